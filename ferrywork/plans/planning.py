"""Plans of a copy: capabilities, preflight, estimates, lossy conversions, and the manifest of a resumable run."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.functions.types import lossy, mapped_type
from ferrywork.operators import transformers
from ferrywork.operators.mapping import FieldRule
from ferrywork.sources.registry import _fs

# What each provider can do (schema, transactions).
CAPABILITIES = {
    "postgres": (True, True), "mysql": (True, True), "mariadb": (True, True), "cockroachdb": (True, True),
    "mssql": (True, True), "sqlite": (True, False), "mongodb": (True, True), "redis": (False, False),
}


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [(name, schema, transactions, "cross", True) for name, (schema, transactions) in sorted(CAPABILITIES.items())]
    return spark.createDataFrame(rows, "provider string, has_schema boolean, transactions boolean, verification string, incremental boolean")


def preflight(caps: DataFrame, defer_constraints: bool = True) -> DataFrame:
    """For each ordered pair of providers the blockers of a copy with schema migration, joined by `; `."""
    a, b = caps.select(F.col("provider").alias("source"), F.col("has_schema").alias("s")), caps.select(F.col("provider").alias("target"), F.col("has_schema").alias("t"), F.col("transactions").alias("x"))
    pairs = a.join(F.broadcast(b), F.col("source") != F.col("target"))  # a fixed list of providers
    schema = F.when(~F.col("s") & ~F.col("t"), "neither side has a schema").when(~F.col("s"), "source has no schema").when(~F.col("t"), "target has no schema")
    constraints = F.when(~F.col("x"), "target cannot defer constraints") if defer_constraints else F.lit(None).cast("string")
    return pairs.select("source", "target", F.concat_ws("; ", schema, constraints).alias("blockers"))


def estimates(counts: DataFrame, batch: int = 1000) -> DataFrame:
    return counts.select("table", "n", F.ceil(F.col("n") / batch).cast("bigint").alias("batches"))


def effective_level(source: str, target: str) -> str:
    """How deep a copy can be verified: cross where both sides can be read back, none if either is unknown."""
    return "cross" if source in CAPABILITIES and target in CAPABILITIES else "none"


def type_report(columns: DataFrame, source: str, target: str) -> DataFrame:
    """table, column, source_type, target_type, converted, lossy of a catalog's columns; target_type is null where no rule
    fits."""
    kind = mapped_type(F.col("kind"), f"{source}_to_{target}")
    rows = columns.select("table", "column", F.col("kind").alias("source_type"), kind.alias("target_type"))
    return rows.withColumns({"converted": F.col("source_type") != F.col("target_type"), "lossy": F.coalesce(lossy(F.col("source_type"), F.col("target_type")) & (F.col("source_type") != F.col("target_type")), F.lit(False))})


def unsupported(types: DataFrame, rules: dict[str, list[FieldRule]]) -> DataFrame:
    """table, field, reason of what does not come through whole: unmapped and lossy types, dropped fields."""
    reason = F.when(F.col("target_type").isNull(), F.concat(F.lit("no type mapping for "), "source_type")).when(F.col("lossy"), F.concat(F.lit("may lose something: "), "source_type", F.lit(" to "), "target_type"))
    rows = types.select("table", F.col("column").alias("field"), reason.alias("reason")).where("reason is not null")
    dropped = [(t, r.source, "dropped by a field rule") for t, own in sorted(rules.items()) for r in own if r.resolved() == "drop"]
    return rows.unionByName(types.sparkSession.createDataFrame(dropped, "table string, field string, reason string"))


def field_report(spark: SparkSession, rules: dict[str, list[FieldRule]]) -> DataFrame:
    """table, rules (how many), actions (different ones, in the order of their first use); a rule without an action renames."""
    rows = [(t, len(own), list(dict.fromkeys(r.action or "rename" for r in own))) for t, own in sorted(rules.items())]
    return spark.createDataFrame(rows, "table string, rules int, actions array<string>")


def blockers(source: str, target: str, tables: int | None, schema: bool = True, fk: str = "defer_constraints") -> list[str]:
    """What forbids a copy before it starts: no transformer, schemas or transactions that a side lacks, an empty source."""
    out = []
    if source != target and not transformers.has(source, target):
        out.append(f"no transformer from {source} to {target}")
    s, t = (CAPABILITIES.get(p, (False, False)) for p in (source, target))
    if schema and not (s[0] and t[0]):
        out.append("neither side has a schema" if not s[0] and not t[0] else "source has no schema" if not s[0] else "target has no schema")
    if fk == "defer_constraints" and not t[1]:
        out.append("target cannot defer constraints")
    if s[0] and tables == 0:
        out.append("source has no tables")
    return out


def warnings(source: str, target: str, rows: int, tables: int, verify: bool = True, fk: str = "defer_constraints") -> list[str]:
    """What a plan warns of: nothing can be verified, no estimate, constraints that cannot be deferred."""
    out = []
    if verify and effective_level(source, target) == "none":
        out.append("verification was asked for, but a side cannot be read back")
    if not rows and not tables and not CAPABILITIES.get(source, (False,))[0]:
        out.append("the source cannot list tables, so rows are not estimated")
    if fk == "defer_constraints" and not CAPABILITIES.get(target, (False, False))[1]:
        out.append(f"{target} has no transactions, so constraints cannot be deferred")
    return out


# URL schemes and the providers they stand for.
SCHEMES = {
    "postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mariadb": "mariadb", "cockroachdb": "cockroachdb", "crdb": "cockroachdb",
    "mongodb": "mongodb", "mongodb+srv": "mongodb", "mssql": "mssql", "sqlserver": "mssql", "sqlite": "sqlite", "redis": "redis", "rediss": "redis",
}


def provider_of(url: str) -> str:
    """The provider that a URL's scheme stands for; empty for others."""
    return SCHEMES.get(url.partition("://")[0].lower(), "") if "://" in url else ""


@dataclass
class Manifest:
    """The state of a run, kept as one JSON file that is written aside and renamed; a changed file is not accepted."""

    config: dict
    completed: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)
    version: int = 3

    @staticmethod
    def config_digest(config: dict) -> str:
        """A digest of a configuration that does not hang on the order of its entries."""
        return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()

    def _digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Written aside and renamed: by Hadoop's file system where a session is given, so that the folder may be any that
        the cluster shares; on this machine otherwise."""
        if ".." in path.split("/"):
            raise ValueError("a manifest's path goes down only")
        text = json.dumps(asdict(self) | {"digest": self._digest()})
        if spark is None:
            with open(f"{path}.tmp", "w") as f:
                f.write(text)
            os.replace(f"{path}.tmp", path)
            return
        fs, at = _fs(spark, path)
        out = fs.create(at(f"{path}.tmp"), True)
        out.write(text.encode())
        out.close()
        fs.delete(at(path), False)
        fs.rename(at(f"{path}.tmp"), at(path))

    @classmethod
    def load(cls, path: str, config: dict, spark: SparkSession | None = None) -> Manifest:
        """The manifest at the path, or the one written aside if the run broke off before it was renamed."""
        if spark is None:
            with open(path) as f:
                data = json.load(f)
        else:
            fs, at = _fs(spark, path)
            name = path if fs.exists(at(path)) else f"{path}.tmp"
            data = json.loads(spark.read.text(name, wholetext=True).first()[0])
        digest = data.pop("digest", "")
        found = cls(**data)
        if found.version != 3 or digest != found._digest():
            raise ValueError("the manifest was changed or has another version")
        if found.config != config:
            raise ValueError("the manifest belongs to another configuration")
        return found

    def remaining(self, tables: list[str]) -> list[str]:
        return [t for t in sorted(tables) if t not in self.completed]


def table_order(tables: list[str], references: list[tuple[str, str]]) -> list[str]:
    """Tables with those they refer to first; tables in a cycle come last, by name."""
    out: list[str] = []
    left = set(tables)
    while left:
        free = sorted(t for t in left if not any(a == t and b in left and b != t for a, b in references)) or sorted(left)
        out += free
        left -= set(free)
    return out
