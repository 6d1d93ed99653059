"""A copy from one provider to another: plan, run with resumption and retries, verification."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.operators import accounting, transformers
from ferrywork.operators import verify as checks
from ferrywork.operators.mapping import FieldRule
from ferrywork.operators.transformers import Context
from ferrywork.plans import ddl, planning
from ferrywork.sources import registry, writers

# Kinds of failures with attempts, first and longest pause in seconds, and what each pause grows by.
RETRIES = {
    "config": (1, 0.0, 0.0, 1.0),
    "connection": (3, 1.0, 10.0, 2.0),
    "scan": (3, 0.5, 10.0, 2.0),
    "transform": (1, 0.0, 0.0, 1.0),
    "write": (5, 0.5, 30.0, 2.0),
    "schema": (2, 1.0, 5.0, 2.0),
    "verify": (1, 0.0, 0.0, 1.0),
    "cancelled": (0, 0.0, 0.0, 1.0),
    "internal": (1, 0.0, 0.0, 1.0),
}


class CopyError(Exception):
    """A failure with its kind, and the table it happened in."""

    def __init__(self, kind: str, message: str, table: str = ""):
        super().__init__(message)
        self.kind, self.table = kind, table


def kind_of(error: BaseException) -> str:
    """The kind of a failure: its own, else by what it is."""
    if isinstance(error, CopyError):
        return error.kind
    if isinstance(error, (KeyboardInterrupt,)):
        return "cancelled"
    if isinstance(error, (ConnectionError, TimeoutError)):
        return "connection"
    return "config" if isinstance(error, ValueError) else "internal"


def pause(kind: str, attempt: int) -> float:
    """Seconds to wait after a failed attempt (from 0): the first pause, grown by its factor, the longest at most."""
    _, first, longest, factor = RETRIES[kind]
    return min(first * factor**attempt, longest)


def with_retries(run: Callable[[], object], kind: str, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of run(), tried as often as its kind of failure allows. Failures that are not of that kind by name are
    retried too, but never a wrong configuration or a cancelled run."""
    attempts = max(1, RETRIES[kind][0])
    for attempt in range(attempts):
        try:
            return run()
        except Exception as error:
            if attempt == attempts - 1 or kind_of(error) in ("config", "cancelled", "transform"):
                raise
            sleep(pause(kind, attempt))
    return None


@dataclass(frozen=True)
class Options:
    """How a copy runs. Spark bounds the memory of a task itself; batch sizes shape statements and estimates only."""

    batch_size: int = 1000
    max_batch_bytes: int = 32 << 20
    conflict: str = "overwrite"
    migrate_schema: bool = True
    fk_handling: str = "defer_constraints"
    max_retries: int = 3
    parallel: int = 4
    fail_fast: bool = False
    dry_run: bool = False
    resume: bool = False
    verify: bool = True
    verify_mode: str = "cross"
    verification: checks.Options = field(default_factory=checks.Options)

    def __post_init__(self):
        for name, least in (("batch_size", 1), ("parallel", 1), ("max_retries", 0), ("max_batch_bytes", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        for name, allowed in (("conflict", ("overwrite", "skip", "error")), ("fk_handling", ("defer_constraints", "ordered", "skip")), ("verify_mode", ("basic", "cross"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")


class Side:
    """One side of a copy: a provider and where it lies. Tables are DataFrames; keys are those of the provider's own
    catalog, or given. `path` is an SQLite file, a folder of Parquet tables (any provider with tables, as exported), or a
    folder of JSON lines (documents, records)."""

    def __init__(self, spark: SparkSession, provider: str, path: str, keys: dict[str, list[str]] | None = None, references: list[tuple[str, str, str, str]] | None = None):
        if provider not in planning.CAPABILITIES:
            raise CopyError("config", f"unknown provider {provider}")
        self.spark, self.provider, self.path, self._keys, self._references = spark, provider, path, keys or {}, references or []

    @property
    def flat(self) -> bool:
        return self.provider in transformers.SQL

    def catalog(self) -> list[ddl.TableOf]:
        """Tables in order; documents and records have no columns of their own."""
        if self.provider == "sqlite":
            return ddl.inspect_sqlite(self.path)
        found = ddl.inspect_frames({n: self.read(n) for n in registry.tables(self.spark, self.path)}, self._keys)
        for t in found:
            t.references = [(c, r, f) for own, c, r, f in self._references if own == t.name]
        return found

    def read(self, table: str) -> DataFrame:
        if self.provider == "sqlite":
            return registry.read(self.spark, "sqlite", path=self.path, table=table)
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")

    def keys(self, table: str) -> list[str]:
        own = self._keys.get(table)
        return own or next((t.key for t in self.catalog() if t.name == table), [])

    def documents(self) -> DataFrame:
        return self.spark.read.schema("_id string, collection string, document string").json(f"{self.path}/documents")

    def records(self) -> DataFrame:
        return self.spark.read.schema(registry.HASHES).json(f"{self.path}/records")

    def create(self, table: ddl.TableOf) -> None:
        if self.provider == "sqlite":
            writers.ensure_sqlite(self.path, table)

    def write(self, df: DataFrame, table: str, keys: list[str], strategy: str) -> None:
        if self.provider == "sqlite":
            writers.write_sqlite(df, self.path, table, keys, strategy)
        elif self.flat:
            registry.write(df, f"{self.path}/{table}.parquet", keys, strategy)
        elif self.provider == "mongodb":
            writers.write_documents(df.select("_id", "collection", "document"), f"{self.path}/documents", strategy)
        else:
            writers.write_records(df, f"{self.path}/records", strategy)


@dataclass
class Plan:
    """What a copy would do: tables with rows and batches, types, field rules, what is lost, warnings and blockers."""

    source: str
    target: str
    tables: list[dict]
    statements: list[str]
    types: list[dict]
    fields: list[dict]
    unsupported: list[dict]
    warnings: list[str]
    blockers: list[str]

    @property
    def rows(self) -> int:
        return sum(t["n"] for t in self.tables)

    @property
    def batches(self) -> int:
        return sum(t["batches"] for t in self.tables)

    def text(self) -> str:
        """The plan as text: totals, a line a table, then what to look at."""
        lines = [f"{self.source} to {self.target}: {len(self.tables)} tables, {self.rows} rows, {self.batches} batches"]
        lines += [f"  {t['table']}: {t['n']} rows, {t['batches']} batches" for t in self.tables]
        lines += [f"  {u['table']}.{u['field']}: {u['reason']}" for u in self.unsupported]
        return "\n".join([*lines, *(f"warning: {w}" for w in self.warnings), *(f"blocked: {b}" for b in self.blockers)])


class Migration:
    """plan(), run() and verify() of a copy. A manifest in `state` (a path that all machines share) lets a run that broke
    off go on: tables that are done are left out, the one that was being written is written again, which by its keys
    changes nothing twice."""

    def __init__(self, source: Side, target: Side, options: Options | None = None, rules: dict[str, list[FieldRule]] | None = None, nulls: str = "passthrough", state: str = "", report: Callable[[str, dict], None] | None = None):
        self.source, self.target, self.options = source, target, options or Options()
        self.rules, self.nulls, self.state, self.report = rules or {}, nulls, state, report or (lambda event, details: None)
        self.spark, self.cancelled, self.progress, self.failures = source.spark, False, accounting.Progress(), []

    @property
    def config(self) -> dict:
        return {"source": self.source.provider, "target": self.target.provider, "conflict": self.options.conflict, "nulls": self.nulls, "rules": {t: [asdict(r) for r in own] for t, own in sorted(self.rules.items())}}

    def cancel(self) -> None:
        """Ends the run before the next table; it can be resumed."""
        self.cancelled = True

    def ordered(self, tables: list[ddl.TableOf]) -> list[ddl.TableOf]:
        """Tables with those they refer to first, unless references are left alone."""
        if self.options.fk_handling == "skip":
            return tables
        by_name = {t.name: t for t in tables}
        return [by_name[n] for n in planning.table_order(list(by_name), [(t.name, r) for t in tables for _, r, _ in t.references])]

    def plan(self) -> Plan:
        tables = self.source.catalog() if self.source.flat else []
        spark, a, b = self.spark, self.source.provider, self.target.provider
        counted = [r.asDict() for r in planning.estimates(checks.counts({t.name: self.source.read(t.name) for t in tables}), self.options.batch_size).orderBy("table").collect()] if tables else []
        types, lost, statements = [], [], []
        if self.source.flat and self.target.flat and a != b and tables:
            mapped = planning.type_report(ddl.catalog(spark, tables)[0], a, b)
            types = [r.asDict() for r in mapped.orderBy("table", "column").collect()]  # one row a column
            lost = [r.asDict() for r in planning.unsupported(mapped, self.rules).orderBy("table", "field").collect()]
        if self.target.flat and self.options.migrate_schema:
            statements = [ddl.create_table(t, b) for t in ddl.converted(spark, tables, a, b)]
        fields = [r.asDict() for r in planning.field_report(spark, self.rules).collect()]
        warned = planning.warnings(a, b, sum(t["n"] for t in counted), len(counted), self.options.verify, self.options.fk_handling)
        stopped = planning.blockers(a, b, len(tables) if self.source.flat else None, self.options.migrate_schema and self.source.flat and self.target.flat, "skip" if not self.target.flat else self.options.fk_handling)
        return Plan(a, b, counted, statements, types, fields, lost, warned, stopped)

    def transformed(self, table: ddl.TableOf | None, df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows as the target takes them, and those that the null policy keeps out."""
        name = table.name if table else ""
        stamps = [c.name for c in table.columns if c.kind.upper().startswith(("DATETIME", "TIMESTAMP", "SMALLDATETIME"))] if table else []
        context = Context(name, table.key if table else [], table.references if table else [], self.rules, self.nulls, stamps, columns)
        out = transformers.transform(df, self.source.provider, self.target.provider, context)
        return (out.drop("schema") if self.target.flat else out), transformers.rejected(df, context)

    def keys_after(self, table: ddl.TableOf) -> list[str]:
        """Key columns by the names that field rules give them."""
        renamed = {r.source: r.target for r in self.rules.get(table.name, self.rules.get("*", [])) if r.resolved() == "rename"}
        return [renamed.get(k, k) for k in table.key]

    def run(self) -> dict:
        """Copies all tables; returns what was scanned, written, failed and skipped."""
        stopped = self.plan().blockers if self.source.flat else planning.blockers(self.source.provider, self.target.provider, None, False, "skip")
        if stopped:
            raise CopyError("config", "; ".join(stopped))
        manifest = planning.Manifest(self.config)
        if self.options.resume and self.state:
            manifest = planning.Manifest.load(self.state, self.config, self.spark)
        if not self.source.flat:
            return self._run_unflat(manifest)
        tables = self.ordered(self.source.catalog())
        shaped = {t.name: t for t in ddl.converted(self.spark, tables, self.source.provider, self.target.provider)} if self.target.flat else {}
        for table in tables:
            if table.name in manifest.completed:
                continue
            if self.cancelled:
                break
            self._copy(table, shaped.get(table.name), manifest)
        return self.summary()

    def _copy(self, table: ddl.TableOf, shape: ddl.TableOf | None, manifest: planning.Manifest) -> None:
        began = time.monotonic()
        try:
            df = with_retries(lambda: self.source.read(table.name), "scan")
            out, bad = self.transformed(table, df, df.columns)
            scanned, refused = df.count(), bad.count()
            if refused and self.options.fail_fast:
                raise CopyError("transform", f"{refused} rows hold nulls", table.name)
            keys = self.keys_after(table)
            if not self.options.dry_run:
                if shape is not None and self.options.migrate_schema:
                    renamed = {r.source: r.target for r in self.rules.get(table.name, self.rules.get("*", [])) if r.resolved() == "rename"}
                    kept = [ddl.ColumnOf(renamed.get(c.name, c.name), c.kind, c.nullable, c.default, c.auto) for c in shape.columns if renamed.get(c.name, c.name) in out.columns]
                    known = {c.name for c in kept}
                    kept += [ddl.ColumnOf(n, "TEXT") for n in out.columns if n not in known]
                    with_retries(lambda: self.target.create(ddl.TableOf(table.name, kept, keys)), "schema")
                with_retries(lambda: self.target.write(out, table.name, keys, self.options.conflict), "write")
        except Exception as error:
            self.failures.append((kind_of(error), table.name, str(error)[:500]))
            self.report("failed", {"table": table.name, "kind": kind_of(error)})
            if self.options.fail_fast or kind_of(error) in ("config", "cancelled"):
                raise
            return
        self.progress.add(scanned, scanned - refused, refused, seconds=time.monotonic() - began)
        manifest.completed.append(table.name)
        manifest.rows[table.name] = scanned - refused
        if self.state and not self.options.dry_run:
            manifest.save(self.state, self.spark)
        self.report("table", {"table": table.name, "rows": scanned - refused, "seconds": time.monotonic() - began})

    def _run_unflat(self, manifest: planning.Manifest) -> dict:
        """Documents or records. To tables, each collection becomes one, with a text column for every field met."""
        began = time.monotonic()
        df = self.source.documents() if self.source.provider == "mongodb" else self.source.records()
        held = F.col("collection") if self.source.provider == "mongodb" else F.split("key", ":", 2)[0]
        names = F.explode(F.map_keys(F.from_json("document", "map<string,variant>") if self.source.provider == "mongodb" else F.col("value")))
        fields = df.select(held.alias("table"), names.alias("field")).distinct().groupBy("table").agg(F.array_sort(F.collect_set("field")).alias("fields")).orderBy("table").collect()  # one row a table
        scanned = df.count()
        for row in fields:
            if row["table"] in manifest.completed or self.cancelled:
                continue
            own, key = df.where(held == row["table"]), "_id" if self.source.provider == "mongodb" else "_key"
            columns = [f for f in row["fields"] if f != "_id"]
            table = ddl.TableOf(row["table"], [ddl.ColumnOf(n, "TEXT") for n in (key, *columns)], [key]) if self.target.flat else None
            out, _ = self.transformed(table, own, columns)
            if not self.options.dry_run:
                if table is not None:
                    self.target.create(table)
                with_retries(lambda out=out, row=row, key=key: self.target.write(out, row["table"], [key], self.options.conflict), "write")
            manifest.completed.append(row["table"])
            if self.state and not self.options.dry_run:
                manifest.save(self.state, self.spark)
        self.progress.add(scanned, scanned, seconds=time.monotonic() - began)
        return self.summary()

    def summary(self) -> dict:
        by_kind = {k: sum(f[0] == k for f in self.failures) for k in {f[0] for f in self.failures}}
        return asdict(self.progress) | {"throughput": self.progress.throughput(), "failures": by_kind, "errors": self.failures[:100]}

    def verify(self) -> checks.Report:
        """Compares both sides: counts, then samples, of tables; for a key-value target the total of its keys."""
        began, options = time.monotonic(), self.options.verification
        names = {t.name: t for t in self.source.catalog()} if self.source.flat else {}
        if self.source.flat and self.target.flat:
            there = {t.name for t in self.target.catalog()}
            source = {n: self.transformed(t, self.source.read(n), [])[0] for n, t in names.items()}
            target = {n: self.target.read(n) for n in names if n in there}
            keys = {n: self.keys_after(t) for n, t in names.items()}
            lacking = {n: df.limit(0) for n, df in source.items() if n not in target}
            by_table, details = checks.verification(source, target | lacking, keys, options, self.source.provider == self.target.provider)
            return checks.report(self.source.provider, self.target.provider, by_table, details, time.monotonic() - began)
        if self.source.flat:
            a = checks.counts({n: self.source.read(n) for n in names})
        else:
            a = self._groups(self.source)
        b = checks.counts({t.name: self.target.read(t.name) for t in self.target.catalog()}) if self.target.flat else self._groups(self.target)
        a, b = checks.remapped(a, b, self.source.provider, self.target.provider)
        results = checks.compare_counts(a, b).withColumns({"sampled": F.lit(0), "mismatched": F.lit(0)})
        uneven = results.where("status = 'FAIL'").select("table", F.lit("").alias("key"), F.lit(checks.COUNT).alias("category"))
        return checks.report(self.source.provider, self.target.provider, results, uneven, time.monotonic() - began)

    def _groups(self, side: Side) -> DataFrame:
        if side.provider == "mongodb":
            return side.documents().groupBy(F.col("collection").alias("table")).agg(F.count(F.lit(1)).alias("n"))
        if "mongodb" in (self.source.provider, self.target.provider) or not self.source.flat:
            return side.records().groupBy(F.split("key", ":", 2)[0].alias("table")).agg(F.count(F.lit(1)).alias("n"))
        return side.records().agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("table"), "n")


class Runs:
    """Runs of this session and their state, newest first; kept as rows of one JSON-lines table if a path is given."""

    def __init__(self, spark: SparkSession, path: str = ""):
        self.spark, self.path, self.rows = spark, path, []
        if path and registry.exists(spark, path):
            self.rows = [r.asDict() for r in spark.read.schema("id string, started double, status string, detail string").json(path).collect()]

    def run(self, name: str, migration: Migration) -> dict:
        row = {"id": name, "started": time.time(), "status": "running", "detail": ""}
        self.rows.append(row)
        try:
            done = migration.run()
            row["status"] = "cancelled" if migration.cancelled else "failed" if done["failures"] else "done"
            return done
        except Exception as error:
            row |= {"status": "failed", "detail": str(error)[:500]}
            raise
        finally:
            if self.path:
                registry.replace(self.spark.createDataFrame(self.rows, "id string, started double, status string, detail string"), self.path, "json")

    def listed(self, most: int = 20) -> list[dict]:
        return sorted(self.rows, key=lambda r: (-r["started"], r["id"]))[:most]
