"""Verification: counts, records, checksums, field differences and their roll-up."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywork.functions.values import normalized_table, row_checksum, values_equal


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n: one aggregate a table, united."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()))


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """table, source_n, target_n, status: FAIL where they differ; a missing table counts 0."""
    a = source.groupBy(normalized_table(F.col("table")).alias("table")).agg(F.sum("n").alias("source_n"))
    b = target.groupBy(normalized_table(F.col("table")).alias("table")).agg(F.sum("n").alias("target_n"))
    both = a.join(b, "table", "full_outer").select("table", F.coalesce("source_n", F.lit(0)).cast("bigint").alias("source_n"), F.coalesce("target_n", F.lit(0)).cast("bigint").alias("target_n"))
    return both.withColumn("status", F.when(F.col("source_n") == F.col("target_n"), "PASS").otherwise("FAIL"))


def _sides(source: DataFrame, target: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Records of both sides by key (null keys equal each other): _a and _b are structs of all columns, null on a side
    that lacks the record; and the fields that either side has."""
    a = source.select(F.struct(*source.columns).alias("_a"), *(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)))
    b = target.select(F.struct(*target.columns).alias("_b"), *(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)))
    on = reduce(Column.__and__, (F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))))
    fields = [c for c in source.columns if c not in keys] + [c for c in target.columns if c not in keys and c not in source.columns]
    both = a.join(b, on, "full_outer")
    return both.select(*(F.when(F.col("_a").isNotNull(), F.col(f"_a{i}")).otherwise(F.col(f"_b{i}")).alias(k) for i, k in enumerate(keys)), "_a", "_b"), fields


def _same(source: DataFrame, target: DataFrame, field: str) -> Column:
    """Whether a field is equal; a field that one side lacks differs, whatever the other holds."""
    if field not in source.columns or field not in target.columns:
        return F.lit(False)
    kinds = dict(source.dtypes)[field], dict(target.dtypes)[field]
    return values_equal(F.col(f"_a.{field}"), F.col(f"_b.{field}"), *kinds)


# Categories of mismatches.
MISSING, EXTRA, VALUE, CHECKSUM, COUNT = "missing_in_destination", "extra_in_destination", "value_diff", "checksum_diff", "count_mismatch"


def compare_records(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys and category of each record that differs: missing, extra or value_diff. One full outer join. Fields are those
    of either side: a column that one side lost makes every record differ."""
    both, fields = _sides(source, target, keys)
    same = reduce(Column.__and__, (_same(source, target, c) for c in fields), F.lit(True))
    category = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~same, "value_diff")
    return both.select(*keys, category.alias("category")).where("category is not null")


def field_differences(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, source_value, target_value of each field, of either side, that differs in a record on both sides."""
    both, fields = _sides(source, target, keys)
    text = lambda side, df, c: F.col(f"{side}.{c}").cast("string") if c in df.columns else F.lit(None).cast("string")
    pairs = [F.struct(F.lit(c).alias("field"), text("_a", source, c).alias("source_value"), text("_b", target, c).alias("target_value"), _same(source, target, c).alias("same")) for c in fields]
    if not pairs:
        return both.select(*keys, *(F.lit(None).cast("string").alias(n) for n in ("field", "source_value", "target_value"))).where("false")
    rows = both.where("_a is not null and _b is not null").select(*keys, F.explode(F.filter(F.array(*pairs), lambda x: ~x["same"])).alias("d"))
    return rows.select(*keys, "d.field", "d.source_value", "d.target_value")


def compare_checksums(source: DataFrame, target: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    a, b = (df.select(*keys, row_checksum(columns).alias(n)) for df, n in ((source, "_a"), (target, "_b")))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "checksum_diff").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def absent(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).join(right.select(*keys), keys, "left_anti")


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def sample_size(total: Column, n: int, percent: float = 0.0) -> Column:
    """A share of the total (cut, one at least) if a percentage is given, else at most n."""
    return F.least(total, F.greatest(F.lit(1), F.floor(total * percent / 100))).cast("bigint") if percent else F.least(total, F.lit(n)).cast("bigint")


def roll_up(results: DataFrame) -> DataFrame:
    """tables, passed, failed, warned, status of table results."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = results.agg(F.count(F.lit(1)).alias("tables"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("WARN").alias("warned"))
    return out.withColumn("status", F.when(F.col("tables") == 0, "SKIPPED").when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").otherwise("PASS"))


def basic(tables: dict[str, DataFrame], expected: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """table, ok: without keys, whether a table has rows; with them, whether it holds all the expected ones."""
    if expected is None:
        return counts(tables).select("table", (F.col("n") > 0).alias("ok"))
    lost = [absent(expected, df, keys or []).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), (F.col("n") == 0).alias("ok")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, lost)


# Providers with tables.
SQL_PROVIDERS = ("sqlite", "mysql", "postgres", "mariadb", "cockroachdb", "mssql")


def remapped(source: DataFrame, target: DataFrame, source_name: str, target_name: str) -> tuple[DataFrame, DataFrame]:
    """Counts (table, n) of both sides where one is a key-value store that counts all keys under one name.

    If the total is the sum of the other side's tables, it is taken apart as these tables; else both stay. One row a
    table: totals join by broadcast.
    """

    def apart(whole: DataFrame, parts: DataFrame) -> DataFrame:
        one = whole.agg(F.count(F.lit(1)).alias("_rows"), F.max("table").alias("_name"), F.sum("n").alias("_n"))
        other = parts.agg(F.count(F.lit(1)).alias("_tables"), F.sum("n").alias("_sum"))
        fits = F.broadcast(one.join(other, F.lit(True)).select(((F.col("_rows") == 1) & (F.col("_name") == "") & (F.col("_tables") > 0) & (F.col("_n") == F.col("_sum"))).alias("_fits")))
        return parts.join(fits, F.col("_fits")).select("table", "n").unionByName(whole.join(fits, ~F.col("_fits")).select("table", "n"))

    if target_name == "redis" and source_name in SQL_PROVIDERS:
        return source, apart(target, source)
    if source_name == "redis" and target_name == "mongodb":
        return apart(source, target), target
    return source, target


@dataclass(frozen=True)
class Options:
    """What is verified. sample_mode: none, count (sample_n rows a table) or pct (sample_pct percent, one row at least)."""

    counts: bool = True
    sample_mode: str = "pct"
    sample_n: int = 100
    sample_pct: float = 5.0
    checksums: bool = True
    seed: int = 42
    max_sample_keys: int = 10_000

    def __post_init__(self):
        if self.sample_mode not in ("none", "count", "pct"):
            raise ValueError(f"unknown sample mode {self.sample_mode}")
        if self.sample_mode == "count" and self.sample_n <= 0:
            raise ValueError("sample_n must be positive")
        if self.sample_mode == "pct" and not 0 < self.sample_pct <= 100:
            raise ValueError("sample_pct must be above 0 and at most 100")

    def size(self, total: int) -> int:
        if self.sample_mode == "none" or not total:
            return 0
        return min(total, self.sample_n if self.sample_mode == "count" else max(1, int(total * self.sample_pct / 100)))


def sampled(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n records, the same for the same seed: the smallest hashes of keys. A top-n, kept small in each task."""
    return df.withColumn("_h", F.xxhash64(*(F.col(k).cast("string") for k in keys), F.lit(seed))).orderBy("_h", *keys).limit(n).drop("_h")


def sample_checks(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, list[str]], results: DataFrame, options: Options, same_engine: bool) -> tuple[DataFrame, DataFrame]:
    """Sampled tables (table, target, checked, mismatched) and mismatches (table, key, category) of tables whose counts
    agree, in the order of names until the budget of keys is used up. Checksums are compared within one engine only."""
    found, details, left = [], [], options.max_sample_keys or 10_000
    for row in results.where("status = 'PASS'").orderBy("table").collect():  # one row a table
        name = row["table"]
        n = min(options.size(row["source_n"]), left)
        if not n or name not in source or name not in target:
            continue
        left -= n
        mine = sampled(source[name], keys[name], n, options.seed)
        theirs = target[name].join(mine.select(*keys[name]), keys[name], "left_semi")
        if options.checksums and same_engine and source[name].columns == target[name].columns:
            columns = [F.col(c) for c in source[name].columns]
            diff = compare_checksums(mine, theirs, keys[name], columns).where("status <> 'same'").select(*keys[name], F.col("status").alias("category"))
        else:
            diff = compare_records(mine, theirs, keys[name])
        key = F.concat_ws(",", *(F.col(k).cast("string") for k in keys[name]))
        diff = diff.select(F.lit(name).alias("table"), key.alias("key"), F.when(F.col("category") == "missing", MISSING).when(F.col("category") == "extra", EXTRA).otherwise(F.col("category")).alias("category"))
        details.append(diff)
        found.append(diff.agg(F.count(F.lit(1)).alias("mismatched")).select(F.lit(name).alias("table"), F.lit(n).cast("bigint").alias("target"), F.lit(n).cast("bigint").alias("checked"), "mismatched"))
    spark = results.sparkSession
    whole = lambda parts, schema: reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return whole(found, "table string, target bigint, checked bigint, mismatched bigint"), whole(details, "table string, key string, category string")


@dataclass
class Report:
    """Results by table (table, source_n, target_n, sampled, mismatched, status) and mismatches (table, key, category)."""

    source: str
    target: str
    tables: list[dict]
    mismatches: list[dict]
    skipped: list[str]
    seconds: float = 0.0

    def count(self, status: str) -> int:
        return sum(t["status"] == status for t in self.tables)

    @property
    def status(self) -> str:
        return "SKIPPED" if not self.tables else next((s for s in ("FAIL", "WARN") if self.count(s)), "PASS")

    def text(self, most: int = 20) -> str:
        """The report as text: totals, a line a table, the first mismatches."""
        a, b = (sum(t[n] for t in self.tables) for n in ("source_n", "target_n"))
        sampled = sum(t["sampled"] for t in self.tables)
        lines = [f"Verification {self.source} to {self.target}: {self.status}", f"tables {len(self.tables)}, passed {self.count('PASS')}, failed {self.count('FAIL')}, warned {self.count('WARN')}", f"rows {a} source, {b} target ({b - a:+d})"]
        if sampled and a:
            lines.append(f"sampled {sampled} ({100 * sampled / a:.1f} % of source rows)")
        for t in sorted(self.tables, key=lambda t: t["table"]):
            name = t["table"] if len(t["table"]) <= 30 else t["table"][:27] + "..."
            lines.append(f"{name:<30} {t['source_n']:>10} {t['target_n']:>10} {t['target_n'] - t['source_n']:>+7} {t['sampled'] or '-':>7} {t['mismatched']:>7} {t['status']}")
        lines += [f"  [{m['category']}] {m['table']} {m['key']}" for m in self.mismatches[:most]]
        if len(self.mismatches) > most:
            lines.append(f"  and {len(self.mismatches) - most} more")
        return "\n".join([*lines, *(f"skipped: {s}" for s in self.skipped)])

    def line(self) -> str:
        return f"Verification: {self.status} ({len(self.tables)} tables, {sum(t['sampled'] for t in self.tables)} sampled)"

    def json(self) -> str:
        return json.dumps(asdict(self) | {"status": self.status}, indent=2, default=str)


#: Mismatches that a report holds at most; their number is counted whole.
LISTED = 1000


def verification(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, list[str]], options: Options = Options(), same_engine: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Results by table and all mismatches: counts, then samples of tables whose counts agree. A differing count is FAIL,
    a differing sample WARN."""
    results = compare_counts(counts(source), counts(target)) if source and target else None
    if results is None or not options.counts:
        raise ValueError("nothing to verify")
    checks, details = sample_checks(source, target, keys, results, options, same_engine)
    status = F.when((F.col("status") == "PASS") & (F.coalesce("mismatched", F.lit(0)) > 0), "WARN").otherwise(F.col("status"))
    by_table = results.join(checks, "table", "left").select("table", "source_n", "target_n", F.coalesce("checked", F.lit(0)).cast("bigint").alias("sampled"), F.coalesce("mismatched", F.lit(0)).cast("bigint").alias("mismatched"), status.alias("status"))
    uneven = results.where("status = 'FAIL'").select("table", F.lit("").alias("key"), F.lit(COUNT).alias("category"))
    return by_table, uneven.unionByName(details)


def report(source_name: str, target_name: str, by_table: DataFrame, mismatches: DataFrame, seconds: float = 0.0, most: int = LISTED) -> Report:
    """One row a table and the first mismatches, in order, come to the driver."""
    return Report(source_name, target_name, [r.asDict() for r in by_table.orderBy("table").collect()], [r.asDict() for r in mismatches.orderBy("table", "key").limit(most).collect()], [], seconds)
