"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that for it was on with be as by at from are this an",
    "fr": "de la le et les des en un du une que est pour qui dans sur par au pas plus",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y los se del las un por con una su para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """A document fails when low > value or value > high; value is 100 * numerator / denominator (denominator 0 passes)."""

    name: str
    numerator: str
    denominator: str | None
    low: int | None
    high: int | None


#: The table. Counts are compared as integers (100 * numerator against limit * denominator), so engines agree exactly.
RULES = (
    Rule("few_words", "n_words", None, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
    Rule("mean_word_length", "word_chars", "n_words", 200, 1400),
    Rule("symbols", "n_symbols", "n_words", None, 25),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 40),
)
BASE_RULES = ("few_words", "repeated_words")


def fails(rule: Rule) -> str:
    """The rule as SQL that Spark and other engines read alike."""
    left = rule.numerator if rule.denominator is None else f"100 * {rule.numerator}"
    limit = (lambda n: f"{n}") if rule.denominator is None else (lambda n: f"{n} * {rule.denominator}")
    parts = [f"{left} < {limit(rule.low)}"] * (rule.low is not None) + [f"{left} > {limit(rule.high)}"] * (rule.high is not None)
    return f"({' OR '.join(parts)})"


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body`: expressions inside lambdas see a bound variable, not a copy."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Up to so many different repeated windows are looked up one by one; more go through a sort.
FEW = 48


def _union(positions: Column) -> Column:
    """Words under the windows that start at the ascending positions."""
    return _let(positions, lambda s: F.aggregate(F.transform(s, lambda i, k: F.when(k + 1 < F.size(s), F.least(F.get(s, k + 1) - i, F.lit(3))).otherwise(3)), F.lit(0).cast("bigint"), lambda a, x: a + x))


def _covered(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are 64-bit hashes. Texts whose windows are all different (one hash set pass tells) stop there. Otherwise
    the repeated hashes come from a sort of longs; if they are few, positions are filtered by them, else (window,
    position) pairs are sorted and positions whose neighbour holds the same window are kept. Each position adds the
    words up to the next, three at most: the union of the windows. Both ways give the same and neither is quadratic.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def by_sort(p: Column) -> Column:
        m = F.size(p)
        same = lambda x, k: F.when((k >= 0) & (k < m), F.get(p, k)["h"] == x["h"]).otherwise(False)
        return _union(F.sort_array(F.filter(F.transform(p, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())))

    def repeated(hashes: Column) -> Column:
        twice = _let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: F.when(i > 0, F.get(s, i - 1) == h).otherwise(False))))
        few = lambda d: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(d, h), i)), lambda i: i.isNotNull())
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = _let(twice, lambda d: F.when(F.size(d) <= FEW, _union(few(d))).otherwise(_let(pairs, by_sort)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(some)

    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(_let(windows, repeated))


def measures(text: Column) -> dict[str, Column]:
    """Columns for every measure of the rules, all built-in functions; a null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    stops = sorted({w for s in STOP_WORDS.values() for w in s.split()})
    return {
        "_words": words,
        "_lines": lines,
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": _covered(F.col("_words")),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("bigint"),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("bigint"),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint"),
    }


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """All columns of `docs`, plus the measures (bigint), base_failed and kept (boolean), each named with `prefix`.

    Null and empty texts have no words: base_failed. Columns of `docs` that clash with a measure are replaced; give a
    prefix to keep them. One projection over the scan: no shuffle, so repeated rows are judged one by one.
    """
    cols = measures(F.col(text))
    split = docs.withColumns({"_words": cols.pop("_words"), "_lines": cols.pop("_lines")})
    # the row number keeps a filter on the verdict above this projection: pushed below, it would copy every measure
    out = split.withColumns({**{f"_m_{k}": v for k, v in cols.items()}, "_m_row": F.monotonically_increasing_id()})
    names = {k: f"_m_{k}" for k in cols}

    def verdict(chosen) -> Column:
        sql = " OR ".join(fails(Rule(r.name, names[r.numerator], r.denominator and names[r.denominator], r.low, r.high)) for r in chosen)
        return F.expr(f"({sql}) AND _m_row >= 0")

    out = out.withColumns({"_m_base_failed": verdict(r for r in rules if r.name in BASE_RULES), "_m_failed": verdict(rules)})
    keep = [c for c in docs.columns if c not in {f"{prefix}{k}" for k in (*names, "base_failed", "kept")}]
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(v).alias(f"{prefix}{k}") for k, v in names.items()], F.col("_m_base_failed").alias(f"{prefix}base_failed"), (~F.col("_m_failed")).alias(f"{prefix}kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The query's columns for each document."""
    base = docs.select("doc_id", "text")
    return judge(base).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def oracle() -> str:
    """The same rows as SQL over the documents view."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS.values() for w in s.split()}))
    any_rule = " OR ".join(fails(r) for r in RULES)
    base = " OR ".join(fails(r) for r in RULES if r.name in BASE_RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(list_filter(words, lambda w: w IN ({stops}))) AS n_stop_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipsis_lines FROM s),
w AS (SELECT doc_id, unnest(words[1:-3]) AS a, unnest(words[2:-2]) AS b, unnest(words[3:]) AS c, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words > 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM w),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, range(3) t(k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT m.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r ON m.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({base}) AS base_failed,
       NOT ({any_rule}) AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_stop_words AS BIGINT) AS n_stop_words FROM f"""
