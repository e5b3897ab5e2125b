"""Quality rules: line-first cleaning. DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text is rejected.

Cases: a null text counts as empty; an empty text has no words, fails the word minimum and is not kept. A line
without a word is neither judged nor removed. Rows are judged one by one, so repeated rows give repeated
results; other columns pass through, and the added columns replace any of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyspark.llm.common import free_prefix

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-ZÀ-ÖØ-Þ]"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
BARS = "[|»›•]"
BOILERPLATE = (
    "licensed under the|general public license|all rights reserved|terms of (use|service)|privacy policy|"
    "cookie policy|accept cookies|subscribe to our|sign up for our|javascript is (disabled|required)"
)
RULES = ("symbols", "shouting", "navigation", "boilerplate")


@dataclass(frozen=True)
class LineRules:
    """Limits; shares are percents."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_exclaim_percent: int = 25
    max_upper_percent: int = 60
    min_shout_words: int = 4
    max_bar_percent: int = 20
    min_bars: int = 2
    max_boilerplate_words: int = 60
    max_lost_percent: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def line_fault(line: Column, n_words: Column, p: LineRules) -> Column:
    """The first rule that ``line`` fails, or null."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    shouts = (count("!") * 100 > n_words * p.max_exclaim_percent) | (count(UPPER) * 100 > count(LETTER) * p.max_upper_percent)
    bars = lambda n: (n >= p.min_bars) & (n * 100 > n_words * p.max_bar_percent)
    return (
        F.when(n_words == 0, F.lit(None))
        .when(count(SYMBOLS) * 100 > F.length(line) * p.max_symbol_percent, "symbols")
        .when((n_words >= p.min_shout_words) & shouts, "shouting")
        .when(_let(count(BARS), bars), "navigation")
        .when((n_words <= p.max_boilerplate_words) & F.lower(line).rlike(BOILERPLATE), "boilerplate")
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted by hash, equal neighbours marked, cover counted.

    Only texts with an equal pair of windows are sorted.
    """

    def marked(ordered: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last"))
    cover = lambda at: F.aggregate(at, start, step, lambda s: s["n"])
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, cover(_let(ordered, marked))).otherwise(F.lit(0).cast("long"))


def clean_lines(docs: DataFrame, rules: LineRules | None = None, text: str = "text") -> DataFrame:
    """Adds the base counts, ``base_failed``, ``n_lines``, ``n_bad_lines``, ``n_lost_words``, ``clean_text`` and ``kept``."""
    p = rules or LineRules()
    t = F.coalesce(F.col(text), F.lit(""))
    words = words_of(t)
    pair = lambda ws: F.transform(
        F.when(F.size(ws) >= 3, F.slice(ws, 1, F.greatest(F.lit(0), F.size(ws) - 2))).otherwise(F.array().cast("array<string>")),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
    )
    worded = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    lines = F.split(t, "\n")
    helper = {name: free_prefix(docs) + name for name in ("words", "all", "lines", "hashes", "judged")}
    out = docs.withColumns({helper["words"]: words, helper["all"]: lines, helper["lines"]: F.filter(lines, worded)})
    out = out.withColumns(
        {
            "n_words": F.size(helper["words"]).cast("long"),
            "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(helper["lines"]) - F.size(F.array_distinct(helper["lines"]))).cast("long"),
            helper["hashes"]: pair(F.col(helper["words"])),
            helper["judged"]: F.transform(
                helper["all"],
                lambda x: _let(F.size(words_of(x)), lambda n: F.struct(x.alias("line"), line_fault(x, n, p).alias("fault"), n.alias("n"))),
            ),
        }
    ).drop(helper["words"], helper["all"])
    bad = F.filter(helper["judged"], lambda x: x["fault"].isNotNull())
    out = out.withColumns(
        {
            "n_repeat_words": _repeat_words(F.col(helper["hashes"])),
            "n_lines": F.size(helper["lines"]).cast("long"),
            "n_bad_lines": F.size(bad).cast("long"),
            "n_lost_words": F.aggregate(bad, F.lit(0).cast("long"), lambda s, x: s + x["n"]),
            "clean_text": F.concat_ws("\n", F.transform(F.filter(helper["judged"], lambda x: x["fault"].isNull()), lambda x: x["line"])),
        }
    ).drop(helper["hashes"], helper["judged"], helper["lines"])
    failed = (F.col("n_words") < p.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.max_repeat_percent)
    out = out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_lost_words") * 100 <= F.col("n_words") * p.max_lost_percent)
    )
    # a generator of one row: a later filter on the verdict would else be pushed down with all that it is made from
    return out.select(*[F.col(c) for c in docs.columns if c not in RESULTS], F.inline(F.array(F.struct(*RESULTS))))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "n_lost_words", "clean_text", "base_failed", "kept")
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "n_lost_words")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(*COLUMNS)


_COUNT = "len(regexp_extract_all({0}, '{1}'))".format
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), tri AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM win
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM tri, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY r
), ln AS (
  SELECT r, unnest(ls) AS line FROM w
), f AS (
  SELECT r, line, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n,
         {_COUNT('line', SYMBOLS)} AS sym, {_COUNT('line', '!')} AS exc, {_COUNT('line', UPPER)} AS up,
         {_COUNT('line', LETTER)} AS le, {_COUNT('line', BARS)} AS bars FROM ln
), b AS (
  SELECT r, count(*) AS n_lines,
         count(*) FILTER (WHERE bad) AS n_bad_lines, coalesce(sum(n) FILTER (WHERE bad), 0)::BIGINT AS n_lost_words
  FROM (SELECT *, sym * 100 > length(line) * 10 OR (n >= 4 AND (exc * 100 > n * 25 OR up * 100 > le * 60))
               OR (bars >= 2 AND bars * 100 > n * 20)
               OR (n <= 60 AND regexp_matches(lower(line), '{BOILERPLATE}')) AS bad FROM f)
  GROUP BY r
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, (length(text) - {_COUNT('text', SPACE)})::BIGINT AS word_chars,
         {_COUNT('text', SYMBOLS)}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(n_lost_words, 0) AS n_lost_words
  FROM w LEFT JOIN cover USING (r) LEFT JOIN b USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words * 100 <= n_words * 50 AS kept
FROM base
"""
