"""Quality rules over whole documents, in DataFrame functions only.

Within a document: word, symbol, repeated-line and repeated-window counts. Across documents: lines are normalised and
hashed, distinct documents are counted per host and line, lines above the limits are taken out, and a document
that this depletes is rejected. Only (host, line hash) pairs travel; a line that a third of all documents share
is summed up before the shuffle, and the join back is a plain equality join whose hot keys the engine splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, saved

BLANKS = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
#: a line is boilerplate of a host if it stands in at least so many of its documents, however many the host has
LINE_DOCS = 20
#: a document is depleted if less than this share of its words is left
KEPT_SHARE = 0.3
MIN_WORDS = 10
WINDOW = 5


def split_words(text: Column) -> Column:
    """Maximal runs of other than ASCII blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in windows of five consecutive words that occur twice or more, first ones included.

    Windows are hashed and sorted with their places, so equal ones are neighbours; the places of repeated ones are
    sorted again, and each covers the words up to the next, five at most.
    """
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
    windows = F.when(n >= WINDOW, hashed)
    distinct = F.size(F.array_distinct(F.transform(windows, lambda x: x["h"])))
    ordered = F.sort_array(windows)

    def place(x: Column, at: Column, s: Column) -> Column:
        same = (F.get(s, at - 1)["h"] == x["h"]) | (F.get(s, at + 1)["h"] == x["h"])
        return F.when(same, x["i"])

    def bind(value: Column, use) -> Column:
        """``use(value)`` with the value computed once."""
        return F.get(F.transform(F.array(value), use), 0)

    places = bind(ordered, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, at: place(x, at, s)), lambda p: p.isNotNull())))
    covered = bind(places, lambda p: F.aggregate(
        F.transform(p, lambda x, at: F.least(F.lit(WINDOW), F.coalesce(F.get(p, at + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.when((n < WINDOW) | (distinct == F.size(windows)), F.lit(0).cast("long")).otherwise(covered)


def normal_line(line: Column) -> Column:
    """Lower case, digits as one sign, blanks as one space: dates and page numbers do not hide a line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANKS, " "))


def own_rules(docs: DataFrame) -> DataFrame:
    """The counts of each document and its distinct normalised lines as (hash, words of all its copies)."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    w = t.withColumn("words", split_words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    c = w.select(
        "doc_id", "host", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    lines = F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(split_words(x)).cast("long").alias("words")))
    return c.withColumn("lines", lines)


def line_rules(docs: DataFrame, line_docs: int = LINE_DOCS, kept_share: float = KEPT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words, kept.

    ``n_line_words`` are the words on lines that stand in at least ``line_docs`` documents of the host (``source``); a host that
    grows never gets a line back. ``kept`` is false if the base rules fail or fewer than ``kept_share`` of the words, or
    fewer than ten, are left without those lines. Null text: no words, fails. A null host is a host of its own, apart from an empty
    one. Rows that repeat a doc_id are judged each by itself but count as one document; a row without a doc_id counts as one. An
    empty table gives an empty result.
    """
    own = saved(own_rules(docs).withColumn("row", F.monotonically_increasing_id()), "line-rules")
    host = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("")).alias("host")
    # rows a line, at least as many as documents: lines are made distinct in the row, so no row ids travel here
    often = (
        own.select(host, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("rows")).filter(F.col("rows") >= line_docs).select("host", "line")
    )
    document = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "row").alias("id")).alias("document")
    hits = own.select("row", host, document, F.explode("lines").alias("l")).select("row", "host", "document", "l.line", "l.words").join(often, ["host", "line"])
    limits = hits.groupBy("host", "line").agg(F.countDistinct("document").alias("docs")).filter(F.col("docs") >= line_docs).select("host", "line")
    taken = hits.join(limits, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_line_words"))
    r = own.drop("lines", "host").join(taken, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    return r.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_line_words",
        (~failed & (left >= MIN_WORDS) & (left >= F.col("n_words") * kept_share)).alias("kept"),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


#: the base columns and the verdict in DuckDB; windows and lines are compared as text
OP9_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM documents),
win AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS r(k) WHERE c > 1 GROUP BY 1),
nl AS (SELECT doc_id, host, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS line,
              len(list_filter(string_split_regex(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda v: v <> '')) AS n
       FROM (SELECT doc_id, host, unnest(l) AS x FROM d)),
freq AS (SELECT host, line FROM nl GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {LINE_DOCS}),
gone AS (SELECT doc_id, sum(n) AS n FROM nl JOIN freq USING (host, line) GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
       NOT base_failed AND n_words - n_line_words >= {MIN_WORDS} AND n_words - n_line_words >= n_words * {KEPT_SHARE} AS kept FROM f"""
