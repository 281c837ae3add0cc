"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules read one text: too few words, or too many words in 5-word windows that
occur more than once in it. The corpus rule hashes normalised lines (lower case, one
space for white space, trimmed) and counts for each host the distinct documents
(doc_id; without one, the text) that hold a line. Lines above that count, which does
not depend on the size of the host, are removed, and a document is rejected if too
few of its words are left.

A null text is empty, a null source is host ''. A row without doc_id is judged like
any other. Rows that repeat doc_id and text get equal results. Empty tables give no
rows. Only doc_id, text and source are read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from .columns import BLANK, BROADCAST_ROWS, let, lines_with_words, lookup, renewed, sieved, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """A line goes if more than ``documents`` documents of its host hold it."""

    min_words: int = 10
    repeat_percent: int = 20
    documents: int = 10
    left_words: int = 10
    left_percent: int = 30


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANK, " ")))


def _covered(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; only called if there are some."""
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def positions(s: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            return (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])

        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(again(x, k), F.lit(False)) | (F.get(s, k + 1)["g"] == x["g"])), lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(ordered, positions), total)


def repeated_words(tokens: Column) -> Column:
    """Words in 5-word windows found twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(
            let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g))))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes)


def base_measures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, host, text_hash and the measures of each text."""
    text = F.coalesce("text", F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    per_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again")))
    lines = let(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        lines.alias("n_dup_lines"), per_word.alias("w"))
    rows = rows.withColumn("n_words", F.col("w.n")).withColumn("n_repeat_words", F.col("w.again")).drop("w")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, host, text_hash, place, line (hash), words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(lines_with_words(text), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words(x)).alias("words")))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"),
                       F.posexplode(lines).alias("place", "x")).select("doc_id", "host", "text_hash", "place", "x.line", "x.words")


def frequent_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, line (hash) and n of lines above the limits."""
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")))
    counts = _line_rows(docs).groupBy("host", "line").agg(F.countDistinct(document).alias("n"))
    return stored(counts.where(F.col("n") > limits.documents), keep=True)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The measures with n_left_words and kept of each row."""
    hits = lookup(_line_rows(docs), frequent_lines(docs, limits), ["host", "line"], "inner", F.struct("doc_id", "text_hash"))
    once = hits.groupBy("doc_id", "text_hash", "place").agg(F.max("words").alias("words"))
    gone = once.groupBy("doc_id", "text_hash").agg(F.sum("words").alias("gone")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    rows = base_measures(docs, limits)
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    joined = rows.join(gone, rows.doc_id.eqNullSafe(gone._id) & (rows.text_hash == gone._hash), "left").withColumn("n_left_words", left)
    return joined.withColumn("kept", ~F.col("base_failed") & _enough(limits)).drop("_id", "_hash", "gone")


def _enough(limits: Limits) -> Column:
    return (F.col("n_left_words") >= limits.left_words) & (100 * F.col("n_left_words") >= limits.left_percent * F.col("n_words"))


def apply_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Kept documents without their frequent lines; columns as given, n_chars (if there) renewed.

    A document meets only those frequent lines that it holds, so nothing grows with the lines of a host.
    """
    spark = docs.sparkSession
    with scratch(spark):
        hits = lookup(_line_rows(docs), frequent_lines(docs, limits), ["host", "line"], "inner", F.struct("doc_id", "text_hash"))
        own = stored(hits.groupBy("doc_id", "host", "text_hash").agg(F.collect_set("line").alias("frequent"))
                     .select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), "frequent"), keep=True)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_d"), F.coalesce("source", F.lit("")).alias("_s"), F.xxhash64(text).alias("_t"))
    met = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_host")) & (F.col("_t") == F.col("_hash"))
    if own.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(own), met, "left").select("row", "frequent")
    else:  # only texts that may hold a frequent line move
        some, clear = sieved(rows, own.select(F.col("_id").alias("_d"), F.col("_host").alias("_s"), F.col("_hash").alias("_t")), ["_d", "_s", "_t"])
        rows = some.join(own, met, "left").select("row", "frequent").union(clear.select("row", F.lit(None).cast("array<bigint>").alias("frequent")))
    whole = F.coalesce(F.col("row.text"), F.lit(""))
    cleaned = F.when(F.col("frequent").isNull(), whole).otherwise(
        F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains("frequent", F.xxhash64(normalised(x)))), "\n"))
    both = let(words(whole), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    rows = rows.select("row", cleaned.alias("clean"), both.alias("w"))
    rows = rows.select("row", "clean", F.col("w.n").alias("n_words"), F.col("w.again").alias("again"), F.size(words(F.col("clean"))).alias("n_left_words"))
    kept = rows.where((F.col("n_words") >= limits.min_words) & (100 * F.col("again") <= limits.repeat_percent * F.col("n_words")) & _enough(limits))
    return kept.select(*renewed(docs, F.col("clean")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, host, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], chr(31)) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, lower(trim(regexp_replace(x, '[ \t\n\x0b\x0c\r]+', ' ', 'g'))) AS line,
  len(list_filter(regexp_split_to_array(x, '[ \t\n\x0b\x0c\r]+'), lambda y: y <> '')) AS n FROM (SELECT doc_id, host, t, unnest(ls) AS x FROM w)),
f AS (SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'without ' || t)) > 10),
gone AS (SELECT doc_id, sum(n) AS n FROM l JOIN f USING (host, line) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t\n\x0b\x0c\r]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS n_left_words FROM w LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left_words >= 10 AND 100 * n_left_words >= 30 * n_words AS kept
FROM m"""
