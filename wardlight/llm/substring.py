"""Substring dedup with suffix automata of reference shards.

A word is removed if a window of ``window`` words covers it that also starts in a
document with a smaller doc_id. Broadcasting automata of the whole corpus to all
documents would read each document once a shard, so references and documents meet by
anchor instead: the least hash of word n-grams in a window, which equal windows share.

1. Anchors of all windows; those of two documents or more are shared (map-side
   minimum and maximum of doc_id before the shuffle).
2. Documents cut out their runs of windows with a shared anchor.
3. A shard holds the distinct runs of its anchors, each with the smallest doc_id that
   has it. Its suffix automaton is built and the runs stream through it for matching
   statistics; each window gets the smallest doc_id that holds it. A shard closes at
   ``SHARD`` words. An anchor with more than ``CROWDED`` distinct runs is no shard:
   its windows are grouped one by one, with map-side minima.
4. Each document compares its windows with its own doc_id and leaves out what they cover.

Windows are judged on the input. A null text is empty. A row without doc_id is
returned whole and is no reference. Rows that repeat a doc_id are one document: they
do not remove each other's words. Other columns than doc_id and text are not read.
"""

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship, stored
from .automaton import SuffixAutomaton
from .columns import lookup, renewed
from .windows import anchors, parts, runs, words_of

WINDOW, GRAM = 13, 4
_SPANS = re.compile(r"[ \t-\r]*[^ \t-\r]+")
SHARD, CROWDED = 100_000, 1024


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id and anchor of each run of windows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in parts(batch.column(1)):
                words = words_of(data, offsets)
                least, valid = anchors(words, window, gram)
                first, _ = runs(least, valid)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][words.text[first]]), pa.array(least[first].view(np.int64))], names=["doc_id", "anchor"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(kernel, "doc_id long, anchor long")


def _member(text: np.ndarray, anchor: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each (text number, anchor) is in the list of that text."""
    values = np.asarray(lists.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    wanted = np.rec.fromarrays([text.astype(np.int64), anchor], names="t,a")
    known = np.rec.fromarrays([owner.astype(np.int64), values], names="t,a")
    both = np.concatenate([known, wanted])
    order = np.lexsort((both["a"], both["t"]))
    group = np.ones(len(both), bool)
    group[1:] = (both["t"][order][1:] != both["t"][order][:-1]) | (both["a"][order][1:] != both["a"][order][:-1])
    number = np.empty(len(both), np.int64)
    number[order] = np.cumsum(group)
    hit = np.zeros(len(both) + 1, bool)
    hit[number[:len(known)]] = True
    return hit[number[len(known):]]


def _run_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, text_hash, anchor, first (window) and run (its words, one blank apart) of each run with a shared anchor."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in parts(batch.column(2)):
                words = words_of(data, offsets)
                least, valid = anchors(words, window, gram)
                first, end = runs(least, valid)
                text = words.text[first]
                keep = _member(text, least[first], batch.column(3).slice(a, b - a))
                first, end, text = first[keep], end[keep], text[keep]
                begin = np.searchsorted(words.text, np.arange(b - a))
                raw = data.tobytes()
                spans = [b" ".join(raw[s:e].split()) for s, e in zip(words.starts[first].tolist(), words.ends[end + window - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][text]), pa.array(hashes[a:b][text]), pa.array(least[first].view(np.int64)), pa.array((first - begin[text]).astype(np.int32)),
                     pa.array(spans, pa.binary()).cast(pa.string())], names=["doc_id", "text_hash", "anchor", "first", "run"])

    return docs.select("doc_id", "text_hash", "text", "shared").mapInArrow(kernel, "doc_id long, text_hash long, anchor long, first int, run string")


def _owners_kernel(window: int):
    """Kernel over runs sorted by anchor: smallest owner of each window of each run, a shard at a time."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        sequences = [run.split(" ") for _, _, run, _ in rows]
        for sequence, (_, _, _, owner) in zip(sequences, rows, strict=True):
            automaton.add(sequence, owner)
        automaton.settle()
        owners = [automaton.matches(s, window)[window - 1:] for s in sequences]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array(owners, pa.list_(pa.int64()))],
            names=["anchor", "run_hash", "at", "owners"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= SHARD and row[0] != held[-1][0]:
                    yield shard(held)
                    held, n = [], 0
                held.append(row)
                n += row[2].count(" ") + 1
        if held:
            yield shard(held)

    return kernel


def _owners(run_rows: DataFrame, window: int) -> DataFrame:
    """anchor, run_hash, at (place of its first window in the run) and owners (smallest doc_id of each window from there)."""
    references = stored(run_rows.groupBy("anchor", "run").agg(F.min("doc_id").alias("owner")).withColumn("run_hash", F.xxhash64("run")))
    crowded = stored(references.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("anchor", F.lit(True).alias("crowded")))
    marked = lookup(references, crowded, ["anchor"], "left", F.col("run_hash"))
    calm = marked.where("crowded IS NULL").select("anchor", "run_hash", "run", "owner")
    calm = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_owners_kernel(window), "anchor long, run_hash long, at int, owners array<long>")
    words = marked.where("crowded").select("anchor", "run_hash", "owner", F.split("run", " ").alias("w"))
    single = words.select("anchor", "run_hash", "owner", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - window), lambda k: F.struct(k.alias("at"), F.array_join(F.slice("w", k + 1, window), " ").alias("words")))).alias("x"))
    single = stored(single.select("anchor", "run_hash", "owner", "x.at", "x.words"))
    least = single.groupBy("words").agg(F.min("owner").alias("least"))
    alone = single.join(least, "words").select("anchor", "run_hash", "at", F.array("least").alias("owners"))
    return stored(calm.union(alone))


def removed_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash and the first words (numbers from 0) of windows that start in a smaller doc_id, of documents that have some."""
    rows = _rows(docs).withColumn("text_hash", F.xxhash64("text"))
    found = _anchor_rows(rows.select("doc_id", "text"), window, gram)
    shared = stored(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    again = _anchor_rows(rows.select("doc_id", "text"), window, gram)
    by_document = stored(again.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared")))
    run_rows = stored(_run_rows(rows.join(by_document, "doc_id"), window, gram))
    owners = _owners(run_rows, window)
    placed = run_rows.select("doc_id", "text_hash", "anchor", "first", F.xxhash64("run").alias("run_hash")).join(owners, ["anchor", "run_hash"])
    starts = F.filter(F.transform("owners", lambda o, k: F.when(o < F.col("doc_id"), F.col("first") + F.col("at") + k)), lambda x: x.isNotNull())
    return stored(placed.withColumn("starts", starts).where(F.size("starts") > 0).groupBy("doc_id", "text_hash")
                   .agg(F.flatten(F.collect_list("starts")).alias("starts")), keep=True)


def _kept(text: str, starts: list[int] | None, window: int) -> tuple[list[str], list[bool]]:
    """The words of a text and whether each stays."""
    words = text.encode("utf-8", "surrogatepass").split()
    change = np.zeros(len(words) + 1, np.int64)
    if starts:
        np.add.at(change, starts, 1)
        np.add.at(change, np.array(starts) + window, -1)
    return words, (np.cumsum(change[:-1]) == 0).tolist()


def _with_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Each row of ``docs`` as a struct, beside the windows that go from its text; the text moves once."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        gone = removed_windows(docs, window, gram).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    return rows.join(gone, (F.col("_d") == F.col("_id")) & (F.col("_t") == F.col("_hash")), "left").withColumn("text", F.coalesce("row.text", F.lit("")))


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, one blank apart) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words, stays = _kept(text.as_py(), starts, window)
                left = [w for w, s in zip(words, stays, strict=True) if s]
                out.append((len(words), len(words) - len(left), sha256(b" ".join(left)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, [pa.int64(), pa.int64(), pa.string()])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_windows(docs.select("doc_id", "text"), window, gram)
    return rows.select(F.col("_d").alias("doc_id"), "text", "starts").mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with texts cut: kept words with the white space before them. n_chars (if there) is renewed."""

    @F.pandas_udf("string")
    def cut(texts, starts):
        def one(text, places):
            if places is None or len(places) == 0:
                return text
            _, stays = _kept(text, list(places), window)
            spans = _SPANS.findall(text)
            return "".join(x for x, s in zip(spans, stays, strict=True) if s).strip(" \t\n\x0b\x0c\r")

        return texts.combine(starts, one)

    rows = _with_windows(docs, window, gram)
    rows = rows.withColumn("clean", F.when(F.col("starts").isNull(), F.col("text")).otherwise(cut("text", "starts")))
    return rows.select(*renewed(docs, F.col("clean")))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, (SELECT unnest(range(0, 13)) AS k)),
gone AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n, coalesce(len(js), 0) AS m,
  CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""
