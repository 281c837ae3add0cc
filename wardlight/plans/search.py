"""Search for a table of requests, end to end."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if
from ..operators import guardrails as g
from ..operators import rerank as r
from ..operators.fusion import dispatch, fetch_errors, pool_size
from ..operators.intent import INTENT_COLUMNS, query_intent
from ..operators.lexical import InvertedIndex, bm25_topk, build_lexical_index, invert
from ..operators.semantic import cosine_topk
from ..operators.signals import with_signals
from ..rules import PROFILES, RulePack, V2
from ..session import stored

REQUEST_COLUMNS = ["k", "threshold", "safe_top1_guardrail", "strict_mode", "strict_cds_mode"]


@dataclass
class Corpus:
    """Chunks, their term index and their vectors (frame_id, embedding); index and vectors go by chunk_id."""

    chunks: DataFrame
    index: InvertedIndex
    vectors: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame, vectors: DataFrame) -> "Corpus":
        """Store the cleaned chunks and their postings once; searches read them."""
        chunks = stored(chunks)
        return cls(chunks, invert(build_lexical_index(chunks, "chunk_id"), peaks=False), vectors)


def understood(requests: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Intents of the valid requests, stored: one row per request, read by many joins."""
    return stored(query_intent(requests.where(F.col("error").isNull()), pack))


def candidate_lists(intents: DataFrame, corpus: Corpus, query_vecs: DataFrame, pack: RulePack = V2) -> DataFrame:
    """(query_id, frame_id, score, pos): the pool of each request before reranking."""
    sized = intents.withColumn("_pool", pool_size(pack, F.col("k"), F.col("is_action")).cast("int"))
    largest = pack.pool_limit or (sized.agg(F.max("_pool")).first()[0] or 1)
    semantic_mode = F.lower("search_mode").isin("sem", "rrf")
    with_vec = sized.where(semantic_mode).join(query_vecs, "query_id")
    ready = sized.where(~semantic_mode).select(*sized.columns).unionByName(with_vec.select(*sized.columns))
    lexical = bm25_topk(ready.where(F.lower("search_mode") != "sem"), corpus.index, F.col("_pool"), largest)
    semantic = cosine_topk(with_vec, corpus.vectors, F.col("_pool"))
    if pack.metadata_priority:
        lexical, semantic = (without_empty(x, corpus.chunks) for x in (lexical, semantic))
    return stored(dispatch(ready, lexical, semantic))


def without_empty(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """A fetched list without chunks that have no content, ranked anew."""
    empty = chunks.where(F.col("content") == "").select(F.col("chunk_id").alias("frame_id"))
    left = listed.join(empty, "frame_id", "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).select(listed.columns)


def with_chunks(candidates: DataFrame, intents: DataFrame, corpus: "Corpus", pack: RulePack = V2) -> DataFrame:
    """Candidates with chunk, intent and signal columns, hash-partitioned by query; content is cut to the request's length here.

    The chunk table is by far the largest input. ``candidates`` is a written table; while its counted
    rows are few they are broadcast to the chunks, so that chunk text is not shuffled.
    """
    bound = broadcast_if(candidates, candidates.count(), 160)
    joined = corpus.chunks.join(bound.withColumnRenamed("frame_id", "chunk_id"), "chunk_id").drop("chunk_id")
    slots = intents.select("query_id", "query", "snippet_chars", *REQUEST_COLUMNS, *INTENT_COLUMNS)
    full = joined.repartition("query_id").join(slots, "query_id")
    cut = full.withColumn("content", F.substring(F.col("content"), F.lit(1), F.col("snippet_chars"))).drop("snippet_chars")
    return with_signals(cut, pack)


def candidates(intents: DataFrame, corpus: Corpus, query_vecs: DataFrame, pack: RulePack = V2) -> DataFrame:
    lists = candidate_lists(intents, corpus, query_vecs, pack)
    return with_chunks(lists, intents, corpus, pack)


def rerank_all(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Final hits of each query: ``pos`` is the rank, swap flags included."""
    hits = r.score_candidates(hits, pack)
    hits = r.apply_threshold(hits, F.col("threshold"))
    hits = r.intent_rerank(hits, pack)
    hits = g.safe_top(g.promote_aligned(hits, pack), pack)
    return g.trim(hits)


def search(requests: DataFrame, corpus: Corpus, query_vecs: DataFrame, profile: str = "v2") -> DataFrame:
    """One response per request (see ``guardrails.assemble``).

    ``requests`` come from ``sources.requests.with_defaults``; ``query_vecs``:
    query_id, embedding.
    """
    pack = PROFILES[profile]
    intents = understood(requests, pack)
    hits = rerank_all(candidates(intents, corpus, query_vecs, pack), pack)
    errors = fetch_errors(intents, query_vecs)
    blank = requests.where(F.col("error").isNotNull()).select("query_id", "error")
    everyone = intents.select("query_id", "query", "is_action", "strict_mode", "strict_cds_mode").unionByName(
        requests.where(F.col("error").isNotNull()).select(
            "query_id", "query", F.lit(False).alias("is_action"), "strict_mode", "strict_cds_mode"))
    return g.assemble(everyone, hits, g.quality_flags(hits, pack), errors.unionByName(blank), pack)
