"""Registered search queries and their comparison SQL."""

import uuid

from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import guardrails as g
from ..operators import rerank as r
from ..operators.compare import compare_runs
from ..operators.fusion import rrf
from ..operators.intent import INTENT_COLUMNS
from ..operators.lexical import bm25_topk, build_lexical_index
from ..operators.semantic import cosine_topk, embedding_windows, pool_embeddings
from ..plans import federation as fed
from ..plans.search import Corpus, candidate_lists, rerank_all, search, understood, with_chunks
from ..rules import FEDERATED, PROFILES, V1, V2
from ..rules import vocabulary as v
from ..session import shared_folder
from ..sources.corpus import corpus_stats, read_chunks
from ..sources.requests import with_defaults
from . import inputs as i
from . import oracle_search as o
from .sqltools import strip, with_

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def chunks(spark, d, pack=V2):
    raw = i.chunks_raw(spark, d) if pack is V2 else i.chunks_raw_v1(spark, d)
    return ch.normalize_chunks(raw, v.PRIMARY_SOURCE, pack=pack)


_MADE = {}


def reset():
    """Forget the tables shared between queries (for timing)."""
    _MADE.clear()


def _once(spark, name, d, profile, make):
    """Requests, index and candidate lists are built once per session and input folder."""
    key = (spark.sparkContext.applicationId, name, d, profile)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def intents(spark, d, profile="v2"):
    requests = with_defaults(i.requests_raw(spark, d, profile), profile)
    return _once(spark, "intents", d, profile, lambda: understood(requests, PROFILES[profile]))


def corpus(spark, d, pack=V2):
    return _once(spark, "corpus", d, pack.metadata_priority, lambda: Corpus.of(chunks(spark, d, pack), i.chunk_vectors(spark, d)))


def lists(spark, d, profile="v2"):
    pack = PROFILES[profile]
    return _once(spark, "lists", d, profile, lambda: candidate_lists(
        intents(spark, d, profile), corpus(spark, d, pack), i.query_vectors(spark, d), pack))


def pool(spark, d, profile="v2"):
    pack, it = PROFILES[profile], intents(spark, d, profile)
    return with_chunks(lists(spark, d, profile), it, corpus(spark, d, pack), pack)


# ------------------------------------------------------------------ sources and chunks

@query("s1_corpus_scan", with_(o.raw(), "SELECT frame_id, title, length(snippet) AS chars, uri, len(regexp_split_to_array(uri, '/')) AS depth FROM chunks_raw"))
def _(spark, d):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    i.chunks_raw(spark, d).write.parquet(path)
    raw = read_chunks(spark, path)
    return raw.select("frame_id", "title", F.length("snippet").cast("bigint").alias("chars"), "uri", F.size(F.split("uri", "/")).cast("bigint").alias("depth"))


@query("s2_requests", with_(o.requests(), """SELECT query_id, asked AS query, k, lower(search_mode) AS search_mode, threshold,
  safe_top1_guardrail, snippet_chars, CASE WHEN asked = '' THEN 'query_required' END AS error FROM requests"""))
def _(spark, d):
    req = with_defaults(i.requests_raw(spark, d))
    return req.select("query_id", "query", "k", F.lower("search_mode").alias("search_mode"), "threshold", "safe_top1_guardrail", "snippet_chars", "error")


@query("s9_corpus_stats", with_(o.chunks(), """SELECT source, count(*) AS n_chunks, count(DISTINCT pdf_file) AS n_files,
  count_if(is_current)::BIGINT AS n_current, round(avg(length(content)), 6) AS mean_chars FROM chunks GROUP BY source"""))
def _(spark, d):
    return corpus_stats(chunks(spark, d))


@query("n1_inline_metadata", with_(o.chunks(), """SELECT frame_id, length(body0) AS body_chars, md5(body0) AS body_hash,
  len(parts) AS n_parts, m_head IS NULL AS no_headings FROM split JOIN (SELECT frame_id AS f, m_head FROM own) ON f = frame_id"""))
def _(spark, d):
    raw = i.chunks_raw(spark, d)
    body, parts = ch.split_inline_metadata(F.col("snippet"))
    has_map = F.size("metadata") > 0
    head = F.when(has_map, F.lit("x")).otherwise(ch.inline_field(parts, "headings"))
    return raw.select("frame_id", F.length(body).cast("bigint").alias("body_chars"), F.md5(body.cast("binary")).alias("body_hash"),
                      F.when(parts.isNotNull(), F.size(parts)).cast("bigint").alias("n_parts"), head.isNull().alias("no_headings"))


@query("n2_tag_fallback", with_(o.chunks(), """SELECT frame_id, coalesce(m_type, CASE WHEN no_pdf THEN type2 END) AS content_type,
  coalesce(m_pdf, CASE WHEN no_pdf THEN pdf END) AS pdf_file, coalesce(m_rp, CASE WHEN no_pdf AND superseded THEN '0.0' END) AS retrieval_priority,
  coalesce(m_cur, CASE WHEN no_pdf AND superseded THEN 'False' END) AS is_current FROM merged"""))
def _(spark, d):
    return ch.with_metadata(i.chunks_raw(spark, d)).select("frame_id", "meta.content_type", "meta.pdf_file", "meta.retrieval_priority", "meta.is_current")


@query("n3_n7_content", with_(o.chunks(), "SELECT frame_id, length(content) AS chars, md5(content) AS hash FROM chunks"))
def _(spark, d):
    return chunks(spark, d).select("frame_id", F.length("content").cast("bigint").alias("chars"), F.md5(F.col("content").cast("binary")).alias("hash"))


@query("n4_n8_uri", with_(o.raw(), """SELECT frame_id, CASE WHEN contains(uri, '#page-') THEN split_part(uri, '#', 1) ELSE uri END AS uri,
  string_split(uri, '/')[-2] AS file FROM chunks_raw"""))
def _(spark, d):
    return i.chunks_raw(spark, d).select("frame_id", ch.clean_uri(F.col("uri")).alias("uri"), ch.file_of_uri(F.col("uri")).alias("file"))


@query("n5_n6_typed_fields", with_(o.chunks(), """SELECT frame_id, content_type, retrieval_priority, is_current, array_to_string(headings, '|') AS headings,
  recommendation_strength, source_url, pdf_file FROM chunks"""))
def _(spark, d):
    return chunks(spark, d).select("frame_id", "content_type", "retrieval_priority", "is_current", F.array_join("headings", "|").alias("headings"),
                                   "recommendation_strength", "source_url", "pdf_file")


@query("n_chunks_v1", with_(o.chunks_v1(), "SELECT frame_id, title, md5(content) AS hash, uri, content_type, pdf_file FROM chunks"))
def _(spark, d):
    return chunks(spark, d, V1).select("frame_id", "title", F.md5(F.col("content").cast("binary")).alias("hash"), "uri", "content_type", "pdf_file")


_DOSES = ch.DOSE_SPAN.replace("'", "''")


@query("n9_display_segments", with_(o.chunks() + [
    "plain0 AS (SELECT frame_id, CASE WHEN regexp_matches(substr(content, 2), '\\btitle:\\s') AND regexp_extract(content, '(?s)^(.*?)\\btitle:\\s', 1) <> '' "
    "THEN regexp_extract(content, '(?s)^(.*?)\\btitle:\\s', 1) ELSE content END AS b FROM chunks)",
    f"plain AS (SELECT frame_id, {strip('''regexp_replace(regexp_replace(''' + strip('b') + r''', '\s*\(\d{1,4}\)\s*', ' ', 'g'), '\s{2,}', ' ', 'g')''')} AS p FROM plain0)",
    "parts AS (SELECT frame_id, p, unnest(range(len(x))) AS n, unnest(x) AS part FROM (SELECT *, string_split(regexp_replace(p, '(?:\\.\\s+-\\s+|(?:^|\\n)\\s*-\\s+)', chr(1), 'g'), chr(1)) AS x FROM plain))",
    f"kinds AS (SELECT frame_id, n, {strip('part')} AS part, CASE WHEN n > 0 OR starts_with(p, '- ') THEN 'bullet' ELSE 'prose' END AS kind FROM parts WHERE {strip('part')} <> '')",
    "sent AS (SELECT *, CASE WHEN kind = 'bullet' THEN [part] ELSE string_split(regexp_replace(part, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END AS s FROM kinds)",
    f"paras AS (SELECT frame_id, n, kind, unnest(range((len(s) + 2) // 3)) AS j, s FROM sent)",
    f"texts AS (SELECT frame_id, n, kind, j, {strip('''array_to_string(s[j * 3 + 1:j * 3 + 3], ' ')''')} AS text FROM paras)",
], f"SELECT frame_id, n AS segment, j AS paragraph, kind, md5(text) AS hash, array_to_string(regexp_extract_all(text, '(?i){_DOSES}', 1), '|') AS doses FROM texts WHERE text <> ''"))
def _(spark, d):
    seg = ch.display_segments(chunks(spark, d))
    return seg.select("frame_id", F.col("ord.segment").cast("bigint").alias("segment"), F.col("ord.paragraph").cast("bigint").alias("paragraph"), "kind",
                      F.md5(F.col("text").cast("binary")).alias("hash"), F.array_join("doses", "|").alias("doses"))


# ------------------------------------------------------------------ index, top-k, fusion

_INDEX = o.chunks() + o.index()


@query("i1_postings", with_(_INDEX, "SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(doc_len) AS longest FROM postings GROUP BY term"))
def _(spark, d):
    ix = build_lexical_index(chunks(spark, d))
    return ix.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("doc_len").alias("longest"))


@query("i1_index_stats", with_(_INDEX, "SELECT n_chunks, avg_len, n_terms FROM stats, (SELECT count(*) AS n_terms FROM term_df)"))
def _(spark, d):
    ix = build_lexical_index(chunks(spark, d))
    return ix.stats.select("n_chunks", "avg_len", ix.term_df.agg(F.count("*")).scalar().alias("n_terms"))


_LISTS = o.chunks() + o.intents() + o.index() + o.lists(V2)


@query("i2_bm25_topk", with_(_LISTS, "SELECT query_id, frame_id, score, rank FROM lex"))
def _(spark, d):
    q = intents(spark, d).join(i.query_vectors(spark, d).select("query_id", F.lit(True).alias("has")), "query_id", "left")
    q = q.where((F.col("has") | ~F.lower("search_mode").isin("rrf")) & (F.lower("search_mode") != "sem"))
    out = bm25_topk(q, corpus(spark, d).index, F.lit(15), 15)
    return out.select("query_id", "frame_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("i3_embedding_windows", """SELECT doc_id, w AS "window", length(t) AS chars, md5(t) AS hash FROM (
  SELECT doc_id, w, substr(text, w * 10000 + 1, 10000) AS t FROM (SELECT doc_id, text, unnest(range((length(text) + 9999) // 10000)) AS w FROM documents))""")
def _(spark, d):
    w = embedding_windows(i.table(spark, d, "documents"))
    return w.select("doc_id", "window", F.length("window_text").cast("bigint").alias("chars"), F.md5(F.col("window_text").cast("binary")).alias("hash"))


@query("i4_pool_embeddings", """WITH parts AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  comp AS (SELECT label, unnest(range(len(e))) AS j, unnest(e) AS x FROM parts),
  means AS (SELECT label, j, avg(x) AS m, count(*) AS n FROM comp GROUP BY label, j),
  norms AS (SELECT label, sqrt(sum(m * m)) AS norm, max(n) AS n FROM means GROUP BY label)
  SELECT label, j AS dim, n AS windows, round(m / CASE WHEN n = 1 OR norm = 0 THEN 1 ELSE norm END, 6) AS x FROM means JOIN norms USING (label, n)""")
def _(spark, d):
    p = pool_embeddings(i.table(spark, d, "embeddings"), "label")
    return p.select("label", "windows", F.posexplode("embedding").alias("dim", "x")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), "windows", F.round("x", 6).alias("x"))


@query("i5_cosine_topk", with_(_LISTS, "SELECT query_id, frame_id, score, rank FROM sem"))
def _(spark, d):
    q = intents(spark, d).where(F.lower("search_mode").isin("sem", "rrf")).select("query_id").join(i.query_vectors(spark, d), "query_id")
    out = cosine_topk(q, i.chunk_vectors(spark, d), F.lit(15))
    return out.select("query_id", "frame_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("i5_cosine_topk_lsh")
def _(spark, d):
    out = cosine_topk(i.query_vectors(spark, d), i.chunk_vectors(spark, d), F.lit(15), mode="lsh")
    return out.select("query_id", "frame_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("i6_rrf", with_(_LISTS, "SELECT query_id, parent_id, frame_id, score, pos FROM fused"))
def _(spark, d):
    q = intents(spark, d).where(F.lower("search_mode") == "rrf").join(i.query_vectors(spark, d), "query_id")
    lex = bm25_topk(q, corpus(spark, d).index, F.lit(15), 15)
    sem = cosine_topk(q.select("query_id", "embedding"), i.chunk_vectors(spark, d), F.lit(15))
    return rrf(lex, sem).select("query_id", "parent_id", "frame_id", "score", F.col("pos").cast("bigint").alias("pos"))


@query("i7_dispatch", with_(_LISTS, "SELECT query_id, frame_id, score, pos FROM candidates"))
def _(spark, d):
    out = lists(spark, d)
    return out.select("query_id", "frame_id", "score", F.col("pos").cast("bigint").alias("pos"))


_LISTS_V1 = o.chunks_v1() + o.intents("v1", V1) + o.index() + o.lists(V1)


@query("i8_pool_size_v1", with_(_LISTS_V1, "SELECT query_id, frame_id, score, pos FROM candidates"))
def _(spark, d):
    out = lists(spark, d, "v1")
    return out.select("query_id", "frame_id", "score", F.col("pos").cast("bigint").alias("pos"))


# ------------------------------------------------------------------ query understanding

@query("q1_expand", with_(o.intents(), "SELECT query_id, length(query) AS chars, query AS expanded FROM expanded"))
def _(spark, d):
    return intents(spark, d).select("query_id", F.length("query").cast("bigint").alias("chars"), F.col("query").alias("expanded"))


_SLOTS = [c for c in INTENT_COLUMNS if c not in ("coherence", "title_exclusions", "content_exclusions", "topic")]
_LISTED = ["coherence", "title_exclusions", "content_exclusions"]
_SLOT_SQL = "SELECT query_id, " + ", ".join(_SLOTS + [f"array_to_string({c}, '|') AS {c}" for c in _LISTED]) + " FROM intents"

for _p in ("v2", "v1", "v1_federated"):
    @query(f"q2_q9_intent_{_p}", with_(o.intents(_p, PROFILES[_p]), _SLOT_SQL))
    def _(spark, d, _p=_p):
        return intents(spark, d, _p).select("query_id", *_SLOTS, *[F.array_join(F.array_distinct(F.transform(c, lambda r: r["id"])), "|").alias(c) for c in _LISTED])


# ------------------------------------------------------------------ rerank stages

_HEAD = o.chunks() + o.intents() + o.index() + o.lists(V2) + o.hits(V2) + o.stages(V2)
_SCORES = "SELECT query_id, frame_id, score FROM "


def _scores(hits):
    return hits.select("query_id", "frame_id", "score")


def _start(spark, d):
    return r.start_trail(r.drop_superseded(r.drop_corrupted(pool(spark, d))))


_CHAIN = [
    ("r3_type_boost", "boost", r.boost_types), ("r4_action_boost", "action", r.boost_actions),
    ("r5_population", "population", r.demote_population), ("r6_coherence", "coherence", r.demote_incoherent),
    ("r7_exclusions", "exclusion", r.demote_exclusions), ("r8_background_rescue", "rescue", r.rescue_background),
    ("r9_soft_corruption", "soft", r.demote_soft_corruption), ("r10_source_diversity", "diverse", r.diversify),
]


@query("r1_r2_hard_drops", with_(_HEAD, _SCORES + "hits"))
def _(spark, d):
    return _scores(_start(spark, d))


for _n, (_name, _cte, _) in enumerate(_CHAIN):
    @query(_name, with_(_HEAD, _SCORES + _cte))
    def _(spark, d, _n=_n):
        hits = _start(spark, d)
        for _, _, step in _CHAIN[: _n + 1]:
            hits = step(hits)
        return _scores(hits)


_FULL = o.full("v2")[1]


@query("r11_threshold", with_(_FULL, "SELECT query_id, frame_id, pos, score FROM thresholded"))
def _(spark, d):
    hits = r.apply_threshold(r.score_candidates(pool(spark, d)), F.col("threshold"))
    return hits.select("query_id", "frame_id", F.col("pos").cast("bigint").alias("pos"), "score")


_WEIGHED = ["on_topic", "off_topic", "chunk_heavy", "chunk_light", "chunk_neonate", "chunk_child", "chunk_adult", "incoherent"]


def _weighed(spark, d, profile="v2"):
    pack = PROFILES[profile]
    hits = r.apply_threshold(r.score_candidates(pool(spark, d, profile), pack), F.col("threshold"))
    return r.intent_scores(r.intent_signals(hits, pack), pack)


@query("r12_r19_intent_scores", with_(_FULL, "SELECT query_id, frame_id, " + ", ".join(_WEIGHED) + """, slots, penalty,
  boost, adjusted FROM weighed"""))
def _(spark, d):
    return _weighed(spark, d).select("query_id", "frame_id", *_WEIGHED, "slots", "penalty",
                                     "boost", "adjusted")


_RANKED = "SELECT query_id, frame_id, pos AS rank, score, {} FROM {}"


def _ranked(hits, *more):
    return hits.select("query_id", "frame_id", F.col("pos").cast("bigint").alias("rank"), "score", *more)


@query("r20_light_guard", with_(_FULL, _RANKED.format("relaxed", "reranked")))
def _(spark, d):
    hits = r.apply_threshold(r.score_candidates(pool(spark, d)), F.col("threshold"))
    return _ranked(r.intent_rerank(hits), "relaxed")


def _reranked(spark, d, profile="v2"):
    pack = PROFILES[profile]
    hits = r.apply_threshold(r.score_candidates(pool(spark, d, profile), pack), F.col("threshold"))
    return r.intent_rerank(hits, pack)


@query("r21_promotion", with_(_FULL, _RANKED.format("aligned_swap", "promoted")))
def _(spark, d):
    return _ranked(g.promote_aligned(_reranked(spark, d)), "aligned_swap")


@query("r22_safe_top", with_(_FULL, _RANKED.format("safe_swap", "safe")))
def _(spark, d):
    return _ranked(g.safe_top(g.promote_aligned(_reranked(spark, d))), "safe_swap")


@query("r23_trim", with_(_FULL, _RANKED.format("title, content_type", "final")))
def _(spark, d):
    return _ranked(rerank_all(pool(spark, d)), "title", "content_type")


@query("r24_quality_flags", with_(_FULL, "SELECT query_id, array_to_string(quality_flags, '|') AS flags FROM flags"))
def _(spark, d):
    return g.quality_flags(rerank_all(pool(spark, d))).select("query_id", F.array_join("quality_flags", "|").alias("flags"))


_RESPONSES = """SELECT r.query_id, coalesce(array_to_string(list_sort(ids), ','), '') AS hits, coalesce(top, '') AS hit, coalesce(array_to_string(f.quality_flags, '|'), '') || {extra} AS flags,
  CASE WHEN r.asked = '' THEN 'query_required' WHEN lower(r.search_mode) IN ('sem', 'rrf') AND r.query_id NOT IN (SELECT query_id FROM query_vecs)
    THEN 'fetch error (' || lower(r.search_mode) || '): no query vector' ELSE '' END AS errors, {swapped} AS top1_swapped, {reason} AS top1_swap_reason
  FROM requests r LEFT JOIN intents q USING (query_id) LEFT JOIN flags f USING (query_id)
  LEFT JOIN (SELECT query_id, list(pos || ':' || frame_id) AS ids, first(frame_id ORDER BY pos) AS top, bool_or(aligned_swap) AS a, bool_or(safe_swap) AS s FROM final GROUP BY query_id) USING (query_id)"""


def _responses(out):
    ids = F.array_sort(F.transform("hits", lambda h: F.concat(h["rank"].cast("string"), F.lit(":"), h["frame_id"])))
    return out.select("query_id", F.array_join(ids, ",").alias("hits"), F.coalesce("hit.frame_id", F.lit("")).alias("hit"),
                      F.array_join("quality_flags", "|").alias("flags"), F.array_join("errors", "|").alias("errors"), "top1_swapped", "top1_swap_reason")


@query("r25_search_responses", with_(_FULL, _RESPONSES.format(
    extra="''", swapped="coalesce(a OR s, false)",
    reason=f"CASE WHEN s THEN '{g.OFF_CONDITION_REASON}' WHEN a THEN '{g.ALIGNED_REASON}' END")))
def _(spark, d):
    requests = with_defaults(i.requests_raw(spark, d))
    return _responses(search(requests, corpus(spark, d), i.query_vectors(spark, d)))


# ------------------------------------------------------------------ first generation

_FULL_V1 = o.full("v1")[1]


def _start_v1(spark, d):
    return r.start_trail(r.drop_corrupted(pool(spark, d, "v1"), V1))


@query("v1_type_boost", with_(_FULL_V1, _SCORES + "boost"))
def _(spark, d):
    return _scores(r.boost_types(_start_v1(spark, d), V1))


@query("v2_action_order", with_(_FULL_V1, _SCORES + "action_step3"))
def _(spark, d):
    return _scores(r.boost_actions(r.boost_types(_start_v1(spark, d), V1), V1))


@query("v3_evidence_floor", with_(_FULL_V1, _SCORES + "action"))
def _(spark, d):
    return _scores(r.evidence_floor(r.boost_actions(r.boost_types(_start_v1(spark, d), V1), V1)))


def _before_tail(spark, d):
    hits = r.evidence_floor(r.boost_actions(r.boost_types(_start_v1(spark, d), V1), V1))
    hits = r.demote_exclusions(r.demote_incoherent(r.demote_population(hits, V1), V1), V1)
    return r.settle(r.diversify(r.demote_soft_corruption(r.rescue_background(hits, V1), V1)))


@query("v4_tail_trim", with_(_FULL_V1, _SCORES + "tail"))
def _(spark, d):
    return _scores(r.trim_tail(_before_tail(spark, d)))


@query("v5_strict_types", with_(_FULL_V1, _SCORES + "strict"))
def _(spark, d):
    return _scores(r.strict_types(r.trim_tail(_before_tail(spark, d)), V1))


@query("v6_intent_scores", with_(_FULL_V1, "SELECT query_id, frame_id, " + ", ".join(_WEIGHED) + """, slots, penalty,
  boost, adjusted FROM weighed"""))
def _(spark, d):
    return _weighed(spark, d, "v1").select("query_id", "frame_id", *_WEIGHED, "slots", "penalty",
                                           "boost", "adjusted")


@query("v7_promotion_and_guard", with_(_FULL_V1, _RANKED.format("aligned_swap, safe_swap", "safe")))
def _(spark, d):
    return _ranked(g.safe_top(g.promote_aligned(_reranked(spark, d, "v1"), V1), V1), "aligned_swap", "safe_swap")


@query("v9_quality_flags", with_(_FULL_V1, "SELECT query_id, array_to_string(quality_flags, '|') AS flags FROM flags"))
def _(spark, d):
    return g.quality_flags(rerank_all(pool(spark, d, "v1"), V1), V1).select("query_id", F.array_join("quality_flags", "|").alias("flags"))


_V1_OUT = _RESPONSES.format(
    extra="CASE WHEN r.strict_cds_mode AND ids IS NULL AND coalesce(is_action, false) THEN CASE WHEN len(coalesce(f.quality_flags, [])) > 0 THEN '|' ELSE '' END || 'strict_cds_no_hit' ELSE '' END",
    swapped="coalesce(s, false)", reason=f"CASE WHEN s THEN '{g.OFF_CONDITION_REASON}' END")


@query("v8_strict_responses", with_(_FULL_V1 + [f"answers AS ({_V1_OUT})"], """SELECT a.* REPLACE (CASE WHEN strict_mode AND flags <> '' THEN '' ELSE hits END AS hits,
  CASE WHEN strict_mode AND flags <> '' THEN '' ELSE hit END AS hit) FROM answers a JOIN requests USING (query_id)"""))
def _(spark, d):
    requests = with_defaults(i.requests_raw(spark, d, "v1"), "v1")
    return _responses(search(requests, corpus(spark, d, V1), i.query_vectors(spark, d), "v1"))


# ------------------------------------------------------------------ two corpora

_FED = o.federated()
_ASKED = f"CASE {' '.join(f'WHEN lower(search_mode) = {chr(39)}{m}{chr(39)} THEN {x}e0' for m, x in v.FAILOVER_THRESHOLDS.items())} ELSE who_failover_threshold END"


def _corpora(spark, d):
    second = ch.normalize_chunks(i.chunks_secondary(spark, d), v.SECONDARY_SOURCE, pack=FEDERATED)
    return corpus(spark, d, FEDERATED), Corpus.of(second, i.secondary_vectors(spark, d))


def _both(spark, d):
    it = intents(spark, d, "v1_federated")
    return it, fed.federated_hits(it, *_corpora(spark, d), i.query_vectors(spark, d))


@query("v10_v13_merged_sources", with_(_FED, "SELECT query_id, frame_id, source, pos AS rank, score FROM merged"))
def _(spark, d):
    it, (_, p, s, _) = _both(spark, d)
    return fed.merge_sources(it, p, s).select("query_id", "frame_id", "source", F.col("pos").cast("bigint").alias("rank"), "score")


@query("v12_failover", with_(_FED, "SELECT query_id, k, failover_reason FROM asked_2f"))
def _(spark, d):
    _, (_, _, _, asked) = _both(spark, d)
    return asked.select("query_id", "k", "failover_reason")


@query("v14_federated_responses", with_(_FED + [
    "tops AS (SELECT query_id, first({'f': frame_id, 's': source, 'x': score} ORDER BY pos) AS p FROM ranked GROUP BY query_id)",
    "tops_2 AS (SELECT query_id, first({'f': frame_id, 's': source, 'x': score} ORDER BY pos) AS s FROM ranked_2 GROUP BY query_id)",
    f"""chosen AS (SELECT query_id, CASE WHEN source_mode = 'who' THEN p WHEN source_mode = 'wiki' THEN s
  WHEN NOT who_first_policy THEN CASE WHEN s.x > p.x THEN s ELSE coalesce(p, s) END
  WHEN p.x >= {_ASKED} THEN p ELSE coalesce(s, p) END AS c, CASE WHEN NOT strict_cds_mode AND is_action THEN 0.05e0 ELSE threshold END AS floor
  FROM intents LEFT JOIN tops USING (query_id) LEFT JOIN tops_2 USING (query_id))""",
    "heads AS (SELECT query_id, first(frame_id ORDER BY pos) AS f, count(*) AS n, count_if(source = 'WikiMed')::BIGINT AS w FROM final GROUP BY query_id)",
    """parts AS (SELECT i.query_id, strict_mode, coalesce(array_to_string(quality_flags, '|'), '') || CASE WHEN strict_cds_mode AND n IS NULL AND is_action THEN
  CASE WHEN len(coalesce(quality_flags, [])) > 0 THEN '|' ELSE '' END || 'strict_cds_no_hit' ELSE '' END AS flags, f, coalesce(n, 0) AS n, coalesce(w, 0) AS w,
  CASE WHEN floor <= 0 OR c.x >= floor THEN c.f END AS own FROM intents i LEFT JOIN flags USING (query_id) LEFT JOIN heads USING (query_id) JOIN chosen USING (query_id))""",
], """SELECT query_id, flags, CASE WHEN strict_mode AND flags <> '' THEN 0 ELSE n END AS n_hits, CASE WHEN strict_mode AND flags <> '' THEN 0 ELSE w END AS secondary_count,
  CASE WHEN strict_mode AND flags <> '' THEN NULL ELSE coalesce(own, f) END AS hit,
  repeat('x', coalesce(first_, 0) + coalesce(second_, 0)) AS errors FROM parts
  LEFT JOIN (SELECT query_id, 1 AS first_ FROM asked_1 WHERE lower(search_mode) IN ('sem', 'rrf') AND query_id NOT IN (SELECT query_id FROM query_vecs)) USING (query_id)
  LEFT JOIN (SELECT query_id, 1 AS second_ FROM asked_2 WHERE lower(search_mode) IN ('sem', 'rrf') AND query_id NOT IN (SELECT query_id FROM query_vecs)) USING (query_id)
  UNION ALL SELECT query_id, '', 0, 0, NULL, 'query_required' FROM requests WHERE asked = ''"""))
def _(spark, d):
    requests = with_defaults(i.requests_raw(spark, d, "v1_federated"), "v1_federated")
    out = fed.federated_search(requests, *_corpora(spark, d), i.query_vectors(spark, d))
    return out.select("query_id", F.array_join("quality_flags", "|").alias("flags"), F.size("hits").cast("bigint").alias("n_hits"),
                      F.col("secondary_count").cast("bigint").alias("secondary_count"), F.col("hit.frame_id").alias("hit"),
                      F.array_join(F.transform("errors", lambda e: F.when(e.startswith("fetch error ("), "x").otherwise(e)), "").alias("errors"))


# ------------------------------------------------------------------ comparison of runs

_RUN = "SELECT query_id, source, content FROM final WHERE pos = 1"


@query("y1_compare_runs", f"""SELECT query_id, coalesce(a.source, 'none') AS source_a, coalesce(b.source, 'none') AS source_b,
  coalesce(a.content <> '', false) AS has_content_a, coalesce(b.content <> '', false) AS has_content_b, coalesce(a.source = b.source, false) AS source_match,
  CASE WHEN NOT coalesce(a.content <> '', false) OR NOT coalesce(b.content <> '', false) THEN 'missing content'
    WHEN NOT coalesce(a.source = b.source, false) THEN 'source mismatch' END AS failure
  FROM ({with_(o.full("v2")[1], _RUN)}) a FULL JOIN ({with_(o.full("v1")[1], _RUN)}) b USING (query_id)""")
def _(spark, d):
    top = lambda hits: hits.where(F.col("pos") == 1).select("query_id", "query", "source", "content")
    a, b = top(rerank_all(pool(spark, d))), top(rerank_all(pool(spark, d, "v1"), V1))
    out = compare_runs(a, b, strict_source=True)
    return out.select("query_id", "source_a", "source_b", "has_content_a", "has_content_b", "source_match", "failure")
