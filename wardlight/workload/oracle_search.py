"""Comparison SQL of the search operators, stage by stage."""

from ..operators import guardrails as g
from ..operators import rerank as r
from ..rules import FEDERATED, V1, V2, RulePack
from ..rules import vocabulary as v
from . import seeds
from .sqltools import FOLD, inlist, lit, matches, num, strip, values

FRAME = ("CASE WHEN {i} % 6 < 2 THEN 'f' || ({i} // 6) || '#page-' || ({i} % 6 + 1) "
         "ELSE 'f' || ({i} // 6) || '-' || ({i} % 6) END")
_FIELDS = "|".join(v.INLINE_FIELDS)


def fold(x: str) -> str:
    return f"regexp_replace({x}, '{FOLD}', 'z', 'g')"


# ---------------------------------------------------------------- chunks

def raw() -> list[str]:
    n = len(seeds.CHUNKS)
    rows = [(i, *c) for i, c in enumerate(seeds.CHUNKS)]
    return [
        values("seed_chunks", "seed_no, title, sentence, type2, type1, pdf", rows),
        f"docs AS (SELECT d.doc_id AS i, d.text, s.* FROM documents d JOIN seed_chunks s ON d.doc_id % {n} = s.seed_no)",
        f"""chunks_raw AS (
  SELECT i, {FRAME.format(i='i')} AS frame_id, title,
    sentence || CASE WHEN i % 5 = 2 THEN chr(10) || '  chunk_id: 77' || chr(10) || 'title: x' ELSE '' END || chr(10) || text
    || CASE WHEN i % 4 <> 3 THEN ' title: ' || title || ' content_type: ' || type2 || ' headings: ["' || title
       || '", "Part"] is_current: ' || CASE WHEN i % 3 = 0 THEN 'False' ELSE 'True' END || ' pdf_file: ' || pdf
       || ' retrieval_priority: ' || CASE WHEN i % 31 = 30 THEN '0.0' WHEN i % 7 = 0 THEN '0.3' WHEN i % 7 = 1 THEN 'bad' ELSE '1.0' END
       || ' source_url: ' ELSE '' END AS snippet,
    'kb://guides/' || pdf || '/' || i || CASE WHEN i % 3 = 0 THEN '#page-2' ELSE '' END AS uri,
    type2, pdf, i % 8 <> 7 AS tag_pdf, i % 29 = 28 AS superseded, i % 11 = 5 AS has_map
  FROM docs)""",
    ]


def drop_lines(x: str, prefixes) -> str:
    tests = " OR ".join(f"starts_with({strip('l')}, {lit(p)})" for p in prefixes)
    kept = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT ({tests})), chr(10))"
    return strip(kept)


def chunks() -> list[str]:
    def field(name):
        start = f"{name}"
        return (f"{strip(f'''substr(list_filter(parts, lambda p: starts_with(p, '{start}' || chr(2)))[-1], {len(start) + 2})''')}")

    return raw() + [
        f"""cut AS (
  SELECT *, regexp_extract(snippet, ' (?:{_FIELDS}): ') AS mark FROM chunks_raw)""",
        f"""split AS (
  SELECT *, CASE WHEN mark = '' THEN snippet ELSE {strip('substr(snippet, 1, strpos(snippet, mark) - 1)')} END AS body0,
    CASE WHEN mark <> '' THEN string_split(regexp_replace(' ' || {strip('substr(snippet, strpos(snippet, mark))')},
      ' ({_FIELDS}): ', chr(1) || '\\1' || chr(2), 'g'), chr(1)) END AS parts FROM cut)""",
        f"""own AS (
  SELECT *, {drop_lines('body0', v.METADATA_LINES)} AS content,
    CASE WHEN has_map THEN 'etd' ELSE {field('content_type')} END AS m_type,
    CASE WHEN has_map THEN NULL ELSE {field('retrieval_priority')} END AS m_rp,
    CASE WHEN has_map THEN NULL ELSE {field('is_current')} END AS m_cur,
    CASE WHEN has_map THEN 'plain heading' ELSE {field('headings')} END AS m_head,
    CASE WHEN has_map THEN NULL ELSE {field('source_url')} END AS m_url,
    CASE WHEN has_map THEN 'x.pdf' ELSE {field('pdf_file')} END AS m_pdf FROM split)""",
        """merged AS (
  SELECT *, coalesce(m_pdf, '') = '' AS no_pdf FROM own)""",
        f"""chunks AS MATERIALIZED (
  SELECT frame_id, title, content, 'WHO Guidelines' AS source,
    CASE WHEN contains(uri, '#page-') THEN split_part(uri, '#', 1) ELSE uri END AS uri,
    coalesce(m_type, CASE WHEN no_pdf THEN type2 END, 'background') AS content_type,
    coalesce(TRY_CAST(coalesce(m_rp, CASE WHEN no_pdf AND superseded THEN '0.0' END) AS DOUBLE), 1.0e0) AS retrieval_priority,
    coalesce(lower(coalesce(m_cur, CASE WHEN no_pdf AND superseded THEN 'False' END)) NOT IN ('false', '0', 'no'), true) AS is_current,
    CASE WHEN m_head IS NULL OR m_head = '' THEN [] WHEN starts_with(m_head, '[') THEN CAST(json(m_head) AS VARCHAR[]) ELSE [m_head] END AS headings,
    coalesce(m_url, '') AS source_url, CASE WHEN has_map THEN 'strong' END AS recommendation_strength,
    coalesce(m_pdf, CASE WHEN no_pdf THEN pdf END, '') AS pdf_file, i
  FROM merged)""",
    ]


def chunks_v1() -> list[str]:
    n = len(seeds.CHUNKS)
    rows = [(i, *c) for i, c in enumerate(seeds.CHUNKS)]
    body = "sentence || CASE WHEN i % 5 = 2 THEN chr(10) || 'hierarchy_level: 2' ELSE '' END || chr(10) || text"
    return [
        values("seed_chunks", "seed_no, title, sentence, type2, type1, pdf", rows),
        f"docs AS (SELECT d.doc_id AS i, d.text, s.* FROM documents d JOIN seed_chunks s ON d.doc_id % {n} = s.seed_no)",
        f"""chunks AS MATERIALIZED (
  SELECT {FRAME.format(i='i')} AS frame_id, title, {drop_lines(body, v.METADATA_LINES_V1)} AS content,
    'WHO Guidelines' AS source, 'kb://guides/' || pdf || '/' || i AS uri,
    CASE WHEN i % 9 <> 8 THEN type1 ELSE 'regular' END AS content_type, 1.0e0 AS retrieval_priority, pdf AS pdf_file, i
  FROM docs)""",
    ]


# ---------------------------------------------------------------- requests

_LEX = {"v2": "lex", "v1": "bm25", "v1_federated": "bm25"}
_K = {"v2": 5, "v1": 5, "v1_federated": 3}
_MODE = {"v2": "rrf", "v1": "rrf", "v1_federated": "bm25"}


def requests(profile: str = "v2") -> list[str]:
    n = len(seeds.QUERIES)
    v1 = profile != "v2"
    strict = "item_id % 7 = 6 AS strict_mode, item_id % 4 = 3 AS strict_cds_mode" if v1 else "false AS strict_mode, false AS strict_cds_mode"
    fed = profile == "v1_federated"
    source = "CASE WHEN item_id % 3 = 0 THEN 'who' WHEN item_id % 6 = 1 THEN 'wiki' ELSE 'auto' END" if fed else "'who'"
    first = "item_id % 4 < 2" if fed else "true"
    return [
        values("seed_queries", "seed_no, phrase", list(enumerate(seeds.QUERIES))),
        f"""requests AS (
  SELECT item_id AS query_id, {strip("CASE WHEN item_id % 17 = 16 THEN '  ' WHEN item_id % 4 < 3 THEN phrase ELSE phrase || ' ' || text END")} AS asked,
    CASE WHEN item_id % 3 = 0 THEN item_id % 4 + 3 ELSE {_K[profile]} END::INTEGER AS k,
    CASE item_id % 5 WHEN 0 THEN '{_LEX[profile]}' WHEN 1 THEN 'sem' WHEN 2 THEN 'RRF' ELSE '{_MODE[profile]}' END AS search_mode,
    item_id % 2 = 0 AS safe_top1_guardrail, CASE WHEN item_id % 10 = 9 THEN 0.01e0 ELSE 0e0 END AS threshold,
    15000 AS snippet_chars, {strict}, {source} AS source_mode, {first} AS who_first_policy, 5.0e0 AS who_failover_threshold
  FROM benchmark JOIN seed_queries ON item_id % {n} = seed_no)""",
    ]


def expand(q: str, pack: RulePack) -> str:
    parts = [
        f"CASE WHEN {matches(q, chr(92) + 'b' + term.replace('-', '[-]') + chr(92) + 'b')} THEN [{', '.join(map(lit, names))}] ELSE [] END"
        for term, names in pack.synonyms
    ]
    new = (f"list_sort(list_distinct(list_filter(flatten([{', '.join(parts)}]), lambda a: NOT contains(lower(asked), lower(a)))))")
    return f"CASE WHEN len({new}) > 0 THEN {strip(f'''asked || ' ' || array_to_string({new}, ' ')''')} ELSE asked END"


def _active(rules) -> str:
    if not rules:
        return "[]::VARCHAR[]"
    items = ", ".join(f"CASE WHEN {matches('qf', x[1])} THEN {lit(x[0])} END" for x in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _first(rules) -> str:
    return "CASE " + " ".join(f"WHEN {matches('qf', p)} THEN {lit(name)}" for name, p in rules) + " END"


def intents(profile: str = "v2", pack: RulePack = V2) -> list[str]:
    dose, topic, task = (matches("qf", p) for p in (pack.action_dose, pack.action_condition, v.ACTION_TASK))
    action = f"({dose} AND {topic})" if pack.action_needs_dose else f"({topic} AND ({dose} OR {task}))"
    m = lambda p: matches("qf", p)
    return requests(profile) + [
        f"folded AS (SELECT *, {fold('asked')} AS af FROM requests WHERE asked <> '')",
        f"expanded AS MATERIALIZED (SELECT *, {expand('af', pack)} AS query FROM folded)",
        f"expanded_f AS (SELECT *, {fold('query')} AS qf FROM expanded)",
        f"""intents AS MATERIALIZED (
  SELECT query_id, asked, query, k, search_mode, safe_top1_guardrail, threshold, strict_mode, strict_cds_mode, source_mode,
    who_first_policy, who_failover_threshold,
    {action} AS is_action, {_first([(c[0], c[1]) for c in pack.conditions])} AS condition,
    {_active(pack.coherence)} AS coherence, {_active(pack.title_exclusions)} AS title_exclusions,
    {_active(pack.content_exclusions)} AS content_exclusions,
    {m(v.SEVERITY_LIGHT_QUERY)} AS sev_light, {m(v.SEVERITY_HEAVY_QUERY)} AND NOT {m(v.SEVERITY_LIGHT_QUERY)} AS sev_heavy,
    {m(v.SENSITIVE_TB_QUERY)} AS sensitive_tb, {m(v.POP_ADULT_QUERY)} AS pop_adult, {m(v.POP_NEONATE_QUERY)} AS pop_neonate,
    {m(v.POP_CHILD_QUERY)} AND NOT {m(v.POP_ADULT_QUERY)} AND NOT {m(v.POP_NEONATE_QUERY)} AS pop_child,
    {_first(v.TASKS)} AS task, {m(v.CHEST_SYNDROME_QUERY)} AS asks_chest_syndrome, {m(pack.treatment_component)} AS asks_component,
    {m(v.PAEDIATRIC_QUERY)} AS asks_paediatric, {m(v.ADULT_NON_OBSTETRIC)} AND NOT {m(v.OBSTETRIC_QUERY)} AS asks_adult_other
  FROM expanded_f)""",
    ]


# ---------------------------------------------------------------- candidate lists

def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def index(chunk_table: str = "chunks", s: str = "") -> list[str]:
    return [
        f"words{s} AS MATERIALIZED (SELECT frame_id, {_tokens('title || chr(32) || content')} AS w FROM {chunk_table})",
        f"""postings{s} AS MATERIALIZED (
  SELECT term, frame_id, count(*) AS tf, any_value(doc_len) AS doc_len
  FROM (SELECT frame_id, len(w) AS doc_len, unnest(w) AS term FROM words{s}) GROUP BY term, frame_id)""",
        f"term_df{s} AS MATERIALIZED (SELECT term, count(*) AS df FROM postings{s} GROUP BY term)",
        f"stats{s} AS MATERIALIZED (SELECT count(*) AS n_chunks, avg(len(w)) AS avg_len FROM words{s})",
    ]


def pool(pack: RulePack) -> str:
    if pack.pool_limit is not None:
        return str(pack.pool_limit)
    return "CASE WHEN is_action THEN least(greatest(k * 3, 15), 50) ELSE k END"


def lists(pack: RulePack, asked: str = "intents", s: str = "", vectors: str | None = None) -> list[str]:
    """lexical, semantic and dispatched candidate lists."""
    new, gone = "rank", ""
    if pack.metadata_priority:  # chunks without content leave after the fetch
        new = "row_number() OVER (PARTITION BY query_id ORDER BY rank)"
        gone = " AND frame_id NOT IN (SELECT frame_id FROM chunks WHERE content = '')"
    vectors = vectors or f"SELECT {FRAME.format(i='vec_id')} AS frame_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON doc_id = vec_id"
    return [
        f"""query_vecs{s} AS MATERIALIZED (
  SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON item_id = vec_id WHERE item_id % 13 <> 12)""",
        f"chunk_vecs{s} AS MATERIALIZED ({vectors})",
        f"""ready{s} AS MATERIALIZED (
  SELECT *, lower(search_mode) AS mode, {pool(pack)} AS pool FROM {asked}
  WHERE lower(search_mode) NOT IN ('sem', 'rrf') OR query_id IN (SELECT query_id FROM query_vecs{s}))""",
        f"""terms{s} AS (SELECT query_id, pool, unnest(list_distinct({_tokens('query')})) AS term FROM ready{s} WHERE mode <> 'sem')""",
        f"""bm25{s} AS (
  SELECT query_id, frame_id, any_value(pool) AS pool,
    CAST(sum(CAST(round(ln((n_chunks - df + 0.5e0) / (df + 0.5e0) + 1.0e0) * (tf * 2.2e0)
      / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * doc_len / avg_len)) * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 AS score
  FROM terms{s} JOIN term_df{s} USING (term) JOIN postings{s} USING (term), stats{s} GROUP BY query_id, frame_id)""",
        f"""lex{s} AS MATERIALIZED (
  SELECT query_id, frame_id, score, {new} AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM bm25{s}) WHERE rank <= pool{gone})""",
        f"""cosine{s} AS (
  SELECT query_id, pool, frame_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 9) AS score
  FROM ready{s} JOIN query_vecs{s} q USING (query_id), chunk_vecs{s} c WHERE mode IN ('sem', 'rrf'))""",
        f"""sem{s} AS MATERIALIZED (
  SELECT query_id, frame_id, score, {new} AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM cosine{s}) WHERE rank <= pool{gone})""",
        f"""listed{s} AS (
  SELECT query_id, frame_id, rank, 0 AS l FROM lex{s} UNION ALL SELECT query_id, frame_id, rank, 1 FROM sem{s})""",
        f"""fused{s} AS (
  SELECT query_id, split_part(frame_id, '#', 1) AS parent_id, sum(1.0e0 / (60 + rank) ORDER BY l, rank) AS score,
    first(frame_id ORDER BY l, rank) AS frame_id, min(l * 1000000 + rank) AS pos
  FROM listed{s} JOIN ready{s} USING (query_id) WHERE mode = 'rrf' GROUP BY ALL)""",
        f"""candidates{s} AS MATERIALIZED (
  SELECT query_id, frame_id, score, pos FROM fused{s}
  UNION ALL SELECT query_id, frame_id, score, rank FROM lex{s} JOIN ready{s} USING (query_id) WHERE mode NOT IN ('rrf', 'sem')
  UNION ALL SELECT query_id, frame_id, score, rank FROM sem{s} JOIN ready{s} USING (query_id) WHERE mode = 'sem')""",
    ]


# ---------------------------------------------------------------- stages

def _stage(name: str, prev: str, score: str) -> str:
    return (f"{name} AS (SELECT * EXCLUDE (ns) REPLACE (ns AS score, list_prepend(ns, trail) AS trail) "
            f"FROM (SELECT *, {score} AS ns FROM {prev}))")


def _f(cond: str, x: float) -> str:
    return f" * CASE WHEN {cond} THEN {num(x)} ELSE 1e0 END"


_TC = lambda n: f"(title_f || ' ' || substr(content_f, 1, {n}))"
_PROTO = "substr(title_f || chr(10) || content_f, 1, 2000)"
_BOTH = "both_f"


def _topic(text: str, pack: RulePack, slot: int) -> str:
    arms = " ".join(f"WHEN condition = {lit(c[0])} THEN {matches(text, c[slot])}" for c in pack.conditions)
    return f"(CASE {arms} ELSE false END)"


def _coherent(text: str, pack: RulePack) -> str:
    return "(" + " OR ".join(f"(list_contains(coherence, {lit(i)}) AND {matches(text, p)})" for i, _, p in pack.coherence) + ")"


def _signals(text: str) -> str:
    return "(" + " + ".join(f"CAST({matches(text, p)} AS INTEGER)" for p in (v.DOSE_NUMBER, v.ROUTE_ADMIN, v.FREQUENCY)) + ")"


def hits(pack: RulePack, asked: str = "intents", chunk_table: str = "chunks", s: str = "") -> list[str]:
    drop = "AND retrieval_priority > 0" if pack.metadata_priority else ""
    return [
        f"""hits{s} AS MATERIALIZED (
  SELECT c.query_id, c.score, c.pos, [c.score] AS trail, h.*, q.* EXCLUDE (query_id, asked, search_mode, source_mode),
    {fold('h.title')} AS title_f, {fold('h.content')} AS content_f,
    lower({fold(strip('h.title'))}) || ' ' || lower({fold('h.content')}) AS both_f
  FROM candidates{s} c JOIN (SELECT * REPLACE (substr(content, 1, 15000) AS content) FROM {chunk_table}) h USING (frame_id) JOIN {asked} q USING (query_id)
  WHERE NOT {matches(f"substr({fold('h.content')}, 1, 2000)", pack.corruption)} {drop})""",
    ]


def actionable(pack: RulePack) -> str:
    return f"({inlist('content_type', pack.action_types)} OR {matches(_PROTO, v.PROTOCOL_TEXT)})"


def stages(pack: RulePack, s: str = "") -> list[str]:
    """boost, action, population, coherence, exclusion, rescue, soft, diverse, ranked."""
    weights = "CASE content_type " + " ".join(f"WHEN {lit(t)} THEN {num(w)}" for t, w in pack.type_weights.items()) + " ELSE 1e0 END"
    boost = f"score * {weights}"
    if pack.metadata_priority:
        boost += " * retrieval_priority"
    else:
        title = strip("title_f")
        boost += _f(f"content_type = 'regular' AND title <> '' AND {matches(title, v.WEAK_TITLE_V1)}", r.WEAK_TITLE_FACTOR)
        if pack.heading_fragments:
            boost += _f(f"{matches(title, v.BARE_HEADING_V1)} AND NOT {matches(f'''substr({strip('content_f')}, 1, 1200)''', v.PROTOCOL_TEXT)} "
                        f"AND length({strip('content')}) < {r.HEADING_CHARS}", r.HEADING_FACTOR)
    steps = [
        f"CASE WHEN {inlist('content_type', pack.context_types)} THEN {num(r.CONTEXT_FACTOR)} ELSE 1e0 END",
        f"(1e0 + {num(r.SIGNAL_STEP)} * {_signals('substr(content_f, 1, 2000)')})",
        f"CASE WHEN {inlist('content_type', pack.action_types)} THEN {num(r.ACTION_BONUS)} ELSE 1e0 END",
    ]
    if pack.protocol_bonus:
        steps.append(f"CASE WHEN {actionable(pack)} THEN {num(r.PROTOCOL_BONUS)} ELSE 1e0 END")
    out = [_stage(f"boost{s}", f"hits{s}", boost)]
    if pack.metadata_priority:
        out.append(_stage(f"action{s}", f"boost{s}", f"CASE WHEN is_action THEN score * {' * '.join(steps)} ELSE score END"))
    else:
        prev = f"boost{s}"
        for n, step in enumerate(steps):
            out.append(_stage(f"action_step{n}{s}", prev, f"CASE WHEN is_action THEN score * {step} ELSE score END"))
            prev = f"action_step{n}{s}"
        out.append(f"action{s} AS (SELECT * FROM {prev} WHERE NOT (is_action AND {inlist('content_type', v.EVIDENCE_TYPES_V1)} AND score < {num(r.EVIDENCE_FLOOR)}))")
    pop = ("CASE WHEN asks_paediatric THEN score ELSE score" + _f(inlist("pdf_file", pack.paediatric_files), r.PAEDIATRIC_FACTOR)
           + _f(f"asks_adult_other AND {inlist('pdf_file', v.OBSTETRIC_FILES)}", r.OBSTETRIC_FACTOR) + " END")
    out.append(_stage(f"population{s}", f"action{s}", pop))
    off = f"len(coherence) > 0 AND NOT {_coherent(_TC(1000), pack)}"
    out.append(_stage(f"coherence{s}", f"population{s}",
                      f"CASE WHEN {off} THEN score * CASE WHEN {inlist('content_type', pack.action_types)} THEN {num(pack.harsh_incoherence)} "
                      f"ELSE {num(r.INCOHERENT_FACTOR)} END ELSE score END"))
    excl = "score"
    for rules in (pack.title_exclusions, pack.title_overrides):
        for rid, _, p, w in rules:
            excl += _f(f"list_contains(title_exclusions, {lit(rid)}) AND {matches('title_f', p)}", w)
    content = "".join(_f(f"list_contains(content_exclusions, {lit(rid)}) AND {matches(_TC(1200), p)}", w) for rid, _, p, w in pack.content_exclusions)
    if pack.metadata_priority:
        out.append(_stage(f"exclusion{s}", f"coherence{s}", excl + content))
    else:
        out.append(_stage(f"exclusion_t{s}", f"coherence{s}", excl))
        out.append(_stage(f"exclusion{s}", f"exclusion_t{s}", "score" + content) if content
                   else f"exclusion{s} AS (SELECT * FROM exclusion_t{s})")
    if pack.rescue:
        low = f"lower({_TC(2000)})"
        cond = (f"(content_type = 'background' AND {matches(_PROTO, v.PROTOCOL_TEXT)} AND ({matches(_PROTO, v.RESCUE_RECOMMEND)} OR {_signals(_PROTO)} >= 2) "
                f"AND CASE WHEN condition IS NOT NULL THEN {_topic(low, pack, 2)} ELSE {_coherent(low, pack)} END)")
        out.append(f"rescue_f{s} AS (SELECT *, {cond} AS rescued FROM exclusion{s})")
        out.append(_stage(f"rescue{s}", f"rescue_f{s}", "score" + _f("rescued", r.RESCUE_FACTOR)))
    else:
        out.append(f"rescue{s} AS (SELECT *, false AS rescued FROM exclusion{s})")
    if pack.soft_corruption:
        out.append(_stage(f"soft{s}", f"rescue{s}", "score" + _f(matches(_TC(1200), v.CORRUPTION_SOFT), r.SOFT_CORRUPTION_FACTOR)))
    else:
        out.append(f"soft{s} AS (SELECT * FROM rescue{s})")
    out.append(f"placed{s} AS (SELECT *, row_number() OVER (PARTITION BY query_id, pdf_file ORDER BY trail DESC, pos) AS file_place FROM soft{s})")
    out.append(_stage(f"diverse{s}", f"placed{s}", "score" + _f(f"file_place > {r.PER_FILE}", r.CROWDED_FACTOR)))
    order = "row_number() OVER (PARTITION BY query_id ORDER BY trail DESC, pos)"
    if pack.metadata_priority:
        out.append(f"ranked{s} AS MATERIALIZED (SELECT * REPLACE ({order} AS pos, [score] AS trail) FROM diverse{s})")
        return out
    out.append(f"sorted{s} AS (SELECT * REPLACE ({order} AS pos, [score] AS trail), max(score) OVER (PARTITION BY query_id) AS best FROM diverse{s})")
    out.append(f"tail{s} AS (SELECT * EXCLUDE (best) FROM sorted{s} WHERE NOT is_action OR score >= best * {num(r.TAIL_RATIO)} OR (NOT strict_cds_mode AND pos <= {r.TAIL_KEEP}))")
    blocked = f"(title <> '' AND ({matches('title_f', pack.corruption)} OR {matches(strip('title_f'), v.WEAK_TITLE_V1)}))"
    out.append(f"strict{s} AS (SELECT * FROM tail{s} WHERE NOT strict_cds_mode OR ({inlist('content_type', v.STRICT_TYPES_V1)} AND NOT {blocked}))")
    out.append(f"ranked{s} AS MATERIALIZED (SELECT * FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY trail DESC, pos) AS pos) FROM strict{s}) WHERE pos <= k)")
    return out


def intent_stages(pack: RulePack, prev: str = "thresholded") -> list[str]:
    """signals, weighed, relaxed, final order."""
    on, off = _topic(_BOTH, pack, 2), _topic(_BOTH, pack, 3)
    sev = "(sev_light OR sev_heavy)"
    m = lambda p: matches(_BOTH, p)
    title = strip("title_f")
    out = []
    if prev == "thresholded":
        out.append("thresholded AS (SELECT * FROM ranked WHERE threshold <= 0 OR score >= threshold)")
    out.append(f"""signals AS MATERIALIZED (
  SELECT *, {on} AS on_topic, {off} AS off_topic, {sev} AND {m(v.SEVERITY_HEAVY_CHUNK)} AS chunk_heavy,
    sev_light AND {m(v.SEVERITY_LIGHT_CHUNK)} AS chunk_light, sensitive_tb AND {m(v.RESISTANT_TB_CHUNK)} AS chunk_resistant,
    (pop_adult OR pop_neonate OR pop_child) AND {m(v.POP_NEONATE_CHUNK)} AS chunk_neonate,
    (pop_adult OR pop_child) AND {m(v.POP_CHILD_CHUNK)} AS chunk_child, pop_adult AND {m(v.POP_ADULT_CHUNK)} AS chunk_adult,
    coalesce(condition = 'snakebite', false) AND {m(v.SCORPION_CHUNK)} AS chunk_scorpion,
    coalesce(condition = 'rabies', false) AND {m(v.RABIES_CONFUSERS)} AS chunk_rabies_confuser,
    coalesce(condition = 'sickle_cell', false) AND asks_chest_syndrome AND NOT {m(v.CHEST_SYNDROME_CHUNK)} AS chest_miss,
    len(coherence) > 0 AND NOT {_coherent(_BOTH, pack)} AS incoherent, condition IS NOT NULL AS asked_topic
  FROM {prev})""")
    p = "1e0"
    if pack.type_penalties:
        p += " * CASE WHEN content_type = 'annex' THEN 0.25e0 WHEN content_type = 'research_gap' THEN 0.15e0 WHEN content_type IN ('scope', 'executive_summary') THEN 0.35e0 ELSE 1e0 END"
    if pack.annex_titles:
        p += _f(matches(title, v.ANNEX_TITLE_V1), 0.25)
    p += f" * CASE WHEN NOT asked_topic THEN 1e0 WHEN off_topic AND NOT on_topic THEN {num(pack.off_topic_penalty)}"
    if pack.mixed_topic_penalty is not None:
        p += f" WHEN off_topic AND on_topic THEN {num(pack.mixed_topic_penalty)}"
    p += f" WHEN on_topic THEN 1e0 ELSE {num(pack.neither_topic_penalty or 1.0)} END"
    if pack.topic_overrides:
        p += _f("chunk_scorpion", 0.05) + _f("chunk_rabies_confuser", 0.20)
    if pack.chest_syndrome:
        p += _f("chest_miss", 0.30)
    if pack.generic_titles:
        p += _f(f"asked_topic AND NOT on_topic AND {matches(title, v.GENERIC_TITLE_V1)}", 0.45)
        p += _f(f"asked_topic AND NOT on_topic AND {matches(title, v.NOISE_TITLE_V1)}", 0.35)
    if pack.type_penalties:
        p += (" * CASE WHEN asked_topic AND NOT on_topic AND content_type IN ('background', 'methods_pico', 'methodology', 'epidemiology') THEN 0.45e0"
              " WHEN asked_topic AND NOT on_topic AND content_type IN ('evidence_summary', 'etd', 'rationale', 'remarks') THEN 0.55e0 ELSE 1e0 END")
        p += _f("asked_topic AND on_topic AND incoherent", 0.55)
    p += _f("sev_light AND chunk_heavy", 0.35) + _f("sensitive_tb AND chunk_resistant", 0.25)
    p += " * CASE WHEN pop_adult AND chunk_neonate THEN 0.30e0 WHEN pop_adult AND chunk_child AND NOT chunk_adult THEN 0.60e0 ELSE 1e0 END"
    credit = "asked_topic AND on_topic"
    if pack.mixed_topic_penalty is not None:
        credit += " AND NOT off_topic"
    if pack.topic_overrides:
        credit += " AND NOT chunk_scorpion"
    if pack.chest_syndrome:
        credit += " AND NOT chest_miss"
    wanted = " OR ".join(f"(task = {lit(t)} AND {inlist('content_type', types)})" for t, types in pack.task_types.items())
    slots = [
        (credit, 0.25),
        ("CASE WHEN sev_light THEN NOT chunk_heavy AND chunk_light ELSE sev_heavy AND chunk_heavy END", 0.10),
        ("pop_adult AND NOT chunk_neonate AND chunk_adult", 0.10),
        ("NOT pop_adult AND pop_neonate AND chunk_neonate", 0.20),
        ("pop_child AND chunk_child AND NOT chunk_neonate", 0.10),
        (f"coalesce({wanted}, false)", 0.10),
    ]
    boost = "0e0" + "".join(f" + CASE WHEN {c} THEN {num(x)} ELSE 0e0 END" for c, x in slots)
    count = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in slots)
    out.append(f"weighed0 AS (SELECT *, greatest({p}, 0.1e0) AS penalty, {boost} AS boost0, {count} AS slots FROM signals)")
    out.append("weighed1 AS (SELECT *, boost0 + CASE WHEN slots >= 3 THEN 0.15e0 WHEN slots = 2 THEN 0.05e0 ELSE 0e0 END AS boost FROM weighed0)")
    out.append("weighed AS MATERIALIZED (SELECT *, score * penalty * (1e0 + boost) AS adjusted FROM weighed1)")
    if pack.light_guard:
        out.append("""guard AS (SELECT *, sev_light AND asked_topic AND on_topic AS asked_light,
    max(sev_light AND asked_topic AND on_topic AND chunk_light) OVER (PARTITION BY query_id) AS has_light FROM weighed)""")
        out.append("""guard_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked_light ORDER BY adjusted DESC, pos) AS light_rank FROM guard)""")
        out.append("""relaxed AS MATERIALIZED (SELECT * REPLACE (CASE WHEN asked_light AND NOT has_light AND light_rank = 1
    THEN adjusted * (0.5e0 / 0.35e0) ELSE adjusted END AS adjusted), asked_light AND NOT has_light AND light_rank = 1 AS relaxed FROM guard_rank)""")
    else:
        out.append("relaxed AS (SELECT *, false AS relaxed FROM weighed)")
    new = "adjusted" if pack.rescored else "score"
    out.append(f"""reranked AS MATERIALIZED (SELECT * REPLACE ({new} AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, trail DESC, pos) AS pos) FROM relaxed)""")
    return out


_PLAIN = "(title_f || ' ' || substr(content_f, 1, 1200))"


def _of_top(x: str) -> str:
    return f"max(CASE WHEN pos = 1 THEN {x} END) OVER (PARTITION BY query_id)"


def _off_condition(pack: RulePack, acts: str) -> str:
    off = f"(NOT {_topic(_PLAIN, pack, 2)} AND (len(coherence) = 0 OR NOT {_coherent(_PLAIN, pack)}))"
    if pack.chest_syndrome:
        off = f"({off} OR (asks_chest_syndrome AND NOT {matches(_PLAIN, v.CHEST_SYNDROME_CHUNK)}))"
    return f"(condition IS NOT NULL AND {off} AND NOT (asks_component AND {acts}))"


def _swap(name: str, prev: str, wanted: str, flag: str) -> list[str]:
    return [
        f"{name}_w AS (SELECT *, min(CASE WHEN {wanted} THEN pos END) OVER (PARTITION BY query_id) AS come_from FROM {prev})",
        f"""{name} AS MATERIALIZED (SELECT * EXCLUDE (come_from) REPLACE (
    CASE WHEN come_from IS NULL OR pos > come_from THEN pos WHEN pos = come_from THEN 1 ELSE pos + 1 END AS pos), come_from IS NOT NULL AS {flag} FROM {name}_w)""",
    ]


def guards(pack: RulePack) -> list[str]:
    low = f"lower({_PLAIN})"
    out = [f"""aligned AS (SELECT *, CASE WHEN condition IS NOT NULL THEN {_topic(low, pack, 2)} AND NOT {_topic(low, pack, 3)}
    ELSE {_coherent(_PLAIN, pack)} END AS aligned, {inlist('content_type', pack.action_types)} OR rescued AS promotable FROM reranked)"""]
    if pack.guarded_promotion:
        extra = "promotable AND NOT top_promotable AND (NOT top_aligned OR is_action)"
    else:
        extra = "NOT top_aligned"
    out.append(f"aligned_top AS (SELECT *, {_of_top('score')} AS top_score, {_of_top('promotable')} AS top_promotable, {_of_top('aligned')} AS top_aligned FROM aligned)")
    out += _swap("promoted", "aligned_top", f"pos > 1 AND aligned AND score >= top_score * {num(pack.promote_ratio)} AND {extra}", "aligned_swap")
    component = inlist("content_type", pack.component_types or pack.action_types)
    out.append(f"""fit AS (SELECT *, {_off_condition(pack, component)} AS off_cond,
    {_topic(_PLAIN, pack, 2)} AND (len(coherence) = 0 OR {_coherent(_PLAIN, pack)}) AS fits FROM promoted)""")
    out.append(f"fit_top AS (SELECT * EXCLUDE (top_score), {_of_top('score')} AS top_score, {_of_top('off_cond')} AS top_off, {_of_top('source')} AS top_source FROM fit)")
    same = " AND source = top_source" if pack.same_source_guard else ""
    out += _swap("safe", "fit_top", f"safe_top1_guardrail AND pos > 1 AND top_off AND fits AND (NOT is_action OR {inlist('content_type', pack.action_types)}) "
                                   f"AND score >= top_score * {num(g.GUARD_RATIO)}{same}", "safe_swap")
    out.append("final AS MATERIALIZED (SELECT * FROM safe WHERE pos <= k)")
    return out


def flags(pack: RulePack) -> list[str]:
    corrupt = matches("substr(content_f, 1, 300)", pack.corruption)
    if pack.guarded_promotion:
        acts = top_acts = f"({actionable(pack)} OR rescued)"
        names = ["corruption_in_top3", "low_confidence", "off_condition_top", "no_actionable_in_top3", "low_priority_top"]
    else:
        acts = actionable(pack) if pack.protocol_bonus else inlist("content_type", pack.action_types)
        top_acts = inlist("content_type", pack.component_types)
        names = ["corruption_in_top3", "low_confidence_all_results", "off_condition_top_result", "no_protocol_in_top3", None]
        if not pack.promotion:
            names[1] = names[2] = None
    tests = ["bool_or(pos <= 3 AND corrupt)", f"bool_or(pos = 1 AND score < {num(g.LOW_CONFIDENCE)})", "bool_or(pos = 1 AND off_c)",
             "bool_or(is_action) AND NOT bool_or(pos <= 3 AND acts)", f"bool_or(pos = 1 AND retrieval_priority < {num(g.LOW_PRIORITY)})"]
    items = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in zip(names, tests) if n)
    return [
        f"seen AS (SELECT *, {corrupt} AS corrupt, {_off_condition(pack, top_acts)} AS off_c, {acts} AS acts FROM final)",
        f"flags AS (SELECT query_id, list_filter([{items}], lambda x: x IS NOT NULL) AS quality_flags FROM seen GROUP BY query_id)",
    ]


def full(profile: str = "v2") -> tuple[RulePack, list[str]]:
    """All CTEs up to ``final`` and ``flags``."""
    pack = {"v2": V2, "v1": V1, "v1_federated": FEDERATED}[profile]
    base = chunks() if profile == "v2" else chunks_v1()
    head = base + intents(profile, pack) + index() + lists(pack) + hits(pack) + stages(pack)
    return pack, head + intent_stages(pack) + guards(pack) + flags(pack)


def federated() -> list[str]:
    """CTEs of a two-corpus search: p_ranked, s_asked, s_ranked, merged, kept, reranked, final, flags."""
    pack = FEDERATED
    body = drop_lines("sentence || chr(10) || html", v.METADATA_LINES_V1)
    limit = " ".join(f"WHEN lower(search_mode) = {lit(m)} THEN {num(x)}" for m, x in v.FAILOVER_THRESHOLDS.items())
    n = len(seeds.CHUNKS)
    out = chunks_v1() + intents("v1_federated", pack) + [
        f"""pages2 AS MATERIALIZED (SELECT 'w' || page_id AS frame_id, title, {body} AS content, 'WikiMed' AS source,
  'kb://wiki/' || pdf || '/' || page_id AS uri, type1 AS content_type, 1.0e0 AS retrieval_priority, pdf AS pdf_file, page_id AS i
  FROM pages JOIN seed_chunks ON page_id % {n} = seed_no)""",
        "asked_1 AS (SELECT * FROM intents WHERE source_mode <> 'wiki')",
    ]
    out += index() + lists(pack, "asked_1") + hits(pack, "asked_1") + stages(pack)
    out += [
        "counts AS (SELECT query_id, count(*)::INTEGER AS n, max(CASE WHEN pos = 1 THEN score END) AS top FROM ranked GROUP BY query_id)",
        f"""gaps AS (SELECT i.*, coalesce(n, 0) AS n, top IS NULL OR top < (CASE {limit} ELSE who_failover_threshold END) AS low FROM intents i LEFT JOIN counts USING (query_id))""",
        """asked_2f AS MATERIALIZED (SELECT * REPLACE (CASE WHEN source_mode = 'who' THEN k - n ELSE k END AS k, source_mode <> 'who' AND strict_cds_mode AS strict_cds_mode),
  CASE WHEN source_mode = 'auto' AND who_first_policy THEN CASE WHEN n = 0 THEN 'who_no_hit' ELSE 'who_low_score' END END AS failover_reason
  FROM gaps WHERE CASE source_mode WHEN 'who' THEN k > n WHEN 'wiki' THEN true ELSE NOT who_first_policy OR low END)""",
        "asked_2 AS (SELECT * EXCLUDE (n, low, failover_reason) FROM asked_2f)",
    ]
    vec = "SELECT 'w' || page_id AS frame_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN pages ON page_id = vec_id"
    out += index("pages2", "_2") + lists(pack, "asked_2", "_2", vec) + hits(pack, "asked_2", "pages2", "_2") + stages(pack, "_2")
    floor = f"CASE WHEN NOT strict_cds_mode AND is_action THEN {num(pack.action_floor)} ELSE threshold END"
    out += [
        "both_ AS (SELECT 0 AS side, * FROM ranked UNION ALL BY NAME SELECT 1 AS side, * FROM ranked_2)",
        """merged0 AS (SELECT b.* EXCLUDE (k, strict_cds_mode), q.k, q.strict_cds_mode, q.source_mode, row_number() OVER (PARTITION BY query_id
  ORDER BY CASE WHEN q.source_mode = 'auto' THEN -b.score END, side, b.pos) AS mpos FROM both_ b JOIN (SELECT query_id, k, strict_cds_mode, source_mode FROM intents) q USING (query_id))""",
        "merged AS MATERIALIZED (SELECT * EXCLUDE (mpos) REPLACE (mpos AS pos, [score] AS trail) FROM merged0 WHERE source_mode <> 'auto' OR mpos <= k)",
        f"kept AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos) FROM merged WHERE ({floor}) <= 0 OR score >= ({floor}))",
    ]
    out += intent_stages(pack, "kept") + ["final AS (SELECT * FROM reranked)"] + flags(pack)
    return out
