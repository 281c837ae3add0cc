"""Registered transcript, case-text, extraction, source and stream queries, with their comparison SQL."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..operators import cases as ca
from ..operators import fhir as fh
from ..operators import manifests as ma
from ..operators import observations as ob
from ..operators import transcripts as tr
from ..rules import concepts as c
from ..session import shared_folder
from ..sources import audio, logs, records, sse
from ..sources.confirm import write_confirmed
from ..sources.corpus import vocabulary_summary
from ..streaming import conversations as live
from . import inputs as i
from . import seeds
from .sqltools import lit, strip, values, with_

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def md5(col):
    return F.md5(F.col(col).cast("binary") if isinstance(col, str) else col.cast("binary"))


# ------------------------------------------------------------------ transcripts

_T = [
    values("openings", "no, opening", list(enumerate(seeds.ASSISTANT))),
    "transcripts AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN opening || chr(10) || text ELSE text END AS text "
    "FROM conversations JOIN openings ON (turn // 2 + conv_id) % 4 = no)",
]
_TAGS = f"list_transform(regexp_extract_all(text, '(?is)<KB_QUERY>(.*?)</KB_QUERY>', 1), lambda x: {strip('x')})"
_STEPS = _T + [
    f"steps AS MATERIALIZED (SELECT conv_id, turn, text, {_TAGS} AS tags, contains(text, '## Clinical Assessment') AS answered, "
    "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM transcripts WHERE role = 'assistant')",
]


def _fold(policy):
    fresh = "list_filter(tags, lambda t: NOT list_contains(used, lower(t)))"
    if policy == "blocking":
        q, known, other = "tags[-1]", "list_contains(used, lower(tags[-1]))", "duplicate"
    else:
        q, known, other = f"{fresh}[1]", f"len({fresh}) = 0", "stop"
    shown = "asks" if policy == "blocking" else "took"
    return _STEPS + [
        f"""fold AS (
  SELECT conv_id, -1::BIGINT AS step, NULL::BIGINT AS turn, []::VARCHAR[] AS used, 'start' AS outcome, NULL::VARCHAR AS query
  FROM (SELECT DISTINCT conv_id FROM steps)
  UNION ALL
  SELECT conv_id, step, turn, CASE WHEN took THEN list_append(used, lower(q)) ELSE used END,
    CASE WHEN took AND len(used) + 1 >= 5 THEN 'final_query' WHEN took THEN 'query' WHEN asks THEN '{other}' ELSE 'stop' END,
    CASE WHEN {shown} THEN q END
  FROM (SELECT *, asks AND NOT coalesce(known, false) AS took FROM (
    SELECT s.conv_id, s.step, s.turn, f.used, {q} AS q, {known} AS known,
      len(tags) > 0 AND NOT answered AND s.step < 4 AND len(used) < 5 AS asks
    FROM fold f JOIN steps s ON s.conv_id = f.conv_id AND s.step = f.step + 1 WHERE f.outcome <> 'stop' AND s.step < 5)))""",
        "outcomes AS MATERIALIZED (SELECT * FROM fold WHERE step >= 0)",
    ]


def _rec(ctes, final):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


@query("t1_kb_query_tags", with_(_T, f"SELECT conv_id, turn, unnest(range(len(tags))) AS pos, unnest(tags) AS query FROM (SELECT *, {_TAGS} AS tags FROM transcripts)"))
def _(spark, d):
    return tr.tag_rows(i.transcripts(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


for _policy in ("blocking", "streaming"):
    @query(f"t2_t3_outcomes_{_policy}", _rec(_fold(_policy), "SELECT conv_id, turn, step, query, outcome, len(used) AS queries_so_far FROM outcomes"))
    def _(spark, d, _policy=_policy):
        out = tr.turn_outcomes(i.transcripts(spark, d), _policy)
        return out.withColumns({"step": F.col("step").cast("bigint"), "queries_so_far": F.col("queries_so_far").cast("bigint")})


_EVID = [
    "results AS (SELECT conv_id, turn, 'WHO Guidelines' AS source, turn * 0.37e0 + (conv_id % 7) * 0.05e0 AS score, text AS content FROM conversations WHERE conv_id % 3 < 2)",
    """blocks AS MATERIALIZED (SELECT o.conv_id, o.turn, o.step, o.query, o.outcome, coalesce(source, 'none') AS source, coalesce(score, 0e0) AS score,
  CASE WHEN source IS NULL THEN '<KB_RESULT source="none" score="0">' || chr(10) || 'No KB evidence found for: ' || query || chr(10) || '</KB_RESULT>'
  ELSE '<KB_RESULT source="' || source || '" score="' || printf('%.1f', score) || '">' || chr(10) || content || chr(10) || '</KB_RESULT>' END AS block
  FROM outcomes o LEFT JOIN results r USING (conv_id, turn) WHERE outcome IN ('query', 'final_query'))""",
]


def _evidence(spark, d, policy="blocking"):
    t = i.transcripts(spark, d)
    out = tr.turn_outcomes(t, policy)
    return t, out, tr.evidence(out, i.evidence_results(spark, d))


@query("t4_evidence_blocks", _rec(_fold("blocking") + _EVID, "SELECT conv_id, turn, query, outcome, source, score, md5(block) AS block FROM blocks"))
def _(spark, d):
    _, _, ev = _evidence(spark, d)
    return ev.select("conv_id", "turn", "query", "outcome", "source", "score", md5("block").alias("block"))


_REPLY = (f"CASE WHEN o.outcome = 'duplicate' THEN {lit(tr.DUPLICATE_TEXT)} WHEN o.outcome = 'final_query' THEN block || {lit(tr.FINAL_TEXT)} ELSE block END")
_PROMPTS = _fold("blocking") + _EVID + [
    f"""added AS (SELECT o.conv_id, o.turn, s.text || '<end_of_turn>' || chr(10) || '<start_of_turn>user' || chr(10) || {_REPLY}
  || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS added
  FROM outcomes o JOIN steps s USING (conv_id, turn) LEFT JOIN blocks b USING (conv_id, turn) WHERE o.outcome <> 'stop')""",
    """starts AS (SELECT conv_id, '<bos>' || text || '<start_of_turn>model' || chr(10) AS start FROM conversations WHERE turn = 0)""",
]


@query("t5_next_prompts", _rec(_PROMPTS, """SELECT conv_id, turn, md5(start || string_agg(added, '' ORDER BY turn)
  OVER (PARTITION BY conv_id ORDER BY turn)) AS prompt FROM added JOIN starts USING (conv_id)"""))
def _(spark, d):
    t, out, ev = _evidence(spark, d)
    prompts = i.table(spark, d, "conversations").where(F.col("turn") == 0).select("conv_id", F.col("text").alias("prompt"))
    return tr.next_prompts(t, prompts, out, ev).select("conv_id", "turn", md5("prompt").alias("prompt"))


# the streaming loop trims what has grown too long after every turn
_MARK = "'<start_of_turn>user' || chr(10)"
_TRIM = (f"CASE WHEN length(x) > {tr.CONTEXT_CHARS} THEN substr(x, 1, strpos(x, {_MARK}) - 1 + length({_MARK})) || '[...context trimmed...]' || chr(10) || right(x, {tr.TAIL_CHARS}) ELSE x END")
_LONG = "repeat(text || ' ', 40)"
_STREAM_PROMPTS = _fold("streaming") + _EVID + [
    f"""added AS (SELECT o.conv_id, o.step, o.turn, s.text || '<end_of_turn>' || chr(10) || '<start_of_turn>user' || chr(10) || {_REPLY}
  || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS added
  FROM outcomes o JOIN steps s USING (conv_id, turn) LEFT JOIN blocks b USING (conv_id, turn) WHERE o.outcome <> 'stop')""",
    f"starts AS (SELECT conv_id, '<bos>' || '<start_of_turn>user' || chr(10) || {_LONG} || '<start_of_turn>model' || chr(10) AS start FROM conversations WHERE turn = 0)",
    f"""grown AS (SELECT conv_id, -1::BIGINT AS step, NULL::BIGINT AS turn, start AS x FROM starts
  UNION ALL SELECT conv_id, step, turn, {_TRIM} FROM (SELECT a.conv_id, a.step, a.turn, g.x || a.added AS x FROM grown g JOIN added a ON a.conv_id = g.conv_id AND a.step = g.step + 1))""",
]


@query("t5_next_prompts_streaming", _rec(_STREAM_PROMPTS, f"SELECT conv_id, turn, md5(x) AS prompt, contains(x, '[...context trimmed...]') AS trimmed FROM grown WHERE step >= 0"))
def _(spark, d):
    t, out, ev = _evidence(spark, d, "streaming")
    first = i.table(spark, d, "conversations").where(F.col("turn") == 0)
    prompts = first.select("conv_id", F.concat(F.lit(tr.USER_TURN), F.repeat(F.concat("text", F.lit(" ")), 40)).alias("prompt"))
    out = tr.next_prompts(t, prompts, out, ev, "streaming")
    return out.select("conv_id", "turn", md5("prompt").alias("prompt"), F.contains("prompt", F.lit("[...context trimmed...]")).alias("trimmed"))


@query("t6_trim_context", f"""SELECT doc_id, length(t) AS chars, md5(t) AS hash FROM (SELECT doc_id, CASE WHEN length(x) > {tr.CONTEXT_CHARS}
  THEN substr(x, 1, strpos(x, m) - 1 + length(m)) || '[...context trimmed...]' || chr(10) || right(x, {tr.TAIL_CHARS}) ELSE x END AS t
  FROM (SELECT doc_id, '<bos>' || doc_id || '<start_of_turn>user' || chr(10) || text AS x, '<start_of_turn>user' || chr(10) AS m FROM documents))""")
def _(spark, d):
    text = F.concat(F.lit("<bos>"), F.col("doc_id").cast("string"), F.lit(tr.USER_TURN), "text")
    out = i.table(spark, d, "documents").select("doc_id", tr.trim_context(text).alias("t"))
    return out.select("doc_id", F.length("t").cast("bigint").alias("chars"), md5("t").alias("hash"))


_TEXTS = _fold("blocking") + [
    "texts AS MATERIALIZED (SELECT conv_id, string_agg(s.text, '' ORDER BY s.turn) AS raw, count(*) AS turns FROM steps s JOIN outcomes USING (conv_id, turn) GROUP BY conv_id)",
]


def _texts(spark, d):
    t = i.transcripts(spark, d)
    return tr.conversation_texts(t, tr.turn_outcomes(t))


@query("t7_missing_assessment", _rec(_TEXTS, "SELECT conv_id, NOT regexp_matches(raw, '## (?:Alert Level|Clinical Assessment|Recommended)') AS missing FROM texts"))
def _(spark, d):
    return tr.missing_assessment(_texts(spark, d)).select("conv_id", "missing")


def _chain(x, steps):
    for pattern in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, '', 'g')"
    return x


_CLEAN = ["(?is)<think>.*?</think>", "(?is)<KB_QUERY>.*?</KB_QUERY>", "(?is)<think>.*$", "(?i)</think>", "QUERY_ESTIMATE:.*",
          "DECISION:\\s*\\w+", "NEXT_QUERY:.*", "CASE_COMPLEXITY:.*"]
_CLEAN_UI = ["(?is)<think(?:ing)?>.*?</think(?:ing)?>", "(?is)<kb_query>.*?</kb_query>", "(?is)<think(?:ing)?>.*$", "(?i)</think(?:ing)?>", "(?i)DECISION:\\s*\\w+"]


@query("t8_clean", with_(_T, f"SELECT conv_id, turn, md5({_chain('text', _CLEAN)}) AS server, md5({strip(_chain('text', _CLEAN_UI))}) AS display FROM transcripts"))
def _(spark, d):
    t = i.transcripts(spark, d)
    return t.select("conv_id", "turn", md5(tr.clean(F.col("text"))).alias("server"), md5(tr.clean_display(F.col("text"))).alias("display"))


_SECTIONS = _TEXTS + [
    f"cleaned AS (SELECT conv_id, raw, {_chain('raw', _CLEAN)} AS c FROM texts)",
    "pieces AS (SELECT conv_id, unnest(range(len(x))) AS n, unnest(x) AS p FROM (SELECT conv_id, string_split(regexp_replace(c, '(?m)^(## .+)$', chr(1) || '\\1', 'g'), chr(1)) AS x FROM cleaned))",
    f"heads AS (SELECT conv_id, n, p, lower({strip('''regexp_extract(p, '(?m)^## .+$')''')}) AS title FROM pieces WHERE regexp_matches(p, '^## .+'))",
    f"kept AS (SELECT conv_id, n, {strip('p')} AS p FROM heads QUALIFY row_number() OVER (PARTITION BY conv_id, title ORDER BY n) = 1)",
    "joined AS (SELECT conv_id, string_agg(p, chr(10) || chr(10) ORDER BY n) AS j FROM kept GROUP BY conv_id)",
    f"visible AS (SELECT c.conv_id, raw, {strip('coalesce(j, c)')} AS v FROM cleaned c LEFT JOIN joined USING (conv_id))",
    "lasts AS (SELECT *, regexp_extract_all(raw, '(?is)<think>(.*?)</think>', 1)[-1] AS last FROM visible)",
]


@query("t9_t10_responses", _rec(_SECTIONS, f"""SELECT conv_id, md5({strip('''CASE WHEN v <> '' THEN v WHEN last IS NULL THEN ''
  WHEN regexp_matches(last, '## ') THEN regexp_extract(last, '(?s)(## .+)', 1) ELSE last END''')}) AS response FROM lasts"""))
def _(spark, d):
    return tr.clean_responses(_texts(spark, d)).select("conv_id", md5("response").alias("response"))


_UI = _T + [
    f"cleaned AS (SELECT conv_id, turn, {strip(_chain('text', _CLEAN_UI))} AS c FROM transcripts)",
    "marked AS (SELECT *, string_split(regexp_replace(c, '(?m)^##\\s+(.+)$', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS x FROM cleaned)",
    "rows_ AS (SELECT conv_id, turn, unnest(range(1, len(x))) AS n, unnest(x[2:]) AS p FROM marked)",
    f"heads AS (SELECT conv_id, turn, n, {strip('split_part(p, chr(2), 1)')} AS title, {strip('substr(p, strpos(p, chr(2)) + 1)')} AS body FROM rows_)",
    "firsts AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(title) ORDER BY n) = 1)",
    f"bodies AS (SELECT conv_id, turn, n, title, {strip('''regexp_replace(body, '(?m)^## .+$', '', 'g')''')} AS content FROM firsts)",
    "all_ AS (SELECT * FROM bodies WHERE content <> '' UNION ALL SELECT conv_id, turn, 0, 'Clinical Insight', c FROM marked WHERE len(x) = 1 AND length(c) > 20)",
]
_ICON = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(title), {lit(w)})" for w in words) + f" THEN {lit(icon)}" for words, icon in tr.ICONS) + " ELSE 'report' END"


@query("t11_display_sections", with_(_UI, f"SELECT conv_id, turn, title, {_ICON} AS icon, md5(content) AS content FROM all_"))
def _(spark, d):
    t = i.transcripts(spark, d).select("conv_id", "turn", F.inline(tr.section_array(F.col("text"))))
    return t.select("conv_id", "turn", "title", "icon", md5("content").alias("content"))


@query("t12_rollup", _rec(_fold("blocking") + _EVID, """SELECT conv_id, turns, n_queries, top_score, top_source, coalesce(titles, '') AS titles FROM
  (SELECT conv_id, count(*) AS turns, count_if(outcome IN ('query', 'final_query'))::BIGINT AS n_queries FROM outcomes GROUP BY conv_id)
  LEFT JOIN (SELECT conv_id, max(score) AS top_score, first(source ORDER BY score DESC, turn) AS top_source, string_agg(query, '|' ORDER BY score DESC, turn) AS titles
    FROM blocks GROUP BY conv_id) USING (conv_id)"""))
def _(spark, d):
    _, out, ev = _evidence(spark, d)
    hits = ev.withColumns({"rank": F.lit(1), "title": F.col("query")})
    return tr.rollup(out, hits).select("conv_id", "turns", "n_queries", "top_score", "top_source", F.coalesce(F.array_join("titles", "|"), F.lit("")).alias("titles"))


# ------------------------------------------------------------------ case text

_STAMP = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
_P = [
    f"""enc AS (SELECT 'p' || o_custkey AS patient_uuid, 'e' || o_orderkey AS uuid, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus,
  CASE o_orderkey % 3 WHEN 0 THEN {_STAMP} || '.000+0000' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE {_STAMP} END AS dt FROM orders)""",
    "ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_uuid ORDER BY o_orderdate, uuid) AS ord FROM enc) WHERE ord <= 50)",
    """items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
  (l_linenumber + l_orderkey) % 8 AS kind, l_quantity, l_extendedprice, l_shipdate, l_linenumber, l_returnflag FROM lineitem)""",
    """leaves AS (SELECT l_orderkey, n, 0 AS m, kind,
    CASE kind WHEN 0 THEN 'Weight (kg)' WHEN 1 THEN 'Systolic blood pressure (CIEL:5085)' WHEN 2 THEN 'Gestational age' WHEN 3 THEN 'Height'
      WHEN 4 THEN 'Appointment Date' WHEN 5 THEN 'Diagnosis' ELSE 'Result' END AS name,
    CASE kind WHEN 0 THEN l_quantity::VARCHAR WHEN 1 THEN (floor(l_extendedprice)::BIGINT % 200)::VARCHAR WHEN 2 THEN '28'
      WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN '{"uuid": "u", "display": "Malaria (CIEL:116128)"}' WHEN 7 THEN 'Malaria, confirmed' END AS value
  FROM items WHERE kind <> 6
  UNION ALL SELECT l_orderkey, n, 0, 6, 'Height (cm)', l_linenumber::VARCHAR FROM items WHERE kind = 6
  UNION ALL SELECT l_orderkey, n, 1, 6, 'Flag', l_returnflag FROM items WHERE kind = 6)""",
    """lines AS (SELECT *, CASE WHEN kind = 1 THEN 'Systolic blood pressure' ELSE name END || ': ' || CASE WHEN kind = 0 THEN value || ' kg' WHEN kind = 1 THEN value || ' mmHg'
    WHEN kind = 4 THEN substr(value, 1, 10) WHEN kind = 5 THEN 'Malaria' WHEN kind = 6 AND m = 0 THEN value || ' cm' ELSE value END AS line FROM leaves)""",
    f"""ages AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 4 THEN c_acctbal / 100 END AS age FROM customer)""",
]
_AGE = "coalesce(CASE WHEN age < 0 THEN '-' ELSE '' END || printf('%.1f', abs(age)), '0.0')"
_HEAD = f"""'Age: ' || {_AGE} || chr(10) || 'Gender: ' || CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'U' END || chr(10)
  || 'Birthdate: ' || CASE WHEN c_custkey % 7 <> 6 THEN '1986-08-19' ELSE '1900-01-01' END || chr(10)
  || 'OpenMRS ID: ' || CASE WHEN c_custkey % 4 = 2 THEN 'Unknown' ELSE c_name END"""


@query("s3_patient_encounters", with_(_P, "SELECT patient_uuid, uuid, ord, dt AS encounterDatetime FROM ranked"))
def _(spark, d):
    e = records.earliest(i.encounters(spark, d), records.ENCOUNTER_LIMIT)
    return e.select("patient_uuid", "uuid", F.col("ord").cast("bigint").alias("ord"), "encounterDatetime")


@query("p1_p2_p3_flatten_obs", with_(_P, """SELECT 'e' || l_orderkey AS encounter_uuid, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, m) - 1 AS ord,
  trim(regexp_replace(name, '\\s*\\(CIEL:\\d+\\)', '', 'g')) AS name, CASE kind WHEN 0 THEN '5089' WHEN 1 THEN '5085' WHEN 2 THEN '161439' WHEN 3 THEN '5090'
  WHEN 6 THEN CASE WHEN m = 0 THEN '5090' END WHEN 7 THEN '1284' END AS code, value FROM leaves WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""))
def _(spark, d):
    flat = ca.flatten_obs(i.encounters(spark, d))
    return flat.select("encounter_uuid", F.col("ord").cast("bigint").alias("ord"), ca.strip_code(F.col("name")).alias("name"), "code", "value")


@query("p4_obs_lines", with_(_P, "SELECT 'e' || l_orderkey AS encounter_uuid, line, count(*) AS n FROM lines WHERE line IS NOT NULL AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL"))
def _(spark, d):
    e = i.encounters(spark, d)
    lines = e.select(F.col("uuid").alias("encounter_uuid"), F.explode(F.array_compact(F.transform(ca.leaves(F.col("obs"), 2), ca.obs_line))).alias("line"))
    return lines.groupBy("encounter_uuid", "line").agg(F.count("*").alias("n"))


@query("p5_p6_header_and_attributes", with_(_P, f"""SELECT 'p' || c_custkey AS patient_uuid, {_HEAD} AS header,
  'Occupation: ' || c_mktsegment || chr(10) || 'Civil Status: Married' AS attributes FROM customer JOIN ages USING (c_custkey)"""))
def _(spark, d):
    p = i.patients(spark, d)
    return p.select(F.col("uuid").alias("patient_uuid"), F.array_join(ca.header_lines(F.col("person"), F.col("identifiers"), ties_to_even=True), "\n").alias("header"),
                    F.array_join(ca.attribute_lines(F.col("person.attributes")), "\n").alias("attributes"))


@query("p7_p8_case_text", with_(_P + [
    "whole AS (SELECT *, row_number() OVER (PARTITION BY patient_uuid ORDER BY o_orderdate, uuid) AS ord FROM enc)",
    "obs_text AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY n, m) AS t, count(DISTINCT n) AS n_obs FROM lines GROUP BY l_orderkey)",
    """visits AS (SELECT patient_uuid, ord, 'Visit: ' || o_orderpriority || chr(10) || 'Date: ' || CASE WHEN contains(substr(dt, 1, 19), 'T') THEN substr(dt, 1, 19)
    ELSE substr(dt, 1, 10) || 'T00:00:00' END || chr(10) || 'Location: ' || CASE WHEN o_orderstatus <> 'P' THEN 'Clinic ' || o_orderstatus ELSE 'Unknown' END
    || coalesce(chr(10) || t, '') AS v, coalesce(n_obs, 0) AS n_obs FROM whole LEFT JOIN obs_text ON l_orderkey = o_orderkey)""",
    "per AS (SELECT patient_uuid, string_agg(v, chr(10) ORDER BY ord) AS vs, count(*) AS encounter_count, sum(n_obs)::BIGINT AS obs_count FROM visits GROUP BY patient_uuid)",
], f"""SELECT 'p' || c_custkey AS patient_uuid, md5({_HEAD} || chr(10) || 'Occupation: ' || c_mktsegment || chr(10) || 'Civil Status: Married' || coalesce(chr(10) || vs, '')) AS case_text,
  coalesce(encounter_count, 0) AS encounter_count, coalesce(obs_count, 0) AS obs_count,
  coalesce(all_, 0) - coalesce(encounter_count, 0) AS encounters_left_out FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS all_ FROM orders GROUP BY 1) USING (c_custkey) JOIN ages USING (c_custkey) LEFT JOIN per ON patient_uuid = 'p' || c_custkey"""))
def _(spark, d):
    out = ca.case_text(i.patients(spark, d), i.encounters(spark, d), ties_to_even=True)
    return out.select("patient_uuid", md5("case_text").alias("case_text"), "encounter_count", "obs_count", "encounters_left_out")


# ------------------------------------------------------------------ manifests and observations

_TYPES = [*c.ENCOUNTER_CONCEPTS, "unknown-type"]
_M = [
    values("dict", "code, label, manifest_line, unit, fhir_type, category, value_type", c.CONCEPTS),
    values("type_codes", "t, ord, code", [(t, n, code) for t, codes in [*c.ENCOUNTER_CONCEPTS.items(), ("unknown-type", c.DEFAULT_CONCEPTS)] for n, code in enumerate(codes)]),
    values("codes", "no, code", [(n, x[0]) for n, x in enumerate(c.CONCEPTS)]),
    "ids AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN code ELSE '9' || p_partkey END AS code, 'loc-' || lpad(p_partkey::VARCHAR, 9, '0') AS local_uuid FROM part JOIN codes ON no = p_partkey % 30 WHERE (p_partkey % 30) % 3 < 2)",
    "local AS (SELECT code, min(local_uuid) AS lu FROM ids GROUP BY code)",
    f"""manifest AS MATERIALIZED (SELECT t, ord, code AS ciel_code, label, manifest_line, unit, fhir_type, category, value_type, substr(code || repeat('A', 32), 1, 36) AS full_code,
  coalesce(lu, substr(code || repeat('A', 32), 1, 36)) AS local_uuid,
  array_to_string(list_transform(string_split(label, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS display0 FROM type_codes JOIN dict USING (code) LEFT JOIN local USING (code))""",
    f"enc AS (SELECT 'e' || o_orderkey AS encounter_uuid, 'p' || o_custkey AS patient_uuid, o_orderkey AS doc_id, {'[' + ', '.join(map(lit, _TYPES)) + ']'}[o_orderkey % 8 + 1] AS t FROM orders)",
]


def _manifests(spark, d):
    concepts, lists = ma.dictionary_tables(spark)
    return ma.manifests(i.encounters_flat(spark, d), concepts, lists, i.concept_ids(spark, d))


@query("s4_dictionaries", with_(_M, """SELECT t AS encounter_type, count(*) AS n, count(unit) AS with_unit, count_if(category = 'laboratory')::BIGINT AS lab,
  count_if(local_uuid LIKE 'loc-%')::BIGINT AS local FROM manifest GROUP BY t"""))
def _(spark, d):
    concepts, lists = ma.dictionary_tables(spark)
    per = ma.type_manifests(concepts, lists, i.concept_ids(spark, d))
    rows = per.select(F.coalesce("encounter_type_uuid", F.lit("unknown-type")).alias("encounter_type"), F.explode("manifest").alias("m"))
    return rows.groupBy("encounter_type").agg(
        F.count("*").alias("n"), F.count("m.unit").alias("with_unit"), F.count_if(F.col("m.category") == "laboratory").alias("lab"),
        F.count_if(F.col("m.local_uuid").startswith("loc-")).alias("local"))


@query("s9_vocabulary_summary", "SELECT 'c' || p_partkey % 5 AS category, count(*) AS n_concepts FROM part GROUP BY 1")
def _(spark, d):
    return vocabulary_summary(i.vocabulary(spark, d))


@query("e1_manifests", with_(_M, """SELECT encounter_uuid, ord, label, ciel_code, full_code AS ciel_uuid_full, local_uuid, unit, display0 AS display_name
  FROM enc JOIN manifest USING (t)"""))
def _(spark, d):
    rows = ma.manifest_rows(_manifests(spark, d))
    return rows.select("encounter_uuid", "ord", "label", "ciel_code", "ciel_uuid_full", "local_uuid", "unit", "display_name")


@query("e2_manifest_labels", with_(_M + [
    "strings AS (SELECT t, string_agg(manifest_line, chr(10) ORDER BY ord) AS s FROM manifest GROUP BY t)",
    "ls AS (SELECT t, unnest(string_split('CONCEPTS:' || chr(10) || s, chr(10))) AS l FROM strings)",
    "labels AS (SELECT t, string_agg(x, '|' ORDER BY x) AS labels FROM (SELECT DISTINCT t, replace(lower(trim(split_part(trim(regexp_replace(trim(l), '^\\[.*?\\]\\s*', '')), '(', 1))), ' ', '_') AS x FROM ls WHERE NOT starts_with(upper(trim(l)), 'CONCEPTS')) GROUP BY t)",
], "SELECT encounter_uuid, labels FROM enc JOIN labels USING (t)"))
def _(spark, d):
    return _manifests(spark, d).select("encounter_uuid", F.array_join(F.array_sort("manifest_labels"), "|").alias("labels"))


_OBS = [
    values("obs_seed", "no, label, value", [(n, *x) for n, x in enumerate(seeds.OBSERVATIONS)]),
    "obs_lines AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, label, value) - 1 AS pos, label, value FROM lineitem JOIN obs_seed ON (l_linenumber * 5 + l_orderkey) % 16 = no)",
    """outputs AS MATERIALIZED (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>weighing it</think>' || chr(10) || '- ' WHEN 1 THEN 'Note: check' || chr(10) || '* ' ELSE '' END
  || string_agg(label || ': ' || value, chr(10) ORDER BY pos) || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'NOT_IN_MANIFEST: oedema' || chr(10) || 'pallor: NONE' || chr(10) || '# done: yes'
  WHEN 1 THEN chr(10) || '<think>cut: off' ELSE '' END AS raw FROM obs_lines GROUP BY doc_id)""",
]
_UNTHINK = "regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '', 'g')"


def _kv(text, line, key, extra, split="_"):
    return _OBS + [
        f"ls AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS l0 FROM (SELECT doc_id, string_split({text}, chr(10)) AS x FROM outputs))",
        f"lb AS (SELECT doc_id, pos, {line} AS l FROM ls)",
        f"kv AS (SELECT doc_id, pos, l, {strip('''split_part(l, ':', 1)''')} AS label0, {strip('''substr(l, strpos(l, ':') + 1)''')} AS value FROM lb WHERE contains(l, ':'))",
        f"kk AS (SELECT *, {key} AS label FROM kv)",
        f"parsed AS (SELECT doc_id, pos, label, value FROM kk WHERE label <> '' AND value <> '' {extra})",
    ]


_LOW = "replace(lower(label0), ' ', '_')"
_PROSE = f"AND NOT ({' OR '.join(f'starts_with(lower(label), {lit(p)})' for p in c.PROSE_PREFIXES)}) AND length(label) <= 50"
_KV = {
    "plain": _kv(strip("raw"), strip("l0"), _LOW, ""),
    "server": _kv(strip(_UNTHINK), f"ltrim({strip('l0')}, '- *')", _LOW, f"AND NOT starts_with(l, '#') {_PROSE} AND len(string_split(label, '_')) <= 5"),
    "audio": _kv(strip("raw"), strip("l0"), "CASE WHEN label0 = 'NOT_IN_MANIFEST' THEN value ELSE label0 END", "AND NOT starts_with(l, '#') AND (label0 = 'NOT_IN_MANIFEST' OR value <> 'NONE')"),
    "display": _kv(_UNTHINK, f"regexp_replace({strip('l0')}, '^[-*]\\s*', '')", "label0", f"{_PROSE} AND len(regexp_split_to_array(label, '[_ ]')) <= 5"),
}
_KV_FINAL = {
    "plain": "SELECT doc_id, pos, label, value FROM parsed", "server": "SELECT doc_id, pos, label, value FROM parsed",
    "audio": "SELECT doc_id, pos, label, CASE WHEN label0 = 'NOT_IN_MANIFEST' THEN 'NOT_IN_MANIFEST' ELSE value END AS value FROM kk JOIN parsed USING (doc_id, pos, label, value)",
    "display": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, label, value FROM parsed",
}

for _variant in ("plain", "server", "audio", "display"):
    @query(f"e4_parse_kv_{_variant}", with_(_KV[_variant], _KV_FINAL[_variant]))
    def _(spark, d, _variant=_variant):
        return ob.parse_kv(i.model_outputs(spark, d), _variant).withColumn("pos", F.col("pos").cast("bigint"))


_CUT = f"{strip('value')}"
_E = _OBS + _M + [
    f"""cleaned AS (SELECT doc_id, pos, {strip("regexp_replace(" + strip("ltrim(" + strip('label') + ", '_')") + ", '^\\[.*?\\]\\s*', '')")} AS label,
  {strip("rtrim(" + strip("CASE WHEN regexp_matches(" + _CUT + ", '(?:^|[^0-9])[\"''{}\\[\\]]') THEN regexp_extract(" + _CUT + ", '^((?:[^\"''{}\\[\\]]|[0-9][\"''{}\\[\\]])*)', 1) ELSE " + _CUT + " END") + ", ',')")} AS v0 FROM obs_lines)""",
    "units AS (SELECT doc_id, pos, label, regexp_replace(v0, '^([0-9]+(?:\\.[0-9]+)?)\\s*[a-zA-Z%/]+$', '\\1') AS value FROM cleaned)",
]


@query("e5_e6_clean", with_(_E, "SELECT doc_id, label, value, count(*) AS n FROM units GROUP BY ALL"))
def _(spark, d):
    rows = i.observation_lines(spark, d).select("doc_id", ob.clean_label(F.col("label")).alias("label"), ob.clean_value(F.col("value")).alias("value"))
    return rows.groupBy("doc_id", "label", "value").agg(F.count("*").alias("n"))


_NEG = lambda words: " OR ".join(f"contains(lower(value), {lit(w)})" for w in words)
_ACC = _E + [
    f"ok AS (SELECT *, 'e' || doc_id AS encounter_uuid FROM units WHERE label <> '' AND value <> '' AND NOT ({_NEG(ob.AUDIO_NEGATIONS)}))",
    "typed AS (SELECT ok.*, t, patient_uuid FROM ok JOIN enc USING (doc_id))",
    """found AS (SELECT typed.*, coalesce((SELECT m.label FROM manifest m WHERE m.t = typed.t AND m.label = typed.label),
    (SELECT first(m.label ORDER BY m.ord) FROM manifest m WHERE m.t = typed.t AND length(typed.label) >= 2 AND ends_with(m.label, '_' || typed.label))) AS entry FROM typed)""",
    f"accepted AS (SELECT doc_id, pos, coalesce(entry, label) AS label, value, entry, t, patient_uuid, encounter_uuid FROM found WHERE lower(value) NOT IN ('absent', 'not present', 'negative') AND NOT (lower(value) = 'present' AND entry IS NOT NULL))",
    "firsts AS MATERIALIZED (SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) = 1)",
]


def _entries(spark, d):
    concepts, lists = ma.dictionary_tables(spark)
    return ma.manifest_entries(concepts, lists, i.concept_ids(spark, d))


def _rows(spark, d, entries):
    rows = i.observation_lines(spark, d)
    typed = ma.with_manifest_type(i.encounters_flat(spark, d), entries)
    return rows.join(typed.select("doc_id", "encounter_uuid", "patient_uuid", "manifest_type"), "doc_id")


def _cleaned(spark, d):
    entries = _entries(spark, d)
    return ob.clean_observations(_rows(spark, d, entries), entries, "audio")


def _accepted(spark, d, path):
    entries = _entries(spark, d)
    return ob.accept(_rows(spark, d, entries), entries, path)


@query("e7_e8_e9_accept", with_(_ACC, "SELECT doc_id, pos, label, value, entry FROM accepted"))
def _(spark, d):
    out = _accepted(spark, d, "audio")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "label", "value", F.col("entry.label").alias("entry"))


@query("e7_text_path", with_(_OBS + _M, f"""SELECT doc_id, pos, label, value FROM (SELECT doc_id, pos, label, trim(trim(value, '"'), '''') AS value FROM obs_lines) x JOIN enc USING (doc_id)
  WHERE NOT starts_with(label, '#') AND NOT ({_NEG(ob.TEXT_NEGATIONS)}) AND value <> '' AND NOT (lower(value) = 'present' AND EXISTS (SELECT 1 FROM manifest m WHERE m.t = enc.t AND m.label = x.label))"""))
def _(spark, d):
    return _accepted(spark, d, "text").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "label", "value")


@query("e10_e11_items", with_(_ACC, """SELECT doc_id, label, value, pos, CASE WHEN entry IS NULL THEN 0.9e0 ELSE 0.95e0 END AS confidence,
  entry IS NULL AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.t = firsts.t AND m.label = replace(lower(firsts.label), ' ', '_')) AS not_in_manifest FROM firsts"""))
def _(spark, d):
    out = _cleaned(spark, d)
    return out.select("doc_id", "label", "value", F.col("pos").cast("bigint").alias("pos"), "confidence", "not_in_manifest")


_BUILT = "2026-01-01T00:00:00+00:00"


def _items(spark, d):
    return fh.to_fhir(_cleaned(spark, d), F.lit(_BUILT))


_NUM = "regexp_replace(value, '[^\\d.\\-]', '', 'g')"
_FH = _ACC + [f"""built AS (SELECT f.*, m.unit, m.local_uuid, m.ciel_code, m.display0, CASE WHEN {_NUM} NOT IN ('', '.', '-', '-.') THEN TRY_CAST({_NUM} AS DOUBLE) END AS number
  FROM firsts f LEFT JOIN manifest m ON m.t = f.t AND m.label = f.entry)"""]


@query("e12_observation_json", with_(_FH, """SELECT doc_id, label, number AS quantity, CASE WHEN number IS NOT NULL THEN coalesce(unit, '') END AS unit,
  CASE WHEN number IS NULL THEN value END AS value_string, local_uuid, ciel_code, 'Patient/' || patient_uuid AS subject, 'Encounter/' || encounter_uuid AS encounter
  FROM built WHERE entry IS NOT NULL"""))
def _(spark, d):
    return _read(_items(spark, d), {
        "quantity": "valueQuantity.value", "unit": "valueQuantity.unit", "value_string": "valueString", "local_uuid": "code.coding[0].code",
        "ciel_code": "code.coding[1].code", "subject": "subject.reference", "encounter": "encounter.reference"})


def _read(items, names):
    """doc_id, label and members of the payloads, each payload built and read once; items without one are left out."""
    read = items.select("doc_id", "label", F.inline(F.array(F.from_json("fhir_payload", fh.RESOURCE)))).where(F.col("resourceType").isNotNull())
    return read.select("doc_id", "label", *[F.expr(path).alias(name) for name, path in names.items()])


# the parts of the resources that do not depend on the value
@query("e12_observation_frame", with_(_FH, f"""SELECT b.doc_id, b.label, 'Observation' AS resource, 'final' AS status, coalesce(m.category, 'exam') AS category, {lit(fh.CATEGORY_SYSTEM)} AS category_system,
  array_to_string(list_transform(string_split(coalesce(m.category, 'exam'), '-'), lambda w: upper(w[1]) || lower(w[2:])), '-') AS category_display, b.display0 AS display, b.display0 AS text,
  {lit(fh.CIEL_SYSTEM)} AS ciel_system, NULL::VARCHAR AS local_system, 'Patient' AS subject_type, 'Encounter' AS encounter_type, {lit(_BUILT)} AS at
  FROM built b JOIN manifest m ON m.t = b.t AND m.label = b.entry WHERE b.entry IS NOT NULL"""))
def _(spark, d):
    return _read(_items(spark, d), {
        "resource": "resourceType", "status": "status", "category": "category[0].coding[0].code", "category_system": "category[0].coding[0].system",
        "category_display": "category[0].coding[0].display", "display": "code.coding[0].display", "text": "code.text", "ciel_system": "code.coding[1].system",
        "local_system": "code.coding[0].system", "subject_type": "subject.type", "encounter_type": "encounter.type", "at": "effectiveDateTime"})


@query("e13_condition_frame", with_(_FH, f"""SELECT b.doc_id, b.label, 'Condition' AS resource, {lit(fh.CLINICAL_SYSTEM)} AS clinical_system, {lit(fh.VERIFICATION_SYSTEM)} AS verification_system,
  b.display0 AS display, b.display0 AS text, b.local_uuid AS local_uuid, b.ciel_code AS ciel_code, 'Patient/' || patient_uuid AS subject, 'Encounter/' || encounter_uuid AS encounter, {lit(_BUILT)} AS at
  FROM built b WHERE b.entry IS NOT NULL"""))
def _(spark, d):
    items = _cleaned(spark, d).where(F.col("entry").isNotNull()).withColumn("entry", F.col("entry").withField("fhir_type", F.lit("Condition")))
    return _read(fh.to_fhir(items, F.lit(_BUILT)), {
        "resource": "resourceType", "clinical_system": "clinicalStatus.coding[0].system", "verification_system": "verificationStatus.coding[0].system", "display": "code.coding[0].display",
        "text": "code.text", "local_uuid": "code.coding[0].code", "ciel_code": "code.coding[1].code", "subject": "subject.reference", "encounter": "encounter.reference", "at": "recordedDate"})


@query("e13_condition_json", with_(_FH, """SELECT doc_id, label, CASE WHEN lower(trim(value)) IN ('absent', 'ruled_out') THEN 'refuted' WHEN lower(trim(value)) IN ('confirmed', 'unconfirmed')
  THEN lower(trim(value)) ELSE 'confirmed' END AS verification, CASE WHEN lower(trim(value)) IN ('absent', 'ruled_out') THEN 'inactive' ELSE 'active' END AS clinical
  FROM (SELECT doc_id, label, CASE doc_id % 4 WHEN 0 THEN 'Absent' WHEN 1 THEN 'unconfirmed' WHEN 2 THEN 'ruled_out' ELSE value END AS value FROM built WHERE entry IS NOT NULL)"""))
def _(spark, d):
    value = F.when(F.col("doc_id") % 4 == 0, "Absent").when(F.col("doc_id") % 4 == 1, "unconfirmed").when(F.col("doc_id") % 4 == 2, "ruled_out").otherwise(F.col("value"))
    items = _cleaned(spark, d).where(F.col("entry").isNotNull())
    items = items.withColumn("value", value).withColumn("entry", F.col("entry").withField("fhir_type", F.lit("Condition")))
    return _read(fh.to_fhir(items, F.lit(_BUILT)), {"verification": "verificationStatus.coding[0].code", "clinical": "clinicalStatus.coding[0].code"})


@query("e14_routing_and_text", with_(_FH, """SELECT doc_id, label, 'Observation' AS fhir_type, CASE WHEN entry IS NULL THEN array_to_string(list_transform(string_split(replace(label, '_', ' '), ' '),
  lambda w: upper(w[1]) || w[2:]), ' ') || ': ' || value WHEN coalesce(unit, '') <> '' THEN display0 || ' — ' || value || ' ' || unit ELSE display0 || ' — ' || value END AS human_readable FROM built"""))
def _(spark, d):
    return _items(spark, d).select("doc_id", "label", "fhir_type", "human_readable")


@query("e15_display_items", with_(_KV["display"], """SELECT doc_id, pos, label, value, human FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, label, value, replace(label, '_', ' ') || ': ' || value AS human FROM parsed WHERE doc_id % 2 = 0)
  UNION ALL SELECT doc_id, 0, 'given', 'v' || doc_id, CASE WHEN doc_id % 4 = 1 THEN 'shown' ELSE 'given: v' || doc_id END FROM outputs WHERE doc_id % 2 = 1"""))
def _(spark, d):
    out = i.model_outputs(spark, d)
    k = F.col("doc_id")
    given = F.when(k % 2 == 1, F.array(F.struct(
        F.lit("given").alias("label"), F.concat(F.lit("v"), k.cast("string")).alias("value"), F.when(k % 4 == 1, "shown").otherwise("").alias("human_readable"))))
    data = out.select("doc_id", given.alias("items"), F.lit("").alias("raw_model_output"), F.col("raw").alias("raw_output"))
    return ob.display_items(data).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "label", "value", F.col("human_readable").alias("human"))


_NOTES = [
    "notes AS (SELECT conv_id * 100 + turn AS doc_id, lower(CASE WHEN conv_id % 3 = 0 THEN 'Temp 38.5, BP 120 over ' || (turn + 70) || ' spo2 97 RR 22 ' || text ELSE text END) AS t FROM conversations WHERE role = 'user')",
    "vitals AS (" + " UNION ALL ".join(
        f"SELECT doc_id, {code} AS concept_id, {lit(label)} AS label, CAST(regexp_extract(t, {lit(p)}, 1) AS DOUBLE) AS value_num, {lit(u)} AS units FROM notes WHERE regexp_matches(t, {lit(p)})"
        for p, code, label, u in c.VITAL_SIGNS) + ")",
]


@query("e16_vital_signs", with_(_NOTES, "SELECT * FROM vitals"))
def _(spark, d):
    rows = i.notes(spark, d).select("doc_id", F.inline(ob.vital_signs(F.col("text"))))
    return rows.select("doc_id", "concept_id", "label", "value_num", "units")


@query("e17_vocabulary_terms", with_(_NOTES + [
    """vocab AS (SELECT p_partkey AS ord, 0 AS k, lower(substr('The and ing ion ent der die und que los las', (p_partkey % 38 + 1)::INTEGER, 4)) AS s, p_partkey + 100000 AS ciel_id, CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey END AS icd10 FROM part
    UNION ALL SELECT p_partkey, 1, 'x' || p_partkey % 40, p_partkey + 100000, CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey END FROM part)""",
    "syn AS (SELECT s, min(ord * 10 + k) AS place, last(ciel_id ORDER BY ord, k) AS ciel_id, last(icd10 ORDER BY ord, k) AS icd10 FROM vocab WHERE length(s) > 2 GROUP BY s)",
    f"rest AS (SELECT doc_id, {strip('t')} AS t FROM notes WHERE doc_id NOT IN (SELECT doc_id FROM vitals))",
    "hit AS (SELECT doc_id, first(ciel_id ORDER BY place) AS concept_id, first(icd10 ORDER BY place) AS icd10 FROM rest, syn WHERE contains(t, s) GROUP BY doc_id)",
], "SELECT doc_id, concept_id, icd10, CASE WHEN icd10 IS NOT NULL THEN 'provisional' END AS certainty, 0.7e0 AS confidence FROM hit"))
def _(spark, d):
    out = ob.extract_rules(i.notes(spark, d), i.vocabulary(spark, d)).where(F.col("datatype") == "coded")
    return out.select("doc_id", "concept_id", "icd10", "certainty", "confidence")


_RESPONSES = _NOTES + [
    """vocab AS (SELECT p_partkey AS ord, 0 AS k, lower(substr('The and ing ion ent der die und que los las', (p_partkey % 38 + 1)::INTEGER, 4)) AS s, p_partkey + 100000 AS ciel_id FROM part
    UNION ALL SELECT p_partkey, 1, 'x' || p_partkey % 40, p_partkey + 100000 FROM part)""",
    "syn AS (SELECT s, min(ord * 10 + k) AS place, last(ciel_id ORDER BY ord, k) AS ciel_id FROM vocab WHERE length(s) > 2 GROUP BY s)",
    f"term AS (SELECT doc_id, first(ciel_id ORDER BY place) AS concept_id FROM (SELECT doc_id, {strip('t')} AS t FROM notes WHERE doc_id NOT IN (SELECT doc_id FROM vitals)), syn WHERE contains(t, s) GROUP BY doc_id)",
    f"ruled AS (SELECT doc_id, count(*) AS n, first(concept_id ORDER BY list_position([{', '.join(str(x[1]) for x in c.VITAL_SIGNS)}], concept_id)) AS concept_id, first(value_num ORDER BY list_position([{', '.join(str(x[1]) for x in c.VITAL_SIGNS)}], concept_id)) AS number FROM vitals GROUP BY doc_id UNION ALL SELECT doc_id, 1, concept_id, NULL FROM term)",
]


@query("e18_parsed_responses", with_(_RESPONSES, """SELECT n.doc_id, n.doc_id % 5 >= 2 AS fallback, CASE n.doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE coalesce(r.n, 0) END AS n_observations,
  CASE n.doc_id % 5 WHEN 0 THEN n.doc_id WHEN 1 THEN NULL ELSE r.concept_id END AS concept_id, CASE n.doc_id % 5 WHEN 0 THEN 36.5e0 WHEN 1 THEN NULL ELSE r.number END AS number,
  CASE WHEN n.doc_id % 5 = 1 THEN 1 ELSE 0 END AS n_alerts FROM notes n LEFT JOIN ruled r USING (doc_id)"""))
def _(spark, d):
    k = F.col("doc_id")
    whole = F.concat(F.lit('Here: {"observations": [{"concept_id": '), k.cast("string"), F.lit(', "label": "t", "value": 36.5}, {"label": "x", "value": {"a": 1}}]} done'))
    response = F.when(k % 5 == 0, whole).when(k % 5 == 1, '{"cds_alerts": [{"type": "info", "message": "m"}], "unmatched": "x"}').when(
        k % 5 == 2, '{"observations": [ {"concept_id": 1} }').when(k % 5 == 3, "no object").otherwise(F.lit(None))
    notes = i.notes(spark, d).select("doc_id", F.col("text").alias("phrase"), response.alias("response"))
    out = ob.parse_responses(notes, i.vocabulary(spark, d))
    first = F.try_element_at("observations", F.lit(1))
    return out.select("doc_id", "fallback", F.size("observations").cast("bigint").alias("n_observations"), first["concept_id"].alias("concept_id"),
                      first["value"].try_cast("double").alias("number"), F.size("cds_alerts").cast("bigint").alias("n_alerts"))


@query("e18_embedded_json", """SELECT event_id, CAST(value AS DOUBLE) AS v, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 4 = 3 AS malformed FROM (
  SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN value END AS value, CASE WHEN event_id % 4 <> 3 THEN props END AS props FROM events)""")
def _(spark, d):
    e = i.table(spark, d, "events")
    body = F.concat(F.lit('Sure: {"v": '), F.col("value").cast("string"), F.lit(', "p": '), "props", F.when(F.col("event_id") % 4 == 3, "").otherwise("}"), F.lit(" done"))
    parsed = ob.embedded_json(body, "v double, p struct<k: bigint>")
    # a cut object has no closing brace of its own: the text after the inner one is not an object
    return e.select("event_id", parsed.alias("j")).select("event_id", "j.v", "j.p.k", F.col("j.v").isNull().alias("malformed"))


@query("e19_confidence", """WITH comp AS (SELECT label, vec_id, unnest(range(64)) AS j, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
  lab AS (SELECT label, j, avg(x) AS b FROM comp GROUP BY ALL), clip AS (SELECT vec_id // 3 AS clip_id, j, avg(x) AS a FROM comp GROUP BY ALL),
  cosine AS (SELECT clip_id, label, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cs FROM clip JOIN lab USING (j) GROUP BY ALL)
  SELECT clip_id, 'l' || label AS label, round(greatest(0, least(1, (cs + 1) / 2)), 3) AS confidence FROM cosine JOIN (SELECT DISTINCT vec_id // 3 AS clip_id, label FROM embeddings) USING (clip_id, label)""")
def _(spark, d):
    e = i.table(spark, d, "embeddings").withColumns({"clip_id": F.floor(F.col("vec_id") / 3), "label": F.concat(F.lit("l"), F.col("label").cast("string"))})
    return ob.confidence_scores(e.select("clip_id", "embedding"), e.select("label", "embedding"), e.select("clip_id", "label").distinct())


@query("s7_confirm_sink", with_(_FH, "SELECT encounter_uuid, label, 'Observation' AS fhir_type, CASE WHEN entry IS NULL THEN 'skipped' WHEN doc_id % 7 = 6 THEN 'failed' ELSE 'posted' END AS status FROM built"))
def _(spark, d):
    out = write_confirmed(_items(spark, d), f"{shared_folder(spark)}/{uuid.uuid4().hex}", F.col("doc_id") % 7 != 6)
    return out.select("encounter_uuid", "label", "fhir_type", "status")


@query("e20_confirm_summary", with_(_FH, """SELECT encounter_uuid, count_if(entry IS NOT NULL AND doc_id % 7 <> 6)::BIGINT AS posted, count_if(entry IS NOT NULL AND doc_id % 7 = 6)::BIGINT AS failed,
  count_if(entry IS NULL)::BIGINT AS skipped FROM built GROUP BY encounter_uuid"""))
def _(spark, d):
    return fh.confirm_summary(fh.confirm(_items(spark, d), F.col("doc_id") % 7 != 6))


_THINK = _OBS + _M + [
    "block AS (SELECT doc_id, CASE WHEN regexp_matches(raw, '(?s)<think>.*?</think>') THEN regexp_extract(raw, '(?s)<think>(.*?)</think>', 1) ELSE raw END AS body FROM outputs)",
    f"think AS MATERIALIZED (SELECT doc_id, unnest(range(len(x))) AS n, ltrim({strip('unnest(x)')}, '- ') AS line FROM (SELECT doc_id, string_split(body, chr(10)) AS x FROM block))",
    "listed AS (SELECT DISTINCT doc_id, label FROM enc JOIN manifest USING (t))",
    f"""able AS MATERIALIZED (SELECT doc_id, n, label, {strip("rtrim(" + strip("regexp_extract(line, '(?i)' || regexp_escape(label) || '\\s*[:=]\\s*(.+)', 1)") + ", ',')")} AS value
  FROM think JOIN listed USING (doc_id) WHERE regexp_matches(line, '(?i)' || regexp_escape(label) || '\\s*[:=]\\s*.'))""",
    """taken AS (SELECT doc_id, 0 AS n, []::VARCHAR[] AS seen, NULL::VARCHAR AS label, NULL::VARCHAR AS value FROM block
  UNION ALL SELECT t.doc_id, t.n + 1, CASE WHEN a.value <> '' THEN list_append(seen, a.label) ELSE seen END, a.label, a.value
  FROM taken t LEFT JOIN LATERAL (SELECT label, value FROM able WHERE able.doc_id = t.doc_id AND able.n = t.n AND NOT list_contains(t.seen, label) ORDER BY length(label) DESC, label LIMIT 1) a ON true
  WHERE t.n <= (SELECT max(n) FROM think))""",
]


@query("e3_think_lines", with_(_THINK, """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, replace(lower(label), ' ', '_') AS label, value
  FROM taken WHERE value <> ''""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    out = i.model_outputs(spark, d).join(_manifests(spark, d).select("doc_id", "manifest_string", "manifest_labels"), "doc_id")
    return ob.labelled_outputs(out).select("doc_id", "pos", "label", "value")


# ------------------------------------------------------------------ event lines, logs, audio

_LOG = "FROM events WHERE event_id % 50 <> 49"


@query("s6_service_log", f"""SELECT event_type AS service, count_if(event_id % 3 = 0)::BIGINT AS requests, count_if(event_id % 3 = 1)::BIGINT AS responses,
  count_if(event_id % 3 = 1 AND event_id % 6 = 0)::BIGINT AS empty, count_if(event_id % 3 = 1 AND event_id % 5 = 0)::BIGINT AS swapped,
  max(CASE WHEN event_id % 3 = 1 THEN value END) AS max_latency_ms {_LOG} AND event_id % 3 < 2 GROUP BY event_type""")
def _(spark, d):
    return logs.search_log_summary(logs.parse_log(i.service_log_lines(spark, d)))


@query("x5_request_log", f"""SELECT 't' || event_id % 1000 AS trace_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS ts, 'GET' AS method, NULL::VARCHAR AS path,
  CAST(arg_min(200 + event_id % 2, (ts, event_id % 2)) AS INTEGER) AS status, NULL::DOUBLE AS elapsed_ms
  FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts {_LOG}) WHERE event_id % 3 = 2 GROUP BY event_id % 1000""")
def _(spark, d):
    done = logs.request_log(logs.parse_log(i.service_log_lines(spark, d)))
    return done.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))


@query("s8_audio_triage", """SELECT doc_id, doc_id % 2 = 0 AS is_wav, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 8 = 2 THEN 2 ELSE 1 END END AS channels,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 8 = 4 THEN 44100 ELSE 16000 END END AS rate, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 8 = 6 THEN 8 ELSE 16 END END AS bits,
  doc_id % 8 <> 0 AS needs_transcode FROM documents""")
def _(spark, d):
    return audio.triage(i.audio_uploads(spark, d)).drop("content")


_LIVE = _T + [
    "said AS MATERIALIZED (SELECT conv_id, turn, text FROM transcripts WHERE role = 'assistant')",
    "tokens AS (SELECT conv_id::VARCHAR AS stream_id, sum(ceil(length(text) / 7.0))::BIGINT AS n_tokens, count(*) AS n_turns, string_agg(text, '' ORDER BY turn) AS said FROM said GROUP BY conv_id)",
]


@query("s5_sse_decode", with_(_LIVE, "SELECT stream_id, n_tokens, n_turns, md5(said) AS said FROM tokens"))
def _(spark, d):
    events = sse.decode_sse(i.sse_lines(spark, d))
    tokens = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "text"))))
    return events.groupBy("stream_id").agg(
        F.count_if(F.col("type") == "token").alias("n_tokens"), F.count_if(F.col("type") == "turn_start").alias("n_turns"),
        md5(F.array_join(F.transform(tokens, lambda t: t["text"]), "")).alias("said"))


def live_rows(spark, d):
    """The seeded token streams after one run of the keyed-state stream."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    i.sse_lines(spark, d).write.parquet(f"{folder}/lines")
    live.run_to_table(live.follow(sse.read_lines(spark, f"{folder}/lines"), idle_minutes=None), f"{folder}/rows", f"{folder}/state")
    return spark.read.schema(live.OUTPUT).parquet(f"{folder}/rows")


# a turn's text is thinking up to its first closing tag; query tags and their content vanish
_SPLIT = _LIVE + [
    "cut AS (SELECT conv_id, turn, text, strpos(text, '</think>') AS e FROM said)",
    f"""modes AS (SELECT conv_id, turn, regexp_replace(CASE WHEN e > 0 THEN substr(text, 1, e - 1) ELSE text END, '(?is)<think>|<kb_query>.*?</kb_query>', '', 'g') AS thinking,
    CASE WHEN e > 0 THEN regexp_replace(substr(text, e + 8), '(?i)</?kb_query>', '', 'g') ELSE '' END AS answer FROM cut)""",
]


@query("x1_live_text", with_(_SPLIT, """SELECT stream_id, kind, md5(t) AS text FROM (
  SELECT conv_id::VARCHAR AS stream_id, 'thinking' AS kind, string_agg(thinking, '' ORDER BY turn) AS t FROM modes GROUP BY conv_id
  UNION ALL SELECT conv_id::VARCHAR, 'answer', string_agg(answer, '' ORDER BY turn) FROM modes GROUP BY conv_id) WHERE t <> ''"""))
def _(spark, d):
    return live.spoken(live_rows(spark, d)).select("stream_id", "kind", md5("text").alias("text"))


# a heading counts at the end of its line; its line still belongs to the section before; the end of the stream overwrites what it parses
_LIVE_SECTIONS = _SPLIT + [
    "spoken AS (SELECT conv_id::VARCHAR AS stream_id, string_agg(answer, '' ORDER BY turn) AS t FROM modes GROUP BY conv_id)",
    "spoken_lines AS (SELECT stream_id, unnest(range(len(x))) AS n, len(x) AS many, unnest(x) AS line FROM (SELECT stream_id, string_split(t, chr(10)) AS x FROM spoken))",
    f"marks AS (SELECT *, CASE WHEN n < many - 1 AND regexp_matches(line, '^##\\s+\\S') THEN {strip('substr(line, 3)')} END AS title FROM spoken_lines)",
    "opens AS (SELECT *, title IS NOT NULL AND row_number() OVER (PARTITION BY stream_id, lower(title) ORDER BY n) = 1 AS opens FROM marks)",
    "placed AS (SELECT *, sum(opens::INT) OVER (PARTITION BY stream_id ORDER BY n ROWS UNBOUNDED PRECEDING) - opens::INT AS holds, sum(opens::INT) OVER (PARTITION BY stream_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS own FROM opens)",
    "live AS (SELECT t.stream_id, t.own - 1 AS ord, t.title, coalesce(string_agg(c.line, '' ORDER BY c.n), '') AS content FROM placed t LEFT JOIN placed c ON c.stream_id = t.stream_id AND c.holds = t.own WHERE t.opens GROUP BY ALL)",
    f"cleaned AS (SELECT conv_id::VARCHAR AS stream_id, {strip(_chain('t', _CLEAN_UI))} AS c FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM said GROUP BY conv_id))",
    "marked AS (SELECT *, string_split(regexp_replace(c, '(?m)^##\\s+(.+)$', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS x FROM cleaned)",
    "rows_ AS (SELECT stream_id, unnest(range(1, len(x))) AS n, unnest(x[2:]) AS p FROM marked)",
    f"heads AS (SELECT stream_id, n, {strip('split_part(p, chr(2), 1)')} AS title, {strip('substr(p, strpos(p, chr(2)) + 1)')} AS body FROM rows_)",
    "firsts AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY stream_id, lower(title) ORDER BY n) = 1)",
    f"final AS (SELECT stream_id, lower(title) AS key, {strip("regexp_replace(body, '(?m)^## .+$', '', 'g')")} AS content FROM firsts)",
]


@query("x2_live_sections", with_(_LIVE_SECTIONS, f"""SELECT l.stream_id, ord, title, {_ICON} AS icon, md5(coalesce(nullif(final.content, ''), l.content)) AS content
  FROM live l LEFT JOIN final ON final.stream_id = l.stream_id AND key = lower(title)"""))
def _(spark, d):
    rows = live_rows(spark, d)
    out = live.live_sections(rows, live.final_texts(rows))
    return out.select("stream_id", F.col("ord").cast("bigint").alias("ord"), "title", "icon", md5("content").alias("content"))


@query("x3_turn_texts", with_(_LIVE, "SELECT conv_id::VARCHAR AS conv_id, turn, md5(text) AS text FROM said"))
def _(spark, d):
    return live.turn_texts(live_rows(spark, d)).select("conv_id", "turn", md5("text").alias("text"))


_EVENTS = _fold("streaming") + [
    "said AS MATERIALIZED (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM transcripts WHERE role = 'assistant')",
    "loop_end AS (SELECT conv_id, max(step) AS last, arg_max(outcome, step) AS ended FROM outcomes GROUP BY conv_id)",
    "more AS (SELECT conv_id, last, ended, bool_or(step <= last AND regexp_matches(text, '## (?:Alert Level|Clinical Assessment|Recommended)')) AS assessed FROM said JOIN loop_end USING (conv_id) GROUP BY ALL)",
    "shown AS (SELECT conv_id, step, text FROM said JOIN more USING (conv_id) WHERE step <= last OR (step = last + 1 AND NOT assessed AND ended = 'stop'))",
    "asked AS (SELECT conv_id, step, query, length(query) AS n FROM outcomes WHERE outcome IN ('query', 'final_query'))",
    """sequence AS (SELECT conv_id, step, 0 AS place, 0 AS k, 'turn_start' AS type, NULL::VARCHAR AS text, NULL::VARCHAR AS source, NULL::DOUBLE AS score FROM shown
  UNION ALL SELECT conv_id, step, 1, k, 'token', substr(text, k * 7 + 1, 7), NULL, NULL FROM (SELECT conv_id, step, text, unnest(range((length(text) + 6) // 7)) AS k FROM shown)
  UNION ALL SELECT conv_id, step, 2, 0, 'kb_query', query, NULL, NULL FROM asked
  UNION ALL SELECT conv_id, step, 2, 1, 'kb_result', NULL, CASE WHEN n % 3 <> 0 THEN 'WHO Guidelines' ELSE 'none' END, CASE WHEN n % 3 <> 0 THEN n * 0.25e0 ELSE 0e0 END FROM asked
  UNION ALL SELECT conv_id, last + 2, 3, 0, 'done', (SELECT coalesce(string_agg(lower(query), chr(10) ORDER BY step), '') FROM asked WHERE asked.conv_id = more.conv_id), NULL, NULL FROM more)""",
]


@query("x3_event_sequence", _rec(_EVENTS, """SELECT conv_id::VARCHAR AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY step, place, k) AS n, type, md5(text) AS text, source, score FROM sequence"""))
def _(spark, d):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    i.sse_lines(spark, d).write.parquet(f"{folder}/lines")
    rows = live.follow(sse.read_lines(spark, f"{folder}/lines"), idle_minutes=None, kinds=["event"])
    live.run_events(rows, i.query_results(spark, d), f"{folder}/events", f"{folder}/state")
    order = Window.partitionBy("stream_id").orderBy("seq", "part", "sub")
    events = spark.read.parquet(f"{folder}/events").withColumn("n", F.row_number().over(order).cast("bigint"))
    return events.select("stream_id", "n", "type", md5("text").alias("text"), "source", "score")


@query("x4_merged_evidence", with_(_LIVE, """SELECT conv_id::VARCHAR AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, turn * 0.5e0 AS score, 't' || turn AS title FROM said"""))
def _(spark, d):
    out = live.running_evidence(live_rows(spark, d))
    return out.select("stream_id", F.col("rank").cast("bigint").alias("rank"), "score", "title")
