"""Observations from model output and notes: parsing, cleaning, matching to manifests."""

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.sizing import broadcast_small
from ..rules import concepts as c
from ..session import ship, stored
from .manifests import manifest_labels, suffix_entries
from .semantic import dot, pool_embeddings, vector_norm

# fixed values: negations, confidences
TEXT_NEGATIONS = ["not present", "not mentioned", "absent", "n/a"]
AUDIO_NEGATIONS = ["not present", "not mentioned", "n/a"]
AUDIO_ABSENT = ["absent", "not present", "negative"]
CONFIDENCE = {("text", True): 0.90, ("text", False): 0.85, ("audio", True): 0.95, ("audio", False): 0.90}
RULE_CONFIDENCE, SYNONYM_CONFIDENCE = 0.85, 0.70

_PAIR = "array<struct<pos:int,label:string,value:string>>"


_SEPARATED = re.compile(r"\s*[:=]\s*(.+)")


def _even_lower(text: str) -> str:
    """Lower case with every character in its place."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


@lru_cache(maxsize=256)
def _label_automaton(labels: tuple[str, ...]):
    """Automaton over the lower-cased labels; each holds the ranks of its labels, the longest first, equal lengths in alphabetical order."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for rank, label in enumerate(sorted(labels, key=lambda x: (-len(x), x))):
        low = _even_lower(label)
        automaton.add_word(low, (*automaton.get(low, ()), (rank, label)))
    automaton.make_automaton()
    return automaton


def labelled_lines(lines: list[str], labels: tuple[str, ...]) -> list[tuple[str, str]]:
    """(label, value) of the lines that hold a label, a colon or equals sign and a value."""
    if not labels:
        return []
    automaton, found = _label_automaton(labels), {}
    for raw in lines:
        line = raw.strip(tx.BLANKS).lstrip("- ")
        places: dict = {}
        for end, same in automaton.iter(_even_lower(line)):
            for mark in same:
                places.setdefault(mark, []).append(end + 1)
        for (_, label), ends in sorted(places.items()):
            value = next(filter(None, (_SEPARATED.match(line, e) for e in ends)), None) if label not in found else None
            if value:
                text = value[1].strip(tx.BLANKS).rstrip(",").strip(tx.BLANKS)
                if text:
                    found[label] = text
                break
    return list(found.items())


@lru_cache(maxsize=256)
def _listed(labels: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(filter(None, labels.split("\n"))))


def think_lines(raw: Column, labels: Column) -> Column:
    """``label: value`` lines of the think block, for manifest labels only.

    A line goes to the longest label it holds before a separator that was not found before, equal
    lengths in alphabetical order. Labels are found by one automaton for each list of labels.
    """
    inner = F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1)
    body = F.when(raw.rlike(r"(?s)<think>.*?</think>"), inner).otherwise(raw)

    @F.pandas_udf("string")
    def pick(lines: pd.Series, listed: pd.Series) -> pd.Series:
        made = (None if x is None or y is None else "\n".join(f"{label}: {value}" for label, value in labelled_lines(list(x), _listed(y))) for x, y in zip(lines, listed, strict=True))
        return pd.Series(list(made), dtype=object)

    return pick(tx.lines(body), F.array_join(labels, "\n"))  # one text, so that a list of labels is unpacked once and not for each row


def _pairs(lines: Column, make) -> Column:
    made = F.transform(lines, make)
    return F.filter(made, lambda p: p["label"].isNotNull()).cast(_PAIR)


def _pair(keep: Column, pos: Column, label: Column, value: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), F.when(keep, label).alias("label"), value.alias("value"))


def _plain(raw: Column) -> Column:
    def make(raw_line, i):
        line = tx.strip(raw_line)
        label = F.translate(F.lower(tx.strip(tx.before(line, ":"))), " ", "_")
        value = tx.strip(tx.after(line, ":"))
        return _pair(F.contains(line, F.lit(":")) & (label != "") & (value != ""), i, label, value)

    return _pairs(tx.lines(tx.strip(raw)), make)


def _without_think(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", "")


def _server(raw: Column) -> Column:
    def make(raw_line, i):
        line = tx.lstrip(tx.strip(raw_line), "- *")
        key = F.translate(F.lower(tx.strip(tx.before(line, ":"))), " ", "_")
        value = tx.strip(tx.after(line, ":"))
        keep = (
            F.contains(line, F.lit(":")) & ~line.startswith("#") & (key != "") & (value != "")
            & ~tx.starts_with_any(key, c.PROSE_PREFIXES) & (F.length(key) <= 50) & (F.size(F.split(key, "_")) <= 5)
        )
        return _pair(keep, i, key, value)

    return _pairs(tx.lines(tx.strip(_without_think(raw))), make)


def _audio(raw: Column) -> Column:
    def make(raw_line, i):
        line = tx.strip(raw_line)
        key, value = tx.strip(tx.before(line, ":")), tx.strip(tx.after(line, ":"))
        outside = key == "NOT_IN_MANIFEST"
        keep = (
            F.contains(line, F.lit(":")) & ~line.startswith("#") & (key != "") & (value != "")
            & (outside | (value != "NONE"))
        )
        return _pair(keep, i, F.when(outside, value).otherwise(key), F.when(outside, "NOT_IN_MANIFEST").otherwise(value))

    return _pairs(tx.lines(tx.strip(raw)), make)


def _display(raw: Column) -> Column:
    def make(raw_line, i):
        line = F.regexp_replace(tx.strip(raw_line), r"(?U)^[-*]\s*", "")
        label = tx.strip(tx.before(line, ":"))
        key, value = F.lower(label), tx.strip(tx.after(line, ":"))
        keep = (
            F.contains(line, F.lit(":")) & (key != "") & (value != "")
            & ~tx.starts_with_any(key, c.PROSE_PREFIXES) & (F.length(key) <= 50) & (F.size(F.split(key, "[_ ]")) <= 5)
        )
        return _pair(keep, i, label, value)

    kept = _pairs(F.split(_without_think(raw), "\n"), make)
    return F.transform(kept, lambda p, i: F.struct(i.alias("pos"), p["label"].alias("label"), p["value"].alias("value")))


_VARIANTS = {"plain": _plain, "server": _server, "audio": _audio, "display": _display}


def kv_pairs(raw: Column, variant: str = "server") -> Column:
    return _VARIANTS[variant](raw)


def parse_kv(outputs: DataFrame, variant: str = "server") -> DataFrame:
    """One row per ``label: value`` line: the other columns of ``outputs``, pos, label, value."""
    rest = [col for col in outputs.columns if col != "raw"]
    return outputs.select(*rest, F.inline(kv_pairs(F.col("raw"), variant)))


#: Labels and values that cleaning leaves as they are: most rows, which one match spares the steps.
_CLEAN_LABEL = r"(?s)^[A-Za-z0-9](?:.*[A-Za-z0-9])?\z"
_CLEAN_VALUE = r"""^(?:[A-Za-z](?:[^"'{}\[\]]*[A-Za-z0-9])?|[0-9]+(?:\.[0-9]+)?)\z"""


def clean_label(label: Column) -> Column:
    bare = tx.strip(tx.lstrip(tx.strip(label), "_"))
    return F.when(label.rlike(_CLEAN_LABEL), label).otherwise(tx.strip(F.regexp_replace(bare, r"(?U)^\[.*?\]\s*", "")))


def clean_value(value: Column) -> Column:
    """Cut leaked JSON, drop a trailing comma, strip the unit of a plain number."""
    cut = F.element_at(F.split(tx.strip(value), r"""(?<![0-9])["'{}\[\]]"""), 1)
    bare = tx.strip(F.rtrim(tx.strip(cut), F.lit(",")))
    return F.when(value.rlike(_CLEAN_VALUE), value).otherwise(F.regexp_replace(bare, r"(?Ud)^([0-9]+(?:\.[0-9]+)?)\s*[a-zA-Z%/]+$", "$1"))


def _says(value: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.lower(value), F.lit(p))
    return out


def with_entry(rows: DataFrame, entries: DataFrame, suffixes: bool) -> DataFrame:
    """Rows with the manifest ``entry`` of their type and label.

    ``suffixes``: else the first entry whose label ends in ``_label``, for keys
    that lost their start. Both tables go by (manifest_type, label), so a row
    carries a type and not a manifest.
    """
    key = ["manifest_type", "label"]
    if suffixes:  # one table for both, in which a whole label comes before an ending
        entries = stored(entries.select(*key, "entry").unionByName(suffix_entries(entries).join(entries, key, "left_anti").select(*key, "entry")))
    return rows.join(broadcast_small(entries, entries.count()), key, "left")


def accept(rows: DataFrame, entries: DataFrame, path: str = "audio") -> DataFrame:
    """Cleaned rows that pass the filters, with their manifest ``entry`` (null outside).

    ``rows``: doc_id, pos, label, value and manifest_type; ``entries``: see
    ``manifests.manifest_entries``.
    """
    if path == "audio":
        # as a generated row, so that the filters below read the cleaned texts and do not clean them again
        cleaned = F.struct(clean_label(F.col("label")).alias("label"), clean_value(F.col("value")).alias("value"))
        rows = rows.select(*[x for x in rows.columns if x not in ("label", "value")], F.inline(F.array(cleaned)))
        rows = rows.where((F.col("label") != "") & (F.col("value") != "") & ~_says(F.col("value"), AUDIO_NEGATIONS))
        rows = with_entry(rows, entries, True).withColumn("label", F.coalesce("entry.label", "label"))
        rows = rows.where(~F.lower("value").isin(*AUDIO_ABSENT))
    else:
        quoted = F.btrim(F.btrim("value", F.lit('"')), F.lit("'"))
        rows = rows.where(~F.col("label").startswith("#")).withColumn("value", quoted)
        rows = rows.where(~_says(F.col("value"), TEXT_NEGATIONS))
        rows = with_entry(rows, entries, False)
    bare = (F.lower(tx.strip(F.col("value"))) == "present") & F.coalesce(F.col("entry.value_type") == "Quantity", F.lit(False))
    return rows.where(~bare & (F.col("value") != ""))


def first_per_label(rows: DataFrame) -> DataFrame:
    """First accepted row of each label in a document; merges per task before the shuffle."""
    rest = [col for col in rows.columns if col not in ("doc_id", "label")]
    return rows.groupBy("doc_id", "label").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("doc_id", "label", "_r.*")


def clean_observations(rows: DataFrame, entries: DataFrame, path: str = "audio", labels: Column | None = None) -> DataFrame:
    """Accepted items with confidence and the outside-manifest flag.

    ``labels``: labels listed in the manifest text; by default those of the
    manifest itself.
    """
    kept = accept(rows, entries, path)
    if path == "audio":  # an accepted row has the label of its entry, so the entry need not ride through the sort
        kept = with_entry(first_per_label(kept.drop("entry")), entries, False)
    inside = F.col("entry").isNotNull()
    plain = F.translate(F.lower("label"), " ", "_")
    if labels is None:
        names = entries.select("manifest_type", F.col("label").alias("_plain"), F.lit(True).alias("_listed"))
        kept = kept.withColumn("_plain", plain).join(broadcast_small(names, entries.count()), ["manifest_type", "_plain"], "left")
        listed = F.coalesce("_listed", F.lit(False))
    else:
        listed = F.array_contains(labels, plain)
    out = kept.withColumns({
        "item_id": F.concat(F.lit("item_"), F.col("pos").cast("string")),
        "confidence": F.when(inside, CONFIDENCE[(path, True)]).otherwise(CONFIDENCE[(path, False)]),
        "not_in_manifest": (
            ~inside & ~listed if path == "audio" else F.lit(False)
        ),
    })
    return out.drop("manifest_type", "_plain", "_listed")


def display_items(data: DataFrame) -> DataFrame:
    """Items for display: the given ``items`` array, else the parsed raw output.

    ``data``: doc_id, items array<struct<label,value,human_readable>>, raw_model_output, raw_output.
    """
    given = F.transform("items", lambda it, i: F.struct(
        i.alias("pos"), it["label"].alias("label"), it["value"].alias("value"),
        F.when(F.coalesce(it["human_readable"], F.lit("")) != "", it["human_readable"]).otherwise(
            F.concat(it["label"], F.lit(": "), it["value"])).alias("human_readable"),
    ))
    non_empty = lambda col: F.when(F.col(col) != "", F.col(col))
    raw = F.coalesce(non_empty("raw_model_output"), non_empty("raw_output"), F.lit(""))
    parsed = F.transform(kv_pairs(raw, "display"), lambda p: F.struct(
        p["pos"].alias("pos"), p["label"].alias("label"), p["value"].alias("value"),
        F.concat(F.translate(p["label"], "_", " "), F.lit(": "), p["value"]).alias("human_readable"),
    ))
    chosen = F.when(F.col("items").isNotNull(), given).otherwise(parsed)
    return data.select("doc_id", F.inline(chosen)).withColumn(
        "item_id", F.concat(F.lit("item-"), F.col("pos").cast("string")))


def vital_signs(text: Column) -> Column:
    """Vital signs named in a text, first match of each pattern."""
    lower = tx.strip(F.lower(text))
    found = [
        F.when(lower.rlike("(?U)" + p), F.struct(
            F.lit(i).alias("ord"), F.lit(code).cast("bigint").alias("concept_id"), F.lit(label).alias("label"),
            F.regexp_extract(lower, "(?U)" + p, 1).cast("double").alias("value_num"), F.lit(units).alias("units"),
        ))
        for i, (p, code, label, units) in enumerate(c.VITAL_SIGNS)
    ]
    return F.array_compact(F.array(*found))


def synonyms(vocabulary: DataFrame) -> DataFrame:
    """Synonyms in dictionary order: position of the first mention, concept of the last one.

    ``vocabulary``: ord, ciel_id, name, datatype, synonyms, units, icd10.
    """
    words = vocabulary.select("ord", "ciel_id", "name", "datatype", "icd10", F.posexplode("synonyms").alias("syn_ord", "synonym"))
    place = F.struct("ord", "syn_ord")
    return words.withColumn("synonym", F.lower("synonym")).groupBy("synonym").agg(
        F.min(place).alias("place"),
        F.max_by(F.struct("ciel_id", "name", "datatype", "icd10"), place).alias("concept"),
    )


#: Characters of synonyms that one broadcast automaton holds, at under 100 bytes each.
PART_CHARS = 1_000_000


def _first_mention(words: Broadcast):
    """Kernel: the number of the first word, in the order given, that each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n, word in enumerate(words.value):
            automaton.add_word(word, n)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            found = [min((n for _, n in automaton.iter(text)), default=None) if len(automaton) and text else None for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["doc_id", "_text", "_n"])

    return run


def dictionary_parts(words: DataFrame, part_chars: int = PART_CHARS) -> list[list]:
    """Rows (synonym, concept) in dictionary order, cut into parts of bounded size; ``words`` is a written table."""
    total = words.agg(F.sum(F.length("synonym"))).first()[0] or 0
    n = -(-total // part_chars)
    edges = [None, *words.agg(F.percentile_approx("place.ord", [k / n for k in range(1, n)], 10_000)).first()[0], None] if n > 1 else [None, None]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        some = words
        if low is not None:
            some = some.where(F.col("place.ord") > low)
        if high is not None:
            some = some.where(F.col("place.ord") <= high)
        parts.append(some.select("synonym", "concept", "place"))
    return parts


def first_terms(texts: DataFrame, words: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id and concept: of the synonyms that a text holds the first in dictionary order.

    ``texts``: doc_id, _text. The dictionary is broadcast in parts of bounded size, in its order, as an automaton
    that reads each text once; a text that an earlier part has found is not read again. Nothing is shuffled.
    """
    ship(texts.sparkSession)
    context, found, left = texts.sparkSession.sparkContext, None, texts
    parts = dictionary_parts(words, part_chars)
    for k, part in enumerate(parts):
        rows = part.orderBy("place").collect()  # at most about ``part_chars`` characters
        automaton = context.broadcast([r.synonym for r in rows])
        concepts = texts.sparkSession.createDataFrame([(n, r.concept) for n, r in enumerate(rows)], T.StructType([T.StructField("_n", T.IntegerType()), words.schema["concept"]]))
        read = left.select("doc_id", "_text").mapInArrow(_first_mention(automaton), T.StructType([texts.schema["doc_id"], T.StructField("_text", T.StringType()), T.StructField("_n", T.IntegerType())]))
        if len(parts) > 1:
            read = stored(read)  # the next part reads what is left
        hits = read.join(F.broadcast(concepts), "_n").select("doc_id", "concept")
        found = hits if found is None else found.unionByName(hits)
        left = read.where("_n IS NULL")
    return found


def extract_rules(notes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Observations of free-text notes by rule, in order: vital signs, else one dictionary term (synonyms count as substrings)."""
    scanned = notes.select("doc_id", F.lower("text").alias("_text"), vital_signs(F.col("text")).alias("_vitals"))
    vitals = scanned.select("doc_id", F.inline("_vitals")).select(
        "doc_id", "ord", "concept_id", "label", F.lit("numeric").alias("datatype"), "value_num",
        F.lit(None).cast("boolean").alias("value_bool"), F.lit(None).cast("string").alias("icd10"),
        F.lit(None).cast("string").alias("certainty"), "units", F.lit(RULE_CONFIDENCE).alias("confidence"),
    )
    rest = scanned.where(F.size("_vitals") == 0).select("doc_id", tx.strip(F.col("_text")).alias("_text"))
    best = first_terms(rest, stored(synonyms(vocabulary).where(F.length("synonym") > 2))).withColumnRenamed("concept", "c")
    coded = F.coalesce(F.col("c.icd10"), F.lit("")) != ""
    terms = best.select(
        "doc_id", F.lit(0).alias("ord"), F.col("c.ciel_id").alias("concept_id"), F.col("c.name").alias("label"), F.col("c.datatype").alias("datatype"),
        F.lit(None).cast("double").alias("value_num"), F.when(~coded, F.lit(True)).alias("value_bool"),
        F.when(coded, F.col("c.icd10")).alias("icd10"), F.when(coded, "provisional").alias("certainty"),
        F.lit(None).cast("string").alias("units"), F.lit(SYNONYM_CONFIDENCE).alias("confidence"),
    )
    return vitals.unionByName(terms)


def embedded_json(text: Column, schema: str) -> Column:
    """The JSON object inside a text, from its first brace to its last; null if malformed."""
    return F.from_json(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), schema)


_RESPONSE = ("observations array<struct<concept_id:bigint,label:string,datatype:string,value:string,units:string,confidence:double>>, "
             "cds_alerts array<struct<type:string,message:string>>")


def parse_responses(responses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, observations, cds_alerts and fallback of model responses (doc_id, response, phrase).

    The JSON object inside a response counts, missing keys are empty lists; a value that is an object stays JSON text.
    Where there is no object or it is malformed, the observations are those that the rules find in the phrase.
    """
    inner = F.regexp_extract("response", r"(\{[\s\S]*\})", 1)
    read = stored(responses.select("doc_id", "phrase", F.when(F.try_parse_json(inner).isNotNull(), inner).alias("_json")))
    kinds = [f.dataType for f in T.StructType.fromDDL(_RESPONSE)]
    none = [F.array().cast(k) for k in kinds]
    body = F.from_json("_json", _RESPONSE)
    given = read.where(F.col("_json").isNotNull()).select("doc_id", body.alias("_b")).select(
        "doc_id", F.coalesce("_b.observations", none[0]).alias("observations"), F.coalesce("_b.cds_alerts", none[1]).alias("cds_alerts"), F.lit(False).alias("fallback"))
    rest = read.where(F.col("_json").isNull())
    coded = F.to_json(F.struct("icd10", "certainty"))
    value = F.when(F.col("value_num").isNotNull(), F.col("value_num").cast("string")).when(F.col("icd10").isNotNull(), coded).otherwise("true")
    found = extract_rules(rest.select("doc_id", F.col("phrase").alias("text")), vocabulary).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", F.struct("concept_id", "label", "datatype", value.alias("value"), "units", "confidence").alias("o")))).alias("_found"))
    ruled = rest.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce(F.transform("_found", lambda x: x["o"]).cast(kinds[0]), none[0]).alias("observations"), none[1].alias("cds_alerts"), F.lit(True).alias("fallback"))
    return given.unionByName(ruled)


def confidence_scores(clip_vectors: DataFrame, label_vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confidence of (clip_id, label) pairs: cosine of the mean vectors, mapped to 0..1."""
    clips = pool_embeddings(clip_vectors, "clip_id", renorm=False).select("clip_id", F.col("embedding").alias("a"))
    labels = pool_embeddings(label_vectors, "label", renorm=False).select("label", F.col("embedding").alias("b"))
    both = pairs.join(clips, "clip_id").join(labels, "label")
    size = F.greatest(vector_norm(F.col("a")), F.lit(1e-8)) * F.greatest(vector_norm(F.col("b")), F.lit(1e-8))
    cos = dot(F.col("a"), F.col("b")) / size
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))
    return both.select("clip_id", "label", F.round(score, 3).alias("confidence"))


def labelled_outputs(outputs: DataFrame, variant: str = "plain") -> DataFrame:
    """Text path: think-block lines of the manifest labels, parsed. Needs ``manifest_string``; its ``manifest_labels``,
    if there (``manifests.manifests``), are not read out of it again."""
    ship(outputs.sparkSession)
    listed = F.col("manifest_labels") if "manifest_labels" in outputs.columns else manifest_labels(F.col("manifest_string"))
    lines = think_lines(F.col("raw"), listed)
    return parse_kv(outputs.withColumn("raw", lines).drop("manifest_labels"), variant)
