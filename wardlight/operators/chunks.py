"""Chunk normalisation: raw index frames to clean, typed chunks (map-only)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..rules import RulePack, V2
from ..rules import vocabulary as v

_MARK, _SEP = "\u0001", "\u0002"
_BOUNDARY = " (" + "|".join(v.INLINE_FIELDS) + "): "
#: The colon of the same boundary: the search stops at colons, which are rarer than blanks.
_BOUNDARY_COLON = ":(?<= (?:" + "|".join(v.INLINE_FIELDS) + "):) "


def split_inline_metadata(snippet: Column) -> tuple[Column, Column]:
    """(content, field parts) of a snippet with an optional metadata tail.

    The tail starts at the first `` <field>: `` of a known field; each value
    runs to the next one.  A part is ``field␂value``.
    """
    def cut(parts):
        """Content and tail around the first boundary, which is searched once; lengths count characters, also those of two units."""
        field = F.substring_index(parts[0], " ", -1)
        tail = F.concat(F.lit(" "), tx.strip(F.concat(field, F.lit(": "), F.try_element_at(parts, F.lit(2)))))
        before = tx.strip(F.substring(parts[0], F.lit(1), F.length(parts[0]) - F.length(field) - 1))
        return F.struct(F.when(F.size(parts) > 1, before).otherwise(snippet).alias("content"), F.when(F.size(parts) > 1, tail).alias("tail"))

    found = tx.let(F.split(snippet, _BOUNDARY_COLON, 2), cut)
    content, tail = found["content"], found["tail"]
    marked = F.regexp_replace(tail, _BOUNDARY, f"{_MARK}$1{_SEP}")
    return content, F.split(marked, _MARK)


def inline_field(parts: Column, field: str) -> Column:
    """Value of a field; the last one wins, null if absent."""
    own = F.filter(parts, lambda p: F.startswith(p, F.lit(field + _SEP)))
    return tx.strip(F.substring(F.try_element_at(own, F.lit(-1)), len(field) + 2, 1 << 30))


def tag_value(tags: Column, prefix: str) -> Column:
    own = F.filter(tags, lambda t: F.startswith(t, F.lit(prefix)))
    return F.substring(F.try_element_at(own, F.lit(-1)), len(prefix) + 1, 1 << 30)


def drop_metadata_lines(content: Column, prefixes) -> Column:
    """Remove whole lines that start with a metadata prefix, then trim."""
    spaced = "|".join(tx.quote(p) + r"(?=[^\n]*\S)" for p in prefixes if p.endswith(" "))
    plain = "|".join(tx.quote(p) for p in prefixes if not p.endswith(" "))
    line = rf"^[^\S\n]*(?:{spaced}|{plain})[^\n]*(?:\n|\z)"
    return tx.strip(tx.replace(content, line, "", extra="m"))


def clean_uri(uri: Column) -> Column:
    return F.when(F.contains(uri, F.lit("#page-")), tx.before(uri, "#")).otherwise(uri)


def file_of_uri(uri: Column) -> Column:
    parts = F.split(uri, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def parse_headings(raw: Column) -> Column:
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
    none = F.array().cast("array<string>")
    return F.when(raw.isNull() | (raw == ""), none).otherwise(F.coalesce(listed, F.array(raw)))


def priority(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("double"), F.lit(1.0))


def current(raw: Column) -> Column:
    return F.coalesce(~F.lower(raw).isin("false", "0", "no"), F.lit(True))


def nullable(raw: Column) -> Column:
    return F.when(~F.lower(raw).isin("null", "none", ""), raw)


def with_metadata(raw: DataFrame) -> DataFrame:
    """Add ``body`` and ``meta`` (a struct of the known fields).

    A filled metadata map replaces the inline tail; tags and track fill the
    gaps of either when no file name is given.
    """
    fields = [
        "content_type", "retrieval_priority", "is_current", "headings", "doc_type",
        "recommendation_strength", "evidence_certainty", "source_url", "pdf_file",
    ]
    content, parts = split_inline_metadata(F.col("snippet"))
    split_rows = raw.withColumns({"body": content, "_parts": parts})
    has_map = F.coalesce(F.size("metadata") > 0, F.lit(False))
    meta = {
        f: F.when(has_map, F.try_element_at("metadata", F.lit(f))).otherwise(
            inline_field(F.col("_parts"), f) if f in v.INLINE_FIELDS else F.lit(None).cast("string")
        )
        for f in fields
    }
    found = split_rows.withColumn("_own", F.struct(*[c.alias(f) for f, c in meta.items()]))
    superseded = F.coalesce(F.array_contains("tags", "superseded"), F.lit(False))
    tag_file = tag_value(F.col("tags"), "pdf:")
    fallback = {
        "content_type": tag_value(F.col("tags"), "type:"),
        "pdf_file": F.when(F.coalesce(tag_file, F.lit("")) != "", tag_file)
        .when(F.coalesce(F.col("track"), F.lit("")) != "", F.col("track"))
        .otherwise(tag_file),
        "retrieval_priority": F.when(superseded, "0.0"),
        "is_current": F.when(superseded, "False"),
    }
    no_file = F.coalesce(F.col("_own.pdf_file"), F.lit("")) == ""
    merged = [
        (F.coalesce(F.col(f"_own.{f}"), F.when(no_file, fallback[f])) if f in fallback else F.col(f"_own.{f}")).alias(f)
        for f in fields
    ]
    return found.withColumn("meta", F.struct(*merged)).drop("_own", "_parts")


#: First character of the key of a chunk without a frame_id.
NAMELESS = "~"


def chunk_key() -> Column:
    """The frame_id, or a hash of place, title and text where there is none, so that nameless chunks stay apart."""
    own = F.concat(F.lit(NAMELESS), F.sha1(F.concat_ws("\0", "uri", "title", "snippet")))
    return F.when(F.coalesce("frame_id", F.lit("")) == "", own).otherwise(F.col("frame_id"))


def normalize_chunks(raw: DataFrame, source: str, pack: RulePack = V2) -> DataFrame:
    """Clean, typed chunks with their whole content; a request cuts it (``plans.search.with_chunks``).

    Chunks whose content is empty after cleaning stay: a search may fetch them,
    and leaves them out of its pool then (v2 only).
    """
    kept = raw.where(F.coalesce(F.col("snippet"), F.lit("")) != "").withColumn("chunk_id", chunk_key())
    if pack.metadata_priority:
        rows = with_metadata(kept).withColumn("body", drop_metadata_lines(F.col("body"), pack.metadata_lines))
        meta = lambda f: F.col(f"meta.{f}")
        file_name = F.coalesce(meta("pdf_file"), F.lit(""))
    else:
        rows = kept.withColumn("body", drop_metadata_lines(F.col("snippet"), pack.metadata_lines))
        meta = lambda f: F.try_element_at("metadata", F.lit(f))
        file_name = file_of_uri(clean_uri(F.col("uri")))
    return rows.select(
        "chunk_id",
        F.coalesce("frame_id", F.lit("")).alias("frame_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.col("body").alias("content"),
        F.lit(source).alias("source"),
        clean_uri(F.coalesce("uri", F.lit(""))).alias("uri"),
        F.coalesce(meta("content_type"), F.lit(pack.default_type)).alias("content_type"),
        priority(meta("retrieval_priority")).alias("retrieval_priority"),
        current(meta("is_current")).alias("is_current"),
        parse_headings(meta("headings")).alias("headings"),
        F.coalesce(meta("doc_type"), F.lit("")).alias("doc_type"),
        nullable(meta("recommendation_strength")).alias("recommendation_strength"),
        nullable(meta("evidence_certainty")).alias("evidence_certainty"),
        F.coalesce(meta("source_url"), F.lit("")).alias("source_url"),
        F.coalesce(file_name, F.lit("")).alias("pdf_file"),
    )


# fixed values: dose spans set in bold
DOSE_SPAN = (
    r"(\d[\d.,/×³–-]*\s*(?:mg/kg(?:/day|/dose|/dose/day)?|mg|g/dL|g/L|mmol/L|μmol/L|mL"
    r"|IU/(?:mL|kg)|IU|g|%|/μL|mmHg|bpm|°C|weeks?|days?|months?|hours?|h|q\d+h"
    r"|times?\s+daily|times?\s+a\s+day))"
)


def display_segments(chunks: DataFrame) -> DataFrame:
    """Readable pieces of a chunk: bullets, and prose in paragraphs of three sentences.

    One row per piece: frame_id, ord, kind, text, doses.
    """
    content = F.col("content")
    tail = F.regexp_instr(content, F.lit(r"(?U)\btitle:\s"))
    body = F.when(tail > 1, F.substring(content, F.lit(1), tail - 1)).otherwise(content)
    plain = tx.replace(tx.strip(body), r"\s*\(\d{1,4}\)\s*", " ")
    plain = tx.strip(tx.replace(plain, r"\s{2,}", " "))
    parts = (
        chunks.select("frame_id", plain.alias("_plain"))
        .select("frame_id", "_plain", F.posexplode(F.split("_plain", r"(?U)(?:\.\s+-\s+|(?:^|\n)\s*-\s+)")).alias("_i", "_part"))
        .withColumn("_part", tx.strip(F.col("_part")))
        .where(F.col("_part") != "")
        .withColumn("kind", F.when((F.col("_i") > 0) | F.col("_plain").startswith("- "), "bullet").otherwise("prose"))
    )
    sentences = F.split("_part", r"(?U)(?<=[.!?])\s+(?=[A-Z])")
    triples = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(sentences) / 3).cast("int") - 1),
        lambda g: tx.strip(F.array_join(F.slice(sentences, g * 3 + 1, F.lit(3)), " ")),
    )
    pieces = F.when(F.col("kind") == "prose", triples).otherwise(F.array("_part"))
    return (
        parts.select("frame_id", "_i", "kind", F.posexplode(pieces).alias("_j", "text"))
        .where(F.col("text") != "")
        .select(
            "frame_id",
            F.struct(F.col("_i").alias("segment"), F.col("_j").alias("paragraph")).alias("ord"),
            "kind",
            "text",
            tx.all_groups(F.col("text"), DOSE_SPAN, 1, ignore_case=True).alias("doses"),
        )
    )
