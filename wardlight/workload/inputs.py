"""Clinical inputs derived from the driver's tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import seeds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, spread over the cores if the file has fewer splits than that.

    Rule matching is heavy per row; a large table has many splits and stays as read.
    """
    df = table(spark, folder, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _seeded(df: DataFrame, key: str, rows, schema: str) -> DataFrame:
    """Join a short literal list by ``key % len(rows)``."""
    spark = df.sparkSession
    numbered = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    seed = spark.createDataFrame(numbered, "seed_no int, " + schema)
    return df.withColumn("seed_no", (F.col(key) % len(rows)).cast("int")).join(F.broadcast(seed), "seed_no").drop("seed_no")


def frame_id(doc_id) -> F.Column:
    g, m = F.floor(doc_id / 6).cast("string"), doc_id % 6
    page = F.concat(F.lit("f"), g, F.lit("#page-"), (m + 1).cast("string"))
    return F.when(m < 2, page).otherwise(F.concat(F.lit("f"), g, F.lit("-"), m.cast("string")))


def chunks_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw chunks: every document with a clinical seed, metadata tail, tags and a path."""
    d = _seeded(texts(spark, folder, "documents", "doc_id", "text"), "doc_id", seeds.CHUNKS,
                "title string, sentence string, type2 string, type1 string, pdf string")
    i = F.col("doc_id")
    rp = F.when(i % 31 == 30, "0.0").when(i % 7 == 0, "0.3").when(i % 7 == 1, "bad").otherwise("1.0")
    tail = F.when(i % 4 != 3, F.concat(
        F.lit(" title: "), "title", F.lit(" content_type: "), "type2",
        F.lit(' headings: ["'), "title", F.lit('", "Part"] is_current: '), F.when(i % 3 == 0, "False").otherwise("True"),
        F.lit(" pdf_file: "), "pdf", F.lit(" retrieval_priority: "), rp, F.lit(" source_url: "),
    )).otherwise("")
    line = F.when(i % 5 == 2, F.lit("\n  chunk_id: 77\ntitle: x")).otherwise("")
    snippet = F.concat("sentence", line, F.lit("\n"), "text", tail)
    tags = F.concat(
        F.array(F.concat(F.lit("type:"), "type2")),
        F.when(i % 8 != 7, F.array(F.concat(F.lit("pdf:"), "pdf"))).otherwise(F.array().cast("array<string>")),
        F.when(i % 29 == 28, F.array(F.lit("superseded"))).otherwise(F.array().cast("array<string>")),
    )
    filled = F.create_map(
        F.lit("content_type"), F.lit("etd"), F.lit("pdf_file"), F.lit("x.pdf"), F.lit("evidence_certainty"), F.lit("null"),
        F.lit("recommendation_strength"), F.lit("strong"), F.lit("headings"), F.lit("plain heading"))
    return d.select(
        "doc_id", frame_id(i).alias("frame_id"), "title", snippet.alias("snippet"),
        F.concat(F.lit("kb://guides/"), "pdf", F.lit("/"), i.cast("string"), F.when(i % 3 == 0, "#page-2").otherwise("")).alias("uri"),
        tags.alias("tags"), F.col("pdf").alias("track"),
        F.when(i % 11 == 5, filled).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def chunks_raw_v1(spark: SparkSession, folder: str) -> DataFrame:
    """First-generation chunks: type in the metadata map, metadata as lines of the text."""
    d = _seeded(texts(spark, folder, "documents", "doc_id", "text"), "doc_id", seeds.CHUNKS,
                "title string, sentence string, type2 string, type1 string, pdf string")
    i = F.col("doc_id")
    snippet = F.concat("sentence", F.when(i % 5 == 2, F.lit("\nhierarchy_level: 2")).otherwise(""), F.lit("\n"), "text")
    return d.select(
        "doc_id", frame_id(i).alias("frame_id"), "title", snippet.alias("snippet"),
        F.concat(F.lit("kb://guides/"), "pdf", F.lit("/"), i.cast("string"), F.when(i % 3 == 0, "#page-2").otherwise("")).alias("uri"),
        F.array().cast("array<string>").alias("tags"), F.col("pdf").alias("track"),
        F.when(i % 9 != 8, F.create_map(F.lit("content_type"), F.col("type1"))).otherwise(
            F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def chunks_secondary(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the secondary corpus: every web page behind a clinical seed."""
    d = _seeded(texts(spark, folder, "pages", "page_id", "html"), "page_id", seeds.CHUNKS,
                "title string, sentence string, type2 string, type1 string, pdf string")
    i = F.col("page_id").cast("string")
    return d.select(
        F.concat(F.lit("w"), i).alias("frame_id"), "title", F.concat("sentence", F.lit("\n"), "html").alias("snippet"),
        F.concat(F.lit("kb://wiki/"), "pdf", F.lit("/"), i).alias("uri"), F.array().cast("array<string>").alias("tags"),
        F.col("pdf").alias("track"), F.create_map(F.lit("content_type"), F.col("type1")).alias("metadata"))


def secondary_vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    p_ = table(spark, folder, "pages").select("page_id")
    return e.join(p_, e.vec_id == p_.page_id).select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("frame_id"), "embedding")


def requests_raw(spark: SparkSession, folder: str, profile: str = "v2") -> DataFrame:
    """A request per benchmark item: a clinical phrase, for each fourth one before the whole text.

    A few are blank, and many fields are left open.
    """
    b = _seeded(table(spark, folder, "benchmark"), "item_id", seeds.QUERIES, "phrase string")
    i = F.col("item_id")
    lexical = "lex" if profile == "v2" else "bm25"
    mode = F.when(i % 5 == 0, lexical).when(i % 5 == 1, "sem").when(i % 5 == 2, "RRF")
    out = b.select(
        i.alias("query_id"),
        F.when(i % 17 == 16, "  ").when(i % 4 < 3, F.col("phrase")).otherwise(F.concat("phrase", F.lit(" "), "text")).alias("query"),
        F.when(i % 3 == 0, (i % 4 + 3).cast("int")).alias("k"),
        mode.alias("search_mode"),
        (i % 2 == 0).alias("safe_top1_guardrail"),
        F.when(i % 10 == 9, 0.01).alias("threshold"),
    )
    if profile == "v2":
        return out
    out = out.withColumns({"strict_mode": F.col("query_id") % 7 == 6, "strict_cds_mode": F.col("query_id") % 4 == 3})
    if profile == "v1_federated":
        q = F.col("query_id")
        out = out.withColumns({
            "source_mode": F.when(q % 3 == 0, "who").when(q % 6 == 1, "wiki").otherwise("auto"),
            "who_first_policy": q % 4 < 2,
        })
    return out


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for every benchmark item but each thirteenth."""
    e = table(spark, folder, "embeddings")
    b = table(spark, folder, "benchmark").where(F.col("item_id") % 13 != 12)
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("query_id"), "embedding")


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    d = table(spark, folder, "documents").select("doc_id")
    return e.join(d, e.vec_id == d.doc_id).select(frame_id(F.col("vec_id")).alias("frame_id"), "embedding")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with tags and headings in front of every assistant turn."""
    c = table(spark, folder, "conversations").withColumn("_mix", F.floor(F.col("turn") / 2) + F.col("conv_id"))
    c = _seeded(c, "_mix", seeds.ASSISTANT, "opening string")
    return c.select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "assistant", F.concat("opening", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"),
    )


def evidence_results(spark: SparkSession, folder: str) -> DataFrame:
    """A top hit for two of three conversations, per turn."""
    c = table(spark, folder, "conversations").where(F.col("conv_id") % 3 < 2)
    return c.select(
        "conv_id", "turn", F.lit("WHO Guidelines").alias("source"),
        (F.col("turn") * 0.37 + (F.col("conv_id") % 7) * 0.05).alias("score"), F.col("text").alias("content"))


def _text(x):
    return F.lit(x).cast("string")


def _concept(name, datatype, code):
    mappings = F.when(code.isNotNull(), F.array(F.struct(F.struct(
        code.alias("code"), F.struct(F.lit("CIEL").alias("display")).alias("conceptSource")).alias("conceptReferenceTerm"))))
    return F.struct(name.alias("display"), F.struct(datatype.alias("display")).alias("datatype"), mappings.alias("mappings"))


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as encounters, line items as observations; every eighth item is a group of two."""
    li = table(spark, folder, "lineitem").withColumn("kind", (F.col("l_linenumber") + F.col("l_orderkey")) % 8)
    kind = F.col("kind")
    pick = lambda *xs: F.element_at(F.array(*[_text(x) if not hasattr(x, "alias") else x for x in xs]), kind.cast("int") + 1)
    name = pick("Weight (kg)", "Systolic blood pressure (CIEL:5085)", "Gestational age", "Height", "Appointment Date", "Diagnosis", "Exam", "Result")
    datatype = pick("Numeric", "Numeric", "Numeric", "Numeric", "Date", "Coded", "N/A", None)
    code = pick("5089", "5085", "161439", "5090", None, None, None, "1284")
    value = pick(
        F.col("l_quantity").cast("string"), (F.floor("l_extendedprice") % 200).cast("string"), "28", None,
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), '{"uuid": "u", "display": "Malaria (CIEL:116128)"}', None, "Malaria, confirmed")
    member = lambda n, t, c, v_: F.struct(_concept(_text(n), _text(t), _text(c)).alias("concept"), v_.alias("value"),
                                          F.lit(None).cast("array<struct<uuid:string>>").alias("groupMembers"))
    group = F.when(kind == 6, F.array(
        member("Height (cm)", "Numeric", "5090", F.col("l_linenumber").cast("string")), member("Flag", "Text", None, F.col("l_returnflag"))))
    obs = F.struct(_concept(name, datatype, code).alias("concept"), value.alias("value"), group.alias("groupMembers"))
    visits = li.groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", obs.alias("o")))), lambda x: x["o"]).alias("obs"))
    o = table(spark, folder, "orders").join(visits, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_uuid"),
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("uuid"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(stamp, F.lit(".000+0000"))).when(
            F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(stamp).alias("encounterDatetime"),
        F.struct(F.col("o_orderpriority").alias("display")).alias("encounterType"),
        F.when(F.col("o_orderstatus") != "P", F.struct(F.concat(F.lit("Clinic "), "o_orderstatus").alias("display"))).alias("location"),
        "obs")


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as patients."""
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    attribute = lambda t, d, v_: F.struct(F.struct(_text(t).alias("display")).alias("attributeType"), d.alias("display"), v_.alias("value"))
    segment = F.col("c_mktsegment")
    attributes = F.array(
        attribute("Occupation", F.concat(F.lit("Occupation = "), segment), segment),
        attribute("Civil Status", _text(None), F.lit('{"display": "Married (CIEL:1057)"}')),
        attribute("Empty", F.lit("  "), F.lit("x")))
    identifier = lambda t, v_: F.struct(v_.alias("identifier"), F.struct(_text(t).alias("display")).alias("identifierType"))
    ids = F.when(k % 4 == 3, F.array(identifier("Old ID", F.col("c_name")))).when(k % 4 < 2, F.array(
        identifier("Old ID", _text("old")), identifier("OpenMRS ID", F.col("c_name"))))
    person = F.struct(
        F.when(k % 3 == 0, "M").when(k % 3 == 1, "Female").alias("gender"),
        F.when(k % 5 != 4, F.col("c_acctbal") / 100).alias("age"),
        F.when(k % 7 != 6, F.lit("1986-08-19T00:00:00.000")).alias("birthdate"), attributes.alias("attributes"))
    return c.select(F.concat(F.lit("p"), k.cast("string")).alias("uuid"), person.alias("person"), ids.alias("identifiers"))


def encounters_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as encounters of the known types and one unknown type."""
    from ..rules.concepts import ENCOUNTER_CONCEPTS

    o = table(spark, folder, "orders")
    types = [*ENCOUNTER_CONCEPTS, "unknown-type"]
    return o.select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("encounter_uuid"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient_uuid"),
        F.element_at(F.array(*map(F.lit, types)), (F.col("o_orderkey") % 8).cast("int") + 1).alias("encounter_type_uuid"),
        F.col("o_orderkey").alias("doc_id"))


def concept_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Local ids for two thirds of the dictionary and for codes outside it."""
    from ..rules.concepts import CONCEPTS

    codes = F.array(*[F.lit(c[0]) for c in CONCEPTS])
    n = F.col("p_partkey") % 30
    return table(spark, folder, "part").where(n % 3 < 2).select(
        F.when(F.col("p_partkey") % 2 == 0, F.element_at(codes, n.cast("int") + 1)).otherwise(F.concat(F.lit("9"), "p_partkey")).alias("code"),
        F.concat(F.lit("loc-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("local_uuid"))


def observation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as observation lines: doc_id, pos (from 0), label, value.

    Keys are shuffled and put in order once; the seeds, which follow from the keys, join the numbered lines.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, folder, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).alias("pos"), (F.col("l_linenumber") * 5 + F.col("l_orderkey")).alias("_k"))
    seeded = _seeded(li, "_k", seeds.OBSERVATIONS, "label string, value string")
    return seeded.select(F.col("l_orderkey").alias("doc_id"), "pos", "label", "value")


def model_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """One model output per order: its observation lines as text, after a think block."""
    lines = observation_lines(spark, folder).withColumn("line", F.concat("label", F.lit(": "), "value"))
    text = lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("lines"))
    head = F.when(F.col("doc_id") % 3 == 0, "<think>weighing it</think>\n- ").when(F.col("doc_id") % 3 == 1, "Note: check\n* ").otherwise("")
    tail = F.when(F.col("doc_id") % 5 == 0, "\nNOT_IN_MANIFEST: oedema\npallor: NONE\n# done: yes").when(
        F.col("doc_id") % 5 == 1, "\n<think>cut: off").otherwise("")
    return text.select("doc_id", F.concat(head, "lines", tail).alias("raw"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as dictionary concepts; synonyms are word pieces that occur in the notes."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("ord"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("category"), (k + 100000).alias("ciel_id"),
        F.concat(F.lit("Concept "), k.cast("string")).alias("name"), F.lit("coded").alias("datatype"),
        F.array(F.concat(F.substring(F.lit("The and ing ion ent der die und que los las"), (k % 38).cast("int") + 1, F.lit(4)), F.lit("")),
                F.concat(F.lit("x"), (k % 40).cast("string"))).alias("synonyms"),
        F.lit(None).cast("string").alias("units"), F.when(k % 2 == 0, F.concat(F.lit("A"), k.cast("string"))).alias("icd10"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as notes; every third one starts with vital signs."""
    c = table(spark, folder, "conversations").where(F.col("role") == "user")
    vitals = F.concat(F.lit("Temp 38.5, BP 120 over "), (F.col("turn") + 70).cast("string"), F.lit(" spo2 97 RR 22 "))
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(vitals, "text")).otherwise(F.col("text")).alias("text"))


def sse_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as token streams, one stream per conversation.

    Each turn is announced, its text is sent in pieces of seven characters, and
    the stream ends with the end mark and a stray token after it.
    """
    t = transcripts(spark, folder).where(F.col("role") == "assistant")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7).cast("int")), lambda i: F.substring(F.col("text"), i * 7 + 1, F.lit(7)))
    token = lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("token").alias("type"), p.alias("text"))))
    start = F.concat(F.lit('data: {"type": "turn_start", "turn": '), F.col("turn").cast("string"), F.lit("}"))
    hit = F.concat(F.lit('data: {"type": "kb_result", "hits": [{"title": "t'), F.col("turn").cast("string"),
                   F.lit('", "score": '), (F.col("turn") * 0.5).cast("string"), F.lit(', "source": "s", "uri": "u", "content": "c"}]}'))
    per_turn = t.select("conv_id", "turn", F.concat(
        F.array(start, F.lit(": heartbeat"), F.lit("event: ping"), F.lit("data: NOT_VALID_JSON")), F.transform(pieces, token), F.array(hit)).alias("ls"))
    end = F.array(F.lit("data: [DONE]"), F.lit('data: {"type": "token", "text": "late"}'))
    streams = per_turn.groupBy("conv_id").agg(F.concat(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "ls"))), lambda x: x["ls"])), end).alias("ls"))
    return streams.select(F.col("conv_id").cast("string").alias("stream_id"), F.posexplode("ls").alias("seq", "line")).select(
        "stream_id", F.col("seq").cast("bigint").alias("seq"), "line")


def query_results(spark: SparkSession, folder: str) -> DataFrame:
    """A top hit for two of three query texts."""
    from ..operators.transcripts import tag_rows

    n = F.length("query")
    asked = tag_rows(transcripts(spark, folder)).select(F.lower("query").alias("query")).distinct().where(n % 3 != 0)
    return asked.select("query", F.lit("WHO Guidelines").alias("source"), (n * 0.25).alias("score"), F.concat(F.lit("about "), "query").alias("content"))


def service_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as service log lines in JSON: searches, answers, finished requests; a few malformed."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    message = F.when(i % 3 == 0, "KB search").when(i % 3 == 1, "KB response").otherwise("Request completed")
    row = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.lit("INFO").alias("level"), F.col("event_type").alias("service"),
        message.alias("message"), F.when(i % 3 == 1, (i % 6).cast("int")).alias("n_hits"), F.when(i % 3 == 1, i % 5 == 0).alias("top1_swapped"),
        F.when(i % 3 == 1, F.col("value")).alias("latency_ms"), F.when(i % 3 == 2, F.concat(F.lit("t"), (i % 1000).cast("string"))).alias("trace_id"),
        F.when(i % 3 == 2, F.lit("GET")).alias("method"), F.when(i % 3 == 2, (F.lit(200) + i % 2).cast("int")).alias("status")))
    return e.select(F.when(i % 50 == 49, F.lit("{broken")).otherwise(row).alias("value"))


def audio_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploads: half of them behind a WAVE header with varying format."""
    i = F.col("doc_id")
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    channels = F.concat(byte(F.when(i % 8 == 2, 2).otherwise(1)), F.lit("00"))
    rate = F.when(i % 8 == 4, "44AC0000").otherwise("803E0000")
    bits = F.concat(byte(F.when(i % 8 == 6, 8).otherwise(16)), F.lit("00"))
    header = F.unhex(F.concat(
        F.lit("524946460000000057415645666D7420100000000100"), channels, rate, F.lit("000000000000"), bits, F.lit("6461746100000000")))
    return table(spark, folder, "documents").select(
        "doc_id", F.when(i % 2 == 0, F.concat(header, F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8")).alias("content"))
