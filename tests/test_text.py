"""Literal cases for chunk, transcript, case and extraction expressions."""

import pytest
from pyspark.sql import functions as F

from wardlight.functions.numbers import one_decimal
from wardlight.operators import cases as ca
from wardlight.operators import chunks as ch
from wardlight.operators import fhir as fh
from wardlight.operators import manifests as ma
from wardlight.operators import observations as ob
from wardlight.operators import transcripts as tr
from wardlight.sources import records, sse


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_inline_metadata(spark):
    text = ('Give artesunate 2.4 mg/kg IV. title: Malaria > Severe content_type: recommendation '
            'headings: ["Malaria", "Severe"] is_current: True pdf_file: a.pdf retrieval_priority: 1.0')
    raw = spark.createDataFrame([("f1", "t", text, "kb://w/a.pdf/3#page-2", ["type:x"], "", {})],
                                "frame_id string, title string, snippet string, uri string, tags array<string>, track string, metadata map<string,string>")
    row = ch.normalize_chunks(raw, "S").first()
    assert row.content == "Give artesunate 2.4 mg/kg IV."
    assert (row.content_type, row.pdf_file, row.retrieval_priority, row.is_current) == ("recommendation", "a.pdf", 1.0, True)
    assert row.headings == ["Malaria", "Severe"] and row.uri == "kb://w/a.pdf/3"
    # characters of two units before the tail count once
    assert one(spark, "\U0001d4b3\U0001d4b3 dose title: t", lambda c: ch.split_inline_metadata(c)[0]) == "\U0001d4b3\U0001d4b3 dose"
    # an empty value takes the next field with it
    _, parts = ch.split_inline_metadata(F.lit("a title: t headings: uri: y"))
    assert spark.range(1).select(ch.inline_field(parts, "headings")).first()[0] == "uri: y"


@pytest.mark.parametrize("x,even,odd", [(0.25, "0.2", "0.3"), (0.35, "0.3", "0.3"), (0.75, "0.8", "0.8"), (38.0, "38.0", "38.0"), (-1.25, "-1.2", "-1.3"), (2.449, "2.4", "2.4")])
def test_one_decimal(spark, x, even, odd):
    assert one(spark, x, one_decimal, "double") == even == f"{x:.1f}"
    assert one(spark, x, lambda c: one_decimal(c, False), "double") == odd


@pytest.mark.parametrize("raw,expected", [
    ("Too short", []),
    ("plain text that is longer than twenty", [("Clinical Insight", "report", "plain text that is longer than twenty")]),
    ("## Clinical Assessment\nFirst occurrence.\n\n## CLINICAL ASSESSMENT\nDuplicate.", [("Clinical Assessment", "stethoscope", "First occurrence.")]),
    ("## Empty Section\n\n## Real Section\nActual content here.", [("Real Section", "report", "Actual content here.")]),
    ("<think>reasoning</think>\n## Clinical Assessment\nClean content.", [("Clinical Assessment", "stethoscope", "Clean content.")]),
])
def test_display_sections(spark, raw, expected):
    assert [tuple(s) for s in one(spark, raw, tr.section_array)] == expected


@pytest.mark.parametrize("raw,expected", [
    ("Weight: 63.2 kg", [("Weight", "63.2 kg")]),
    ("<think>model reasoning</think>\nWeight: 63.2 kg", [("Weight", "63.2 kg")]),
    ("Height: 170 cm\n<think>never closed", [("Height", "170 cm")]),
    ("- Weight: 63.2 kg\n* Height: 170 cm", [("Weight", "63.2 kg"), ("Height", "170 cm")]),
    ("note: something irrelevant\nWeight: 70 kg", [("Weight", "70 kg")]),
    ("x" * 51 + ": 1\na b c d e f: 1\n: no label\nno value:\nGood: value", [("Good", "value")]),
])
def test_display_pairs(spark, raw, expected):
    assert [(p.label, p.value) for p in one(spark, raw, lambda c: ob.kv_pairs(c, "display"))] == expected


@pytest.mark.parametrize("raw,expected", [("175cm", "175"), ('80h", "patient_id": "x"', "80"), ("38.5C", "38.5"), ('5"', '5"'), ("120/80", "120/80"), ("99,", "99")])
def test_clean_value(spark, raw, expected):
    assert one(spark, raw, ob.clean_value) == expected


@pytest.mark.parametrize("raw,expected", [("120/80", 12080.0), ("5-10", None), ("-", None), ("63.2 kg", 63.2)])
def test_numeric_value(spark, raw, expected):
    assert one(spark, raw, fh.numeric_value) == expected


def test_think_lines_take_the_longest_unused_label(spark):
    raw = "<think>- weight_kg: 70,\nbirth_weight_kg = 3\nweight_kg: 80 birth_weight_kg: 4\npulse: ,</think> pulse: 9"
    labels = F.array(F.lit("pulse"), F.lit("weight_kg"), F.lit("birth_weight_kg"))
    assert one(spark, raw, lambda c: ob.think_lines(c, labels)) == "weight_kg: 70\nbirth_weight_kg: 3"


def test_padded_code(spark):
    assert len(one(spark, "887", ma.padded_code)) == 35 and len(one(spark, "5088", ma.padded_code)) == 36


def test_case_text_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"uuid":"p1","person":{"gender":"M","age":38,"birthdate":"1986-08-19T00:00:00.000","attributes":['
        '{"attributeType":{"display":"Occupation"},"display":"Occupation = Farmer","value":"Farmer"}]},'
        '"identifiers":[{"identifier":"JIN-2024-017872","identifierType":{"display":"OpenMRS ID"}}]}\n')
    obs = ('{"concept":{"display":"%s","datatype":{"display":"%s"},"mappings":[{"conceptReferenceTerm":{"code":"%s","conceptSource":{"display":"CIEL"}}}]},"value":%s,"groupMembers":%s}')
    weight = obs % ("Weight (kg)", "Numeric", "5089", "63.2", "null")
    gone = obs % ("Weight (kg)", "Numeric", "5089", "null", "null")
    date = obs % ("Appointment Date", "Date", "1", '"2025-01-01T00:00:00"', "null")
    group = obs % ("Vitals", "N/A", "2", "null", "[" + (obs % ("Gestational age", "Numeric", "161439", "28", "null")) + "]")
    coded = obs % ("Diagnosis", "Coded", "3", '{"uuid":"u","display":"Depression (CIEL:1)"}', "null")
    (tmp_path / "e.json").write_text(
        '{"patient_uuid":"p1","uuid":"e2","encounterDatetime":"2024-08-18","encounterType":{"display":"Late"},"obs":[]}\n'
        '{"patient_uuid":"p1","uuid":"e1","encounterDatetime":"2024-08-17T10:00:00.000+0000","encounterType":{"display":"First"},'
        f'"location":{{"display":"Here"}},"obs":[{weight},{gone},{date},{group},{coded}]}}\n')
    patients = records.read_patients(spark, str(tmp_path / "p.json"))
    visits = records.earliest(records.read_encounters(spark, str(tmp_path / "e.json")), 50)
    row = ca.case_text(patients, visits).first()
    assert row.case_text.split("\n") == [
        "Age: 38.0", "Gender: M", "Birthdate: 1986-08-19", "OpenMRS ID: JIN-2024-017872", "Occupation: Farmer",
        "Visit: First", "Date: 2024-08-17T10:00:00", "Location: Here", "Weight (kg): 63.2 kg", "Appointment Date: 2025-01-01",
        "Gestational age: 28", "Diagnosis: Depression", "Visit: Late", "Date: 2024-08-18T00:00:00", "Location: Unknown"]
    assert (row.encounter_count, row.obs_count, row.groups_too_deep, row.encounters_left_out) == (2, 5, 0, 0)
    # what is left out is counted: a second encounter, and a group below the declared levels
    typed = lambda depth: spark.read.schema(records.schemas.encounters(depth)).json(str(tmp_path / "e.json"))
    flat = records.earliest(typed(1), 1)
    row = ca.case_text(patients, flat).first()
    assert (row.encounter_count, row.encounters_left_out, row.groups_too_deep) == (1, 1, 1)
    assert ca.declared_depth(flat) == 1 and ca.declared_depth(typed(4)) == 4
    assert ca.case_text(patients, records.earliest(typed(4), 50)).first().case_text == ca.case_text(patients, visits).first().case_text


def test_sse(spark):
    lines = [": heartbeat", "event: ping", 'data: {"type":"token","text":"A"}', "data: NOT_VALID_JSON", 'data: {"type":"token","text":"B"}', "data: [DONE]", 'data: {"type":"token","text":"late"}']
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream_id string, seq bigint, line string")
    assert [r.text for r in sse.decode_sse(df).orderBy("seq").collect()] == ["A", "B"]


@pytest.mark.parametrize("lines,labels,expected", [
    (["Weight: 70", "weight = 71"], ["weight"], [("weight", "70")]),
    (["- Blood Pressure (mean) : 90,"], ["mean", "pressure"], []),
    (["pulse rate: 80", "pulse rate: 81"], ["pulse", "pulse rate", "rate"], [("pulse rate", "80"), ("rate", "81")]),
    (["a.b: x", "axb: y"], ["a.b"], [("a.b", "x")]),  # a label is no pattern
    (["weight of weight: 5"], ["weight"], [("weight", "5")]),
    (["temp:", "temp: ,", "temp: 38"], ["temp"], [("temp", "38")]),
    (["İ weight: 3"], ["weight"], [("weight", "3")]),
    (["bb: 1 aa: 2"], ["aa", "bb"], [("aa", "2")]),
    (["x: 1"], [], []),
])
def test_labelled_lines(lines, labels, expected):
    assert ob.labelled_lines(lines, tuple(labels)) == expected


@pytest.mark.parametrize("part_chars", [1_000_000, 12])
def test_first_term_in_dictionary_order(spark, part_chars):
    """Also with a synonym that every note holds, overlapping ones, and a dictionary in many parts."""
    entries = [("fever", 3), ("ever", 1), ("malaria fever", 2), ("the", 9), ("cough", 4), ("ärger", 5)]
    words = spark.createDataFrame([(w, (n, 0), (n, w, "coded", None)) for w, n in entries],
                                  "synonym string, place struct<ord:bigint,syn_ord:int>, concept struct<ciel_id:bigint,name:string,datatype:string,icd10:string>")
    texts = ["the malaria fever", "cough and ärger", "nothing", "", None, "the cough"] + ["the end"] * 200
    notes = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, _text string").repartition(4)
    out = ob.first_terms(notes, words, part_chars)
    want = {k: min((n for w, n in entries if t and w in t), default=None) for k, t in enumerate(texts)}
    assert {r.doc_id: r.concept.ciel_id for r in out.collect()} == {k: n for k, n in want.items() if n is not None}
    if part_chars > 12:
        assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()


def _nested(levels, name="leaf"):
    """An observation inside ``levels`` groups."""
    obs = {"concept": {"display": name, "datatype": {"display": "Numeric"}, "mappings": [{"conceptReferenceTerm": {"code": "5089", "conceptSource": {"display": "CIEL"}}}]}, "value": 7}
    for k in range(levels):
        obs = {"concept": {"display": f"group {k}"}, "value": None, "groupMembers": [obs, {"concept": {"display": f"after {name} {k}"}, "value": {"display": "Yes"}}]}
    return obs


def test_observations_nest_to_any_depth(spark, tmp_path):
    """Read from JSON lines without a declared depth: all leaves, depth first, in order."""
    import json

    visits = [{"patient_uuid": "p", "uuid": "e1", "encounterDatetime": "2026-01-02T10:00:00", "obs": [_nested(7), _nested(0, "flat"), _nested(11, "deep")]},
              {"patient_uuid": "p", "uuid": "e2", "encounterDatetime": "2026-01-01", "obs": []}, {"patient_uuid": "q", "uuid": "e3", "encounterDatetime": None, "obs": None},
              {"patient_uuid": "q", "uuid": "e4", "encounterDatetime": None, "obs": [{"concept": {"display": "empty group"}, "value": "text", "groupMembers": []}]}]
    path = tmp_path / "visits.json"
    path.write_text("\n".join(map(json.dumps, visits)))
    read = records.read_encounters(spark, str(path))
    rows = {}
    for r in ca.flatten_obs(read).orderBy("encounter_uuid", "ord").collect():
        rows.setdefault(r.encounter_uuid, []).append(r)
    want = ["leaf", *[f"after leaf {k}" for k in range(7)], "flat", "deep", *[f"after deep {k}" for k in range(11)]]
    assert [r.name for r in rows["e1"]] == want and [r.ord for r in rows["e1"]] == list(range(len(want)))
    assert (rows["e1"][0].value, rows["e1"][0].code, rows["e1"][0].datatype, ca and rows["e1"][1].value) == ("7", "5089", "Numeric", '{"display":"Yes"}')
    assert [(r.name, r.value) for r in rows["e4"]] == [("empty group", "text")] and set(rows) == {"e1", "e4"}
    people = spark.createDataFrame([("p", "d", None, []), ("q", "d", None, [])], records.schemas.PATIENTS)
    cases = {r.patient_uuid: r for r in ca.case_text(people, records.earliest(read, 50)).collect()}
    assert "leaf: 7 kg" in cases["p"].case_text and "after deep 10: Yes" in cases["p"].case_text
    assert (cases["p"].obs_count, cases["p"].encounter_count, cases["p"].groups_too_deep) == (3, 2, 0)


def test_vocabulary_file_keeps_its_order(spark, tmp_path):
    import json

    from wardlight.sources.dictionaries import read_vocabulary

    concept = lambda n, **more: {"ciel_id": n, "name": f"c{n}", "datatype": "coded", "synonyms": [f"s{n}"], **more}
    doc = {"version": 1, "categories": {"vitals": {"concepts": [concept(3), concept(1, units="kg")]}, "alpha": {"concepts": [concept(2, synonyms=None, icd10="A1")]}, "none": {"concepts": []}}}
    (tmp_path / "v.json").write_text(json.dumps(doc, indent=2))
    rows = read_vocabulary(spark, str(tmp_path / "v.json")).orderBy("ord").collect()
    assert [(r.category, r.ciel_id, r.synonyms, r.units, r.icd10) for r in rows] == [
        ("vitals", 3, ["s3"], None, None), ("vitals", 1, ["s1"], "kg", None), ("alpha", 2, [], None, "A1")]
    assert ob.synonyms(read_vocabulary(spark, str(tmp_path / "v.json"))).count() == 2


@pytest.fixture(scope="module")
def tied_ages(spark, tmp_path_factory):
    """The smallest tables with ages half way between two tenths."""
    import shutil

    folder = tmp_path_factory.mktemp("ages")
    for name in ("orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder)
    ages = F.when(F.col("c_custkey") % 2 == 0, 9325.0).otherwise(-25.0)
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").withColumn("c_acctbal", ages).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def _same_as_sql(spark, folder, name):
    import duckdb
    from oracle_check import compare
    from wardlight.workload import registry

    con = duckdb.connect()
    for table, files in (("customer", "customer.parquet/*.parquet"), ("orders", "orders.parquet"), ("lineitem", "lineitem.parquet")):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{files}'")
    status, rows, *_, detail = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], folder)
    assert status == "match" and rows > 0, detail


def test_header_of_tied_ages_equals_sql(spark, tied_ages):
    _same_as_sql(spark, tied_ages, "p5_p6_header_and_attributes")


def test_case_text_of_tied_ages_equals_sql(spark, tied_ages):
    _same_as_sql(spark, tied_ages, "p7_p8_case_text")


def test_case_text_has_all_encounters(spark, tmp_path):
    """two patients have hundreds of encounters, many at the same time; some orders have no patient."""
    import shutil

    import duckdb
    from wardlight.workload import inputs, registry

    small, folder = "/root/testdata/sf0.001", str(tmp_path)
    shutil.copy(f"{small}/lineitem.parquet", folder)
    spark.read.parquet(f"{small}/customer.parquet").write.parquet(f"{folder}/customer.parquet")
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 11 <> 0 THEN o_custkey END::BIGINT AS o_custkey,
      date_trunc('quarter', o_orderdate)::TIMESTAMP AS o_orderdate) FROM '{small}/orders.parquet') TO '{folder}/orders.parquet'""")
    _same_as_sql(spark, folder, "p7_p8_case_text")
    rows = registry.QUERIES["p7_p8_case_text"](spark, folder).collect()
    given = spark.read.parquet(f"{folder}/orders.parquet").where("o_custkey IS NOT NULL").count()
    assert sum(r.encounter_count for r in rows) == given and {r.encounters_left_out for r in rows} == {0} and max(r.encounter_count for r in rows) > 300
    texts = ca.case_text(inputs.patients(spark, folder), inputs.encounters(spark, folder)).collect()
    assert all(r.case_text.count("\nVisit: ") == r.encounter_count for r in texts)


def test_labels_and_values_are_cleaned_once_and_clean_ones_stay(spark):
    """filters read the cleaned texts; the short way for clean texts changes none."""
    rows = spark.createDataFrame([(1, 0, "t", " _[x] temp ", "38.5 C,")], "doc_id long, pos int, manifest_type string, label string, value string")
    concepts, lists = ma.dictionary_tables(spark)
    entries = ma.manifest_entries(concepts, lists, spark.createDataFrame([], "code string, local_uuid string"))
    kept = ob.accept(rows, entries, "audio")
    assert [(r.label, r.value) for r in kept.collect()] == [("temp", "38.5")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-zA-Z%/]") == 1
    for raw, label, value in (("temp", "temp", "temp"), ("temp\n", "temp", "temp"), (" temp", "temp", "temp"), ("a [b] c", "a [b] c", "a"), ("38.5", "38.5", "38.5"),
                              ("38.5 mg", "38.5 mg", "38.5"), ("x\ny", "x\ny", "x\ny"), ("5'3", "5'3", "5'3"), ("a'b", "a'b", "a"), ("", "", ""), ("yes,", "yes,", "yes"), ("__k", "k", "__k")):
        assert (one(spark, raw, ob.clean_label), one(spark, raw, ob.clean_value)) == (label, value)


def test_manifest_labels_are_read_once_a_type(spark):
    """F16: the labels of a manifest come with it, and outputs need not read them out of its text."""
    concepts, lists = ma.dictionary_tables(spark)
    encounters = spark.createDataFrame([("e", "none"), ("f", lists.where("encounter_type_uuid IS NOT NULL").first()[0])], "encounter_uuid string, encounter_type_uuid string")
    out = ma.manifests(encounters, concepts, lists, spark.createDataFrame([], "code string, local_uuid string"))
    for own, again in out.select("manifest_labels", ma.manifest_labels(F.col("manifest_string"))).collect():
        assert own and own == again
    given = spark.createDataFrame([(1, "temp: 38\npain: yes", "CONCEPTS:\ntemp (C)", ["pain"])], "doc_id long, raw string, manifest_string string, manifest_labels array<string>")
    assert [(r.label, r.value) for r in ob.labelled_outputs(given).collect()] == [("pain", "yes")]
    assert [(r.label, r.value) for r in ob.labelled_outputs(given.drop("manifest_labels")).collect()] == [("temp", "38")]
