"""Live reading equals reading the whole text, however the stream is cut."""

import json
import re
import time
import uuid
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.session import shared_folder
from wardlight.sources import logs
from wardlight.sources.confirm import confirm_batches, write_confirmed
from wardlight.streaming import conversations as live
from wardlight.streaming.tags import LiveSections, split_piece

TEXT = "<think>a<b <<think> x</thinking>\n## One\ntext <i>\n## two\n\nmore</think><KB_query>q</kb_QUERY>\n## ONE\nend"


def read(pieces):
    mode, held, out, sections = "thinking", "", [], LiveSections()
    found = []
    for p in pieces:
        parts, mode, held = split_piece(p, mode, held)
        for m, t in parts:
            if m != "kb_query":
                out.append((m, t))
            if m == "answer":
                found += sections.push(t)
    merged = {m: "".join(t for k, t in out if k == m) for m in ("thinking", "answer")}
    bodies = {}
    for n, title, added in found:
        bodies[(n, title)] = bodies.get((n, title), "") + added
    return merged, bodies


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(TEXT)), max_size=40))
def test_any_cut_gives_the_same_result(cuts):
    at = sorted({0, len(TEXT), *cuts})
    assert read([TEXT[a:b] for a, b in zip(at, at[1:])]) == read([TEXT])


def test_modes_and_sections():
    merged, bodies = read([TEXT])
    assert merged["thinking"] == "a<b <<think> x"
    assert merged["answer"].startswith("\n## One") and "q\n## ONE" in merged["answer"]
    assert list(bodies) == [(0, "One"), (1, "two")]


def test_stream_with_late_and_repeated_lines(spark):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token = lambda t: "data: " + json.dumps({"type": "token", "text": t})
    lines = ['data: {"type": "turn_start", "turn": 1}', token("x</thi"), token("nk>## A\nbody"), "data: oops", token("\n## B\nend"), "data: [DONE]", token("late")]
    rows = [("s", i, x) for i, x in enumerate(lines)]
    first = [rows[0], rows[2], rows[2]]  # line 1 arrives in the second file
    for part in (first, [r for r in rows if r not in first] + [rows[0]]):
        spark.createDataFrame(part, "stream_id string, seq bigint, line string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("stream_id string, seq bigint, line string").parquet(f"{folder}/in")
        live.run_to_table(live.follow(stream, idle_minutes=None), f"{folder}/out", f"{folder}/state")
    out = spark.read.schema(live.OUTPUT).parquet(f"{folder}/out")
    assert {r.kind: r.text for r in live.spoken(out).collect()} == {"thinking": "x", "answer": "## A\nbody\n## B\nend"}
    assert [(r.title, r.content) for r in live.live_sections(out).orderBy("ord").collect()] == [("A", "body## B"), ("B", "end")]
    assert re.sub(r"\s", "", live.turn_texts(out).first().text).startswith("x</think>##A")


def feed(lines, live_=None):
    live_ = live_ or live.Live()
    for seq, text in lines:
        live_.push(seq, text)
    return live_


def turn(n, *texts):
    return [json.dumps({"type": "turn_start", "turn": n})] + [json.dumps({"type": "token", "text": t}) for t in texts]


def hit(score):
    return json.dumps({"type": "kb_result", "hits": [{"score": score, "title": f"t{score}", "source": "s"}]})


def events(rows):
    return [(r[5], r[6]) for r in rows if r[3] == "event"]


def test_events_use_the_first_unused_query():
    ask = lambda *q: "".join(f"<KB_QUERY> {x} </KB_QUERY>" for x in q)
    lines = turn(1, "a", ask("Malaria", "dose")) + turn(2, ask("malaria", "Dose")) + turn(3, ask("dose")) + turn(4, "## Alert Level") + turn(5, "not seen") + ["[DONE]"]
    got = events(feed(enumerate(lines)).rows)
    assert [e for e in got if e[0] != "token"] == [
        ("turn_start", None), ("kb_query", "Malaria"), ("turn_start", None), ("kb_query", "Dose"), ("turn_start", None), ("turn_start", None), ("done", "malaria\ndose")]
    assert ("token", "not seen") not in got


def test_events_end_with_an_answer_an_error_or_the_last_turn():
    assert events(feed(enumerate(turn(1, "## Clinical Assessment <KB_QUERY>q</KB_QUERY>") + turn(2, "x") + ["[DONE]"])).rows)[-1] == ("done", "")
    failed = feed(enumerate([*turn(1, "x"), '{"type": "error", "message": "gone"}', *turn(2, "y"), "[DONE]"]))
    assert events(failed.rows)[-1] == ("error", "gone")
    many = [x for n in range(7) for x in turn(n, f"<KB_QUERY>q{n}</KB_QUERY>")] + ["[DONE]"]
    got = events(feed(enumerate(many)).rows)
    assert [t for e, t in got if e == "kb_query"] == ["q0", "q1", "q2", "q3"] and got[-1][0] == "done"
    assert sum(e == "turn_start" for e, _ in got) == 6  # five turns and one for the missing assessment
    assert events(feed([(0, "[DONE]")]).rows) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=8), st.lists(st.integers(0, 12), max_size=5))
def test_merged_hits_do_not_depend_on_the_split(scores, cuts):
    lines = list(enumerate(turn(1, "x") + [hit(s) for s in scores]))
    at, rows, one = sorted({0, len(lines), *[c for c in cuts if c < len(lines)]}), [], live.Live()
    for a, b in zip(at, at[1:]):
        one = live.Live(one.place(), one.titles, one.used, one.hits)  # as it comes back from state
        rows += feed(lines[a:b], one).rows
    last = max(r[0] for r in rows if r[3] == "evidence")
    merged = [r[7] for r in rows if r[3] == "evidence" and r[0] == last]
    assert merged == sorted(scores, reverse=True)
    assert rows == feed(lines).rows


SCHEMA = "stream_id string, seq bigint, line string"


def _stream(spark, folder, parts, **more):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.run_to_table(live.follow(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), **more), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(live.OUTPUT).parquet(f"{folder}/out")


def test_any_split_into_batches_gives_the_rows_of_one(spark):
    lines = [f"data: {x}" for x in turn(1, "x</think>## A\nb", "<KB_QUERY>q</KB_QUERY>") + [hit(1.0), hit(3.0)] + turn(2, "## B\nc") + [hit(2.0)]] + ["data: [DONE]"]
    rows = [("s", i, x) for i, x in enumerate(lines)] + [("t", i, x) for i, x in enumerate(lines[:3])]
    whole, cut = (f"{shared_folder(spark)}/{uuid.uuid4().hex}" for _ in "ab")
    one = _stream(spark, whole, [rows], idle_minutes=None)
    many = _stream(spark, cut, [rows[5:8] + rows[:1], rows[1:3] + rows[6:9], rows[3:5] + rows[9:]], idle_minutes=None)
    drop = lambda df: sorted((tuple(r) for r in df.where("kind <> 'evidence'").collect()), key=str)
    assert drop(one) == drop(many)
    ranks = lambda df: sorted(map(tuple, df.collect()))
    assert ranks(live.running_evidence(one)) == ranks(live.running_evidence(many)) == ranks(live.merged_evidence(one))
    assert [r.raw for r in live.final_texts(many).collect()] == ["x</think>## A\nb<KB_QUERY>q</KB_QUERY>## B\nc"]
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{cut}/state")
    assert {r.key.stream_id for r in state("place").collect()} == {"s", "t"}
    for name in ("titles", "used", "hits"):  # the ended stream keeps its end marker only
        assert "s" not in {r.key.stream_id for r in state(name).collect()}
    assert state("early").count() == 0


def test_a_lost_line_is_given_up_and_a_silent_stream_forgotten(spark):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines = [f"data: {x}" for x in turn(1, "one ", "lost ", "three")]
    rows = [("s", i, x) for i, x in enumerate(lines) if i != 2]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    typed = live.follow(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), idle_minutes=0.03, forget_minutes=0.2)
    writer = typed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    query = live.started(writer.outputMode("append").trigger(processingTime="200 milliseconds"))
    try:
        said = ""
        for _ in range(60):
            time.sleep(0.5)
            if list(Path(folder, "out").glob("*.parquet")):
                said = "".join(r.text for r in spark.read.schema(live.OUTPUT).parquet(f"{folder}/out").where("kind = 'thinking'").orderBy("seq").collect())
                if said == "one three":
                    break
        assert said == "one three"
        # the sequence goes on behind what was given up: a line from before is late, the next one is not
        spark.createDataFrame([("s", 2, lines[2]), ("s", 4, lines[1])], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for _ in range(40):
            time.sleep(0.5)
            said = "".join(r.text for r in spark.read.schema(live.OUTPUT).parquet(f"{folder}/out").where("kind = 'thinking'").orderBy("seq").collect())
            if said == "one threeone ":
                break
        assert said == "one threeone "
        left = None
        for _ in range(60):
            time.sleep(0.5)
            left = spark.read.format("statestore").option("stateVarName", "place").load(f"{folder}/state").count()
            if not left:
                break
        assert left == 0
    finally:
        query.stop()


def test_events_of_a_batch_run_their_streams_once(spark):
    """a micro-batch is not worked out again for the answers to its queries."""
    count, folder = spark.sparkContext.accumulator(0), f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def seen(frames):
        for frame in frames:
            count.add(len(frame))
            yield frame

    batch = [("s", n, 0, 1, "event", 0, title, text, None, None, None) for n, (title, text) in enumerate([("token", "a"), ("kb_query", "Q"), ("done", "q")])]
    results = spark.createDataFrame([("q", "S", 1.5, "c")], "query string, source string, score double, content string")
    rows = spark.createDataFrame(batch, live.OUTPUT).mapInPandas(seen, live.OUTPUT)
    live.enrich_events(results, folder)(rows, 0)
    got = sorted((r.seq, r.sub, r.type, r.source, r.score) for r in spark.read.parquet(folder).collect())
    assert got == [(0, 0, "token", None, None), (1, 0, "kb_query", None, None), (1, 1, "kb_result", "S", 1.5), (2, 0, "done", None, None)]
    assert count.value == 3


def test_wanted_kinds_are_given_as_among_all(spark):
    lines = turn(1, "x</think>## A\nb", "<KB_QUERY>q</KB_QUERY>") + [hit(1.0)] + turn(2, "## B\nc") + ["[DONE]"]
    rows = [("s", i, f"data: {x}") for i, x in enumerate(lines)]
    whole, some = (_stream(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", [rows[:4], rows[4:]], idle_minutes=None, **more) for more in ({}, {"kinds": ["event", "section"]}))
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(some) == plain(whole.where("kind IN ('event', 'section')")) != []


def test_request_log_stream_drops_repeated_traces(spark):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    line = lambda trace, second, message="Request completed": (json.dumps({"ts": f"2026-01-01T00:00:{second:02d}.000Z", "level": "INFO", "service": "api", "message": message, "trace_id": trace, "method": "GET", "status": 200}),)
    for part in ([line("a", 1), line("b", 2), line("a", 3), line("c", 4, "KB search"), line(None, 5)], [line("b", 6), line("d", 7)]):
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
        logs.ingest_requests(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(r.trace_id for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b", "d"]


def test_confirmed_batches_can_be_repeated(spark):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = "encounter_uuid string, item_id string, label string, fhir_type string, fhir_payload string"
    items = spark.createDataFrame([("e", "i1", "temp", "Observation", "{\"a\": 1}"), ("e", "i2", "pain", "Condition", None)], schema)
    write = confirm_batches(folder)
    for batch, part in ((0, items), (1, items.limit(1)), (0, items)):
        write(part, batch)
    found = spark.read.parquet(f"{folder}/results")
    assert sorted((r.batch, r.item_id, r.status) for r in found.collect()) == [(0, "i1", "posted"), (0, "i2", "skipped"), (1, "i1", "posted")]
    assert spark.read.text(f"{folder}/resources").count() == 2


def test_items_are_worked_out_once_for_resources_and_status(spark):
    """the two tables of the sink come from one run over the items."""
    count = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def taken(name):
        count.add(1)
        return name != "i2"

    schema = "encounter_uuid string, item_id string, label string, fhir_type string, fhir_payload string"
    items = spark.createDataFrame([("e", f"i{n}", "temp", "Observation", '{"a": 1}') for n in range(4)], schema)
    out = write_confirmed(items, f"{shared_folder(spark)}/{uuid.uuid4().hex}", taken("item_id"))
    assert sorted((r.item_id, r.status) for r in out.collect()) == [("i0", "posted"), ("i1", "posted"), ("i2", "failed"), ("i3", "posted")]
    assert count.value == 4
