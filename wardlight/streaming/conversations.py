"""Live conversations: keyed state over event lines.

One stateful pass per stream turns lines into typed rows; the views below are
plain filters and aggregates of those rows. Lines are put into sequence per
stream; repeated lines are ignored and early ones wait for their turn.

State is typed: a row with the place in the stream, a map of lines that came early, and lists of
section titles, used queries and merged hits. Timers end two waits. A stream that is silent for the idle time
gives up the lines it misses and goes on with those that came early. After the forget time all of its state
goes; an ended stream keeps nothing but its end marker until then.
"""

import json
import re
from bisect import insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import BLANKS
from ..operators import transcripts as tr
from ..session import scratch, ship, stored
from ..sources.sse import DONE, payload
from .tags import LiveSections, split_piece

OUTPUT = (
    "stream_id string, seq bigint, part int, turn int, kind string, ord int, title string, text string, "
    "score double, source string, uri string"
)
_COLUMNS = ["stream_id", "seq", "part", "turn", "kind", "ord", "title", "text", "score", "source", "uri"]
_PLACE = {"next": "bigint", "turn": "int", "mode": "string", "held": "string", "line": "string", "said": "string", "ended": "boolean",
          "step": "int", "stage": "string", "assessed": "boolean", "early": "int"}
_FRESH = (0, 0, "thinking", "", "", "", False, -1, "", False, 0)
_HIT = "order double, seq bigint, part int, score double, source string, title string, uri string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TAG, _ASSESSED = re.compile(r"<KB_QUERY>(.*?)</KB_QUERY>", re.S | re.I), re.compile(tr.ASSESSMENT)


class Live:
    """One stream: takes its lines in order and gives typed rows.

    Kinds: thinking, answer, section, turn_text, query, hit, done, error, end; evidence (the merged hits, after each
    change); and event: the sequence that a reader of the loop sees (title: turn_start, token, kb_query, done, error).
    Of the queries in a turn the first that was not used before runs; the loop stops at a turn without
    one, with an answer, at the last turn, or after as many queries as are allowed. If no assessment was written
    by then, one more turn follows. With ``kinds`` only rows of these are given; their numbers stay.
    """

    def __init__(self, place: tuple = _FRESH, titles=(), used=(), hits=(), kinds: frozenset[str] | None = None):
        for name, value in zip(_PLACE, place, strict=True):
            setattr(self, name, value)
        self.titles, self.used, self.hits, self.kinds = list(titles), list(used), list(hits), kinds
        self.rows: list[tuple] = []

    def place(self) -> tuple:
        return tuple(getattr(self, name) for name in _PLACE)

    def _emit(self, kind, ord=None, title=None, text=None, score=None, source=None, uri=None):
        if self.kinds is None or kind in self.kinds:
            self.rows.append((self.seq, self.part, self.turn, kind, ord, title, text, score, source, uri))
        self.part += 1

    def push(self, seq: int, text: str | None) -> None:
        """One line; None is a line without an event."""
        self.seq, self.part, self.next = seq, 0, seq + 1
        if text is None or self.ended:
            return
        if text == DONE:
            self._end_of_turn()
            if self.step >= 0 and self.stage != "over":
                self.stage = self.stage or f"last {self.step + 1}"
                self._over()
            self._emit("end")
            self.ended = True
            return
        try:
            event = json.loads(text)
        except ValueError:
            return
        if isinstance(event, dict):
            self._event(event)

    def _event(self, event: dict) -> None:
        kind = event.get("type")
        if kind == "turn_start":
            self._end_of_turn()
            self.turn, self.mode, self.step = int(event.get("turn") or 0), "thinking", self.step + 1
            self._seen("turn_start")
        elif kind == "token":
            self._token(event.get("text") or "")
        elif kind == "kb_query":
            self._emit("query", text=event.get("query"))
        elif kind == "kb_result":
            for n, hit in enumerate(event.get("hits") or []):
                self._emit("hit", ord=n, title=hit.get("title"), text=hit.get("content"), score=hit.get("score"), source=hit.get("source"), uri=hit.get("uri"))
                score = hit.get("score")
                insort(self.hits, (float("inf") if score is None else -float(score), self.seq, n, score, hit.get("source"), hit.get("title"), hit.get("uri")))
            if event.get("hits"):
                for rank, (_, _, _, score, source, title, uri) in enumerate(self.hits, 1):
                    self._emit("evidence", ord=rank, score=score, source=source, title=title, uri=uri)
        elif kind in ("done", "error"):
            self._emit(kind, text=event.get("message"))
            if kind == "error":
                self._seen("error", text=event.get("message"))
                self.stage = "over"

    def _token(self, piece: str) -> None:
        self.said += piece
        self._seen("token", text=piece)
        pieces, self.mode, self.held = split_piece(piece, self.mode, self.held)
        for mode, part in pieces:
            if mode == "kb_query":
                continue
            self._emit(mode, text=part)
            if mode == "answer":
                live = LiveSections(self.line, self.titles)
                for ord_, title, added in live.push(part):
                    self._emit("section", ord=ord_, title=title, text=added)
                self.line, self.titles = live.line, live.titles

    def _seen(self, title: str, **more) -> None:
        """An event of the loop, as long as it runs."""
        if self.stage != "over":
            self._emit("event", ord=self.step, title=title, **more)

    def _end_of_turn(self) -> None:
        if self.said:
            self._emit("turn_text", text=self.said)
            self.assessed = self.assessed or bool(_ASSESSED.search(self.said))
        if self.step >= 0 and self.stage == "":
            tags = [t.strip(BLANKS) for t in _TAG.findall(self.said)]
            asks = tags and tr.ANSWER not in self.said and self.step < tr.MAX_TURNS - 1 and len(self.used) < tr.MAX_QUERIES
            query = next((t for t in tags if t.lower() not in self.used), None) if asks else None
            if query is not None:
                self.used.append(query.lower())
                self._seen("kb_query", text=query)
            else:  # the loop ends here, or after one more turn for the assessment
                self.stage = f"last {self.step + 1}"
                if self.assessed:
                    self._over()
        elif self.stage.startswith("last"):
            self._over()
        self.said = ""

    def _over(self) -> None:
        turns = int(self.stage.split()[1])
        self._emit("event", ord=turns, title="done", text="\n".join(self.used))
        self.stage = "over"


class Conversation(StatefulProcessor):
    def __init__(self, idle_ms: int | None, forget_ms: int | None, kinds: frozenset[str] | None = None):
        self.idle_ms, self.forget_ms, self.kinds = idle_ms, forget_ms, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", ", ".join(f"{n} {t}" for n, t in _PLACE.items()))
        self.early = handle.getMapState("early", "seq bigint", "text string")
        self.titles = handle.getListState("titles", "title string")
        self.used = handle.getListState("used", "query string")
        self.hits = handle.getListState("hits", _HIT)

    def _load(self) -> Live:
        if not self.place.exists():
            return Live(kinds=self.kinds)
        place = tuple(self.place.get())
        if place[list(_PLACE).index("ended")]:
            return Live(place, kinds=self.kinds)
        return Live(place, [r[0] for r in self.titles.get()], [r[0] for r in self.used.get()], [tuple(r) for r in self.hits.get()], self.kinds)

    def _save(self, live: Live, before: tuple) -> None:
        """``before``: early lines, titles, used queries and hits in the state. What holds nothing is not touched, as each call leaves the worker."""
        self.place.update(live.place())
        if live.ended:
            for state, then in zip((self.early, self.titles, self.used, self.hits), before, strict=True):
                if then:
                    state.clear()
            return
        for state, now, then in zip((self.titles, self.used, self.hits), ([(t,) for t in live.titles], [(q,) for q in live.used], live.hits), before[1:], strict=True):
            if len(now) != then:
                state.put(now)

    def _rows(self, key: tuple, live: Live) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in live.rows], columns=_COLUMNS)

    def _clock(self, now_ms: int, wait_ms: int | None) -> None:
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now_ms + wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = self._load()
        sizes = live.early, len(live.titles), len(live.used), len(live.hits)
        came = {}
        for pdf in rows:
            for seq, text in zip(pdf["seq"], pdf["text"], strict=True):
                if seq >= live.next and not live.ended:
                    came.setdefault(int(seq), None if pd.isna(text) else text)
        waiting = live.early
        while not live.ended:
            if live.next in came:
                live.push(live.next, came.pop(live.next))
            elif waiting and self.early.containsKey((live.next,)):
                text = self.early.getValue((live.next,))[0]
                self.early.removeKey((live.next,))
                waiting -= 1
                live.push(live.next, text)
            else:
                break
        if not live.ended:
            for seq, text in came.items():
                waiting += not (waiting and self.early.containsKey((seq,)))
                self.early.updateValue((seq,), (text,))
        live.early = 0 if live.ended else waiting
        self._save(live, sizes)
        self._clock(timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0, self.forget_ms if live.ended else self.idle_ms)
        if live.rows:
            yield self._rows(key, live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Idle: lines that came early run, whatever is missing between them; a stream that has none is forgotten."""
        live = self._load()
        if live.ended or not live.early:
            for state in (self.place, self.early, self.titles, self.used, self.hits):
                state.clear()
            return
        sizes = live.early, len(live.titles), len(live.used), len(live.hits)
        for (seq,), (text,) in sorted((tuple(k), tuple(v)) for k, v in self.early.iterator()):
            live.push(seq, text)
        self.early.clear()
        live.early = 0
        self._save(live, sizes)
        self._clock(timerValues.getCurrentProcessingTimeInMs(), self.forget_ms)
        if live.rows:
            yield self._rows(key, live)

    def close(self) -> None:
        pass


def follow(lines: DataFrame, idle_minutes: float | None = 30, forget_minutes: float | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    """Typed rows of live streams from (stream_id, seq, line); ``seq`` counts every line from 0.

    A stream that stays silent for ``idle_minutes`` goes on without the lines it misses, one that then stays
    silent for ``forget_minutes`` (by default as long again) is forgotten. A run that
    must end once all input is read needs None: timers keep it waiting. The state lives in RocksDB, see ``run_to_table``.
    ``kinds``: those that the reader wants, all by default; other rows do not leave the Python worker.
    """
    ship(lines.sparkSession)
    texts = lines.select("stream_id", "seq", payload(F.col("line")).alias("text"))
    ms = lambda minutes: int(minutes * 60_000) if minutes else None
    processor = Conversation(ms(idle_minutes), ms(forget_minutes or idle_minutes), None if kinds is None else frozenset(kinds))
    return texts.groupBy("stream_id").transformWithStateInPandas(processor, OUTPUT, "append", "processingTime" if idle_minutes else "none")


def started(writer):
    """Start a stream whose state lives in RocksDB, which typed state needs; the session's setting stays."""
    conf, name = writer._spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, _ROCKS)
    try:
        return writer.start()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def run_to_table(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Process all lines that are there, exactly once, into ``out``."""
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    started(writer.outputMode("append").trigger(availableNow=True)).awaitTermination()


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    order = F.struct("seq", "part", "text")
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("text"))


def spoken(rows: DataFrame) -> DataFrame:
    """stream_id, kind (thinking / answer), text so far."""
    return _joined(rows.where(F.col("kind").isin("thinking", "answer")), "stream_id", "kind")


def final_texts(rows: DataFrame) -> DataFrame:
    """conv_id and raw: all model text of the streams that have reached their end."""
    over = rows.where(F.col("kind") == "end").select("stream_id").distinct()
    said = rows.where(F.col("kind") == "turn_text").join(over, "stream_id", "left_semi")
    return _joined(said, "stream_id").select(F.col("stream_id").alias("conv_id"), F.col("text").alias("raw"))


def live_sections(rows: DataFrame, full_texts: DataFrame | None = None) -> DataFrame:
    """stream_id, ord, title, icon, content.

    With the full texts of ended streams (conv_id as stream_id, raw), the final
    parse replaces the content of the sections it finds.
    """
    live = _joined(rows.where(F.col("kind") == "section"), "stream_id", "ord", "title")
    live = live.withColumn("icon", tr.icon_of(F.col("title"))).withColumnRenamed("text", "content")
    if full_texts is None:
        return live.select("stream_id", "ord", "title", "icon", "content")
    final = tr.sections(full_texts).select(
        F.col("conv_id").alias("stream_id"), F.lower("title").alias("_key"), F.col("content").alias("_final"))
    joined = live.withColumn("_key", F.lower("title")).join(final, ["stream_id", "_key"], "left")
    return joined.select("stream_id", "ord", "title", "icon", F.coalesce("_final", "content").alias("content"))


def turn_texts(rows: DataFrame) -> DataFrame:
    """Finished model turns as a transcript table: conv_id, turn, role, text."""
    done = rows.where(F.col("kind") == "turn_text")
    return done.select(F.col("stream_id").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.lit("assistant").alias("role"), "text")


def merged_evidence(rows: DataFrame) -> DataFrame:
    """Hits of a stream by score, best first; equal scores in arrival order."""
    order = Window.partitionBy("stream_id").orderBy(F.col("score").desc(), "seq", "part")
    hits = rows.where(F.col("kind") == "hit")
    return hits.withColumn("rank", F.row_number().over(order)).select("stream_id", "rank", "score", "source", "title", "uri")


def running_evidence(rows: DataFrame) -> DataFrame:
    """The merged hits of each stream as of its last line: the latest list that the stream has given."""
    lists = rows.where(F.col("kind") == "evidence")
    last = lists.groupBy("stream_id").agg(F.max("seq").alias("seq"))
    return lists.join(last, ["stream_id", "seq"], "left_semi").select("stream_id", F.col("ord").alias("rank"), "score", "source", "title", "uri")


_EVENT = ["stream_id", "seq", "part", "sub", "type", "step", "text", "query", "source", "score", "content"]


def event_rows(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The event sequence, in the order of seq, part, sub: each ``kb_query`` is followed by its ``kb_result``.

    ``results`` is a static table of top hits by query text (query, source, score, content); a query without one
    has the source ``none`` and score 0.
    """
    none = {"sub": F.lit(0), "query": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "content": F.lit(None).cast("string")}
    events = rows.where(F.col("kind") == "event").select("stream_id", "seq", "part", F.col("title").alias("type"), F.col("ord").alias("step"), "text").withColumns(none)
    top = results.groupBy(F.lower("query").alias("_q")).agg(F.max(F.struct("score", "source", "content")).alias("_top"))
    asked = events.where(F.col("type") == "kb_query").withColumn("_q", F.lower("text")).join(top, "_q", "left")
    answers = asked.withColumns({
        "sub": F.lit(1), "type": F.lit("kb_result"), "query": F.col("text"), "text": F.lit(None).cast("string"),
        "source": F.coalesce("_top.source", F.lit("none")), "score": F.coalesce("_top.score", F.lit(0.0)), "content": F.col("_top.content")})
    return events.select(*_EVENT).unionByName(answers.select(*_EVENT))


def enrich_events(results: DataFrame, out: str):
    """``foreachBatch`` function: the event rows of a micro-batch, in a folder of its own that a repeated batch overwrites.

    A micro-batch that is read twice runs its streams twice, so its events are written first.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            events = stored(batch.where(F.col("kind") == "event"))
            event_rows(events, results).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def run_events(rows: DataFrame, results: DataFrame, out: str, checkpoint: str) -> None:
    """Process all lines that are there into event rows below ``out``."""
    writer = rows.writeStream.foreachBatch(enrich_events(results, out)).option("checkpointLocation", checkpoint)
    started(writer.outputMode("append").trigger(availableNow=True)).awaitTermination()
