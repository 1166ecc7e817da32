"""Page transitions and document progress on a stream of changes, in order of event time.

Changes may arrive out of order by up to the watermark's delay. Each waits in the list state of its
key's bucket until the watermark has passed it; a timer then releases what has become due, in order of ``seq``.
Changes behind the watermark are dropped and counted by the query (``sinks.late_rows``). A row of
kind ``heartbeat`` moves the watermark on and has no outcome.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lettermill.streaming.sinks import use_keyed_state

# The state each kind of change leads to, and the states it may start from.
TARGET = {"ocr": "OCR_DONE", "capped": "CAPPED", "translated": "TRANSLATED", "audio": "AUDIO_DONE",
          "indexed": "INDEXED", "failed": "FAILED", "edited": "OCR_DONE"}
ALLOWED_FROM = {
    "ocr": ("PENDING",), "capped": ("PENDING",), "translated": ("OCR_DONE",), "audio": ("TRANSLATED",),
    "indexed": ("AUDIO_DONE",), "failed": ("PENDING", "OCR_DONE", "TRANSLATED", "AUDIO_DONE", "FAILED"),
    "edited": ("OCR_DONE", "TRANSLATED", "AUDIO_DONE", "INDEXED", "FAILED", "CAPPED"),
}
TERMINAL = ("PARTIAL", "COMPLETE")
HEARTBEAT = "heartbeat"
#: Groups of keys that share one state, and rows of one value of it. The number of buckets can't change within a checkpoint.
BUCKETS, PACKED_ROWS = 256, 10_000

PAGE_OUTPUT = "document_id bigint, page_no int, seq bigint, kind string, status string, accepted boolean"
PROGRESS_OUTPUT = "document_id bigint, seq bigint, status string, pages string, closed boolean"


def _packed(rows: pa.Table) -> list[tuple[bytes]]:
    """The rows as list state: Arrow streams of at most ``PACKED_ROWS`` rows each."""
    out = []
    for start in range(0, rows.num_rows, PACKED_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows.slice(start, PACKED_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(state, schema: pa.Schema) -> pa.Table:
    found = [pa.ipc.open_stream(bytes(row[0])).read_all() for row in state.get()] if state.exists() else []
    return pa.concat_tables(found) if found else schema.empty_table()


def _replace(state, rows: pa.Table) -> None:
    if rows.num_rows:
        state.put(_packed(rows))
    else:
        state.clear()


class InOrder(StatefulProcessor):
    """Holds the changes of a bucket of keys back until the watermark has passed them and hands each key's on in order.

    Python is entered once per bucket and micro-batch and not once per key. Subclasses name the ``keys``, the ``columns``
    of a change and of the state they keep per key (``kept``); after ``idle_ms`` without a change a key's state goes.
    """
    keys: dict[str, pa.DataType]
    columns: dict[str, pa.DataType]
    kept: dict[str, pa.DataType]
    output: list[str]

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms
        self.waiting_schema = pa.schema({"at": pa.int64(), **self.keys, **self.columns})
        self.state_schema = pa.schema({**self.keys, "last": pa.int64(), **self.kept})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getListState("state", "rows binary")

    def outcomes(self, key: tuple, changes: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple | None]:
        """What the changes of a key lead to, and its state behind them (none: no state)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame["kind"] != HEARTBEAT] if "kind" in frame else frame
            if len(frame):
                changes = frame.assign(at=frame["ts"].astype("datetime64[ms]").astype("int64"))
                self.waiting.appendList(_packed(pa.Table.from_pandas(changes, self.waiting_schema, preserve_index=False).replace_schema_metadata()))
                first = min(int(changes["at"].min()), first) if first is not None else int(changes["at"].min())
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = _unpacked(self.waiting, self.waiting_schema)
        passed = pc.less_equal(held["at"], now)
        due, rest = held.filter(passed), held.filter(pc.invert(passed))
        # A bucket's states by key: when it last changed, and what is kept of it.
        width = len(self.keys)
        stored = zip(*(c.to_pylist() for c in _unpacked(self.state, self.state_schema).columns), strict=True)
        states = {row[:width]: row[width:] for row in stored}
        before = len(states)
        if due.num_rows:
            _replace(self.waiting, rest)
            found = self.release(due.sort_by([(name, "ascending") for name in (*self.keys, "seq")]), states)
            if found:
                yield pd.DataFrame(found, columns=self.output)
        states = {k: state for k, state in states.items() if state[0] + self.idle_ms > now}
        if due.num_rows or len(states) < before:
            rows = [(*k, *state) for k, state in states.items()]
            columns = list(zip(*rows, strict=True)) or [()] * len(self.state_schema)
            _replace(self.state, pa.table([pa.array(c, f.type) for c, f in zip(columns, self.state_schema, strict=True)], schema=self.state_schema))
        if states:
            self.handle.registerTimer(min(state[0] for state in states.values()) + self.idle_ms)
        if rest.num_rows:
            self.handle.registerTimer(pc.min(rest["at"]).as_py())

    def release(self, due: pa.Table, states: dict[tuple, tuple]) -> list[tuple]:
        """Outcomes of sorted changes; ``states`` is brought up to date."""
        out = []
        each_key = zip(*(due[name].to_pylist() for name in self.keys), strict=True)
        each_change = zip(*(due[name].to_pylist() for name in ("at", *self.columns)), strict=True)
        for key, rows in groupby(zip(each_key, each_change, strict=True), itemgetter(0)):
            changes = [change for _, change in rows]
            state = states.pop(key, None)
            if state and state[0] + self.idle_ms < min(change[0] for change in changes):
                state = None
            found, kept = self.outcomes(key, [change[1:] for change in changes], state[1:] if state else None)
            out += found
            if kept is not None:
                states[key] = (max(change[0] for change in changes), *kept)
        return out

    def close(self) -> None:
        pass


class PageStates(InOrder):
    keys = {"document_id": pa.int64(), "page_no": pa.int32()}
    columns = {"seq": pa.int64(), "kind": pa.string(), "text_hash": pa.string()}
    kept = {"status": pa.string(), "text_hash": pa.string()}
    output = ["document_id", "page_no", "seq", "kind", "status", "accepted"]

    def outcomes(self, key, changes, state):
        status, known_hash = state or ("PENDING", None)
        out = []
        for seq, kind, text_hash in changes:
            ok = status in ALLOWED_FROM.get(kind, ()) and (kind != "translated" or text_hash == known_hash)
            if ok:
                status = TARGET[kind]
                known_hash = text_hash if kind in ("ocr", "edited") else known_hash
            out.append((*key, seq, kind, status, ok))
        return out, (status, known_hash)


class Progress(InOrder):
    keys = {"document_id": pa.int64()}
    columns = {"seq": pa.int64(), "page_no": pa.int32(), "page_status": pa.string(), "document_status": pa.string()}
    kept = {"status": pa.string(), "page_nos": pa.list_(pa.int32()), "statuses": pa.list_(pa.string())}
    output = ["document_id", "seq", "status", "pages", "closed"]

    def outcomes(self, key, changes, state):
        status, page_nos, statuses = state or ("PROCESSING", [], [])
        pages, out = dict(zip(page_nos, statuses, strict=True)), []
        for seq, page_no, page_status, document_status in changes:
            if page_status is not None:
                pages[int(page_no)] = page_status
            status = document_status if document_status is not None else status
            closed = status in TERMINAL
            listed = ",".join(f"{n}:{s}" for n, s in sorted(pages.items()))
            out.append((key[0], seq, status, listed, closed))
            if closed:
                status, pages = "PROCESSING", {}
        kept = (status, list(pages), list(pages.values())) if pages or status != "PROCESSING" else None
        return out, kept


def _run(changes: DataFrame, processor: InOrder, output: str, delay: str, buckets: int) -> DataFrame:
    use_keyed_state(changes.sparkSession)
    # Event time without a zone is read as UTC.
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64(*processor.keys), F.lit(buckets)).cast("int")
    return timed.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(processor, output, "Append", "EventTime")


def page_state_stream(changes: DataFrame, delay: str = "1 day", idle: datetime.timedelta = datetime.timedelta(days=90),
                      buckets: int = BUCKETS) -> DataFrame:
    """Accept or refuse each change (``document_id, page_no, seq, ts, kind, text_hash``) of a page.

    A translation only counts for the text it was made from. A refused change, also a
    repeated one, comes out with ``accepted`` false and leaves the page as it was. The changes of
    the pages of one of ``buckets`` that wait, and their states, fit into a task's memory.
    """
    return _run(changes, PageStates(int(idle.total_seconds() * 1000)), PAGE_OUTPUT, delay, buckets)


def progress_stream(changes: DataFrame, delay: str = "1 day", idle: datetime.timedelta = datetime.timedelta(days=90),
                    buckets: int = BUCKETS) -> DataFrame:
    """A full snapshot of a document after each change of it.

    ``changes``: ``document_id, seq, ts`` with ``page_no, page_status`` or ``document_status``, and ``kind`` if there are heartbeats.
    A terminal document status closes the stream of snapshots and drops the state. ``buckets``: see :func:`page_state_stream`.
    """
    return _run(changes, Progress(int(idle.total_seconds() * 1000)), PROGRESS_OUTPUT, delay, buckets)
