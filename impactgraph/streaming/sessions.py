"""Session state over streams of events: debounced batches, read strategies, and running ledgers.

Event times arrive without a zone in the test tables and must be cast to timestamps before a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from impactgraph.operators import session


def debounced(events: DataFrame, key: str, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """One row for each burst of events that a quiet gap ends: key, events, first, last. Batch or stream (with `late`)."""
    if late:
        events = events.withWatermark("ts", late)
    got = events.groupBy(key, F.session_window("ts", quiet)).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return got.drop("session_window")


def running_ledger(calls: DataFrame) -> DataFrame:
    """The ledger of a stream of calls, without the total row: complete mode keeps one state row for each tool."""
    n, o, d = F.count("*").alias("calls"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered")
    return calls.groupBy("tool").agg(n, o, d)


STRATEGY = "session long, file string, seq long, count int, same boolean, strategy string"
_STATE = "hash long, count int"


def read_strategies(reads: DataFrame, timeout_ms: int = 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """Strategies of a stream of reads (session, file, content_hash, ts, seq, confidence), keyed by session and file.

    State is the last content and the number of reads; a key that stays silent for timeout_ms of event time is forgotten,
    as the tracker forgets its oldest files. Within a batch reads are taken in order of time. The timeout is one of event
    time, so that a stream without new rows comes to rest.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, count = state.get if state.exists else (None, 0)
        for rows in [pd.concat(list(batches)).sort_values(["ts", "seq"])]:
            out = []
            for h, seq, sure in zip(rows["content_hash"], rows["seq"], rows["confidence"], strict=True):
                same = count > 0 and h == last
                out.append((key[0], key[1], seq, count, same, _strategy(count, same, sure)))
                last, count = h, count + 1
            state.update((last, count))
            at = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(at + timeout_ms)
            yield pd.DataFrame(out, columns=["session", "file", "seq", "count", "same", "strategy"])

    return reads.withWatermark("ts", late).groupBy("session", "file").applyInPandasWithState(step, STRATEGY, _STATE, "append", "EventTimeTimeout")


class _Tracker(StatefulProcessor):
    """The files that one session remembers, the least recently read first to go. They are loaded once for a batch of the
    session's reads, and what changed is written back: at most `capacity` entries, whatever the session's length."""

    def __init__(self, capacity: int, window: int):
        self.capacity, self.window = capacity, window

    def init(self, handle) -> None:
        self.files = handle.getMapState("files", "file string", "at long, content_hash long, count int, tokens long")
        self.totals = handle.getValueState("totals", "reads long, sent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reads, sent = self.totals.get() if self.totals.exists() else (0, 0)
        known = {k[0]: tuple(v) for k, v in sorted(self.files.iterator(), key=lambda x: x[1][0])} if reads else {}
        before, out = dict(known), []
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for file, content, seq, tokens in zip(batch["file"], batch["content_hash"], batch["seq"], batch["tokens"], strict=True):
            _, last, count, previous = known.pop(file, (0, None, 0, 0))
            same, ratio = count > 0 and content == last, (sent - previous) / self.window if self.window > 0 else 1.0
            sure = "high" if ratio < session.HIGH else "medium" if ratio < session.MEDIUM else "low"
            out.append((key[0], file, seq, count, same, _strategy(count, same, sure)))
            known[file] = (reads, content, count + 1, tokens)  # now the last in order
            if len(known) > self.capacity:
                known.pop(next(iter(known)))
            reads, sent = reads + 1, sent + tokens
        for file in before.keys() - known.keys():
            self.files.removeKey((file,))
        for file, entry in known.items():
            if before.get(file) != entry:
                self.files.updateValue((file,), entry)
        self.totals.update((reads, sent))
        yield pd.DataFrame(out, columns=["session", "file", "seq", "count", "same", "strategy"])

    def close(self) -> None:
        pass


def evicting_strategies(reads: DataFrame, window: int, capacity: int = session.CAPACITY) -> DataFrame:
    """Strategies of a stream of reads (session, file, content_hash, ts, seq, tokens) by a tracker that remembers `capacity`
    files of each session, as `reuse.strategies` gives them for a table. A batch's reads are taken in order of time.

    The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return reads.groupBy("session").transformWithStateInPandas(_Tracker(capacity, window), STRATEGY, "Append", "None")


def _strategy(count: int, same: bool, sure: str) -> str:
    if count == 0 or not same:
        return "full-fresh"
    if count >= 3:
        return "sha-pointer" if sure == "high" else "escalated-full"
    if count == 2:
        return {"high": "sha-pointer", "medium": "session-signature"}.get(sure, "full-fresh")
    return "sha-pointer"


def drift_batches(changes: DataFrame, delivered: DataFrame, sink) -> object:
    """A stream of (file, content_hash) changes held against what was delivered; sink(df, batch) gets each batch's drift."""
    return changes.writeStream.foreachBatch(lambda df, n: sink(session.file_drift(delivered, df), n))
