"""A bounded line with parking: documents enter while there is room, wait in order while there is none, and go in as room opens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: What comes in: a lane, an order within it, a document, and arrive, read (its text is needed now), done, or forget.
EVENTS = "lane string, at long, doc long, kind string"
#: What goes out: entered, parked, released (from the wait into the line), left, forgotten; the line's length and the number that wait, behind it.
ACTIONS = "lane string, at long, doc long, action string, line int, waiting int"
#: Documents whose work has been asked for and hasn't ended, at most.
ROOM = 8


class Gate(StatefulProcessor):
    """Per lane: the line, which never holds more than `room` documents, and the documents that wait, by the order in which they came.

    An arrival enters if there is room and nobody waits, and parks otherwise. `read` is for a document that was never read: it enters
    whatever the line's length is, as searchable text comes first. `done` takes a document out of the line, and the first that waits goes in if there is room.
    `forget` drops a document from wherever it is. What is in the line or waits already isn't taken twice; `done` of a document that isn't in the line is passed
    over. The wait is a map state on disk, read only for its first entries and changed entry by entry; the line is one short list.
    """

    def __init__(self, room: int = ROOM):
        self.room = room

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line = handle.getValueState("line", "docs array<long>, first long, last long, waiting int")
        self.turns = handle.getMapState("turns", "turn long", "doc long")
        self.places = handle.getMapState("places", "doc long", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "doc", "kind"], kind="stable")
        docs, first, last, waiting = self.line.get() if self.line.exists() else ([], 0, 0, 0)
        docs, out = list(docs), []

        def told(e, action: str, doc: int) -> None:
            out.append((key[0], e.at, doc, action, len(docs), waiting))

        for e in events.itertuples():
            doc, parked = int(e.doc), self.places.containsKey((int(e.doc),))
            if e.kind in ("arrive", "read"):
                if doc in docs or (parked and e.kind == "arrive"):
                    continue
                if e.kind == "read" or (len(docs) < self.room and not waiting):
                    if parked:
                        waiting -= self._forget(doc)
                    docs.append(doc)
                    told(e, "entered", doc)
                else:
                    self.turns.updateValue((last,), (doc,))
                    self.places.updateValue((doc,), (last,))
                    last, waiting = last + 1, waiting + 1
                    told(e, "parked", doc)
            elif e.kind == "forget" and parked:
                waiting -= self._forget(doc)
                told(e, "forgotten", doc)
            elif e.kind in ("done", "forget") and doc in docs:
                docs.remove(doc)
                told(e, "left" if e.kind == "done" else "forgotten", doc)
                while waiting and len(docs) < self.room:
                    while not self.turns.containsKey((first,)):  # forgotten meanwhile
                        first += 1
                    next_ = int(self.turns.getValue((first,))[0])
                    waiting -= self._forget(next_)
                    first += 1
                    docs.append(next_)
                    told(e, "released", next_)
        self.line.update((docs, first, last, waiting))
        yield pd.DataFrame(out, columns=["lane", "at", "doc", "action", "line", "waiting"])

    def _forget(self, doc: int) -> int:
        turn = int(self.places.getValue((doc,))[0])
        self.turns.removeKey((turn,))
        self.places.removeKey((doc,))
        return 1

    def close(self) -> None:
        pass


def gated(events: DataFrame, room: int = ROOM) -> DataFrame:
    """(lane, at, doc, action, line, waiting) of a stream or a table of EVENTS; lanes are dealt over tasks, and each has a line of its own.

    Events of a lane take effect in the order of `at` within a micro-batch, so a stream has to bring them in that order; a table is one batch. Rows with a
    null lane, at, doc or kind are left out. A restarted stream goes on from the state that its checkpoint holds. Needs the RocksDB state store.
    """
    rows = events.select("lane", "at", "doc", "kind").dropna()
    return rows.groupBy("lane").transformWithStateInPandas(Gate(room), StructType.fromDDL(ACTIONS), "Append", "None")


def plain(events: Iterable[tuple], room: int = ROOM) -> list[tuple]:
    """The same over a list, with a list and a dict: what tests compare the stream with."""
    lines: dict[str, list] = {}
    waits: dict[str, list] = {}
    out = []
    for lane, at, doc, kind in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3])):
        line, wait = lines.setdefault(lane, []), waits.setdefault(lane, [])
        tell = lambda action, d: out.append((lane, at, d, action, len(line), len(wait)))  # noqa: B023, E731
        if kind in ("arrive", "read") and doc not in line and not (doc in wait and kind == "arrive"):
            if kind == "read" or (len(line) < room and not wait):
                if doc in wait:
                    wait.remove(doc)
                line.append(doc)
                tell("entered", doc)
            else:
                wait.append(doc)
                tell("parked", doc)
        elif kind == "forget" and doc in wait:
            wait.remove(doc)
            tell("forgotten", doc)
        elif kind in ("done", "forget") and doc in line:
            line.remove(doc)
            tell("left" if kind == "done" else "forgotten", doc)
            while wait and len(line) < room:
                next_ = wait.pop(0)
                line.append(next_)
                tell("released", next_)
    return out


def with_store(spark, run):
    """run() while the session keeps state in RocksDB, which map states need; the session's own choice comes back afterwards."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def run_stream(stream: DataFrame, target: str, checkpoint: str, room: int = ROOM):
    """Gates a stream of EVENTS into a Parquet folder, as far as there is input now; a later call goes on from the checkpoint."""
    def start():
        out = gated(stream, room).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
        return out

    return with_store(stream.sparkSession, start)
