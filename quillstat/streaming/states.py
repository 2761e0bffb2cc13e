"""Holding states and running counts over a stream, by event time.

Rows may come in any order within the watermark's delay. A key's rows are held back until the watermark has passed them and
then taken in order, so the results are those of the batch operators; later rows than that are dropped by Spark. Timers
run on event time: one for the earliest row held back, one for the end of an open run, so that a key that falls silent
is closed by what other keys bring. State is what is held back (the delay's worth of rows) and a few numbers a key.

These need the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstat.functions import params as P
from quillstat.shipping import ship


def use_state_store(spark: SparkSession) -> None:
    """Sets the session's state store to the one that keeps lists, values and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Holds rows (at: event time in ms, then `columns`) back until the watermark passes them. Subclasses take them in order."""

    #: What is held back, as a DDL schema that begins with `at long`; rows are taken in the order of these columns.
    held_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [tuple(_plain(v) for v in row) for part in rows for row in part[self.names()].itertuples(index=False, name=None)]
        if came:
            self.held.appendList(came)
            self.handle.registerTimer(max(min(r[0] for r in came), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready = [r for r in held if r[0] <= now]
        if ready:
            left = [r for r in held if r[0] > now]
            if left:
                self.held.put(left)
                self.handle.registerTimer(min(r[0] for r in left))
            else:
                self.held.clear()
        out = list(self.taken(key, sorted(ready, key=_order), now))
        if out:
            yield pd.DataFrame(out, columns=self.out_names())

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.held_schema.split(", ")]

    def out_names(self) -> list[str]:
        raise NotImplementedError

    def taken(self, key: tuple, rows: list[tuple], now: int) -> Iterator[tuple]:
        """Takes rows whose time has come, in order; `now` is the watermark."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _plain(v: Any) -> Any:
    """A cell as a Python value, missing ones as None."""
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


def _order(row: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


class _States(_InOrder):
    held_schema = "at long, frame long, pid string, team string"

    def __init__(self, gap: int, least: int, frame_ms: int) -> None:
        self.gap, self.least, self.reach = gap, least, gap * frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "at long, pid string, team string, start long, end long, n long")

    def out_names(self) -> list[str]:
        return ["shot", "pid", "team", "start", "end", "n"]

    def taken(self, key: tuple, rows: list[tuple], now: int) -> Iterator[tuple]:
        run = self.run.get() if self.run.exists() else None
        for at, frame, pid, team in rows:
            if run is not None and run[1] == pid and frame - run[4] <= self.gap:
                run = (at, pid, run[2], run[3], frame, run[5] + 1)
                continue
            if run is not None and run[5] >= self.least:
                yield key[0], *run[1:]
            run = (at, pid, team, frame, frame, 1)
        if run is not None and run[0] + self.reach < now:  # whatever could go on with it would be late
            if run[5] >= self.least:
                yield key[0], *run[1:]
            run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
            self.handle.registerTimer(run[0] + self.reach + 1)


def streaming_states(holders: DataFrame, late: str, gap: int = P.HOLD_GAP, least: int = P.HOLD_ROWS, frame_ms: int = 1000 // P.FPS) -> DataFrame:
    """(shot, pid, team, start, end, n): `possession.holder_states` of a stream of (shot, frame, pid, team), emitted as runs close.

    A frame's event time is (frame + 1) * frame_ms, since a watermark begins at 0, where rows are late already. Rows of one frame are taken in the order of their pid. A run closes with
    the next row that does not go on with it, or once the watermark has passed the last frame that could.
    """
    at = ((F.col("frame") + 1) * frame_ms).cast("long")
    timed = holders.select(F.col("shot").cast("long").alias("shot"), F.timestamp_millis(at).alias("ts"), at.alias("at"), F.col("frame").cast("long").alias("frame"), F.col("pid").cast("string").alias("pid"), F.col("team").cast("string").alias("team"))
    ship(holders.sparkSession)
    return timed.withWatermark("ts", late).groupBy("shot").transformWithStateInPandas(_States(gap, least, frame_ms), "shot long, pid string, team string, start long, end long, n long", "Append", "EventTime")


class _Counts(_InOrder):
    held_schema = "at long, frame long, shown boolean, team string, type string"

    def __init__(self, kits: tuple[str, str], types: tuple[str, str]) -> None:
        self.kits, self.types = kits, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", ", ".join(f"c{k} long" for k in range(6)))

    def out_names(self) -> list[str]:
        return ["clip", "frame", *[f"{k}_{t}" for k in self.kits for t in self.types], *[f"{k}_possession" for k in self.kits]]

    def taken(self, key: tuple, rows: list[tuple], now: int) -> Iterator[tuple]:
        total = list(self.totals.get()) if self.totals.exists() else [0] * 6
        pairs = [(k, t) for k in self.kits for t in self.types]
        frames: dict[int, list[tuple]] = {}
        for r in rows:
            frames.setdefault(r[1], []).append(r)
        for frame, at_once in frames.items():
            shown = [r for r in at_once if r[2]]
            if not shown:
                continue  # events count on frames that are there
            for _, _, is_frame, team, kind in at_once:
                if not is_frame and (team, kind) in pairs:
                    total[pairs.index((team, kind))] += 1
                elif is_frame and team in self.kits:
                    total[4 + self.kits.index(team)] += 1
            held = total[4] + total[5]
            yield key[0], frame, *total[:4], *[100.0 * x / held if held else None for x in total[4:]]
        self.totals.update(tuple(total))


def streaming_counts(frames: DataFrame, events: DataFrame, late: str, kits: tuple[str, str] = ("light", "dark"), types: tuple[str, str] = ("pass", "interception"), frame_ms: int = 1000 // P.FPS) -> DataFrame:
    """`possession.cumulative_counts` of streams: frames (clip, frame, team), one row a frame, and events (clip, frame, team, type); a frame's totals are emitted once the watermark has passed it."""
    row = lambda shown, kind: [F.col("clip").cast("long").alias("clip"), ((F.col("frame") + 1) * frame_ms).cast("long").alias("at"), F.col("frame").cast("long").alias("frame"), F.lit(shown).alias("shown"), F.col("team").cast("string").alias("team"), kind.cast("string").alias("type")]
    both = frames.select(*row(True, F.lit(None))).unionByName(events.select(*row(False, F.col("type"))))
    timed = both.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    ship(frames.sparkSession)
    fields = ", ".join(["clip long", "frame long", *[f"{k}_{t} long" for k in kits for t in types], *[f"{k}_possession double" for k in kits]])
    return timed.groupBy("clip").transformWithStateInPandas(_Counts(kits, types), fields, "Append", "EventTime")
