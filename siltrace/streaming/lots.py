"""Subgroups of whole lots as session state of a stream, with the rows that come too late kept aside.

A line's rows are put in order behind a bound that follows the latest time seen; consecutive rows of one lot are a run, and runs are merged
until a group has its size, as :func:`siltrace.operators.spc.lot_groups` does for a table.  A row that arrives when its time has
already been passed cannot change what was told: it is given out as late, so that it can be counted, stored or replayed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND = "kind string, line string, run long, first_idx long, size long, lot string, gid long, ts timestamp, id long"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


class Line:
    """What is remembered of a line: the run that is open, the runs of the open group, and places; ``memory`` is all of it, in types of JSON."""

    def __init__(self, target: int, memory: dict | None = None):
        self.target = target
        self.memory: dict[str, Any] = memory or {"idx": 0, "run": -1, "lot": None, "first": 0, "open": [], "held": 0, "gid": 0}

    def add(self, lot: str | None) -> list[tuple]:
        """(run, first_idx, size, lot, gid) of the runs whose group the next row completes."""
        m, out = self.memory, []
        if m["run"] < 0 or lot != m["lot"] or m.get("ended"):
            out = self._close_run()
            m["run"], m["lot"], m["first"], m["ended"] = m["run"] + 1, lot, m["idx"], False
        m["idx"] += 1
        return out

    def _close_run(self) -> list[tuple]:
        m = self.memory
        size = m["idx"] - m["first"]
        if m["run"] < 0 or m.get("ended") or not size:
            return []
        m["open"].append([m["run"], m["first"], size, m["lot"]])
        m["held"] += size
        return self._close_group(m["gid"]) if m["held"] >= self.target else []

    def _close_group(self, gid: int) -> list[tuple]:
        m = self.memory
        out = [(*r, gid) for r in m["open"]]
        m["open"], m["held"] = [], 0
        m["gid"] += gid >= 0
        return out

    def end(self) -> list[tuple]:
        """The open run ends; so does the open group, which counts if it has half its size."""
        m = self.memory
        out = self._close_run()
        m["ended"] = m["run"] >= 0
        return out + (self._close_group(m["gid"] if 2 * m["held"] >= self.target else -1) if m["open"] else [])


class LotGroups(StatefulProcessor):
    """Keeps a :class:`Line` for each key, rows that wait, and the time up to which rows have been taken."""

    def __init__(self, target: int, late_us: int, idle_us: int | None):
        self.target, self.late_us, self.idle_us = target, late_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line = handle.getValueState("line", "memory string")
        self.waiting = handle.getListState("waiting", "us long, id long, lot string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        memory = json.loads(self.line.get()[0]) if self.line.exists() else None
        line = Line(self.target, memory)
        m = line.memory
        come = [(int(u), int(i), None if pd.isna(t) else t) for part in rows for u, i, t in zip(part["us"], part["id"], part["lot"], strict=True)]
        passed = m.get("passed")
        late = [r for r in come if passed is not None and r[0] <= passed]
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        held = sorted([*held, *[r for r in come if passed is None or r[0] > passed]], key=lambda r: r[:2])
        if held:
            bound = max(held[-1][0] - self.late_us, passed if passed is not None else held[-1][0] - self.late_us)
            m["passed"] = passed = bound
        found = []
        ready = [r for r in held if r[0] <= passed]
        for us, _, lot in ready:
            if self.idle_us is not None and m.get("latest") is not None and us - m["latest"] > self.idle_us:
                found += line.end()
            found += line.add(lot)
            m["latest"] = us
        if self.idle_us is not None and m.get("latest") is not None and passed - m["latest"] > self.idle_us:
            found += line.end()
        rest = held[len(ready) :]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        self.line.update((json.dumps(m),))
        out = [("run", key[0], *r, pd.NaT, None) for r in found]
        out += [("late", key[0], None, None, None, lot, None, pd.Timestamp(us, unit="us"), i) for us, i, lot in late]
        table = pd.DataFrame(out, columns=_NAMES)
        numbers = {c: "Int64" for c in ("run", "first_idx", "size", "gid", "id")}
        yield table.astype(numbers | {"ts": "datetime64[us]"})

    def close(self) -> None:
        pass


def lot_groups_of_stream(
    stream: DataFrame, target: int, *, time_col: str = "ts", id_col: str = "event_id", lot_col: str = "lot", line_col: str | None = None, late_ms: int = 3_600_000, idle_ms: int | None = None
) -> DataFrame:
    """Rows of two kinds, in append mode.

    ``run``: (line, run, first_idx, size, lot, gid) of each run of consecutive rows of one lot, in order of time, then id, when its
    group of at least ``target`` rows is complete; gid -1: of a last group of less than half of that.  ``late``: (line, lot, ts, id) of each row
    that came after rows ``late_ms`` younger than itself had been seen in an earlier micro-batch, and takes no part.

    A line (all rows, by default) is one key, as each run depends on all rows before; give ``line_col`` where there are several.
    State is bounded by the rows within ``late_ms`` and the runs of one group.  idle_ms: where no row came for longer, in event time, run and
    group end.  Rows without time take no part; a null lot is a lot.  Needs the RocksDB state store.
    """
    line = F.coalesce(F.col(line_col).cast("string"), F.lit("")) if line_col else F.lit("")
    at = F.col(time_col).cast("timestamp")
    rows = stream.filter(F.col(time_col).isNotNull()).select(
        line.alias("line"), F.unix_micros(at).alias("us"), F.col(id_col).cast("long").alias("id"), F.col(lot_col).cast("string").alias("lot")
    )
    processor = LotGroups(target, 1000 * late_ms, None if idle_ms is None else 1000 * idle_ms)
    return rows.groupBy("line").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Append", timeMode="None")
