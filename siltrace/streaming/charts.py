"""Control charts as state of a stream: the alarms of :mod:`siltrace.operators.spc`, as soon as they can be known.

Every chart is a key of ``transformWithState``.  Its state holds rows that wait for the watermark, and of those before it only sums: the
blocks of the baseline until that is complete, then the frozen baseline, the open subgroup, the last eight z and the EWMA.  Rows are
taken in order of event time behind the watermark, so that alarms do not depend on how a stream is cut into micro-batches, nor
on restarts from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from math import ceil, sqrt
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltrace.operators.spc import D2, LAMBDA, LIMIT, MIN_EXPECTED

ALARM = "chart string, subgroup long, end_idx long, phase string, rule string, value double, z double, direction string"
MEAN = "FAIL_FRAC_MEAN"


class Chart:
    """What one chart remembers, and how it goes on; ``memory`` is all of it, in types of JSON."""

    def __init__(self, mean: bool, base_size: int, n_base_rows: int, laney: bool, memory: dict | None = None):
        self.mean, self.base_size, self.n_base_rows, self.laney = mean, base_size, n_base_rows, laney
        self.memory: dict[str, Any] = memory or {
            "idx": 0, "blocks": [], "start": 0.0, "size": base_size if mean else 0, "n": 0, "held": 0, "sum": 0.0,
            "groups": [], "closed": 0, "base": None, "last": [], "ewma": 0.0, "early": [],
        }

    def add(self, values: Sequence[float | None]) -> list[tuple]:
        """Alarms that the next rows bring."""
        m, out = self.memory, []
        for value in values:
            m["idx"] += 1
            if not m["size"]:  # the size of subgroups follows from the baseline
                m["start"] += value if m["idx"] <= self.n_base_rows else 0
                m["n"], m["sum"] = m["n"] + 1, m["sum"] + value
                if m["n"] == self.base_size:
                    m["blocks"].append(m["sum"])
                    m["n"], m["sum"] = 0, 0.0
                if m["idx"] >= self.n_base_rows:
                    out += self._sized()
            elif m["size"] > 0:
                m["n"] += 1
                if value is not None:
                    m["held"], m["sum"] = m["held"] + 1, m["sum"] + value
                if m["n"] == m["size"]:
                    out += self._close()
        return out

    def _sized(self) -> list[tuple]:
        m, out = self.memory, []
        share = m["start"] / self.n_base_rows
        m["size"] = ceil(MIN_EXPECTED / share / self.base_size) * self.base_size if share > 0 else -1  # no hit, no chart
        blocks, rest = m["blocks"], (m["n"], m["sum"])
        m["blocks"], m["n"], m["held"], m["sum"] = [], 0, 0, 0.0
        if m["size"] > 0:
            per = m["size"] // self.base_size
            idx, m["idx"] = m["idx"], 0
            for k in range(0, len(blocks), per):
                own = blocks[k : k + per]
                m["n"], m["sum"] = len(own) * self.base_size, sum(own)
                m["held"] = m["n"]
                m["idx"] += m["n"]
                if len(own) == per:
                    out += self._close()
            m["n"], m["sum"], m["held"], m["idx"] = m["n"] + rest[0], m["sum"] + rest[1], m["held"] + rest[0], idx
        return out

    def end(self) -> list[tuple]:
        """Closes the open subgroup if it has half its size."""
        m = self.memory
        return self._close() if m["size"] > 0 and m["n"] and 2 * m["n"] >= m["size"] else []

    def _close(self) -> list[tuple]:
        m = self.memory
        n, value = m["n"], m["sum"] / max(1, m["held"])
        m["n"], m["held"], m["sum"] = 0, 0, 0.0
        m["closed"] += 1
        if m["base"] is None:
            m["groups"].append((m["idx"] - 1, n, value))
            n_base = max(3, self.n_base_rows // m["size"])
            if len(m["groups"]) < n_base or m["idx"] < self.n_base_rows:
                return []
            self._freeze(n_base)
            groups, m["groups"] = m["groups"], []
            m["closed"] = 0
            out = []
            for end_idx, size, v in groups if m["size"] > 0 else []:
                m["closed"] += 1
                out += self._point(end_idx, size, v)
            return self._told(out)
        return self._told(self._point(m["idx"] - 1, n, value))

    def _freeze(self, n_base: int) -> None:
        m = self.memory
        own = m["groups"][:n_base]
        if self.mean:
            center = sum(v for _, _, v in own) / n_base
            sigma = sum(abs(b[2] - a[2]) for a, b in zip(own[:-1], own[1:], strict=True)) / (n_base - 1) / D2
            if sigma <= 0:
                m["size"] = -1
            m["base"] = [n_base, center, sigma]
            return
        center = sum(n * v for _, n, v in own) / sum(n for _, n, _ in own)
        if not 0 < center < 1:
            m["size"] = -1
            m["base"] = [n_base, center, 0.0]
            return
        z = [(v - center) / sqrt(center * (1 - center) / n) for _, n, v in own]
        steps = [abs(b - a) for a, b in zip(z[:-1], z[1:], strict=True)]
        m["base"] = [n_base, center, max(1.0, sum(steps) / len(steps) / D2) if self.laney else 1.0]

    def _point(self, end_idx: int, n: int, value: float) -> list[tuple]:
        m = self.memory
        n_base, center, scale = m["base"]
        z = (value - center) / (scale if self.mean else sqrt(center * (1 - center) / n) * scale)
        i = m["closed"] - 1
        m["last"] = last = [*m["last"], z][-8:]
        m["ewma"] = LAMBDA * z + (1 - LAMBDA) * m["ewma"]
        limit = LIMIT * sqrt(LAMBDA / (2 - LAMBDA) * (1 - (1 - LAMBDA) ** (2 * (i + 1))))

        def run(length: int, least: int, beyond: float) -> bool:
            own = last[-length:]
            return len(own) == length and (sum(x > beyond for x in own) >= least or sum(x < -beyond for x in own) >= least)

        rules = {"R1": abs(z) > 3, "R2": run(3, 2, 2.0), "R3": run(5, 4, 1.0), "R4": run(8, 8, 0.0), "EWMA": abs(m["ewma"]) > limit}
        phase = "baseline" if i < n_base else "monitor"
        return [(i, end_idx, phase, rule, value, z, "up" if z > 0 else "down") for rule, on in rules.items() if on]

    def _told(self, alarms: list[tuple]) -> list[tuple]:
        """A p-chart counts as one when two of its subgroups are monitored; its alarms wait for that."""
        m = self.memory
        if self.mean or (m["base"] and m["closed"] - m["base"][0] >= 2):
            out, m["early"] = [tuple(x) for x in m["early"]] + alarms, []
            return out
        m["early"] += alarms
        return []


class ChartAlarms(StatefulProcessor):
    """Keeps a :class:`Chart` for each key and feeds it the rows that the watermark has passed."""

    def __init__(self, base_size: int, n_base_rows: int, laney: bool, idle_ms: int | None):
        self.limits, self.idle_ms = (base_size, n_base_rows, laney), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chart = handle.getValueState("chart", "memory string")
        self.waiting = handle.getListState("waiting", "us long, id long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            own = [(int(u), int(i), None if pd.isna(v) else float(v)) for u, i, v in zip(part["us"], part["id"], part["value"], strict=True)]
            self.waiting.appendList(own)
            latest = max([u for u, _, _ in own] + ([] if latest is None else [latest]))
        if latest is not None:
            due = latest // 1000 + 1
            self.handle.registerTimer(due)
            if self.idle_ms is not None:
                self.handle.registerTimer(due + self.idle_ms + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        name = key[0]
        memory = json.loads(self.chart.get()[0]) if self.chart.exists() else None
        chart = Chart(name == MEAN, *self.limits, memory)
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        alarms = self._fed(chart, ready, passed)
        if len(ready) < len(rows):
            self.waiting.put([r for r in rows if r[0] > passed])
        elif rows:
            self.waiting.clear()
        self.chart.update((json.dumps(chart.memory),))
        names = ["subgroup", "end_idx", "phase", "rule", "value", "z", "direction"]
        yield pd.DataFrame(alarms, columns=names).assign(chart=name)[["chart", *names]]

    def _fed(self, chart: Chart, ready: list[tuple], passed: int) -> list[tuple]:
        """Alarms of the rows, whose subgroups end where no row came for long, and of the time that has passed since."""
        alarms, part, latest = [], [], chart.memory.get("latest")
        idle = None if self.idle_ms is None else 1000 * self.idle_ms
        for us, _, value in ready:
            if idle is not None and latest is not None and us - latest > idle:
                alarms += chart.add(part) + chart.end()
                part = []
            part.append(value)
            latest = us
        alarms += chart.add(part)
        if idle is not None and latest is not None and passed - latest > idle:
            alarms += chart.end()
        chart.memory["latest"] = latest
        return alarms

    def close(self) -> None:
        pass


def chart_alarms(
    stream: DataFrame,
    classes: Sequence[str],
    *,
    time_col: str = "ts",
    id_col: str = "event_id",
    base_size: int = 25,
    n_base_rows: int = 2500,
    conf_threshold: float = 0.7,
    laney: bool = True,
    late: str = "1 hour",
    idle: int | None = None,
) -> DataFrame:
    """(chart, subgroup, end_idx, phase, rule, value, z, direction): the alarms of a stream of predictions, in append mode.

    One chart for each class; LOW_CONFIDENCE and FAIL_FRAC_MEAN where the columns ``confidence`` and ``fail_frac`` are there.  Rows
    are ordered by event time, then id, behind the watermark, ``late`` after the latest time seen; rows that come later still are dropped by
    Spark, which counts them.  Alarms of the baseline come when its ``n_base_rows`` rows and two monitored subgroups are complete.
    idle: milliseconds; where no row came for longer, in event time, the open subgroup closes if it has half its size; by default
    it waits for ever.  Rows without time take no part; a null class or confidence is no hit.

    State is bounded by the rows within ``late`` and by n_base_rows / base_size sums a chart.  A chart is one key: its rows pass
    through one task, as each alarm depends on all rows before.  Needs the RocksDB state store.
    """
    value = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    watched = [F.struct(F.lit(c).alias("chart"), value(F.col("y_pred") == c).alias("value")) for c in classes]
    if "confidence" in stream.columns:
        watched.append(F.struct(F.lit("LOW_CONFIDENCE").alias("chart"), value(F.col("confidence") < conf_threshold).alias("value")))
    if "fail_frac" in stream.columns:
        watched.append(F.struct(F.lit(MEAN).alias("chart"), F.col("fail_frac").cast("double").alias("value")))
    timed = stream.filter(F.col(time_col).isNotNull()).withColumn("_at", F.col(time_col).cast("timestamp"))
    rows = timed.withWatermark("_at", late).select("_at", F.unix_micros("_at").alias("us"), F.col(id_col).cast("long").alias("id"), F.inline(F.array(*watched)))
    return rows.groupBy("chart").transformWithStateInPandas(
        statefulProcessor=ChartAlarms(base_size, n_base_rows, laney, idle), outputStructType=ALARM, outputMode="Append", timeMode="EventTime"
    )
