"""Live trips with state between batches: late rows, a finish that holds, a bounded warm-up, and turns that settle.

Each takes a stream and gives a stream. State is a few numbers of a trip, or lists with a stated bound; a trip that is
silent for ``idle`` is forgotten, where it has one. Rows of a batch are taken in the order that the docstring names, so results don't depend
on how a batch was dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def policed(stream: DataFrame) -> DataFrame:
    """A verdict on each row (trip_id, arrival, t, kind of ``fix`` or ``end``), in order of ``arrival``.

    A fix that is not later than the last one accepted is ``out_of_order``; one that comes after the trip's end is
    ``after_end``; one without a time is ``no_time``; none of them changes anything, and all stay in the result as a side table. The first end is ``finished``
    with the fixes accepted and the last of their times, and any further one repeats that result. No watermark drops a row,
    so nothing is lost in silence; a trip's three numbers stay.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, ended = state.get if state.exists else (None, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("arrival")
        for arrival, t, kind in zip(rows["arrival"], rows["t"], rows["kind"], strict=True):
            if kind == "end":
                verdict, ended = "finished_again" if ended else "finished", True
            elif ended:
                verdict = "after_end"
            elif pd.isna(t):
                verdict = "no_time"
            elif last is not None and t <= last:
                verdict = "out_of_order"
            else:
                verdict, last, n = "accepted", float(t), n + 1
            out.append((key[0], arrival, t, verdict, n, last))
        state.update((last, n, ended))
        yield pd.DataFrame(out, columns=["trip_id", "arrival", "t", "verdict", "n", "last"])

    out = "trip_id long, arrival long, t double, verdict string, n long, last double"
    return stream.groupBy("trip_id").applyInPandasWithState(run, out, "last double, n long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def warmed(stream: DataFrame, cap: int = 4000, idle: int = 60_000, late: str = "2 seconds") -> DataFrame:
    """Controls (trip_id, ts, n, a, ready) held back until the first that is ``ready``, then let go in order of ``n``.

    At most ``cap`` are held, the oldest go first. What came before is told as ``held``, that row and all after it as
    ``straight``; a row without a number is left out. A trip that is silent for ``idle`` milliseconds of event time is let go without: ``forced``.
    """
    columns = ["trip_id", "n", "a", "how"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        resolved, held, values = state.get if state.exists else (False, [], [])
        held, values = list(held), list(values)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, a, "forced") for n, a in zip(held, values, strict=True)], columns=columns)
            return
        rows, out = pd.concat(list(batches)).sort_values("n"), []
        newest, rows = rows["ts"].max(), rows[rows["n"].notna()]
        for n, a, ready in zip(rows["n"], rows["a"], rows["ready"], strict=True):
            if not resolved and ready:
                out += [(key[0], m, b, "held") for m, b in zip(held, values, strict=True)]
                resolved, held, values = True, [], []
            if resolved:
                out.append((key[0], n, a, "straight"))
            else:
                held, values = [*held, int(n)][-cap:], [*values, float(a)][-cap:]
        state.update((resolved, held, values))
        state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        if out:
            yield pd.DataFrame(out, columns=columns)

    kept = "resolved boolean, held array<long>, vals array<double>"
    return stream.withWatermark("ts", late).groupBy("trip_id").applyInPandasWithState(run, "trip_id long, n long, a double, how string", kept, "append", GroupStateTimeout.EventTimeTimeout)


def settled(stream: DataFrame, settle: float = 1.0, age: float = 60.0, idle: int = 120_000, late: str = "2 seconds") -> DataFrame:
    """When turns may be used: trip_id, turn, what (``usable`` or ``expired``), t of the tick that says so.

    Rows (trip_id, ts, t, turn, peak) are ticks of the motion, and where ``turn`` is set, the end of a turn besides. A turn is
    usable from the first tick ``settle`` seconds after its end, and expires at the first tick after that which is more than
    ``age`` seconds after its peak; a tick without a time is left out. The state holds the turns that are neither.
    """
    columns = ["trip_id", "turn", "what", "t"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = list(zip(*state.get, strict=True)) if state.exists else []
        rows, out = pd.concat(list(batches)).sort_values("t"), []
        newest, rows = rows["ts"].max(), rows[rows["t"].notna()]
        for t, turn, peak in zip(rows["t"], rows["turn"], rows["peak"], strict=True):
            left = []
            for name, end, top, usable in open_:
                if not usable and t >= end + settle:
                    usable = True
                    out.append((key[0], name, "usable", t))
                elif usable and t - top > age:
                    out.append((key[0], name, "expired", t))
                    continue
                left.append((name, end, top, usable))
            open_ = left if pd.isna(turn) else [*left, (int(turn), float(t), float(peak), False)]
        state.update(tuple(map(list, zip(*open_, strict=True))) if open_ else ([], [], [], []))
        state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        if out:
            yield pd.DataFrame(out, columns=columns)

    kept = "name array<long>, end array<double>, peak array<double>, usable array<boolean>"
    return stream.withWatermark("ts", late).groupBy("trip_id").applyInPandasWithState(run, "trip_id long, turn long, what string, t double", kept, "append", GroupStateTimeout.EventTimeTimeout)


def delayed(stream: DataFrame, lag: float = 12.0, drift: float = 0.5, noise: float = 2.0, start: float = 25.0) -> DataFrame:
    """A level filtered through measurements that may come late: trip_id, t, z, level, var, in order of ``t``; late ones apart.

    Rows are (trip_id, arrival, t, z). The state keeps the filter as it stood ``lag`` seconds before the newest time, and the
    measurements since, in order; a measurement is folded in, and told, once nothing earlier can come any more, so the result is
    that of all of them sorted. One that comes more than ``lag`` behind the newest, or not after the last that is told, is
    ``too_late``, with null level. A row without a measurement ends the trip: what is held is told. Between measurements the
    variance grows by ``drift`` a second; ``noise`` is the variance of one, ``start`` that of the first level, zero.
    """
    columns = ["trip_id", "t", "z", "level", "var", "what"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, level, var, newest, times, values = state.get if state.exists else (None, 0.0, start, None, [], [])
        held, out = list(zip(times, values, strict=True)), []

        def fold(until: float) -> None:
            nonlocal last, level, var, held
            held.sort()
            while held and held[0][0] < until:
                t, z = held.pop(0)
                var += 0.0 if last is None else drift * (t - last)
                gain = var / (var + noise)
                last, level, var = t, level + gain * (z - level), (1 - gain) * var
                out.append((key[0], t, z, level, var, "told"))

        rows = pd.concat(list(batches)).sort_values("arrival")
        for t, z in zip(rows["t"], rows["z"], strict=True):
            if pd.isna(z):
                fold(float("inf"))
            elif newest is not None and t < newest - lag or last is not None and t <= last:
                out.append((key[0], t, z, None, None, "too_late"))
            else:
                held.append((float(t), float(z)))
                newest = t if newest is None else max(newest, t)
                fold(newest - lag)
        state.update((last, level, var, newest, [t for t, _ in held], [z for _, z in held]))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"level": "float64", "var": "float64"})

    kept = "last double, level double, var double, newest double, times array<double>, vals array<double>"
    return stream.groupBy("trip_id").applyInPandasWithState(run, "trip_id long, t double, z double, level double, var double, what string", kept, "append", GroupStateTimeout.NoTimeout)
