"""Order-dependent keep rules, run on slices of each key that hold equally many rows.

"Keep an event only if enough time has passed since the last kept one" depends
on all earlier events of the key. For a slice it is a function: given the last
kept event before it, which event is kept last? What comes before a slice can
only matter through the first event it allows, so the function is a table over
the slice's first events, filled by jumping from each event to the next one kept.
Functions of neighbouring slices are composed in groups, those again, until one
is left per key; going back down, every slice learns what was kept before it and
is replayed on its own. No table holds more events than fall into one gap (and
one episode) behind the start of its span.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.operators.ordering import _attach
from tidewrack.operators.slices import micros, place, us
from tidewrack.session import durable

#: Slices whose functions are composed in one task.
FAN = 32
_TABLE = "last_t long, last_g long, entry_t array<long>, entry_g array<long>, exit_t array<long>, exit_g array<long>"


def _first_allowed(t: np.ndarray, g: np.ndarray, last_t, last_g, gap: int) -> np.ndarray:
    """Place of the first event after each state (time and episode of the last kept event)."""
    return np.maximum(np.searchsorted(t, np.add(last_t, gap), side="left"), np.searchsorted(g, last_g, side="right"))


def _ends(nxt: np.ndarray) -> np.ndarray:
    """Where the jumps from each event end inside the slice."""
    n, end = len(nxt), list(range(len(nxt)))
    jumps = nxt.tolist()
    for i in range(n - 1, -1, -1):
        if jumps[i] < n:
            end[i] = end[jumps[i]]
    return np.array(end, dtype=np.int64)


class Keep:
    """The rule on arrays: events of a slice, tables of slices, tables of groups of slices."""

    def __init__(self, gap: int, once: bool):
        self.gap, self.once = gap, once

    def episodes(self, g: np.ndarray) -> np.ndarray:
        """Without episodes every event is one of its own."""
        return g if self.once else np.full(len(g), -1, dtype=np.int64)

    def _after(self, t, g, last_t, last_g):
        if self.once:
            return _first_allowed(t, g, last_t, last_g, self.gap)
        return np.searchsorted(t, np.add(last_t, self.gap), side="left")

    def jumps(self, t: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.maximum(self._after(t, g, t, g), np.arange(1, len(t) + 1))

    def _domain(self, t: np.ndarray, g: np.ndarray) -> int:
        """How many of the first events can be the first one allowed."""
        return min(int(self._after(t, g, t[0], g[0])) + 1, len(t))

    def table(self, t: np.ndarray, g: np.ndarray) -> tuple:
        n, end = self._domain(t, g), _ends(self.jumps(t, g))
        return int(t[-1]), int(g[-1]), t[:n], g[:n], t[end[:n]], g[end[:n]]

    def kept(self, t: np.ndarray, g: np.ndarray, last: tuple[int, int] | None) -> list[int]:
        jumps, out = self.jumps(t, g).tolist(), []
        i = 0 if last is None else int(self._after(t, g, *last))
        while i < len(t):
            out.append(i)
            i = jumps[i]
        return out

    def composed(self, parts: list[tuple]) -> tuple:
        """One table for neighbouring spans in order."""
        last_t, last_g = (np.array([p[x] for p in parts]) for x in (0, 1))
        exits: list[tuple[np.ndarray, np.ndarray]] = [(p[4].copy(), p[5].copy()) for p in parts]
        for k in range(len(parts) - 2, -1, -1):
            out_t, out_g = exits[k]
            target = np.maximum(self._after(last_t, last_g, out_t, out_g), k + 1)
            for j in np.unique(target[target < len(parts)]).tolist():
                here = np.flatnonzero(target == j)
                at = self._after(parts[j][2], parts[j][3], out_t[here], out_g[here])
                out_t[here], out_g[here] = exits[j][0][at], exits[j][1][at]
        t, g = (np.concatenate([p[x] for p in parts]) for x in (2, 3))
        n = self._domain(t, g)
        return int(last_t[-1]), int(last_g[-1]), t[:n], g[:n], *(np.concatenate([e[x] for e in exits])[:n] for x in (0, 1))

    def states(self, parts: list[tuple], last: tuple[int, int] | None) -> list[tuple[int, int] | None]:
        """Last kept event before each of the spans."""
        out = []
        for last_t, last_g, t, g, exit_t, exit_g in parts:
            out.append(last)
            if last is None or (last_t >= last[0] + self.gap and (not self.once or last_g > last[1])):
                i = 0 if last is None else int(self._after(t, g, *last))
                last = int(exit_t[i]), int(exit_g[i])
        return out


def _parts(table: pa.Table) -> list[tuple]:
    columns = [table.column(c).to_pylist() for c in ("last_t", "last_g")]
    lists = [[x.values.to_numpy() for x in table.column(c)] for c in ("entry_t", "entry_g", "exit_t", "exit_g")]
    return list(zip(*columns, *lists))


def _state_columns(states: list[tuple[int, int] | None]) -> list[pa.Array]:
    return [pa.array([None if s is None else s[x] for s in states], pa.int64()) for x in (0, 1)]


def in_order(df: DataFrame, keys: Sequence[str], ts: str, tie: str, rows: int | None = None) -> DataFrame:
    """``df`` (stored) in slices of each key by time and ``tie``, a unique column; rows without a time are left out. For ``mark_kept``."""
    return place(df.filter(F.col(ts).isNotNull()).withColumn("_at", us(ts)), keys, ["_at", tie], rows)


def mark_kept(events: DataFrame, keys: Sequence[str], min_gap_s: float, among: Column, out: str, once_per: str | None = None, fan: int = FAN) -> DataFrame:
    """Rows of ``in_order`` with ``out``: true where a row of ``among`` is kept, at least ``min_gap_s`` after the previous kept one of its key.

    ``once_per`` names a column of episode numbers that never fall; at most one row of an episode is kept.
    """
    rule, own = Keep(micros(min_gap_s), once_per is not None), events.columns
    key_ddl = "".join(f"`{k}` {events.schema[k].dataType.simpleString()}, " for k in keys)
    span_ddl, state_ddl = f"{key_ddl}_slice long, {_TABLE}", f"{key_ddl}_slice long, _in_t long, _in_g long"
    flagged = events.withColumns({"_among": F.coalesce(among, F.lit(False)), "_ep": (F.col(once_per) if once_per else F.lit(0)).cast("long")})

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("_at").to_numpy(), rule.episodes(table.column("_ep").to_numpy())

    def span_row(head: pa.Table, number: int, values: tuple) -> pa.Table:
        columns = {k: head.column(k).slice(0, 1) for k in keys} | {"_slice": pa.array([number], pa.int64())}
        for name, v in zip(("last_t", "last_g", "entry_t", "entry_g", "exit_t", "exit_g"), values):
            columns[name] = pa.array([v], pa.int64()) if isinstance(v, int) else pa.array([v], pa.list_(pa.int64()))
        return pa.table(columns)

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        return span_row(table, table.column("_slice")[0].as_py(), rule.table(*arrays(table)))

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        return span_row(table, table.column("_group")[0].as_py(), rule.composed(_parts(table)))

    def hand_down(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        before = table.column("_in_t")[0].as_py(), table.column("_in_g")[0].as_py()
        states = rule.states(_parts(table), None if before[0] is None else before)
        return pa.table({k: table.column(k) for k in keys} | {"_slice": table.column("_slice")} | dict(zip(("_in_t", "_in_g"), _state_columns(states))))

    def replay(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        mine = np.flatnonzero(table.column("_among").to_numpy())
        before = table.column("_in_t")[0].as_py(), table.column("_in_g")[0].as_py()
        t, g = (x[mine] for x in arrays(table))
        yes = np.zeros(len(table), dtype=bool)
        yes[mine[rule.kept(t, g, None if before[0] is None else before)]] = True
        return table.select(own).append_column(out, pa.array(yes))

    nothing = {"_in_t": F.lit(None).cast("long"), "_in_g": F.lit(None).cast("long")}
    group = F.floor(F.col("_slice") / fan).cast("long")
    if events.filter("_slice > 0").isEmpty():
        entered = flagged.withColumns(nothing)
    else:
        # slices without a row of ``among`` change nothing, so they may be missing from the tables
        levels = [durable(flagged.filter("_among").groupBy(*keys, "_slice").applyInArrow(summarise, span_ddl))]
        while not levels[-1].filter("_slice > 0").isEmpty():
            levels.append(durable(levels[-1].withColumn("_group", group).groupBy(*keys, "_group").applyInArrow(compose, span_ddl)))
        state = levels[-1].select(*keys, "_slice").withColumns(nothing)
        for level in reversed(levels[:-1]):
            told = _attach(level.withColumn("_group", group), state.withColumnRenamed("_slice", "_group"), [*keys, "_group"])
            state = told.groupBy(*keys, "_group").applyInArrow(hand_down, state_ddl)
        entered = _attach(flagged, durable(state), [*keys, "_slice"])
    return entered.groupBy(*keys, "_slice").applyInArrow(replay, T.StructType([*events.schema, T.StructField(out, T.BooleanType())]))


def thin(df: DataFrame, keys: Sequence[str], ts: str, tie: str, min_gap_s: float, once_per: str | None = None, rows: int | None = None, fan: int = FAN) -> DataFrame:
    """Rows kept when each kept row is at least ``min_gap_s`` after the previous kept one of its key.

    ``once_per``: see ``mark_kept``. ``tie`` is a unique column that orders rows of equal time. Rows without a time are left out.
    ``rows`` of a key make a slice, ``fan`` slices a group.
    """
    marked = mark_kept(in_order(df, keys, ts, tie, rows), keys, min_gap_s, F.lit(True), "_kept", once_per, fan)
    return marked.filter("_kept").select(df.columns)
