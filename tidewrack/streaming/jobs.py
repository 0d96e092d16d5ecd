"""Streaming twins of the batch rules: event time, watermarks and keyed state.

Every function takes a streaming DataFrame and returns one (or starts a sink),
and gives the rows the batch function gives once the watermark has passed them;
rows of a key may arrive in any order within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewrack.functions.columns import dew_point_c, stem_date
from tidewrack.operators import rollups as R
from tidewrack.operators.grids import detect
from tidewrack.operators.joins import attach_metadata, new_only
from tidewrack.operators.series import DEW_RISE_C, DOWN_COOLDOWN_S, PRESSURE_SHIFT_MBAR, STALE_READS, STALE_S
from tidewrack.operators.slices import micros, us
from tidewrack.session import durable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    """Keyed processors keep their state in RocksDB, on disk and in the checkpoint folder."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


# ---- windows ----------------------------------------------------------------------------------------------------


def stream_device_rollup(samples: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts", **spec) -> DataFrame:
    """Device roll-up; a window is emitted once the watermark has passed it, later rows are dropped."""
    return R.device_rollup(samples.withWatermark(ts, delay), keys, ts, **spec)


def stream_environment_rollup(samples: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts", **spec) -> DataFrame:
    return R.environment_rollup(samples.withWatermark(ts, delay), keys, ts, **spec)


def stream_rolling(crops: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts", width: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Crops per sliding window. The exact per-row count stays a batch job."""
    out = crops.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width, step).alias("_w")).agg(F.count(F.lit(1)).alias("crops"))
    return out.select(*keys, F.col("_w.end").alias("window_end"), "crops")


def stream_daily(crops: DataFrame, species: str, delay: str, ts: str = "ts", label: str = "class_label") -> DataFrame:
    """Crops per UTC day and how many are of one class."""
    out = crops.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("crops"), F.count_if(F.col(label) == species).alias("of_class"))
    return out.select(F.to_date("_w.start").alias("date"), "crops", "of_class")


def stream_dedup(crops: DataFrame, key: Sequence[str], delay: str, ts: str = "ts") -> DataFrame:
    """Each item once, also across restarts, as long as its copies are within ``delay``."""
    return crops.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


# ---- keyed state ------------------------------------------------------------------------------------------------


#: Time span of a packet of waiting rows, rows gathered before they are dealt to packets, and before they are taken.
PACKET_US, GATHERED, TAKEN = 3_600_000_000, 100_000, 20_000


class EventOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, and hands them on in event order.

    A row arrives at most ``delay`` late, so a row at or below the watermark has
    nothing before it still to come. A timer at the earliest waiting row wakes the key. Rows wait in packets of
    ``PACKET_US`` of event time, a column being one array, and are taken a few packets at a time: neither the rows of a key
    in a batch nor those that wait are ever held together. Subclasses give
    ``waiting`` (columns of a waiting row, t_us first, then the tie), ``kept`` (schema of what they remember) and ``take``,
    which turns sorted arrays and what was kept into output columns and what is kept next; it is called once or more for
    the rows of a timer, perhaps without rows. Rows without time are dropped.
    """

    waiting: str
    kept: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = ", ".join(f"{n} array<{kind}>" for n, kind in (c.split(" ", 1) for c in self.waiting.split(", ")))
        self.packets = handle.getMapState("packets", "span long, part long", packed)
        self.parts = handle.getValueState("parts", "n long")
        self.memory = handle.getValueState("kept", self.kept)

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.waiting.split(", ")]

    def _wake(self, due_us: list[int], watermark_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due_us:
            self.handle.registerTimer(max(min(due_us) // 1000 + 1, watermark_ms + 1))

    def due(self, kept) -> int | None:
        """A time at which the key acts without a row."""
        return None

    def _times(self, first_us: int | None, kept) -> list[int]:
        return [x for x in (first_us, self.due(kept)) if x is not None]

    def _pack(self, pdf: pd.DataFrame, part: int) -> None:
        """Store rows as part ``part`` of their packets."""
        span = pdf["t_us"].to_numpy(dtype=np.int64) // PACKET_US
        order = np.argsort(span, kind="stable")
        span, values = span[order], [_plain(pdf[c].iloc[order]) for c in self.columns]
        starts = np.flatnonzero(np.diff(span, prepend=span[0] - 1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(span)]):
            self.packets.updateValue((int(span[a]), part), tuple(v[a:b] for v in values))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = self.parts.get()[0] if self.parts.exists() else 0
        earliest = [t * 1000 - 1000 for t in self.handle.listTimers()]
        for pdf in gathered((b.loc[b["t_us"].notna(), self.columns] for b in rows), GATHERED):
            earliest.append(int(pdf["t_us"].min()))
            self._pack(pdf, part)
            part += 1
        self.parts.update((part,))
        self._wake([min(earliest)] if earliest else [], timerValues.getCurrentWatermarkInMs())
        yield self.frame(key, {})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.memory.get() if self.memory.exists() else None
        packets: dict[int, list[int]] = {}
        for span, part in self.packets.keys():
            packets.setdefault(span, []).append(part)
        held, n, first = [], 0, None
        for span in sorted(packets):
            if span * PACKET_US > mark:
                first = first if first is not None else span * PACKET_US
                break
            places = [(span, part) for part in sorted(packets[span])]
            values = [self.packets.getValue(place) for place in places]
            pdf = pd.DataFrame({c: [x for v in values for x in v[i]] for i, c in enumerate(self.columns)}).sort_values(self.columns[:2], kind="stable", ignore_index=True)
            ready = (pdf["t_us"] <= mark).to_numpy(dtype=bool)
            for place in places:
                self.packets.removeKey(place)
            if not ready.all():
                rest = pdf[~ready]
                first = int(rest["t_us"].iloc[0])
                self._pack(rest, places[0][1])
            held.append(pdf[ready])
            n += len(held[-1])
            if n >= TAKEN:
                now = pd.concat(held, ignore_index=True)
                out, kept = self.take(now, kept, int(now["t_us"].iloc[-1]))
                yield self.frame(key, out)
                held, n = [], 0
        out, kept = self.take(pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: [] for c in self.columns}), kept, mark)
        if kept is not None:
            self.memory.update(kept)
        self._wake(self._times(first, kept), timerValues.getCurrentWatermarkInMs())
        yield self.frame(key, out)

    def frame(self, key, out: dict) -> pd.DataFrame:
        """Output columns behind the key's."""
        found = pd.DataFrame({n: pd.Series(out.get(n, []), dtype=object) for n in self.out})
        for name, value in zip(reversed(self.keys), reversed(key)):
            found.insert(0, name, value)
        return found

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """Values as state takes them: plain ones, lists, and None."""
    known = column.astype(object).where(column.notna(), None)
    return [v.tolist() if hasattr(v, "tolist") else v for v in known]


def _records(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(*(_plain(pdf[c]) for c in pdf.columns)))


def gathered(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in pieces of ``least`` and a little more; the last may be smaller."""
    held, n = [], 0
    for pdf in frames:
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
        if n >= least:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def spaced(times: np.ndarray, gap: int, last: int | None) -> np.ndarray:
    """Places of sorted times that are kept when each kept one silences the ``gap`` behind it; one step per kept time."""
    kept = []
    at = 0 if last is None else int(np.searchsorted(times, last + gap))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return np.array(kept, dtype=np.int64)


def run_lengths(yes: np.ndarray, before: int) -> np.ndarray:
    """Successive true values up to each place; ``before`` of them precede the first."""
    n = np.arange(1, len(yes) + 1)
    return n - np.maximum.accumulate(np.where(yes, -before, n)) if len(yes) else n


def next_known(values: np.ndarray) -> np.ndarray:
    """Place of the first number at or behind each place (the length where there is none)."""
    places = np.where(np.isnan(values), len(values), np.arange(len(values)))
    return np.minimum.accumulate(places[::-1])[::-1]


def _numbers(column: pd.Series) -> np.ndarray:
    return pd.to_numeric(column, errors="coerce").to_numpy(dtype=np.float64)


class LeakAlerts(EventOrder):
    """Kept per key: length of the run of leak reads, last alert of each tier, samples of the trailing window."""

    kept = "run long, critical long, warning long, t array<long>, dew array<double>, pressure array<double>"

    def __init__(self, keys, tie, tie_type, k, window_s, cooldown_s, dew_rise, pressure_shift):
        self.keys, self.tie, self.k = list(keys), tie, k
        self.waiting = f"t_us long, {tie} {tie_type}, leak_in boolean, dew_in double, p_in double"
        self.out = [tie, "tier"]
        self.window, self.cooldown = micros(window_s), micros(cooldown_s)
        self.dew_rise, self.pressure_shift = dew_rise, pressure_shift

    def take(self, new: pd.DataFrame, kept, mark: int):
        run, critical, warning, *past = kept if kept is not None else (0, None, None, [], [], [])
        old_t, old_dew, old_p = (np.asarray(x, dtype=k) for x, k in zip(past, (np.int64, np.float64, np.float64)))
        t = new["t_us"].to_numpy(dtype=np.int64)
        runs = run_lengths(new["leak_in"].fillna(False).to_numpy(dtype=bool), run)
        sent = np.zeros(len(t), dtype=bool)
        due = np.flatnonzero(runs >= self.k)
        sent[due[spaced(t[due], self.cooldown, critical)]] = True
        # The trend is read over what was kept and what is new, as arrays.
        times = np.concatenate([old_t, t])
        dew, p = np.concatenate([old_dew, _numbers(new["dew_in"])]), np.concatenate([old_p, _numbers(new["p_in"])])
        here = np.arange(len(old_t), len(times))
        start = np.searchsorted(times, t - self.window)
        known = ~np.isnan(dew[here]) & ~np.isnan(p[here]) & (2 * (t - times[start]) >= self.window)
        # Where the sample itself is known, something known stands at or behind the start of its window.
        a, b = (np.minimum(next_known(x)[start], len(times) - 1) for x in (dew, p))
        with np.errstate(invalid="ignore"):
            moved = known & (dew[here] - dew[a] >= self.dew_rise) & (np.abs(p[here] - p[b]) >= self.pressure_shift)
        due = np.flatnonzero(moved & ~sent)
        warned = due[spaced(t[due], self.cooldown, warning)]
        first = np.flatnonzero(sent)
        item = new[self.tie].to_numpy()
        if len(t):
            run = int(runs[-1])
            critical = int(t[first[-1]]) if len(first) else critical
            warning = int(t[warned[-1]]) if len(warned) else warning
            stay = times >= t[-1] - self.window
            times, dew, p = times[stay], dew[stay], p[stay]
        alerts = {self.tie: [*item[first], *item[warned]], "tier": ["critical"] * len(first) + ["warning"] * len(warned)}
        return alerts, (run, critical, warning, times.tolist(), dew.tolist(), p.tolist())


def stream_leak_alerts(samples: DataFrame, keys: Sequence[str], tie: str, k: int, window_s: float, cooldown_s: float, ts: str = "ts",
                       delay: str = "10 minutes", dew_rise: float = DEW_RISE_C, pressure_shift: float = PRESSURE_SHIFT_MBAR,
                       leak: str = "leak", temp: str = "temp_c", humidity: str = "humidity_pct", pressure: str = "pressure_mbar") -> DataFrame:
    """Alerts of both tiers once the watermark has passed a sample: keys, tie, ``tier``."""
    use_rocksdb(samples)
    rows = samples.withWatermark(ts, delay).select(
        *keys, tie, ts, us(ts).alias("t_us"), F.col(leak).alias("leak_in"), dew_point_c(temp, humidity).cast("double").alias("dew_in"), F.col(pressure).cast("double").alias("p_in"))
    job = LeakAlerts(keys, tie, samples.schema[tie].dataType.simpleString(), k, window_s, cooldown_s, dew_rise, pressure_shift)
    return rows.groupBy(*keys).transformWithStateInPandas(job, f"{_ddl(samples, [*keys, tie])}, tier string", "Append", "EventTime")


class StageAlerts(EventOrder):
    """Kept per stage: length of the run of stale reads, whether down was announced, when last, and the last read.

    A stage that is silent for ``silence_s`` counts as stale at that moment.
    """

    kept = "run long, down boolean, last_down long, seen long"

    def __init__(self, keys, tie, tie_type, stale_s, reads, cooldown_s, silence_s):
        self.keys, self.tie, self.stale_s, self.reads = list(keys), tie, stale_s, reads
        self.waiting = f"t_us long, {tie} {tie_type}, age_in double"
        self.out = [tie, "event"]
        self.cooldown, self.silence = micros(cooldown_s), None if silence_s is None else micros(silence_s)

    def due(self, kept) -> int | None:
        return None if kept is None or self.silence is None or kept[3] is None or kept[1] else kept[3] + self.silence

    def take(self, new: pd.DataFrame, kept, mark: int):
        run, down, last, seen = kept if kept is not None else (0, False, None, None)
        t, item = new["t_us"].to_numpy(dtype=np.int64), new[self.tie].to_numpy(dtype=object)
        fresh = np.nan_to_num(_numbers(new["age_in"]), nan=np.inf) < self.stale_s
        weight = np.ones(len(t), dtype=np.int64)
        if self.silence is not None:
            # A read that does not come is a row of its own, worth as many stale reads as it takes.
            ends = np.concatenate([t if seen is None else np.concatenate([[seen], t]), [mark + 1]])
            quiet = ends[:-1][np.diff(ends) > self.silence] + self.silence
            quiet = quiet[quiet <= mark]
            order = np.argsort(np.concatenate([t, quiet]), kind="stable")
            t, item = np.concatenate([t, quiet])[order], np.concatenate([item, np.full(len(quiet), None, dtype=object)])[order]
            fresh = np.concatenate([fresh, np.zeros(len(quiet), dtype=bool)])[order]
            weight = np.concatenate([weight, np.full(len(quiet), self.reads)])[order]
        events: list[tuple] = []
        edges = np.flatnonzero(np.diff(np.concatenate([[not fresh[0]], fresh, [not fresh[-1]]]).astype(int))) if len(t) else np.zeros(0, dtype=int)
        for a, b in zip(edges[:-1], edges[1:]):  # one step per run of equal state
            if fresh[a]:
                if down:
                    events.append((item[a], "up"))
                run, down = 0, False
                continue
            count = run + np.cumsum(weight[a:b])
            if not down:
                at = max(int(np.searchsorted(count, self.reads)), 0 if last is None else int(np.searchsorted(t[a:b], last + self.cooldown)))
                if at < b - a:
                    down, last = True, int(t[a + at])
                    events.append((item[a + at], "down"))
            run = int(count[-1])
        read = new["t_us"].to_numpy(dtype=np.int64)
        seen = int(read[-1]) if len(read) else seen
        if self.silence is not None and seen is not None and len(t) and t[-1] > seen and not down:
            seen = int(t[-1])  # a silence that the cooldown held back is looked at again later
        return {self.tie: [e[0] for e in events], "event": [e[1] for e in events]}, (run, down, last, seen)

    def frame(self, key, out: dict) -> pd.DataFrame:
        found = super().frame(key, out)
        if self.whole:
            found[self.tie] = found[self.tie].astype("Int64")
        return found

    @property
    def whole(self) -> bool:
        return any(x in self.waiting.split(", ")[1] for x in ("int", "long"))


def stream_stage_alerts(beats: DataFrame, keys: Sequence[str], tie: str, ts: str = "ts", age: str = "age_s", delay: str = "10 minutes",
                        stale_s: float = STALE_S, reads: int = STALE_READS, cooldown_s: float = DOWN_COOLDOWN_S, silence_s: float | None = None) -> DataFrame:
    """Down and up events per stage, once the watermark has passed them. With ``silence_s`` a stage that sends nothing
    for that long (in event time) is announced down by a timer; such rows have no ``tie``."""
    use_rocksdb(beats)
    rows = beats.withWatermark(ts, delay).select(*keys, tie, ts, us(ts).alias("t_us"), F.col(age).cast("double").alias("age_in"))
    job = StageAlerts(keys, tie, beats.schema[tie].dataType.simpleString(), stale_s, reads, cooldown_s, silence_s)
    return rows.groupBy(*keys).transformWithStateInPandas(job, f"{_ddl(beats, [*keys, tie])}, event string", "Append", "EventTime")


class RunningBackground(EventOrder):
    """Kept per camera tile: the current background."""

    kept = "px array<double>"

    def __init__(self, keys, order, order_type, alpha, top):
        self.keys, self.order, self.alpha, self.top = list(keys), order, alpha, top
        self.waiting = f"t_us long, {order} {order_type}, px_in array<double>"
        self.out = [order, "corrected"]

    def take(self, new: pd.DataFrame, kept, mark: int):
        bg = None if kept is None else np.asarray(kept[0], dtype=np.float64)
        out = []
        for px in new["px_in"]:  # a step per frame, each over all its pixels
            frame = np.asarray(px, dtype=np.float64)
            bg = frame.copy() if bg is None else self.alpha * frame + (1 - self.alpha) * bg
            out.append(np.clip(frame - bg, 0, self.top).astype(np.int64))
        return {self.order: new[self.order].tolist(), "corrected": out}, None if bg is None else (bg.tolist(),)


def stream_background(frames: DataFrame, keys: Sequence[str], order: str, alpha: float, top: float, px: str = "px",
                      ts: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Frames minus their running background, per camera and tile, once the watermark has passed them.

    Without ``ts`` the frame number counts as seconds (from day one on, since no watermark lies before day zero).
    """
    use_rocksdb(frames)
    timed = frames.withColumn("_ts", F.col(ts) if ts else F.timestamp_seconds(F.col(order) + 86_400)).withWatermark("_ts", delay)
    rows = timed.select(*keys, order, "_ts", us("_ts").alias("t_us"), F.col(px).cast("array<double>").alias("px_in"))
    job = RunningBackground(keys, order, frames.schema[order].dataType.simpleString(), alpha, top)
    return rows.groupBy(*keys).transformWithStateInPandas(job, f"{_ddl(frames, [*keys, order])}, corrected array<long>", "Append", "EventTime")


class FrameAssembly(StatefulProcessor):
    """Kept per frame: its tiles so far, a bitmap of their slots, and when it is released at the latest.

    A frame is released once, with all its tiles in one batch: as ``complete`` when every
    slot is filled, else as ``partial`` when the watermark passes the deadline. Tiles that
    fill another slot afterwards are handed on as ``late``; a slot sent again is dropped.
    """

    def __init__(self, frame: str, tile: Sequence[str], ddl: str, wait_ms: int, remember_ms: int):
        self.key_name, self.tile, self.ddl, self.wait, self.remember = frame, list(tile), ddl, wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tiles = handle.getListState("tiles", self.ddl)
        self.state = handle.getValueState("state", "seen binary, due long, released boolean")

    def _alarm(self, at_ms: int, watermark_ms: int) -> int:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        at_ms = max(at_ms, watermark_ms + 1)
        self.handle.registerTimer(at_ms)
        return at_ms

    def _out(self, key, rows: pd.DataFrame, status: str) -> pd.DataFrame:
        out = rows[self.tile].astype(object).where(rows[self.tile].notna(), None)
        out.insert(0, self.key_name, key[0])
        return out.assign(status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["at_slot", "sent_ms", *self.tile], kind="stable", ignore_index=True)
        mark = timerValues.getCurrentWatermarkInMs()
        seen, due, released = self.state.get() if self.state.exists() else (b"", None, False)
        slots = new["at_slot"].to_numpy(dtype=np.int64)
        filled = np.unpackbits(np.frombuffer(bytes(seen), dtype=np.uint8))
        filled = np.concatenate([filled, np.zeros(max(0, int(slots[-1]) + 1 - len(filled)), dtype=np.uint8)])
        first = np.concatenate([[True], slots[1:] != slots[:-1]]) & (filled[slots] == 0)
        new, filled[slots] = new[first], 1
        packed = np.packbits(filled).tobytes()
        if released:
            self.state.update((packed, due, True))
            yield self._out(key, new, "late")
        elif len(new) and filled.sum() >= new["of_slots"].max():
            held = pd.DataFrame(list(self.tiles.get()) if self.tiles.exists() else [], columns=self.tile)
            self.tiles.clear()
            self.state.update((packed, self._alarm((due or mark) + self.remember, mark), True))
            yield self._out(key, new if held.empty else pd.concat([held, new[self.tile]], ignore_index=True), "complete")
        elif len(new):
            self.tiles.appendList(_records(new[self.tile]))
            latest = int(new["sent_ms"].min()) + self.wait
            if due is None or latest < due:
                due = self._alarm(latest, mark)
            self.state.update((packed, due, False))
            yield self._out(key, new[:0], "")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, due, released = self.state.get()
        if released:
            self.state.clear()
            return
        held = pd.DataFrame(list(self.tiles.get()), columns=self.tile)
        self.tiles.clear()
        self.state.update((bytes(seen), self._alarm(due + self.remember, timerValues.getCurrentWatermarkInMs()), True))
        yield self._out(key, held, "partial")

    def close(self) -> None:
        pass


def assemble_frames(tiles: DataFrame, frame: str, slot: Column, expected: Column, ts: str, delay: str = "1 minute", wait_s: float = 600, remember_s: float = 86_400) -> DataFrame:
    """Tiles with ``status``, handed on when their frame is whole or has waited ``wait_s`` since its first tile.

    ``ts`` is when a tile was sent, ``slot`` its place in the frame (from 0), ``expected`` how
    many slots a frame has. Tiles without frame, slot or time are dropped. A frame is remembered
    for ``remember_s`` after its release; a tile later than that would open it anew.
    """
    use_rocksdb(tiles)
    timed = tiles.withColumns({"at_slot": slot.cast("long"), "of_slots": expected.cast("long")}).filter(F.col(frame).isNotNull() & (F.col("at_slot") >= 0) & F.col(ts).isNotNull())
    own = [c for c in tiles.columns if c != frame]
    rows = timed.withWatermark(ts, delay).withColumn("sent_ms", F.unix_millis(ts))
    job = FrameAssembly(frame, own, _ddl(tiles, own), int(wait_s * 1000), int(remember_s * 1000))
    return rows.groupBy(frame).transformWithStateInPandas(job, f"{_ddl(tiles, [frame, *own])}, status string", "Append", "EventTime")


# ---- sinks ------------------------------------------------------------------------------------------------------


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Write a stream as Parquet with exactly-once files."""
    w = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _replace_batch(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """A replayed batch writes the same partitions again instead of adding rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stream_catalogue(items: DataFrame, sidecars: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    """Add items the catalogue does not hold yet, with their metadata. ``key`` also joins the sidecars."""
    spark = items.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(list(key))
        try:
            # rows of this very batch do not count, so that a replay writes them again
            have = spark.read.parquet(path).filter(F.col("batch") != number)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            have = None
        if have is not None:
            fresh = new_only(fresh, [have], key)
        _replace_batch(attach_metadata(fresh, sidecars, key).withColumn("batch", F.lit(number)), path, ["batch"])

    return each_batch(items, add, checkpoint)


def stream_detect(tiles: DataFrame, path: str, checkpoint: str, frame: str = "frame_id", date: str | None = None, late: str | None = None, **spec) -> StreamingQuery:
    """Detect crops per micro-batch into a dated table, and count late tiles per frame into the table ``late``.

    Tiles of one frame must be in one batch: give the rows of ``assemble_frames``, or tiles that arrive a frame a file.
    """

    def run(batch: DataFrame, number: int) -> None:
        # read several times below; the state behind it must be asked once
        batch = durable(batch)
        if "status" in batch.columns:
            if late is not None:
                missed = batch.filter("status = 'late'").groupBy(frame).agg(F.count(F.lit(1)).alias("late_tiles"))
                _replace_batch(missed.withColumn("batch", F.lit(number)), late, ["batch"])
            batch = batch.filter("status <> 'late'").drop("status")
        found = detect(batch, frame=frame, **spec)
        if date is not None:
            days = batch.groupBy(frame).agg(F.min(stem_date(date)).alias("date"))
            found = found.join(days, frame)
        by = ["date", "batch"] if date is not None else ["batch"]
        _replace_batch(found.withColumn("batch", F.lit(number)), path, by)

    return each_batch(tiles, run, checkpoint)
