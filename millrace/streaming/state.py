"""Keyed state with lifetimes and timers. Streams only; the session needs the RocksDB state store (state_session()).

Rows pass as they are (no batch changes the type of an id), one by one. The
state of a key is bounded in each operator, and a lifetime removes it once the
key has been silent for so long; a row of the key begins the lifetime anew.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

#: What a session needs for this module.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY_MS = 24 * 3600 * 1000


def _kept(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: StructType, mode: str = "append") -> DataFrame:
    return df.groupBy(*keys).transformWithState(processor, schema, mode, "ProcessingTime")


class _FirstDay(StatefulProcessor):
    def __init__(self, day: str, names: list[str], ttl: int | None):
        self.day, self.names, self.ttl = day, names, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "day date", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(rows)
        days = [r[self.day] for r in held if r[self.day] is not None]
        if self.first.exists():
            days.append(self.first.get()[0])
        first = min(days, default=None)
        if first is not None:
            self.first.update((first,))
        for r in held:
            yield Row(**{n: int(r[self.day] is not None and r[self.day] == first) if n == "is_new" else r[n] for n in self.names})


def first_visits(df: DataFrame, device: str, day: str, *, lifetime_ms: int | None = DAY_MS) -> DataFrame:
    """df with is_new: 1 on the earliest day that its device has been seen on so far, else 0; rows without a day have 0.

    One date is kept per device, until lifetime_ms have gone by without a row of
    it (None: for good). A task holds a device's rows of one micro-batch, which
    the source's bound on a batch limits.
    """
    schema = StructType([*[f for f in df.schema.fields if f.name != "is_new"], StructField("is_new", IntegerType())])
    return _kept(df, [device], _FirstDay(day, schema.fieldNames(), lifetime_ms), schema)


class _Newest(StatefulProcessor):
    def __init__(self, version: str, arrival: list[str], ttl: int):
        self.version, self.arrival, self.ttl = version, arrival, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "version long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        highest = self.highest.get()[0] if self.highest.exists() else None
        some = [r for r in rows if r[self.version] is not None]
        for r in sorted(some, key=lambda r: [(r[c] is None, r[c]) for c in self.arrival]):
            if highest is None or r[self.version] > highest:
                highest = r[self.version]
                yield r
        if some:
            self.highest.update((highest,))


def newest_versions(df: DataFrame, key: str, version: str, arrival: list[str], *, lifetime_ms: int = DAY_MS) -> DataFrame:
    """Rows whose version (a long) is above all that arrived before for their key; rows without a version go.

    Rows of one micro-batch are taken in order of the arrival columns. One
    number is kept per key, for lifetime_ms after its last row. A task holds a
    key's rows of one micro-batch.
    """
    return _kept(df, [key], _Newest(version, arrival, lifetime_ms), df.schema)


class _Windows(StatefulProcessor):
    def __init__(self, keys: list[str], value: str, width: int):
        self.keys, self.value, self.width = keys, value, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "n long, total double, least double, most double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        start = now - now % self.width
        n, total, least, most = self.open.getValue((start,)) if self.open.containsKey((start,)) else (0, 0.0, None, None)
        for r in rows:
            n += 1
            v = r[self.value]
            if v is not None:
                total, least, most = total + float(v), v if least is None else min(least, v), v if most is None else max(most, v)
        self.open.updateValue((start,), (n, total, least, most))
        self.handle.registerTimer(start + self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.width
        if self.open.containsKey((start,)):
            n, total, least, most = self.open.getValue((start,))
            self.open.removeKey((start,))
            yield Row(**dict(zip(self.keys, key, strict=True)), window_start_ms=start, window_end_ms=start + self.width, n=n, total=total, least=least, most=most)


def arrival_windows(df: DataFrame, keys: list[str], value: str, *, width_ms: int = 10_000) -> DataFrame:
    """Tumbling windows by processing time: (keys, window_start_ms, window_end_ms, n, total, least, most).

    A row belongs to the window in which its micro-batch begins. A timer closes
    the window at its end by the clock, whether rows come or not, gives it out
    once and removes its state; a key holds a window or two at a time.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{fields}, window_start_ms long, window_end_ms long, n long, total double, least double, most double")
    return _kept(df.withColumn(value, df[value].cast("double")), keys, _Windows(keys, value, width_ms), schema)


class _Phase(StatefulProcessor):
    def __init__(self, columns: list[str], key: str, silence: int, ttl: int):
        self.columns, self.key, self.silence, self.ttl = columns, key, silence, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "begun boolean, over boolean, due long", self.ttl)

    def _completed(self, key) -> Row:
        return Row(**dict.fromkeys(self.columns), phase="completed") if self.key not in self.columns else Row(**{c: key[0] if c == self.key else None for c in self.columns}, phase="completed")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        begun, over, due = self.state.get() if self.state.exists() else (False, False, 0)
        live = False
        for r in rows:
            old = r["op"] == "r" or bool(r["source"] and str(r["source"]["snapshot"]).lower() == "true")
            begun, live = begun or old, live or not old
            if old:
                yield Row(**{c: r[c] for c in self.columns}, phase="snapshot")
        if live and not over:
            yield self._completed(key)
        over = over or live
        if not over:
            due = timerValues.getCurrentProcessingTimeInMs() + self.silence
            self.handle.registerTimer(due)
        self.state.update((begun, over, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        begun, over, due = self.state.get() if self.state.exists() else (False, True, 0)
        # A later row has set a later timer.
        if begun and not over and expiredTimerInfo.getExpiryTimeInMs() >= due:
            self.state.update((begun, True, due))
            yield self._completed(key)


def snapshot_phases(changes: DataFrame, key: str, *, silence_ms: int = 15_000, lifetime_ms: int = DAY_MS) -> DataFrame:
    """A stream's snapshot rows, phase `snapshot`, and per key one row, phase `completed`, when its snapshot is over.

    It is over with the first live row, or after a silence that follows snapshot
    rows. Live rows don't pass. changes has op and source; the row that marks
    the end has its key only. A key is forgotten after lifetime_ms without a
    row, ended ones too.
    """
    schema = StructType([*changes.schema.fields, StructField("phase", StringType())])
    return _kept(changes, [key], _Phase(changes.columns, key, silence_ms, lifetime_ms), schema)


def bloom_size(items: int, error: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter that holds so many items with this share of false hits at most."""
    bits = math.ceil(-items * math.log(error) / math.log(2) ** 2)
    return 8 * math.ceil(bits / 8), max(1, round(bits / items * math.log(2)))


class _Bloom(StatefulProcessor):
    """Two generations of bits: both are asked, the younger learns, and when it is full the older one goes."""

    def __init__(self, columns: list[str], items: int, error: float, ttl: int, names: list[str], held: str | None):
        self.columns, self.items, self.ttl, self.names, self.held = columns, items, ttl, names, held
        # A row asks two filters, so each has half of the error.
        self.bits, self.hashes = bloom_size(items, error / 2)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filters = handle.getValueState("filters", "young binary, old binary, n long", self.ttl)

    def _places(self, row: Row) -> list[int]:
        text = "\x1f".join("" if row[c] is None else f"{len(str(row[c]))}:{row[c]}" for c in self.columns)
        digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
        a, b = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big") | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        blank = bytes(self.bits // 8)
        young, old, n = self.filters.get() if self.filters.exists() else (blank, blank, 0)
        young = bytearray(young)
        has = lambda bits, places: all(bits[p >> 3] >> (p & 7) & 1 for p in places)
        for r in rows:
            places = self._places(r)
            known = has(young, places)
            if not known and has(old, places):
                known = True
            if self.held:
                yield Row(**{c: r[c] for c in self.names}, **{self.held: known})
            elif not known:
                yield r
            if not has(young, places):
                if n >= self.items:
                    young, old, n = bytearray(blank), bytes(young), 0
                for p in places:
                    young[p >> 3] |= 1 << (p & 7)
                n += 1
        self.filters.update((bytes(young), bytes(old), n))


def drop_repeats_roughly(df: DataFrame, keys: list[str], slot: str, *, items: int = 20_000, error: float = 0.01, lifetime_ms: int = DAY_MS, held: str | None = None) -> DataFrame:
    """Rows whose keys their slot has not seen lately, by Bloom filters of bounded size.

    Every value of `slot`, a number that a hash of the keys gives, has two
    generations of bits. A repeat among the last `items` different keys of its
    slot never passes; a row with new keys is dropped with a chance of `error`
    at most. The state takes about 2.6 bytes an item and slot at one per cent,
    however many rows come, and goes lifetime_ms after a slot's last row. Null is a
    value like any other. With `held` all rows pass, and this column says whether
    one would have been dropped, for an exact check of those.
    """
    schema = StructType([*df.schema.fields, StructField(held, BooleanType())]) if held else df.schema
    return _kept(df, [slot], _Bloom(keys, items, error, lifetime_ms, df.columns, held), schema)
