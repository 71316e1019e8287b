"""Sharding by histogram sort.

Rows are ordered by a 128-bit key, the hash of the text and then of the id.
Splitters between shards are found by counting: each round counts, over all
partitions, the exact bytes below a set of candidate boundaries, and refines
the probes only where the best boundary still misses its target by more than
the tolerance. When every splitter meets it the rows are exchanged once.

A round returns at most (shards - 1) x 4096 counters to the driver. Boundaries
fall between groups of equal texts until a single group is heavier than the
tolerance; then the id's half of the key splits that group.

DataFrame operations only.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import table, written

SHARDS = 24
TOLERANCE = 0.01
LEAST = -(1 << 63)
#: Rows aimed at in a cell, the unit of the exchange.
CELL_ROWS = 50_000
#: A cell is never split for fewer rows than four times these.
HEAVY_ROWS = 200


def _unsigned(k: Column) -> Column:
    """Flip the sign bit so that bits rise as the signed number does."""
    return k.bitwiseXOR(F.lit(LEAST))


def _signed(prefix: int, length: int) -> int:
    return prefix - (1 << 64) if length == 64 and prefix >> 63 else prefix


class _Bracket(NamedTuple):
    """Keys whose half (0: k1, 1: k2 where k1 is fixed) starts with `prefix` of `length` bits."""

    half: int = 0
    fixed: int = 0
    prefix: int = 0
    length: int = 0

    @property
    def bits(self) -> int:
        return min(8 if self.length < 16 else 12, 64 - self.length)

    def holds(self) -> Column:
        own = F.lit(True)
        if self.length:
            own = F.shiftrightunsigned(_unsigned(F.col(("k1", "k2")[self.half])), 64 - self.length) == _signed(self.prefix, self.length)
        return own & (F.col("k1") == self.fixed) if self.half else own

    def digit(self) -> Column:
        moved = F.shiftrightunsigned(_unsigned(F.col(("k1", "k2")[self.half])), 64 - self.length - self.bits)
        return moved.bitwiseAND(F.lit((1 << self.bits) - 1))

    def edge(self, digit: int) -> tuple[int, int]:
        """The least key whose next digit is this one or, at 2^bits, lies beyond the bracket."""
        at = ((self.prefix << self.bits) + digit) << (64 - self.length - self.bits)
        if not self.half:
            return (LEAST + at, LEAST) if at < 1 << 64 else (-LEAST - 1, -LEAST - 1)
        return (self.fixed, LEAST + at) if at < 1 << 64 else (self.fixed + 1, LEAST)

    def inner(self, digit: int, least: int, most: int) -> _Bracket:
        if not self.half and least == most:  # one text: go on with the ids
            return _Bracket(1, least)
        return _Bracket(self.half, self.fixed, (self.prefix << self.bits) + digit, self.length + self.bits)


def find_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """shards - 1 keys (k1, k2); a row belongs to the shard of the last one not above it.

    keys has (k1, k2, size). No rows: every splitter is the least key. A
    splitter that no key can bring within the tolerance takes the nearest one.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    allowed = tolerance * total / shards
    #: per open splitter: its bracket, the bytes below that, and the best error and key so far
    at = {i: (_Bracket(), 0, (float("inf"), (LEAST, LEAST))) for i in range(1, shards)} if total else {}
    found: dict[int, tuple[int, int]] = {}
    while at:
        brackets = sorted({b for b, _, _ in at.values()})
        group = digit = None
        for g, b in enumerate(brackets):
            group = F.when(b.holds(), F.lit(g)) if group is None else group.when(b.holds(), F.lit(g))
            digit = F.when(b.holds(), b.digit()) if digit is None else digit.when(b.holds(), b.digit())
        counted = keys.select(group.alias("g"), digit.alias("digit"), "k1", "k2", "size").where("g is not null").groupBy("g", "digit")
        counted = counted.agg(F.sum("size"), F.min("k1"), F.max("k1"), (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2")))
        histogram: dict[int, list[tuple]] = defaultdict(list)
        for g, *counts in counted.collect():  # at most (shards - 1) x 4096 rows
            histogram[g].append(tuple(counts))
        still = {}
        for i, (bracket, below, best) in at.items():
            target, inside = i * total / shards, None
            for d, size, least, most, one in sorted(histogram[brackets.index(bracket)]):
                best = min(best, (abs(below - target), bracket.edge(d)), (abs(below + size - target), bracket.edge(d + 1)))
                if below <= target < below + size and not one and bracket.length + bracket.bits < 64 * (1 + (bracket.half == 0)):
                    inside = (bracket.inner(d, least, most), below)
                below += size
            if best[0] <= allowed or inside is None:
                found[i] = best[1]
            else:
                still[i] = (*inside, best)
        at = still
    return sorted(found.get(i, (LEAST, LEAST)) for i in range(1, shards))


def _shard(splitters: list[tuple[int, int]]) -> Column:
    n = F.lit(0)
    for hi, lo in splitters:
        n = n + ((F.col("k1") > hi) | ((F.col("k1") == hi) & (F.col("k2") >= lo))).cast("int")
    return n


def assign_shards(df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, fixed_bytes: int = 8) -> DataFrame:
    """df with `shard` (0 to shards-1) and `slot` (gapless from 0 within the shard).

    Shards are near equal in bytes: UTF-8 bytes of the text (null: none) plus
    fixed_bytes a row; an empty or very long text is a row like any other, and
    a row larger than a shard's share stays whole. A null id is an id of its
    own. Slots follow the order of cells, then of the key, then of a hash of
    the whole row (columns that can't be hashed left out), so that only rows
    equal in all columns are interchangeable. Rows that agree in id and text
    stay in one shard and take neighbouring slots. Columns of df named shard or
    slot are replaced. Empty tables give no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = [c for c in df.columns if c not in ("shard", "slot")]
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in names and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    keyed = df.select(F.xxhash64(body).alias("k1"), F.xxhash64(F.col(key).cast("string")).alias("k2"), (F.octet_length(body) + fixed_bytes).cast("long").alias("size"), F.xxhash64(*hashed).alias("k3"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_mr_row"))
    keys = written(keyed.select("k1", "k2", "size"))
    splitters = find_splitters(keys, shards, tolerance)
    rows = keys.count()
    bits = min(20, max(8, (rows // CELL_ROWS).bit_length()))

    # A cell is a shard's rows of one prefix of k1; heavy ones also take bits of k2, so many that even all rows of one text fall into small cells.
    c1 = F.shiftrightunsigned(_unsigned(F.col("k1")), 64 - bits)
    b2 = F.shiftrightunsigned(_unsigned(F.col("k2")), 64 - bits)
    heavy = 4 * max(rows / (1 << bits), HEAVY_ROWS)
    cells = keys.select(_shard(splitters).alias("shard"), c1.alias("c1"), b2.alias("b2")).groupBy("shard", "c1", "b2").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("c2", F.when(F.sum("n").over(Window.partitionBy("shard", "c1")) > heavy, F.col("b2")).otherwise(F.lit(-1)))
    cells = cells.groupBy("shard", "c1", "c2").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("c1", "c2")) - F.col("n")
    cells = written(cells.select("shard", "c1", "c2", before.alias("before")))

    placed = keyed.select("k1", "k2", "k3", "_mr_row", _shard(splitters).alias("shard"), c1.alias("c1"), b2.alias("b2"))
    heavy_cells = cells.where("c2 >= 0").select(F.col("shard").alias("hs"), F.col("c1").alias("h1")).distinct()
    placed = placed.join(heavy_cells, (F.col("shard") == F.col("hs")) & (F.col("c1") == F.col("h1")), "left").withColumn("c2", F.when(F.col("h1").isNotNull(), F.col("b2")).otherwise(F.lit(-1)))
    own = Window.partitionBy("shard", "c1", "c2").orderBy("k1", "k2", "k3")
    numbered = placed.withColumn("nth", F.row_number().over(own)).join(cells, ["shard", "c1", "c2"])
    return numbered.select("_mr_row.*", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law of near-equal bytes.

    A null text has no bytes beside the 8 that every row has, and an empty one
    neither; null ids and repeated rows have slots of their own; equal texts lie
    together until they are heavier than the tolerance; a very long text is one
    row and may outweigh a shard's share; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    shaped = docs.withColumn("size", (F.octet_length(body) + 8).cast("long")).withColumn("text_crc32", F.crc32(body))
    return assign_shards(shaped).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
