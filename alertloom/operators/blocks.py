"""Scans along the rows of a key in order, by blocks, so that no task holds all rows of a busy key.

The rows of a key with many rows are sorted over many tasks and cut into blocks. Each block is scanned by itself and
reduced to one row; those few rows are scanned, and what comes from earlier blocks is carried back into each block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import materialize

#: Rows of a block; keys with more are cut.
BLOCK = 1_000_000
#: Parts by hash in which rows are counted before their keys are.
PARTS = 1 << 16


def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


#: How values are put together along a scan: in a window, and what came earlier (a) with what came later (b).
_HOW: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (_last, lambda a, b: F.coalesce(b, a)),
}


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


@dataclass(frozen=True)
class Blocks:
    """Rows with their block: -1 for all rows of a key that is in one piece. Blocks of a key are numbered in its order."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool

    def scan(self, wanted: dict[str, tuple[str, Column]], backward: bool = False, strict: bool = False) -> Blocks:
        """Adds columns: for each name the values of its key put together up to the row, from the first in order or, backward,
        from the last. Values are put together by sum, xor, max, min or last (the last one that isn't null); nulls are skipped. strict: the row's
        own value doesn't count. Rows of equal order stand in any order.

        What is broadcast has one row a block, that is one for each BLOCK rows of the busy keys."""
        turn = F.desc if backward else F.asc
        local = Window.partitionBy(*self.keys, "_block").orderBy(*map(turn, self.order)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        told = self.rows.withColumns({name: _HOW[how][0](value).over(local) for name, (how, value) in wanted.items()})
        if not self.cut:
            return replace(self, rows=told)
        place = F.struct(*self.order)
        pick = F.min_by if backward else F.max_by

        def whole(how: str, value: Column) -> Column:
            return pick(value, F.when(value.isNotNull(), place)) if how == "last" else _HOW[how][0](value)

        sums = self.rows.filter("_block >= 0").groupBy(*self.keys, "_block").agg(*(whole(*what).alias(f"_of_{name}") for name, what in wanted.items()))
        before = Window.partitionBy(*self.keys).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(*self.keys, "_block", *(_HOW[how][0](F.col(f"_of_{name}")).over(before).alias(f"_of_{name}") for name, (how, _) in wanted.items()))
        joined = told.alias("_scanned").join(F.broadcast(carried.alias("_carried")), _same([*self.keys, "_block"], "_scanned", "_carried"), "left")
        merged = {name: _HOW[how][1](F.col(f"_carried._of_{name}"), F.col(f"_scanned.{name}")).alias(name) for name, (how, _) in wanted.items()}
        return replace(self, rows=joined.select(*(merged.get(c, F.col(f"_scanned.{c}")) for c in told.columns)))

    def ahead(self, name: str, value: Column, most: int) -> Blocks:
        """Adds an array of the next `most` values of the row's key that aren't null, nearest first; the row's own doesn't count.

        All are read in one pass over a key, and no list grows beyond `most`. What is broadcast is one row a block, with the
        first values of the blocks behind it."""
        onward = Window.partitionBy(*self.keys, "_block").orderBy(*self.order)
        nexts = {f"_next{i}": F.expr(f"lead(_own, {i}) IGNORE NULLS").over(onward) for i in range(1, most + 1)}
        told = self.rows.withColumn("_own", value).withColumns(nexts)
        there = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in nexts])
        told = told.withColumn(name, F.slice(F.array(*nexts), F.lit(1), there)).drop("_own", *nexts)
        if not self.cut:
            return replace(self, rows=told)
        front = Window.partitionBy(*self.keys, "_block").orderBy(*self.order)
        many = self.rows.filter("_block >= 0").select(*self.keys, F.col("_block").alias("_at"), "_block", *[c for c in self.order if c not in self.keys], value.alias("_own"))
        firsts = many.filter("_own IS NOT NULL").withColumn("_k", F.row_number().over(front)).filter(F.col("_k") <= most).select(*self.keys, "_at", "_k", "_own")
        ends = many.select(*self.keys, "_at").distinct().withColumns({"_k": F.lit(most + 1), "_own": F.lit(None).cast(firsts.schema["_own"].dataType)})
        few = materialize(firsts.unionByName(ends), "block-heads").withColumn("_block", F.lit(-1))
        behind = Blocks(few, self.keys, ["_at", "_k"], False).ahead("_behind", F.col("_own"), most).rows.filter(F.col("_k") == most + 1)
        carried = behind.select(*self.keys, F.col("_at").alias("_block"), "_behind")
        joined = told.alias("_scanned").join(F.broadcast(carried.alias("_carried")), _same([*self.keys, "_block"], "_scanned", "_carried"), "left")
        both = F.concat(F.col(f"_scanned.{name}"), F.coalesce("_carried._behind", F.array().cast(told.schema[name].dataType)))
        return replace(self, rows=joined.select(*(F.slice(both, 1, most).alias(c) if c == name else F.col(f"_scanned.{c}") for c in told.columns)))

    def with_rows(self, rows: DataFrame) -> Blocks:
        """The same blocks with other columns."""
        return replace(self, rows=rows)

    def number(self, name: str) -> Blocks:
        """Adds the row's number in its key, from 1."""
        return self.scan({name: ("sum", F.lit(1).cast("long"))})

    def result(self) -> DataFrame:
        return self.rows.drop("_block")


def in_blocks(df: DataFrame, keys: list[str], order: list[str], rows: int = BLOCK, name: str = "blocks", stored: bool = True) -> Blocks:
    """The rows of df in the order of columns `order` (ascending, nulls first) within each key; nulls in keys are equal.

    Keys with more than `rows` rows are cut; there are at most count / rows of them, which is what is broadcast. Rows that are equal in keys and order
    stay in one block, so the order should tell rows apart. df is written as a table once, as it is read several times, unless it isn't to be stored: if it is
    made from tables by cheap expressions. Rows are counted in parts by the hash of their key first; only in parts with more than `rows` rows keys are counted."""
    table = materialize(df, name) if stored else df
    whole = Blocks(table.withColumn("_block", F.lit(-1)), keys, order, False)
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).alias("_part")
    full = materialize(table.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows), f"{name}-parts")
    if full.isEmpty():
        return whole
    among = table.withColumn("_part", part).join(F.broadcast(full.select("_part")), "_part", "left_semi")
    busy = materialize(among.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows), f"{name}-keys")
    total = busy.agg(F.sum("_n")).first()[0]
    if not total:
        return whole
    there = F.broadcast(busy.alias("_busy"))
    rest = table.alias("_all").join(there, _same(keys, "_all", "_busy"), "left_anti").withColumn("_block", F.lit(-1))
    many = table.alias("_all").join(there, _same(keys, "_all", "_busy"), "left_semi")
    cut = many.repartitionByRange(max(2, ceil(total / rows)), *keys, *order).withColumn("_block", F.spark_partition_id())
    return Blocks(rest.unionByName(materialize(cut, f"{name}-cut")), keys, order, True)
