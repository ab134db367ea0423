"""Dominance counts: for each sale, the sales of smaller slot and larger level, by a binary trie over levels.

Two levels part at one bit: the larger has a one there, the smaller a zero, and all higher bits, the prefix, are the same. So for
each bit, within a prefix and in order of slots, a running sum of what has a one credits what has a zero; the credits of all bits
are the count.

No prefix is summed in one task. Equal slots and levels are one cell. Slots are cut into blocks, intervals of a power of two that
hold CELLS cells at most, and levels into nodes of the trie that hold CELLS pairs of a block and a level at most:
1. cells of one block: windows over the bits of the levels' ranks in the block, in order of slots;
2. blocks of one node: windows over the bits of the levels' ranks in the node, in order of blocks;
3. nodes: windows over the bits of the nodes in the trie, in order of blocks, as sums of sums of DIGIT bits of the block.
Two cells of different slots and levels are in one block, or else in one node, or else in two nodes, so each pair counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import forget, stored

#: Bits of a rank within a block or a node, which has so many cells at most; bits of a place that one window spans.
RANK_BITS, DIGIT = 14, 8
CELLS = 1 << RANK_BITS
#: Levels become numbers without sign, of the same order, by turning the sign's bit.
SIGN = -(1 << 63)


def _shifted(value: str, by: str) -> Column:
    """``value`` without its ``by`` lowest bits; 64 of them leave nothing, where the JVM's shift would leave all."""
    return F.expr(f"shiftrightunsigned(shiftrightunsigned({value}, ({by}) div 2), ({by}) - ({by}) div 2)")


def _before(at: str, *keys: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)


def _ends(cells: DataFrame) -> tuple[int, int, int]:
    """The least slot, and how many low bits differ among slots counted from it, and among levels."""
    r = cells.agg(F.min("slot"), F.max("slot"), F.min("level"), F.max("level")).first()
    return (r[0], (r[1] - r[0]).bit_length(), ((r[2] ^ r[3]) & (1 << 64) - 1).bit_length()) if r[0] is not None else (0, 0, 0)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """By sorted parts of both sides: neither is ever sent whole to all tasks."""
    return left.join(right.hint("merge"), keys, how)


def _cut(cells: DataFrame, at: str, bits: int) -> DataFrame:
    """``at`` and k for each value of ``at``: its interval is the largest one of 2 ** k values with CELLS cells at most, or the
    value itself (k = 0): an interval that is no larger, in one that is."""
    own = cells.groupBy(at).agg(F.count("*").alias("c"))
    each = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("p", _shifted(at, "k"))
    sums = stored(each.groupBy("k", "p").agg(F.sum("c").alias("c")), "intervals")
    large = sums.where(f"c > {CELLS}").select("k", "p")
    small = sums.where(f"c <= {CELLS} or k = 0").select("k", "p")
    inside = small.where(f"k < {bits}").select((F.col("k") + 1).alias("k"), _shifted("p", "1").alias("p"), F.col("p").alias("own"))
    inside = _joined(inside, large, ["k", "p"]).select((F.col("k") - 1).alias("k"), F.col("own").alias("p"))
    found = stored(inside.union(small.where(f"k = {bits}")), "cuts")
    forget(sums)
    return _joined(each.select(at, "k", "p"), found, ["k", "p"]).select(at, "k")


def _start(at: str, k: str) -> Column:
    return F.expr(f"CASE WHEN {k} > 63 THEN 0L ELSE shiftleft(shiftrightunsigned({at}, {k}), {k}) END")


def _within(cells: DataFrame, part: str, at: str, of: str) -> DataFrame:
    """``cells`` (at, of, n, m and the interval ``part``, of CELLS rows at most) with up_n and up_m: the sums of n and m over the
    cells of the same part with smaller ``at`` and larger ``of``."""
    own = cells.repartitionByRange(part).withColumn("rank", F.dense_rank().over(Window.partitionBy(part).orderBy(F.col(of).bitwiseXOR(F.lit(SIGN)))) - 1)
    own = own.withColumns({"up_n": F.lit(0).cast("long"), "up_m": F.lit(0).cast("long")})
    for b in range(RANK_BITS):
        before, one = _before(at, F.shiftright("rank", b + 1), part), F.shiftright("rank", b).bitwiseAND(1) == 1
        credit = lambda c, before=before, one=one: F.when(one, 0).otherwise(F.coalesce(F.sum(F.when(one, F.col(c))).over(before), F.lit(0)))
        own = own.withColumns({"up_n": F.col("up_n") + credit("n"), "up_m": F.col("up_m") + credit("m")})
    return own.drop("rank")


def _credited(cells: DataFrame, part: str, k: str, at: str, of: str) -> DataFrame:
    """As :func:`_within`; parts of a single value of ``at`` or ``of`` (``k`` = 0) have no pairs, and may have any number of cells."""
    alone = cells.where(f"{k} = 0").withColumns({"up_n": F.lit(0).cast("long"), "up_m": F.lit(0).cast("long")})
    return _within(cells.where(f"{k} > 0"), part, at, of).unionByName(alone)


def _running(sums: DataFrame, keys: list[str], at: str, bits: int) -> DataFrame:
    """``sums`` (keys, at, n, m; one row each) with the sums over smaller ``at`` of equal keys in place of their own. A window
    spans values that differ in DIGIT bits only; what lies before those is a running sum of sums."""
    own = [F.coalesce(F.sum(c).over(_before(at, *keys, _shifted(at, str(DIGIT)))), F.lit(0)).alias(c) for c in ("n", "m")]
    here = sums.select(*keys, at, *own)
    if bits <= DIGIT:
        return here
    up = f"{at}_up"
    above = sums.groupBy(*keys, _shifted(at, str(DIGIT)).alias(up)).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    above = _running(above, keys, up, bits - DIGIT).withColumnsRenamed({"n": "up_n", "m": "up_m"})
    both = _joined(here.withColumn(up, _shifted(at, str(DIGIT))), above, [*keys, up])
    return both.select(*keys, at, (F.col("n") + F.col("up_n")).alias("n"), (F.col("m") + F.col("up_m")).alias("m"))


def _across_nodes(sums: DataFrame, block_bits: int, node_bits: int) -> DataFrame:
    """block, node, up_n, up_m of ``sums`` (block, node, node_k, n, m): over smaller blocks and larger nodes."""
    if not node_bits:
        return sums.limit(0).select("block", "node", F.col("n").alias("up_n"), F.col("m").alias("up_m"))
    each = sums.where(f"node_k < {node_bits}").withColumn("b", F.explode(F.sequence("node_k", F.lit(node_bits - 1))))
    each = each.select("block", "node", "b", _shifted("node", "b + 1").alias("prefix"), _shifted("node", "b").bitwiseAND(1).alias("one"), "n", "m")
    ones = each.groupBy("b", "prefix", "block").agg(*[F.sum(F.when(F.col("one") == 1, F.col(c)).otherwise(0)).alias(c) for c in ("n", "m")])
    before = _running(ones, ["b", "prefix"], "block", block_bits).where("n > 0")
    zeros = each.where("one = 0").select("block", "node", "b", "prefix")
    return _joined(zeros, before, ["b", "prefix", "block"]).groupBy("block", "node").agg(F.sum("n").alias("up_n"), F.sum("m").alias("up_m"))


def above(points: DataFrame) -> DataFrame:
    """slot, level, n_above, m_above for each distinct pair (slot, level) of ``points`` (slot: long, level: long, m: long): the
    number of rows, and the sum of their m, with smaller slot and strictly larger level. Rows with a null slot or level are left
    out; slots are less than 2 ** 63 apart, levels any; an empty table gives an empty table.

    What is shuffled is cells, a few times, and sums of them; every window has CELLS rows at most, or 2 ** DIGIT sums, however
    many rows share a slot, a level or a prefix.
    """
    cells = points.where("slot is not null and level is not null").groupBy("slot", "level").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    turned = F.col("level").bitwiseXOR(F.lit(SIGN)).alias("level")
    kept = stored(cells.select("slot", turned, "n", "m"), "cells")
    least, slot_bits, level_bits = _ends(kept)
    cells = kept.withColumn("slot", F.col("slot") - least)
    blocks = _cut(cells, "slot", slot_bits).select("slot", F.col("k").alias("block_k"), _start("slot", "k").alias("block"))
    in_blocks = stored(_credited(_joined(cells, blocks, ["slot"]), "block", "block_k", "slot", "level"), "in-blocks")
    by_block = stored(in_blocks.groupBy("block", "level").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "by-block")
    nodes = _cut(by_block, "level", level_bits).select("level", F.col("k").alias("node_k"), _start("level", "k").alias("node"))
    in_nodes = stored(_credited(_joined(by_block, nodes, ["level"]), "node", "node_k", "block", "level"), "in-nodes")
    by_node = stored(in_nodes.groupBy("block", "node", "node_k").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "by-node")
    across = _across_nodes(by_node, slot_bits, level_bits).withColumnsRenamed({"up_n": "far_n", "up_m": "far_m"})
    zero = F.lit(0).cast("long")
    far = _joined(in_nodes, across, ["block", "node"], "left")
    far = stored(far.select("block", "level", *[(F.col(f"up_{c}") + F.coalesce(f"far_{c}", zero)).alias(f"far_{c}") for c in "nm"]), "across-blocks")
    forget(kept, by_block, in_nodes, by_node)
    return _joined(in_blocks, far, ["block", "level"]).select((F.col("slot") + least).alias("slot"), turned, *[(F.col(f"up_{c}") + F.col(f"far_{c}")).alias(f"{c}_above") for c in "nm"])


def slot_of(sales: DataFrame) -> Column:
    """Whole minutes since 1970 of sold_at; a timestamp without a zone is taken as UTC, whatever the session's zone."""
    if sales.schema["sold_at"].dataType.typeName() == "timestamp":
        return F.floor(F.unix_seconds("sold_at") / 60)
    return F.datediff(F.col("sold_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour("sold_at") * 60 + F.minute("sold_at")


def sales_above(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level, n_sales, n_rows for every row of ``sales`` (sale_id, sold_at, total): how many sales have a smaller
    slot (minute of sold_at) and a strictly larger level (total in hundredths, rounded half up), and how many rows these stand for:
    1 + crc32(sale_id) mod 5 each, and one where sale_id is null.

    A null sold_at or total, or a total that is no number, makes slot or level null; such sales are above none and have null
    counts. Totals beyond 64 bits have the last level. Repeated rows count each and have equal results; other columns are not
    looked at; an empty table gives an empty table.
    """
    weight = 1 + F.coalesce(F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(5)), F.lit(0))
    total = F.when(~F.isnan("total"), F.col("total"))
    rows = sales.select("sale_id", slot_of(sales).alias("slot"), F.floor(100 * total + 0.5).alias("level"), weight.alias("m"))
    found = above(rows).withColumnsRenamed({"n_above": "n_sales", "m_above": "n_rows"})
    return _joined(rows.drop("m"), found, ["slot", "level"], "left").select("sale_id", "slot", "level", "n_sales", "n_rows")
