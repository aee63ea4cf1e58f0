"""Sharding into contiguous runs of atomic groups whose largest total is as small as can be.

Documents with equal texts form a group and must stay together. Groups are laid out in the order of their texts' hash;
the hash's leading bits name an atom, which holds whole groups. The smallest capacity that lets a greedy pass fill no
more than k shards is found by binary search over the ordered atoms' sizes. Cuts that keep to that capacity are then
made where a shard is nearest to an equal share of what is left, wherever the atoms after the cut still fit into the shards
after it, so that the least shard is not small either. An atom that alone exceeds an equal share of what is left gets a shard of its own first, since any capacity
would have to hold it and would leave other shards empty; the other shards are contiguous but for such atoms.

The atoms are bounded (2^16 by default) whatever the size of the corpus, so the search sees one row of fixed width.

Defined results: a null text counts no bytes and equals other null texts; repeated rows each get a slot; rows of equal id and
text take slots in any order; a very long text is an atom like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pairforge.llm.common import written

ATOM_BITS = 16
ROW_BYTES = 16
#: Rows numbered together: slots are dealt in blocks of about so many, never a whole shard in one task.
SLOT_BLOCK = 4096


def cut_atoms(atoms: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """The cuts for (atom, bytes): atoms with a shard of their own, and the first atom of each further shard.

    Both lists are shorter than `shards`. Each step is a query over one row that holds the atoms' array; the steps' results
    are written or read as constants, since an optimizer that merged the steps would evaluate one inside the other's loop.
    """
    one = written(atoms.agg(F.array_sort(F.collect_list(F.struct("atom", F.col("bytes").cast("long").alias("bytes")))).alias("rest")).coalesce(1))
    # atoms of more than an equal share of what the atoms before them leave, largest first
    alone = (
        f"aggregate(slice(reverse(array_sort(transform(rest, x -> struct(x.bytes AS bytes, x.atom AS atom)))), 1, {max(shards - 1, 1)}),"
        f" struct(aggregate(rest, 0L, (s, x) -> s + x.bytes) AS rest, {shards}L AS k, CAST(array() AS array<bigint>) AS own, true AS go),"
        " (s, x) -> IF(s.go AND s.k > 1 AND x.bytes * s.k > s.rest, struct(s.rest - x.bytes AS rest, s.k - 1 AS k, concat(s.own, array(x.atom)) AS own, true AS go),"
        " struct(s.rest AS rest, s.k AS k, s.own AS own, false AS go)), s -> s.own)"
    )
    own = one.selectExpr(f"{alone} AS own").first().own
    k = shards - len(own)
    if own:
        one = written(one.selectExpr(f"filter(rest, x -> NOT x.atom IN ({', '.join(map(str, own))})) AS rest"))
    sizes = written(one.selectExpr("transform(rest, x -> x.bytes) AS sizes", "coalesce(array_max(transform(rest, x -> x.bytes)), 0L) AS top", "aggregate(rest, 0L, (s, x) -> s + x.bytes) AS total"))
    top, total = sizes.select("top", "total").first()
    fits = f"aggregate(sizes, struct(1 AS shards, 0L AS fill), (s, x) -> IF(s.fill + x <= mid, struct(s.shards AS shards, s.fill + x AS fill), struct(s.shards + 1 AS shards, x AS fill)), s -> s.shards <= {k})"
    low = max(-(-total // k), top)
    # an equal share and one atom more is always enough
    search = (
        f"aggregate(sequence(1, {max(top.bit_length(), 1) + 1}), struct({low}L AS lo, {low + top}L AS hi), (b, i) -> IF(b.lo >= b.hi, b,"
        f" transform(array(b.lo + (b.hi - b.lo) div 2L), mid -> IF({fits}, struct(b.lo AS lo, mid AS hi), struct(mid + 1L AS lo, b.hi AS hi)))[0]), b -> b.hi)"
    )
    capacity = sizes.selectExpr(f"{search} AS capacity").first().capacity
    # the earliest atoms from which the rest fits into one shard, into two, and so on
    ends = (
        "aggregate(reverse(rest), struct(CAST(array() AS array<bigint>) AS at, 0L AS fill, CAST(NULL AS bigint) AS first),"
        f" (s, x) -> IF(s.fill + x.bytes <= {capacity}L, struct(s.at AS at, s.fill + x.bytes AS fill, x.atom AS first),"
        " struct(concat(s.at, array(s.first)) AS at, x.bytes AS fill, x.atom AS first)), s -> s.at)"
    )
    fit = [None, *one.selectExpr(f"{ends} AS at").first().at]
    # s.k shards are left, the one being filled among them, for the s.left bytes from its beginning on
    after = f"element_at(array({', '.join(f'{x}L' for x in fit[1:]) or '0L'}), least(s.k - 1, {max(len(fit) - 1, 1)}))"
    may = f"(s.k - 1 > {len(fit) - 1} OR x.atom >= {after})"
    near = "abs(s.fill * s.k - s.left) <= abs((s.fill + x.bytes) * s.k - s.left)"
    cuts = (
        f"aggregate(rest, struct(CAST(array() AS array<bigint>) AS cuts, 0L AS fill, {total}L AS left, {k} AS k),"
        f" (s, x) -> IF(s.fill > 0 AND s.k > 1 AND (s.fill + x.bytes > {capacity}L OR ({may} AND {near})),"
        " struct(concat(s.cuts, array(x.atom)) AS cuts, x.bytes AS fill, s.left - s.fill AS left, s.k - 1 AS k),"
        " struct(s.cuts AS cuts, s.fill + x.bytes AS fill, s.left AS left, s.k AS k)), s -> s.cuts)"
    )
    return own, one.selectExpr(f"{cuts} AS cuts").first().cuts


def shard(docs: DataFrame, shards: int = 40, *, id_column: str = "doc_id", text_column: str = "text", atom_bits: int = ATOM_BITS, slot_block: int = SLOT_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row. The law is `bytes`."""
    text = F.col(text_column)
    sized = written(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - atom_bits).alias("atom"),
        )
    )
    # 2^atom_bits rows at most, whatever the corpus
    atoms = written(sized.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    rows = atoms.agg(F.sum("n")).first()[0] or 0
    own, cuts = cut_atoms(atoms, shards)
    at = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("atom")))
    for i, atom in enumerate(own):
        at = F.when(F.col("atom") == atom, F.lit(shards - len(own) + i)).otherwise(at)
    placed = sized.withColumn("shard", at.cast("int"))
    blocks = max(1, -(-rows // (shards * slot_block)))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("number", number).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
