"""Mixing sources to target weights, by dependent rounding.

Every source has a target number of words. A document of a source of S words with target t is taken t / S times on
average: the whole part for certain, and the fraction as a probability. Documents' fractional masses (fraction times
words) are paired: a random one gives mass to the other until one of them holds nothing or its whole size. The direction
is drawn so that no expectation moves, and mass in words is kept exactly, so a source's words end within one document of
its target. Blocks of documents are folded independently, large documents first; what a block has left over, one document with a part of its
mass, goes to the next level of a tree until one is left in each source. That one is taken if its source then ends nearer to
its target. Where it ends off the target all the same, as where documents are large, one more document is settled the other
way, the one whose words come nearest to what is missing or too much. These two decisions of a source are not drawn.

Defined results: a null text has no words; a null source is a source of its own, ordered last; documents without words
are taken 0 times; repeated rows (same id, source and text) are treated as so many documents; a very long text is one
document; ties go by hash; an empty table gives no rows. Draws depend on ids and texts alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairforge.llm.common import n_words, written

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3.0
#: Documents folded together at each level of the tree.
BLOCK = 512
KEY = ("_id", "_source", "_size", "_text")

_ITEM = "struct<least:bigint,h:bigint,id:bigint,text:bigint,size:bigint,n:bigint,full:bigint,mass:double>"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, ...) with the target of each source.

    Weights repeat over the sources in code point order. All words are shared by weight; a source stops at `max_repeat`
    times its own words and the rest is shared anew. In order of cap / weight the stopped sources are a prefix, so one
    pass over running sums finds the level at which the others stand. One row a source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    whole = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(in_order)).withColumns(
        {"weight": F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1), "cap": F.col("source_size") * F.lit(float(max_repeat))}
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / rest)
    stopped = level.withColumn("stopped", F.col("level") * F.col("weight") >= F.col("cap"))
    first_free = F.min(F.when(~F.col("stopped"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "rank", "level"))).over(whole)
    return stopped.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(first_free["level"] * F.col("weight"))).drop("rank", "weight", "cap", "level", "stopped")


def _fold(items: str, seed: int) -> Column:
    """struct(left, done) of a block: the item left over with its mass, and the items decided, each with `up` 0 or 1."""
    # what one step does: the item decided, whether it is taken, and the mass of the one that stays
    gives = "IF(a.mass <= b.size - b.mass, struct(a AS done, 0 AS up, b AS stay, a.mass + b.mass AS mass), struct(b AS done, 1 AS up, a AS stay, a.mass - (b.size - b.mass) AS mass))"
    takes = "IF(b.mass <= a.size - a.mass, struct(b AS done, 0 AS up, a AS stay, a.mass + b.mass AS mass), struct(a AS done, 1 AS up, b AS stay, b.mass - (a.size - a.mass) AS mass))"
    give, take = "least(a.mass, b.size - b.mass)", "least(b.mass, a.size - a.mass)"
    draw = f"shiftrightunsigned(xxhash64({seed}, a.id, a.text, b.id, b.text), 11) * {2.0**-53!r}D * ({give} + {take}) < {take}"
    with_mass = "struct(s.stay.least AS least, s.stay.h AS h, s.stay.id AS id, s.stay.text AS text, s.stay.size AS size, s.stay.n AS n, s.stay.full AS full, s.mass AS mass)"
    pair = f"transform(transform(array(struct(acc.left AS a, x AS b)), p -> transform(array(p), q -> {{}})[0]), s -> struct({with_mass} AS left, concat(acc.done, array(named_struct('item', s.done, 'up', s.up))) AS done))[0]"
    q = lambda text: text.replace("a.", "q.a.").replace("b.", "q.b.").replace("(a AS", "(q.a AS").replace("(b AS", "(q.b AS").replace(" a AS", " q.a AS").replace(" b AS", " q.b AS")
    step = pair.format(f"IF({q(draw)}, {q(gives)}, {q(takes)})")
    start = f"struct(CAST(NULL AS {_ITEM}) AS left, CAST(array() AS array<struct<item:{_ITEM},up:int>>) AS done)"
    return F.expr(f"aggregate({items}, {start}, (acc, x) -> IF(acc.left IS NULL, struct(x AS left, acc.done AS done), {step}))")


def mix_decisions(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """A row for each distinct (_id, _source, _size, _text hash): n equal rows, of which `more` are taken base + 1 times and the rest base times; source_size, target."""
    # the one pass over texts; equal rows meet here, after a partial count
    keyed = written(
        docs.select(
            F.col(id_column).cast("long").alias("_id"), F.col(source_column).cast("string").alias("_source"), n_words(F.col(text_column)).alias("_size"), F.xxhash64(text_column).alias("_text")
        ).groupBy(*KEY).agg(F.count("*").alias("n"))
    )
    sizes = keyed.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"), F.count("*").alias("keys"))
    aims = written(targets(sizes, weights, max_repeat).coalesce(1))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    with_rate = keyed.join(aims, keyed["_source"].eqNullSafe(aims["source"])).drop("source").withColumn("base", F.floor(rate).cast("long")).withColumn("part", (rate - F.floor(rate)) * F.col("n"))
    split = with_rate.withColumns({"full": F.floor("part").cast("long"), "mass": F.when(F.col("_size") > 0, (F.col("part") - F.floor("part")) * F.col("_size")).otherwise(F.lit(0.0))})
    carried = ("source_size", "target", "base")
    settled = split.where(F.col("mass") <= 0).select(*KEY, "n", *carried, F.col("full").alias("more"))

    # the tree; block counts follow from the number of keys, so that no level needs a count of its own
    most = aims.agg(F.max("keys")).first()[0] or 0
    left = split.where(F.col("mass") > 0).select("_source", "keys", *carried, F.struct((-F.col("_size")).alias("least"), F.xxhash64(F.lit(seed), "_id", "_text").alias("h"), F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_size").alias("size"), "n", "full", "mass").alias("item"))
    decided, level, span = [settled], 0, block
    while True:
        groups = left.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + level), "item.h", "item.size"), F.ceil(F.col("keys") / F.lit(span))))
        folded = written(
            groups.groupBy("_source", "keys", *carried, "_block").agg(F.array_sort(F.collect_list("item")).alias("items")).select("_source", "keys", *carried, _fold("items", seed + level).alias("f"))
        )
        done = folded.select("_source", *carried, F.explode("f.done").alias("d"))
        decided.append(_rows(done, "d.item", F.col("d.up"), carried))
        left = folded.select("_source", "keys", *carried, F.col("f.left").alias("item"))
        if span >= most:
            break
        level, span = level + 1, span * block
    # one item is left in each source: it goes where its source ends nearer to its target
    decided.append(_rows(left, "item", (F.col("item.mass") * 2 >= F.col("item.size")).cast("int"), carried))
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return _settled(out, max_repeat)


def _settled(decisions: DataFrame, max_repeat: float) -> DataFrame:
    """`decisions` with one of each source settled the other way, if that brings the source nearer to its target."""
    taken = (F.col("base") * F.col("n") + F.col("more")) * F.col("_size")
    # a row a source
    miss = decisions.groupBy("_source").agg((F.first("target") - F.sum(taken)).alias("miss")).withColumnRenamed("_source", "source")
    known = decisions.join(miss, decisions["_source"].eqNullSafe(F.col("source"))).drop("source")
    way = F.when((F.col("miss") > 0) & (F.col("more") < F.col("n")) & (F.col("base") + 1 <= max_repeat), 1).when((F.col("miss") < 0) & (F.col("more") > 0), -1)
    gain = F.abs("miss") - F.abs(F.abs("miss") - F.col("_size"))
    tried = known.withColumns({"way": way, "gain": gain}).where("way IS NOT NULL AND gain > 0 AND _size > 0")
    pick = tried.groupBy("_source").agg(F.max(F.struct("gain", F.xxhash64("_id", "_text").alias("h"), F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_size").alias("size"), "way")).alias("pick")).withColumnRenamed("_source", "source")
    both = decisions.join(pick, decisions["_source"].eqNullSafe(F.col("source")), "left")
    same = F.col("_id").eqNullSafe(F.col("pick.id")) & (F.col("_text") == F.col("pick.text")) & (F.col("_size") == F.col("pick.size"))
    return both.withColumn("more", F.when(same, F.col("more") + F.col("pick.way")).otherwise(F.col("more"))).drop("source", "pick")


def _rows(df: DataFrame, item: str, up: Column, carried: tuple[str, ...]) -> DataFrame:
    i = F.col(item)
    return df.select(i["id"].alias("_id"), "_source", i["size"].alias("_size"), i["text"].alias("_text"), i["n"].alias("n"), *carried, (i["full"] + up).cast("long").alias("more"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it; columns stay as they are."""
    id_column, text_column, source_column = options.get("id_column", "doc_id"), options.get("text_column", "text"), options.get("source_column", "source")
    picks = mix_decisions(docs, **options).where((F.col("base") > 0) | (F.col("more") > 0))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_column].cast("long").alias("_id"), docs[source_column].cast("string").alias("_source"), n_words(docs[text_column]).alias("_size"), F.xxhash64(docs[text_column]).alias("_text"))
    # one shuffle of the rows serves both the join and the numbering, as no key is null
    same = ["_size", "_text", "_i", "_i_null", "_s", "_s_null"]
    plain = {"_i": F.coalesce("_id", F.lit(0)), "_i_null": F.col("_id").isNull(), "_s": F.coalesce("_source", F.lit("")), "_s_null": F.col("_source").isNull()}
    # equal rows take turns; ids are unique in a sound table, so these windows hold one row
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))
    numbered = rows.withColumns(plain).drop("_id", "_source").withColumn("_turn", turn)
    joined = numbered.join(picks.withColumns(plain).select(*same, "base", "more"), same)
    copies = F.col("base") + F.when(F.col("_turn") <= F.col("more"), 1).otherwise(0)
    return joined.where(copies > 0).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("_row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("turn")
    rows = mix_decisions(docs, **options).select("_id", "_size", "source_size", "target", "base", "more", turn)
    taken = (F.col("base") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)) * F.col("_size")
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))
