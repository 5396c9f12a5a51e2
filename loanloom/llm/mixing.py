"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document's expected number of copies is target / source size, whose
whole part is taken outright.  The fractional parts are rounded dependently: two units meet, mass moves at random
from one to the other until one of them is 0 or 1, and the other goes on.

Units that hold more than one part in ``HEADS`` of their source's words come first, largest first (a source has fewer
than ``HEADS`` of them): each meets all smaller ones as one composite unit and moves words, until it is 0 or 1 itself.
So the smaller documents make up for what the large ones miss.  Where they are too few for that after one of the two
outcomes, the outcome that leaves the smaller miss is taken instead of a draw.

All others meet in blocks of ``FAN_IN`` neighbours in size order, folded at a time, and each block leaves one unit at
most; those meet in the next level, so a source of n units takes log(n) levels and no task ever sees more than a
block.  Neighbours have nearly the same size, so words, not only copies, stay near the target.  Their draws are hashes
of a unit's rank, level and the seed; those of the large units go round the unit interval in even steps from a hashed
start, so each is uniform and the copies of a source's large units, too, stay near their expected number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm.common import WORD, cut, numbered

FAN_IN = 64
#: A unit with more than one part in so many of its source's words is rounded on its own.
HEADS = 200
#: Draws of a source's heads step by this part of 1, so that the low and the high ones take turns.
STRIDE = (5**0.5 - 1) / 2
#: Words by which two misses differ only through the rounding of sums.
EVEN = 1e-6
#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words so many times at most.
LIMIT = 3
KEY = ("source", "size", "doc_id")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sharing by weight and resharing what exceeds ``limit`` times a size ends where target = min(limit * size,
    weight * level).  Sources are settled in the order of limit * size / weight; the windows see one row a source.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * limit)
        .withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(0))))
    )
    by_need = W.orderBy(F.col("most") / F.col("weight"), "place")
    earlier = by_need.rowsBetween(W.unboundedPreceding, -1)
    later = by_need.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    levelled = ranked.withColumn("level", level)
    full = F.col("most") <= F.col("level") * F.col("weight")
    final = F.max(F.when(~full, F.col("level"))).over(W.partitionBy(F.lit(0)))
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return levelled.withColumn("final", final).select("source", "source_size", target.alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _meet(state: Column, unit: Column) -> Column:
    """One pivotal step: the carried unit and the next one share their mass until one of them is decided."""
    mass = state["p"] + unit["p"]
    carried_lives = unit["u"] * mass < state["p"]
    carried_wins = unit["u"] * (F.lit(2.0) - mass) < F.lit(1.0) - unit["p"]
    light = F.struct(
        F.when(carried_lives, state["rank"]).otherwise(unit["rank"]).alias("rank"), mass.alias("p"), state["ones"].alias("ones")
    )
    heavy = F.struct(
        F.when(carried_wins, unit["rank"]).otherwise(state["rank"]).alias("rank"),
        (mass - 1.0).alias("p"),
        F.concat(state["ones"], F.array(F.when(carried_wins, state["rank"]).otherwise(unit["rank"]))).alias("ones"),
    )
    return F.when(mass < 1.0, light).otherwise(heavy)


def pivotal(units: DataFrame, rows: int, seed: int) -> DataFrame:
    """Ranks rounded up to 1 from ``source, rank, p`` (0 <= p < 1, ranks below ``rows``); all others become 0."""
    ups, level = None, 0
    active = units.where("p > 0").select("source", "rank", "p", F.col("rank").alias("block"))
    while True:
        level += 1
        top = FAN_IN**level >= rows
        draw = uniform(F.col("rank"), F.lit(level), F.lit(seed))
        folded = (
            active.withColumn("block", F.lit(0).cast("bigint") if top else F.expr(f"block div {FAN_IN}"))
            .groupBy("source", "block")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "p", draw.alias("u")))).alias("units"))
            .withColumn(
                "state",
                F.aggregate(
                    "units",
                    F.struct(
                        F.lit(-1).cast("bigint").alias("rank"),
                        F.lit(0.0).alias("p"),
                        F.array().cast("array<bigint>").alias("ones"),
                    ),
                    _meet,
                ),
            )
            .select("source", "block", "state")
        )
        folded = cut(folded)
        won = folded.select("source", F.explode("state.ones").alias("rank"))
        ups = won if ups is None else ups.unionByName(won)
        left = folded.where("state.p > 0").select("source", "state.rank", "state.p", "block")
        if top:
            last = left.where(uniform(F.col("rank"), F.lit(0), F.lit(seed)) < F.col("p")).select("source", "rank")
            return ups.unionByName(last)
        active = left


def _settle(state: Column, head: Column) -> Column:
    """A head takes its copy or not; the composite of all smaller units gets the words that it leaves or lacks."""
    after = state["rest"] - head["words"]
    without = F.greatest(state["mass"] - after, F.lit(0.0))
    taken = state["mass"] - head["words"]
    with_it = F.greatest(-taken, taken - after, F.lit(0.0))
    up = (
        F.when(with_it < without - EVEN, True)
        .when(without < with_it - EVEN, False)
        .otherwise(head["u"] * state["rest"] < state["mass"])
    )
    mass = F.least(F.greatest(F.when(up, taken).otherwise(state["mass"]), F.lit(0.0)), after.cast("double"))
    ones = F.when(up, F.concat(state["ones"], F.array(head["rank"]))).otherwise(state["ones"])
    return F.struct(after.alias("rest"), mass.alias("mass"), ones.alias("ones"))


def settle_heads(rated: DataFrame, seed: int) -> DataFrame:
    """``source, rest, mass, ones`` of each source with heads: words of its other units, the part of them that is
    still to be taken, and the ranks of the heads that are rounded up."""
    words = F.col("size") * F.col("n")
    heads = rated.where((F.col("p") > 0) & (words * HEADS > F.col("source_size")))
    head = F.struct((-words).alias("order"), F.col("rank"), words.alias("words"))
    gathered = heads.groupBy("source").agg(
        F.array_sort(F.collect_list(head)).alias("heads"), F.max("source_size").alias("all"), F.max("p").alias("p")
    )
    begin = F.struct(
        F.col("all").alias("rest"), (F.col("p") * F.col("all")).alias("mass"), F.array().cast("array<bigint>").alias("ones")
    )
    start = uniform(F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull(), F.lit(seed))

    def drawn(h: Column, place: Column) -> Column:
        turn = start + place * F.lit(STRIDE)
        return F.struct(h["rank"].alias("rank"), h["words"].alias("words"), (turn - F.floor(turn)).alias("u"))

    state = F.aggregate(F.transform("heads", drawn), begin, _settle)
    return gathered.select("source", state.alias("state")).select("source", "state.*")


def decide_copies(docs: DataFrame, seed: int = 11, limit: int = LIMIT) -> DataFrame:
    """``source, size, doc_id, n, source_size, target, copies``: one row for each distinct (source, size, doc_id).

    ``docs`` has doc_id, text and source; any may be null (null text has no words, null source is a source of its
    own and the last).  Rows that repeat source, size and doc_id (``n`` of them) share one decision.  When no word
    exists at all, every target and every number of copies is 0.  An empty table gives no rows.
    """
    light = docs.select("source", word_count(F.col("text")).alias("size"), "doc_id")
    units = numbered(light.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), KEY, "rank")
    targets = cut(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), limit=limit))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0)
    rated = units.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate)
    rated = cut(rated.withColumn("whole", F.floor("rate").cast("bigint")).withColumn("p", F.col("rate") - F.col("whole")))
    first = rated.select("rows").first()
    settled = cut(settle_heads(rated, seed))
    rest = settled.select(F.col("source").alias("_s"), "rest", "mass")
    light = rated.where(F.col("size") * F.col("n") * HEADS <= F.col("source_size"))
    share = F.when(F.col("rest") > 0, F.col("mass") / F.col("rest")).otherwise(F.col("p"))
    light = light.join(rest, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("p", share)
    # a composite that was filled to the brim takes all of its units
    full = light.where("p >= 1").select("source", "rank")
    drawn = pivotal(light.where("p < 1"), first["rows"] if first else 0, seed)
    up = settled.select("source", F.explode("ones").alias("rank")).unionByName(full).unionByName(drawn).select("rank", F.lit(1).alias("_up"))
    copies = F.col("whole") + F.coalesce(F.col("_up"), F.lit(0))
    return rated.join(up, "rank", "left").select(*KEY, "n", "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    decided = decide_copies(docs, seed)
    each = decided.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` with each row repeated as often as decided: rows of the mix, in the columns of ``docs``."""
    decided = decide_copies(docs, seed).where("copies > 0").select(*[F.col(c).alias(f"_mix_{c}") for c in KEY], F.col("copies").alias("_mix_copies"))
    sized = docs.withColumn("_mix_n", word_count(F.col("text")))
    same = (
        F.col("_mix_n").eqNullSafe(F.col("_mix_size"))
        & F.col("source").eqNullSafe(F.col("_mix_source"))
        & F.col("doc_id").eqNullSafe(F.col("_mix_doc_id"))
    )
    taken = sized.join(decided, same).withColumn("_mix_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_copies"))))
    return taken.select(*docs.columns)
