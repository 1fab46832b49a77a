"""Mixing sources to target weights (problem 8).

A mix is a schedule of slots of equal size. Slot i belongs to the source into whose share of the cumulated
weights the golden-ratio point frac((i + 1/2) * phi) falls; such points are spread so evenly that any stretch of
the schedule has the sources in nearly their weights. Each source's documents, shuffled by a hash and repeated
as often as needed and allowed, form a stream of tokens, cut into blocks of the slot's size; the k-th block of a
source goes into its k-th slot. A document belongs to the block in which it begins; the last one of a source is
taken if at least half of it lies within the source's part.

A mix has as many tokens as its sources have together, unless told otherwise. A source too small for its part is
repeated, at most as often as its cap allows; what it can't give then is reported as its shortfall, and the others
keep their parts. Sources without documents can't contribute; the others share their weight in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import cut

GOLDEN = (5**0.5 - 1) / 2
#: Tokens of a slot.
BLOCK = 16_384
#: Slots ranked together, and documents whose tokens are added up together.
CHUNK = 65_536
ROWS = 500_000


def schedule(mixes: DataFrame) -> DataFrame:
    """(mix_id, source, k, slot): the k-th slot of each source, from mixes (mix_id, n_slots, edges).

    ``edges`` has struct(upper, source) in order, one for each source of the mix. Slots are made and ranked in
    chunks, so a schedule of any length is spread over tasks.
    """
    chunks = mixes.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_slots") - 1) / CHUNK)))).repartition("mix_id", "_chunk")
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, F.col("n_slots")) - 1)))
    turn = (F.col("slot") + 0.5) * GOLDEN
    passed = F.size(F.filter("edges", lambda e: e["upper"] <= F.col("_point")))
    slots = slots.withColumn("_point", turn - F.floor(turn)).withColumn("source", F.get("edges", F.least(passed, F.size("edges") - 1))["source"]).select("mix_id", "source", "_chunk", "slot")
    sums = slots.groupBy("mix_id", "source", "_chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_id", "source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("mix_id", "source", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("mix_id", "source", "_chunk").orderBy("slot"))
    return slots.withColumn("_row", inside).join(offsets, ["mix_id", "source", "_chunk"]).select("mix_id", "source", (F.col("_before") + F.col("_row") - 1).alias("k"), "slot")


def plan_mixes(targets: DataFrame, tokens: DataFrame, total: float | None = None, keep_weights: bool = False, block: int = BLOCK) -> DataFrame:
    """For every source of every mix that contributes: mix_id, source, whole (its tokens), asked, give, times, upper
    (the end of its share of the cumulated weights) and n_slots of its mix.

    ``tokens`` has source, whole. ``keep_weights`` takes the largest total at which no capped source falls short.
    """
    usable = targets.where("weight > 0 AND (max_repeats IS NULL OR max_repeats > 0)").join(tokens.where("whole > 0"), "source")
    each = Window.partitionBy("mix_id")
    part = F.col("weight") / F.sum("weight").over(each)
    usable = usable.withColumn("_part", part)
    most = F.col("max_repeats") * F.col("whole")
    size: Column = F.sum("whole").over(each).cast("double") if total is None else F.lit(float(total))
    if keep_weights:
        size = F.least(size, F.coalesce(F.min(most / F.col("_part")).over(each), size))
    usable = usable.withColumn("_total", size).withColumn("asked", F.col("_total") * F.col("_part")).withColumn("give", F.least("asked", F.coalesce(most.cast("double"), F.col("asked"))))
    up_to = Window.partitionBy("mix_id").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    n = F.ceil(F.col("_total") / block)
    slots = (n + F.ceil(F.log2(n + 2)) + 8).cast("bigint")  # a source may be behind its share by as many
    return usable.select("mix_id", "source", "whole", "asked", "give", F.ceil(F.col("give") / F.col("whole")).cast("int").alias("times"), F.sum("_part").over(up_to).alias("upper"), slots.alias("n_slots"))


def token_offsets(sized: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """(source, key, tokens, start): where each document begins in its source's shuffled stream of tokens.

    Tokens are added up in ranges of the hash, as many as there are ``ROWS`` documents, so that a source that has
    a third of all documents is spread over tasks.
    """
    rows = sized.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(size).alias("tokens"))
    ranges = max(64, rows.count() // ROWS)
    rows = rows.withColumn("_h", F.xxhash64("key", F.lit(8))).withColumn("_range", F.pmod(F.shiftright(F.col("_h"), 24), F.lit(ranges)))
    sums = rows.groupBy("source", "_range").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_range").orderBy("_h", "key").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "_range"]).select("source", "key", "tokens", (F.col("_before") + F.col("_in")).alias("start"))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", total: float | None = None, keep_weights: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(draws, shares).

    draws: mix_id, source, ``key``, repeat_no (from 0), slot, tokens, one row for every use of a document.
    shares: mix_id, source, weight, target_share, tokens, share, n_draws, available (its tokens, once) and shortfall
    (tokens of its part that it could not give under its cap) for every source of every mix.
    Documents of a null source, of sources in no mix, and of size 0 or null are not drawn. Rows of one mix and source
    count as one: weights are added, the greatest cap holds. A null or negative weight counts as 0; a null
    ``max_repeats`` means no cap; a null mix or source draws nothing. ``total`` asks for another number of tokens.
    Repeated documents are documents of their own. Empty tables give no draws. Nothing comes to the driver.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    cap = F.when(F.count("max_repeats") == F.count("*"), F.max("max_repeats"))
    wanted = cut(targets.groupBy("mix_id", "source").agg(F.sum(weight).alias("weight"), cap.alias("max_repeats")), "targets")
    names = wanted.where("weight > 0").select(F.col("source").alias(source)).distinct()
    starts = cut(token_offsets(cut(join_small(sized.select(key, source, size), names, [source], "left_semi"), "listed"), key, source, size), "offsets")
    tokens = cut(starts.groupBy("source").agg(F.sum("tokens").alias("whole")), "tokens")
    plan = cut(plan_mixes(wanted, tokens, total, keep_weights, block), "plan")
    mixes = plan.groupBy("mix_id", "n_slots").agg(F.sort_array(F.collect_list(F.struct("upper", "source"))).alias("edges"))
    at = F.col("start") + F.col("repeat_no") * F.col("whole")
    drawn = join_small(starts, plan, ["source"]).withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).where(at + F.col("tokens") / 2 <= F.col("give"))
    drawn = drawn.select("mix_id", "source", "key", "repeat_no", "tokens", "n_slots", F.floor(at / block).alias("k"))
    draws = drawn.join(schedule(mixes), ["mix_id", "source", "k"], "left").select("mix_id", "source", F.col("key").alias(key), "repeat_no", F.coalesce("slot", "n_slots").alias("slot"), "tokens")
    sums = drawn.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_draws"))
    each, every = Window.partitionBy("mix_id"), F.coalesce("tokens", F.lit(0))
    shares = wanted.join(sums, ["mix_id", "source"], "left").join(tokens, "source", "left").join(plan.select("mix_id", "source", "asked", "give"), ["mix_id", "source"], "left").select(
        "mix_id", "source", "weight", F.try_divide(F.col("weight"), F.sum("weight").over(each)).alias("target_share"), every.alias("tokens"), F.coalesce(F.try_divide(every, F.sum(every).over(each)), F.lit(0.0)).alias("share"),
        F.coalesce("n_draws", F.lit(0)).alias("n_draws"), F.coalesce("whole", F.lit(0)).alias("available"), F.coalesce(F.round(F.col("asked") - F.col("give")).cast("bigint"), F.lit(0)).alias("shortfall"),
    )
    return draws, shares
