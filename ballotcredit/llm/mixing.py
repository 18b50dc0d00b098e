"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets come from weights by water filling under a cap. The words of the mix are cut into equal
blocks, given to sources by highest quotients, and each source's blocks to its shards in the same
way. A shard is a bounded part of a source, so a hot source is many groups; its documents lie in
a seeded order, and a seeded permutation chooses its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, without, word_count
from ballotcredit.sources.sinks import written

# A prime above any number of blocks of a shard: its multiples permute the block numbers.
STRIDE = 2147483647


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) with target: weighted shares of all words, none above ``cap`` sizes.

    A source is full if its capacity lies below its share of what the sources that fill earlier
    (least capacity per weight) leave; comparisons are exact. One row per source.
    """
    whole, rest = Window.partitionBy(), Window.orderBy("fill", "place")
    before = rest.rowsBetween(Window.unboundedPreceding, -1)
    onward = rest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = "decimal(38,0)"
    weight = F.element_at(
        F.array([F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    filled = (
        sizes.withColumn(
            "place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
        )
        .withColumn("weight", weight.cast("long"))
        .withColumn("room", F.col("source_size") * cap)
        .withColumn("fill", F.col("room").cast(big) * math.lcm(*weights) / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(whole))
        .withColumn("earlier", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("heads", F.sum("weight").over(onward))
        .withColumn(
            "full",
            F.col("room").cast(big) * F.col("heads")
            <= F.col("weight").cast(big) * (F.col("all") - F.col("earlier")),
        )
        .withColumn("used", F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    )
    share = F.try_divide(
        F.col("weight").cast("double") * (F.col("all") - F.col("used")), F.col("open"))
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(share)
    return filled.select("source", "place", "source_size", "all", target.alias("target"))


def sainte_lague(votes: DataFrame, keys: Sequence[str], vote: str, seats: str) -> DataFrame:
    """``votes`` with ``won``: integer seats by highest quotients vote / (2k + 1), k = 0, 1, ...

    ``seats`` holds the seats to give within a group of ``keys``. Dividers a little above and a
    little below the ideal one bound each party's seats, so only the few seats between the bounds
    are ranked by quotient. Ties go to the earlier ``place``.
    """
    group = Window.partitionBy(*keys)
    total, parties = F.sum(vote).over(group), F.count(F.lit(1)).over(group)
    per_seat = F.col("seats_") + F.lit(0.0)

    def held(n: Column) -> Column:
        return F.coalesce(
            F.floor(F.try_divide(F.col(vote) * n, F.col("total_")) + 0.5), F.lit(0)).cast("long")

    bounds = (
        votes.withColumn("total_", total.cast("double")).withColumn("parties_", parties)
        .withColumn("seats_", F.col(seats))
        .withColumn("sure_", F.greatest(
            held(F.greatest(per_seat - F.col("parties_") / 2, F.lit(0.0))) - 1, F.lit(0)))
        .withColumn("most_", held(per_seat + F.col("parties_") / 2) + 1)
        .withColumn("left_", F.col(seats) - F.sum("sure_").over(group))
    )
    ranked = Window.partitionBy(*keys).orderBy(F.desc("quotient_"), "place", "seat_")
    contested = (
        bounds.where(F.col(vote) > 0)
        .withColumn("seat_", F.explode(F.expr("sequence(sure_, most_)")))
        .withColumn("quotient_", F.col(vote) / (2 * F.col("seat_") + 1))
        .withColumn("rank_", F.row_number().over(ranked))
        .groupBy(*keys, "place")
        .agg(F.sum((F.col("rank_") <= F.col("left_")).cast("long")).alias("more_"))
    )
    same = F.lit(True)
    right = contested.select(*[F.col(k).alias(f"{k}_r") for k in [*keys, "place"]], "more_")
    for k in [*keys, "place"]:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    won = F.when(F.col(vote) > 0, F.col("sure_")).otherwise(0) + F.coalesce("more_", F.lit(0))
    return bounds.join(right, same, "left").select(
        *votes.columns, won.cast("long").alias("won"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    block_words: int = 16,
    shard_words: int = 2_000_000,
    seed: int = 7,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: str | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    Sources in code point order, a missing source last, weigh ``weights`` in turn and share all
    words by weight; a target stops at ``cap`` times its source's words and the excess is shared
    again. The mix is cut into blocks of ``block_words`` words; blocks are apportioned to sources
    by their targets, and to shards of about ``shard_words`` words by their sizes. A shard takes
    whole passes while its quota lasts, then blocks chosen by a seeded permutation, so no document
    is taken more than ``cap`` times and a source's taken words miss its target by about half a
    block per shard. Reruns agree, whatever the partitioning.

    ``size`` names a column of ready word counts, for calls without the texts; without it the rows
    are written once with their counts, so texts are counted once. The four result
    columns replace input columns of these names. A missing or empty text has size 0, is not taken
    and takes no part in a shard, however many there are; rows that repeat an id are separate
    documents; an empty table gives none.
    """
    words = word_count(column(docs, text)) if size is None else F.coalesce(
        column(docs, size).cast("long"), F.lit(0))
    slim = without(docs, ["size", "source_size", "target", "taken"] if size != "size" else
                   ["source_size", "target", "taken"])
    names = [c for c in slim.columns if c != size or size != "size"]
    own = {n: fresh(docs.columns, n) for n in ("m_size", "m_shard", "m_order", "m_source")}
    base = docs.select(
        *[column(docs, c) for c in names], words.alias(own["m_size"]),
        column(docs, source).alias(own["m_source"]),
        F.xxhash64(F.lit(seed), column(docs, doc_id), words).alias(own["m_order"]),
    )
    if size is None:
        base = written(base)
    sizes = base.groupBy(F.col(own["m_source"]).alias("source")).agg(
        F.sum(own["m_size"]).alias("source_size"))
    # Tables of a row per source and per shard are written: both sides of their joins read them.
    targets = written(source_targets(sizes, weights, cap))
    seats = F.round(F.col("all") / block_words).cast("long")
    won = (
        sainte_lague(targets.withColumn("seats", seats), [], "target", "seats")
        .withColumn("n_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)))
        .select(F.col("source").alias("t_source"), F.col("place").alias("t_place"), "source_size",
                "target", F.col("won").alias("t_won"), "n_shards")
    )
    own |= {n: fresh(base.columns, n) for n in ("t_source", "t_place", "source_size", "target",
                                                 "t_won", "n_shards")}
    known = base.join(
        won.toDF(*[own[c] for c in won.columns]),
        F.col(own["m_source"]).eqNullSafe(F.col(own["t_source"])),
    )
    placed = known.where(F.col(own["m_size"]) > 0).withColumn(own["m_shard"], F.pmod(F.shiftright(own["m_order"], 20), F.col(own["n_shards"])))
    shards = written(
        placed.groupBy(F.col(own["t_place"]).alias("q_source"), F.col(own["m_shard"]).alias("place"))
        .agg(F.sum(own["m_size"]).alias("shard_size"), F.first(own["t_won"]).alias("seats"))
    )
    quotas = sainte_lague(shards, ["q_source"], "shard_size", "seats").select("q_source", F.col("place").alias("q_shard"), "shard_size", "won")
    own |= {n: fresh(placed.columns, n) for n in ("q_source", "q_shard", "shard_size", "won")}
    shard = Window.partitionBy(own["t_place"], own["m_shard"])
    line = shard.orderBy(own["m_order"], own["m_size"], column(placed, doc_id)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = fresh(placed.columns + list(own.values()), "m_end")
    laid = placed.withColumn(end, F.sum(own["m_size"]).over(line)).join(
        quotas.toDF(*[own[c] for c in quotas.columns]),
        (F.col(own["t_place"]) == F.col(own["q_source"]))
        & (F.col(own["m_shard"]) == F.col(own["q_shard"])),
    )
    stop, length, held = F.col(end), F.col(own["m_size"]), F.col(own["shard_size"])
    start = stop - length
    quota = F.col(own["won"]) * block_words
    passes = F.least(F.lit(cap), F.floor(F.coalesce(F.try_divide(quota, held), F.lit(0))))
    blocks = F.greatest(F.ceil(held / block_words), F.lit(1))
    rest = F.when(passes >= cap, 0).otherwise(
        F.least(blocks, F.round((quota - passes * held) / block_words))).cast("long")
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), own["t_place"], own["m_shard"]), blocks)

    def overlap(taken: Column, k: Column) -> Column:
        inside = F.least(stop, (k + 1) * block_words) - F.greatest(start, k * block_words)
        return taken + F.when(F.pmod(k * F.lit(STRIDE) + shift, blocks) < rest, inside).otherwise(0)

    first, last = F.floor(start / block_words), F.floor((stop - 1) / block_words)
    more = F.when(length > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), overlap))
    taken = passes * length + F.coalesce(more, F.lit(0))

    def shown(rows: DataFrame, taken: Column) -> DataFrame:
        return rows.select(
            *[column(rows, c) for c in names],
            F.col(own["m_size"]).alias("size"),
            F.col(own["source_size"]).alias("source_size"),
            F.col(own["target"]).alias("target"),
            taken.cast("long").alias("taken"),
        )

    empty = known.where(F.col(own["m_size"]) <= 0)
    return shown(laid, taken).unionByName(shown(empty, F.lit(0)))
