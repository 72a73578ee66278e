"""Splits that keep related records together.

Records that share a number (``编号``) or a sentence group, directly or through further records, form one block
and get the same split.  Spellings that differ only in formatting are the same; a group that is then not 16 hex
digits is no group, a number that is then empty is no number.

Method: numbers are first folded away: each number with several groups links its smallest group to the others.
The group graph is then contracted by random mate.  In every round each vertex throws a coin that hangs on its
name and the round; every tails vertex with a heads neighbour collapses into its smallest one.  Edges are renamed,
loops dropped, duplicates removed, until no edge is left.  The collapse tables are then unwound from last to first,
which gives every group its block.  Each round is a join and a distinct on one table that was written to the shared
folder, so no task holds more than its hash partition and a lost executor repeats one round at most.

Splits: blocks are ordered by hash and cut where their cumulative weight passes the given proportions, so blocks of
every size come into every split.  Only blocks heavier than a ``LARGE_PARTS``-th of the smallest split are placed before
that, heaviest first, each where most room is left; there are at most LARGE_PARTS / (smallest proportion) of them.  The
prefix sum runs over ranges of the hash, never over one sorted task.

Defined cases: a record without group goes with its number; without both it is a block of its own (by ``row_id``).
Repeated rows weigh as often as they occur.  Empty tables give empty results.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glossmill.functions.text import without_formatting
from glossmill.session import discard, materialize, materialize_counted

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
MAX_ROUNDS = 400
#: Hash ranges of the prefix sum: 16 to the power of so many.
RANGE_DIGITS = 3
LARGE_PARTS = 20


def record_keys(df: DataFrame) -> DataFrame:
    """(row_id, num, grp): normalised number and group, null where there is none."""
    num, grp = without_formatting("编号"), without_formatting("sentence_group")
    return df.select(
        "row_id",
        F.when(num != "", num).alias("num"),
        F.when(grp.rlike("^[0-9a-f]{16}$"), grp).alias("grp"),
    )


def group_links(keys: DataFrame) -> DataFrame:
    """(a, b) with a < b: for each number, its smallest group to each further one."""
    pairs = keys.where(F.col("num").isNotNull() & F.col("grp").isNotNull()).select("num", "grp").distinct()
    pairs = materialize(pairs, "number-groups")  # texts are cleaned once
    hubs = pairs.groupBy("num").agg(F.min("grp").alias("a"), F.max("grp").alias("z")).where(F.col("a") < F.col("z"))
    return pairs.join(hubs.select("num", "a"), "num").where(F.col("grp") > F.col("a")).select("a", F.col("grp").alias("b")).distinct()


def _heads(v: Column, round_no: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(round_no), v), F.lit(2)) == 0


def contract(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(vertex, block) for every vertex of ``links(a, b)``: random-mate contraction, then unwinding."""
    spark = links.sparkSession
    edges, path, left_over = materialize_counted(links, "links")
    if not left_over:
        return edges.select(F.col("a").alias("vertex"), F.col("a").alias("block"))
    vertices = materialize(edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "vertex"), "vertices")
    collapses: list[DataFrame] = []
    for k in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mates = both.where(~_heads(F.col("a"), k) & _heads(F.col("b"), k)).groupBy("a").agg(F.min("b").alias("into"))
        mates = materialize(mates, "mates")
        collapses.append(mates)
        left = mates.select("a", F.col("into").alias("na"))
        right = mates.select(F.col("a").alias("b"), F.col("into").alias("nb"))
        renamed = edges.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y")
        )
        smaller = renamed.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new_edges, new_path, left_over = materialize_counted(smaller, "links")
        discard(spark, path)
        edges, path = new_edges, new_path
        if not left_over:
            break
    else:
        raise RuntimeError(f"contraction left edges after {max_rounds} rounds")
    return unwind(vertices, collapses)


def unwind(vertices: DataFrame, collapses: list[DataFrame]) -> DataFrame:
    """Replay the collapses backwards.  A vertex collapses once at most, so each round only adds its own children."""
    known = None
    for mates in reversed(collapses):
        child = mates.select(F.col("a").alias("vertex"), F.col("into"))
        if known is None:
            known = child.select("vertex", F.col("into").alias("block"))
            continue
        up = known.select(F.col("vertex").alias("into"), F.col("block").alias("top"))
        added = child.join(up, "into", "left").select("vertex", F.coalesce("top", "into").alias("block"))
        known = materialize(known.unionByName(added), "labels")
    return vertices.join(known, "vertex", "left").select("vertex", F.coalesce("block", "vertex").alias("block"))


def blocks(keys: DataFrame) -> DataFrame:
    """(grp, block_group): the smallest group of the block, for every group that is linked to another."""
    labels = materialize(contract(group_links(keys)), "block-labels")
    names = labels.groupBy("block").agg(F.min("vertex").alias("block_group"))
    return labels.join(names, "block").select(F.col("vertex").alias("grp"), "block_group")


def linked_groups(df: DataFrame) -> DataFrame:
    """(block_group, sentence_group): every group of a block of two or more, except the smallest."""
    found = blocks(record_keys(df))
    return found.where(F.col("grp") > F.col("block_group")).select("block_group", F.col("grp").alias("sentence_group"))


def record_blocks(df: DataFrame) -> DataFrame:
    """(row_id, block): the block every record belongs to."""
    keys = materialize(record_keys(df), "record-keys")
    named = blocks(keys)
    by_num = (
        keys.where(F.col("num").isNotNull() & F.col("grp").isNotNull())
        .groupBy("num")
        .agg(F.min("grp").alias("num_grp"))
    )
    # rows without group look it up by number, rows without either stay out of the joins: no null is ever a join key
    grouped = keys.where(F.col("grp").isNotNull()).select("row_id", "num", F.col("grp").alias("g"))
    numbered = keys.where(F.col("grp").isNull() & F.col("num").isNotNull()).join(by_num, "num", "left")
    placed = grouped.unionByName(numbered.select("row_id", "num", F.col("num_grp").alias("g")))
    in_group = placed.where(F.col("g").isNotNull()).join(named.withColumnRenamed("grp", "g"), "g", "left")
    return (
        in_group.select("row_id", F.concat(F.lit("g:"), F.coalesce("block_group", "g")).alias("block"))
        .unionByName(placed.where(F.col("g").isNull()).select("row_id", F.concat(F.lit("n:"), F.col("num")).alias("block")))
        .unionByName(keys.where(F.col("grp").isNull() & F.col("num").isNull()).select("row_id", F.concat(F.lit("r:"), F.col("row_id").cast("string")).alias("block")))
    )


def assign_splits(df: DataFrame, proportions=PROPORTIONS, seed: int = 42) -> DataFrame:
    """(row_id, block, split): whole blocks are cut into splits by cumulative weight."""
    placed = materialize(record_blocks(df), "record-blocks")
    weight = placed.groupBy("block").agg(F.count(F.lit(1)).alias("w"))
    ranked = weight.select("block", "w", F.md5(F.concat(F.lit(f"{seed}:"), "block")).alias("h")).withColumn("rng", F.substring("h", 1, RANGE_DIGITS))
    ranked = materialize(ranked, "block-weights")
    total = ranked.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("t")).first()["t"]
    # few blocks can be this heavy, so they fit on the driver
    large = ranked.where(F.col("w") * LARGE_PARTS > F.lit(total * min(share for _, share in proportions))) if total else ranked.limit(0)
    heavy = sorted(((-r["w"], r["h"], r["block"]) for r in large.select("w", "h", "block").collect()))
    held = dict.fromkeys((name for name, _ in proportions), 0)
    homes = []
    for w, _, block in heavy:
        name = max(proportions, key=lambda p: (p[1] * total - held[p[0]], p[1]))[0]
        held[name] -= w
        homes.append((block, name))
    spark = df.sparkSession
    homes = spark.createDataFrame(homes, "block string, split string")
    small = ranked.join(F.broadcast(homes), "block", "left_anti")
    sums = sorted((r["rng"], r["s"]) for r in small.groupBy("rng").agg(F.sum("w").alias("s")).collect())
    left = sum(s for _, s in sums)
    offsets = spark.createDataFrame([(r, int(o)) for (r, _), o in zip(sums, accumulate([0] + [s for _, s in sums][:-1]))], "rng string, base long")
    within = W.partitionBy("rng").orderBy("h", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.sum("w").over(within) + F.col("base") - F.col("w") / 2.0
    room = {name: max(0.0, share * total - held[name]) for name, share in proportions}
    scale = left / max(sum(room.values()), 1.0)
    split, upto = F.lit(proportions[-1][0]), left
    for name, _ in reversed(proportions):
        split = F.when(F.col("place") < upto, F.lit(name)).otherwise(split)
        upto -= room[name] * scale
    chosen = small.join(F.broadcast(offsets), "rng").withColumn("place", place).select("block", split.alias("split"))
    return placed.join(chosen.unionByName(homes), "block").select("row_id", "block", "split")
