"""Ranking, deduplication and selection.

Orders always end in a unique key, so results never hang on row order.  Where one group may be unbounded, choices are
made by aggregates of structs, which combine map-side, and ranks in two passes (``global_rank``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glossmill.functions.text import ratio
from glossmill.session import materialize

#: Pages kept for a point, the least score and the share of the best score that count as near.
PAGES, PAGE_FLOOR, PAGE_NEAR = 8, 8.0, 0.62


def majority_label(df: DataFrame, keys: list[str], label: str, ordinal: str) -> DataFrame:
    """(keys, majority): the most frequent label; ties go to the one met first by ``ordinal``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), "first")).alias("majority"))


def risk(confidence: Column, conflict: Column, weak: Column, missing: float = 0.5) -> Column:
    """1 - confidence, plus 1 for a strong conflict and a quarter for a weak one."""
    return 1.0 - F.coalesce(confidence, F.lit(missing)) + conflict.cast("double") + 0.25 * weak.cast("double")


def budget_size(n: Column, share: float) -> Column:
    """At least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(n.cast("double") * F.lit(float(share)), 0).cast("int"))


def group_rank(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """Adds ``rank`` and ``group_rows`` within each key, without one task ever holding a whole group.

    Rows are range-partitioned by (keys, order) and written once, so that the ranges stay what they are; rows are
    counted per range and key, and ranked within their range on top of the counts of the ranges before.  Without
    ``ranges`` the shuffle's own number counts, which adaptive execution fits to the size of the data.
    ``order`` has to end in a unique column.
    """
    ranged = materialize(df.repartitionByRange(*([ranges] if ranges else []), *[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_p", *keys).agg(F.count(F.lit(1)).alias("_c"))
    by_key = W.partitionBy(*keys)
    before = by_key.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(by_key).alias("group_rows"),
    )
    cond = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(W.partitionBy("_p", *keys).orderBy(*order))
    ranked = ranged.withColumn("_r", within).join(offsets, cond)
    return ranked.withColumn("rank", F.col("_r") + F.col("_base")).drop("_p", "_q", "_r", "_base", *[f"_k{i}" for i in range(len(keys))])


def review_queue(df: DataFrame, keys: list[str], risk_col: str, item: str, share: float) -> DataFrame:
    """The riskiest rows of each key within the budget, with their rank."""
    ranked = group_rank(df, keys, [F.desc(risk_col), F.asc(item)])
    return ranked.where(F.col("rank") <= budget_size(F.col("group_rows"), share)).drop("group_rows")


def selective_review(df: DataFrame, keys: list[str], risk_col: str, item: str, correct: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, budget, n_rows, reviewed, review_rate, coverage, retained_accuracy, error_capture, review_precision).

    Rows are ranked once for all budgets.
    """
    ranked = group_rank(df.select(*keys, risk_col, item, correct), keys, [F.desc(risk_col), F.asc(item)])
    each = ranked.withColumn("budget", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    size = F.greatest(F.lit(1), F.bround(F.col("group_rows").cast("double") * F.col("budget"), 0).cast("int"))
    seen, wrong = F.col("rank") <= size, F.col(correct) == 0
    n, k, e = F.count(F.lit(1)), F.count_if(seen), F.count_if(wrong)
    caught = F.count_if(seen & wrong)
    r6 = lambda c: F.round(c, 6)
    return each.groupBy(*keys, "budget").agg(
        n.alias("n_rows"), k.alias("reviewed"), r6(ratio(k, n)).alias("review_rate"),
        r6(1.0 - ratio(k, n)).alias("coverage"), r6(ratio(F.count_if(~seen & ~wrong), n - k)).alias("retained_accuracy"),
        r6(ratio(caught, e)).alias("error_capture"), r6(ratio(caught, k)).alias("review_precision"),
    )


def quota_sample(df: DataFrame, stratum: str, quality: str, item: str, quota: int, seed: int) -> DataFrame:
    """Best ``quota`` rows of each stratum by quality, ties shuffled by a seeded hash, with batch labels."""
    shuffle = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string")))
    top = df.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy(F.desc(quality), shuffle, F.asc(item))))
    return top.where(F.col("rank") <= quota).withColumn("batch", F.pmod(F.col("rank") - 1, F.lit(6)) + 1)


def dedup_prefer(df: DataFrame, keys: list[str], preferred: Column, ordinal: str) -> DataFrame:
    """One row per key: one for which ``preferred`` holds if there is any, else the first.

    Done as an aggregate of structs, not a window, so a key that holds a third of the rows is combined map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct((~preferred).cast("int").alias("_p"), F.col(ordinal).alias("_o"), F.struct(*rest).alias("_v"))).alias("b"))
    return best.select(*keys, *[F.col(f"b._v.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return dedup_prefer(df, keys, F.lit(True), ordinal)


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(ordinal).alias("_o"), F.struct(*rest).alias("_v"))).alias("b"))
    return best.select(*keys, *[F.col(f"b._v.{c}").alias(c) for c in rest])


def top_with_margin(df: DataFrame, keys: list[str], score: str, order: list[Column]) -> DataFrame:
    """Best row of each key with the margin to the runner-up (0.0 as the missing second score).

    Only the two best rows of each key and task are shuffled (the engine limits the window by its rank).
    """
    two = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= 2)
    rest = [c for c in df.columns if c not in keys]
    best = two.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.struct(*rest))).alias("_b"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(score))), F.lit(0.0)).alias("_second")
    )
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest], F.round(F.col(f"_b.{score}") - F.col("_second"), 6).alias("margin"))


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of re-run keys replaced by the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def global_rank(df: DataFrame, order_key: str, item: str, ranges: int = 64) -> DataFrame:
    """Adds ``rank`` over all rows by (order_key, item) without one global sort task."""
    return group_rank(df.withColumn("_all", F.lit(1)), ["_all"], [F.asc(order_key), F.asc(item)], ranges).drop("_all", "group_rows")


def greedy_pages(scored: DataFrame, keys: list[str], limit: int = PAGES, floor: float = PAGE_FLOOR, near: float = PAGE_NEAR) -> DataFrame:
    """(keys, pages): walk pages by falling score; keep one that is near the best or covers a new keyword.

    ``scored`` holds page, score and words (array); at most ``limit`` pages are kept per key.  Of pages with the same
    words only the ``limit`` best can ever be kept (the first covers the words, and near ones fill the limit), so no
    more are gathered, whatever the number of pages.
    """
    same = W.partitionBy(*keys, "words").orderBy(F.desc("score"), F.asc("page"))
    scored = scored.withColumn("words", F.array_sort("words")).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= limit).drop("_r")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "page", "words")))
    start = F.struct(F.array().cast("array<int>").alias("pages"), F.array().cast("array<string>").alias("seen"))
    best = -F.element_at("ps", 1)["neg"]
    close = lambda x: -x["neg"] >= F.greatest(F.lit(floor), F.lit(near) * best)
    fresh = lambda acc, x: F.size(F.array_except(x["words"], acc["seen"])) > 0
    step = lambda acc, x: F.when(
        (F.size(acc["pages"]) < limit) & (close(x) | fresh(acc, x)),
        F.struct(F.concat(acc["pages"], F.array(x["page"])).alias("pages"), F.array_union(acc["seen"], x["words"]).alias("seen")),
    ).otherwise(acc)
    return scored.groupBy(*keys).agg(ordered.alias("ps")).select(*keys, F.aggregate("ps", start, step)["pages"].alias("pages"))
