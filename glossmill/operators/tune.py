"""Rule reliability, rerank and grid search as joins and aggregates.

Grids are literal frames of a fixed size (the weight grid has 1,260 rows); rows are first reduced to counts per
distinct feature vector, so a grid search never multiplies the data.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import ratio
from glossmill.operators.metrics import union_label_metrics

CLIP = 1e-4
#: The grid of vote weights of the rerank.
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
#: The grid of weights of the rule states (accept, weak, strong) and of thresholds.
GRID = {
    "w_accept": (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0),
    "w_weak": (-3.0, -2.0, -1.5, -1.0, -0.5, 0.0),
    "w_strong": (-6.0, -4.0, -3.0, -2.0, -1.0, 0.0),
    "threshold": (-1.0, -0.5, 0.0, 0.5, 1.0),
}


def logit(p: Column) -> Column:
    c = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), p))
    return F.ln(c / (1 - c))


def rule_reliability(df: DataFrame, rule: str, correct: str) -> DataFrame:
    """(rule, support, hits, posterior, grade, weight) from rows of fired rules on the training split."""
    agg = df.groupBy(F.col(rule).alias("rule")).agg(F.count(F.lit(1)).alias("support"), F.sum(F.col(correct).cast("long")).alias("hits"))
    post = (F.col("hits") + 1.0) / (F.col("support") + 2.0)
    a, b, d = (F.col("support") >= 20) & (post >= 0.8), (F.col("support") >= 5) & (post >= 0.65), post < 0.5
    grade = F.when(a, "A").when(b, "B").when(d, "D").otherwise("insufficient")
    weight = F.when(a, post).when(b, 0.65 * post).when(d, 0.0).otherwise(0.15)
    return agg.select("rule", "support", "hits", F.round(post, 6).alias("posterior"), grade.alias("grade"), F.round(weight, 6).alias("weight"))


def rerank(probs: DataFrame, votes: DataFrame, item: str, alpha: float | Column) -> DataFrame:
    """(item, label, p): softmax of log p + alpha * mean vote weight.  probs(item, label, p), votes(item, label, weight)."""
    mean = votes.groupBy(item, "label").agg(F.avg("weight").alias("w"))
    z = F.ln(F.greatest(F.col("p"), F.lit(1e-9))) + (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * F.coalesce("w", F.lit(0.0))
    scored = probs.join(mean, [item, "label"], "left").withColumn("e", F.exp(z))
    total = scored.groupBy(item).agg(F.sum("e").alias("t"))
    return scored.join(total, item).select(item, "label", F.round(F.col("e") / F.col("t"), 6).alias("p"))


def top_label(scored: DataFrame, item: str) -> DataFrame:
    """(item, label, p): highest p, ties to the smaller label."""
    best = scored.groupBy(item).agg(F.min(F.struct((-F.col("p")).alias("n"), "label")).alias("b"))
    return best.select(item, F.col("b.label").alias("label"), (-F.col("b.n")).alias("p"))


def alpha_scores(probs: DataFrame, votes: DataFrame, gold: DataFrame, item: str, negative: str) -> DataFrame:
    """(alpha, macro_f1, hard_negative_accuracy, accuracy, n_rows) of the reranked labels for every alpha of the grid.  gold(item, gold)."""
    each = lambda df: df.withColumn("_a", F.explode(F.array(*[F.lit(a) for a in ALPHAS]))).withColumn("_k", F.struct(F.col("_a").alias("alpha"), F.col(item).alias("item"))).drop("_a", item)
    top = top_label(rerank(each(probs), each(votes), "_k", F.col("_k.alpha")), "_k")
    known = top.select(F.col("_k.alpha").alias("alpha"), F.col("_k.item").alias(item), F.col("label").alias("prediction")).join(gold, item)
    return union_label_metrics(known, ["alpha"], negative)


def best_alpha(scores: DataFrame) -> float:
    """Highest macro-F1, then hard-negative accuracy (0 where there is none), then accuracy, then the smallest alpha; 0.0 without scores."""
    rows = scores.collect()  # one row per alpha
    return min(rows, key=lambda r: (-r["macro_f1"], -(r["hard_negative_accuracy"] or 0.0), -r["accuracy"], r["alpha"]))["alpha"] if rows else 0.0


def weight_grid(spark) -> DataFrame:
    rows = [(i, *[float(x) for x in combo]) for i, combo in enumerate(product(*GRID.values()))]
    return spark.createDataFrame(rows, "grid int, " + ", ".join(f"{k} double" for k in GRID))


def governor_grid(df: DataFrame, keys: list[str], positive_gold: str = "gold_pos") -> DataFrame:
    """(keys, grid, weights, macro_f1, accuracy): scores of every grid point.

    ``df`` holds margin (rounded logit), accepted, weak, strong as 0/1 and the gold flag.
    """
    reduced = df.groupBy(*keys, "margin", "accepted", "weak", "strong").agg(
        F.sum(F.col(positive_gold).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    x = reduced.crossJoin(F.broadcast(weight_grid(df.sparkSession)))
    z = F.col("margin") + F.col("w_accept") * F.col("accepted") + F.col("w_weak") * F.col("weak") + F.col("w_strong") * F.col("strong")
    yes = z >= F.col("threshold")
    pick = lambda c, v: F.sum(F.when(c, v).otherwise(F.lit(0)))
    neg = F.col("n") - F.col("pos")
    g = x.groupBy(*keys, "grid", *GRID).agg(
        pick(yes, F.col("pos")).alias("tp"), pick(yes, neg).alias("fp"), pick(~yes, F.col("pos")).alias("fn"), pick(~yes, neg).alias("tn")
    )
    f = (ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) + ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fn") + F.col("fp"))) / 2
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.select(*keys, "grid", *GRID, F.round(f, 6).alias("macro_f1"), F.round(ratio(F.col("tp") + F.col("tn"), total), 6).alias("accuracy"))


def best_grid_point(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Highest macro-F1, then accuracy, then smallest sum of sizes of weights and threshold, then smallest ones in order."""
    size = F.abs("w_accept") + F.abs("w_weak") + F.abs("w_strong") + F.abs("threshold")
    order = F.struct((-F.col("macro_f1")).alias("a"), (-F.col("accuracy")).alias("b"), size.alias("c"), "w_accept", "w_weak", "w_strong", "threshold")
    best = scores.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.struct("grid", *GRID, "macro_f1", "accuracy").alias("v"))).alias("m"))
    return best.select(*keys, "m.v.*")
