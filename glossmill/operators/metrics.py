"""Classification metrics, agreement and paired tests as two-stage aggregates.

All of them first reduce rows to a small confusion table with map-side combining; what follows works on that.
Three kinds of macro-F1 are kept apart: over the labels seen in gold or prediction (``union_label_metrics``), over a
given list (``fixed_label_metrics``), and over gold labels only (the bootstrap).

Defined cases: rows with a null gold or prediction are left out by ``confusion``; a ratio over nothing is 0.0;
hard-negative accuracy without negatives is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glossmill.functions.text import ratio


def confusion(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "prediction") -> DataFrame:
    """(keys, gold, prediction, n)."""
    known = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    return known.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def label_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, tp, support, predicted, precision, recall, f1) over labels seen on either side."""
    g = cells.select(*keys, F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gold") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"))
    p = cells.select(*keys, F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    s = g.unionByName(p).groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    return with_prf(s)


def with_prf(s: DataFrame) -> DataFrame:
    return (
        s.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    )


def _summary(scores: DataFrame, keys: list[str], negative: str | None) -> DataFrame:
    hard = F.max(F.when((F.col("label") == negative) & (F.col("support") > 0), F.col("recall"))) if negative else F.lit(None).cast("double")
    return scores.groupBy(*keys).agg(
        F.sum("support").alias("n_rows"),
        F.round(ratio(F.sum("tp"), F.sum("support")), 6).alias("accuracy"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(hard, 6).alias("hard_negative_accuracy"),
    )


def union_label_metrics(df: DataFrame, keys: list[str], negative: str | None = None, gold="gold", pred="prediction") -> DataFrame:
    """(keys, n_rows, accuracy, macro_f1, hard_negative_accuracy)."""
    return _summary(label_scores(confusion(df, keys, gold, pred), keys), keys, negative)


def fixed_label_metrics(df: DataFrame, keys: list[str], labels: list[str], negative: str | None = None, gold="gold", pred="prediction") -> DataFrame:
    """As ``union_label_metrics`` over exactly ``labels``; labels that never occur score 0."""
    cells = confusion(df, keys, gold, pred)
    seen = label_scores(cells, keys)
    grid = cells.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    counts = ["tp", "support", "predicted"]
    full = grid.join(seen.select(*keys, "label", *counts), [*keys, "label"], "left").fillna(0, counts)
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("all_rows"), F.sum(F.when(F.col("gold") == F.col("prediction"), F.col("n")).otherwise(0)).alias("right"))
    out = _summary(with_prf(full), keys, negative).drop("n_rows", "accuracy").join(totals, keys)
    return out.select(*keys, F.col("all_rows").alias("n_rows"), F.round(ratio(F.col("right"), F.col("all_rows")), 6).alias("accuracy"), "macro_f1", "hard_negative_accuracy")


def binary_f1(df: DataFrame, keys: list[str], positive: str, gold="gold", pred="prediction") -> DataFrame:
    """(keys, n_rows, pos_f1, neg_f1, macro_f1, negative_recall) from first principles; empty classes score 0."""
    known = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    g, p = F.col(gold) == positive, F.col(pred) == positive
    n = lambda c: F.count_if(c)
    f1 = lambda tp, fp, fn: F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)
    tp, fp, fn, tn = n(g & p), n(~g & p), n(g & ~p), n(~g & ~p)
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), f1(tp, fp, fn).alias("pos_f1"), f1(tn, fn, fp).alias("neg_f1"),
        F.round((ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fn + fp)) / 2, 6).alias("macro_f1"),
        F.round(ratio(tn, tn + fp), 6).alias("negative_recall"),
    )


def mean_by_key(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form: (keys, metric, mean, std, min, max, n).  Null values are skipped; one value has std 0.0."""
    long = df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy(*keys, "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"),
        F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"), F.count(F.lit(1)).alias("n"),
    )


def mean_wide(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide form: {metric}_mean and {metric}_std per key."""
    cells = []
    for m in metrics:
        cells += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 6).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*cells)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact McNemar p: twice the smaller binomial tail at one half, at most 1; 1 when nothing is discordant.

    The tail is summed in log space, so large counts neither overflow nor vanish.
    """
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    ln_fact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    start = F.struct(F.lit(0.0).alias("lc"), F.lit(1.0).alias("rel"))
    # relative to C(n, k): terms below shrink by i / (n - i + 1)
    down = F.when(k > 0, F.sequence(k, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rel = F.aggregate(down, start, lambda a, i: F.struct((a["lc"] + F.ln(i.cast("double")) - F.ln((n - i + 1).cast("double"))).alias("lc"), (a["rel"] + F.exp(a["lc"] + F.ln(i.cast("double")) - F.ln((n - i + 1).cast("double")))).alias("rel")))["rel"]
    log_top = ln_fact(n) - ln_fact(k) - ln_fact(n - k) - n * F.lit(0.6931471805599453)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(log_top + F.ln(rel))))


def paired_contingency(df: DataFrame, keys: list[str], item: list[str], a: str, b: str, system: str = "system", correct: str = "correct") -> DataFrame:
    """(keys, both_right, only_a, only_b, both_wrong, oracle_accuracy, p_value) of two systems on the same items."""
    wide = df.where(F.col(system).isin(a, b)).groupBy(*keys, *item).agg(
        F.max(F.when(F.col(system) == a, F.col(correct).cast("int"))).alias("a"), F.max(F.when(F.col(system) == b, F.col(correct).cast("int"))).alias("b")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    n = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    counts = wide.groupBy(*keys).agg(n(1, 1).alias("both_right"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("both_wrong"))
    total = F.col("both_right") + F.col("only_a") + F.col("only_b") + F.col("both_wrong")
    return counts.withColumn("oracle_accuracy", F.round(ratio(total - F.col("both_wrong"), total), 6)).withColumn(
        "p_value", F.round(binomial_two_sided(F.col("only_a"), F.col("only_b")), 6)
    )


def alignment_gaps(df: DataFrame, item: list[str], system: str, expected: int) -> DataFrame:
    """Items that some system lacks, answers more than once, or sees with another gold label."""
    return df.groupBy(*item).agg(
        F.countDistinct(system).alias("n_systems"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gold").alias("n_gold")
    ).where((F.col("n_systems") != expected) | (F.col("n_rows") != expected) | (F.col("n_gold") > 1))


def cohen_kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, observed, expected, kappa); 1.0 when chance agreement is already complete."""
    cells = confusion(df, keys, a, b)
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    rows = cells.groupBy(*keys, F.col("gold").alias("label")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*keys, F.col("prediction").alias("label")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("prod"))
    base = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("prediction"), F.col("n")).otherwise(0)).alias("same"))
    j = base.join(chance, keys, "left") if keys else base.crossJoin(chance)
    po = F.col("same") / F.col("n")
    pe = F.coalesce(F.col("prod"), F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(*keys, "n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def fleiss_ac1(ratings: DataFrame, item: list[str], label: str, raters: int) -> DataFrame:
    """One row: items, observed agreement, Fleiss' kappa, Gwet's AC1, share of unanimous and of majority items.

    Items that don't have exactly ``raters`` ratings are left out.
    """
    counts = ratings.where(F.col(label).isNotNull()).groupBy(*item, label).agg(F.count(F.lit(1)).alias("c"))
    per_item = counts.groupBy(*item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max("c").alias("top")).where(F.col("r") == raters)
    obs = per_item.agg(
        F.count(F.lit(1)).alias("n_items"), F.avg((F.col("sq") - raters) / F.lit(float(raters * (raters - 1)))).alias("po"),
        F.avg((F.col("top") == raters).cast("double")).alias("unanimous"), F.avg((F.col("top") >= 2).cast("double")).alias("majority"),
    )
    shares = counts.join(per_item.select(*item), item, "left_semi").groupBy(label).agg(F.sum("c").alias("c"))
    total = shares.agg(F.sum("c").alias("t"))
    p = shares.crossJoin(F.broadcast(total)).select((F.col("c") / F.col("t")).alias("p"))
    chance = p.agg(F.sum(F.col("p") * F.col("p")).alias("pe"), (F.sum(F.col("p") * (1 - F.col("p"))) / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("pa"))
    kappa = lambda po, pe: F.round(F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)), 6)
    return obs.crossJoin(F.broadcast(chance)).select(
        "n_items", F.round("po", 6).alias("observed"), kappa(F.col("po"), F.col("pe")).alias("fleiss_kappa"), kappa(F.col("po"), F.col("pa")).alias("ac1"),
        F.round("unanimous", 6).alias("unanimous"), F.round("majority", 6).alias("majority"),
    )


def span_scores(df: DataFrame, keys: list[str], gold: str, pred: str, sentence: str) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1, relaxed, grounded): a wrong span counts as fp and as fn."""
    g, p = F.coalesce(F.col(gold), F.lit("")), F.coalesce(F.col(pred), F.lit(""))
    tp = F.count_if((g != "") & (g == p))
    fp = F.count_if((p != "") & (g != p))
    fn = F.count_if((g != "") & (g != p))
    both = (g != "") & (p != "")
    return df.groupBy(*keys).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(ratio(F.count_if(both & (g.contains(p) | p.contains(g))), F.count_if(both)), 6).alias("relaxed"),
        F.round(ratio(F.count_if((p != "") & F.col(sentence).contains(p)), F.count_if(p != "")), 6).alias("grounded"),
    )
