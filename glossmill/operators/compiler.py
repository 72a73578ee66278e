"""Catalogue compilation: corrections, split units, taxonomy templates, contract tests, integrity audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import stable_id

#: The diagnosis labels of the contract tests, in order.
CASES = ("positive", "boundary", "missing_slot", "confusable", "semantic_incompatible", "other_construction", "uncertain")
#: Markers that number the parts of a text.
UNIT_MARK = r"(?:[0-9]+[.．、)]|[（(][0-9]+[)）]|[①②③④⑤⑥⑦⑧⑨])"


def reject_corrections(corrections: DataFrame) -> DataFrame:
    """(key, field, reason) of corrections that can't be applied: duplicate, unverified, or empty."""
    dup = corrections.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", "field", F.lit("duplicate").alias("reason"))
    bad = corrections.where(~F.coalesce(F.col("verified"), F.lit(False)) | (F.coalesce(F.col("new"), F.lit("")) == ""))
    why = F.when(F.coalesce(F.col("new"), F.lit("")) == "", "empty").otherwise("unverified")
    return dup.unionByName(bad.select("key", "field", why.alias("reason")))


def patch(df: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-level corrections (key, field, old, new) applied where the current value is the old one.

    Corrections are pivoted to one row per key, so the frame is joined once.  Adds ``patched``, the number of fields.
    """
    wide = corrections.groupBy(F.col("key").alias("_key")).agg(
        *[F.max(F.when(F.col("field") == f, F.struct("old", "new"))).alias(f"_fix_{f}") for f in fields]
    )
    out = df.join(wide, df[key] == F.col("_key"), "left")
    hits = [F.coalesce(F.col(f).eqNullSafe(F.col(f"_fix_{f}.old")) & F.col(f"_fix_{f}").isNotNull(), F.lit(False)) for f in fields]
    out = out.withColumn("patched", reduce(lambda a, b: a + b, [h.cast("int") for h in hits]))
    for f, h in zip(fields, hits):
        out = out.withColumn(f, F.when(h, F.col(f"_fix_{f}.new")).otherwise(F.col(f)))
    return out.drop("_key", *[f"_fix_{f}" for f in fields])


def split_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit_no, path, unit): numbered parts of a text; fewer than two markers leave it whole.

    What stands before the first marker is scope and joins every unit.
    """
    n = F.regexp_count(F.col(text), F.lit(UNIT_MARK))
    parts = F.transform(F.split(F.col(text), UNIT_MARK), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    scope, rest = F.element_at(parts, 1), F.filter(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts) - 1)), lambda p: p != "")
    units = F.when(n >= 2, F.transform(rest, lambda p: F.when(scope == "", p).otherwise(F.concat_ws(" ", scope, p)))).otherwise(F.array(F.col(text)))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(units).alias("i", "unit"))
    return rows.select(key, (F.col("i") + 1).alias("unit_no"), F.lpad((F.col("i") + 1).cast("string"), 2, "0").alias("path"), "unit")


def templates(df: DataFrame, path: list[str], regime: Column, ordinal: str) -> DataFrame:
    """(template_id, path columns, regime, members, first_member): one template per taxonomy path and regime."""
    r = df.withColumn("regime", regime)
    tid = stable_id("TPL-", *[F.col(c) for c in path], F.col("regime"))
    return r.withColumn("template_id", tid).groupBy("template_id", *path, "regime").agg(F.count(F.lit(1)).alias("members"), F.min(ordinal).alias("first_member"))


def decide(flags: dict[str, Column]) -> Column:
    """Decision ladder over named flags; the order is the contract."""
    return (
        F.when(flags["empty"], "uncertain")
        .when(flags["meta"], "other_construction")
        .when(flags["incompatible"], "semantic_incompatible")
        .when(flags["confusable"] & ~flags["marker"], "confusable")
        .when(~flags["marker"], "other_construction")
        .when(~flags["structure"], "missing_slot")
        .when(flags["overlong"], "boundary")
        .otherwise("positive")
    )


def contract_tests(bindings: DataFrame, key: str) -> DataFrame:
    """(key, test_id, case, input, expected): seven generated cases per binding, a lateral expansion without join."""
    marker = F.col("literal")
    inputs = {
        "positive": F.concat(marker, F.lit("甲乙丙")), "boundary": F.concat(marker, F.repeat(F.lit("甲"), 60)), "missing_slot": marker,
        "confusable": F.lit("近似形式"), "semantic_incompatible": F.concat(marker, F.lit("※")), "other_construction": F.lit("别的句式"), "uncertain": F.lit(""),
    }
    cases = F.array(*[F.struct(F.lit(c).alias("case"), inputs[c].alias("input")) for c in CASES])
    rows = bindings.select(key, "literal", F.posexplode(cases).alias("i", "c"))
    return rows.select(key, "literal", F.concat_ws("-", F.col(key), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("test_id"), "c.case", "c.input")


def run_contract_tests(tests: DataFrame) -> DataFrame:
    """Adds ``actual`` and ``passed``."""
    t, m = F.col("input"), F.col("input").contains(F.col("literal"))
    flags = {
        "empty": t == "", "meta": t.rlike("例句|语法点"), "incompatible": t.contains("※"), "confusable": t.contains("近似"), "marker": m,
        "structure": F.length(t) >= F.length("literal") + 2, "overlong": F.length(t) > 50,
    }
    return tests.withColumn("actual", decide(flags)).withColumn("passed", F.col("actual") == F.col("case"))


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, passed, n_failed): named booleans over all rows in one aggregate."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_failed")) for n in checks])).alias("r")
    return counts.select(rows).select("r.check_name", (F.col("r.n_failed") == 0).alias("passed"), "r.n_failed")


def histogram_gap(df: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """(key, n, expected) where the counts differ from the expected ones."""
    exp = df.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], f"`{key}` string, expected long")
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = seen.join(exp, key, "full_outer").fillna(0, ["n", "expected"])
    return j.where(F.col("n") != F.col("expected")).select(key, "n", "expected")


def escaped_alternation(words: Column) -> Column:
    """Alternation pattern of distinct words, longest first, at most sixteen, special signs escaped."""
    distinct = F.filter(F.array_distinct(words), lambda w: w != "")
    ordered = F.transform(F.array_sort(F.transform(distinct, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    return F.array_join(F.transform(F.slice(ordered, 1, 16), lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), "|")
