"""Rule execution: pattern bindings evaluated over candidates as plain column expressions.

A binding belongs to a proposed point and holds a marker pattern, a structure pattern, optional hard-negative
patterns and three lists of rule ids (positive, weak, strong).  For each candidate the executor derives the fired
ids, a score, the decision flags, a diagnosis and a provenance trace.  Everything is stateless per row, so the same
function serves batch and streaming frames, and nothing is shuffled.

Few bindings become a ladder of literal patterns, which the JVM compiles once; a catalogue of bindings is joined as
a frame with pattern columns, broadcast when it is below the broadcast threshold.

Order of the steps is the contract: binding rules, lexical hard negatives, empty candidate, meta mention, offset
mismatch.  ``accepted`` does not look at weak rejections, so a row can be accepted and weakly rejected at once; the
diagnosis tests strong, weak, accepted in that order.

Defined cases: null text counts as empty, a point without binding runs on literal markers alone, repeated rows
are independent, extra columns pass through unless they share a result's name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LADDER_LIMIT = 64

BINDING_SCHEMA = T.StructType(
    [
        T.StructField("marker", T.StringType()),
        T.StructField("structure", T.StringType()),
        T.StructField("hard_negatives", T.ArrayType(T.StringType())),
        T.StructField("positive", T.ArrayType(T.StringType())),
        T.StructField("weak", T.ArrayType(T.StringType())),
        T.StructField("strong", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Binding:
    """Patterns and rule ids of one proposed point."""

    marker: str
    structure: str
    positive: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    hard_negatives: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleBook:
    """Bindings by point, patterns of meta mentions, and literal markers of points without binding."""

    bindings: dict[str, Binding]
    meta: tuple[str, ...] = ()
    literals: dict[str, tuple[str, ...]] = field(default_factory=dict)


def book_from_json(spark, path: str) -> RuleBook:
    """Read a bindings document: ``global_meta_patterns`` and ``rules`` keyed by point."""
    import json

    doc = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    rules = {
        point: Binding(
            b["marker_pattern"], b["structure_pattern"], tuple(b.get("positive_rule_ids", ())), tuple(b.get("weak_rule_ids", ())),
            tuple(b.get("strong_rule_ids", ())), tuple(b.get("hard_negative_patterns", ())),
        )
        for point, b in doc["rules"].items()
    }
    return RuleBook(rules, tuple(doc.get("global_meta_patterns", ())))


def bindings_frame(spark, book: RuleBook) -> DataFrame:
    rows = [
        (p, (b.marker, b.structure, list(b.hard_negatives), list(b.positive), list(b.weak), list(b.strong)))
        for p, b in book.bindings.items()
    ]
    return spark.createDataFrame(rows, T.StructType([T.StructField("bound_point", T.StringType()), T.StructField("binding", BINDING_SCHEMA)]))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return f"array({', '.join(_lit(v) for v in values)})" if values else "cast(array() AS array<string>)"


def _case(cases: dict[str, str], otherwise: str) -> str:
    """A ladder over the point; points with the same outcome share a step."""
    steps: dict[str, list[str]] = {}
    for point, outcome in cases.items():
        steps.setdefault(outcome, []).append(point)
    steps.pop(otherwise, None)
    if not steps:
        return otherwise
    whens = " ".join(f"WHEN _p IN ({', '.join(_lit(k) for k in points)}) THEN {outcome}" for outcome, points in steps.items())
    return f"CASE {whens} ELSE {otherwise} END"


def _any(parts) -> str:
    parts = list(parts)
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


_RESULTS = (
    "marker_hit", "structure_hit", "positive_ids", "weak_ids", "strong_ids", "score", "accepted", "weak_reject", "strong_reject", "state", "diagnosis", "trace",
)


def evaluate(
    rows: DataFrame, book: RuleBook, sentence: str = "sentence", span: str = "span", point: str = "label", family: str | None = None
) -> DataFrame:
    """``rows`` with marker_hit, structure_hit, positive_ids, weak_ids, strong_ids, score, accepted, weak_reject,
    strong_reject, state, diagnosis, trace.

    The plan is four projections (and, for a catalogue, one join), written as SQL text: one call builds each.
    """
    keep = [_name(c) for c in rows.columns if c not in _RESULTS]
    trim = lambda c: rf"regexp_replace(coalesce({_name(c)}, ''), '(?U)^\\s+|\\s+$', '')"
    df = rows.selectExpr(
        *keep, f"{trim(sentence)} AS _s", f"{trim(span)} AS _c", f"coalesce({_name(point)}, '') AS _p", (f"coalesce({_name(family)}, '')" if family else "''") + " AS _f"
    )
    b = book.bindings
    if len(b) <= LADDER_LIMIT:
        per = lambda make, other: _case({k: make(x) for k, x in b.items()}, other)
        bound = _any([f"_p IN ({', '.join(_lit(k) for k in b)})"] if b else [])
        marker, structure = per(lambda x: f"_c RLIKE {_lit(x.marker)}", "false"), per(lambda x: f"_c RLIKE {_lit(x.structure)}", "false")
        lexical = per(lambda x: _any(f"_c RLIKE {_lit(h)}" for h in x.hard_negatives), "false")
        pos, weak, strong = (per(lambda x, a=a: _list(getattr(x, a)), _list(())) for a in ("positive", "weak", "strong"))
    else:
        catalogue = bindings_frame(rows.sparkSession, book)
        df = df.join(catalogue, df["_p"] == catalogue["bound_point"], "left")
        bound = "bound_point IS NOT NULL"
        marker, structure = "coalesce(_c RLIKE binding.marker, false)", "coalesce(_c RLIKE binding.structure, false)"
        lexical = "coalesce(exists(binding.hard_negatives, h -> _c RLIKE h), false)"
        pos, weak, strong = (f"coalesce(binding.{a}, {_list(())})" for a in ("positive", "weak", "strong"))
    literal = _case({k: _any(f"contains(_c, {_lit(m)})" for m in ms) for k, ms in book.literals.items()}, "false")
    longer = _case({k: str(max(2, min(len(m) for m in ms) + 1)) for k, ms in book.literals.items() if ms}, "2")
    none = _list(())
    df = df.selectExpr(
        *keep, "_s", "_c", "_p", "_f", f"{bound} AS _bound", f"{marker} AS _m", f"{structure} AS _st", f"{lexical} AS _lex", f"{literal} AS _lm", f"length(_c) >= {longer} AS _long",
        f"{pos} AS _pos", f"{weak} AS _weak", f"{strong} AS _strong", f"{_any(f'_c RLIKE {_lit(m)}' for m in book.meta)} AS _meta", "_c <> '' AND NOT contains(_s, _c) AS _off",
    ).selectExpr(
        *keep, "_p", "_f", "if(_bound, _m, _lm) AS marker_hit", "if(_bound, _st, _lm AND _long) AS structure_hit",
        f"array_distinct(if(_bound, concat(if(_m, slice(_pos, 1, 1), {none}), if(_st, slice(_pos, 2, 1000000), {none})), {none})) AS positive_ids",
        f"""array_distinct(concat(if(_bound AND NOT (_m AND _st), slice(_weak, 1, 1), {none}),
            CASE WHEN _off AND _bound THEN slice(_weak, 1, 1) WHEN _off THEN {_list(("GLOBAL-OFFSET-MISMATCH",))} ELSE {none} END)) AS weak_ids""",
        f"""array_distinct(concat(if(_bound AND _lex AND size(_strong) > 0, slice(_strong, -1, 1), {none}), if(_c = '', {_list(("GLOBAL-EMPTY-CANDIDATE",))}, {none}),
            CASE WHEN _meta AND size(_strong) > 0 THEN slice(_strong, 1, 1) WHEN _meta THEN {_list(("GLOBAL-META-MENTION",))} ELSE {none} END)) AS strong_ids""",
    )
    ids = ["marker_hit", "structure_hit", "positive_ids", "weak_ids", "strong_ids"]
    return df.selectExpr(
        *keep, *ids, "size(positive_ids) - size(weak_ids) - 2 * size(strong_ids) AS score", "marker_hit AND structure_hit AND size(strong_ids) = 0 AS accepted",
        "size(weak_ids) > 0 AND size(strong_ids) = 0 AS weak_reject", "size(strong_ids) > 0 AS strong_reject",
        "CASE WHEN size(strong_ids) > 0 THEN 'strong' WHEN size(weak_ids) > 0 THEN 'weak' WHEN marker_hit AND structure_hit THEN 'accept' ELSE 'no_decision' END AS state",
        "CASE WHEN size(strong_ids) > 0 THEN 'strong_reject' WHEN size(weak_ids) > 0 THEN 'weak_reject' WHEN marker_hit AND structure_hit THEN 'accept' ELSE 'review' END AS diagnosis",
        "concat(array(concat('candidate:', _p), concat('family:', _f)), transform(array_distinct(concat(positive_ids, weak_ids, strong_ids)), r -> concat('rule:', r))) AS trace",
    )


def trace_state(strong: Column, weak: Column, accepted: Column) -> Column:
    """strong over weak over accept over no_decision."""
    return F.when(strong, "strong").when(weak, "weak").when(accepted, "accept").otherwise("no_decision")


def predicted_label(accepted: Column, strong: Column, weak: Column, positive: str, negative: str) -> Column:
    """Target label from flags: acceptance first, then rejection, negative by default."""
    return F.when(accepted, positive).when(strong | weak, negative).otherwise(negative)


def with_sources(evaluated: DataFrame, authority: DataFrame, key: str = "row_id") -> DataFrame:
    """Adds ``sources`` and ``trace`` with sources, from ``authority(rule_id, sources)`` (``；``-packed lists).

    Ids unknown to the authority are dropped; the rows that fire no rule keep empty sources.
    """
    fired = evaluated.select(key, F.explode(F.concat("positive_ids", "weak_ids", "strong_ids")).alias("rule_id")).distinct()
    found = (
        fired.join(authority, "rule_id")
        .groupBy(key)
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", "[；;]"))))).alias("sources"))
    )
    sources = F.filter(F.coalesce("sources", _strings(())), lambda x: F.trim(x) != "")
    return (
        evaluated.join(found, key, "left")
        .withColumn("sources", sources)
        .withColumn("trace", F.concat("trace", F.transform("sources", lambda x: F.concat(F.lit("source:"), F.trim(x)))))
    )


def feature_map(evaluated: DataFrame, sentence: str = "sentence", span: str = "span") -> Column:
    """Numeric rule features of a row: flags, counts, clipped lengths."""
    clip = lambda c: F.least(F.length(F.coalesce(c, F.lit(""))), F.lit(100)) / 100.0
    bound = lambda c: F.greatest(F.lit(-10), F.least(F.lit(10), c)).cast("double")
    pairs = {
        "marker": F.col("marker_hit").cast("double"), "structure": F.col("structure_hit").cast("double"),
        "accepted": F.col("accepted").cast("double"), "weak": F.col("weak_reject").cast("double"),
        "strong": F.col("strong_reject").cast("double"), "score": bound(F.col("score")),
        "sentence_len": clip(F.col(sentence)), "span_len": clip(F.col(span)),
    }
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values()))
