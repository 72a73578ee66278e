"""Several values packed in one field, split into one value per row with its position.

Fields hold lists without one convention: separators differ between and within fields, values may be quoted in
several ways, the whole list may stand in brackets, separators may double or trail.

Method: a field is scanned into *atoms* (quoted spans, which stay whole, and runs without separators) and
separators.  Between two unquoted atoms a separator either divides them or is part of one value that was left unquoted;
the possible readings form a lattice.  Expectation-maximisation learns, for each column, how often each value occurs
(over all its fields) and how often a separator stands unquoted inside a value; the Viterbi path through each lattice is
the split.  The values a reading may join to are those the column holds in quotes somewhere, of any length and with any
separators: a value that is never seen on its own has probability zero and can't win.

Almost all lattices have one path.  Their expected counts are the counts of their atoms and never change, so they are
summed once, in the JVM, and enter every M-step; only lattices with several paths are priced anew in each E-step, until
no expected count moves by more than ``TOLERANCE`` of its lattices.  The path of a lattice with one path is its atoms.

Defined cases: null and blank fields give no row; empty pieces are no values and take no position; repeated values
stay; a quote that is never closed is an ordinary character; a doubled quote within a quoted value means one.
Ties between readings go to the one with more values.  Rows with the same key are split independently (``fid``
is made per row), so repeated keys give repeated rows.  Very long fields only lengthen their own lattice.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import materialize

#: Characters that divide lists, quotes with their closing partner, brackets around a whole list.
SEPARATORS = "；;，,、|/"
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("「", "」"), ("‘", "’"), ("『", "』"))
BRACKETS = (("[", "]"), ("{", "}"), ("(", ")"), ("（", "）"), ("【", "】"), ("〔", "〕"))
#: Characters with the White_Space property.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: The iterations end earlier, once they have converged.
ROUNDS = 20
TOLERANCE = 1e-2
#: At the start a separator inside an unquoted value is this likely; the iterations replace it.
UNQUOTED = 1e-3

_SEP = r"\s" + re.escape(SEPARATORS).replace("/", r"\/")
_END = rf"(?=[{_SEP}]|$)"


def _scanner() -> str:
    quoted = []
    for a, b in QUOTES:
        a_, b_ = re.escape(a), re.escape(b)
        inner = f"[^{b_}]*+" if a == b else f"[^{a_}{b_}]*+"
        quoted.append(f"{a_}{inner}(?:{b_}{b_}{inner})*+{b_}{_END}")
    return f"(?U)({'|'.join(quoted)}|[{_SEP}]+|[^{_SEP}]+)"


SCANNER = _scanner()
_OPENERS = "".join(a for a, _ in QUOTES)


def _first_in(c: Column, characters: str) -> Column:
    return (c != "") & F.lit(characters).contains(F.substring(c, 1, 1))


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def _without_brackets(c: Column) -> Column:
    """Drop one pair of brackets that opens at the start, closes at the end, and isn't closed in between."""
    plain = _trimmed(c)
    out = plain
    for a, b in BRACKETS:
        a_, b_ = re.escape(a), re.escape(b)
        out = F.regexp_replace(out, f"(?s)^{a_}([^{a_}{b_}]*){b_}$", "$1")
    return F.when(_first_in(plain, "".join(a for a, _ in BRACKETS)), out).otherwise(plain)


def _in_quotes(token: Column) -> Column:
    hits = [token.startswith(a) & token.endswith(b) for a, b in QUOTES]
    return _first_in(token, _OPENERS) & (F.length(token) >= 2) & reduce(lambda x, y: x | y, hits)


def _bare(token: Column) -> Column:
    """The value of a token: enclosing quotes off, doubled quotes single, blanks around it off."""
    inner, out = F.substring(token, 2, F.length(token) - 2), F.lit(None).cast("string")
    for a, b in QUOTES:
        out = F.when(token.startswith(a), F.replace(inner, F.lit(b + b), F.lit(b))).otherwise(out)
    return F.when(_in_quotes(token), _trimmed(out)).otherwise(token)


def packed_fields(df: DataFrame, table_name: str, key: str, fields: list[str]) -> DataFrame:
    """(table_name, field_name, row_key, raw) for every field that isn't null."""
    parts = [
        df.select(
            F.lit(table_name).alias("table_name"),
            F.lit(f).alias("field_name"),
            F.col(key).cast("string").alias("row_key"),
            F.col(f).alias("raw"),
        )
        for f in fields
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("raw").isNotNull())


def atoms(fields: DataFrame) -> DataFrame:
    """Adds ``atoms``: array of (value, quoted, gap), ``gap`` being the separator before the atom."""
    tokens = F.regexp_extract_all(_without_brackets(F.col("raw")), F.lit(SCANNER), F.lit(1))
    is_sep = lambda t: _first_in(t, SEPARATORS + BLANKS)
    paired = F.transform(
        F.col("tokens"),
        lambda t, i: F.struct(
            F.when(is_sep(t), F.lit("")).otherwise(_bare(t)).alias("value"),
            _in_quotes(t).alias("quoted"),
            F.when(i > 0, F.try_element_at(F.col("tokens"), i)).otherwise(F.lit("")).alias("gap"),
        ),
    )
    return (
        fields.withColumn("tokens", tokens)
        .withColumn("atoms", F.filter(paired, lambda a: a["value"] != ""))
        .select("table_name", "field_name", "row_key", "atoms")
    )


def _paths(n: int, single: np.ndarray, arcs: list[tuple[int, int, float]], lam: float) -> tuple[np.ndarray, list[float], list[tuple[int, int]]]:
    """Forward-backward and Viterbi over one lattice, in logarithms: posterior of each single atom, of each arc, and the
    best path."""
    inside, divides = np.log(lam), np.log1p(-lam)
    into: list[list[tuple[int, float, int]]] = [[(j - 1, float(np.log(single[j - 1])) + (divides if j > 1 else 0.0), -1)] if j else [] for j in range(n + 1)]
    for k, (i, j, p) in enumerate(arcs):
        into[j].append((i, float(np.log(p)) + inside * (j - i - 1) + (divides if i else 0.0), k))
    fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    best, back = np.full(n + 1, -np.inf), [0] * (n + 1)
    fwd[0] = best[0] = bwd[n] = 0.0
    for j in range(1, n + 1):
        for i, p, _ in into[j]:
            fwd[j] = np.logaddexp(fwd[j], fwd[i] + p)
            if best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    for j in range(n, 0, -1):
        for i, p, _ in into[j]:
            bwd[i] = np.logaddexp(bwd[i], p + bwd[j])
    post_single, post_arc = np.zeros(n), [0.0] * len(arcs)
    for j in range(1, n + 1):
        for i, p, k in into[j]:
            g = float(np.exp(fwd[i] + p + bwd[j] - fwd[n]))
            if k < 0:
                post_single[i] += g
            else:
                post_arc[k] += g
    path, j = [], n
    while j:
        path.append((back[j], j))
        j = back[j]
    return post_single, post_arc, path[::-1]


KEYS = ["table_name", "field_name"]


def joined_readings(scanned: DataFrame) -> DataFrame:
    """(fid, table_name, field_name, start, stop, value): runs of unquoted atoms that read together as a value which the
    column holds in quotes somewhere.

    Runs and values meet by their first two pieces with what stands between, so neither a field's runs nor the column's
    values are ever multiplied out; the few that meet are compared in full.
    """
    quoted = scanned.select(*KEYS, F.explode(F.filter("atoms", lambda a: a["quoted"])).alias("a")).select(*KEYS, F.col("a.value").alias("value"))
    head = F.regexp_extract("value", rf"(?U)^([^{_SEP}]+[{_SEP}]+[^{_SEP}]+)", 1)
    values = quoted.where(F.col("value").rlike(rf"(?U)[^{_SEP}][{_SEP}]+[^{_SEP}]")).distinct()
    pieces = F.size(F.split(F.col("value"), rf"(?U)[{_SEP}]+"))
    values = values.select(*KEYS, "value", head.alias("head"), pieces.alias("pieces")).where(F.col("head") != "")
    pairs = F.filter(
        F.transform(
            F.slice("atoms", 1, F.size("atoms") - 1),
            lambda a, i: F.when(
                ~a["quoted"] & ~F.element_at("atoms", i + 2)["quoted"],
                F.struct(i.alias("start"), F.concat(a["value"], F.element_at("atoms", i + 2)["gap"], F.element_at("atoms", i + 2)["value"]).alias("head")),
            ),
        ),
        lambda p: p.isNotNull(),
    )
    runs = scanned.where(F.size("atoms") > 1).select("fid", *KEYS, F.explode(pairs).alias("p")).select("fid", *KEYS, "p.start", "p.head")
    met = runs.join(values, [*KEYS, "head"]).select("fid", "start", "pieces", "value")
    whole = F.slice("atoms", F.col("start") + 1, F.col("pieces"))
    text = F.array_join(F.transform(whole, lambda a, i: F.when(i > 0, F.concat(a["gap"], a["value"])).otherwise(a["value"])), "")
    fits = (F.size(whole) == F.col("pieces")) & ~F.exists(whole, lambda a: a["quoted"]) & (text == F.col("value"))
    return scanned.join(met, "fid").where(fits).select("fid", *KEYS, "start", (F.col("start") + F.col("pieces")).alias("stop"), "value")


def split_packed(fields: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(table_name, field_name, row_key, pos, item) from the output of ``packed_fields``."""
    # fields without atoms go only after the write: a filter before it would scan every field once for each of its atoms
    scanned = materialize(atoms(fields).withColumn("fid", F.monotonically_increasing_id()), "packed-atoms").where(F.size("atoms") > 0)
    arcs = materialize(joined_readings(scanned), "packed-arcs")
    lattices = scanned.join(arcs.groupBy("fid").agg(F.collect_list(F.struct("start", "stop", "value")).alias("arcs")), "fid")
    lattices = materialize(lattices.select("fid", *KEYS, "atoms", "arcs"), "packed-lattices")
    best = viterbi(lattices, learned(scanned, lattices, rounds))
    items = F.coalesce("items", F.transform("atoms", lambda a: a["value"]))
    each = scanned.join(best, "fid", "left").select(*KEYS, "row_key", F.posexplode(items).alias("p", "item"))
    return each.select(*KEYS, "row_key", (F.col("p") + 1).cast("int").alias("pos"), "item")


def learned(scanned: DataFrame, lattices: DataFrame, rounds: int) -> DataFrame:
    """(table_name, field_name, value, p, lam): the probability of each value the lattices could use, and of a separator
    inside a value, after the last M-step."""
    open_ids = lattices.select("fid")
    columns = scanned.groupBy(*KEYS).agg(F.sum(F.size("atoms")).alias("total"), F.sum(F.size("atoms") - 1).alias("separators"))
    columns = materialize(columns, "packed-columns")
    wanted = lattices.select(*KEYS, F.explode(F.concat(F.transform("atoms", lambda a: a["value"]), F.transform("arcs", lambda a: a["value"]))).alias("value")).distinct()
    sure = (
        scanned.join(open_ids, "fid", "left_anti")
        .select(*KEYS, F.explode("atoms").alias("a"))
        .select(*KEYS, F.col("a.value").alias("value"))
        .join(wanted, [*KEYS, "value"], "left_semi")
        .groupBy(*KEYS, "value")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    sure = materialize(wanted.join(sure, [*KEYS, "value"], "left").select(*KEYS, "value", F.coalesce("n", F.lit(0.0)).alias("sure")), "packed-sure")

    def priced(expected: DataFrame | None) -> DataFrame:
        """M-step: shares of values and of separators from the sure counts and the expected ones."""
        if expected is None:
            counts, inside = sure.withColumn("n", F.lit(0.0)), F.col("separators") * UNQUOTED
            per = columns
        else:
            counts = sure.join(expected.where("value is not null"), [*KEYS, "value"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
            per = columns.join(expected.where("value is null").select(*KEYS, F.col("n").alias("joined")), KEYS, "left")
            inside = F.coalesce("joined", F.lit(0.0))
        lam = F.least(F.lit(0.5), (inside + UNQUOTED) / (F.col("separators") + 1.0))
        per = per.select(*KEYS, "total", lam.alias("lam"))
        p = (F.col("sure") + F.col("n") + 0.01) / (F.col("total") + 1.0)
        return counts.join(F.broadcast(per), KEYS).select(*KEYS, "value", p.alias("p"), "lam")

    n_lattices = {tuple(r[k] for k in KEYS): r["n"] for r in lattices.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).collect()}
    expected = None
    for _ in range(max(1, rounds)):
        now = materialize(expectation(lattices, priced(expected)), "packed-expected")
        moved = now.select(*KEYS, "value", "n")
        if expected is not None:
            moved = moved.unionByName(expected.select(*KEYS, "value", (-F.col("n")).alias("n")))
        shift = moved.groupBy(*KEYS, "value").agg(F.abs(F.sum("n")).alias("shift")).groupBy(*KEYS).agg(F.max("shift").alias("shift"))
        expected = now
        if all(r["shift"] <= TOLERANCE * n_lattices[tuple(r[k] for k in KEYS)] for r in shift.collect()):
            break
    return priced(expected)


def _solved(lattices: DataFrame, prices: DataFrame, out_type: str, answer) -> DataFrame:
    """(fid, keys, out): every lattice solved with its arcs' prices.  Prices are joined to the lattice's own arcs, so no
    task ever holds the column's values."""
    wanted = lattices.select(
        "fid", *KEYS,
        F.explode(
            F.concat(
                F.transform("atoms", lambda a, i: F.struct(i.alias("start"), (i + 1).alias("stop"), a["value"].alias("value"))),
                F.transform("arcs", lambda a: F.struct(a["start"], a["stop"], a["value"])),
            )
        ).alias("arc"),
    ).select("fid", *KEYS, "arc.start", "arc.stop", "arc.value")
    per_field = wanted.join(prices, [*KEYS, "value"]).groupBy("fid", *KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "value", "p", "lam"))).alias("arcs"))

    @F.pandas_udf(out_type)
    def solve(col: pd.Series) -> pd.Series:
        out = []
        for row in col:
            row = list(row)
            n = max(a["stop"] for a in row)
            single, names, multi = np.zeros(n), [""] * n, []
            for a in row:
                if a["stop"] - a["start"] == 1:
                    single[a["start"]], names[a["start"]] = a["p"], a["value"]
                else:
                    multi.append(a)
            out.append(answer(names, multi, *_paths(n, single, [(a["start"], a["stop"], a["p"]) for a in multi], row[0]["lam"])))
        return pd.Series(out)

    return per_field.select("fid", *KEYS, solve("arcs").alias("out"))


def expectation(lattices: DataFrame, prices: DataFrame) -> DataFrame:
    """E-step: (table_name, field_name, value, n), the expected count of each value; of separators inside values for null."""

    def counts(names, multi, single, joined, path):
        inside = sum(float(p) * (a["stop"] - a["start"] - 1) for a, p in zip(multi, joined))
        values = [{"value": v, "n": float(n)} for v, n in zip(names, single)] + [{"value": a["value"], "n": float(p)} for a, p in zip(multi, joined)]
        return values + [{"value": None, "n": inside}]

    solved = _solved(lattices, prices, "array<struct<value:string,n:double>>", counts)
    return solved.select(*KEYS, F.explode("out").alias("i")).groupBy(*KEYS, F.col("i.value").alias("value")).agg(F.sum("i.n").alias("n"))


def viterbi(lattices: DataFrame, prices: DataFrame) -> DataFrame:
    """(fid, items): the most probable reading of every lattice."""

    def read(names, multi, single, joined, path):
        by = {(a["start"], a["stop"]): a["value"] for a in multi}
        return [names[i] if j == i + 1 else by[(i, j)] for i, j in path]

    return _solved(lattices, prices, "array<string>", read).select("fid", F.col("out").alias("items"))
