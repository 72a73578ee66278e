"""Duplicates hidden by formatting differences.

Records are the same when all compared columns agree, text columns without regard to letter case, blanks,
punctuation and signs.  In a column of labelled fields (``name：value``) the order of the fields does not matter.

Method: every compared column is brought to a canonical form inside the JVM, the forms are joined and hashed to 128 bits (MD5), and copies are counted by that hash with map-side combining.  A second,
independent 64-bit hash travels along: where its minimum and maximum differ within one group, two different
records collided, and exactly those groups are counted again by their full canonical text.

Only (hash, row id) pairs are ever shuffled.  A group that holds a third of all rows is combined map-side; finding
its surplus rows is a join against one row per group, which adaptive execution splits or broadcasts.

Defined cases: null equals null and nothing else; a text of mere formatting equals an empty text; exact copies
count; extra columns of a table are ignored unless named; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.text import FORMATTING, without_formatting
from glossmill.session import materialize

#: Blanks of any kind, and signs nobody sees.
_BLANK = r"(?U)[\s\p{Cf}\x{FE00}-\x{FE0F}]+"
#: A labelled field: a short name, a colon, and what follows up to the next separator.
_PIECE = r"[；;，,、|/。！!？?]+"
_LABELLED = r"^[^\p{L}\p{N}]*[\p{L}\p{N}]{1,12}[：:].*$"


def labelled_form(c: Column | str) -> Column:
    """Canonical form of a text that may hold labelled fields: fields sorted, formatting gone.

    A text counts as labelled when at least two of its pieces start with a name and a colon; pieces before the first
    label and pieces without one stay attached to the field before them.
    """
    c = F.col(c) if isinstance(c, str) else c
    pieces = F.split(F.regexp_replace(c, _BLANK, ""), _PIECE)
    clean = F.filter(pieces, lambda p: F.length(F.regexp_replace(p, FORMATTING, "")) > 0)
    marked = F.transform(clean, lambda p: F.concat(F.when(p.rlike(_LABELLED), F.lit("\u0001")).otherwise(F.lit("")), without_formatting(p)))
    joined = F.split(F.array_join(marked, ""), "\u0001")
    many = F.size(F.filter(clean, lambda p: p.rlike(_LABELLED))) >= 2
    head, tail = F.element_at(joined, 1), F.slice(joined, 2, F.greatest(F.size(joined) - 1, F.lit(1)))
    ordered = F.concat(head, F.lit("\u0001"), F.array_join(F.array_sort(tail), "\u0001"))
    return F.when(many, ordered).otherwise(without_formatting(c))


_CELL, _NULL, _ESCAPE = "\u0001", "\u0002", "\u0003"


def _cell(c: Column) -> Column:
    """A loosely compared cell as text, without the signs that mark cell ends and nulls: they are formatting."""
    s = c.cast("string")
    plain = F.when(s.contains(_CELL) | s.contains(_NULL), F.translate(s, _CELL + _NULL, "")).otherwise(s)
    return F.coalesce(plain, F.lit(_NULL))


def _exact_cell(c: Column) -> Column:
    """An exactly compared cell as text, with those signs escaped."""
    s = c.cast("string")
    escaped = s
    for sign, letter in ((_ESCAPE, "c"), (_CELL, "a"), (_NULL, "b")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(_ESCAPE + letter))
    special = s.contains(_CELL) | s.contains(_NULL) | s.contains(_ESCAPE)
    return F.coalesce(F.when(special, escaped).otherwise(s), F.lit(_NULL))


def canonical(df: DataFrame, loose: list[str], exact: list[str], labelled: list[str]) -> Column:
    """One canonical text per record from loosely, exactly and field-wise compared columns.

    All loose columns go through one replacement: the signs between their cells survive it.
    """
    parts = []
    if loose:
        joined = F.concat_ws(_CELL, *[_cell(F.col(c)) for c in loose])
        parts.append(F.lower(F.regexp_replace(joined, r"[^\p{L}\p{N}\x01\x02]+", "")))
    parts += [_exact_cell(F.col(c)) for c in exact] + [F.coalesce(labelled_form(F.col(c)), F.lit(_NULL)) for c in labelled]
    return F.concat_ws(_CELL, *parts)


def fingerprints(df: DataFrame, table_name: str, loose=(), exact=(), labelled=()) -> DataFrame:
    """(table_name, row_id, h, check, text): 128-bit hash, independent 64-bit hash, and the canonical text."""
    text = canonical(df, list(loose), list(exact), list(labelled))
    return df.select("row_id", text.alias("text")).select(
        F.lit(table_name).alias("table_name"),
        "row_id",
        F.unhex(F.md5("text")).alias("h"),
        F.xxhash64(F.lit(7), F.col("text")).alias("check"),
        "text",
    )


def hash_groups(slim: DataFrame) -> DataFrame:
    """(table_name, h, kept_row, n_copies, lo, hi): copies counted by hash, combined map-side."""
    return slim.groupBy("table_name", "h").agg(
        F.min("row_id").alias("kept_row"), F.count(F.lit(1)).alias("n_copies"), F.min("check").alias("lo"), F.max("check").alias("hi")
    )


def resolve(groups: DataFrame, prints: DataFrame) -> DataFrame:
    """(table_name, h, part, kept_row, n_copies): groups with collided hashes counted again by canonical text.

    ``part`` is '' but for collided hashes, where it is the text.
    """
    sound = groups.where(F.col("lo") == F.col("hi")).select("table_name", "h", F.lit("").alias("part"), "kept_row", "n_copies")
    collided = groups.where(F.col("lo") != F.col("hi")).select("table_name", "h")
    if collided.isEmpty():
        return sound
    apart = (
        prints.join(collided, ["table_name", "h"])
        .groupBy("table_name", "h", F.col("text").alias("part"))
        .agg(F.min("row_id").alias("kept_row"), F.count(F.lit(1)).alias("n_copies"))
    )
    return sound.unionByName(apart)


def slim_prints(prints: DataFrame) -> DataFrame:
    """Hashes and row ids, computed once and written; texts stay where they are."""
    return materialize(prints.select("table_name", "row_id", "h", "check"), "prints")


def surplus_copies(prints: DataFrame) -> DataFrame:
    """(table_name, kept_row, copy_row): one row per record that another, smaller-numbered one stands for."""
    slim = slim_prints(prints)
    several = materialize(hash_groups(slim).where(F.col("n_copies") > 1), "copy-groups")
    groups = resolve(several, prints).where(F.col("n_copies") > 1).select("table_name", "h", "part", "kept_row")
    keys = ["table_name", "h"]
    plain = slim.join(groups.where(F.col("part") == ""), keys)
    split = groups.where(F.col("part") != "")
    found = plain.select("table_name", "kept_row", "row_id")
    if not split.isEmpty():
        exact = prints.join(split, (prints["h"] == split["h"]) & (prints["text"] == split["part"]) & (prints["table_name"] == split["table_name"]))
        found = found.unionByName(exact.select(prints["table_name"], split["kept_row"], prints["row_id"]))
    return found.where(F.col("row_id") > F.col("kept_row")).select("table_name", "kept_row", F.col("row_id").alias("copy_row"))


def collapse(prints: DataFrame) -> DataFrame:
    """(table_name, kept_row, n_copies): every distinct record once with its number of copies."""
    return resolve(hash_groups(slim_prints(prints)), prints).select("table_name", "kept_row", "n_copies")


def compared_columns(df: DataFrame, leave_out: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Text columns and other columns of a table, but for those left out."""
    fields = [f for f in df.schema.fields if f.name not in leave_out]
    loose = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return loose, [f.name for f in fields if f.name not in loose]
