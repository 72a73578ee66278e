"""Visually identical text with different characters, brought to one form.

Method: every character that only looks different is mapped to the one it looks like (widths, radicals,
compatibility ideographs, kinds of blank, Cyrillic and Greek twins of Latin letters), invisible characters are
dropped, and the mapped values are grouped under Spark's accent- and case-sensitive ``UNICODE`` collation, which
treats composed and decomposed accents alike.  Each class gets a deterministic canonical member, the mapped value
that is smallest in binary order among its members, and it is joined back.

A third of all rows may share one class: grouping combines map-side, and joins run over distinct values.

Defined cases: null stays null and belongs to no class; an empty text is a class of its own; case, accents, words and
punctuation marks keep texts apart; repeated rows share a class but only differing texts are paired.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import materialize

COLLATION = "UNICODE"
#: Signs that stand on or join with the sign before them.
COMBINING = r"[\p{M}\u1100-\u11FF]"

#: Letters of other scripts and the Latin letters they can't be told from by eye.
TWINS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y", "ԁ": "d", "ɡ": "g", "ɑ": "a", "ı": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
}

#: Blocks whose characters are other forms of ordinary ones.
FORM_BLOCKS = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1F))


@lru_cache(1)
def mapping() -> tuple[str, str]:
    """(from, to) for ``translate``; characters of ``from`` beyond the end of ``to`` are dropped.

    Built by rule: one-character compatibility forms within FORM_BLOCKS, one-character composed forms, every kind of
    blank to the ordinary one, the TWINS, and last all invisible control and format characters and variation selectors,
    which go.
    """
    pairs, gone = dict(TWINS), []
    for lo, hi in FORM_BLOCKS:
        for cp in range(lo, hi + 1):
            form = unicodedata.normalize("NFKC", chr(cp))
            if len(form) == 1 and form != chr(cp):
                pairs[chr(cp)] = TWINS.get(form, form)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if len(unicodedata.normalize("NFC", ch)) == 1 and unicodedata.normalize("NFC", ch) != ch:
            form = unicodedata.normalize("NFC", ch)
            pairs.setdefault(ch, TWINS.get(form, form))
        if kind == "Cf" or (kind == "Cc" and ch not in "\t\n\r\x0b\x0c\x85") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or ch in "͏ᅟᅠㅤﾠ":
            gone.append(ch)
        elif kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\x0b\x0c\x85":
            pairs[ch] = " "
    for ch in gone:
        pairs.pop(ch, None)
    keys = sorted(pairs)
    return "".join(keys) + "".join(gone), "".join(pairs[k] for k in keys)


def looks(c: Column | str) -> Column:
    """The mapped form: what the text looks like, up to the composition of accents."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, *mapping())


def without_blanks(c: Column) -> Column:
    return F.translate(c, " \t\r\n", "")


def _collated(c: Column) -> Column:
    return F.collate(c, COLLATION)


def _composed(values: DataFrame) -> DataFrame:
    """``shape`` in composed form."""

    def compose(batches):
        for pdf in batches:
            yield pdf.assign(shape=[unicodedata.normalize("NFC", s) for s in pdf["shape"]])

    return values.mapInPandas(compose, values.schema)


def canonical_values(df: DataFrame, column: str) -> DataFrame:
    """(value, canonical): each distinct value of ``column`` with the canonical member of its class.

    A mapped value without combining signs equals another under the collation only where both are the same in binary
    order too, so it is its own canonical member; only values with such signs are composed and grouped by the collation.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    mapped = values.select("value", looks("value").alias("shape"))
    combining = F.col("shape").rlike(COMBINING)
    other = _composed(mapped.where(combining)).withColumn("look", _collated(F.col("shape")))
    classes = other.groupBy("look").agg(F.min(F.collate("shape", "UTF8_BINARY")).alias("canonical"))
    return mapped.where(~combining).select("value", F.col("shape").alias("canonical")).unionByName(
        other.join(classes, "look").select("value", "canonical")
    )


def consistent(df: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """``key`` and each column in its consistent form; null stays null."""
    out = df.select(key, *columns)
    for c in columns:
        forms = canonical_values(df, c).select(F.col("value").alias(c), F.col("canonical").alias(f"{c}__form"))
        out = out.join(forms, c, "left").drop(c).withColumnRenamed(f"{c}__form", c)
    return out.select(key, *columns)


def lookalike_pairs(df: DataFrame, column: str, key: str = "row_id") -> DataFrame:
    """(row_a, row_b), row_a < row_b: rows whose texts look the same but differ beyond ordinary blanks.

    Classes are the canonical members of distinct texts.  Different texts of one class are paired first, and rows join
    those pairs by text, so no pair of rows is ever made that isn't a result, however many copies a text has.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("row"), without_blanks(F.col(column)).alias("plain"))
    forms = canonical_values(rows, "plain")
    shaped = forms.select(F.unhex(F.md5("value")).alias("h"), F.unhex(F.md5(without_blanks(F.col("canonical")))).alias("look"))
    shaped = materialize(shaped, "look-classes")
    mixed = shaped.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("look")
    members = shaped.join(mixed, "look")
    pairs = members.select("look", F.col("h").alias("ha")).join(members.select("look", F.col("h").alias("hb")), "look").where(F.col("ha") < F.col("hb"))
    pairs = materialize(pairs.select("ha", "hb"), "look-pairs")
    slim = rows.select("row", F.unhex(F.md5("plain")).alias("h"))
    met = pairs.join(slim.select(F.col("h").alias("ha"), F.col("row").alias("ra")), "ha").join(slim.select(F.col("h").alias("hb"), F.col("row").alias("rb")), "hb")
    return met.select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def lookalike_classes(df: DataFrame, column: str, key: str = "row_id") -> DataFrame:
    """(row, look): rows whose text looks like a different one, with the id of its class; one row per row of the table."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("row"), without_blanks(F.col(column)).alias("plain"))
    shaped = canonical_values(rows, "plain").select(F.col("value").alias("plain"), F.md5(without_blanks(F.col("canonical"))).alias("look"))
    shaped = materialize(shaped, "look-classes")
    mixed = shaped.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("look")
    return rows.join(shaped.join(mixed, "look"), "plain").select("row", "look")


def hidden_spans(df: DataFrame, sentence: str = "sentence", span: str = "span", key: str = "row_id") -> DataFrame:
    """(row): rows whose span, in its consistent form, stands in the consistent sentence without being a literal part of it.

    Only rows whose span is no literal part are brought to the consistent form.
    """
    s, p = F.col(sentence), F.col(span)
    near = df.where(s.isNotNull() & p.isNotNull() & ~F.contains(s, p)).select(F.col(key).alias("row"), s.alias("s"), p.alias("p"))
    both = consistent(near, ["s", "p"], "row")
    inside = F.when(F.contains("s", "p"), True).when(F.col("p").rlike(COMBINING), F.contains(_collated(F.col("s")), _collated(F.col("p"))))
    return both.where((F.length("p") > 0) & inside).select("row")
