"""Text normalisation as column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is no letter, digit or ideograph: blanks of any kind, punctuation, signs, marks, invisibles.
FORMATTING = r"[^\p{L}\p{N}]+"


def without_formatting(c: Column | str) -> Column:
    """Lower-case letters, digits and ideographs only.  Null stays null, a text of mere formatting becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, FORMATTING, ""))


def strip_unicode(c: Column | str) -> Column:
    """Trim every kind of white space at both ends; null becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def squeeze_sentence(c: Column | str) -> Column:
    """Group-key form of a sentence: lower case, Chinese punctuation to ASCII, no white space."""
    c = F.col(c) if isinstance(c, str) else c
    mapped = F.translate(F.lower(F.coalesce(c, F.lit(""))), "，。！？；：（）“”‘’", ",.!?;:()\"\"''")
    return F.regexp_replace(mapped, r"(?U)\s+", "")


def group_id(c: Column | str) -> Column:
    """16 hex digits of the SHA-1 of the squeezed sentence."""
    return F.substring(F.sha1(squeeze_sentence(c)), 1, 16)


def stable_id(prefix: str, *parts: Column) -> Column:
    """12 upper-case hex digits of SHA-256 over unit-separated parts; nulls count as ''."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(joined, 256), 1, 12)))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 where the denominator is 0 or null."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))
