"""Parsing helpers of catalogue texts as column expressions: quotes, levels, page anchors, markers, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of levels beside their plain number, and the levels there are.
LEVEL_SPELLINGS = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七-九": "7-9", "七九": "7-9", "高等": "7-9", "7": "7-9", "8": "7-9", "9": "7-9", "7-8-9": "7-9", "7/8/9": "7-9", "7、8、9": "7-9"}
LEVELS = ("1", "2", "3", "4", "5", "6", "7-9")
#: Names of the books in page anchors.
BOOKS = {"初等": "elementary", "中等": "intermediate", "高等": "advanced"}
QUOTES = (("“", "”"), ("‘", "’"))


def last_position(text: Column, mark: str) -> Column:
    """1-based position of the last ``mark`` (one sign) in ``text``, 0 where there is none."""
    return F.when(text.contains(mark), F.length(text) - F.length(F.substring_index(text, mark, -1))).otherwise(F.lit(0))


def outside_quotes(text: Column, position: Column) -> Column:
    """Whether a 1-based position lies outside curved quotes: no quote was opened before it and not closed."""
    before = F.substring(text, F.lit(1), position - 1)
    out = F.lit(True)
    for a, b in QUOTES:
        out = out & (last_position(before, a) <= last_position(before, b))
    return out


def positions_outside_quotes(text: Column, mark: str) -> Column:
    """1-based positions of a mark outside curved quotes; quadratic in the length, for catalogue entries and sentences."""
    n = F.length(text) - len(mark) + 1
    every = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (F.substring(text, i, F.lit(len(mark))) == mark) & outside_quotes(text, i))


def normalise_level(raw: Column) -> Column:
    """A level's plain form; an unknown one raises, null stays null."""
    c = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    c = F.regexp_replace(F.regexp_replace(c, "level|级| ", ""), "[—–~至]", "-")
    known = F.create_map(*[F.lit(x) for kv in LEVEL_SPELLINGS.items() for x in kv])
    c = F.coalesce(F.try_element_at(known, c), c)
    return F.when(c.isin(*LEVELS), c).when(raw.isNotNull(), F.raise_error(F.concat(F.lit("unknown level: "), raw)).cast("string"))


def page_anchors(raw: Column) -> Column:
    """Array of (book, page) of anchors like ``初等 p.12``; null gives an empty array."""
    text = F.coalesce(raw, F.lit(""))
    pattern = rf"({'|'.join(BOOKS)})\s*p\.(\d+)"
    books = F.create_map(*[F.lit(x) for kv in BOOKS.items() for x in kv])
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("p")),
        lambda z: F.struct(F.element_at(books, z["b"]).alias("book"), z["p"].cast("int").alias("page")),
    )


#: Names of concepts, which are no literal markers.
CONCEPTS = ("数量", "时量", "趋向", "结果", "双宾", "给予", "兼语", "可能", "将字处置")


def literal_markers(raw: Column) -> Column:
    """Literal markers of a list divided by semicolons: no concepts, no ellipses, no open lists; order is kept."""
    pieces = F.transform(F.split(F.coalesce(raw, F.lit("")), "[；;]"), lambda m: F.regexp_replace(m, r"(?U)^\s+|\s+$", ""))
    return F.filter(pieces, lambda m: (m != "") & ~m.isin(*CONCEPTS) & ~m.contains("...") & ~m.contains("等"))


def holds_all(text: Column, markers: Column) -> Column:
    """Whether the text holds every marker at least as often as the array does, occurrences not overlapping."""
    times = lambda m: (F.length(text) - F.length(F.replace(text, m, F.lit("")))) >= F.length(m) * F.size(F.filter(markers, lambda x: x == m))
    return F.forall(F.filter(markers, lambda m: m != ""), times)


def window_after(text: Column, mark: Column, size: int) -> Column:
    """The mark and up to ``size`` characters after it, '' where the text lacks it."""
    at = F.call_function("locate", mark, text)
    return F.when((F.length(mark) > 0) & (at > 0), F.substring(text, at, F.length(mark) + size)).otherwise(F.lit(""))


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """A row's columns as JSON with sorted keys, without blanks between them and without empty values."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return F.to_json(F.struct(*[(F.nullif(F.col(c), F.lit("")) if c in text else F.col(c)).alias(c) for c in sorted(columns)]))


def json_sha256(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(canonical_json(df, columns), 256)


