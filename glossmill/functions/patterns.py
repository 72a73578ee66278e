"""Pattern and label helpers: repair of foreign regex dialects, validity, confidences, label heads, quality scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def repair_pattern(pattern: str) -> str:
    """A pattern of another dialect in the JVM's: quote wrappers off, named groups, literal blocks, bounded ellipses."""
    p = pattern.strip()
    if len(p) >= 2 and p[0] == p[-1] and p[0] in "\"'":
        p = p[1:-1]
    p = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m.group(1)), p)
    p = p.replace("(?P<", "(?<").replace("\\p{Han}", "\\p{IsHan}")
    return re.sub(r"……|…|\.\.\.", ".{0,12}", p)


def literal_fallback(words: list[str]) -> str:
    """Alternation of escaped words, longest first, at most sixteen."""
    distinct = sorted({w for w in words if w}, key=lambda w: (-len(w), w))[:16]
    return "|".join(re.escape(w) for w in distinct)


def pattern_validity(patterns: DataFrame, column: str) -> DataFrame:
    """Adds ``repaired`` and ``valid`` (compiles) to a frame of patterns; patterns are a dimension, rows never carry them."""

    @F.pandas_udf("struct<repaired:string,valid:boolean>")
    def judge(col: pd.Series) -> pd.DataFrame:
        fixed = [repair_pattern(p or "") for p in col]

        def ok(p: str) -> bool:
            try:
                re.compile(p.replace("\\p{IsHan}", "[一-鿿]").replace("(?<", "(?P<") if "(?<=" not in p and "(?<!" not in p else p)
                return bool(p)
            except re.error:
                return False

        return pd.DataFrame({"repaired": fixed, "valid": [ok(p) for p in fixed]})

    return patterns.withColumn("_j", judge(F.col(column))).select("*", "_j.repaired", "_j.valid").drop("_j")


def margin_confidence(margin: Column) -> Column:
    """1 / (1 + exp(-|s|)) of a binary margin."""
    return 1.0 / (1.0 + F.exp(-F.abs(margin)))


def softmax_confidence(margins: Column) -> Column:
    """Largest softmax share of an array of margins, shifted by their maximum."""
    top = F.array_max(margins)
    return 1.0 / F.aggregate(F.transform(margins, lambda m: F.exp(m - top)), F.lit(0.0), lambda a, x: a + x)


def aligned_probabilities(probs: Column, labels: list[str]) -> Column:
    """Array in the order of ``labels`` from a map, missing ones at 1e-9, summing to one."""
    raw = F.array(*[F.greatest(F.coalesce(F.try_element_at(probs, F.lit(x)), F.lit(0.0)), F.lit(1e-9)) for x in labels])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def label_head(label: Column) -> Column:
    """What stands before the first colon, where that is at most 32 characters, else the whole."""
    head = F.substring_index(label, "：", 1)
    return F.when(label.contains("：") & F.length(head).between(1, 32), head).otherwise(label)


def clean_speaker(text: Column) -> Column:
    """Leading bullets, numbering and a short speaker's name with its colon off, blanks collapsed."""
    t = F.regexp_replace(text, r"^(?U)[\s·*•\-—#>（(【“]+", "")
    t = F.regexp_replace(t, r"^[\p{L}]{1,4}[：:](?=.)", "")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


#: Words of grammar explanations, signs of formulas and quotations, and words of everyday sentences.
EXPLAINING = (
    "表示", "可以", "不能", "一般", "通常", "用于", "用在", "结构", "特点", "小提示", "语义", "用法", "前边", "后边", "成分", "主语", "谓语", "宾语",
    "定语", "状语", "补语", "动词", "形容词", "名词", "词语", "句中", "句末", "疑问句", "肯定形式", "否定形式",
)
FORMULA = ("“", "”", "(", ")", "（", "）", "+", "=", ":", "：")
EVERYDAY = ("我", "你", "他", "她", "我们", "他们", "老师", "学生", "妈妈", "爸爸", "小王")


def candidate_quality(sentence: Column, span: Column, has_clue: Column | None = None) -> Column:
    """Additive quality of a candidate: length, no explanation, no formula, a page clue, a short span, everyday words."""
    s, n = F.coalesce(sentence, F.lit("")), F.length(F.coalesce(sentence, F.lit("")))
    any_of = lambda words: s.rlike("|".join(re.escape(w) for w in words))
    clue = F.lit(False) if has_clue is None else F.coalesce(has_clue, F.lit(False))
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    return (
        F.when(n.between(8, 42), 5).when(n <= 65, 2).otherwise(0)
        + points(any_of(EXPLAINING), -5)
        + points(any_of(FORMULA), -2)
        + points(clue, 1)
        + points(F.length(F.coalesce(span, F.lit(""))).between(1, 16), 1)
        + points(any_of(EVERYDAY), 2)
    )


def is_clean_utf8(text: Column) -> Column:
    """No replacement characters and a valid encoding."""
    return F.is_valid_utf8(text) & ~text.contains("�")
