"""Orphan references and packed fields on small cases."""

from datetime import datetime as dt

import pytest

from glossmill.operators import orphans, packed

EDGE = "edge_id long, source string, relation string, target string, loaded_at timestamp, key string, side string"
NODE = "id string, loaded_at timestamp, deleted_at timestamp, begun string"


def day(n):
    return dt(2027, 1, n)


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], NODE)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], EDGE)


def found(df):
    return sorted((r["edge_id"], r["side"]) for r in df.collect())


CASES = [
    (1, "a", "R", "b", day(5)),  # both there
    (2, "a", "R", "gone", day(5)),  # deleted before
    (3, "late", "R", "b", day(5)),  # arrives later
    (4, "A", "R", "never", day(5)),  # case matters, never delivered
    (5, None, "R", "b", day(5)),  # null end is no reference
    (6, "a", "R", "back", day(9)),  # deleted, then created anew
    (7, "a", None, "b", None),  # no time: nothing can resolve
    (8, "", "R", "b", day(5)),  # empty text is an ordinary id
    (2, "a", "R", "gone", day(5)),  # repeated row
    (9, "a", "R", "gone", day(2)),  # deleted at a later time
    (10, "a", "R", "edge", day(4)),  # deleted at the same moment
]
NODES = [
    ("a", day(1), None), ("a", day(3), None), ("b", day(1), day(20)), ("gone", day(1), day(3)), ("late", day(6), None), ("back", day(1), day(2)), ("back", day(8), None),
    (None, day(1), None), ("x", None, None), ("edge", day(1), day(4)), ("odd", day(5), day(4)),
]
WANT = sorted([(2, "target"), (2, "target"), (3, "source"), (4, "source"), (4, "target"), (7, "source"), (7, "target"), (8, "source"), (10, "target")])


@pytest.mark.parametrize("share,limit", [(0.9, 10), (0.01, 10_000), (0.01, 0)])
def test_orphans_by_every_path(spark, share, limit):
    got = orphans.orphan_references(edges(spark, CASES), nodes(spark, NODES), share, limit)
    assert found(got) == WANT


def test_orphans_of_empty_tables(spark):
    assert found(orphans.orphan_references(edges(spark, []), nodes(spark, NODES))) == []
    assert len(found(orphans.orphan_references(edges(spark, CASES[:2]), nodes(spark, [])))) == 4
    assert orphans.orphan_counts(orphans.orphan_references(edges(spark, CASES), nodes(spark, NODES))).count() > 0


def split(spark, values, **kw):
    df = spark.createDataFrame([(f"k{i:03d}", v, "clash") for i, v in enumerate(values)], "id string, f string, value string")
    out = packed.split_packed(packed.packed_fields(df, "t", "id", ["f"]), **kw).collect()
    res = {}
    for r in sorted(out, key=lambda r: (r["row_key"], r["pos"])):
        res.setdefault(r["row_key"], []).append(r["item"])
    for k, v in res.items():
        assert sorted(r["pos"] for r in out if r["row_key"] == k) == list(range(1, len(v) + 1))
    return [res.get(f"k{i:03d}", []) for i in range(len(values))]


def test_packed_conventions(spark):
    values = [
        "a；b;c", '"A不A", "一样"; "再"，"起来"', '"读作""de"""、离', "是（…）的", '["先","何必"]', "{335，12}", "“又，又”；跟；跟", "、、a;; b", "a\nb\tc d", None, "   ", "[]",
        "「主语 谓语」", "don't; 'x y'", '"never closed; b', "341-343/92", "p.301", '["x"]；"y"',
    ]
    want = [
        ["a", "b", "c"], ["A不A", "一样", "再", "起来"], ['读作"de"', "离"], ["是（…）的"], ["先", "何必"], ["335", "12"], ["又，又", "跟", "跟"], ["a", "b"], ["a", "b", "c", "d"], [], [], [],
        ["主语 谓语"], ["don't", "x y"], ['"never', "closed", "b"], ["341-343", "92"], ["p.301"], ['["x"]', "y"],
    ]
    assert split(spark, values) == want


def test_packed_joined_reading_is_learned(spark):
    """A value often seen quoted, whose parts are never seen alone, stays whole where it was left unquoted."""
    values = ["「给/替」"] * 40 + ["给/替；把"] + ["把；被"] * 5
    got = split(spark, values)
    assert got[40] == ["给/替", "把"]
    assert got[0] == ["给/替"] and got[-1] == ["把", "被"]


def test_packed_share_of_inner_separators_is_learned(spark):
    """Where a column often leaves values with separators unquoted, a pair both of whose parts are known is joined too."""
    habit = ["「先、再、然后」；跟", "「有；没有」、离"] * 20 + ["先、再、然后", "跟|有；没有|离"] * 60
    parts = ["给；跟", "替；离"] * 3 + ["「给/替」；跟"] * 30
    got = split(spark, [*habit, *parts, "离；给/替"])
    assert got[40] == ["先、再、然后"] and got[41] == ["跟", "有；没有", "离"] and got[-1] == ["离", "给/替"]
    rare = split(spark, ["跟；离"] * 60 + ["给；跟", "替；离"] * 30 + ["「给/替」；跟"] * 3 + ["离；给/替"])
    assert rare[-1] == ["离", "给", "替"]


def test_packed_long_values_join(spark):
    """Values of many pieces, and with blanks beside a separator, join as shorter ones do."""
    long = "甲、乙、丙、丁、戊、己、庚、辛"
    got = split(spark, [f"「{long}」"] * 20 + ['"子 / 丑"'] * 20 + [f"{long}；跟", "跟；子 / 丑", "甲、乙、丙；跟"] + ["跟；离"] * 9)
    assert got[40] == [long, "跟"] and got[41] == ["跟", "子 / 丑"] and got[42] == ["甲", "乙", "丙", "跟"]


def test_packed_frequent_pair_of_frequent_values_still_splits(spark):
    values = ["「又，又」"] * 10 + ["又，又，跟"] * 10 + ["又；跟"] * 30
    got = split(spark, values)
    assert got[10] == ["又", "又", "跟"]


def test_packed_very_long_quoted_and_open_fields(spark):
    got = split(spark, ['"' + "长，" * 30_000 + '"；b', '"' + "长 " * 5_000, "“" * 3_000])
    assert got[0] == ["长，" * 30_000, "b"] and len(got[1]) == 5_000 and len(got[2]) == 1


def test_packed_long_and_empty(spark):
    many = ";".join(f"v{i}" for i in range(3000))
    assert len(split(spark, [many])[0]) == 3000
    assert split(spark, [None]) == [[]]
