"""Text problems against brute force, planted cases and edge cases."""

import random
import unicodedata

import numpy as np
import pytest

from glossmill.llm import duplicates, leakage, lookalike, packing, queries, splits, truncation
from tests.conftest import SMALL
from tests.oracle import check, connect

DOC = "doc_id long, text string, source string, tokens string, kind string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "clash", "clash") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    check(spark, con, queries.QUERIES[name], queries.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0


# --- 1: splits -------------------------------------------------------------------------------------------------------


def hexa(i):
    return f"{i:016x}"


def records(spark, rows):
    return spark.createDataFrame([(i, n, g, "x") for i, (n, g) in enumerate(rows)], "row_id long, `编号` string, sentence_group string, block string")


def union_find(rows):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    clean = lambda s: "".join(c.lower() for c in s or "" if unicodedata.category(c)[0] in "LN")
    groups = set()
    for n, g in rows:
        n, g = clean(n), clean(g)
        if len(g) == 16 and all(c in "0123456789abcdef" for c in g):
            groups.add(g)
            if n:
                par[find("n" + n)] = find("g" + g)
    comp = {}
    for g in groups:
        comp.setdefault(find("g" + g), set()).add(g)
    return {(min(c), g) for c in comp.values() for g in c if g != min(c)}


def test_blocks_equal_union_find(spark):
    rng = random.Random(5)
    rows = [(f"N-{rng.randrange(150)}", hexa(rng.randrange(200)) if rng.random() < 0.8 else None) for _ in range(260)]
    rows += [(f"chain{i // 2}", hexa(5000 + (i + 1) // 2)) for i in range(80)]  # a long path
    rows += [("hub", hexa(9000 + i)) for i in range(60)]  # a star
    rows += [("N_1", hexa(3).upper()), ("n 1", hexa(4)[:8] + "-" + hexa(4)[8:]), ("", hexa(7)), (None, hexa(8)), ("q", "pending"), (None, None), ("q", "")]
    got = {tuple(r) for r in splits.linked_groups(records(spark, rows)).collect()}
    assert got == union_find(rows)


def test_splits_hold_blocks_and_proportions(spark):
    rng = random.Random(6)
    rows = [(f"N{rng.randrange(9000)}", hexa(rng.randrange(9000))) for _ in range(3000)] + [(f"H{i}", hexa(77777)) for i in range(1500)] + [(None, None)] * 3
    out = {r["row_id"]: (r["block"], r["split"]) for r in splits.assign_splits(records(spark, rows)).collect()}
    assert len(out) == len(rows)
    for key in (0, 1):
        seen = {}
        for i, r in enumerate(rows):
            if r[key] and (key == 0 or len(r[key]) == 16):
                assert seen.setdefault(r[key], out[i][1]) == out[i][1]
    share = sum(s == "train" for _, s in out.values()) / len(out)
    assert 0.7 <= share <= 0.9


def test_splits_of_nothing(spark):
    empty = records(spark, [])
    assert splits.linked_groups(empty).count() == 0 and splits.assign_splits(empty).count() == 0
    alone = records(spark, [("a", hexa(1)), ("a", hexa(1)), (None, None)])
    assert splits.linked_groups(alone).count() == 0 and splits.assign_splits(alone).count() == 3


# --- 4: duplicates ---------------------------------------------------------------------------------------------------


def prints(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "row_id long, a string, b double, h string")
    return duplicates.fingerprints(df, "t", **kw)


def pairs(df):
    return sorted((r["kept_row"], r["copy_row"]) for r in df.collect())


def test_copies_by_formatting(spark):
    rows = [("Ab, c", 1.0), ("aB C!", 1.0), ("abc", 2.0), (None, 1.0), (None, 1.0), ("", 1.0), (" ！", 1.0), ("a\u0001bc", 1.0), ("Ab, c", None)]
    got = pairs(duplicates.surplus_copies(prints(spark, rows, loose=["a"], exact=["b"])))
    assert got == [(0, 1), (0, 7), (3, 4), (5, 6)]


def test_labelled_fields_in_any_order(spark):
    rows = [
        ("时间：周一；地点：湖边；人物：小周", 1.0), ("人物:小周 | 时间：周一 | 地 点：湖边。", 1.0), ("时间：周一；地点：湖边；人物：小唐", 1.0), ("小周说：去湖边，周一。", 1.0),
        ("去湖边，小周说：周一", 1.0), ("昨天说，时间：周一；地点：湖边；人物：小周", 1.0), (None, 1.0),
    ]
    assert pairs(duplicates.surplus_copies(prints(spark, rows, exact=["b"], labelled=["a"]))) == [(0, 1)]


def test_hash_collisions_are_resolved(spark):
    from pyspark.sql import functions as F

    p = prints(spark, [("x", 1.0), ("y", 1.0), ("x", 1.0), ("y", 1.0)], loose=["a"], exact=["b"]).withColumn("h", F.lit(b"same"))
    assert pairs(duplicates.surplus_copies(p)) == [(0, 2), (1, 3)]
    assert sorted((r["kept_row"], r["n_copies"]) for r in duplicates.collapse(p).collect()) == [(0, 2), (1, 2)]
    assert duplicates.surplus_copies(p.limit(0)).count() == 0


def test_exact_columns_keep_control_signs(spark):
    rows = [(1, "a", "x\x01y"), (2, "A.", "xy"), (3, "a", "x\x01y"), (4, "a", "x\x02y"), (5, "a", "x\x03ay"), (6, "a", None)]
    df = spark.createDataFrame(rows, "row_id long, loose string, exact string")
    got = {tuple(r)[1:] for r in duplicates.surplus_copies(duplicates.fingerprints(df, "t", loose=["loose"], exact=["exact"])).collect()}
    assert got == {(1, 3)}


# --- 5: look-alikes --------------------------------------------------------------------------------------------------


def texts(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "x") for i, r in enumerate(rows)], "row_id long, sentence string, span string, look string, plain string")


def test_lookalikes(spark):
    rows = [
        ("Unit 27，去", "27"), ("Ｕｎｉｔ ２７,去", "27"), ("Unit  27，去", "２7"), ("unit 27，去", None), ("Unit 27；去", "28"), ("café", "fe"), ("café", "fé"), ("cafe", ""),
        ("РАР", "PAP"), ("PAP", "PAP"), (None, "x"), ("", ""), ("小​⼿", "小手"), ("小手", "小手"), ("Unit 27，去", None),
    ]
    got = sorted((r["row_a"], r["row_b"]) for r in lookalike.lookalike_pairs(texts(spark, rows), "sentence").collect())
    assert got == sorted([(0, 1), (1, 2), (1, 14), (5, 6), (8, 9), (12, 13)])
    assert sorted(r["row"] for r in lookalike.hidden_spans(texts(spark, rows)).collect()) == [1, 2, 6, 8, 12]
    form = {r["row_id"]: (r["sentence"], r["span"]) for r in lookalike.consistent(texts(spark, rows), ["sentence", "span"]).collect()}
    assert form[5][0] == form[6][0] and form[8][0] == form[9][0] and form[12][0] == form[13][0] and form[10] == (None, "x")
    for i in (1, 2, 6, 8, 12):
        assert form[i][1] in form[i][0]
    assert lookalike.lookalike_pairs(texts(spark, []), "sentence").count() == 0


def test_splits_have_blocks_of_all_sizes(spark):
    rng = random.Random(31)
    rows, row = [], 0
    for g in range(3000):
        for _ in range(1 if rng.random() < 0.6 else rng.randrange(2, 12)):
            rows.append((f"N{row}", f"{g:016x}"))
            row += 1
    rows += [(f"N{row + k}", f"{9999:016x}") for k in range(row // 3)]
    out = splits.assign_splits(records(spark, rows)).toPandas()
    share = out.groupby("split").size() / len(out)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02
    sizes = out.groupby(["split", "block"]).size()
    sizes = sizes[sizes < 100].groupby("split").mean()
    assert sizes.max() < 1.5 * sizes.min()
    assert out.groupby("block")["split"].nunique().max() == 1


# --- 6: packing ------------------------------------------------------------------------------------------------------


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 500)
    box = packing.best_fit(sizes, 100)
    room = {}
    for s, b in zip(sizes, box):
        fits = [r for r in room.values() if r >= s]
        if fits:
            assert room[b] == min(fits)
        else:
            assert b not in room
        room[b] = room.get(b, 100) - s
        assert room[b] >= 0


def test_containers(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "语法", "标记", "the", "of", "句子", "，"]
    many = ["".join(rng.choice(words) + " " for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["", None, " ".join(["word"] * 1000)]
    got = packing.pack_containers(docs(spark, many).repartition(5), capacity=128).collect()
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 128 and fill[0] == 0
    assert {r["doc_id"] for r in got} == set(range(len(many)))
    pieces = [r for r in got if r["doc_id"] == 402]
    assert sum(r["tokens"] for r in pieces) == 1000 and [r["tokens"] for r in sorted(pieces, key=lambda r: r["piece"])][:-1] == [128] * 7
    assert all(sum(1 for r in got if r["doc_id"] == i) == 1 for i in range(400))
    total = sum(fill.values())
    assert len(fill) - 1 <= 1.04 * -(-total // 128) + 1
    assert packing.pack_containers(docs(spark, [])).count() == 0


def test_packing_over_several_levels(spark, monkeypatch):
    rng = random.Random(32)
    many = [" ".join("word" for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    monkeypatch.setattr(packing, "MERGE_ROWS", 20)
    got = packing.pack_containers(docs(spark, many).repartition(12), capacity=128).toPandas()
    assert sorted(got["doc_id"]) == list(range(1500))
    fill = got.groupby("container")["tokens"].sum()
    assert fill.max() <= 128 and len(fill) <= 1.05 * np.ceil(got["tokens"].sum() / 128) + 2


# --- 7: leaks --------------------------------------------------------------------------------------------------------


def test_fm_index_equals_naive_search():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 3000).astype(np.uint16)
    text[::97] = 0
    text[1500:2400] = text[100:1000]  # a long repeat
    text[-1] = 0
    index = leakage.FMIndex(text, 3)
    sa = leakage.suffix_array(text, 3)
    assert [tuple(text[i:]) for i in sa] == sorted(tuple(text[i:]) for i in range(len(text)))
    phrases = np.zeros((60, 8), dtype=np.uint16)
    for k in range(60):
        n, a = int(rng.integers(1, 9)), int(rng.integers(0, 2990))
        w = text[a : a + n] if k % 3 else rng.integers(1, 5, n)
        w = w[w > 0]
        phrases[k, 8 - len(w) :] = w
    lo, hi = index.search(phrases)
    for k in range(60):
        w = phrases[k][phrases[k] > 0]
        if len(w):
            want = [i for i in range(len(text) - len(w) + 1) if (text[i : i + len(w)] == w).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def noisy(rng, s, every):
    out, at = [], 0
    while at < len(s):
        cut = min(len(s), at + every)
        out.append(s[at:cut])
        at = cut
        kind = rng.randrange(3)
        if at < len(s) and kind == 0:
            out.append("的")
        elif at < len(s):
            out.append("了" if kind == 1 else "")
            at += 1
    return "".join(out)


def test_leaks_are_found(spark):
    rng = random.Random(4)
    pool = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜海咸河淡鳞潜羽翔"
    item = lambda n: "".join(rng.choice(pool) + ("，" if rng.random() < 0.1 else "") for _ in range(n))
    items = [item(120) for _ in range(6)] + ["短句子", "", "  ！", None]
    items.append(items[0])  # an equal item
    hay = lambda: item(400)
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)
    full = items[1]
    cases = [
        hay() + items[0] + hay(), noisy(rng, items[2], 22), hay(), hay() + items[3][: int(len(items[3]) * 0.65)] + hay(), hay() + items[3][: int(len(items[3]) * 0.35)] + hay(),
        wide(full).replace("，", " \n"), None, "", "前面短句子后面", items[4][:40] + hay() + items[4][80:100], items[5] * 3, hay() + items[0] + hay(),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, start string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_pairs(docs(spark, cases), bench).collect()}
    assert got == {(0, 0), (0, 10), (1, 2), (3, 3), (5, 1), (8, 6), (10, 5), (11, 0), (11, 10)}
    spans = leakage.removal_spans(docs(spark, cases), bench).collect()
    for r in spans:
        assert 0 <= r["start"] < r["stop"] <= len(cases[r["doc_id"]])
    s0 = next(r for r in spans if r["doc_id"] == 0)
    assert abs(cases[0].index(items[0][:20]) - s0["start"]) <= 3 and s0["n_items"] == 2
    assert leakage.leaked_pairs(docs(spark, []), bench).count() == 0
    assert leakage.leaked_pairs(docs(spark, cases), bench.limit(0)).count() == 0


def test_leaks_in_blocks_and_pieces(spark, monkeypatch):
    rng = random.Random(8)
    item = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [item(80) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    cases = [item(900) + items[i] + item(900) for i in range(5)]
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    monkeypatch.setattr(leakage, "SHARD", 700)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_pairs(docs(spark, cases), bench).collect()}
    assert got == {(i, i) for i in range(5)}


@pytest.mark.parametrize("n", [350, 360, 400, 1500])
def test_long_items_hide_nothing(spark, monkeypatch, n):
    rng = random.Random(n)
    item = lambda k: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(k))
    long, short = item(n), item(40)
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    cases = [item(500) + short + item(2500), item(900) + long + item(900), item(30) + long[: n // 2 + 20] + item(30), item(30) + long[: n // 2 - 20] + item(600) + short, long, item(3000)]
    monkeypatch.setattr(leakage, "SHARD", 700)
    monkeypatch.setattr(leakage, "LONG", 100)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_pairs(docs(spark, cases), bench).collect()}
    assert got == {(0, 2), (1, 1), (2, 1), (3, 2), (4, 1)}


def brute_pairs(cases, items):
    """Every document and item with a stretch of half the item, from every pair of places that agree in four signs."""
    fold = leakage.folding()
    plain = lambda t: [int(c) for c in fold[leakage.code_points(t)] if c]

    def along(q, t):
        i = j = 0
        while True:
            while i < len(q) and j < len(t) and q[i] == t[j]:
                i, j = i + 1, j + 1
            if i >= len(q) or j >= len(t):
                return i
            runs = []
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                k = 0
                while k < 24 and i + di + k < len(q) and j + dj + k < len(t) and q[i + di + k] == t[j + dj + k]:
                    k += 1
                runs.append((k, di, dj))
            k, di, dj = max(runs, key=lambda r: r[0])
            if k < leakage.RESUME:
                return i
            i, j = i + di, j + dj

    found = set()
    for d, text in enumerate(cases):
        t = plain(text)
        at = {}
        for p in range(len(t) - 3):
            at.setdefault(tuple(t[p : p + 4]), []).append(p)
        for k, it in enumerate(items):
            q = plain(it)
            if any(along(q[a:], t[p:]) + along(q[:a][::-1], t[:p][::-1]) >= len(q) / 2 for a in range(len(q) - 3) for p in at.get(tuple(q[a : a + 4]), ())):
                found.add((d, k))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(21)
    item = lambda n: "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经") for _ in range(n))
    items = [item(rng.randrange(30, 90)) for _ in range(12)]
    cases = []
    for k in range(60):
        it = items[k % 12]
        a = rng.randrange(0, len(it) // 2)
        part = it[a : a + int(len(it) * rng.uniform(0.3, 1.0))]
        cases.append(item(rng.randrange(0, 40)) + noisy(rng, part, rng.randrange(9, 40)) + item(rng.randrange(0, 40)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_pairs(docs(spark, cases), bench).collect()}
    assert got == brute_pairs(cases, items) and len(got) > 20


def test_stock_instructions_are_not_multiplied(spark, monkeypatch):
    rng = random.Random(22)
    item = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    stock = item(24)
    items = [stock + item(100) for _ in range(300)]
    cases = [stock * 500, stock + item(60), "前文" + items[7] + "后文", stock + items[9][24:90], items[11] * 2]
    bench = spark.createDataFrame(list(enumerate(items)) + [(1000, items[7])], "item_id long, text string")
    alphabet = leakage.alphabet_of(list("".join(items)))
    block = leakage.prepare(list(enumerate(items)), alphabet)
    assert (block.first[1:] - block.first[:-1]).max() <= leakage.STOCK
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_pairs(docs(spark, cases), bench).collect()}
    assert got == {(2, 7), (2, 1000), (3, 9), (4, 11)}


# --- 8: cut texts ----------------------------------------------------------------------------------------------------


SENTENCES = ["小周在图书馆里整理了两个小时的笔记", "虽然标题很清楚，但是老唐昨天就修改了句子", "请把语法书放回架子上，再打开窗户", "为什么老师要在教室里朗读课文呢", "The teacher reads the sentence again because the label was missing"]


def corpus(rng, n):
    subs = ["笔记", "课本", "表格", "词典", "录音"]
    make = lambda: rng.choice(SENTENCES).replace("笔记", rng.choice(subs)).replace("课文", rng.choice(subs))
    return ["".join(make() + rng.choice("。！？") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def test_cut_texts(spark):
    rng = random.Random(9)
    base = corpus(rng, 300)
    cut = [
        base[0] + "虽然标题很清", base[1] + "请把语法书放回架子上，", base[2] + "小周在图书馆里整理了两�", base[3] + "他说：“为什么老师要在教", base[4] + "虽然标题很清楚，但是老 […", base[5] + "请把语法书…",
        base[6] + "The teacher reads the sent", base[7] + "请看&nbs", base[8] + "请把语",
    ]
    whole = [base[10] + "请把语法书放回架子上，再打开窗户", base[11] + "\n——小周", base[12] + "\n关键词：语法、句子", base[13] + "（完）", base[14] + " ^_^", "", None, "   ", base[15] + "\n第 12 页", "他问：“去不去？”"]
    df = docs(spark, base + cut + whole)
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    assert got == set(range(300, 300 + len(cut)))
    share = {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.cut_share(df).collect()}
    assert share == {"s": (300 + len(cut) + len(whole) - 3, len(cut))}
    assert truncation.cut_documents(docs(spark, [])).count() == 0


def test_completeness_model_on_held_out_prefixes():
    rng = random.Random(11)
    sents = [s for t in corpus(rng, 600) for s in truncation.sentences(t)]
    m = truncation.fit(sents[:1500])
    held = sents[1500:1900]
    assert np.mean([m.score(s) > 0 for s in held]) > 0.97
    assert np.mean([m.score(s[: rng.randrange(2, len(s) - 1)]) < 0 for s in held]) > 0.97


def test_very_long_text_is_judged(spark):
    long = "小周在图书馆里整理了笔记。" * 20_000 + "小周在图书"
    got = {r["doc_id"] for r in truncation.cut_documents(docs(spark, [long, long + "馆里整理了笔记。", *corpus(random.Random(1), 60)])).collect()}
    assert 1 not in got




def test_openings_outside_the_sample_are_known(spark, monkeypatch):
    monkeypatch.setattr(truncation, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(truncation.training_sentences, "__defaults__", (20, truncation.SAMPLE_SENTENCES))
    base = corpus(random.Random(3), 400)
    rare = ["鹦鹉在教室里朗读课文呢。", "鹦鹉把语法书放回架子上。", "小周整理了笔记。鹦鹉在教室里朗读课文，再打"]
    df = docs(spark, base + rare)
    assert not any(s.startswith("鹦鹉") for s in truncation.training_sentences(df))
    assert 402 in {r["doc_id"] for r in truncation.cut_documents(df).collect()}


def test_proven_source_limit_needs_no_known_opening(spark):
    whole = corpus(random.Random(4), 200)
    texts = [f"小周整理了笔记。{c}{c}虽然标题很清楚，但是老唐昨天就修" for c in "鲸鲨鳄鲵鳗鳕鲟鲈鲤鲫"]
    thanks = ["小周整理了笔记。\n谢谢大家"] * 3
    df = docs(spark, whole + texts + thanks)
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    assert got == set(range(200, 210))  # three of a length are no proof


def test_rare_openings_are_cut_by_the_sources_baseline(spark):
    rng = random.Random(12)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(n))
    words = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(n))
    known = corpus(rng, 300)
    chinese = ["".join(han(rng.randrange(9, 20)) + "。" for _ in range(4)) for _ in range(400)]
    english = [" ".join(words(rng.randrange(5, 12)).capitalize() + "." for _ in range(4)) for _ in range(400)]
    cut = [t + han(8) for t in chinese[:200]] + [t + " " + words(6).capitalize() for t in english[:100]] + [t + " Tariffs distort large and many differ" for t in english[100:200]]
    whole = chinese[200:] + english[200:] + [t + "\n——" + han(2) for t in chinese[200:300]] + [t + "哈哈" for t in chinese[300:320]]
    texts = known + cut + whole
    rows = [(i, t, "known" if i < 300 else "other") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    want = set(range(300, 700))
    assert len(got & want) >= 0.9 * len(want)
    assert len(got - want) <= 0.02 * len(rows)


def test_structure_of_whole_texts():
    kind = lambda t: truncation.ending(t)[0]
    assert kind("<div>第一句。第二句。") == "open" and kind("<div>第一句。</div>") == "bare" and kind("<p>第一句。<br>第二句。") == "done"
    assert kind('He said "the first one. And then.') == "done" and kind('He left. She said "the first one') == "open" and kind('He said "yes."') == "done"
    assert kind('A pipe of 5" and one more.') == "done" and kind("Look :( it is gone.") == "done"
    assert kind("说明。\n```\ncode.") == "open" and kind("说明。\n```\ncode.\n```\n完。") == "done"
    assert kind("文。<a href=\"https://example.org/" + "x" * 200) == "broken" and kind("文。<!-- " + "注" * 100) == "broken" and kind("当 a <b 时，结果很长很长，" * 9 + "所以。") == "done"
    assert kind("地址%E4%BD%A") == "broken" and kind("占100%") == "bare"
    assert kind("“" + "（一）" * 5000 + "完”。") == "done" and kind("「一『二（三）四』五。") == "open"
