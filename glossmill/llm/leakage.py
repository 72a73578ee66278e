"""Evaluation texts leaking into training text.

Method: the documents of a task are concatenated into shards, and each shard gets one FM-index: a suffix array by
prefix doubling, its Burrows-Wheeler transform in a wavelet matrix with rank counters, and text positions sampled at
every ``SAMPLE``-th place.  Phrases of the test items, short windows that start every ``STRIDE`` symbols, are searched
backward, all at once, through the wavelet ranks.  Their occurrences are located by walking to sampled positions, turned
into (document, item, diagonal) and counted; where one diagonal band holds enough of an item, an exact check extends the
match in both directions over isolated changed, lost or added characters, and keeps stretches of at least half the item.
The stretches of a document are merged into spans to remove.

Texts are compared by letters, digits and ideographs only, without case, accents or width, look-alikes as one.  Nothing
of the corpus is shuffled: documents stay where they were read, and are read and indexed once.  The test items are
prepared in blocks of about ``BLOCK_CHARS`` characters, written to the shared folder; a task holds one block at a time
and searches all blocks in the same index, so neither driver nor tasks ever hold more than a block, or one longer item.
Broadcast is only the table from code points to symbols, which Unicode bounds.

Guarantee of the phrases: a stretch is nominated when exact runs of at least ``q + STRIDE - 1`` symbols (``q`` is 6 for
ideographs, 12 for letters) hold a twentieth of the item, or of ``LONG`` symbols of a longer one, on one band of diagonals.
Phrases that more than ``STOCK`` different items share (stock instructions) are not multiplied by all those items:
where at most a quarter of an item is stock, its other phrases nominate it, with so many fewer as it has stock ones, and
at least one.  That nominates every pair which all phrases together would, unless no other phrase of the item is hit.

Documents longer than a shard are indexed in overlapping pieces, but stretches are extended over the whole document, so
a stretch may be longer than a shard, and an item too.

Defined cases: null and empty texts hold nothing; items without letters are skipped; equal items are searched once and
all reported; a document delivered again is reported again; ties don't matter, since every qualifying pair is kept.
Empty tables give no rows.
"""

from __future__ import annotations

import pickle
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.lookalike import TWINS
from glossmill.session import new_path

SHARD = 1 << 20
SAMPLE = 4
STRIDE = 2
WEIGHT = 12
IDEOGRAPH_WEIGHT = 2
BAND = 16
NOMINATE = 0.05
MIN_SHARE = 0.5
RESUME = 3
BLOCK_CHARS = 2_000_000
LONG = 4096
STOCK = 32
#: Rows of (occurrence, item) a task expands at a time, unless one document alone has more.
CHUNK = 2_000_000


def folding() -> np.ndarray:
    """Code point -> folded code point, 0 for formatting.  By rule from the Unicode data and the twins."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for lo, hi in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20)):
        for cp in range(lo, hi):
            ch = chr(cp)
            if 0xD800 <= cp <= 0xDFFF or unicodedata.category(ch) in ("Cn", "Cc", "Zs", "Cf"):
                continue
            form = "".join(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c)[0] != "M")[:1]
            form = TWINS.get(form, form).lower()[:1]
            if form and unicodedata.category(form)[0] in "LN":
                out[cp] = ord(form)
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x33480)):
        out[lo:hi] = np.arange(lo, hi)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Items:
    """A block of different test items as symbols, and their phrases: unique windows with where they come from."""

    ids: list[list[int]]  # all items of this text
    symbols: list[np.ndarray]
    phrases: np.ndarray  # one row per unique window, right-aligned, 0 where shorter
    origin: np.ndarray  # sorted rows (phrase, item, offset)
    first: np.ndarray  # phrase -> first row in origin
    need: np.ndarray  # hits on one band that nominate the item


@dataclass
class Alphabet:
    """Symbols of all items: those of formatting are 0, characters no item has are one symbol."""

    lookup: np.ndarray  # code point -> symbol
    bits: int
    weight: np.ndarray  # symbol -> share of a phrase


def alphabet_of(characters: list[str]) -> Alphabet:
    fold = folding()
    points = np.array([ord(c) for c in characters if len(c) == 1], dtype=np.int64)
    used = np.unique(fold[points]) if len(points) else np.zeros(0, dtype=np.uint32)
    used = used[used > 0]
    other = len(used) + 1
    kind = np.uint16 if other < 1 << 16 else np.uint32
    code = np.zeros(0x110000, dtype=kind)
    code[used] = np.arange(1, other)
    lookup = np.where(fold > 0, np.where(code[fold] > 0, code[fold], other), 0).astype(kind)
    weight = np.zeros(other + 1, dtype=np.int64)
    weight[1:other] = np.where(used >= 0x2E80, IDEOGRAPH_WEIGHT, 1)
    return Alphabet(lookup, int(other).bit_length(), weight)


def prepare(items: list[tuple[int, str]], alphabet: Alphabet) -> Items | None:
    ids: dict[bytes, list[int]] = {}
    symbols: list[np.ndarray] = []
    for i, text in items:
        s = alphabet.lookup[code_points(text or "")]
        s = s[s > 0]
        if not len(s):
            continue
        same = ids.setdefault(s.tobytes(), [])
        if not same:
            symbols.append(s)
        same.append(i)
    if not symbols:
        return None
    windows: dict[bytes, int] = {}
    origin, rows = [], []
    for k, s in enumerate(symbols):
        run = np.concatenate(([0], np.cumsum(alphabet.weight[s])))
        starts = np.arange(0, len(s), STRIDE)
        stops = np.searchsorted(run, run[starts] + WEIGHT)
        fits = stops <= len(s)
        spans = list(zip(starts[fits].tolist(), stops[fits].tolist())) or [(0, len(s))]  # shorter than any window: one phrase
        for a, b in spans:
            w = s[a:b]
            p = windows.setdefault(w.tobytes(), len(windows))
            if p == len(rows):
                rows.append(w)
            origin.append((p, k, a))
    width = max(len(w) for w in rows)
    phrases = np.zeros((len(rows), width), dtype=alphabet.lookup.dtype)
    for p, w in enumerate(rows):
        phrases[p, width - len(w) :] = w
    origin_a = np.array(sorted(origin), dtype=np.int64)
    origin_a, need = _without_stock(origin_a, np.array([len(s) for s in symbols]), len(rows))
    first = np.searchsorted(origin_a[:, 0], np.arange(len(rows) + 1))
    return Items(list(ids.values()), symbols, phrases, origin_a, first, need)


def _without_stock(origin: np.ndarray, sizes: np.ndarray, n_phrases: int) -> tuple[np.ndarray, np.ndarray]:
    """Origins without those of stock phrases in items that are mostly other text, and the hits each item still needs."""
    sizes = np.minimum(sizes, LONG)
    need = np.maximum(np.maximum(1, np.minimum(2, sizes // (2 * STRIDE))), np.floor(NOMINATE * sizes / STRIDE).astype(np.int64))
    pairs = np.unique(origin[:, :2], axis=0)
    stock = (np.bincount(pairs[:, 0], minlength=n_phrases) > STOCK)[origin[:, 0]]
    of_stock = np.bincount(origin[stock, 1], minlength=len(sizes))
    total = np.bincount(origin[:, 1], minlength=len(sizes))
    lean = of_stock * 4 <= total
    need = np.where(lean, np.maximum(1, need - of_stock), need)
    return origin[~(stock & lean[origin[:, 1]])], need


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array by prefix doubling; keys carry their position in the low bits, so plain sorts do."""
    n = len(text)
    idx_bits = max(1, int(n).bit_length())
    per = max(1, min((63 - idx_bits) // bits, 8))
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((text.astype(np.int64), np.zeros(per, dtype=np.int64)))
    for k in range(per):
        key = (key << bits) | padded[k : k + n]
    order = np.sort((key << idx_bits) | np.arange(n))
    sa = order & ((1 << idx_bits) - 1)
    head = np.concatenate(([True], (order[1:] >> idx_bits) != (order[:-1] >> idx_bits)))
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.zeros(n + 1, dtype=np.int64)  # 1-based group start; 0 stands for the end of the text
    rank[sa] = start + 1
    tail = np.concatenate((head[1:], [True]))
    open_at = np.flatnonzero(~(head & tail))
    k = per
    while len(open_at) and k < n:
        pos = sa[open_at]
        group = rank[pos]
        after = rank[np.minimum(pos + k, n)]
        local = np.lexsort((after, group)) if 2 * idx_bits + int(len(open_at)).bit_length() > 63 else None
        if local is None:
            m_bits = int(len(open_at)).bit_length()
            packed = np.sort((((group << idx_bits) | after) << m_bits) | np.arange(len(open_at)))
            local = packed & ((1 << m_bits) - 1)
        pos, group, after = pos[local], group[local], after[local]
        sa[open_at] = pos
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        start = open_at[np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))]
        rank[pos] = start + 1
        tail = np.concatenate((head[1:], [True]))
        open_at = open_at[~(head & tail)]
        k *= 2
    return sa


class FMIndex:
    """Burrows-Wheeler transform in a wavelet matrix with sampled suffix positions."""

    def __init__(self, text: np.ndarray, bits: int):
        sa = suffix_array(text, bits)
        self.n, self.bits = len(text), bits
        row = text[sa - 1]  # the text is cyclic: before the first symbol stands the last, a separator
        counts = np.bincount(text, minlength=(1 << bits) + 1)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.words, self.sums, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            words, sums = self._pack(bit)
            self.words.append(words)
            self.sums.append(sums)
            self.zeros.append(int(self.n - sums[-1]))
            row = np.concatenate((row[~bit], row[bit]))
        # after each separator too: the walk to a sampled place then never passes one, whose order the cycle doesn't keep
        start = np.concatenate(([True], text[:-1] == 0))
        marked = (sa % SAMPLE == 0) | start[sa]
        self.mark_words, self.mark_sums = self._pack(marked)
        self.samples = sa[marked]

    @staticmethod
    def _pack(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(bit) // 64 + 1
        raw = np.zeros(size * 8, dtype=np.uint8)
        packed = np.packbits(bit, bitorder="little")
        raw[: len(packed)] = packed
        words = raw.view(np.uint64)
        return words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def _rank(words: np.ndarray, sums: np.ndarray, pos: np.ndarray) -> np.ndarray:
        w = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return sums[w] + np.bitwise_count(words[w] & mask)

    def _count(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``pos`` rows of the transform."""
        start = np.zeros(len(pos), dtype=np.int64)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self._rank(self.words[k], self.sums[k], start), self._rank(self.words[k], self.sums[k], pos)
            start = np.where(one, self.zeros[k] + a, start - a)
            pos = np.where(one, self.zeros[k] + b, pos - b)
        return pos - start

    def _step(self, pos: np.ndarray) -> np.ndarray:
        """From the row of a suffix to the row of the suffix one symbol longer."""
        symbol = np.zeros(len(pos), dtype=np.int64)
        start = np.zeros(len(pos), dtype=np.int64)
        for k in range(self.bits):
            w = pos >> 6
            one = ((self.words[k][w] >> (pos & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol = (symbol << 1) | one
            a, b = self._rank(self.words[k], self.sums[k], start), self._rank(self.words[k], self.sums[k], pos)
            start = np.where(one, self.zeros[k] + a, start - a)
            pos = np.where(one, self.zeros[k] + b, pos - b)
        return self.below[symbol] + pos - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (right-aligned, 0-padded) by backward search."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for col in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, col].astype(np.int64)
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            if not len(live):
                break
            both = self._count(np.concatenate((symbol, symbol)), np.concatenate((lo[live], hi[live])))
            lo[live] = self.below[symbol] + both[: len(live)]
            hi[live] = self.below[symbol] + both[len(live) :]
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking to the nearest sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            w = at >> 6
            hit = ((self.mark_words[w] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            if hit.any():
                out[todo[hit]] = self.samples[self._rank(self.mark_words, self.mark_sums, at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                at = self._step(at)
            steps += 1
        return out


def as_text(symbols: np.ndarray) -> str:
    """Symbols as characters: comparing short pieces of text is far cheaper than comparing short arrays."""
    return symbols.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _run(q: str, i: int, t: str, j: int, most: int) -> int:
    """Length of the common prefix of ``q[i:]`` and ``t[j:]``, up to ``most``."""
    n = min(len(q) - i, len(t) - j, most)
    at, step = 0, 16
    while at < n and q[i + at : i + at + step] == t[j + at : j + at + step]:
        at += step
        step = min(2 * step, 1 << 16)
    while at < n and q[i + at] == t[j + at]:
        half = max(1, step >> 1)
        while half > 1 and q[i + at : i + at + half] != t[j + at : j + at + half]:
            half >>= 1
        at += half
    return min(at, n)


def _extend(q: str, t: str) -> tuple[int, int]:
    """How far ``q`` and ``t`` agree from their starts, over isolated changed, lost or added symbols."""
    i = j = 0
    while True:
        r = _run(q, i, t, j, len(q))
        i, j = i + r, j + r
        if i >= len(q) or j >= len(t):
            return i, j
        best, move = 0, (0, 0)
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            m = _run(q, i + di, t, j + dj, 24)
            if m > best:
                best, move = m, (di, dj)
        if best < RESUME:
            return i, j
        i, j = i + move[0], j + move[1]


def stretches(q: str, t: str, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(item from, to, text from, to) of the longest stretches through seeds (item offset, text position)."""
    out: list[tuple[int, int, int, int]] = []
    near: list[tuple[int, int, int, int]] = []  # those that reach beyond the current seed
    reach = 2 * len(q) + 64  # every added symbol is followed by RESUME that agree
    for a, p in sorted(seeds, key=lambda s: (s[1], s[0])):
        near = [s for s in near if s[3] > p]
        if any(x <= a < y and u <= p and abs((p - a) - (u - x)) <= BAND for x, y, u, v in near):
            continue
        fi, fj = _extend(q[a:], t[p : p + reach])
        bi, bj = _extend(q[:a][::-1], t[max(0, p - reach) : p][::-1])
        near.append((a - bi, a + fi, p - bj, p + fj))
        out.append(near[-1])
    return out


class Shard:
    """Pieces of documents under one FM-index: (document, where the piece starts in it, its symbols)."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]], bits: int):
        self.doc = np.array([d for d, _, _ in pieces])
        self.begin = np.array([a for _, a, _ in pieces], dtype=np.int64)
        self.starts = np.cumsum([0] + [len(s) + 1 for _, _, s in pieces])
        text = np.zeros(self.starts[-1], dtype=pieces[0][2].dtype)
        for (_, _, s), a in zip(pieces, self.starts):
            text[a : a + len(s)] = s
        self.index = FMIndex(text, bits)

    def scan(self, items: Items, whole: list[np.ndarray]) -> set[tuple[int, int, int, int]]:
        """(document, item, from, to) in symbols of the whole documents, of every qualifying stretch."""
        lo, hi = self.index.search(items.phrases)
        n = hi - lo
        n[items.first[1:] == items.first[:-1]] = 0
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return set()
        place = self.index.locate(np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which])
        order = np.argsort(place, kind="stable")
        which, place = which[order], place[order]
        piece = np.searchsorted(self.starts, place, side="right") - 1
        fan = (items.first[1:] - items.first[:-1])[which]
        rows = np.concatenate(([0], np.cumsum(fan)))
        ends = np.concatenate((np.flatnonzero(np.diff(piece)) + 1, [len(piece)]))  # chunks end with a piece
        found: set[tuple[int, int, int, int]] = set()
        a = 0
        while a < len(which):
            b = int(ends[max(np.searchsorted(rows[ends], rows[a] + CHUNK, side="right") - 1, np.searchsorted(ends, a, side="right"))])
            found |= self._nominate(items, whole, which[a:b], place[a:b], piece[a:b], fan[a:b])
            a = b
        return found

    def _nominate(self, items: Items, whole, which, place, piece, fan) -> set[tuple[int, int, int, int]]:
        row = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(items.first[which], fan)
        item, offset = items.origin[row, 1], items.origin[row, 2]
        doc = np.repeat(self.doc[piece], fan)
        pos = np.repeat(place - self.starts[piece] + self.begin[piece], fan)
        hot = np.zeros(len(doc), dtype=bool)
        diagonal = pos - offset + max(len(s) for s in items.symbols)
        for shift in (0, BAND // 2):
            band = (diagonal + shift) // BAND
            order = np.lexsort((band, item, doc))
            d, i, k = doc[order], item[order], band[order]
            head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1]))))
            count = np.diff(np.concatenate((head, [len(k)])))
            hot[order] |= np.repeat(count >= items.need[i[head]], count)
        found = set()
        pick = np.flatnonzero(hot)
        pick = pick[np.lexsort((offset[pick], pos[pick], item[pick], doc[pick]))]
        heads = np.flatnonzero(np.diff(doc[pick], prepend=-1).astype(bool) | np.diff(item[pick], prepend=-1).astype(bool)).tolist()
        queries: dict[int, str] = {}
        last, text = -1, ""
        for a, b in zip(heads, heads[1:] + [len(pick)]):
            d, i = int(doc[pick[a]]), int(item[pick[a]])
            if d != last:  # pairs come by document
                last, text = d, as_text(whole[d])
            q = queries.get(i) or queries.setdefault(i, as_text(items.symbols[i]))
            seeds = list(zip(offset[pick[a:b]].tolist(), pos[pick[a:b]].tolist()))
            for x, y, u, v in stretches(q, text, seeds):
                if (y - x) >= MIN_SHARE * len(q):
                    found.add((d, i, u, v))
        return found


_SCHEMA = "doc_id long, item_id long, start int, stop int"


def leaked_stretches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, stop): stretches of documents, in characters, that hold half of an item or more."""
    spark = docs.sparkSession
    known = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if not size:
        return spark.createDataFrame([], _SCHEMA)
    characters = known.select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).distinct()
    shared = spark.sparkContext.broadcast(alphabet_of([r["c"] for r in characters.collect()]))
    n_blocks = max(1, -(-int(size) // BLOCK_CHARS))
    path = new_path(spark, "items")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        items = prepare(list(zip(pdf["item_id"].tolist(), pdf["text"].tolist())), shared.value)
        payload = [] if items is None else [pickle.dumps(tuple(vars(items).values()), protocol=5)]
        return pd.DataFrame({"block": pdf["block"].iloc[:1].repeat(len(payload)), "payload": payload})

    blocks = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
    blocks.groupBy("block").applyInPandas(pack, "block int, payload binary").write.partitionBy("block").parquet(path)
    present = sorted(r["block"] for r in spark.read.schema("payload binary, block int").parquet(path).select("block").distinct().collect())
    texts = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInPandas(_scanner(shared, path, present), _SCHEMA)


def read_block(path: str, block: int) -> Items:
    """A block of prepared items from the shared folder."""
    import pyarrow.fs
    import pyarrow.parquet

    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    payload = pyarrow.parquet.read_table(f"{root}/block={block}", filesystem=fs, columns=["payload"], partitioning=None)["payload"]
    return Items(*pickle.loads(payload[0].as_py()))


def _scanner(shared, path: str, blocks: list[int]):
    def scan(batches):
        alphabet = shared.value
        kept = read_block(path, blocks[0]) if len(blocks) == 1 else None
        overlap = 2 * LONG
        shard = max(SHARD, 2 * overlap)
        pieces: list[tuple[int, int, np.ndarray]] = []
        whole: list[np.ndarray] = []
        origin: list[tuple[int, np.ndarray]] = []  # document id and the character of each symbol
        size = 0

        def flush():
            index = Shard(pieces, alphabet.bits)
            rows = set()
            for b in blocks:
                items = kept or read_block(path, b)
                for d, i, u, v in index.scan(items, whole):
                    doc_id, chars = origin[d]
                    rows.update((doc_id, item_id, int(chars[u]), int(chars[v - 1]) + 1) for item_id in items.ids[i])
            return pd.DataFrame(sorted(rows, key=str), columns=["doc_id", "item_id", "start", "stop"])

        for pdf in batches if blocks else ():
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                symbols = alphabet.lookup[code_points(text)]
                chars = np.flatnonzero(symbols).astype(np.int32)
                symbols = symbols[chars]
                if not len(symbols):
                    continue
                whole.append(symbols)
                origin.append((doc_id, chars))
                for a in range(0, max(1, len(symbols) - overlap), shard - overlap):
                    piece = symbols[a : a + shard]
                    if pieces and size + len(piece) > shard:
                        yield flush()
                        whole, origin, pieces, size = whole[-1:], origin[-1:], [], 0
                    pieces.append((len(whole) - 1, a, piece))
                    size += len(piece) + 1
        if pieces:
            yield flush()

    return scan


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document and item of which it holds half or more in one stretch."""
    return leaked_stretches(docs, benchmark).select("doc_id", "item_id").distinct()


def removal_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, start, stop, n_items): overlapping stretches of a document merged into spans to remove."""
    found = leaked_stretches(docs, benchmark)
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "item_id"))).alias("s"))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(
                F.struct(
                    F.element_at(acc, -1)["start"].alias("start"),
                    F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"),
                    F.array_union(F.element_at(acc, -1)["items"], F.array(x["item_id"])).alias("items"),
                )
            ),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.array(x["item_id"]).alias("items")))))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,items:array<bigint>>>)")
    merged = by_doc.select("doc_id", F.explode(F.aggregate("s", empty, step)).alias("m"))
    return merged.select("doc_id", "m.start", "m.stop", F.size("m.items").alias("n_items"))
