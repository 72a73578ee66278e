"""The best pages of each point, without a row for each pair of point and page.

``align.page_scores`` joins points to the pages that share a cue with them, so its rows grow as points times pages.  Here the
hits are written once to the shared folder, and a task scores its points against the pages of their source in memory: pages
with a heading of the point's or with its printed id first, all others only where they could still be among the best.  No
page is left out unless its score has a bound below those kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.session import materialize_at

#: Cells (cues times pages, a byte each) of a block of pages, and points held by a task at once.
CELLS, POINTS = 1 << 27, 100_000
LABEL = ("grammar_full", "canonical", "grammar_component")
FLAGS = "printed boolean, n_label long, n_long_label long, n_long long, full boolean, headed boolean"


class Block:
    """Pages of one source in the order of their ids; ``marks``: by cue and page 1 where it hits, 3 where it heads too."""

    def __init__(self, pages: np.ndarray, cues: list[str], marks: np.ndarray, base: np.ndarray, ids: dict[str, np.ndarray], whole: bool):
        self.pages, self.marks, self.base, self.ids, self.whole = pages, marks, base, ids, whole
        some = marks.any(axis=1)
        self.rows = {c: v for v, c in enumerate(cues) if some[v]}
        self.top, self.kept = float(base.max()), {}

    def where(self, row: int, least: int) -> np.ndarray:
        """Pages that the cue hits (1) or heads (3)."""
        if (row, least) not in self.kept:
            self.kept[row, least] = np.flatnonzero(self.marks[row] >= least).astype(np.int32)
        return self.kept[row, least]


def blocks(path: str, source: str, cells: int):
    """The pages of a source, read from the shared folder, in blocks of ``cells`` cells."""
    import pyarrow.dataset
    import pyarrow.fs

    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    data = pyarrow.dataset.dataset(root, filesystem=fs, format="parquet", partitioning=None)
    t = data.to_table(columns=["page_id", "cue", "printed", "heading", "content", "navigation"], filter=pyarrow.dataset.field("source") == source)
    if not t.num_rows:
        return
    pages, at = np.unique(t["page_id"].to_numpy(), return_inverse=True)
    cue = t["cue"].combine_chunks().dictionary_encode()
    cue = cue.combine_chunks() if isinstance(cue, pa.ChunkedArray) else cue
    names, code = cue.dictionary.to_pylist(), cue.indices.to_numpy(zero_copy_only=False)
    printed, heading, content, navigation = (t[c].to_numpy() for c in ("printed", "heading", "content", "navigation"))
    is_content, is_navigation = np.zeros(len(pages), bool), np.zeros(len(pages), bool)
    is_content[at[content]] = is_navigation[at[navigation]] = True
    base = 2.0 * is_content - 80.0 * (is_navigation & ~is_content)
    size = max(1, cells // max(1, len(names)))
    for low in range(0, len(pages), size):
        here = (at >= low) & (at < low + size)
        marks = np.zeros((len(names), min(size, len(pages) - low)), np.uint8)
        for mask, mark in ((here & ~printed, 1), (here & ~printed & heading, 3)):
            marks[code[mask], at[mask] - low] = mark
        ids: dict[str, list[int]] = {}
        for c, p in zip(code[here & printed].tolist(), (at[here & printed] - low).tolist()):
            ids.setdefault(names[c], []).append(p)
        yield Block(pages[low : low + size], names, marks, base[low : low + size], {c: np.unique(p) for c, p in ids.items()}, size >= len(pages))


class Point:
    """Cues of a point that hit pages of a block, as (row, text, weight, origin), and its printed ids there."""

    def __init__(self, cues: tuple, ids: tuple, block: Block):
        self.cues, self.block = cues, block
        self.rows = [c[0] for c in cues]
        size = [len(c[1]) for c in cues]
        self.n = np.array(size, float)
        self.weight = np.array([0.0 if o == "grammar_full" else min(w, {1: 1.0, 2: 5.0}.get(n, w)) for (_, _, w, o), n in zip(cues, size)])
        of = lambda *origins: [i for i, c in enumerate(cues) if c[3] in origins]
        self.full, self.label, self.section, self.legacy = of("grammar_full"), of(*LABEL), of("section_item"), of("legacy_regex_literal")
        self.long = [i for i, n in enumerate(size) if n >= 2]
        self.printed = np.unique(np.concatenate([block.ids[i] for i in ids])) if ids else np.zeros(0, np.int32)

    def score(self, marks: np.ndarray, base: np.ndarray, printed: np.ndarray) -> np.ndarray:
        """The score of ``align.page_scores``; marks by cue and page."""
        hit, head, none = marks >= 1, marks >= 3, np.zeros(len(base))
        longest = lambda rows, on: (self.n[rows, None] * on[rows]).max(axis=0) if rows else none
        some = lambda rows: hit[rows].any(axis=0) if rows else none > 0
        full, label, section = longest(self.full, hit), longest(self.label, head), longest(self.section, head)
        s = base + 48.0 * printed + np.where(full > 0, 22.0 + np.minimum(full, 18) * 0.7, 0.0) + np.minimum(38.0, self.weight @ hit)
        s += np.where(label > 0, 42.0 + np.minimum(label, 15) * 1.2, np.where(section > 0, 15.0 + np.minimum(section, 15) * 0.8, 0.0))
        if self.section:
            s += 9.0 * (some(self.section) & some(self.label))
        if self.legacy:
            s += 1.5 * some(self.legacy)
        s = np.where(printed | (label > 0) | (section > 0) | some(self.long), s, np.minimum(s, 3.0))
        return np.floor(np.maximum(s, 0.0) * 1000 + 0.5) / 1000

    def over_all(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all pages of the block, and which of them hold any evidence."""
        printed = np.zeros(len(self.block.base), bool)
        printed[self.printed] = True
        marks = self.block.marks[self.rows]
        return self.score(marks, self.block.base, printed), marks.any(axis=0) | printed

    def best(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``limit`` best pages with their scores, ties to the smaller page."""
        b = self.block
        heads = [h for i in (*self.label, *self.section) if len(h := b.where(self.rows[i], 3))]
        at = np.unique(np.concatenate([*heads, self.printed])) if heads else self.printed
        if len(at) >= limit:
            # a last column for any page without heading and id: it scores no more than one with all cues
            marks = np.concatenate([b.marks[np.ix_(self.rows, at)], np.ones((len(self.rows), 1), np.uint8)], axis=1)
            s = self.score(marks, np.append(b.base[at], b.top), np.append(np.isin(at, self.printed), False))
            first, found = top(s[:-1], at, limit)
            if found[-1] > s[-1]:
                return first, found
        s, some = self.over_all()
        at = np.flatnonzero(some)
        return top(s[at], at, limit)

    def walk(self, limit: int, floor: float, near: float) -> tuple[np.ndarray, np.ndarray]:
        """Pages that a greedy choice over all blocks can keep: the ``limit`` best, and the best with each cue.

        A page far from the best is kept for a cue that no page before it holds, thus for one that it is the best with.
        """
        at, s = self.best(limit)
        if self.block.whole and len(at) == limit and s[-1] >= max(floor, near * s[0]):
            return at, s
        every, _ = self.over_all()
        firsts = [p[every[p].argmax()] for p in (self.block.where(r, 1) for r in self.rows)]
        at = np.unique(np.concatenate([at, np.array(firsts, at.dtype)]))
        return at, every[at]

    def rows_of(self, at: np.ndarray, s: np.ndarray) -> list[tuple]:
        out = []
        ids = set(self.printed.tolist())
        for p, score, marks in zip(at.tolist(), s.tolist(), self.block.marks[np.ix_(self.rows, at)].T.tolist()):
            on = [(c[1], c[3], m) for c, m in zip(self.cues, marks) if m]
            label = [len(c) for c, o, _ in on if o in LABEL]
            out.append((
                self.block.pages[p], len(on), sorted({c for c, _, _ in on}), score, p in ids, len(label), sum(n >= 2 for n in label), sum(len(c) >= 2 for c, _, _ in on),
                any(o == "grammar_full" for _, o, _ in on), any(m == 3 and (o in LABEL or o == "section_item") for _, o, m in on),
            ))
        return out


def top(s: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    if len(s) > 4 * limit:
        keep = np.flatnonzero(s >= np.partition(s, len(s) - limit)[len(s) - limit])
        s, at = s[keep], at[keep]
    order = np.argsort(-s, kind="stable")[:limit]
    return at[order], s[order]


def best_pages(points: DataFrame, hits: DataFrame, limit: int = 2, walk: tuple[float, float] | None = None) -> DataFrame:
    """The rows of ``align.page_scores(points, hits)`` that are among the ``limit`` best of a point in its source.

    With ``walk``, floor and share of the best that count as near, also those that ``ranking.greedy_pages`` can keep.  Of a
    source that takes several blocks, the rows of each block are given.
    """
    spark = points.sparkSession
    _, path = materialize_at(hits, "hits")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_point = points.where(F.col("source").isNotNull()).repartition(n, "point", "source")
    by_point = by_point.groupBy("point", "source").agg(F.collect_list(F.struct("cue", "weight", "origin")).alias("cues"))
    kinds = {f.name: f.dataType.simpleString() for f in (points.schema["point"], points.schema["source"], hits.schema["page_id"])}
    schema = T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in kinds.items()) + f", n_cues long, cues array<string>, score double, {FLAGS}")
    return by_point.mapInArrow(_searcher(path, limit, walk, schema, CELLS), schema)


def _searcher(path: str, limit: int, walk: tuple[float, float] | None, schema: T.StructType, cells: int):
    def found(point: Point) -> list[tuple]:
        return point.rows_of(*(point.walk(limit, *walk) if walk else point.best(limit)))

    def search(source: str, points: list[tuple]):
        for block in blocks(path, source, cells):
            known: dict[tuple, list[tuple]] = {}
            out: list[tuple] = []
            for name, cues in points:
                plain = tuple(sorted((block.rows[c["cue"]], c["cue"], c["weight"], c["origin"]) for c in cues if c["origin"] != "official_id" and c["cue"] in block.rows))
                ids = tuple(sorted({c["cue"] for c in cues if c["origin"] == "official_id" and c["cue"] in block.ids}))
                if not plain and not ids:
                    continue
                if (plain, ids) not in known:
                    known[plain, ids] = found(Point(plain, ids, block))
                out += [(name, source, *r) for r in known[plain, ids]]
                if len(out) > 20_000:
                    yield out
                    out = []
            yield out

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        held: dict[str, list[tuple]] = {}

        def flush():
            for source, points in held.items():
                for rows in search(source, points):
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
            held.clear()

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held.setdefault(r[1], []).append((r[0], r[2]))
            if sum(map(len, held.values())) >= POINTS:
                yield from flush()
        yield from flush()

    return run
