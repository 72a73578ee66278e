"""Filling fixed-capacity containers with texts.

Sizes are tokens of a public tokenizer, whose vocabulary file is a parameter.  A text is divided only when it alone
exceeds the capacity: then into full pieces, each a container, and a rest that is packed like any text.

Method: hierarchical residual packing.  Each task packs its own texts best-fit in falling order, with one stack of open
containers per residual, so an item costs a bitmap look-up.  Containers filled to ``FULL`` are emitted; the others go
on as items one level up, where ``FAN_IN`` groups meet in one task and are packed best-fit again, until one
group is left or the groups, which hold at most about ``MERGE_ROWS`` containers, can't become fewer.  A merge task takes at most ``MERGE_ROWS`` containers, whatever their number.

Only container sizes travel between levels.  Every level is written to the shared folder before the next reads it, so
ids stay the same when a task is repeated, and texts are read and tokenized once.

Defined cases: null and empty texts have no tokens and share a container of their own (number 0); repeated texts are
packed as often as they occur; equal sizes are ordered by document id; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import materialize

CAPACITY = 2048
FULL = 0.99
FAN_IN = 8
MERGE_ROWS = 200_000
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_file(name: str = TOKENIZER) -> str:
    """Where the machine keeps a public tokenizer's vocabulary; a full path is taken as it is."""
    if "/" in name:
        return name
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], enc) -> list[int]:
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, items taken in the given order; each goes where least space would be left.

    Open containers lie in one stack per residual; a bitmap of residuals in use gives the smallest that fits.
    """
    stacks: dict[int, list[int]] = {}
    used, made = 0, 0
    out = np.empty(len(sizes), dtype=np.int64)
    for k, size in enumerate(sizes.tolist()):
        fitting = used >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            stack = stacks[room]
            box = stack.pop()
            if not stack:
                used &= ~(1 << room)
        else:
            room, box = capacity, made
            made += 1
        out[k] = box
        left = room - size
        if left:
            stacks.setdefault(left, []).append(box)
            used |= 1 << left
    return out


_LEVEL0 = "doc_id long, piece int, tokens int, box long, fill int"


def pack_locally(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """(doc_id, piece, tokens, box, fill): containers of each task; ``fill`` is the container's sum."""

    def pack(batches):
        ids, pieces, sizes = [], [], []
        enc = _encoder(path)
        for pdf in batches:
            for doc_id, n in zip(pdf["doc_id"].tolist(), count_tokens(pdf["text"].tolist(), enc)):
                whole, rest = divmod(n, capacity)
                parts = [capacity] * whole + ([rest] if rest or not whole else [])
                ids += [doc_id] * len(parts)
                pieces += range(len(parts))
                sizes += parts
        if not ids:
            return
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        frame = pd.DataFrame({"doc_id": ids, "piece": np.array(pieces, dtype=np.int32), "tokens": np.array(sizes, dtype=np.int32)})
        empty = frame["tokens"] == 0
        if empty.any():
            yield frame[empty].assign(box=-1, fill=0)
        frame = frame[~empty].sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
        if len(frame):
            box = best_fit(frame["tokens"].to_numpy(), capacity)
            fill = np.bincount(box, frame["tokens"].to_numpy())
            yield frame.assign(box=(task << 32) + box, fill=fill[box].astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pack, _LEVEL0)


def merge_level(bins: DataFrame, groups: int, capacity: int) -> DataFrame:
    """(box, fill, up, up_fill): under-full containers of one group packed together into containers ``up``."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "box"], ascending=[False, True])
        box = best_fit(pdf["fill"].to_numpy(), capacity)
        lead = pdf["box"].to_numpy()[np.unique(box, return_index=True)[1]]  # named after their first member
        fill = np.bincount(box, pdf["fill"].to_numpy())
        return pdf[["box", "fill"]].assign(up=lead[box], up_fill=fill[box].astype(np.int32))

    group = F.pmod(F.xxhash64("box"), F.lit(groups)).cast("int")
    return bins.withColumn("grp", group).groupBy("grp").applyInPandas(pack, "box long, fill int, up long, up_fill int")


def pack_containers(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, tokens, container): where every text, or piece of an over-long text, goes."""
    base = materialize(pack_locally(docs, capacity, tokenizer_file(tokenizer)), "pack-items")
    enough = int(FULL * capacity)
    open_bins = base.where((F.col("box") >= 0) & (F.col("fill") < enough)).select("box", "fill").distinct()
    open_bins = materialize(open_bins, "pack-open")
    left = open_bins.count()
    groups = max(1, -(-left // MERGE_ROWS))
    if groups == 1 and left > 4 * MERGE_ROWS // FAN_IN:  # one more level, so that the first runs in parallel
        groups = FAN_IN
    names = None
    while left > 1:
        level = materialize(merge_level(open_bins, groups, capacity), "pack-level")
        step = level.select("box", "up")
        if names is None:
            names = step
        else:
            moved = step.select(F.col("box").alias("up"), F.col("up").alias("top"))
            names = materialize(names.join(moved, "up", "left").select("box", F.coalesce("top", "up").alias("up")), "pack-names")
        open_bins = materialize(level.where(F.col("up_fill") < enough).select(F.col("up").alias("box"), F.col("up_fill").alias("fill")).distinct(), "pack-open")
        now = open_bins.count()
        fewer = max(1, -(-groups // FAN_IN), -(-now // MERGE_ROWS))
        if fewer >= groups:  # the same containers would meet again
            break
        left, groups = now, fewer
    placed = base if names is None else base.join(names, "box", "left").withColumn("box", F.coalesce("up", "box"))
    return placed.select("doc_id", "piece", "tokens", (F.col("box") + 1).alias("container"))
