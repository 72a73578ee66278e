"""Text cut off by field limits or in transfer.

Method: one pass over whole texts with a stack automaton for structure, a look at how the text ends, and the source's
baselines, which are counted over all documents.

* A text ending in a broken multibyte sequence or an unfinished escape, entity, comment or tag is cut.
* Quotes (curved, corner and straight), brackets, markup elements and code fences are pushed and popped through the
  whole text.  A quote or bracket still open in the last sentence means a cut, and so does an element or fence that is
  still open anywhere.  A quote left open in an earlier sentence says nothing about the end.
* A mark that stands for missing text (``…``, ``...``) at the end is taken off; what is left must be whole.
* A text whose last sentence has its terminator is complete; so is one that ends in a closed bracket or sign.
* A missing terminator is judged against the source: how often its sentences have one, and how often the texts of just
  this length lack it.  Where the source ends its sentences with terminators, a last sentence without one is cut.

Two kinds of complete text lack a terminator and have no structure that tells so.  Closing lines (signature, list, key
words, page number) are short lines of their own, or interjections, whose opening more texts end with than sentences
start with.  Whole sentences without full stop are told from prefixes by a model of sentence completeness, which is
asked only where the documents know the sentence's opening; elsewhere it has no basis and the source's baseline decides.
The model is trained here, on the corpus itself: whole sentences, taken between two terminators, against prefixes of
such sentences, as a logistic regression on hashed features.  Its weights are fitted on about ``SAMPLE_SENTENCES``
sentences of about ``SAMPLE_DOCS`` documents chosen by hash of their id, whatever the corpus holds; openings, closing
lines and baselines cover all documents.

The corpus is read once: the pass writes one short row per document, and per task the counts of sentence openings and
the sentences of sampled documents; everything else reads that table.

Defined cases: null and empty texts, and texts of blanks, are no case; repeated texts are judged alike; a null source is
a source of its own; a very long text costs time linear in its length; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import materialize

#: Bounds of the model's training set: documents whose sentences are offered, and sentences taken from them.
SAMPLE_SENTENCES = 12_000
SAMPLE_DOCS = 1_500
HASH_BITS = 18
EPOCHS = 5
BATCH = 64
RATE = 0.3
#: Openings seen at least this often in all documents belong to sentences.
OPENING_SUPPORT = 2
#: Distinct openings a task holds before it hands their counts on.
OPENINGS_HELD = 200_000
#: A last line of at most so many words, or ideographs, may be a closing line that opens like a sentence.
SHORT_LINE = (6, 14)
#: At most so many words, or ideographs, within a line may be an interjection.
INTERJECTION = (2, 4)
#: Length classes with at least this many texts, most of them without terminator, are a source's limit.
LIMIT_SUPPORT = 3
LIMIT_WEIGHT = 2.0
#: A limit is proven where chance, at the source's own rate, is below about exp(-LIMIT_PROOF) for so many without terminator.
LIMIT_PROOF = 16.0
#: A source that ends at least this share of its inner sentences and lines with a terminator expects one at the end.
TERMINATED = 0.7

TERMINATORS = "。！？!?｡．"
CLOSERS = "”’」』）)】》〉]\"'"
PAIRS = {"“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》", "[": "]", "{": "}"}
_OPENER = {b: a for a, b in PAIRS.items()}
_STRUCT = re.compile(
    r"<(/?)([A-Za-z][\w:-]*)(?:\s[^<>]*?)?(/?)>|^[ \t]*(```)|[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]", re.M
)
#: Elements without end tag, and those whose end tag may be left out.
UNCLOSED_TAGS = frozenset("area base br col embed hr img input link meta source track wbr p li dt dd tr td th thead tbody tfoot option optgroup colgroup rt rp".split())
_MARK = re.compile(r"[\s\[(（【]*(?:…+|\.{2,}|⋯+)[\s\])）】]*$")
_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|(?:%[0-9A-Fa-f]{2})+%[0-9A-Fa-f]?|&#\w{0,7}|&(?:n|nb|nbs|nbsp|a|am|amp|l|lt|g|gt|q|qu|quo|quot)?)$")
_ATTRIBUTE = r"""\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'<>=]*))?"""
_OPEN_TAG = re.compile(rf"(?:/?[A-Za-z][\w:-]*(?:{_ATTRIBUTE})*\s*/?|/|!(?:-[^>]*|D\w*[^>]*|\[[^>]*)?)$")
_BOUND = re.compile(rf"(?:[{TERMINATORS}]|(?<![\d.])\.(?=[\s\"'”’)\]]|[\u2e80-\U0003ffff]|$))[{re.escape(CLOSERS)}]*|\n+")
_SIGN = re.compile(r"(?:[\s~～♪^_\-=+*#@:;]|[☀-➿]|[\U0001F300-\U0001FAFF])+$")
_TAG = re.compile(r"\s#\S+\s*$")
_CLAUSE = re.compile(r"[，,；;：:、]\s*")
_LEAD = "“‘「『（(【《\"' \t"
#: The first three words, or ideographs, of what stands at a place.
_HEAD = re.compile(rf"[{re.escape(_LEAD)}]*((?:[A-Za-z]+|[^\s{TERMINATORS}])(?:[ \t]*(?:[A-Za-z]+|[^\s{TERMINATORS}])){{0,2}})")


def _h(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << HASH_BITS) - 1)


def _words(s: str) -> list[str]:
    """Leading words in lower case, or leading ideographs one by one; opening quotes don't count."""
    return [w.lower() for w in re.findall(r"[A-Za-z]+|\S", s.lstrip("“‘「『（(【《\"' \t")[:60])]


def _opening(s: str) -> str:
    """How a sentence starts: two ideographs, or the first word."""
    w = _words(s)[:2]
    return w[0] if w and w[0].isascii() else "".join(w)


def sentence_features(s: str) -> list[int]:
    """Hashed features of a sentence without its terminator."""
    s = s.rstrip()
    clauses = [c for c in _CLAUSE.split(s) if c]
    last = clauses[-1] if clauses else s
    words = re.findall(r"[A-Za-z]+|\S", last)
    start, head = _opening(s), _opening(last)
    head3 = last.lstrip("“‘\"' ")[:3]
    n = min(len(clauses), 4)
    tail = [s[-k:] for k in (1, 2, 3, 4)]
    latin = bool(re.search(r"[A-Za-z]$", s))
    lw = words[-1].lower() if words else ""
    lw2 = " ".join(words[-2:]).lower()
    body = re.sub(r"“[^”]*”", "“”", last)
    feats = [
        "b", f"n{n}", f"s{start}", f"s{start}|n{n}", f"h{head}", f"h{head}|n{n}", f"s{start}|h{head}", f"s{start}|h{head}|n{n}",
        f"l{min(len(last), 30)}|{head}", f"w{min(len(words), 24)}|{head}|{latin}", f"q{head3}",
    ]
    feats += [f"t{k}{t}" for k, t in enumerate(tail)]
    feats += [f"h{head}|t{k}{t}" for k, t in enumerate(tail[:3])]
    feats += [f"s{start}|t{k}{t}|n{n}" for k, t in enumerate(tail[:2])]
    if latin:
        feats += [f"e{lw}", f"e{lw2}", f"h{head}|e{lw}", f"s{start}|e{lw}|n{n}", f"h{head}|e{lw2}"]
    for w in ("的", "了", "着", "过", "里", "上", "在", "把", "用", "跟", "比", "地", "得", "是", "与", "和", "只", "去"):
        k = body.rfind(w)
        if k >= 0:
            feats.append(f"d{w}{min(len(body) - k, 8)}")
            feats.append(f"h{head}|d{w}{min(len(body) - k, 8)}")
    return [_h(f) for f in feats]


def sentences(text: str) -> list[str]:
    """Sentences of a text that end in a terminator, without it."""
    out, at = [], 0
    for m in _BOUND.finditer(text):
        if not m.group(0).startswith("\n"):
            s = text[at : m.start()].strip()
            if len(s) > 1:
                out.append(s)
        at = m.end()
    return out


class Completeness:
    """Logistic regression over hashed features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, s: str) -> float:
        return float(self.weights[sentence_features(s)].sum())


def _opening_key(s: str, own_line: bool) -> str:
    """The opening that sentences have to share with this one; on a short line of its own it is one word longer."""
    w = _words(s)
    latin = bool(w) and w[0].isascii() and w[0].isalpha()
    k = (1 if latin else 2) + (own_line and len(w) <= (SHORT_LINE[0] if latin else SHORT_LINE[1]))
    if len(w) > k:
        return "|".join(w[:k])
    return "|".join(w) + ("~" if latin else "")


def _opening_parts(w: list[str]) -> set[str]:
    """Openings of one to three words of a sentence, and every beginning of their last word (marked ``~``)."""
    parts = set()
    for k in (1, 2, 3):
        parts.add("|".join(w[:k]))
        if w and w[0].isascii() and k <= min(2, len(w)):
            stem = "|".join(w[: k - 1]) + ("|" if k > 1 else "")
            parts.update(stem + w[k - 1][:n] + "~" for n in range(1, len(w[k - 1]) + 1))
    return parts


def fit(whole: list[str], seed: int = 7) -> Completeness:
    """Whole sentences against prefixes of them; three prefixes each, one of them near the end."""
    rng = np.random.default_rng(seed)
    feats, y = [], []
    for s in whole:
        feats.append(sentence_features(s))
        y.append(1.0)
        n = len(s)
        for k in {int(rng.integers(1, n)), int(rng.integers(1, n)), max(1, n - int(rng.integers(1, 5)))} if n > 2 else ():
            feats.append(sentence_features(s[:k]))
            y.append(0.0)
    w = np.zeros(1 << HASH_BITS)
    squares = np.full(1 << HASH_BITS, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(feats))
        for at in range(0, len(order), BATCH):
            rows = [feats[i] for i in order[at : at + BATCH]]
            sizes = np.array([len(r) for r in rows])
            flat = np.concatenate([np.asarray(r) for r in rows])
            z = np.add.reduceat(w[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - np.array([y[i] for i in order[at : at + BATCH]])
            used, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, np.repeat(error, sizes)) / 4.0
            squares[used] += g * g
            w[used] -= RATE * g / np.sqrt(squares[used])
    return Completeness(w.astype(np.float32))


def bounds_of(text: str) -> list[tuple[int, int, bool]]:
    """(from, to, line): ends of sentences with their closers, and line breaks."""
    return [(m.start(), m.end(), text[m.start()] == "\n") for m in _BOUND.finditer(text)]


def open_structure(text: str, last: int | None = None) -> bool:
    """Whether the stack of the whole text still holds, at its end, an element, a fence, or a quote or bracket opened at
    ``last`` (the start of the last sentence) or later."""
    if last is None:
        last = _last_start(bounds_of(text), len(text))[0]
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()

    def close(mark: str) -> None:
        while True:
            top = stack.pop()[0]
            held[top] -= 1
            if top == mark:
                return

    for m in _STRUCT.finditer(text):
        c, at = m.group(0), m.start()
        if m.group(4):
            if held["```"]:
                close("```")
            else:
                stack.append(("```", at))
                held["```"] += 1
        elif held["```"]:
            continue
        elif m.group(2):
            name = "<" + m.group(2).lower()
            if name[1:] in UNCLOSED_TAGS or m.group(3):
                continue
            if m.group(1):
                if held[name]:
                    close(name)
            else:
                stack.append((name, at))
                held[name] += 1
        elif c == '"':
            if held[c]:
                since = next(p for mark, p in reversed(stack) if mark == c)
                if "\n" not in text[since:at]:
                    close(c)
                    continue
            if at and (text[at - 1].isdigit() or (text[at - 1].isascii() and text[at - 1].isalpha())):
                continue  # inches, or a stray closing quote
            stack.append((c, at))
            held[c] += 1
        elif c in PAIRS:
            if c == "(" and at and text[at - 1] in ":;=-":
                continue  # a face
            stack.append((c, at))
            held[c] += 1
        elif held[_OPENER[c]]:
            close(_OPENER[c])
    return any(at >= last or mark[0] in "<`" for mark, at in stack)


def _last_start(bounds: list[tuple[int, int, bool]], n: int) -> tuple[int, int]:
    """(start, index): where the last sentence of the first ``n`` characters starts, and the bound before it or -1."""
    k = len(bounds) - 1
    while k >= 0 and bounds[k][1] >= n:
        k -= 1
    return (bounds[k][1] if k >= 0 else 0), k


def unfinished(t: str) -> bool:
    """Whether ``t`` ends within a multibyte sequence, an escape, an entity, a comment or a tag, however long."""
    if t[-1] == "\ufffd" or "\ud800" <= t[-1] <= "\udfff" or _ESCAPE.search(t[-40:]):
        return True
    at = t.rfind("<")
    if t.rfind("<!--") > t.rfind("-->"):
        return True
    return at >= 0 and ">" not in t[at:] and _OPEN_TAG.match(t, at + 1) is not None


def ending(text: str) -> tuple[str, str, bool]:
    """(kind, fragment, own_line): how the text ends, the sentence to judge, and whether it is a line of its own.

    Kinds: 'empty', 'broken', 'open', 'done', 'marked' (a mark of missing text), 'bare' (no terminator).
    """
    t = trimmed(text)
    return ending_of(t, bounds_of(t))


def trimmed(text: str) -> str:
    t = text.rstrip()
    while t and (t[-1] in "\u200b\u200c\u200d\u2060\ufeff\u00ad" or t[-1].isspace()):
        t = t[:-1]
    return t


def ending_of(t: str, bounds: list[tuple[int, int, bool]]) -> tuple[str, str, bool]:
    """As ``ending`` for a trimmed text and its bounds."""
    if not t:
        return "empty", "", False
    if unfinished(t):
        return "broken", "", False
    marked = _MARK.search(t, max(0, len(t) - 80))
    if marked and marked.start() > 0:
        t = t[: marked.start()].rstrip()
        if t and t[-1] in TERMINATORS + ".":
            return "done", "", False
    elif open_structure(t, _last_start(bounds, len(t))[0]):
        return "open", "", False
    else:
        stripped = _TAG.sub("", _SIGN.sub("", t)) or t
        if stripped != t and not re.search(r"\w", t[len(stripped) :].replace("_", "").split("#")[0]):
            t = stripped
    core = t.rstrip(CLOSERS)
    if not marked and core and (core[-1] in TERMINATORS or (core[-1] == "." and not core.endswith(".."))):
        return "done", "", False
    if not marked and t[-1:] in tuple("）)】]》〕}") and core != t:
        return "done", "", False
    last, k = _last_start(bounds, len(t))
    own_line = k >= 0 and (bounds[k][2] or t[last : last + 1] == "\n")
    return ("marked" if marked else "bare"), t[last:].strip(), own_line


_SURVEY = "row string, doc_id long, source string, n int, kind string, frag string, own_line boolean, ends long, lines long, k long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def survey(docs: DataFrame, sample_docs: int | None = None) -> DataFrame:
    """One read of the corpus, written once, with rows of three sorts.

    ``row`` 'd': a document, how it ends, and how many inner sentences and lines have (``ends``) or lack (``lines``) a
    terminator.  'h': a sentence opening of up to three words (``frag``) with its count ``k`` in a task.  's': a sentence
    (``frag``) of a sampled document with its hash ``k``.  Repeated sentences stay: how often a sentence occurs is part of what is learned.
    """
    wanted = SAMPLE_DOCS if sample_docs is None else sample_docs
    share = min(1.0, wanted / max(1, docs.count()))
    chance = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(11), "text")).otherwise(F.xxhash64(F.lit(11), "doc_id"))
    picked = F.shiftrightunsigned(chance, 1) <= F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))
    texts = docs.where(F.length("text") > 0).select("doc_id", "source", "text", picked.alias("picked"))
    schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in _SURVEY.split(", ")])

    def read(batches):
        heads: Counter = Counter()

        def pack(rows):
            columns = zip(*rows) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        def counts():
            return pack([("h", None, None, None, None, h, None, None, None, k) for h, k in heads.items()])

        for batch in batches:
            out = []
            for doc_id, source, text, sampled in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "text", "picked"))):
                t = trimmed(text)
                bounds = bounds_of(t)
                at, ends, lines = 0, 0, 0
                for start, stop, line in bounds:
                    if line:
                        lines += bool(t[at:start].strip())
                    else:
                        ends += 1
                        m = _HEAD.match(t, at)
                        if m:
                            heads[m.group(1)] += 1
                        if sampled:
                            s = t[at:start].strip()
                            if 1 < len(s) <= 400:
                                key = zlib.crc32(f"{ends}|{len(t)}|{s}".encode("utf-8", "surrogatepass"))
                                out.append(("s", None, None, None, None, s, None, None, None, key))
                    at = stop
                kind, frag, own_line = ending_of(t, bounds)
                out.append(("d", doc_id, source, len(text), kind, frag, own_line, ends, lines, None))
            yield pack(out)
            if len(heads) >= OPENINGS_HELD:
                yield counts()
                heads.clear()
        yield counts()

    return materialize(texts.mapInArrow(read, _SURVEY), "survey")


def sampled_sentences(rows: DataFrame, limit: int) -> list[str]:
    """About ``limit`` of the sampled sentences, chosen by hash; what reaches the driver never grows beyond that."""
    offered = rows.where("row = 's'").select("frag", "k")
    n = offered.count()
    kept = offered if n <= limit else offered.where(F.col("k") < F.lit(int((1 << 32) * limit / n)))
    return [r["frag"] for r in sorted(kept.collect(), key=lambda r: (r["k"], r["frag"]))]


def training_sentences(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, limit: int = SAMPLE_SENTENCES) -> list[str]:
    """About ``limit`` sentences of about ``sample_docs`` documents, both chosen by hash."""
    return sampled_sentences(survey(docs, sample_docs), limit)


def source_limits(ends: DataFrame) -> DataFrame:
    """(source, n, limit_share, proven): share of texts of a source and length without terminator, where it marks a limit.

    Among many lengths some have mostly texts without terminator by chance; ``proven`` are those that Chernoff's bound
    excludes at the share of such texts in the whole source.
    """
    lengths = ends.where("kind <> 'empty'").select("source", "n", (F.col("kind") == "done").alias("done"))
    per = lengths.groupBy("source", "n").agg(F.count(F.lit(1)).alias("texts"), F.sum((~F.col("done")).cast("long")).alias("bare"))
    rate = per.groupBy("source").agg((F.sum("bare") / F.sum("texts")).alias("p"))
    limit = per.where((F.col("bare") >= LIMIT_SUPPORT) & (F.col("bare") >= 0.6 * F.col("texts"))).join(rate, "source")
    share, p = F.col("bare") / F.col("texts"), F.col("p")
    rest = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - p))).otherwise(0.0)
    proven = (share > p) & (F.col("texts") * (share * F.ln(share / p) + rest) >= LIMIT_PROOF)
    return limit.select("source", "n", share.alias("limit_share"), proven.alias("proven"))


def source_baselines(ends: DataFrame) -> DataFrame:
    """(source, terminated): share of the ends of sentences and lines within a source's texts that have a terminator."""
    return ends.groupBy("source").agg((F.sum("ends") / F.greatest(F.sum("ends") + F.sum("lines"), F.lit(1))).alias("terminated"))


def known_openings(rows: DataFrame) -> DataFrame:
    """(opening, sentences): openings that at least ``OPENING_SUPPORT`` whole sentences of all documents share."""

    def parts(batches):
        for pdf in batches:
            seen: Counter = Counter()
            for h, n in zip(pdf["frag"], pdf["n"]):
                for k in _opening_parts(_words(h)[:3]):
                    seen[k] += n
            yield pd.DataFrame({"opening": list(seen), "n": list(seen.values())}).astype({"opening": "object", "n": "int64"})

    counted = rows.where("row = 'h'").groupBy("frag").agg(F.sum("k").alias("n"))
    parted = counted.mapInPandas(parts, "opening string, n long").groupBy("opening").agg(F.sum("n").alias("n"))
    return parted.where(F.col("n") >= OPENING_SUPPORT).withColumnRenamed("n", "sentences")


_JUDGED = "doc_id long, source string, n int, kind string, own_line boolean, score double, opening string, brief int"


def judged(rows: DataFrame) -> DataFrame:
    """Every document's ending with the model's score of its fragment, the fragment's opening, and ``brief``: 2 for a
    fragment short enough for an interjection, 1 for a short line, 0 for a longer one."""
    model = fit(sampled_sentences(rows, SAMPLE_SENTENCES))
    shared = rows.sparkSession.sparkContext.broadcast(model.weights.tobytes())

    def judge(batches):
        m = Completeness(np.frombuffer(shared.value, dtype=np.float32))
        for pdf in batches:
            scores, openings, briefs = [], [], []
            for kind, frag, own_line in zip(pdf["kind"], pdf["frag"], pdf["own_line"]):
                scores.append(m.score(frag) if frag else 0.0)
                openings.append(_opening_key(frag, bool(own_line)) if frag and kind == "bare" else None)
                briefs.append(_brief(frag) if frag else 0)
            yield pdf[["doc_id", "source", "n", "kind", "own_line"]].assign(score=scores, opening=openings, brief=briefs)

    ends = rows.where("row = 'd'").select("doc_id", "source", "n", "kind", "own_line", "frag")
    return ends.mapInPandas(judge, _JUDGED)


def _brief(s: str) -> int:
    w = _words(s)
    latin = bool(w) and w[0].isascii() and w[0].isalpha()
    return 2 if len(w) <= INTERJECTION[not latin] else 1 if len(w) <= SHORT_LINE[not latin] else 0


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cut): the verdict on every non-empty text."""
    return reasons(docs).select("doc_id", "source", F.col("reason").isNotNull().alias("cut"))


def reasons(docs: DataFrame) -> DataFrame:
    """(doc_id, source, reason): why a non-empty text counts as cut, null for complete ones.

    Reasons: 'broken', 'open', 'marked', 'limit' and 'terminator' (missing, by the source's baselines), and
    'prefix' (missing, and the model takes the sentence for a prefix).
    """
    rows = survey(docs)
    ends = materialize(judged(rows), "judged").where("kind <> 'empty'")
    whole = rows.where("row = 'd' and kind <> 'empty'")
    source = F.coalesce("source", F.lit("\x1f"))
    limits = source_limits(whole.withColumn("source", source)).withColumnRenamed("source", "skey")
    base = source_baselines(whole.withColumn("source", source)).withColumnRenamed("source", "skey")
    marked = ends.withColumn("skey", source).join(limits, ["skey", "n"], "left").join(base, "skey", "left")
    score = F.col("score") - F.coalesce(F.col("limit_share"), F.lit(0.0)) * LIMIT_WEIGHT
    plain = marked.where("kind <> 'bare'").select(
        "doc_id", "source",
        F.when(F.col("kind").isin("broken", "open"), F.col("kind"))
        .when((F.col("kind") == "marked") & (score < LIMIT_WEIGHT), F.lit("marked"))
        .alias("reason"),
    )
    bare = marked.where("kind = 'bare'").withColumn("score", score)
    lines = ends.where("kind = 'bare'").groupBy("opening").agg(F.count(F.lit(1)).alias("closings"))
    seen = lines.join(known_openings(rows), "opening", "left").select(
        "opening", (F.coalesce("sentences", F.lit(0)) > F.col("closings")).alias("known"), (F.col("closings") >= OPENING_SUPPORT).alias("often")
    )
    bare = bare.join(seen, "opening", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "often", "proven")})
    closing = ~F.col("known") & F.when(F.col("own_line"), F.col("brief") > 0).otherwise((F.col("brief") == 2) & F.col("often"))
    expected = F.col("terminated") >= TERMINATED
    reason = (
        F.when(F.col("known"), F.when(F.col("score") < 0, F.lit("prefix")))
        .when(F.col("proven") & ~F.col("often") & (F.col("score") < 0), F.lit("limit"))
        .when(~closing & expected, F.lit("terminator"))
    )
    return plain.unionByName(bare.select("doc_id", "source", reason.alias("reason")))


def cut_documents(docs: DataFrame) -> DataFrame:
    return verdicts(docs).where("cut").select("doc_id")


def cut_share(docs: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, cut_share)."""
    return verdicts(docs).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.col("cut").cast("long")).alias("n_cut"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"),
    )
