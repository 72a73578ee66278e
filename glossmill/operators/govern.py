"""Release governance: redaction, verbatim-leak scans, forbidden tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEEDLE_CHARS = 4_000_000


def redact(df: DataFrame, keep: list[str], hashed: list[str] = (), lengths: list[str] = (), withheld: dict[str, str] | None = None) -> DataFrame:
    """Ids and labels kept, texts replaced by a SHA-256 or by their length, columns overridden by a literal."""
    cols = [F.col(c) for c in keep]
    cols += [F.sha2(F.coalesce(F.col(c), F.lit("")), 256).alias(f"{c}_sha256") for c in hashed]
    cols += [F.length(F.coalesce(F.col(c), F.lit(""))).alias(f"{c}_chars") for c in lengths]
    cols += [F.lit(v).alias(c) for c, v in (withheld or {}).items()]
    return df.select(*cols)


def verbatim_leaks(texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle_id: str, needle: str, min_chars: int = 12) -> DataFrame:
    """(text_id, needle_id): the first needle, by id, that stands verbatim in each text.

    All needles are looked up in one pass per text by an automaton, in blocks of bounded size; texts are not shuffled.
    Needles shorter than ``min_chars`` are exempt.
    """
    import pandas as pd

    usable = needles.where(F.length(needle) >= min_chars).select(F.col(needle_id).cast("long").alias("nid"), F.col(needle).alias("n"))
    size = usable.agg(F.coalesce(F.sum(F.length("n")), F.lit(0)).alias("s")).first()["s"]
    blocks = max(1, -(-int(size) // NEEDLE_CHARS))
    spark = texts.sparkSession
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text_id).cast("long").alias("tid"), F.col(text).alias("t"))
    found = None
    for b in range(blocks):
        part = usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("nid"), F.lit(blocks)) == b)
        words = sorted((r["nid"], r["n"]) for r in part.collect())
        if not words:
            continue
        shared = spark.sparkContext.broadcast(words)

        def scan(batches, shared=shared):
            import ahocorasick

            auto = ahocorasick.Automaton()
            for nid, w in reversed(shared.value):  # of equal needles the smallest id stays
                auto.add_word(w, nid)
            auto.make_automaton()
            for pdf in batches:
                best = [min((nid for _, nid in auto.iter(t)), default=-1) for t in pdf["t"]]
                out = pd.DataFrame({"tid": pdf["tid"], "nid": best})
                yield out[out["nid"] >= 0]

        hit = rows.mapInPandas(scan, "tid long, nid long")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return spark.createDataFrame([], f"`{text_id}` long, `{needle_id}` long")
    return found.groupBy(F.col("tid").alias(text_id)).agg(F.min("nid").alias(needle_id))


def forbidden_tokens(df: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """(finding, n_rows): rows whose serialised columns match a forbidden pattern."""
    whole = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    counts = df.agg(*[F.count_if(whole.rlike(p)).alias(k) for k, p in patterns.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("n_rows")) for k in patterns])).alias("r")
    return counts.select(rows).select("r.finding", "r.n_rows")


def scrub_paths(column: str):
    """Local paths in a text or JSON cell replaced by a placeholder."""
    return F.regexp_replace(F.col(column), r"(?:/(?:home|Users|root)/[^\s\"',;]+|[A-Z]:\\\\[^\s\"',;]+)", "<path>")
