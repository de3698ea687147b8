"""Quality by importance resampling (operator 5).

Two generative models of hashed n-grams (words, runs of punctuation, and pairs of these, in ``buckets`` buckets, with
add-one smoothing) are estimated, one on target texts and one on all raw texts. A text's weight is the
logarithm of the ratio of its probabilities under both, and a text is sampled without replacement with
probability proportional to the ratio: a Gumbel number is added to each log weight, and those with the highest sums are
taken (Gumbel top-k). The number comes from a hash of the id and a seed, so that reruns agree.

All counts cover every whole text, those of the target model every target text. Each task sends one table of ``buckets`` counts, so what is gathered doesn't
depend on texts. The k-th highest sum is found exactly, by counts of rows for 16 bits of the sum at a time; no
rows are gathered for it. Of equal sums, smaller ids are taken, and of the same id texts of smaller hashes.

Cases. A null, empty or wordless text has log weight 0. Without target texts all log weights are 0, and the sample is
uniform. Repeated rows are candidates each, but share a Gumbel number; where the sample ends within them, as many are taken as it has room for.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import Scratch
from .textkit import WORDPUNCT, freed, runs, sequence_hashes, window_starts

BUCKETS = 10_000
#: Ids of target texts are broadcast if they are as many at most (one number each), and joined by a shuffle beyond that.
BROADCAST_IDS = 1_000_000


def target_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """All documents labelled 1."""
    good = labels.filter((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id)).distinct()
    return docs.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, doc_id, "left_semi")


def _buckets(run, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word or run of punctuation, and of every pair of them."""
    words = run.hashes()
    at, row = window_starts(run.first, 2)
    h = np.concatenate([words, sequence_hashes(words, at, 2)])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([run.row, row])


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of the buckets over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for run in runs(batch.column(0), WORDPUNCT, True):
                total += np.bincount(_buckets(run, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(total)], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(freed(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """The logarithm of target over raw probability of each bucket."""
    counts = [_counts(df.select(F.col(text).cast("string").alias("text")), buckets) for df in (target, raw)]
    if not counts[0].any():
        return np.zeros(buckets)
    p, q = ((c + 1.0) / (c.sum() + buckets) for c in counts)
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, log_weight, n_grams) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            for run in runs(batch.column(2), WORDPUNCT, True):
                bucket, row = _buckets(run, len(r))
                k = run.hi - run.lo
                w = np.bincount(row, weights=r[bucket], minlength=k)
                keys = [batch.column(i).slice(run.lo, k) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(w, pa.float64()), pa.array(np.bincount(row, minlength=k).astype(np.int64))], ["doc_id", "text_hash", "log_weight", "n_grams"])

    texts = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(texts).alias("text_hash"), texts.alias("text"))
    return rows.mapInArrow(freed(weights), "doc_id long, text_hash long, log_weight double, n_grams long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel number for an id."""
    unit = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def top_share(rows: DataFrame, key: str, k: int, scratch: Scratch, tie: tuple[str, ...] = ("doc_id", "text_hash")) -> DataFrame:
    """``rows`` with ``kept``: whether a row is among the k with the highest ``key``, or among equal ones has the smallest ``tie``.

    Counts narrow the k-th key down, 16 bits at a time. Rows that are equal in ``tie`` too differ in nothing; as many of them are kept as there is room for.
    """
    # Doubles as integers of the same order: 9 decimal places are what is compared.
    ordered = F.round(F.col(key) * 1e9).cast("long") + F.lit(1 << 62)
    rows = scratch.table(rows.withColumn("__o", ordered), "keyed")
    prefix, left = 0, k
    if k <= 0:
        return rows.withColumn("kept", F.lit(False)).drop("__o")
    for shift in (48, 32, 16, 0):
        part = F.shiftright("__o", shift)
        inside = rows if shift == 48 else rows.filter(F.shiftright("__o", shift + 16) == prefix)
        counts = sorted(((r["p"], r["n"]) for r in inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        if shift == 48 and sum(n for _, n in counts) <= k:
            return rows.withColumn("kept", F.lit(True)).drop("__o")
        for p, n in counts:
            prefix = p
            if n >= left:
                break
            left -= n
    # Equal keys are those of few ids, as each id has a number of its own in it: counts by tie tell where the sample ends.
    at = F.col("__o") == prefix
    order = [F.col(c).asc_nulls_last() for c in tie]
    edge = rows.filter(at).groupBy(*tie).agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    edge = scratch.table(edge.withColumn("room", F.least("m", F.greatest(F.lit(left) - (F.col("upto") - F.col("m")), F.lit(0)))).drop("upto"), "edge")
    clear = rows.filter(~at).withColumn("kept", F.col("__o") > prefix)
    whole = edge.filter("room > 0 AND room = m").select(*[F.col(c).alias(f"__{c}") for c in tie], F.lit(True).alias("__in"))
    split = edge.filter("room > 0 AND room < m").first()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in tie])
    even = rows.filter(at).join(whole, on, "left").withColumn("kept", F.coalesce("__in", F.lit(False)))
    if split is not None:  # one tie at most
        mine = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(split[c])) for c in tie])
        row, types = even.filter(mine).first(), dict(clear.dtypes)
        same = rows.sparkSession.range(split["m"]).select(*[F.lit(row[c]).cast(types[c]).alias(c) for c in rows.columns], (F.col("id") < split["room"]).alias("kept"))
        even = even.filter(~mine).select(clear.columns).unionByName(same)
    return clear.unionByName(even.select(clear.columns)).drop("__o")


def resample(docs: DataFrame, target: DataFrame, share: float = 0.85, seed: int = 0, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its log weight and whether it is in the sample of ``share`` of all: doc_id, text_hash, log_weight, n_grams, gumbel_key, kept."""
    scratch = Scratch(docs.sparkSession, "importance")
    weighed = weigh(docs, log_ratios(docs, target, buckets, text), doc_id, text)
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    n = docs.count()
    return top_share(keyed, "gumbel_key", math.ceil(share * n), scratch) if n else keyed.withColumn("kept", F.lit(False))
