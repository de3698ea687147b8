"""Benchmark decontamination by a prefix-filtered set join (operator 8).

An item's windows are its runs of ``window`` words, or all its words where they
are fewer. A window is a set of shingles (runs of ``shingle`` words with their
places in it). A document holds a window only if it holds all of the shingles, so one
of them is a sufficient prefix: the rarest, by the number of windows that have it. Steps:

1. The prefix shingle of each window, with its place in the window, is the table that is joined; shingles that aren't
   any window's prefix never are.
2. Each place of a document's words is looked up there. The shingle's place in the window gives the place where the window
   would begin; it has to begin and end within the document (position and length bounds).
3. The item-sized run of words from there is compared with the window, in the row itself. So a document is read once
   and no text or candidate is shuffled, whatever the windows that many documents share.

The table of prefixes is made of items alone and is broadcast. If it has more than ``broadcast_bytes``, it is cut into blocks of that size by
shingle, and the documents are read once for each. All steps are DataFrame operations.

Cases. A null text or one without words has no words; such an item isn't an item that can be found.
Rows that share a doc_id are judged each by its own text. Items that share text are all reported. Items that
share an id are one item with the windows of all its rows. Empty tables give empty or clean results. A null item_id
counts as an item but isn't listed. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import match
from .native_words import count_words, words
from .store import Scratch

BROADCAST_BYTES = 64 << 20
#: Items of windows are broadcast if they are as many at most (two numbers each).
BROADCAST_ROWS = 1_000_000


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(key, len, item_id): each item's different windows, their words joined by a space."""
    n = F.size("words")
    k = F.least(n, F.lit(window))
    at = F.explode(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))
    return items.filter(n > 0).select("item_id", k.alias("len"), at.alias("key")).distinct()


def _token(said: list[Column]) -> Column:
    return F.xxhash64(*said)


def _prefixes(windows: DataFrame, shingle: int) -> DataFrame:
    """(token, k, offset, key, len): each window's rarest shingle, of ``shingle`` words or all that it has, and its place."""
    w, k = F.split("key", " "), F.least("len", F.lit(shingle))
    found = None
    for size in range(1, shingle + 1):
        places = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size))).alias("offset", "s")  # noqa: B023
        some = windows.filter(k == size).select("key", "len", places).select("key", "len", F.lit(size).alias("k"), "offset", _token([F.col("s")[i] for i in range(size)]).alias("token"))
        found = some if found is None else found.unionByName(some)
    counts = found.groupBy("token").agg(F.count("*").alias("n"))
    rarest = found.join(counts, "token").groupBy("key", "len", "k").agg(F.min(F.struct("n", "token", "offset")).alias("p"))
    return rarest.select("p.token", "k", "p.offset", "key", "len")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, broadcast_bytes: int = BROADCAST_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The places of windows in documents (doc_id, text_hash, start, len, key), and the items' windows (key, len, item_id)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words"))
    windows = scratch.table(_windows(items, window), "windows")
    prefixes = scratch.table(_prefixes(windows.select("key", "len").distinct(), shingle), "prefixes")
    size = prefixes.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    blocks = -(-size // broadcast_bytes)
    sizes = sorted((r["k"] for r in prefixes.select("k").distinct().collect()), reverse=True)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("words"))
    # An outer explode: from the other Spark would infer a filter that cuts the words a second time.
    rows = rows.select("*", F.posexplode_outer("words").alias("pos", "w0"))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.size("words"))
    same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ") == F.col("key")
    found = prefixes.select(F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), "len", "key").filter("false")
    for k in sizes:
        said = [F.col("w0"), *[F.get("words", F.col("pos") + i) for i in range(1, k)]]
        for block in range(blocks):
            mine = prefixes.filter((F.col("k") == k) & (F.pmod(F.xxhash64("token"), F.lit(blocks)) == block))
            seen = rows.withColumn("_token", _token(said)).join(F.broadcast(mine), (F.col("_token") == F.col("token")) & inside & same)
            found = found.unionByName(seen.select("doc_id", "text_hash", start.alias("start"), "len", "key"))
    return scratch.table(found, "places"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and text_hash)."""
    places, windows = hits(docs, benchmark, window, doc_id=doc_id, text=text, **options)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
    )["n"]
    spans = places.groupBy("doc_id", "text_hash").agg(covered.cast("long").alias("n_hit"))
    few = F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows
    items = places.select("doc_id", "text_hash", "key", "len").distinct().join(few, ["key", "len"])
    # A null id counts as an item but isn't listed.
    items = items.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    by_doc = match(spans, items.select("doc_id", "text_hash", (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items")), ["doc_id", "text_hash"])
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), count_words(F.col(text)).alias("n_words"))
    return match(each, by_doc, ["doc_id", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
