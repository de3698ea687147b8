"""Exact top-k inner products over a bit-sliced index (operator 9).

Components are quantised to integers, floor(``scale`` * x). The index holds, for a group of rows and each
attribute (component), one bitmap for each bit of the value above the group's least: bit i of every
row of the group. A query's score is a sum of attributes times the query's own
integers: each one bit of these adds the attribute's slices, shifted, and a negative factor takes
their complement. Slices of one weight are added by full adders on whole bitmaps (three in, a sum and a carry out), which
leaves one slice for each bit of the score. From the most significant slice downward, rows with a one are
taken while there are no more than wanted, and rows with a zero dropped otherwise; what is left in
doubt at the end are rows of equal score, of which those of the smallest ids are taken. Every row is
indexed, and the results are exact.

Queries and index are both cut into groups, and a task gets one group of each, so memory is bounded. The best of
each index group are then ranked for each query.

Cases. Vectors that are null or hold null or non-finite components take no part; vectors of different lengths are
compared as if padded with zeros. A quantised component, or the score of a
result, that a long can't hold is an error. Rows that share the id of a query aren't
its candidates; such rows are one query, with the smallest of their vectors. Otherwise repeated rows are candidates
each. Equal scores go by the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import Scratch

GROUP_ROWS = 1 << 16
GROUP_QUERIES = (64, 4096)
LIMIT = 2.0**63


# -- a group's index --------------------------------------------------------------------------


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    n = len(lists)
    counts = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + n + 1])
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(counts.max(initial=0))
    if n and counts.min() == width:
        return flat.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    out[np.repeat(np.arange(n), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def build(values: np.ndarray) -> bytes:
    """Slices of a group: for each attribute its least value and the bitmaps of what is above it."""
    n, width = values.shape
    low = values.min(axis=0) if n else np.zeros(width, np.int64)
    above = (values - low).astype(np.uint64)
    bits = [int(above[:, d].max()).bit_length() if n else 0 for d in range(width)]
    words = -(-n // 64)
    slices = np.zeros((sum(bits), words * 8), np.uint8)
    at = 0
    for d in range(width):
        for i in range(bits[d]):
            packed = np.packbits((above[:, d] >> np.uint64(i) & np.uint64(1)).astype(bool), bitorder="little")
            slices[at, : len(packed)] = packed
            at += 1
    head = json.dumps({"n": n, "low": low.tolist(), "bits": bits}).encode()
    return struct.pack("<I", len(head)) + head + slices.tobytes()


class Slices:
    """Reads ``build``'s bytes and answers queries over the group."""

    def __init__(self, payload: bytes, ids: np.ndarray):
        (k,) = struct.unpack_from("<I", payload)
        head = json.loads(payload[4 : 4 + k])
        self.n, self.low, self.bits, self.ids = head["n"], head["low"], head["bits"], ids
        words = -(-self.n // 64)
        self.slices = np.frombuffer(payload, np.uint64, offset=4 + k).reshape(-1, words) if words and (4 + k) % 8 == 0 else np.frombuffer(payload[4 + k :], np.uint64).reshape(-1, max(words, 1))
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).astype(int)
        self.full = np.full(words, np.iinfo(np.uint64).max, np.uint64)
        if self.n % 64:
            self.full[-1] = np.uint64((1 << self.n % 64) - 1)
        self.inverse = ~self.slices & self.full

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, from the least significant, and what has to be added to them."""
        columns: dict[int, list[np.ndarray]] = {}
        plus = 0
        for d in range(min(len(query), len(self.bits))):
            q, b = int(query[d]), self.bits[d]
            plus += q * self.low[d]
            if q < 0:
                plus += q * ((1 << b) - 1)
            source, q = (self.slices, q) if q > 0 else (self.inverse, -q)
            for j in range(q.bit_length()):
                if q >> j & 1:
                    for i in range(b):
                        columns.setdefault(i + j, []).append(source[self.first[d] + i])
        out: list[np.ndarray] = []
        place = 0
        while columns:
            held = columns.pop(place, [])
            up = columns.setdefault(place + 1, []) if len(held) > 1 else None
            while len(held) > 2:
                a, b, c = held.pop(), held.pop(), held.pop()
                x = a ^ b
                y = a & b
                up.append(y | (x & c))
                held.insert(0, x ^ c)
            if len(held) == 2:
                a, b = held
                up.append(a & b)
                held = [a ^ b]
            out.append(held[0] if held else np.zeros_like(self.full))
            place += 1
        return out, plus

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows other than the query's own; the group's ids ascend."""
        slices, plus = self.sums(query)
        taken, doubt = np.zeros_like(self.full), self.full.copy()
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        for own in range(lo, hi):
            doubt[own // 64] &= ~np.uint64(1 << own % 64)
        have = 0
        for s in reversed(slices):
            ones = doubt & s
            n = int(np.bitwise_count(ones).sum())
            if have + n > k:
                doubt = ones
            else:
                taken |= ones
                doubt &= ~s
                have += n
                if have == k:
                    break
        rows = self._rows(taken)
        if have < k:
            rows = np.concatenate([rows, self._rows(doubt, k - have)])
        scores = [plus + sum(int(s[r // 64] >> np.uint64(r % 64) & np.uint64(1)) << i for i, s in enumerate(slices)) for r in rows.tolist()]
        return [(int(self.ids[r]), v) for r, v in zip(rows.tolist(), scores)]

    @staticmethod
    def _rows(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        if most is not None:
            words = words[:most]
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64) if len(words) else np.zeros((0, 64), np.uint8)
        w, b = np.nonzero(bits)
        return (words[w] * 64 + b)[:most]


# -- the search -------------------------------------------------------------------------------


def quantise(vector: Column, scale: float) -> Column:
    def whole(x: Column) -> Column:
        y = scale * x.cast("double")
        error = F.raise_error(F.concat(F.lit("quantised component beyond a long: "), y.cast("string"))).cast("long")
        return F.when((y < -LIMIT) | (y >= LIMIT), error).otherwise(F.floor(y))

    return F.transform(vector, whole)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, group_rows: int = GROUP_ROWS, group_queries: tuple[int, int] = GROUP_QUERIES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k best other rows: query_id, rank, vec_id, score. ``is_query`` is a condition over ``vec_id``'s column."""
    scratch = Scratch(vectors.sparkSession, "bitsliced")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), quantise(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Of rows that are repeated whole no more than k can be among a query's best. Rows of one id are dealt to groups by their vectors.
    queries = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("q"))
    rows = scratch.table(rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m")).select("vec_id", F.explode(F.array_repeat("v", F.col("m"))).alias("v")), "rows")
    queries = scratch.table(queries, "queries")
    n, asks = rows.count(), queries.count()
    groups = max(1, -(-n // group_rows))
    least, most = group_queries
    blocks = max(1, -(-asks // min(most, max(least, -(-asks // 12)))))

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        values = _matrix(table["v"].combine_chunks() if table["v"].num_chunks != 1 else table["v"].chunk(0))
        return pa.table({"ig": pa.array([table["ig"][0].as_py()], pa.int32()), "ids": pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())), "payload": pa.array([build(values)], pa.binary())})

    grouped = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("ig"))
    indexed = scratch.table(grouped.groupBy("ig").applyInArrow(index, "ig int, ids array<long>, payload binary"), "index", codec="none")
    queries = queries.select("vec_id", "q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("jq"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            group = Slices(left["payload"][0].as_py(), np.array(left["ids"][0].as_py(), np.int64))
            for q, v in zip(right["vec_id"].to_pylist(), right["q"].to_pylist()):
                out += [(q, i, s) for i, s in group.top(q, np.array(v, np.int64), k)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    # Every query meets every index group: a task for each pair of a group and a block of queries.
    a = indexed.withColumn("jq", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = queries.withColumn("ig", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = a.groupBy("ig", "jq").cogroup(b.groupBy("ig", "jq")).applyInArrow(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
