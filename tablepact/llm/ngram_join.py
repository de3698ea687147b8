"""N-gram Jaccard join: a size-aware heavy-light join (operator 2).

A document's set is its distinct shingles of ``size`` words (of all its words, where
they are fewer), as 64-bit hashes. Documents with the same set are one class, and only classes are joined.

A set of n shingles links only with sets that share at least t = ceil(threshold * n) of them. With all sets
in one order, two sets that link share c shingles among the first n - t + c of each. The order is by rarity: counts of
shingles are held in a table of 2^``CELLS_LOG2`` cells whose size doesn't depend on the corpus.

* Light sets, smaller than a boundary, list every subset of c = 2 among their first n - t + 2
  shingles; two light sets that link have such a subset in common.
* Heavy sets scan the inverted lists of their first n - t + 1 shingles, in which light sets that are
  large enough to link with a heavy one are as well.

The boundary is chosen by cost, from all sets of at most ``LIGHT_MOST`` shingles: the subsets that the sets of a size would list,
against the entries of the lists that they would scan instead. Sets above that are heavy.

A list is in the order of its members' own places of the shingle in their prefixes: what comes before it is shared with no other, so a member's place
bounds how much it can have in common with any (position filter), and the first member is the most central one.
Members aren't paired with each other. Each is compared with the first, so a list costs its length; members that linked are in one
component then, and pairs within one add nothing. Then all pairs in a list that lie in different components, fit by
size and pass the position filter are compared, so no link that joins components is lost. Comparisons are
exact, on whole sets; these are made anew from the texts of the documents concerned, which are picked by a broadcast of their keys
if they are ``BROADCAST_KEYS`` at most, and by a shuffled join otherwise.

A list that may be longer than ``LONG_LIST`` (by the table of counts) is dealt into parts by class, each with a
first member of its own; a class that many documents of a task share is listed once for them.

Cases. A null, empty or wordless text has no shingles, links with nothing, and is its own component and class. A text of fewer words than a
shingle has one. Documents with the same doc_id are documents of their own that share a name; the smallest doc_id of a component
may be theirs. A null doc_id never names a component that has another. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .joins import match
from .store import Scratch
from .textkit import SPACED, freed, mix, ragged, runs, sequence_hashes, window_starts

CELLS_LOG2 = 22
BLOCK_LOG2 = 15
#: Parts in which a block's counts are added up first.
SUM_PARTS = 16
LIGHT_MOST = 64
LONG_LIST = 1 << 20
BROADCAST_KEYS = 500_000
_U = np.uint64


# -- sets -------------------------------------------------------------------------------------


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of rows: lo, hi, the distinct shingles sorted by row, their rows, and each row's number of them."""
    for run in runs(column, SPACED, True):
        words = run.hashes()
        at, row = window_starts(run.first, size)
        h = sequence_hashes(words, at, size)
        n = np.diff(run.first)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            h = np.concatenate([h, sequence_hashes(words, run.first[:-1][short], n[short])])
            row = np.concatenate([row, short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
        yield run.lo, run.hi, h, row, np.bincount(row, minlength=run.hi - run.lo)


def _class_ids(h: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; the order of its members doesn't matter. 0 for the empty set."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D)), out=s[1:])
    x = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + _U(0x14057B7EF767814F)), out=x[1:])
    one, two = s[ends[1:]] - s[ends[:-1]], x[ends[1:]] - x[ends[:-1]]
    return np.where(counts > 0, mix(one ^ mix(two + counts.astype(np.uint64))) | _U(1), _U(0))


def _fresh(cid: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows hold a class that this task hasn't seen before."""
    out = np.zeros(len(cid), bool)
    _, first = np.unique(cid, return_index=True)
    for i in first.tolist():
        c = int(cid[i])
        if c not in seen:
            seen.add(c)
            out[i] = True
    return out


def _required(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n has to share with any that it links with."""
    return -(-n * percent // 100)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CELLS_LOG2)).astype(np.int64)


def _survey(docs: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, cid, n, tokens of a small set) of every row, and the table of shingle counts, as classes of about 9 % each."""
    import zstandard

    names = ["doc_id", "text_hash", "cid", "n", "tokens", "block", "counts"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS_LOG2, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, h, row, n in _sets(batch.column(2), size):
                cid, k = _class_ids(h, row, n).view(np.int64), hi - lo
                fresh = _fresh(cid, seen)
                np.add.at(cells, _cells(h[fresh[row]]), np.uint32(1))
                small = fresh & (n > 1) & (n <= LIGHT_MOST)
                tokens = ragged(h[small[row]].view(np.int64), np.where(small, n, 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k), batch.column(1).slice(lo, k), pa.array(cid), pa.array(n, pa.int64()), tokens, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        used = [b for b in range(1 << (CELLS_LOG2 - BLOCK_LOG2)) if cells[b << BLOCK_LOG2 : (b + 1) << BLOCK_LOG2].any()]
        packed = [zstandard.compress(cells[b << BLOCK_LOG2 : (b + 1) << BLOCK_LOG2].astype(np.int64).tobytes(), 1) for b in used]
        k = len(used)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.nulls(k, pa.list_(pa.int64())), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)

    fields = "doc_id long, text_hash long, cid long, n long, tokens array<long>, block int, counts binary"
    rows = scratch.table(docs.mapInArrow(freed(found), fields), "survey")

    def summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[b] = sums.get(b, 0) + np.frombuffer(zstandard.decompress(c.as_py()), np.int64)
        return sums

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(batches)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], ["block", "counts"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(batches)
        out = [np.minimum(8 * np.log2(1.0 + s), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["block", "classes"])

    blocks = rows.filter("block IS NOT NULL").select("block", "counts")
    once = blocks.repartition(F.col("block"), F.pmod(F.xxhash64("counts"), F.lit(SUM_PARTS))).mapInArrow(added, "block int, counts binary")
    rarity = np.zeros(1 << CELLS_LOG2, np.uint8)  # 4 MB, whatever the corpus
    for r in once.repartition("block").mapInArrow(banded, "block int, classes binary").collect():
        rarity[r["block"] << BLOCK_LOG2 : (r["block"] + 1) << BLOCK_LOG2] = np.frombuffer(r["classes"], np.uint8)
    return rows.filter("block IS NULL").drop("block", "counts"), rarity


# -- lists ------------------------------------------------------------------------------------


def choose_boundary(sizes: list[tuple[int, float, float]]) -> int:
    """The size below which sets are light, from (size, cost of subsets, cost of scans) of all sets by size."""
    sizes = sorted(sizes)
    best, at = math.inf, 0
    subsets, scans = 0.0, sum(s for _, _, s in sizes)
    for i in range(len(sizes) + 1):
        if subsets + scans < best:
            best, at = subsets + scans, sizes[i][0] if i < len(sizes) else sizes[-1][0] + 1 if sizes else 0
        if i < len(sizes):
            subsets += sizes[i][1]
            scans -= sizes[i][2]
    return at


def _costs(classes: DataFrame, percent: int, rarity: np.ndarray) -> list[tuple[int, float, float]]:
    """For each size up to ``LIGHT_MOST``: its sets' subsets, and the entries of the lists that they would scan."""
    shared = classes.sparkSession.sparkContext.broadcast(rarity)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            h = batch.column(1).flatten().to_numpy().view(np.uint64)
            order = np.lexsort((h, shared.value[_cells(h)], row))
            first = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n - _required(n, percent) + 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(n[row][first]), pa.array(h[order][first].view(np.int64))], ["n", "key"])

    small = classes.filter(F.size("tokens") > 0).groupBy("cid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")).select("n", "tokens")
    lists = small.mapInArrow(prefixes, "n long, key long").groupBy("key", "n").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("length"), F.collect_list(F.struct("n", "m")).alias("by"))
    scans = {r["n"]: float(r["s"]) for r in lists.select("length", F.inline("by")).groupBy("n").agg(F.sum(F.col("m") * F.col("length")).alias("s")).collect()}
    out = []
    for r in small.groupBy("n").agg(F.count("*").alias("m")).collect():
        n = r["n"]
        p = min(n - int(_required(np.array(n), percent)) + 2, n)
        out.append((n, r["m"] * p * (p - 1) / 2, scans[n]))
    return out


def _postings(docs: DataFrame, size: int, percent: int, rarity: np.ndarray, boundary: int) -> DataFrame:
    """(key, part, pos, cid, n): subsets of two of light sets, shingles of heavy sets and of the light ones that may link with one."""
    least = int(_required(np.array([max(boundary, 1)]), percent)[0])
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, h, row, n in _sets(batch.column(0), size):
                cid = _class_ids(h, row, n).view(np.int64)
                use = _fresh(cid, seen) & (n > 1)  # a set of one links with its like only
                mine = use[row]
                h, row = h[mine], row[mine]
                band = table[_cells(h)]
                order = np.lexsort((h, band, row))
                h, band = h[order], band[order]
                m = np.where(use, n, 0)
                place = np.arange(len(h)) - np.repeat(np.cumsum(m) - m, m)
                at = np.flatnonzero((place < (n - _required(n, percent) + 1)[row]) & (n[row] >= least))
                found = [(h[at], band[at], place[at], row[at])]
                ends = np.cumsum(m)
                for i in np.flatnonzero(use & (n < boundary)).tolist():
                    lo = int(ends[i] - m[i])
                    x, y = np.triu_indices(min(int(n[i] - _required(n[i], percent)) + 2, int(n[i])), 1)
                    one, two = h[lo + x], h[lo + y]
                    found.append((mix(mix(np.minimum(one, two)) + np.maximum(one, two)), band[lo + x], y - 1, np.full(len(x), i)))
                key, band, pos, row = (np.concatenate(c) for c in zip(*found))
                parts = np.ceil(np.exp2(band / 8.0) / LONG_LIST).astype(np.int64)
                part = np.where(parts > 1, (mix(cid[row].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), -1)
                columns = [pa.array(key.view(np.int64)), pa.array(part, pa.int32()), pa.array(pos, pa.int32()), pa.array(cid[row]), pa.array(n[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", "pos", "cid", "n"])

    return docs.select("text").mapInArrow(freed(listed), "key long, part int, pos int, cid long, n int")


def read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, pos, cid, n) in that order, each once, as (key, cid, n, pos, first, first_n, first_pos) for lists with two rows or more.

    A list may go on in later batches; none is held. Parts of a long list (``part`` from 0) are given out even if they have one row.
    """
    names = ["key", "cid", "n", "pos", "first", "first_n", "first_pos"]
    last: list[int] | None = None  # key, part, its last cid; first cid, n and pos; whether the first has been given out
    for batch in batches:
        key, part, pos, cid, n = (batch.column(i).to_numpy() for i in range(5))
        if not len(key):
            continue
        before = last if last is not None else [0, -2, 0]
        new = (key != np.append(before[0], key[:-1])) | (part != np.append(before[1], part[:-1]))
        once = new | (cid != np.append(before[2], cid[:-1]))
        key, part, pos, cid, n, new = (x[once] for x in (key, part, pos, cid, n, new))
        if not len(key):
            continue
        starts = np.flatnonzero(new)
        upto = int(starts[0]) if len(starts) else len(key)
        first, first_n, first_pos, many = np.empty(len(key), np.int64), np.empty(len(key), np.int32), np.empty(len(key), np.int32), np.ones(len(key), bool)
        ahead = None
        if upto:  # these go on with the last batch's list
            first[:upto], first_n[:upto], first_pos[:upto] = last[3:6]
            if not last[6]:
                ahead = [last[0], *last[3:6], *last[3:6]]
            last = [last[0], last[1], int(cid[upto - 1]), *last[3:6], True]
        if len(starts):
            sizes = np.diff(np.append(starts, len(key)))
            for out, of in ((first, cid), (first_n, n), (first_pos, pos)):
                out[upto:] = np.repeat(of[starts], sizes)
            many[upto:] = np.repeat((sizes > 1) | (part[starts] >= 0), sizes)
            s = starts[-1]
            last = [int(key[s]), int(part[s]), int(cid[-1]), int(cid[s]), int(n[s]), int(pos[s]), bool(many[s])]
        rows = [x[many] for x in (key, cid, n, pos, first, first_n, first_pos)]
        if ahead:
            rows = [np.concatenate([np.array([a], r.dtype), r]) for a, r in zip(ahead, rows)]
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names)


def _lists(postings: DataFrame) -> DataFrame:
    """Lists of two members or more, read in order without holding one."""
    ordered = postings.repartition("key", "part").sortWithinPartitions("key", "part", "pos", "cid")
    return ordered.mapInArrow(freed(read_lists), "key long, cid long, n int, pos int, first long, first_n int, first_pos int")


def _may_link(a: tuple[str, str], b: tuple[str, str], percent: int) -> Column:
    """By two sets' sizes and places of a shared shingle, before which they share none (columns n and pos of each)."""
    (xn, xp), (yn, yp) = ((F.col(n).cast("long"), F.col(p).cast("long")) for n, p in (a, b))
    return (F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent) & (F.least(xn - xp, yn - yp) * (100 + percent) >= (xn + yn) * percent)


# -- comparison -------------------------------------------------------------------------------


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose sets link, by exact comparison."""
    asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    # A document of each class will do.
    one = classes.join(asked, "cid").groupBy("cid").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"))
    wanted = scratch.table(one.select("cid", "d.*"), "wanted")
    sets = scratch.table(_whole_sets(docs, wanted, size), "sets")
    if sets.count() > wanted.count():  # rows that are repeated whole
        sets, repeated = scratch.table(sets.dropDuplicates(["cid"]), "sets"), sets
        scratch.drop(repeated)
    both = pairs.join(sets.withColumnsRenamed({"cid": "a", "tokens": "x"}), "a").join(sets.withColumnsRenamed({"cid": "b", "tokens": "y"}), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    found = scratch.table(both.filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b"), "links")
    scratch.drop(sets)
    return found


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, tokens) of the wanted classes (cid, doc_id, text_hash), from the whole texts of the documents of one key each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, h, _, n in _sets(batch.column(1), size):
                cid = batch.column(0).slice(lo, hi - lo)
                once = pa.array(_fresh(cid.to_numpy(), seen))
                yield pa.RecordBatch.from_arrays([cid, ragged(h.view(np.int64), n, pa.int64())], ["cid", "tokens"]).filter(once)

    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = match(docs, keys, ["doc_id", "text_hash"]).select("cid", "text")
    return texts.mapInArrow(freed(found), "cid long, tokens array<long>")


def join(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, class_id (the smallest doc_id with an equal set), text_hash (xxhash64) and group_id
    (a name of the component that no other shares, whatever the ids; null without shingles)."""
    scratch = Scratch(docs.sparkSession, "ngramjoin")
    texts = F.col(text).cast("string")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(texts).alias("text_hash"), texts.alias("text"))
    classes, rarity = _survey(docs, size, scratch)
    boundary = choose_boundary(_costs(classes, percent, rarity))
    lists = scratch.table(_lists(_postings(docs, size, percent, rarity, boundary)), "lists")
    classes = classes.drop("tokens")

    firsts = lists.filter((F.col("cid") != F.col("first")) & _may_link(("n", "pos"), ("first_n", "first_pos"), percent))
    pairs = scratch.table(firsts.select(F.least("cid", "first").alias("a"), F.greatest("cid", "first").alias("b")).distinct(), "pairs")
    links = _linked(pairs, docs, classes, size, percent, scratch)
    groups = components(links, scratch)

    # Lists with members of different components: all their members against those that aren't in the first one's.
    mine = lists.join(groups.select(F.col("node").alias("cid"), F.col("component").alias("g")), "cid", "left").select("key", "cid", "n", "pos", F.coalesce("g", "cid").alias("g"))
    mixed = mine.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.min(F.struct("pos", "cid", "g")).alias("first")).filter("low <> high").select("key", F.col("first.g").alias("fg"))
    left = scratch.table(mine.join(mixed, "key"), "mixed")
    x = left.filter("g <> fg").select("key", *[F.col(c).alias(f"x{c}") for c in ("cid", "n", "pos", "g")])
    y = left.select("key", *[F.col(c).alias(f"y{c}") for c in ("cid", "n", "pos", "g")])
    crossing = x.join(y, "key").filter((F.col("xg") != F.col("yg")) & _may_link(("xn", "xpos"), ("yn", "ypos"), percent))
    crossing = crossing.select(F.least("xcid", "ycid").alias("a"), F.greatest("xcid", "ycid").alias("b"), F.least("xg", "yg").alias("ga"), F.greatest("xg", "yg").alias("gb")).distinct()
    rest = scratch.table(match(crossing, pairs, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = _linked(rest, docs, classes, size, percent, scratch)
        joined = components(more.join(rest, ["a", "b"]).select("ga", "gb"), scratch, "ga", "gb")
        # Components that turned out to be one take its name, and so do classes that were in none.
        alone = joined.join(groups, joined["node"] == groups["component"], "left_anti").select("node", "component")
        named = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        groups = scratch.table(named.unionByName(alone), "groups")
    scratch.drop(lists, left)

    some = classes.filter("n > 0")
    ids = some.groupBy("cid").agg(F.min("doc_id").alias("class_id"))
    ids = scratch.table(ids.join(groups.withColumnRenamed("node", "cid"), "cid", "left"), "ids")
    names = ids.filter("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = scratch.table(ids.join(names, "component", "left"), "named")
    out = some.join(named, "cid")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "class_id").alias("component_id"), "class_id", "text_hash", F.coalesce("component", "cid").alias("group_id"))
    none = classes.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("group_id"))
    return out.unionByName(none)
