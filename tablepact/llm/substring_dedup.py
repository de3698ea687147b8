"""Substring deduplication with repeated-phrase automata (operator 3).

A phrase is a run of ``window`` words that starts in two documents or more. Every word under
a phrase is removed from all documents but the first that holds it (the smallest doc_id).

1. Each run of ``window`` words has an anchor: of its runs of ``GRAM`` words the one of the smallest hash.
   Equal runs have equal anchors, so a run can only recur if its anchor does. Anchors are a fifth as many as words.
2. Where anchors recur in different texts, documents give out segments: the words around the anchor, with a hash of each
   run whose anchor it is. The recurring anchors are a bitmap that goes to all machines if it stays
   below ``BITMAP_LOG2`` bits; beyond that, each document is joined with its own recurring anchors.
3. Segments are dealt into shards by anchor, so that all places of a run meet in one. Each shard confirms, by their counts, the runs that start in
   two documents; these are its phrases.
4. It compiles its phrases into an Aho-Corasick automaton over words and streams all of its segments through it, which locates every
   occurrence. A shard with many segments (an anchor that a third of all documents share) is cut into parts instead,
   each with the phrases of the whole shard, which an aggregate over all its parts has confirmed.
5. What was located is removed from the whole texts.

The automata's letters are 31-bit codes of words; a place that one reports counts if the hash of its run is the phrase's.

Cases. A null, empty or wordless text has no words and keeps none. A text of fewer words than a window loses none.
Rows with the same doc_id are judged each by its own text and aren't smaller than one another. A null doc_id counts as larger than any.
A phrase that recurs within one document alone is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .joins import match
from .store import Scratch
from .textkit import SPACED, Run, freed, mix, ragged, runs, sequence_hashes, window_starts

GRAM = 5
BITMAP_LOG2 = 28
#: Bits of a part of the bitmap that is made in one place.
BLOCK_LOG2 = 14
#: An automaton looks for the first word of a phrase among those of all of its phrases, so shards are small.
SHARD_SEGMENTS = 4_000
MOST_SHARDS = 1_000_000
LAST = (1 << 63) - 1
_U = np.uint64


def _text_ids(run: Run, words: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's sequence of words; 0 for none."""
    n = np.diff(run.first)
    return np.where(n > 0, mix(sequence_hashes(words, run.first[:-1], n)) | _U(1), _U(0)).view(np.int64)


def _anchors(run: Run, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``window`` words: its start, row, anchor and the anchor's place."""
    at, row = window_starts(run.first, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none
    grams = sequence_hashes(words, np.arange(len(words) - GRAM + 1), GRAM)
    best, place = grams[at], at.copy()
    for k in range(1, window - GRAM + 1):
        other = grams[at + k]
        less = other < best
        best[less] = other[less]
        place[less] = at[less] + k
    return at, row, best, place


def _surveyed(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, tid, n_words, anchors) of every document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(2), SPACED, False):
                words, k = run.hashes(), run.hi - run.lo
                _, row, anchor, place = _anchors(run, words, window)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                lists = ragged(anchor[new].view(np.int64), np.bincount(row[new], minlength=k), pa.int64())
                columns = [batch.column(0).slice(run.lo, k), batch.column(1).slice(run.lo, k), pa.array(_text_ids(run, words)), pa.array(np.diff(run.first).astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "tid", "n_words", "anchors"])

    return docs.mapInArrow(freed(found), "doc_id long, text_hash long, tid long, n_words long, anchors array<long>")


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of the keys' leading bits: 128 for each key or somewhat more where they fit, so that few others are taken for one of them; 16 at least."""
    log2 = max(20, min(BITMAP_LOG2, int(128 * n).bit_length()), int(16 * n).bit_length())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = (batch.column(1).to_numpy().view(np.uint64) >> _U(64 - log2)).astype(np.int64)
            cell = np.sort(cell)
            at = np.flatnonzero(np.append(True, cell[1:] >> BLOCK_LOG2 != cell[:-1] >> BLOCK_LOG2)) if len(cell) else []
            for lo, hi in zip(at, [*at[1:], len(cell)]):
                bits = blocks.setdefault(int(cell[lo] >> BLOCK_LOG2), np.zeros(1 << BLOCK_LOG2, bool))
                bits[cell[lo:hi] & ((1 << BLOCK_LOG2) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"])

    block = F.shiftrightunsigned("key", 64 - log2 + BLOCK_LOG2).cast("int")
    out = np.zeros(1 << (log2 - 3), np.uint8)
    for r in keys.select(block.alias("block"), "key").repartition("block").mapInArrow(packed, "block int, bits binary").collect():
        out[r["block"] << BLOCK_LOG2 - 3 : (r["block"] + 1) << BLOCK_LOG2 - 3] = np.frombuffer(r["bits"], np.uint8)
    return out


def _segments(docs: DataFrame, window: int, bitmap: np.ndarray | None) -> DataFrame:
    """(anchor, tid, id, pos, codes, hashes): words around each recurring anchor, and its runs' hashes.

    Rows of ``docs`` are (id, text), and without a bitmap (id, text, want, anchors), for the text of tid ``want``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    fields = "anchor long, tid long, id long, pos int, codes array<int>, hashes array<long>"
    names = [f.split()[0] for f in fields.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for run in runs(batch.column(1), SPACED, False):
                words = run.hashes()
                tid = _text_ids(run, words)
                at, row, anchor, place = _anchors(run, words, window)
                if bits is not None:
                    shift = 64 - (len(bits).bit_length() + 2)
                    cell = (anchor >> _U(shift)).astype(np.int64)
                    keep = bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0
                else:
                    keep = np.zeros(len(at), bool)
                    for i in range(run.lo, run.hi):
                        if batch.column(2)[i].as_py() == tid[i - run.lo]:
                            mine = slice(*np.searchsorted(row, [i - run.lo, i - run.lo + 1]))
                            keep[mine] = np.isin(anchor[mine].view(np.int64), batch.column(3)[i].values.to_numpy())
                at, row, anchor, place = at[keep], row[keep], anchor[keep], place[keep]
                if not len(at):
                    continue
                hashes = sequence_hashes(words, at, window)
                new = np.ones(len(at), bool)
                new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                runs_in = np.diff(np.append(first, len(at)))
                n = runs_in + window - 1
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                codes = (words[np.repeat(at[first], n) + within] & _U(0x7FFFFFFF)).astype(np.int32)
                lists = [ragged(codes, n, pa.int32()), ragged(hashes.view(np.int64), runs_in, pa.int64())]
                r = row[first]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(tid[r]), pa.array(ids[run.lo + r]), pa.array((at[first] - run.first[r]).astype(np.int32)), *lists], names)

    return docs.mapInArrow(freed(found), fields)


def _list(segments: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one after another, and where each row's begin, with their end."""
    column = segments[name].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = np.asarray(column.offsets)[: len(column) + 1].astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _confirm(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that start in two documents, in order, and the first document of each."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    first, last = np.minimum.reduceat(ids[order], begin), np.maximum.reduceat(ids[order], begin)
    twice = first < last
    return h[begin][twice], first[twice]


def _compile(codes: list[int], places: np.ndarray, window: int):
    """An automaton of the runs of codes from these places; each reports its number, and those of the same codes are listed under the first of them."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    same: dict[int, list[int]] = {}
    for k, i in enumerate(places.tolist()):
        run = tuple(codes[i : i + window])
        held = automaton.get(run, -1)
        if held < 0:
            automaton.add_word(run, k)
        else:
            same.setdefault(held, [held]).append(k)
    automaton.make_automaton()
    return automaton, same


def _locate(segments: pa.Table, phrases: tuple[np.ndarray, np.ndarray] | None, window: int) -> tuple[np.ndarray, ...]:
    """(tid, id, start, end): every occurrence of the phrases in segments of larger ids, joined where they overlap.

    ``phrases`` are sorted hashes and first ids; None: those of the segments themselves.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not segments.num_rows:
        return none
    hashes, first_hash = _list(segments, "hashes")
    codes, first_code = _list(segments, "codes")
    tids, ids, pos = (segments[c].to_numpy() for c in ("tid", "id", "pos"))
    segment = np.repeat(np.arange(len(ids)), np.diff(first_hash))
    known, first = phrases if phrases is not None else _confirm(hashes, ids[segment])
    # A place of each phrase, for its words; each segment has one place more in the stream, for a stop.
    at, place = np.unique(hashes, return_index=True)
    k = np.minimum(np.searchsorted(known, at), max(len(known) - 1, 0))
    here = known[k] == at if len(known) else np.zeros(len(at), bool)
    if not here.any():
        return none
    known, first, place = at[here], first[k[here]], place[here]
    shift = np.arange(len(ids) + 1)
    stream = np.full(len(codes) + len(ids), 0xFFFFFFFF, np.int64)
    stream[np.arange(len(codes)) + np.repeat(shift[:-1], np.diff(first_code))] = codes
    begins = first_code + shift
    stream = stream.tolist()
    automaton, same = _compile(stream, begins[segment[place]] + place - first_hash[segment[place]], window)
    found = np.fromiter(chain.from_iterable(automaton.iter(tuple(stream))), np.int64).reshape(-1, 2)
    start, phrase = found[:, 0] - (window - 1), found[:, 1]
    for held, others in same.items():
        mine = start[phrase == held]
        start = np.concatenate([start, *[mine] * (len(others) - 1)])
        phrase = np.concatenate([phrase, *[np.full(len(mine), o) for o in others[1:]]])
    own = np.searchsorted(begins, start, "right") - 1
    within = start - begins[own]
    good = (first[phrase] < ids[own]) & (hashes[first_hash[own] + within] == known[phrase])
    own, within = own[good], within[good]
    if not len(own):
        return none
    order = np.lexsort((within, own))
    own, within = own[order], within[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (within[1:] > within[:-1] + window)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(own)) - 1
    return tids[own[lo]], ids[own[lo]], pos[own[lo]] + within[lo], pos[own[lo]] + within[hi] + window


def occurrences(docs: DataFrame, anchors: DataFrame, texts: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(tid, id, spans): in each text of a document, the places of words that an earlier document's phrase covers.

    Rows are docs (id, text), anchors (tid, anchors) and texts (tid, id).
    """
    postings = anchors.filter("tid <> 0").select(F.explode("anchors").alias("key"), "tid")
    recurring = postings.groupBy("key").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).filter("low <> high").select("key")
    recurring = scratch.table(recurring, "recurring")
    n = recurring.count()
    if 16 * n < 1 << (BITMAP_LOG2 - 1):
        found = _segments(docs, window, _bitmap(recurring, n))
    else:
        own = postings.join(recurring, "key").groupBy("tid").agg(F.collect_set("key").alias("anchors"))
        rows = texts.distinct().join(own, "tid").select("id", F.col("tid").alias("want"), "anchors")
        found = _segments(docs.join(rows, "id").select("id", "text", "want", "anchors"), window, None)
    segments = scratch.table(found, "segments")
    scratch.drop(recurring)

    total = segments.count()
    shards = max(1, -(-total // SHARD_SEGMENTS))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    fields = "tid long, id long, start int, end int"

    def spans(tid: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        return pa.table({"tid": pa.array(tid), "id": pa.array(own), "start": pa.array(start.astype(np.int32)), "end": pa.array(end.astype(np.int32))})

    # A shard holds all runs of its anchors, so it confirms its own phrases unless it is so large that it has to be dealt out.
    parts = scratch.table(segments.groupBy(shard.alias("shard")).agg(F.ceil(F.count("*") / (2 * SHARD_SEGMENTS)).cast("int").alias("parts")).filter("parts > 1"), "parts")
    few = F.broadcast(parts) if shards <= MOST_SHARDS else parts
    keyed = segments.withColumn("shard", shard).drop("anchor").join(few, "shard", "left")
    places = keyed.filter("parts IS NULL").groupBy("shard").applyInArrow(lambda rows: spans(*_locate(rows, None, window)), fields)
    if not parts.isEmpty():
        large = keyed.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("tid", "id"), F.col("parts")).cast("int")).drop("parts")
        phrases = (
            large.select("id", "shard", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.first("shard").alias("shard"))
            .filter("first_id < last_id").select("shard", "hash", "first_id")
        )
        given = phrases.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def located(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("hash")
            return spans(*_locate(left, (right["hash"].to_numpy(), right["first_id"].to_numpy()), window))

        places = places.unionByName(large.groupBy("shard", "part").cogroup(given.groupBy("shard", "part")).applyInArrow(located, fields))
    found = scratch.table(places.groupBy("tid", "id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop(segments)
    return found


def _removed(docs: DataFrame, fields: str, emit) -> DataFrame:
    """Runs of whole texts with their removed words marked; rows are (doc_id, whole, spans, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, spans = batch.column(1).to_pylist(), batch.column(2)
            for run in runs(batch.column(3), SPACED, False):
                gone = np.zeros(len(run.start) + 1, np.int64)
                for i in range(run.lo, run.hi):
                    a, b = run.first[i - run.lo], run.first[i - run.lo + 1]
                    if whole[i]:
                        gone[a] += 1
                        gone[b] -= 1
                    elif spans[i].is_valid:
                        flat = spans[i].values
                        np.add.at(gone, a + flat.field(0).to_numpy(), 1)
                        np.add.at(gone, a + flat.field(1).to_numpy(), -1)
                yield emit(batch, run, np.cumsum(gone)[:-1] > 0)

    return docs.mapInArrow(freed(found), fields)


def _kept(run: Run, gone: np.ndarray) -> Iterator[bytes]:
    """Each row's kept words, joined by one space."""
    start, end = run.start[~gone], run.end[~gone]
    n = end - start + 1
    ends = np.cumsum(n)
    at = np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    text = np.append(run.data, np.uint8(32))[at] if len(at) else np.zeros(0, np.uint8)
    text[ends - 1] = 32
    raw = text.tobytes()
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.bincount(run.row[~gone], minlength=run.hi - run.lo))]).astype(np.int64)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield raw[a : max(a, b - 1)]


def dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (and with ``texts`` the kept text)."""
    scratch = Scratch(docs.sparkSession, "substrings")
    words = F.col(text).cast("string")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(words).alias("text_hash"), words.alias("text"))
    surveyed = scratch.table(_surveyed(docs, window), "survey")
    own = F.coalesce("doc_id", F.lit(LAST)).alias("id")
    spans = occurrences(docs.select(own, "text"), surveyed.select("tid", "anchors"), surveyed.select("tid", own), scratch, window)
    each = surveyed.filter(F.col("n_words") >= window).select("doc_id", "text_hash", "tid", own).distinct()
    first = each.groupBy("tid").agg(F.min("id").alias("first_id"), F.count("*").alias("m"))
    # All of a text goes where an earlier document has the same words; the first of them loses what was located.
    whole = F.col("id") > F.col("first_id")
    known = each.join(first.join(spans.withColumnRenamed("id", "first_id"), ["tid", "first_id"], "left").filter("m > 1 OR spans IS NOT NULL"), "tid")
    known = known.select("doc_id", "text_hash", whole.alias("whole"), F.when(~whole, F.col("spans")).alias("spans")).filter("whole OR spans IS NOT NULL")
    known = scratch.table(known, "known")
    scratch.drop(spans, surveyed)

    def digest(batch: pa.RecordBatch, run: Run, gone: np.ndarray) -> pa.RecordBatch:
        kept = list(_kept(run, gone))
        columns = [
            batch.column(0).slice(run.lo, run.hi - run.lo), pa.array(np.diff(run.first).astype(np.int64)), pa.array(np.bincount(run.row[gone], minlength=run.hi - run.lo).astype(np.int64)),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([k.decode() for k in kept], pa.string())] if texts else columns, [*names, "kept"] if texts else names)

    rows = match(docs, known, ["doc_id", "text_hash"], "left").select("doc_id", "whole", "spans", "text")
    return _removed(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts, digest)
