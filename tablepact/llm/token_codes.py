"""Token ids in directly addressable codes (operator 1).

An id is cut into chunks of ``WIDTH`` bits. Level 0 holds the low chunk of every
id; a bitmap tells which ids go on to level 1, and so on. A directory of ranks
over each bitmap (one count for every 512 bits) turns a place in one level into
the place in the next, so any token is found by a few look-ups, without decoding
those before it.

``encode_documents`` writes one file set: Parquet rows, each of them a shard of
whole documents in ascending ``doc_id`` order whose ``payload`` has the layout
that ``DacShard`` reads. The payload column is not compressed, so that a place in
it can be addressed. ``read_documents`` reads the files back, and ``read_token`` looks one token up in its shard.

Cases. A null text is empty: it has the end id alone. A null ``doc_id`` comes
first. Rows with the same ``doc_id`` are kept, one after another, in the order
of their texts' hashes (so that many of them are dealt to many tasks). An empty table gives no rows. Other columns are ignored. A text
longer than a shard is a shard by itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import Scratch
from .textkit import buffers, freed, kept, spans

MAGIC = b"DAC1"
WIDTH = 8
RANK_BITS = 512
SHARD_TOKENS = 1 << 19
CACHE_WORDS, CACHE_PIECES = 80_000, 60_000
#: Bytes of texts whose words are looked up at once (a longer text makes a run of its own).
RUN = 1 << 20

SHARD_SCHEMA = "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, payload binary"


# -- the code ---------------------------------------------------------------------------------


def pack(ids: np.ndarray, doc_ends: np.ndarray) -> bytes:
    """The payload of a shard: ``ids`` of all its documents and the place where each of them ends."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> WIDTH > 0
        bits = np.packbits(more, bitorder="little")
        whole = np.zeros(-(-len(bits) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        whole[: len(bits)] = bits
        ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
        levels.append((rest.astype(np.uint8), bits, (np.cumsum(ones) - ones).astype(np.uint32)))
        if not more.any():
            break
        rest = rest[more] >> WIDTH
    out = [MAGIC, struct.pack("<QII", len(ids), len(doc_ends), len(levels)), doc_ends.astype("<u8").tobytes()]
    for chunk, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunk), len(bits), len(ranks)), ranks.astype("<u4").tobytes(), bits.tobytes(), chunk.tobytes()]
    return b"".join(out)


class DacShard:
    """Reads a payload; ``token(i)`` touches one chunk, bit and rank in each level."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        self.n, docs, levels = struct.unpack_from("<QII", payload, 4)
        at = 20
        self.doc_ends = np.frombuffer(payload, "<u8", docs, at)
        at += 8 * docs
        self.levels = []
        for _ in range(levels):
            n, nbits, nranks = struct.unpack_from("<QQQ", payload, at)
            at += 24
            ranks = np.frombuffer(payload, "<u4", nranks, at)
            at += 4 * nranks
            bits = np.frombuffer(payload, np.uint8, nbits, at)
            at += nbits
            self.levels.append((np.frombuffer(payload, np.uint8, n, at), bits, ranks))
            at += n

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before place i."""
        block = i // RANK_BITS
        lo = block * RANK_BITS // 8
        ones = int(np.bitwise_count(bits[lo : i // 8]).sum())
        return int(ranks[block]) + ones + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at place i, found without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << WIDTH * k
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n, np.uint32)
        where = None
        for k, (chunk, bits, _) in enumerate(self.levels):
            part = chunk.astype(np.uint32) << np.uint32(WIDTH * k)
            if where is None:
                out |= part
                where = np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))
            else:
                out[where] |= part
                where = where[np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool)]
        return out


# -- the tokenizer ----------------------------------------------------------------------------


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Second bytes of the letters from U+00C0 to U+00FF, whose first is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True


class ByteBpe:
    """Ids of the tokenizers library's byte-level BPE, with a cache of words.

    Such a tokenizer cuts a text by a pattern and codes each piece by itself. The
    texts of a run are cut into words where the pattern is sure to cut, each word that is in
    them is looked up once, and the library's model codes every piece that the cache does not hold. Texts
    with white space other than single spaces and line ends, or with an added token such as
    ``<|endoftext|>``, go to the library whole.
    """

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: White space other than spaces and line ends.
    _rare = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        # What the library says of its parts; the file, with its vocabulary, isn't parsed a second time.
        pre = json.loads(self.whole.pre_tokenizer.__getstate__()) if self.whole.pre_tokenizer else {}
        model = self.whole.model
        self.cached = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not self.whole.normalizer and type(model).__name__ == "BPE" and not model.dropout
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        bytes_as = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        #: The model's own character for each byte.
        self.bytes_as = "".join(bytes_as[b] for b in range(256))
        self.pieces = regex.compile(self.PIECE)
        self.model = self.whole.model
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size(True))]
        #: Pieces seen of late, and those of the turn before.
        self.small: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        if self.cached:
            self.stops = {stop: self._ids(stop) for stop in "\n.,;:!?"}

    def _plain(self, text: str) -> bool:
        """Whether words are set apart by single spaces and line ends alone, and none is an added token."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        return not self._rare.search(text) and not any(t in text for t in self.added)

    def _ids(self, piece: str) -> bytes:
        """The ids of a piece by the model, to which each byte is a character of its own."""
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(charmap_decode(piece.encode(), "strict", self.bytes_as)[0])])

    def _keep(self, piece: str) -> bytes:
        """The ids of a piece that isn't kept yet."""
        if len(self.small) >= CACHE_PIECES:
            self.older, self.small = self.small, {}  # most are seen once; what recurs is soon back, and in ``words``
        ids = self.small[piece] = self._ids(piece)
        return ids

    def _word(self, word: str, recurs: bool) -> bytes:
        """The ids of a word that isn't kept yet. It is kept if it recurs in its run or all of its pieces were seen before, so words that are seen once aren't."""
        if word in self.stops:
            return self.stops[word]
        small, older = self.small.get, self.older.get
        # Most are letters, after a space or none.
        if (word[1:] if word[0] == " " else word).isalpha():
            ids = small(word) or older(word)
            if ids is None:
                ids = self._keep(word)
            else:
                recurs = True
        else:
            pieces = self.pieces.findall(word)
            found = [small(p) or older(p) for p in pieces]
            ids = b"".join([self._keep(p) if x is None else x for p, x in zip(pieces, found)])
            recurs = recurs or None not in found
        if recurs and len(self.words) < CACHE_WORDS:
            self.words[word] = ids
        return ids

    def _run(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each of some plain texts."""
        data, at = buffers(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        # A word begins with each text, at a space, at and after a line end, and where punctuation follows a letter or digit of the first 256 characters.
        line = data == 0x0A
        first = (data == 0x20) | line
        first[1:] |= line[:-1]
        known = _ALNUM[data]
        known[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        first[1:] |= known[:-1] & _PUNCT[data[1:]]
        first[at[:-1]] = True
        start = np.flatnonzero(first)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)).dictionary_encode()
        which, words = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, words))
        if None in found:
            recurs = (np.bincount(which) > 1).tolist()
            found = [self._word(w, r) if ids is None else ids for w, r, ids in zip(words, recurs, found)]
        # Each word's ids are copied from those of the distinct words.
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[which]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(end[-1]) + np.repeat((np.cumsum(size) - size)[which] - (end - n), n)]
        lo = 0
        for hi in end[np.searchsorted(start, at[1:]) - 1].tolist():
            yield ids[lo:hi].tobytes()
            lo = hi

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; null is empty."""
        for lo, hi in spans(buffers(texts)[1], RUN):
            run = texts.slice(lo, hi - lo)
            values = run.to_pylist()
            plain = [self.cached and bool(v) and self._plain(v) for v in values]
            coded = self._run(run.filter(pa.array(plain))) if any(plain) else iter(())
            for value, known in zip(values, plain):
                yield next(coded) if known else np.array(self.whole.encode(value or "", add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return next(self.encode_all(pa.array([text], pa.string())))


def coder(path: str) -> ByteBpe:
    coders = kept.setdefault("token_codes", {})
    if path not in coders:
        coders[path] = ByteBpe(path)
    return coders[path]


# -- writing and reading ----------------------------------------------------------------------


def encode_documents(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every text, ``end_id`` after each, as shards in ascending ``doc_id`` order to ``out``."""
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = coder(tokenizer), TaskContext.get().partitionId()
        ids, parts, ends, held, seq, before = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(parts), "<u4"), np.array(ends, np.uint64))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "first_token", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            for key, coded in zip(batch.column(0), code.encode_all(batch.column(1))):
                ids.append(key.as_py())
                parts += coded, end
                held += len(coded) // 4 + 1
                ends.append(held)
                if held >= shard_tokens:
                    yield row()
                    ids, parts, ends, seq, before, held = [], [], [], seq + 1, before + held, 0
        if ids:
            yield row()
        code.small, code.older = {}, {}  # words that recur stay for the worker's next task

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ordered.select("doc_id", "text").mapInArrow(freed(shards, "token_codes"), SHARD_SCHEMA).write.option("compression", "none").parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, keys, payload in zip(*(batch.column(i) for i in range(4))):
            shard = DacShard(payload.as_py())
            ends = shard.doc_ends.astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            raw = shard.tokens().astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * len(ends), pa.int32()), pa.array(keys.as_py(), pa.int64()), pa.array(starts + first.as_py(), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _bases(shards: DataFrame) -> list[tuple[int, int]]:
    """Each file part and the ids before it: one count for each, no more than the partitions of the write, is summed on the driver."""
    base, before = [], 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base.append((r["part"], before))
        before += r["n"]
    return base


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: doc_id, start (ids before it), n_tokens and ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    bases = spark.createDataFrame(_bases(shards), "part int, base long")
    found = shards.select("part", "first_token", "doc_ids", "payload").mapInArrow(freed(_documents), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def read_token(spark: SparkSession, path: str, i: int) -> int:
    """The id at place ``i`` of all that the files hold. Only the counts of the shards and the one shard with that place are read, and no other id is decoded."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    part, base = max(((p, b) for p, b in _bases(shards) if b <= i), key=lambda x: (x[1], x[0]), default=(None, 0))
    at = F.lit(i - base)
    row = shards.filter((F.col("part") == part) & (F.col("first_token") <= at) & (at < F.col("first_token") + F.col("n_tokens"))).select("first_token", "payload").first() if part is not None else None
    if row is None:
        raise IndexError(i)
    return DacShard(row["payload"]).token(i - base - row["first_token"])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, out: str | None = None) -> DataFrame:
    """Encodes, writes and reads back; one row a document."""
    spark = docs.sparkSession
    out = out or f"{Scratch(spark, 'tokens').path}/shards"
    encode_documents(docs, out, tokenizer, end_id)
    return read_documents(spark, out)
