"""Token-id files with direct access to every id.

Directly addressable codes: an id is split into chunks; level k holds chunk k of
every id that has one, a bitmap says which of them go on in level k + 1, and a
rank directory counts the set bits before each block.  Reading id i takes one
chunk and one rank a level; nothing is decoded around it.

A file is one shard: ``LTD1``, the header, document ids, document starts, and for
each level its chunks, bitmap and rank directory, then one line feed (the record
end of the Spark writer that commits the file, so lost executors leave nothing
half written).
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.llm.common import in_arrow, new_path, text_slices, written

MAGIC = b"LTD1"
_HEAD = struct.Struct("<4sqqqqB")  # magic, part, sequence, documents, ids, levels
RANK_BITS = 512
#: Bits of the chunk of each level; 32 together.
WIDTHS = (8, 8, 16)
#: A shard is closed once it has this many ids; one document is never split.
SHARD_IDS = 1 << 20


def encode_shard(part: int, seq: int, doc_ids: list[int | None], lists: list[np.ndarray], widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The bytes of one shard."""
    if sum(widths) < 32 or any(w not in (8, 16, 32) for w in widths):
        raise ValueError("chunk widths are 8, 16 or 32 bits, 32 together")
    ids = np.concatenate(lists).astype(np.uint32) if lists else np.empty(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("<u8")
    out = [_HEAD.pack(MAGIC, part, seq, len(doc_ids), len(ids), len(widths)), bytes(widths)]
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.append(starts.tobytes())
    rest = ids.astype(np.uint64)
    for w in widths:
        chunk = (rest & np.uint64((1 << w) - 1)).astype(f"<u{w // 8}")
        rest = rest >> np.uint64(w)
        more = rest != 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = np.unpackbits(bits).reshape(-1, RANK_BITS).sum(1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        out += [struct.pack("<q", len(chunk)), chunk.tobytes(), bits.tobytes(), rank.tobytes()]
        rest = rest[more]
    return b"".join(out)


class Shard:
    """Read access to the bytes of a shard (also to a memory map)."""

    def __init__(self, data: bytes):
        magic, self.part, self.seq, self.n_docs, self.n_ids, n_levels = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.widths = tuple(data[at : at + n_levels])
        at += n_levels
        null = np.frombuffer(data, np.uint8, self.n_docs, at)
        ids = np.frombuffer(data, "<i8", self.n_docs, at + self.n_docs)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids, strict=True)]
        at += 9 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for w in self.widths:
            (n,) = struct.unpack_from("<q", data, at)
            at += 8
            chunk = np.frombuffer(data, f"<u{w // 8}", n, at)
            at += n * w // 8
            n_bytes = -(-n // RANK_BITS) * (RANK_BITS // 8)
            bits = np.frombuffer(data, np.uint8, n_bytes, at)
            at += n_bytes
            rank = np.frombuffer(data, "<u8", n_bytes * 8 // RANK_BITS + 1, at)
            at += rank.nbytes
            self.levels.append((w, chunk, bits, rank))

    def token(self, i: int) -> int:
        """Id number i, by one chunk and one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for w, chunk, bits, rank in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")
            i = int(rank[block]) + int(inside[: i - block * RANK_BITS].sum())
            shift += w
        return value

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """Ids at many places, as ``token`` finds each."""
        out = np.zeros(len(places), np.uint64)
        left, at, shift = np.arange(len(places)), np.asarray(places, np.int64), 0
        for w, chunk, bits, rank in self.levels:
            out[left] |= chunk[at].astype(np.uint64) << np.uint64(shift)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left, at = left[more], at[more]
            if not len(left):
                break
            blocks = bits.reshape(-1, RANK_BITS // 8)[at // RANK_BITS].view("<u8")  # a row of words for each place
            word = np.arange(RANK_BITS // 64)
            own = (at % RANK_BITS // 64)[:, None]
            mask = (np.uint64(1) << (at % 64).astype(np.uint64))[:, None] - np.uint64(1)
            ones = np.bitwise_count(np.where(word == own, blocks & mask, np.where(word < own, blocks, np.uint64(0)))).sum(1, dtype=np.int64)
            at = rank[at // RANK_BITS].astype(np.int64) + ones
            shift += w
        return out.astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        """All ids at once, from the deepest level upwards."""
        above = None
        for w, chunk, bits, _ in reversed(self.levels):
            value = chunk.astype(np.uint64)
            if above is not None:
                value[np.unpackbits(bits, bitorder="little")[: len(chunk)].astype(bool)] |= above << np.uint64(w)
            above = value
        return above.astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


# --- encoding -----------------------------------------------------------------

# Texts are cut only where every match of a byte-level pattern ends anyway: from a
# character that is not white space to one that is, and from letters or digits to
# the marks of _MARKS.  Both hold whatever follows.
_LETTERS = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r".,!|*$%&#"
_UNIT = re.compile(rf"[ \n\t\r]*[{_LETTERS}]+(?=[ \n\t\r{_MARKS}]|\Z)|[{_MARKS}]+(?=[ \n\t\r]|\Z)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Other white space (which Unicode versions and libraries tell differently): such a text is encoded in one piece.
_ODD_SPACE = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\u180e\u200b\u2060\ufeff]")
_ODD_BYTES = b"\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef"  # every such character has one of these in UTF-8


def _odd(text: str) -> bool:
    data = text.encode()
    return len(data.translate(None, _ODD_BYTES)) != len(data) and _ODD_SPACE.search(text) is not None


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bytes of words whose ids are kept, twice: those of lately, and those before them; and what a word takes beside its letters.
_KEPT_BYTES = 32 << 20
_WORD_BYTES = 200
#: Characters of text whose words are looked up together.
_SLICE_CHARS = 1 << 20


class Tokens:
    """Ids of texts by the tokenizers library, each distinct word encoded once in a while.

    What stands between two places of certain cuts is encoded alike wherever it
    stands, so its ids are kept for a while.  The vocabulary is byte-level, its
    pattern that of ``public_tokenizers.PATTERN``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: What the library takes out of a text before the pattern; such a text is encoded in one piece.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.whole_ids(text), "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if self.size > _KEPT_BYTES:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        new, before = [], len(known)
        for w in words.difference(known):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        merge, letters, mixed = self.model.tokenize, self.letters, []
        for w in new:
            if w.removeprefix(" ").isalpha():  # one match of the pattern: straight to the library's merges
                ids = [t.id for t in merge(w.encode().decode("latin-1").translate(letters))]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                mixed.append(w)
        for w, e in zip(mixed, self.tokenizer.encode_batch_fast(mixed, add_special_tokens=False), strict=True):
            known[w] = struct.pack(f"<{len(e)}I", *e.ids)
        self.size += sum(map(len, new)) + _WORD_BYTES * (len(known) - before)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _SLICE_CHARS):
                size += len(texts[stop])
                stop += 1
            units = [None if _odd(t) or any(a in t for a in self.added) else _UNIT.findall(t) for t in texts[start:stop]]
            self._learn(set().union(*(u for u in units if u is not None)))
            get = self.known.__getitem__
            for text, own in zip(texts[start:stop], units, strict=True):
                yield np.frombuffer(self.whole(text) if own is None else b"".join(map(get, own)), "<u4")
            start = stop


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> str:
    """Write the ids of (doc_id, text) to token files under ``path``, in ascending doc_id order.

    Null ids come first, equal ids in the order of their texts' hash; a null text
    counts as empty and still gets the end id.  The text is range-partitioned and
    sorted once, so a task holds one shard at a time, and tasks with equal input
    write equal files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, tok = TaskContext.get().partitionId(), 0, tokens(tokenizer)
        names: list[int | None] = []
        lists: list[np.ndarray] = []
        size = 0
        shard = lambda: pa.RecordBatch.from_arrays([pa.array([encode_shard(part, seq, names, lists)], pa.binary())], ["shard"])
        for batch in text_slices(batches, 1):
            for name, found in zip(batch.column(0).to_pylist(), tok.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(found, np.uint32(end_id))
                if size and size + len(ids) > shard_ids:
                    yield shard()
                    seq, names, lists, size = seq + 1, [], [], 0
                names.append(name)
                lists.append(ids)
                size += len(ids)
        if names:
            yield shard()

    shards = rows.transform(in_arrow, run, "shard binary")
    shards.select(F.col("shard").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, k, doc_id, local_start, n_tokens, ids_crc32) of every document in the files.

    The first and last id of each document are also read by the rank directories; one
    that differs stops the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_py())
                ids = s.all_ids().astype("<u4")
                ends = np.concatenate([s.starts[:-1], s.starts[1:] - 1])[np.tile(np.diff(s.starts) > 0, 2)]
                if (s.tokens(ends) != ids[ends]).any():
                    raise ValueError(f"shard {s.part}/{s.seq}: a directory leads elsewhere")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)]
                n = s.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.part] * n, pa.int64()), pa.array([s.seq] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(s.doc_ids, pa.int64()),
                     pa.array(s.starts[:-1], pa.int64()), pa.array(np.diff(s.starts), pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "k", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").transform(in_arrow, run, "part long, seq long, k long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): where each document's ids begin among all.

    Only a total for each shard (a file of a million ids) is ordered in one task.
    """
    rows = written(read_token_files(spark, path), "token-index")
    shards = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    bases = shards.select("part", "seq", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write token files into the shared folder and return ``token_index`` of them."""
    spark = docs.sparkSession
    return token_index(spark, write_token_files(docs, tokenizer, end_id, new_path(spark, "token-files")))
