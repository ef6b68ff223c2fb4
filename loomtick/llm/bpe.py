"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import in_arrow, text_slices

#: A text longer than this is encoded in segments of about this many characters.
SEGMENT_CHARS = 1 << 16

#: White space in every Unicode version; only in front of these is a text cut.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n\t\r]")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; loaded once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"own-{rank_file}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a text where every match of the pattern ends anyway.

    No alternative of the byte-level patterns goes from a character that is not
    white space to one that is, and looking ahead matters only within white
    space; so the place between the two is a boundary however the text goes on.
    Without such a place (one endless word) the text stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str, size: int = SEGMENT_CHARS) -> np.ndarray:
    """Ids of a whole text, as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4") if text else np.empty(0, "<u4")
    return np.concatenate([np.asarray(enc.encode_ordinary(s), "<u4") for s in segments(text, size)])


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) to (doc_id, text).

    One row for each row of ``docs``; a null text counts as empty and has no
    ids.  Other columns are left out, so clashing names do no harm.  Works row
    by row: no shuffle, and memory is bounded by one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in text_slices(batches, 1):
            ids = [encode_text(enc, t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).transform(in_arrow, run, "doc_id long, ids binary")


def decode_ids(enc, ids: bytes) -> bytes:
    """Raw bytes of the ids; never by way of text, as a token can end inside a character."""
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def digests(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids), by decoding the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in text_slices(batches, 1):
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) // 4 for b in rows], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in rows], pa.string()),
                    pa.array([hashlib.sha256(decode_ids(enc, b)).hexdigest() for b in rows], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.transform(in_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
