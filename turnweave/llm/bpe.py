"""Byte-level BPE by the tiktoken library and a local rank file.

A text is cut before spaces where the library's pattern always begins a new match,
so that each piece can be encoded alone: a long text never meets the pattern as a
whole, and the ids of a frequent piece are looked up. The ids are those of the whole
text. Decoding joins the raw bytes of the ids, so that it is exact even where an id
holds part of a character.

Edge cases: a null text counts as empty (no ids); runs of white space of any length are
given to the merges without the pattern, whose engine overflows on them; texts of one word
and texts without spaces are encoded whole; special strings are ordinary text. The cuts
fit ``CUT_PATTERN`` alone: with another pattern each text is encoded as a whole. Repeated
rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches

#: Entries of the table of pieces of each Python worker, and the longest piece kept in it.
CACHE_PIECES, CACHE_CHARS = 400_000, 40

#: Fixed value: the pattern that the cuts below fit.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of the pattern; Python's own class has U+001C to U+001F besides.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space between white space is the one place where a cut before it could be inside a match.
_INNER_SPACE = re.compile(f"[{_WHITE}] [{_WHITE}]")
#: Before a space that ends its run of white space, a match always begins.
_SAFE = re.compile(f"(?<=[{_WHITE}])(?= [^{_WHITE}])|(?<=[^{_WHITE}])(?=[{_WHITE}])")
#: Runs of white space that the pattern's engine is not asked for.
_LONG = re.compile(f"[{_WHITE}]{{1000,}}")


class BytePairs(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str, cache_pieces: int = CACHE_PIECES) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.room = cache_pieces
        self.cuts = pattern == CUT_PATTERN

    def _ids(self, piece: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(piece)).tobytes()

    def _with_long_runs(self, piece: str) -> bytes:
        """A long run is one match up to its last character, which begins the next match if text follows."""
        out, at = [], 0
        for run in _LONG.finditer(piece):
            start, end = run.span()
            end -= end < len(piece)
            out += [self._ids(piece[at:start]), array("I", self.encoding._encode_single_piece(piece[start:end].encode())).tobytes()]
            at = end
        return b"".join([*out, self._ids(piece[at:])])

    def __missing__(self, piece: str) -> bytes:
        ids = self._with_long_runs(piece) if len(piece) >= 1000 and _LONG.search(piece) else self._ids(piece)
        if len(piece) <= CACHE_CHARS and self.room > 0:
            self.room -= 1
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if not self.cuts:
            return self._ids(text)
        if _INNER_SPACE.search(text):
            return b"".join(map(self.__getitem__, _SAFE.split(text)))
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[x] for x in map(" ".__add__, rest)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(ranks_path: str, pattern: str) -> BytePairs:
    """The tokenizer of this process; read from the local file once."""
    key = (ranks_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = BytePairs(ranks_path, pattern)
    return _LOADED[key]


def encode_texts(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks_path, pattern)
        for batch in batches:
            found = [np.frombuffer(pairs.encode(x or ""), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(encoded, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and raw (binary): the bytes of ``ids``; a null list gives no bytes."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks_path, pattern)
        for batch in batches:
            raw = [pairs.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    bound_batches(encoded)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, raw binary")


def token_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, digest, decode again, digest.

    Both ways happen where the row is read, so that no ids cross to the JVM.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks_path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_raw = [], [], []
            for text in batch.column(1):
                ids = pairs.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_raw.append(sha(pairs.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_raw, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(digests, schema)
