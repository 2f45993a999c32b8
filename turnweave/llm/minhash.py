"""Near-duplicates by MinHash, banding, verification on whole sets, and components.

A text is lower-cased (A-Z) and cut into words at ASCII white space; its set is that of
its distinct shingles of ``words`` words (with fewer words, the whole sequence is one).
Documents are linked if their sets' Jaccard similarity reaches the threshold.

1. Each set gets a 128-bit key, ``ROWS * BANDS`` universal hash minima (its signature), and
   from these a bucket for each band. Equal sets are one class from here on, whatever
   their number.
2. Of the buckets with the same members only one is kept. A bucket of more than ``BLOCK``
   classes, or of more than ``BLOCK_SHINGLES`` shingles, is cut into blocks, and every
   pair of blocks is a task's own; nothing is capped.
3. Signatures are verified there first: a class stays in a block or pair of blocks if its
   signature has enough equal minima with another's (``least_equal``). Only the whole sets
   of those that stay are fetched.
4. Within a block or pair of blocks, the candidates are compared exactly by an inverted
   index; pairs that are connected there already are skipped. What comes out are the
   links of a spanning forest, not all pairs.
5. Components by alternating large-star and small-star.

A pair at the threshold t is missed by all bands with probability (1 - t ** ROWS) **
BANDS: 4e-7 at 0.85, 3e-5 at 0.8 (28 bands: 4e-7), and by the signatures with 1e-7 at most;
every link that is found is exact on 64-bit hashes. A bucket of n blocks is read n times.

Edge cases: a text that is null, empty or of white space only has an empty set and is
linked with nothing; equal texts are one class; rows that repeat a doc_id count as one
document with all their links; a null doc_id takes part as a member of its class and
is its own component if the class has no other; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches, checkpointed
from turnweave.llm.components import connected_components

ROWS, BANDS, BLOCK, BLOCK_SHINGLES = 4, 20, 1024, 4_000_000
#: Standard deviations that the number of equal minima may be below its mean at the threshold.
DEVIATIONS = 6.0
#: Class ids (8 bytes each) up to this number are broadcast when sets are fetched; above, the join shuffles.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=_U)
_STEP = int(_RANDOM.integers(0, 2**63)) * 2 + 1
_MIX = [_U(int(x) * 2 + 1) for x in _RANDOM.integers(0, 2**63, 8)]
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int, held: list = [np.ones(1, _U), np.ones(1, _U)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the step and of its inverse modulo 2**64, n at least."""
    if len(held[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        for k, base in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            held[k] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]))
    return held[0], held[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX[0]
    x = (x ^ (x >> _U(29))) * _MIX[1]
    return x ^ (x >> _U(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    up, down = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[raw] * up[: len(raw)])])
    return _mix((sums[ends] - sums[starts]) * down[starts] if len(starts) else np.empty(0, _U))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    hashes = word_hashes(text) if text else np.empty(0, _U)
    size = min(words, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    total = np.full(n, size, _U)
    for i in range(size):
        total = total * _MIX[2] + hashes[i : i + n] * _MIX[3]
        total ^= total >> _U(31)
    return np.unique(_mix(total))


class Minima:
    """Universal hash minima of a set, and the buckets of its bands."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS) -> None:
        random = np.random.default_rng(97)
        self.rows, self.bands = rows, bands
        self.factor = random.integers(0, 2**63, (rows * bands, 1), dtype=_U) * _U(2) + _U(1)
        self.shift = random.integers(0, 2**64, (rows * bands, 1), dtype=_U)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.rows * self.bands, 2**64 - 1, _U)
        for i in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[i : i + 2048] * self.factor + self.shift).min(axis=1), out=least)
        return least >> _U(32)

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        signature = signature.reshape(self.bands, self.rows)
        total = np.arange(1, self.bands + 1, dtype=_U)
        for i in range(self.rows):
            total = _mix(total * _MIX[4] + signature[:, i])
        return total.view(np.int64)


def least_equal(threshold: float, minima: int) -> int:
    """The least number of equal minima of two sets at the threshold, but for one case in 1e7."""
    return max(1, math.floor(minima * threshold - DEVIATIONS * math.sqrt(minima * threshold * (1 - threshold))))


def sketch(documents: DataFrame, words: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key, buckets and signature (32 bits a minimum); all but the first two are null for empty sets."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(rows, bands)
        for batch in batches:
            sizes, keys, buckets, signatures, known = [], [], [], [], {}
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                key = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
                if key and key not in known:
                    signature = minima.signature(shingles)
                    known[key] = minima.buckets(signature), signature.astype("<u4").tobytes()
                keys.append(key)
                found = known.get(key, (None, None))
                buckets.append(found[0])
                signatures.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "buckets", "signature"],
            )

    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(sketched, f"doc_id {kind}, n_shingles bigint, set_key binary, buckets array<bigint>, signature binary")


def _whole_sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the documents named in ``wanted``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").alias("rep"), F.col("text").cast("string")).join(wanted, "rep", "left_semi")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(made, f"rep {kind}, shingles array<bigint>")


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> list[int]:
        """Those of the others that were not connected with a yet, one for each of their trees."""
        new = []
        for b in others.tolist():
            if self.root[a] != self.root[b]:
                self.root[self.root == self.root[b]] = self.root[a]
                new.append(b)
        return new


def spanning_links(sets: list[np.ndarray], sides: np.ndarray, least: Fraction, cross: bool) -> list[tuple[int, int]]:
    """Pairs of indexes of similar sets that connect all that are similar.

    cross: only pairs with different ``sides`` are candidates.
    """
    n, found = len(sets), []
    sizes = np.array([len(x) for x in sets])
    up, down = least.numerator, least.denominator
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if down * common >= up * (sizes.sum() - common) and not (cross and sides[0] == sides[1]) else []
    forest = _Forest(n)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")  # of equal shingles, owners ascend
    owner = owner[order]
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    last = np.append(first[1:], len(values))
    ends = np.cumsum(sizes)
    for a in range(n - 1):
        own = rank[ends[a] - sizes[a] : ends[a]]
        starts, counts = first[own], last[own] - first[own]
        total = int(counts.sum())
        at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        common = np.bincount(owner[at], minlength=n)
        good = down * common >= up * (sizes + sizes[a] - common)
        good &= forest.root != forest.root[a]
        good[: a + 1] = False
        if cross:
            good &= sides != sides[a]
        found += [(a, b) for b in forest.join(a, np.flatnonzero(good))]
    return found


def _agreeing(dealt: DataFrame, least: int, kind: str) -> DataFrame:
    """The rows (bucket, one, two, side, rep) whose signature agrees with that of another class there; rows of one block stand together."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stay() -> list[int]:
            if len(rows) < 2:
                return []
            found = np.zeros(len(rows), bool)
            table = np.frombuffer(b"".join(signatures), "<u4").reshape(len(rows), -1)
            sides = np.array([x[3] for x in rows])
            for a in range(len(rows) - 1):
                near = (table[a + 1 :] == table[a]).sum(axis=1) >= least
                if now[1] != now[2]:
                    near &= sides[a + 1 :] != sides[a]
                if near.any():
                    found[a] = True
                    found[a + 1 :] |= near
            return np.flatnonzero(found).tolist()

        now, rows, signatures, kinds = None, [], [], None
        for batch in batches:
            kinds = batch.schema.types[:5]
            kept = []
            for *row, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(row[:3]) != now:
                    kept += [rows[i] for i in stay()]
                    now, rows, signatures = tuple(row[:3]), [], []
                rows.append(row)
                signatures.append(signature)
            yield made(kept, kinds)
        if kinds:
            yield made([rows[i] for i in stay()], kinds)

    def made(kept: list[list], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in kept], kinds[i]) for i in range(5)], names=["bucket", "one", "two", "side", "rep"])

    return dealt.mapInArrow(agreeing, f"bucket bigint, one int, two int, side int, rep {kind}")


def _verified(candidates: DataFrame, least: Fraction, kind: str) -> DataFrame:
    """(a, b) of the links of each block or pair of blocks; rows of one stand together."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared() -> list[tuple]:
            if len(reps) < 2:
                return []
            found = spanning_links(sets, np.array(sides), least, now[1] != now[2])
            return [(reps[a], reps[b]) for a, b in found if reps[a] != reps[b]]

        now, reps, sets, sides, own = None, [], [], [], pa.int64()
        for batch in batches:
            found, own = [], batch.schema.types[4]
            flat = batch.column(5)
            values, offsets = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for k, (bucket, one, two, side, rep) in enumerate(keys):
                if (bucket, one, two) != now:
                    found += compared()
                    now, reps, sets, sides = (bucket, one, two), [], [], []
                reps.append(rep)
                sides.append(side)
                sets.append(values[offsets[k] : offsets[k + 1]].copy())
            yield _pairs(found, own)
        if now:
            yield _pairs(compared(), own)

    def _pairs(found: list[tuple], own: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], own), pa.array([b for _, b in found], own)], names=["a", "b"])

    return candidates.mapInArrow(links, f"a {kind}, b {kind}")


def near_links(documents: DataFrame, classes: DataFrame, words: int, least: Fraction, block: int = BLOCK, minima: int = ROWS * BANDS) -> DataFrame:
    """Links (a, b) between classes (rep, n_shingles, buckets, signature) that connect all similar ones."""
    kind = classes.schema["rep"].dataType.simpleString()
    in_bucket = classes.select("rep", "n_shingles", F.explode("buckets").alias("bucket"))
    size = F.sum("n_shingles").alias("size")
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("n"), size, F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("hub")).where("n > 1")
    shared = shared.groupBy("n", "x", "hub").agg(F.min("bucket").alias("bucket"), F.max("size").alias("size")).select("bucket", "n", "size")
    members = checkpointed(in_bucket.join(shared, "bucket").select("bucket", "n", "size", "rep"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    side = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("side", side)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.where("blocks = 1").withColumn("other", F.lit(0)).unionByName(placed.where("blocks > 1").withColumn("other", other))
    placed = placed.select("bucket", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "rep")
    key = ["bucket", "one", "two"]
    signed = placed.join(classes.select("rep", "signature"), "rep").select(*key, "side", "rep", "signature")
    agreeing = checkpointed(_agreeing(signed.repartition(*key).sortWithinPartitions(*key), least_equal(float(least), minima), kind))
    sets = _whole_sets(documents, agreeing.select("rep").distinct(), words)
    dealt = agreeing.join(sets, "rep").select(*key, "side", "rep", "shingles")
    return _verified(dealt.repartition(*key).sortWithinPartitions(*key), least, kind)


def near_duplicates(documents: DataFrame, *, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; see the module."""
    bound_batches(documents)
    sketches = checkpointed(sketch(documents, words, rows, bands))
    full = sketches.where("n_shingles > 0")
    own = [F.first(x).alias(x) for x in ("n_shingles", "buckets", "signature")]
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *own)
    links = near_links(documents, classes.where("rep IS NOT NULL"), words, Fraction(percent, 100), block, rows * bands)
    nodes = connected_components(links)
    reps = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    labels = reps.join(nodes, reps["rep"] == nodes["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    linked = full.join(labels, "set_key").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(documents: DataFrame, **how: int) -> DataFrame:
    """The rows of ``documents`` but those that are near a document with a smaller id.

    Rows of one doc_id stay or go together; rows without an id stay.
    """
    found = near_duplicates(documents, **how)
    gone = checkpointed(found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return documents.join(gone, documents["doc_id"] == gone["gone_id"], "left_anti")
