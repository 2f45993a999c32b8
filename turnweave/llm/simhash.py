"""SimHash fingerprints and search in a Hamming radius; DataFrame operations only.

A text's terms are its runs of ``WORDS`` words (runs of letters, marks and digits,
lower-cased; a shorter text is one term). Every occurrence votes, so that a term's weight
is its frequency. A bit of the fingerprint is set if more than half of the votes have it
in their 64-bit hash. Votes are summed by aggregation over exploded hashes, two bits in
one 64-bit sum. The likeness of two fingerprints is 1 minus their share of differing bits.

The search cuts fingerprints into ``radius + MATCH`` blocks. Two fingerprints within the
radius agree in MATCH of them at least, and so meet in one of the tables, which are keyed
by every choice of MATCH blocks, permuted to the front. Equal fingerprints are one entry.

Documents are dealt by ranges of doc_id for what needs the next one. The ranges come from
approximate quantiles, their number is bounded, and each range gets a copy of the first
document of the range below it.

Edge cases: a null text counts as empty; a text without words has the fingerprint 0; rows
of one doc_id are ordered by a hash of their text; a null doc_id is the smallest; a single
document is its own next; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import stored

WORDS, BITS = 2, 64
#: Blocks that have to agree in a table's key.
MATCH = 3
#: Documents in a range, and the most ranges.
RANGE_ROWS, MAX_RANGES = 400, 16_384

_SMALLEST = -(2**63)


def _terms(words_column: str, words: int) -> Column:
    """The hashes of the terms of a text, from the array of its words."""
    w = F.col(words_column)
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(words)]))
    return F.when(F.size(w) >= words, runs).when(F.size(w) > 0, F.array(F.xxhash64(w)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def with_fingerprints(texts: DataFrame, text: str, keys: list[str], words: int = WORDS) -> DataFrame:
    """``keys`` and fingerprint (bigint) of each group of equal keys; ``text``: the column of its one text.

    If ``texts`` are dealt by some of the keys already, nothing is shuffled.
    """
    one, half = F.lit(1).cast("bigint"), BITS // 2
    cut = texts.select(*keys, _words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    votes = cut.select(*keys, F.explode_outer(_terms("_words", words)).alias("_h"))
    h = F.col("_h")
    both = [F.shiftright(h, i).bitwiseAND(one) + F.shiftleft(F.shiftright(h, i + half).bitwiseAND(one), 32) for i in range(half)]
    summed = votes.groupBy(*keys).agg(F.count("_h").alias("_n"), *[F.sum(x).alias(f"_v{i}") for i, x in enumerate(both)])
    bits = F.lit(0).cast("bigint")
    for i in range(half):
        low, high = F.col(f"_v{i}").bitwiseAND(F.lit(2**32 - 1)), F.shiftright(F.col(f"_v{i}"), 32)
        bits = bits.bitwiseOR(F.when(2 * low > F.col("_n"), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0)))
        top = (1 << (i + half)) - (1 << 64 if i + half == 63 else 0)
        bits = bits.bitwiseOR(F.when(2 * high > F.col("_n"), F.lit(top).cast("bigint")).otherwise(F.lit(0)))
    return summed.select(*keys, bits.alias("fingerprint"))


def distance(a: Column | str, b: Column | str) -> Column:
    """The number of differing bits of two fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column | str, b: Column | str) -> Column:
    return (1 - distance(a, b) / F.lit(float(BITS))).cast("double")


def within_radius(fingerprints: DataFrame, radius: int = 3, match: int = MATCH) -> DataFrame:
    """(a, b, distance) of all pairs a < b of different fingerprints within the radius.

    ``fingerprints`` has a column fingerprint (bigint); nulls are ignored, equal ones are one.
    """
    blocks = radius + match
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
    one = fingerprints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    tables = []
    for k, chosen in enumerate(combinations(range(blocks), match)):
        mask = sum(masks[i] for i in chosen)
        tables.append(F.struct(F.lit(k).alias("place"), F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64 if mask >> 63 else 0)).cast("bigint")).alias("key")))
    dealt = one.select("fingerprint", F.inline(F.array(*tables)))
    a, b = dealt.alias("a"), dealt.alias("b")
    met = (F.col("a.place") == F.col("b.place")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fingerprint") < F.col("b.fingerprint"))
    near = distance("a.fingerprint", "b.fingerprint")
    pairs = a.join(b, met & (near <= radius)).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"), near.alias("distance"))
    return pairs.distinct()


def _ranges(documents: DataFrame) -> tuple[DataFrame, int]:
    """``documents`` with the number of the range of their ids."""
    n = documents.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    splits: list[int] = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        accuracy = max(10_000, 4 * ranges)
        splits = sorted(set(documents.agg(F.percentile_approx("_k", at, accuracy)).first()[0]))
    # Of the bounds, how many are not above: by halving steps over the constant array.
    number = F.lit(0)
    if splits:
        steps = [1 << i for i in range(len(splits).bit_length() - 1, -1, -1)]
        constant = F.array(*[F.lit(x) for x in splits])
        number = F.aggregate(
            F.array(*[F.lit(x) for x in steps]),
            F.lit(0),
            lambda low, step: F.when((low + step <= len(splits)) & (F.get(constant, low + step - 1) <= F.col("_k")), low + step).otherwise(low),
        )
    return documents.withColumn("_range", number), len(splits) + 1


def with_next(documents: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (_range, _copy, _k, _tie, doc_id, text) in ranges of ids, and their order in a range.

    The next document is the one behind in this order; rows with _copy stand there for the range below.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_k", F.coalesce(F.col("doc_id"), F.lit(_SMALLEST)).cast("bigint"))
    placed, _ = _ranges(rows)
    placed = placed.withColumn("_tie", F.xxhash64("text"))
    # At most MAX_RANGES rows: the largest id of each range, and of the range below it or, at the end, of the top.
    tops = placed.groupBy("_range").agg(F.max("_k").alias("_top"))
    line = Window.partitionBy(F.lit(0)).orderBy("_range")
    everything = Window.partitionBy(F.lit(0))
    below = tops.select("_range", F.coalesce(F.lag("_top").over(line), F.max("_top").over(everything)).alias("_below"))
    below = F.broadcast(below.select(F.col("_range").alias("_to"), F.col("_below")))
    copies = placed.join(below, placed["_k"] == below["_below"]).select(F.col("_to").alias("_range"), F.lit(1).alias("_copy"), "_k", "_tie", "doc_id", "text")
    both = placed.select("_range", F.lit(0).alias("_copy"), "_k", "_tie", "doc_id", "text").unionByName(copies)
    return both, Window.partitionBy("_range").orderBy("_copy", F.col("_k").desc(), "_tie")


def edited_fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document by descending doc_id; after the last comes the first.
    """
    rows, order = with_next(documents)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce(F.lead("text").over(order), F.lit(""))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))
    keys = ["_range", "_copy", "_k", "_tie", "_place", "doc_id", "n_chars", "edited_sha256", "_which"]
    rows = rows.withColumn("_place", F.row_number().over(order)).withColumn("_next", following)
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("_edited", F.when(F.col("_copy") == 0, edited))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    bodies = F.array(F.struct(F.lit(0).alias("_which"), F.col("text").alias("_body")), F.struct(F.lit(1).alias("_which"), F.col("_edited").alias("_body")))
    bodies = F.when(F.col("_copy") == 0, bodies).otherwise(F.slice(bodies, 1, 1))
    texts = rows.select(*keys[:-1], F.inline(bodies))
    prints = with_fingerprints(texts, "_body", keys, words)
    at = lambda k: F.max(F.when(F.col("_which") == k, F.col("fingerprint"))).alias(f"_f{k}")
    whole = prints.groupBy(*keys[:-1]).agg(at(0), at(1))
    by_place = Window.partitionBy("_range").orderBy("_place")
    whole = whole.withColumn("_following", F.lead("_f0").over(by_place)).where("_copy = 0")
    text = lambda c: F.lpad(F.lower(F.hex(c)), BITS // 4, "0")
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("_f0").alias("fingerprint"),
        text("_f1").alias("edited_fingerprint"),
        likeness("_f0", "_f1").alias("near_edited"),
        likeness("_f0", "_following").alias("near_next"),
    )


def with_near(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprints``, of hexadecimal column fingerprint, and n_near: how many other fingerprints are within the radius of it."""
    rows = stored(fingerprints.withColumn("_f", F.conv("fingerprint", 16, -10).cast("bigint")))
    pairs = within_radius(rows.select(F.col("_f").alias("fingerprint")), radius)
    near = stored(pairs.select(F.explode(F.array("a", "b")).alias("_f")).groupBy("_f").agg(F.count("*").alias("n_near")))
    found = rows.join(near, "_f", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))
    return found.select(*fingerprints.columns, "n_near")
