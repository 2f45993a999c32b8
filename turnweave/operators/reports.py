"""Aggregates of evaluated dialogues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnweave.functions.text import compact
from turnweave.operators.passages import Passages
from turnweave.sources.shared import bound_batches, stored, stored_with

COMPONENTS = ("total", "node_completion", "relation_score", "knowledge_score", "constraint_score")


def result_breakdown(records: DataFrame) -> DataFrame:
    """By domain and sample type: how many, how many of each result (passed, arbitrated, pending, failed), and the five mean scores."""
    count = lambda name: F.sum((F.col("result") == name).cast("int")).cast("bigint").alias(f"n_{name}")
    named = records.withColumn("domain", F.coalesce("domain", F.lit("未标注"))).withColumn("sample_type", F.coalesce("sample_type", F.lit("未标注")))
    means = [F.avg(c).alias(f"avg_{c}") for c in COMPONENTS]
    return named.groupBy("domain", "sample_type").agg(F.count("*").alias("n"), *map(count, ("passed", "arbitrated", "pending", "failed")), *means)


def breakdown(records: DataFrame) -> DataFrame:
    """Counts and averages by domain and sample type."""
    return records.groupBy("domain", "sample_type").agg(
        F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).cast("bigint").alias("n_passed"), F.avg("total").alias("avg_total"), F.min("total").alias("min_total"), F.max("total").alias("max_total")
    )


def score_gap(records: DataFrame, clear: float = 30.0, weak: float = 18.0) -> DataFrame:
    """Of each domain, the gap of the mean totals of positive and negative samples, and its band."""
    means = records.groupBy("domain").pivot("sample_type", ["positive", "negative"]).agg(F.avg("total"))
    gap = F.col("positive") - F.col("negative")
    band = F.when(gap >= clear, "clear").when(gap >= weak, "weak").otherwise("none")
    return means.select("domain", F.col("positive").alias("positive_mean"), F.col("negative").alias("negative_mean"), gap.alias("gap"), band.alias("band"))


def issue_families(events: DataFrame) -> DataFrame:
    """How many dialogues have each combination of families of issues."""
    combined = events.groupBy("dialogue_id").agg(F.array_join(F.array_sort(F.collect_set("family")), " + ").alias("families"))
    return combined.groupBy("families").agg(F.count("*").alias("n_dialogues"))


def rollup(records: DataFrame) -> DataFrame:
    """Counts and average totals by domain and sample type, with subtotals and the total."""
    out = records.rollup("domain", "sample_type").agg(F.count("*").alias("n"), F.avg("total").alias("avg_total"), F.grouping_id().cast("bigint").alias("level"))
    return out.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("sample_type", F.lit("*")).alias("sample_type"), "n", "avg_total", "level")


def usage(calls: DataFrame) -> DataFrame:
    """Tokens by purpose, and in all."""
    out = calls.rollup("purpose").agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return out.withColumn("purpose", F.coalesce("purpose", F.lit("total")))


#: Passages of this number at most are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Passages of fewer characters are found in the texts themselves, so many at a time: their grams are in too many texts to be keys.
SHORT, HELD_AT_ONCE = 40, 400_000
#: Others: characters of a gram, and grams of a window of which the least hash is kept. A text that holds such a passage holds a whole
#: window of it. Long passages have few keys, and their texts too.
LONG_GRAM, WINDOW = 9, 32
#: Characters of a gram; words of a run of passages with spaces.
GRAM, RUN = 5, 3


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def grams(text: Column, n: int = GRAM) -> Column:
    """The hashes of a text's runs of n characters, in order."""

    def joined(letters: Column) -> Column:
        # Shifted arrays are zipped: to cut each run from the text would be to count its characters each time.
        m = F.greatest(F.size(letters) - (n - 1), F.lit(0))
        runs = F.slice(letters, F.lit(1), m)
        for k in range(1, n):
            runs = F.zip_with(runs, F.slice(letters, F.lit(k + 1), m), lambda x, y: F.concat(x, y))
        return F.transform(runs, lambda x: F.xxhash64(x))

    return _with(F.filter(F.split(text, ""), lambda x: x != ""), joined)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_runs(words: Column, n: int = RUN) -> Column:
    """The hashes of the runs of n words."""

    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return _with(words, made)


def winnowed(hashes: Column, window: int) -> Column:
    """The least hash of each window (a power of two) of consecutive ones, each once; of fewer than a window none."""

    def halved(h: Column, k: int) -> Column:
        """Of windows of k the least, from those of half of it."""
        rest = F.greatest(F.size(h) - k // 2, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(k // 2 + 1), rest), lambda x, y: F.least(x, y))

    out, k = hashes, 2
    while k <= window:
        out = _with(out, partial(halved, k=k))
        k *= 2
    return F.array_distinct(out)


def _held(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, body) that hold one of ``passages`` (item_id, passage), by a pass over the texts where they are."""
    listed = passages.select("passage", "item_id").toArrow()
    column = lambda name: pa.concat_arrays(listed[name].chunks) if listed[name].chunks else pa.array([], listed[name].type)
    shared = documents.sparkSession.sparkContext.broadcast(Passages(column("passage"), column("item_id")))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, items in shared.value.rows(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids, items], names=["doc_id", "item_id"])

    bound_batches(documents)
    schema = StructType([documents.schema["doc_id"], passages.schema["item_id"]])
    return documents.select("doc_id", "body").mapInArrow(met, schema)


def leaks(documents: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage, in any script; one row a document's row and passage's row.

    Short passages are found in one pass over the texts, for so many of them at a time that a task can have them all. Of the others,
    a text that holds a passage with spaces holds its inner words (all but the first and last, which may be parts of words there) as
    words; with three of these they meet by the hash of three neighbours, which are fewer than characters. Other passages, as of scripts
    without spaces, meet by winnowing: of each window of neighbouring character grams the least hash is a key, so that a text that
    holds a passage with a window has that window's key. Keys meet without the texts; a text is fetched once for each document that met
    a passage, and compared.
    """
    known = passages.select("item_id", F.col("text").alias("passage")).where("passage <> ''").withColumn("p", F.monotonically_increasing_id())
    short = F.length("passage") < SHORT
    words = _words(F.col("passage"))
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2))
    wordy = ~short & (F.size(words) >= RUN + 2)
    plain = ~short & ~wordy
    known, seen = stored_with(known, F.count("*").alias("n"), F.count(F.when(short, 1)).alias("n_short"), F.max(wordy).alias("wordy"), F.max(plain).alias("plain"))
    if not seen["n"]:
        return documents.limit(0).select("doc_id").join(known.limit(0).select("item_id"), F.lit(True))
    parts = -(-seen["n_short"] // HELD_AT_ONCE)
    own = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"))
    if parts > 1 or seen["n_short"] < seen["n"]:
        own = stored(own.withColumn("d", F.monotonically_increasing_id()))
    # Their number grows with the passages: what is held at once is bounded, for the driver too.
    out = [_held(own, known.where(short & (F.pmod(F.xxhash64("p"), F.lit(parts)) == k))) for k in range(parts)]
    small = F.broadcast if seen["n"] <= MAX_BROADCAST else (lambda x: x)
    body, met = F.col("body"), None
    # One of a passage's keys is enough. The rarest is not known; the least hash is as good as any.
    asked = [(plain, winnowed(grams(F.col("passage"), LONG_GRAM), WINDOW), winnowed(grams(body, LONG_GRAM), WINDOW))] if seen["plain"] else []
    asked += [(wordy, word_runs(inner), word_runs(_words(body)))] if seen["wordy"] else []
    for which, of_passage, of_body in asked:
        keyed = known.where(which).select("p", F.array_min(of_passage).alias("key"))
        each = own.select("d", F.explode_outer(F.array_distinct(of_body)).alias("key")).where("key IS NOT NULL")
        pairs = each.join(small(keyed), "key").select("d", "p")
        met = pairs if met is None else met.unionByName(pairs)
    if met is not None:
        by_document = met.groupBy("d").agg(F.collect_set("p").alias("ps"))
        texts = own.join(by_document, "d").select("doc_id", "body", F.explode("ps").alias("p"))
        out.append(texts.join(small(known), "p").where(F.contains("body", F.col("passage"))).select("doc_id", "item_id"))
    return reduce(DataFrame.unionByName, out)


def span_leaks(spans: DataFrame, patterns: DataFrame, least: int = 6) -> DataFrame:
    """(span, pattern) of label spans of ``least`` compact characters or more that a graph's pattern texts hold: answers in the rules.

    ``spans``: span; ``patterns``: pattern; both are compared in their compact form, each once.
    """
    wanted = spans.select(compact("span").alias("item_id")).where(F.length("item_id") >= least).distinct().withColumn("text", F.col("item_id"))
    texts = patterns.select(compact("pattern").alias("doc_id")).distinct().withColumn("text", F.col("doc_id"))
    return leaks(texts, wanted).select(F.col("item_id").alias("span"), F.col("doc_id").alias("pattern"))
