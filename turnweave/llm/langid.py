"""Language identification by bit-sliced Bloom filters of character n-grams.

All languages' filters have one size and one set of hash functions and are stored bit
by bit: row r of the table holds, as a mask of languages, the bit r of every filter. The
AND of an n-gram's rows is the mask of all languages that contain it. A filter holds the
n-grams that some part of its language's texts have (``ONE_IN``), so that what a few texts
have, such as those with a wrong label, fills no filter, however many texts there are. A text's n-grams are counted per language, those of
several languages as an equal part for each; the share is corrected for the language's
rate of false positives (fill ** hashes), and the highest corrected share decides.

The model is learned from labelled documents only, from all of them and their whole texts.
N-grams of letters with one space at word bounds, lower-cased. Where the texts are read,
their n-grams are counted; what reaches the driver is the table, of 2 ** ``BITS`` rows.

``keep_identified`` rejects texts that are in none of the learned languages: those whose
share of n-grams in the best filter is below a floor, beyond doubt (``DOUBT`` standard
deviations of a share of so many n-grams, so that short texts stay). The floor is ``FLOOR``
of the median share of labelled texts that were kept aside from the filters.

Edge cases: a null text or one without any letter is ``und`` with score 0, and so is
every text if nothing was learned; ties go to the language that sorts first; labels
that are null teach nothing; more than ``MAX_LANGUAGES`` languages are refused. Texts with
no known n-gram get the first of the languages, score 0. Rows that repeat an id teach
too, rows without an id do not. Repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches, stored

UNKNOWN = "und"
#: An n-gram is in a language's filter if one in so many of its texts has it; more languages are refused.
ONE_IN, MAX_LANGUAGES = 250, 64
#: Bits of a filter, as a power of two; hash functions; characters of an n-gram.
BITS, HASHES, N = 18, 2, 4
#: One in so many texts is kept aside for the floor; the floor's part of the median share; deviations; steps in which shares are counted.
ASIDE, FLOOR, DOUBT, STEPS = 5, 0.5, 4.0, 10_000
#: N-grams of texts that a task merges at once, and counts that it holds; merging needs a few times their memory in each Python worker.
COUNTED_AT_ONCE = 1 << 19

_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_hashes(text: str, n: int = N) -> np.ndarray:
    """A 32-bit hash of every n-gram of the text's letters; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other characters, one space
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    if len(points) < n:
        points = np.pad(points, (0, n - len(points)), constant_values=32)
    size = len(points) - n + 1
    hashes = points[:size] * _STEPS[0]
    for i in range(1, n):
        hashes += points[i : i + size] * _STEPS[i]
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x2C1B3C6D)
    hashes ^= hashes >> np.uint32(13)
    return hashes


class LanguageFilters:
    """``rows``: for each bit position the mask of the languages whose filter has it set."""

    def __init__(self, languages: list[str], rows: np.ndarray, hashes: int = HASHES, n: int = N) -> None:
        self.languages, self.rows, self.hashes, self.n = languages, rows, hashes, n
        self.floor = 0.0
        fill = np.array([((rows >> rows.dtype.type(k)) & rows.dtype.type(1)).mean() for k in range(len(languages))])
        self.false = fill**hashes
        if len(languages) <= 8:
            of_mask = (np.arange(256)[:, None] >> np.arange(len(languages))) & 1
            self.of_mask = of_mask / np.maximum(1, of_mask.sum(axis=1, keepdims=True))

    @classmethod
    def of_rows(cls, languages: list[str], places: np.ndarray, masks: np.ndarray, bits: int = BITS, hashes: int = HASHES, n: int = N) -> LanguageFilters:
        """From the rows of the table that are not 0."""
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        rows = np.zeros(1 << bits, np.uint64)
        np.bitwise_or.at(rows, places, masks.astype(np.uint64))
        return cls(languages, rows.astype(np.uint8) if len(languages) <= 8 else rows, hashes, n)

    @classmethod
    def learn(cls, texts: dict[str, list[str]], bits: int = BITS, hashes: int = HASHES, n: int = N) -> LanguageFilters:
        """From texts by language: each filter holds all n-grams of its language's texts."""
        languages = sorted(texts)
        found = [(set_rows(text, bits, hashes, n), k) for k, language in enumerate(languages) for text in texts[language]]
        places = np.concatenate([np.empty(0, np.int64), *(x for x, _ in found)])
        masks = np.concatenate([np.empty(0, np.uint64), *(np.full(len(x), 1 << min(k, 63), np.uint64) for x, k in found)])
        return cls.of_rows(languages, places, masks, bits, hashes, n)

    @staticmethod
    def places(grams: np.ndarray, i: int, bits: int) -> np.ndarray:
        """Where the i-th hash function puts n-grams."""
        return (grams * _STEPS[i]) >> np.uint32(32 - bits)

    def shares(self, text: str) -> np.ndarray | None:
        """Of the text's n-grams, each language's share without false positives; None without letters."""
        grams = gram_hashes(text, self.n)
        if not len(grams):
            return None
        bits = len(self.rows).bit_length() - 1
        masks = self.rows[self.places(grams, 0, bits)]
        for i in range(1, self.hashes):
            masks &= self.rows[self.places(grams, i, bits)]
        if len(self.languages) <= 8:
            counts = np.bincount(masks, minlength=256) @ self.of_mask
        else:
            part = 1 / np.maximum(1, np.bitwise_count(masks))
            counts = np.array([part @ ((masks >> np.uint64(k)) & np.uint64(1)) for k in range(len(self.languages))])
        share = counts / len(grams)
        return np.clip((share - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)

    def known(self, text: str) -> tuple[float, int]:
        """The share of the text's n-grams in the filter that holds most of them, without false positives, and their number."""
        grams = gram_hashes(text, self.n)
        if not len(grams) or not self.languages:
            return 0.0, len(grams)
        bits = len(self.rows).bit_length() - 1
        masks = self.rows[self.places(grams, 0, bits)]
        for i in range(1, self.hashes):
            masks &= self.rows[self.places(grams, i, bits)]
        kind = masks.dtype.type
        held = np.array([((masks >> kind(k)) & kind(1)).mean() for k in range(len(self.languages))])
        return float(np.clip((held - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1).max()), len(grams)

    def foreign(self, text: str) -> bool:
        """Whether a text is in none of the languages, beyond doubt."""
        share, n = self.known(text)
        return n > 0 and share + DOUBT * (self.floor * (1 - self.floor) / n) ** 0.5 < self.floor

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the winner's part of all languages' shares."""
        share = self.shares(text) if text and self.languages else None
        if share is None:
            return UNKNOWN, 0.0
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share[best] > 0 else 0.0


def set_rows(text: str, bits: int = BITS, hashes: int = HASHES, n: int = N) -> np.ndarray:
    """The rows of the table in which a text's n-grams set a bit."""
    grams = np.unique(gram_hashes(text, n))
    return np.unique(np.concatenate([LanguageFilters.places(grams, i, bits) for i in range(hashes)])).astype(np.int64)


def _count_grams(documents: DataFrame, languages: list[str]) -> DataFrame:
    """(language, gram, n): in how many of the texts (lang, text) of each language, by number, an n-gram is; gram -1: of how many texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def merge() -> None:
            for k, parts in waiting.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                if k in held:
                    grams, at = np.unique(np.concatenate([held[k][0], grams]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[k][1], n])).astype(np.int64)
                held[k] = grams, n
            waiting.clear()

        def emit() -> Iterator[pa.RecordBatch]:
            for k, (grams, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams), pa.array(n, pa.int64())], names=["language", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.append(np.unique(gram_hashes(text.as_py() or "")).astype(np.int64), -1)
                waiting.setdefault(languages.index(language), []).append(grams)
                size += len(grams)
                if size > COUNTED_AT_ONCE:
                    merge()
                    size = 0
                    # Counts of parts are summed where they meet: a task need not hold all of its n-grams.
                    if sum(len(grams) for grams, _ in held.values()) > COUNTED_AT_ONCE:
                        yield from emit()
        merge()
        yield from emit()

    bound_batches(documents)
    return documents.select("lang", "text").mapInArrow(counted, "language int, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn_filters(documents: DataFrame, held_out: Column, one_in: int = ONE_IN, with_floor: bool = False) -> LanguageFilters:
    """Filters of the languages of the labelled documents that are not held out.

    A filter holds the n-grams that are in one in ``one_in`` or more of all texts of its language; of up to so many texts all. What
    comes from the texts are counts by n-gram. ``with_floor``: one in ``ASIDE`` of the texts, by a hash of their ids, do not teach, but
    give the floor; one of each language teaches always.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).select("doc_id", "lang", F.col("text").cast("string"))
    place = F.xxhash64("lang", "doc_id")
    found = known.groupBy("lang").agg(F.min(place).alias("least")).limit(MAX_LANGUAGES + 1).collect()
    languages = sorted(row.lang for row in found)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return LanguageFilters.learn({})
    aside = (F.pmod(place, F.lit(ASIDE)) == 0) & ~place.isin([row.least for row in found]) if with_floor else F.lit(False)
    counts = stored(_count_grams(known.where(~aside), languages))
    texts = {row.language: row.n for row in counts.where("gram = -1").collect()}
    enough = F.element_at(F.array(*[F.lit(-(-texts.get(k, 0) // one_in)) for k in range(len(languages))]), F.col("language") + 1)

    def rows_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.uint64)
        for batch in batches:
            masks, grams = np.uint64(1) << batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy().astype(np.uint32)
            for i in range(HASHES):
                np.bitwise_or.at(table, LanguageFilters.places(grams, i, BITS), masks)
        places = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(table[places].view(np.int64), pa.int64())], names=["place", "mask"])

    taught = counts.where((F.col("gram") >= 0) & (F.col("n") >= enough)).select("language", "gram").mapInArrow(rows_set, "place bigint, mask bigint")
    rows = taught.groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    model = LanguageFilters.of_rows(languages, rows["place"].to_numpy(), rows["mask"].to_numpy().view(np.uint64))
    if with_floor:
        shared = documents.sparkSession.sparkContext.broadcast(model)

        def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = [round(shared.value.known(x.as_py() or "")[0] * STEPS) for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64())], names=["step"])

        # Shares are counted in steps, so that what is sorted is no more than the steps.
        seen = sorted((row.step, row["count"]) for row in known.where(aside).select("text").mapInArrow(shares, "step bigint").groupBy("step").count().collect())
        until = np.cumsum([n for _, n in seen])
        model.floor = FLOOR * seen[int(np.searchsorted(until, until[-1] / 2))][0] / STEPS if seen else 0.0
    return model


def predict_languages(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score; only ``text`` is an input of both predictions."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """The rows, with all their columns, of texts with a letter that are not foreign to all learned languages.

    If no language is known, all texts with a letter stay.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    at = documents.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(at)]
            yield batch.filter(pa.array([len(gram_hashes(x)) > 0 and not model.foreign(x) for x in texts], pa.bool_()))

    bound_batches(documents)
    return documents.mapInArrow(kept, documents.schema)


def crc_held_out(part: int = 2, parts: int = 4) -> Column:
    """Whether a document is held out: crc32 of its id as text, by remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))
