"""Removal of repeated runs of lines: suffixes of line-ID sequences by prefix doubling, and their LCP intervals.

A document is the sequence of its lines that are not blank (ends stripped). A run of
consecutive lines with ``min_words`` words at least that stands earlier in the corpus,
by (doc_id, place), is a later copy, and its lines are deleted; the first copy stays.

1. Lines get 128-bit IDs where they are read. Suffixes whose first line occurs once are
   unique and take no further part.
2. Prefix doubling, up: the rank of the 2**(k+1) lines at a place is that of the pair of
   ranks of 2**k lines at it and behind it. Ranks follow the order of line IDs; those
   that only one suffix has are dropped, and the rounds end when none is left, after the
   logarithm of the longest repeat.
3. LCP intervals, down: all suffixes begin in one interval of length 0. From the longest
   step to that of one line, the suffixes of an interval that go on with the same rank of
   2**k lines are a new interval, 2**k lines longer; its first suffix stays behind in the
   old one, for all of it. In the end the suffixes of an interval share as many lines as
   it is long and no two of them more, as in the suffix tree: the intervals are the
   maximal repeated runs, with their number of copies.
4. A suffix that is not the first of its interval is a later copy of that run. Of the runs
   of a document those inside a longer one are left out, and those with too few words.

Each round reads what the round before stored. Keys are aggregated before they are joined
back, and keys with many rows are dealt to many tasks (``join_counted``); no step needs a
group in one task. A document's own lines are handled together.

Edge cases: null and empty texts and those of blank lines only have no lines and stay
as they are; if every line of a text is deleted, the text is empty; blank lines are
kept otherwise; copies inside a document count, also overlapping ones; rows with the
same doc_id and text are one document and get the same result; a null doc_id comes
first in the order. All other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches, join_counted, stored, stored_with

MIN_WORDS = 4


def text_lines(text: str) -> list[str]:
    """The lines of a text that are not blank, without white space at their ends."""
    return [x for x in (line.strip() for line in text.split("\n")) if x]


def _line_table(keyed: DataFrame, kind: str) -> DataFrame:
    """doc_id, doc_key, at and line (128-bit ID) of every line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            of, at, ids = [], [], []
            for k, text in enumerate(batch.column(2)):
                for i, line in enumerate(text_lines(text.as_py() or "")):
                    of.append(k)
                    at.append(i)
                    ids.append(digest(line.encode("utf-8", "surrogatepass")))
            row = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(at, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "doc_key", "at", "line"])

    return keyed.select("doc_id", "doc_key", "text").mapInArrow(lines, f"doc_id {kind}, doc_key bigint, at int, line binary")


_PLACE = ["doc_id", "doc_key", "at"]
_SPREAD = ["doc_key", "at"]


def _by_document() -> WindowSpec:
    return Window.partitionBy("doc_id", "doc_key").orderBy("at")


def _ranked(groups: DataFrame, by: list[str], name: str) -> tuple[DataFrame, int, tuple[int, int]]:
    """Groups of two rows or more, stored with their rank; their number, that of all their rows and of the largest's."""
    ranked = groups.where("n > 1").orderBy(*by).withColumn(name, F.monotonically_increasing_id() + 1)
    out, seen = stored_with(ranked, F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    return out, seen["groups"], (seen["rows"] or 0, seen["most"] or 0)


def _repeated_lines(lines: DataFrame) -> DataFrame:
    """The places of lines that occur more than once: rank, and left: the number of such lines in a row from there."""
    classes, _, sizes = _ranked(lines.groupBy("line").agg(F.count("*").alias("n")), ["line"], "rank")
    places = join_counted(lines, classes, ["line"], _SPREAD, *sizes).where("rank IS NOT NULL").select(*_PLACE, "rank")
    once = places.repartition("doc_id", "doc_key").dropDuplicates(_PLACE)
    runs = once.withColumn("run", F.col("at") - F.row_number().over(_by_document()))
    left = F.row_number().over(Window.partitionBy("doc_id", "doc_key", "run").orderBy(F.col("at").desc()))
    return stored(runs.withColumn("left", left).drop("run"))


def _doubled(places: DataFrame, k: int) -> tuple[DataFrame, int]:
    """``places`` with longer: the rank of the 2**(k+1) lines there, null if only this suffix begins with them; and the number of ranks."""
    step = 1 << k
    behind = F.when((F.col("left") >= 2 * step) & (F.lead("at", step).over(_by_document()) == F.col("at") + step), F.lead("rank", step).over(_by_document()))
    paired = places.withColumn("behind", behind)
    pairs = paired.where("behind IS NOT NULL").groupBy("rank", "behind").agg(F.count("*").alias("n"))
    classes, n, sizes = _ranked(pairs, ["rank", "behind"], "longer")
    if not n:
        return places.withColumn("longer", F.lit(None).cast("bigint")), 0
    joined = join_counted(paired, classes, ["rank", "behind"], _SPREAD, *sizes)
    return stored(joined.select(*_PLACE, "rank", "left", "longer")), n


def _levels(places: DataFrame) -> list[DataFrame]:
    """By k: the places whose 2**k lines are repeated, with their rank and that of twice as many lines."""
    found = []
    while True:
        level, n = _doubled(places, len(found))
        found.append(level)
        if not n:
            return found
        places = level.where("longer IS NOT NULL").select(*_PLACE, F.col("longer").alias("rank"), "left")


def _same_place(a: str, b: str) -> Column:
    return (F.col(f"{a}doc_key") == F.col(f"{b}doc_key")) & (F.col(f"{a}at") == F.col(f"{b}at")) & F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id"))


_ROW = [*_PLACE, "left", "size", "level", "node", "weight", "own", "copies"]


def _intervals(levels: list[DataFrame]) -> list[DataFrame]:
    """The rows of the LCP intervals, a stored table a round: place, left, size of the interval, level and node (its
    name), weight (suffixes the row stands for), own (whether it is the first of its interval), copies (all of its suffixes)."""
    found: list[DataFrame] = []
    rows = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        new = [F.lit(0).alias("size"), F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("weight"), F.lit(True).alias("own"), F.lit(0).cast("bigint").alias("copies")]
        asked = level.where("longer IS NULL").select(*_PLACE, "left", *new, "rank")
        if rows is not None:
            there = level.select(F.col("doc_id").alias("t_doc_id"), F.col("doc_key").alias("t_doc_key"), F.col("at").alias("t_at"), "rank")
            behind = (F.col("doc_key") == F.col("t_doc_key")) & (F.col("at") + F.col("size") == F.col("t_at")) & F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
            asked = asked.unionByName(rows.join(there, behind, "left").select(*_ROW, "rank"))
        key = ["level", "node", "rank"]
        first = F.min(F.struct(*_PLACE, "left", "own", "copies")).alias("first")
        groups = asked.where("rank IS NOT NULL").groupBy(*key).agg(F.count("*").alias("n"), F.sum("weight").alias("all"), F.first("size").alias("old"), first)
        groups, n, sizes = _ranked(groups, key, "name")
        longer = F.col("name").isNotNull()
        moved = join_counted(asked, groups, key, _SPREAD, *sizes) if n else asked.withColumns({x: F.lit(None) for x in ("name", "all", "first")})
        into = {
            "size": F.when(longer, F.col("size") + (1 << k)).otherwise(F.col("size")),
            "level": F.when(longer, F.lit(k)).otherwise(F.col("level")),
            "node": F.when(longer, F.col("name")).otherwise(F.col("node")),
            "own": F.when(longer, _same_place("", "first.")).otherwise(F.col("own")) if n else F.col("own"),
            "copies": F.when(longer, F.col("all")).otherwise(F.col("copies")),
        }
        after = moved.select(*[into.get(c, F.col(c)).alias(c) for c in _ROW])
        if n:
            left_behind = groups.select("first.*", F.col("old").alias("size"), "level", "node", F.col("all").alias("weight"))
            after = after.unionByName(left_behind.select(*_ROW))
        after = stored(after)
        found.append(after.where("size = left") if k else after)
        rows = after.where("size < left")
    return found


def later_copies(documents: DataFrame) -> DataFrame:
    """doc_id, doc_key (a hash of doc_id and text), at, size, copies: the runs of lines, not counting blank ones, that
    stand earlier in the corpus, as long as they go, and how many copies of them there are in all."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    lines = _line_table(documents.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), F.col("text").cast("string")), kind)
    tables = _intervals(_levels(_repeated_lines(lines)))
    runs = tables[0]
    for table in tables[1:]:
        runs = runs.unionByName(table)
    runs = runs.where("size > 0 AND NOT own").select(*_PLACE, "size", "copies")
    before = F.coalesce(F.when(F.lag("at").over(_by_document()) == F.col("at") - 1, F.lag("size").over(_by_document())), F.lit(0))
    return runs.withColumn("before", before).where("before <= size").drop("before")


def deleted_lines(text: str, runs: list[tuple[int, int]], min_words: int) -> set[int]:
    """The numbers of the lines in those of the runs (at, size) that have enough words."""
    words = [0, *accumulate(len(line.split()) for line in text_lines(text))] if runs else []
    return {i for at, size in runs if words[at + size] - words[at] >= min_words for i in range(at, at + size)}


def delete_lines(text: str | None, deleted: set[int]) -> str | None:
    """The text without these of its lines that are not blank."""
    if not text or not deleted:
        return text
    kept, at, left = [], 0, False
    for line in text.split("\n"):
        if line.strip():
            if at not in deleted:
                kept.append(line)
                left = True
            at += 1
        else:
            kept.append(line)
    return "\n".join(kept) if left else ""


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, counts: bool = True, keep_empty: bool = True) -> DataFrame:
    """``documents`` with ``text`` without later copies.

    counts: two more columns behind, n_lines and n_deleted, in place of such columns of
    the input. keep_empty: also the rows all of whose lines were deleted.
    """
    bound_batches(documents)
    names = documents.columns
    own = [f"c{i}" for i in range(len(names))]
    doc, at = own[names.index("doc_id")], names.index("text")
    keyed = documents.toDF(*own).withColumn("doc_key", F.xxhash64(doc, own[at]))
    found = later_copies(documents).groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("at", "size")).alias("runs"))
    joined = keyed.join(found, (keyed["doc_key"] == found["doc_key"]) & keyed[doc].eqNullSafe(found["doc_id"]), "left")
    joined = joined.select(*own, found["runs"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_deleted = [], [], []
            for value, runs in zip(batch.column(at), batch.column(len(own)), strict=True):
                value = value.as_py()
                gone = deleted_lines(value or "", [(x["at"], x["size"]) for x in runs.as_py() or ()], min_words)
                texts.append(delete_lines(value, gone))
                n_lines.append(len(text_lines(value or "")))
                n_deleted.append(len(gone))
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(own)]]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())]
            whole = pa.RecordBatch.from_arrays(columns, names=[*own, "n_lines", "n_deleted"])
            yield whole if keep_empty else whole.filter(pa.array([d == 0 or d < n for n, d in zip(n_lines, n_deleted, strict=True)], pa.bool_()))

    fields = [f"{x} {f.dataType.simpleString()}" for x, f in zip(own, documents.schema.fields, strict=True)]
    result = joined.mapInArrow(cleaned, ", ".join([*fields, "n_lines bigint", "n_deleted bigint"]))
    more = ["n_lines", "n_deleted"] if counts else []
    return result.select(*[F.col(c).alias(x) for c, x in zip(own, names, strict=True) if x not in more], *more)
