"""Fill-in-the-middle transformation of whole texts, and its inversion, on ropes.

A text becomes a balanced tree of leaves of at most ``LEAF`` code points; every node caches
how many units begin in it and how many code points it has. A unit is white space with the
word behind it, or the white space at the end. The tree is split at two unit ranks, and
prefix, middle and suffix are put together again with sentinels between them. The inversion
makes a tree of the output, splits it at the sentinels by code points, and joins the parts.
Splits and joins touch a path of the tree; no text is copied but in the leaves at a cut.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix,
prefix, middle). Ranks and form come from the digest of ``seed:doc_id``, so that a row's
result does not depend on other rows, on partitions or on retries.

Edge cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays
plain (the inversion would be ambiguous); a null doc_id hashes as no digits; rows of one
doc_id are cut at ranks of the same digest, each of its own text; a text of one unit, or of
white space alone, has empty parts; an empty table gives no rows. Other columns are not
read by ``transform`` and are kept by ``restore``; a column ``restored`` is replaced. An
output that is null or lacks its form's sentinels restores to null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from turnweave.llm.common import bound_batches

#: Code points of a leaf, at most.
LEAF = 2048
SPACE = "\x20\x09-\x0d"
_BEGINS = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
_IS_SPACE = re.compile(f"[{SPACE}]").match


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Rope:
    """A leaf with a text, or a node with two subtrees; both with cached counts."""

    __slots__ = ("left", "right", "text", "before", "units", "chars", "height")

    def __init__(self, left=None, right=None, text="", before=None):
        self.left, self.right, self.text, self.before = left, right, text, before
        if left is None:
            #: ``before``: the character before the leaf in its text, "" at the beginning, None where units don't count.
            self.units = len(_begins(text, before))
            self.chars, self.height = len(text), 0
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
            self.height = 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def _begins(text: str, before: str | None) -> list[int]:
    """Where units begin in a leaf: at white space behind a word, and at the beginning of the whole text."""
    if before is None or not text:
        return []
    found = [m.start() for m in _BEGINS.finditer(text)]
    first = not before or (_IS_SPACE(text) and not _IS_SPACE(before))
    return [0, *found] if first else found


def rope(text: str, units: bool = True) -> Rope:
    """A balanced tree of the text; without ``units`` only code points count."""

    def leaf(start: int) -> Rope:
        return Rope(text=text[start : start + LEAF], before=text[start - 1 : start] if units else None)

    level = [leaf(start) for start in range(0, len(text), LEAF)] or [Rope(before="" if units else None)]
    while len(level) > 1:
        pairs = [Rope(a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def joined(a: Rope, b: Rope) -> Rope:
    """One tree of two, balanced by height along the edge where they meet."""
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Rope(a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return Rope(Rope(a, b.left.left), Rope(b.left.right, b.right))
        return Rope(Rope(a, b.left), b.right)
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return Rope(Rope(a.left, a.right.left), Rope(a.right.right, b))
        return Rope(a.left, Rope(a.right, b))
    return Rope(a, b)


def split_at(node: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The tree before and from the place where ``rank`` units (or chars) are behind; ``by``: units or chars."""
    if node.left is not None:
        own = getattr(node.left, by)
        if rank < own:
            a, b = split_at(node.left, rank, by)
            return a, joined(b, node.right)
        a, b = split_at(node.right, rank - own, by)
        return joined(node.left, a), b
    if rank >= getattr(node, by):
        return node, Rope(before=node.before)
    at = _begins(node.text, node.before)[rank] if by == "units" else rank
    before = None if node.before is None else node.text[at - 1 : at] or node.before
    return Rope(text=node.text[:at], before=node.before), Rope(text=node.text[at:], before=before)


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers below 2^32 that belong to a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, numbers: list[int], percent: int, spm_percent: int, marks: Sentinels) -> tuple:
    """(units, form, prefix code points, middle code points, output) of one text."""
    tree = rope(text)
    n = tree.units
    if not text or any(x in text for x in marks) or numbers[2] % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted(x % (n + 1) for x in numbers[:2])
    start, suffix = split_at(tree, high, "units")
    prefix, middle = split_at(start, low, "units")
    p, s, m = (Rope(text=x) for x in marks)
    form = "spm" if numbers[3] % 100 < spm_percent else "psm"
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = order[0]
    for part in order[1:]:
        out = joined(out, part)
    return n, form, prefix.chars, middle.chars, str(out)


def restored(output: str | None, form: str | None, marks: Sentinels) -> str | None:
    """The text of an output of ``rearranged``."""
    if output is None or form not in ("psm", "spm"):
        return output if form == "plain" else None
    first, second = (marks.suffix, marks.prefix) if form == "spm" else (marks.prefix, marks.suffix)
    at = output.find(second, len(first))
    end = output.find(marks.middle, at + len(second))
    if not output.startswith(first) or at < 0 or end < 0:
        return None
    rest, middle = split_at(rope(output, units=False), end, "chars")
    one, two = split_at(rest, at, "chars")
    one, two, middle = (split_at(part, len(mark), "chars")[1] for part, mark in ((one, first), (two, second), (middle, marks.middle)))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return str(joined(joined(prefix, middle), suffix))


def transform(documents: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every whole text.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rearranged(text.as_py() or "", draws(i, seed), percent, spm_percent, marks) for i, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            whole = [pa.array(x, kind) for x, kind in ((n, pa.int64()), (form, pa.string()), (prefix, pa.int64()), (middle, pa.int64()), (output, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *whole], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(made, schema)


def restore(transformed: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """``transformed`` with the text of each row, as column restored, from its output and form alone."""
    rows = transformed.drop("restored")
    output, form = rows.columns.index("output"), rows.columns.index("form")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored(o.as_py(), f.as_py(), marks) for o, f in zip(batch.column(output), batch.column(form))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    bound_batches(rows)
    return rows.mapInArrow(back, StructType([*rows.schema.fields]).add("restored", StringType()))
