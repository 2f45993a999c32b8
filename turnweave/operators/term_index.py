"""All terms of a catalogue found in a text in one pass.

An automaton over the terms runs in the tasks, batch by batch: a text is read once however many terms there are, and only the
numbers of the terms that it holds come back. Terms that may be met loosely, by their characters, are looked at where the text has
one of their rarest characters. The catalogue is metadata, whose size is bounded where it is compiled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from turnweave.functions.text import COMMON_LEAST, COMMON_SHARE, MAX_GAP

#: Rows of one Arrow batch; texts of turns are short.
BATCH = 2000


class Term(NamedTuple):
    """The forms of a term (``functions.text.term_form``); in_order: its characters may follow each other in small gaps."""

    tight: str
    rest: str
    chars: tuple[str, ...]
    exact: bool
    in_order: bool = False


def follows(term: str, text: str) -> bool:
    """Whether a term's characters follow each other in the text, each the next one of its kind, in small gaps."""
    at = 0
    for k, char in enumerate(term):
        found = text.find(char, at)
        if found < 0 or (k and at and found - at > MAX_GAP):
            return False
        at = found + 1
    return True


class TermIndex:
    """The automata of the compact terms and of those without fillers, and the rarest characters of loose ones."""

    def __init__(self, terms: Sequence[Term]):
        self.terms = terms
        self.tight, self.rest = self._automaton([t.tight for t in terms]), self._automaton([t.rest for t in terms])
        often = Counter(c for t in terms for c in t.chars)
        self.loose: dict[str, list[int]] = {}
        self.ordered: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            rare = sorted(t.chars, key=lambda c: (often[c], c))
            # A text with nine tenths of the characters has one of the rarest tenth and one more.
            for c in rare[: len(rare) // 10 + 1] if not t.exact else ():
                self.loose.setdefault(c, []).append(i)
            if t.in_order and rare:
                self.ordered.setdefault(rare[0], []).append(i)

    @staticmethod
    def _automaton(words: list[str]):
        by_word: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            if word:
                by_word.setdefault(word, []).append(i)
        made = ahocorasick.Automaton()
        for word, numbers in by_word.items():
            made.add_word(word, tuple(numbers))
        made.make_automaton()
        return made if by_word else None

    def marks(self, tight: str, rest: str, ordered: bool = False) -> list[int]:
        """The numbers of the terms that a text expresses, ascending; ``tight`` and ``rest``: the text's forms."""
        if not tight:
            return []
        found: set[int] = set()
        for made, text in ((self.tight, tight), (self.rest, rest)):
            if made is not None and text:
                for _, numbers in made.iter(text):
                    found.update(numbers)
        # A term without a compact form expresses nothing, whatever is left of it.
        if self.loose or (ordered and self.ordered):
            own = set(tight)
            for c in own:
                for i in self.loose.get(c, ()):
                    if i not in found:
                        chars = self.terms[i].chars
                        common = sum(x in own for x in chars)
                        if common >= COMMON_LEAST and common / len(chars) >= COMMON_SHARE:
                            found.add(i)
                for i in self.ordered.get(c, ()) if ordered else ():
                    if i not in found and follows(self.terms[i].tight, tight):
                        found.add(i)
        return sorted(found)


def mark_terms(texts: DataFrame, terms: Sequence[Term], ordered: bool = False) -> DataFrame:
    """``texts`` with marks (array<int>), the numbers of the terms found, in place of its column form (``functions.text.form``)."""
    kept = [c for c in texts.columns if c != "form"]
    listed = [tuple(t) for t in terms]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex([Term(*t) for t in listed])
        for batch in batches:
            *own, tight, rest = batch.columns
            for start in range(0, batch.num_rows, BATCH):
                part = [c.slice(start, BATCH) for c in own]
                found = [index.marks(a or "", b or "", ordered) for a, b in zip(tight.slice(start, BATCH).to_pylist(), rest.slice(start, BATCH).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part, pa.array(found, pa.list_(pa.int32()))], names=[*kept, "marks"])

    schema = texts.select(*kept).schema.add("marks", ArrayType(IntegerType()))
    return texts.select(*kept, "form.tight", "form.rest").mapInArrow(marked, schema)


def word_marks(turns: DataFrame, words: Sequence[str], keys: list[str]) -> DataFrame:
    """``keys`` and marks of turns: which of the words, by number, their lower-cased text holds."""
    terms = [Term(w.lower(), "", (), True) for w in words]
    return mark_terms(turns.select(*keys, F.struct(F.lower(F.coalesce("text", F.lit(""))).alias("tight"), F.lit("").alias("rest")).alias("form")), terms)
