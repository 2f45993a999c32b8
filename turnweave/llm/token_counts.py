"""Exact token counts of every prefix of a text, by dynamic programming.

``PrefixCounts`` holds the number of tokens of each prefix of a text, by code points. Units
of the tokenizer do not act on each other, and inside a unit the count of a prefix follows
from the tokens that end there and the counts before them (``Merges``), so that a table
takes time in proportion to the text, also where a unit is very long. Totals, budgets,
cuts and slices are read from the table; no text and no prefix of it is encoded.
The counts are those of the tokenizer file's library without begin, end or added special
tokens; special strings inside a text are one token, as by the library's default.

Edge cases: a null text counts as empty, 0 tokens and 0 bytes; white space has no
tokens; a prefix that ends inside a unit, a special string or a sequence of combining
characters counts as if the text ended there; repeated rows are counted one by one.
A file whose tokens are not rebuilt by their own merges is refused.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches
from turnweave.llm.word_tokens import _END, CACHE_CHARS, CACHE_CHUNKS, CACHE_UNITS, WordTokens, own_merges, word_tokens

#: Prefixes of units of each Python worker that are remembered; the table starts anew when it is full.
CACHE_NODES = 400_000


@lru_cache(maxsize=8)
def quick_merges(path: str) -> bool:
    return own_merges(path)


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may be composed with the one before them."""
    found = {chr(i) for i in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for i in range(0x110000):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _clusters(text: str) -> list[str]:
    """The text cut where normalization never joins what is on both sides."""
    if text.isascii() or (unicodedata.is_normalized("NFC", text) and not any(map(unicodedata.combining, text))):
        return list(text)
    joining, found = _joining(), []
    for c in text:
        if found and (c in joining or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)):
            found[-1] += c
        else:
            found.append(c)
    return found


#: Units that begin with an apostrophe and are two units without their last letter.
_TWO_LETTERS = ("'re", "'ve", "'ll")


class UnitTables:
    """Counts of all prefixes of units and chunks. One of these belongs to one Python process."""

    def __init__(self, tokens: WordTokens) -> None:
        if tokens.merge is None:
            raise ValueError("counts of prefixes need a tokenizer whose tokens are rebuilt by their own merges")
        self.tokens, self.merges = tokens, tokens.merges
        self.normalize = lru_cache(maxsize=100_000)(tokens.tokenizer.normalizer.normalize_str)
        special = [x.content for x in tokens.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.units: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.nodes: dict[bytes, tuple[bytes, int, bytes]] = {}

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.tokens.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _alone(self, unit: str) -> int:
        raw = unit.encode()
        last, counts = self.merges.prefixes(raw)
        return self.merges.ended(raw, last, counts, len(raw))

    def unit(self, unit: bytes) -> bytes:
        """Counts (unsigned 32-bit) of the prefixes of 1, 2, ... characters of a unit of Latin-1 bytes."""
        ascii_ = unit.isascii()
        raw = unit if ascii_ else unit.decode("latin-1").encode()
        if len(raw) <= CACHE_CHARS:
            return self._shared(raw)
        last, counts = self.merges.prefixes(raw)
        ends = range(1, len(raw) + 1) if ascii_ else np.cumsum([1 + (c >= 0x80) for c in unit]).tolist()
        ended = self.merges.ended
        return np.array([ended(raw, last, counts, i) for i in ends], "<u4").tobytes()

    def _shared(self, raw: bytes) -> bytes:
        """The same of a short unit: what is known of its prefixes from other units is not worked out again.

        ``nodes``: the last token, the number of tokens, and the counts up to there, of each prefix.
        """
        nodes, merges = self.nodes, self.merges
        kinds, pairs, stay = merges.kinds, merges.pairs, merges.stay
        if len(nodes) > CACHE_NODES or not nodes:
            nodes.clear()
            nodes[b""] = (b"", 0, b"")
        n = at = len(raw)
        while raw[:at] not in nodes:
            at -= 1
        shown = nodes[raw[:at]][2]
        for i in range(at + 1, n + 1):
            inner, final, j = [], [], i - 1
            while j >= 0 and (kind := kinds.get(raw[j:i])) is not None:
                if kind & 1:
                    inner.append(j)
                if kind & 2:
                    final.append(j)
                j -= 1
            for j in reversed(inner):
                before, token = nodes[raw[:j]], raw[j:i]
                if not j or (stay(before[0], token) if (known := pairs.get((before[0], token))) is None else known):
                    break
            last, count = token, before[1] + 1
            if i == n or raw[i] & 0xC0 != 0x80:  # a character ends
                for j in reversed(final):
                    before, token = nodes[raw[:j]], raw[j:i] + _END
                    if not j or (stay(before[0], token) if (known := pairs.get((before[0], token))) is None else known):
                        break
                shown += (before[1] + 1).to_bytes(4, "little")
            nodes[raw[:i]] = (last, count, shown)
        return shown

    def chunk(self, chunk: str) -> bytes:
        """The same of a text without white space."""
        out: list[int] = []
        base, at = 0, 0
        for found in [*self.special.finditer(chunk), None]:
            end = found.start() if found else len(chunk)
            tail, total = self._segment(chunk[at:end], base, out)
            if found:
                out += [tail(found[0][:k]) for k in range(1, len(found[0]))]
                base, at = total + 1, found.end()
                out.append(base)
        return np.array(out, "<u4").tobytes()

    def _segment(self, text: str, base: int, out: list[int]):
        """Append the counts of the prefixes of a text without special strings; returns what counts a tail behind it, and its count."""
        clusters = _clusters(text)
        parts = [self.normalize(c) for c in clusters]
        norm = "".join(parts)
        pieces = self._pieces(norm)
        merges = self.merges
        start = end = at = 0  # of the unit, and the place in norm
        raw, place, last, counts = b"", 0, [b""], [0]
        before, now, number = base, base, 0  # tokens before the unit and up to the place

        def tail(more: str) -> int:
            """Tokens up to the place with ``more`` behind it."""
            more = self.normalize(more)
            low = max(start, at - 2) if at <= end else at
            found = self._pieces(norm[low:at] + more)
            shown, total = at - low, now
            for s, e in found:
                if s < shown < e:  # goes on with the unit
                    total = before + merges.with_tail(raw, last, counts, place, (norm[low:at] + more)[shown:e].encode())
                elif s >= shown:
                    total += self._alone((norm[low:at] + more)[s:e])
            return total

        for cluster, part in zip(clusters, parts, strict=True):
            for k in range(1, len(cluster)):
                out.append(tail(cluster[:k]))
            for c in part:
                if number < len(pieces) and at == pieces[number][0]:
                    start, end = pieces[number]
                    number += 1
                    raw, place, before = norm[start:end].encode(), 0, now
                    last, counts = merges.prefixes(raw)
                at += 1
                if at <= end:
                    place += len(c.encode())
                    now = before + merges.ended(raw, last, counts, place)
            if at < end and at - start == 2 and norm[start:end] in _TWO_LETTERS:
                out.append(before + self._alone(norm[start]) + self._alone(norm[start + 1]))
            else:
                out.append(now)
        return tail, now

    def tables(self, units: list, latin: bool) -> list[bytes]:
        table, most, make = (self.units, CACHE_UNITS, self.unit) if latin else (self.chunks, CACHE_CHUNKS, self.chunk)
        missing = set(units).difference(table)
        for x in missing:
            table[x] = make(x)
        found = list(map(table.__getitem__, units))
        if missing and (len(table) > most - 10_000 or any(len(x) > CACHE_CHARS for x in missing)):
            for x in missing:
                if len(table) > most or len(x) > CACHE_CHARS:
                    del table[x]
        return found


_TABLES: dict[int, UnitTables] = {}


def unit_tables(tokens: WordTokens) -> UnitTables:
    if id(tokens) not in _TABLES:
        _TABLES[id(tokens)] = UnitTables(tokens)
    return _TABLES[id(tokens)]


class PrefixCounts:
    """The token count of every prefix of ``text``: ``table[n]`` is that of the first n code points."""

    def __init__(self, text: str, tokens: WordTokens) -> None:
        units, self.starts, self.ends, latin = tokens.spans(text)
        found = unit_tables(tokens).tables(units, latin)
        sizes = self.ends - self.starts
        inner = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(inner[np.cumsum(sizes) - 1] if len(units) else [])]).astype(np.int64)
        self.table = np.zeros(len(text) + 1, np.int64)
        done = np.zeros(len(text) + 1, np.int64)
        done[self.ends] = 1
        self.table += self.before[np.cumsum(done)]  # right in white space
        solid = np.arange(len(inner)) + np.repeat(self.starts - (np.cumsum(sizes) - sizes), sizes)
        self.table[solid + 1] = inner + np.repeat(self.before[:-1], sizes)

    @property
    def total(self) -> int:
        return int(self.table[-1])

    def at(self, n: int) -> int:
        """Tokens of the first n code points."""
        return int(self.table[min(max(n, 0), len(self.table) - 1)])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.table <= budget)[-1])

    def slices(self, budget: int) -> list[tuple[int, int]]:
        """The text from end to end as (start, end) of whole units or chunks, at most ``budget`` tokens each where one of them allows."""
        found, k = [], 0
        while k < len(self.starts):
            j = max(k + 1, int(np.searchsorted(self.before, self.before[k] + budget, side="right")) - 1)
            found.append((int(self.starts[k]), int(self.ends[j - 1])))
            k = j
        return found


def measure(text: str, tokens: WordTokens, limit: int) -> tuple[int, int, bool, int | None]:
    """n_bytes, n_tokens, over_limit and fit_chars of a text, from one table of its prefixes."""
    table = PrefixCounts(text, tokens)
    over = table.total > limit
    return len(text) if text.isascii() else len(text.encode()), table.total, over, table.longest(limit) if over else None


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), and fit_chars: code
    points of the longest prefix within the limit, of the texts over it (else null)."""
    if not quick_merges(path):
        raise ValueError("counts of prefixes need a tokenizer whose tokens are rebuilt by their own merges")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path, True)
        for batch in batches:
            found = [measure(value.as_py() or "", tokens, limit) for value in batch.column(1)]
            n_bytes, n_tokens, over, fit = ([x[i] for x in found] for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    bound_batches(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(counted, schema)
