"""Token ids of a local word-level BPE file, looked up word by word.

The tokenizer (lower case, white space dropped, BPE inside units of letters, single
digits and runs of marks) gives each unit ids of its own, whatever stands around it.
Texts of Latin-1 characters without apostrophes or special strings are lower-cased
and cut into units as bytes; of all other texts, each chunk between white space is
given to the tokenizers library as it is. Both keep what they found in bounded tables.

New units are merged by tiktoken, with an end mark in place of the file's word end.
That gives the library's ids if every token of the file is rebuilt by its own merges
(then two symbols whose joined bytes are a token can only be that token's own pair), and
if the file normalizes and splits as is assumed here; ``own_merges`` checks both for a
file once. Without them the library gets each whole text.

``Merges`` counts the tokens of all prefixes of a unit in one pass. The last token of a
prefix is the one token that ends there and stands its ground beside the last token of
what is before it; so each place needs only the tokens that end at it, and nothing is
encoded twice.

Edge cases: a null text counts as empty and has no ids; white space of any kind and
length gives no ids; one-word texts of any length are merged as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np

#: Entries of each table of a Python worker (about 160 bytes each), and the longest unit or chunk kept.
CACHE_UNITS, CACHE_CHUNKS, CACHE_CHARS = 250_000, 100_000, 40
#: Chunks of other texts that are given to the library in one call.
GROUP = 20_000

_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0}


def _kind(i: int) -> int:
    if i in _WHITE:
        return _SPACE
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(i))[0], _MARK)


_KINDS = np.array([_kind(i) for i in range(256)], np.uint8)
_LOWER = bytes(32 if i in _WHITE else ord(chr(i).lower()) for i in range(256))
#: Of two neighbouring kinds (4 * first + second), whether a unit ends between them.
_CUTS = np.array([a != _SPACE and b != _SPACE and (a != b or a == _DIGIT) for a in range(4) for b in range(4)])
#: White space of the tokenizer; str.split() would also cut at U+001C to U+001F.
_CHUNK = re.compile("[^\t-\r\x20\x85\xa0  -     　]+")
_END = b"\xff"  # never part of UTF-8
#: What the file has to say of normalization and splitting for the cuts made here.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _char_bytes() -> dict[str, int]:
    """The usual printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [i for i in range(256) if i not in set(plain)]
    return {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(shifted)}


def _merge_ranks(path: str) -> tuple[dict[bytes, int], dict[int, int], list[tuple[bytes, bytes]]]:
    """Ranks by bytes, the file's id of each rank, and the file's merges as bytes."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    of_char = _char_bytes()

    def raw(token: str) -> bytes:
        end = token.endswith("</w>") and len(token) > 4
        return bytes(of_char[c] for c in (token[:-4] if end else token)) + _END * end

    known = {raw(token): i for token, i in model["vocab"].items() if all(c in of_char for c in token.removesuffix("</w>"))}
    pairs = [tuple(map(raw, x.split(" ") if isinstance(x, str) else x)) for x in model["merges"]]
    ranks, ids = {}, {}
    for i in range(255):  # first of all, the last byte of a unit joins its end
        ranks[bytes([i]) + _END] = i
    for k, (a, b) in enumerate(pairs):
        ranks[a + b] = 256 + k
    for token, rank in ranks.items():
        if token in known:
            ids[rank] = known[token]
    for i in range(256):
        ranks[bytes([i])] = 1_000_000 + i
        if bytes([i]) in known:
            ids[1_000_000 + i] = known[bytes([i])]
    return ranks, ids, pairs


def assumed_sections(path: str) -> bool:
    """Whether the file lower-cases, drops white space and cuts units as this module does."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    normalizer, cutter, model = found.get("normalizer") or {}, found.get("pre_tokenizer") or {}, found["model"]
    steps = [x["type"] for x in normalizer.get("normalizers", [])]
    cuts = cutter.get("pretokenizers") or [{}]
    split = cuts[0].get("pattern", {}).get("Regex") == _SPLIT and cuts[0].get("invert") is True and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
    return steps == _NORMALIZER and split and not cuts[1].get("add_prefix_space") and model.get("end_of_word_suffix") == "</w>" and not model.get("unk_token")


def own_merges(path: str) -> bool:
    """Whether the file is of the assumed kind, and every token of it is rebuilt by its own merges from its bytes."""
    if not assumed_sections(path):
        return False
    _, _, pairs = _merge_ranks(path)
    order = {pair: k for k, pair in enumerate(pairs)}
    if len({a + b for a, b in pairs}) != len(pairs):
        return False
    for a, b in pairs:
        whole = a + b
        end = whole.endswith(_END)
        symbols = [whole[i : i + 1] for i in range(len(whole) - end)]
        if end:
            symbols[-1] += _END
        while len(symbols) > 1:
            best = min((order.get(x, len(pairs)), i) for i, x in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == len(pairs):
                return False
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return True


class Merges:
    """Tokens of the prefixes of a unit's bytes."""

    #: Pairs of neighbouring tokens that are remembered.
    CACHE_PAIRS = 1_000_000

    def __init__(self, ranks: dict[bytes, int], merge) -> None:
        self.ranks, self.merge = ranks, merge
        self.longest = max(map(len, ranks))
        self.suffixes = {token[i:] for token in ranks for i in range(len(token))}
        #: Of what a token inside or at the end of a unit (without its mark) ends with: 1 if it is one inside, 2 if at the end.
        self.kinds = {x.removesuffix(_END): 0 for x in self.suffixes}
        for token in ranks:
            self.kinds[token.removesuffix(_END)] |= 2 if token.endswith(_END) else 1
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def stay(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens side by side are not merged into others; nothing stands before the first."""
        if not a:
            return True
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(a + b) == [self.ranks[a], self.ranks[b]]
        return found

    def grow(self, raw: bytes, last: list[bytes], counts: list[int]) -> None:
        """Extend the last token and the number of tokens of each prefix to the end of ``raw``."""
        ranks, suffixes, stay, most = self.ranks, self.suffixes, self.stay, self.longest
        for i in range(len(last), len(raw) + 1):
            ends = []
            for j in range(i - 1, max(-1, i - 1 - most), -1):
                token = raw[j:i]
                if token not in suffixes:
                    break
                if token in ranks:
                    ends.append((j, token))
            for j, token in reversed(ends):
                if stay(last[j], token):
                    last.append(token)
                    counts.append(counts[j] + 1)
                    break

    def ended(self, raw: bytes, last: list[bytes], counts: list[int], i: int) -> int:
        """Tokens of the first i bytes as a unit of their own, with the mark of its end."""
        if i == 0:
            return 0
        ends = []
        for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
            token = raw[j:i] + _END
            if token not in self.suffixes:
                break
            if token in self.ranks:
                ends.append((j, token))
        return next(counts[j] + 1 for j, token in reversed(ends) if self.stay(last[j], token))

    def prefixes(self, raw: bytes) -> tuple[list[bytes], list[int]]:
        last, counts = [b""], [0]
        self.grow(raw, last, counts)
        return last, counts

    def with_tail(self, raw: bytes, last: list[bytes], counts: list[int], i: int, tail: bytes) -> int:
        """Tokens of the first i bytes and ``tail`` as one unit."""
        low = max(0, i - self.longest)
        near, near_last, near_counts = raw[low:i] + tail, last[low : i + 1], counts[low : i + 1]
        self.grow(near, near_last, near_counts)
        return self.ended(near, near_last, near_counts, len(near))


class WordTokens:
    """Ids of texts. One of these belongs to one Python process."""

    def __init__(self, path: str, quick: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.merge = None
        if quick:
            import tiktoken

            ranks, ids, _ = _merge_ranks(path)
            self.merge = tiktoken.Encoding("units", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
            self.ranks = ranks
            self.id_of = {rank: np.array(i, "<u4").tobytes() for rank, i in ids.items()}

    @cached_property
    def merges(self) -> Merges:
        """Made when first used: its tables of all tokens' ends are larger than the tokens, and ids need none of them."""
        return Merges(self.ranks, self.merge)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _cut(self, text: str) -> list[bytes] | None:
        """The units of a text of Latin-1 characters, lower-cased; None for other texts."""
        if self.merge is None or "'" in text or "<|" in text:
            return None
        try:
            raw = text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return None
        kinds = _KINDS[np.frombuffer(raw, np.uint8)]
        cuts = np.flatnonzero(_CUTS[4 * kinds[:-1] + kinds[1:]])
        if len(cuts):
            raw = np.insert(np.frombuffer(raw, np.uint8), cuts + 1, 32).tobytes()
        return raw.split()

    def _add_units(self, missing: set[bytes]) -> None:
        merge, id_of, units = self.merge, self.id_of, self.units
        for unit in missing:
            whole = unit if unit.isascii() else unit.decode("latin-1").encode()
            units[unit] = b"".join([id_of[x] for x in merge(whole + _END)])

    def _add_chunks(self, missing: set[str]) -> None:
        asked = list(missing)
        for i in range(0, len(asked), GROUP):
            part = asked[i : i + GROUP]
            self.chunks.update(zip(part, self._library(part), strict=True))

    @staticmethod
    def _trim(table: dict, added: set, most: int) -> None:
        """Of what one text has added, drop what the table has no room for."""
        for x in added:
            if len(table) > most or len(x) > CACHE_CHARS:
                del table[x]

    def parts(self, text: str) -> list[bytes]:
        """The ids of each unit or chunk of a text, in order, as little-endian unsigned 32-bit integers."""
        if self.merge is None:
            return self._library([text])
        units = self._cut(text)
        if units is not None:
            table, most, add = self.units, CACHE_UNITS, self._add_units
        else:
            units, table, most, add = _CHUNK.findall(text), self.chunks, CACHE_CHUNKS, self._add_chunks
        missing = set(units).difference(table)
        if missing:
            add(missing)
        found = list(map(table.__getitem__, units))
        if missing and len(table) > most - 10_000 or any(len(x) > CACHE_CHARS for x in missing):
            self._trim(table, missing, most)
        return found

    def spans(self, text: str) -> tuple[list, np.ndarray, np.ndarray, bool]:
        """Units (lower-cased, Latin-1 bytes) or chunks of a text, their starts and ends in code points, and which of both they are."""
        units = self._cut(text)
        if units is None:
            found = np.array([x.span() for x in _CHUNK.finditer(text)], np.int64).reshape(-1, 2)
            return _CHUNK.findall(text), found[:, 0], found[:, 1], False
        kinds = _KINDS[np.frombuffer(text.encode("latin-1"), np.uint8)]
        inside = np.flatnonzero(_CUTS[4 * kinds[:-1] + kinds[1:]]) + 1
        solid = np.concatenate([[False], kinds != _SPACE, [False]])
        starts = np.flatnonzero(~solid[:-1] & solid[1:])
        ends = np.flatnonzero(solid[:-1] & ~solid[1:])
        return units, np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside])), True

    def ids(self, text: str) -> bytes:
        return b"".join(self.parts(text))

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text))) // 4


_LOADED: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(path: str, quick: bool) -> WordTokens:
    """The tokenizer of this process; read from the local file once."""
    if (path, quick) not in _LOADED:
        _LOADED[path, quick] = WordTokens(path, quick)
    return _LOADED[path, quick]
