"""JSON as language models write it: a tolerant reader, of one object or of all that a text holds.

Accepted besides JSON: text and fences around the object, comments, single quotes, bare keys
and words, missing and trailing commas, quotes inside strings, and an end that was cut off.
"""

from __future__ import annotations

import json
import re
from typing import Any

_WORD = re.compile(r"[^\s,:{}\[\]\"']+")
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S)
#: What stands behind the quote that ends a string.
_CLOSES = re.compile(r"\s*(?:[,:}\]]|$|\n\s*[\"'])")
_NAMES = {"true": True, "false": False, "null": None, "none": None, "nan": None}


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        """The next character behind white space, "" at the end."""
        found = _SPACE.match(self.text, self.at)
        if found:
            self.at = found.end()
        return self.text[self.at : self.at + 1]

    def value(self) -> Any:
        c = self.skip()
        if c == "{":
            return self.members()
        if c == "[":
            return self.items()
        if c in ('"', "'") and c:
            return self.string(c)
        found = _WORD.match(self.text, self.at)
        if not found:
            self.at += 1
            return None
        self.at = found.end()
        word = found.group()
        if word.lower() in _NAMES:
            return _NAMES[word.lower()]
        try:
            return json.loads(word)
        except ValueError:
            return word

    def string(self, quote: str) -> str:
        """Ends at a quote that a separator, a bracket or the end follows; other quotes belong to the text."""
        out, self.at = [], self.at + 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                size = 6 if self.text[self.at + 1] == "u" else 2
                part = self.text[self.at : self.at + size]
                try:
                    out.append(json.loads(f'"{part}"'))
                except ValueError:
                    out.append(part[1:])
                self.at += size
                continue
            self.at += 1
            if c == quote and _CLOSES.match(self.text, self.at):
                return "".join(out)
            out.append(c)
        return "".join(out)

    def members(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        self.at += 1
        while True:
            c = self.skip()
            if c in ("", "}"):
                self.at += 1
                return out
            if c in (",", ":"):
                self.at += 1
                continue
            if c == "]":  # closes something further out
                return out
            key = self.value()
            if self.skip() == ":":
                self.at += 1
                out[str(key)] = self.value()

    def items(self) -> list[Any]:
        out: list[Any] = []
        self.at += 1
        while True:
            c = self.skip()
            if c in ("", "]"):
                self.at += 1
                return out
            if c in (",", ":"):
                self.at += 1
                continue
            if c == "}":
                return out
            out.append(self.value())


def read_object(text: str) -> dict[str, Any]:
    """The first object of a text; strict JSON is taken as it is. ``ValueError`` if there is none."""
    source = re.sub(r"^\s*```[a-zA-Z]*\s*|```\s*$", "", text or "").strip()
    try:
        strict = json.loads(source)
        if isinstance(strict, dict):
            return strict
    except ValueError:
        pass
    start = source.find("{")
    if start < 0:
        raise ValueError("no JSON object in the text")
    reader = _Reader(source)
    reader.at = start
    return reader.members()


def read_any(text: str) -> Any:
    """The first object or array of a text; strict JSON is taken as it is. ``ValueError`` if there is none, or none that can be read."""
    source = re.sub(r"^\s*```[a-zA-Z]*\s*|```\s*$", "", text or "").strip()
    try:
        strict = json.loads(source)
        if isinstance(strict, (dict, list)):
            return strict
    except (ValueError, RecursionError):
        pass
    start = re.search(r"[\[{]", source)
    if not start:
        raise ValueError("no JSON in the text")
    reader = _Reader(source)
    reader.at = start.start()
    try:
        return reader.value()
    except RecursionError:
        raise ValueError("JSON of too many levels") from None


def records_with(found: Any, key: str) -> list[dict[str, Any]]:
    """All objects below a value that have the key, in order; what is inside of one is not searched."""
    out, waiting = [], [found]
    while waiting:
        now = waiting.pop()
        if isinstance(now, dict) and key in now:
            out.append(now)
        elif isinstance(now, (dict, list)):
            waiting += reversed(list(now.values()) if isinstance(now, dict) else now)
    return out
