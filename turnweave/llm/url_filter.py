"""URL allow and block rules in a trie over reversed host labels, then path segments.

A rule is (verdict, "host/path"). It fits its host and every subdomain, if the
URL's path starts with the rule's path. The deepest fitting node wins: more host
labels first, then a longer path. The trie is plain data of a checked size and is
broadcast; URLs are judged where they are read, so that nothing is shuffled and a
host with a third of all rows costs no more than any other.

Edge cases: a null URL or one without "://" has empty host and path, fits no rule
and gets the default verdict. A-Z are lower-cased in hosts, paths stay as they are.
Of two rules with the same host and path, the later replaces the earlier. Repeated
rows are judged one by one; extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import bound_batches

#: The trie is broadcast, so its size is bounded; larger lists are refused.
MAX_RULES = 2_000_000

_UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty without "://"."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        if cut >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


class _Node:
    """A host label's or a path segment's node."""

    __slots__ = ("labels", "partial", "rule", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] | None = None  # of a host with rules: below its path "/"
        self.partial: list[tuple[str, tuple[str, str]]] | None = None  # rule paths that end inside a segment
        self.rule: tuple[str, str] | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        """``rules``: (verdict, "host/path"); a rule without "/" fits every path, also an empty one."""
        self.root = _Node()
        self.size = 0
        for verdict, text in rules:
            self._add(verdict, text)

    def _add(self, verdict: str, text: str) -> None:
        self.size += 1
        host, slash, path = text.partition("/")
        node = self.root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.labels.setdefault(label, _Node())
        found = (text, verdict)
        if not slash:
            node.rule = found
            return
        *whole, rest = path.split("/")
        if node.segments is None:
            node.segments = {}
        # A path's first "/" has been taken off; what follows are whole segments, each closed by "/".
        at = node.segments.setdefault("", _Node())
        for segment in whole:
            if at.segments is None:
                at.segments = {}
            at = at.segments.setdefault(segment, _Node())
        if rest:
            at.partial = [x for x in at.partial or [] if x[0] != rest] + [(rest, found)]
        else:
            at.rule = found

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        best = None
        node, segments = self.root, path.split("/") if path else []
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            best = self._in_host(node, segments) or best
        return best

    @staticmethod
    def _in_host(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best, at = node.rule, node
        for i, segment in enumerate(segments):
            if at.partial and i:
                fits = [x for x in at.partial if segment.startswith(x[0])]
                if fits:
                    best = max(fits, key=lambda x: len(x[0]))[1]
            if i == len(segments) - 1 or not at.segments:  # the last segment is not closed by "/"
                break
            at = at.segments.get(segment)
            if at is None:
                break
            best = at.rule or best
        return best


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]],
    *,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    bound_batches(pages)
    id_type = pages.schema[id_column].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = find(host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(verdict)
            text = pa.string()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, text), pa.array(paths, text), pa.array(found, text), pa.array(verdicts, text)],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    narrow = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    return narrow.mapInArrow(judged, f"page_id {id_type}, host string, path string, rule string, verdict string")
