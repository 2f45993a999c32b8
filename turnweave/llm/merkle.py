"""A Merkle manifest of a table: a digest of every row, subtrees of groups, one root, and a proof for every row.

A row's leaf is the SHA-256 (lower-case hexadecimal) of its fields, each written as ``-`` if
null, else as its UTF-8 length, ``:`` and its value. In a group, leaves ascend by the key; as
long as there are several nodes, each run of ``FANOUT`` (the last of fewer, even of one)
becomes the digest of its nodes' hexadecimal texts. What is left is the group's subroot. The
subroots, by group (null first, then by UTF-8 bytes), are the leaves of the tree of the root.

Leaves, with their digests and no texts, are stored and become a range-sorted RDD. Its
partitions' counts (one small row a partition: its first and last group with their numbers of
rows) give each partition the offset of its rows in their groups. A partition then builds all
complete aligned subtrees by itself. Only its ragged nodes, whose parents need another
partition's nodes, are shuffled, by the coordinate (group, level, place) of an ancestor; upper
levels are finished in rounds that each close blocks of ``BLOCK`` times more leaves. For the
proofs a partition gets the nodes beside its own edges, by coordinate again, and puts every
leaf's proof together where the leaf is. The tree of the subroots is built in the same way,
so that neither a group nor the number of groups is bounded by one task. To the driver come
the counts of partitions only.

A proof is a list of levels from the leaf up; a level has the digests of the run's other
nodes that stand left and right of the node, each joined to one text.

Edge cases: null fields are ``-`` and null texts stay null when tampered with; a null key is
the smallest; rows of one group and key are ordered by their leaf, and equal rows are leaves
of their own (a number given when leaves are stored orders them, so that the copies of one
row can be dealt to many partitions); a group of one row has its leaf as subroot, a single
group its subroot as root, with no levels; an empty table gives no rows. Extra columns take
no part, and none of their names clashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import stored

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of one partition. A partition is held by one task when its proofs are put together.
PART_ROWS = 50_000
#: Levels that a round of the upper tree closes; a block has 3^4 = 81 times more leaves than one of the round before.
ROUND_LEVELS = 4

LEVEL = "struct<left: string, right: string>"


def encoded(field: Column) -> Column:
    """A field as it enters the digest."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(x) for x in fields]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda below, level: F.sha2(F.concat(level["left"], below, level["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _digest(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _widths(n: int) -> list[int]:
    """How many nodes each level of a tree of n leaves has."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def _deal(key) -> int:
    return zlib.crc32(repr(key).encode())


def _segments(rows: Iterable[tuple]) -> Iterator[tuple[str | None, list[tuple]]]:
    """The groups of sorted rows, each with its rows."""
    group, held = None, []
    for row in rows:
        if held and row[0] != group:
            yield group, held
            held = []
        group = row[0]
        held.append(row)
    if held:
        yield group, held


def _ends(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(partition, first group, its rows, last group, its rows) of a partition that has rows."""
    first = last = None
    for row in rows:
        if last is None or row[0] != last[0]:
            if first is None and last is not None:
                first = last
            last = [row[0], 0]
        last[1] += 1
    if last is not None:
        yield (part, *(first or last), *last)


def offsets(ends: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """By partition: the offset of its first group's rows, that group's size, and its last group's size."""
    sizes: dict = {}
    for _, first, n_first, last, n_last in ends:
        # A group in the middle of a partition is in no other one, and is not counted here.
        sizes[first] = sizes.get(first, 0) + n_first
        if last != first:
            sizes[last] = sizes.get(last, 0) + n_last
    out, seen = {}, {}
    for part, first, n_first, last, n_last in sorted(ends, key=lambda x: x[0]):
        out[part] = (seen.get(first, 0), sizes[first], sizes[last])
        seen[first] = seen.get(first, 0) + n_first
        if last != first:
            seen[last] = n_last
    return out


def _placed(part: int, rows: Iterable[tuple], at: dict) -> Iterator[tuple]:
    """(group, its rows here, offset, size of the group) of each group of a partition; every group is held alone."""
    number = 0
    segments = iter(_segments(rows))
    now = next(segments, None)
    while now is not None:
        after = next(segments, None)
        (group, held), (offset, first_size, last_size) = now, at[part]
        if number == 0:
            yield group, held, offset, first_size
        else:
            yield group, held, 0, last_size if after is None else len(held)
        number, now = number + 1, after


def _local_levels(leaves: list[str], offset: int, n: int) -> list[tuple[int, list[str]]]:
    """The levels of the subtrees that these leaves complete: of each level its first place and its nodes."""
    levels = [(offset, leaves)]
    for width in _widths(n)[:-1]:
        start, nodes = levels[-1]
        first = -(-start // FANOUT)
        end = start + len(nodes)
        last = -(-end // FANOUT) if end == width else end // FANOUT
        if first >= last:
            break
        levels.append((first, [_digest(nodes[max(0, i * FANOUT - start) : (i + 1) * FANOUT - start]) for i in range(first, last)]))
    return levels


def _ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of the nodes whose parents are not complete here."""
    for level, (start, nodes) in enumerate(levels):
        if level + 1 < len(levels):
            first, above = levels[level + 1]
            for i, node in enumerate(nodes):
                if i + start < first * FANOUT:
                    yield level, i + start, node
                else:
                    break
            for i in range(max(0, (first + len(above)) * FANOUT - start), len(nodes)):
                yield level, i + start, nodes[i]
        else:
            yield from ((level, i + start, node) for i, node in enumerate(nodes))


def _beside(offset: int, count: int, n: int, levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that proofs of these leaves need and that are not complete here."""
    low, high = offset, offset + count - 1
    for level, width in enumerate(_widths(n)[:-1]):
        low, high = low // FANOUT, high // FANOUT
        start, nodes = levels[level] if level < len(levels) else (0, [])
        for place in range(low * FANOUT, min((high + 1) * FANOUT, width)):
            if not start <= place < start + len(nodes):
                yield level, place


def _finish(block: tuple, nodes: Iterable[tuple]) -> Iterator[tuple]:
    """The nodes above ``nodes``, (level, place, digest, n), of one block (group, level), up to the block's level."""
    group, top, _ = block
    by_level: dict[int, dict[int, str]] = {}
    n = 0
    for level, place, digest, n in nodes:
        by_level.setdefault(level, {})[place] = digest
    for level in range(min(by_level), top):
        here = by_level.get(level, {})
        width = _widths(n)[level]
        for parent in sorted({place // FANOUT for place in here}):
            run = range(parent * FANOUT, min((parent + 1) * FANOUT, width))
            digest = _digest(here[i] for i in run)
            by_level.setdefault(level + 1, {})[parent] = digest
            yield (group, level + 1, parent), digest, n


def _upper(ragged: RDD, first_level: int, most_levels: int, tasks: int) -> RDD:
    """All nodes ((group, level, place), digest, n) from ragged ones up to the roots; ``first_level``: where the first round ends."""
    open_, found, top = ragged, ragged, first_level
    while True:
        now = min(top, most_levels)

        def keyed(node, now=now):
            (group, level, place), digest, n = node
            up = min(now, len(_widths(n)) - 1)
            return (group, up, place // FANOUT ** max(0, up - level)), (level, place, digest, n)

        below = open_.filter(lambda node, now=now: node[0][1] < min(now, len(_widths(node[2])) - 1))
        made = below.map(keyed).groupByKey(tasks, _deal).flatMap(lambda x: _finish(*x))
        found = found.union(made)
        if now >= most_levels:
            return found
        # Nodes at or above this round's level go on; those below were used up by it.
        open_ = open_.union(made).filter(lambda node, now=now: node[0][1] >= now)
        top = now + ROUND_LEVELS


def _proofs(rows: list[tuple], offset: int, n: int, levels: list[tuple[int, list[str]]], given: dict[tuple[int, int], str]) -> Iterator[tuple[tuple, tuple]]:
    """Each row with its levels (left, right) up to the subroot; digests that are not complete here are ``given``."""
    widths = _widths(n)

    def node(level: int, place: int) -> str:
        if level < len(levels):
            start, nodes = levels[level]
            if start <= place < start + len(nodes):
                return nodes[place - start]
        return given[level, place]

    above: list[tuple[int, tuple]] = [(-1, ())] * (len(widths) + 1)  # by level: the place last asked for, and its levels

    def path(level: int, place: int) -> tuple:
        if level >= len(widths) - 1:
            return ()
        if above[level][0] != place:
            run = range(place // FANOUT * FANOUT, min((place // FANOUT + 1) * FANOUT, widths[level]))
            left, right = "".join(node(level, i) for i in run if i < place), "".join(node(level, i) for i in run if i > place)
            above[level] = (place, ((left, right), *path(level + 1, place // FANOUT)))
        return above[level][1]

    for i, row in enumerate(rows):
        yield row, path(0, offset + i)


def _tree(leaves: DataFrame, rows: int) -> tuple[RDD, dict, int, int]:
    """Range-sorted rows of stored ``leaves`` (first column: group, second: digest), offsets, levels at most, and tasks for nodes."""
    order = [F.col(c).asc_nulls_first() for c in ("group", *[c for c in leaves.columns if c.startswith("key")])]
    parts = max(1, -(-rows // PART_ROWS))
    placed = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd.map(tuple)
    at = offsets(placed.mapPartitionsWithIndex(_ends).collect())
    most = max((len(_widths(max(x[1:]))) - 1 for x in at.values()), default=0)
    return placed, at, most, max(1, placed.getNumPartitions() // 16)


def _built(leaves: DataFrame, rows: int) -> tuple[RDD, RDD, RDD, dict]:
    """Range-sorted rows, the nodes that are not inside one partition, (group, (subroot, partition)) pairs, and offsets."""
    placed, at, most, tasks = _tree(leaves, rows)
    context = placed.context
    shared = context.broadcast(at)

    def local(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for group, held, offset, n in _placed(part, rows, shared.value):
            levels = _local_levels([x[1] for x in held], offset, n)
            if len(held) == n:
                yield "whole", (group, (levels[-1][1][0], part))
                continue
            yield "part", (group, part)
            for level, place, digest in _ragged(levels):
                yield "node", ((group, level, place), digest, n)
            for level, place in _beside(offset, len(held), n, levels):
                yield "ask", ((group, level, place), part)

    made = placed.mapPartitionsWithIndex(local)

    def only(kind: str) -> RDD:
        return made.filter(lambda x: x[0] == kind).values()

    first = len(_widths(PART_ROWS)) + 1
    nodes = _upper(only("node"), min(first, most), most, tasks)
    digests = nodes.map(lambda x: (x[0], x[1]))
    roots = nodes.filter(lambda x: x[0][1] == len(_widths(x[2])) - 1).map(lambda x: (x[0][0], x[1]))
    cut = only("part").leftOuterJoin(roots, tasks).map(lambda x: (x[0], (x[1][1], x[1][0])))
    given = only("ask").join(digests, tasks).map(lambda x: (x[1][0], (x[0], x[1][1])))
    return placed, given, only("whole").union(cut), at


def _by_part(rows: RDD, pairs: RDD) -> tuple[RDD, RDD]:
    """``rows`` and, for each partition, the list of what it is given; both with empty partitions more if a session deals to more."""
    given = pairs.partitionBy(rows.getNumPartitions(), int).mapPartitions(lambda it: [[value for _, value in it]])
    more = given.getNumPartitions() - rows.getNumPartitions()
    # One element a partition on both sides, as is asked of what is zipped.
    empty = rows.context.parallelize(range(more), more).map(lambda _: []) if more else None
    return rows if empty is None else rows.union(empty), given


def _finished(placed: RDD, given: RDD, tops: RDD, at: dict) -> RDD:
    """(row, subroot, root, proof) of all rows; ``tops``: (partition, (group, subroot, root, levels above the subroot))."""
    shared = placed.context.broadcast(at)

    def rows(part: int, pairs: Iterator[tuple]) -> Iterator[tuple]:
        for (held, nodes), above in pairs:
            known: dict = {}
            for (group, level, place), digest in nodes:
                known.setdefault(group, {})[level, place] = digest
            top = {group: rest for group, *rest in above}
            for group, own, offset, n in _placed(part, held, shared.value):
                levels = _local_levels([x[1] for x in own], offset, n)
                subroot, root, upper = top[group]
                for row, proof in _proofs(own, offset, n, levels, known.get(group, {})):
                    yield row, subroot, root, proof + tuple(upper)

    whole = placed.mapPartitions(lambda it: [list(it)])
    for pairs in (given, tops):
        whole = RDD.zip(*_by_part(whole, pairs))
    return whole.mapPartitionsWithIndex(rows)


def manifest(documents: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None) -> DataFrame:
    """``key``, leaf, subroot, root and proof of every row; with ``claimed``, that digest too, as column claimed.

    ``claimed`` is an expression over ``documents``: the leaf of what somebody says the row is.
    ``folded(claimed, proof) = root`` then tells whether it is.
    """
    spark = documents.sparkSession
    leaf = leaf_digest([F.col(x) for x in fields])
    columns = [F.col(group).cast("string").alias("group"), leaf.alias("leaf"), F.col(key).alias("key")]
    columns += [(leaf if claimed is None else claimed).alias("claimed")]
    rows = documents.select(*columns).withColumn("number", F.monotonically_increasing_id())
    rows = stored(rows.select("group", "leaf", "key", F.col("leaf").alias("key_leaf"), F.col("number").alias("key_number"), "claimed"))
    placed, given, subroots, at = _built(rows, rows.count())

    # The tree above: one group whose leaves are the subroots, each once.
    found = spark.createDataFrame(subroots.map(lambda x: (x[0], x[1][0], x[1][1])), "key string, leaf string, part int", verifySchema=False)
    found = stored(found)
    each = stored(found.select(F.lit(None).cast("string").alias("group"), "leaf", "key").distinct())
    top, top_given, top_roots, top_at = _built(each, each.count())
    roots = top_roots.map(lambda x: (x[1][1], (x[0], x[1][0], x[1][0], ())))
    above = _finished(top, top_given, roots, top_at).map(lambda x: (x[0][2], (x[0][1], x[2], x[3])))
    where = found.select("key", "part").rdd.map(tuple)
    tasks = max(1, placed.getNumPartitions() // 16)
    tops = where.join(above, tasks).map(lambda x: (x[1][0], (x[0], *x[1][1])))

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, leaf string, claimed string, subroot string, root string, proof array<{LEVEL}>"
    whole = _finished(placed, given, tops, at).map(lambda x: (x[0][2], x[0][1], x[0][5], *x[1:]))
    out = spark.createDataFrame(whole, schema, verifySchema=False)
    return out if claimed is not None else out.drop("claimed")


def tampered_leaf(documents: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text lost its line feeds, for half of the rows by the CRC of their id; else the row's own."""
    columns = {x: F.col(x) for x in fields}
    lossy = columns | {"text": F.replace(columns["text"].cast("string"), F.lit("\n"), F.lit(""))}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, leaf_digest(list(lossy.values()))).otherwise(leaf_digest(list(columns.values())))


def audit(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: the manifest held against tampered rows."""
    found = manifest(documents, claimed=tampered_leaf(documents))
    with_fold = found.withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return with_fold.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
