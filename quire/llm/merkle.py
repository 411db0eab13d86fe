"""A Merkle manifest of a dataset by supersteps over an RDD, and the check of rows against it.

Rows of a group (``source``) in the order of their ids are the leaves of a tree in which every three consecutive nodes
have a parent; the roots of the groups, in the order of the groups, are the leaves of one more such tree.

Going up, every node sends its digest to its vertex, which holds the ``LEVELS`` levels above ``BLOCK`` consecutive nodes; a
vertex that has its nodes hashes them level by level and sends the last digest on. A vertex is the top of its tree if it is the
first and the last of its step, which nodes tell their vertices, so none needs the size of its group. Going down, every
vertex sends each node the siblings on its way to the root. Vertices are dealt by a hash of group and place, so a group
that holds most rows is spread like any other; what meets in a vertex are ``BLOCK`` nodes at most. The driver sees two numbers a
partition (where groups continue across partitions), counts and one root.

Vertices of each superstep are checkpointed, leaves are a written table: a lost executor costs the step at hand.

Rows with equal group and id are ordered by their leaf, and equal leaves by their place in the written table: the order of
equal digests changes neither root. Null groups and ids come first. An empty table has an empty manifest.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.text import carried, shared_dir

ARITY = 3
#: Levels of the tree, and so nodes, that one vertex holds; a superstep climbs that many.
LEVELS = 3
BLOCK = ARITY**LEVELS
#: The group of the groups' own tree.
DATASET = -1


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values, each with its length in bytes before it, `-` for null."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)), 256)


def _hash(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


# -- leaves in order ----------------------------------------------------------------------------------------------------------


def _summary(index: int, rows: Iterator) -> Iterator[tuple]:
    """Of one partition: its first and last group with their rows here, the number of groups, and the most rows of one."""
    groups, most, count, first, current = 0, 0, 0, None, None
    for row in rows:
        name = None if row[0] is None else hashlib.sha256(row[0].encode()).digest()
        if not groups or name != current:
            first = first or (groups and (current, count)) or None
            groups, current, count = groups + 1, name, 0
        count += 1
        most = max(most, count)
    if groups:
        yield index, first or (current, count), (current, count), groups, most


def _starts(summaries: list[tuple]) -> tuple[dict[int, tuple[int, int, bool]], int, int]:
    """For each partition the number of its first group, the rows of that group before it, and whether its last group goes on; the number of groups and the most rows of one."""
    out, group, before, most = {}, -1, 0, 0
    last, previous = None, None
    for index, first, end, groups, longest in sorted(summaries):
        goes_on = previous is not None and last[0] == first[0]
        if goes_on:
            out[previous] = (*out[previous][:2], True)
        else:
            group, before = group + 1, 0
        out[index] = (group, before, False)
        most = max(most, longest, before + first[1])
        before = before + end[1] if groups == 1 else end[1]
        group, last, previous = group + groups - 1, end, index
        most = max(most, before)
    return out, group + 1, most


def _numbered(starts: dict[int, tuple[int, int, bool]]):
    """Rows as messages to their first vertices: ((group, place of the vertex), (slot, digest, last of its group, payload))."""

    def run(index: int, rows: Iterator) -> Iterator[tuple]:
        if index not in starts:
            return
        group, place, goes_on = starts[index]
        held = None
        for row in rows:
            if held is not None:
                same = held[0] == row[0]
                yield (group, place // BLOCK), (place % BLOCK, bytes(held[1]), not same, tuple(held[2:]))
                group, place = (group, place + 1) if same else (group + 1, 0)
            held = row
        if held is not None:
            yield (group, place // BLOCK), (place % BLOCK, bytes(held[1]), not goes_on, tuple(held[2:]))

    return run


# -- supersteps ---------------------------------------------------------------------------------------------------------------


def _steps(n: int) -> int:
    """Supersteps until a group of n leaves is one vertex."""
    steps = 1
    while n > BLOCK:
        n, steps = -(-n // BLOCK), steps + 1
    return steps


def _whole(place: int, nodes: list) -> bool:
    """Whether a vertex has all nodes of its group's level."""
    return place == 0 and nodes[-1][2]


def _climb(place: int, nodes: list) -> tuple[bytes, list[bytes]]:
    """The digest that a vertex sends on, and for each node the way there: slot, number of siblings and their digests, level by level.

    A vertex with all nodes of its group climbs until one is left, a lone leaf not at all; any other climbs ``LEVELS`` levels.
    """
    digests, ways, under = [n[1] for n in nodes], [b""] * len(nodes), [[k] for k in range(len(nodes))]
    climbed = 0
    while len(digests) > 1 if _whole(place, nodes) else climbed < LEVELS:
        runs = [range(k, min(k + ARITY, len(digests))) for k in range(0, len(digests), ARITY)]
        for run in runs:
            for slot, k in enumerate(run):
                step = bytes([slot, len(run) - 1]) + b"".join(digests[x] for x in run if x != k)
                for leaf in under[k]:
                    ways[leaf] += step
        digests = [_hash([digests[k] for k in run]) for run in runs]
        under = [sum((under[k] for k in run), []) for run in runs]
        climbed += 1
    return digests[0], ways


def _vertices(messages: RDD, partitions: int) -> tuple[RDD, int]:
    """Messages brought together at their vertices, in order, and how many vertices there are."""
    met = messages.combineByKey(lambda m: [m], lambda got, m: [*got, m], lambda a, b: a + b, partitions).mapValues(lambda got: sorted(got, key=lambda m: m[0]))
    met.persist(StorageLevel.MEMORY_AND_DISK)
    met.checkpoint()
    count = met.count()
    met.unpersist()
    return met, count


def _rise(messages: RDD, supersteps: int) -> tuple[list[RDD], RDD]:
    """The vertices of every superstep, and (group, (digest, superstep)) of those at the top of their group."""
    steps, tops, partitions, share = [], [], messages.getNumPartitions(), 0.0
    for level in range(1, supersteps + 1):
        vertices, count = _vertices(messages, partitions)
        share = share or max(1.0, count / partitions)
        partitions = max(1, min(partitions, math.ceil(count / BLOCK / share)))
        finished = lambda v: _whole(v[0][1], v[1])
        tops.append(vertices.filter(finished).map(lambda v, level=level: (v[0][0], (_climb(v[0][1], v[1])[0], level))))
        up = lambda v: ((v[0][0], v[0][1] // BLOCK), (v[0][1] % BLOCK, _climb(v[0][1], v[1])[0], v[1][-1][2], None))
        messages = vertices.filter(lambda v: not finished(v)).map(up)
        steps.append(vertices)
    return steps, messages.context.union(tops).coalesce(steps[0].getNumPartitions())


def _down(vertex: tuple) -> Iterator[tuple]:
    """From ((group, place), (nodes, (context, path))) a row for each node: its place, context, path from it to the root, and itself."""
    (group, place), (nodes, (context, path)) = vertex
    for node, way in zip(nodes, _climb(place, nodes)[1]):
        yield (group, place * BLOCK + node[0]), context, way + path, node


def _sink(steps: list[RDD], starts: RDD):
    """Paths from the tops in ``starts`` ((level, ((group, 0), (context, path)))) down to the leaves."""
    paths = rows = None
    for level in range(len(steps), 0, -1):
        vertices = steps[level - 1]
        here = starts.filter(lambda s, level=level: s[0] == level).map(lambda s: s[1])
        paths = here if paths is None else here.union(paths)
        n = vertices.getNumPartitions()
        rows = vertices.join(paths.partitionBy(n), n).flatMap(_down)
        paths = rows.map(lambda r: (r[0], (r[1], r[2])))
    return rows


def manifest(leaves: DataFrame, group_col: str = "source", id_col: str = "doc_id", leaf_col: str = "leaf", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root (lowercase hex), path (for ``verify``), and carried columns as ``in_<name>``.

    The path has for each level from the leaf to the root a byte for the slot among its run, one for the number of its siblings, and their digests.
    """
    spark = leaves.sparkSession
    folder = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    names = [f"in_{name}" for name in carry]
    given = leaves.select(leaves[group_col].alias("group"), F.unhex(leaves[leaf_col]).alias("digest"), leaves[id_col].alias("doc_id"), *carried(leaves, carry))
    given.write.parquet(folder)
    stored = spark.read.schema(given.schema).parquet(folder).withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("tie")]
    ordered = stored.repartitionByRange(*order).sortWithinPartitions(*order).select("group", "digest", "doc_id", *names).rdd
    kinds = StructType.fromDDL("doc_id long, leaf string, subroot string, root string, path binary").fields
    kinds[0].dataType = given.schema["doc_id"].dataType
    schema = StructType([*kinds, *(given.schema[name] for name in names)])

    starts, groups, most = _starts(ordered.mapPartitionsWithIndex(_summary).collect())
    if not groups:
        return spark.createDataFrame([], schema)
    steps, tops = _rise(ordered.mapPartitionsWithIndex(_numbered(starts)), _steps(most))
    subroots = tops.map(lambda t: ((DATASET, t[0] // BLOCK), (t[0] % BLOCK, t[1][0], t[0] == groups - 1, (t[0], t[1][1]))))
    over, [(_, (root, height))] = (found := _rise(subroots, _steps(groups)))[0], found[1].collect()

    top = spark.sparkContext.parallelize([(height, ((DATASET, 0), (None, b"")))], 1)
    placed = _sink(over, top).map(lambda r: (r[3][3][1], ((r[3][3][0], 0), (r[3][1], r[2]))))
    top_hex = root.hex()
    rows = _sink(steps, placed).map(lambda r: (r[3][3][0], r[3][1].hex(), r[1].hex(), top_hex, r[2], *r[3][3][1:]))
    return spark.createDataFrame(rows, schema, verifySchema=False)


# -- verification -------------------------------------------------------------------------------------------------------------


def fold(leaf: str, path: bytes) -> tuple[str, str]:
    """SHA-256 of the siblings on the path, and the root that the leaf leads to."""
    own, seen, at = leaf, [], 0
    while at < len(path):
        slot, many = path[at], path[at + 1]
        digests = [path[at + 2 + 32 * k : at + 34 + 32 * k].hex() for k in range(many)]
        seen += digests
        own = hashlib.sha256("".join([*digests[:slot], own, *digests[slot:]]).encode()).hexdigest()
        at += 2 + 32 * many
    return hashlib.sha256("".join(seen).encode()).hexdigest(), own


def _folded(leaf: pd.Series, path: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fold(a, b) for a, b in zip(leaf, path)], columns=["proof_sha256", "folded_root"])


def verify(rows: DataFrame, presented: str) -> DataFrame:
    """The manifest's rows with proof_sha256, folded_root (from the leaf in column ``presented`` and the siblings) and verified."""
    folding = F.pandas_udf(_folded, "proof_sha256 string, folded_root string")
    folded = rows.withColumn("folded", folding(F.col(presented), F.col("path")))
    return folded.select(*rows.columns, "folded.proof_sha256", "folded.folded_root", (F.col("folded.folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, source, doc_id, {_LEAF.format('text')} AS leaf, {_LEAF.format("CASE WHEN xor({0}, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END".format(_CRC))} AS given FROM documents),
o AS (SELECT r, doc_id, leaf, given, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d),
t(g, l, i, h) AS (SELECT g, 0, i, leaf FROM o UNION ALL SELECT g, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE n > 1 GROUP BY g, l, i // 3),
s AS (SELECT g, l, i, h, count(*) OVER (PARTITION BY g, l) AS n, coalesce(string_agg(h, '') OVER (PARTITION BY g, l, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY g, l, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM t),
w(r, g, l, i, p, f) AS (SELECT r, g, 0, i, '', given FROM o UNION ALL SELECT w.r, w.g, w.l + 1, w.i // 3, p || a || b, sha256(a || f || b) FROM w JOIN s ON s.g = w.g AND s.l = w.l AND s.i = w.i WHERE s.n > 1),
v AS (SELECT r, g, arg_max(p, l) AS p, arg_max(f, l) AS f FROM w GROUP BY r, g),
u AS (SELECT g, h FROM s WHERE n = 1),
tt(l, i, h) AS (SELECT 0, g, h FROM u UNION ALL SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM tt) WHERE n > 1 GROUP BY l, i // 3),
ss AS (SELECT l, i, h, count(*) OVER (PARTITION BY l) AS n, coalesce(string_agg(h, '') OVER (PARTITION BY l, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY l, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM tt),
ww(r, l, i, p, f) AS (SELECT r, 0, g, p, f FROM v UNION ALL SELECT ww.r, ww.l + 1, ww.i // 3, p || a || b, sha256(a || f || b) FROM ww JOIN ss ON ss.l = ww.l AND ss.i = ww.i WHERE ss.n > 1),
vv AS (SELECT r, arg_max(p, l) AS p, arg_max(f, l) AS f FROM ww GROUP BY r), q AS (SELECT h FROM ss WHERE n = 1)
SELECT doc_id, leaf, u.h AS subroot, q.h AS root, sha256(vv.p) AS proof_sha256, vv.f AS folded_root, vv.f = q.h AS verified
FROM o JOIN vv USING (r) JOIN u ON u.g = o.g CROSS JOIN q"""
