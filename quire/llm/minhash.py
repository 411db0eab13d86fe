"""Near-duplicates by circulant MinHash, banding and exact verification.

A document's set holds the hashes of its distinct shingles of five words. One permutation spreads a shingle over
2**32 places, a second one, shifted circularly by 0, 1, 2 ... places, gives every coordinate of the signature; bands
of coordinates are buckets. Work goes by classes of equal sets, so copies cost nothing, and no step lists the pairs
of a bucket:

1. In each bucket every class meets the bucket's smallest class; of the classes it met, the one it met most often is
   compared with it on full sets. Connected components of these links join most of every group.
2. Classes whose buckets still hold more than one component are joined on their rarest shingles (a prefix filter,
   exact for the threshold: sets this similar share one of them), across components only, and compared likewise.

Two classes at a similarity of exactly 0.75 share no band with a probability of 2 in 100,000 (at 0.8 it is 1 in 10
million), so step 1 by itself can lose a link. With ``exact`` all classes take step 2, which loses none and costs the
rarest quarter of all shingles in the shuffle.

A set is its shingles' 64-bit hashes: comparisons are of these, and sets are one class if 128 bits of them agree.
Tables that several steps read are written to the shared folder, and removed there once no later step reads them.
Rows carry one set at most, two when compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import BLANKS, Words, carried, chunks, mix, remove_folder, shared_dir, with_carried

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 5
SALTS = 16
#: Rows of two ids that are sent to all executors at most; larger candidate tables are joined by shuffling.
BROADCAST_ROWS = 1_000_000
_SLOT_BITS = 20
_SLOTS, _PART, _LEAVES = 1 << _SLOT_BITS, 1 << 12, 1 << 10
_WEIGHTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, with duplicates, and the bounds of each row's."""
    h, many = words.hashes(), np.diff(words.rows)
    count = np.where(many >= WORDS, many - WORDS + 1, np.minimum(many, 1))
    bounds = np.r_[0, np.cumsum(count)]
    row = np.repeat(np.arange(len(many)), count)
    first = words.rows[row] + np.arange(len(row)) - bounds[row]
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(row), np.uint64)
    for k in range(WORDS):
        total += np.where(k < many[row], padded[first + k] * _WEIGHTS[k], np.uint64(0))
    return mix(total + np.minimum(many[row], WORDS).astype(np.uint64)), bounds


def sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, at = shingles(Words(data, bounds, BLANKS))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        s = np.sort(h[a:b])
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(len(s))).to_bytes(8, "big")


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(groups: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (sets x bands) of sets that are not empty."""
    place = (mix(np.concatenate(groups) ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum([0] + [len(g) for g in groups[:-1]])
    keys = np.zeros((bands, len(groups)), np.uint64)
    for band in range(bands):
        key = np.full(len(groups), band + 1, np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(_permute(place + np.uint32(band * rows + row)), start)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[band] = key
    return keys.T.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, set_key, bands (null without shingles) of each row, and the columns to carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in chunks(batch.column(1)):
                groups = sets(data, bounds)
                some = [g for g in groups if len(g)]
                keys = iter(signatures(some) if some else ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(map(len, groups), pa.int64()), pa.array([set_key(g) for g in groups], pa.binary()), pa.array([next(keys).tolist() if len(g) else None for g in groups], pa.list_(pa.int64())), *(c.slice(low, high - low) for c in batch.columns[2:])],
                    names=["doc_id", "n_shingles", "set_key", "bands", *more],
                )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), *carried(docs, carry))
    more = rows.columns[2:]
    return rows.mapInArrow(run, with_carried("doc_id long, n_shingles long, set_key binary, bands array<long>", rows, more))


def set_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (the sorted hashes as bytes) of the wanted classes (node, rep, set_key), read from their smallest documents."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).join(wanted, F.col("k").eqNullSafe(F.col("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in chunks(batch.column(0)):
                groups, keys = sets(data, bounds), batch.column(2).slice(low, high - low).to_pylist()
                own = [set_key(g) == k for g, k in zip(groups, keys)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low).filter(pa.array(own, pa.bool_())), pa.array([g.tobytes() for g, mine in zip(groups, own) if mine], pa.binary())], names=["node", "shingles"])

    return texts.select("t", "node", "set_key").mapInArrow(run, "node binary, shingles binary")


def alike(a: bytes, b: bytes) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= PERCENT * (len(x) + len(y) - same)


def verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are alike; ``rows`` has the sets by node."""
    left = pairs.join(rows.withColumnsRenamed({"node": "v", "shingles": "y"}), "v")
    both = left.join(rows.withColumnsRenamed({"node": "u", "shingles": "x"}), "u").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = pa.array([alike(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield batch.select([0, 1]).filter(yes)

    return both.mapInArrow(run, "u binary, v binary")


class Tables:
    """Tables of one run in the shared folder, each written once and read again."""

    def __init__(self, spark) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/minhash-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def drop(self, low: int, high: int) -> None:
        """Remove the tables from number ``low`` up to ``high``, not included; the caller has written all that was made of them."""
        for n in range(low, high):
            remove_folder(self.spark, f"{self.folder}/{n}")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, comp (its component's smallest node) of every node in ``links`` (u, v), by alternating large and small stars.

    Each star takes a minimum for each node and joins it back, so a node with many links is no group of rows; rounds
    end when a round changes no link.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        ways = links.union(links.select("v", "u")) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = ways.join(least, "u")
        if large:
            out = out.filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
        else:
            out = out.select(F.col("m").alias("u"), "v").union(least.select(F.col("m"), F.col("u")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    links = tables.keep(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    before = mark(links)
    while before[0]:
        links = tables.keep(star(star(links, True), False))
        after = mark(links)
        tables.drop(tables.n - 1, tables.n)
        if after == before:
            break
        before = after
    return links.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(links.select("u", "u").distinct())


def rarest(rows: DataFrame) -> DataFrame:
    """node, token, place, n: of each set of n the shingles that cannot all be missing from a set like it, the rarest first.

    Shingles are ordered by how often their slot of ``_SLOTS`` occurs in all these sets, then by hash: one order
    for all sets, which is all that the filter needs to be exact. The table of slots has a fixed size.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for low, high, data, _ in chunks(batch.column(0)):
                total += np.bincount(_slot(np.ascontiguousarray(data).view(np.uint64)), minlength=_SLOTS)
        parts = total.reshape(-1, _PART)
        some = np.flatnonzero(parts.any(axis=1))
        leaf = TaskContext.get().partitionId() % _LEAVES
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([leaf] * len(some), pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "leaf", "counts"])

    def total(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "leaf": table.column("leaf")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    # sums in two levels: a group holds the slots of _PART from one task in _LEAVES, then of _LEAVES sums
    schema = "part int, leaf int, counts binary"
    often = np.zeros((_SLOTS // _PART, _PART), np.int64)
    for r in rows.select("shingles").mapInArrow(tally, schema).groupBy("part", "leaf").applyInArrow(total, schema).groupBy("part").applyInArrow(total, schema).toLocalIterator():
        often[r["part"]] = np.frombuffer(r["counts"], np.int64)
    often = np.minimum(often.ravel(), np.iinfo(np.int32).max).astype(np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, token, place, size = [], [], [], []
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                need = len(s) - -(-PERCENT * len(s) // 100) + 1
                best = s[np.lexsort((s, shared.value[_slot(s)]))[:need]]
                node += [batch.column(0)[i].as_py()] * len(best)
                token.append(best.view(np.int64))
                place += range(len(best))
                size += [len(s)] * len(best)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(np.concatenate(token) if token else np.zeros(0, np.int64)), pa.array(place, pa.int64()), pa.array(size, pa.int64())], names=["node", "token", "place", "n"])

    return rows.select("node", "shingles").mapInArrow(run, "node binary, token long, place long, n long")


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _node(rep: Column, key: Column) -> Column:
    """16 bytes that name a class and sort by its smallest id."""
    order = F.coalesce(rep, F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.unhex(F.lpad(F.hex(order), 16, "0")), F.substring(key, 1, 8))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id, kept, and the columns to carry under ``in_`` names.

    A text without words (or null) has no shingles, is linked with nothing and kept. Rows with equal ids and
    different texts are apart; with equal texts they are alike and all kept if theirs is the smallest id. Null ids
    come after all others: such rows are kept only in components without an id. Other columns are not read. Carried
    columns are stored once more, so long ones are better joined. ``exact`` finds every link (see above).
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    sketches = tables.keep(sketch(docs, id_col, text_col, carry))
    more = sketches.columns[4:]
    classes = sketches.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = tables.keep(classes.withColumn("node", _node(F.col("rep"), F.col("set_key"))))

    buckets = classes.select(F.explode("bands").alias("band"), "node", "n")
    hubs = buckets.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    met = tables.keep(buckets.join(hubs, "band"))
    first = met.filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("hits")).groupBy("node").agg(F.max(F.struct("hits", "hub")).alias("best"))
    pairs = tables.keep(first.select(F.col("best.hub").alias("u"), F.col("node").alias("v")))
    links = tables.keep(verify(pairs, set_rows(docs, _of(classes, pairs), id_col, text_col)))
    labels = tables.keep(components(links, tables))

    split = met.join(labels, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = split.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("band")
    still = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")) if exact else split.join(mixed, "band").select("node", "comp").distinct()
    open_nodes = tables.keep(still)
    tables.drop(3, 5)
    if open_nodes.limit(1).count():
        begun = tables.n
        wanted = open_nodes.select("node").join(classes.select("node", "rep", "set_key"), "node")
        rows = tables.keep(set_rows(docs, wanted, id_col, text_col))
        tokens = tables.keep(rarest(rows).join(open_nodes, "node"))
        # in each token's rows the largest component stays on one side: its own rows, which are linked already, do not meet
        sizes = tokens.groupBy("token", "comp").agg(F.count("*").alias("size"))
        major = sizes.groupBy("token").agg(F.max(F.struct("size", "comp"))["comp"].alias("major"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
        some = tokens.join(major, "token")
        side = lambda k: [F.col("node").alias(k), F.col("comp").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("place").alias(f"p{k}")]
        x, y = some.filter("comp != major").select("token", *side("u")), some.select("token", "major", *side("v"))
        apart = (F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("major")) | (F.col("cu") < F.col("cv")))
        # sets that are alike share so much that the first shingle they share comes this early in both
        early = [(F.col(f"n{k}") - F.col(f"p{k}")) * (100 + PERCENT) >= PERCENT * (F.col("nu") + F.col("nv")) for k in "uv"]
        close = apart & (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * PERCENT) & early[0] & early[1]
        likely = tables.keep(x.join(y, "token").filter(close).select("u", "v").distinct())
        links = links.union(tables.keep(verify(likely, rows)))
        labels = tables.keep(components(links, tables))
        tables.drop(begun + 1, tables.n)

    # only classes with another id than their own, for every salt, so that a class of a third of all rows is many groups
    named = labels.join(classes.select(F.col("node").alias("comp"), F.col("rep").alias("component_id")), "comp")
    changed = classes.select("node", "set_key", "rep", "copies").join(named, "node", "left").select("set_key", F.when(F.col("comp").isNotNull(), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"), F.lit(True).alias("grouped"), (F.col("comp").isNotNull() | (F.col("copies") > 1)).alias("many")).filter("many").drop("many")
    changed = changed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = sketches.select("doc_id", "n_shingles", "set_key", *more, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(changed, ["set_key", "salt"], "left")
    component = F.when(F.col("grouped") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)


def _of(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, rep, set_key of every class in the pairs."""
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes.select("node", "rep", "set_key"), "node")
