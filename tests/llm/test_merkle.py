"""The manifest against trees built in plain lists, and what tampering does to it."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf its siblings level by level as (those before, those after)."""
    nodes, owners, paths = list(leaves), [[k] for k in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(k, min(k + 3, len(nodes))) for k in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for leaf in owners[k]:
                    paths[leaf].append(([nodes[x] for x in run if x < k], [nodes[x] for x in run if x > k]))
        owners = [sum((owners[k] for k in run), []) for run in runs]
        nodes = [H(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded from the presented leaf) of rows (group, doc_id, leaf, presented)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(row[0], []).append(row)
    built = [(members, *tree([m[2] for m in members])) for members in groups.values()]
    root, over = tree([b[1] for b in built])
    out = []
    for (members, subroot, paths), above in zip(built, over):
        for member, path in zip(members, paths):
            seen, own = "", member[3]
            for before, after in [*path, *above]:
                seen += "".join(before + after)
                own = H(*before, own, *after)
            out.append((member[1], member[2], subroot, root, H(seen), own))
    return sorted(out, key=repr)


def rows_of(spark, rows, parts=5):
    schema = "source string, doc_id long, leaf string, presented string, path string, root string"
    df = spark.createDataFrame([(*r, "p", "r") for r in rows], schema).repartition(parts)
    found = merkle.verify(merkle.manifest(df, carry=["presented", "path"]), "in_presented")
    got = found.collect()
    assert all(r.verified == (r.folded_root == r.root) and r.in_path == "p" for r in got)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=repr)


def made(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for name, n in sizes.items():
        rows += [(name, i, leaf := H(f"{name} {i}"), leaf if i % 2 else H("other")) for i in rng.sample(range(10 * n), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 3, 28])
def test_one_group(spark, n):
    rows = made({"a": n})
    assert rows_of(spark, rows) == plain(rows)


def test_groups_of_all_sizes_across_partitions(spark):
    rows = made({None: 5, "": 3, "z": 1, "é": 40, "Z": 700, "b": 1, "a": 27, "ab": 81, "hot" * 50: 2})
    assert rows_of(spark, rows, 9) == plain(rows)


def test_many_groups(spark):
    rows = made({f"s{k}": 1 + k % 2 for k in range(120)})
    assert rows_of(spark, rows) == plain(rows)


def test_null_and_repeated_ids_and_repeated_rows(spark):
    rows = made({"a": 12, None: 3})
    rows += [("a", None, H("n"), H("n")), (None, None, H("n"), H("x")), ("a", rows[0][1], H("again"), H("again"))]
    assert rows_of(spark, rows) == plain(rows)
    twice = rows + [("r", 1, H("same"), H("same"))] * 7
    assert rows_of(spark, twice) == plain(twice)


def test_no_rows(spark):
    assert rows_of(spark, []) == []


def test_leaf_of_nulls_and_lengths(spark):
    df = spark.createDataFrame([(1, "é", None), (None, None, None), (-3, "", "a:b")], "i long, s string, t string")
    got = [r[0] for r in df.select(merkle.leaf_digest([F.col(c) for c in "ist"])).collect()]
    assert got == [H("1:1", "2:é", "-"), H("---"), H("2:-3", "0:", "3:a:b")]


def test_a_changed_leaf_changes_the_root_it_leads_to(spark):
    rows = made({"a": 30, "b": 4})
    found = {r[0:2]: r for r in rows_of(spark, rows)}
    for _, i, leaf, given in rows:
        assert (found[i, leaf][5] == found[i, leaf][3]) == (leaf == given)
