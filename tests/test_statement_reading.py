"""How statements are read: recurring lines once, words as Spark's expressions cut them, cells settled in their row."""

import random
import sys

from oracle import SF_DIR
from pyspark.sql import functions as F

from quire.operators import statements
from quire.plans import placement


def test_words_are_those_of_the_expression(spark):
    rng = random.Random(6)
    signs = [chr(c) for c in [*range(0x20, 0x250), 0x300, 0x345, 0x903, 0xA0, 0x85, 0x2028, 0x200C, 0x200D, 0x2160, 0x24B6, 0xB2, 0x0660, 0x3000, 0x4E00, 0x1F130, 0x1F600, 9, 11, 12, 0x1C, 0x1F]]
    texts = ["".join(rng.choice(signs) for _ in range(12)) for _ in range(400)] + ["".join(rng.choice(" \t-$Aa9_\x1c") for _ in range(9)) for _ in range(100)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", statements.norm(F.col("x")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [statements._norm(x) for x in texts]


def test_a_line_that_recurs_is_read_once(monkeypatch):
    seen = []
    read = statements._read
    monkeypatch.setattr(sys.modules["quire.operators.statements"], "_read", lambda line, *rest: seen.append(line) or read(line, *rest))
    reader = statements._Reader(["Current assets"], True)
    for n in range(50):
        opened, items, totals, _ = reader.statement(f"CURRENT ASSETS\r\nCash {n}\rTotal 7")
        assert list(opened) == [0] and [x.value for x in items[0]] == [str(n)] and totals == {0: "7"}
    assert len(seen) == 52


def test_what_is_read_does_not_pile_up(monkeypatch):
    monkeypatch.setattr(statements._Reader, "MOST", 5)
    reader = statements._Reader(["Current assets"], True)
    for n in range(50):
        reader.statement(f"Cash {n}")
    assert len(reader.lines) <= 5


def test_cells_of_a_statement_are_settled_in_its_row(spark):
    plan = placement.e9_dynamic_fill(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    filled = plan[: plan.index("ArrowEvalPython")]
    assert "Aggregate" not in filled and "Generate" in filled


def test_lines_without_signs_are_not_cut_into_words(monkeypatch):
    cut = []
    norm = statements._norm
    monkeypatch.setattr(sys.modules["quire.operators.statements"], "_norm", lambda x: cut.append(x) or norm(x))
    reader = statements._Reader(["Current assets", "***"], True)
    plain = statements._Reader(["Current assets"], True)
    cut.clear()
    opened, items, *_ = plain.statement("Current Assets\nCash 5\nFixed. asset 6\nCafé 7")
    assert list(opened) == [0] and [x.label for x in items[0]] == ["Cash", "Fixed. asset", "Café"]
    assert cut == ["Current Assets", "Fixed. asset 6", "Café 7"]
    assert list(reader.statement("---\n--\n!!")[0]) == [1], "a name without words is like any other without words"
