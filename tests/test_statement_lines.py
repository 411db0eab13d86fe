"""Lines of statements, each read once."""

from quire.plans import documents


def test_odd_lines_have_their_labels_and_amounts(spark):
    texts = ["Net: (1,234.50)\n--- no 5\nGross:: $(70)\n a\t$-5 \nRent  ($8.)\n\t9\n:: 4\nTotal (1234.5)\nA\x01b 7\nx\x017\nnet 2", "Sum 1,23\nSum  6\nFee 5 \nLate 6\x85", "", None, "none"]
    got = {(r.doc_id, r.label): (r.value, r.line_no) for r in documents.parse_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[0, "net"] == ("2", 10) and got[0, "gross"] == ("-70", 2) and got[0, "a"] == ("-5", 3) and got[0, "rent"] == ("-8.", 4) and got[0, "a b"] == ("7", 8)
    assert {k[0] for k in got} <= {0, 1} and len([k for k in got if k[0] == 0]) == 5 and not [k for k in got if "x" in k[1]]


def test_patterns_stand_once_in_the_plan(spark):
    df = documents.parse_lines(spark.createDataFrame([(1, "a 5")], "doc_id int, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]{1,3}") == len(documents.LINE_PATTERNS)
