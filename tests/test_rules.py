"""Rules as rows of a table: cases of every kind, nulls, empty tables and types without rules."""

from quire.functions.rule_sets import RULE_SETS, rule_rows, rule_table
from quire.operators.rules import checks, verdicts

DOCS = "doc_id int, doc_type string, table_mode boolean, rules string"
FIELDS = "doc_id int, pos int, name string, value string, key string"
ROWS = "doc_id int, cells map<string,string>, r string"
RULES = "doc_type string, no int, kind string, columns array<string>, args array<string>"


def held(spark, docs, fields=(), rows=(), rules=None):
    table = rule_table(spark) if rules is None else spark.createDataFrame(rules, RULES)
    out = checks(spark.createDataFrame([(*d, "clash") for d in docs], DOCS), spark.createDataFrame([(*f, "clash") for f in fields], FIELDS), spark.createDataFrame([(*r, "clash") for r in rows], ROWS), table)
    return out, sorted((r.doc_id, r.check, r.status) for r in out.collect())


def test_rules_have_twelve_types_and_own_numbers():
    rows = rule_rows()
    assert len(RULE_SETS) == 12 and len({r[:2] for r in rows}) == len(rows)


def test_fields(spark):
    fields = [
        (1, 0, "pay_period", "2024-02-30"), (1, 1, "Gross  Pay", "1"), (1, 2, "GROSS PAY:", " 1,250.00 "), (1, 3, "Net Pay", "nan"), (1, 4, "_label_Employee Name", "x"), (1, 5, None, "lost"), (1, 6, "Other", " N/A "), (1, 7, "Other", "n/a"),
        (2, 0, "Audit opinion", "QUALIFIED, but"), (2, 1, "Report Date", "2024-2-9"), (2, 2, "Firm", None),
    ]
    out, got = held(spark, [(1, "payslip", None), (2, "audit_report", False), (3, "poem", True), (4, None, True), (5, "tax_form", False)], fields)
    assert got == sorted([
        (1, "req:Employee Name", "MISSING"), (1, "req:Pay Period From", "PASS"), (1, "req:Pay Period To", "PASS"), (1, "req:Gross Pay", "PASS"), (1, "req:Net Pay", "PASS"), (1, "num:Gross Pay", "PASS"), (1, "num:Net Pay", "FAIL"), (1, "date:Pay Period From", "FAIL"), (1, "date:Pay Period To", "FAIL"), (1, "prohib:Other", "FAIL"), (1, "prohib:Other", "FAIL"),
        (2, "req:Company Audited", "MISSING"), (2, "req:Audit Firm", "MISSING"), (2, "req:Audit Opinion", "PASS"), (2, "req:Report Date", "PASS"), (2, "date:Report Date", "PASS"), (2, "pat:Audit Opinion", "PASS"),
        (3, "schema", "SKIP"), (4, "schema", "SKIP"), (5, "req:Taxpayer Name", "MISSING"), (5, "req:Tax Year", "MISSING"),
    ])
    scores = {r.doc_id: (r.passed, r.checks, r.ok) for r in verdicts(out).collect()}
    assert scores == {1: (5, 11, False), 2: (4, 6, False), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 2, False)}


def test_rows(spark):
    good = {"Item": "a", "SKU": "b", "Qty": "2", "Price": "1,000", "Item Subtotal": "2040"}
    invoices = [(1, good), (1, good | {"SKU": " "}), (2, good | {"Item Subtotal": "2041"}), (2, good | {"Qty": "two"}), (2, {"Price": "-1"}), (2, None), (3, good)]
    _, got = held(spark, [(1, "sales_invoice", True), (2, "sales_invoice", True), (3, "sales_invoice", False), (4, "sales_invoice", True)], rows=invoices)
    names = ["table:rows", "col:Item", "col:SKU", "col:Qty", "col:Price", "col:Item Subtotal", "cons:QtyxPrice=Item Subtotal"]
    want = {1: "PASS PASS FAIL PASS PASS PASS PASS", 2: "PASS FAIL FAIL FAIL FAIL PASS WARN", 4: "FAIL FAIL FAIL PASS PASS PASS"}
    assert got == sorted((doc, name, status) for doc, line in want.items() for name, status in zip(names, line.split()))


def test_own_rules_hot_documents_and_empty_tables(spark):
    own = [("poem", 0, "exclusive", ["a", "b"], []), ("poem", 1, "keywords", ["a"], ["rose", "thorn"]), ("poem", 2, "least_rows", [], ["5000"])]
    rows = [(1, {"a": "x", "b": " "})] * 4999 + [(1, {"a": "A Thorn"}), (2, {"a": "x", "b": "y"})]
    assert held(spark, [(1, "poem", True), (2, "poem", True)], rows=rows, rules=own)[1] == sorted([(1, "cons:a_xor_b", "PASS"), (1, "cons:row:rose", "PASS"), (1, "table:rows", "PASS"), (2, "cons:a_xor_b", "WARN"), (2, "cons:row:rose", "FAIL"), (2, "table:rows", "FAIL")])
    assert held(spark, [])[1] == [] and held(spark, [(1, "poem", True)], rules=[])[1] == [(1, "schema", "SKIP")]
