"""Rules of the document types, as rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Values that stand for nothing.
BLANKS = ["N/A", "null", "None", "n/a"]
ZEROS = ["0", "0.00"]

# What the documents of each type are held against, as (kind of rule, columns, arguments). A kind that looks
# at one column is given several columns as several rules.
RULE_SETS: dict[str, list[tuple[str, list[str], list[str]]]] = {
    "cheque": [
        ("required", ["Cheque Number", "Date", "Bank Name", "Drawer Name", "Payee", "Amount", "Amount in Words", "Memo", "Authorized By", "Routing Number", "Account Number"], []),
        ("numeric", ["Amount"], []),
        ("date", ["Date"], []),
        ("pattern", ["Routing Number"], [r"^[A-Z]?\d{9}[A-Z]?$"]),
        ("pattern", ["Amount"], [r"^\d+(\.\d{1,2})?$"]),
        ("prohibited", [], BLANKS + ZEROS),
    ],
    "sales_invoice": [
        ("prohibited", [], BLANKS),
        ("least_rows", [], ["1"]),
        ("filled", ["Item", "SKU"], []),
        ("cells_numeric", ["Qty"], []),
        ("cells_positive", ["Price", "Item Subtotal"], []),
        ("product", ["Qty", "Price", "Item Subtotal"], ["2"]),
    ],
    "purchase_order": [
        ("required", ["PO Number", "Date", "Vendor Name", "Buyer Name"], []),
        ("numeric", ["Total Amount"], []),
        ("date", ["Date"], []),
        ("prohibited", [], BLANKS),
        ("least_rows", [], ["1"]),
        ("filled", ["Description"], []),
        ("cells_numeric", ["Quantity"], []),
        ("cells_positive", ["Unit Price"], []),
    ],
    "receipt": [
        ("required", ["Merchant Name", "Date", "Total Amount"], []),
        ("numeric", ["Total Amount"], []),
        ("date", ["Date"], []),
        ("pattern", ["Total Amount"], [r"^\d+(\.\d{1,2})?$"]),
        ("prohibited", [], BLANKS),
    ],
    "pay_order": [
        ("required", ["Pay Order Number", "Issue Date", "Amount (Figures)", "Amount (Words)", "Beneficiary", "Issuing Bank"], []),
        ("numeric", ["Amount (Figures)"], []),
        ("date", ["Issue Date"], []),
        ("pattern", ["Amount (Figures)"], [r"^\d+(\.\d{1,2})?$"]),
        ("prohibited", [], BLANKS + ZEROS),
    ],
    "bank_statement": [
        ("prohibited", [], BLANKS),
        ("least_rows", [], ["3"]),
        ("filled", ["Description"], []),
        ("exclusive", ["Debit", "Credit"], []),
    ],
    "payslip": [
        ("required", ["Employee Name", "Pay Period From", "Pay Period To", "Gross Pay", "Net Pay"], []),
        ("numeric", ["Gross Pay", "Net Pay"], []),
        ("date", ["Pay Period From", "Pay Period To"], []),
        ("prohibited", [], BLANKS),
    ],
    "expense_report": [
        ("required", ["Employee Name", "Report Period From", "Report Period To", "Total Claimed"], []),
        ("numeric", ["Total Claimed"], []),
        ("date", ["Report Period From", "Report Period To"], []),
        ("prohibited", [], BLANKS),
        ("least_rows", [], ["1"]),
        ("filled", ["Description"], []),
        ("cells_positive", ["Amount"], []),
    ],
    "tax_form": [
        ("required", ["Taxpayer Name", "Tax Year"], []),
        ("prohibited", [], BLANKS),
    ],
    "income_statement": [
        ("prohibited", [], BLANKS),
        ("least_rows", [], ["5"]),
        ("filled", ["Description"], []),
        ("cells_numeric", ["Current Period"], []),
        ("keywords", ["Description"], ["net income", "net profit", "net loss"]),
        ("keywords", ["Description"], ["revenue", "net sales", "total revenue"]),
    ],
    "balance_sheet": [
        ("prohibited", [], BLANKS),
        ("least_rows", [], ["10"]),
        ("filled", ["Description"], []),
        ("cells_numeric", ["Amount"], []),
        ("keywords", ["Description"], ["total assets"]),
        ("keywords", ["Description"], ["total liabilities"]),
        ("keywords", ["Description"], ["total equity", "shareholders equity", "stockholders equity"]),
    ],
    "audit_report": [
        ("required", ["Company Audited", "Audit Firm", "Audit Opinion", "Report Date"], []),
        ("date", ["Report Date"], []),
        ("pattern", ["Audit Opinion"], [r"(?i)(unqualified|qualified|adverse|disclaimer)"]),
        ("prohibited", [], BLANKS),
    ],
}

#: Kinds of rules that look at several columns of one row.
WIDE = ["product", "exclusive", "prohibited", "least_rows"]


def rule_rows() -> list[tuple[str, int, str, list[str], list[str]]]:
    """(doc_type, no, kind, columns, args) of every rule."""
    out = []
    for kind_of_doc, rules in RULE_SETS.items():
        each = [(kind, columns, args) for kind, names, args in rules for columns in ([names] if kind in WIDE else [[n] for n in names])]
        out += [(kind_of_doc, no, *rule) for no, rule in enumerate(each)]
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    """The same as a table; a user's own rules are another one of this form."""
    return spark.createDataFrame(rule_rows(), "doc_type string, no int, kind string, columns array<string>, args array<string>")
