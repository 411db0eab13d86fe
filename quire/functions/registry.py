"""Document types: classification hints and field lists. Four sets of types are kept apart because their rules differ."""

from __future__ import annotations

# Phrases that hint at a document type.
HINTS = {
    "sales_invoice": [
        "invoice", "invoice no", "invoice number", "inv-", "inv #", "tax invoice", "sales invoice", "commercial invoice", "bill to", "sold to", "amount due", "due date", "payment terms",
        "subtotal", "vat", "gst", "total amount due", "please pay",
    ],
    "purchase_order": [
        "purchase order", "p.o.", "po number", "po #", "po no", "purchase order number", "vendor", "supplier", "ship to", "deliver to", "ordered by", "purchasing", "requisition",
    ],
    "cheque": [
        "cheque", "check", "pay to the order of", "pay to the order", "in favour of", "in favor of", "amount in words", "authorized signature", "routing number", "micr", "non-negotiable", "a/c payee",
        "not negotiable", "memo", "drawer", "payee", "chq",
    ],
    "receipt": [
        "receipt", "thank you for your purchase", "your receipt", "sale receipt", "transaction", "subtotal", "change due", "amount paid", "payment method", "visa", "mastercard", "cash",
        "your cashier", "store #", "table #", "order #",
    ],
    "pay_order": [
        "pay order", "demand draft", "dd no", "banker's cheque", "banker's draft", "cashier's cheque", "cashier's check", "payable at", "in favour of", "in favor of", "beneficiary",
        "applicant", "issuing bank", "encashable at", "pay order no", "valid until", "instrument no",
    ],
    "bank_statement": [
        "bank statement", "account statement", "statement of account", "opening balance", "closing balance", "available balance", "balance brought forward", "balance carried forward",
        "sort code", "account number", "transactions", "debit", "credit", "withdrawal", "deposit", "current account", "savings account",
    ],
    "payslip": [
        "payslip", "pay slip", "salary slip", "pay stub", "earnings statement", "gross pay", "net pay", "basic salary", "paye", "national insurance", "ni number", "tax code", "employee number", "payroll",
        "deductions", "take home", "pay period", "ytd",
    ],
    "expense_report": [
        "expense report", "expense claim", "expense form", "reimbursement", "employee expenses", "travel expenses", "cost centre", "mileage", "per diem", "out of pocket",
        "business purpose", "receipt attached", "approved by", "total claimed",
    ],
    "tax_form": [
        "tax return", "income tax", "tax form", "assessment year", "tax year", "hmrc", "irs", "pan", "tin", "form 16", "p60", "p45", "w-2", "1099", "itr", "tds", "withholding",
        "taxable income", "tax payable", "refund", "federal income tax", "form 941", "form 1120", "employer identification",
    ],
    "income_statement": [
        "income statement", "profit and loss", "p&l", "statement of operations", "statement of comprehensive income", "revenue", "net income", "gross profit", "operating income",
        "ebitda", "ebit", "earnings per share", "cost of goods sold", "selling general administrative", "interest expense",
    ],
    "balance_sheet": [
        "balance sheet", "statement of financial position", "total assets", "total liabilities", "shareholders equity", "stockholders equity", "current assets", "current liabilities",
        "accounts receivable", "accounts payable", "retained earnings", "as at", "as of", "property plant", "intangible",
    ],
    "audit_report": [
        "audit report", "independent auditor", "auditor's report", "we have audited", "in our opinion", "audit opinion", "unqualified", "qualified opinion", "key audit matters",
        "basis for opinion", "going concern", "material uncertainty", "chartered accountants", "certified public accountants", "pcaob", "icaew", "internal audit", "management letter",
    ],
}

# Fields that each type requires, and which of its fields are numbers or dates.
FIELDS = {
    "sales_invoice": {"required": ["invoice_number", "invoice_date", "vendor_name", "customer_name", "total_amount"], "numeric": ["subtotal", "tax_amount", "total_amount", "unit_price", "line_total", "quantity"], "date": ["invoice_date", "due_date"]},
    "purchase_order": {"required": ["po_number", "po_date", "buyer_name", "vendor_name"], "numeric": ["unit_price", "line_total", "total_amount", "quantity"], "date": ["po_date", "delivery_date"]},
    "cheque": {"required": ["cheque_number", "cheque_date", "bank_name", "drawer_name", "payee", "amount_figures", "amount_words", "memo", "authorized_by", "routing_number", "account_number", "micr_line"], "numeric": ["amount_figures"], "date": ["cheque_date"]},
    "receipt": {"required": ["merchant_name", "date", "total_amount"], "numeric": ["subtotal", "tax_amount", "tip_amount", "total_amount", "change_given"], "date": ["date"]},
    "pay_order": {"required": ["pay_order_number", "issue_date", "issuing_bank", "beneficiary", "amount_figures", "amount_words"], "numeric": ["amount_figures"], "date": ["issue_date", "expiry_date"]},
    "bank_statement": {"required": ["account_holder", "account_number", "statement_period_from", "statement_period_to", "opening_balance", "closing_balance"], "numeric": ["opening_balance", "closing_balance", "debit", "credit", "balance", "total_debits", "total_credits"], "date": ["statement_period_from", "statement_period_to", "transaction_date"]},
    "payslip": {"required": ["employee_name", "pay_period_from", "pay_period_to", "gross_pay", "net_pay", "payment_date"], "numeric": ["gross_pay", "net_pay", "total_deductions"], "date": ["pay_period_from", "pay_period_to", "payment_date"]},
    "expense_report": {"required": ["employee_name", "report_period_from", "report_period_to", "total_claimed"], "numeric": ["amount", "total_claimed", "total_approved"], "date": ["expense_date", "report_period_from", "report_period_to"]},
    "tax_form": {"required": ["taxpayer_name", "taxpayer_id", "tax_year"], "numeric": ["gross_income", "taxable_income", "tax_computed", "tax_withheld", "tax_refund", "balance_due"], "date": ["filing_date", "assessment_date"]},
    "income_statement": {"required": ["company_name", "period_from", "period_to", "total_revenue", "net_income"], "numeric": ["total_revenue", "gross_profit", "operating_income", "net_income", "income_tax_expense"], "date": ["period_from", "period_to"]},
    "balance_sheet": {"required": ["company_name", "as_at_date", "total_assets", "total_liabilities", "total_equity"], "numeric": ["total_assets", "total_liabilities", "total_equity"], "date": ["as_at_date"]},
    "audit_report": {"required": ["company_audited", "audit_firm", "audit_opinion", "report_date"], "numeric": [], "date": ["report_date", "financial_period_from", "financial_period_to"]},
    "other": {"required": [], "numeric": [], "date": []},
}

# Sets of types, each used by rules of its own.
FINANCIAL = ["bank_statement", "income_statement", "balance_sheet", "audit_report", "tax_form", "payslip"]
TABLE_HEAVY = ["bank_statement", "payslip", "expense_report", "sales_invoice", "purchase_order"]
CROSS_CHECKED = ["balance_sheet", "income_statement", "profit_and_loss", "audit_report", "payslip", "bank_statement", "invoice", "purchase_order", "receipt"]
SECTIONED = ["balance_sheet", "income_statement", "audit_report", "payslip"]
CRITICAL = ["balance_sheet", "income_statement", "payslip", "sales_invoice"]
SPANNING = ["audit_report", "balance_sheet", "income_statement", "tax_form"]

# Words that say little about which figure is meant.
GENERIC_COLUMNS = ["total", "amount", "value", "balance", "net", "gross", "subtotal", "debit", "credit", "description"]
GENERIC_LABELS = ["total", "amount", "balance", "net", "gross", "subtotal", "value", "debit", "credit", "description", "item", "quantity", "rate", "date", "name", "number", "ref", "other", "summary", "remarks", "assets", "liabilities", "equity"]
SUMMARY_ROWS = ["subtotal", "grand total", "shipping", "discount", "charges", "refund", "balance due", "amount due"]

# File name prefixes and currency signs.
PREFIXES = {"INV": "sales_invoice", "PO": "purchase_order", "CHQ": "cheque", "RCP": "receipt", "FNBNY": "pay_order", "STMT": "bank_statement", "PAYSLIP": "payslip", "EXP": "expense_report", "FORM": "tax_form", "IS": "income_statement", "BS": "balance_sheet", "AUD": "audit_report", "INT": "audit_report", "MGMT": "audit_report", "REV": "audit_report"}
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR", "₹": "INR", "¥": "JPY", "₩": "KRW", "A$": "AUD", "C$": "CAD", "HK$": "HKD", "S$": "SGD", "NZ$": "NZD"}
STEMS = ["asset", "liabilit", "equity", "stockholder", "shareholder"]
FILE_TYPES = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "tiff": "image", "bmp": "image"}
