"""Statements against a plain reading of the rules, on random lines."""

import random
import re

from quire.operators.statements import fill, sections, template_zones

CELLS = [(0, 0, "Current assets"), (9, 0, "Total"), (0, 2, "Non current assets"), (9, 2, "Total"), (9, 4, "Final Total"), (10, 0, "Current liabilities"), (20, 0, "Total"), (10, 2, "Shareholder equity"), (20, 2, "Total"), (20, 4, "Final Total")]
NAMES = ["Current assets", "Current liabilities", "Non current assets", "Shareholder equity"]
AMOUNT = re.compile(r"(.*?)\s+\(?\$?(-?\d{1,3}(?:,\d{3})*(?:\.\d{0,2})?)\)?")


def words(x):
    return re.sub(r"[^\w\s]", " ", x.lower()).split()


def capitals(x):
    letters = [c for c in x if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0


def kind(x):
    return next((s for s in ("asset", "liabilit", "equity", "stockholder", "shareholder") if s in " ".join(words(x))), None)


def plain(text):
    """{name: (items, total)} of the opened sections, and the grand totals."""
    found, grand, here = {}, [], None
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("---"):
            continue
        m, best = AMOUNT.fullmatch(line), (0, None)
        label = m[1].strip().rstrip(":").strip() if m else ""
        if label and capitals(label) >= 0.6 and words(label) not in map(words, NAMES) and re.search("total|sum|aggregate", " ".join(words(label))) and kind(label):
            grand.append((kind(label), m[2].replace(",", "")))
        for name in NAMES:
            a, b = set(words(name)), set(words(line))
            if b and min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.5 and len(a & b) / len(a | b) > best[0]:
                best = len(a & b) / len(a | b), name
        opens = best[1]
        if not opens and "&" not in line and capitals(line) > 0.5 and kind(line):
            opens = next((n for n in NAMES if kind(line) in n.lower() and not found.get(n, ([],))[0]), None)
        if opens:
            here = opens
            found.setdefault(here, ([], []))
        elif here is None or (m and not label):
            continue
        elif not m:
            here = None if capitals(line) > 0.5 else here
        else:
            value, name = m[2].replace(",", ""), " ".join(words(label))
            minus = not value.startswith("-") and re.search(r"\(\$?[\d,]+(?:\.\d{1,2})?\)", line)
            value = "-" * bool(minus) + value
            if name in ("total", "grand total") or name.startswith("total ") or "subtotal" in name:
                found[here][1].append(value)
                here = None
            else:
                found[here][0].append((label, "-" + value if re.match("less[: -]", label.lower()) and not value.startswith("-") else value))
    return {n: (items, totals[-1] if totals else None) for n, (items, totals) in found.items()}, grand


def statements(rng):
    heads = ["CURRENT ASSETS", "Current assets:", "Non-Current Assets", "FIXED ASSETS", "LONG-TERM LIABILITIES", "current liabilities", "STOCKHOLDERS' EQUITY", "EQUITY & LIABILITIES", "NOTES", "Notes", "--- page", "", "Shareholder's equity", "SHAREHOLDER EQUITY 5"]
    names = ["Cash", "Less: tax", "less-wear", "Lessor fee", "Total", "Subtotal of it", "Grand Total", "TOTAL ASSETS", "SUM OF EQUITY", "Totally", "Prepaid:", "TOTAL LIABILITIES", "ACCRUED", ":"]
    amounts = ["1,234.50", "(12)", "$7", "($1,200.00)", "-5", "1234", "12.", "0.5", "1,23", "$(3)", "x"]
    return "\n".join(rng.choice(heads) if rng.random() < 0.35 else rng.choice(names) + rng.choice([" ", "\t", "   "]) + rng.choice(amounts) for _ in range(rng.randint(0, 30)))


def test_sections_and_cells_of_random_statements(spark):
    rng = random.Random(8)
    texts = [statements(rng) for _ in range(150)] + ["", "\n\n"]
    cells = spark.createDataFrame([(1, *c) for c in CELLS], "template_id int, r int, c int, value string")
    groups = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3)], "template_id int, g int, label_col int, value_col int")
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id int, text string").crossJoin(template_zones(cells, groups)).repartition(4)
    read = sections(docs).cache()
    for r in read.collect():
        want, grand = plain(texts[r.doc_id] if r.doc_id < 999 else "")
        got = {s.zone: ([tuple(i) for i in s["items"]], s.total) for s in r.sections if s.opened is not None}
        assert got == want, texts[r.doc_id]
        assert [tuple(g) for g in r.grand] == grand
    filled = {}
    for r in fill(read, ["doc_id"]).collect():
        filled.setdefault(r.doc_id, {})[r.ref] = r.value
    places = {"Current assets": ("A", "B", 2, 10, 8), "Current liabilities": ("A", "B", 12, 21, 9), "Non current assets": ("C", "D", 2, 10, 8), "Shareholder equity": ("C", "D", 12, 21, 9)}
    for k, text in enumerate(texts):
        found, grand = plain(text)
        want = {"B1": "", "B11": "", "D1": "", "D11": ""}
        for name, (items, total) in found.items():
            left, right, first, last, slots = places[name]
            for i, (label, value) in enumerate(items[:slots]):
                want |= {f"{left}{first + i}": label, f"{right}{first + i}": value}
            if total is not None:
                want[f"{right}{last}"] = total
        for stem, value in reversed(grand):
            if ref := {"asset": "F10", "liabilit": "F21", "equity": "F21"}.get(stem):
                want[ref] = value
        asked = [g for g in grand if {"asset": "F10", "liabilit": "F21", "equity": "F21"}.get(g[0]) == "F21"]
        if asked:
            want["F21"] = asked[0][1]
        assert filled[k] == want, text


def test_the_known_balance_sheet(spark):
    """A statement whose cells are known: two columns of assets, a deduction, totals and grand totals."""
    text = """CURRENT ASSETS
Cash $168,000
Receivables 428,000
Inventory 724,000
Prepaid costs 50,000
Other: 17,400
Total current assets $1,387,400
FIXED ASSETS
Equipment 262,000
Less: wear (139,800)
Land 85,000
Deposits 14,000
Total fixed assets 221,200
TOTAL ASSETS $1,608,600"""
    cells = spark.createDataFrame([(1, *c) for c in CELLS], "template_id int, r int, c int, value string")
    groups = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3)], "template_id int, g int, label_col int, value_col int")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string").crossJoin(template_zones(cells, groups))
    got = {r.ref: r.value for r in fill(sections(docs), ["doc_id"]).collect()}
    want = {"B2": "168000", "B3": "428000", "B4": "724000", "B5": "50000", "B6": "17400", "D2": "262000", "D3": "-139800", "D4": "85000", "D5": "14000", "B10": "1387400", "D10": "221200", "F10": "1608600", "B1": "", "A6": "Other"}
    assert {k: got.get(k) for k in want} == want
