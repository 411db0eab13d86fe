"""Operators on document texts: classification, page and line streams, line parsing, answers of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows, values_sql
from quire.functions import values as V
from quire.functions.registry import HINTS, SPANNING
from quire.session import table

HINT_ROWS = [(kind, i, hint) for i, (kind, hints) in enumerate(HINTS.items()) for hint in hints]


def _scored(docs: DataFrame, id_col: str, text_col: str, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, an array of (score, order, kind) over all types, and more columns of the documents.

    The beginning of each text is lower-cased once, in a projection of its own: it is used by every hint, so Catalyst keeps it.
    """
    own = [c.alias(name) for name, c in (more or {}).items()]
    begins = docs.select(F.col(id_col).alias("doc_id"), *own, F.lower(F.substring(F.col(text_col), 1, 5000)).alias("begin"))
    hits = lambda hints: F.size(F.filter(F.array(*map(F.lit, hints)), lambda h: F.col("begin").contains(h)))
    return begins.select("doc_id", *(more or {}), F.array(*[F.struct(hits(hints).alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, (kind, hints) in enumerate(HINTS.items())]).alias("scores"))


def hint_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, kind: how many of a type's hints are in the first 5,000 characters; no row for no hints.

    The hints are constants in the expression, so each text is read once and nothing is joined.
    """
    return _scored(docs, id_col, text_col).select("doc_id", F.inline(F.filter("scores", lambda x: x["score"] > 0)))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, best, best_score, second_score, doc_type, and more columns of the documents: the winner needs two hints and a lead, or one where no other type has any."""
    ranked = _scored(docs, id_col, text_col, more).select("doc_id", *(more or {}), F.slice(F.sort_array("scores", asc=False), 1, 2).alias("top")).select("doc_id", *(more or {}), *[F.col("top")[i]["score"].alias(n) for i, n in enumerate(("best_score", "second_score"))], F.col("top")[0]["kind"].alias("kind"))
    wins = ((F.col("best_score") >= 2) & (F.col("best_score") > F.col("second_score"))) | ((F.col("best_score") >= 1) & (F.col("second_score") == 0))
    return ranked.select("doc_id", F.when(F.col("best_score") > 0, F.col("kind")).alias("best"), "best_score", "second_score", F.when(wins, F.col("kind")).alias("doc_type"), *(more or {}))


_SCORES = f"""
hints AS (SELECT * FROM {values_sql("kind, pos, hint", HINT_ROWS)}),
scores AS (SELECT doc_id, kind, pos, count(*) AS score FROM documents JOIN hints ON contains(lower(text[1:5000]), hint) GROUP BY doc_id, kind, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM scores),
typed AS (SELECT d.doc_id, a.kind AS best, coalesce(a.score, 0) AS best_score, coalesce(b.score, 0) AS second_score,
  CASE WHEN (a.score >= 2 AND a.score > coalesce(b.score, 0)) OR (a.score >= 1 AND b.score IS NULL) THEN a.kind END AS doc_type
  FROM documents d LEFT JOIN ranked a ON a.doc_id = d.doc_id AND a.r = 1 LEFT JOIN ranked b ON b.doc_id = d.doc_id AND b.r = 2)"""


@query("a15_hint_scores", f"WITH {_SCORES} SELECT doc_id, kind, score FROM scores")
def a15_hint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hint_scores(table(spark, sf_dir, "documents")).select("doc_id", "kind", "score")


@query("e3_w12_classify", f"WITH {_SCORES} SELECT * FROM typed")
def e3_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


@query(
    "review_queue",
    f"""
WITH {_SCORES}, flags AS (SELECT t.doc_id, coalesce(doc_type, 'other') AS doc_type, length(trim(text)) <= 50 OR coalesce(quality, 1) = 0 AS needs_review, coalesce(toxic, 0) = 1 AS reviewed, CASE WHEN best_score >= 2 THEN 'high' WHEN best_score = 1 THEN 'medium' ELSE 'low' END AS confidence
  FROM typed t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN labels l ON l.doc_id = t.doc_id)
SELECT doc_type, count(*) AS documents, count_if(needs_review AND NOT reviewed) AS pending, count_if(confidence = 'high') AS high_confidence FROM flags GROUP BY doc_type""",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by type, with how many wait for review and how many were told apart with confidence."""
    typed = classify(table(spark, sf_dir, "documents"), more={"short": F.length(F.trim("text")) <= 50}).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    review = (F.col("short") | (F.coalesce("quality", F.lit(1)) == 0)) & ~(F.coalesce("toxic", F.lit(0)) == 1)
    return typed.groupBy(F.coalesce("doc_type", F.lit("other")).alias("doc_type")).agg(F.count("*").alias("documents"), F.count_if(review).alias("pending"), F.count_if(F.col("best_score") >= 2).alias("high_confidence"))


@query(
    "e1_s6_meaningful_text",
    """
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS pages FROM documents)
SELECT doc_id, length(trim(text)) > 50 AS meaningful, len(list_filter(pages[1:3], lambda p: length(trim(p)) >= 80)) > 0 AS text_file, len(pages) AS page_count FROM a""",
)
def meaningful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of over 50 characters; text files have a page of 80 characters among the first three (lines stand for pages here)."""
    pages = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim("text")) > 50).alias("meaningful"), F.exists(F.slice(pages, 1, 3), lambda p: F.length(F.trim(p)) >= 80).alias("text_file"), F.size(pages).alias("page_count"))


@query(
    "page_lines",
    """
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, length(line) AS size, md5(line) AS digest FROM a WHERE trim(line) <> ''""",
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("size"), F.md5("line").alias("digest"))


def select_pages(pages: DataFrame, low: int, high: int) -> DataFrame:
    """Pages (doc_id, page_no, page) in a range; all pages of a document that has none in it."""
    w = Window.partitionBy("doc_id")
    inside = F.col("page_no").between(low, high)
    return pages.withColumn("any", F.max(inside).over(w)).filter(inside | ~F.col("any")).drop("any")


@query(
    "s8_page_selection",
    """
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents),
b AS (SELECT doc_id, count_if(page_no BETWEEN 2 AND 3) AS n FROM a GROUP BY doc_id)
SELECT doc_id, page_no, length(page) AS size FROM a JOIN b USING (doc_id) WHERE n = 0 OR page_no BETWEEN 2 AND 3""",
)
def s8_page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "page")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "page")
    return select_pages(pages, 2, 3).select("doc_id", "page_no", F.length("page").alias("size"))


_TERMS = {"Payments": ["the", "and"], "Totals": ["ble", "tion"], "Umlaute": ["ü", "ß"]}


@query(
    "a16_page_anchor",
    f"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents),
t AS (SELECT * FROM {values_sql("name, term", [(n, t) for n, ts in _TERMS.items() for t in ts])}),
s AS (SELECT doc_id, name, page_no, count(*) AS score FROM a JOIN t ON contains(lower(page), term) GROUP BY ALL)
SELECT doc_id, name, arg_max(page_no, score * 100000 - page_no) AS page_no, max(score) AS score FROM s GROUP BY doc_id, name""",
)
def a16_page_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table the page with most of its terms, the first of several."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "page"))
    scores = F.array(*[F.struct(F.lit(n).alias("name"), sum((F.lower("page").contains(t).cast("long") for t in ts), F.lit(0)).alias("score")) for n, ts in _TERMS.items()])
    scored = pages.select("doc_id", "pos", F.inline(F.filter(scores, lambda x: x["score"] > 0)))
    best = scored.groupBy("doc_id", "name").agg(F.max(F.struct("score", (-F.col("pos")).alias("first"))).alias("best"))
    return best.select("doc_id", "name", (1 - F.col("best.first")).alias("page_no"), F.col("best.score").alias("score"))


# -- statements rendered from line items, and parsed back ---------------------------------------------------------------------------------


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order: a line for each item, in three layouts, with the order's key as the document."""
    item = F.concat(F.lit("Item "), F.col("l_partkey").cast("string"), F.lit(":"))
    amount = F.format_number("l_extendedprice", 2)
    k = F.col("l_linenumber") % 3
    line = F.when(k == 0, F.concat(item, F.lit("\t$"), amount)).when(k == 1, F.concat(item, F.lit("  $("), amount, F.lit(")"))).otherwise(F.concat(item, F.lit(" "), amount))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"))
    return grouped.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("--- header\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nno amount here")).alias("text"))


_NUMBER = r"([-]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{0,2})?)"
LINE_PATTERNS = [rf"^(.*?)\t\$?{_NUMBER}$", rf"^(.*?)\s+\$\(?{_NUMBER}\)?$", rf"^(.*?)\s+\(?\$?{_NUMBER}\)?$"]
#: All of them in order; a line end that ``$`` leaves out goes too.
_ANY_PATTERN = f"(?:{'|'.join(LINE_PATTERNS)})[\\r\\n\\x{{85}}\\x{{2028}}\\x{{2029}}]*"


def label_key(x: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s&.()/]", " "), r"\s+", " ")))


def parse_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, value, line_no of the lines that end in an amount; the last line of a label counts.

    Patterns are tried in order: a tab, a dollar sign, any blank. An amount in brackets is negative, commas go. Lines are read in their
    array, step by step, so that each step is taken once for a line: filters behind it would be pushed below with copies of the patterns.
    """
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda raw, i: F.struct(i.alias("line_no"), V.strip(raw).alias("line")))
    lines = F.filter(lines, lambda x: (x["line"] != "") & ~F.startswith(x["line"], F.lit("---")))
    # the label and the value of the first pattern that fits stand in place of the line; where a pattern fits, the mark takes the place of a blank
    lines = F.transform(lines, lambda x: F.struct(x["line_no"], x["line"], F.regexp_replace(x["line"], _ANY_PATTERN, "$1$3$5\x01$2$4$6").alias("said")))
    lines = F.transform(F.filter(lines, lambda x: x["said"] != x["line"]), lambda x: F.struct(x["line_no"], x["line"], x["said"], F.substring_index(x["said"], "\x01", -1).alias("value")))
    lines = F.transform(lines, lambda x: F.struct(x["line_no"], x["line"], x["value"], F.replace(x["value"], F.lit(","), F.lit("")).alias("plain"), V.strip(F.regexp_replace(V.strip(F.substr(x["said"], F.lit(1), F.length(x["said"]) - F.length(x["value"]) - 1)), ":+$", "")).alias("label")))
    # brackets count where the amount was printed without commas, or with them inside the brackets
    held = lambda x, begin, amount: F.contains(x["line"], F.concat(F.lit(begin), amount, F.lit(")")))
    negative = lambda x: held(x, "(", x["plain"]) | held(x, "($", x["plain"]) | held(x, "(", x["value"])
    lines = F.transform(F.filter(lines, lambda x: (x["label"] != "") & (x["value"] != "")), lambda x: F.struct(x["line_no"], label_key(x["label"]).alias("label"), F.when(negative(x) & ~F.startswith(x["plain"], F.lit("-")), F.concat(F.lit("-"), x["plain"])).otherwise(x["plain"]).alias("value")))
    # outer: else Spark would test the arrays for rows before it makes them, and so make them twice
    found = docs.select(F.col(id_col).alias("doc_id"), F.inline_outer(F.filter(lines, lambda x: x["label"] != ""))).filter("line_no IS NOT NULL")
    return found.groupBy("doc_id", "label").agg(F.max(F.struct("line_no", "value")).alias("last")).select("doc_id", "label", F.col("last.value").alias("value"), F.col("last.line_no").alias("line_no"))


@query(
    "e6_statement_parse",
    """
WITH a AS (SELECT l_orderkey AS doc_id, 'item ' || l_partkey AS label, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN '-' ELSE '' END || printf('%.2f', l_extendedprice) AS value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Item ' || l_partkey || ':' || CASE l_linenumber % 3 WHEN 0 THEN chr(9) || '$' || format('{:,.2f}', l_extendedprice) WHEN 1 THEN '  $(' || format('{:,.2f}', l_extendedprice) || ')' ELSE ' ' || format('{:,.2f}', l_extendedprice) END) AS line_no FROM lineitem)
SELECT doc_id, label, arg_max(value, line_no) AS value, max(line_no) AS line_no FROM a GROUP BY doc_id, label""",
)
def e6_statement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(statements(spark, sf_dir))


@query(
    "e2_decimal_repair",
    """
WITH t AS (SELECT o_orderkey AS id, 'Net ' || o_orderkey || '.' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 10 AS VARCHAR) ELSE '' END AS head, CAST(o_orderkey % 70 AS VARCHAR) AS tail FROM orders)
SELECT id, CASE WHEN id >= 1000 THEN head || tail ELSE head || chr(10) || tail END || chr(10) || 'end' AS text FROM t UNION ALL SELECT -1, NULL""",
)
def e2_decimal_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of four figures or more that break off after the point are joined with the figures on the next line."""
    key = F.col("o_orderkey")
    broken = F.concat(F.lit("Net "), key.cast("string"), F.lit("."), F.when(key % 2 == 0, (key % 10).cast("string")).otherwise(""), F.lit("\n"), (key % 70).cast("string"), F.lit("\nend"))
    texts = table(spark, sf_dir, "orders").select(key.alias("id"), broken.alias("text")).unionByName(rows(spark, "id bigint, text string", [(-1, None)]))
    return texts.select("id", V.decimal_repair(F.col("text")).alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, page) with a number that breaks off at the end of a page joined by the one or two figures that begin the next."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    tail, orphan = r"(\d[\d,]*\.\d?)\s*$", r"^\s*(\d{1,2})\b"
    after, before = F.lead("page").over(w), F.lag("page").over(w)
    breaks = lambda a, b: F.regexp_extract(a, tail, 1).rlike(r"\.\d?$") & b.rlike(orphan)
    marked = pages.withColumns({"gives": F.coalesce(breaks(F.col("page"), after), F.lit(False)), "takes": F.coalesce(breaks(before, F.col("page")), F.lit(False)), "next": after})
    body = F.when(F.col("takes"), F.regexp_replace("page", orphan, "")).otherwise(F.col("page"))
    joined = F.concat(F.regexp_replace(body, tail, ""), F.replace(F.regexp_extract("page", tail, 1), F.lit(","), F.lit("")), F.regexp_extract("next", orphan, 1))
    return marked.select("doc_id", "page_no", F.when(F.col("gives"), joined).otherwise(body).alias("page"))


@query(
    "e2_cross_page_decimals",
    """SELECT CAST(p_partkey AS BIGINT) AS doc_id, n AS page_no, CASE n WHEN 1 THEN 'Total ' || CAST(p_partkey AS VARCHAR) || '513.0' || '7' ELSE ' units left' END AS page FROM part, (VALUES (1), (2)) v(n)""",
)
def e2_cross_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    first = part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), F.concat(F.lit("Total "), key, F.lit(",513.0\n")).alias("page"))
    return join_pages(first.union(part.select("p_partkey", F.lit(2), F.lit("7 units left"))))


def segments(docs: DataFrame, pages: Column, kind: Column, stem: Column, suffix: Column) -> DataFrame:
    """One row for each document inside a file: each page of a file of several, unless its type spans pages; names are numbered where there are several."""
    several = (F.size(pages) > 1) & ~kind.isin(SPANNING)
    parts = F.when(several, pages).otherwise(F.array(F.array_join(pages, "\n\n--- PAGE BREAK ---\n\n")))
    out = docs.select("*", F.posexplode(parts).alias("n", "segment"), several.alias("several"))
    return out.withColumn("file_name", F.when(F.col("several"), F.concat(stem, F.lit("_doc"), (F.col("n") + 1).cast("string"), suffix)).otherwise(F.concat(stem, suffix)))


@query(
    "e4_e5_segments",
    """
WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tax_form' WHEN 1 THEN 'receipt' WHEN 2 THEN 'balance_sheet' ELSE 'cheque' END AS kind, string_split(text, chr(10)) AS pages FROM documents),
b AS (SELECT *, len(pages) > 1 AND kind NOT IN ('audit_report', 'balance_sheet', 'income_statement', 'tax_form') AS several FROM a),
c AS (SELECT *, unnest(CASE WHEN several THEN pages ELSE [array_to_string(pages, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10))] END) AS segment, generate_subscripts(CASE WHEN several THEN pages ELSE [''] END, 1) AS n FROM b)
SELECT doc_id, kind, CASE WHEN several THEN 'file' || doc_id || '_doc' || n || '.pdf' ELSE 'file' || doc_id || '.pdf' END AS file_name, length(segment) AS size FROM c""",
)
def e4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "tax_form").when(k == 1, "receipt").when(k == 2, "balance_sheet").otherwise("cheque").alias("kind"), F.split("text", "\n").alias("pages"))
    out = segments(docs, F.col("pages"), F.col("kind"), F.concat(F.lit("file"), F.col("doc_id").cast("string")), F.lit(".pdf"))
    return out.select("doc_id", "kind", "file_name", F.length("segment").alias("size"))


@query(
    "e12_json_answers",
    """
SELECT event_id, json_extract_string(props, '$.k') AS k, true AS parsed FROM events WHERE event_id % 5 <> 4
UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 5 = 4""",
)
def e12_json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers wrapped in thoughts, fences and chatter, parsed; what is no JSON is null."""
    k, p = F.col("event_id") % 5, F.col("props")
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("<think>{not this}\n</think>\n"), p)).when(k == 2, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone."))).when(k == 3, F.concat(F.lit("Here you are "), p, F.lit(" bye"))).otherwise("no braces at all")
    parsed = F.try_parse_json(V.response_json(raw))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"), (F.schema_of_variant(parsed).startswith("OBJECT")).alias("ok")).select("event_id", "k", F.coalesce("ok", F.lit(False)).alias("parsed"))


@query("e13_unwrap", "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 3 THEN 4 END AS a FROM orders")
def e13_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of an answer that lists documents, else the answer itself; what is no object has nothing."""
    k, n = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('{"documents": [{"a": '), n, F.lit('}, {"a": 2}]}'))).when(k == 1, F.concat(F.lit('{"a": '), n, F.lit("}"))).when(k == 2, '{"documents": []}').when(k == 3, '{"documents": 5, "a": 4}').when(k == 4, "[1]").when(k == 5, "x")
    parsed = F.try_parse_json("raw")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).select("id", F.coalesce(F.try_variant_get(parsed, "$.documents[0].a", "bigint"), F.try_variant_get(parsed, "$.a", "bigint")).alias("a"))


PAGE_LABEL = "\n\n=== DOCUMENT CONTINUES ON NEXT PAGE — ALL CONTENT BELOW IS PART OF THE SAME DOCUMENT ===\n\n"


def truncate(text: Column, form: Column, regions: list[tuple[list[str], str]], whole: int = 8000, short: int = 3000, head: int = 1500, section: int = 2000, lines: int = 100) -> Column:
    """What is sent to a model: short texts whole; of long forms the beginning; else the beginning, a snippet for each table region, and what follows the beginning up to the limit.

    A region's snippet begins at the first line that has one of its first two column names or its label, without case;
    it has ``lines`` lines and ``section`` characters at most, and less as the limit comes near. Regions are folded in order.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("--- PAGE BREAK ---"), F.lit(PAGE_LABEL))
    split = F.split(text, "\n")
    kinds = "struct<used:int,out:string>"

    def step(acc: Column, region: Column) -> Column:
        has = lambda line: F.exists(region["terms"], lambda t: F.lower(line).contains(t))
        start = F.array_position(F.transform(split, has), F.lit(True)).cast("int")
        budget = F.least(F.lit(section), whole - acc["used"] - 100)
        snippet = F.substring(F.array_join(F.slice(split, F.greatest(start, F.lit(1)), F.lit(lines)), "\n"), F.lit(1), F.greatest(budget, F.lit(0)))
        more = F.struct((acc["used"] + F.length(snippet)).alias("used"), F.concat(acc["out"], F.lit("\n\n--- SECTION: "), region["label"], F.lit(" ---\n"), snippet).alias("out")).cast(kinds)
        return F.when((start > 0) & (budget > 0), more).otherwise(acc)

    known = F.array(*[F.struct(F.array(*[F.lit(t.lower()) for t in [*names[:2], label] if t]).alias("terms"), F.lit(label or "Table").alias("label")) for names, label in regions if names])
    begin = F.struct(F.lit(head).alias("used"), F.substring(text, 1, head).alias("out")).cast(kinds)
    rest = lambda acc: F.when(acc["used"] < whole, F.concat(acc["out"], F.lit("\n"), F.substring(text, F.lit(head + 1), whole - acc["used"]))).otherwise(acc["out"])
    parts = F.substring(F.aggregate(known, begin, step, rest), 1, whole) if any(names for names, _ in regions) else F.substring(F.concat(F.substring(text, 1, head), F.lit("\n"), F.substring(text, head + 1, whole - head)), 1, whole)
    return F.when(F.length(text) <= whole, text).when(form, F.substring(text, 1, short)).otherwise(parts)


_REGIONS = [(["total", "qty", "price"], "Items"), (["the", "and"], ""), (["no such column"], ""), (["Licensed"], "Licence"), (["IN "], "In"), (["de", "la"], "De"), (["a"], "A")]


def _truncated_sql() -> str:
    """The same rule for DuckDB, a step for each region."""
    steps, last = "", "s0"
    for i, (names, label) in enumerate(_REGIONS, 1):
        has = " OR ".join(f"contains(x, '{t.lower()}')" for t in [*names[:2], label] if t)
        steps += f""", p{i} AS (SELECT *, coalesce(list_position(list_transform(low, lambda x: {has}), true), 0) AS pos, least(2000, 8000 - used - 100) AS budget FROM {last}),
q{i} AS (SELECT *, CASE WHEN pos > 0 AND budget > 0 THEN substring(array_to_string(lines[pos:pos + 99], chr(10)), 1, budget) END AS snippet FROM p{i}),
s{i} AS (SELECT doc_id, t, lines, low, used + coalesce(length(snippet), 0) AS used, out || CASE WHEN snippet IS NULL THEN '' ELSE chr(10) || chr(10) || '--- SECTION: {label or "Table"} ---' || chr(10) || snippet END AS out FROM q{i})"""
        last = f"s{i}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s0 AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines, string_split(lower(t), chr(10)) AS low, 1500 AS used, substring(t, 1, 1500) AS out FROM d){steps}
SELECT doc_id, length(x) AS size, md5(x) AS digest FROM (SELECT doc_id, CASE WHEN length(t) <= 8000 THEN t WHEN doc_id % 3 = 0 THEN substring(t, 1, 3000)
  ELSE substring(out || CASE WHEN used < 8000 THEN chr(10) || substring(t, 1501, 8000 - used) ELSE '' END, 1, 8000) END AS x FROM {last})"""


@query("e24_truncation", _truncated_sql())
def e24_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = truncate(F.col("text"), F.col("doc_id") % 3 == 0, _REGIONS)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("x")).select("doc_id", F.length("x").alias("size"), F.md5("x").alias("digest"))


@query(
    "e19_bare_currency",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN printf('%.2f', o_totalprice) WHEN o_orderkey % 4 = 1 THEN '£' ELSE 'x' || o_orderkey END AS value, o_orderkey % 4 < 2 AS asked_again FROM orders""",
)
def e19_bare_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone currency sign asks for a second answer, which replaces it unless it is such a sign or empty as well."""
    k = F.col("o_orderkey") % 4
    bare = lambda c: c.isin("$", "£", "€", "₹", "¥")
    first = F.when(k == 0, "$").when(k == 1, "£").otherwise(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
    again = F.when(k == 0, F.format_string("%.2f", "o_totalprice")).otherwise("$")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(bare(first) & ~bare(again) & (again != ""), again).otherwise(first).alias("value"), bare(first).alias("asked_again"))


@query(
    "e22_category_backfill",
    """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 1 THEN l_returnflag WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) = 1 THEN 'kept' END AS category FROM lineitem""",
)
def e22_category_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories are filled in by row order, only where a document's first row has none."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    own = F.when((F.row_number().over(w) == 1) & (F.col("l_orderkey") % 2 == 0), "kept")
    out = table(spark, sf_dir, "lineitem").select("*", own.alias("own"))
    first = F.first("own").over(w)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.when(first.isNull(), F.coalesce("own", "l_returnflag")).otherwise(F.col("own")).alias("category"))


@query(
    "udtf_pages_to_lines",
    """
WITH a AS (SELECT item_id, replace(text, chr(10), chr(10) || '--- PAGE BREAK ---' || chr(10)) AS t FROM benchmark), p AS (SELECT item_id, unnest(string_split(t, '--- PAGE BREAK ---')) AS page, generate_subscripts(string_split(t, '--- PAGE BREAK ---'), 1) AS page_no FROM a),
l AS (SELECT item_id, page_no, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) AS line_no FROM p)
SELECT item_id, page_no, line_no, line FROM l WHERE trim(line) <> ''""",
)
def udtf_pages_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function that SQL users have, joined laterally."""
    from quire.functions import tables

    tables.register(spark)
    text = F.replace("text", F.lit("\n"), F.lit("\n--- PAGE BREAK ---\n"))
    table(spark, sf_dir, "benchmark").select("item_id", text.alias("t")).createOrReplaceTempView("quire_benchmark_pages")
    return spark.sql("SELECT item_id, l.page_no, l.line_no, l.line FROM quire_benchmark_pages, LATERAL pages_to_lines(t) l")


def collapse(sections: DataFrame) -> DataFrame:
    """Rows of the same section in several documents of a file as one list, documents in order: file, section, rows."""
    ordered = F.array_sort(F.collect_list(F.struct("doc", "rows")))
    return sections.groupBy("file", "section").agg(F.flatten(F.transform(ordered, lambda x: x["rows"])).alias("rows"))


@query(
    "u3_section_union",
    """
WITH d AS (SELECT o_custkey AS file, o_orderkey AS doc, l_returnflag AS section, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT file, section, count(*) AS n, string_agg(l_partkey, ',' ORDER BY doc, l_partkey) AS parts FROM d GROUP BY file, section""",
)
def u3_section_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("section"), "l_partkey")
    d = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    per_doc = d.groupBy(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("doc"), "section").agg(F.array_sort(F.collect_list("l_partkey")).alias("rows"))
    out = collapse(per_doc)
    return out.select("file", "section", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("parts"))


def collect_rows(answers: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, source, pos, row of every array of an answer whose key ends in ``_rows``: ``table_rows`` first, then in the order of the keys.

    Keys of other kinds of values, and items of an array that are no objects, are passed over. What is no JSON object gives no row.
    """
    keys = answers.select(F.col(id_col), F.posexplode(F.from_json(json_col, "map<string,string>")).alias("nth", "key", "list")).filter(F.col("key").endswith("_rows"))
    listed = keys.select(id_col, F.replace("key", F.lit("_rows"), F.lit("")).alias("source"), F.when(F.col("key") == "table_rows", -1).otherwise(F.col("nth")).alias("nth"), F.posexplode(F.from_json("list", "array<string>")).alias("i", "item"))
    objects = listed.filter(F.ltrim("item").startswith("{"))
    return objects.select(id_col, "source", F.row_number().over(Window.partitionBy(id_col).orderBy("nth", "i")).alias("pos"), F.from_json("item", "map<string,string>").alias("row"))


@query(
    "e16_collect_rows",
    """
WITH l AS (SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'z' ELSE 'a' END AS source, l_linenumber, l_partkey FROM lineitem)
SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'table' THEN 0 WHEN 'z' THEN 1 ELSE 2 END, l_linenumber, l_partkey) AS pos, l_partkey AS part, CASE WHEN source = 'z' THEN l_linenumber END AS line FROM l""",
)
def e16_collect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's answer has scalar keys, three arrays whose keys are not in the order of their names, and an item that is no object."""
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    third = F.col("l_linenumber") % 3
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", third.alias("third"), F.struct("l_linenumber", "l_partkey", F.when(third == 1, F.struct(part.alias("part"), line.alias("line"))).otherwise(F.struct(part.alias("part"), F.lit(None).cast("string").alias("line"))).alias("row")).alias("x"))
    rows_of = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("third") == n, F.col("x")))), lambda x: F.to_json(x["row"]))
    array = lambda n: F.concat(F.lit("["), F.array_join(rows_of(n), ", "), F.lit("]"))
    raw = F.concat(F.lit('{"confidence": "high", "z_rows": '), array(1), F.lit(', "total": 7, "notes": {"x_rows": 1}, "table_rows": '), array(0), F.lit(', "a_rows": '), F.regexp_replace(array(2), r"\]$", ', "none"]'), F.lit(', "empty_rows": [], "odd_rows": "text"}'))
    raw = F.replace(raw, F.lit("[, "), F.lit("["))
    out = collect_rows(lines.groupBy(F.col("l_orderkey").alias("id")).agg(raw.alias("raw")), "id", "raw")
    return out.select("id", "source", "pos", F.try_element_at("row", F.lit("part")).cast("bigint").alias("part"), F.try_element_at("row", F.lit("line")).cast("bigint").alias("line"))
