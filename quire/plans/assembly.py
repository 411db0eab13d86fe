"""Documents inside a file by recorded page ranges, and results put together from recorded answers on their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.operators import assembly
from quire.session import table

PROVIDERS = ["primary", "fallback"]
_KINDS = ["tax_form", "receipt", "balance_sheet", "Audit_Report", None]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: their lines are the pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5).cast("int"))
    return d.select("doc_id", kind.alias("kind"), F.split("text", "\n").alias("pages"), F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("stem"), F.lit(".pdf").alias("suffix"))


@query(
    "e4_detected_documents",
    rf"""
WITH f AS (SELECT doc_id, {["tax_form", "receipt", "balance_sheet", "Audit_Report", "other"]!r}[1 + doc_id % 5] AS kind, string_split(coalesce(text, ''), chr(10)) AS pages, doc_id % 7 AS a FROM documents),
s AS (SELECT *, len(pages) AS n, len(pages) > 1 AND doc_id % 5 IN (1, 4) AS split FROM f),
t AS (SELECT *, CASE
  WHEN split THEN list_transform(range(n), lambda i: {{'i': i, 'lo': i, 'hi': i, 'hint': 'page ' || (i + 1)}})
  WHEN n = 1 AND a = 2 THEN [{{'i': 0, 'lo': 0, 'hi': 0, 'hint': 'left'}}, {{'i': 1, 'lo': 0, 'hi': 0, 'hint': 'doc 2'}}]
  WHEN n > 1 AND a = 2 THEN [{{'i': 0, 'lo': 0, 'hi': 0, 'hint': 'first'}}, {{'i': 1, 'lo': 1, 'hi': n - 1, 'hint': 'document 2'}}]
  WHEN n > 1 AND a = 3 THEN [{{'i': 0, 'lo': 0, 'hi': 1, 'hint': 'document 1'}}, {{'i': 1, 'lo': 1, 'hi': 1, 'hint': 'document 2'}}, {{'i': 6, 'lo': n - 1, 'hi': n - 1, 'hint': 'last'}}]
  WHEN n > 1 AND a = 5 THEN [{{'i': 0, 'lo': 1, 'hi': 0, 'hint': 'back'}}, {{'i': 1, 'lo': 0, 'hi': 0, 'hint': 'document 2'}}]
  ELSE [{{'i': 0, 'lo': 0, 'hi': n - 1, 'hint': 'full document'}}] END AS segs FROM s),
c AS (SELECT *, flatten(list_transform(segs, lambda x: range(x.lo, x.hi + 1))) AS claimed FROM t),
u AS (SELECT *, unnest(segs) AS g FROM c)
SELECT doc_id, g.i AS idx, 'file' || doc_id || CASE WHEN len(segs) > 1 THEN '_doc' || (g.i + 1) ELSE '' END || '.pdf' AS file_name, g.hint AS hint, greatest(0, g.hi - g.lo + 1) AS page_count, CASE WHEN g.hi >= g.lo THEN g.lo END AS first_page,
  md5(array_to_string(pages[g.lo + 1:g.hi + 1], chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10))) AS digest, n - len(list_distinct(claimed)) AS gaps, CASE WHEN n > 1 THEN len(claimed) - len(list_distinct(claimed)) ELSE 0 END AS overlaps FROM u""",
)
def e4_detected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a page each, or by recorded ranges: fenced, from the second provider, with overlaps, gaps and ranges that end early or beyond the file; broken, single and missing answers leave one."""
    files = _files(spark, sf_dir)
    a, n = F.col("doc_id") % 7, F.size("pages")
    ranges = lambda *parts: F.concat(F.lit('{"is_multi_document": true, "document_count": 3, "documents": ['), *parts, F.lit("]}"))
    count = n.cast("string")
    raw = (
        F.when((a == 2) & (n == 1), F.lit('{"document_count": 2, "layout": "stacked", "documents": [{"index": 0, "hint": "left"}, {"index": 1}]}'))
        .when(a == 2, F.concat(F.lit("<think>{two?}</think>```json\n"), ranges(F.lit('{"doc_number": 1, "start_page": 1, "end_page": 1, "hint": "first"}, {"doc_number": "2", "start_page": 2, "end_page": '), (n + 5).cast("string"), F.lit("}")), F.lit("\n```")))
        .when(a == 3, ranges(F.lit('{"end_page": 2}, {"start_page": 2}, {"doc_number": 7, "hint": "last", "start_page": '), count, F.lit(', "end_page": '), count, F.lit("}")))
        .when(a == 4, '{"is_multi_document": false, "document_count": 1, "documents": [{"doc_number": 1, "start_page": 1, "end_page": 1}]}')
        .when(a == 5, ranges(F.lit('{"doc_number": 1, "start_page": 2, "end_page": 1, "hint": "back"}, {"start_page": -3, "end_page": 1}')))
        .when(a == 6, ranges(F.lit('{"start_page": "first", "end_page": 2}')))
    )
    provider = F.when(F.col("doc_id") % 2 == 0, "primary").otherwise("fallback")
    # a single page has ranges as well in some answers; they list places on the page
    answers = files.filter((a >= 2) & ((n > 1) | (a == 2))).select("doc_id", F.lit("boundaries").alias("task"), provider.alias("provider"), raw.alias("raw"))
    broken = files.filter(F.col("doc_id") % 2 == 1).select("doc_id", F.lit("boundaries").alias("task"), F.lit("primary").alias("provider"), F.lit("no braces").alias("raw"))
    out = assembly.boundaries(files, answers.unionByName(broken), PROVIDERS)
    pages = F.col("page_nos")
    return out.select("doc_id", F.col("index").alias("idx"), "file_name", "hint", F.size(pages).alias("page_count"), F.get(pages, 0).alias("first_page"), F.md5("segment").alias("digest"), "gaps", "overlaps")


_HEADINGS = ["Lines", "Totals:", "Sub lines", "Notes and lines", "lines"]
_GROUPS = [("Lines", 1, 5, "A", "B"), ("Totals", 6, 6, "C", "D"), ("Notes", 8, 9, "E", "F")]


def _pick(name: str, free: str) -> str:
    """The first place of a key that is the name, else of one that holds it or lies in it."""
    fits = f"keys[i + 1] = '{name}'", f"contains(keys[i + 1], '{name}') OR contains('{name}', keys[i + 1])"
    return "coalesce(" + ", ".join(f"list_filter(range(len(keys)), lambda i: ({fit}){free})[1]" for fit in fits) + ")"


@query(
    "e20_assembled_results",
    rf"""
WITH p AS (SELECT doc_id, doc_id % 6 AS c, doc_id % 4 < 2 AS tpl, string_split(coalesce(text, ''), chr(10)) AS pages FROM documents),
m AS (SELECT *, unnest(range(len(pages))) AS pg FROM p WHERE c IN (2, 3, 5)),
sec AS (SELECT doc_id, tpl, CASE c WHEN 2 THEN 0 WHEN 3 THEN pg ELSE least(pg, 1) END AS d, CASE c WHEN 2 THEN pg WHEN 3 THEN 0 ELSE greatest(pg - 1, 0) END AS s, {_HEADINGS!r}[1 + (doc_id + pg) % 5] AS heading, pages[pg + 1] AS page, (doc_id + pg) % 11 <> 0 AS answered, pg FROM m
  UNION ALL SELECT doc_id, tpl, 0, k, CASE WHEN tpl THEN {[g[0] for g in _GROUPS]!r}[k + 1] ELSE 'Document' END, pages[1], k = 0 AND c <> 1, 0 FROM p, range(3) t(k) WHERE c IN (0, 1, 4) AND (tpl OR k = 0)),
h AS (SELECT doc_id, d, tpl, list(regexp_replace(lower(heading), '[^a-z0-9]+', '', 'g') ORDER BY s) AS keys FROM sec GROUP BY ALL),
h1 AS (SELECT *, CASE WHEN tpl THEN {_pick("lines", "")} END AS g0 FROM h),
h2 AS (SELECT *, CASE WHEN tpl THEN {_pick("totals", " AND i IS DISTINCT FROM g0")} END AS g1 FROM h1),
h3 AS (SELECT *, CASE WHEN tpl THEN {_pick("notes", " AND i IS DISTINCT FROM g0 AND i IS DISTINCT FROM g1")} END AS g2 FROM h2),
l AS (SELECT sec.*, CASE s WHEN g0 THEN 0 WHEN g1 THEN 1 WHEN g2 THEN 2 END AS g FROM sec JOIN h3 USING (doc_id, d)),
l2 AS (SELECT *, coalesce({[g[0] for g in _GROUPS]!r}[g + 1], heading) AS label, coalesce(['A', 'C', 'E'][g + 1], 'A') AS lc, coalesce(['B', 'D', 'F'][g + 1], 'B') AS vc FROM l),
lay AS (SELECT doc_id, d, label, min(s) AS pos, max(s) AS s FROM l2 GROUP BY ALL),
r AS (SELECT doc_id, d, s, label, vc, unnest(string_split(page, '. ')) AS sentence, generate_subscripts(string_split(page, '. '), 1) + CASE WHEN pg % 4 = 1 THEN 1 ELSE 0 END AS n FROM l2 WHERE answered),
k AS (SELECT lay.doc_id, lay.d, lay.label, pos, s, r.n, string_split(sentence, ' ')[1] AS word, length(sentence) AS v, vc FROM lay LEFT JOIN r USING (doc_id, d, s)),
sizes AS (SELECT doc_id, d, label, min(pos) AS pos, count(n) AS rows FROM k GROUP BY ALL
  UNION ALL SELECT doc_id, d, name, 1000000000 + j, 0 FROM h3, (VALUES (0, 'Lines'), (1, 'Totals'), (2, 'Notes')) t(j, name) WHERE tpl AND [g0, g1, g2][j + 1] IS NULL AND NOT EXISTS (SELECT 1 FROM lay WHERE lay.doc_id = h3.doc_id AND lay.d = h3.d AND lay.label = name)),
layout AS (SELECT doc_id, d, string_agg(label || ':' || rows, ';' ORDER BY pos) AS layout FROM sizes GROUP BY ALL),
e AS (SELECT doc_id, d, word AS key, CAST(v AS VARCHAR) AS value, vc || n AS ref, CAST(pos AS BIGINT) * 1000000 + n AS ord FROM k WHERE word <> ''
  UNION ALL SELECT doc_id, d, 'B9', CAST(len(string_split(page, '. ')) AS VARCHAR), 'B9', 1000000000000000 + s FROM l2 WHERE answered AND pg % 3 = 1),
x AS (SELECT doc_id, d, key, min(ord) AS o, arg_max(value, ord) AS value, arg_max(ref, ord) AS ref FROM e GROUP BY ALL),
said AS (SELECT doc_id, d, count(*) AS facts, md5(string_agg(key || '=' || value || '@' || ref, ';' ORDER BY o)) AS digest FROM x GROUP BY ALL)
SELECT doc_id, d AS idx, 'file' || doc_id || CASE WHEN (c = 3 OR c = 5) AND len(pages) > 1 THEN '_doc' || (d + 1) ELSE '' END || '.pdf' AS file_name,
  CASE WHEN c = 2 THEN 'invoice' WHEN c = 3 THEN 'receipt' WHEN c = 5 THEN coalesce({["tax_form", "receipt", "balance_sheet", "Audit_Report", "other"]!r}[1 + doc_id % 5], 'other') ELSE 'other' END AS doc_type,
  CASE WHEN c = 3 THEN 'ID-' || doc_id || '-' || d ELSE '' END AS identifier, CASE WHEN c = 3 OR (c = 5 AND d = 0) THEN 1 WHEN c = 5 THEN len(pages) - 1 ELSE len(pages) END AS page_count,
  layout, coalesce(facts, 0) AS facts, digest FROM p JOIN layout USING (doc_id) LEFT JOIN said USING (doc_id, d)""",
)
def e20_assembled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories of files (one document, one a page, two; empty, broken and missing ones) and answers on their sections, as results with their facts.

    Answers are plain or fenced, wrapped in a list of documents or not, with a second section that does not count, rows that
    are no rows, and a total; every eleventh is missing.
    """
    files = _files(spark, sf_dir).withColumns({"c": F.col("doc_id") % 6, "n": F.size("pages")})
    group = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("label start_row end_row label_col value_col".split(), g)]) for g in _GROUPS])
    files = files.withColumn("groups", F.when(F.col("doc_id") % 4 < 2, group))
    c = F.col("c")

    heading = lambda pg: F.get(F.array(*map(F.lit, _HEADINGS)), ((F.col("doc_id") + pg) % 5).cast("int"))
    section = lambda pg: F.struct(heading(pg).alias("heading"), pg.alias("page"), F.lit("table").alias("structure"))
    document = lambda index, kind, name, pages: F.struct(index.alias("doc_index"), kind.cast("string").alias("doc_type"), name.alias("identifier"), pages.alias("pages"), F.transform(pages, section).alias("sections"))
    every, none = F.sequence(F.lit(0), F.col("n") - 1), F.lit("")
    one = F.array(document(F.lit(0), F.lit("invoice"), none, every))
    each = F.transform(every, lambda pg: document(pg, F.lit("receipt"), F.concat_ws("-", F.lit("ID"), F.col("doc_id").cast("string"), pg.cast("string")), F.array(pg)))
    two = F.filter(F.array(document(F.lit(0), F.lit(None), none, F.array(F.lit(0))), document(F.lit(1), F.lit(None), none, F.slice(every, F.lit(2), F.col("n")))), lambda d: F.size(d["pages"]) > 0)
    inventory = F.when(c == 1, '{"documents": [').when(c == 4, '{"documents": []}').otherwise(F.to_json(F.struct(F.when(c == 2, one).when(c == 3, each).otherwise(two).alias("documents"))))
    maps = files.filter(c != 0).select("doc_id", F.lit("map").alias("task"), F.lit("primary").alias("provider"), inventory.alias("raw"))

    pg = F.col("pg")
    pages = files.select("doc_id", "c", F.posexplode("pages").alias("pg", "page"))
    place = F.when(c == 3, F.concat_ws(":", pg.cast("string"), F.lit("0"))).when(c == 5, F.concat_ws(":", F.least(pg, F.lit(1)).cast("string"), F.greatest(pg - 1, F.lit(0)).cast("string"))).otherwise(F.concat(F.lit("0:"), pg.cast("string")))
    sentences = F.split("page", r"\. ")
    rows = F.to_json(F.transform(sentences, lambda s: F.struct(F.get(F.split(s, " "), 0).alias("label"), F.length(s).alias("value"))))
    rows = F.when(pg % 4 == 1, F.concat(F.lit('["x",'), F.substr(rows, F.lit(2)))).otherwise(rows)
    fields = F.when(pg % 3 == 1, F.concat(F.lit(', "extracted_fields": {"B9": {"value": '), F.size(sentences).cast("string"), F.lit("}}"))).otherwise("")
    answer = F.concat(F.lit('{"layout_sections": {"told": {"rows": '), rows, F.lit('}, "more": {"rows": [{"label": "not", "value": 1}]}}'), fields, F.lit("}"))
    answer = F.when(pg % 2 == 0, F.concat(F.lit('{"documents": ['), answer, F.lit("]}"))).otherwise(answer)
    answer = F.when(pg % 3 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    told = F.when(c.isin(2, 3, 5), (F.col("doc_id") + pg) % 11 != 0).otherwise((pg == 0) & (c != 1))
    sections = pages.filter(told).select("doc_id", F.concat(F.lit("section:"), place).alias("task"), F.lit("fallback").alias("provider"), answer.alias("raw"))

    documents = assembly.document_map(files, maps, PROVIDERS)
    results = assembly.assemble(documents, sections, PROVIDERS)
    line = F.concat("key", F.lit("="), "value", F.lit("@"), "ref")
    layout = F.array_join(F.transform("layout_sections", lambda s: F.concat(s["label"], F.lit(":"), F.size(s["rows"]).cast("string"))), ";")
    about = F.struct(F.col("doc_index").alias("idx"), "file_name", "doc_type", "identifier", F.size("page_nos").alias("page_count"), layout.alias("layout"))
    # what is shown of a document goes along with its facts, so that its answers are read for both at once
    said = assembly.facts(results.withColumn("about", about), "about").groupBy("doc_id", "doc", "about").agg(F.count("place").alias("facts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", line.alias("line"))))), lambda x: x["line"]), ";").alias("text"))
    return said.select("doc_id", "about.*", "facts", F.when(F.col("facts") > 0, F.md5("text")).alias("digest"))
