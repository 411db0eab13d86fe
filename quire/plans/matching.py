"""Label matching: tiers of exact, contained and similar labels, greedy sections, bands, neighbours, look-ups in order."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows, values_sql
from quire.functions import values as V
from quire.functions.registry import GENERIC_LABELS
from quire.operators.assign import greedy
from quire.session import table

LABELS = [("A2", "green"), ("B2", "Less: red steel"), ("C2", "amount"), ("D2", "large blue widget gear"), ("E2", "pink"), ("F2", "total blue gear set"), ("G2", "small")]


def match_labels(pairs: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """doc_id, ref, value, confidence: each template label's value among a document's (label, value, pos) pairs.

    Exact first; then labels that hold the template's or lie in it, the longest; then labels with three quarters of the
    template's words, the most. Generic labels match exactly only, and values of labels that begin with ``less`` are negative.
    The template's labels are constants in one expression; ranking is one aggregate for each document, without a window.
    """
    label = F.col("label")
    best = []
    for ref, text in labels:
        key = " ".join("".join(ch if ch.isalnum() or ch in "_ &.()/" else " " for ch in text).lower().split())
        words = sorted(set(key.split()))
        exact, generic = label == key, key in GENERIC_LABELS
        near = F.lit(False) if generic else label.contains(key) | (F.lit(key).contains(label) & (label != ""))
        share = F.size(F.array_intersect(F.array(*map(F.lit, words)), F.split(label, " "))) / max(1, len(words))
        loose = F.lit(False) if generic or not words else share >= 0.75
        tier = F.when(exact, 3).when(near, 2).when(loose, 1)
        rank = F.when(tier == 2, F.length(label).cast("double")).when(tier == 1, share).otherwise(0.0)
        negate = text.lower().strip().startswith(("less:", "less ", "less-"))
        value = F.when((F.col("value") != "") & ~F.col("value").startswith("-"), F.concat(F.lit("-"), F.col("value"))).otherwise(F.col("value")) if negate else F.col("value")
        best.append(F.max(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), rank.alias("rank"), (-F.col("pos")).alias("first"), value.alias("value"), F.lit(ref).alias("ref")))))
    found = pairs.groupBy("doc_id").agg(F.array_compact(F.array(*best)).alias("found"))
    return found.select("doc_id", F.inline("found")).select("doc_id", "ref", "value", F.when(F.col("tier") >= 2, "high").otherwise("medium").alias("confidence"))


_PARTS = "SELECT p_partkey % 50 AS doc_id, lower(p_name) AS label, CAST(p_partkey AS VARCHAR) AS value, p_partkey AS pos FROM part"
_KEYS = [(r, " ".join("".join(c if c.isalnum() or c in "_ &.()/" else " " for c in t).lower().split()), t.lower().startswith("less")) for r, t in LABELS]


@query(
    "j8_e7_label_match",
    f"""
WITH d AS ({_PARTS}), t AS (SELECT *, string_split(k, ' ') AS words FROM {values_sql("ref, k, negate", _KEYS)}),
m AS (SELECT *, CASE WHEN label = k THEN 3 WHEN NOT k IN ({", ".join(f"'{x}'" for x in GENERIC_LABELS)}) THEN CASE WHEN contains(label, k) OR contains(k, label) THEN 2 WHEN CAST(len(list_intersect(words, string_split(label, ' '))) AS DOUBLE) / len(words) >= 0.75 THEN 1 END END AS tier,
  CAST(len(list_intersect(words, string_split(label, ' '))) AS DOUBLE) / len(words) AS share FROM d, t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ref ORDER BY tier DESC, CASE tier WHEN 2 THEN length(label) WHEN 1 THEN share ELSE 0 END DESC, pos) AS n FROM m WHERE tier IS NOT NULL)
SELECT doc_id, ref, CASE WHEN negate THEN '-' || value ELSE value END AS value, CASE WHEN tier >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE n = 1""",
)
def j8_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.lower("p_name").alias("label"), F.col("p_partkey").cast("string").alias("value"), F.col("p_partkey").alias("pos"))
    return match_labels(pairs, LABELS)


_NAMES = ["Current assets", "Assets", "Liabilities", "Equity", "", "Income", "Current liabilities"]
_HEADINGS = ["TOTAL ASSETS", "Current Assets:", "long-term liabilities", "equity", "Income tax", "Expenses", "ASSETS", "Stockholders' equity"]
_SIDES = f"""
n AS (SELECT o_orderkey AS template, unnest(range(4)) AS k FROM orders),
g AS (SELECT template, k AS grp, regexp_replace(lower({_NAMES!r}[1 + (template + k * (1 + template % 3)) % 7]), '[^a-z0-9]+', '', 'g') AS gn FROM n),
s AS (SELECT template, k AS section, regexp_replace(lower({[h.replace("'", "’") for h in _HEADINGS]!r}[1 + (template * 3 + k * (1 + template % 5)) % 8]), '[^a-z0-9]+', '', 'g') AS sn FROM n)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four groups and four sections for each order, named by its key from the lists, squeezed."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("template"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    t, k = F.col("template"), F.col("k")
    pick = lambda names, at: V.squeeze(F.get(F.array(*map(F.lit, names)), at.cast("int")))
    return n.select("template", k.alias("grp"), pick(_NAMES, (t + k * (1 + t % 3)) % 7).alias("gn")), n.select("template", k.alias("section"), pick(_HEADINGS, (t * 3 + k * (1 + t % 5)) % 8).alias("sn"))


@query(
    "j6_greedy_sections",
    f"""
WITH RECURSIVE {_SIDES},
c AS (SELECT template, grp, list(section ORDER BY CASE WHEN gn = sn THEN 0 ELSE 1 END, section) AS cand FROM g JOIN s USING (template) WHERE gn <> '' AND (contains(gn, sn) OR contains(sn, gn)) GROUP BY ALL),
r AS (SELECT o_orderkey AS template, -1 AS i, []::BIGINT[] AS taken, CAST(NULL AS BIGINT) AS section FROM orders UNION ALL
  SELECT template, i + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT r.template, r.i, taken, list_filter(coalesce(cand, []), lambda x: NOT list_contains(taken, x))[1] AS pick FROM r LEFT JOIN c ON c.template = r.template AND c.grp = r.i + 1 WHERE r.i < 3))
SELECT template, i AS grp, section FROM r WHERE section IS NOT NULL""",
)
def j6_greedy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order take the first section of their name, else the first whose name holds theirs or lies in it; each section once.

    A group tries its exact sections before the others, and all its tries come before the next group's.
    """
    g, s = _sides(spark, sf_dir)
    exact = (F.col("gn") == F.col("sn")) & (F.col("sn") != "")
    near = (F.col("gn") != "") & (F.col("gn").contains(F.col("sn")) | F.col("sn").contains(F.col("gn")))
    candidates = g.join(s, "template").filter(exact | near).withColumn("tier", F.when(exact, 0).otherwise(1))
    return greedy(candidates, ["template"], "grp", "section", ["grp", "tier", "section"])


@query(
    "j7_writer_sections",
    f"""
WITH {_SIDES}
SELECT template, section, grp FROM (SELECT *, row_number() OVER (PARTITION BY template, section ORDER BY CASE WHEN gn = sn THEN 0 ELSE 1 END, grp) AS n FROM s JOIN g USING (template) WHERE gn <> '' AND (gn = sn OR contains(gn, sn) OR contains(sn, gn))) WHERE n = 1""",
)
def j7_writer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section goes to one group, by name or containment; several may go to one."""
    g, s = _sides(spark, sf_dir)
    both = s.join(g.filter("gn != ''"), "template").filter((F.col("gn") == F.col("sn")) | F.col("gn").contains(F.col("sn")) | F.col("sn").contains(F.col("gn")))
    return both.groupBy("template", "section").agg(F.min(F.struct(F.when(F.col("gn") == F.col("sn"), 0).otherwise(1).alias("tier"), "grp")).alias("b")).select("template", "section", F.col("b.grp").alias("grp"))


_ZONES = ["current assets", "non current assets", "total current assets", "other assets", "long term liabilities", "current liabilities", "equity"]
_PRINTED = ["Current Assets", "NON-CURRENT ASSETS", "Total current assets:", "Assets current", "Long-term liabilities", "Liabilities", "Equity"]


def zone_sections(zones: DataFrame, sections: DataFrame) -> DataFrame:
    """doc, zone, section: zones in order take the free section whose words are most like theirs, from 0.6 on and with like numbers of words; of equal ones the first."""
    words = lambda c: V.words(F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))))
    z, s = zones.select("doc", "zone", words("label").alias("zw")).filter("size(zw) > 0"), sections.select("doc", "section", words("heading").alias("sw")).filter("size(sw) > 0")
    both = z.join(s, "doc").withColumn("score", V.jaccard(F.col("zw"), F.col("sw"))).filter((F.col("score") >= 0.6) & (V.count_ratio(F.col("zw"), F.col("sw")) >= 0.7))
    return greedy(both, ["doc"], "zone", "section", ["zone", -F.col("score"), "section"])


@query(
    "j10_zone_sections",
    f"""
WITH RECURSIVE n AS (SELECT o_orderkey AS doc, unnest(range(4)) AS k FROM orders),
z AS (SELECT doc, k AS zone, list_distinct(string_split({_ZONES!r}[1 + (doc + k * (1 + doc % 3)) % 7], ' ')) AS zw FROM n),
s AS (SELECT doc, k AS section, list_distinct(string_split(trim(regexp_replace(lower({_PRINTED!r}[1 + (doc * 3 + k * (1 + doc % 5)) % 7]), '[^a-z0-9]+', ' ', 'g')), ' ')) AS sw FROM n),
b AS (SELECT doc, zone, section, len(list_intersect(zw, sw)) / len(list_distinct(list_concat(zw, sw))) AS score FROM z JOIN s USING (doc) WHERE least(len(zw), len(sw)) / greatest(len(zw), len(sw)) >= 0.7),
c AS (SELECT doc, zone, list(section ORDER BY score DESC, section) AS cand FROM b WHERE score >= 0.6 GROUP BY ALL),
r AS (SELECT o_orderkey AS doc, -1 AS i, []::BIGINT[] AS taken, CAST(NULL AS BIGINT) AS section FROM orders UNION ALL
  SELECT doc, i + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT r.doc, r.i, taken, list_filter(coalesce(cand, []), lambda x: NOT list_contains(taken, x))[1] AS pick FROM r LEFT JOIN c ON c.doc = r.doc AND c.zone = r.i + 1 WHERE r.i < 3))
SELECT doc, i AS zone, section FROM r WHERE section IS NOT NULL""",
)
def j10_zone_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    d, k = F.col("doc"), F.col("k")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    return zone_sections(n.select("doc", k.alias("zone"), pick(_ZONES, (d + k * (1 + d % 3)) % 7).alias("label")), n.select("doc", k.alias("section"), pick(_PRINTED, (d * 3 + k * (1 + d % 5)) % 7).alias("heading")))


def label_classes(labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, w (words in small letters, sorted), class_id (the smallest id with these words), members. Labels without words are in no class."""
    a = labels.select(F.col(id_col).alias("id"), F.array_sort(V.words(F.lower(F.coalesce(text_col, F.lit(""))))).alias("w"))
    named = a.filter(F.size("w") > 0).groupBy("w").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    return a.join(named, "w", "left").select("id", "w", "class_id", "members")


def label_links(classes: DataFrame) -> DataFrame:
    """class_id, other, score of the two-way links between classes whose word sets have a Jaccard of 0.5 and a count ratio of 0.7 at least.

    Classes meet on the rarest words of their sets, as many as a Jaccard of 0.5 needs (of n words, n less half of n, and one), so
    the work does not grow with the copies of a label, which are not paired at all.
    """
    own = classes.filter("class_id IS NOT NULL").select("class_id", "w").distinct()
    word = own.select("class_id", "w", F.explode("w").alias("word"))
    count = word.groupBy("word").agg(F.count("*").alias("n"))
    ranked = word.join(count, "word").groupBy("class_id", "w").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    first = ranked.select("class_id", "w", F.explode(F.slice("r", 1, F.size("r") - F.ceil(F.size("r") / 2).cast("int") + 1)).alias("s")).select("class_id", "w", F.col("s.word").alias("word"))
    others = first.select(F.col("class_id").alias("other"), F.col("w").alias("v"), "word")
    near = F.col("class_id") < F.col("other")
    meet = first.join(others, "word").filter(near & (F.size("w") >= 0.7 * F.size("v")) & (F.size("v") >= 0.7 * F.size("w"))).select("class_id", "w", "other", "v").distinct()
    alike = meet.select("class_id", "other", V.jaccard(F.col("w"), F.col("v")).alias("score"), V.count_ratio(F.col("w"), F.col("v")).alias("ratio")).filter("score >= 0.5 and ratio >= 0.7")
    both = F.array(F.struct("class_id", "other", F.round("score", 6).alias("score")), F.struct(F.col("other").alias("class_id"), F.col("class_id").alias("other"), F.round("score", 6).alias("score")))
    return alike.select(F.inline(both))


@query(
    "j10_j11_similar_labels",
    """
WITH a AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda x: x <> ''))) AS w FROM part),
c AS (SELECT w, min(p_partkey) AS class_id, count(*) AS members FROM a GROUP BY w),
p AS (SELECT x.class_id, len(list_intersect(x.w, y.w)) AS common, len(x.w) AS n, len(y.w) AS m FROM c x JOIN c y ON x.class_id <> y.class_id),
l AS (SELECT class_id, count(*) AS links, round(max(common / (n + m - common)), 6) AS closest FROM p WHERE 2 * common >= n + m - common AND least(n, m) >= 0.7 * greatest(n, m) GROUP BY class_id)
SELECT p_partkey, c.class_id, members, coalesce(links, 0) AS links, closest FROM a JOIN c USING (w) LEFT JOIN l ON l.class_id = c.class_id""",
)
def j10_similar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label with its class, the rows of that class, and how many other classes are like it."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label"))
    classes = label_classes(parts, "p_partkey", "label")
    links = label_links(classes).groupBy("class_id").agg(F.count("*").alias("links"), F.max("score").alias("closest"))
    return classes.join(links, "class_id", "left").select(F.col("id").alias("p_partkey"), "class_id", "members", F.coalesce("links", F.lit(0)).alias("links"), "closest")


def close_match(pairs: DataFrame, a: str, b: str, cutoff: float = 0.6) -> DataFrame:
    """``pairs`` with the ratio of the longest matching blocks of two texts, those below the cut-off left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratio = [difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(batch[a], batch[b])]
            yield batch.assign(ratio=ratio)[[r >= cutoff for r in ratio]]

    return pairs.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", ratio double")


HEADERS = ["qty", "unit price", "description of goods", "line total", "sku code"]
COLUMNS = ["Qty", "Price", "Descripton of good", "Total", "Skucode", "Weight"]


def match_columns(pairs: DataFrame) -> DataFrame:
    """tbl, col, header from pairs(tbl, col, header, h): equal, else the first that holds the other, else the closest by matching blocks from 0.6 on; of equally close ones the text that sorts last."""
    pairs = pairs.withColumns({"c": F.lower("col"), "h": F.lower("h")})
    sure = pairs.withColumn("tier", F.when(F.col("c") == F.col("h"), 0).when(F.col("h").contains(F.col("c")) | F.col("c").contains(F.col("h")), 1)).filter("tier is not null")
    known = sure.groupBy("tbl", "col").agg(F.min(F.struct("tier", "header"))["header"].alias("header"))
    rest = pairs.join(known.select("tbl", "col"), ["tbl", "col"], "left_anti").select("tbl", "col", "c", "h", "header")
    # tables share their texts, so two texts are compared once, however many tables have them
    ratios = close_match(rest.select("c", "h").distinct(), "c", "h")
    near = rest.join(ratios, ["c", "h"]).groupBy("tbl", "col").agg(F.max(F.struct("ratio", "h", (-F.col("header")).alias("first")))["first"].alias("first"))
    return known.union(near.select("tbl", "col", -F.col("first")))


def column_places(names: list[str]) -> Callable[[Column | str], Column]:
    """A function of a table's headers, in small letters, to the places of the names among them, by the rule of ``match_columns``; null where none is like a name.

    It is for tables that are dear to make: they are read once, while pairs of their headers would need them again. Lists of headers recur and are compared once in a batch.
    """

    def place(name: str, headers: tuple[str, ...]) -> int | None:
        sure = [(h != name, i) for i, h in enumerate(headers) if name in h or h in name]
        near = [] if sure else [(difflib.SequenceMatcher(None, h, name).ratio(), h, -i) for i, h in enumerate(headers)]
        best = max([x for x in near if x[0] >= 0.6], default=None)
        return min(sure)[1] if sure else best and -best[2]

    def run(headers: pd.Series) -> pd.Series:
        lists = [tuple(x) for x in headers]
        known = {x: [place(n.lower(), x) for n in names] for x in set(lists)}
        return pd.Series([known[x] for x in lists], dtype=object)

    return F.pandas_udf(run, "array<int>")


@query(
    "j9_column_headers",
    f"""
SELECT c_custkey AS tbl, col, CAST((place + 5 - c_custkey % 5) % 5 AS INTEGER) AS header
FROM customer, {values_sql("col, place", [("Qty", 0), ("Price", 1), ("Descripton of good", 2), ("Total", 3), ("Skucode", 4)])}""",
)
def j9_column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed table for each customer, its headers turned by as many places as the key says."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(len(HEADERS) - 1)), lambda i: F.get(F.array(*map(F.lit, HEADERS)), ((i + F.col("c_custkey")) % len(HEADERS)).cast("int")))
    printed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tbl"), F.posexplode(turned).alias("header", "h"))
    return match_columns(printed.select("tbl", "header", "h", F.explode(F.array(*map(F.lit, COLUMNS))).alias("col")))


BANDS = [(1, -1000.0, 0.0), (2, 0.0, 2500.0), (3, 2500.0, 6000.0), (4, 6000.0, 10000.0)]


@query("j12_j16_bands", f"SELECT c_custkey, band FROM customer JOIN {values_sql('band, lo, hi', BANDS)} ON c_acctbal >= lo - 12 AND c_acctbal + 5 <= hi + 12")
def j12_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to the columns whose band holds them, with a margin of twelve; a word near an edge can fall in two.

    The bands of a page are few: an array in the row, so that no range join is needed.
    """
    fits = F.filter(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, lo, hi in BANDS]), lambda b: (F.col("c_acctbal") >= b["lo"] - 12) & (F.col("c_acctbal") + 5 <= b["hi"] + 12))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.transform(fits, lambda b: b["band"])).alias("band"))


@query(
    "j13_rank_columns",
    """
WITH w AS (SELECT l_orderkey, l_suppkey % 3 AS cluster, min(l_extendedprice) AS x FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, cluster) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS k FROM w)
SELECT l_orderkey, cluster, CASE rank WHEN 1 THEN 'Item' WHEN 2 THEN 'Qty' ELSE 'Amount' END AS name FROM n WHERE k = 3""",
)
def j13_rank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters take the template's columns by rank, where there are as many of both."""
    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("cluster")).agg(F.min("l_extendedprice").alias("x"))
    by = Window.partitionBy("l_orderkey")
    ranked = w.select("*", F.row_number().over(by.orderBy("x", "cluster")).alias("rank"), F.count("*").over(by).alias("k")).filter("k = 3")
    return ranked.select("l_orderkey", "cluster", F.element_at(F.array(F.lit("Item"), F.lit("Qty"), F.lit("Amount")), F.col("rank")).alias("name"))


@query("j1_j2_fact_lookup", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j1_fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their documents' dimension rows; Spark broadcasts what its size allows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query("j4_new_files", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j4_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("j5_processed_state", "(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000) INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def j5_processed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed or downloaded, of those still listed."""
    c = table(spark, sf_dir, "customer")
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).union(c.filter("c_acctbal > 9000").select("c_custkey"))
    return seen.distinct().join(c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("id")), "id", "left_semi")


@query(
    "j17_ref_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE chr(65 + CAST(l_partkey % 26 AS INTEGER)) IN ('B', 'D', 'F')""",
)
def j17_ref_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose reference lies in one of the value columns."""
    ref = V.cell_ref(F.col("l_linenumber"), (F.col("l_partkey") % 26).cast("int"))
    columns = rows(spark, "letters string", [("B",), ("D",), ("F",)])
    return table(spark, sf_dir, "lineitem").withColumn("letters", F.upper(F.regexp_extract(ref, "^([A-Za-z]+)[0-9]+$", 1))).join(columns, "letters", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


_REFS = [("Invoice No", "B1"), ("Total", "B9"), ("Tax", "B8")]


@query(
    "j18_j19_e14_coercion",
    f"""WITH t AS (SELECT lower(label) AS label, ref FROM {values_sql("label, ref", _REFS)}),
a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'B9' WHEN 1 THEN ' TOTAL ' WHEN 2 THEN 'tax rate' ELSE 'other' END AS k, printf('%.2f', o_totalprice) AS v FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(k, '^[A-Z]+[0-9]+$') THEN k ELSE coalesce(t.ref, CASE WHEN contains(lower(trim(k)), 'tax') THEN 'B8' END) END AS ref, v FROM a LEFT JOIN t ON t.label = lower(trim(k)) WHERE k <> 'other'""",
)
def j18_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an answer as cell references: as they are, by label without case, else by the first label that holds the key or lies in it."""
    k = F.col("o_orderkey") % 4
    key = F.when(k == 0, "B9").when(k == 1, " TOTAL ").when(k == 2, "tax rate").otherwise("other")
    label = V.strip(F.lower("k"))
    exact, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, ref in reversed(_REFS):
        exact = F.when(label == name.lower(), ref).otherwise(exact)
        near = F.when(label.contains(name.lower()) | F.lit(name.lower()).contains(label), ref).otherwise(near)
    a = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("k"), F.format_string("%.2f", "o_totalprice").alias("v"))
    return a.select("o_orderkey", F.when(F.col("k").rlike("^[A-Z]+[0-9]+$"), F.col("k")).otherwise(F.coalesce(exact, near)).alias("ref"), "v").filter("ref is not null")


@query("j20_expected_counts", "SELECT p_brand, count(*) AS actual, 90 AS expected FROM part GROUP BY p_brand HAVING regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') <> '' AND count(*) < 0.8 * 90")
def j20_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("actual")).withColumn("key", V.squeeze(F.col("p_brand")))
    expected = table(spark, sf_dir, "part").select(F.upper("p_brand").alias("heading")).distinct().select(V.squeeze(F.col("heading")).alias("key"), F.lit(90).alias("expected"))
    return actual.join(expected, "key", "left").filter("actual < 0.8 * expected").select("p_brand", "actual", "expected")


@query(
    "j21_ref_labels",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN p_type ELSE 'B' || p_partkey END AS label FROM part""",
)
def j21_ref_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label that any of several look-ups has, else the reference itself."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    look = lambda n, c: part.filter(k % n == 0).select("p_partkey", F.col(c).alias(f"l{n}"))
    joined = part.select("p_partkey").join(look(2, "p_name"), "p_partkey", "left").join(look(3, "p_brand"), "p_partkey", "left").join(look(5, "p_type"), "p_partkey", "left")
    return joined.select("p_partkey", F.coalesce("l2", "l3", "l5", F.concat(F.lit("B"), k.cast("string"))).alias("label"))


def drop_redundant(sections: DataFrame, order: str = "section") -> DataFrame:
    """Sections (doc, section, labels array, matched) without those that repeat a matched one: they have more rows, nine tenths of its labels, and one label more at most.

    The sections of a document are folded in order; one that was dropped drops no other. Sections without labels stay.
    """
    listed = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "section", "labels", "matched"))).alias("all"))
    small_size = lambda small: F.size(F.array_distinct(small["labels"]))
    covers = lambda big, small: small["matched"] & (small_size(small) > 0) & (F.size(big["labels"]) > F.size(small["labels"])) & (F.size(F.array_intersect(big["labels"], small["labels"])) >= 0.9 * small_size(small)) & (F.size(F.array_except(big["labels"], small["labels"])) <= 1)
    dropped = lambda gone, big: F.when(F.exists("all", lambda small: (small["section"] != big["section"]) & ~F.array_contains(gone, small["section"]) & covers(big, small)), F.concat(gone, F.array(big["section"]))).otherwise(gone)
    gone = F.aggregate("all", F.array().cast(f"array<{sections.schema['section'].dataType.simpleString()}>"), dropped)
    return listed.select("doc", F.explode(F.array_except(F.transform("all", lambda x: x["section"]), gone)).alias("section"))


@query(
    "u5_redundant_sections",
    """
WITH RECURSIVE n AS (SELECT l_orderkey AS doc, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
s AS (SELECT doc, k AS section, CASE WHEN doc % 2 = 0 THEN k ELSE n + 1 - k END AS pos, (doc + k) % 3 <> 0 AS matched FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n)),
c AS (SELECT b.doc, b.pos, b.section, list(a.section) FILTER (a.section IS NOT NULL) AS covered FROM s b LEFT JOIN s a ON a.doc = b.doc AND a.matched AND b.section = a.section + 1 GROUP BY ALL),
r AS (SELECT doc, 0 AS i, []::BIGINT[] AS gone FROM n UNION ALL
  SELECT r.doc, i + 1, CASE WHEN len(list_filter(coalesce(covered, []), lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, c.section) ELSE gone END FROM r JOIN c ON c.doc = r.doc AND c.pos = r.i + 1)
SELECT s.doc, s.section FROM s JOIN r ON r.doc = s.doc JOIN n ON n.doc = s.doc AND n.n = r.i WHERE NOT list_contains(gone, s.section)""",
)
def u5_redundant_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section k of an order has the labels 1 to k; orders run up or down, and every third section is not matched."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.max("l_linenumber").cast("long").alias("n"))
    s = n.select("doc", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("section"))
    s = s.select("doc", "section", F.when(F.col("doc") % 2 == 0, F.col("section")).otherwise(F.col("n") + 1 - F.col("section")).alias("pos"), F.sequence(F.lit(1).cast("long"), F.col("section")).alias("labels"), ((F.col("doc") + F.col("section")) % 3 != 0).alias("matched"))
    return drop_redundant(s, "pos")
