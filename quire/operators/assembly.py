"""From the pages of a file to its results: which documents it holds, what sections each has, and their answers put together.

Every question to an outside model goes through ``model.respond``: its recorded answer is joined by document and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.registry import SPANNING
from quire.operators import model

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
GROUP = "array<struct<label:string,start_row:int,end_row:int,label_col:string,value_col:string>>"


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str) -> Column:
    """The elements of a list, null where there is no list."""
    return _at(v, path, "array<variant>")


def _numbers(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _file_name(stem: Column, suffix: Column, several: Column, index: Column) -> Column:
    return F.when(several, F.concat(stem, F.lit("_doc"), (index + 1).cast("string"), suffix)).otherwise(F.concat(stem, suffix))


def boundaries(files: DataFrame, answers: DataFrame, providers: list[str]) -> DataFrame:
    """doc_id, index, file_name, hint, page_nos, segment, gaps, overlaps: the documents inside each file.

    ``files`` has doc_id, kind, pages (array), stem and suffix. A file of several pages has a document on each, unless its
    kind spans pages; such a file, and a single page, is asked about (task ``boundaries``). Page ranges are cut at the ends
    of the file and kept as they are answered: a page in two ranges is in both documents (``overlaps`` counts those of the
    file), a page in none is in no document (``gaps``), a range that ends before it starts has no pages. Without an answer,
    with a page that is no number or with fewer than two documents, the file is one. Null or no pages: one document
    without pages.
    """
    n = F.size(F.coalesce("pages", F.array().cast("array<string>")))
    own = files.select("doc_id", F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), "stem", "suffix", n.alias("n"))
    own = own.withColumn("split", (F.col("n") > 1) & ~F.lower("kind").isin(SPANNING))
    asked = own.withColumn("task", F.when((F.col("n") > 0) & ~F.col("split"), "boundaries"))
    told = model.respond(asked, answers, providers).withColumn("listed", _list(F.col("parsed"), "$.documents"))

    found = lambda index, pages, hint: F.struct(index.cast("int").alias("index"), pages.alias("page_nos"), hint.alias("hint"))
    whole = F.array(found(F.lit(0), _numbers(F.col("n")), F.lit("full document")))
    each = F.transform(_numbers(F.col("n")), lambda i: found(i, F.array(i), F.concat(F.lit("page "), (i + 1).cast("string"))))

    def beside(d: Column, i: Column) -> Column:
        index = F.coalesce(_at(d, "$.index", "int"), i)
        return found(index, F.array(F.lit(0)), F.coalesce(_at(d, "$.hint"), F.concat(F.lit("doc "), (index + 1).cast("string"))))

    def ranged(d: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), F.coalesce(_at(d, "$.start_page", "int"), F.lit(1)) - 1)
        end = F.least(F.col("n") - 1, F.coalesce(_at(d, "$.end_page", "int"), start + 1) - 1)
        pages = F.when(end >= start, F.sequence(start, F.greatest(start, end))).otherwise(F.array().cast("array<int>"))
        return found(F.coalesce(_at(d, "$.doc_number", "int"), i + 1) - 1, pages, F.coalesce(_at(d, "$.hint"), F.concat(F.lit("document "), (i + 1).cast("string"))))

    strange = lambda d, path: _at(d, path, "variant").isNotNull() & _at(d, path, "int").isNull()
    odd = lambda d: strange(d, "$.start_page") | strange(d, "$.end_page") | strange(d, "$.doc_number")
    several = F.coalesce((_at(F.col("parsed"), "$.document_count", "int") > 1) & (F.size("listed") > 0), F.lit(False))
    believed = several & F.coalesce(_at(F.col("parsed"), "$.is_multi_document", "boolean"), F.lit(False)) & ~F.coalesce(F.exists("listed", odd), F.lit(False))
    parts = F.when(F.col("split"), each).when((F.col("n") == 1) & several, F.transform("listed", beside)).when((F.col("n") > 1) & believed, F.transform("listed", ranged)).otherwise(whole)

    cut = told.select("doc_id", "pages", "stem", "suffix", "n", parts.alias("parts")).withColumn("claimed", F.flatten(F.transform("parts", lambda p: p["page_nos"])))
    out = cut.select(
        "doc_id", "pages", "stem", "suffix", (F.size("parts") > 1).alias("several"), F.size(F.array_except(_numbers(F.col("n")), "claimed")).alias("gaps"),
        F.when(F.col("n") > 1, F.size("claimed") - F.size(F.array_distinct("claimed"))).otherwise(0).alias("overlaps"), F.inline("parts"),
    )
    name = _file_name(F.col("stem"), F.col("suffix"), F.col("several"), F.col("index"))
    text = F.array_join(F.transform("page_nos", lambda i: F.get("pages", i)), PAGE_BREAK)
    return out.select("doc_id", "index", name.alias("file_name"), "hint", "page_nos", text.alias("segment"), "gaps", "overlaps")


def document_map(files: DataFrame, answers: DataFrame, providers: list[str]) -> DataFrame:
    """doc_id, doc (place in the file), doc_index, file_name, doc_type, identifier, page_nos, groups, sections, taken (for each group the place of its section or -1) of every document that the inventory of a file (task ``map``) lists.

    ``files`` has doc_id, kind, n (pages), stem, suffix and groups (``GROUP``: column groups of its template, null for none).
    Without a usable inventory a file is one document of type other with all pages and a section for each group of its
    template, or one for everything. A document without an index takes its place, one without a type the kind of its file.
    """
    section = lambda heading, page, count, structure: F.struct(heading.alias("heading"), page.alias("page"), count.alias("item_count"), structure.alias("structure"))
    told = model.respond(files.withColumns({"task": F.lit("map"), "groups": F.coalesce("groups", F.array().cast(GROUP))}), answers, providers)

    def read_section(s: Column) -> Column:
        return section(F.coalesce(_at(s, "$.heading"), F.lit("")), F.coalesce(_at(s, "$.page", "int"), F.lit(0)), F.coalesce(_at(s, "$.item_count", "int"), F.lit(0)), F.coalesce(_at(s, "$.structure"), F.lit("table")))

    document = lambda index, kind, name, pages, sections: F.struct(index.alias("doc_index"), kind.alias("doc_type"), name.alias("identifier"), pages.alias("page_nos"), sections.alias("sections"))

    def read(d: Column, i: Column) -> Column:
        kind = F.coalesce(F.nullif(_at(d, "$.doc_type"), F.lit("")), F.nullif(F.col("kind"), F.lit("")), F.lit("other"))
        listed = F.transform(F.coalesce(_list(d, "$.sections"), F.array().cast("array<variant>")), read_section)
        return document(F.coalesce(_at(d, "$.doc_index", "int"), i), kind, F.coalesce(_at(d, "$.identifier"), F.lit("")), F.coalesce(_at(d, "$.pages", "array<int>"), F.array(F.lit(0))), listed)

    grouped = F.transform("groups", lambda g: section(F.coalesce(g["label"], F.lit("")), F.lit(0), F.greatest(F.lit(1), g["end_row"] - g["start_row"] + 1), F.lit("table")))
    everything = F.array(section(F.lit("Document"), F.lit(0), F.lit(10), F.lit("mixed")))
    plain = F.array(document(F.lit(0), F.lit("other"), F.lit(""), _numbers(F.greatest("n", F.lit(1))), F.when(F.size("groups") > 0, grouped).otherwise(everything)))
    found = _list(F.col("parsed"), "$.documents")
    mapped = told.select("doc_id", "stem", "suffix", "groups", F.when(F.coalesce(F.size(found) > 0, F.lit(False)), F.transform(found, read)).otherwise(plain).alias("documents"))
    out = mapped.select("doc_id", "stem", "suffix", "groups", (F.size("documents") > 1).alias("several"), F.posexplode("documents").alias("doc", "d")).select("*", "d.*")
    # names are squeezed once, in a projection of their own, not again for every pair
    out = out.withColumns({"keys": F.transform("sections", lambda s: V.squeeze(s["heading"])), "names": F.transform("groups", lambda g: V.squeeze(g["label"]))})
    return out.select("doc_id", "doc", "doc_index", _file_name(F.col("stem"), F.col("suffix"), F.col("several"), F.col("doc_index")).alias("file_name"), "doc_type", "identifier", "page_nos", "groups", "sections", "keys", "names").withColumn("taken", _group_sections(F.col("names"), F.col("keys"))).drop("keys", "names")


def _group_sections(names: Column, keys: Column) -> Column:
    """For each name, in order, the place of the key it takes or -1: the first free one that is the name, else the first free one that holds it or lies in it."""
    places = _numbers(F.size(keys))

    def step(taken: Column, name: Column) -> Column:
        free = lambda test: F.get(F.filter(places, lambda i: test(F.get(keys, i)) & ~F.array_contains(taken, i)), 0)
        exact = free(lambda k: (k != "") & (k == name))
        near = free(lambda k: (name != "") & (k.contains(name) | name.contains(k)))
        return F.concat(taken, F.array(F.coalesce(exact, near, F.lit(-1))))

    return F.aggregate(names, F.array().cast("array<int>"), step)


def section_tasks(documents: DataFrame) -> DataFrame:
    """doc_id, doc, section (its place), task, heading, page, item_count, structure, group, label, first, last: a row for every section of ``document_map``.

    Its label is the name of the template's group that it fills, else its heading; of the sections with one label ``first`` is the place of
    the first, and ``last`` marks the last.
    """
    each = documents.select("doc_id", "doc", "groups", "taken", F.posexplode("sections").alias("section", "s"))
    out = each.select("doc_id", "doc", "section", "s.*", F.get("groups", F.array_position("taken", F.col("section")).cast("int") - 1).alias("group"))
    label = F.coalesce(F.nullif(F.col("group.label"), F.lit("")), F.nullif(F.col("heading"), F.lit("")), F.lit("section"))
    same = Window.partitionBy("doc_id", "doc", "label")
    marked = out.withColumn("label", label).withColumns({"first": F.min("section").over(same), "last": F.col("section") == F.max("section").over(same)})
    return marked.withColumn("task", F.concat_ws(":", F.lit("section"), F.col("doc").cast("string"), F.col("section").cast("string")))


def _rows(group: Column) -> Column:
    """The rows of the first section in an answer, numbered by their places; what is no object is left out, but keeps its number."""
    inner = F.coalesce(_at(F.col("parsed"), "$.documents[0]", "variant"), F.col("parsed"))
    # variants have their keys in order of the alphabet: the text tells which came first, and its beginning is enough where the key is plain
    wrapped = _at(F.col("parsed"), "$.documents[0]", "variant").isNotNull()
    blocks = F.when(wrapped, F.get_json_object("json", "$.documents[0].layout_sections")).otherwise(F.get_json_object("json", "$.layout_sections"))
    plain = F.regexp_extract(blocks, r'^\{"([^"\\]+)":', 1)
    first = F.when(plain != "", plain).otherwise(F.get(F.json_object_keys(blocks), 0))
    rows = _list(F.try_element_at(_at(inner, "$.layout_sections", "map<string,variant>"), first), "$.rows")
    text = lambda r, path: F.coalesce(_at(r, path), F.lit(""))
    column = lambda r, path, given, plain: F.upper(F.coalesce(F.nullif(given, F.lit("")), F.when(group.isNull(), F.nullif(text(r, path), F.lit(""))), F.lit(plain)))
    read = F.transform(rows, lambda r, i: F.when(F.schema_of_variant(r).startswith("OBJECT"), F.struct(column(r, "$.label_col", group["label_col"], "A").alias("label_col"), column(r, "$.value_col", group["value_col"], "B").alias("value_col"), (i + 1).alias("row"), text(r, "$.label").alias("label"), text(r, "$.value").alias("value"))))
    return F.coalesce(F.filter(read, lambda r: r.isNotNull()), F.array().cast("array<struct<label_col:string,value_col:string,row:int,label:string,value:string>>"))


def _fields() -> Column:
    """The single fields of an answer as (key, value)."""
    inner = F.coalesce(_at(F.col("parsed"), "$.documents[0]", "variant"), F.col("parsed"))
    found = F.map_entries(_at(inner, "$.extracted_fields", "map<string,variant>"))
    value = lambda v: F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), _at(v, "$.value")).otherwise(_at(v, "$")), F.lit(""))
    return F.coalesce(F.transform(found, lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))


def assemble(documents: DataFrame, answers: DataFrame, providers: list[str]) -> DataFrame:
    """The rows of ``document_map`` with layout_sections (label and rows) and fields (key and value), in the order of the document.

    A section goes under the name of the template's group that it fills, else under its heading; of several with one name the
    last is kept, at the place of the first. Groups that no section fills come last and are empty. Sections without an
    answer have no rows. A document's sections are collected in one row, which is its result.
    """
    told = model.read_answers(section_tasks(documents), answers, providers)
    rows = F.when(F.col("last"), F.struct("first", "label", _rows(F.col("group")).alias("rows")))
    parts = told.groupBy("doc_id", "doc").agg(F.array_sort(F.collect_list(rows)).alias("kept"), F.array_sort(F.collect_list(F.struct("section", _fields().alias("fields")))).alias("parts"))
    out = documents.join(parts, ["doc_id", "doc"], "left")
    for name in ("kept", "parts"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(parts.schema[name].dataType)))

    empty = F.array().cast("array<struct<label_col:string,value_col:string,row:int,label:string,value:string>>")
    kept = F.transform("kept", lambda p: F.struct(p["label"].alias("label"), p["rows"].alias("rows")))
    unfilled = F.array_distinct(F.filter(F.transform("groups", lambda g, i: F.when(F.get("taken", i) < 0, F.coalesce(g["label"], F.concat(F.lit("group_"), i.cast("string"))))), lambda g: g.isNotNull()))
    rest = F.transform(F.array_except(unfilled, F.transform("kept", lambda p: p["label"])), lambda n: F.struct(n.alias("label"), empty.alias("rows")))
    fields = F.flatten(F.transform("parts", lambda p: p["fields"]))
    return out.select("doc_id", "doc", "doc_index", "file_name", "doc_type", "identifier", "page_nos", F.concat(kept, rest).alias("layout_sections"), fields.alias("fields"))


def facts(results: DataFrame, about: str | None = None) -> DataFrame:
    """doc_id, doc, place, key, value, ref: what the results say by label, then their single fields; of one key the last value counts, at the place of the first. Rows without a label are left out.

    With ``about``, a column of results, it stands beside each fact, and a document without facts has one row without a key.
    """
    entry = lambda key, value, ref: F.struct(key.alias("key"), value.alias("value"), ref.alias("ref"))
    rows = F.filter(F.flatten(F.transform("layout_sections", lambda s: s["rows"])), lambda r: r["label"] != "")
    said = F.concat(F.transform(rows, lambda r: entry(r["label"], r["value"], F.concat(r["value_col"], r["row"].cast("string")))), F.transform("fields", lambda f: entry(f["key"], f["value"], f["key"])))
    keys = ["doc_id", "doc", *([about] if about else [])]
    each = results.select(*keys, F.posexplode_outer(said).alias("place", "e")).select(*keys, "place", "e.*")
    told = each if about else each.filter("place IS NOT NULL")
    return told.groupBy(*keys, "key").agg(F.min("place").alias("place"), F.max_by(F.struct("value", "ref"), "place").alias("last")).select(*keys, "place", "key", "last.*")
