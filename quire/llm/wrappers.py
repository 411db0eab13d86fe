"""Main text of web pages by wrapper induction.

A page is read into a tree of its block elements, in which siblings with the same label (tag, classes, id) are one node, so
lists and paragraphs of any number give the same tree: the page's skeleton. The skeletons of a host are aligned by simple tree
matching (the largest set of pairs of nodes with equal labels that keeps order and parents) and merged into the host's
wrapper, whose nodes know the least and greatest hash of their text over all pages. A node with one text on all pages, of
two different pages at least, is template; nodes whose text varies are slots.

What is read out: the article (``article``, or ``main`` where there is none), without menus, footers, sidebars, notices,
adverts, forms and reader comments, which tags, roles and class names mark. Of several articles those that are template
go, if another one varies. Pages without such an element give their slots that are not marked and are no lists of links.
Inside an article nothing goes for being the same on all pages: two captures of one article differ in their surroundings only.

Work is dealt by page, then by (host, skeleton, node) with partial sums, and skeletons of a host in groups of ``FAN`` until
one wrapper is left, so neither a large host nor one with many skeletons meets in one task. Skeletons are merged in their own
order, so the result does not depend on how rows are dealt.

A null page is empty, a null url belongs to the host "". Unclosed tags and quotes are read as browsers do, elements nested
deeper than ``DEPTH`` keep their text and marks. Pages of one id are judged each by itself; no pages give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import carried, shared_dir, with_carried

FAN = 64
DEPTH = 150
#: Roles of all (host, skeleton) pairs are sent to every task up to this size, beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
LINKS = 0.5

_WORDS = lambda words: frozenset(words.split())
BLOCKS = _WORDS("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody thead tfoot tr td th caption ul")
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
#: Their content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "iframe", "noframes", "noembed")}
IGNORED = _WORDS("html head body")
#: Never part of an article.
HARD_TAGS = _WORDS("nav footer aside menu dialog noscript template svg canvas audio video object button select datalist applet search")
HARD_ROLES = _WORDS("navigation contentinfo complementary search dialog alertdialog menu menubar toolbar")
HARD_NAMES = _WORDS("comment comments commentlist disqus respond reply replies")
#: Not part of an article either, but they may stand around one.
SOFT_NAMES = _WORDS("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations pagination pager copyright alert alerts")
HEADER_NAMES = _WORDS("header")
#: Class names with these words say what a page has, or name parts of the article.
NOT_MARKS = _WORDS("has no with without not is")
ARTICLE_PARTS = _WORDS("post entry article story content title")
#: What a new element closes, and where that ends.
_CLOSES = {"li": (_WORDS("li"), _WORDS("ul ol menu dir")), "dt": (_WORDS("dt dd"), _WORDS("dl")), "dd": (_WORDS("dt dd"), _WORDS("dl")), "td": (_WORDS("td th"), _WORDS("table tr")), "th": (_WORDS("td th"), _WORDS("table tr")), "tr": (_WORDS("tr"), _WORDS("table")), **{t: (_WORDS("thead tbody tfoot"), _WORDS("table")) for t in ("thead", "tbody", "tfoot")}}
_P = (_WORDS("p"), _WORDS("table td th caption button object"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# -- reading a page -------------------------------------------------------------------------------------------------------------


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), ("open", tag, attributes) and ("close", tag, ""); comments, declarations and raw content are passed over."""
    at, loose = 0, False
    while at < len(html):
        low = html.find("<", at)
        if low < 0:
            yield "", "", html[at:]
            return
        if low > at:
            yield "", "", html[at:low]
        if found := _TAG.match(html, low):
            end = None if loose else _END.match(html, found.end())
            loose = end is None  # a quote that never ends: from here on tags end at the next >
            at = end.end() if end else html.find(">", found.end()) + 1
            if not at:
                return
            tag = found[2].lower()
            yield ("close", tag, "") if found[1] else ("open", tag, html[found.end() : at - 1])
            if tag in RAW and not found[1]:
                close = RAW[tag].search(html, at)
                if not close:
                    return
                at = close.start()
        elif html.startswith("<!--", low):
            at = low + 5 if html.startswith("<!-->", low) else html.find("-->", low + 4) + 3
            if at == 2:
                return
        elif html.startswith(("<!", "<?", "</"), low):
            at = html.find(">", low) + 1
            if not at:
                return
        else:
            yield "", "", "<"
            at = low + 1


class Node:
    """A block element of the skeleton. ``kind``: "h" never content, "s" marked, "e" a header, "a" an article, "m" the main part, "" else."""

    __slots__ = ("label", "kind", "children", "number")

    def __init__(self, kind: str, label: str) -> None:
        self.kind, self.label, self.children, self.number = kind, label, {}, 0

    def child(self, kind: str, label: str) -> Node:
        key = f"{kind}|{label}"
        if key not in self.children:
            self.children[key] = Node(kind, key)
        return self.children[key]


def _label(tag: str, attributes: str) -> tuple[str, str]:
    """The kind of an element and its name among its siblings; numbers of two digits and more are alike, as they count pages."""
    if "=" not in attributes:
        return "h" if tag in HARD_TAGS else "s" if tag == "form" else "e" if tag == "header" else "a" if tag == "article" else "m" if tag == "main" else "", tag
    given = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    names = [re.sub(r"\d\d+", "0", x) for x in [*given.get("class", "").split(), *given.get("id", "").split()]]
    role = given.get("role", "").lower()
    kind = "h" if tag in HARD_TAGS or role in HARD_ROLES else "s" if tag == "form" else "e" if tag == "header" or role == "banner" else ""
    for name in names:
        words = {w.lower() for w in _NAME.findall(name)}
        if words & NOT_MARKS:
            continue
        if words & HARD_NAMES:
            kind = "h"
        elif words & SOFT_NAMES and kind != "h":
            kind = "s"
        elif words & HEADER_NAMES and not words & ARTICLE_PARTS:
            kind = kind or "e"
    if not kind:
        kind = "a" if tag == "article" or role == "article" or given.get("itemprop") == "articleBody" else "m" if tag == "main" or role == "main" else ""
    return kind, ".".join([tag, *sorted(set(names)), *([role] if role else [])])


def read(html: str | None) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The skeleton and the blocks in page order: (node, text with single blanks, characters of it in links)."""
    root = Node("", "|body")
    stack: list[tuple[str, Node, bool]] = [("", root, False)]
    opened: Counter[str] = Counter()
    blocks, text, linked, link = [], [], 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            if joined := " ".join("".join(text).split()):
                blocks.append((stack[-1][1], joined, min(linked, len(joined))))
            text.clear()
            linked = 0

    def close(tags: frozenset[str], scope: frozenset[str] = frozenset()) -> None:
        """Up to the innermost open one of ``tags``, unless ``scope`` comes first."""
        if not any(opened[t] for t in tags):
            return
        at = len(stack) - 1
        while at and stack[at][0] not in tags:
            if stack[at][0] in scope:
                return
            at -= 1
        if any(stack[k][0] in BLOCKS or stack[k][1] is not stack[k - 1][1] for k in range(at, len(stack))):
            flush()
        for tag, _, _ in stack[at:]:
            opened[tag] -= 1
        del stack[at:]

    for what, tag, rest in tokens(html or ""):
        if not what:
            if not stack[-1][2]:
                piece = unescape(rest) if "&" in rest else rest
                text.append(piece)
                linked += len(piece) * link
        elif what == "close":
            if tag == "a":
                link = False
            if tag == "p" and not opened["p"]:
                flush()  # stands for an empty paragraph
            elif tag not in IGNORED and tag not in VOID:
                close(frozenset((tag,)))
        elif tag == "br":
            if not stack[-1][2]:
                text.append(" ")
        elif tag not in IGNORED:
            if tag in BLOCKS:
                close(*_P)
                if tag in _CLOSES:
                    close(*_CLOSES[tag])
                flush()
            if tag in VOID:
                continue
            if tag == "a":
                link = True
            _, node, hidden = stack[-1]
            kind, label = _label(tag, rest)
            if not hidden:
                if tag not in BLOCKS and (kind == "h" or kind == "s"):
                    hidden = True  # within a line of text
                elif kind == "h":
                    node, hidden = node.child(kind, label), True
                elif tag in BLOCKS and (len(stack) < DEPTH or kind and not node.kind):
                    node = node.child(kind, label)
            stack.append((tag, node, hidden))
            opened[tag] += 1
    flush()
    return root, blocks


def _skeleton(root: Node) -> list:
    """[label, number, children] with nodes numbered in page order."""
    count = 0

    def walk(node: Node) -> list:
        nonlocal count
        node.number, count = count, count + 1
        return [node.label, node.number, [walk(c) for c in node.children.values()]]

    return walk(root)


def _key(tree: list) -> tuple[str, str]:
    written = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(written.encode()).hexdigest(), written


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


# -- alignment ------------------------------------------------------------------------------------------------------------------


def match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching of two trees with equal roots: the number of pairs, and for the children the pairs (i, j, their own pairs)."""
    left, right = a[2], b[2]
    inner = {(i, j): match(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0]}
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            pair = inner.get((i - 1, j - 1))
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pair[0] if pair else 0)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        pair = inner.get((i - 1, j - 1))
        if pair and best[i][j] == best[i - 1][j - 1] + pair[0]:
            pairs.append((i - 1, j - 1, pair[1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs[::-1]


def _sum(a: list | None, b: list | None) -> list | None:
    """Text figures of two nodes together: least and greatest hash of the text, of the page, characters, and those in links."""
    return a or b if a is None or b is None else [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5]]


def merge(a: list, b: list, pairs: list | None = None) -> list:
    """The tree of both: matched nodes are one, the others stand between them, those of the first before those of the second."""
    pairs = match(a, b)[1] if pairs is None else pairs
    children, i, j = [], 0, 0
    for x, y, inner in [*pairs, (len(a[2]), len(b[2]), None)]:
        children += a[2][i:x] + b[2][j:y]
        if inner is not None:
            children.append(merge(a[2][x], b[2][y], inner))
        i, j = x + 1, y + 1
    return [a[0], _sum(a[1], b[1]), children]


def _constant(figures: list | None) -> bool:
    return figures is not None and figures[0] == figures[1] and figures[2] != figures[3]


def content(skeleton: list, wrapper: list) -> list[int]:
    """Numbers of the skeleton's nodes whose text is content, by their marks and by what the host's wrapper says of the nodes they match."""
    nodes: list[tuple[list, list | None, tuple[int, ...]]] = []  # (node, its wrapper figures, its ancestors and itself as places in this list)

    def walk(node: list, other: list | None, pairs: list, above: tuple[int, ...]) -> None:
        here = (*above, len(nodes))
        nodes.append((node, other[1] if other else None, here))
        found = {x: (other[2][y], inner) for x, y, inner in pairs} if other else {}
        for k, child in enumerate(node[2]):
            walk(child, *found.get(k, (None, [])), here)

    walk(skeleton, wrapper, match(skeleton, wrapper)[1], ())
    kind = [n[0].split("|", 1)[0] for n, _, _ in nodes]
    kinds = [[kind[k] for k in line] for _, _, line in nodes]
    tops: list[int] = []
    for wanted, around in (("a", "hse"), ("m", "hse"), ("a", "h"), ("m", "h")):
        tops = [k for k, line in enumerate(kinds) if line[-1] == wanted and not any(x and x in around for x in line) and line.count(wanted) == 1]
        if tops:
            break
    if not tops:
        return [n[1] for (n, figures, _), line in zip(nodes, kinds) if not any(x and x in "hse" for x in line) and not _constant(figures) and not (figures and figures[5] > LINKS * figures[4])]
    inside = {top: [k for k, (_, _, line) in enumerate(nodes) if top in line and not any(x and x in "hs" for x in kinds[k][line.index(top) + 1 :])] for top in tops}
    varying = [top for top in tops if any(nodes[k][1] and not _constant(nodes[k][1]) for k in inside[top])]
    return sorted({nodes[k][0][1] for top in varying or tops for k in inside[top]})


# -- over a table of pages --------------------------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


_FIGURES = "struct<node:int,text:long,chars:long,links:long,tree:string>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its skeleton's key, a hash of the page, and the figures of its nodes; number -1 has the skeleton."""
    kind = pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("tree", pa.string())])
    for batch in batches:
        keys, pages, figures = [], [], []
        for html in batch.column("html").to_pylist():
            root, blocks = read(html)
            key, tree = _key(_skeleton(root))
            texts: dict[int, list] = {}
            for node, text, links in blocks:
                texts.setdefault(node.number, []).append((text, links))
            keys.append(key)
            pages.append(_hash("\n".join(text for _, text, _ in blocks)))
            figures.append([(-1, None, None, None, tree), *((k, _hash("\n".join(t for t, _ in v)), sum(len(t) for t, _ in v), sum(x for _, x in v), None) for k, v in texts.items())])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.array([[dict(zip(("node", "text", "chars", "links", "tree"), f)) for f in x] for x in figures], pa.list_(kind))], ["host", "skeleton", "page", "figures"])


def _grown(batches: Iterator) -> Iterator:
    """Skeletons with the figures of their nodes in place of the numbers."""
    for df in batches:
        out = []
        for tree, figures in zip(df["tree"], df["figures"]):
            by_node = {f["node"]: [int(f[c]) for c in ("low", "high", "first", "last", "chars", "links")] for f in figures}
            grow = lambda n: [n[0], by_node.get(n[1]), [grow(c) for c in n[2]]]  # noqa: E731, B023
            out.append(json.dumps(grow(json.loads(tree)), ensure_ascii=False))
        yield df[["host", "skeleton", "tree"]].assign(wrapper=out)


def _merged(batches: Iterator) -> Iterator:
    """Runs of rows with the same host and bucket as one wrapper."""
    key, tree = None, None
    for df in batches:
        done = []
        for name, bucket, wrapper in zip(df["host"], df["bucket"], df["wrapper"]):
            if key == (name, bucket):
                tree = merge(json.loads(tree) if isinstance(tree, str) else tree, json.loads(wrapper))
            else:
                if key is not None:
                    done.append((key[0], tree if isinstance(tree, str) else json.dumps(tree, ensure_ascii=False)))
                key, tree = (name, bucket), wrapper
        yield _frame(done)
    if key is not None:
        yield _frame([(key[0], tree if isinstance(tree, str) else json.dumps(tree, ensure_ascii=False))])


def _frame(rows: list[tuple[str, str]]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["host", "wrapper"], dtype="object")


def _roles(batches: Iterator) -> Iterator:
    for df in batches:
        nodes = [content(json.loads(tree), json.loads(wrapper)) for tree, wrapper in zip(df["tree"], df["wrapper"])]
        yield df[["host", "skeleton"]].assign(nodes=nodes)


def skeletons(pages: DataFrame) -> DataFrame:
    """One row per host and skeleton: tree, and wrapper (the same tree with figures over all its pages)."""
    measured = pages.mapInArrow(_measure, f"host string, skeleton string, page long, figures array<{_FIGURES}>")
    each = measured.select("host", "skeleton", "page", F.inline("figures"))
    summed = each.groupBy("host", "skeleton", "node").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.min("page").alias("first"), F.max("page").alias("last"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("tree").alias("tree"))
    figures = F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "low", "high", "first", "last", "chars", "links")))
    whole = summed.groupBy("host", "skeleton").agg(F.max("tree").alias("tree"), figures.alias("figures"))
    return whole.mapInPandas(_grown, "host string, skeleton string, tree string, wrapper string")


def wrappers(trees: DataFrame, folder: str, fan: int = FAN) -> DataFrame:
    """One wrapper per host, merged ``fan`` at a time; every round is written."""
    spark, rest, step = trees.sparkSession, trees.select("host", "wrapper"), 0
    while True:
        counts = rest.groupBy("host").agg(F.count(F.lit(1)).alias("many"))
        if (counts.agg(F.max("many")).first()[0] or 0) <= 1:
            return rest
        dealt = rest.join(counts, "host").withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("many") / fan)))
        runs = dealt.select("host", "bucket", "wrapper").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "wrapper")
        step += 1
        runs.mapInPandas(_merged, "host string, wrapper string").write.parquet(f"{folder}/round-{step}")
        rest = spark.read.schema("host string, wrapper string").parquet(f"{folder}/round-{step}")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        keys, found = [], []
        for html in batch.column("html").to_pylist():
            root, blocks = read(html)
            keys.append(_key(_skeleton(root))[0])
            found.append([{"node": node.number, "text": text} for node, text, _ in blocks])
        kept = [i for i, name in enumerate(batch.schema.names) if name != "html"]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, kind), *(batch.column(i) for i in kept)], ["skeleton", "blocks", *(batch.schema.names[i] for i in kept)])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: Sequence[str] = (), fan: int = FAN) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a line end, empty if there are none), n_chars, and carried columns as ``in_<name>``."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/wrappers-{uuid.uuid4().hex}"
    given = pages.select(host(pages[url_col]).alias("host"), pages[html_col].alias("html"), pages[id_col].alias("page_id"), pages[url_col].alias("url"), *carried(pages, carry))
    grown = skeletons(given.select("host", "html"))
    grown.write.parquet(f"{folder}/skeletons")
    trees = spark.read.schema(grown.schema).parquet(f"{folder}/skeletons")
    joined = trees.select("host", "skeleton", "tree").join(wrappers(trees, folder, fan), "host")
    joined.mapInPandas(_roles, "host string, skeleton string, nodes array<int>").write.parquet(f"{folder}/roles")
    roles = spark.read.schema("host string, skeleton string, nodes array<int>").parquet(f"{folder}/roles")
    size = roles.agg(F.sum(F.octet_length("host") + 128 + 8 * F.size("nodes"))).first()[0] or 0
    names = [f"in_{name}" for name in carry]
    read_pages = given.mapInArrow(_blocks, with_carried("skeleton string, blocks array<struct<node:int,text:string>>", given, [c for c in given.columns if c != "html"]))
    found = read_pages.join(F.broadcast(roles) if size <= BROADCAST_BYTES else roles, ["host", "skeleton"], "left")
    inside = F.filter("blocks", lambda b: F.array_contains("nodes", b.node))
    text = F.coalesce(F.array_join(F.transform(inside, lambda b: b.text), "\n"), F.lit(""))
    return found.select("page_id", "url", text.alias("text"), *names).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *names)


#: Of the given tables, whose pages have one article of headings, paragraphs and line breaks each.
ORACLE = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS x FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(x, lambda y: y <> ''), chr(10)) AS t FROM b),
d AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);?', '''', 'g'), '&amp;?', '&', 'g') AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""
