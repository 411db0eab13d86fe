"""Licence scans by canonical digest lookup.

A text's canonical form is lower case, without copyright lines, with one spelling for equivalent words and with one
blank for everything between letters and figures. The SHA-256 of the whole canonical text is hash-joined to the
digests of known licences; the canonical lines are looked up in the same digests, which finds notices inside other
texts. All of it is built-in SQL functions; the known texts are a table of fixed size, made in the plan itself, to
which the caller can add a table of licence texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.license_digests import DIGESTS

# Spellings of whole words that licence matching takes as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "copyright holder": "copyright owner",
    "copyright holders": "copyright owners", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses",
    "licenced": "licensed", "maximise": "maximize", "merchantibility": "merchantability", "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organisations": "organizations", "organise": "organize", "per cent": "percent",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub licence": "sublicense",
    "sub license": "sublicense", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Texts and notices of common licences.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]

# What follows "copyright" where a sentence speaks of it, as against a line that names an owner.
NOT_OWNER = "holders? owners? notices? laws? licen[cs]es? statements? interests? permissions? disclaimers? treaty treaties infringements? protection and or in on is to of for as under"
SPOKEN = r"copyright(ed\b|able\b|s\b|\s+(?:" + "|".join(NOT_OWNER.split()) + r")\b)"
#: Stands for "copyright" there while copyright lines are removed; control characters are no part of a canonical form.
_KEPT = "\x01"
#: Lines that name an owner and a year, not the licence. Applied to lower case, with ^ and $ at line ends.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The form with its line ends kept, spellings of single words made one; lines of nothing but signs become empty."""
    x = F.regexp_replace(F.replace(F.lower(text), F.lit(_KEPT), F.lit(" ")), SPOKEN, _KEPT + "$1")
    x = F.replace(F.regexp_replace(x, COPYRIGHT_LINE, ""), F.lit(_KEPT), F.lit("copyright"))
    x = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", "  "), r"\n", "  \n  ")
    return _spelled(x, [w for w in SPELLINGS if " " not in w])


def _spelled(x: Column, words: list[str]) -> Column:
    """Spellings replaced in text whose words have two blanks between them, so that each has one of its own on either side: only whole words are replaced."""
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for word in words:
        x = F.replace(x, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {SPELLINGS[word].replace(' ', '  ')} "))
    return F.regexp_replace(x, r" +", " ")


def phrases(x: Column) -> Column:
    """Spellings of several words made one, in lines or in a whole text without line ends."""
    return F.trim(_spelled(F.replace(x, F.lit(" "), F.lit("  ")), [w for w in SPELLINGS if " " in w]))


def flat(lines: Column) -> Column:
    """The canonical form of a whole text; a phrase may run over a line end of ``canonical_lines``."""
    return phrases(F.regexp_replace(lines, r"[ \n]+", " "))


def known(spark: SparkSession, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """license_id and digest of the known texts; of equal canonical texts the first id by name."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in texts])
    return spark.range(1).select(F.inline(rows)).select("license_id", F.sha2(flat(canonical_lines(F.col("text"))), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def digest_table(licenses: DataFrame, name_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """license_id and digest of a table of licence texts, for ``scan``; rows with a null, or without a letter or figure, are left out."""
    lines = canonical_lines(F.col(text_col))
    return licenses.select(F.col(name_col).cast("string").alias("license_id"), flat(lines).alias("c")).filter("license_id is not null and c != ''").select("license_id", F.sha2("c", 256).alias("digest"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, id_col: str = "doc_id", text_col: str = "text", licenses: DataFrame | None = None) -> DataFrame:
    """One row for each row: doc_id, canonical_sha256, license_id, notices, licensed.

    ``license_id`` is set where the whole text is a known one; ``notices`` has the ids of known lines, in order,
    comma-joined, empty where there are none. Null is as empty: the digest of nothing, which is no licence. Rows with
    equal ids stay apart. Other columns are not read; texts of any length are one value. ``licenses`` has more known
    texts (license_id, digest; see ``digest_table``): of equal digests the first id by name counts.
    """
    whole = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(digest).alias("digest")) for name, digest in DIGESTS])
    table = known(docs.sparkSession, texts).unionByName(docs.sparkSession.range(1).select(F.inline(whole)))
    if licenses is not None:
        table = table.unionByName(licenses.select("license_id", "digest"))
    table = table.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    # the digests of the given texts are constants, which Catalyst folds; of equal ones the first id by name counts
    of = lambda t: F.sha2(flat(canonical_lines(F.lit(t))), 256)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), of(t).alias("digest")) for n, t in sorted(texts)])
    digests = F.array(*[of(t) for _, t in sorted(texts)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    lines = F.transform(F.split(phrases(F.col("lines")), "\n"), lambda line: F.sha2(F.trim(line), 256))
    found = F.transform(F.array_intersect(lines, digests), lambda d: F.filter(pairs, lambda p: p["digest"] == d)[0]["name"])
    rows = rows.select("doc_id", F.sha2(flat(F.col("lines")), 256).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    # the built-in table has some fifty rows; a caller's table is joined as Spark sees fit
    joined = rows.join(table if licenses is not None else F.broadcast(table), F.col("canonical_sha256") == F.col("digest"), "left")
    return joined.select("doc_id", "canonical_sha256", "license_id", "notices", (F.col("license_id").isNotNull() | (F.col("notices") != "")).alias("licensed"))


def oracle(texts: list[tuple[str, str]] = TEXTS) -> str:
    """The same in SQL for DuckDB, over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(x: str, words: list[str]) -> str:
        x = f"' ' || {x} || ' '"
        for word in words:
            x = f"replace({x}, {quote(' ' + word.replace(' ', '  ') + ' ')}, {quote(' ' + SPELLINGS[word].replace(' ', '  ') + ' ')})"
        return f"regexp_replace({x}, ' +', ' ', 'g')"

    def phrases(x: str) -> str:
        doubled = f"replace({x}, ' ', '  ')"
        return f"trim({spelled(doubled, [w for w in SPELLINGS if ' ' in w])})"

    def whole(x: str) -> str:
        one_line = f"regexp_replace({x}, '[ \\n]+', ' ', 'g')"
        return phrases(one_line)

    def lines(text: str) -> str:
        x = f"regexp_replace(replace(lower({text}), chr(1), ' '), {quote(SPOKEN)}, chr(1) || '\\1', 'g')"
        x = f"regexp_replace(replace(regexp_replace({x}, {quote(COPYRIGHT_LINE)}, '', 'g'), chr(1), 'copyright'), {quote(r'[^\p{L}\p{N}\n]+')}, '  ', 'g')"
        return spelled(f"replace({x}, chr(10), '  ' || chr(10) || '  ')", [w for w in SPELLINGS if " " not in w])

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in texts)
    return f"""
WITH known AS (
  SELECT min(license_id) AS license_id, digest FROM (SELECT n AS license_id, sha256({whole(lines('t'))}) AS digest FROM (VALUES {values}) v(n, t)) GROUP BY digest
), docs AS (SELECT r, doc_id, {whole("x")} AS whole, {phrases("x")} AS lines FROM (SELECT row_number() OVER () AS r, doc_id, {lines("coalesce(text, '')")} AS x FROM documents)
), noted AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM docs) JOIN known ON sha256(trim(line)) = digest GROUP BY r
)
SELECT doc_id, sha256(whole) AS canonical_sha256, license_id, coalesce(notices, '') AS notices, license_id IS NOT NULL OR notices IS NOT NULL AS licensed
FROM docs LEFT JOIN known ON sha256(whole) = digest LEFT JOIN noted USING (r)"""
