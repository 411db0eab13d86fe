"""Fill-in-middle: texts cut into prefix, middle and suffix and put in the order that such a model is trained on.

A token is a run of ink with the blanks before it; blanks at the end of a text are one too. Between two tokens stands a
boundary, a byte of ink followed by a blank, so two adjacent bytes tell it. Texts are taken as UTF-8 bytes in chunks of
``chunk`` bytes that overlap by one: each chunk counts its boundaries by itself, running sums over the counts tell which
chunk has the boundary of a cut's rank, and only those two chunks are scanned again for the place. Nothing is shuffled and no
chunk is copied but the one at hand; all of it is expressions over one row.

Null and empty texts have no tokens and stay plain. A null id is hashed as the seed alone. Texts that contain a marker
stay plain, as they could not be told apart again. Equal ids with equal texts give equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import carried

CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK, _INK = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"


def _bytes_of(data: Column, k: Column, size: int) -> Column:
    """Chunk k with the first byte of the next one, a character for each byte, so that no cut splits a character."""
    return F.decode(F.substring(data, k * size + 1, F.lit(size + 1)), "ISO-8859-1")


def boundary_counts(data: Column, size: int) -> Column:
    """For each chunk the number of boundaries whose ink it holds."""
    chunks = F.ceil(F.octet_length(data) / size).cast("int")
    return F.when(chunks > 0, F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.regexp_count(_bytes_of(data, k, size), F.lit(_INK + _BLANK)))).otherwise(F.array().cast("array<int>"))


def owners(counts: Column, *ranks: Column) -> Column:
    """For each rank the chunk that has this boundary and the rank within it, by one pass over the running sums."""

    def step(at: Column, count: Column) -> Column:
        found = [F.when((rank > at.seen) & (rank <= at.seen + count), F.struct(at.k.alias("chunk"), (rank - at.seen).cast("int").alias("rest"))).otherwise(at[f"r{i}"]).alias(f"r{i}") for i, rank in enumerate(ranks)]
        return F.struct((at.k + 1).alias("k"), (at.seen + count).alias("seen"), *found)

    none = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("rest"))
    return F.aggregate(counts, F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("seen"), *[none.alias(f"r{i}") for i in range(len(ranks))]), step)


def _place(data: Column, owner: Column, rank: Column, n: Column, size: int) -> Column:
    """Bytes before the boundary of a rank: none before the first token, all after the last one."""
    pieces = F.slice(F.split(_bytes_of(data, owner.chunk, size), f"(?<={_INK})(?={_BLANK})"), 1, owner.rest)
    inside = owner.chunk.cast("long") * size + F.aggregate(pieces, F.lit(0), lambda sum_, piece: sum_ + F.length(piece))
    return F.when(rank == 0, 0).when(rank == n, F.octet_length(data)).otherwise(inside).cast("int")


def _draws(id_: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts lie between the markers, which no text of these forms contains."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = CHUNK, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, n (tokens), form, prefix_chars, middle_chars, output, and carried columns as ``in_<name>``.

    Of 100 documents ``rate`` are cut, of those ``spm`` with the suffix first. Cuts and forms depend on the seed and the id.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    drawn = docs.select(docs[id_col].alias("doc_id"), text.alias("t"), text.cast("binary").alias("b"), F.array(*_draws(docs[id_col], seed)).alias("h"), *carried(docs, carry))
    kept = [f"in_{name}" for name in carry]
    h = [F.col("h")[i] for i in range(4)]
    counted = drawn.withColumn("counts", boundary_counts(F.col("b"), chunk))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda sum_, count: sum_ + count) + F.when(F.octet_length("b") > 0, 1).otherwise(0)
    marked = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    form = F.when((F.octet_length("b") == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    ranked = counted.withColumn("n", n).withColumn("form", form).withColumn("low", F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1))).withColumn("high", F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)))
    routed = ranked.withColumn("owner", F.when(F.col("form") != "plain", owners(F.col("counts"), F.col("low"), F.col("high"))))
    placed = routed.withColumn("from", F.when(F.col("form") != "plain", _place(F.col("b"), F.col("owner.r0"), F.col("low"), F.col("n"), chunk))).withColumn("to", F.when(F.col("form") != "plain", _place(F.col("b"), F.col("owner.r1"), F.col("high"), F.col("n"), chunk)))
    between = lambda low, high: F.substring(F.col("b"), low + 1, high - low).cast("string")
    parts = placed.withColumn("prefix", between(F.lit(0), F.col("from"))).withColumn("middle", between(F.col("from"), F.col("to"))).withColumn("suffix", between(F.col("to"), F.octet_length("b")))
    ordered = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")).otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    return parts.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), ordered.alias("output"), *kept)


_TOKEN = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, regexp_extract_all(t, '{_TOKEN}') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
