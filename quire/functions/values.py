"""Scalar functions on extracted values, as column expressions.

Missing values are the empty string, as in the stored payloads; ANSI mode stays on, so conversions are the ``try_`` forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.registry import CURRENCIES, PREFIXES, STEMS

NULL_TOKENS = ["null", "n/a", "none", "not found", "–", "-"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_DAY_MONTH = r"^(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})$"
_MONTH_DAY = r"^([A-Za-z]{3,9})[. ]+(\d{1,2}),?\s+(\d{4})$"
_NUMERIC_DATE = r"^(\d{1,2})([/-])(\d{1,2})[/-](\d{4})$"


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\n\x0b\f\r"))


def number(x: Column) -> Column:
    return x.try_cast("double")


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def _two(x: Column) -> Column:
    return F.lpad(x, 2, "0")


def iso_date(s: Column) -> Column:
    """``YYYY-MM-DD`` of a written or numeric date in US order, without checking its range; null for other texts."""
    part = lambda p, i: F.regexp_extract(s, p, i)
    written = F.when(s.rlike(_DAY_MONTH), F.concat_ws("-", part(_DAY_MONTH, 3), _month(part(_DAY_MONTH, 2)), _two(part(_DAY_MONTH, 1)))).when(s.rlike(_MONTH_DAY), F.concat_ws("-", part(_MONTH_DAY, 3), _month(part(_MONTH_DAY, 1)), _two(part(_MONTH_DAY, 2))))
    numeric = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") | s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.concat_ws("-", part(_NUMERIC_DATE, 4), _two(part(_NUMERIC_DATE, 1)), _two(part(_NUMERIC_DATE, 3))))
    return F.coalesce(F.when(F.length(written) >= 10, written), numeric)


def normalize(x: Column) -> Column:
    """A value as struct(kind, text, num): empty, negative, date, scaled (K or M), amount, or text as it stands."""
    s = strip(x)
    bare = F.regexp_replace(s, r"^([$£€₹¥]\s*)+", "")
    candidate = strip(F.replace(bare, F.lit(","), F.lit("")))
    currency = s.rlike("^[$£€₹¥]")
    scaled = F.when(candidate.rlike("^-?[0-9.]+[Kk]$"), number(F.regexp_replace(candidate, "[Kk]$", "")) * 1000.0).when(candidate.rlike("^-?[0-9.]+[Mm][Mm]?$"), number(F.regexp_replace(candidate, "[Mm]+$", "")) * 1000000.0)
    amount = candidate.rlike(r"^-?[0-9]+\.?[0-9]*$") & (currency | s.contains(",") | candidate.contains("."))
    date = iso_date(s)
    brackets = r"^\(([0-9,]+\.?[0-9]*)\)$"
    negative = F.concat(F.lit("-"), F.replace(F.regexp_extract(s, brackets, 1), F.lit(","), F.lit("")))
    row = lambda kind, text, num=None: F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None).cast("double") if num is None else num).alias("num"))
    return (
        F.when(s.isNull() | (s == "") | F.lower(s).isin(NULL_TOKENS), row("empty", F.lit("")))
        .when(s.rlike(brackets), row("negative", negative, number(negative)))
        .when(date.isNotNull(), row("date", date))
        .when(scaled.isNotNull(), row("scaled", candidate, scaled))
        .when(amount, row("amount", candidate, number(candidate)))
        .otherwise(row("text", s))
    )


def clean_numeric(value: Column, key: Column, numeric_fields: list[str]) -> Column:
    """Strip currency signs, commas and blanks, and turn brackets into a minus, where the key is or ends with a numeric field."""
    k = F.replace(F.lower(key), F.lit(" "), F.lit("_"))
    hit = F.lit(False)
    for name in numeric_fields:
        hit = hit | k.endswith(name)
    s = strip(value)
    return F.when(value.isNull(), "").when(hit, F.regexp_replace(F.regexp_replace(s, r"[£€$¥₹,\s]", ""), r"^\((.+)\)$", "-$1")).otherwise(s)


def money(x: Column) -> Column:
    """A money text as a double, or null."""
    t = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), "[,$£€]", "")
    return number(F.regexp_replace(t, r"^\((.*)\)$", "-$1"))


def squeeze(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def column_letters(c: Column) -> Column:
    """A, B ... Z, AA ... ZZ of a zero-based column."""
    letter = lambda n: F.chr(n + 65)
    return F.when(c < 26, letter(c)).otherwise(F.concat(letter((c / 26).cast("int") - 1), letter(c % 26)))


def cell_ref(r: Column, c: Column) -> Column:
    return F.concat(column_letters(c), (r + 1).cast("string"))


def column_number(letters: Column) -> Column:
    """The zero-based column of letters."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def ref_row(ref: Column) -> Column:
    return F.regexp_extract(ref, "([0-9]+)$", 1).try_cast("int") - 1


def words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def count_ratio(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b)))


def signed(x: Column) -> Column:
    t = strip(x)
    plain = strip(F.regexp_replace(t, "[,$]", ""))
    return F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), strip(F.regexp_replace(t, "[(),$]", "")))).otherwise(plain)


def looks_numeric(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("")).rlike(r"^[\$\-\(\)]?[\d,]+(?:\.\d{1,2})?[\)]?$")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def currency_code(x: Column) -> Column:
    """ISO code of the leading currency sign, the longest that fits; empty without one."""
    s = strip(x)
    out = F.lit("")
    for sign, code in sorted(CURRENCIES.items(), key=lambda pair: len(pair[0])):
        out = F.when(s.startswith(sign), code).otherwise(out)
    return out


def currency_number(x: Column) -> Column:
    s = strip(x)
    out = s
    for sign in sorted(CURRENCIES, key=len):
        out = F.when(s.startswith(sign), strip(F.replace(F.substring(s, len(sign) + 1, 1 << 30), F.lit(","), F.lit("")))).otherwise(out)
    return out


def type_key(x: Column) -> Column:
    return F.translate(strip(F.lower(x)), " -/", "___")


def title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def upper_share(x: Column) -> Column:
    """Share of capitals among ASCII letters; null without letters."""
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]+", ""))
    return F.try_divide(F.length(F.regexp_replace(x, "[^A-Z]+", "")), letters)


def stem(x: Column) -> Column:
    """The statement section that a label speaks of, or null."""
    s = F.lower(x)
    out = F.when(s.contains(STEMS[0]), STEMS[0])
    for word in STEMS[1:]:
        out = out.when(s.contains(word), word)
    return out


def safe_file_name(x: Column) -> Column:
    base = F.regexp_extract(x, "([^/]*)$", 1)
    return F.translate(base, " &?#%+=<>|\"'", "_" * 12)


def prefix_type(name: Column) -> Column:
    """Document type of a file name's prefix before the first dash, or null."""
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    return F.try_element_at(table, F.upper(F.split(name, "-")[0]))


def confidence_rank(x: Column) -> Column:
    return F.when(x == "high", 3).when(x == "medium", 2).when(x == "low", 1).otherwise(2)


def round_half_up(x: Column) -> Column:
    """As JavaScript rounds: the floor of x + 0.5."""
    return F.floor(x + 0.5)


def decimal_repair(text: Column) -> Column:
    """Join a number of four figures or more with less than two decimals and the one or two figures that follow on a line of their own."""
    return F.regexp_replace(text, r"(\d{4,}\.\d?)\n(\d{1,2})\n", "$1$2\n")


def response_json(raw: Column) -> Column:
    """The JSON text in a model's answer: without thoughts and fences, from the first to the last brace."""
    # the patterns are tried only where their signs occur: most answers are plain
    s = strip(F.when(raw.contains("<"), F.regexp_replace(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""), r"(?is)<thought>.*?</thought>", "")).otherwise(raw))
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)
    s = F.when(s.contains("```") & s.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(fenced)).otherwise(s)
    braces = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(s)


def in_text(value: Column, text: Column) -> Column:
    """Whether a value of two characters or more is in the document's text, as it stands or by its figures (four or more)."""
    figures = F.regexp_replace(value, "[^0-9.]", "")
    return (F.length(value) < 2) | F.lower(text).contains(F.lower(strip(value))) | ((F.length(figures) >= 4) & F.regexp_replace(text, "[^0-9.]", "").contains(figures))


def presence(value: Column, text: Column) -> Column:
    """high, medium or low: by letters and figures, by figures alone, or not at all in the text."""
    v, d = squeeze(value), digits(value)
    return F.when(v == "", "high").when(squeeze(text).contains(v), "high").when((d != "") & digits(text).contains(d), "medium").otherwise("low")


_MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def variant_in_text(value: Column, text: Column) -> Column:
    """Whether the text has another writing of an ISO date (in figures, or its day and month by name) or the whole part, of four figures or more, of an amount with cents."""
    date, amount = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d+)\.\d{2}$"
    y, m, d = (F.regexp_extract(value, date, i) for i in (1, 2, 3))
    name = F.get(F.array(*map(F.lit, _MONTH_NAMES)), m.try_cast("int") - 1)
    day = d.try_cast("int").cast("string")
    short = F.substring(name, 1, 3)
    numeric = [F.concat_ws("/", d, m, y), F.concat_ws("/", m, d, y), F.concat_ws("-", d, m, y)]
    forms = F.array(*numeric, F.concat_ws(" ", name, day), F.concat_ws(" ", day, name), F.concat_ws(" ", short, day), F.concat_ws(" ", day, short))
    small = F.lower(text)
    whole = F.regexp_extract(value, amount, 1)
    return F.when(value.rlike(date), name.isNotNull() & F.exists(forms, small.contains)).otherwise((F.length(whole) >= 4) & F.replace(text, F.lit(","), F.lit("")).contains(whole))


def text_check(value: Column, text: Column) -> Column:
    """struct(level, confirmed) of a value against its document's text: high (empty, or in the text), medium (in another writing), or low."""
    v = strip(F.coalesce(value, F.lit("")))
    row = lambda level, how: F.struct(F.lit(level).alias("level"), F.lit(how).alias("confirmed"))
    return F.when(v == "", row("high", "empty")).when(in_text(v, text), row("high", "text")).when(variant_in_text(v, text), row("medium", "variant")).otherwise(row("low", "none"))
