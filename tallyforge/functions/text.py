"""Column functions of the domain: names, codes, labels, money, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that names are compared without.
STOP_TOKENS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "llp", "ag", "sa", "nv", "se", "ab", "oyj", "as", "spa", "gmbh", "bv", "pte", "kk", "group", "holdings", "holding", "the")
# vendors' sector labels, normalised, and what they stand for.
VENDOR_SECTORS = {
    "technology": "INFORMATION_TECHNOLOGY", "financialservices": "FINANCIALS", "financial": "FINANCIALS", "healthcare": "HEALTH_CARE",
    "consumercyclical": "CONSUMER_DISCRETIONARY", "consumerdefensive": "CONSUMER_STAPLES", "energy": "ENERGY", "basicmaterials": "MATERIALS",
    "industrials": "INDUSTRIALS", "communicationservices": "COMMUNICATION_SERVICES", "utilities": "UTILITIES", "realestate": "REAL_ESTATE",
}


def norm_name(name: Column) -> Column:
    """Lower case, letters and digits only, legal suffixes dropped."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_TOKENS)), " ")


def norm_cik(cik: Column) -> Column:
    """Digits only, padded with zeros to ten and never cut; null if there is no digit."""
    digits = F.regexp_replace(cik, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, digits).when(digits != "", F.lpad(digits, 10, "0"))


def missing_cik(cik: Column) -> Column:
    """Whether a stored CIK says nothing: null, without digits, or zero."""
    return F.coalesce(F.regexp_replace(cik, "[^1-9]", "") == "", F.lit(True))


def trim_cik(cik: Column) -> Column:
    """Without leading zeros; all else stays."""
    return F.ltrim(cik, F.lit("0"))


def norm_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{Nd}]", ""))


def norm_ticker(ticker: Column) -> Column:
    """The first token, with dots as hyphens, in upper case."""
    return F.upper(F.translate(F.regexp_extract(F.trim(ticker), r"^([^ \t\n\[]*)", 1), ".", "-"))


def humanise(name: Column) -> Column:
    return F.initcap(F.translate(F.lower(name), "_", " "))


def money(value: Column) -> Column:
    """$x.xxB, M or k, by size; rounded as decimals, so that halves go up."""
    cents, size = value.cast("decimal(18,2)"), F.abs(value)
    scaled = lambda by, unit: F.concat(F.lit("$"), F.format_string("%.2f", F.round(cents * F.lit(by).cast("decimal(10,9)"), 2).cast("double")), F.lit(unit))
    return F.when(size >= 1e9, scaled("0.000000001", "B")).when(size >= 1e6, scaled("0.000001", "M")).when(size >= 1e3, scaled("0.001", "k")).otherwise(scaled("1", ""))


def billions(value: Column) -> Column:
    """$x.xB, whatever the size; null stays null. Rounded as decimals, halves away from zero."""
    scaled = F.round(value.cast("decimal(20,2)") / F.lit(1_000_000_000).cast("decimal(10,0)"), 1).cast("double")
    return F.when(value.isNotNull(), F.concat(F.lit("$"), F.format_string("%.1f", scaled), F.lit("B")))


def label(name: Column, strip: str = "") -> Column:
    """A name for display: underscores as spaces, an ending stripped, a dash for null."""
    bare = F.regexp_replace(name, f"{strip}$", "") if strip else name
    return F.coalesce(F.translate(bare, "_", " "), F.lit("—"))


def dotted(*parts: Column) -> Column:
    """The parts that aren't blank, with middle dots between; null if none is left."""
    return F.nullif(F.concat_ws(" · ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))


def period_label(fiscal_year: Column, end: Column) -> Column:
    """The fiscal year, else the first four characters of a date, else n/a."""
    return F.coalesce(fiscal_year.cast("string"), F.substring(end.cast("string"), 1, 4), F.lit("n/a"))


def value_added_kind(code: Column) -> Column:
    """What a row of value added is, by the start of its code."""
    start = F.substring(F.upper(F.trim(code)), 1, 4)
    return F.when(start == "V001", "labor").when(start == "V002", "taxes").when(start == "V003", "capital")


def sector_name(raw: Column, known: tuple[str, ...]) -> Column:
    """A sector written in any case, with spaces for underscores; null if it's none of the known."""
    name = F.translate(F.upper(F.trim(raw)), " ", "_")
    return F.when(name.isin(*known), name)


def pretty_segment(member: Column) -> Column:
    """A trailing "Segment" goes, camel case becomes words; what would be empty stays as it was."""
    bare = F.regexp_replace(F.regexp_replace(member, "Segment$", ""), r"(?<=[a-z])(?=[A-Z])", " ")
    return F.when(bare == "", member).otherwise(bare)


def json_salvage(answer: Column) -> Column:
    """The first { to the last } as a variant; if it doesn't parse, once more with ]} after it; else null."""
    cut = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(cut), F.try_parse_json(F.concat(cut, F.lit("]}"))))


def json_num(text: Column) -> Column:
    """A number written with $ , % or spaces, in parentheses or with the sign behind it if negative; anything else is null."""
    bare = F.trim(F.regexp_replace(text, r"[$,%]", ""))
    inner = F.when(F.regexp_like(bare, F.lit(r"^\([^()+-]*\)$")), F.concat(F.lit("-"), F.trim(F.substr(bare, F.lit(2), F.length(bare) - 2))))
    behind = F.when(F.regexp_like(bare, F.lit(r"^[^()+-]*-$")), F.concat(F.lit("-"), F.trim(F.substr(bare, F.lit(1), F.length(bare) - 1))))
    number = F.coalesce(inner, behind, bare)
    plain = F.regexp_like(number, F.lit(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"))
    return F.when(plain, number.try_cast("double"))


def json_str(answer: Column, path: str) -> Column:
    """A string of a variant; null for anything else, a blank, or the word null."""
    kind, text = F.schema_of_variant(F.try_variant_get(answer, path, "variant")), F.try_variant_get(answer, path, "string")
    return F.when((kind == "STRING") & (F.trim(text) != "") & (F.lower(text) != "null"), text)


def json_text(answer: Column, path: str) -> Column:
    """The looser form: numbers count as text, and the word null is a word."""
    kind, text = F.schema_of_variant(F.try_variant_get(answer, path, "variant")), F.try_variant_get(answer, path, "string")
    return F.when(kind.isin("STRING", "BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.when(F.trim(text) != "", text))


def cite_resolve(url: Column, index: Column, note: Column, citations: Column) -> Column:
    """An address as given, else the citation that a 1-based number, [n] or the first [n] of a note names."""
    n = F.coalesce(F.regexp_extract(index, r"^\s*\[?([0-9]+)\]?\s*$", 1).try_cast("int"), F.regexp_extract(note, r"\[([0-9]+)\]", 1).try_cast("int"))
    return F.when(F.startswith(F.lower(url), F.lit("http")), url).otherwise(F.when(n >= 1, F.get(citations, n - 1)))


def wiki_path(raw: Column) -> Column:
    """The path of an article: /wiki/.. as given, or that of an address on wikipedia.org; null for anything else."""
    s = F.trim(raw)
    host, path = F.lower(F.try_parse_url(s, F.lit("HOST"))), F.try_parse_url(s, F.lit("PATH"))
    whole = F.try_parse_url(s, F.lit("PROTOCOL")).isNotNull()
    there = whole & F.endswith(host, F.lit("wikipedia.org")) & F.startswith(path, F.lit("/wiki/"))
    return F.when(F.startswith(s, F.lit("/wiki/")), s).when(there, path)


def fund_ticker(raw: Column) -> Column:
    """A symbol of one to six letters, in capitals; null for anything else."""
    symbol = F.upper(F.trim(raw))
    return F.when(F.regexp_like(symbol, F.lit(r"^\p{L}{1,6}$")), symbol)


def triage_ids(answer: Column, count: Column) -> Column:
    """The ids an answer names, numbers or strings, in range and each once, in order; all ids if it names none."""
    listed = F.try_variant_get(json_salvage(answer), "$.ids", "array<variant>")
    whole = F.transform(listed, lambda x: F.when(F.schema_of_variant(x).isin("BIGINT", "STRING"), F.trim(F.try_variant_get(x, "$", "string")).try_cast("int")))
    known = F.sort_array(F.array_distinct(F.filter(whole, lambda x: (x >= 0) & (x < count))))
    return F.when(F.size(known) > 0, known).otherwise(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))


def amount_line(label: str, value: Column) -> Column:
    """A label and an amount in billions with one digit and separators; null without one."""
    return F.concat(F.lit(f"{label} $"), F.format_number(value / 1_000_000_000, 1), F.lit("B"))


def cited(answer: Column, citations: Column) -> Column:
    """The address that an answer's source_url gives or names by number, else the one that the first [n] of its note names.

    A number may be a JSON number, a string with or without brackets, or the first number of an
    array; numbers count from one, and one out of range names nothing.
    """
    kind = F.schema_of_variant(F.try_variant_get(answer, "$.source_url", "variant"))
    text = F.try_variant_get(answer, "$.source_url", "string")
    listed = F.filter(F.try_variant_get(answer, "$.source_url", "array<variant>"), lambda x: F.schema_of_variant(x) == "BIGINT")
    cite = lambda n: F.when(n >= 1, F.get(citations, n - 1))
    string = F.when(F.startswith(F.lower(text), F.lit("http")), text).otherwise(cite(F.btrim(text, F.lit("[] ")).try_cast("int")))
    field = F.when(kind == "STRING", string).when(kind == "BIGINT", cite(text.try_cast("int"))).when(F.startswith(kind, F.lit("ARRAY")), cite(F.try_variant_get(F.get(listed, F.lit(0)), "$", "int")))
    note = F.regexp_extract(F.coalesce(json_str(answer, "$.note"), F.lit("")), r"\[([0-9]+)\]", 1).try_cast("int")
    return F.coalesce(field, cite(note))
