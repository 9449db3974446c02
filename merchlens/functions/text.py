"""Column builders for text, price, rating, brand and specification cleaning."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Placeholder sets, limits and patterns that decide results.
CLEANING_NULLS = ("none", "nan", "null", "")
TEXT_PLACEHOLDERS = ("na", "n/a", "none", "null", "nan", "nil", "undefined", "")
PROFILE_MISSING = ("no rating available", "none", "null", "n/a", "na", "-", "--", "nan")
SPEC_VALUE_NULLS = ("none", "nan", "null", "nil")
MAX_DESCRIPTION_CHARS = 1200
SPEC_PAIR = (
    r'\{"key"=>"((?:\\.|[^"\\])*)",\s*"value"=>'
    r'((?:"(?:\\.|[^"\\])*"|nil|\d+(?:\.\d+)?|true|false))\}'
)
SPEC_KEY_PROBE = r"""["']key["']\s*=>\s*["']([^"']+)["']"""
FORBIDDEN_EMISSION = (
    r"(?i)\b((Product|Category|Brand|Specifications|Description):\s*(none|nan|null|na|n/a))\b"
)
BOILERPLATE = (
    r"Flipkart\.com: Buy .+?(?:from Flipkart\.com|\bRs\.?\s*\d+[^.]*?\.)",
    r"Only Genuine Products\.",
    r"\d+\s*Day Replacement Guarantee\.",
    r"Free Shipping\.",
    r"Cash On Delivery[!.]?",
    r"Shop for .+?online at [^.]+?\.",
)
MOJIBAKE_MARKERS = ("Ã", "Ä", "á»", "áº", "Â")
TOKEN = r"[\p{L}\p{N}_]+"
# ---------------------------------------------------------------------------

SPECS_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
    )
)
# A superset of the characters whose presence can change a text under NFC.
MAY_DECOMPOSE = (
    r"[\p{M}\x{0340}-\x{0387}\x{0958}-\x{0FFF}\x{1100}-\x{11FF}\x{1F00}-\x{2BFF}\x{F900}-\x{FB4F}\x{10000}-\x{10FFFF}]"
)
_WS = r"(?U)\s+"
_TAG = re.compile(r"<[^>]+>")


@F.pandas_udf(T.StringType())
def _unescape_strip_nfkc(values: pd.Series) -> pd.Series:
    def fix(value):
        if value is None:
            return None
        return unicodedata.normalize("NFKC", _TAG.sub(" ", html.unescape(value)))

    return values.map(fix)


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Catalyst copies an expression into every place that uses it; a regex that a
    rule reads ten times would run ten times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _WS, " "))


def null_if_in(c: Column, words: tuple[str, ...]) -> Column:
    return F.when(~F.lower(c).isin(*words), c)


def clean_text(c: Column) -> Column:
    """P01. Only rows holding an entity or a non-ASCII character visit Python."""
    special = c.rlike(r"[&[^\x00-\x7F]]")
    body = F.coalesce(
        _unescape_strip_nfkc(F.when(special, c)), F.regexp_replace(c, r"<[^>]+>", " ")
    )
    body = F.regexp_replace(body, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x9F]", "")
    return null_if_in(collapse_space(body), CLEANING_NULLS)


def clean_price(c: Column) -> Column:
    """P02. Numeric, finite and positive, two decimals; otherwise NULL."""
    v = c.try_cast("double")
    finite = ~F.isnan(v) & (v < F.lit(float("inf")))
    return F.when(finite & (v > 0), F.round(v, 2))


def normalize_rating(*candidates: Column) -> Column:
    """P03. First candidate that is a number in [1, 5]."""
    out = []
    for c in candidates:
        v = F.trim(c.cast("string")).try_cast("double")
        out.append(F.when((v >= 1) & (v <= 5), F.round(v, 2)))
    return F.coalesce(*out)


def brand_text(c: Column) -> Column:
    """Whitespace-collapsed brand, placeholders to NULL (before casing lookup)."""
    return null_if_in(collapse_space(c), CLEANING_NULLS)


def parse_specifications(c: Column) -> Column:
    """P05. Ruby-hash text to an array of {key, value}."""

    def unquote(s: Column) -> Column:
        return F.trim(F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'")))

    keys = F.regexp_extract_all(c, F.lit(SPEC_PAIR), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(SPEC_PAIR), F.lit(2))

    def pair(k: Column, v: Column) -> Column:
        quoted = v.startswith('"')
        inner = unquote(F.substring(v, F.lit(2), F.length(v) - 2))
        value = F.when(quoted, F.nullif(inner, F.lit(""))).when(v != "nil", F.trim(v))
        return F.struct(unquote(k).alias("key"), value.alias("value"))

    return F.coalesce(
        F.zip_with(keys, values, pair), F.array().cast(SPECS_TYPE)
    )


def specs_map(specs: Column) -> Column:
    """P06. Lower-cased key to value; the last value of a repeated key wins."""
    low = F.transform(
        specs,
        lambda s: F.struct(
            F.lower(F.trim(s["key"])).alias("key"), F.lower(F.trim(s["value"])).alias("value")
        ),
    )
    kept = F.filter(
        low,
        lambda s: s["key"].isNotNull()
        & (s["key"] != "")
        & s["value"].isNotNull()
        & (s["value"] != "")
        & ~s["value"].isin(*SPEC_VALUE_NULLS),
    )

    def last_wins(rows: Column) -> Column:
        unique = F.size(F.array_distinct(F.transform(rows, lambda s: s["key"]))) == F.size(rows)
        later = F.filter(
            rows,
            lambda s, i: ~F.exists(
                F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda t: t["key"] == s["key"]
            ),
        )
        return F.map_from_entries(F.when(unique, rows).otherwise(later))

    return let(kept, last_wins)


def category_levels(c: Column) -> Column:
    """P07. Breadcrumb text to its list of levels, top level first."""
    text = F.trim(c)
    inner = F.coalesce(
        F.nullif(F.from_json(text, T.ArrayType(T.StringType()))[0], F.lit("")),
        F.nullif(F.regexp_extract(text, r"^\[\s*'((?:\\.|[^'\\])*)'\s*[,\]]", 1), F.lit("")),
        F.regexp_replace(
            F.trim(F.regexp_replace(text, r"(?s)^\[(.*)\]$", "$1")),
            r"""(?s)^(?:"(.*)"|'(.*)')$""",
            "$1$2",
        ),
    )
    blank = F.coalesce(text, F.lit("")).isin("", "[]", '[""]', "['']")
    levels = F.filter(
        F.transform(F.split(inner, ">>"), lambda p: F.trim(p)), lambda p: p != ""
    )
    return F.when(blank, F.array().cast("array<string>")).otherwise(levels)


def category_level(c: Column, level: int = 1) -> Column:
    return F.try_element_at(category_levels(c), F.lit(level))


def is_placeholder(c: Column) -> Column:
    """P11. NULL and the eight placeholder spellings."""
    edges = F.lit(" \t\n\r\f\x0b\u00a0\u2003\u3000")
    return F.lower(F.coalesce(F.trim(c, edges), F.lit(""))).isin(*TEXT_PLACEHOLDERS)


def format_specifications(specs: Column) -> Column:
    """P08. ``k: v; k: v`` without placeholder keys or values; NULL when empty."""
    pairs = F.transform(
        specs,
        lambda s: F.struct(
            collapse_space(s["key"]).alias("key"), collapse_space(s["value"]).alias("value")
        ),
    )
    kept = F.filter(pairs, lambda s: ~is_placeholder(s["key"]) & ~is_placeholder(s["value"]))
    joined = F.array_join(F.transform(kept, lambda s: F.concat(s["key"], F.lit(": "), s["value"])), "; ")
    return let(joined, lambda j: F.when(j != "", j))


def truncate_description(c: Column, max_chars: int = MAX_DESCRIPTION_CHARS) -> Column:
    """P09. At most ``max_chars``, cut at a word boundary where one exists."""

    def cut(text: Column) -> Column:
        head = F.substring(text, 1, max_chars)
        clean_cut = F.substring(text, max_chars + 1, 1) == " "
        at_word = F.regexp_replace(head, r"^(.+) \S*$", "$1")
        return F.when(F.length(text) <= max_chars, text).when(clean_cut, head).otherwise(at_word)

    return F.when(~is_placeholder(c), F.rtrim(let(collapse_space(c), cut)))


def search_text(
    name: Column,
    category: Column,
    brand: Column,
    specs: Column,
    description: Column,
    max_chars: int = MAX_DESCRIPTION_CHARS,
) -> Column:
    """P10. Labelled parts joined by `` | ``; NULL when name or category is missing."""

    def part(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), c)

    def present(c: Column) -> Column:
        return F.when(~is_placeholder(c), collapse_space(c))

    text = F.concat_ws(
        " | ",
        part("Product", present(name)),
        part("Category", present(category)),
        part("Brand", present(brand)),
        part("Specifications", format_specifications(specs)),
        part("Description", truncate_description(description, max_chars)),
    )
    return F.when(~is_placeholder(name) & ~is_placeholder(category), text)


def search_text_problem(c: Column) -> Column:
    """P12. Reason the search text is not acceptable, NULL when it is."""
    s = F.trim(c)
    found = F.regexp_extract(s, FORBIDDEN_EMISSION, 1)
    return (
        F.when(c.isNull(), F.lit("missing"))
        .when(s == "", F.lit("blank"))
        .when(~s.startswith("Product: "), F.lit("no product prefix"))
        .when(~s.contains(" | Category: "), F.lit("no category part"))
        .when(found != "", F.concat(F.lit("placeholder: "), found))
    )


def sanitize_url(c: Column) -> Column:
    """P13. Trimmed URL when it is http(s) with a host."""
    s = F.trim(c)
    return F.when(s.rlike(r"^(?i:https?)://[^/?#\s]+"), s)


def first_url(c: Column) -> Column:
    """P13. First acceptable URL of a JSON list, else the text itself."""
    listed = F.from_json(F.trim(c), T.ArrayType(T.StringType()))
    ok = F.filter(F.transform(listed, sanitize_url), lambda u: u.isNotNull())
    return F.coalesce(F.try_element_at(ok, F.lit(1)), sanitize_url(c))


def strip_boilerplate(c: Column) -> Column:
    """P14. Remove promotional sentences, collapse whitespace."""
    for pattern in BOILERPLATE:
        c = F.regexp_replace(c, f"(?i){pattern}", "")
    return collapse_space(c)


def fingerprint(**fields: Column) -> Column:
    """P15. SHA-256 of the JSON of the fields in name order, NULL fields written."""
    cols = [fields[k].alias(k) for k in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def nfc(c: Column) -> Column:
    """Unicode NFC.  Only texts that may not be composed yet visit Python."""
    return F.coalesce(_nfc(F.when(c.rlike(MAY_DECOMPOSE), c)), c)


def match_key(c: Column) -> Column:
    """P16. Mojibake repair, NFC and lower case, used for matching only."""
    suspicious = F.lit(False)
    for marker in MOJIBAKE_MARKERS:
        suspicious = suspicious | c.contains(marker)
    latin1 = ~c.rlike(r"[^\x00-\xFF]")
    raw = F.encode(F.when(suspicious & latin1, c), "ISO-8859-1").cast("string")
    text = F.coalesce(F.when(F.is_valid_utf8(raw), raw), c)
    return F.lower(nfc(text))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def casing_is_mixed(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}")
