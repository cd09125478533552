"""Text normalisation, markers, escapes and parsers, as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Field classes and domains.
CODE_FIELDS = ("position", "symbol", "atomic_mass", "melting_point_c", "position_col", "number")
TYPOGRAPHY = {"italics": "italic", "small caps": "smallcaps", "small-caps": "smallcaps", "roman type": "roman", "regular": "roman", "capitals": "caps"}
MINUS = "−"
EM_DASH = "—"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def squeeze(c: Column) -> Column:
    """Runs of white space made one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize(field: Column, value: Column, compose: bool = True) -> Column:
    """A field's value as compared: null is empty; code fields lose white space and write a leading hyphen as
    U+2212; typography is lower-cased and mapped to its synonym; names have single spaces. Em dashes stay."""
    v = F.coalesce(value, F.lit(""))
    v = straight_quotes(strip(nfc(v) if compose else v))
    code = F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", ""), "^-", MINUS)
    synonyms = F.create_map(*[F.lit(x) for kv in TYPOGRAPHY.items() for x in kv])
    typo = F.coalesce(F.element_at(synonyms, F.lower(v)), F.lower(v))
    return F.when(field.isin(*CODE_FIELDS), code).when(field == "typography", typo).when(field == "name", squeeze(v)).otherwise(v)


def uncertain_alternatives(value: Column, norm=lambda c: c) -> Column:
    """Whole-value readings of the first [uncertain:a|b] marker, normalised; empty without a marker."""
    pattern = r"\[uncertain:([^\]]*)\]"
    inner = F.regexp_extract(value, pattern, 1)
    marker = F.regexp_extract(value, pattern, 0)
    at = F.locate("[uncertain:", value)
    before, after = F.substring(value, F.lit(1), at - 1), F.substring(value, at + F.length(marker), F.length(value))
    readings = F.transform(F.split(inner, r"\|"), lambda a: norm(F.concat(before, a, after)))
    return F.when(value.rlike(pattern), readings).otherwise(F.expr("cast(array() as array<string>)"))


def compare(dataset: Column, witness: Column, alternatives: Column) -> Column:
    """agree, agree-uncertain, differ; missing where the witness has no row (null)."""
    return F.when(witness.isNull(), "missing").when(dataset == witness, "agree").when(F.array_contains(alternatives, dataset), "agree-uncertain").otherwise("differ")


def slug(c: Column) -> Column:
    c = F.lower(F.regexp_replace(c, "<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("and")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escape_html(c: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quote else [])
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def printed_number(c: Column) -> Column:
    """A printed value as a double: an asterisk is dropped, an em dash or U+2212 is a minus; null if it is no number."""
    return F.translate(F.translate(c, EM_DASH + MINUS, "--"), "*", "").try_cast("double")


def folio(c: Column) -> Column:
    """[83] or 83 -> 83; anything else null."""
    digits = F.regexp_extract(c, r"^\[?([0-9]+)\]?$", 1)
    return F.when(digits != "", digits.cast("long"))


def signed(c: Column, digits: int) -> Column:
    """Text with a sign and so many decimals."""
    return F.format_string(f"%+.{digits}f", c)
