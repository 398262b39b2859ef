"""Names, addresses and search text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import col


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    def key(text):
        if not text:
            return ""
        parts = unicodedata.normalize("NFKD", text)
        return "".join(ch for ch in parts if not unicodedata.combining(ch)).casefold()

    return values.map(key)


def fold(text) -> Column:
    """Case- and accent-free key. Plain ASCII needs no Python worker's help,
    but a CASE cannot skip a vectorised UDF, so both forms are offered."""
    return _fold(col(text))


def fold_ascii(text) -> Column:
    """The same key for text known to be ASCII, inside codegen."""
    return F.lower(F.coalesce(col(text), F.lit("")))


def unpadded_street(street) -> Column:
    return F.regexp_replace(col(street), r"\b0+(?=\d)", "")


def _capital_parts(word: Column) -> Column:
    """Upper-case each letter run's first letter, lower-case the rest."""
    parts = F.regexp_extract_all(word, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def display_address(number, street) -> Column:
    named = F.transform(words(col(street)), lambda w: F.when(w.rlike(r"^\d"), F.lower(w)).otherwise(_capital_parts(w)))
    head = F.when(F.coalesce(col(number), F.lit("")) != "", F.array(col(number))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, named), " ")


def blockface_street(street) -> Column:
    """'04TH AVE' as '4th Ave'."""
    def shape(w):
        bare = F.regexp_replace(w, "^0+", "")
        return F.when(w.rlike(r"^\d"), F.lower(F.when(bare == "", w).otherwise(bare))).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))

    return F.array_join(F.transform(words(col(street)), shape), " ")


def category_text(cat) -> Column:
    c = col(cat)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Place")).otherwise(_capital_parts(F.replace(c, F.lit("_"), F.lit(" "))))


_NUMBER = r"\b(\d{1,6})[A-Za-z]?\b"


def house_number(query) -> Column:
    return F.nullif(F.regexp_extract(F.trim(col(query)), _NUMBER, 1), F.lit(""))


def street_words(query) -> Column:
    """A query without its house number, spaces collapsed."""
    q = F.trim(col(query))
    first = F.regexp_extract(q, r"(?s)^(.*?)" + _NUMBER + r"(.*)$", 1)
    rest = F.regexp_extract(q, r"(?s)^(.*?)" + _NUMBER + r"(.*)$", 3)
    bare = F.when(house_number(query).isNull(), q).otherwise(F.concat(first, rest))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def address_label(number, street, unit) -> Column:
    base = F.when(F.coalesce(col(number), F.lit("")) != "", F.concat(col(number), F.lit(" "), col(street))).otherwise(col(street))
    return F.when(F.coalesce(col(unit), F.lit("")) != "", F.concat(base, F.lit(" ("), col(unit), F.lit(")"))).otherwise(base)


def sentence(text) -> Column:
    t = col(text)
    return F.when(t.rlike(r"[.!?…]$"), t).otherwise(F.concat(t, F.lit(".")))


def title(text) -> Column:
    return _capital_parts(col(text))


@F.pandas_udf(T.StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    from html import unescape as decoded

    return values.map(lambda v: None if v is None else decoded(v))


def unescape(html) -> Column:
    """All named and numeric character references, as HTML 5 reads them."""
    return _unescaped(col(html))
