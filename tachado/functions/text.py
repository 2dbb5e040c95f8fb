"""Scalar text helpers: Column -> Column."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tachado import constants as K

_BLANKS = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strip(x) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` only knows blanks)."""
    return F.regexp_replace(as_col(x), rf"\A{_BLANKS}|{_BLANKS}\z", "")


def is_blank(x) -> Column:
    return ~F.coalesce(as_col(x), F.lit("")).rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]")


def fold(x) -> Column:
    """Strip and case-fold, for comparisons that ignore case (``ß`` reads ``ss``).

    The trim has nothing left to trim: it keeps the optimizer from reducing
    lower(upper(x)) to lower(x), which does not fold.
    """
    return F.lower(F.trim(F.upper(strip(x))))


def quote(x) -> Column:
    """A pattern that matches the text literally."""
    return F.concat(F.lit("\\Q"), F.replace(as_col(x), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


_DROPPED = set(K.SEPARATORS)


class _Characters(dict):
    """What normalising makes of each character (by code point) seen so far: it never depends on the ones around."""

    def __missing__(self, point: int) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        # A character beyond ASCII may come apart into separators.
        value = self[point] = "".join(c.lower() for c in kept if c not in _DROPPED)
        return value

    def __reduce__(self):
        # Travels to workers empty.
        return _Characters, ()


_CHARACTERS = _Characters()


def normalized(text: str | None) -> str | None:
    """``normalize_text`` of one text."""
    return None if text is None else text.translate(_CHARACTERS)


@pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalized)


#: Stands for characters that come apart into several; no text has it by right.
_SEVERAL = "\uffff"


@cache
def _normal_characters() -> tuple[str, str]:
    """Characters of the basic plane that normalising changes, and what of; those that vanish come last."""
    one, several, gone = {}, [], []
    for c in map(chr, chain(range(0xD800), range(0xE000, 0xFFFF))):
        to = normalized(c)
        if not to:
            gone.append(c)
        elif len(to) > 1:
            several.append(c)
        elif to != c:
            one[c] = to
    return "".join([*one, *several, *gone]), "".join(one.values()) + _SEVERAL * len(several)


def normalize_text(text) -> Column:
    """Compatibility-decompose, drop accents and separators, lower-case.

    Characters that stay one or vanish are exchanged by a table made from the rule; only texts with others (ligatures,
    fractions, Hangul, beyond the basic plane) go through Python, which sees null for the rest.
    """
    x = as_col(text)
    plain = F.translate(x, *_normal_characters())
    other = F.contains(plain, F.lit(_SEVERAL)) | x.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(other, _normalized(F.when(other, x))).otherwise(plain)


def safe_name(x, limit: int = 64) -> Column:
    return F.left(F.regexp_replace(as_col(x), "[^A-Za-z0-9_-]", "-"), F.lit(limit))


def cut(x, limit: int) -> Column:
    return F.left(as_col(x), F.lit(limit))


def key_parent(x) -> Column:
    """``a/b/c`` -> ``a/b/``; a key without a slash is its own parent."""
    return F.when(as_col(x).contains("/"), F.regexp_replace(as_col(x), r"[^/]*\z", "")).otherwise(as_col(x))


def key_name(x) -> Column:
    """``a/b/c`` -> ``c``; a key that ends in a slash is returned as it is."""
    last = F.substring_index(as_col(x), "/", -1)
    return F.when(last == "", as_col(x)).otherwise(last)


def account_suffix(bucket) -> Column:
    """The digits after the last ``-`` of a bucket name, else empty."""
    return F.regexp_extract(as_col(bucket), r"-([0-9]+)\z", 1)


def model_label(model_id) -> Column:
    """``us.anthropic.claude-haiku-4-5-20251001-v1:0`` -> ``Claude Haiku 4.5``.

    Eight-digit dates go, digits that follow digits join with a dot, words are
    capitalised; an id of another family is its own label.
    """
    x = as_col(model_id)
    after = F.regexp_replace(x, r"(?s)\A.*?anthropic\.claude-", "")
    name = F.substring_index(after, "-v1", 1)
    tokens = F.filter(F.split(name, "-"), lambda t: ~t.rlike(r"\A[0-9]{8}\z"))
    digits = r"\A[0-9]+\z"
    words = F.aggregate(
        tokens, F.lit(""),
        lambda acc, t: F.when(t.rlike(digits) & acc.rlike(r"(\A| )[0-9.]*[0-9]\z"), F.concat(acc, F.lit("."), t))
        .otherwise(F.concat(acc, F.when(acc == "", "").otherwise(F.lit(" ")),
                            F.when(t.rlike(digits), t).otherwise(
                                F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))))))
    return F.when(name == x, x).otherwise(F.trim(F.concat(F.lit("Claude "), words)))
