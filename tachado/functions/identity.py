"""Who a row belongs to: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tachado.functions.text import as_col, strip


def user_from_email(email) -> Column:
    """Local part, stripped and lower-cased, without its ``+tag``."""
    local = F.lower(strip(F.substring_index(as_col(email), "@", 1)))
    return F.substring_index(local, "+", 1)


def user_from_claims(email, username, subject) -> Column:
    """User name from the email, else the suffix of a federated name, else the subject."""
    def filled(c):
        return F.nullif(c, F.lit(""))
    named = F.when(filled(as_col(username)).isNotNull(), F.substring_index(as_col(username), "_", -1))
    return F.coalesce(filled(user_from_email(email)), named, as_col(subject), F.lit(""))


def session_tag(subject) -> Column:
    """First eight hex digits of the subject's SHA-256."""
    return F.left(F.sha2(as_col(subject).cast("string"), 256), F.lit(8))
