"""String expressions: names of columns and tolerant casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of the words of a column name: signs, and a capital after a small letter.
NAME_SPLIT = r"[_\-\s]+|(?<=[a-z])(?=[A-Z])"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def name_tokens(name: Column) -> Column:
    """The lower-case words of a column name."""
    return F.filter(F.transform(F.split(name, NAME_SPLIT), F.lower), lambda t: t != "")


def trimmed(value: Column) -> Column:
    """Without blanks around; the text nan is null."""
    out = F.trim(value.cast("string"))
    return F.when(F.lower(out) == "nan", None).otherwise(out)


def to_number(value: Column) -> Column:
    """A double, or null for what is none."""
    out = F.trim(value.cast("string")).try_cast("double")
    return F.when(F.isnan(out), None).otherwise(out)


def to_time(value: Column, formats: Sequence[str]) -> Column:
    """The first of the formats that fits, or null."""
    text = F.trim(value.cast("string"))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def to_boolean(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true", "yes"), True).when(text.isin("0", "false", "no"), False)


def token_count(value: Column) -> Column:
    """Words between white space."""
    text = F.trim(F.regexp_replace(value.cast("string"), r"\s+", " "))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID)
