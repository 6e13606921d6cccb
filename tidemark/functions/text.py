"""Text normalisation, hashed ids and route parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.expressions import as_column

__all__ = ["hashed_id", "joined_text", "normalise_email", "route_screen", "slug"]


def normalise_email(column: str | Column) -> Column:
    return F.lower(F.trim(as_column(column)))


def slug(column: str | Column) -> Column:
    """Lower-case ascii letters, digits, dot and underscore; everything else is removed."""
    return F.regexp_replace(F.lower(as_column(column)), "[^a-z0-9._]", "")


def hashed_id(*parts: str | Column, length: int = 32) -> Column:
    """Retry-safe id: the first characters of a SHA-256 over the joined parts."""
    text = F.concat_ws("|", *[as_column(part).cast("string") for part in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def route_screen(route: str | Column, default: str = "HOME") -> Column:
    """Last part of a route as a screen name."""
    last = F.element_at(F.split(as_column(route), "/"), -1)
    name = F.upper(F.replace(last, F.lit("-"), F.lit("_")))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def joined_text(values: str | Column, separator: str = ", ") -> Column:
    """Join an array; missing entries count as empty text, as in a script's ``join``."""
    filled = F.transform(as_column(values), lambda item: F.coalesce(item.cast("string"), F.lit("")))
    return F.array_join(filled, separator)
