"""Tidy forms of identifiers and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around an identifier.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000"


def stripped(column: Column | str) -> Column:
    """Without outer blanks; null when nothing is left."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.btrim(column, F.lit(BLANKS)), F.lit(""))


def tidy_upper(column: Column | str) -> Column:
    """Image, slide and patient ids; null and blank refer to nothing and give null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.upper(F.btrim(column, F.lit(BLANKS))), F.lit(""))


def tidy_lower(column: Column | str) -> Column:
    """Tar, source and split names, digests."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.btrim(column, F.lit(BLANKS))), F.lit(""))


def tidy_path(column: Column | str) -> Column:
    """A path in one notation: lower case, '/' once, without '.' steps and outer separators.

    '..' steps stay as they are, since what they mean depends on links. Null and
    blank paths, and paths of separators and '.' only, give null.
    """
    column = F.col(column) if isinstance(column, str) else column
    path = F.replace(F.lower(F.btrim(column, F.lit(BLANKS))), F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(path, r"(?<![^/])(?:\.?/)+|(?<![^/])\.\z", "")
    return F.nullif(F.btrim(path, F.lit("/")), F.lit(""))


def folder_of(path: Column) -> Column:
    """The last folder of a tidy path, null when it has none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def file_of(path: Column) -> Column:
    """The last component of a tidy path."""
    return F.element_at(F.split(path, "/"), -1)


def unit_interval(*columns: Column | str | int, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns], F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
