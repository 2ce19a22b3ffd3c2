"""Small string expressions with Unicode-aware whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space at the ends of a text.
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACES))


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def path_parts(path: Column) -> Column:
    """Path components. Their array order sorts a folder before ``folder-1``."""
    return F.split(path, "/", -1)


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """Whether the file name ends in one of the extensions, in any case."""
    return F.lower(path).rlike(r"[^/]\.(" + "|".join(extensions) + r")\z")


def or_default(value: Column, default: str) -> Column:
    """Null and empty become the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def occurrences(text: Column, token: str) -> Column:
    """How often a token occurs in a text."""
    shorter = F.replace(text, F.lit(token), F.lit(""))
    return ((F.length(text) - F.length(shorter)) / F.lit(len(token))).cast("int")
