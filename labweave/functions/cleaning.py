"""Scalar cleaning as Column expressions; none of them needs a Python worker."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labweave.fixed_values import MISSING_TOKENS, READER_NULL_TOKENS

# the characters that str.strip() removes, those beyond ASCII included
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# plain decimal or exponent notation, blanks around it allowed
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(text.cast("string"), F.lit(SPACE))


def null_if_missing(text: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Null where the text, without white space around it, is one of the missing-value tokens."""
    return F.when(strip(text).isin(*tokens), F.lit(None)).otherwise(text)


def null_if_reader_missing(text: Column, tokens: Iterable[str] = READER_NULL_TOKENS) -> Column:
    """Null where a delimited-text reader sees none: the cell is exactly one of its tokens, the empty text among them."""
    return F.when(text.isin(*tokens), F.lit(None)).otherwise(text)


def to_number(text: Column) -> Column:
    """Strict number: anything that is not plain decimal text becomes null.

    The pattern keeps Java-only spellings out ('1d', 'NaN', '0x1p3') and spares the cast
    an exception per bad cell.
    """
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_number_lenient(text: Column) -> Column:
    """Number after dropping '?' and reading a decimal comma as a point."""
    return to_number(F.translate(text, ",?", "."))


def to_number_digits(text: Column) -> Column:
    """Number from only the digits, points and minus signs of the text."""
    return to_number(F.regexp_replace(text, r"[^0-9.\-]", ""))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def tag_source(value: Column, source: int | str) -> Column:
    """``source-[value]``; an absent value gives empty text."""
    return F.coalesce(F.concat(F.lit(f"{source}-["), value.cast("string"), F.lit("]")), F.lit(""))


def safe_file_name(text: Column) -> Column:
    """Replace characters that file systems refuse by '_'."""
    return F.regexp_replace(text, r'[\\/*?:"<>|]', "_")


def safe_label(text: Column) -> Column:
    """Lower-risk label: blanks and slashes become '_', parentheses go."""
    return F.translate(text, " /()", "__")


def quantise(value: Column, step: float, low: float, high: float) -> Column:
    """Round to a multiple of ``step`` (half to even) and clip to the bounds."""
    return F.least(F.greatest(F.bround(value / F.lit(step)) * F.lit(step), F.lit(low)), F.lit(high))


def field_or(struct: Column | str, path: str, default) -> Column:
    """Nested field with a default for an absent or null step."""
    root = F.col(struct) if isinstance(struct, str) else struct
    for name in path.split("."):
        root = root[name]
    return F.coalesce(root, F.lit(default))
