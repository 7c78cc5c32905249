"""Scalar text functions. All are JVM expressions, but for names outside ASCII in norm_key, whose NFKC and case folding Spark lacks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the four separators that Python strips besides.
_SPACE = "[\\s\\u001c-\\u001f]"


def strip(text: Column) -> Column:
    plain = text.rlike("\\A[!-~](?:[ -~]*[!-~])?\\z")  # nearly all names: one look, and nothing to take off
    return F.when(plain, text).otherwise(F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", ""))


def text_of(content: Column) -> Column:
    """UTF-8 bytes as text with plain line ends."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n")


def title_of(filename: Column) -> Column:
    return F.translate(F.regexp_replace(filename, "\\.md$", ""), "_", " ")


def title_or_filename(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), filename)


def chunk_id(filename: Column, index: Column) -> Column:
    return F.concat(filename, F.lit("::"), index.cast("string"))


def filename_of(chunk: Column) -> Column:
    """What stands before the last ``::``, or all of it."""
    return F.when(chunk.contains("::"), F.left(chunk, F.length(chunk) - F.length(F.substring_index(chunk, "::", -1)) - 2)).otherwise(chunk)


def norm_text(name: str) -> str:
    """Key under which spellings of one name meet."""
    folded = unicodedata.normalize("NFKC", name).replace("_", " ").replace("-", " ")
    return re.sub(r"\s+", " ", folded).strip().casefold()


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(norm_text, na_action="ignore")


def norm_key(name: Column | str) -> Column:
    """norm_text; only names outside ASCII go to Python. Callers pass distinct names where they can."""
    name = F.col(name) if isinstance(name, str) else name
    plain = name.rlike("\\A[\\x00-\\x7f]*\\z")
    # Blanks of ASCII as Python has them.
    spaced = F.regexp_replace(F.translate(name, "_-", "  "), "[\\t-\\r\\x1c-\\x20]+", " ")
    return F.when(plain, F.lower(F.trim(spaced))).otherwise(_folded(F.when(~plain, name)))


def has_both_cases(name: Column) -> Column:
    return (name.rlike("\\p{IsUppercase}") & name.rlike("\\p{IsLowercase}")).cast("int")


def parse_value(value: Column) -> Column:
    """First number of a text, or null."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), "-?\\d+(?:\\.\\d+)?", 0).try_cast("double")


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def result_id(*fields: Column) -> Column:
    """Digest of a result's identifying fields; null counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]).cast("binary"))


def header_prefix(headers: Column, levels: list[tuple[str, str]]) -> Column:
    """``mark value`` lines of the header map, in configured order, present values only."""
    lines = [F.when(F.coalesce(headers[key], F.lit("")) != "", F.concat(F.lit(mark + " "), headers[key])) for mark, key in levels]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def add_prefix(body: Column, prefix: Column) -> Column:
    return F.when(prefix != "", F.concat(prefix, F.lit("\n"), body)).otherwise(body)


def snippet(text: Column, width: int = 100) -> Column:
    return F.left(F.translate(text, "\n", " "), F.lit(width))
