"""Text keys: normalisation, slugs, alias maps, small string rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=None)
def _combining_marks() -> dict[int, None]:
    """Deletion table of all combining marks, derived from the Unicode data."""
    return {p: None for p in range(0x300, 0x20000) if unicodedata.combining(chr(p))}


@lru_cache(maxsize=None)
def _ascii_bases() -> tuple[str, str]:
    """Characters whose canonical decomposition holds an ASCII character, and that character."""
    source, target = [], []
    for point in range(0x80, 0x3000):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(point)) if x < "\x80")
        if plain:
            source.append(chr(point))
            target.append(plain)
    return "".join(source), "".join(target)


@lru_cache(maxsize=None)
def _ascii_folds() -> tuple[str, str]:
    """Characters that fold to one ASCII character, and that character; accents that stand alone fold to nothing."""
    source, target, gone = [], [], []
    for point in range(0x80, 0x3000):
        plain = unicodedata.normalize("NFKD", chr(point)).translate(_combining_marks())
        if not plain:
            gone.append(chr(point))
        elif len(plain) == 1 and plain < "\x80":
            source.append(chr(point))
            target.append(plain)
    # what has no counterpart in the second text is removed
    return "".join(source + gone), "".join(target)


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    marks = _combining_marks()
    return s.map(
        lambda t: unicodedata.normalize("NFKD", t).translate(marks).strip().lower(), na_action="ignore"
    )


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@lru_cache(maxsize=None)
def _settled() -> str:
    """Characters outside ASCII that are their own decomposition and lower case."""
    marks = _combining_marks()
    points = (chr(p) for p in range(0x80, 0x3000) if p not in marks)
    return "".join(x for x in points if unicodedata.normalize("NFKD", x) == x == x.lower() and not x.isspace())


def _is_settled(text: Column) -> Column:
    """Whether the table has folded all there is to fold."""
    return _is_ascii(F.translate(text, _settled(), ""))


def normalize_text(c: str | Column) -> Column:
    """Lower case without accents and outer white space; NULL stays NULL.

    ASCII text is only stripped and lowered. Accented Latin letters and the like fold
    once by a character table in the JVM. Only text with other characters outside ASCII
    goes through Python in Arrow batches, for the Unicode decomposition.
    """
    text = col(c)
    foreign = F.when(~_is_ascii(text), text)
    plain = F.translate(foreign, *_ascii_folds())
    # as an element of an array, so that it is made once for its test and its use
    folded = F.transform(F.array(plain), lambda x: F.when(_is_settled(x), F.lower(strip_space(x))))
    return F.when(_is_ascii(text), F.lower(strip_space(text))).otherwise(
        F.coalesce(folded[0], _fold(F.when(~_is_settled(plain), text)))
    )


# every character that counts as white space, from the Unicode data
WHITE_SPACE = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def slug(c: str | Column, aliases: Mapping[str, str] | None = None) -> Column:
    """ASCII letters, digits and underscores in lower case; ``aliases`` applied last."""
    text = col(c)
    source, target = _ascii_bases()
    ascii_only = F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7f]", "")
    out = F.lower(F.translate(F.regexp_replace(ascii_only, r"[^\w\s]", ""), " ", "_"))
    return replace_values(out, aliases) if aliases else out


def country_key(c: str | Column, aliases: Mapping[str, str] | None = None) -> Column:
    """One join key for names from all sources: normalised, punctuation out, words joined by one underscore."""
    words = F.regexp_replace(normalize_text(c), r"(?U)[^\w\s]", "")
    out = F.regexp_replace(F.trim(words), r"\s+", "_")
    return replace_values(out, aliases) if aliases else out


def _pairs(mapping: Mapping) -> Column:
    flat = []
    for k, v in mapping.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def replace_values(c: str | Column, mapping: Mapping) -> Column:
    """Mapped values replaced, others kept."""
    return F.coalesce(_pairs(mapping)[col(c)], col(c))


def map_values(c: str | Column, mapping: Mapping) -> Column:
    """Mapped values replaced, others NULL."""
    return _pairs(mapping)[col(c)]


def fix_containing(c: str | Column, fixes: Sequence[tuple[str, str]]) -> Column:
    """Apply (substring, replacement) in order; a later fix sees the result of an earlier one."""
    out = col(c)
    for part, whole in fixes:
        out = F.when(out.contains(part), F.lit(whole)).otherwise(out)
    return out


def percent_to_fraction(c: str | Column) -> Column:
    """'12%' to 0.12; unreadable text to NULL."""
    return F.regexp_replace(col(c), r"%+$", "").try_cast("double") / 100


def truncate(c: str | Column, length: int) -> Column:
    """Text longer than ``length`` is cut to that length, ending in three dots."""
    text = col(c)
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def feature_column_name(name: str, stem: str = "feature") -> str:
    """Header rule for numbered features: '' -> stem_0, ' .12' -> stem_12, other names kept."""
    bare = name.strip(" .")
    if bare == "":
        return f"{stem}_0"
    return f"{stem}_{int(bare)}" if bare.lstrip("+-").isdigit() else name


def prefix_columns(columns: Sequence[str], stem: str, prefix: str) -> dict[str, str]:
    """Renames that put ``prefix_`` before every column of a feature family."""
    return {c: f"{prefix}_{c}" for c in columns if c.startswith(f"{stem}_")}


def strata_key(*columns: str | Column) -> Column:
    """Several columns as one text key; NULL is written as 'nan' so that it cannot vanish."""
    return F.concat_ws("-", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in columns])


def to_number(c: str | Column) -> Column:
    """Text to DOUBLE; unreadable text to NULL."""
    return col(c).try_cast("double")
