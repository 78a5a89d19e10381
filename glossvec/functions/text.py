"""Text expressions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed patterns: a run of word characters, and a run of or a single other visible character.
WORD_RUN = r"[\p{L}\p{M}\p{N}_]+"
PUNCT_RUN = r"[^\p{L}\p{M}\p{N}_\s]+"
PUNCT_ONE = r"[^\p{L}\p{M}\p{N}_\s]"


# Texts of a batch that are normalised at a time.
TEXTS_AT_A_TIME = 256


def _col(t) -> Column:
    return F.col(t) if isinstance(t, str) else t


def words(t) -> Column:
    """Whitespace-separated words, without empty items."""
    return F.regexp_extract_all(_col(t), F.lit(r"\S+"), F.lit(0))


def word_runs(t) -> Column:
    """Lower-cased runs of letters, marks, digits and underscores."""
    return F.regexp_extract_all(F.lower(_col(t)), F.lit(WORD_RUN), F.lit(0))


def word_count(t) -> Column:
    return F.size(words(t)).cast("bigint")


def chars(t) -> Column:
    """The characters of a text in order, without empty items."""
    return F.filter(F.split(_col(t), ""), lambda c: c != "")


def strip_chars(t, what: str) -> Column:
    """Strip any of the given characters at both ends."""
    return F.btrim(_col(t), F.lit(what))


def char_span(t, start, end) -> Column:
    """Characters `[start, end)` of a text, counted from 0."""
    s, e = _col(start).cast("int"), _col(end).cast("int")
    return F.substring(_col(t), s + 1, e - s)


@pandas_udf(T.ArrayType(T.StringType()))
def _spans(t: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    rows = [
        None if s is None or a is None or e is None else [s[i:j] for i, j in zip(a, e)]
        for s, a, e in zip(t, starts, ends)
    ]
    return pd.Series(rows, dtype=object)


def char_spans(t, starts, ends) -> Column:
    """Many spans of one text at once: `[starts[i], ends[i])` for every i.

    A substring expression counts characters from the front each time, which
    is quadratic in the length of a text with many spans.
    """
    return _spans(_col(t), _col(starts), _col(ends))


def hyphen_to_space(t) -> Column:
    return F.translate(_col(t), "-", " ")


@F.arrow_udf(T.StringType())
def _strip_accents(t: pa.Array) -> pa.Array:
    # NFD, then drop the combining marks; Spark has no built-in normaliser.
    parts = [t.slice(s, TEXTS_AT_A_TIME).cast(pa.string()) for s in range(0, len(t), TEXTS_AT_A_TIME)]
    done = [pc.replace_substring_regex(pc.utf8_normalize(p, form="NFD"), r"\p{Mn}+", "") for p in parts]
    return pa.concat_arrays(done) if done else t.cast(pa.string())


def normalise_text(t) -> Column:
    """NFD, lower case, accents stripped."""
    return _strip_accents(F.lower(_col(t)))
