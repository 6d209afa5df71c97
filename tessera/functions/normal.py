"""Compatibility normalisation with a map back to the source, and keys made from it. There is no built-in expression for it, so it runs in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stays as it is: fenced code, code in backticks, URLs.
PROTECTED = r"(?s)```.*?```|`[^`\n]*`|https?://[^\s)>\]]+"
_PROTECTED = regex.compile(PROTECTED)
_CLUSTER = regex.compile(r"\X")


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """(text, start and end in the source of the cluster that each character is from)."""
    if text.isascii():
        return text, list(range(len(text))), list(range(1, len(text) + 1))
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def take(begin: int, end: int, change: bool) -> None:
        for m in _CLUSTER.finditer(text, begin, end):
            put = unicodedata.normalize("NFKC", m[0]) if change else m[0]
            out.append(put)
            starts.extend([m.start()] * len(put) if change else range(m.start(), m.end()))
            ends.extend([m.end()] * len(put) if change else range(m.start() + 1, m.end() + 1))

    at = 0
    for m in _PROTECTED.finditer(text):
        take(at, m.start(), True)
        take(m.start(), m.end(), False)
        at = m.end()
    take(at, len(text), True)
    return "".join(out), starts, ends


def with_map(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text, normal, starts, ends: the text normalised by grapheme clusters, protected parts left alone, and for each character of it the cluster [start, end) of the source. Null stays null."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [normalised(x) if x is not None else (None, None, None) for x in batch.column(len(keys)).to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(keys) + 1)), *columns], [*keys, "text", "normal", "starts", "ends"])

    return texts.select(*keys, F.col(text).alias("text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string", "normal string", "starts array<int>", "ends array<int>"]))


def project(start: Column, end: Column, starts: Column, ends: Column) -> Column:
    """(start, end) in the source of a span of the normalised text; places outside are moved to its edges, an empty text gives (0, 0)."""
    n = F.size(starts)
    first = F.try_element_at(starts, F.greatest(F.lit(1), F.least(start + 1, n)))
    last = F.try_element_at(ends, F.greatest(F.lit(1), F.least(F.greatest(end, start + 1), n)))
    return F.struct(F.coalesce(first, F.lit(0)).alias("start"), F.coalesce(last, F.lit(0)).alias("end"))


@F.pandas_udf(T.StringType())
def join_key(x: pd.Series) -> pd.Series:
    """NFKC, without white space, case folded: the key under which surfaces meet. `lower` is not enough, as of ß."""
    return x.str.normalize("NFKC").str.replace(r"\s+", "", regex=True).str.casefold()


@F.pandas_udf(T.StringType())
def lexicon_text(x: pd.Series) -> pd.Series:
    """NFKC, runs of white space as one space, trimmed."""
    return x.str.normalize("NFKC").str.replace(r"\s+", " ", regex=True).str.strip()
