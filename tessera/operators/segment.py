"""Clauses and tokens with ordinals and offsets; quoted ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spans

#: A clause: what stands between sentence ends.
CLAUSE = r"[^.!?\n]*[^.!?\n \t\r][^.!?\n]*[.!?\n]*"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
QUOTED = '"[^"]*"'


def clauses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clause_no (from 1), start, end, clause (trimmed of spaces at both ends; start and end are those of the trimmed part). Blank clauses are left out."""
    found = docs.select(key, F.posexplode(spans(F.col(text), CLAUSE)).alias("pos", "c"))
    lead = F.length("c.surface") - F.length(F.ltrim("c.surface"))
    trimmed = F.regexp_replace(F.trim("c.surface"), r"[\n]+$", "")
    return found.select(key, (F.col("pos") + 1).alias("clause_no"), (F.col("c.start") + lead).alias("start"), (F.col("c.start") + lead + F.length(trimmed)).alias("end"), trimmed.alias("clause"))


def tokens(docs: DataFrame, key: list[str] | str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), token: lower-cased runs of letters and digits, the fallback where no morphological analyser is at hand."""
    keys = [key] if isinstance(key, str) else key
    return docs.select(*keys, F.posexplode(F.filter(F.split(F.lower(F.col(text)), TOKEN_BREAK), lambda t: t != "")).alias("pos", "token"))


def token_spans(docs: DataFrame, key: list[str] | str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, start, end, token, with offsets in the text."""
    keys = [key] if isinstance(key, str) else key
    return docs.select(*keys, F.posexplode(spans(F.col(text), r"[\p{L}\p{N}]+")).alias("pos", "t")).select(*keys, "pos", "t.start", "t.end", F.lower("t.surface").alias("token"))


def quotes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Quoted ranges that do not nest."""
    return docs.where(F.contains(F.col(text), F.lit('"'))).select(key, F.explode(spans(F.col(text), QUOTED)).alias("q")).select(key, "q.start", "q.end", "q.surface")


#: Opening marks and what closes them.
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "「": "」", "『": "』", "（": "）"}


def nested_quotes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of matched pairs, nested ones kept, in order of start; needs a stack, so it runs in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        close = {v: k for k, v in PAIRS.items()}
        for batch in batches:
            out = []
            for ident, value in zip(batch[key], batch[text], strict=True):
                stack, found = [], []
                for i, c in enumerate(value or ""):
                    if c in PAIRS:
                        stack.append((c, i))
                    elif c in close and any(o == close[c] for o, _ in stack):
                        while stack[-1][0] != close[c]:
                            stack.pop()
                        found.append((ident, stack.pop()[1], i + 1, len(stack)))
                out += sorted(found, key=lambda x: x[1])
            yield pd.DataFrame(out, columns=[key, "start", "end", "depth"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, start int, end int, depth int")


def sentence_final(text: Column, end: Column) -> Column:
    """Whether what ends here stands at the end of its sentence."""
    return F.substring(text, end + 1, 1).isin("", ".", "!", "?", "\n")
