"""Column functions on text: normalisation, keys, masking, spans. All but nfkc() are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; written out, as \s differs between engines.
SPACE = r"[ \t\n\x0B\f\r]"
#: Small kana block of 86 letters, in both scripts, 0x60 apart.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def compact(x: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(x, f"{SPACE}+", "")


def compact_punctuation(x: Column) -> Column:
    """Lower case, without white space, punctuation, quotes and brackets: the key under which mentions of an entity meet."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 20 hex digits of the SHA-256 over the parts, which a rare separator keeps apart; nulls count as empty."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("␟", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 20))


def fold_kana(x: Column) -> Column:
    return F.translate(x, KATAKANA, HIRAGANA)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in expression."""
    return x.str.normalize("NFKC")


#: Ordered rewrites of secrets: pattern, replacement.
MASKS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    (r"(?i)bearer +[A-Za-z0-9._~+/=-]+", "[TOKEN]"),
    (r"(?i)(api_key|apikey|password|passwd|secret|token) *[=:] *[^ \t\n\r,;]+", "$1=[SECRET]"),
    (r"[0-9]([ -]?[0-9]){11,18}", "[NUMBER]"),
]


def mask_sensitive(x: Column) -> Column:
    for pattern, put in MASKS:
        x = F.regexp_replace(x, pattern, put)
    return x


def strip_markup(x: Column, rounds: int = 1) -> Column:
    """Scripts, styles, comments and tags go, a few references are decoded, white space collapses. More rounds undo nesting."""
    for _ in range(rounds):
        x = F.regexp_replace(x, r"(?s)<script[^>]*>.*?</script>", " ")
        x = F.regexp_replace(x, r"(?s)<style[^>]*>.*?</style>", " ")
        x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
        x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return collapse(x)


#: Elements that a fold appends to one array before it begins the next.
CHUNK = 64
#: Characters of a text whose matches go to one array.
SHORT = 1024


def fold_append(xs: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An array of what each element of xs gives, with a state that goes along: step(state, x) is (next state, output). kind: the output's type.

    One pass; outputs are gathered CHUNK at a time, so that a long array costs no square of its length.
    """
    one, many = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def each(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        full = F.size(a["now"]) >= CHUNK
        return F.struct(state.alias("state"), F.when(full, F.array(out)).otherwise(F.concat(a["now"], F.array(out))).alias("now"), F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"))

    return F.aggregate(xs, F.struct(zero.alias("state"), one.alias("now"), many.alias("done")), each, lambda a: F.when(F.size(a["done"]) == 0, a["now"]).otherwise(F.flatten(F.concat(a["done"], F.array(a["now"])))))


def spans(x: Column, pattern: str | Column, short_only: bool = False) -> Column:
    """Every match as (start, end, surface), [start, end) in code points. short_only: the plan has the fold for short texts alone (clauses), which is right for all, but slow for thousands of matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(x, pattern, -1).alias("gap"), F.regexp_extract_all(x, pattern, F.lit(0)).alias("hit"))

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["gap"])
        end = start + F.length(p["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("surface"))

    hits = F.filter(pairs, lambda p: p["hit"].isNotNull())
    kind = "struct<start:int,end:int,surface:string>"
    none = F.array().cast(f"array<{kind}>")

    def plain(a: Column, p: Column) -> Column:
        at, out = step(a["at"], p)
        return F.struct(at.alias("at"), F.concat(a["out"], F.array(out)).alias("out"))

    # a short text has few matches: one array is enough, and quicker
    short = F.aggregate(hits, F.struct(F.lit(0).alias("at"), none.alias("out")), plain, lambda a: a["out"])
    if short_only:
        return short
    return F.when(F.length(x) <= SHORT, short).otherwise(fold_append(hits, F.lit(0), kind, step))


#: Ordered classes of names; the first that fits wins.
ENTITY_CLASSES = [("url", r"^https?://"), ("email", r"^[A-Za-z0-9._%+-]+@"), ("number", r"^[0-9]"), ("name", r"^[A-Z]")]


def entity_type(x: Column) -> Column:
    out = None
    for kind, pattern in ENTITY_CLASSES:
        out = F.when(x.rlike(pattern), kind) if out is None else out.when(x.rlike(pattern), kind)
    return out.otherwise("unknown")


#: Ordered license buckets by what the declared license contains.
LICENSE_BUCKETS = [("sharealike", "cc by-sa"), ("noncommercial", "cc by-nc"), ("attribution", "cc by"), ("copyleft", "general public license"), ("permissive", "mit license"), ("permissive", "apache license"), ("public-domain", "public domain")]


def license_bucket(x: Column) -> Column:
    low, out = F.lower(x), None
    for bucket, mark in LICENSE_BUCKETS:
        hit = F.contains(low, F.lit(mark))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise("unknown")


def semver_bump(x: Column) -> Column:
    """The patch number, plus one."""
    parts = F.split(x, r"\.")
    return F.concat_ws(".", parts[0], parts[1], (parts[2].cast("int") + 1).cast("string"))


def is_public_url(x: Column) -> Column:
    """http or https with a host that has no private mark."""
    host = F.lower(F.regexp_extract(x, r"^https?://([^/:?#]+)", 1))
    return (host != "") & ~host.rlike(r"(^|\.)(localhost|internal|local|intranet|private)(\.|$)")


def any_marker(x: Column, markers: list[str]) -> Column:
    low = F.lower(x)
    return F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m))


def word_bounded(text: Column, start: Column, end: Column, surface: Column) -> Column:
    """Whether a surface with ASCII letters or digits stands between other characters than these; other surfaces always do."""
    before, after = F.substring(text, start, 1), F.substring(text, end + 1, 1)
    edge = (F.when(start == 0, "").otherwise(before).rlike("[A-Za-z0-9]")) | after.rlike("[A-Za-z0-9]")
    return ~surface.rlike("[A-Za-z0-9]") | ~edge
