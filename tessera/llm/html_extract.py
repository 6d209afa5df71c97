"""HTML main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: the text between the borders of block-level elements, with the elements that are open around it.
A block has features of its ancestors (tag names, and the words of their class, id and role) and of its text (length, links,
punctuation). The field labels the chain of a page's blocks as article or not; it is trained by gradient ascent on the
likelihood of labelled pages, and decoded by Viterbi. The labelled pages are written by a seeded generator here: there is
no labelled table, and the pages to be extracted are never looked at in training.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noframes noembed xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BLOCK = CLOSES_P | frozenset("article body caption col colgroup dd dt frameset head html legend li link meta nav noframes tbody td template textarea tfoot th thead title tr script style base".split())
#: An element of the key ends open elements of the value, up to the container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Paths:
    """Open-element chains, each known by a number; features are the distinct ones of the chain."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.step: dict[tuple[int, str, str], int] = {}
        self.features: list[frozenset[str]] = [frozenset()]

    def down(self, path: int, tag: str, attributes: str) -> int:
        key = (path, tag, attributes)
        found = self.step.get(key)
        if found is None:
            new = {f"a:{tag}"}
            if "=" in attributes:
                for names in _NAMED.findall(attributes):
                    new.update(f"c:{w}" for w in _WORD.findall(_CAMEL.sub(r"\1 \2", html.unescape("".join(names))).lower()))
            old = self.features[path]
            found = self.step[key] = len(self.features)
            self.features.append(old if new <= old else old | new)
        return found


def blocks(page: str, paths: Paths) -> list[tuple[str, int, str, float]]:
    """(text, path, tag of the innermost block element, share of characters in links) of each block, in page order."""
    if len(paths.features) > 100_000:
        paths.clear()
    out: list[tuple[str, int, str, float]] = []
    stack: list[tuple[str, int]] = []  # open elements
    path, block = 0, "body"
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, path, block, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def pop(count: int) -> None:
        nonlocal path, block, in_link
        for _ in range(count):
            tag, path = stack.pop()
            in_link -= tag == "a"
        block = next((t for t, _ in reversed(stack) if t in BLOCK), "body")

    at, size = 0, len(page)
    for token in iter(lambda: _TOKEN.search(page, at), None):
        if token.start() > at:
            text = page[at : token.start()]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) * (in_link > 0)
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if token[1]:
            for up in range(len(stack) - 1, -1, -1):
                if stack[up][0] == tag:
                    pop(len(stack) - up)
                    break
            continue
        attributes = token[3]
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        ends, within = ({"p"}, CLOSES_P - {"p"}) if tag in CLOSES_P else SIBLINGS.get(tag, ((), ()))
        if ends:
            for up in range(len(stack) - 1, -1, -1):
                if stack[up][0] in ends:
                    pop(len(stack) - up)
                    break
                if stack[up][0] in within:
                    break
        stack.append((tag, path))
        path = paths.down(path, tag, attributes)
        in_link += tag == "a"
        if tag in BLOCK:
            block = tag
    if at < size:
        text = page[at:]
        parts.append(html.unescape(text) if "&" in text else text)
    flush()
    return out


def text_features(text: str, tag: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    length = min(words.bit_length(), 9)
    out = [f"t:{tag}", f"w:{length}", f"k:{round(linked * 4)}", f"kw:{round(linked * 2)}:{min(length, 5)}"]
    if text[-1] in ".!?…。\"»”)":
        out.append("end")
    if "©" in text or "all rights reserved" in text.lower():
        out.append("copyright")
    if "·" in text or "|" in text or "»" in text:
        out.append("separators")
    if text.count(",") * 12 > words:
        out.append("commas")
    return out


# -- labelled pages ---------------------------------------------------------------------------------------------------

_MARK = "\ue000"
#: Container names that page authors use; what they hold is not the article.
ASIDE_NAMES = {
    "nav": "nav navigation menu navbar topnav breadcrumb breadcrumbs main-menu site-nav pagination pager tabs toc skip links".split(),
    "header": "header masthead site-header top topbar banner page-header logo branding head".split(),
    "footer": "footer site-footer bottom colophon copyright foot legal page-footer".split(),
    "aside": "sidebar side aside widget related recommended more-stories popular trending tags share sharing social related-posts promo-list rail left-col right-col".split(),
    "ad": "ad ads advert advertisement ad-slot adsense sponsor sponsored promo banner-ad dfp native-ad commercial partner outbrain taboola".split(),
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice alert notification newsletter-popup modal popup overlay paywall subscribe toast warning disclaimer".split(),
    "form": "form login search search-form signup newsletter subscribe contact register comment-form".split(),
    "comments": "comments comment comment-list replies reply disqus discussion responses user-comments feedback reader-comments comment-body".split(),
}
ARTICLE_NAMES = "article content post entry entry-content post-content article-body story main main-content body-text article-text story-body page-content text".split()


def _sentence(r: random.Random, low: int, high: int) -> str:
    syllables = ("the", "er", "an", "ti", "on", "re", "la", "ch", "de", "ou", "in", "st", "ein", "que", "ó", "mi")
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for i in range(len(words) - 1):
        if r.random() < 0.1:
            words[i] += ","
        elif r.random() < 0.06:
            words[i] += "."
    return (" ".join(words)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def _label_noise(r: random.Random, text: str) -> str:
    """Junk symbols after words, which also real articles have."""
    return re.sub(" ", lambda _: r.choice(["&amp; ", "% ", " ", "* ", "$ "]), text) if r.random() < 0.05 else text


def labelled_page(r: random.Random) -> str:
    """A page; blocks of the article begin with a mark."""

    def box(kind: str, inner: str) -> str:
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "ins", "section"], "notice": ["div", "section", "dialog"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}
        tag = r.choice(tags[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form")
        name = "" if semantic and r.random() < 0.5 else f' {r.choice(["class", "id", "class"])}="{r.choice(ASIDE_NAMES[kind])}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        made = [f'<a href="/{i}">{_sentence(r, 1, 4)}</a>' for i in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>" if r.random() < 0.7 else r.choice([" ", " | ", " · "]).join(made)

    def junk(kind: str) -> str:
        if kind == "nav":
            return box(kind, links(2, 8))
        if kind == "header":
            return box(kind, r.choice([f"<h1>{_sentence(r, 1, 4)}</h1>", f"<p>{_sentence(r, 2, 8)}</p>", f'<a href="/">{_sentence(r, 1, 3)}</a>', _sentence(r, 2, 6)]) + (links(2, 5) if r.random() < 0.4 else ""))
        if kind == "footer":
            return box(kind, r.choice([f"&copy; {_sentence(r, 1, 3)} &middot; {_sentence(r, 3, 20)}", f"<p>&copy; 2020 {_sentence(r, 1, 6)}</p>", links(2, 5), f"<p>{_sentence(r, 3, 25)}</p>"]))
        if kind == "aside":
            return box(kind, r.choice([f"<h3>{_sentence(r, 1, 4)}</h3>{links(2, 6)}", f"<p>{_sentence(r, 4, 40)}</p>", f"<h2>{_sentence(r, 1, 4)}</h2><p>{_sentence(r, 4, 40)}</p>", _sentence(r, 4, 30)]))
        if kind in ("ad", "notice"):
            return box(kind, r.choice([_sentence(r, 3, 30), f"<p>{_sentence(r, 3, 40)}</p>", f"{_sentence(r, 3, 20)}<button>{_sentence(r, 1, 2)}</button>", f'<a href="/x">{_sentence(r, 3, 12)}</a>']))
        if kind == "form":
            return box(kind, f'<label>{_sentence(r, 1, 3)}</label><input name="q">' + r.choice([f"<p>{_sentence(r, 2, 15)}</p>", "", f"<button>{_sentence(r, 1, 2)}</button>"]))
        each = "".join(r.choice([f'<div class="comment"><b>{_sentence(r, 1, 2)}</b><p>{_sentence(r, 3, 60)}</p></div>', f"<li><p>{_sentence(r, 3, 60)}</p></li>", f"<p>{_sentence(r, 3, 60)}</p>"]) for _ in range(r.randint(1, 5)))
        return box(kind, f"<h3>{_sentence(r, 1, 3)}</h3>" * (r.random() < 0.5) + each)

    def body_block() -> str:
        text = _label_noise(r, _sentence(r, *r.choice([(1, 3), (3, 12), (12, 50), (40, 150)])))
        kind = r.random()
        if kind < 0.7:
            inner = r.choice(["{}", "{}", "{}", "<b>{}<br>", "<em>{}</em>", '<a href="/y">{}</a>' if r.random() < 0.2 else "{}"]).format(_MARK + text)
            return f"<p>{inner}" + "</p>" * (r.random() < 0.85)
        if kind < 0.8:
            return r.choice(["<h2>{}</h2>", "<h3>{}</h3>"]).format(_MARK + _sentence(r, 1, 9))
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{_MARK}{_sentence(r, 1, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{_MARK}{text}</blockquote>"
        if kind < 0.96:
            return f"<pre>{_MARK}{text}</pre>"
        return f"<div>{_MARK}{text}</div>"

    kinds = list(ASIDE_NAMES)
    pick = lambda chance: "".join(junk(k) for k in r.sample(kinds, r.randint(0, 3)) if r.random() < chance)
    inner = f"<h1>{_MARK}{_sentence(r, 2, 12)}</h1>" * (r.random() < 0.85)
    for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
        inner += body_block()
        if r.random() < 0.08:
            inner += junk(r.choice(["ad", "aside", "notice", "form", "nav", "ad"]))
    way = r.random()
    if way < 0.6:
        body = f"<article>{inner}</article>"
    elif way < 0.8:
        body = f'<{r.choice(["div", "section", "main"])} {r.choice(["class", "id"])}="{r.choice(ARTICLE_NAMES)}">{inner}</div>'
    elif way < 0.9:
        body = f"<main>{inner}</main>"
    else:
        body = inner
    if r.random() < 0.1:  # nothing but the article
        return f"<html><body>{body}</body></html>" if r.random() < 0.5 else body
    body = (junk("header") if r.random() < 0.5 else "") + (junk("nav") if r.random() < 0.8 else "") + pick(0.7) + body + (junk("comments") if r.random() < 0.4 else "") + pick(0.7) + (junk("footer") if r.random() < 0.85 else "")
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}" + "</body></html>" * (r.random() < 0.9)


# -- the field --------------------------------------------------------------------------------------------------------


class Field:
    """Weights: of each feature for the article label (the other's are 0), of label pairs (from, to), and of the first and last label."""

    def __init__(self, names: list[str], weights: np.ndarray, pairs: np.ndarray, ends: np.ndarray) -> None:
        self.weight = dict(zip(names, weights.tolist(), strict=True))
        self.pairs, self.ends = pairs.tolist(), ends.tolist()

    def viterbi(self, scores: list[float]) -> list[bool]:
        """The most likely labels of a chain, given the article scores; ties to not article."""
        (t00, t01), (t10, t11) = self.pairs
        (s0, s1), (e0, e1) = self.ends
        a, b, back = s0, s1 + scores[0], []
        for x in scores[1:]:
            to0, to1 = b + t10 > a + t00, b + t11 > a + t01
            back.append((to0, to1))
            a, b = (b + t10 if to0 else a + t00), x + (b + t11 if to1 else a + t01)
        label = b + e1 > a + e0
        out = [label]
        for to0, to1 in reversed(back):
            label = to1 if label else to0
            out.append(label)
        return out[::-1]


def train(pages: list[str], steps: int = 160, l2: float = 0.02) -> Field:
    """Fit on pages whose article blocks begin with the mark: full-batch Adam on the log-likelihood, all chains at once."""
    paths, chains, labels = Paths(), [], []
    ids: dict[str, int] = {}
    for page in pages:
        chain, truth = [], []
        for text, path, tag, linked in blocks(page, paths):
            marked = text.startswith(_MARK)
            text = text.replace(_MARK, "")
            if not text:
                continue
            truth.append(int(marked))
            chain.append([ids.setdefault(f, len(ids)) for f in (*paths.features[path], *text_features(text, tag, linked))])
        if chain:
            chains.append(chain)
            labels.append(truth)
    n, longest = len(chains), max(map(len, chains))
    sizes = np.array([len(c) for c in chains])
    y = np.full((n, longest), -1)
    for i, t in enumerate(labels):
        y[i, : len(t)] = t
    feature = np.array([f for c in chains for b in c for f in b])
    place = np.array([i * longest + j for i, c in enumerate(chains) for j, b in enumerate(c) for _ in b])
    real = y >= 0
    total = len(ids)
    theta = np.zeros(total + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)

    def expectations(theta: np.ndarray) -> np.ndarray:
        """Gradient of the mean log-likelihood."""
        w, pairs, ends = theta[:total], theta[total : total + 4].reshape(2, 2), theta[total + 4 :].reshape(2, 2)
        scores = np.zeros((n, longest, 2))
        scores[:, :, 1] = np.bincount(place, weights=w[feature], minlength=n * longest).reshape(n, longest)
        forward = np.empty((n, longest, 2))
        forward[:, 0] = scores[:, 0] + ends[0]
        for j in range(1, longest):
            step = np.logaddexp.reduce(forward[:, j - 1, :, None] + pairs, axis=1) + scores[:, j]
            forward[:, j] = np.where(real[:, j, None], step, forward[:, j - 1])
        backward = np.tile(ends[1], (n, longest, 1))
        for j in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(pairs + (scores[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(real[:, j + 1, None], step, ends[1])
        z = np.logaddexp.reduce(forward[:, -1] + ends[1], axis=1)
        one = np.where(real, np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]), 0)
        g = np.zeros_like(theta)
        g[:total] = np.bincount(feature, weights=(np.where(real, y, 0) - one).reshape(-1)[place], minlength=total)
        both = np.exp(forward[:, :-1, :, None] + pairs + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        want = np.zeros((2, 2))
        np.add.at(want, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        g[total : total + 4] = (want - both.sum((0, 1))).reshape(-1)
        g[total + 4 : total + 6] = [(y[:, 0] == 0).sum() - (1 - one[:, 0]).sum(), (y[:, 0] == 1).sum() - one[:, 0].sum()]
        last = one[rows, sizes - 1]
        g[total + 6 :] = [(y[rows, sizes - 1] == 0).sum() - (1 - last).sum(), (y[rows, sizes - 1] == 1).sum() - last.sum()]
        return g / n - l2 * theta / 10

    for step in range(1, steps + 1):
        g = expectations(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(list(ids), theta[:total], theta[total : total + 4].reshape(2, 2), theta[total + 4 :].reshape(2, 2))


@lru_cache(maxsize=4)
def default_field(pages: int = 800, seed: int = 7) -> Field:
    r = random.Random(seed)
    return train([labelled_page(r) for _ in range(pages)])


class Extractor:
    def __init__(self, field: Field) -> None:
        self.field, self.paths = field, Paths()
        self.known: list[float] = []  # score of a path's features

    def labels(self, page: str) -> list[tuple[str, bool]]:
        found = blocks(page, self.paths)
        if not found:
            return []
        if len(self.known) > len(self.paths.features):
            self.known = []
        weight = self.field.weight.get
        for features in self.paths.features[len(self.known) :]:
            self.known.append(sum(weight(f, 0.0) for f in features))
        scores = [self.known[path] + sum(weight(f, 0.0) for f in text_features(text, tag, linked)) for text, path, tag, linked in found]
        return [(x[0], label) for x, label in zip(found, self.field.viterbi(scores), strict=True)]

    def __call__(self, page: str) -> str:
        return "\n".join(text for text, article in self.labels(page) if article)


def extract(pages: DataFrame, column: str = "html", field: Field | None = None) -> DataFrame:
    """Every row of pages with text (the article's blocks, joined by line feeds) and n_chars (its code points); the page's own column is left out.

    A null or empty page, or one without an article, has an empty text; repeated rows each have a row, no rows give none. Character references are decoded, white space (that of
    str.split, no-break spaces too) inside a block becomes one space. Columns of pages named text or n_chars are replaced.
    """
    spark: SparkSession = pages.sparkSession
    batch_rows(spark, 1000)
    model = spark.sparkContext.broadcast(field or default_field())
    kept = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    held = pages.select((F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("string")).alias("_row"), F.col(f"`{column}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model.value)
        for batch in batches:
            for rows, _, _ in slices(batch, "html", 4 << 20):
                texts = [extractor(x) if x else "" for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["_row", "text", "n_chars"])

    out = held.mapInArrow(run, T.StructType([held.schema.fields[0], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "text", "n_chars")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; null and empty pages have an empty text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
