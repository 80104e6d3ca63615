"""Main text of web pages: gradient-boosted trees over elements, decoded along the tree.

Every element gets features of its subtree (text, links, density), of its tag and
attribute tokens and those above it, of its depth and of its siblings.  Boosted
regression trees, trained here on generated pages whose main text is known, give the
log-odds that an element holds main text.  Decoding then chooses the most likely set
of elements in which no element is kept under one that is dropped.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import markup
from tideline.llm.common import documents_columns, output_schema

# Training: generated pages, trees, their depth and step.
TRAIN_PAGES = 500
TREES = 40
DEPTH = 4
BINS = 32
STEP = 0.25
FEATURES = (
    "tag tag_low tag_high token_low token_high above_low above_high depth text own_text link_share density children place "
    "alike before after position share form_share").split()

# What the regions of generated pages are called, as "tag" or "tag.token".
_KEPT = ("article main div.content div.post section.article div.entry-content div#main-content div.article-body section.story "
         "div.text div.post-body div#content section div.page-content").split()
_DROPPED = {
    "menu": "nav ul.menu div.nav div.navbar div#navigation nav.main-nav div.breadcrumbs ul.nav div.menu".split(),
    "header": "header div.header div#header div.masthead header.site-header div.banner div.topbar".split(),
    "footer": "footer div.footer div#footer footer.site-footer div.copyright div.bottom".split(),
    "sidebar": "aside div.sidebar div#sidebar aside.related div.widget section.related div.recommended aside.side".split(),
    "notice": "div.notice div.cookie-notice div.cookie-banner div.alert p.notice div.consent div.gdpr section.notice div.popup div.message".split(),
    "advert": "div.ad div.ads div.advert div.advertisement div.sponsored div.promo aside.ad section.ad ins.adsbygoogle".split(),
    "form": "form form.search form.subscribe form.newsletter form.login div.form fieldset".split(),
    "comments": "section.comments div.comments div#comments ol.comment-list div.comment section.discussion div.responses ul.comments".split(),
    "share": "div.share ul.social div.social-links div.tags".split(),
}
_TOKENS = re.compile(r"[a-z]+")


@dataclass
class Model:
    """Trees as arrays, and the log-odds of tags and attribute tokens."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    base: float
    tags: dict[str, float]
    tokens: dict[str, float]


def _tokens(element: markup.Element) -> list[str]:
    if "=" not in element.attributes:
        return []
    given = markup.attributes_of(element.attributes)
    named = " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
    return _TOKENS.findall(named.lower())


def _features(page: markup.Page, tags: dict[str, float], tokens: dict[str, float]) -> np.ndarray:
    """A row of FEATURES per element."""
    elements = page.elements
    n = len(elements)
    own, text, links, forms = [0] * n, [0] * n, [0] * n, [0] * n
    first = [0] * n
    total = 0
    for element, piece in page.texts:
        own[element] += len(piece.strip())
    for i in range(n):
        first[i] = total
        total += own[i]
    for i in range(n - 1, -1, -1):
        e = elements[i]
        text[i] += own[i]
        if e.tag == "a":
            links[i] = text[i]
        if e.tag in ("input", "button", "select", "textarea", "label"):
            forms[i] += 1
        if e.parent >= 0:
            text[e.parent] += text[i]
            links[e.parent] += links[i]
            forms[e.parent] += forms[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[elements[i].parent].append(i)
    out: list[tuple[float, ...]] = []
    low, high = [0.0] * n, [0.0] * n
    above_low, above_high = [0.0] * n, [0.0] * n
    place = [(0, 1, 0, 0, 1)] * n
    for family in children:
        kinds: dict[str, int] = {}
        for i in family:
            kinds[elements[i].tag] = kinds.get(elements[i].tag, 0) + 1
        for k, i in enumerate(family):
            before = text[family[k - 1]] if k else 0
            after = text[family[k + 1]] if k + 1 < len(family) else 0
            place[i] = (k, len(family), before, after, kinds[elements[i].tag])
    for i, e in enumerate(elements):
        tag = tags.get(e.tag, 0.0)
        odds = [tokens[t] for t in _tokens(e) if t in tokens]
        token_low, token_high = min(odds, default=0.0), max(odds, default=0.0)
        up = e.parent
        if up >= 0:
            low[i], high[i] = min(low[up], tag), max(high[up], tag)
            above_low[i], above_high[i] = min(above_low[up], token_low), max(above_high[up], token_high)
        else:
            low[i] = high[i] = tag
        k, siblings, before, after, alike = place[i]
        inside = max(1, e.end - i)
        out.append((
            tag, low[i], high[i], token_low, token_high, above_low[i], above_high[i], e.depth,
            math.log1p(text[i]), math.log1p(own[i]), links[i] / text[i] if text[i] else 0.0,
            math.log1p(text[i] / inside), math.log1p(len(children[i])), k / siblings, alike / siblings,
            math.log1p(before), math.log1p(after), first[i] / total if total else 0.0,
            text[i] / total if total else 0.0, forms[i] / inside,
        ))
    return np.array(out)


def _log_odds(model: Model, rows: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaves for each row."""
    out = np.full(len(rows), model.base)
    at_row = np.arange(len(rows))
    for feature, split, value in zip(model.feature, model.split, model.value, strict=True):
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (rows[at_row, feature[node]] > split[node])
        out += value[node - (2 ** DEPTH - 1)]
    return out


def _boost(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trees by steepest descent of the logistic loss, on binned features."""
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = math.log(labels.mean() / (1 - labels.mean()))
    score = np.full(len(rows), base)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    all_features, all_splits, all_values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = labels - p, np.maximum(p * (1 - p), 1e-6)
        feature, split = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            for f in range(rows.shape[1]):
                key = (node - first) * BINS + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                gain = gs ** 2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain = gain[:, :max(1, len(edges[f]))]
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                if not len(edges[f]):
                    continue
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    feature[first + k], split[first + k] = f, edges[f][at[k]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > split[node])
        leaf = node - inner
        value = STEP * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + 1)
        score += value[leaf]
        all_features.append(feature)
        all_splits.append(split)
        all_values.append(value)
    return np.array(all_features), np.array(all_splits), np.array(all_values), base


class _PageMaker:
    """Pages with known main text; main pieces carry a mark that training strips."""

    MARK = "\x01"

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(1, 9)))
                        for _ in range(r.randint(low, high)))

    def element(self, name: str, inside: str, plain: bool = False) -> str:
        tag, _, token = name.replace("#", ".").partition(".")
        if not token or (plain and self.rng.random() < 0.5):
            return f"<{tag}>{inside}</{tag}>"
        key = "id" if "#" in name else "class"
        return f'<{tag} {key}="{token}">{inside}</{tag}>'

    def main(self, low: int = 1, high: int = 40) -> str:
        return f"{self.MARK}{self.words(low, high)}"

    def paragraph(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.62:
            inside = self.main(1, r.choice((3, 20, 80, 200)))
            if r.random() < 0.25:
                inside += f" <a href='#'>{self.main(1, 4)}</a> {self.main(1, 20)}"
            if r.random() < 0.2:
                inside = f"<b>{inside}<br>" if r.random() < 0.6 else f"<em>{inside}</em>"
            return f"<p>{inside}" + ("</p>" if r.random() < 0.8 else "")
        if kind < 0.72:
            return f"<h2>{self.main(1, 8)}</h2>"
        if kind < 0.8:
            items = "".join(f"<li>{self.main(1, 12)}</li>" for _ in range(r.randint(1, 6)))
            return f"<ul>{items}</ul>" if r.random() < 0.7 else f"<ol>{items}</ol>"
        if kind < 0.85:
            return f"<blockquote><p>{self.main(3, 40)}</p></blockquote>"
        if kind < 0.89:
            return f"<pre>{self.main(2, 30)}</pre>"
        if kind < 0.93:
            cells = "".join(f"<tr><td>{self.main(1, 5)}</td><td>{self.main(1, 5)}</td></tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{cells}</table>"
        if kind < 0.96:
            return f"<figure><img src='x'><figcaption>{self.main(2, 12)}</figcaption></figure>"
        return f"<div>{self.main(2, 60)}</div>"

    def dropped(self, kind: str) -> str:
        r = self.rng
        name = r.choice(_DROPPED[kind])
        link = lambda: f"<a href='/{self.words(1, 1)}'>{self.words(1, 3)}</a>"
        if kind in ("menu", "share"):
            items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
            inside = items if name.startswith("ul") else f"<ul>{items}</ul>" if r.random() < 0.8 else " | ".join(link() for _ in range(4))
        elif kind == "comments":
            item = lambda: f"<p>{self.words(1, 50)}</p>" if r.random() < 0.6 else f"<b>{self.words(1, 2)}</b> {self.words(2, 40)}"
            wrap = "li" if name[:2] in ("ol", "ul") else r.choice(("div", "article", "p"))
            inside = (f"<h3>{self.words(1, 2)}</h3>" if r.random() < 0.5 and wrap != "li" else "") + "".join(
                f"<{wrap}>{item()}</{wrap}>" for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inside = f"<label>{self.words(1, 4)}</label><input name='q'><button>{self.words(1, 2)}</button>"
            if r.random() < 0.5:
                inside = f"<p>{self.words(2, 20)}</p>{inside}"
        elif kind == "sidebar":
            inside = f"<h3>{self.words(1, 4)}</h3>" + (
                f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randint(2, 6)))}</ul>" if r.random() < 0.6 else f"<p>{self.words(5, 50)}</p>")
        elif kind == "header":
            inside = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>", self.words(1, 6), f"<p>{self.words(2, 10)}</p>"))
            if r.random() < 0.4:
                inside += self.dropped("menu")
        elif kind == "footer":
            inside = r.choice((f"&copy; {self.words(2, 20)}", f"<p>&copy; {self.words(2, 12)}</p>" + link(), self.words(3, 30)))
        else:
            inside = self.words(2, 40) if r.random() < 0.6 else f"<p>{self.words(2, 40)}</p>"
            if r.random() < 0.3:
                inside += f"<button>{self.words(1, 2)}</button>"
        return self.element(name, inside)

    def page(self) -> str:
        r = self.rng
        parts = [self.paragraph() for _ in range(r.choice((0, 1, 3, 6, 12)))]
        for kind in ("advert", "sidebar", "share", "form", "notice", "comments", "menu", "header", "footer"):
            if r.random() < 0.14:
                at = len(parts) if kind in ("comments", "footer") else 0 if kind == "header" else r.randint(0, len(parts))
                parts.insert(at, self.dropped(kind))
        title = f"<h1>{self.main(1, 10)}</h1>" if r.random() < 0.85 or not parts else ""
        kept = self.element(r.choice(_KEPT), title + "".join(parts), plain=True)
        if r.random() < 0.25:
            kept = self.element(r.choice(("main", "div.wrapper", "div.container", "div", "section")), kept)
        before = [self.dropped(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar")
                  if r.random() < (0.6 if k in ("header", "menu") else 0.25)]
        after = [self.dropped(k) for k in ("comments", "sidebar", "advert", "share", "notice", "form", "menu", "footer")
                 if r.random() < (0.7 if k == "footer" else 0.25)]
        body = "".join(before) + kept + "".join(after)
        if r.random() < 0.2:
            body = f"<div class='page'>{body}</div>"
        page = (f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style>"
                f"<script>var a = '</p>';</script></head><body>{body}</body></html>")
        return page[: r.randint(len(page) * 2 // 3, len(page))] if r.random() < 0.08 else page


@lru_cache(maxsize=1)
def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Model:
    """The model of a fixed number of generated pages."""
    rng = random.Random(seed)
    maker = _PageMaker(rng)
    read = []
    for _ in range(pages):
        page = markup.read(maker.page())
        labels = np.zeros(len(page.elements))
        for element, text in page.texts:
            if maker.MARK in text:
                while element >= 0 and not labels[element]:
                    labels[element] = 1
                    element = page.elements[element].parent
        page.texts = [(e, t.replace(maker.MARK, "")) for e, t in page.texts]
        read.append((page, labels))
    counts: dict[tuple[str, str], list[float]] = {}
    for page, labels in read:
        for element, label in zip(page.elements, labels, strict=True):
            # Wrappers say little; what counts is whether a name goes with main text.
            for key in (("tag", element.tag), *(("token", t) for t in set(_tokens(element)))):
                counts.setdefault(key, [0.5, 0.5])[int(label)] += 1
    odds = {key: math.log(c[1] / c[0]) for key, c in counts.items()}
    tags = {name: v for (kind, name), v in odds.items() if kind == "tag"}
    tokens = {name: v for (kind, name), v in odds.items() if kind == "token"}
    rows = np.concatenate([_features(page, tags, tokens) for page, _ in read])
    labels = np.concatenate([y for _, y in read])
    feature, split, value, base = _boost(rows, labels)
    return Model(feature, split, value, base, tags, tokens)


def decode(page: markup.Page, log_odds: np.ndarray) -> list[bool]:
    """The likeliest choice in which an element is kept only under kept ones.

    Bottom up, an element's kept value is its log-odds and what its children add if
    kept; top down, a child stays where that is positive.
    """
    n = len(page.elements)
    gain = log_odds.tolist()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.elements[i].parent] += gain[i]
    keep = [False] * n
    keep[0] = True
    for i in range(1, n):
        keep[i] = gain[i] > 0 and keep[page.elements[i].parent]
    return keep


def main_texts(sources: list[str], model: Model) -> list[str]:
    """Main text of each page, blocks parted by an empty line; '' if there is none."""
    pages = [markup.read(s) for s in sources]
    if not pages:
        return []
    rows = [_features(p, model.tags, model.tokens) for p in pages]
    odds = np.split(_log_odds(model, np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    return ["\n\n".join(markup.blocks(p, decode(p, o))) for p, o in zip(pages, odds, strict=True)]


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts([v.as_py() or "" for v in batch.column("html")], model.value)
            names = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())],
                                             names=[*names, "text"])

    return run


def extract(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and main text of each row's html.

    Null html is an empty page, whose text is empty; repeated rows give a row each;
    other columns than keys and html are not read.  A page is read whole.
    """
    rows = documents_columns(pages, [*keys, "html"])
    return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(train())),
                           output_schema(rows, keys, "text string"))
