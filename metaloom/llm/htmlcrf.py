"""HTML main text: a linear-chain conditional random field over DOM leaf blocks.

Each block of a page is labelled as content or not.  Features are the tags and the names in class, id and role of its
ancestors, and the shape of its text; transitions depend on whether two blocks have the same parent.  The field is
trained on labelled pages by the gradient of its likelihood (forward-backward over all pages at once) and decoded by
Viterbi.  Labelled pages carry ``data-content`` on the
elements that are content, and ``data-content="no"`` on parts of them that are not; ``labelled_pages`` makes such pages
from a grammar of layouts, and ``train`` takes any.

Results for odd input.  A null or empty page, or one without content, has an empty text.  Broken markup gives the
blocks that the usual repairs give; an unclosed comment or script runs to the end.  Repeated rows are rows of their
own; null ids and urls stay null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import small_batches
from metaloom.llm.dom import Block, blocks

#: Roots of names that say what an element holds (fixed values, common usage on the web).
ROOTS = "nav menu foot head side comment repl discuss cookie consent gdpr notice alert banner advert sponsor promo share social relat recommend newsletter subscrib signup form login search breadcrumb pag widget copyright legal popup modal skip article content post entry story main body text".split()
#: Words of a text that say what it is (fixed values).
CUES = "© copyright cookie cookies subscribe newsletter login sign advertisement sponsored share reply comment comments privacy menu search".split()
_NAME = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END = frozenset(".!?…:;\"”»)")


@functools.lru_cache(maxsize=1 << 16)
def names_of(raw: str) -> tuple[str, ...]:
    out = set()
    for n in _NAME.findall(raw):
        n = n.lower()
        out.add(f"n:{n}")
        out.update(f"r:{r}" for r in ROOTS if len(n) > len(r) and r in n)
    return tuple(sorted(out))


def chain_features(chain: tuple, known: dict, among: dict | None = None) -> frozenset[str]:
    """The features of a block's ancestors; shared between the blocks of an element.  Of a trained field only those that
    it has, so that a set is no larger than the field, however deep the element stands."""
    todo = []
    while chain[0] is not None and id(chain) not in known:
        todo.append(chain)
        chain = chain[0]
    got = known[id(chain)][1] if id(chain) in known else frozenset()
    for x in reversed(todo):
        own = {f"t:{x[1]}"}
        if x[1] not in ("html", "body"):
            own.update(names_of(x[2]))
        if among is not None:
            own &= among.keys()
        got = got if own <= got else got | own
        known[id(x)] = (x, got)
    return got


def text_features(b: Block) -> list[str]:
    words = b.text.split(" ")
    n, share = len(words), b.linked / max(1, len(b.text))
    out = ["bias", f"len:{sum(n > x for x in (2, 7, 19, 49))}", f"link:{sum(share > x for x in (0, 0.3, 0.7))}", f"leaf:{b.chain[1] or 'body'}"]
    out.append("stop" if b.text[-1] in _END else "nostop")
    if n <= 40:
        low = b.text.lower()
        out += [f"cue:{c}" for c in CUES if c in low]
    return out


class Field:
    """Weights of the features for content (against other), and of transitions by (same parent, from, to)."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, first: float):
        self.weights, self.moves, self.first = weights, moves, first

    def emissions(self, found: list[Block]) -> list[float]:
        known: dict = {}
        sums: dict[frozenset, float] = {}
        get, out = self.weights.get, []
        for b in found:
            f = chain_features(b.chain, known, self.weights)
            if f not in sums:
                sums[f] = sum(get(x, 0.0) for x in sorted(f))
            out.append(sums[f] + sum(get(x, 0.0) for x in text_features(b)))
        return out

    def decode(self, found: list[Block]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        if not found:
            return []
        scores = self.emissions(found)
        best, back = [0.0, self.first + scores[0]], []
        for k in range(1, len(found)):
            m = self.moves[int(found[k].chain[0] is found[k - 1].chain[0])]
            step, new = [], []
            for y in (0, 1):
                a, b = best[0] + m[0][y], best[1] + m[1][y]
                step.append(int(b > a))
                new.append(max(a, b) + (scores[k] if y else 0.0))
            back.append(step)
            best = new
        y = int(best[1] > best[0])
        labels = [y]
        for step in reversed(back):
            y = step[y]
            labels.append(y)
        return [bool(x) for x in reversed(labels)]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def is_marked(chain: tuple) -> bool:
    """The nearest mark decides: a part of the content that is none has data-content="no"."""
    while chain[0] is not None:
        if chain[3] is not None:
            return chain[3]
        chain = chain[0]
    return False


def train(pages: list[str], steps: int = 100, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood over pages whose content elements carry data-content, with a Gaussian prior."""
    found = [x for x in (blocks(p) for p in pages) if x]
    index: dict[str, int] = {}
    rows, cols = [], []
    P, L = len(found), max(map(len, found))
    y, live, same = np.zeros((P, L), int), np.zeros((P, L), bool), np.zeros((P, L), int)
    for i, page in enumerate(found):
        known: dict = {}
        for k, b in enumerate(page):
            feats = [*chain_features(b.chain, known), *text_features(b)]
            cols += [index.setdefault(f, len(index)) for f in sorted(feats)]
            rows += [i * L + k] * len(feats)
            y[i, k], live[i, k] = is_marked(b.chain), True
            same[i, k] = k > 0 and b.chain[0] is page[k - 1].chain[0]
    rows_, cols_ = np.array(rows), np.array(cols)
    w, moves, first = np.zeros(len(index)), np.zeros((2, 2, 2)), 0.0
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves, np.zeros(1))]

    def logsum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = np.zeros((P, L, 2))
        e[:, :, 1] = np.bincount(rows_, weights=w[cols_], minlength=P * L).reshape(P, L)
        e[:, 0, 1] += first
        a, b = np.zeros((P, L, 2)), np.zeros((P, L, 2))
        a[:, 0] = e[:, 0]
        for k in range(1, L):
            a[:, k] = np.where(live[:, k, None], logsum(a[:, k - 1, :, None] + moves[same[:, k]], 1) + e[:, k], a[:, k - 1])
        for k in range(L - 1, 0, -1):
            b[:, k - 1] = np.where(live[:, k, None], logsum(moves[same[:, k]] + (e[:, k] + b[:, k])[:, None, :], 2), 0.0)
        z = logsum(np.where(live[:, :, None], a + b, 0)[np.arange(P), 0], 1)
        gap = (y - np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])) * live
        gm = np.zeros((2, 2, 2))
        for k in range(1, L):
            joint = np.exp(a[:, k - 1, :, None] + moves[same[:, k]] + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None]) * live[:, k, None, None]
            np.add.at(gm, same[:, k], -joint)
            on = live[:, k]
            np.add.at(gm, (same[on, k], y[on, k - 1], y[on, k]), 1)
        grads = [np.bincount(cols_, weights=gap.reshape(-1)[rows_], minlength=len(index)) / P - decay * w, gm / P - decay * moves, np.array([gap[:, 0].sum() / P])]
        for x, g, s in zip((w, moves, None), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            d = rate * (1 - step / (steps + 1)) * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-6)
            if x is None:
                first += float(d[0])
            else:
                x += d
    return Field({f: float(w[i]) for f, i in index.items()}, moves, first)


# Labelled pages: a grammar of layouts with invented text.

_SYLLABLES = "an ber ca de el fo gri ha in jo ka lu mi no or pe qua ri sol ta um ver wi xa yo zen".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        ws = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(a, b))]
        return " ".join(ws)

    def sentence(self, a=4, b=18) -> str:
        return self.words(a, b).capitalize() + self.r.choice("...!?")

    def text(self, a=1, b=6) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(a, b)))
        if self.r.random() < 0.3:
            w = out.split(" ")
            k = self.r.randrange(len(w))
            w[k] = self.r.choice([f"<b>{w[k]}</b>", f"<i>{w[k]}</i>", f'<a href="/x">{w[k]}</a>', f"<span>{w[k]}</span>"])
            out = " ".join(w)
        return out

    def box(self, names: str, tags: str, inner: str, extra: str = "") -> str:
        tag, name = self.r.choice(tags.split()), self.r.choice(names.split())
        kind = self.r.choice(["class", "class", "id"])
        if tag != "div" and self.r.random() < 0.6:
            return f"<{tag}{extra}>{inner}</{tag}>"
        glue = self.r.choice(["", "", "-box", " wide", "_1", "-wrapper", " clearfix"])
        return f'<{tag} {kind}="{name}{glue}"{extra}>{inner}</{tag}>'

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(a, b))]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if form < 0.8 else " ").join(items)

    def off(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.box("nav menu navbar navigation main-menu topnav breadcrumbs breadcrumb", "nav nav div ul", self.links(3, 9))
        if kind == "header":
            inner = r.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1><p>{self.words(3, 8)}</p>", f"<div>{self.words(1, 3)}</div>"])
            return self.box("header site-header masthead top page-header", "header div", inner + (self.off("nav") if r.random() < 0.3 else ""))
        if kind == "footer":
            inner = r.choice([f"&copy; {self.words(1, 4)}", f"&copy; 2024 {self.words(1, 3)} &middot; {self.sentence()}", f"<p>{self.sentence()}</p>" + self.links(2, 6), f"<p>Copyright {self.words(1, 5)}</p>"])
            return self.box("footer site-footer bottom page-footer colophon", "footer footer div", inner)
        if kind == "side":
            inner = "".join(r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}", f"<p>{self.text(1, 2)}</p>", f"<div>{self.words(2, 9)}</div>"]) for _ in range(r.randint(1, 3)))
            return self.box("sidebar side aside widget widget-area right-column left-col rail related recommended most-read", "aside aside div section", inner)
        if kind == "ad":
            inner = r.choice([self.sentence(), self.text(1, 2), f"<p>{self.sentence()}</p>", f"<a href='/ad'>{self.words(2, 8)}</a>", f"<span>Advertisement</span> {self.sentence()}"])
            return self.box("ad ads advert advertisement sponsor sponsored promo banner adbox ad-slot google-ad promotion", "div div section aside", inner)
        if kind == "notice":
            inner = r.choice([f"<p>{self.text(1, 2)}</p>", self.text(1, 2) + f"<button>{self.words(1, 2)}</button>", f"<p>We use cookies. {self.sentence()}</p><button>OK</button>"])
            return self.box("cookie cookies cookie-banner consent gdpr notice notification alert popup modal overlay cookie-notice message newsletter subscribe", "div div section dialog", inner)
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input type='text'><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.5 else "")
            return self.box("form search login signup contact-form newsletter-form subscribe", "form", inner)
        if kind == "share":
            return self.box("share social sharing share-buttons tags pagination pager post-meta", "div ul p", self.links(2, 5) if r.random() < 0.7 else self.words(1, 4))
        if kind == "comments":
            one = lambda: self.box("comment comment-body reply user-comment response", "div li article section", f"<b>{self.words(1, 2)}</b><p>{self.text(1, 3)}</p>" + (f"<a href='#'>{self.words(1, 1)}</a>" if r.random() < 0.5 else ""))
            inner = (f"<h3>{self.words(1, 2)}</h3>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 5))) + (self.off("form") if r.random() < 0.3 else "")
            return self.box("comments comment-list discussion responses replies reader-comments disqus", "div section section ol aside", inner)
        return "<script>var a = '<p>no</p>';</script><style>p{margin:0}</style>"

    def article(self) -> str:
        r, out = self.r, []
        for k in range(r.randint(1, 9)):
            x = r.random()
            if k == 0 and r.random() < 0.8:
                out.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(self.words(2, 9)))
            if x < 0.70:
                out.append(f"<p>{self.text()}</p>" if r.random() < 0.9 else f"<p><b>{self.sentence()}<br><p>{self.text()}</p>")
            elif x < 0.76:
                h = f"h{r.randint(2, 4)}"
                out.append(f"<{h}>{self.words(1, 7)}</{h}>")
            elif x < 0.83:
                h = r.choice(["ul", "ol"])
                out.append(f"<{h}>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(r.randint(2, 5))) + f"</{h}>")
            elif x < 0.87:
                out.append(f"<blockquote>{self.text(1, 2)}</blockquote>")
            elif x < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.92:
                out.append(f"<pre>{self.words(3, 12)}</pre>")
            elif x < 0.94:
                out.append(f"<figure><img src='x'><figcaption>{self.words(3, 9)}</figcaption></figure>")
            elif x < 0.96:
                out.append(f"<div>{self.text()}</div>")
            else:
                out.append(f"<p>{self.words(1, 3)}</p>")
            if r.random() < 0.09:
                out.append(self.set_off(r.choice(["ad", "ad", "side", "share", "notice", "form"])))
        return "".join(out)

    def set_off(self, kind: str) -> str:
        return regex.sub(r"^<(\w+)", r'<\1 data-content="no"', self.off(kind))

    def page(self) -> str:
        r = self.r
        inner = self.article()
        main = self.box("article content post entry story main article-body post-content entry-content text body-text main-content page-content", "article article div div main section", inner, " data-content")
        if r.random() < 0.35:
            main = self.box("container main wrapper page content-area layout site-content", "main div div", main + (self.off("comments") if r.random() < 0.4 else "") + (self.off("share") if r.random() < 0.3 else "") + (self.off("side") if r.random() < 0.3 else ""))
        top = [self.off(k) for k in ("notice", "header", "nav", "ad", "form", "script") if r.random() < (0.6 if k in ("header", "nav") else 0.35)]
        if r.random() < 0.2:
            r.shuffle(top)
        low = [self.off(k) for k in ("share", "comments", "ad", "side", "form", "notice") if r.random() < 0.3] + [self.off("footer") for _ in range(r.random() < 0.8)]
        body = r.choice(["", ' class="home page"', ' class="has-sidebar single-post"'])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body{body}>{''.join(top)}{main}{''.join(low)}</body></html>"

    def short_page(self) -> str:
        """A few words in an article, in a plain block, or in the body itself, often with nothing around them."""
        r = self.r
        texts = [r.choice([self.words(1, 3), self.words(2, 5).capitalize(), self.sentence(1, 4), self.text(1, 2)]) for _ in range(r.choice([1, 1, 1, 1, 2, 3]))]
        form, mark = r.random(), ""
        if form < 0.4:
            inner = "".join(f"<p>{t}</p>" for t in texts)
            main = self.box("article content post entry story main", "article main main div", inner, " data-content")
        elif form < 0.8:
            main = "".join(f"<{t} data-content>{x}</{t}>" for x in texts for t in [r.choice(["p", "p", "p", "div", "h1"])])
        else:
            main, mark = texts[0], " data-content"
        around = r.choice([(), (), ("nav",), ("footer",), ("header", "footer"), ("nav", "footer"), ("notice",), ("script",)])
        top, low = ("".join(self.set_off(k) for k in around if (k == "footer") is last) for last in (False, True))
        return f"<html><body{mark}>{top}{main}{low}</body></html>"


def labelled_pages(n: int = 400, seed: int = 9) -> list[str]:
    """Pages with data-content on their content; one in five is short."""
    maker, brief = _Maker(seed), _Maker(seed + 1)
    return [brief.short_page() if k % 5 == 4 else maker.page() for k in range(n * 5 // 4)]


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page."""
    small_batches(pages.sparkSession)
    field = field or default_field()

    def run(batches):
        for pdf in batches:
            texts = [field.extract(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
