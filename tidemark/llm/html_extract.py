"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Two models score each block node: does its subtree hold main text, and is the
node itself inside it. The best consistent labelling then follows by dynamic
programming: below an excluded node all is excluded, and below a main node all
is main or excluded, so that no choice contradicts an ancestor's or descendant's.
The models are fitted here, on generated pages of many layouts.
"""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boosting
from tidemark.llm.common import ROW, clean_text, packed, small_batches, unpacked

#: Generated pages that the models are fitted on.
TRAINING_PAGES = 500
SEED = 17

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object head title select option button textarea audio video canvas map".split())
#: Of these, the ones whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Start tags that end an open element of the same set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an end does not reach through.
WALLS = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote".split())

TAG_FEATURES = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "figure", "pre", "body"]
TOKEN_FEATURES = {
    "content": "article content main post entry story body text page paragraph prose".split(),
    "advert": "ad ads adv advert advertisement banner promo promotion sponsor sponsored dfp outbrain taboola".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip".split(),
    "side": "sidebar side rail related widget recommended trending popular more archive teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer".split(),
    "talk": "comment comments discussion reply replies respond disqus reader feedback thread".split(),
    "social": "share sharing social follow tweet facebook like buttons".split(),
    "edge": "header masthead footer foot bottom top copyright legal brand logo site".split(),
    "form": "form login signin signup search searchbox contact".split(),
    "credit": "meta byline author date tags tag categories caption".split(),
}
TOKEN_OF = {t: k for k, (_, words) in enumerate(TOKEN_FEATURES.items()) for t in words}
N_FEATURES = 2 * len(TAG_FEATURES) + 2 * len(TOKEN_FEATURES) + 19

#: A comment; a tag without angle brackets in its quotes; the start of any other tag; other markup. Nothing is read twice.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>|<(/?)([a-zA-Z][^\s/><"']*+)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_MARK = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class _Ends:
    """Where a tag ends whose quotes hold angle brackets: at the first `>` outside quotes; a quote that nothing closes is a character."""

    def __init__(self, source: str) -> None:
        self.at = [m.start() for m in _MARK.finditer(source)]
        n = len(self.at)
        self.end = [-1] * (n + 1)  # by mark, met outside quotes
        later: dict[str, int] = {}
        for i in range(n - 1, -1, -1):
            mark = source[self.at[i]]
            if mark == ">":
                self.end[i] = self.at[i]
            else:
                self.end[i] = self.end[later[mark] + 1] if mark in later else self.end[i + 1]
                later[mark] = i

    def after(self, place: int) -> int:
        return self.end[bisect_left(self.at, place)]


class Page:
    """Block nodes in page order, and text pieces with their node and block."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.tokens, self.links, self.attrs = ["#root"], [-1], [()], [0], [""]
        self.pieces: list[tuple[int, int, str, bool]] = []  # node, block, text, in a link
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones with their block's node
        block, at, links, silent = 0, 0, 0, 0
        lower = ends_of = None
        while m := _TOKEN.search(source, at):
            if m.start() > at and not silent:
                self.pieces.append((stack[-1][1], block, source[at : m.start()], links > 0))
            at = m.end()
            closing, name, raw = m[1], m[2], m[3]
            if m[5]:
                ends_of = ends_of or _Ends(source)
                end = ends_of.after(at)
                end = source.find(">", at) if end < 0 else end
                if end < 0:  # the page ends inside the tag
                    at = len(source)
                    break
                closing, name, raw, at = m[4], m[5], source[at:end], end + 1
            if not name:
                continue
            name = name.lower()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        closed = stack[k:]
                        del stack[k:]
                        links -= sum(t == "a" for t, _ in closed)
                        silent -= sum(t in SILENT for t, _ in closed)
                        if any(t not in INLINE for t, _ in closed):
                            block += 1
                        break
                    if stack[k][0] in WALLS and name in INLINE:
                        break
                continue
            if name == "br":
                if not silent:
                    self.pieces.append((stack[-1][1], block, " ", links > 0))
                continue
            inline = name in INLINE
            if not inline:
                block += 1
                ends = ENDS.get(name, ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends or stack[k][0] == "p":
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        if stack[-1][0] not in ends:
                            break
                    elif stack[k][0] in WALLS:
                        break
            if name in VOID:
                continue
            if name in RAW:
                lower = source.lower() if lower is None else lower
                end = lower.find(f"</{name}", at)
                at = len(source) if end < 0 else end
                if end >= 0:
                    at = source.find(">", end) + 1 or len(source)
                continue
            node = stack[-1][1]
            if name == "a":
                links += 1
                self.links[node] += 1
            if name in SILENT:
                silent += 1
            if not inline:
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.links.append(0)
                self.attrs.append(raw)
                self.tokens.append(self._tokens(raw) if raw else ())
            if not raw_self_closed(raw, inline):
                stack.append((name, node))
        if at < len(source) and not silent:
            self.pieces.append((stack[-1][1], block, source[at:], links > 0))

    @staticmethod
    @functools.lru_cache(maxsize=4096)
    def _tokens(raw: str) -> tuple[int, ...]:
        out = []
        for name, a, b, c in _ATTRIBUTE.findall(raw):
            if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                out += [TOKEN_OF[w] for w in _WORD.findall((a or b or c).lower()) if w in TOKEN_OF]
        return tuple(out)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        x = np.zeros((n, N_FEATURES))
        parent = np.array(self.parent)
        own = np.zeros((n, 6))  # characters, in links, stops, pieces, words, upper
        for node, _, text, linked in self.pieces:
            size = len(text)
            words = text.count(" ") + 1 if size > 1 else 0
            own[node] += (size, size * linked, text.count(".") + text.count(","), 1, words, 0)
        total = own.copy()
        count, links, paragraphs, forms = np.ones(n), np.array(self.links, float), np.array([t == "p" for t in self.tag], float), np.array([t in ("form", "table") for t in self.tag], float)
        depth, index, brothers = np.zeros(n), np.zeros(n), np.zeros(n)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
            index[k] = brothers[parent[k]]
            brothers[parent[k]] += 1
        for k in range(n - 1, 0, -1):
            p = parent[k]
            total[p] += total[k]
            count[p] += count[k]
            links[p] += links[k]
            paragraphs[p] += paragraphs[k]
            forms[p] += forms[k]
        tags = {t: j for j, t in enumerate(TAG_FEATURES)}
        a, b, c = len(TAG_FEATURES), 2 * len(TAG_FEATURES), 2 * len(TAG_FEATURES) + len(TOKEN_FEATURES)
        for k in range(1, n):
            p = parent[k]
            x[k, a:b] = np.maximum(x[p, a:b], x[p, :a])  # tags above
            x[k, c : c + len(TOKEN_FEATURES)] = x[p, c : c + len(TOKEN_FEATURES)] + x[p, b:c]  # tokens above
            if (j := tags.get(self.tag[k])) is not None:
                x[k, j] = 1
            for t in self.tokens[k]:
                x[k, b + t] += 1
        d = c + len(TOKEN_FEATURES)
        up = np.maximum(parent, 0)
        chars = np.maximum(total[:, 0], 1)
        rest = [
            np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 1] / chars, total[:, 2] / chars, links / chars * 100, count / chars * 100, paragraphs, forms, depth,
            index, brothers[up], (index + 1) / (brothers[up] + 1), total[:, 0] / max(1.0, total[0, 0]), total[:, 0] / np.maximum(total[up, 0], 1), total[:, 4] / np.maximum(count, 1),
            total[:, 0] / np.maximum(total[:, 3], 1), np.log1p(total[up, 0]), total[up, 1] / np.maximum(total[up, 0], 1), brothers,
        ]
        x[:, d:] = np.stack(rest, axis=1)
        return x

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """(holds, inside) by the marks of generated pages."""
        n = len(self.tag)
        inside, holds = np.zeros(n, bool), np.zeros(n, bool)
        for k in range(1, n):
            inside[k] = (inside[self.parent[k]] or "data-keep" in self.attrs[k]) and "data-drop" not in self.attrs[k]
        for k in range(n - 1, 0, -1):
            holds[k] |= inside[k]
            holds[self.parent[k]] |= holds[k]
        return holds, inside

    def decode(self, holds: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Main nodes of the best consistent labelling, given both log odds."""
        n = len(self.tag)
        log = lambda z: -np.logaddexp(0, -z)  # noqa: E731  of the probability
        # 0 excluded, 1 container (holds, not inside), 2 main
        best = np.stack([log(-holds) + log(-inside), log(holds) + log(-inside), log(holds) + log(inside)], axis=1)
        if n:
            best[0] = (-1e9, 0, -1e9)
        for k in range(n - 1, 0, -1):
            x, c, m = best[k]
            best[self.parent[k]] += (x, max(x, c, m), max(x, m))
        state = np.ones(n, np.int64)
        for k in range(1, n):
            above = state[self.parent[k]]
            x, c, m = best[k]
            state[k] = 0 if above == 0 else (2 if m >= x else 0) if above == 2 else int(np.argmax((x, c, m)))
        return state == 2

    def text(self, main: np.ndarray) -> str:
        out, now, parts = [], None, []
        for node, block, text, _ in self.pieces:
            if main[node]:
                if block != now:
                    out.append("".join(parts))
                    now, parts = block, []
                parts.append(text)
        out.append("".join(parts))
        return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in out) if x)


def raw_self_closed(raw: str, inline: bool) -> bool:
    return inline and raw.endswith("/")


def generated(seed: int) -> str:
    """A page of a random layout; data-keep marks its article, data-drop what is foreign in it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "an", "er", "lo", "mi", "ra", "se", "tu", "é", "ken")) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 20).capitalize() + "." for _ in range(r.randint(low, high)))

    def attribute(kind: str, plain: float = 0.25) -> str:
        if r.random() < plain:
            return ""
        token = r.choice(TOKEN_FEATURES[kind])
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("", "site-", "js-", "c-"))}{token}{r.choice(("", "-wrap", " block", "-1"))}"'

    def link_list(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def foreign() -> str:
        kind = r.choice(("advert", "menu", "side", "notice", "talk", "social", "form", "credit", "advert"))
        tag = {"menu": ("nav", "div"), "side": ("aside", "div"), "form": ("form", "div"), "talk": ("section", "div")}.get(kind, ("div", "div", "aside", "section"))
        body = {
            "advert": lambda: r.choice((words(3, 12), f"<p>{sentences(1, 2)}</p>", f'<a href="/x">{words(3, 9)}</a>')),
            "menu": lambda: link_list(r.randint(2, 9)),
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + r.choice((link_list(r.randint(2, 8)), f"<p>{sentences(1, 3)}</p>")),
            "notice": lambda: f"<p>{sentences(1, 3)}</p><button>{words(1, 2)}</button>",
            "talk": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(f'<div{attribute("talk")}><p>{sentences(1, 4)}</p></div>' for _ in range(r.randint(1, 6))),
            "social": lambda: link_list(r.randint(2, 5)),
            "form": lambda: f'<form><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button></form>',
            "credit": lambda: words(1, 6),
        }[kind]()
        t = r.choice(tag)
        return f'<{t}{attribute(kind, 0.0 if t in ("div", "section") else 0.4)} data-drop="1">{body}</{t}>'

    def paragraph() -> str:
        x = sentences(1, r.choice((1, 3, 8)))
        if r.random() < 0.15:
            x = f"<b>{x}" if r.random() < 0.4 else f"<em>{x}</em>"
        if r.random() < 0.15:
            x += f' <a href="/y">{words(1, 4)}</a> {words(2, 5)}.'
        return f"<p>{x}<br>" if r.random() < 0.1 else f"<p>{x}</p>"

    def article() -> str:
        if r.random() < 0.05:  # hardly any text, and the heading may say it again
            x = words(1, 3).capitalize() + "."
            parts = [f"<h1>{r.choice((x, words(1, 3)))}</h1>", f"<p>{x}</p>"]
            return '<article data-keep="1">' + "".join(parts) + "</article>"
        parts = [f"<h1>{words(3, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 4, 8, 15))):
            kind = r.random()
            if kind < 0.75:
                parts.append(paragraph())
            elif kind < 0.83:
                parts.append(f"<h2>{words(2, 6)}</h2>")
            elif kind < 0.90:
                t = r.choice(("ul", "ol"))
                parts.append(f"<{t}>" + "".join(f"<li>{words(3, 15)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{paragraph()}</blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                parts.append(f"<pre>{words(4, 20)}</pre>")
            if r.random() < 0.08:
                parts.append(foreign())
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        return f'<{tag}{attribute("content", 0.5 if tag in ("article", "main") else 0.1)} data-keep="1">' + "".join(parts) + f"</{tag}>"

    before, after = [], []
    if r.random() < 0.5:
        before.append(f'<header{attribute("edge")}><a href="/">{words(1, 3)}</a>' + (f"<nav>{link_list(r.randint(2, 7))}</nav>" if r.random() < 0.5 else "") + (f"<p>{words(2, 8)}</p>" if r.random() < 0.4 else "") + "</header>")
    if r.random() < 0.7:
        before.append(f"<nav>{link_list(r.randint(2, 10))}</nav>" if r.random() < 0.7 else f'<div{attribute("menu", 0)}>{link_list(r.randint(2, 9))}</div>')
    before += [foreign() for _ in range(r.randint(0, 3))]
    after += [foreign() for _ in range(r.randint(0, 4))]
    foot = f"&copy; {words(1, 3)} &middot; {words(2, 9)}."
    if r.random() < 0.9:
        after.append(f"<footer>{foot}</footer>" if r.random() < 0.6 else f'<div{attribute("edge", 0)}>{r.choice(("<p>%s</p>", "%s"))}</div>' % foot)
    middle = article()
    for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
        middle = f"<{(t := r.choice(('div', 'div', 'main', 'section')))}{attribute('content', 0.6)}>{middle}" + (foreign() if r.random() < 0.3 else "") + f"</{t}>"
    end = "</body></html>" if r.random() < 0.9 else ""
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(before) + middle + "".join(after) + end


@functools.lru_cache(maxsize=4)
def models(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[boosting.Boosted, boosting.Boosted]:
    """(holds, inside), fitted on `pages` generated pages."""
    xs, hs, ins = [], [], []
    for k in range(pages):
        page = Page(generated(seed * 100_003 + k))
        h, i = page.labels()
        xs.append(page.features()[1:])
        hs.append(h[1:])
        ins.append(i[1:])
    x = np.concatenate(xs)
    return boosting.fit(x, np.concatenate(hs)), boosting.fit(x, np.concatenate(ins))


def extract_all(sources: list[str], fitted: tuple[boosting.Boosted, boosting.Boosted]) -> list[str]:
    pages = [Page(s) for s in sources]
    sizes = np.cumsum([0, *(len(p.tag) for p in pages)])
    if not pages:
        return []
    x = np.concatenate([p.features() for p in pages])
    holds, inside = fitted[0].log_odds(x), fitted[1].log_odds(x)
    return [p.text(p.decode(holds[a:b], inside[a:b])) for p, a, b in zip(pages, sizes, sizes[1:], strict=False)]


def extract_main_text(df: DataFrame, html_col: str = "html", pages: int = TRAINING_PAGES, seed: int = SEED, batch: int = 128) -> DataFrame:
    """`df` with main_text (a column so named is replaced): the article of each page, its blocks joined by a line break.

    Character references are decoded, white space within a block is one space; a
    page without main text gives ''; null html is empty; markup that nothing closes ends with the page. Repeated
    rows are pages of their own, and an empty table stays empty. Every row is handled
    alone, whole, in batches of `batch` pages. The models (a few hundred kB at
    most) travel with the task.
    """
    fitted = models(pages, seed)
    rest = [c for c in df.columns if c.lower() != "main_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = extract_all(part.column(1).to_pylist(), fitted)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], [ROW, "main_text"])

    rows = small_batches(df).select(packed(df, rest), clean_text(html_col).alias("__html"))
    schema = rows.select(ROW).schema.add("main_text", "string")
    return rows.mapInArrow(run, schema).select(*unpacked(rest), "main_text")
