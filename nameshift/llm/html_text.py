"""Main text of HTML pages by a tree-structured graphical model.

Method: every block of a page's DOM is a variable with the states boilerplate, content, and frame (what only holds other
blocks). Node potentials are likelihoods of the words of its class, id and role, of its link share and of its amounts of
text; edge potentials say how a block's state follows its parent's, by tag. Sum-product messages pass from the leaves up
and from the root down, and a line of text belongs to the article if its block's content marginal is over one half. All
potentials are smoothed counts over labelled pages.

The labelled pages are generated by ``labelled_pages``, ``PAGES`` of them, which bounds the training.

Defined results: a null or empty page has empty text; so has a page without content. Scripts, styles and
forms' controls never count; formulae and what stands in for media run inside their line, and hidden elements are judged like others. Repeated rows give equal texts. Null keys and urls stay. An empty table gives an empty
result. Other columns are not read. References that HTML does not know stay as they are.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from nameshift.llm.dom import Tree, parse
from nameshift.llm.frames import longs, map_text

PAGES, SEED, SMOOTHING = 1500, 7, 0.5
FROM = 0.5
#: Lengths of neighbouring blocks go together, so their likelihoods count for less.
TEXT_WEIGHT = 0.3
BOILERPLATE, CONTENT_STATE, FRAME = 0, 1, 2
STATES = (BOILERPLATE, CONTENT_STATE, FRAME)

#: Containers in labelled pages. A name is a tag, then words of its class.
CONTENT = "article article article main main div.main div.content div.main-content div.post div.entry div.entry-content div.article-body div.story div.text section.body section.article div.page-content div"
MENUS = "nav ul.menu div.menu div.nav div.navbar div.navigation ul.breadcrumb div.breadcrumbs div.toc div.pagination div.tabs ul.links"
HEADERS = "header div.header div.masthead div.topbar div.site-header div.logo div.branding"
FOOTERS = "footer div.footer div.copyright div.legal div.site-footer div.colophon section.footer"
ASIDES = "aside div.sidebar div.side div.related div.recommended div.widget div.trending div.popular section.more div.tags div.share div.social div.author-bio"
NOTICES = "div.cookie div.cookie-banner div.notice div.consent div.alert div.popup div.modal div.newsletter div.subscribe div.paywall div.banner section.gdpr div.disclaimer"
ADVERTS = "div.ad div.ads div.advert div.advertisement div.sponsored div.promo div.sponsor aside.ad section.promotion div.commercial ins.adsbygoogle"
FORMS = "form form.search form.login div.login div.search form.contact"
COMMENTS = "div.comments section.comments div.comment-list ol.commentlist div.disqus div.respond div.replies div.discussion div.reviews div.responses"


def _open(name: str, label: int, extra: str = "") -> tuple[str, str]:
    tag, _, words = name.partition(".")
    role = f' class="{words}"' if words else ""
    return f'<{tag}{role}{extra} data-label="{label}">', f"</{tag}>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages whose blocks carry ``data-label``; blocks without one have their parent's label."""
    r = random.Random(seed)
    pick = lambda names: r.choice(names.split())
    prose = lambda a, b: " ".join("word" + "s" * r.randint(0, 5) for _ in range(round(math.exp(r.uniform(math.log(a), math.log(b))))))

    def body(k: int) -> str:
        out = [f"<h1>{prose(2, 12)}</h1>"] if r.random() < 0.7 else []
        for _ in range(k):
            kind = r.random()
            if kind < 0.62:
                out.append(f"<p>{prose(1, 200)}</p>")
            elif kind < 0.7:
                out.append(f"<p>{prose(5, 40)} <a href=x>{prose(1, 4)}</a> {prose(3, 30)}</p>")
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{prose(1, 40)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<h{r.randint(2, 4)}>{prose(1, 8)}</h2>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{prose(1, 50)}</p></blockquote>")
            elif kind < 0.9:
                out.append(f"<pre>{prose(5, 40)}</pre>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{prose(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f"<section><h2>{prose(1, 6)}</h2><p>{prose(5, 80)}</p></section>")
        return "".join(out)

    def menu() -> str:
        a, b = _open(pick(MENUS), 0)
        items = "".join(f"<li><a href=x>{prose(1, 3)}</a></li>" for _ in range(r.randint(2, 9)))
        return a + (items if a.startswith("<ul") else f"<ul>{items}</ul>") + b

    def small(names: str, low: int, high: int) -> str:
        a, b = _open(pick(names), 0)
        inner = prose(low, high)
        kind = r.random()
        if names is HEADERS and r.random() < 0.4:
            inner = f"<h1>{prose(1, 5)}</h1>"
        return a + (inner if kind < 0.4 else f"<p>{inner}</p>" if kind < 0.8 else f"<h3>{prose(1, 4)}</h3><ul><li><a href=x>{inner}</a></li><li>{prose(1, 6)}</li></ul>") + b

    def comments() -> str:
        a, b = _open(pick(COMMENTS), 0)
        wrap = r.choice(["div.comment", "li.comment", "article.comment", "div", "p", "li", "div.reply"])
        each = "".join("".join((_open(wrap, 0)[0], f"<p>{prose(1, 100)}</p>" if wrap != "p" else prose(1, 100), _open(wrap, 0)[1])) for _ in range(r.choice((1, 2, 4, 8, 16))))
        return f"{a}<h2>{prose(1, 3)}</h2>{each}{b}"

    def anonymous(inner: str, label: int) -> str:
        """Wrappers that say nothing, around a part of the page."""
        for _ in range(r.choice((1, 1, 2, 3, 5, 8))):
            name = "".join(r.choice("bcdfghjkmnpqrstvwxz0123456789") for _ in range(r.randint(2, 8)))
            role = r.choice(("", f' class="{name}"', f' class="x{name} y{name}"', f' id="{name}"'))
            inner = f'<div{role} data-label="{label}">{inner}</div>'
        return inner

    def laid_out(before: list[str], article: str, after: list[str], label: int) -> str:
        """A table with the article in one cell and the rest in others."""
        cell = lambda inner, state: f'<td data-label="{state}">{inner}</td>'
        row = lambda cells: f'<tr data-label="{FRAME}">{cells}</tr>'
        if r.random() < 0.5:
            before = [*before, r.choice((" ", " | ", "<br>")).join(f"<a href=x>{prose(1, 3)}</a>" for _ in range(r.randint(2, 9)))]
        left, right = [cell(x, BOILERPLATE) for x in before], [cell(x, BOILERPLATE) for x in after]
        rows = row("".join(left) + cell(article, label) + "".join(right)) if r.random() < 0.6 else "".join(row(c) for c in (*left, cell(article, label), *right))
        return f'<table data-label="{FRAME}">{rows}</table>'

    pages = []
    for _ in range(n):
        a, b = _open(pick(CONTENT), 1)
        if r.random() < 0.25:
            c, d = _open(pick(CONTENT), 1)
            a, b = a + c, d + b
        inner = body(r.choice((1, 2, 3, 5, 8, 12, 20, 40)))
        inside = [f() for f, p in ((lambda: small(ADVERTS, 3, 25), 0.2), (lambda: small(ASIDES, 3, 30), 0.2), (comments, 0.2), (lambda: small(NOTICES, 4, 30), 0.1), (menu, 0.1), (lambda: small(FORMS, 1, 8), 0.1)) if r.random() < p]
        if r.random() < 0.15:
            inner = f"<header>{inner[: inner.find('</h1>') + 5]}</header>{inner[inner.find('</h1>') + 5 :]}" if "</h1>" in inner else inner
        bare = r.random() < 0.15  # the article's blocks lie in the body or a frame
        parts = [inner + "".join(inside) if bare else a + inner + "".join(inside) + b]
        before = [f() for f, p in ((lambda: small(HEADERS, 1, 12), 0.5), (menu, 0.8), (lambda: small(ADVERTS, 3, 30), 0.5), (lambda: small(NOTICES, 5, 40), 0.4), (lambda: small(FORMS, 1, 8), 0.2)) if r.random() < p]
        after = [f() for f, p in ((lambda: small(ASIDES, 3, 60), 0.5), (comments, 0.4), (lambda: small(ADVERTS, 3, 30), 0.3), (lambda: small(NOTICES, 5, 40), 0.2), (menu, 0.2), (lambda: small(FOOTERS, 3, 25), 0.9)) if r.random() < p]
        r.shuffle(before)
        style = r.random()
        if style < 0.25:
            parts = [anonymous("".join(parts), CONTENT_STATE if bare else FRAME)]
            bare = False
        if style < 0.05 or 0.25 < style < 0.35:
            page = laid_out(before, "".join(parts), after, CONTENT_STATE if style >= 0.25 else FRAME)
            bare = False
        else:
            page = "".join([*before, *parts, *after])
        if style < 0.1 or 0.6 < style < 0.7:
            page = anonymous(page, CONTENT_STATE if bare else FRAME)
        frame = CONTENT_STATE if bare else FRAME
        if r.random() < 0.4:
            c, d = _open(r.choice(["div.wrapper", "div.container", "main", "div.row", "div.page", "div"]), frame)
            page = c + page + d
        if r.random() < 0.1:
            pages.append(f'<html data-label="1">{inner}' if r.random() < 0.7 else f'<html data-label="1">{prose(1, 200)}')
            continue
        if r.random() < 0.15:
            pages.append(f'<html data-label="{frame}">{page}')
            continue
        pages.append(f'<html data-label="{frame}"><body data-label="{frame}">{page}</body></html>')
    return pages


def node_features(tree: Tree) -> list[list[str]]:
    """Names of the features of each block."""
    n = len(tree.tags)
    text, linked, kids = tree.text[:], tree.linked[:], [0] * n
    for i in range(n - 1, 0, -1):
        kids[tree.parents[i]] += 1
        text[tree.parents[i]] += text[i]
        linked[tree.parents[i]] += linked[i]
    out = []
    for i in range(n):
        share = linked[i] / text[i] if text[i] else 0
        own = [*(f"name {w}" for w in tree.names[i]), f"links {round(4 * share)}", "named" if tree.names[i] else "plain"]
        own.append(f"kids {min(kids[i].bit_length(), 4)}")
        if not kids[i]:
            own.append(f"text {min(text[i].bit_length() // 3, 3)}")
        own.append("inked" if tree.text[i] else "blank")
        out.append(own)
    return out


def inherited(tree: Tree) -> list[int]:
    labels: list[int] = []
    for i, own in enumerate(tree.labels):
        labels.append(own if own is not None else FRAME if i == 0 else labels[tree.parents[i]])
    return labels


def normal(v: list[float]) -> list[float]:
    total = sum(v)
    return [x / total for x in v]


@dataclass
class Potentials:
    """Log-likelihoods of features by tag and state, and joint probabilities of a child's tag and state by its parent's state."""

    features: dict[tuple[str, str], tuple[float, ...]]
    edges: dict[str, list[list[float]]]
    any_edge: list[list[float]]
    root: list[float]

    @staticmethod
    def fit(pages: list[str]) -> Potentials:
        seen, edges, totals, roots = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            tree = parse(page, labelled=True)
            states = inherited(tree)
            roots[states[0]] += 1
            for i, names in enumerate(node_features(tree)):
                for tag in (tree.tags[i], "*"):
                    totals[tag, states[i]] += 1
                    for f in names:
                        seen[tag, f, states[i]] += 1
                if i:
                    up = states[tree.parents[i]]
                    for tag in (tree.tags[i], "*"):
                        edges[tag, up, states[i]] += 1
        k = SMOOTHING
        known = {f for _, f, _ in seen}
        back = {f: [(seen["*", f, s] + k) / (totals["*", s] + 2 * k) for s in STATES] for f in known}
        likely = {("*", f): tuple(math.log(p) for p in back[f]) for f in known}
        for tag in {t for t, _, _ in seen} - {"*"}:
            for f in known:
                likely[tag, f] = tuple(math.log((seen[tag, f, s] + back[f][s]) / (totals[tag, s] + 1)) for s in STATES)
        under = {up: sum(edges["*", up, s] for s in STATES) + 1 for up in STATES}
        any_edge = [normal([edges["*", up, s] + k for s in STATES]) for up in STATES]
        rows = lambda tag: [[(edges[tag, up, s] + k * any_edge[up][s]) / under[up] for s in STATES] for up in STATES]
        return Potentials(likely, {t: rows(t) for t in {t for t, _, _ in edges} - {"*"}}, any_edge, normal([roots[s] + k for s in STATES]))

    def marginals(self, tree: Tree) -> list[float]:
        """The probability of content of every block, by messages up the tree and then down."""
        n = len(tree.tags)
        belief: list[list[float]] = []
        for tag, names in zip(tree.tags, node_features(tree), strict=True):
            a = b = c = 0.0
            for f in names:
                x, y, z = self.features.get(("*", f) if f.startswith("name ") else (tag, f)) or self.features.get(("*", f), (0.0, 0.0, 0.0))
                weight = TEXT_WEIGHT if f.startswith("text ") else 1.0
                a, b, c = a + weight * x, b + weight * y, c + weight * z
            top = max(a, b, c)
            belief.append([math.exp(max(x - top, -60.0)) for x in (a, b, c)])
        belief[0] = [x * y for x, y in zip(belief[0], self.root, strict=True)]
        edge = [self.edges.get(t, self.any_edge) for t in tree.tags]
        up: list[list[float]] = [[]] * n
        for i in range(n - 1, 0, -1):
            a, b, c = belief[i]
            up[i] = normal([x * a + y * b + z * c for x, y, z in edge[i]])
            parent = tree.parents[i]
            belief[parent] = normal([x * y for x, y in zip(belief[parent], up[i], strict=True)])
        out = [normal(belief[0])[CONTENT_STATE]]
        for i in range(1, n):
            rest = normal([x / y for x, y in zip(belief[tree.parents[i]], up[i], strict=True)])
            down = [sum(p * row[s] for p, row in zip(rest, edge[i], strict=True)) for s in STATES]
            belief[i] = normal([x * y for x, y in zip(belief[i], down, strict=True)])
            out.append(belief[i][CONTENT_STATE])
        return out

    def text(self, html: str) -> str:
        tree = parse(html)
        if not tree.lines:
            return ""
        content = self.marginals(tree)
        return "\n".join(line for node, line in tree.lines if content[node] > FROM)


@lru_cache(maxsize=1)
def trained() -> Potentials:
    return Potentials.fit(labelled_pages())


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Potentials | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    model = model or trained()
    source = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def make():
        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            raw = data.tobytes()
            texts = [model.text(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            return [pa.array(texts, pa.string()), longs(np.array([len(t) for t in texts]))]

        return function

    return map_text(source, "html", make, [StructField("text", StringType()), StructField("n_chars", LongType())], ["page_id", "url"])
