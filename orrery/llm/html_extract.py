"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each node is content or not; unary potentials come from its
tag, cue words in its class, id and role, and its own text, pairwise potentials join it to its parent.
Sum-product messages upward and downward give every node's marginal, and the text blocks of nodes whose
marginal for content is 0.5 or more are the main text; on a page where none reaches that, its prose outside of menus and the
like is taken if its marginal is near the page's best. All pages of a batch pass their messages together,
level by level.

The weights are trained by gradient steps on the exact marginals: from the labelled pages below
(``data-main`` opens content, ``data-not`` closes it), and, as labelled pages of the table itself, a
sample of pages whose author marks the content by one <article> or <main> (all nodes in it are content,
but for nav, aside, header, footer and form and what carries a cue against it), each of them once more with another
tag in place of that element.

Scripts, styles, comments, head and markup are never text. Character references are decoded, white space
inside a block becomes one space (a line break in a block as well), and blocks are joined by \\n. Broken
markup is read as browsers mostly do: p, li and the like close by themselves, stray end tags are ignored.
Null and empty pages, and pages without content, have the empty text. Each page is read by itself, so
repeated rows agree.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Generator
from dataclasses import dataclass, field as data_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import field, map_columns

#: Pages of the table, by a hash of the id, that the weights are trained on beside the labelled ones, if their author marks the content.
SAMPLE = 200
PAGES_AT_ONCE = 400
#: Signs of a block that is prose for sure, if it also ends a sentence and isn't mostly links.
PROSE = 80
STEPS, RATE, DECAY = 80, 0.4, 1e-3

TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption address summary legend".split())
SECTIONS = frozenset("article main section nav aside header footer form".split())
OTHER = frozenset("html body div ul ol dl table thead tbody tfoot tr figure details fieldset hr center menu dialog select option button label".split())
BLOCKS = TEXTUAL | SECTIONS | OTHER
TAGS = {tag: k for k, tag in enumerate(sorted(BLOCKS))}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no text of the page.
HIDDEN = frozenset("script style template noscript head title textarea svg math iframe object canvas audio video".split())
#: A tag that opens closes these if they are open on top of it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Cue words in class, id and role.
CUES = {
    "menu": r"nav|menu|breadcrumb|\btoc\b|pagination|pager",
    "header": r"header|masthead|topbar|\bbrand|\blogo",
    "footer": r"footer|copyright|colophon|legal",
    "side": r"side|aside|related|widget|recommend|popular|trending",
    "notice": r"notice|cookie|consent|gdpr|alert|popup|modal|newsletter|subscri|paywall|banner",
    "advert": r"\bads?\b|[-_]ads?\b|\bad[-_]|advert|sponsor|promo",
    "form": r"form|login|signup|search",
    "comment": r"comment|respon[ds]|repl(y|ies)|disqus|discuss",
    "share": r"share|social|follow",
    "content": r"article|content|\bmain\b|\bpost\b|entry|story|\bbody\b",
}
AGAINST = re.compile("|".join(v for k, v in CUES.items() if k != "content"))
CUE_LIST = [(k, re.compile(v)) for k, v in CUES.items()]
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]{0,40})")
SPECIAL = re.compile("['\">]")
LONG_REFERENCE = re.compile(r"&#(?:(\d{9,})|[xX]([0-9a-fA-F]{9,}));?")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

N_STATS = 12
N_FEATURES = 1 + len(TAGS) + len(CUES) + N_STATS
WIDTH = 12  # features of a node at most
EDGES = 3  # a child is textual, a section, or else


@dataclass
class Page:
    """Nodes in page order; 0 is the root."""

    parent: list[int] = data_field(default_factory=lambda: [-1])
    tag: list[str] = data_field(default_factory=lambda: ["html"])
    marks: list[str] = data_field(default_factory=lambda: [""])
    label: list[int] = data_field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = data_field(default_factory=list)  # node, text, characters inside links


def tokens(source: str) -> Generator[tuple[int, int, str, str | None, str], int | None, None]:
    """Tags, comments and declarations in order, each with begin, end, "/" if it closes, name (None: no tag) and what follows the name; a tag that never ends is text.

    Linear: of quotes outside of tags' other quotes that have led to no end before, none is tried again, and the next sign that matters is looked for once.
    """
    n, at, last = len(source), 0, {q: source.rfind(q) for q in "\"'>"}
    dead: set[int] = set()
    looked, special = 0, -1  # from `looked` on the next quote or > is `special`

    def end_of_tag(at: int) -> int:
        nonlocal looked, special
        tried: list[int] = []
        while True:
            if not (tried == [] and looked <= at <= special):
                found = SPECIAL.search(source, at)
                here = found.start() if found else n
                if not tried:
                    looked, special = at, here
            else:
                here = special
            if here == n or here in dead:
                break
            if source[here] == ">":
                return here + 1
            tried.append(here)
            if here >= last[source[here]]:
                break
            at = source.find(source[here], here + 1) + 1
        dead.update(tried)
        return -1

    while True:
        begin = source.find("<", at)
        if begin < 0 or begin >= last[">"] and not source.startswith(("<!--", "<![CDATA["), begin):
            if begin < 0:
                return
            at = begin + 1
            continue
        closing, name, rest = "", None, ""
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4) + 3
            end = end if end > 2 else n
        elif source.startswith("<![CDATA[", begin):
            end = source.find("]]>", begin + 9) + 3
            end = end if end > 2 else n
        elif source.startswith(("<!", "<?"), begin):
            end = source.find(">", begin) + 1
        elif tag := NAME.match(source, begin):
            end = end_of_tag(tag.end())
            closing, name = tag.group(1), tag.group(2).lower()
            rest = source[tag.end() : end - 1] if end > 0 else ""
        else:
            end = -1
        if end < 0:
            at = begin + 1
            continue
        to = yield begin, end, closing, name, rest
        at = to or end


def decoded(text: str) -> str:
    """text without its character references; numbers beyond all characters are U+FFFD."""

    def short(found: re.Match) -> str:
        decimal, digits = found.group(1), (found.group(1) or found.group(2)).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 8 else f"&#{digits};" if decimal else f"&#x{digits};"

    return entities.unescape(LONG_REFERENCE.sub(short, text))


def parse(source: str) -> Page:
    page = Page()
    stack, held, at, link, linked = [0], [], 0, False, 0
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()  # hidden elements that end nowhere from here on

    def end_block() -> None:
        nonlocal linked
        if held:
            text = " ".join(decoded("".join(held)).split())
            if text:
                page.blocks.append((stack[-1], text, linked))
            held.clear()
        linked = 0

    def pop(k: int) -> None:
        for node in stack[k:]:
            open_tags[page.tag[node]] -= 1
        del stack[k:]

    n, reader, jump = len(source), tokens(source), None
    while at < n:
        try:
            begin, end, closing, tag, rest = reader.send(jump)
        except StopIteration:
            begin = end = n
            tag = None
        jump = None
        if begin > at:
            held.append(source[at:begin])
            if link:
                linked += begin - at
        at = end
        if tag is None:
            continue
        if tag in HIDDEN:
            if not closing and not rest.endswith("/"):
                if tag in BLOCKS or tag in ("head", "title"):
                    end_block()
                stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if stop is None:
                    unclosed.add(tag)
                # an element that is never closed hides nothing, but for raw text
                at = jump = stop.end() if stop else n if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "a":
            link = not closing
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        end_block()
        link = False
        if closing:
            if open_tags[tag]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if page.tag[stack[k]] == tag))
            continue
        if page.tag[stack[-1]] == "p":
            pop(len(stack) - 1)
        while len(stack) > 1 and page.tag[stack[-1]] in CLOSES.get(tag, ()):
            pop(len(stack) - 1)
        if tag == "html" and len(stack) == 1:
            page.label[0] = int("data-main" in rest)
            continue
        node = len(page.parent)
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.marks.append(" ".join(m.strip("\"'") for m in MARKS.findall(rest)).lower() if "=" in rest else "")
        page.label.append(1 if "data-main" in rest else 0 if "data-not" in rest else page.label[stack[-1]])
        if tag not in VOID and not rest.endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    end_block()
    return page


def labels_by_author(page: Page) -> list[int] | None:
    """Labels of a page with one article or main element."""
    if sum(tag == "article" for tag in page.tag) == 1:
        top = page.tag.index("article")
    elif sum(tag == "main" for tag in page.tag) == 1:
        top = page.tag.index("main")
    else:
        return None
    out = [0] * len(page.parent)
    for k in range(1, len(out)):
        out[k] = int(k == top or (out[page.parent[k]] and page.tag[k] not in ("nav", "aside", "header", "footer", "form") and not AGAINST.search(page.marks[k])))
    return out


def retagged(page: Page, tag: str) -> Page:
    """The page with another tag for its one article or main element, so that not all is learnt from that tag."""
    top = page.tag.index("article" if page.tag.count("article") == 1 else "main")
    return Page(page.parent, [*page.tag[:top], tag, *page.tag[top + 1 :]], page.marks, page.label, page.blocks)


def features(page: Page) -> np.ndarray:
    """Numbers of each node's features, -1 where there are fewer."""
    n = len(page.parent)
    chars, links, ends, commas = [0] * n, [0] * n, [False] * n, [0] * n
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        ends[node] |= text[-1] in ".!?…"
        commas[node] += text.count(",")
    out = np.full((n, WIDTH), -1, np.int64)
    base = 1 + len(TAGS) + len(CUES)
    for k in range(n):
        own = [0, 1 + TAGS[page.tag[k]]]
        if page.marks[k]:
            own += [1 + len(TAGS) + c for c, (_, cue) in enumerate(CUE_LIST) if cue.search(page.marks[k])]
        size = chars[k]
        own.append(base + (0 if not size else 1 if size < 25 else 2 if size < 80 else 3 if size < 250 else 4))
        if size:
            own.append(base + (5 if 2 * links[k] > size else 6 if links[k] else 7))
            own.append(base + (8 if ends[k] else 9))
            own.append(base + (10 if commas[k] else 11))
        own = own[:WIDTH]
        out[k, : len(own)] = own
    return out


class Forest:
    """Nodes of many pages, and their levels from the roots down."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.starts = starts
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)])
        self.features = np.concatenate([features(p) for p in pages])
        kinds = {tag: 0 for tag in TEXTUAL} | {tag: 1 for tag in SECTIONS}
        self.kind = np.array([kinds.get(tag, 2) for p in pages for tag in p.tag])
        depth = []
        for p in pages:
            own = [0] * len(p.parent)
            for k in range(1, len(own)):
                own[k] = own[p.parent[k]] + 1
            depth += own
        depth = np.array(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        padded = np.append(weights, 0.0)  # -1 takes the 0
        return padded[self.features].sum(1)

    def messages(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upward beliefs (node without its parent), messages to the parent, downward messages; pair[kind, x of parent, x of child]."""
        n = len(self.parent)
        up = np.stack([np.zeros(n), unary], 1)
        to_parent, down = np.zeros((n, 2)), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            psi = pair[self.kind[level]]
            to_parent[level] = np.logaddexp(up[level, None, 0] + psi[:, :, 0], up[level, None, 1] + psi[:, :, 1])
            np.add.at(up, self.parent[level], to_parent[level])
        for level in self.levels[1:]:
            p = self.parent[level]
            outside = down[p] + up[p] - to_parent[level]
            psi = pair[self.kind[level]]
            down[level] = np.logaddexp(outside[:, 0, None] + psi[:, 0, :], outside[:, 1, None] + psi[:, 1, :])
        return up, to_parent, down

    def marginals(self, model: "Model") -> np.ndarray:
        up, _, down = self.messages(self.unary(model.weights), model.pair)
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray


def train(pages: list[tuple[Page, list[int]]]) -> Model:
    forest = Forest([p for p, _ in pages])
    y = np.array([v for _, labels in pages for v in labels], float)
    weights, pair = np.zeros(N_FEATURES), np.zeros((EDGES, 2, 2))
    squares, pair_squares = np.full(N_FEATURES, 1e-6), np.full((EDGES, 2, 2), 1e-6)
    inner = np.flatnonzero(forest.parent >= 0)
    parent, kind = forest.parent[inner], forest.kind[inner]
    there = forest.features >= 0
    gold = np.zeros((EDGES, 2, 2))
    np.add.at(gold, (kind, y[parent].astype(int), y[inner].astype(int)), 1)
    for _ in range(STEPS):
        up, to_parent, down = forest.messages(forest.unary(weights), pair)
        both = up + down
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -40, 40)))
        outside = (down + up)[parent] - to_parent[inner]
        joint = outside[:, :, None] + pair[kind] + up[inner][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        slope = gold.copy()
        np.add.at(slope, kind, -joint)
        residual = np.repeat((y - p)[:, None], WIDTH, 1)[there]
        gradient = np.bincount(forest.features[there], residual, N_FEATURES) - DECAY * len(y) / N_FEATURES * weights
        squares += gradient**2
        pair_squares += slope**2
        weights += RATE * gradient / np.sqrt(squares)
        pair += RATE * slope / np.sqrt(pair_squares)
    return Model(weights, pair)


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    out = []
    for at in range(0, len(sources), PAGES_AT_ONCE):
        pages = [parse(s or "") for s in sources[at : at + PAGES_AT_ONCE]]
        forest = Forest(pages)
        marginals = forest.marginals(model)
        for page, start in zip(pages, forest.starts.tolist(), strict=False):
            own = marginals[start : start + len(page.parent)]
            out.append("\n".join(text for node, text, _ in page.blocks if own[node] >= 0.5) or "\n".join(unsure(page, own)))
    return out


def unsure(page: Page, marginals: np.ndarray) -> list[str]:
    """Blocks of a page on which no text reaches one half: its prose outside of everything that says it is something else, where it comes near to the likeliest of it."""
    apart = [False] * len(page.parent)
    for k in range(1, len(apart)):
        apart[k] = apart[page.parent[k]] or page.tag[k] in ("nav", "aside", "header", "footer", "form") or bool(AGAINST.search(page.marks[k]))
    prose = [(node, text) for node, text, linked in page.blocks if len(text) >= PROSE and text[-1] in ".!?…" and 2 * linked <= len(text) and not apart[node]]
    best = max((marginals[node] for node, _ in prose), default=0.0)
    return [text for node, text in prose if 2 * marginals[node] >= best]


def labelled_pages() -> list[tuple[Page, list[int]]]:
    pages = [parse(source) for source in LABELLED]
    return [(p, p.label) for p in pages]


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample: int = SAMPLE) -> Model:
    both = pages.select(field(page_id).alias("page_id"), field(html).alias("html"))
    drawn = both.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)  # ids alone are sorted
    rows = both.join(F.broadcast(drawn), "page_id").orderBy("page_id", F.xxhash64("html")).limit(2 * sample).collect()  # ids may repeat
    labelled = [(p, labels) for p in (parse(r[1]) for r in rows) if (labels := labels_by_author(p))]
    return train(labelled_pages() * 5 + labelled + [(retagged(p, ("div", "main", "section")[k % 3]), labels) for k, (p, labels) in enumerate(labelled)])


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", model: Model | None = None) -> DataFrame:
    """One row for each row: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages, html, page_id))
    rows = pages.select(field(page_id).alias("page_id"), field(url).cast("string").alias("url"), field(html).alias("html"))

    def run(batch: pa.RecordBatch) -> list:
        texts = main_texts(batch.column(2).to_pylist(), shared.value)
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    return map_columns(rows, run, "url string, text string, n_chars bigint", rows.schema["page_id"])


_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "About us", "Contact"))
_LONG = "The council met on Tuesday, and after two hours of debate it agreed to repair the old bridge, which has been closed since spring."
_MORE = "Work is expected to start in May, said the engineer in charge, and to last until the end of the year."
#: Pages labelled by hand.
LABELLED = [
    f"<body><header><h1>The Daily</h1><p>News from here.</p></header><nav><ul>{_LINKS}</ul></nav><main data-main><h1>Bridge to be repaired</h1><p>{_LONG}</p><p>{_MORE}</p><ul><li>First the pillars.</li><li>Then the road.</li></ul></main>"
    f"<aside><h3>Related</h3><ul>{_LINKS}</ul><p>{_MORE}</p></aside><footer><p>All rights reserved.</p></footer></body>",
    f'<body><div class="top-menu">{_LINKS}</div><div class="cookie-notice"><p>We use cookies, as everybody does. Read more.</p><button>Accept</button></div><div class="content" data-main><h2>Bridge</h2><p>{_LONG}</p>'
    f'<div class="ad" data-not><p>Buy one, get one free.</p></div><p>{_MORE}</p><blockquote><p>{_LONG}</p></blockquote></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{_MORE}</p></div><div class="comment"><p>{_LONG}</p></div>'
    '<form><label>Your reply</label><button>Send</button></form></div><div class="footer">Imprint, privacy</div></body>',
    f'<body><nav>{_LINKS}</nav><article data-main><h1>Bridge</h1><p>{_LONG}</p><p>{_MORE}</p><section><h2>Costs</h2><p>{_MORE}</p></section><aside class="sidebar" data-not><p>{_LONG}</p></aside><p>{_LONG}</p>'
    f'<section class="comments" data-not><h3>Comments</h3><p>{_MORE}</p></section><footer data-not><p>Filed under roads.</p></footer></article><div class="sponsored"><p>{_MORE}</p></div></body>',
    f'<body><div id="header"><div class="logo">The Daily</div><ul class="nav">{_LINKS}</ul></div><div id="wrap"><div class="post" data-main><h1>Bridge</h1>{_LONG}<p>{_MORE}</p><table><tr><td>Length</td><td>80 m</td></tr></table></div>'
    f'<div class="sidebar"><h4>Popular</h4><ul>{_LINKS}</ul><p>{_LONG}</p></div></div><div class="newsletter"><form><p>Subscribe to our letter, it is free.</p></form></div><div id="footer"><p>{_MORE}</p></div></body>',
    f'<body><div class="alert"><p>{_LONG}</p></div><div class="ad">{_MORE}</div><article data-main><header data-not><p>By our staff, today.</p></header><h1>Bridge</h1><p>{_LONG}</p><p>{_MORE}</p><p>Yes.</p><pre>a = 1</pre></article>'
    f'<div class="share-buttons">{_LINKS}</div><aside><p>{_LONG}</p></aside><form class="search"><p>Search this site.</p></form><footer>{_LONG}</footer></body>',
    f'<body><nav>{_LINKS}</nav><div class="ad">{_MORE}</div><article data-main><h1>Bridge</h1><p><b>{_LONG}<br><p>{_MORE}</p><p>No.</p></article><footer>Imprint. {_MORE}</footer></body>',
    f'<body><nav>{_LINKS}</nav><article data-main><h1>Ok</h1><p>Yes</p><p>no, or so</p><p>1</p></article><footer>Imprint</footer></body>',
    "<body><article data-main><p>Short</p><p>e</p></article></body>",
    "<article data-main><h1>Note</h1><p>Late train, again.</p></article>",
    f'<body><div><ul>{_LINKS}</ul></div><div><div data-main><h2>Bridge</h2><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p></div></div><div class="comments"><h3>Comments</h3><div><p>{_MORE}</p></div><div><p>{_LONG}</p></div></div><div>Imprint</div></body>',
    f'<body><p class="notice">{_LONG}</p><nav>{_LINKS}</nav><form><p>{_LONG}</p></form><footer>{_LONG}</footer></body>',
    # Layouts without any name: bare blocks, text that lies in the body itself, tables, several articles.
    f"<body><div><div data-main><p>{_LONG}</p><p>{_MORE}</p></div></div></body>",
    f"<body><div data-main><p>{_MORE}</p><p>{_LONG}</p><p>{_MORE}</p></div></body>",
    f"<body data-main><p>{_LONG}</p><p>{_MORE}</p></body>",
    f"<body data-main><h1>Bridge</h1>{_LONG}<br>{_MORE}<footer data-not>Imprint, {_LINKS}</footer></body>",
    f"<body data-main>{_LONG} {_MORE}</body>",
    f"<body data-main><h2>Bridge</h2>{_LONG} {_MORE}<br><br>{_LONG}<hr>{_MORE}<div data-not class='footer'>Imprint</div></body>",
    f"<body><table><tr><td><ul>{_LINKS}</ul></td><td data-main><h1>Bridge</h1><p>{_LONG}</p><p>{_MORE}</p></td></tr><tr><td>Imprint</td></tr></table></body>",
    f"<body><table><tr><td><a href='/'>Home</a></td><td><a href='/n'>News</a></td></tr><tr><td></td><td data-main>{_LONG}<br>{_MORE}</td></tr></table></body>",
    f"<body><table><tr><td><a href='/'>Home</a> | <a href='/n'>News</a></td></tr><tr><td data-main><h2>Bridge</h2>{_LONG} {_MORE}</td></tr><tr><td>Imprint</td></tr></table></body>",
    f"<body><nav>{_LINKS}</nav><article data-main><h2>Bridge</h2><p>{_LONG}</p></article><article data-main><h2>Road</h2><p>{_MORE}</p><p>{_LONG}</p></article><footer>Imprint</footer></body>",
    f"<body><div><ul>{_LINKS}</ul></div><div><div data-main>{_LONG}<br>{_MORE}</div></div><div>Imprint</div></body>",
    f"<body><div><ul>{_LINKS}</ul></div><div><div data-main><p>{_LONG}</p><p>{_MORE}</p></div></div><div class='comments'><div><p>{_MORE}</p></div><div><p>{_LONG}</p></div></div></body>",
    f"<body><div data-main><p>{_LONG}</p><p>{_MORE}</p></div><div class='comments'><div><p>{_MORE}</p></div></div></body>",
    f"<body><center><b>The Daily</b></center><ul>{_LINKS}</ul><div data-main><p>{_LONG}</p><p>{_MORE}</p></div><center>Imprint</center></body>",
    f"<body><ul>{_LINKS}</ul><form><p>{_MORE}</p></form><div class='newsletter'><p>{_LONG}</p></div></body>",
    f"<html data-main>{_LONG} {_MORE}",
    f"<html data-main>{_MORE}<br>{_LONG}",
    f"<div data-main>{_LONG} {_MORE}</div>",
    f"<body><ul>{_LINKS}</ul><div data-main>{_LONG}<br>{_MORE}</div></body>",
    f"<body data-main><ul data-not>{_LINKS}</ul><span>{_LONG}</span><br><span>{_MORE}</span></body>",
    f"<body><ul>{_LINKS}</ul><ul data-main><li>{_LONG}</li><li>{_MORE}</li></ul></body>",
    f"<body><ul data-main><li>{_MORE}</li><li>{_LONG}</li></ul></body>",
    "<article data-main><p>note</p></article>",
    f"<body><nav>{_LINKS}</nav><article data-main><p>ok</p></article></body>",
]
