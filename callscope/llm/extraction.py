"""Main text of web pages: boosted trees over the nodes of the document tree.

A page becomes a tree of its block elements; inline markup only joins text.
Each node has features (its own and its subtree's text and link density, what
its tag, class, id and role say and what those of its ancestors say, depth,
place among its siblings and their statistics). Boosted trees give every node
the log-odds of holding main text. The tree is then decoded as a whole: to drop
a node is to drop all below it, and to keep one is to keep all above it, so no
kept block lies in a dropped one. The decoding with the highest total
likelihood is found from the leaves up.

The trees are fitted on a bounded sample (``SAMPLE`` pages, ``SAMPLE_CHARS``
characters of each): its sentences are set into ``TRAINING_PAGES`` pages of
many layouts made by rule, where it is known which blocks are main text.

Defined results: a NULL or empty page, or one without text, has an empty text;
unclosed, misplaced and cut-off markup is read as browsers do in the common
cases; text outside any element counts as the body's; repeated rows are read
one by one; an empty table gives no rows. Calling :func:`learn` starts a job.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import boosting
from callscope.llm.common import query, table, texts_in_blocks

SAMPLE = 200
SAMPLE_CHARS = 20_000
TRAINING_PAGES = 900
BLOCK = 1 << 22

# Element names of HTML by their role.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre section select summary table tbody td
tfoot th thead tr ul""".split())
RAW = ("script", "style", "title", "textarea", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp")
SPACING = frozenset("br hr img input wbr".split())
#: An opening tag of the first kind ends an open element of the second, but not beyond the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"}),
}
KEEPS_PARAGRAPH = frozenset("button label option optgroup select legend summary caption td th tr tbody thead tfoot".split())
SCOPES = frozenset("button caption table td th".split())
# Words in class, id and role that pages use for what is not, and what is, their main text.
BOILERPLATE = frozenset("""ad ads advert advertisement adverts banner bar breadcrumb breadcrumbs byline comment commentlist comments complementary
consent contentinfo cookie cookies disclaimer disqus feedback foot footer form gdpr head header hidden login masthead menu meta modal nav
navbar navigation newsletter notice notification pager pagination pagelinks popup print promo promoted promotion rail recommended related
replies reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe tags teaser toc toolbar top
tracking trending warning widget""".split())
CONTENT = frozenset("article articlebody body content copy entry hentry main mainbody page post postbody prose story text".split())

_TOKEN = re.compile(
    r"<!--(?:.*?(?:-->)|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden|itemprop|data-main)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "parent", "words", "children", "text", "links", "order", "main")

    def __init__(self, tag: str, parent: Node | None, words: tuple[str, ...] = (), main: bool = False):
        self.tag, self.parent, self.words, self.main = tag, parent, words, main
        self.children: list[Node] = []
        self.text = 0  # characters of its own
        self.links = 0  # of them in links


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    words, main = [], False
    for name, a, b, c in _ATTR.findall(raw):
        value, name = a or b or c, name.lower()
        if name == "data-main":
            main = True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            words.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            # camelCase and kebab-case alike
            words += [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
    return tuple(words), main


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The nodes in page order, and the blocks of text in page order with their node's index."""
    root = Node("body", None)
    nodes, blocks = [root], []
    root.order = 0
    open_, link, pieces = [root], False, []

    def end_block():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append((open_[-1].order, text))
            pieces.clear()

    def put(raw):
        pieces.append(raw)
        size = len(raw) - raw.count(" ")
        open_[-1].text += size
        if link:
            open_[-1].links += size

    def close(names, barrier=frozenset()):
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in names:
                end_block()
                del open_[depth:]
                return
            if open_[depth].tag in barrier:
                return

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            put(page[at:])
            break
        if found.start() > at:
            put(page[at:found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "a":
                link = False
            elif tag == "p":
                close({"p"}, SCOPES)
            elif tag in BLOCKS and tag not in ("body", "html"):
                close({tag}, {"table"} if tag not in ("table",) and open_[-1].tag != "table" else frozenset())
        elif tag in RAW:
            if not found["attrs"].rstrip().endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else len(page)
        elif tag == "head":
            pass
        elif tag == "a":
            link = True
        elif tag in SPACING:
            pieces.append(" ")
        elif tag in BLOCKS:
            words, main = _attributes(found["attrs"]) if found["attrs"] else ((), False)
            if tag in ("body", "html"):
                root.words += words
                continue
            if tag in ENDS:
                close(*ENDS[tag])
            if tag not in KEEPS_PARAGRAPH:
                close({"p"}, SCOPES)
            end_block()
            node = Node(tag, open_[-1], words, main)
            node.order = len(nodes)
            open_[-1].children.append(node)
            nodes.append(node)
            open_.append(node)
    end_block()
    return nodes, blocks


_KINDS = (
    {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"div", "section", "center"},
    {"article", "main"}, {"nav"}, {"footer"}, {"header", "hgroup"}, {"aside"}, {"form", "fieldset", "button", "select", "option", "label", "legend"},
    {"table", "tbody", "tr", "td", "th", "thead", "tfoot", "caption"}, {"figure", "figcaption"}, {"address", "details", "dialog", "summary"},
)
_KIND = {tag: i for i, tags in enumerate(_KINDS) for tag in tags}
_HEADING = re.compile(r"h\d")
WIDTH = 35


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    own = [0] * n
    stops, words, first = [0] * n, [0] * n, [""] * n
    for at, text in blocks:
        own[at] += len(text)
        words[at] += text.count(" ") + 1
        stops[at] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        first[at] = first[at] or text
    sub_text, sub_tags, sub_words, sub_stops, sub_p = list(own), [1] * n, list(words), list(stops), [0] * n
    sub_links, sub_own = [v.links for v in nodes], [v.text for v in nodes]
    for i in range(n - 1, 0, -1):
        v = nodes[i]
        up = v.parent.order
        for sums in (sub_text, sub_tags, sub_words, sub_stops, sub_links, sub_own):
            sums[up] += sums[i]
        sub_p[i] += v.tag == "p"
        sub_p[up] += sub_p[i]
    total = max(1, sub_text[0])
    depth, bad, good, kinds = [0] * n, [0] * n, [0] * n, [0] * n
    out = np.zeros((n, WIDTH))
    seen = 0
    for i, v in enumerate(nodes):
        up = v.parent.order if v.parent else 0
        mine_bad, mine_good = sum(w in BOILERPLATE for w in v.words), sum(w in CONTENT for w in v.words)
        kind = _KIND.get(v.tag, 15)
        if i:
            depth[i], bad[i], good[i] = depth[up] + 1, bad[up] + mine_bad, good[up] + mine_good
            kinds[i] = kinds[up] | 1 << kind
        same = v.parent.children if v.parent else [v]
        if len(same) > 64:  # the sums below are per parent; long lists share one
            rank, alike = min(i - same[0].order, 64) / 64, sum(c.tag == v.tag for c in same[:64]) / 64
        else:
            rank, alike = (same.index(v) + 1) / len(same), sum(c.tag == v.tag for c in same) / len(same)
        text = max(1, sub_own[i])
        out[i] = (
            kind, mine_bad, mine_good, bad[i] - mine_bad, good[i] - mine_good, depth[i],
            np.log1p(own[i]), np.log1p(sub_text[i]), sub_text[i] / sub_tags[i], sub_links[i] / text,
            sub_text[i] / total, sub_text[i] / max(1, sub_text[up]), sub_stops[i] / max(1, sub_words[i]), sub_words[i] / sub_tags[i],
            rank, alike, len(same), len(v.children), sub_p[i], sub_p[up], seen / total,
            kinds[i] >> 6 & 1, kinds[i] >> 7 & 1, kinds[i] >> 8 & 1, kinds[i] >> 9 & 1, kinds[i] >> 10 & 1, kinds[i] >> 11 & 1,
            kinds[i] >> 12 & 1, kinds[i] >> 13 & 1, kinds[i] >> 4 & 1, bool(_HEADING.fullmatch(v.tag)),
            first[i][:1] in ("©", "(") if first[i] else 0, sub_links[up] / max(1, sub_own[up]), nodes[up].tag == "body", sub_tags[i])
        seen += own[i]
    return out


def decode(nodes: list[Node], odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the likeliest choice in which no kept node has a dropped ancestor.

    A node counts by the text below it, so that a long paragraph outweighs the many links around it.
    """
    weight = 1 + np.log1p(sizes)
    keep_gain = weight * -np.logaddexp(0, -odds)
    drop_gain = weight * -np.logaddexp(0, odds)
    best = [0.0] * len(nodes)
    all_dropped = drop_gain.tolist()
    kept = keep_gain.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.order
        best[i] = max(kept[i], all_dropped[i])
        kept[up] += best[i]
        all_dropped[up] += all_dropped[i]
    out = np.zeros(len(nodes), bool)
    for i, v in enumerate(nodes):
        out[i] = kept[i] > all_dropped[i] and (i == 0 or out[v.parent.order])
    return out


def extract(model: boosting.Trees, pages: list[str | None]) -> list[str]:
    parsed = [parse(p) if p else ([], []) for p in pages]
    rows = [features(*p) if p[1] else np.zeros((0, WIDTH)) for p in parsed]
    odds = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for (nodes, blocks), x in zip(parsed, rows):
        if not len(x):
            out.append("")
            continue
        keep = decode(nodes, odds[at:at + len(x)], np.expm1(x[:, 7]))
        at += len(x)
        out.append("\n\n".join(text for i, text in blocks if keep[i]))
    return out


# Training pages -------------------------------------------------------------------------------------


class _Maker:
    """Pages of many layouts around given sentences; main blocks carry the attribute ``data-main``."""

    def __init__(self, rng: random.Random, sentences: list[str]):
        self.rng, self.sentences = rng, sentences

    def some(self, least: int, most: int) -> str:
        return html.escape(" ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(least, most))), quote=False)

    def short(self, words: int) -> str:
        return html.escape(" ".join(self.rng.choice(self.sentences).split()[:self.rng.randint(1, words)]), quote=False)

    def attrs(self, words, chance=0.8) -> str:
        if self.rng.random() > chance:
            return ""
        word = self.rng.choice(sorted(words))
        word += self.rng.choice(["", "", "-box", "-1", " widget-x", "__inner"])
        return f' {self.rng.choice(["class", "class", "id"])}="{word}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.short(4)}</a>' for i in range(n)]
        return self.rng.choice([
            "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<p>{x}</p>" for x in items)])

    def noise(self) -> str:
        r = self.rng
        name = lambda *words: self.attrs(words, 1)
        return r.choice([
            lambda: f"<nav{self.attrs({'nav', 'menu', 'main-nav'}, 0.4)}>{self.links(r.randint(2, 12))}</nav>",
            lambda: f"<div{name('menu', 'nav', 'navigation', 'breadcrumb', 'toolbar')}>{self.links(r.randint(2, 12))}</div>",
            lambda: f"<div{name('ad', 'ads', 'advert', 'banner', 'promo', 'sponsored', 'advertisement')}>{self.some(1, 3)}</div>",
            lambda: f"<aside{self.attrs({'sidebar', 'related', 'widget'}, 0.5)}><h3>{self.short(3)}</h3>{r.choice([self.links(5), '<p>' + self.some(1, 4) + '</p>'])}</aside>",
            lambda: f"<div{name('sidebar', 'related', 'rail', 'recommended', 'teaser')}><h4>{self.short(3)}</h4><p>{self.some(1, 3)}</p>{self.links(3)}</div>",
            lambda: f"<div{name('cookie', 'notice', 'consent', 'notification', 'warning', 'disclaimer')}><p>{self.some(1, 3)}</p><button>OK</button></div>",
            lambda: f"<form{self.attrs({'search', 'login', 'newsletter', 'subscribe'}, 0.5)}><label>{self.short(5)}</label><input><p>{self.some(0, 2)}</p><button>{self.short(2)}</button></form>",
            lambda: f"<{(t := r.choice(['div', 'section']))}{name('comments', 'comment', 'replies', 'respond', 'commentlist')}><h3>{self.short(2)}</h3>"
                    + "".join(f"<{(u := r.choice(['div', 'li', 'article']))}{self.attrs({'comment', 'reply'}, 0.7)}><p>{self.some(1, 5)}</p></{u}>" for _ in range(r.randint(1, 5))) + f"</{t}>",
            lambda: f"<div{name('share', 'social', 'tags', 'meta', 'byline', 'pagination')}>{self.links(r.randint(1, 5))}{self.short(4)}</div>",
            lambda: f"<div{r.choice([' hidden', ' style=\"display:none\"', ' aria-hidden=\"true\"'])}><p>{self.some(1, 4)}</p></div>",
        ])()

    def before(self) -> list[str]:
        r = self.rng
        head = f"<header{self.attrs({'header', 'masthead', 'top'}, 0.5)}>{r.choice(['<h1>', '<p>', '<div>'])}{self.short(4)}{r.choice(['', '<p>' + self.some(1, 1) + '</p>'])}</header>"
        return [x for x in (head if r.random() < 0.5 else "", *(self.noise() for _ in range(r.randint(0, 4)))) if x]

    def after(self) -> list[str]:
        r = self.rng
        legal = f"{r.choice(['&copy; ', '(c) ', ''])}{self.short(4)} {r.choice(['&middot; ', ' | ', ''])}{self.some(0, 2)}"
        foot = r.choice([f"<footer>{legal}</footer>", f"<footer><p>{legal}</p>{self.links(4)}</footer>", f"<div{self.attrs({'footer', 'foot', 'contentinfo'}, 1)}>{legal}</div>"])
        return [*(self.noise() for _ in range(r.randint(0, 3))), foot if r.random() < 0.85 else ""]

    def block(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.72:
            text = self.some(1, r.choice([1, 2, 6, 12]))
            if r.random() < 0.2:
                text = f'{self.short(5)} <a href="#">{self.short(4)}</a> {text}'
            if r.random() < 0.2:
                return f"<p data-main><b>{text}<br>"
            return f"<p data-main>{text}" + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.82:
            return f"<h{(d := r.randint(2, 4))} data-main>{self.short(7)}</h{d}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li data-main>{self.some(1, 2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote data-main>{self.some(1, 3)}</blockquote>"
        return "<table>" + "".join(f"<tr><td data-main>{self.short(4)}</td><td data-main>{self.short(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"

    def page(self) -> str:
        r = self.rng
        blocks = [self.block() for _ in range(r.choice([0, 1, 1, 2, 3, 6, 12]))]
        if r.random() < 0.3:
            blocks.insert(r.randint(0, len(blocks)), self.noise())
        title = f"<h1 data-main>{self.short(12)}</h1>" if r.random() < 0.8 or not blocks else ""
        tag = r.choice(["article", "article", "article", "main", "div", "section", "td"])
        words = {"content", "post", "entry", "article", "story", "main", "text", "page", "col", "x1"}
        inside = f"<{tag}{self.attrs(words, 0.9 if tag in ('div', 'td') else 0.3)}>{title}{''.join(blocks)}"
        inside += "" if r.random() < 0.05 else f"</{tag}>"
        inside = f"<table><tr>{inside}</tr></table>" if tag == "td" else inside
        parts = [*self.before(), inside, *self.after()]
        body = "".join(parts)
        if r.random() < 0.4:
            body = f"<div{self.attrs({'wrap', 'container', 'page', 'site', 'content'}, 0.8)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.short(9)}</title></head><body>{body}</body></html>"


def training_rows(sentences: list[str], pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the nodes of made pages. A node that holds main text is one."""
    make = _Maker(random.Random(seed), sentences)
    x, y = [], []
    for _ in range(pages):
        nodes, blocks = parse(make.page())
        main = [v.main for v in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent.order] |= main[i]
        x.append(features(nodes, blocks))
        y.append(np.array(main, float))
    rows = np.concatenate(x)
    return rows, np.concatenate(y), 1 + np.log1p(np.expm1(rows[:, 7]))


_END = re.compile(r"(?<=[.!?])\s+")


def learn(df: DataFrame, html_column: str = "html", pages: int = TRAINING_PAGES, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, seed: int = 7) -> boosting.Trees:
    """Trees fitted on made pages around the sentences of ``sample`` pages."""
    drawn = df.select(F.substring(html_column, 1, chars).alias("h")).where(F.col("h").isNotNull())
    drawn = drawn.orderBy(F.xxhash64("h"), "h").limit(sample).toArrow().column("h").to_pylist()
    sentences = [s for page in drawn for _, text in parse(page)[1] for s in _END.split(text) if s][:20_000]
    return boosting.fit(*training_rows(sentences or ["Some words."], pages, seed))


def _extract(batches, model, html_column) -> Iterator[pa.RecordBatch]:
    for block in texts_in_blocks(batches, html_column, BLOCK):
        texts = extract(model.value, block.column(block.schema.get_field_index(html_column)).to_pylist())
        keep = [i for i, f in enumerate(block.schema.names) if f != html_column]
        yield pa.RecordBatch.from_arrays(
            [*(block.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*(block.schema.names[i] for i in keep), "text", "n_chars"])


def main_text(df: DataFrame, model: boosting.Trees, html_column: str = "html") -> DataFrame:
    """``df`` without ``html_column``, with ``text`` and ``n_chars``."""
    df = df.drop(*[c for c in ("text", "n_chars") if c != html_column])
    schema = T.StructType([*(f for f in df.schema.fields if f.name != html_column), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.mapInArrow(partial(_extract, model=df.sparkSession.sparkContext.broadcast(model), html_column=html_column), schema)


@query("op9_dom_trees")
def op9_dom_trees(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, learn(pages))
