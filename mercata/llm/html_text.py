"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order, each with its place in the
element tree.  Every block is a node of a graph:

* **Terminal capacities** come from two costs in units of 1/100 nat: the log
  odds of a logistic classifier over the block's text (length, share of
  linked text, punctuation, capitals, digits, end sign, heading), and a prior from the
  nearest element that says what it is (article, main; nav, footer, aside,
  form, or a class or id such as ad, sidebar, comments, cookie).  No one cost
  decides alone: text and edges together outweigh a prior.  A name that
  consists of such words and of words about layout (cookie-notice, ad-box)
  counts in full; one with a word about something else (legal-analysis,
  share-price) counts half, and within content only halves the prior there, so
  that the text decides.  A main anywhere, and an article in a boilerplate
  wrapper (a form, or a class or id), is content again; an element with a
  content word there is left to its text.  A boilerplate word outweighs a
  content word.  What has the attribute hidden or the style display:none is
  never content.
* **Smoothness edges** join neighbours in page order and neighbours under one
  parent, the stronger the more of their paths they share.

The minimum cut (maximum flow by shortest augmenting paths in phases) parts
content from boilerplate.  Nodes whose terminal outweighs all their edges are
settled first, which does not change the cut's value.

The classifier is trained on blocks that the tree labels clearly, in a sample
of about ``train_pages`` pages (chosen by a hash of page_id and html); it sees
only a block's text and its container's share of text, so it carries over to
pages without telling elements.

Never text: comments, head, title, script, style, template, xmp, noembed,
noframes and iframe, and the form controls select, datalist, button and
textarea.  Formulas (math), labels in drawings (svg), and what noscript,
object, canvas, audio and video hold for readers without them are text like
any other.  Elements that may stand in a line do not end its block.
Character references are decoded, white space within a block becomes
one space, and blocks are joined by a newline; nothing else is dropped.

Edge cases: NULL or empty html, and pages without content, give the empty
text.  Unclosed and stray tags are repaired as they come; a raw-text element
without an end runs to the page's end.  Repeated rows are rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled sample: pages (equal ones count together), and blocks of one page.
TRAIN_PAGES, PAGE_BLOCKS = 1500, 200
#: Prior of a telling element, and the strongest smoothness edge, in 1/100 nat.
PRIOR, SMOOTH = 600, 120
#: A text score counts at most this much: with the edges it can override a telling element.
TEXT_LIMIT = 500
#: Cost of showing what the page hides.
HIDDEN = 4000

# Element names by role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SKIPPED = {"head", "script", "style", "template", "select", "button", "textarea", "datalist", "iframe", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mmultiscripts",
    "mprescripts", "none", "mstyle", "mtable", "mtr", "mtd", "mpadded", "mphantom", "menclose", "merror", "semantics", "annotation", "annotation-xml",
    "script", "style", "template", "noscript", "svg", "object", "canvas", "audio", "video", "select", "button", "textarea", "datalist", "iframe",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_DRAWING = HEADINGS | {"article", "aside", "blockquote", "body", "div", "dl", "footer", "form", "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
WRAPPERS = {"form", "fieldset"}  # boilerplate that may lie around a whole page
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
CONTENT = {"article", "main"}
# Words of a class or id that tell boilerplate, or content.
BOILERPLATE_WORDS = set(
    "ad ads advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer bottom sidebar aside widget related recommended share sharing social cookie cookies consent notice alert popup modal "
    "overlay newsletter subscribe subscription signup login search comment comments disqus respond reply replies pagination pager copyright legal toolbar "
    "skip disclaimer form".split()
)
CONTENT_WORDS = set("article content main post entry story body text".split())
# Words that tell an element's place or form, not what it is about.
LAYOUT_WORDS = set(
    "area articles aria bar block blocks body bottom box btn button buttons card cards cell col cols column columns container content contents count counts "
    "description desktop div el element entries extra field fixed float footer grid group head heading holder icon icons image img in inline inner input is item "
    "items js label large layout left lg line link links list lists main md media meta mini mobile module new news old open outer page pane panel part posts "
    "primary row rows secondary section sections sm slot small space spot sticky stories strip tab tabs teaser teasers text the title titles toggle top unit "
    "upper view wide widgets wp wrap wrapper xl zone".split()
)
BESIDE = {"has", "with", "without", "no"}  # the next word tells what is beside the element, not what it is
#: A start tag (key) ends an open element of these names, up to the given borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("name", "parent", "depth", "prior", "fixed", "hidden", "linked", "skipped", "drawn")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.linked = name == "a" or bool(parent and parent.linked)
        self.skipped = name in SKIPPED or bool(parent and parent.skipped)
        self.drawn = name == "svg" or bool(parent and parent.drawn)
        self.hidden = bool(parent and parent.hidden)
        self.prior = parent.prior if parent else 0  # of the nearest telling element: content above 0, boilerplate below
        self.fixed = bool(parent and parent.fixed)  # within boilerplate that is no wrapper
        said = {}
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                said.setdefault(key.lower(), value.strip("\"'"))
        if name not in ("html", "body"):
            self.hidden = self.hidden or "hidden" in said or bool(_NO_DISPLAY.search(said.get("style", "")))
        prior = _prior(name, said, self.prior, self.fixed)
        if prior is not None:
            self.prior = prior
            self.fixed = prior < 0 and (self.fixed or name in BOILERPLATE - WRAPPERS)

    @property
    def inline(self) -> bool:
        return self.drawn or self.name in INLINE


def _prior(name: str, said: dict[str, str], around: int, fixed: bool) -> int | None:
    """Prior of an element within one of prior ``around``; None: the same."""
    words: set[str] = set()
    clear: set[str] = set()  # of names that are about nothing else
    if name not in ("html", "body"):
        for key in ("class", "id", "role"):
            for term in said.get(key, "").lower().split():
                found = _WORDS.findall(term)
                own = {w for w, before in zip(found, ["", *found]) if before not in BESIDE}
                words |= own
                if all(w in BOILERPLATE_WORDS or w in CONTENT_WORDS or w in LAYOUT_WORDS or len(w) < 2 for w in own):
                    clear |= own
    if name in BOILERPLATE:
        return -PRIOR
    if name == "main":
        return PRIOR
    content = bool(words & CONTENT_WORDS)
    told = words & BOILERPLATE_WORDS
    if around > 0 or content:
        told = told - {"header"}  # an article's own header may hold its title
    if told and not (name in CONTENT and content) and name not in INLINE - {"span", "a"}:
        if told & clear:
            return -PRIOR
        return min(around, PRIOR // 2) if around > 0 else min(around, -PRIOR // 2)
    if said.get("aria-hidden", "").lower() == "true":
        return -PRIOR
    if name == "header" and around <= 0:
        return -PRIOR
    if name in CONTENT and not fixed:
        return PRIOR
    if content and name in ("div", "section", "td") and not fixed:
        return PRIOR if around >= 0 else 0  # in a boilerplate wrapper the text decides
    return None


class Block:
    __slots__ = ("parts", "linked", "element", "heading", "text")

    def __init__(self, element: Element):
        self.parts: list[str] = []
        self.linked = 0
        self.element, self.heading = element, False


def blocks(page: str) -> list[Block]:
    """Blocks of a page's text in page order."""
    root = Element("", None, "")
    node, out, block = root, [], None
    at, end = 0, len(page)

    def say(text: str) -> None:
        nonlocal block
        if not text or node.skipped:
            return
        if block is None:
            if text.isspace():
                return
            holder = node
            while holder.inline and holder.parent:
                holder = holder.parent
            block = Block(holder)
            block.heading = holder.name in HEADINGS
            out.append(block)
        block.parts.append(text)
        if node.linked:
            block.linked += len(text)

    def leave(names: set[str], borders: set[str]) -> None:
        """Ends the nearest open element of these names, if no border lies before it."""
        nonlocal node
        seek = node
        while seek.parent and seek.name not in names:
            if seek.name in borders:
                return
            seek = seek.parent
        if seek.parent:
            node = seek.parent

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if node.drawn and name in ENDS_DRAWING:
            leave({"svg"}, {"foreignobject"})
        inline = name in INLINE or node.drawn
        if not inline:
            block = None
        if name == "br":
            say(" ")
        if closing:
            if name not in VOID:
                leave({name}, {"table"} if inline or name == "p" else set())
            continue
        if name in VOID:
            continue
        if not inline:  # a new block ends an open paragraph
            leave({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "main", "body", "nav", "aside", "footer", "header", "form"})
        if name in CLOSES:
            leave(*CLOSES[name])
        if attributes.endswith("/") and (name == "svg" or node.drawn):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        node = Element(name, node, attributes)
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


FEATURES = 11


def text_features(b: Block) -> list[float]:
    text = b.text
    n = len(text)
    words = text.count(" ") + 1
    raw = max(1, sum(map(len, b.parts)))
    signs = text.count(",") + text.count(".") + text.count(";") + text.count("!") + text.count("?")
    share = b.linked / raw
    return [
        1.0, min(6.0, np.log1p(n)), min(5.0, np.log1p(words)), share, float(share > 0.5), min(1.0, 10 * signs / n), float(text[-1] in ".!?:;\"'…»”"),
        float(words < 4), float(b.heading), min(1.0, sum(map(str.isdigit, text)) / n * 4),
    ]


def page_features(found: list[Block]) -> np.ndarray:
    """Features of a page's blocks: each block's own, and how much text its
    container holds, against the fullest container of the page.  A container
    is the parent, or the block's element if that says itself what it is."""
    under: dict[int, int] = {}
    holders = []
    for b in found:
        parent = b.element.parent or b.element
        holder = id(parent if parent.prior == b.element.prior else b.element)
        holders.append(holder)
        under[holder] = under.get(holder, 0) + len(b.text)
    most = max(under.values(), default=1)
    return np.array([[*text_features(b), under[h] / most] for b, h in zip(found, holders)])


def train(features: np.ndarray, labels: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier with balanced classes (Newton steps)."""
    w = np.zeros(features.shape[1])
    if not len(labels) or labels.min() == labels.max():
        return w
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (weight * (labels - p)) - ridge * w
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def maximum_flow(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut, by blocking
    flows in level graphs.  ``edges`` count both ways."""
    n = len(source)
    s, t = n, n + 1
    heads: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(heads))
        heads.append(b)
        room.append(there)
        out[b].append(len(heads))
        heads.append(a)
        room.append(back)

    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            join(s, i, source[i] - both, 0)
        if sink[i] > both:
            join(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[heads[e]] < 0:
                    level[heads[e]] = level[a] + 1
                    queue.append(heads[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                keep = next(k for k, e in enumerate(path) if not room[e])
                a = heads[path[keep] ^ 1]
                del path[keep:]
                continue
            while nth[a] < len(out[a]):
                e = out[a][nth[a]]
                if room[e] and level[heads[e]] == level[a] + 1:
                    break
                nth[a] += 1
            if nth[a] < len(out[a]):
                path.append(out[a][nth[a]])
                a = heads[out[a][nth[a]]]
            elif a == s:
                break
            else:
                a = heads[path.pop() ^ 1]
                nth[a] += 1


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]], flow=maximum_flow) -> list[bool]:
    """Labels (True: content) of least cost.  ``gain``: cost of boilerplate
    minus cost of content; ties go to boilerplate."""
    n = len(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    gain = list(gain)
    total = [sum(x.values()) for x in near]
    todo = [i for i in range(n) if abs(gain[i]) > total[i] or not near[i]]
    while todo:  # a terminal that outweighs all edges settles its node
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = gain[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                gain[j] += c if label[i] else -c
                total[j] -= c
                if abs(gain[j]) > total[j] or total[j] == 0:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [(place[a], place[b], c) for a in rest for b, c in near[a].items() if a < b and b in place]
        side = flow([max(0, gain[i]) for i in rest], [max(0, -gain[i]) for i in rest], inner)
        for i, k in place.items():
            label[i] = side[k]
    return [bool(x) for x in label]


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours in page order and under one parent."""
    def closeness(a: Element, b: Element) -> int:
        x, y, deep = a, b, max(a.depth, b.depth, 1)
        while x is not y:
            if x.depth >= y.depth:
                x = x.parent
            else:
                y = y.parent
        return SMOOTH * x.depth // deep

    edges = [(i, i + 1, closeness(found[i].element, found[i + 1].element)) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.element.parent or b.element
        before = last.get(id(parent))
        if before is not None:
            edges.append((before, i, SMOOTH // 2))
        last[id(parent)] = i
    return edges


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    odds = np.clip(page_features(found) @ weights * 100, -TEXT_LIMIT, TEXT_LIMIT).astype(int)
    gain = [int(o) + b.element.prior - HIDDEN * b.element.hidden for o, b in zip(odds, found)]
    return "\n".join(b.text for b, content in zip(found, minimum_cut(gain, smoothness(found))) if content)


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the text classifier, from the blocks of sampled pages that
    the tree labels."""
    n = pages.count()
    chance = min(1.0, train_pages / max(1, n))

    def run(batches):
        for batch in batches:
            for h, page in zip(batch.column(0), batch.column(1).to_pylist()):
                found = blocks(page or "")
                clear = [i for i, b in enumerate(found) if abs(b.element.prior) == PRIOR]
                if len(clear) > PAGE_BLOCKS:  # evenly over a long page
                    clear = [clear[i * len(clear) // PAGE_BLOCKS] for i in range(PAGE_BLOCKS)]
                if clear:
                    x, y = page_features(found)[clear], bytes(found[i].element.prior > 0 for i in clear)
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([x.tobytes()], pa.binary()), pa.array([y], pa.binary())], ["h", "x", "y"])

    page = F.col("html").cast("string")
    hashed = pages.select(F.xxhash64(F.lit("train"), "page_id", page).alias("h"), page.alias("html"))
    sample = hashed.where(F.col("h") / F.lit(2.0**64) + 0.5 <= chance)
    got = sample.mapInArrow(run, "h long, x binary, y binary").orderBy("h", "x", "y").limit(2 * train_pages).toPandas()
    if not len(got):
        return np.zeros(FEATURES)
    x = np.concatenate([np.frombuffer(v).reshape(-1, FEATURES) for v in got["x"]])
    return train(x, np.concatenate([np.frombuffer(v, np.uint8) for v in got["y"]]).astype(int))


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = learn(pages, train_pages)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(page, weights) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
