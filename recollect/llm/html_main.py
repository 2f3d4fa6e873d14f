"""Main text of web pages by a minimum cut.

A page falls into blocks of text. A classifier, fitted here on blocks whose markup names them, gives each block
log-odds of being content; they are its capacities to the two terminals. Blocks that follow each other and blocks
of one parent are joined by smoothness edges, the weaker the further apart they are in the tree. The minimum cut
separates content from boilerplate: the labelling of least cost, and of several the one with least content.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, slices, tidy

#: Pages whose blocks teach the classifier, most frequent patterns of features taken from them, and as how many observations they count against the prior.
SAMPLE, PATTERNS, STRENGTH = 2000, 4096, 60.0
#: Cost of different labels of neighbours with one parent, its half-life in steps through the tree, cost for earlier siblings, the part that stays where markup names the two differently, and the most that one block weighs.
NEXT, FADE, SIBLING, UNLIKE, LIMIT = 2.0, 2.0, 1.0, 0.25, 9.0

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math canvas object select datalist button audio video head".split())
#: An opening tag of the first set ends an open element of the second, unless an element of the third stands between.
CLOSES = [
    (frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split()), frozenset(["p"]), frozenset("table td th caption button object".split())),
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu table".split())),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset("dl table".split())),
    (frozenset(["tr"]), frozenset(["tr"]), frozenset(["table"])),
    (frozenset(["td", "th", "tr"]), frozenset(["td", "th"]), frozenset(["table"])),
    (frozenset(["body"]), frozenset(["head"]), frozenset()),
]

#: What words in class, id and role say of an element.
NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar tabs toc skip",
    "top": "header masthead banner branding logo",
    "foot": "footer foot copyright colophon contentinfo imprint",
    "side": "sidebar side aside rail widget complementary related recommended recommendation trending popular teaser",
    "notice": "cookie consent gdpr notice alert notification popup modal overlay disclaimer privacy paywall",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted",
    "comment": "comment commentlist reply replies discussion disqus respond",
    "form": "form login signin signup subscribe subscription newsletter search",
    "share": "share sharing social follow",
    "content": "article content post entry story main text body",
}
_NAMED = {w: k for k, words in NAMES.items() for w in words.split()}
#: Each feature's prior weight, in log-odds. The first ones are the markup that names blocks; `bias` is always there.
FEATURES = {
    "tag_nav": -5.0, "tag_footer": -5.0, "tag_aside": -5.0, "tag_form": -4.0, "tag_header": -4.0, "tag_article": 3.0, "tag_main": 1.5, "hidden": -6.0,
    "name_nav": -5.0, "name_top": -3.5, "name_foot": -5.0, "name_side": -5.0, "name_notice": -5.0, "name_ad": -6.0, "name_comment": -6.0, "name_form": -4.0, "name_share": -4.5, "name_content": 1.5,
    "bias": -1.0, "in_p": 1.2, "heading": 0.6, "item": -0.3, "cell": -0.2, "quote": 0.8, "links_some": -0.8, "links_most": -3.0, "words_5": 0.5, "words_12": 1.0, "words_30": 0.8, "words_80": 0.8, "words_200": 0.8, "sentence": 1.0, "comma": 0.3, "sign": -2.5,
}
BIT = {name: 1 << k for k, name in enumerate(FEATURES)}
#: Features that name a block's role, those of them that say boilerplate, and those that say content.
ROLES = sum(BIT[x] for x in FEATURES if x.startswith(("tag_", "name_", "hidden")))
BOILER = ROLES & ~(BIT["tag_article"] | BIT["tag_main"] | BIT["name_content"])
_TAGS = {"nav": BIT["tag_nav"], "footer": BIT["tag_footer"], "aside": BIT["tag_aside"], "article": BIT["tag_article"], "main": BIT["tag_main"]}
_KINDS = {"p": BIT["in_p"], "li": BIT["item"], "dt": BIT["item"], "dd": BIT["item"], "td": BIT["cell"], "th": BIT["cell"], "blockquote": BIT["quote"], "pre": BIT["quote"], "figcaption": BIT["quote"]} | {f"h{k}": BIT["heading"] for k in range(1, 7)}
_KIND = sum(BIT[x] for x in ("in_p", "item", "cell", "quote", "heading"))

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in RAW}


@lru_cache(8192)
def _named(attributes: str) -> int:
    """The features that an element's attributes give."""
    mask = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for w in _WORD.findall(value):
                w = w.lower()
                kind = _NAMED.get(w) or _NAMED.get(w[:-1] if w.endswith("s") else w)
                if kind:
                    mask |= BIT[f"name_{kind}"]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            mask |= BIT["hidden"]
    return mask


class Page:
    """The blocks of a page, in order: text, features, depth, the least depth since the block before, and the parent's number."""

    def __init__(self, source: str):
        self.text: list[str] = []
        self.mask: list[int] = []
        self.depth: list[int] = []
        self.low: list[int] = []
        self.parent: list[int] = []
        self.form: list[int] = []  # the number of the form around, or -1
        self._parts: list[str] = []
        self._linked = 0
        # an open element: name, features, number of block elements around it, its own number, its parent's, the form's, and for each rule the place of the element that it may end
        self._open: list[tuple] = [("", BIT["bias"], 0, 0, -1, -1, (-1,) * len(CLOSES))]
        self._count: dict[str, int] = {}
        self._numbers, self._least, self._links, self._dropped = 0, 0, 0, 0
        self._read(source)
        self._forms()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                close = _END[name].search(source, at)
                at = close.start()
                self._end(name)
        self._say(source[at:])
        self._flush()

    def _say(self, raw: str) -> None:
        if self._dropped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._links:
            self._linked += len(text)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
            return
        if name in VOID and name in INLINE:
            return
        for k, (opening, _, _) in enumerate(CLOSES):
            if name in opening and self._open[-1][6][k] >= 0:
                self._cut(self._open[-1][6][k])
        block = name not in INLINE
        if block:
            self._flush()
        if name in VOID:
            return
        _, mask, depth, number, parent, form, ends = self._open[-1]
        if block:
            own = _named(attributes) if attributes else 0
            mask = mask & ~_KIND | (mask & (BIT["item"] | BIT["cell"] | BIT["quote"])) | own | _TAGS.get(name, 0) | _KINDS.get(name, 0)
            if name == "header" and not mask & (BIT["tag_article"] | BIT["tag_main"]):
                mask |= BIT["tag_header"]
            if mask & BIT["name_top"] and mask & BIT["tag_article"] and not self._open[-1][1] & BIT["name_top"]:
                mask &= ~BIT["name_top"]  # the head of an article is no head of a page
            self._numbers += 1
            parent, number, depth = number, self._numbers, depth + 1
            if name == "form":  # what it is called says no more than that it is one
                form, mask = number, mask & ~BIT["name_form"]
        if name == "a":
            self._links += 1
        if name in DROPPED:
            self._dropped += 1
        place = len(self._open)
        ends = tuple(place if name in ended else -1 if name in fence else e for e, (_, ended, fence) in zip(ends, CLOSES, strict=True))
        self._open.append((name, mask, depth, number, parent, form, ends))
        self._count[name] = self._count.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if not self._count.get(name):
            return
        place = len(self._open) - 1
        while self._open[place][0] != name:
            place -= 1
        self._cut(place)

    def _cut(self, place: int) -> None:
        """Closes the open elements from this place on."""
        if any(x[0] not in INLINE for x in self._open[place:]):
            self._flush()
        for x in self._open[place:]:
            self._count[x[0]] -= 1
            self._links -= x[0] == "a"
            self._dropped -= x[0] in DROPPED
        del self._open[place:]
        self._least = min(self._least, self._open[-1][2])

    def _flush(self) -> None:
        if not self._parts:
            return
        raw = "".join(self._parts)
        self._parts, linked, self._linked = [], self._linked, 0
        text = " ".join(raw.split())
        if not text:
            return
        _, mask, depth, _, parent, form, _ = self._open[-1]
        self.text.append(text)
        self.mask.append(mask | _said(text, linked / max(len(raw), 1)))
        self.depth.append(depth)
        self.low.append(min(self._least, depth))
        self.parent.append(parent)
        self.form.append(form)
        self._least = depth

    def _forms(self) -> None:
        """A form that holds half of a page's text or more is the page's frame, not a form to fill in."""
        held: dict[int, int] = {}
        for f, t in zip(self.form, self.text, strict=True):
            held[f] = held.get(f, 0) + len(t)
        half = sum(held.values()) / 2
        self.mask = [m | BIT["tag_form"] if f >= 0 and held[f] < half else m for m, f in zip(self.mask, self.form, strict=True)]

    def edges(self) -> list[tuple[int, int, int]]:
        """Smoothness edges (block, block, capacity): to the block before, and to the block before it of the same parent."""
        out, last = [], {}
        for i, parent in enumerate(self.parent):
            before = last.get(parent, -1)
            if i:
                steps = self.depth[i - 1] + self.depth[i] - 2 * self.low[i]
                w = self._alike(i - 1, i, NEXT * 2 ** (-max(steps - 2, 0) / FADE))
                if w:
                    out.append((i - 1, i, w))
            if 0 <= before < i - 1:
                out.append((before, i, self._alike(before, i, SIBLING)))
            last[parent] = i
        return out

    def _alike(self, i: int, j: int, cost: float) -> int:
        return round(1000 * cost * (UNLIKE if (self.mask[i] ^ self.mask[j]) & BOILER else 1))


def _said(text: str, linked: float) -> int:
    """The features of a block's own text."""
    words = text.count(" ") + 1
    mask = 0
    for least, name in ((5, "words_5"), (12, "words_12"), (30, "words_30"), (80, "words_80"), (200, "words_200")):
        if words >= least:
            mask |= BIT[name]
    if linked >= 0.5:
        mask |= BIT["links_most"]
    elif linked >= 0.15:
        mask |= BIT["links_some"]
    if re.search(r"[.!?。！？](?:\W|$)", text):
        mask |= BIT["sentence"]
    if ", " in text or "、" in text or "，" in text:
        mask |= BIT["comma"]
    if "©" in text or " | " in text:
        mask |= BIT["sign"]
    return mask


def min_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source's side of the minimum cut, the smallest such side.

    gains: capacity from the source if positive, to the sink if negative. A node whose capacity is over the sum of its
    edges is on its own side in every minimum cut, so it leaves with its edges added to its neighbours' gains; what stays is cut by
    maximum flow along shortest paths.
    """
    n = len(gains)
    gains, near = [*gains], [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    held = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(gains[i]) > held[i] or not held[i])
    while queue:
        i = queue.popleft()
        if side[i] is not None:
            continue
        side[i] = gains[i] > 0
        for j, w in near[i].items():
            if side[j] is None:
                held[j] -= w
                gains[j] += w if side[i] else -w
                if abs(gains[j]) > held[j] or not held[j]:
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, yes in zip(rest, _max_flow(rest, gains, near), strict=True):
            side[i] = yes
    return side


def _max_flow(nodes: list[int], gains: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Whether each node is reached from the source once flow is at its most: blocking flows over levels."""
    number = {i: k for k, i in enumerate(nodes)}
    n = len(nodes)
    s, t = n, n + 1
    head, room, out = [], [], [[] for _ in range(n + 2)]

    def pipe(a: int, b: int, w: int, back: int) -> None:
        out[a].append(len(head))
        head.append(b)
        room.append(w)
        out[b].append(len(head))
        head.append(a)
        room.append(back)

    for k, i in enumerate(nodes):
        if gains[i] > 0:
            pipe(s, k, gains[i], 0)
        elif gains[i] < 0:
            pipe(k, t, -gains[i], 0)
        for j, w in near[i].items():
            if j in number and number[j] > k:
                pipe(k, number[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        at, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                w = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= w
                    room[e ^ 1] += w
                    if not room[e] and not cut:
                        cut = k + 1
                a = head[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] and level[head[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = head[path[-1]]
            elif a == s:
                break
            else:
                a = head[path.pop() ^ 1]
                at[a] += 1


def main_text(source: str, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by spaces."""
    page = Page(source)
    if not page.text:
        return ""
    masks = np.array(page.mask, np.int64)
    odds = ((masks[:, None] >> np.arange(len(FEATURES))) & 1) @ weights
    gains = np.rint(1000 * np.clip(odds, -LIMIT, LIMIT)).astype(np.int64).tolist()
    return " ".join(t for t, yes in zip(page.text, min_cut(gains, page.edges()), strict=True) if yes)


def patterns(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """content, mask, n: how many blocks whose markup says content or boilerplate have these features. Each counts twice, with and without the markup that says so, so that the text's own features learn too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, 0, 1 << 20):
                found = [m for raw in as_bytes(batch.column(0)) for m in Page(raw.decode("utf-8", "replace")).mask]
                mask = np.array(found, np.int64)
                boiler, content = mask & BOILER != 0, mask & (BIT["tag_article"] | BIT["tag_main"]) != 0
                mask, boiler = mask[boiler | content], boiler[boiler | content]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(~boiler, 2)), pa.array(np.concatenate([mask, mask & ~ROLES]))], ["content", "mask"])

    return bound_batches(pages).select(F.col(html_col).alias("h")).mapInArrow(tidy(run), "content boolean, mask bigint").groupBy("content", "mask").agg(F.count("*").alias("n"))


def learn(content: np.ndarray, mask: np.ndarray, n: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Weights of the features: logistic regression about the prior weights by Newton's method; both classes weigh the same, and together as `strength` observations."""
    prior = np.array([*FEATURES.values()])
    w, count = prior.copy(), n.astype(float)
    share = np.zeros(len(count))
    for side in (content, ~content):
        if count[side].sum():
            share[side] = count[side] / count[side].sum() * strength / 2
    x = ((mask[:, None] >> np.arange(len(prior))) & 1).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (share * (p - content)) + (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from the blocks of about `sample` pages, those whose html has the smallest hashes, by at most PATTERNS patterns. Without pages they are the prior's."""
    hashed = pages.select(html_col, F.xxhash64(F.col(html_col)).alias("_hash"))
    top = hashed.select("_hash").distinct().orderBy("_hash").limit(sample).agg(F.max("_hash").alias("m")).first().m  # one number
    if top is None:
        return np.array([*FEATURES.values()])
    picked = hashed.filter(F.col("_hash") <= top).dropDuplicates(["_hash"])
    rows = patterns(picked, html_col).orderBy(F.desc("n"), "mask", "content").limit(PATTERNS).toPandas()
    return learn(rows["content"].to_numpy(bool), rows["mask"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every page.

    A null or empty html, and one without content, has an empty text. Columns that are not kept are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, 0):
                texts = [main_text(raw.decode("utf-8", "replace"), weights) if raw else "" for raw in as_bytes(batch.column(0))]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return bound_batches(pages).select(F.col(html_col).alias("_html"), *keep).mapInArrow(tidy(run), f"{kinds}, text string, n_chars bigint")
