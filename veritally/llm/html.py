"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node is the path of tags and classes from the root, with the
ways its children are laid out (presentation) and the text it holds (content) over all pages of the host.
Siblings of one name are nodes of their own, by number. On m pages with a node:

* presentation importance is the entropy of its layouts, relative to log m;
* content importance is one minus the mean evenness of the features of its branch. A feature found on c of the m
  pages has evenness log c / log m. Blocks of up to ``SHORT`` words are taken apart into words, each a feature, so that a
  template with a number or a name in it still comes back; a longer block is one feature, with the weight of its words.

Importance is (1 - GAMMA) * presentation + GAMMA * content: entropies alone, whatever the length or the names of a branch. On a
host with ``LEAST_PAGES`` pages with a node, branches go that come to less than ``THRESHOLD`` of the most important branch beside them. But parts of a text stay: nothing within an article,
nor within a branch that the tree has found to hold text of its own that matters (``OWN_WORDS`` words a page at least, directly
in it), is judged by the tree, as lists, tables and captions of an article have few and common words.

What comes anew on every page but isn't the article (a menu of the day, an advert) can't be told by entropy. So HTML's own words
are asked on every host: elements that are never article text (menus, footers, forms, ...) go by tag, role or class, and where a
page has an ``article`` or ``main`` element its text is the page's. A class or id speaks only as a whole: all its words must be words for noise, or
neutral ones beside one for noise ("site-header" goes, "header-image" and "post-header" stay), and never for headings and paragraphs. Inside an article only containers can go
by name. So a page comes out the same on a large host and on a small one, but for what the tree removes outside of articles.

Nodes are counted, never gathered: a host with a third of all pages costs a row for each feature and task. The tree is
``LEVELS`` containers deep; what lies deeper belongs to the last of them. Pages are read in one pass, in time linear in
their length, whatever their nesting or unclosed tags.

Null html counts as empty, and gives ''. A null url has no host and no tree. Broken markup is read leniently: a tag
without an end is text, one with an unbalanced quote ends at the next >. Repeated rows, null ids and empty tables are no
special cases, and other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, staged
from .bpe import byte_ranges

LEAST_PAGES = 5
GAMMA = 0.9
THRESHOLD = 0.6
#: Importance of a branch that holds text of its own, whatever is beside it.
HOLDING = 0.5
SHORT = 16
OWN_WORDS = 20
LEVELS = 64

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: A whole attribute: any name, and its value with quotes if there is one.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg object canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINER = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
#: Headings and paragraphs: their ids are anchors, and their classes say nothing about noise.
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_NOISE_TAGS = frozenset("head nav footer aside form script style noscript template svg iframe object canvas button select option input textarea dialog menu title audio video map".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "foot footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing beside one for noise.
_NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons container content global inner items left link links list main outer page primary right secondary section site top wrap wrapper".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that an opening tag of the key closes.
_CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
#: Elements that hold no text of a page.
_NEVER = frozenset("head script style noscript template svg iframe object canvas button select option input textarea title audio video map".split())
_LISTS = frozenset(("ul", "ol", "menu"))
_SCOPE = frozenset("article aside body div footer form header main nav ol section table td th ul dl blockquote".split())


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Scan:
    """Tags of a page in order. A search that finds nothing isn't repeated, so all of them together pass the page once."""

    def __init__(self, html: str):
        self.html, self.none = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def end(self, at: int) -> int:
        """Place of the > that ends a tag, quoted ones left out; -1 if there is none."""
        while True:
            if ">" in self.none or self.find(">", at) < 0:
                return -1
            m = _STOP.search(self.html, at)
            if m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end())
            at = close + 1 if close >= 0 else m.end()
            if close < 0:
                return self.find(">", at)

    def tags(self):
        """(start, end, closing, name, attributes) of each tag; without a name for comments and declarations."""
        html, at = self.html, 0
        while (at := self.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = len(html) if end < 0 else end + 3
                yield at, end, False, "", ""
            elif html[at + 1 : at + 2] in ("!", "?"):
                end = self.find(">", at)
                end = len(html) if end < 0 else end + 1
                yield at, end, False, "", ""
            else:
                m = _NAME.match(html, at)
                stop = self.end(m.end()) if m else -1
                if stop < 0:
                    at += 1
                    continue
                end = stop + 1
                skip = yield at, end, bool(m[1]), m[2].lower(), html[m.end() : stop]
                if skip is not None:
                    end = skip
                    yield
            at = end


class Page:
    """Elements of a page in order, each with its parent, and runs of text by block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.name, self.noise = ["#"], [-1], [""], [False]
        self.main, self.within, self.raw = [False], [False], [False]
        self.runs: list[tuple[int, int, str]] = []
        self.depths: dict[str, list[int]] = {}
        self.stack, block, at = [0], 0, 0
        scan = _Scan(html)
        tags = scan.tags()
        for start, end, closing, tag, attributes in tags:
            if start > at:
                self.runs.append((block, self.stack[-1], html[at:start]))
            at = end
            if not tag:
                continue
            if tag in _BLOCK:
                block += 1
            if closing:
                self._close(tag)
                continue
            if tag in _BLOCK and tag != "br":
                self._close("p", _SCOPE)
                for other in _CLOSES.get(tag, ()):
                    self._close(other, _SCOPE if other != "li" else _LISTS)
            i = self._open(tag, attributes, self.stack[-1])
            if tag in _RAW:
                close = _raw_end(tag).search(html, at)
                at = close.end() if close else len(html)
                tags.send(at)
            elif tag not in _VOID and (tag in _BLOCK or not attributes.endswith("/")):  # a slash doesn't close blocks
                self.depths.setdefault(tag, []).append(len(self.stack))
                self.stack.append(i)
        if at < len(html):
            self.runs.append((block, self.stack[-1], html[at:]))

    def _close(self, tag: str, scope: frozenset = frozenset()) -> None:
        mine = self.depths.get(tag)
        if not mine or any((at := self.depths.get(s)) and at[-1] > mine[-1] for s in scope):
            return
        depth = mine[-1]
        for i in self.stack[depth:]:
            self.depths[self.tag[i]].pop()
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        i, name, noise = len(self.tag), "", tag in _NOISE_TAGS
        main, raw, named = tag in ("article", "main"), tag in _NEVER, False
        within = self.within[parent]
        if attributes and not attributes.isspace():
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "class":
                    name = value
                if key == "role":
                    noise |= value in _NOISE_ROLES
                    main |= value in ("main", "article")
                elif key == "itemprop":
                    main |= value == "articlebody"
                elif key == "hidden":
                    raw = True
                elif key == "style":
                    raw |= "display:none" in value.replace(" ", "")
                elif key in ("class", "id") and tag not in ("html", "body"):
                    named |= self._named_noise(tag, value, within)
        if tag == "header" and not within:
            noise = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.name.append(f"{tag}.{name}" if name else tag)
        self.raw.append(raw)
        self.noise.append(noise or raw or named)
        self.main.append(main)
        self.within.append(main or within)
        return i

    @staticmethod
    def _named_noise(tag: str, value: str, within: bool) -> bool:
        """Whether a whole class or id names noise: in an article only for containers, elsewhere for all but headings and paragraphs."""
        if tag in _TEXT or (within and tag not in _CONTAINER):
            return False
        return any(not _NOISE_WORDS.isdisjoint(w) and not w - _NOISE_WORDS - _NEUTRAL_WORDS for w in (set(_WORDS.findall(name)) for name in value.split()))

    def paths(self) -> list[int]:
        """Names from the root to each element, each with its number among siblings of that name, as a 64-bit hash."""
        path, seen = [0], {}
        for i in range(1, len(self.tag)):
            like = self.parent[i], self.name[i]
            seen[like] = seen.get(like, -1) + 1
            path.append(_signed(xxhash.xxh64_intdigest(f"{path[self.parent[i]]}\n{self.name[i]}\n{seen[like]}".encode("utf-8", "surrogatepass"))))
        return path

    def profile(self):
        """(path, layout, containers above and itself) of each container, and {(path, hash): words} of each different feature directly in it."""
        n, path = len(self.tag), self.paths()
        gone, level = [False] * n, [0] * n
        holder, layout, above, last = [0] * n, {}, {}, {}
        for i in range(1, n):
            p = self.parent[i]
            gone[i] = gone[p] or self.raw[i]
            holder[i], level[i] = holder[p], level[p]
            if self.tag[i] in _CONTAINER and level[p] < LEVELS:
                holder[i], level[i] = i, level[p] + 1
                layout.setdefault(path[i], 0)
                above[path[i]] = [*above.get(path[holder[p]], ()), path[i]]
            if holder[p] == p and last.get(p) != self.name[i]:
                last[p] = self.name[i]
                layout[path[p]] = layout.get(path[p], 0) * 31 + xxhash.xxh32_intdigest(self.name[i].encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
        layout.pop(path[0], None)
        blocks = {}
        for block, i, run in self.runs:
            if not gone[i] and holder[i] and not run.isspace():
                blocks.setdefault((block, holder[i]), []).append(run)
        features = {}
        for (_, i), runs in blocks.items():
            words = "".join(runs).split()
            for feature in words if len(words) <= SHORT else [" ".join(words)]:
                features[path[i], xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass"))] = 1 if len(words) <= SHORT else len(words)
        return [(p, layout[p], above[p]) for p in layout], features

    def text(self, importance: dict[int, float] | None = None, prior: bool = True, holding: frozenset = frozenset()) -> str:
        """The page's text. ``importance``: of nodes of the tree; ``holding``: those with a text of their own; ``prior``: names decide too."""
        n, importance = len(self.tag), importance or {}
        holds = [False] * n  # an article somewhere below
        for i in range(n - 1, 0, -1):
            if (self.main[i] and not self.raw[i]) or holds[i]:
                holds[self.parent[i]] = True
        known = {}  # containers that the tree knows
        best = {}  # the most important of them by parent
        if importance:
            for i, p in enumerate(self.paths()):
                if p in importance and self.tag[i] in _CONTAINER and self.tag[i] != "body":
                    known[i] = p
                    best[self.parent[i]] = max(best.get(self.parent[i], 0.0), importance[p])
        gone, inside, whole = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            noise = self.noise[i] and not (holds[i] and self.tag[i] not in _NOISE_TAGS) if prior else self.raw[i]
            if i in known:
                article = prior and (self.main[i] or self.within[i] or holds[i])
                noise |= not (whole[p] or article) and importance[known[i]] < THRESHOLD * best[p]
                whole[i] = known[i] in holding
            gone[i] = gone[p] or noise
            whole[i] |= whole[p]
            inside[i] = inside[p] or (self.main[i] and not gone[i])
        only = prior and any(inside)
        out, held, current = [], [], -1
        for block, i, run in self.runs:
            if gone[i] or (only and not inside[i]):
                continue
            if block != current:
                out.append("".join(held))
                held, current = [], block
            held.append(unescape(run) if "&" in run else run)
        out.append("".join(held))
        return " ".join(s for s in (" ".join(b.split()) for b in out) if s)


def _profiles(batches):
    """mapInArrow function: (host, html) to (host, path, kind, look, words, above); kind 0 is a layout, 1 a feature."""
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            rows = []
            for h, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                nodes, features = Page(html or "").profile()
                rows += [(h, p, 0, layout, 0, above) for p, layout, above in nodes]
                rows += [(h, p, 1, feature, words, None) for (p, feature), words in features.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "kind", "look", "words", "above"])


def host() -> F.Column:
    return F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, presentation, content, importance, own_words, own_content) of every container node; own: without its containers."""
    rows = documents(pages, "url", "html").where("html is not null").select(host().alias("host"), "html").where("host is not null")
    looks = rows.mapInArrow(_profiles, "host string, path long, kind int, look long, words long, above array<long>").groupBy("host", "path", "kind", "look")
    looks = looks.agg(F.count("*").alias("c"), F.sum("words").alias("words"), F.min("above").alias("above"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    nodes = looks.groupBy("host", "path").agg(
        of(0, F.col("c")).alias("n_pages"), F.min("above").alias("above"), of(0, F.col("c") * F.log("c")).alias("layouts"), of(1, F.col("words") * F.log("c")).alias("even"), of(1, F.col("words")).alias("words")
    )
    log_m = F.greatest(F.log("n_pages"), F.lit(1e-9))
    single = F.col("n_pages") < 2
    nodes = nodes.withColumn("presentation", F.when(single, 1.0).otherwise(1 - F.col("layouts") / F.col("n_pages") / log_m)).withColumn("even", F.when(single, 0.0).otherwise(F.col("even") / log_m))
    nodes = staged(nodes.select("host", "path", "n_pages", "above", "presentation", "even", "words"), "style-nodes")
    branch = nodes.where("words > 0").select("host", F.explode("above").alias("path"), "even", "words").groupBy("host", "path").agg((1 - F.sum("even") / F.sum("words")).alias("content"))
    nodes = nodes.join(branch, ["host", "path"], "left").select("host", "path", "n_pages", "presentation", F.coalesce("content", F.lit(0.0)).alias("content"), "even", "words")
    own = F.when(F.col("words") > 0, 1 - F.col("even") / F.col("words")).otherwise(0.0)
    importance = (1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content")
    return nodes.select("host", "path", "n_pages", "presentation", "content", importance.alias("importance"), (F.col("words") / F.col("n_pages")).alias("own_words"), own.alias("own_content"))


class _Extract:
    """mapInArrow function: (page_id, url, html, nodes of its host with their importance, and those that hold text) to text."""

    def __init__(self, prior: bool):
        self.prior = prior

    def __call__(self, batches):
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                texts = []
                for html, nodes, values, holding in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    importance = dict(zip(nodes or (), values or (), strict=True))
                    texts.append(Page(html or "").text(importance, self.prior, frozenset(holding or ())))
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, prior: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Without the prior the tree alone decides, and what it hasn't seen often stays."""
    known = style_tree(pages).where(F.col("n_pages") >= LEAST_PAGES)
    holding = (F.col("importance") >= HOLDING) & (F.col("own_words") >= OWN_WORDS) & (F.col("own_content") >= HOLDING)
    node = F.collect_list(F.struct("path", "importance")).alias("node")
    verdicts = known.groupBy("host").agg(node, F.collect_list(F.when(holding, F.col("path"))).alias("holding")).select("host", F.col("node.path").alias("nodes"), F.col("node.importance").alias("values"), "holding")
    rows = documents(pages, "page_id", "url", "html").withColumn("host", host())
    marked = rows.join(staged(verdicts, "style-tree"), "host", "left").select("page_id", "url", "html", "nodes", "values", "holding")
    return marked.mapInArrow(_Extract(prior), "page_id long, url string, text string, n_chars long")
