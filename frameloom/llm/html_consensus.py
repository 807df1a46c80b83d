"""HTML main text by consensus host paths.

Each page's containers are scored by the text that they hold (outside links and outside what is plainly not the article),
and the page votes for its best container's generalised path: tags and first classes from the body down, without digits.
Votes are summed by host in Spark, and every page is extracted again at its host's winning path. A page that has no such
element, or no votes on its host, uses its own best container.

Paths are the nodes of a tree with links to their parents, so scores are sums over subtrees, and a page of any depth and
any markup takes time and memory in proportion to its length.

What goes from inside the winning container: elements that are never an article's (``NEVER``), hidden ones, those whose class
or id has a word that is itself a name of what isn't the article (``OTHER``: class="ad"), and containers (``HOLDERS``) with such
a name as a part (class="related-posts"). Weak names (``WEAK``: header, share, notice, ...) never take text away there by
themselves, but only with links: an element so named goes if half its text is link text. In the voting they don't count.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by one newline. Nothing else is dropped and nothing is capped.

Defined cases: null or empty html, or a page without text, gives an empty text; a null or unreadable url is a host of its
own (the empty name); repeated pages vote each, and each is extracted; tied paths go by weight, then by name; unclosed and
stray tags follow the usual implied ends; a tag, comment or raw element that the page doesn't end takes the rest of the page;
a quote that nothing closes is an ordinary character; columns other than the three named are not read, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import checkpointed
from ._text import release

#: Fixed values of HTML: elements without content, blocks, raw text, and elements that are never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NEVER = frozenset("nav header footer aside form button select option menu dialog svg canvas object audio video map head fieldset label input".split())
#: Elements that hold others; names of parts matter on these alone.
HOLDERS = frozenset("div section ul ol dl table tbody figure span details center".split())
#: Words in a class or id that name what isn't the article, and weaker ones, which an article's own parts may have too.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist reply replies disqus cookie cookies consent login menu modal nav navbar navigation newsletter pagination pager popup promo promos promoted promotion related recommended recommendations sidebar sponsor sponsored subscribe subscription".split()
)
WEAK = frozenset("alert footer header hidden masthead notice respond share sharing side skip social tags toolbar topbar widget widgets".split())
#: Words that say that a container is laid out around such a part, not that it is one; then the name counts as weak.
AROUND = frozenset("has no with without wrap wrapper layout page".split())
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
_P_ENDS = BLOCK - {"body", "html"}
#: For elements whose end is implied: the kind of each, and the kinds that a new one ends.
_KIND = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_ENDS = {"li": (1,), "dt": (2,), "dd": (2,), "tr": (3, 4), "td": (4,), "th": (4,), "option": (5,)}
_SCOPE = frozenset("article aside body blockquote div dl fieldset footer form header html main nav ol section table td th ul".split())
_CELLS = frozenset(("td", "th"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTR = re.compile(r"""([^\s=/"'>][^\s=/>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?+""")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[a-z]+")


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


_RAW_END = {t: _raw_end(t) for t in RAW}


def named(names: str, tag: str) -> tuple[bool, bool]:
    """Whether a class or id names the element as none of the article's, and whether it does so weakly."""
    sure = weak = False
    for word in names.lower().split():
        parts = _PARTS.findall(word)
        if not any(p in OTHER for p in parts):
            weak = weak or any(p in WEAK for p in parts)
        elif len(parts) == 1 or tag in HOLDERS and not any(p in AROUND for p in parts):
            sure = True
        else:
            weak = weak or tag in HOLDERS
    return sure, weak


class _Scanner:
    """The markup of a page, each part looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.closed: dict[str, bool] = {}

    def __iter__(self):
        """(start, end, kind, tag, attributes): kind is '' for an opening tag, '/' for an end tag, '!' for what is no element."""
        page, at, end = self.page, 0, len(self.page)
        while (start := page.find("<", at)) >= 0:
            nxt = page[start + 1 : start + 2]
            if nxt == "!" or nxt == "?":
                comment = page.startswith("<!--", start)
                stop = page.find("-->", start + 4) + 3 if comment else page.find(">", start) + 1
                if stop < 3 if comment else not stop:
                    stop = end
                yield start, stop, "!", "", ""
                at = stop
                continue
            closing = nxt == "/"
            name = _NAME.match(page, start + 1 + closing)
            if not name:
                at = start + 1
                continue
            stop = self._end(name.end())
            yield start, stop, "/" if closing else "", name.group().lower(), page[name.end() : stop - 1]
            at = stop
            if not closing and (tag := name.group().lower()) in RAW:
                close = _RAW_END[tag].search(page, at) if self.closed.get(tag, True) else None
                if close is None:
                    self.closed[tag] = False  # nor is there one further on
                at = close.end() if close else end
                yield stop, at, "!", "", ""

    def _end(self, at: int) -> int:
        page, end = self.page, len(self.page)
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= end:
                return end
            mark = page[at]
            if mark == ">":
                return at + 1
            at = page.find(mark, at + 1) + 1 if at < self.last[mark] else at + 1


class _Element:
    __slots__ = ("tag", "node", "skip", "link", "weak", "scope", "near", "index")

    def __init__(self, tag, node, skip, link, weak, scope, near, index):
        self.tag, self.node, self.skip, self.link, self.weak, self.scope, self.near, self.index = tag, node, skip, link, weak, scope, near, index


class Tree:
    """A page's blocks under its generalised paths. ``parent`` and ``step`` of each path's node (0: the page); ``blocks``:
    (text, characters in links, node, weak element or 0); ``weak``: for each weakly named element its node, the weak element
    around it, and the characters of text and of links in it."""

    def __init__(self, page: str):
        self.parent, self.step, self.children = [0], [""], [{}]
        self.blocks: list[tuple[str, int, int, int]] = []
        self.weak: list[list[int]] = [[0, 0, 0, 0]]
        self._read(page)
        for i in range(len(self.weak) - 1, 0, -1):
            self.weak[self.weak[i][1]][2] += self.weak[i][2]
            self.weak[self.weak[i][1]][3] += self.weak[i][3]

    def _node(self, parent: int, step: str) -> int:
        own = self.children[parent].get(step)
        if own is None:
            own = self.children[parent][step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
            self.children.append({})
        return own

    def _read(self, page: str) -> None:
        none = (0, 0, 0, 0, 0, 0)
        stack = [_Element("", 0, False, False, 0, 0, none, 0)]
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack of each tag's open elements
        buffer: list[str] = []
        linked = at = 0

        def flush():
            nonlocal linked
            if buffer:
                text = " ".join(_html.unescape("".join(buffer)).split())
                top = stack[-1]
                if text and not top.skip:
                    mine = min(linked, len(text))
                    self.blocks.append((text, mine, top.node, top.weak))
                    self.weak[top.weak][2] += len(text)
                    self.weak[top.weak][3] += mine
                buffer.clear()
            linked = 0

        def cut(k: int):
            for e in stack[k:]:
                opened[e.tag].pop()
            del stack[k:]

        def gather(upto: int):
            nonlocal linked
            if upto > at and not stack[-1].skip:
                piece = page[at:upto]
                buffer.append(piece)
                if stack[-1].link:
                    linked += len(piece.strip())

        for start, stop, kind, tag, rest in _Scanner(page):
            gather(start)
            at = stop
            if kind == "!":
                continue
            block = tag in BLOCK
            if block and not kind and opened.get("head"):  # a head ends where the body's content begins
                cut(opened["head"][-1])
            if kind:
                places = opened.get(tag)
                k = places[-1] if places else 0
                if not k:
                    if block:
                        flush()
                elif block or k >= stack[-1].scope:
                    if block or stack[k].skip or any(e.tag in BLOCK for e in stack[k:]):
                        flush()
                    cut(k)
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in RAW:
                if tag == "textarea":
                    flush()
                continue
            if block:
                flush()
                near = stack[-1].near
                if tag in _P_ENDS and near[0]:
                    cut(near[0])
                    near = stack[-1].near
                if tag in _ENDS and (k := max(near[i] for i in _ENDS[tag])):
                    cut(k)
            if tag in VOID or rest.endswith("/") and not block:
                continue
            top = stack[-1]
            attrs = {}
            if rest and not rest.isspace():
                for name, value in _ATTR.findall(rest):
                    attrs.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" and value else value)
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            skip = top.skip or tag in NEVER and not (tag == "header" and opened.get("article")) or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            weak = top.weak
            if names and not skip and tag not in ("body", "html"):
                sure, weakly = named(names, "div" if tag in ("article", "main") else tag)
                if tag in ("article", "main"):  # a page's article may be called anything but these
                    skip, weak = sure and any(w in names.lower() for w in ("comment", "repl", "related", "promo")), 0
                else:
                    skip = sure
                    if weakly and not sure:
                        self.weak.append([0, top.weak, 0, 0])
                        weak = len(self.weak) - 1
            if skip and not top.skip:
                flush()
            node = top.node
            if block:
                first = (attrs.get("class") or attrs.get("id") or "").split()
                node = self._node(node, tag + ("." + _DIGITS.sub("", first[0]).lower() if first else ""))
            if weak != top.weak:
                self.weak[weak][0] = node if block else -1
            place = len(stack)
            kept = top.near if tag not in _SCOPE else none if tag not in _CELLS else (0, 0, 0, *top.near[3:])
            if (own := _KIND.get(tag)) is not None:
                kept = (*kept[:own], place, *kept[own + 1 :])
            stack.append(_Element(tag, node, skip, top.link or tag == "a", weak, place if tag in _SCOPE else top.scope, kept, place))
            opened[tag].append(place)
        if at < len(page):
            gather(len(page))
        flush()

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def find(self, path: str) -> int | None:
        node = 0
        for step in path.split(">") if path else ():
            node = self.children[node].get(step)
            if node is None:
                return None
        return node

    def under(self, node: int) -> list[bool]:
        """For each path's node, whether it is the given one or below it."""
        out = [False] * len(self.parent)
        out[node] = True
        for i in range(node + 1, len(out)):
            out[i] = out[self.parent[i]]
        return out

    def best(self) -> tuple[int, float] | None:
        """The node with the highest score and its score; depth, then name, break ties. Text in weakly named elements counts only if there is no other."""
        for weakly in (False, True):
            held = [0.0] * len(self.parent)
            for text, linked, node, weak in self.blocks:
                if weakly or not weak:
                    held[node] += max(0.0, len(text) - 2.0 * linked)
            for i in range(len(held) - 1, 0, -1):
                held[self.parent[i]] += held[i]
            scored = [(v * _weight(self.step[i]), i) for i, v in enumerate(held) if v > 0]
            if scored:
                top = max(scored)[0]
                ties = [i for v, i in scored if v == top]
                return (ties[0] if len(ties) == 1 else min(ties, key=lambda i: ((p := self.path(i)).count(">"), p))), top
        return None

    def text(self, node: int) -> str:
        inside = self.under(node)
        #: A weakly named element below the container goes with its text if that is half links.
        gone = [False] * len(self.weak)
        for i in range(1, len(gone)):
            at, around, size, linked = self.weak[i]
            gone[i] = gone[around] or at > 0 and at != node and inside[at] and size > 0 and 2 * linked >= size
        return "\n".join(text for text, _, at, weak in self.blocks if inside[at] and not gone[weak])

    def holds(self, node: int) -> bool:
        inside = self.under(node)
        return any(inside[b[2]] for b in self.blocks)


def _weight(step: str) -> float:
    tag, _, name = step.partition(".")
    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "pre", "dt", "dd", "blockquote", "ul", "ol", "figcaption"):
        return 0.2
    base = {"article": 2.0, "main": 1.6, "body": 0.9, "html": 0.5, "": 0.4}.get(tag, 1.0)
    return base * (1.4 if name and GOOD.search(name) else 1.0)


def best_path(page: str) -> tuple[str, float] | None:
    tree = Tree(page)
    own = tree.best()
    return (tree.path(own[0]), own[1]) if own else None


def extract(page: str | None, path: str | None) -> str:
    """The text of the page's elements at the path; at its own best path if it has none there."""
    if not page:
        return ""
    tree = Tree(page)
    node = tree.find(path) if path is not None else None
    if node is None or not tree.holds(node):
        own = tree.best()
        if own is None:
            return ""
        node = own[0]
    return tree.text(node)


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: str) -> "F.Column":
    """The host of a url, in lower case; empty if it can't be read."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, votes, weight: what the pages of each host vote for."""

    def run(batches):
        for batch in batches:
            out: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0.0])
            for of, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (own := page.as_py()) and (best := best_path(own)):
                    cell = out[of, best[0]]
                    cell[0] += 1
                    cell[1] += round(best[1])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.float64())], names=["host", "path", "votes", "weight"])
        release()

    each = pages.select(host(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, votes long, weight double")
    return each.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight"))


def winners(counted: DataFrame) -> DataFrame:
    """host, path: the path with most votes, then most weight, then the first by name."""
    top = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("weight")).alias("w"), "path"))
    return counted.groupBy("host").agg(top.alias("top")).select("host", F.col("top.path").alias("path"))


#: Winners are broadcast up to so many bytes of hosts and paths; beyond, pages are joined by (host, salt), winners once for each salt.
SMALL = 64 << 20
SALTS = 64


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", small: int = SMALL) -> DataFrame:
    """One row for each page: key, url, text, n_chars, host, path."""
    chosen = checkpointed(winners(votes(pages, url, html)))
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    own = pages.select(F.col(key).alias("row_key"), F.col(url).alias("url"), F.col(html).alias("html"), host(url).alias("host"))
    if size <= small:
        joined = own.join(F.broadcast(chosen), "host", "left")
    else:
        salted = own.withColumn("salt", F.pmod(F.xxhash64("row_key", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(chosen.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), ["host", "salt"], "left")
    joined = joined.select("row_key", "url", "html", "host", "path")
    schema = T.StructType([joined.schema["row_key"], *[T.StructField(c, T.StringType()) for c in ("url", "text")], T.StructField("n_chars", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [extract(page.as_py(), path) for page, path in zip(batch.column(2), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3), batch.column(4)], names=schema.names)
        release()

    return joined.mapInArrow(run, schema).withColumnRenamed("row_key", key)
