"""Main text of web pages, by site style trees.

The pages of a host are merged into one tree of element paths. A branch is told by how much of
it the host's pages share: of its content, the words, link targets and images (each by the
logarithm of the pages that have it, so that what one page has alone counts nothing and what
all have counts one), and of its presentation, by the entropy of its looks. A branch that is
shared far more than the rest of the host's text is of low importance, and is removed from
each page. Elements whose tag, role or class says what they are (menus, adverts, forms and
so on) go as well, which is all there is to go by on a host of a single page.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from doctriage.llm.common import BROADCAST_ROWS
from doctriage.llm.url_rules import url_host
from doctriage.session import written

SHARED_TIMES = 1.5          # a branch of low importance is shared so much more than the rest
SHARED_ERRORS = 3           # and by so many standard errors of its shared features
PRESENTATION = 0.1          # weight of a branch's looks against its content
KEPT_TAG = 200              # characters of a tag whose meaning a worker keeps
MAX_DEPTH = 64              # deeper elements count as part of the one at this depth

# --- fixed values: element and class names of HTML pages ---------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd
label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
CLOSES_PARAGRAPH = frozenset("""address article aside blockquote center details dialog dir div dl
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre
search section summary table ul""".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
              "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
DROPPED_TAGS = frozenset("""head nav footer aside form button select input dialog menu svg canvas
object audio video map search""".split())
DROPPED_ROLES = frozenset("""navigation banner contentinfo complementary search form dialog
alertdialog alert menu menubar toolbar""".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo
promotion promoted banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead
topbar cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup
modal overlay share sharing social related recommended recommendations widget toolbar pagination
pager comment comments commentlist disqus respond reply replies login skip copyright""".split())
HEADER_WORDS = frozenset(["header"])
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# A tag whose quotes all follow an equals sign or white space and close, as nearly all do.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"']*+)(?=[\s/>])"""
                  r"""((?:[^"'>]++|(?<=[= \t\n\r\f])(?:"[^"]*+"|'[^']*+'))*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tag_end(html: str, at: int) -> int:
    """The ``>`` that ends the tag at ``at``, quotes respected; -1 without one.

    A quote that never closes is taken as an ordinary character.
    """
    end = html.find(">", at)
    quote = at
    while end >= 0:
        double, single = html.find('"', quote, end), html.find("'", quote, end)
        opener = min((q for q in (double, single) if q >= 0), default=-1)
        if opener < 0 or html[opener - 1] not in "= \t\n\r\f":
            return end
        closer = html.find(html[opener], opener + 1)
        if closer < 0:
            return end
        quote = closer + 1
        if quote > end:
            end = html.find(">", quote)
    return -1


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag)}


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: text, open and close tags, in one pass over the page.

    An end that isn't there ends the page, so that a page of broken openers still takes linear time.
    """
    at, n = 0, len(html)
    while at < n:
        opener = html.find("<", at)
        if opener < 0:
            yield "text", "", html[at:]
            return
        if opener > at:
            yield "text", "", html[at:opener]
        if plain := _TAG.match(html, opener):
            closing, name, rest = plain.groups()
            name, at = name.lower(), plain.end()
        else:
            nxt = html[opener + 1:opener + 2]
            if html.startswith("<!--", opener):
                end = html.find("-->", opener + 4)
                if end < 0:
                    return          # an open comment runs to the end of the page
                at = end + 3
                continue
            if nxt in ("!", "?"):
                end = html.find(">", opener)
                if end < 0:
                    return
                at = end + 1
                continue
            closing = "/" if nxt == "/" else ""
            found = _NAME.match(html, opener + 1 + len(closing))
            if not found:
                yield "text", "", "<"
                at = opener + 1
                continue
            end = tag_end(html, opener)
            if end < 0:
                return              # an open tag runs to the end of the page
            name, rest, at = found[0].lower(), html[found.end():end], end + 1
        yield ("close" if closing else "open"), name, rest
        if name in RAW and not closing:
            end = find_close(html, f"</{name}", at)
            if end < 0:
                return
            at = end


def find_close(html: str, key: str, at: int) -> int:
    m = re.compile(re.escape(key) + r"(?=[\s/>])", re.I).search(html, at)
    return m.start() if m else -1


def unseen(name: str, attrs: dict[str, str]) -> bool:
    """Whether a browser shows nothing of the element."""
    return bool(name == "head" or name in RAW or "hidden" in attrs
                or attrs.get("aria-hidden", "").lower() == "true"
                or _HIDDEN.search(attrs.get("style", "")))


def told_apart(name: str, attrs: dict[str, str], in_main: bool) -> tuple[str, bool]:
    """An element's label in the tree, and whether its tag, role or class rules it out."""
    classes = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(classes)}
    header = name == "header" or words & HEADER_WORDS
    out = bool(name in DROPPED_TAGS or name in RAW
               or attrs.get("role", "").lower() in DROPPED_ROLES
               or unseen(name, attrs)
               or name not in ("html", "body") and words & DROPPED_WORDS
               or header and not in_main and name not in ("html", "body"))
    label = ".".join([name, *sorted(attrs.get("class", "").lower().split())])
    return label, out


@lru_cache(maxsize=20_000)
def element(name: str, rest: str, in_main: bool) -> tuple[str, bool, bool, str]:
    """Of an open tag: ``told_apart``, whether it is unseen, and its link target or image source."""
    attrs = attributes(rest)
    target = attrs.get("href" if name == "a" else "src" if name == "img" else "", "")
    return *told_apart(name, attrs, in_main), unseen(name, attrs), target


class Block(NamedTuple):
    path: str
    text: str
    in_main: bool       # inside an article or main element
    out: bool           # inside an element whose tag, role or class rules it out


def page_blocks(html: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    """The blocks of what is seen, in page order; and for each path its features other than
    words: children as ``<label``, link targets and image sources."""
    blocks: list[Block] = []
    parts: dict[str, list[str]] = {}
    # name, path, ruled out, in main, unseen
    stack: list[tuple[str, str, bool, bool, bool]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                place = next((s for s in reversed(stack) if s[0] not in INLINE), None)
                blocks.append(Block(place[1] if place else "", " ".join(words),
                                    bool(place and place[3]), bool(place and place[2])))

    def close(index: int) -> None:
        if any(s[0] not in INLINE for s in stack[index:]):
            flush()
        del stack[index:]

    for kind, name, rest in events(html or ""):
        if kind == "text":
            if not (stack and stack[-1][4]):
                text.append(rest)
        elif kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "table", "article", "main") and name in INLINE:
                    break
        elif name == "br":
            text.append(" ")
        else:
            if name in CLOSES_PARAGRAPH or name in SAME_LEVEL:
                for i in range(len(stack) - 1, -1, -1):
                    here = stack[i][0]
                    if here == "p" and name in CLOSES_PARAGRAPH or here in SAME_LEVEL.get(name, ()):
                        close(i)
                        break
                    if here not in INLINE:
                        break
            parent = stack[-1] if stack else ("", "", False, False, False)
            tell = element if len(rest) <= KEPT_TAG else element.__wrapped__
            label, out, alone, target = tell(name, rest, parent[3])
            inline = name in INLINE
            if not inline:
                flush()
            if target:
                parts.setdefault(parent[1], []).append(target)
            if name in VOID:
                continue
            deep = inline or parent[1].count("/") >= MAX_DEPTH
            path = parent[1] if deep else f"{parent[1]}/{label}"
            # Inside a block, what is ruled out can only go here: blocks go as a whole.
            hidden = parent[4] or alone or inline and out and not parent[2]
            if not inline and not hidden:
                parts.setdefault(parent[1], []).append(f"<{label}")
            if name in RAW:
                continue
            stack.append((name, path, out or parent[2], parent[3] or name in MAIN_TAGS, hidden))
    if not (stack and stack[-1][4]):
        flush()
    return blocks, parts


def code_of(text: str) -> int:
    code = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return code - (code >> 63 << 64)


@lru_cache(maxsize=20_000)
def branches_of(path: str) -> tuple[int, ...]:
    """The codes of the branches that hold the path, its own first, without the root.

    A heading belongs to the section that it heads: it is no branch of its own.
    """
    steps = path.split("/")
    while steps[-1].split(".")[0] in HEADINGS:
        steps.pop()
    return tuple(code_of("/".join(steps[:i])) for i in range(len(steps), 1, -1))


NODES = "host bigint, node bigint, look boolean, feature int, n bigint, words bigint, around array<bigint>"


def style_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` on ``host, html``: how many pages have each feature of each path.

    A look of a path on a page is its children, without repeats, and the binary digits of the
    number of its words; ``words`` and ``around`` go with looks.
    """
    for batch in batches:
        content: dict[tuple, Counter] = defaultdict(Counter)
        looks: Counter = Counter()
        sizes: Counter = Counter()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks, parts = page_blocks(html)
            words: dict[str, list[str]] = {}
            for block in blocks:
                words.setdefault(block.path, []).extend(block.text.split(" "))
            for path in filter(branches_of, {*words, *parts}):
                mine, more = words.get(path, []), parts.get(path, [])
                content[host, path].update({f for f in {*mine, *more} if f[0] != "<" or len(f) < 2})
                children = "".join(dict.fromkeys(x for x in more if x[0] == "<"))
                look = host, path, f"{children} {len(mine).bit_length()}"
                looks[look] += 1
                sizes[look] += len(mine)
        codes = {f: code_of(f) >> 32 for f in set().union(*content.values())}
        places = [(host, branches_of(path)[0], len(counts)) for (host, path), counts in content.items()]
        hosts, own, repeats = np.array(places, np.int64).reshape(-1, 3).T
        n = int(repeats.sum())
        nodes = [branches_of(path) for _, path, _ in looks]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.repeat(hosts, repeats), np.array([k[0] for k in looks], np.int64)])),
             pa.array(np.concatenate([np.repeat(own, repeats), np.array([k[0] for k in nodes], np.int64)])),
             pa.array(np.arange(n + len(looks)) >= n),
             pa.array([*map(codes.__getitem__, chain.from_iterable(content.values())),
                       *(code_of(k[2]) >> 32 for k in looks)], pa.int32()),
             pa.array([*chain.from_iterable(c.values() for c in content.values()), *looks.values()],
                      pa.int64()),
             pa.array([0] * n + [sizes[k] for k in looks], pa.int64()),
             pa.array([None] * n + nodes, pa.list_(pa.int64()))],
            names=["host", "node", "look", "feature", "n", "words", "around"])


def unimportant(pages: DataFrame) -> DataFrame:
    """``host, node`` of the branches of low importance, as codes. ``pages`` has ``host, html``.

    A branch that holds half of its host's words or more is never one.
    """
    counted = (pages.mapInArrow(style_counts, NODES).groupBy("host", "node", "look", "feature")
               .agg(F.sum("n").alias("n"), F.sum("words").alias("words"),
                    F.max("around").alias("around")))
    content, look = ~F.col("look"), F.col("look")
    of = lambda test, value: F.sum(F.when(test, value).otherwise(0))
    nodes = counted.groupBy("host", "node").agg(
        of(content, 1).alias("features"), of(content, F.log("n")).alias("shared"),
        of(look, F.col("n")).alias("seen"), of(look, F.col("n") * F.log("n")).alias("n_logs"),
        F.sum("words").alias("words"), F.max("around").alias("around"))
    # Of a node's looks: one less their entropy, against that of a look of its own on each page.
    alike = F.when(F.col("seen") > 1, F.col("n_logs") / (F.col("seen") * F.log("seen"))).otherwise(0)
    nodes = written(nodes.withColumn("alike", F.col("features") * alike), "style-nodes")
    sums = [F.sum(c).alias(c) for c in ("features", "shared", "alike", "words")]
    hosts = nodes.groupBy("host").agg(*(x.alias(f"all_{c}") for x, c in zip(
        (F.sum(c) for c in ("features", "shared", "alike", "words")),
        ("features", "shared", "alike", "words"))))
    sized = hosts.join(pages.groupBy("host").agg(F.log(F.count(F.lit(1))).alias("most")), "host")
    branches = (nodes.withColumn("node", F.explode("around")).groupBy("host", "node").agg(*sums)
                .join(sized, "host").filter("most > 0 AND features > 0 AND 2 * words < all_words"))
    rest = {c: F.col(f"all_{c}") - F.col(c) for c in ("features", "shared", "alike")}
    among = F.greatest(rest["features"], F.lit(1))

    def commonness(shared, looks, features):
        return (1 - PRESENTATION) * shared / (features * F.col("most")) + PRESENTATION * looks / features

    found, awaited = F.col("shared") / F.col("most"), (
        F.col("features") * rest["shared"] / (among * F.col("most")))
    return branches.filter(
        (commonness(F.col("shared"), F.col("alike"), F.col("features"))
         >= SHARED_TIMES * commonness(rest["shared"], rest["alike"], among))
        & (found - awaited >= SHARED_ERRORS * F.sqrt(awaited + 0.25))).select("host", "node")


def main_text(html: str | None, removed: list[int] | None, names: bool = True) -> str:
    """The page's blocks outside the removed branches, one to a line; with ``names``, also
    without what tags, roles and classes rule out, or is outside an article or main element."""
    blocks, _ = page_blocks(html)
    if names:
        blocks = [b for b in blocks if not b.out]
        if any(b.in_main for b in blocks):
            blocks = [b for b in blocks if b.in_main]
    if gone := set(removed or ()):
        blocks = [b for b in blocks if gone.isdisjoint(branches_of(b.path))] or blocks
    return "\n".join(b.text for b in blocks)


def extract(names: bool):
    """For ``mapInArrow`` on ``id, url, html, removed``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, r, names) for h, r in zip(batch.column(2).to_pylist(),
                                                            batch.column(3).to_pylist())]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])
    return run


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
               html_column: str = "html", names: bool = True) -> DataFrame:
    """One row per page: ``id, url, text, n_chars``.

    Character references are decoded, white space within a block becomes one space, and
    blocks follow each other in page order, one to a line. When a page has an article or
    main element, only what is in one counts. A null or empty page, or one of markup only,
    has an empty text. When the branches of low importance hold all of a page's text they
    stay. Without ``names`` the style tree alone decides. Pages without a host share the empty host. Repeated rows each get a row; other
    columns are not read.
    """
    hosted = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"),
                          F.col(html_column).alias("html"),
                          F.xxhash64(url_host(url_column)).alias("host"))
    low = written(unimportant(hosted.select("host", "html")), "unimportant")
    lists = low.groupBy("host").agg(F.collect_set("node").alias("removed"))
    if low.count() <= BROADCAST_ROWS:       # two numbers a row
        lists = F.broadcast(lists)
    kind = dict(pages.dtypes)[id_column]
    return (hosted.join(lists, "host", "left").select("id", "url", "html", "removed")
            .mapInArrow(extract(names), f"id {kind}, url string, text string, n_chars bigint")
            .withColumnsRenamed({"id": id_column, "url": url_column}))
