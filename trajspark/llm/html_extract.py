"""HTML extraction: wrappers by union-free regular-expression inference.

A page is read into a tree of its structural elements (tag and class; inline markup is
ignored).  The wrapper of a host is the least general union-free expression that its pages
match: sequences of elements, in which runs of equal elements fold into a repeated group
(+), elements that only some pages have become optional (?), and texts that differ between
pages become slots.  Aligning two trees, or a tree and a wrapper, is the same step, so wrappers
are inferred per batch of pages, in parallel, and merged by host; a hot host sends one small
wrapper for each batch, merged in two levels.

The wrapper tells where a host's pages keep their content: all elements of the best rank of
article, main, elements marked as content, or body that it has.  Each page is then aligned with
its host's wrapper, and the slots under these elements are read.  A text that LEAST distinct pages
and SHARE of those with its place in the wrapper have there is a constant, not a slot, and is left
out, unless a page has nothing else; pages that differ in their HTML are distinct, so
near copies on most pages of a host count as constants too.  Elements marked as menus,
headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts or styles are left
out.  A name marks an element only as a whole (has-sidebar is
a state, not a sidebar), and paragraphs and headings only by the stronger words; html, body and main are never left out, nor is an element that holds the
only article, main or content element of a page.  A page that lacks the host's content element is read by
its own.  Blocks are joined by a line feed in page order, white space within a block becomes
one space, character references are decoded.

Bounds that lose no text: elements nested deeper than DEPTH only part blocks, and an element's
children beyond MOST have no place in its wrapper, so no constants are looked for there.  A tag
without an end is text; where quotes never close, tags end at the next '>'.

Null and empty pages give ''.  URLs without a host share one wrapper.  Repeated rows are read
each; an empty table gives an empty result; other columns are carried by `extract`.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import arrow_rows, cut, spread_join

OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NUMBER = re.compile(r"\d+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "select", "button", "label", "dialog", "menu"}
NOISE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "select", "button", "label", "fieldset", "dialog", "menu"}
_NOISE = r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|side-?bar|header|masthead|footer|cookies?|notice|consent|popup|modal|newsletter|subscribe|share|social|related|comments?|replies|disqus|widget)"
_PLACE = r"(?:site|page|main|blog|post|entry|article|global|top|bottom|left|right|primary|secondary|mobile|container|wrapper|wrap|inner|box|block|bar|list|item|items|area|section|links|buttons|posts|form|slot|unit|text)"
#: A whole name: noise words and words of place only; states such as no-sidebar or comments-open are none.
NOISE_NAME = re.compile(rf"(?:{_PLACE}[_-])*{_NOISE}(?:[_-](?:{_PLACE}|{_NOISE}))*", re.I)
NOISE_PART = re.compile(rf"(?:^|[_-]){_NOISE}(?:$|[_-])", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|content|post(?:-?body)?|entry(?:-?content)?|main|story)(?:$|[\s_-])", re.I)
#: Elements that an opening tag closes first.
CLOSES = {**{t: {"p"} for t in BLOCK - {"label", "button", "select"}}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
#: Names that mark a paragraph or heading as noise; the others of NOISE_NAME may name what it tells of.
STRONG = re.compile(r"ads?|advert\w*|sponsor\w*|cookies?|consent|notice|breadcrumbs?|newsletter|subscribe|byline-ads?", re.I)
SAID = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "tr", "figcaption"}
#: Characters of wrappers and constants up to which all are broadcast as one table.
BROADCAST_CHARS = 32 << 20
#: Levels of elements that are told apart, and children of an element that its wrapper holds.
DEPTH, MOST = 128, 1_000
#: A text is a constant of its place in the wrapper if at least LEAST distinct pages have it there, and SHARE of those that have the place.
LEAST, SHARE = 4, 0.8


class Node:
    """An element: label (tag and names), and its children, which are elements and texts."""

    __slots__ = ("label", "tag", "children")

    def __init__(self, label: str, tag: str):
        self.label, self.tag, self.children = label, tag, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open' or 'close', tag, attributes) in page order; raw elements and comments are left out.

    Every character is read a bounded number of times: where no '>' or closing quote follows
    any more, that is known from then on."""
    at, n, quotes = 0, len(page), True
    last = page.rfind(">")
    while at < n:
        m = OPEN.search(page, at)
        if m is None or m.start() > last and m[2]:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if m[2] is None:
            comment = page.startswith("<!--", m.start())
            end = page.find("-->" if comment else ">", m.end())
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        end = m.end()
        while quotes:
            stop = STOP.search(page, end)
            if stop is None:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            elif (end := page.find(stop[0], stop.end()) + 1) == 0:
                quotes = False
        if not quotes:
            end = page.find(">", m.end())
        tag, said = m[2].lower(), page[m.end() : end]
        at = end + 1
        if m[1]:
            yield "close", tag, ""
        elif tag not in RAW:
            yield "open", tag, said
        elif not said.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n


def parse(page: str) -> Node:
    """The tree of block elements of a page; unclosed elements end with their parents.

    Below DEPTH levels, elements are empty nodes where they begin and end, which part the texts."""
    root = Node("", "")
    stack, open_ = [root], Counter()
    deep: list[str] = []
    in_deep = Counter()
    for kind, tag, said in tokens(page):
        if kind == "text":
            stack[-1].children.append(tag)
        elif kind == "close":
            if in_deep[tag]:
                while (gone := deep.pop()) != tag:
                    in_deep[gone] -= 1
                in_deep[tag] -= 1
                stack[-1].children.append(Node("", ""))
            elif open_[tag]:
                deep.clear()
                in_deep.clear()
                while (gone := stack.pop()).tag != tag:
                    open_[gone.tag] -= 1
                open_[tag] -= 1
        elif tag == "br":
            stack[-1].children.append(" ")
        elif tag in BLOCK:
            closes = CLOSES.get(tag, ())
            if not deep:
                while len(stack) > 1 and stack[-1].tag in closes:
                    open_[stack.pop().tag] -= 1
            if len(stack) > DEPTH:
                deep.append(tag)
                in_deep[tag] += 1
                stack[-1].children.append(Node("", ""))
                continue
            names = {k.lower(): v.strip("\"'") for k, v in NAMED.findall(said)} if said else {}
            if names:  # numbers, and ids of articles, name the page, not the place
                names = {k: NUMBER.sub("#", v) for k, v in names.items() if k != "id" or tag != "article"}
            node = Node(" ".join([tag, *(f"{k}={names[k]}" for k in ("class", "id", "role") if k in names)]), tag)
            stack[-1].children.append(node)
            stack.append(node)
            open_[tag] += 1
    return root


def shape(node: Node) -> list:
    """[label, count flag, text, children]: flags '' once, '+' repeated, '?' optional, '*' both;
    text None without text, the text if constant, True for a slot."""
    said = " ".join(" ".join(c.split()) for c in node.children if isinstance(c, str)).strip()
    out: list = [node.label, "", (said if len(said) <= 40 else True) if said else None, []]
    for c in node.children:
        if not isinstance(c, str) and c.label and len(out[3]) < MOST:
            s = shape(c)
            if out[3] and out[3][-1][0] == s[0]:  # a repetition
                out[3][-1] = merge(out[3][-1], s)
                out[3][-1][1] = _both(out[3][-1][1], "+")
            else:
                out[3].append(s)
    return out


def _both(a: str, b: str) -> str:
    return b if not a else a if not b or a == b else "*"


def merge(a: list, b: list) -> list:
    """The least general expression that both match: aligns the children, mismatches become
    optional, neighbours that fall together repeat, differing texts become slots."""
    text = a[2] if a[2] == b[2] else True
    x, y = a[3], b[3]
    if [c[0] for c in x] == [c[0] for c in y]:
        kids = [merge(p, q) for p, q in zip(x, y, strict=True)]
        return [a[0], _both(a[1], b[1]), text, kids]
    # longest common subsequence of the labels, a row at a time
    number = {c[0]: k for k, c in enumerate((*x, *y))}
    across = np.array([number[c[0]] for c in y], np.int64)
    rows = [np.zeros(len(y) + 1, np.int16)]
    for c in reversed(x):
        below = rows[-1]
        met = np.maximum(below[:-1], np.where(across == number[c[0]], below[1:] + 1, 0))
        rows.append(np.append(np.maximum.accumulate(met[::-1])[::-1], 0).astype(np.int16))
    best = [r.tolist() for r in reversed(rows)]
    kids, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            new, i, j = merge(x[i], y[j]), i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            new, i = [x[i][0], _both(x[i][1], "?"), *x[i][2:]], i + 1
        else:
            new, j = [y[j][0], _both(y[j][1], "?"), *y[j][2:]], j + 1
        if kids and kids[-1][0] == new[0]:
            kids[-1] = merge(kids[-1], new)
            kids[-1][1] = _both(kids[-1][1], "+")
        else:
            kids.append(new)
    return [a[0], _both(a[1], b[1]), text, kids[:MOST]]


def _names(label: str) -> list[str]:
    """The single class, id and role names of a label."""
    return re.sub(r"(?:^| )(?:class|id|role)=", " ", label.partition(" ")[2]).split()


@lru_cache(100_000)
def _rank(label: str) -> int:
    tag = label.split(" ")[0]
    if tag == "article":
        return 0
    if tag == "main" or "role=main" in label:
        return 1
    if tag in ("div", "section") and any(CONTENT_NAMES.search(x) and not NOISE_PART.search(x) for x in _names(label)):
        return 2
    return 3 if tag == "body" else 9


@lru_cache(100_000)
def noisy(label: str) -> bool:
    """Whether an element is marked as noise; html, body and main never are."""
    tag = label.partition(" ")[0]
    if tag in ("html", "body", "main") or "role=main" in label:
        return False
    return tag in NOISE_TAGS or any((STRONG if tag in SAID else NOISE_NAME).fullmatch(x) for x in _names(label))


def content_rank(wrapper: list) -> int:
    """The best rank of the content elements outside noise."""
    label, _, _, kids = wrapper
    return min([_rank(label) if label else 9, *(content_rank(k) for k in kids if not noisy(k[0]))])


def _align(node: Node, wrapper: list | None, at: str = "") -> Iterator[tuple[Node, list | None, str]]:
    """The child elements of a node with their parts of the wrapper and their places in it."""
    kids, k = wrapper[3] if wrapper else [], 0
    places: dict[str, list[int]] = {}
    for i, kid in enumerate(kids):
        places.setdefault(kid[0], []).append(i)
    for c in node.children:
        if isinstance(c, str):
            continue
        if found := places.get(c.label):
            n = bisect_left(found, k)
            k = found[n if n < len(found) else 0]  # the next place of the label, or its first one
            yield c, kids[k], f"{at}/{k}"
        else:
            yield c, None, f"{at}/{c.label}"
            k = 0


Part = tuple[Node, "list | None", str]


def _roots(part: Part, rank: int) -> list[Part]:
    """The outermost elements of a content rank outside noise."""
    if _rank(part[0].label) == rank:
        return [part]
    return [r for c in _align(*part) if not noisy(c[0].label) for r in _roots(c, rank)]


def _best(node: Node) -> int:
    """The best content rank in an element, itself included."""
    return min([_rank(node.label), *(_best(c) for c in node.children if not isinstance(c, str))])


def _ranked(part: Part, rank: int) -> list[Part]:
    """The outermost elements of a content rank, noise or not."""
    return [part] if _rank(part[0].label) == rank else [r for c in _align(*part) for r in _ranked(c, rank)]


def _read(roots: list[Part], opened: bool = False) -> list[tuple[str, str]]:
    """(place in the wrapper, text) of the blocks under the roots; if opened, noise that holds a content element is read too."""
    blocks: list[tuple[str, list[str]]] = []

    def read(node: Node, wrapper: list | None, at: str) -> None:
        blocks.append((at, []))
        aligned = _align(node, wrapper, at)
        for c in node.children:
            if isinstance(c, str):
                blocks[-1][1].append(c)
                continue
            part = next(aligned)
            if not noisy(c.label) or opened and _best(c) <= 2:
                read(*part)
                blocks.append((at, []))

    for r in roots:
        read(*r)
    lines = ((at, " ".join(html.unescape("".join(b)).split())) for at, b in blocks if b)
    return [x for x in lines if x[1]]


def content_blocks(page: str | None, wrapper: list | None = None, rank: int = 9) -> list[tuple[str, str]]:
    """(place in the wrapper, text) of the blocks of a page under its content elements, all those of the
    host's content rank; a page without any is read by its own best rank."""
    if not page:
        return []
    tree = parse(page)
    whole = (tree, wrapper, "")
    roots = _roots(whole, rank) if rank <= 2 else []
    if not roots:
        rank = content_rank(shape(tree))
        roots = _roots(whole, rank) if rank < 9 else [whole]
    blocks = _read(roots)
    if blocks and rank <= 2 or (best := _best(tree)) > 2:
        return blocks
    # content elements, if any, stand in elements marked as noise
    return _read(roots, opened=True) if blocks else _read(_ranked(whole, best), opened=True)


def _key(at: str, text: str | None = None) -> int:
    """A number for a place, or for a text at a place."""
    return int.from_bytes(hashlib.blake2b((at if text is None else f"{at} {text}").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: str | None, wrapper: list | None = None, rank: int = 9, constants: frozenset = frozenset()) -> str:
    """The slots of a page: its content blocks without the host's constants; all blocks, if all are constants."""
    blocks = content_blocks(page, wrapper, rank)
    slots = [t for at, t in blocks if _key(at, t) not in constants] if constants else []
    return "\n".join(slots or [t for _, t in blocks])


def _parsed(wrappers: dict, w: str | None) -> tuple[list | None, int]:
    """A wrapper read from JSON, and its content rank."""
    if w not in wrappers:
        if len(wrappers) > 1_000:
            wrappers.clear()
        wrappers[w] = (None, 9) if w is None else (x := json.loads(w), content_rank(x))
    return wrappers[w]


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: dict[str, list] = {}
        seen = set()
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            if not page:
                continue
            s = shape(parse(page))
            if (key := (host, json.dumps(s))) in seen:
                continue
            seen.add(key)
            found[host] = merge(found[host], s) if host in found else s
        yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(w) for w in found.values()]}, dtype=object)


def _merge_all(pdf: pd.DataFrame) -> pd.DataFrame:
    out = None
    for w in sorted(set(pdf["wrapper"])):
        out = json.loads(w) if out is None else merge(out, json.loads(w))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(out)]})


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"://([^/?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of each host of pages(url, html), as JSON."""
    arrow_rows(pages.sparkSession)
    parts = pages.select(_host().alias("host"), F.col("html").cast("string")).mapInPandas(_infer, "host string, wrapper string").distinct()
    first = parts.withColumn("salt", F.expr("pmod(xxhash64(wrapper), 64)")).groupBy("host", "salt").applyInPandas(_merge_all, "host string, wrapper string")
    return first.groupBy("host").applyInPandas(_merge_all, "host string, wrapper string")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, place, key, page) of each place that a page has (key null) and each text there."""
    wrappers: dict = {}
    for batch in batches:
        rows = set()
        for host, page, w in zip(*(batch.column(c).to_pylist() for c in ("__host", "html", "__wrapper")), strict=True):
            if page:
                name = _key(page)
                for at, t in content_blocks(page, *_parsed(wrappers, w)):
                    rows |= {(host, p := _key(at), None, name), (host, p, _key(at, t), name)}
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "place", "key", "page"])


def infer_constants(source: DataFrame) -> DataFrame:
    """(host, constants): the keys of the texts that enough distinct pages of source(__host, html, __wrapper) have at the same place."""
    found = source.select("__host", "html", "__wrapper").mapInArrow(_places, "host string, place long, key long, page long")
    n = found.distinct().groupBy("host", "place", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    pages = n.where("key is null").select("host", "place", F.col("n").alias("of"))
    fixed = n.where("key is not null").join(pages, ["host", "place"]).where(F.col("n") >= SHARE * F.col("of"))
    return fixed.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("constants"))


def _beside(source: DataFrame, side: DataFrame) -> DataFrame:
    """source with the columns of side(__host, ...): broadcast while side is small, else joined by host, hot hosts apart."""
    size = side.agg(F.sum(sum(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in side.columns))).first()[0]
    if (size or 0) <= BROADCAST_CHARS:
        return source.join(F.broadcast(side), "__host", "left")
    pages = source.groupBy("__host").agg(F.count("*").alias("__n"))
    return spread_join(source, pages.join(side, "__host", "left"), ["__host"], "__n")


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, with text string and n_chars long; these names (in any case) are replaced where pages has them."""
    wrappers = cut(infer_wrappers(pages))
    kept = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    plain = pages.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)), F.col("html").cast("string").alias("html"), _host().alias("__host"))
    side = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    constants = cut(infer_constants(_beside(plain.select("html", "__host"), side)))
    source = _beside(plain, cut(side.join(constants.select(F.col("host").alias("__host"), F.col("constants").alias("__constants")), "__host", "left")))
    numbers = [f"__{i}" for i in range(len(kept))]
    schema = plain.select(*numbers).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict = {}
        fixed: dict[str, frozenset] = {}
        for batch in batches:
            texts = []
            for i, (page, w, host) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("html", "__wrapper", "__host")), strict=True)):
                if host not in fixed:
                    if len(fixed) > 1_000:
                        fixed.clear()
                    fixed[host] = frozenset(batch.column("__constants")[i].as_py() or ())
                texts.append(main_text(page, *_parsed(wrappers, w), fixed[host]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in numbers), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*numbers, "text", "n_chars"])

    out = source.select(*numbers, "html", "__wrapper", "__host", "__constants").mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(numbers, kept, strict=True)), "text", "n_chars")
