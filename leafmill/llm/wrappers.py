"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host."""
from __future__ import annotations

import html as entities
import json
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, wraps
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free_name, ship, stored
from leafmill.llm.html import INLINE, Node, parse

OPTIONAL, REPEATED = 1, 2
TEXT = "#"
#: Weight of content in items whose tag or class names say boilerplate.
HINTED = 0.1
#: Of more than this share of the text outside links of the pages it stands on, a constant is no template: those pages are copies.
MOST_TEXT = 0.5
#: Elements that running text is made of.
FLOW = INLINE | set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th figure figcaption hr".split())

# Elements that rarely hold main text, and words of class, id or role that say so.
NO_TEXT = set(
    "head script style noscript template iframe noframes noembed object svg math canvas audio video map nav footer aside form button select textarea option datalist dialog menu xmp title".split()
)
BOILERPLATE = set(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments disqus reply replies respond
    discussion share sharing social related recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb
    breadcrumbs pagination pager footer masthead toolbar login search contentinfo complementary dialog form""".split()
)
MAIN_WORDS = ({"articlebody"}, {"article", "body"}, {"article", "content"}, {"post", "content"}, {"post", "body"}, {"entry", "content"}, {"main", "content"}, {"story", "body"}, {"main"})

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# An item of a wrapper is a list: key, flags, constant text (0: a slot), pages, characters, characters in links, items,
# characters outside links of all pages it stands on (items named as boilerplate left out, unless they hold all). All numbers add up, so a wrapper
# says the same however its pages were grouped.


def _text_item(text: str, in_link: bool) -> list | None:
    words = text.split()
    if not words:
        return None
    size = sum(map(len, words))
    return [TEXT, 0, crc32(" ".join(words).encode("utf-8", "surrogatepass")) or 1, 1, size, size if in_link else 0, [], 0]


def any_depth(walk: Callable) -> Callable:
    """Lets a function's walks go as deep as pages nest: they call themselves from Python only, which takes no room on the C stack."""

    @wraps(walk)
    def run(*args):
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 1 << 30))
        try:
            return walk(*args)
        finally:
            sys.setrecursionlimit(limit)

    return run


@any_depth
def page_wrapper(root: Node) -> list:
    """The expression of one page: its token stream with tandem repeats folded."""
    free_text = all_text = 0

    def build(node: Node, in_link: bool, free: bool) -> list:
        nonlocal free_text, all_text
        in_link = in_link or node.tag == "a"
        free = free and not in_link and not is_boilerplate(node.tag, node.hints)
        items = []
        for child in node.children:
            if isinstance(child, str):
                item = _text_item(child, in_link)
                if item:
                    free_text += item[4] if free else 0
                    all_text += 0 if in_link else item[4]
                    items.append(item)
            elif child.tag not in ("script", "style"):
                items.append(build(child, in_link, free))
        items = fold(items)
        return [node.key, 0, 0, 1, sum(i[4] for i in items), sum(i[5] for i in items), items, 0]

    def set_around(item: list) -> None:
        item[7] = free_text or all_text
        for x in item[6]:
            set_around(x)

    whole = build(root, False, True)
    set_around(whole)
    return whole


@any_depth
def merge_item(a: list, b: list, same_page: bool) -> list:
    """One wrapper for two of one host; texts that differ become a slot. ``same_page``: both are of the same pages."""
    return _merge_item(a, b, same_page)


def _merge_item(a: list, b: list, same_page: bool) -> list:
    constant = a[2] if a[2] == b[2] else 0
    items = merge_items(a[6], b[6], same_page) if a[6] or b[6] else []
    pages, around = (max(a[3], b[3]), max(a[7], b[7])) if same_page else (a[3] + b[3], a[7] + b[7])
    return [a[0], a[1] | b[1], constant, pages, a[4] + b[4], a[5] + b[5], items, around]


def _next_period(keys: list[str], after: int) -> int | None:
    """Smallest length above ``after`` at which a group of siblings follows itself.

    A length is a distance between two equal keys that follow one another; a unit in which
    some key stands once has its own length among these.
    """
    last: dict[str, int] = {}
    gaps = set()
    for i, key in enumerate(keys):
        if key in last and i - last[key] > after:
            gaps.add(i - last[key])
        last[key] = i
    codes = None
    for size in sorted(gaps):
        if size == 1:
            return size
        if codes is None:
            numbers: dict[str, int] = {}
            codes = np.array([numbers.setdefault(k, len(numbers)) for k in keys])
        differs = np.flatnonzero(codes[:-size] != codes[size:])
        runs = np.diff(np.concatenate(([-1], differs, [len(keys) - size])))
        if len(runs) and runs.max() > size:
            return size
    return None


def fold(items: list) -> list:
    """Tandem repeats of groups of siblings become one repeated item or group, shorter groups first."""
    size = 0
    while len({x[0] for x in items}) < len(items):  # else no key twice: nothing repeats
        size = _next_period([x[0] for x in items], size)
        if size is None:
            break
        i, out = 0, []
        while i < len(items):
            keys = [x[0] for x in items[i : i + size]]
            j = i + size
            unit = items[i : i + size]
            again = False
            while len(unit) == size and [x[0] for x in items[j : j + size]] == keys:
                unit = [_merge_item(x, y, True) for x, y in zip(unit, items[j : j + size])]
                again = True
                j += size
            if again and size == 1:
                unit[0][1] |= REPEATED
                out.append(unit[0])
            elif again:
                out.append(_group(unit))
            else:
                out.append(items[i])
                j = i + 1
            i = j
        items = out
    return items


def _group(unit: list) -> list:
    return ["(" + " ".join(x[0] for x in unit) + ")", REPEATED, 0, max(x[3] for x in unit), sum(x[4] for x in unit), sum(x[5] for x in unit), unit, max(x[7] for x in unit)]


def _regroup(items: list, groups: dict[str, list[str]]) -> list:
    """Sequences that the other side has as a group become that group."""
    for keys in groups.values():
        size, i, out = len(keys), 0, []
        while i < len(items):
            if [x[0] for x in items[i : i + size]] == keys:
                out.append(_group(items[i : i + size]))
                i += size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of keys, by the places where they match."""
    places: dict[str, list[int]] = {}
    for j, key in enumerate(b):
        places.setdefault(key, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, key in enumerate(a):
        for j in reversed(places.get(key, ())):
            k = bisect_left(tails, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k] = j
                links[k] = link
    out = []
    link = links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def merge_items(a: list, b: list, same_page: bool) -> list:
    """Aligns two sequences: what matches is merged, what does not is optional, repeats are folded again."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b)):
        return fold([_merge_item(x, y, same_page) for x, y in zip(a, b)])
    groups_a = {x[0]: [y[0] for y in x[6]] for x in a if x[0][0] == "("}
    groups_b = {x[0]: [y[0] for y in x[6]] for x in b if x[0][0] == "("}
    a, b = _regroup(a, {k: v for k, v in groups_b.items() if k not in groups_a}), _regroup(b, {k: v for k, v in groups_a.items() if k not in groups_b})
    out, i, j = [], 0, 0
    for x, y in [*align([k[0] for k in a], [k[0] for k in b]), (len(a), len(b))]:
        out += [[item[0], item[1] | OPTIONAL, *item[2:]] for side in (a[i:x], b[j:y]) for item in side]
        if x < len(a):
            out.append(_merge_item(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return fold(out)


def has_main_words(hints: tuple[str, ...]) -> bool:
    return any(w <= set(hints) for w in MAIN_WORDS)


def is_boilerplate(tag: str, hints) -> bool:
    return tag in NO_TEXT or (tag not in ("html", "body") and any(h in BOILERPLATE for h in hints))


def _split_key(key: str) -> tuple[str, list[str]]:
    tag, *hints = key.split(".")
    return tag, hints


def _weight(key: str) -> float:
    """What the tag and the class names of an item make of its content: they weigh it, they do not decide."""
    tag, hints = _split_key(key)
    if is_boilerplate(tag, hints):
        return HINTED
    return 2.0 if tag in ("article", "main") or (tag not in ("html", "body") and has_main_words(tuple(hints))) else 1.0


def below(path: object, key: str) -> int:
    """Name of the path that leads on to ``key``; the same within a process."""
    return hash((path, key))


@any_depth
def read_wrapper(wrapper: list) -> tuple[tuple | None, frozenset, frozenset]:
    """What a wrapper says of its host's pages: the way to the main region, paths of the template, paths of hinted boilerplate.

    An item is template if its texts are the same wherever it stands, none of them optional,
    and it stands on most of the host's pages; all pages are counted. Pages may also agree
    because they are copies or near copies of one text, so an item is no template if it
    holds more than ``MOST_TEXT`` of the text of the pages it stands on, nor are the items
    beside it that stand on no other pages; nor are items of one parent that together hold
    so much. Content is the text of all other items outside links, weighed by their tags
    and class names. The main region is found from the top down: as long as one item
    holds most of the content, step into it, but not into parts of an article or main
    element, nor past a heading that is content. An item whose names say boilerplate is left out
    unless it holds most of the content even so. Inside a region below the body, elements of
    running text stay, also if all pages have them: only boxes are left out there. A path is left out only if all its items are. The way is None
    for one page, and for hosts whose pages say the same throughout.
    """
    pages = wrapper[3]

    def has_slot(item: list) -> bool:
        found = item[0] == TEXT and item[2] == 0
        for x in item[6]:
            found = found or has_slot(x)
        return found

    if pages < 2 or not has_slot(wrapper):
        return None, frozenset(), frozenset()

    # pages, text outside links and text around of each constant: alignment may put equal boxes of one path in several items
    signs: dict[int, int] = {}
    constants: dict[object, dict[tuple, list]] = {}

    def find_constants(item: list, path: object) -> int | None:
        """Signature of an item's texts; None if they vary."""
        found: list = [item[0], item[2]]
        for x in item[6]:
            sign = find_constants(x, below(path, x[0]) if x[0] != TEXT and x[0][0] != "(" else path)
            found.append(None if x[1] & OPTIONAL else sign)
            if sign is not None and x[0] != TEXT and x[0][0] != "(" and x[4] > 0:
                signs[id(x)] = sign
                total = constants.setdefault(path, {}).setdefault((x[0], sign), [0, 0, 0])
                for k, n in enumerate((x[3], x[4] - x[5], x[7])):
                    total[k] += n
        if (item[0] == TEXT and item[2] == 0) or None in found:
            return None
        return hash(tuple(found))

    find_constants(wrapper, "")
    shared: set[int] = set()  # items that are template

    @lru_cache(maxsize=None)
    def verdicts_at(path: object) -> tuple[set, set]:
        """Constants below a path that most pages have, and those of them that are template."""
        on_most = {k: v for k, v in constants.get(path, {}).items() if 2 * v[0] > pages}
        named = {k for k in on_most if is_boilerplate(*_split_key(k[0]))}
        found = {k: v for k, v in on_most.items() if k not in named}
        copied = max((v[0] for v in found.values() if v[1] > MOST_TEXT * v[2]), default=0)
        found = {k: v for k, v in found.items() if v[0] > copied}
        if sum(v[1] for v in found.values()) > MOST_TEXT * max((v[2] for v in found.values()), default=0):
            found = {}
        return set(on_most), named | set(found)

    def mark(item: list, path: object) -> None:
        for x in item[6]:
            if x[0] == TEXT:
                continue
            if x[0][0] == "(":
                mark(x, path)
                continue
            on_most, template = verdicts_at(path)
            own = (x[0], signs.get(id(x)))
            if own in template:
                shared.add(id(x))
            elif own not in on_most:
                mark(x, below(path, x[0]))

    mark(wrapper, "")
    held: dict[int, tuple[float, float]] = {}  # content of an item: weighed by its own names and without them

    def weigh(item: list) -> float:
        total = 0.0
        if item[0] == TEXT:
            total = item[4] - item[5]
        elif id(item) not in shared:
            for x in item[6]:
                total += weigh(x)
        weight = 1.0 if item[0] == TEXT or item[0][0] == "(" else _weight(item[0])
        held[id(item)] = (total * weight, total)
        return total * weight

    weigh(wrapper)

    def inside(item: list) -> list[list]:
        out = []
        for x in item[6]:
            if x[0][0] == "(":
                out += inside(x)
            elif x[0] != TEXT:
                out.append(x)
        return out

    item, way, trusted = wrapper, [], False
    while True:
        whole = held[id(item)][1]
        best = max(inside(item), key=lambda x: held[id(x)][0], default=None)
        if not whole or best is None or held[id(best)][0] < 0.7 * whole or best[1] & REPEATED:
            break
        tag = best[0].split(".")[0]
        if tag in INLINE or tag in ("p", "h1", "h2", "h3", "ul", "ol", "table"):
            break
        if trusted and _weight(best[0]) <= 1 or any(_split_key(x[0])[0] in HEADINGS and held[id(x)][0] for x in inside(item)):
            break  # all of an article is its text; a heading belongs to what follows it
        item = best
        trusted = trusted or _weight(best[0]) > 1
        way.append(below(way[-1] if way else "", best[0]))
    verdicts: dict[int, set[str]] = {}

    def stays(x: list) -> bool:
        """Running text, if it stands in the region."""
        return _split_key(x[0])[0] in FLOW and 2 * (x[4] - x[5]) > x[4]

    def visit(at: list, path: object, scale: float, in_region: bool) -> None:
        for x in at[6]:
            if x[0] == TEXT:
                continue
            if x[0][0] == "(":
                visit(x, path, scale, in_region)
                continue
            own = below(path, x[0])
            said = verdicts.setdefault(own, set())
            hinted = is_boilerplate(*_split_key(x[0]))
            if id(x) in shared and not (in_region and not hinted and stays(x)):
                said.add("template")
            elif hinted and held[id(x)][0] <= 0.5 * scale:
                said.add("hinted")
            else:
                said.add("content")
                visit(x, own, held[id(x)][1] if hinted else scale, in_region or (bool(way) and own == way[-1] and _split_key(x[0])[0] not in ("html", "body")))

    visit(wrapper, "", held[id(wrapper)][1], False)
    template = frozenset(p for p, said in verdicts.items() if said == {"template"})
    return tuple(way), template, frozenset(p for p, said in verdicts.items() if said in ({"hinted"}, {"hinted", "template"}))


def main_nodes(root: Node) -> list[Node]:
    """Where the main text of a page without a wrapper stands: its articles, else its main element, else what is named so, else all."""
    articles, mains, named = [], [], []

    def visit(node: Node, depth_named: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                continue
            if is_boilerplate(child.tag, child.hints) and child.tag != "main":
                if not (child.tag == "article" and not {"comment", "comments", "reply", "related", "ad", "ads", "sponsored", "promo"} & set(child.hints)):
                    continue
            if child.tag == "article":
                articles.append(child)
                continue
            if child.tag == "main":
                mains.append(child)
            elif has_main_words(child.hints) and not depth_named and child.tag not in ("html", "body"):
                named.append(child)
            visit(child, depth_named or (has_main_words(child.hints) and child.tag not in ("html", "body")))

    visit(root, False)
    return articles or mains or named or [root]


def text_blocks(node: Node, path: object, left_out: Callable[[Node, object], bool]) -> list[str]:
    """Blocks of text below a node, without the elements that ``left_out`` names by their node and path."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    def walk(at: Node, own: object, heads_only: bool) -> None:
        for child in at.children:
            if isinstance(child, str):
                if not heads_only:
                    held.append(child)
                continue
            if child.tag == "br":
                held.append(" ")
                continue
            path = below(own, child.key)
            if left_out(child, path):
                flush()
                continue
            only = (heads_only or child.tag == "header" or "header" in child.hints) and child.tag not in HEADINGS
            if child.tag in INLINE:
                walk(child, path, only)
            else:
                flush()
                walk(child, path, only)
                flush()

    walk(node, path, False)
    flush()
    return blocks


@any_depth
def main_text(html: str, way: Sequence | None, template: frozenset, hinted: frozenset = frozenset()) -> str:
    """Main text of one page: blocks in page order, one a line; character references decoded, white space in a block one space.

    With a wrapper, the text stands in the region at the end of ``way``, or, where a page
    has none or an empty one, in the nearest element on the way that has text; items of
    ``template`` and ``hinted`` are left out. Without (``way`` is None) tags and class names
    decide. Class names never empty a page: one with all its text in elements named as
    boilerplate keeps that text, without the template and the tags that hold no main text.
    """
    root = parse(html)
    by_tag = lambda node, path: node.tag in NO_TEXT or path in template
    if way is None:
        steps = [[(n, "") for n in main_nodes(root)]]
        by_name = lambda node, path: is_boilerplate(node.tag, node.hints)
    else:
        steps = [[(root, "")]]
        for step in way:
            found = [(c, step) for n, path in steps[-1] for c in n.children if not isinstance(c, str) and below(path, c.key) == step]
            if not found:
                break
            steps.append(found)
        by_name = lambda node, path: path in hinted or path in template
    for left_out in (by_name, by_tag):
        for nodes in reversed(steps):
            text = "\n".join(b for node, path in nodes for b in text_blocks(node, path, left_out))
            if text:
                return text
    return ""


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*//([^/?#]*)", 1), F.lit("")))


def dump_wrapper(wrapper: list) -> str:
    """A wrapper as JSON of one level: its items in order, each with the number of its items in their place."""
    flat, open_items = [], [wrapper]
    while open_items:
        item = open_items.pop()
        flat.append([*item[:6], len(item[6]), item[7]])
        open_items += reversed(item[6])
    return json.dumps(flat, separators=(",", ":"))


def load_wrapper(dumped: str) -> list:
    around: list[tuple[list, int]] = []  # open items, each with the number of items still to come
    flat = json.loads(dumped)
    for item in flat:
        if around:
            parent, more = around.pop()
            parent.append(item)
            if more > 1:
                around.append((parent, more - 1))
        if item[6]:
            around.append((inner := [], item[6]))
            item[6] = inner
        else:
            item[6] = []
    return flat[0]


def _merge_all(wrappers) -> str:
    whole = None
    for w in wrappers:
        one = load_wrapper(w)
        whole = one if whole is None else merge_item(whole, one, False)
    return dump_wrapper(whole)


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", hosts_held: int = 500) -> DataFrame:
    """``host, wrapper``: one expression per host, from all of its pages.

    Every task aligns its pages host by host and gives one wrapper for each, so the hottest
    host moves one small row per task, not its pages; these meet in 256 groups a host first
    and then in one. A wrapper's size follows the variety of a host's layouts, not its pages.
    Null pages count as empty.
    """
    ship(pages.sparkSession)

    def infer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(h, dump_wrapper(w)) for h, w in held.items()], columns=["host", "wrapper"])
            held.clear()
            return out

        for part in parts:
            for host, page in zip(part["host"], part["html"]):
                one = page_wrapper(parse(page or ""))
                held[host] = merge_item(held[host], one, False) if host in held else one
                if len(held) >= hosts_held:
                    yield flush()
        yield flush()

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(part["host"].iloc[0], _merge_all(sorted(part["wrapper"])))], columns=["host", "wrapper"])

    parts = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInPandas(infer, "host string, wrapper string")
    parts = cut(parts).withColumn("deal", F.pmod(F.xxhash64("wrapper"), F.lit(256)))
    return parts.groupBy("host", "deal").applyInPandas(meet, "host string, wrapper string").groupBy("host").applyInPandas(meet, "host string, wrapper string")


@lru_cache(maxsize=2000)
def _read(wrapper: str) -> tuple[tuple | None, frozenset, frozenset]:
    return read_wrapper(load_wrapper(wrapper))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text`` (replacing a column of that name): the main text of each page by its host's wrapper.

    Wrappers come to the pages by a join on the host. They are written first, so Spark knows
    their size: it broadcasts them if they are small, so that no page moves, and otherwise
    splits a hot host's partition. Null pages give empty text.
    """
    wrappers = stored(infer_wrappers(pages, url, html), "wrappers")
    host, wrapper = free_name(pages, "host_"), free_name(pages, "wrapper_")
    wrappers = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, found in parts:
            yield pd.Series([main_text(p or "", *_read(w)) for p, w in zip(page, found)], dtype=object)

    joined = pages.withColumn(host, host_of(F.col(url))).join(wrappers, host)
    rest = [c for c in pages.columns if c.lower() != text.lower()]
    return joined.select(*rest, run.asNondeterministic()(F.col(html), F.col(wrapper)).alias(text))
