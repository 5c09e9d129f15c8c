"""A lenient reader of HTML: tokens, and the tree that end tags and implied ends give."""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# Names of elements, as the HTML standard groups them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An element ends where one of these begins, unless one of the second set stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ASSIGNED_QUOTE = re.compile(r"""=\s*(["'])""")
RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
#: A tag whose attributes are few and written with double quotes: the common case, in one step.
SIMPLE_TAG = re.compile(r"""<(/?[A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z-]+(?:="[^"]*")?)*\s*/?)>""")
ROLE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=""", re.I)


class Node:
    """An element: its tag, the words of its class, id, role and itemprop, and its children (elements and texts)."""

    __slots__ = ("children", "hints", "key", "tag")

    def __init__(self, tag: str, hints: tuple[str, ...] = ()):
        self.tag = tag
        self.hints = hints
        self.key = tag + "".join(f".{h}" for h in hints)
        self.children: list[Node | str] = []


def hint_words(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and itemprop, without digits, sorted, once each."""
    if not ROLE.search(attributes):
        return ()
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "")
            found.update(w for w in re.split(r"[^a-z]+", value.lower()) if w)
    return tuple(sorted(found))


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: text (as written), start with its attributes, end. Comments and declarations give none."""
    at, n = 0, len(html)
    no_quote = {'"': n + 1, "'": n + 1}  # from here on there is no such quote
    while at < n:
        start = html.find("<", at)
        if start < 0:
            yield "text", "", html[at:]
            return
        if start > at:
            yield "text", "", html[at:start]
        m = SIMPLE_TAG.match(html, start)
        if m:
            name, rest, at = m[1].lower(), m[2], m.end()
        elif html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            continue
        else:
            m = NAME.match(html, start + 1)
            if not m:
                yield "text", "", "<"
                at = start + 1
                continue
            end = m.end()
            while True:  # a '>' inside quotes does not end the tag
                close = html.find(">", end)
                if close < 0:
                    close = n
                    break
                quote = ASSIGNED_QUOTE.search(html, end, close)
                if not quote or quote.end() >= no_quote[quote[1]]:
                    break
                after = html.find(quote[1], quote.end())
                if after < 0:
                    no_quote[quote[1]] = quote.end()
                    break
                end = after + 1
            name, rest, at = m[0].lower(), html[m.end() : close], min(close + 1, n)
        if name[0] == "/":
            yield "end", name[1:], ""
            continue
        yield "start", name, rest
        if name in RAW and not rest.endswith("/"):
            stop = RAW_END[name].search(html, at)
            end = stop.start() if stop else n
            if name in ("title", "textarea") and end > at:
                yield "text", "", html[at:end]
            at = end


def parse(html: str) -> Node:
    """Tree of a page, of any depth; end tags without a start are passed over, elements without an end last as long as their parent."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    blocks = [0]  # for each element of the stack, the nearest that is not inline, itself or above

    def cut(at: int) -> None:
        for node in stack[at:]:
            places[node.tag].pop()
        del stack[at:], blocks[at:]

    def imply_ends(name: str) -> None:
        if name in CLOSES_P and stack[blocks[-1]].tag == "p":
            cut(blocks[-1])
        if name in IMPLIED:
            ends, limits = IMPLIED[name]
            limit = max((places[t][-1] for t in limits if places.get(t)), default=0)
            found = [at[k] for t in ends if (at := places.get(t)) and (k := bisect_right(at, limit)) < len(at)]
            if found:
                cut(min(found))

    for kind, name, rest in tokens(html):
        if kind == "text":
            children = stack[-1].children
            if children and isinstance(children[-1], str):
                children[-1] += rest
            else:
                children.append(rest)
        elif kind == "start":
            imply_ends(name)
            node = Node(name, hint_words(rest))
            stack[-1].children.append(node)
            if name not in VOID and not (rest.endswith("/") and name not in INLINE and name not in CLOSES_P):
                places.setdefault(name, []).append(len(stack))
                blocks.append(blocks[-1] if name in INLINE else len(stack))
                stack.append(node)
        elif places.get(name):
            cut(places[name][-1])
    return root
