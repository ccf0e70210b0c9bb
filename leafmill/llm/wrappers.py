"""Wrappers of web pages: union-free regular expressions over tag trees.

A page is a tree of block elements with text slots. Equal neighbours fold into
one repeated group. Two wrappers are aligned level by level: what both have is
merged, what one lacks becomes optional, runs of equal members become repeated.
Aligning the different trees of a host's pages gives the host's wrapper.

What a wrapper's slots hold over all pages of the host tells what they are: slots
of one text are the template's, repeated groups of links are lists of links, the
element whose slots vary most holds the article.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

# no part but short quoted values looks past the next "<"
TOKEN = re.compile(
    r"<!--"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b[^<>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|\"[^\"]{0,1000}\"|'[^']{0,1000}'|[^<>])*+)>"
    r"|<[!?][^<>]*>"
    r"|[^<]+|<",
    re.IGNORECASE,
)
RAW_ENDS = {"!": re.compile("-->")} | {t: re.compile(f"</{t}\\b[^<>]*>?", re.IGNORECASE) for t in "script style noscript template svg iframe textarea title".split()}
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of these ends an open element of the named tags.
ENDS = {t: ("p",) for t in "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Elements further down are siblings of the one at this depth; their text stays.
DEPTH = 100
#: Members of a level up to which two wrappers are aligned as they are.
LEVEL = 300
#: Elements that never hold the article's text.
ASIDE_TAGS = frozenset("nav footer aside menu button select dialog head input".split())
#: Elements that are asides unless they hold most of a host's varying text, as a form does that is drawn around a whole page; a header is none within an article.
MAYBE_TAGS = frozenset(("form", "header"))
#: Names of elements that are asides unless they hold most of a host's varying text.
ASIDE_MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies reply respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Compounds that are marks too, whole and with single hyphens.
ASIDE_COMPOUNDS = frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper breadcrumb-trail comment-form comment-list comment-respond comments-area comments-section cookie-banner cookie-consent cookie-notice left-sidebar main-menu main-nav main-navigation nav-bar nav-links nav-menu page-footer pagination-links post-navigation promo-box related-articles related-posts related-stories right-sidebar search-box search-form share-bar share-buttons share-links sidebar-left sidebar-right sidebar-widget site-footer site-header site-nav site-navigation skip-link social-icons social-links social-media social-share sponsored-content top-bar top-nav widget-area".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: Different pages from which on what all of a host have within their articles is taken for the template's.
ALWAYS_PAGES = 5
#: Elements that are no asides, whatever their names.
NEVER_ASIDE = MAIN_TAGS | {"", "html", "body"}


class Element:
    """A block element of a page; children are elements and pairs of a text and whether it is a link's."""

    __slots__ = ("children", "marks", "tag")

    def __init__(self, tag: str, marks: str) -> None:
        self.tag, self.marks, self.children = tag, marks, []

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def parse(source: str) -> Element:
    """The tree of block elements; scripts, styles, comments and inline tags are left out."""
    root = Element("", "")
    stack, at, link = [root], 0, False
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        if m[0] == "<!--" or m["raw"]:
            # without an end they go on to the end of the page, as browsers have it
            found = RAW_ENDS["!" if m["raw"] is None else m["raw"].lower()].search(source, at)
            at = found.end() if found else len(source)
            continue
        tag = m["tag"]
        if tag is None:
            if m[0][:2] not in ("<!", "<?"):
                stack[-1].children.append((m[0], link))
            continue
        tag = tag.lower()
        if tag == "br":
            stack[-1].children.append((" ", link))
        if tag == "a":
            link = not m["end"]
        if tag in INLINE or tag in VOID:
            continue
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        link = False
        for closed in ENDS.get(tag, ()):
            # only up to the nearest element that holds others of this kind
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == closed:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("table", "ul", "ol", "dl", "div", "article", "section", "td", "th") and stack[depth].tag not in (closed, "td", "th"):
                    break
        marks = " ".join(sorted({re.sub(r"\d+", "", w) for x in MARKS.findall(m["attrs"]) for w in "".join(x).lower().split()} - {""})) if m["attrs"] else ""
        element = Element(tag, marks)
        if len(stack) > DEPTH:
            stack.pop()
        stack[-1].children.append(element)
        if not m[0].endswith("/>"):
            stack.append(element)
    return root


def blocks(element: Element, path: tuple[str, ...] = (), drop: frozenset[str] | None = None, starts: frozenset[str] | None = None) -> Iterator[tuple[str, str, int]]:
    """Path, text and characters in links of each block, in page order; white space is one blank.

    Elements that :func:`aside` tells by ``drop``, the paths that are dropped or
    (after a "+") spared, are left out; none if it is None. With ``starts``, only blocks in elements
    of these paths are given.
    """
    place, text, links = "/".join(path), [], 0
    inside = starts is None or place in starts
    below = None if inside else starts

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined and inside:
                yield place, joined, min(links, len(joined))
            links = 0

    for child in element.children:
        if isinstance(child, tuple):
            text.append(child[0])
            links += len(child[0].strip()) if child[1] else 0
        else:
            yield from flush()
            down = (*path, child.key)
            if drop is None or not aside(child.key, "/".join(down), drop):
                yield from blocks(child, down, drop, below)
    yield from flush()


def aside(key: str, place: str, drop: frozenset[str]) -> bool:
    """Whether an element is left out: by its tag, by the host's wrapper, or by its name where the wrapper does not spare it."""
    tag, _, marks = key.partition(".")
    if tag in NEVER_ASIDE:
        return False
    if tag in ASIDE_TAGS or place in drop:
        return True
    if tag in MAYBE_TAGS and f"+{place}" not in drop:
        return tag == "form" or not within_main(place)
    words = (re.sub(r"[-_:]+", "-", w).strip("-") for w in marks.split())
    return f"+{place}" not in drop and any(w in ASIDE_MARKS or w in ASIDE_COMPOUNDS for w in words)


def within_main(place: str) -> bool:
    return any(k.partition(".")[0] in MAIN_TAGS for k in place.split("/"))


def digest(text: str) -> int:
    """A text as a signed number of 64 bits."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


# A wrapper node is [key, optional, repeated, children]; the key of a text slot is
# "#", that of a group of members "(" and their keys.


def _fold(nodes: list[list]) -> list[list]:
    """Equal neighbours become one repeated node, then equal runs of 2 to 4 one repeated group."""
    out: list[list] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = merge(out[-1], node)
            out[-1][2] = node[0] != "#"
        else:
            out.append(node)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            keys = [n[0] for n in out[i : i + period]]
            if [n[0] for n in out[i + period : i + 2 * period]] != keys:
                i += 1
                continue
            members, j = out[i : i + period], i + period
            while [n[0] for n in out[j : j + period]] == keys:
                members = [merge(a, b) for a, b in zip(members, out[j : j + period], strict=True)]
                j += period
            out[i:j] = [["(" + " ".join(keys), False, True, members]]
            i += 1
    return out


def wrapper_of(element: Element) -> list:
    """The wrapper that one page is."""
    nodes = []
    for child in element.children:
        if isinstance(child, tuple):
            if child[0].strip():
                nodes.append(["#", False, False, []])
        else:
            nodes.append(wrapper_of(child))
    return [element.key, False, False, _bounded(_fold(nodes))]


def merge(a: list, b: list) -> list:
    """The wrapper of the pages of both; keys are equal."""
    return [a[0], a[1] or b[1], a[2] or b[2], _align(a[3], b[3])]


def _bounded(nodes: list[list]) -> list[list]:
    """A level of many members as one repeated member of each key, in order of appearance; over LEVEL keys, of each tag."""
    for name in (lambda n: n[0], lambda n: n[0].partition(".")[0] if n[0][:1] != "(" else "("):
        if len(nodes) <= LEVEL:
            break
        kept: dict[str, list] = {}
        for node in nodes:
            key = name(node)
            one = [key if key != "(" else node[0], True, True, node[3]]
            kept[key] = [one[0], True, True, _align(kept[key][3], one[3])] if key in kept else one
        nodes = list(kept.values())
    return nodes


def _align(a: list[list], b: list[list]) -> list[list]:
    """Members of both in one order; those that one side lacks are optional."""
    first = 0
    while first < min(len(a), len(b)) and a[first][0] == b[first][0]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last][0] == b[-1 - last][0]:
        last += 1
    head = [merge(x, y) for x, y in zip(a[:first], b[:first], strict=True)]
    tail = [merge(x, y) for x, y in zip(a[len(a) - last :], b[len(b) - last :], strict=True)]
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a and not b:
        return head + tail
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    optional = lambda n: [n[0], True, *n[2:]]
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return _bounded(_fold(head + out + tail))


def expression(node: list) -> str:
    """The wrapper as a regular expression."""
    inner = " ".join(map(expression, node[3]))
    text = "#" if node[0] == "#" else f"({inner})" if node[0][:1] == "(" else f"<{node[0]}>{inner}</>" if node[0] else inner
    sign = ("*" if node[1] else "+") if node[2] else "?" if node[1] else ""
    return f"({text}){sign}" if sign else text


def members(node: list, repeated: bool = False) -> Iterator[tuple[list, bool]]:
    """The elements and slots of a level, those of groups among them, and whether they repeat."""
    for child in node[3]:
        if child[0][:1] == "(":
            yield from members(child, True)
        else:
            yield child, repeated or child[2]


def rules_of(wrapper: list, sums: dict[str, tuple[int, int]], n_pages: int = 1) -> tuple[list[str], list[str]]:
    """Paths of the elements that hold a host's article; and paths to drop, or to spare after a "+".

    ``sums`` has, by path, the characters below it of texts that vary over the
    host's ``n_pages`` different pages, and those of them in links; what is below
    elements that never hold an article is not in them. Lists are dropped that
    repeat a member and are links for the most part; within an article only those
    that all pages have, as a page's own list of sources is no menu. Elements of an
    aside's name or tag are spared if they hold half of the text. The article is
    in ``article`` and ``main`` elements; without one, in the lowest element that
    has most of the text.
    """
    whole = sums.get("", (0, 0))[0]
    drop: list[str] = []

    def lists(node: list, path: tuple[str, ...], always: bool) -> None:
        place = "/".join(path)
        text, links = sums.get(place, (0, 0))
        inner = [(child, repeated) for child, repeated in members(node) if child[0] != "#"]
        mostly_links = path and text and links * 10 >= text * 7 and node[0].partition(".")[0] not in NEVER_ASIDE
        if mostly_links and any(repeated for _, repeated in inner) and (not within_main(place) or (always and n_pages >= ALWAYS_PAGES)):
            drop.append(place)
        for child, _ in inner:
            lists(child, (*path, child[0]), (always or child[0].partition(".")[0] in MAIN_TAGS) and not child[1])

    lists(wrapper, (), True)
    dropped = set(drop)
    spared = ["+" + p for p, (t, _) in sums.items() if p and t * 2 >= whole and p not in dropped and aside(p.rpartition("/")[2], p, frozenset())]
    out = frozenset(drop) | frozenset(spared)
    found: list[str] = []

    def below(node: list, path: tuple[str, ...]) -> Iterator[tuple[list, bool, tuple[str, ...]]]:
        for child, repeated in members(node):
            if child[0] != "#" and not aside(child[0], "/".join((*path, child[0])), out):
                yield child, repeated, (*path, child[0])

    def search(node: list, path: tuple[str, ...]) -> None:
        for child, _, down in below(node, path):
            if child[0].partition(".")[0] in MAIN_TAGS:
                found.append("/".join(down))
            else:
                search(child, down)

    search(wrapper, ())
    if found:
        return found, sorted(out)
    node, path = wrapper, ()
    while whole:
        lower = [(sums.get("/".join(down), (0, 0))[0], child, down) for child, repeated, down in below(node, path) if not repeated and any(x[0] != "#" for x, _ in members(child))]
        lower = [x for x in lower if x[0] * 10 >= whole * 6]
        if not lower:
            break
        _, node, path = max(lower, key=lambda x: x[0])
    return ["/".join(path)], sorted(out)


def main_text(root: Element, starts: frozenset[str], drop: frozenset[str], template: frozenset[int] = frozenset()) -> str:
    """Blocks of the elements that hold the article, joined by blank lines, without those of the template.

    A page without such an element gives the text of its whole body. What an
    ``article`` or ``main`` element has in common with the host's other pages goes
    only if it is the smaller part of it: pages of one text keep it.
    """
    found = [(place, text, digest(f"{place}\n{text}") in template) for place, text, _ in list(blocks(root, (), drop, starts)) or list(blocks(root, (), drop))]
    marked = [(len(text), fixed) for place, text, fixed in found if within_main(place)]
    smaller = 2 * sum(n for n, fixed in marked if fixed) <= sum(n for n, _ in marked)
    return "\n\n".join(text for place, text, fixed in found if not fixed or (within_main(place) and not smaller))
