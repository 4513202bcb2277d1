"""HTML as a stream of text blocks, each with the path of structural elements around it.

One forward scan, linear in the page's length whatever its tags and quotes are: nothing is searched for twice, and an
element's path is a hash made from its parent's, so depth costs nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import xxhash

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp select svg math".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont frame".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of the first kind is ended by the start of one of the second.
ENDED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Ends of open elements are not looked for beyond these.
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}


@dataclass
class Block:
    """One run of text between structural tags. path: the hash of the signatures from the root on."""

    path: int
    text: str
    link_chars: int
    dropped: bool
    content: bool


@dataclass
class Page:
    """Blocks in page order, the page's title, and by path its parent's path and whether the element holds running text only."""

    blocks: list[Block] = field(default_factory=list)
    title: str = ""
    paths: dict[int, tuple[int, bool]] = field(default_factory=dict)


def signature(tag: str, attributes: str) -> str:
    """tag.class#id with digits as 0; role, and a mark for hidden elements."""
    out = [tag]
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "class":
                out += [f".{c}" for c in sorted(set(value.split()))]
            elif name == "id" and value:
                out.append(f"#{value}")
            elif name == "role" and value:
                out.append(f"@{value}")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("!hidden")
    return re.sub(r"\d+", "0", "".join(out).replace("/", "_")) if len(out) > 1 else tag


class _Quotes:
    """Ends of tags. A ">" within quotes ends no tag, unless a quote is left open: then the first ">" does."""

    def __init__(self, source: str) -> None:
        self.source, self.last = source, {c: source.rfind(c) for c in "\"'>"}
        self.failed: set[int] = set()  # quotes at which an earlier search, outside of quotes, met no end

    def end(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin at at; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        i, met = at, []
        while m := STOP.search(self.source, i):
            j, c = m.start(), m[0]
            if c == ">":
                return j
            if j in self.failed:
                break
            met.append(j)
            close = self.source.find(c, j + 1) if j < self.last[c] else -1
            if close < 0:
                break
            i = close + 1
        self.failed.update(met)
        return self.source.find(">", at)


def tokens(source: str) -> Iterator[tuple[str, bool, str, str]]:
    """("", False, text, "") for text, (tag, whether it ends the element, "", attributes) for tags; raw content is left out.

    A title's content comes as the attributes of the tag title. A tag that the end of the page cuts off is left out.
    """
    quotes, at, n = _Quotes(source), 0, len(source)
    begin = 0  # of the text not yet given
    while at < n:
        at = source.find("<", at)
        if at < 0:
            break
        start = at
        tag = None
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            after = n if end < 0 else end + 3
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at) if at <= quotes.last[">"] else -1
            if end < 0:
                break
            after = end + 1
        elif m := NAME.match(source, at):
            end = quotes.end(m.end())
            if end < 0:
                break
            name, after = m[2].lower(), end + 1
            tag = (name, bool(m[1]), "", source[m.end() : end])
            if name in RAW and not m[1]:
                if name in ("svg", "math") and tag[3].endswith("/"):
                    tag = None
                else:
                    close = RAW_END[name].search(source, after)
                    tag = (name, False, "", source[after : close.start() if close else n]) if name == "title" else None
                    after = close.end() if close else n
        else:
            at += 1
            continue
        if start > begin:
            yield "", False, source[begin:start], ""
        if tag:
            yield tag
        begin = at = after
    if begin < n:
        rest = source[begin:]
        cut = rest.rfind("<")
        yield "", False, rest[:cut] if cut >= 0 and re.match(r"<[a-zA-Z/!?]", rest[cut:]) else rest, ""


#: Elements that hold running text only.
TEXTUAL = re.compile(r"(?:p|h[1-6]|li|ul|ol|blockquote|pre|table|dl)(?![a-z0-9])")


def parse(source: str, is_dropped: Callable[[str, bool], bool], is_content: Callable[[str], bool]) -> Page:
    """The page's blocks. Elements left open end with the page; stray end tags are skipped.

    is_dropped (of a signature, and whether a content element is around it) and is_content hold for all that is inside.
    """
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    depths: dict[str, list[int]] = {}
    known: dict[tuple[int, str], tuple[int, bool, bool]] = {}
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            found = " ".join(html.unescape("".join(parts)).split())
            if found:
                _, path, dropped, content = stack[-1]
                page.blocks.append(Block(path, found, links, dropped, content))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()

    def topmost(names: Iterable[str]) -> int:
        return max((depths[t][-1] for t in names if depths.get(t)), default=0)

    for tag, ending, text, attributes in tokens(source):
        if not tag:
            parts.append(text)
            if in_link:
                links += len(text)
            continue
        if tag == "title" and not ending:
            page.title = page.title or " ".join(html.unescape(attributes).split())
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if ending else 1
            continue
        in_link = 0
        if tag in VOID or tag in RAW:
            flush()
        elif ending:
            close(depths[tag][-1] if depths.get(tag) else len(stack))
        else:
            flush()
            if tag in FENCES:  # an open element of the kind ends, if no list or table has begun since
                ended = topmost(t for t, by in ENDED_BY.items() if tag in by)
                if ended > topmost(FENCES[tag]):
                    close(ended)
            else:
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] in ENDED_BY:
                    if tag in ENDED_BY[stack[depth][0]]:
                        close(depth)
                        break
                    depth -= 1
            if not attributes.endswith("/"):
                _, parent, dropped, content = stack[-1]
                sig = signature(tag, attributes)
                if (parent, sig) not in known:
                    path = xxhash.xxh3_64_intdigest(f"{parent}/{sig}") >> 1
                    known[parent, sig] = path, dropped or is_dropped(sig, content), content or is_content(sig)
                    page.paths[path] = parent, bool(TEXTUAL.match(sig))
                depths.setdefault(tag, []).append(len(stack))
                stack.append((tag, *known[parent, sig]))
    flush()
    return page
