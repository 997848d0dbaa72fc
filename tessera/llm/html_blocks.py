"""HTML to text blocks with what is known of each: one pass over the tags, no tree is built."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z](?=[^>]*$)[^>]*$", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Names of HTML elements and of the parts that pages commonly mark.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "select", "math", "title", "xmp", "noembed"}
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}
CONTENT_TAGS = {"article": 4.0, "main": 2.0}
BOILERPLATE_TAGS = {"nav": 6.0, "footer": 5.0, "aside": 6.0, "form": 6.0, "button": 6.0, "head": 9.0, "dialog": 5.0, "menu": 5.0, "fieldset": 5.0}
BOILERPLATE_NAMES = (
    "ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer foot sidebar side aside widget "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus toolbar pagination pager copyright legal disclaimer search skip masthead topbar teaser trending popular tags"
).split()
CONTENT_NAMES = "article content post entry story body main text".split()
#: Names of parts that may well outweigh the text they belong to.
LONG_NAMES = set("comment comments reply replies respond disqus".split())
#: A marked element is the page's wrapper if it holds more than the first share of its text and leaves at most the second unmarked.
WRAPPER, LEFT_OUT = 0.5, 0.1
#: Least evidence of the containers that leaves no doubt.
SURE = 3.0
_NAMES = {n: 6.0 for n in BOILERPLATE_NAMES} | {n: -2.0 for n in CONTENT_NAMES}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。！？][\"')\]]*(?:\s|$)")


@dataclass
class Block:
    text: str
    tag: str
    parent: int  # number of the block container that it stands in
    depth: int
    mark: float  # evidence of the containers' names: above 0 for boilerplate, below for content
    link_chars: int


def _evidence(tag: str, attributes: str, in_article: bool) -> tuple[float, float, bool]:
    """What a container says of its content, how much of it doesn't hold for a wrapper of the whole page, and whether it hides it."""
    wide = BOILERPLATE_TAGS[tag] if tag in ("form", "fieldset") else 0.0
    mark = BOILERPLATE_TAGS.get(tag, 0.0) - CONTENT_TAGS.get(tag, 0.0)
    if tag == "header" and not in_article:
        mark += 5.0
    hidden = tag == "option"
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id", "role"):
                words = [w for w in map(str.lower, _SPLIT.split(value)) if w in _NAMES]
                found = [_NAMES[w] for w in words]
                if found and tag not in ("html", "body"):
                    mark += max(found) if max(found) > 0 else min(found)
                    if max(found) > 0 and LONG_NAMES.isdisjoint(words):
                        wide += max(found)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    return mark, wide, hidden


def _marks(blocks: list[Block], at: list[int], elements: list[tuple[int, float, float]]) -> None:
    """Sets the marks of blocks that stand in the elements `at`: evidence summed from the top; wrappers of the page lose theirs."""
    held = [0] * len(elements)
    for block, k in zip(blocks, at, strict=True):
        held[k] += len(block.text)
    for k in range(len(elements) - 1, 0, -1):
        held[elements[k][0]] += held[k]
    large = [n > WRAPPER * held[0] for n in held]
    mark = [0.0] * len(elements)
    for k in range(1, len(elements)):
        parent, own, wide = elements[k]
        mark[k] = mark[parent] + own - wide * large[k]
    plain = [0] * len(elements)
    for block, k in zip(blocks, at, strict=True):
        if mark[k] < SURE:
            plain[k] += len(block.text)
    for k in range(len(elements) - 1, 0, -1):
        plain[elements[k][0]] += plain[k]
    for k in range(1, len(elements)):
        parent, own, wide = elements[k]
        mark[k] = mark[parent] + own - wide * (large[k] and plain[0] - plain[k] <= LEFT_OUT * held[0])
    for block, k in zip(blocks, at, strict=True):
        block.mark = mark[k]


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order; character references are decoded and white space is one space."""
    out: list[Block] = []
    # open elements: (name, container number, place in elements, hidden)
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    # elements that say something of their content: (place of the next one outside, evidence, part of it that a wrapper loses)
    elements: list[tuple[int, float, float]] = [(0, 0.0, 0.0)]
    places: list[int] = []
    held, links, link_depth, n_containers, article = [], 0, 0, 0, 0
    at, closed = 0, dict.fromkeys(RAW, True)

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                name, container, place, hidden = next((s for s in reversed(stack) if s[0] not in INLINE), stack[0])
                if not hidden:
                    out.append(Block(text, name, stack[-2][1] if len(stack) > 1 and name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td") else container, len(stack), 0.0, links))
                    places.append(place)
        links = 0

    def opened(mark: float, wide: float) -> int:
        if not mark and not wide:
            return stack[-1][2]
        elements.append((stack[-1][2], mark, wide))
        return len(elements) - 1

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            if link_depth:
                links += len(piece.strip())
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in INLINE:
                if name == "a" and link_depth:
                    link_depth -= 1
                for k in range(len(stack) - 1, max(0, len(stack) - 6), -1):
                    if stack[k][0] == name:
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    article -= sum(s[0] == "article" for s in stack[k:])
                    del stack[k:]
                    break
            link_depth = 0
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in RAW:
            if not m.group(3).endswith("/"):  # only its own end tag ends raw text
                end = _RAW_END[name].search(page, at) if closed[name] else None
                closed[name] = end is not None
                if end:
                    at = end.end()
                elif name not in ("svg", "math", "canvas", "object", "select"):
                    at = len(page)
            continue
        if name in INLINE:
            if name not in VOID:
                if name == "a":
                    link_depth += 1
                mark, wide, hidden = _evidence(name, m.group(3), True) if m.group(3) and name != "a" else (0.0, 0.0, False)
                if mark or hidden:
                    flush()
                stack.append((name, stack[-1][1], opened(mark, wide), stack[-1][3] or hidden))
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSED_BY:
            ends = CLOSED_BY[name].split()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name not in INLINE and stack[-1][0] in INLINE:
            while len(stack) > 1 and stack[-1][0] in INLINE:
                stack.pop()
        if name not in CLOSED_BY and name[0] != "h" and stack[-1][0] == "p":
            stack.pop()
        if name != "option" and stack[-1][0] == "option":
            stack.pop()
        mark, wide, hidden = _evidence(name, m.group(3), article > 0)
        article += name == "article"
        n_containers += 1
        stack.append((name, n_containers, opened(mark, wide), stack[-1][3] or hidden))
        link_depth = 0
    if at < len(page):
        held.append(page[at:])
    flush()
    _marks(out, places, elements)
    return out


FEATURES = 8


def features_of(block: Block) -> list[float]:
    """Numbers that don't look at the containers' names: length, links, sentences, kind of element."""
    n = len(block.text)
    link = min(1.0, block.link_chars / n)
    words = block.text.count(" ") + 1
    return [
        1.0,
        min(words, 60) / 20.0,
        link,
        float(link > 0.5 and words < 8),
        min(4, len(_SENTENCE.findall(block.text))) / 2.0,
        float(block.tag == "p"),
        float(block.tag[0:1] == "h" and block.tag[1:].isdigit()),
        float(block.tag in ("li", "td", "dd")),
    ]
