"""Leaf blocks of an HTML page: runs of text between block-level tags, with the elements they stand in."""

from __future__ import annotations

import html
from dataclasses import dataclass

import regex

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is no text.
RAW = frozenset("script style template".split())
#: A start tag closes an open element of the first kind, looking up to an element of the second.
_LISTS = frozenset(("ul", "ol", "menu", "dir"))
_TABLE = frozenset(("table",))
_ROW = frozenset(("tr", "table"))
CLOSES = {"p": (frozenset(("p",)), frozenset("button td th caption table object html".split())), "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr",)), _TABLE), "td": (frozenset(("td", "th")), _ROW), "th": (frozenset(("td", "th")), _ROW), "option": (frozenset(("option",)), frozenset(("select", "datalist")))}
#: The elements that change what a start tag would close.
_CHANGES = {t: tuple((r, t in kinds) for r, (kinds, scope) in CLOSES.items() if t in kinds or t in scope) for rule in CLOSES.values() for t in rule[0] | rule[1]}
_TOKEN = regex.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", regex.S)
_ATTR = regex.compile(r"""(?<=[\s"'])(?:(class|id|role)\s*=\s*|(data-content)(?:\s*=\s*|(?=[\s/]|$)))(?:"([^"]*)"|'([^']*)'|([^\s"'>]*))""", regex.I)


@dataclass(slots=True)
class Block:
    text: str
    chain: tuple  # (parent chain, tag, names in class, id and role, is marked as content)
    linked: int  # characters in links
    breaks: bool = False


def attributes(raw: str) -> tuple[str, bool | None]:
    """The text of class, id and role, and what data-content says of the element: content, not content, or nothing."""
    if "=" not in raw and "data-content" not in raw:
        return "", None
    names, marked = [], None
    for m in _ATTR.finditer(raw):
        value = m[3] or m[4] or m[5] or ""
        if m[2]:
            marked = value != "no"
        else:
            names.append(value)
    return " ".join(names), marked


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; character references are decoded and white space is one space.

    Time is linear in the page, whatever its depth: with each open element stands the innermost block-level element, and
    for each kind of start tag the open element that it would close; open elements are also listed by tag.
    """
    page = page or ""
    out: list[Block] = []
    root = (None, "", "", None)
    stack = [root]
    inner = [0]  # where the innermost block-level element stands, for each open element
    closable = [dict.fromkeys(CLOSES, 0)]  # where the element stands that a start tag closes, 0 for none
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = at = 0
    holder = root  # the innermost block-level element, which the text so far stands in

    def end():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, holder, linked))
            parts.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked, holder
        if piece:
            if not parts:
                holder = stack[inner[-1]]
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if places.get("a"):
                linked += len(piece)

    def cut(k: int):
        while len(stack) > k:
            places[stack.pop()[1]].pop()
            inner.pop()
            closable.pop()

    while m := _TOKEN.search(page, at):  # after a raw element, from its end: its content is no markup
        add(page[at : m.start()])
        at = m.end()
        slash, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        is_block = tag in BLOCK
        if is_block:
            end()
        if slash:
            open_ = places.get(tag)
            if open_ and (is_block or open_[-1] > inner[-1]):  # an inline end tag closes nothing outside its block
                cut(open_[-1])
            continue
        if tag in VOID:
            if tag == "br" and parts:
                parts.append(" ")
            continue
        if tag in RAW:
            if not raw.rstrip().endswith("/") or tag != "template":
                found = regex.compile(rf"</{tag}\b[^>]*(?:>|$)", regex.I).search(page, at)
                at = found.end() if found else len(page)
            continue
        for rule in ("p", tag) if is_block and tag != "p" else (tag,):
            if is_block and closable[-1].get(rule):
                cut(closable[-1][rule])
        names, marked = attributes(raw)
        k = len(stack)
        stack.append((stack[-1], tag, names, marked))
        inner.append(k if is_block else inner[-1])
        closable.append(closable[-1] | {r: k if kind else 0 for r, kind in _CHANGES[tag]} if tag in _CHANGES else closable[-1])
        places.setdefault(tag, []).append(k)
    add(page[at:])
    end()
    return out
