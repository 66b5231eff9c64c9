"""A page as an ordered list of tokens and text blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

# Fixed values of HTML: elements by how they are read.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "math", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand on lines of their own. All others, unknown ones too, are part of the running text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start of one of these ends an open paragraph, list item or cell of its kind.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr li main nav ol p pre section table td th tr ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "option": frozenset(["option"]),
}
#: Elements that hold no article text, and words that say so in a class, id or role.
OUTSIDE = frozenset("head nav footer aside menu dialog button fieldset header".split())
#: What makes a form the frame of a page and no form to fill in.
STRUCTURE = frozenset("article main h1 nav header footer".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Of these, words of content that has articles of its own: comments, teasers, adverts.
OWN_WORDS = frozenset(
    "ad ads advert advertisement advertising comment comments disqus promo promotion recommended related replies reply "
    "respond sponsor sponsored widget widgets".split()
)
#: Words for parts of a page, which say nothing of what stands there.
PARTS = frozenset(
    "area articles bar bars block body bottom box btn button buttons card cards column container content desktop fixed "
    "footer form global group header icon icons inner item items left link links list logo main message mobile module "
    "outer overlay page panel post posts primary right row secondary section site slot sticky stories text title top "
    "unit wrap wrapper zone".split()
)
#: First and last words of names that only say what a page has: has-sidebar, comments-open.
STATES = frozenset("has hide no non not with without".split())
STATES_AFTER = frozenset("allowed closed disabled enabled open".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
MAIN_ROLES = frozenset(["main", "article"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"\s+")
_ANY = re.compile(r"\w")
#: A tag cut off inside a quoted value at the end of the page.
_CUT_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")
#: How firmly an element is outside: by a word in a name, by a name of such content, or by what it is.
SOFT, FIRM, HARD = 1, 2, 3


@dataclass
class Block:
    """Text between two block tags: where it stands among the tokens, what it stands in, whether any of it is no link."""

    text: str
    token: int
    outside: bool
    main: bool
    plain: bool
    heading: bool
    forms: tuple[int, ...]


@dataclass
class Page:
    """Token hashes in page order, and the blocks."""

    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _role(name: str, rest: str, inside: bool) -> tuple[str, int, int]:
    """The element's name with its classes; how firmly it is outside; the least firmness above it that it cannot undo, if it holds the article."""
    level, least, label = HARD if name in OUTSIDE else 0, {"main": HARD, "article": FIRM}.get(name, 0), name
    if inside and name == "header":
        level = 0  # title and lead of the article
    found = [(kind.lower(), "".join(values).lower()) for kind, *values in _NAMES.findall(rest)] if rest else []
    for kind, value in found:
        if kind == "role" and (roles := MAIN_ROLES.intersection(_WORD.findall(value))):
            least = max(least, HARD if "main" in roles else FIRM)
    for kind, value in found:
        if kind != "id":
            label += "." + ".".join(_WORD.findall(value))
        if name not in ("html", "body"):
            level = max(level, *(_named(kind, words, least, inside) for words in map(_WORD.findall, value.split())), 0)
    # What holds the article is not outside by a mere word of its names.
    return label, level if level >= least else 0, least


def _named(kind: str, words: list[str], least: int, inside: bool) -> int:
    """How firmly the words of one class, id or role say that the element is outside: all of them must say so, or name parts."""
    telling = OUTSIDE_WORDS.intersection(words) - ({"header"} if inside else set())
    if not telling or words[0] in STATES or words[-1] in STATES_AFTER:
        return 0
    if OUTSIDE_WORDS.issuperset(words):
        return FIRM
    if not (OUTSIDE_WORDS | PARTS).issuperset(words):
        return 0
    own = words[:1] if least else words
    return FIRM if kind != "id" and OWN_WORDS.intersection(own) else SOFT


def parse(html: str) -> Page:
    """Tokens are tags with their place among open elements, and whole texts of blocks."""
    page = Page()
    stack: list[tuple[str, int, int, bool, tuple[int, ...]]] = [("", 0, 0, False, ())]
    parts: list[str] = []
    unlinked: list[str] = []
    links, n_forms, frames = 0, 0, set()

    def flush() -> None:
        plain = bool(_ANY.search(unescape("".join(unlinked))))
        unlinked.clear()
        text = _BLANKS.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            name, path, outside, main, forms = stack[-1]
            page.tokens.append(crc32(text.encode("utf-8", "replace"), path) | 1 << 32)
            page.blocks.append(Block(text, len(page.tokens) - 1, outside > 0, main, plain, name in HEADINGS, forms))

    def pop() -> None:
        path = stack.pop()[1]
        page.tokens.append(path | 1 << 33)

    at = 0
    for found in _TOKEN.finditer(html):
        if found.start() > at:
            parts.append(html[at : found.start()])
            if not links:
                unlinked.append(parts[-1])
        at = found.end()
        name = found.group("name")
        if name is None:
            continue
        name = name.lower()
        closing = bool(found.group("close"))
        if name == "a":
            links = max(links - 1, 0) if closing else 1
        if name == "br":
            parts.append(" ")
            unlinked.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            if any(e[0] == name for e in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while stack[-1][0] in ENDS and name in ENDS[stack[-1][0]]:
            pop()
        _, path, within, inside, forms = stack[-1]
        label, outside, least = _role(name, found.group("rest"), inside)
        # A form that holds the structure of a page only frames it.
        if name in STRUCTURE:
            frames.update(forms)
        path = crc32(label.encode(), path)
        page.tokens.append(path)
        if name not in VOID and not found.group("rest").rstrip().endswith("/"):
            if name == "form":
                forms, n_forms = (*forms, n_forms), n_forms + 1
            stack.append((name, path, max(outside, within if within >= least else 0), inside or least > 0, forms))
    # Tags are all read: a '<' in what is left is text.
    rest = _CUT_TAG.sub("", html[at:])
    parts.append(rest)
    unlinked.append("" if links else rest)
    flush()
    while len(stack) > 1:
        pop()
    for block in page.blocks:
        block.outside = block.outside or not frames.issuperset(block.forms)
    return page
