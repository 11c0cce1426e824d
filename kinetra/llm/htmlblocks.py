"""HTML as a stream of text blocks with the path of elements around each."""

from __future__ import annotations

import html
import re

#: HTML elements by their part in the text.
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select|object|audio|video|canvas|xmp|noembed|noframes"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("datalist",)}
DROPPED = frozenset("nav aside footer form button dialog menu head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted cookie
    cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
    search nav navbar navigation menu menus breadcrumb breadcrumbs toc footer copyright sidebar sidebars aside widget widgets
    related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus
    discussion pagination pager skip skiplink form hidden""".split()
)
#: Marks of page headers; inside the article they hold its own heading.
HEADER_MARKS = frozenset(["header", "masthead", "topbar"])
SITE_MARKS = frozenset(["site", "page", "global", "top", "masthead", "topbar"])
ARTICLE_MARKS = frozenset("article content post entry story".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _element(name: str, attributes: str) -> tuple[str, bool]:
    """(signature: name and class, whether it is no part of an article)."""
    if not attributes.strip():
        return name, name in DROPPED
    out, drop = name, name in DROPPED
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class" or key == "id":
            parts = [p for p in _SPLIT.split(value) if p]
            marked = not MARKS.isdisjoint(parts)
            drop |= marked and (ARTICLE_MARKS.isdisjoint(parts) if name == "article" else name not in ("body", "html", "main"))
            if key == "class":
                out = f"{name}.{'.'.join(value.split())}"
            elif key == "id" and "." not in out and not any(c.isdigit() for c in value):
                out = f"{name}#{value}"
        elif key == "role":
            drop |= value in ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            drop = True
        elif key == "style":
            drop |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
    return out, drop


def _named(signature: str) -> list[str]:
    """Words of an element's class or id."""
    return _SPLIT.split(signature.partition("." if "." in signature else "#")[2])


def like_article(signature: str) -> bool:
    return not signature.startswith(("body", "html")) and not ARTICLE_MARKS.isdisjoint(_named(signature))


def _foreign_header(signature: str, within: bool) -> bool:
    """Whether an element is a page's header rather than the article's own."""
    words = _named(signature)
    header = signature.partition(".")[0].partition("#")[0] == "header" or not HEADER_MARKS.isdisjoint(words)
    return header and (not within or not SITE_MARKS.isdisjoint(words))


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """(path, dropped, text) of each block with text, in page order.

    Paths join signatures of open elements; a path is dropped if an element on it (menu, footer, advert, form, comments,
    or a header outside the article) cannot belong to the article. Character references are decoded and white space is
    one space. Unclosed elements end with what implies their end.
    """
    out: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool]] = []
    leaf: tuple[str, str, bool] | None = None
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                signs = [s for _, s, _ in stack]
                within = any(n in ("article", "main") or like_article(s) for n, s, _ in stack)
                drop = any(d for _, _, d in stack) or (leaf is not None and leaf[2])
                drop = drop or any(_foreign_header(s, within) for s in signs)
                if leaf is not None:
                    signs.append(leaf[1])
                out.append(("/".join(signs), drop, " ".join(words)))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m.group(3) or m.group(6):
            closing, name, attributes = (m.group(2), m.group(3).lower(), m.group(4)) if m.group(3) else (m.group(5), m.group(6).lower(), m.group(7))
            if name in INLINE:
                signature, drop = ("", False) if closing or not attributes.strip() else _element(name, attributes)
                if not drop or name in VOID:
                    continue
            if name == "br":
                text.append(" ")
                continue
            flush()
            if name in VOID:
                leaf = None if name == "hr" else leaf
                continue
            if closing:
                if name in LEAF or name in INLINE:
                    leaf = None
                    if name in INLINE and any(n == name for n, _, _ in stack):
                        while stack.pop()[0] != name:
                            pass
                    continue
                leaf = None
                if any(n == name for n, _, _ in stack):
                    while stack.pop()[0] != name:
                        pass
                continue
            signature, drop = _element(name, attributes)
            if name in LEAF:
                leaf = (name, signature, drop)
                continue
            leaf = None
            if name in ITEMS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ITEMS[name]:
                        break
                    if stack[k][0] == name or name in ("dt", "dd") and stack[k][0] in ("dt", "dd") or name in ("td", "th") and stack[k][0] in ("td", "th"):
                        del stack[k:]
                        break
            elif name == "body":
                stack = [s for s in stack if s[0] != "head"]
            stack.append((name, signature, drop))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out
