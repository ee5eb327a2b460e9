"""HTML helpers that need a real parser (stdlib ``html.parser``).

Text extraction follows the usual tree-builder conventions: text nodes in
document order, concatenated with no separator; strings inside
``script``/``style``, comments, declarations and processing instructions are
not text; entities are decoded (known names with or without ';').
Elements are reported in document order with their attributes, their
descendant text and the ords of all enclosing elements.
"""

from __future__ import annotations

import re
from html.entities import html5 as _HTML5
from html.parser import HTMLParser

import pyarrow as pa

# HTML void elements (never have children or end tags).
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
])
RAW_TEXT_TAGS = frozenset(["script", "style"])
KEPT_SPACE_TAGS = frozenset(["pre", "textarea"])
_ASCII_SPACES = " \n\t\f\r"

# Numeric references 128-159 read as windows-1252 characters.
_CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†",
    0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ",
    0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}

_WS = re.compile(r"\s+")


def _decode_charref(name: str) -> str:
    try:
        code = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
    except ValueError:
        return "&#" + name
    if code in _CP1252:
        return _CP1252[code]
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "�"


def _decode_entity(name: str) -> str:
    char = _HTML5.get(name + ";")
    if char is None:
        char = _HTML5.get(name)
    return char if char is not None else "&" + name


class _Walker(HTMLParser):
    """Builds the text-node list and the element list of one document."""

    def __init__(self, want_elements: bool):
        super().__init__(convert_charrefs=False)
        self.want_elements = want_elements
        self.texts: list[str] = []
        self.elements: list[dict] = []
        self.stack: list[int] = []     # indices into elements (open, non-void)
        self.raw_depth = 0             # inside script/style
        self.kept_depth = 0            # inside pre/textarea
        self.in_text = False           # last event was text (merge pieces)

    def _boundary(self):
        """Ends a text node. A node of ASCII white space only stands for one
        line feed (if it has any) or one space, but in pre and textarea."""
        if self.in_text and not self.texts[-1].strip(_ASCII_SPACES) and not self.kept_depth:
            self.texts[-1] = "\n" if "\n" in self.texts[-1] else " "
        self.in_text = False

    # -- tree
    def _open(self, tag, attrs):
        attr_map = {}
        for k, v in attrs:
            attr_map[k] = "" if v is None else v
        el = {"ord": len(self.elements), "tag": tag, "attrs": attr_map,
              "last": len(self.elements), "t0": len(self.texts), "t1": None}
        self.elements.append(el)
        return el

    def handle_starttag(self, tag, attrs):
        self._boundary()
        el = self._open(tag, attrs)
        if tag in VOID_TAGS:
            el["t1"] = len(self.texts)
            return
        self.stack.append(el["ord"])
        self.raw_depth += tag in RAW_TEXT_TAGS
        self.kept_depth += tag in KEPT_SPACE_TAGS

    def handle_startendtag(self, tag, attrs):
        self._boundary()
        el = self._open(tag, attrs)
        el["t1"] = len(self.texts)

    def handle_endtag(self, tag):
        self._boundary()
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[pos]]["tag"] == tag:
                for idx in self.stack[pos:]:
                    el = self.elements[idx]
                    el["t1"], el["last"] = len(self.texts), len(self.elements) - 1
                    self.raw_depth -= el["tag"] in RAW_TEXT_TAGS
                    self.kept_depth -= el["tag"] in KEPT_SPACE_TAGS
                del self.stack[pos:]
                return

    # -- text
    def handle_data(self, data):
        if self.raw_depth or not data:
            return
        if self.in_text:
            self.texts[-1] += data
        else:
            self.texts.append(data)
            self.in_text = True

    def handle_comment(self, data):
        self._boundary()

    def handle_decl(self, decl):
        self._boundary()

    def handle_pi(self, data):
        self._boundary()

    def unknown_decl(self, data):
        self._boundary()

    def handle_entityref(self, name):
        self.handle_data(_decode_entity(name))

    def handle_charref(self, name):
        self.handle_data(_decode_charref(name))

    def finish(self):
        self.close()
        self._boundary()
        end = len(self.texts)
        for el in self.elements:
            if el["t1"] is None:
                el["t1"], el["last"] = end, len(self.elements) - 1
        return self


def document_text(html: str) -> str:
    """All text nodes concatenated (no separator)."""
    w = _Walker(False)
    w.feed(html)
    w.finish()
    return "".join(w.texts)


def raw_page_text(html: str | None) -> str | None:
    """Text nodes of a page; None for None and on a parser error."""
    if html is None:
        return None
    try:
        return document_text(html)
    except Exception:  # the caller falls back to the raw input
        return None


ELEMENT_FIELDS = ["id", "name", "type", "placeholder", "value", "onclick", "action", "method", "href"]


# Element columns in order: name, Spark type. ``ord`` numbers elements in document
# order and ``last`` is the greatest ord inside an element: what it contains are the
# ords after its own up to ``last``, two numbers however deep a page is nested.
ELEMENT_COLUMNS = (
    [("ord", "int"), ("tag", "string")]
    + [("el_" + f if f in ("id", "name") else f, "string") for f in ELEMENT_FIELDS]
    + [("classes", "array<string>"), ("required", "boolean"), ("text", "string"), ("text_strip", "string"),
       ("last", "int"), ("attrs", "map<string,string>")])


ARROW_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
               "map<string,string>": pa.map_(pa.string(), pa.string())}


def element_columns(html: str | None, columns, text_tags=None) -> list[list]:
    """One value list per wanted column, an entry per element in document order.
    Texts are made only if wanted, and only for ``text_tags`` (None: all)."""
    out: list[list] = [[] for _ in columns]
    if not html:
        return out
    w = _Walker(True)
    w.feed(html)
    w.finish()
    for el in w.elements:
        a = el["attrs"]
        wanted = text_tags is None or el["tag"] in text_tags
        for values, c in zip(out, columns):
            if c == "ord":
                v = el["ord"]
            elif c == "tag":
                v = el["tag"]
            elif c == "classes":
                v = _WS.split(a["class"].strip()) if a.get("class", "").strip() else []
            elif c == "required":
                v = "required" in a
            elif c == "text":
                v = "".join(w.texts[el["t0"]:el["t1"]]) if wanted else None
            elif c == "text_strip":
                v = "".join([t.strip() for t in w.texts[el["t0"]:el["t1"]]]) if wanted else None
            elif c == "last":
                v = el["last"]
            elif c == "attrs":
                v = list(a.items())
            else:
                v = a.get(c.removeprefix("el_"))
            values.append(v)
    return out
