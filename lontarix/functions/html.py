"""Pages: title, text, links, labelled fields, documents and next pages, by one walk over a page's elements in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, unquote, unquote_to_bytes, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame

#: Labels of a portal page and the fields that they name.
FIELDS = {
    "judul": "title", "tipe dokumen": "document_type", "nomor": "number", "tahun": "year", "bentuk": "regulation_type", "bentuk singkat": "regulation_abbreviation",
    "t.e.u.": "issuer", "tanggal penetapan": "enactment_date", "tanggal pengundangan": "promulgation_date", "tanggal berlaku": "effective_date",
    "tempat penetapan": "enactment_place", "sumber": "publication_source", "bahasa": "language", "status": "portal_status", "lokasi": "location",
}
FIELD_BYTES = 8192
#: Elements whose leading text may be a label; elements that link, with their attributes in order; words of a link to the next page.
LABELLED, LINKING, TARGETS, NEXT = ("div", "td", "dt", "label"), ("a", "iframe", "embed", "object"), ("href", "src", "data"), ("next", "selanjutnya")
#: Parts of a document's path, and of one that leads to a document's page.
DOCUMENT_PATHS, DETAIL_PATHS, RELATED_PATH = ("/download/", "/unduh/"), ("/details/", "/produk_hukum/view/id/"), "downloadujimateri"
#: Elements without an end tag, and for those whose end tag may be left out what ends them.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDED_BY = {"a": {"a"}, "p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: A tag that the page's end cuts off: no element and no text.
_TORN = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_PATH, _BAD = re.compile(r"[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/%]*"), re.compile(r"%(?![0-9A-Fa-f]{2})|[\x00-\x1f\x7f]")


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def resolve(base: str, target: str) -> str:
    """The absolute http or https URL of a link on the page ``base``, without fragment; "" for any other and for one that is malformed.

    Dot segments are taken out of the path, and a path with characters that URLs don't have is percent-encoded anew.
    """
    if not target or _BAD.search(target.strip()):
        return ""
    try:
        parts = urlsplit(urljoin(base, target.strip()))
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return ""
    except ValueError:
        return ""
    path = parts.path if _PATH.fullmatch(parts.path) else quote(unquote_to_bytes(parts.path), safe="-_.~$&+,/:;=@")
    return urlunsplit((parts.scheme, parts.netloc, path, parts.query, ""))


class _Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[_Node | str | None] = []  # None is a comment


class _Tree(HTMLParser):
    """The page's elements; end tags that are left out are put where the next element needs them, stray ones are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while tag in _ENDED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = _Node(tag, own)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "body", "html"):
                return  # an end tag doesn't reach out of a cell

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(None)


def _walk(node: _Node) -> Iterator[tuple[_Node | str, _Node | None]]:
    """Elements and texts in the order of the page, each with its next element; what scripts and styles hold is left out."""
    todo: list[tuple[_Node | str, _Node | None]] = [(node, None)]
    while todo:
        node, following = todo.pop()
        yield node, following
        if isinstance(node, _Node) and node.tag not in ("script", "style"):
            after: _Node | None = None
            for c in reversed(node.children):
                if c is not None:
                    todo.append((c, after))
                    after = c if isinstance(c, _Node) else after


def _text(node: _Node) -> str:
    return collapse(" ".join(n for n, _ in _walk(node) if isinstance(n, str)))


def _field(node: _Node, following: _Node | None) -> tuple[str, str] | None:
    """Field and value of an element that begins with a label: its first child element with text (no line break), else the next element."""
    leading = []
    for c in node.children:
        if not isinstance(c, str):
            break
        leading.append(c)
    key = FIELDS.get(collapse("".join(leading)).lower().strip(" :"))
    if key is None:
        return None
    value = next((t for c in node.children if isinstance(c, _Node) and c.tag != "br" and (t := _text(c))), "")
    value = value or (_text(following) if following else "")
    return (key, value) if value and len(value.encode()) < FIELD_BYTES else None


def parse_page(raw: str | None, base: str) -> dict:
    """title (text of the first h1 that has some), text, links, fields, documents, related, details, next; each target once, in order."""
    tree = _Tree()
    tree.feed(_TORN.sub("", raw or ""))
    tree.close()
    out: dict = {"title": "", "fields": {}} | {k: {} for k in ("links", "documents", "related", "details", "next")}
    texts = []
    for node, following in _walk(tree.open[0]):
        if isinstance(node, str):
            texts.append(node)
            continue
        if node.tag == "h1" and not out["title"]:
            out["title"] = _text(node)
        if node.tag in LABELLED and (found := _field(node, following)) and found[1] not in out["fields"].setdefault(found[0], []):
            out["fields"][found[0]].append(found[1])
        if node.tag in LINKING and (url := resolve(base, next((node.attributes[t] for t in TARGETS if node.attributes.get(t)), ""))):
            out["links"].setdefault(url)
            label, query = _text(node), dict(reversed(parse_qsl(urlsplit(url).query)))
            if ".pdf" in query.get("file", "").lower():
                url = resolve(base, query["file"]) or url
            parts = urlsplit(url)
            path = unquote(parts.path).lower()
            if path.endswith(".pdf") or any(p in path for p in DOCUMENT_PATHS):
                out["related" if RELATED_PATH in path else "documents"].setdefault(url)
            if node.tag == "a":
                if any(p in path for p in DETAIL_PATHS):
                    out["details"].setdefault(url)
                onward = "next" in node.attributes.get("rel", "").lower() or label.lower() in NEXT or node.attributes.get("aria-label", "").lower() == "next"
                if onward and parts.hostname == urlsplit(base).hostname:
                    out["next"].setdefault(url)
    out["text"] = collapse(" ".join(texts))
    return {k: list(v) if k in ("links", "documents", "related", "details", "next") else v for k, v in out.items()}


_PARSED = ("title", "links", "fields", "text", "documents", "related", "details", "next")


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, title, links, fields, text, documents, related, details, next) of every page; a page without markup has empty ones."""
    kind = pages.schema[id_col].dataType.simpleString()
    strings = pa.list_(pa.string())
    types = {c: strings for c in _PARSED} | {"title": pa.string(), "text": pa.string(), "fields": pa.map_(pa.string(), strings)}
    names = {strings: "array<string>", pa.string(): "string", types["fields"]: "map<string, array<string>>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                got = [parse_page(h, u or "") for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                columns = [pa.array([list(g[c].items()) if c == "fields" else g[c] for g in got], types[c]) for c in _PARSED]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *_PARSED])

    fields = ", ".join(f"`{c}` {names[types[c]]}" for c in _PARSED)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
