"""Field extraction from HTML documents.

The token walk is the one per-row Python step: an Arrow-batched function from the
HTML column to a struct of raw fields. Links are put into their written form afterwards
by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from blogindex.functions import urls

# Tags whose text is content, headings, and tags that hold raw text.
CONTENT_TAGS = frozenset((
    "p span pre code em strong b i mark small abbr cite q blockquote kbd samp var "
    "li dt dd th td caption").split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW_TAGS = frozenset(
    "iframe noembed noframes noscript plaintext script style textarea title xmp".split())
DECODED_RAW_TAGS = frozenset(["textarea", "title"])
# The Unicode white space characters.
_SPACE = ("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*+))?+"""
_MARKUP = re.compile(rf"""
    <!--(?:-?>|.*?(?:--!?>|\Z))          # comment
  | <(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)  # doctype and bogus comments
  | <(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|{_ATTRIBUTE})*+)(?P<close>>|\Z)
""", re.S | re.X)
_PAIR = re.compile(
    r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?+""", re.S)
_REFERENCE = re.compile(r"&(?:#\w+;?|[a-zA-Z][a-zA-Z0-9]*;?)(=)?")

_TEXT = ["title", "description", "author"]
_LISTS = ["keywords", "headings", "content", "hrefs", "srcs", "script_content"]
RAW_FIELDS = StructType([StructField(n, StringType()) for n in _TEXT]
                        + [StructField(n, ArrayType(StringType())) for n in _LISTS])


def _attribute_text(value: str) -> str:
    """Decode references; a bare name before '=' or inside a longer name stays."""
    def decode(m: re.Match) -> str:
        ref, follow = m.group(0), m.group(1) or ""
        name = ref[1:len(ref) - len(follow)]
        if name.startswith("#") or name.endswith(";") or (not follow and name in html5):
            return unescape("&" + name) + follow
        return ref

    value = value.replace("\r\n", "\n").replace("\r", "\n")
    return _REFERENCE.sub(decode, value) if "&" in value else value


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    for m in _PAIR.finditer(text):
        yield m.group(1).lower(), _attribute_text(m.group(2) or m.group(3) or m.group(4) or "")


def html_tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('start', tag, attributes) and ('text', '', text) tokens in document order.

    End tags, comments and self-closing tags only separate text.
    """
    at, size = 0, len(html)
    raw = ""
    while at < size:
        if raw:
            end = None if raw == "plaintext" else re.compile(
                rf"</{raw}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            text = html[at:stop].replace("\r\n", "\n").replace("\r", "\n")
            if text:
                yield "text", "", unescape(text) if raw in DECODED_RAW_TAGS else text
            at, raw = stop, ""
            continue
        mark = _MARKUP.search(html, at)
        stop = mark.start() if mark else size
        if stop > at:
            text = html[at:stop].replace("\r\n", "\n").replace("\r", "\n")
            yield "text", "", unescape(text) if "&" in text else text
        if not mark:
            return
        at = mark.end()
        if mark["name"] and not mark["end"]:
            if not mark["close"]:
                return
            name = mark["name"].lower()
            raw = name if name in RAW_TAGS else ""
            if html[at - 2] != "/":
                yield "start", name, mark["attrs"]


def page_fields(html: str | None) -> tuple:
    """Raw fields of one document: text goes to the last start tag before it."""
    title = description = author = None
    keywords: list[str] | None = None
    headings, content, hrefs, srcs, scripts = [], [], [], [], []
    state = ""
    for kind, tag, data in html_tokens(html or ""):
        if kind == "text":
            text = data.strip(_SPACE) if state else ""
            if not text:
                continue
            if state in CONTENT_TAGS:
                content.append(text)
            elif state in HEADING_TAGS:
                headings.append(text)
            elif state == "title":
                title = text
            elif state == "script":
                scripts.append(text)
            continue
        state = tag
        if tag == "a":
            hrefs.extend(v for k, v in _attributes(data) if k == "href")
        elif tag == "script":
            srcs.extend(v for k, v in _attributes(data) if k == "src")
        elif tag == "meta":
            meta = dict(_attributes(data))
            value = meta.get("content", "").strip(_SPACE)
            name = meta.get("name", "").strip(_SPACE) if value else ""
            if name == "description":
                description = value
            elif name == "author":
                author = value
            elif name == "keywords":
                keywords = value.split(",")
    return title, description, author, keywords or [], headings, content, hrefs, srcs, scripts


# Pages whose fields are in a task's Python at once.
_ROWS = 200


@F.arrow_udf(RAW_FIELDS)
def raw_fields(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A batch is walked in slices, so only a slice is held as Python objects."""
    kinds = [pa.string()] * len(_TEXT) + [pa.list_(pa.string())] * len(_LISTS)
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            columns = zip(*[page_fields(h.as_py()) for h in batch.slice(at, _ROWS)])
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], RAW_FIELDS.fieldNames())


def extract_pages(df: DataFrame, mode: str = "append") -> DataFrame:
    """Crawled pages of documents (page_id, url, html), other columns kept."""
    keep = [c for c in df.columns if c not in ("url", "html")]
    base = urls.url_parts(F.col("url"))

    def links(name: str):
        written = F.transform(F.col(name), lambda h: urls.normalize_link(
            {p: F.col("_base")[p] for p in base}, h, mode))
        return F.filter(written, lambda u: u.isNotNull())

    return (df.select(*keep, "url", raw_fields("html").alias("_f"))
            .select(*keep, "url", "_f.*", F.struct(*[v.alias(p) for p, v in base.items()]).alias("_base"))
            .select(*keep, "title", "description", "author", "keywords", "headings", "content",
                    links("hrefs").alias("links"), links("srcs").alias("script_links"),
                    "script_content", F.col("url").alias("location")))
