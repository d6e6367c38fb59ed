"""URL expressions. All are plain column expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"
AUTHORITY = rf"^(?:{SCHEME}:)?//([^/?#]*)"
DOT_SEGMENT = r"(^|/)\.{1,2}(/|$)"
# Characters a URL path may carry as they are.
PATH_OK = r"^(?:[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]|%[0-9A-Fa-f]{2})*$"
# Characters that form encoding escapes but a URL path keeps.
PATH_KEEPS = {
    "%2F": "/", "%7E": "~", "%24": "$", "%26": "&", "%2B": "+",
    "%2C": ",", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@",
}


def netloc(url: Column) -> Column:
    """Authority with user info and port; '' without one."""
    return F.regexp_extract(url, rf"^{SCHEME}://([^/?#]*)", 1)


def hostname(url: Column) -> Column:
    """Host without user info, port or brackets, in its own case."""
    host = F.regexp_extract(
        F.regexp_extract(url, AUTHORITY, 1), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(host, r"[\[\]]", "")


def domain(url: Column) -> Column:
    """What is left after dropping a web scheme and all from the first slash."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "(?s)/.*$", "")


def valid_location(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def parses(url: Column) -> Column:
    """Whether a strict URL parser takes the string."""
    before_query = F.regexp_replace(url, r"\?[^#]*", "")
    authority = F.regexp_extract(url, AUTHORITY, 1)
    return (
        url.isNotNull()
        & ~url.rlike(r"[\x00-\x1f\x7f]")
        & ~url.startswith(":")
        & ~before_query.rlike(r"%(?![0-9A-Fa-f]{2})")
        & ~url.rlike(rf"^(?!{SCHEME}:)[^/?#]*:")
        & ~authority.rlike(r'[ <>"^`{}|\\]')
        & ~authority.rlike(r":[^@\]]*[^0-9@\]:][^@\]]*$")
    )


def _percent_encode(path: Column) -> Column:
    """Decode, then encode everything a path may not hold."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    out = F.regexp_replace(F.regexp_replace(F.url_encode(plain), r"\+", "%20"), r"\*", "%2A")
    for escape, char in PATH_KEEPS.items():
        out = F.replace(out, F.lit(escape), F.lit(char))
    return out


def encode_path(path: Column) -> Column:
    """Keep a valid path as written; percent-encode any other as a whole."""
    return F.when(path.rlike(PATH_OK), path).otherwise(_percent_encode(path))


def clean_path(path: Column) -> Column:
    """Collapse slashes and resolve '.' and '..' of a rooted path; no trailing slash."""
    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))) \
            .otherwise(F.array_append(done, part))

    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    plain = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "(?<=.)/$", "")
    return F.when(path.rlike(DOT_SEGMENT), F.concat(F.lit("/"), F.array_join(folded, "/"))) \
        .otherwise(plain)


def url_parts(url: Column) -> dict[str, Column]:
    """Origin, path, query (with ?) and fragment (with #) of a URL with an authority, and its scheme."""
    pattern = rf"(?s)^((?:{SCHEME}:)?//[^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    names = ["origin", "path", "query", "fragment"]
    parts = {n: F.regexp_extract(url, pattern, i + 1) for i, n in enumerate(names)}
    return {**parts, "scheme": F.regexp_extract(url, rf"^({SCHEME}:)?//", 1)}


def _absolute(link: Column) -> Column:
    """Written form of a link that has a host: lower-case scheme, encoded path."""
    p = url_parts(link)
    rest = F.substring(p["origin"], F.length(p["scheme"]) + 1, F.length(p["origin"]))
    return F.concat(F.lower(p["scheme"]), rest, encode_path(p["path"]), p["query"], p["fragment"])


def _appended(p: dict[str, Column], link: Column) -> Column:
    """The link appended to the page's own path; the page keeps query and fragment."""
    joined = F.concat(F.lit("/"), p["path"],
                      F.when(link == "", "").otherwise(F.concat(F.lit("/"), link)))
    path = clean_path(joined)
    path = F.when(link.endswith("/") & ~path.endswith("/"), F.concat(path, F.lit("/"))) \
        .otherwise(path)
    path = F.when((path == "/") & (p["path"] == "") & (link == ""), "").otherwise(path)
    return F.concat(p["origin"], encode_path(path), p["query"], p["fragment"])


def _resolved(p: dict[str, Column], link: Column) -> Column:
    """Reference resolution after RFC 3986."""
    pattern = r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$"
    path, query, fragment = (F.regexp_extract(link, pattern, i) for i in (1, 2, 3))
    folder = F.regexp_extract(p["path"], r"^(.*/)", 1)
    merged = F.when(path.startswith("/"), path) \
        .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    cleaned = clean_path(merged)
    keep_slash = merged.rlike(r"(/|/\.{1,2})$") & ~cleaned.endswith("/")
    cleaned = F.when(keep_slash, F.concat(cleaned, F.lit("/"))).otherwise(cleaned)
    full_path = F.when(path == "", p["path"]).otherwise(cleaned)
    full_query = F.when((path == "") & (query == ""), p["query"]).otherwise(query)
    own_scheme = link.rlike(rf"^{SCHEME}:")
    return F.when(own_scheme, link).otherwise(
        F.concat(p["origin"], encode_path(full_path), full_query, fragment))


def normalize_link(base: Column | dict[str, Column], href: Column, mode: str = "append") -> Column:
    """Written form of a page link; null when the link does not parse.

    'append' joins a host-less link to the whole page path, 'rfc3986' resolves it. For
    many links of one page, base may be url_parts() of its address held in columns.
    """
    if mode not in ("append", "rfc3986"):
        raise ValueError(f"unknown link mode: {mode}")
    parts = base if isinstance(base, dict) else url_parts(base)
    link = F.regexp_replace(href, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+\z", "")
    if mode == "append":
        relative, hosted = _appended(parts, link), _absolute(link)
    else:
        relative = _resolved(parts, link)
        hosted = F.when(link.startswith("//"), F.concat(parts["scheme"], _absolute(link))) \
            .otherwise(_absolute(link))
    # Most links are a path or start with a web scheme: only those with // can have a host.
    has_host = link.contains("//") & (hostname(link) != "")
    return F.when(~parses(link), F.lit(None)).when(has_host, hosted).otherwise(relative)


def host_suffixes(host: Column) -> Column:
    """The host and each parent of at least two labels."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, count), "."))
