"""The expressions as temporary SQL functions, which Spark SQL inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from blogindex.functions import urls

SCHEME = urls.SCHEME
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
_KEPT = "replace(replace(url_encode(url_decode(replace(p, '+', '%2B'))), '+', '%20'), '*', '%2A')"
for _escape, _char in urls.PATH_KEEPS.items():
    _KEPT = f"replace({_KEPT}, '{_escape}', '{_char}')"

# Patterns are raw literals: r"..." keeps backslashes as they are.
_DEFINITIONS = {
    "extract_domain(url STRING) RETURNS STRING":
        """regexp_replace(regexp_replace(url, '^https?://', ''), '(?s)/.*$', '')""",
    "netloc(url STRING) RETURNS STRING":
        rf"""regexp_extract(url, r"^{SCHEME}://([^/?#]*)", 1)""",
    "hostname(url STRING) RETURNS STRING":
        rf"""regexp_replace(regexp_extract(regexp_extract(url, r"{urls.AUTHORITY}", 1),
            r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", '')""",
    "word_count(content STRING) RETURNS INT":
        r"""if(coalesce(content, '') = '', 0,
            length(regexp_replace(content, r"[\p{L}\p{N}_\t\n\x0B\f\r]+", '')) + 1)""",
    "strip_blank(txt STRING) RETURNS STRING":
        rf"""regexp_replace(txt, r"^{_BLANK}+|{_BLANK}+\z", '')""",
    "content_hash(title STRING, content STRING) RETURNS STRING":
        """sha2(concat(strip_blank(lower(coalesce(title, ''))), ' ',
            strip_blank(lower(coalesce(content, '')))), 256)""",
    "snippet(content STRING) RETURNS STRING":
        rf"""if(length(strip_blank(coalesce(content, ''))) <= 200, strip_blank(coalesce(content, '')),
            concat(regexp_extract(concat(regexp_replace(strip_blank(content), r"{_BLANK}+", ' '), ' '),
            '^(.{{0,199}}) ', 1), '...'))""",
    "encode_path(p STRING) RETURNS STRING":
        rf"""if(p RLIKE r"{urls.PATH_OK}", p, {_KEPT})""",
    "clean_path(p STRING) RETURNS STRING":
        rf"""if(p RLIKE r"{urls.DOT_SEGMENT}", concat('/', array_join(aggregate(
            filter(split(p, '/'), s -> s NOT IN ('', '.')), cast(array() AS array<string>),
            (a, s) -> if(s = '..', slice(a, 1, greatest(size(a) - 1, 0)), array_append(a, s))), '/')),
            regexp_replace(regexp_replace(p, '/{{2,}}', '/'), '(?<=.)/$', ''))""",
    "url_parses(u STRING) RETURNS BOOLEAN":
        rf"""u IS NOT NULL AND NOT u RLIKE r"[\x00-\x1f\x7f]" AND NOT startswith(u, ':')
            AND NOT regexp_replace(u, r"\?[^#]*", '') RLIKE '%(?![0-9A-Fa-f]{{2}})'
            AND NOT u RLIKE r"^(?!{SCHEME}:)[^/?#]*:"
            AND NOT regexp_extract(u, r"{urls.AUTHORITY}", 1) RLIKE r'[ <>"^`{{}}|\\]'
            AND NOT regexp_extract(u, r"{urls.AUTHORITY}", 1) RLIKE r":[^@\]]*[^0-9@\]:][^@\]]*$" """,
    "hosted_link(u STRING) RETURNS STRING":
        rf"""concat(lower(regexp_extract(u, r"^({SCHEME}:)?//", 1)), regexp_extract(u, r"^(?:{SCHEME}:)?(//[^/?#]*)", 1),
            encode_path(regexp_extract(u, r"(?s)^(?:{SCHEME}:)?//[^/?#]*([^?#]*)", 1)),
            regexp_extract(u, r"(?s)^[^?#]*(.*)$", 1))""",
    "appended_path(base_path STRING, u STRING) RETURNS STRING":
        """CASE WHEN base_path = '' AND u = '' THEN ''
            WHEN endswith(u, '/') AND NOT endswith(clean_path(concat('/', base_path, '/', u)), '/')
            THEN concat(clean_path(concat('/', base_path, '/', u)), '/')
            ELSE clean_path(concat('/', base_path, '/', u)) END""",
    "page_link(base STRING, u STRING) RETURNS STRING":
        rf"""CASE WHEN NOT url_parses(u) THEN NULL WHEN hostname(u) <> '' THEN hosted_link(u)
            ELSE concat(regexp_extract(base, r"^((?:{SCHEME}:)?//[^/?#]*)", 1),
            encode_path(appended_path(regexp_extract(base, r"^(?:{SCHEME}:)?//[^/?#]*([^?#]*)", 1), u)),
            regexp_extract(base, r"(?s)^[^?#]*(.*)$", 1)) END""",
    "normalize_link(base STRING, href STRING) RETURNS STRING":
        """page_link(base, strip_blank(href))""",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for signature, body in _DEFINITIONS.items():
        head, returns = signature.split(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    return [s.split("(")[0] for s in _DEFINITIONS]
