"""Text expressions: fields to text, tokens, fingerprints, counts, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w is ASCII; these classes cover letters and digits of every script.
WORD = r"[\p{L}\p{N}_]+"
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
# A whole word of four or more ASCII letters: no other word character may touch it.
_ASCII_WORD = r"(?<![\p{L}\p{N}_])[a-z]{4,}+(?![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def page_text(fields: list[str]) -> Column:
    """The named page fields in order, lists flattened, joined by one space."""
    lists = {"keywords", "headings", "content", "links", "script_links", "script_content"}
    return F.concat_ws(" ", *[
        F.col(f) if f in lists else F.nullif(F.col(f), F.lit("")) for f in fields])


def words(text: Column) -> Column:
    """Lower-case words of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Words of only ASCII letters and more than three of them."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_ASCII_WORD})"), F.lit(1))


def has_tokens(text: Column) -> Column:
    return F.lower(text).rlike(_ASCII_WORD)


def remove_stop_words(toks: Column, stop_words: list[str]) -> Column:
    return F.filter(toks, lambda t: ~t.isin(stop_words)) if stop_words else toks


def ngrams(toks: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of low to high neighbouring tokens, joined by a space.

    The list is bound once, as the variable of a transform over a list of one: an expression
    used in a lambda would be worked out again for every token.
    """
    def of_size(bound: Column, n: int) -> Column:
        if n == 1:
            return bound
        starts = F.slice(bound, 1, F.greatest(F.size(bound) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda t, i: F.concat(
            t, *[x for k in range(1, n) for x in (F.lit(" "), F.get(bound, i + k))]))

    return F.transform(F.array(toks), lambda bound: F.concat(*[of_size(bound, n) for n in range(low, high + 1)]))[0]


def content_text(content: Column) -> Column:
    return F.concat_ws(" ", content)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def content_hash(title: Column, content: Column) -> Column:
    """Fingerprint of title and content; case and outer white space do not count."""
    text = F.concat(strip(F.lower(F.coalesce(title, F.lit("")))), F.lit(" "),
                    strip(F.lower(F.coalesce(content, F.lit("")))))
    return F.sha2(text, 256)


def word_count(text: Column) -> Column:
    """Pieces between single spaces after every symbol became a space.

    That is one more than the number of spaces and symbols, so it is enough to
    drop the words and the other white space and to measure what is left.
    """
    separators = F.regexp_replace(text, r"[\p{L}\p{N}_\t\n\x0B\f\r]+", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)) \
        .otherwise(F.length(separators) + 1).cast("int")


def snippet(text: Column, limit: int = 200) -> Column:
    """The text, or its longest run of whole words that fits, with an ellipsis."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    line = F.concat(F.regexp_replace(trimmed, rf"{BLANK}+", " "), F.lit(" "))
    head = F.regexp_extract(line, rf"^(.{{0,{limit - 1}}}) ", 1)
    return F.when(F.length(trimmed) <= limit, trimmed).otherwise(F.concat(head, F.lit("...")))
