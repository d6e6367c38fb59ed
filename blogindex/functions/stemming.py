"""English suffix stripping after the published Porter2 description.

Spark has no stemmer. The Arrow function stems only the distinct words of a batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the algorithm: word classes, suffixes and exceptions.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_ENDING = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset(
    ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
_PREFIXES = ("gener", "commun", "arsen")

_REGION = re.compile(r".*?[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in _PREFIXES if word.startswith(p)), None)
    if first is None:
        m = _REGION.match(word)
        first = m.end() if m else len(word)
    m = _REGION.match(word, first)
    return first, m.end() if m else len(word)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # Past and progressive forms.
    end = _longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[:-len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[:-len(end)]):
        w = w[:-len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # Derivational suffixes.
    end = _longest(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        head = w[:-len(end)]
        if (end != "ogi" or head.endswith("l")) and (end != "li" or head[-1:] in tuple(_LI_ENDING)):
            w = head + _STEP2[end]
    end = _longest(w, _STEP3)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[:-len(end)] + _STEP3[end]
    end = _longest(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[:-len(end)]
    # Final e and doubled l.
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stem_array(words: pa.Array) -> pa.Array:
    encoded = pc.dictionary_encode(words)
    stems = pa.array([None if w is None else stem(w) for w in encoded.dictionary.to_pylist()],
                     words.type)
    return pc.take(stems, encoded.indices)


@F.arrow_udf(ArrayType(StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """Stems of lists of words, position by position."""
    lists = words if isinstance(words, pa.ListArray) else words.cast(pa.list_(pa.string()))
    stems = _stem_array(lists.values)
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(lists.offsets, stems, mask=mask)


def stem_steps(word: str, dialect: str = "spark") -> list[tuple[str, str]]:
    """The rules as SQL: (column, expression) pairs, each using those before it; the last is stem.

    word names the column of lower-case words. The dialects differ in how a pattern is
    tested and replaced only.
    """
    def has(x: str, pattern: str) -> str:
        return f"{x} RLIKE '{pattern}'" if dialect == "spark" else f"regexp_matches({x}, '{pattern}')"

    def quoted(values) -> str:
        return ", ".join(f"'{v}'" for v in values)

    def ending(x: str, suffixes) -> str:
        # The match that starts first is that of the longest suffix.
        return f"regexp_extract({x}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 1)"

    def switch(x: str, table: dict[str, str]) -> str:
        return f"CASE {x} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())} END"

    def region(x: str) -> str:
        return f"length(regexp_extract({x}, '^.*?[aeiouy][^aeiouy]', 0))"

    def head(x: str, end: str) -> str:
        return f"left({x}, length({x}) - length({end}))"

    def far(x: str, end: str, start: str) -> str:
        return f"{end} <> '' AND length({x}) - length({end}) >= {start}"

    short = f"({has('{x}', '[^aeiouy][aeiouy][^aeiouywxY]$')} OR {has('{x}', '^[aeiouy][^aeiouy]$')})"
    doubles = "(" + "|".join(_DOUBLES) + ")$"
    marked = f"regexp_replace({word}, '(^|[aeiouy])y', '$1Y')" if dialect == "spark" else \
        f"regexp_replace({word}, '(^|[aeiouy])y', '\\1Y', 'g')"
    first = " ".join(f"WHEN starts_with(a, '{x}') THEN {len(x)}" if dialect != "spark" else f"WHEN startswith(a, '{x}') THEN {len(x)}"
                     for x in _PREFIXES)
    return [
        ("a", marked),
        ("r1", f"CASE {first} WHEN {region('a')} = 0 THEN length(a) ELSE {region('a')} END"),
        ("r2", f"CASE WHEN {region('substring(a, r1 + 1)')} = 0 THEN length(a) ELSE r1 + {region('substring(a, r1 + 1)')} END"),
        # Plurals.
        ("b", f"CASE WHEN a LIKE '%sses' THEN left(a, length(a) - 2) WHEN a LIKE '%ied' OR a LIKE '%ies' THEN "
              f"left(a, length(a) - CASE WHEN length(a) > 4 THEN 2 ELSE 1 END) WHEN a LIKE '%s' AND a NOT LIKE '%us' AND a NOT LIKE '%ss' "
              f"AND {has('left(a, length(a) - 2)', '[aeiouy]')} THEN left(a, length(a) - 1) ELSE a END"),
        # Past and progressive forms.
        ("e1", ending("b", ["eed", "eedly", "ed", "edly", "ing", "ingly"])),
        ("h", head("b", "e1")),
        ("c", f"CASE WHEN e1 IN ('eed', 'eedly') THEN CASE WHEN length(h) >= r1 THEN concat(h, 'ee') ELSE b END "
              f"WHEN e1 = '' OR NOT {has('h', '[aeiouy]')} THEN b WHEN {has('h', '(at|bl|iz)$')} THEN concat(h, 'e') "
              f"WHEN {has('h', doubles)} THEN left(h, length(h) - 1) "
              f"WHEN length(h) <= r1 AND {short.format(x='h')} THEN concat(h, 'e') ELSE h END"),
        ("d", f"CASE WHEN length(c) > 2 AND {has('c', '[^aeiouy][yY]$')} THEN concat(left(c, length(c) - 1), 'i') ELSE c END"),
        # Derivational suffixes.
        ("e2", ending("d", _STEP2)),
        ("h2", head("d", "e2")),
        ("f", f"CASE WHEN {far('d', 'e2', 'r1')} AND (e2 <> 'ogi' OR h2 LIKE '%l') AND (e2 <> 'li' OR {has('h2', f'[{_LI_ENDING}]$')}) "
              f"THEN concat(h2, {switch('e2', _STEP2)}) ELSE d END"),
        ("e3", ending("f", _STEP3)),
        ("g", f"CASE WHEN {far('f', 'e3', 'r1')} AND (e3 <> 'ative' OR length(f) - length(e3) >= r2) "
              f"THEN concat({head('f', 'e3')}, {switch('e3', _STEP3)}) ELSE f END"),
        ("e4", ending("g", _STEP4)),
        ("i", f"CASE WHEN {far('g', 'e4', 'r2')} AND (e4 <> 'ion' OR {has(head('g', 'e4'), '[st]$')}) THEN {head('g', 'e4')} ELSE g END"),
        # Final e and doubled l.
        ("j", "left(i, length(i) - 1)"),
        ("k", f"CASE WHEN i LIKE '%e' AND (length(j) >= r2 OR (length(j) >= r1 AND NOT {short.format(x='j')})) THEN j "
              f"WHEN i LIKE '%ll' AND length(j) >= r2 THEN j ELSE i END"),
        ("stem", f"CASE WHEN length({word}) <= 2 THEN {word} WHEN {word} IN ({quoted(_WHOLE)}) THEN {switch(word, _WHOLE)} "
                 f"WHEN b IN ({quoted(sorted(_AFTER_1A))}) THEN b ELSE replace(k, 'Y', 'y') END"),
    ]


def stem_vocabulary(vocabulary: DataFrame, col: str = "word") -> DataFrame:
    """(word, stem) of the distinct words, by column expressions only."""
    words = vocabulary.select(F.col(col).alias("word")).distinct()
    for name, rule in stem_steps("word"):
        words = words.withColumn(name, F.expr(rule))
    return words.select("word", "stem")
