"""Weighted positional index over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.functions import text as tx
from blogindex.functions.stemming import stem_words
from blogindex.functions.stopwords import ENGLISH_STOP_WORDS
from blogindex.plans.rows import runs, unnest
from blogindex.session import dropped_shuffles

# Limits of positions, and field weights.
MAX_POSITION, MAX_POSITIONS = 16_383, 256
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# Indexed fields in order, with their weight letter.
FIELDS = [("title", "A"), ("description", "B"), ("headings", "B"), ("content", "C"),
          ("keywords", "D")]


def _check(config: str) -> None:
    if config not in ("simple", "english"):
        raise ValueError(f"unknown text configuration: {config}")


def lexemes(text: Column, config: str = "simple", stop_words: list[str] | None = None) -> Column:
    """(pos, lexeme) list: words counted from 1; a stop word is left out but takes its number.

    'english' drops the English stop words and stems the rest, 'simple' does neither
    unless stop words are given.
    """
    _check(config)
    if stop_words is None:
        stop_words = ENGLISH_STOP_WORDS if config == "english" else []
    placed = F.transform(tx.words(text), lambda w, i: F.struct((i + 1).alias("pos"), w.alias("lexeme")))
    return F.filter(placed, lambda e: ~e["lexeme"].isin(stop_words)) if stop_words else placed


def _stemmed(df: DataFrame, entries: str, config: str) -> DataFrame:
    """The entries with their lexemes stemmed under the 'english' configuration.

    One Arrow call per batch takes all lexemes and stems each distinct one once.
    """
    if config != "english":
        return df
    stems = stem_words(F.transform(F.col(entries), lambda e: e["lexeme"]))
    return df.withColumn("_stems", stems).withColumn(
        entries, F.zip_with(F.col(entries), F.col("_stems"),
                            lambda e, s: e.withField("lexeme", s))).drop("_stems")


def analyze(df: DataFrame, key: str, text: Column, config: str = "simple",
            stop_words: list[str] | None = None) -> DataFrame:
    """(key, pos, lexeme) of a text."""
    placed = df.select(key, lexemes(F.coalesce(text, F.lit("")), config, stop_words).alias("_l"))
    return _stemmed(placed, "_l", config).transform(lambda d: unnest(d, "_l", key))


def _entries(pages: DataFrame, keep: list[str], config: str, stop_words: list[str] | None,
             position_limits: bool) -> DataFrame:
    """The kept columns and _all, the (lexeme, pos, weight) list of the weighted fields.

    Each field continues behind the last kept position of those before it. Everything
    happens inside the row. The steps are separate projections because a list used twice
    in one expression would be computed twice.
    """
    texts = {f"_f{i}": F.array_join(F.col(name), " ") if name in ("headings", "keywords") else F.col(name)
             for i, (name, _) in enumerate(FIELDS)}
    df = pages.select(*keep, *[lexemes(F.coalesce(t, F.lit("")), config, stop_words).alias(n)
                               for n, t in texts.items()])
    def capped(pos: Column) -> Column:
        return F.least(pos, F.lit(MAX_POSITION)) if position_limits else pos

    df = df.withColumns({
        f"_e{i}": F.coalesce(F.try_element_at(F.col(f"_f{i}"), F.lit(-1))["pos"], F.lit(0))
        for i in range(len(FIELDS))})

    def placed(i: int, weight: str, start: Column) -> Column:
        return F.transform(F.col(f"_f{i}"), lambda e: F.struct(
            e["lexeme"].alias("lexeme"), capped(e["pos"] + start).alias("pos"),
            F.lit(weight).alias("weight")))

    start: Column = F.lit(0)
    shifted = []
    for i, (_, weight) in enumerate(FIELDS):
        shifted.append(placed(i, weight, start))
        start = capped(start + F.col(f"_e{i}"))
    return _stemmed(df.select(*keep, F.concat(*shifted).alias("_all")), "_all", config)


def document_vectors(pages: DataFrame, key: str = "id", config: str = "simple",
                     stop_words: list[str] | None = None, position_limits: bool = False) -> DataFrame:
    """(key, lexeme, pos, weight) of each page's fields; needs no shuffle."""
    entries = _entries(pages, [key], config, stop_words, position_limits)
    return unnest(entries, "_all", key)


def build_postings(pages: DataFrame, key: str = "id", config: str = "simple",
                   stop_words: list[str] | None = None, keep: list[str] | None = None,
                   position_limits: bool = False) -> DataFrame:
    """(lexeme, key, keep..., positions): positions with weight letter, in order, each once.

    With position_limits, the published limits of the search-vector type hold: 256 positions
    per lexeme, and those above 16,383 are pressed into it. Without, every position is kept.

    A page's entries are sorted and cut into runs of one lexeme inside its row, so the
    postings come out of a map-only plan; only writing them by lexeme shuffles.
    """
    columns = [key, *(keep or [])]
    entries = _entries(pages, columns, config, stop_words, position_limits)

    def once(run: Column) -> Column:
        # Positions differ unless the limit presses them together.
        if not position_limits:
            return run
        kept = F.filter(run, lambda p, i: (i == 0) | (p["pos"] != F.try_element_at(run, i)["pos"]))
        return F.slice(kept, 1, MAX_POSITIONS)

    grouped = runs(entries, "_all", "lexeme", lambda run: F.transform(
        run, lambda e: F.struct(e["pos"].alias("pos"), e["weight"].alias("w"))), "_run")
    return grouped.select("lexeme", *columns, once(F.col("_run")).alias("positions"))


def write_postings(postings: DataFrame, path: str) -> None:
    """Map-only write: each file is sorted by lexeme, so a lookup skips most row groups.

    What moved the pages before is deleted when the postings are written.
    """
    order = ["lexeme", *[c for c in postings.columns if c not in ("lexeme", "positions")]]
    with dropped_shuffles(postings.sparkSession):
        postings.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def cluster_postings(postings: DataFrame, path: str) -> None:
    """Write sorted across files as well; for stored postings, since ranges need a sampling pass.

    Ranges include the page, so a lexeme found on very many pages spans several files.
    """
    order = ["lexeme", *[c for c in postings.columns if c not in ("lexeme", "positions")]]
    write_postings(postings.repartitionByRange(*order), path)
