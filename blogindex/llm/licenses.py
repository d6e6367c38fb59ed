"""Licence scan: TF-IDF cosine of notices to templates, then inheritance down the directories.

Only DataFrame functions run on the data. The number of files with each word is counted
over all words and files; only what depends on the templates alone, a few dozen words, is
computed on the driver and enters the plan as literals.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import stored

# Short notices of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
]
# Base names of licence files.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
_TERM = "[a-z0-9]+"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(f"({_TERM})"), 1)


def _folder(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


class Weights:
    """Term weights of all files, from the number of files that hold each term.

    The counts of all terms stay a table; only those of the template terms come to the driver.
    """

    def __init__(self, files: DataFrame, templates: list[tuple[str, str]], threshold: float):
        bags = {name: Counter(re.findall(_TERM, text.lower())) for name, text in templates}
        names = sorted(set().union(*bags.values()))
        counts = stored(files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
                        .groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
        n = files.count()
        df = {r["term"]: r["df"] for r in counts.filter(F.col("term").isin(names)).collect()}
        self.counts = counts.select("term", (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
        self.idf = {t: math.log((n + 1.0) / (df.get(t, 0) + 1.0)) + 1.0 for t in names}
        raw = {name: {t: k * self.idf[t] for t, k in bag.items()} for name, bag in bags.items()}
        self.size = {name: sum(bag.values()) for name, bag in bags.items()}
        self.unit: dict[str, dict[str, float]] = {}
        self.anchors: dict[str, list[str]] = {}
        # By Cauchy-Schwarz the cosine is at most the length of the part of the template
        # whose terms a text holds, whatever else it holds.
        self.least = threshold * threshold * 0.999
        for name, weights in raw.items():
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.unit[name] = {t: w / norm for t, w in weights.items()}
            # A text that holds none of the heaviest terms cannot reach the threshold:
            # all the lighter ones together are shorter than it.
            rest, self.anchors[name] = 0.0, []
            for t, w in sorted(self.unit[name].items(), key=lambda x: (x[1], x[0])):
                rest += w * w
                if rest >= self.least:
                    self.anchors[name].append(t)

    def near(self, terms: Column) -> Column:
        """The templates that a list of terms can reach, as structs."""
        rows = [F.struct(
            F.lit(name).alias("name"), F.lit(self.size[name]).alias("size"),
            F.array(*map(F.lit, self.anchors[name])).alias("anchors"),
            F.create_map(*[F.lit(x) for t, u in sorted(unit.items()) for x in (t, u * u)]).alias("squares"))
            for name, unit in sorted(self.unit.items())]
        held = F.array_intersect(terms, F.array(*map(F.lit, sorted(self.idf))))
        return F.filter(F.array(*rows), lambda k: F.aggregate(
            held, F.lit(0.0), lambda x, t: x + F.coalesce(F.try_element_at(k["squares"], t), F.lit(0.0))) >= self.least)

    def terms(self, files: DataFrame) -> DataFrame:
        """(term, known): the idf of the template terms, as literals."""
        rows = [F.struct(F.lit(t).alias("term"), F.lit(w).alias("known")) for t, w in sorted(self.idf.items())]
        return files.sparkSession.range(1).select(F.inline(F.array(*rows)))

    def units(self, files: DataFrame) -> DataFrame:
        """(name, term, unit): the templates as vectors of length one, as literals."""
        rows = [F.struct(F.lit(name).alias("name"), F.lit(t).alias("term"), F.lit(u).alias("unit"))
                for name, unit in sorted(self.unit.items()) for t, u in sorted(unit.items())]
        return files.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _lines(texts: DataFrame, weights: Weights, anchor: str) -> DataFrame:
    """(file, is_file, name, part, terms): lines, and whole texts of licence files, with templates they can reach."""
    parts = F.filter(F.split("text", "\n"), lambda line: line.rlike(anchor))
    parts = F.when(F.col("is_file"), F.array_union(F.array("text"), parts)).otherwise(F.array_distinct(parts))
    segments = texts.select("file", "is_file", F.posexplode(parts).alias("part", "segment")) \
        .select("file", "is_file", "part", F.regexp_extract_all("segment", F.lit(f"({_TERM})"), 1).alias("terms"))
    return segments.select("file", "is_file", "part", "terms", F.explode(weights.near(F.col("terms"))).alias("_k")) \
        .select("file", "is_file", F.col("_k.name").alias("name"), "part", "terms")


def _windows(texts: DataFrame, weights: Weights) -> DataFrame:
    """(file, is_file, name, part, terms): runs of as many words as a template, over line breaks too.

    Of every text, each run that holds an anchor term of the template and enough of its
    terms to reach the threshold; of a text of fewer words, all of them. Parts are negative.
    """
    words = texts.select("file", "is_file", F.explode(F.array(_terms(F.col("text")))).alias("words"))
    pairs = words.select("file", "is_file", "words", F.explode(weights.near(F.col("words"))).alias("_k"))
    size, n = F.col("_k.size"), F.size("words")
    at = F.filter(F.transform("words", lambda t, i: F.when(F.array_contains("_k.anchors", t), i + 1)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(
        F.greatest(F.lit(1), i - size + 1), F.greatest(F.lit(1), F.least(i, n - size + 1))))))
    # A term counts as often as it occurs, which only lets more runs through.
    squares = F.transform("words", lambda t: F.coalesce(F.try_element_at("_k.squares", t), F.lit(0.0)))
    pairs = pairs.select("file", "is_file", "words", "_k", starts.alias("_starts"), squares.alias("_squares"))
    kept = F.filter("_starts", lambda s: F.aggregate(
        F.slice("_squares", s, size), F.lit(0.0), lambda x, y: x + y) >= weights.least)
    return pairs.select("file", "is_file", "words", "_k", F.explode(kept).alias("_start")).select(
        "file", "is_file", F.col("_k.name").alias("name"), (-F.col("_start")).alias("part"),
        F.slice("words", F.col("_start"), size).alias("terms"))


def own_licences(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(file, licence, similarity, is_file) of the files (file, path, text) with a notice like a template.

    Every line of a text is compared, every run of as many words as the template has, and
    for a licence file also the whole text; the best counts. What holds too few terms of a
    template to reach the threshold is skipped.
    """
    weights = Weights(files, templates, threshold)
    anchor = rf"(?<![a-z0-9])({'|'.join(sorted(set().union(*weights.anchors.values())))})(?![a-z0-9])"
    is_file = F.col("path").rlike(LICENCE_FILE)
    texts = files.select("file", _lower(F.col("text")).alias("text"), is_file.alias("is_file")).filter(F.col("text").rlike(anchor))
    segments = _lines(texts, weights, anchor).unionByName(_windows(texts, weights))
    key = ["file", "is_file", "name", "part"]
    terms = stored(segments.select(*key, F.explode("terms").alias("term"))
                   .groupBy(*key, "term").agg(F.count("*").alias("tf")), "licence-terms")
    # The literal tables have as many rows as the templates have terms. The other terms
    # meet their counts in a shuffle; template terms, the commonest here, pass it under
    # keys of their own that match nothing.
    known = terms.join(F.broadcast(weights.terms(files)), "term", "left") \
        .join(F.broadcast(weights.units(files)), ["name", "term"], "left") \
        .withColumn("_other", F.when(F.col("known").isNull(), F.col("term")).otherwise(F.concat(F.lit("/"), F.hex("file"))))
    others = weights.counts.join(terms.select("term").distinct(), "term", "left_semi").withColumnRenamed("term", "_other")
    w = F.col("tf") * F.coalesce("known", "idf")
    scored = known.join(others, "_other", "left").groupBy("file", "name", "part").agg(
        F.first("is_file").alias("is_file"),
        F.round(F.sum(w * F.coalesce("unit", F.lit(0.0))) / F.sqrt(F.sum(w * w)), 6).alias("similarity")) \
        .filter(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("_best")
    return scored.groupBy("file").agg(best, F.first("is_file").alias("is_file")) \
        .select("file", F.col("_best.name").alias("licence"), (-F.col("_best.s")).alias("similarity"), "is_file")


def inherited_licences(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """(folder, licence, similarity, licensed_folder): the nearest of a folder and its ancestors with a licence.

    folders is joined once per depth, on the path of the ancestor; a folder has as many
    rows as its path has parts.
    """
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    pairs = folders.select("folder", F.explode(F.array_distinct(above)).alias("licensed_folder"))
    near = pairs.join(licensed, "licensed_folder").groupBy("folder").agg(
        F.max(F.struct(F.length("licensed_folder").alias("n"), "licensed_folder", "licence", "similarity")).alias("_near"))
    return near.select("folder", "_near.licence", "_near.similarity", "_near.licensed_folder")


def scan_licences(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.6) -> DataFrame:
    """(doc_id, path, licence, similarity, origin, inherited_from) of files (doc_id, path, text).

    origin is 'file' for a licence file and 'notice' for another file with a notice of its
    own, 'inherited' where the nearest directory above has a licence file (of several, the
    likest, then the first name), else 'none' with no licence. Notices are cosines of at
    least the threshold; ties go to the name that sorts first. A null text is empty. Rows
    of one path and text are one file, and each keeps a row; rows of one path with other
    texts are files of their own. A null path is the empty one. Other columns are ignored;
    an empty table gives no rows.
    """
    files = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows of one path and text are one file; another text under the same path is another file.
    files = files.withColumn("file", F.unhex(F.md5(F.concat_ws("\n", "path", "text"))))
    own = own_licences(files, templates or TEMPLATES, threshold)
    named = files.select("doc_id", "path", _folder(F.col("path")).alias("folder"), "file")
    licensed = own.filter("is_file").join(named.select("file", F.col("folder").alias("licensed_folder")), "file") \
        .groupBy("licensed_folder").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("_b")) \
        .select("licensed_folder", F.col("_b.licence").alias("licence"), (-F.col("_b.s")).alias("similarity"))
    given = inherited_licences(named.select("folder").distinct(), licensed).withColumnsRenamed(
        {"licence": "_licence", "similarity": "_similarity"})
    out = named.join(own, "file", "left").join(given, "folder", "left")
    has = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("licence", "_licence").alias("licence"),
        F.coalesce("similarity", "_similarity").alias("similarity"),
        F.when(has & F.col("is_file"), "file").when(has, "notice").when(F.col("_licence").isNotNull(), "inherited")
        .otherwise("none").alias("origin"),
        F.when(~has, F.col("licensed_folder")).alias("inherited_from"))


def document_files(docs: DataFrame, per_folder: int = 64) -> DataFrame:
    """Documents as files (doc_id, path, text) of a tree: source, language, number range.

    Of documents of any length with the word 'license' in them, by the id modulo 16, one
    in 16 is a licence file of the source, two of the language, nine of the number range,
    and the others are ordinary files with a notice. A null source, language or id leaves its
    part out, and a row without an id is an ordinary file, named '.txt'; rows of a repeated
    id share a path. A null text stays null.
    """
    deal = F.pmod(F.col("doc_id"), F.lit(16))
    names_it = F.lower("text").contains("license")

    def dealt(low: int, high: int) -> Column:
        return F.coalesce(names_it & deal.between(low, high), F.lit(False))

    name = F.concat(F.when(dealt(0, 11), "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    path = F.concat_ws("/", "source", F.when(~dealt(0, 0), F.col("lang")),
                       F.when(~dealt(0, 2), F.floor(F.col("doc_id") / per_folder).cast("string")), name)
    return docs.select("doc_id", path.alias("path"), "text")


def licence_scan_sql() -> str:
    """The scan of document_files for DuckDB with the document frequencies of all words and all runs of words.

    A run or line is only compared with a template if the template's terms in it are long
    enough together: 0.36 is the square of the threshold.
    """
    templates = ", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES)
    return rf"""
WITH f AS (SELECT doc_id, text, concat_ws('/', source, CASE WHEN deal <> 0 THEN lang END,
    CASE WHEN deal > 2 THEN CAST(doc_id // 64 AS VARCHAR) END,
    CASE WHEN deal <= 11 THEN 'LICENSE-' ELSE '' END || doc_id || '.txt') AS path
  FROM (SELECT *, CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN (doc_id % 16 + 16) % 16 ELSE 16 END AS deal FROM documents)),
l AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS folder, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
    regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$') AS is_file FROM f),
tm AS (SELECT name, regexp_extract_all(lower(body), '[a-z0-9]+') AS terms FROM (VALUES {templates}) t(name, body)),
tc AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(terms) AS term FROM tm) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS term FROM l) GROUP BY term),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM df FULL JOIN (SELECT DISTINCT term FROM tc) USING (term), n),
tw AS (SELECT name, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY name)) AS unit FROM tc JOIN idf USING (term)),
wd AS (SELECT path, is_file, regexp_extract_all(text, '[a-z0-9]+') AS words FROM l),
hit AS (SELECT path, name, len(terms) AS size, n, pos, unit * unit AS sq
  FROM (SELECT path, len(words) AS n, generate_subscripts(words, 1) AS pos, unnest(words) AS term FROM wd) JOIN tw USING (term) JOIN tm USING (name)),
st AS (SELECT path, name, size, start FROM (SELECT path, name, size, sq,
    unnest(range(greatest(1, pos - size + 1), greatest(1, least(pos, n - size + 1)) + 1)) AS start FROM hit)
  GROUP BY path, name, size, start HAVING sum(sq) >= 0.3599),
ln AS (SELECT row_number() OVER () AS line, path, is_file, regexp_extract_all(segment, '[a-z0-9]+') AS terms FROM (
  SELECT path, is_file, unnest(string_split(text, chr(10))) AS segment FROM l UNION ALL SELECT path, is_file, text FROM l WHERE is_file)),
lt AS (SELECT line, name FROM (SELECT line, unnest(list_distinct(terms)) AS term FROM ln) JOIN tw USING (term)
  GROUP BY line, name HAVING sum(unit * unit) >= 0.3599),
sg AS (SELECT DISTINCT path, is_file, name, terms FROM (
  SELECT path, is_file, name, words[start:start + size - 1] AS terms FROM st JOIN wd USING (path)
  UNION ALL SELECT path, is_file, name, terms FROM lt JOIN ln USING (line))),
id AS (SELECT row_number() OVER () AS id, * FROM sg),
w AS (SELECT id, name, term, count(*) * any_value(idf) AS w FROM (SELECT id, name, unnest(terms) AS term FROM id) JOIN idf USING (term) GROUP BY id, name, term),
sim AS (SELECT path, is_file, name, similarity FROM (SELECT id, round(sum(w * coalesce(unit, 0)) / sqrt(sum(w * w)), 6) AS similarity
  FROM w LEFT JOIN tw USING (name, term) GROUP BY id) JOIN id USING (id)),
own AS (SELECT path, is_file, name AS licence, similarity FROM sim WHERE similarity >= 0.6
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, name) = 1),
dir AS (SELECT folder, licence, similarity FROM own JOIN (SELECT path, folder FROM l) USING (path) WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, licence) = 1),
inh AS (SELECT l.path, d.licence, d.similarity, d.folder FROM l JOIN dir d
  ON d.folder = '' OR l.folder = d.folder OR starts_with(l.folder, d.folder || '/')
  QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY length(d.folder) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.licence, inh.licence) AS licence, coalesce(own.similarity, inh.similarity) AS similarity,
  CASE WHEN own.licence IS NOT NULL AND own.is_file THEN 'file' WHEN own.licence IS NOT NULL THEN 'notice'
    WHEN inh.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.licence IS NULL THEN inh.folder END AS inherited_from
FROM f LEFT JOIN own USING (path) LEFT JOIN inh USING (path)
"""
