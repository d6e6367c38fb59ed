"""Token features for the page classifier."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blogindex.functions import text as tx
from blogindex.plans.rows import runs, unnest
from blogindex.session import new_work_dir


def default_stop_words() -> list[str]:
    """Spark's English list; any other list may be passed instead."""
    return StopWordsRemover.loadDefaultStopWords("english")


def page_tokens(df: DataFrame, key: str, fields: list[str], text_col: str | None = None
                ) -> DataFrame:
    """(key, tokens): classifier tokens of the page text; pages without any are dropped."""
    source = F.col(text_col) if text_col else tx.page_text(fields)
    # A match test stops at the first token; a filter on the list would be pushed below
    # the projection and make the whole list twice.
    return df.filter(tx.has_tokens(source)).select(key, tx.tokens(source).alias("tokens"))


def token_occurrences(docs: DataFrame, key: str) -> DataFrame:
    """(key, pos, token); the outer form, as the inner one would make the token list twice."""
    return docs.select(key, F.posexplode_outer("tokens").alias("pos", "token")).filter("pos IS NOT NULL")


def filter_dictionary(docs: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, pos, token): tokens of which some proper prefix of four or more letters is a word.

    Only the distinct tokens are tested, so a frequent token is tested once. The result
    of the test goes back to the occurrences by an equi-join that Spark may broadcast or
    split where a token is hot.
    """
    occurrences = token_occurrences(docs, key)
    vocabulary = occurrences.select("token").filter("token RLIKE '^[a-z]{5,}$'").distinct()
    kept = (vocabulary
            .select("token", F.explode(F.expr(
                "transform(sequence(4, length(token) - 1), n -> left(token, n))")).alias("word"))
            .join(words.select("word").distinct(), "word", "left_semi")
            .select("token").distinct())
    return occurrences.join(kept, "token", "left_semi").select(key, "pos", "token")


def lemmatize(occurrences: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Token replaced by its lemma where the table (token, lemma) has one."""
    rest = [c for c in occurrences.columns if c != "token"]
    one = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    return (occurrences.join(one, "token", "left")
            .select(*rest, F.coalesce("lemma", "token").alias("token")))


def term_counts(docs: DataFrame, key: str, low: int = 1, high: int = 3,
                stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, tf) over the n-grams of the tokens left after the stop words.

    Terms of a document are counted inside its row, so no term is shuffled.
    """
    kept = docs.select(key, tx.remove_stop_words(F.col("tokens"), stop_words or []).alias("tokens"))
    terms = kept.select(key, F.transform(tx.ngrams(F.col("tokens"), low, high),
                                         lambda t: F.struct(t.alias("term"))).alias("_terms"))
    return runs(terms, "_terms", "term", F.size, "tf").select(
        key, "term", F.col("tf").cast("bigint").alias("tf"))


def select_vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.9,
                      size: int = 10_000) -> DataFrame:
    """(term, df, total): terms in enough and not too many documents, the most frequent first.

    n_docs is a one-row frame (n). Ties go to the term that sorts first.
    """
    totals = counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total"))
    n = n_docs.select("n").scalar()
    return (totals.filter((F.col("df") >= min_df) & (F.col("df") <= n * max_df))
            .orderBy(F.desc("total"), "term").limit(size)
            .select("term", "df", "total"))


# Grams of one length that go into the plan to prune the next; more are not used.
_LISTED = 20_000


def _pruned_ngrams(tokens: Column, n: int, frequent: list[str] | None) -> Column:
    """The n-grams whose two parts of n - 1 tokens are frequent; all of them without a list."""
    if n == 1 or frequent is None:
        return tx.ngrams(tokens, n, n)

    def bound(b: Column) -> Column:
        # Only the n-grams that stay are put together.
        starts = F.filter(F.transform(b["ok"], lambda ok, i: F.when(ok & F.get(b["ok"], i + 1), i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(b["tokens"], i + k) for k in range(n)]))

    ok = F.transform(tx.ngrams(tokens, n - 1, n - 1), lambda g: g.isin(frequent) if frequent else F.lit(False))
    return F.transform(F.array(F.struct(tokens.alias("tokens"), ok.alias("ok"))), bound)[0]


def _counted(docs: DataFrame, key: str, grams: Column) -> DataFrame:
    """(term, df, total) of a list of terms per document: its distinct terms count for df, all of them for total.

    Both go as plain rows into one hash aggregate with map-side reduction; nothing is sorted in the row.
    """
    lists = docs.select(grams.alias("_terms")).select(F.inline_outer(F.array(
        F.struct(F.lit(0).alias("_d"), F.col("_terms").alias("_t")), F.struct(F.lit(1).alias("_d"), F.array_distinct("_terms").alias("_t")))))
    return lists.select("_d", F.explode_outer("_t").alias("term")).filter("term IS NOT NULL").groupBy("term").agg(
        F.sum("_d").cast("bigint").alias("df"), F.sum(1 - F.col("_d")).cast("bigint").alias("total"))


def mine_vocabulary(docs: DataFrame, key: str, n_docs: DataFrame, low: int = 1, high: int = 3,
                    stop_words: list[str] | None = None, min_df: int = 2, max_df: float = 0.9,
                    size: int = 10_000) -> DataFrame:
    """(term, df, total): what select_vocabulary makes of all n-grams, counting far fewer of them.

    Words first, then pairs, then triples. A term occurs at most as often as any of its parts
    and in no more documents, so only terms whose parts are in enough documents and occur as
    often as the last term of the vocabulary so far are counted at all; nothing else could
    get into it. docs is read once per length and should be a stored table.
    """
    n = n_docs.select("n").first()["n"]
    kept = docs.select(key, tx.remove_stop_words(F.col("tokens"), stop_words or []).alias("tokens"))
    best: DataFrame | None = None
    frequent: list[str] | None = None
    least = 0
    for length in range(1, high + 1):
        counted = _counted(kept, key, _pruned_ngrams(F.col("tokens"), length, frequent)) \
            .filter((F.col("df") >= min_df) & (F.col("total") >= least))
        path = new_work_dir(docs.sparkSession, f"grams-{length}")
        counted.write.parquet(path)
        level = docs.sparkSession.read.schema(counted.schema).parquet(path)
        if length >= low:
            fits = level.filter(F.col("df") <= n * max_df)
            best = fits if best is None else best.unionByName(fits)
            edge = best.orderBy(F.desc("total"), "term").limit(size).agg(
                F.count("*").alias("n"), F.min("total").alias("total")).first()
            least = edge["total"] if edge["n"] == size else 0
        if length < high:
            rows = level.filter(F.col("total") >= least).select("term").limit(_LISTED + 1).collect()
            frequent = [r["term"] for r in rows] if len(rows) <= _LISTED else None
    return best.orderBy(F.desc("total"), "term").limit(size).select("term", "df", "total")


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def idf(vocabulary: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, idf): ln((1+n)/(1+df)) + 1."""
    n = n_docs.select("n").scalar()
    return vocabulary.select("term", (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def vector_stages(terms: list[str], idfs: list[float]) -> list[Transformer]:
    """Term lists (terms) to unit TF-IDF vectors (features), all inside the row."""
    return [CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf"),
            ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense(idfs)),
            Normalizer(inputCol="tfidf", outputCol="features", p=2.0)]


def with_ngrams(docs: DataFrame, stop_words: list[str], low: int = 1, high: int = 3) -> DataFrame:
    """The input with terms, the n-grams of the tokens left after the stop words."""
    kept = tx.remove_stop_words(F.col("tokens"), stop_words)
    return docs.withColumn("terms", tx.ngrams(kept, low, high))


def vectorize(docs: DataFrame, key: str, vocabulary: DataFrame, n_docs: DataFrame, low: int = 1, high: int = 3,
              stop_words: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """((key, indices, values), terms): unit TF-IDF weights of each document by place in the term list.

    The vocabulary, bounded by its size limit, comes to the driver and goes into the plan;
    counting, weighing and the norm happen in the document's row, so nothing is shuffled.
    A document without a term of the vocabulary has empty lists.
    """
    rows = idf(vocabulary, n_docs).orderBy("term").collect()
    terms = [r["term"] for r in rows]
    if not terms:
        empty = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<double>)")
        return docs.select(key, empty[0].alias("indices"), empty[1].alias("values")).limit(0), terms
    made = with_ngrams(docs, stop_words or [], low, high).select(key, "terms")
    for stage in vector_stages(terms, [r["idf"] for r in rows]):
        made = stage.transform(made)
    vector = F.unwrap_udt("features")
    return made.select(key, vector["indices"].alias("indices"), vector["values"].alias("values")), terms


def tfidf(vectors: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, term, weight): the long form of the vectors."""
    named = F.split(F.lit("\n".join(terms)), "\n")  # one constant; an array of thousands of them is slow to plan
    entries = F.zip_with("indices", "values", lambda i, v: F.struct(F.get(named, i).alias("term"), v.alias("weight")))
    return unnest(vectors.select(key, entries.alias("_entries")), "_entries", key)
