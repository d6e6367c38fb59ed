"""Page classifier: training, scoring and evaluation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blogindex.operators import features as fe
from blogindex.plans.rows import unnest
from blogindex.session import exists

def training_set(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("label", F.lit(1.0)).unionByName(
        negative.withColumn("label", F.lit(0.0)))


def split_bucket(key: Column, seed: int = 42) -> Column:
    """0..99 from the key, the same in any order and on any cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42
          ) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash of the key."""
    bucket, limit = split_bucket(F.col(key), seed), round(test_share * 100)
    return df.filter(bucket >= limit), df.filter(bucket < limit)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    even = counts.agg(F.sum("_n") / F.count("*")).scalar()
    return counts.select(label, (even / F.col("_n")).alias("weight"))


def train(docs: DataFrame, key: str, C: float = 1.0, balanced: bool = True,
          stop_words: list[str] | None = None, fit_on: str = "all",
          vocabulary_size: int = 10_000) -> PipelineModel:
    """Fit TF-IDF and logistic regression on (key, tokens, label).

    Vocabulary and IDF come from all rows, or with fit_on='train' only from the training
    split; the model is fitted on the training split. The vocabulary is the only thing
    that reaches the driver, and its size is bounded.
    """
    stop_words = fe.default_stop_words() if stop_words is None else stop_words
    docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(docs, key, C, balanced, stop_words, fit_on, vocabulary_size)
    finally:
        docs.unpersist()


def _fit(docs: DataFrame, key: str, C: float, balanced: bool, stop_words: list[str], fit_on: str,
         vocabulary_size: int) -> PipelineModel:
    fitted = split(docs, key)[0]
    source = docs if fit_on == "all" else fitted
    n_docs = fe.document_count(source)
    vocabulary = fe.mine_vocabulary(source, key, n_docs, stop_words=stop_words, size=vocabulary_size)
    rows = fe.idf(vocabulary, n_docs).orderBy("term").collect()
    if not rows:
        raise ValueError("no term is frequent enough to train on")
    stages = fe.vector_stages([r["term"] for r in rows], [r["idf"] for r in rows])
    data = fe.with_ngrams(fitted, stop_words)
    if balanced:
        data = data.join(F.broadcast(class_weights(fitted)), "label")
    else:
        data = data.withColumn("weight", F.lit(1.0))
    size = data.agg(F.sum("weight").alias("weight")).first()
    prepared = PipelineModel(stages=stages)
    # Every iteration is a job over these rows: keep the finished vectors.
    vectors = prepared.transform(data).select("label", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        regression = LogisticRegression(
            weightCol="weight", elasticNetParam=0.0, regParam=1.0 / (C * size["weight"]),
            standardization=False, maxIter=2000, tol=1e-6).fit(vectors)
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*stages, regression])


def score(docs: DataFrame, model: PipelineModel, stop_words: list[str] | None = None) -> DataFrame:
    """The input with p_not and p_dev, the two class probabilities."""
    stop_words = fe.default_stop_words() if stop_words is None else stop_words
    scored = model.transform(fe.with_ngrams(docs, stop_words))
    p = vector_to_array("probability")
    return scored.select(*docs.columns, p[0].alias("p_not"), p[1].alias("p_dev"))


def score_linear(vectors: DataFrame, coefficients: list[float], intercept: float, key: str) -> DataFrame:
    """(key, p_not, p_dev) of vectors (key, indices, values); one coefficient per term, in the row.

    Documents with no term are left out, by unnesting a list of none or one: a filter would
    be pushed below the vectors and make them twice.
    """
    # One constant: an array of thousands of them is slow to plan.
    weights = F.split(F.lit(",".join(repr(float(c)) for c in coefficients)), ",").try_cast("array<double>")
    products = F.zip_with("indices", "values", lambda i, v: v * F.get(weights, i))
    margin = F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + F.lit(intercept)
    found = F.when(F.size("indices") > 0, F.array(F.struct(margin.alias("_margin"))))
    p_dev = 1.0 / (1.0 + F.exp(-F.col("_margin")))
    return unnest(vectors.select(key, found.alias("_found")), "_found", key) \
        .select(key, (1.0 - p_dev).alias("p_not"), p_dev.alias("p_dev"))


def predict(p_dev: Column) -> Column:
    return F.when(p_dev > 0.5, 1).otherwise(0)


def classification_report(df: DataFrame, label: str = "label", predicted: str = "prediction"
                          ) -> DataFrame:
    """(name, precision, recall, f1, support): each class, accuracy, macro and weighted means.

    One pass counts the confusion matrix; all else works on its few rows.
    """
    cells = df.groupBy(F.col(label).cast("int").alias("a"), F.col(predicted).cast("int").alias("p")) \
        .agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("a").alias("c"), F.lit(1).alias("actual"), (F.col("a") == F.col("p")).alias("hit"), "n"),
        F.struct(F.col("p").alias("c"), F.lit(0).alias("actual"), (F.col("a") == F.col("p")).alias("hit"), "n"),
    )).alias("s")).select("s.*")
    counts = sides.groupBy("c").agg(
        F.sum(F.when(F.col("actual") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("actual") == 0, F.col("n")).otherwise(0)).alias("claimed"),
        F.sum(F.when(F.col("hit") & (F.col("actual") == 1), F.col("n")).otherwise(0)).alias("hits"))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    scored = counts.select("c", "support", "hits", share("hits", "claimed").alias("precision"),
                           share("hits", "support").alias("recall"))
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    classes = scored.select(F.col("c").cast("string").alias("name"), "precision", "recall", "f1", "support")
    accuracy = scored.agg(F.sum("hits").alias("_h"), F.sum("support").alias("support")) \
        .withColumn("f1", share("_h", "support")) \
        .select(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"), "f1", "support")
    metrics = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support")) \
        .select(F.lit("macro avg").alias("name"), *metrics, "support")
    weighted = scored.agg(
        *[F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(m)
          for m in metrics], F.sum("support").alias("support")) \
        .select(F.lit("weighted avg").alias("name"), *metrics, "support")
    return classes.union(accuracy).union(macro).union(weighted)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A missing model is an error."""
    return PipelineModel.load(path)


def load_or_train(path: str, docs, key: str, **options) -> PipelineModel:
    """The saved model, or where the path is absent a newly trained and saved one.

    docs is a callable giving the rows. A model that is there but cannot be read is an error.
    """
    if exists(SparkSession.active(), path):
        return load_model(path)
    model = train(docs(), key, **options)
    save_model(model, path)
    return model
