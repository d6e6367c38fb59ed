"""JSON records: frontier items, page records, the labelled corpus, page streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.functions import text as tx

_EMPTY_LIST = "cast(array() as array<string>)"


def parse_frontier(df: DataFrame, col: str = "value") -> DataFrame:
    """Add location and retries from JSON text; malformed items are dropped."""
    item = F.from_json(F.col(col), schemas.FRONTIER + ", _bad STRING",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (df.withColumn("_item", item)
            .filter("_item IS NOT NULL AND _item._bad IS NULL")
            .select(*[c for c in df.columns if c != col],
                    F.coalesce("_item.location", F.lit("")).alias("location"),
                    F.coalesce("_item.retries", F.lit(0)).alias("retries")))


def split_pages(df: DataFrame, col: str = "value", missing_text: str | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects): page columns of well-formed JSON, raw text of the rest.

    missing_text stands in for an absent text field: '' for the router, null for the indexer.
    """
    record = F.from_json(F.col(col), schemas.PAGE + ", _bad STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = df.withColumn("_page", record)
    rest = [c for c in df.columns if c != col]
    bad = F.col("_page").isNull() | F.col("_page._bad").isNotNull()
    fields = {c: F.col(f"_page.{c}") for c in schemas.PAGE_COLUMNS}
    for c in schemas.LIST_COLUMNS:
        fields[c] = F.coalesce(fields[c], F.expr(_EMPTY_LIST))
    if missing_text is not None:
        for c in [*schemas.TEXT_COLUMNS, "location"]:
            fields[c] = F.coalesce(fields[c], F.lit(missing_text))
    pages = parsed.filter(~bad).select(*rest, *[v.alias(k) for k, v in fields.items()])
    return pages, parsed.filter(bad).select(*df.columns)


def parse_pages(df: DataFrame, col: str = "value", missing_text: str | None = None) -> DataFrame:
    return split_pages(df, col, missing_text)[0]


def parse_typed_pages(df: DataFrame, col: str = "value") -> DataFrame:
    """Page columns plus type_error, true where a field has the wrong JSON type.

    A null or empty list field becomes an empty list; content given as one string
    becomes a list of that string. Text that is no JSON object is dropped.
    """
    raw = F.try_parse_json(F.col(col))

    def get(name: str, kind: str) -> Column:
        return F.try_variant_get("_raw", f"$.{name}", kind)

    def kind_of(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(get(name, "variant")), F.lit("VOID"))

    def falsy(name: str) -> Column:
        text = F.lower(F.coalesce(get(name, "string"), F.lit("")))
        scalar = ~kind_of(name).rlike("^(ARRAY|OBJECT)<")
        number = get(name, "double") == 0
        return (kind_of(name) == "VOID") | (kind_of(name) == "OBJECT<>") | (
            scalar & ((text == "") | (text == "false")) & (
                kind_of(name).isin("BOOLEAN") | (text == ""))) | (
            scalar & (kind_of(name) != "STRING") & F.coalesce(number, F.lit(False)))

    fields: dict[str, Column] = {}
    errors: list[Column] = []
    for name in [*schemas.TEXT_COLUMNS, "location"]:
        fields[name] = get(name, "string")
        allowed = ["STRING"] if name == "location" else ["STRING", "VOID"]
        errors.append(~kind_of(name).isin(allowed))
    for name in schemas.LIST_COLUMNS:
        value = get(name, "array<string>")
        kind = kind_of(name)
        good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
        ok = falsy(name) | (good & ~F.coalesce(F.exists(value, lambda x: x.isNull()), F.lit(False)))
        empty = F.expr(_EMPTY_LIST)
        listed = F.when(falsy(name), empty).otherwise(F.coalesce(value, empty))
        if name == "content":
            single = (kind == "STRING")
            listed = F.when(single, F.array(get(name, "string"))).otherwise(listed)
            ok = ok | single
        fields[name] = listed
        errors.append(~ok)
    number = get("created_at", "bigint")
    fields["created_at"] = number
    errors.append((kind_of("created_at") != "VOID") & (
        number.isNull() | (get("created_at", "double") != number.cast("double"))))
    wrong = errors[0]
    for e in errors[1:]:
        wrong = wrong | e
    return (df.withColumn("_raw", raw)
            .filter(F.schema_of_variant("_raw").startswith("OBJECT<"))
            .select(*[c for c in df.columns if c != col],
                    *[fields[c].alias(c) for c in schemas.PAGE_COLUMNS],
                    wrong.alias("type_error")))


def gate_documents(df: DataFrame) -> DataFrame:
    """Documents of a text type; any but HTML loses its body and gives an empty page."""
    return (df.filter(F.col("content_type").startswith("text/"))
            .withColumn("html", F.when(F.col("content_type").startswith("text/html"), F.col("html"))
                        .otherwise(F.lit(""))))


def read_corpus(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """Labelled page files: <root>/<domain>/*.json, one record each, label 1.0 or 0.0 by root.

    Pages without any text to train on are left out.
    """
    def labelled(root: str, label: float) -> DataFrame:
        # The folders are listed, not each file looked up; a file must lie right in one of them.
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        depth = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth() + 2
        inside = F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        return (spark.read.schema(schemas.PAGE).option("multiLine", True).option("pathGlobFilter", "*.json")
                .json(f"{root}/*")
                .filter(F.length(inside) - F.length(F.replace(inside, F.lit("/"), F.lit(""))) == depth)
                .filter(tx.strip(tx.page_text(schemas.TRAIN_FIELDS)) != "")
                .withColumn("label", F.lit(label)))

    return labelled(positive, 1.0).unionByName(labelled(negative, 0.0))


def stream_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of page JSON files; the checkpoint takes the place of the queue pop."""
    return (spark.readStream.schema(schemas.PAGE + ", seq BIGINT")
            .option("maxFilesPerTrigger", max_files).json(path))


def stream_frontier(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return (spark.readStream.schema(schemas.FRONTIER + ", seq BIGINT")
            .option("maxFilesPerTrigger", max_files).json(path))
