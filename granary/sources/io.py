"""Readers and writers: JSON dumps of documents and chunks, metadata files, page text, PDFs, and the index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as t
from granary.operators.lexical import Index

DOCUMENT_FIELDS = (
    "document_id", "document_name", "document_type", "source_organization", "source_url", "language", "country", "publication_date", "last_updated",
    "version", "status", "scheme_id", "scheme_level", "applicable_scope", "state", "district",
)
METADATA = T.StructType([
    *(T.StructField(f, T.StringType()) for f in DOCUMENT_FIELDS), T.StructField("page_number", T.IntegerType()), T.StructField("section", T.StringType()),
    T.StructField("subsection", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
    T.StructField("chunk_type", T.StringType()), T.StructField("extraction_method", T.StringType()), T.StructField("image_count", T.IntegerType()),
])
DOCUMENT = T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", METADATA)])
DUMP = T.StructType([T.StructField("parents", T.ArrayType(DOCUMENT)), T.StructField("children", T.ArrayType(DOCUMENT))])
PAGE_RULE, TEXT_RULE = "=" * 80, "#" * 100
PAGES = "path string, page_number int, text string, extraction_method string, image_count int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def required(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def flat(df: DataFrame) -> DataFrame:
    """page_content and the metadata as columns; missing content is empty."""
    return df.select(t.text(F.col("page_content")).alias("page_content"), "metadata.*")


def nested(df: DataFrame) -> DataFrame:
    fields = [f for f in METADATA.names if f in df.columns]
    return df.select("page_content", F.struct(*fields).alias("metadata"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of {page_content, metadata}, as columns: from files of one JSON array each, or of a JSON object a line as write_documents() makes them."""
    start = spark.read.text(required(spark, path)).where("trim(value) <> ''").head()
    return flat(spark.read.schema(DOCUMENT).json(path, multiLine=start is not None and start.value.lstrip().startswith("[")))


def read_chunk_dumps(spark: SparkSession, path: str, part: str = "children") -> DataFrame:
    """Children (or parents) of dumps {parents, children}; path may be a pattern. Missing lists are empty."""
    rows = spark.read.schema(DUMP).json(required(spark, path), multiLine=True)
    return flat(rows.select(F.explode(F.coalesce(part, F.array().cast(T.ArrayType(DOCUMENT)))).alias("d")).select("d.*"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a metadata file, with the stem that it shares with its document. countrywide scope is the default."""
    rows = spark.read.schema(T.StructType(METADATA.fields[: len(DOCUMENT_FIELDS)])).json(required(spark, path), multiLine=True)
    stem = F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]*?)(?:_metadata)?\.json$", 1)
    return rows.withColumn("applicable_scope", F.coalesce("applicable_scope", F.lit("India"))).withColumn("stem", stem)


def with_metadata(files: DataFrame, metadata: DataFrame, stem: str = "stem") -> tuple[DataFrame, DataFrame]:
    """(files with their metadata, stems of files without)."""
    return files.join(metadata, stem), files.join(metadata, stem, "left_anti").select(stem)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, extraction_method, text) of debug texts with a PAGE n banner before each page."""
    rows = spark.read.text(required(spark, path), wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = rows.select("path", F.explode(F.slice(F.split("value", r"(?m)^[=#]{20,}\s*\n\s*PAGE "), 2, 1_000_000)).alias("p"))
    body = F.regexp_replace("p", r"^\d+[^\n]*\n(?:[=#]{20,}\s*\n)?(?:Extraction[^\n]*\n)?(?:Image[^\n]*\n)?(?:[=#]{20,}\s*\n)?", "")
    return parts.select("path", F.regexp_extract("p", r"^(\d+)", 1).cast("int").alias("page_number"), F.nullif(F.regexp_extract("p", r"Extraction(?: Method)?: (\S+)", 1), F.lit("")).alias("extraction_method"), t.strip(body).alias("text"))


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files, in the order of their paths; recursive: those of folders within, too."""
    required(spark, f"{folder}/*/{pattern}" if recursive else f"{folder}/{pattern}")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).orderBy("path")


def parsed(files: DataFrame, parse: Callable[[bytes], list[tuple[int, str, str, int]]]) -> DataFrame:
    """Pages of files. parse is passed in: bytes to (page number, text, method, images). A file that fails gives one page without text and the method failed."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, *page) for page in parse(bytes(content))]
                except Exception:  # noqa: BLE001 - whatever a parser raises is about this file
                    rows.append((path, None, None, "failed", 0))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "extraction_method", "image_count"]).astype({"page_number": "Int32", "image_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def rendered(files: DataFrame, render: Callable[[bytes, int], list[bytes]], dpi: int = 250) -> DataFrame:
    """(path, page_number, image) of every page. render is passed in: bytes and resolution to the images of the pages; a file that fails gives one row without page and image."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, n, image) for n, image in enumerate(render(bytes(content), dpi), 1)]
                except Exception:  # noqa: BLE001 - whatever a renderer raises is about this file
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "page_number", "image"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, image binary")


def metadata_json(*fields: str) -> F.Column:
    """Metadata as JSON; null fields are left out."""
    return F.to_json(F.struct(*fields))


def nested_tables(activities: DataFrame, costs: DataFrame) -> DataFrame:
    """(document, page_number, value): the tables of each page as one nested JSON, null fields kept. A page's rows are one group, as they are one value."""
    keys = ["document", "page_number"]
    listed = lambda order, *names: F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*names).alias("row")))), lambda s: s["row"])
    a = activities.groupBy(*keys).agg(listed(["table_no", "activity_number", "activity_id"], "marker", "text", "confidence", "warnings").alias("activities"))
    c = costs.groupBy(*keys).agg(listed(["table_no", "item_number", "extracted_at"], "item_number", "description", "cost", "confidence", "raw_description", "raw_cost", "warnings").alias("rows"))
    value = F.struct("document", "page_number", "activities", F.struct("rows").alias("cost_table"))
    return a.join(c, keys, "full").select(*keys, F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


def write_nested(df: DataFrame, path: str) -> str:
    """The JSON values of nested_tables(), one file a document."""
    df.select("document", "value").write.mode("overwrite").partitionBy("document").text(path)
    return path


# Sinks


def write_documents(df: DataFrame, path: str) -> str:
    """{page_content, metadata} as lines of JSON, null fields kept."""
    if df.isEmpty():
        raise ValueError("no documents")
    nested(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_dumps(parents: DataFrame, children: DataFrame, path: str, document: str = "document_id") -> str:
    """{parents, children} of each document, in a folder a document. A document's chunks are one group, as its dump is one file."""
    parts = [nested(d).withColumn("k", F.col(f"metadata.{document}")).groupBy("k").agg(F.collect_list(F.struct("page_content", "metadata")).alias(n)) for d, n in ((parents, "parents"), (children, "children"))]
    empty = F.array()
    rows = parts[0].join(parts[1], "k", "full").select(F.col("k").alias(document), *(F.coalesce(n, empty.cast(d.schema[n].dataType)).alias(n) for n, d in zip(("parents", "children"), parts)))
    rows.write.mode("overwrite").partitionBy(document).json(path)
    return path


def page_texts(pages: DataFrame, document: str = "document_id", rule: str = PAGE_RULE) -> DataFrame:
    """(document, value): all pages of a document, each under its banner."""
    banner = F.concat(F.lit(f"{rule}\nPAGE "), F.col("page_number").cast("string"), F.lit("\nExtraction: "), t.text(F.col("extraction_method")), F.lit(f"\n{rule}\n\n"), t.text(F.col("text")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("page_number", banner.alias("b")))), lambda s: s["b"])
    return pages.groupBy(document).agg(F.array_join(joined, "\n\n").alias("value"))


def full_text(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, text): the pages that aren't blank, in order."""
    kept = pages.where(t.strip(t.text(F.col("text"))) != "")
    return kept.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def write_texts(pages: DataFrame, path: str, document: str = "document_id") -> str:
    page_texts(pages, document).write.mode("overwrite").partitionBy(document).text(path)
    return path


def write_vectors(df: DataFrame, embed: Callable, path: str, text: str = "page_content") -> str:
    """df with the vectors of its texts; embed is passed in: a column to a column of vectors."""
    if df.isEmpty():
        raise ValueError("no documents")
    df.withColumn("embedding", embed(F.col(text))).write.mode("overwrite").parquet(path)
    return path


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(required(spark, path))


def write_index(index: Index, path: str, buckets: int = 64) -> str:
    """The tables of a lexical index; postings lie sorted by term in term buckets, so that a search reads few row groups."""
    index.postings.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    return path


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(required(spark, f"{path}/{n}")) for n in ("postings", "lengths", "terms")))


def last_parents(df: DataFrame, order: str, parent: str = "parent_id") -> DataFrame:
    """One row a parent id: the last one counts."""
    best = Window.partitionBy(parent).orderBy(F.col(order).desc())
    return df.withColumn("__at", F.row_number().over(best)).where("__at = 1").drop("__at")
