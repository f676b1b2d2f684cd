"""Scan of the corpus and relational tables with fixed schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the tables that have one shape everywhere.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer parts, as a small file does, for work that costs far more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; the fixed schema where the name has one."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def to_lines(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Ordered lines of a text: (id, pos, line). A null text has no line, an empty one a single empty line."""
    return df.select(id_col, F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("pos", "line"))


def page_text(html: str | Column) -> Column:
    """Text of a page's body without script, style, noscript and template elements."""
    c = F.col(html) if isinstance(html, str) else html
    body = F.regexp_replace(c, r"(?is)^.*?<body[^>]*>", "")
    for tag in ("script", "style", "noscript", "template"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")


def write_sections(sections: DataFrame, path: str, book: str = "book") -> None:
    """One row per section with its file name as a column, partitioned by book."""
    sections.write.partitionBy(book).mode("overwrite").parquet(path)
