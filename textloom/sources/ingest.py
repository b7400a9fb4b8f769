"""Reading and writing documents: JSON folders, scripts, arrays in one JSON file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "title string, url string, genre string, body string"
MOST_SCRIPTS = 650
# What is taken out of scripts, in this order.
REMOVED = [
    "Back to IMSDb",
    "<b><!--\n\n</b>if (window!= top)\n\ntop.location.href=location.href\n\n<b>// -->\n\n</b>",
    "          Scanned by http://freemoviescripts.com\n          Formatting by http://simplyscripts.home.att.net\n",
    "<b><!--",
    "</b>",
    "<b>/*",
    "(c) 1990 The Walt Disney Company",
    "------------------------------------------------------------",
    "<script>",
    "for educational use only",
    "=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-",
    "\\r",
]


def numbered(files: DataFrame) -> DataFrame:
    """With doc_id, the place of each file's path in the order of names, from 0: a sort by range, counts of its parts, and their sums.

    Only one number a part goes through one task.
    """
    parts = files.repartitionByRange("file").sortWithinPartitions("file").withColumn("part", F.spark_partition_id())
    # the number of a row within its part follows its order there
    parts = parts.withColumn("nth", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").withColumn("doc_id", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, title, url, genre, body, text (the body) of a folder of one-document JSON files; absent fields are null."""
    rows = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).json(folder, multiLine=True)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), "title", "url", "genre", "body")
    return numbered(rows).select("doc_id", "file", "title", "url", "genre", "body", F.col("body").alias("text"))


def split_array(spark: SparkSession, path: str, key: str, item: str) -> DataFrame:
    """(file_num, ...) from 1: the members of the array `key` of one JSON file, each of the struct type `item`."""
    rows = spark.read.schema(f"`{key}` array<{item}>").json(path, multiLine=True)
    return rows.select(F.posexplode(key).alias("at", "item")).select((F.col("at") + 1).alias("file_num"), "item.*")


def clean_script(text: Column) -> Column:
    """A script without the boilerplate of REMOVED and without white space at its ends."""
    for part in REMOVED:
        text = F.replace(text, F.lit(part), F.lit(""))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_scripts(spark: SparkSession, folder: str, most: int = MOST_SCRIPTS) -> DataFrame:
    """file, title (the first line), genre (the parent folder), body of at most `most` text files, by path."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), clean_script(F.col("value")).alias("body"))
    rows = rows.orderBy("path").limit(most)
    # the path is written as a URI
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    return rows.select(F.split(F.element_at(parts, -1), r"\.")[0].alias("file"), F.split("body", "\n")[0].alias("title"), F.element_at(parts, -2).alias("genre"), "body")


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
