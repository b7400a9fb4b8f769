"""An index that grows by micro-batches: each batch of documents is indexed once and its postings are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import Index, merged, occurrences, postings, vocabulary_words


def index_stream(docs: DataFrame, path: str, checkpoint: str, stemmed: bool = True) -> StreamingQuery:
    """Starts a query over a stream of (doc_id, text). A batch that is run again overwrites its own folder, so nothing counts twice."""

    def add(batch: DataFrame, number: int) -> None:
        own = batch.select("doc_id", "text")
        postings(occurrences(own, stemmed)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        vocabulary_words(own, stemmed).write.mode("overwrite").parquet(f"{path}/words/batch={number}")
        own.select("doc_id").write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_index(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """The index of all batches so far; document counts and frequencies are worked out when it is read."""
    of = merged(spark.read.parquet(f"{path}/postings").drop("batch"))
    words = spark.read.parquet(f"{path}/words").select("word", "term").distinct()
    return Index(of, words, spark.read.parquet(f"{path}/documents").count(), stemmed)
