import json

from textloom.functions.text import kgrams
from textloom.operators import search
from textloom.operators.index import Index
from textloom.sources import ingest
from textloom.streaming.incremental import index_stream, read_stream_index
from pyspark.sql import functions as F


def test_numbers_follow_file_names(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"{n}.json").write_text(json.dumps({"title": str(n), "body": f"text {n}"}))
    rows = ingest.read_json(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["file"], r["url"]) for r in rows] == [(0, "1.json", None), (1, "10.json", None), (2, "2.json", None)]


def test_arrays_and_scripts(spark, tmp_path):
    (tmp_path / "all.json").write_text(json.dumps({"data": [{"body": "x"}, {"body": "y"}]}))
    assert [tuple(r) for r in ingest.split_array(spark, str(tmp_path / "all.json"), "data", "struct<body:string>").orderBy("file_num").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "scripts/dark drama").mkdir(parents=True)
    (tmp_path / "scripts/dark drama/one.v2.txt").write_text("  Back to IMSDb<script>\nTitle\\r line\nrest </b> \n")
    got = ingest.read_scripts(spark, str(tmp_path / "scripts")).collect()
    assert [tuple(r) for r in got] == [("one", "Title line", "dark drama", "Title line\nrest")]
    assert ingest.read_scripts(spark, str(tmp_path / "scripts"), most=0).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.5)], "blocksize double, time double")
    ingest.write_csv(df, str(tmp_path / "csv"))
    assert ingest.read_csv(spark, str(tmp_path / "csv"), "blocksize double, time double").collect() == df.collect()


def test_grams(spark):
    words = spark.createDataFrame([("word",), ("",), ("a",)], "word string")
    got = {r[0]: set(r[1]) for r in words.select("word", kgrams(F.col("word"))).collect()}
    assert got["word"] == {"$", "w", "o", "r", "d", "$w", "wo", "or", "rd", "d$", "$wo", "wor", "ord", "rd$"}
    assert got[""] == {"$", "$$"} and got["a"] == {"$", "a", "$a", "a$", "$a$"}


def test_a_stream_of_batches_is_one_index(spark, tmp_path):
    source = tmp_path / "in"
    for n, rows in enumerate([[(0, "one two"), (1, "two three")], [(2, "two two")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        index_stream(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    index = read_stream_index(spark, str(tmp_path / "index"))
    assert index.size == 3
    assert [r[0] for r in search.boolean(index, "two").collect()] == [0, 1, 2]
    whole = Index.build(spark.read.parquet(str(source)))
    assert sorted(map(tuple, search.ranked(index, "two").collect())) == sorted(map(tuple, search.ranked(whole, "two").collect()))
