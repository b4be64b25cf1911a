"""Sentences against the items they claim, where texts are odd: against the words they were made of, and against SQL."""

import duckdb
from pyspark.sql import functions as F

from lectern.operators import jobs, verify

TEXTS = [
    ' a text that begins with a blank, as some do', 'a title that ends in what somebody "said", and then goes on', "one two three four five six seven “eight”, nine", '"all of it stands in quotation marks of its own."', ". . . . . . . . .", "eight words with a line end of another kind within",
    "text cut in a word of capitals ΟΔΟΣΟΔΟΣ ΟΔΟΣ and more", "the İstanbul of capitals and of small letters is one", "vertical\x0btab makes no words of one two three four", "no-break blanks make none two three four five six either", "next\u0085line is one, as two three four five six",
    "they say that the vertical tab parts no words", "he who says that they say that the vertical tab parts no words",
]


def test_a_records_own_words_are_sourced(spark):
    rows = spark.createDataFrame([("p", k, f"https://a.example/{k}", " ".join(t.split(" ")[:8]), t) for k, t in enumerate(TEXTS)], "person string, item_id long, url string, title string, body string").withColumn("published_at", F.lit(None).cast("date"))
    rows = rows.unionByName(rows.withColumn("person", F.lit(None).cast("string"))).unionByName(rows.where("item_id < 3"))
    said = F.array(F.concat(F.lit("**Title:** “"), "title", F.lit("”.")), F.concat(F.lit('Quote: "'), F.trim(F.substring(F.trim(F.regexp_replace("body", r"(?U)\s+", " ")), 1, 35)), F.lit('"')))
    told = rows.distinct().select("person", F.col("item_id").alias("item"), F.col("url").alias("claimed"), F.posexplode(said).alias("k", "text")).withColumn("sentence_id", F.monotonically_increasing_id())
    got = verify.verify(told, rows, spark.createDataFrame([], "person string, statement string"))
    assert sorted(map(str, got.select("item_id", "kind", "verdict").collect())) == sorted(map(str, told.selectExpr("item as item_id", "if(k = 0, 'title', 'quote') as kind", "'sourced' as verdict").collect()))
    wrong = told.where("k = 0").withColumn("text", F.lit("**Title:** “Another title”."))
    assert [r.verdict for r in verify.verify(wrong, rows, spark.createDataFrame([], "person string, statement string")).select("verdict").distinct().collect()] == ["unsourced"]


def test_odd_documents_give_the_rows_of_the_sql(spark, tmp_path):
    """Odd texts, documents without a person or a source, and one that has two labels."""
    docs = [(k, t, [None, "en"][k % 6 > 0], [None, f"src{k % 4}"][k % 5 > 0], len(t)) for k, t in enumerate(TEXTS * 3)] + [(900, None, "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0), (4, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    duck = duckdb.connect()
    for name in ("embeddings", "events", "pages", "benchmark", "conversations"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in ("documents", "labels"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for query in ("e5_verify_sources", "e5_source_faults"):
        got, want = jobs.QUERIES[query](spark, str(tmp_path)), duck.execute(jobs.ORACLES[query])
        columns = [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
