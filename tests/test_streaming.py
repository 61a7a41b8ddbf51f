from pyspark.sql import functions as F

from tidemill.operators.sequences import MarkovChain
from tidemill.streaming import windows as W


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("a", s, f"2024-01-01 00:00:{i:02d}", float(i)) for i, s in enumerate("xxyzx")]
    df = spark.createDataFrame(rows, "q string, s string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(W.windowed(read(), "t", ["v"], "2 seconds", by=["q"], operation="sum"), spark, "tumbling", "complete")
    assert sorted(r.sum_v for r in got) == [1.0, 4.0, 5.0]
    assert [r.n for r in run(W.sessions(read(), "t", "10 seconds", ["q"]), spark, "visits", "complete")] == [5]
    chain = MarkovChain.fit(df, "s", "q", ["t"])
    got = run(W.chained_stream(read(), chain, "s", "q", "t"), spark, "carried")
    assert [r.chained_p for r in got] == chain.chained(list("xxyzx"))[0]
