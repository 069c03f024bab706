"""What Spark takes for small by a guess does not go through the driver."""

from pyspark.sql import functions as F

from metaloom.llm import base, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_sent_by_the_size_of_the_fingerprints(spark):
    fps = spark.range(50).select(F.col("id").alias("doc"), (F.col("id") * 3).alias("fp"))
    assert "BroadcastExchange" not in plan(simhash.links(fps))


def test_saved_tables_send_by_a_guess_only_what_is_very_small(spark, monkeypatch):
    plans, writer = [], type(spark.range(1).write)
    write = writer.parquet
    before = spark.conf.get(base._GUESSED), spark.conf.get(base._MEASURED, None)
    # Guessed at 0.8 MB, and six times as many rows by the explode.
    side = spark.range(60_000).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("id", "x")
    both = side.join(spark.range(1_000_000), "id")

    def watched(self, *args, **kwargs):
        plans.append((spark.conf.get(base._MEASURED), plan(both)))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", watched)
    assert base.saved(both, "joined").count() == 360_000
    assert plans[0][0] == "10485760" and "BroadcastExchange" not in plans[0][1]
    assert (spark.conf.get(base._GUESSED), spark.conf.get(base._MEASURED, None)) == before


def test_thresholds_that_are_off_stay_off(spark):
    with base._set(spark, {base._GUESSED: "-1"}):
        assert base._thresholds(spark) == {base._GUESSED: "-1", base._MEASURED: "-1"}
    with base._set(spark, {base._MEASURED: "1k"}):
        assert base._thresholds(spark)[base._MEASURED] == "1k"
