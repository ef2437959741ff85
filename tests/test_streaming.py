from panelwright.streaming.refresh import replace_dates

SCHEMA = "date date, code string, close double"


def test_arriving_dates_replace_stored_ones(spark, tmp_path):
    land, store, mark = (str(tmp_path / x) for x in ("land", "store", "mark"))

    def arrive(*rows):
        spark.createDataFrame(rows, "date string, code string, close double").selectExpr("cast(date as date) date", "code", "close").write.mode("append").parquet(land)
        query = replace_dates(spark.readStream.schema(SCHEMA).parquet(land), store, mark)
        query.awaitTermination(60)
        return sorted((str(r.date), r.code, r.close) for r in spark.read.parquet(store).collect())

    arrive(("2024-01-02", "a", 1.0), ("2024-01-02", "b", 2.0), ("2024-01-03", "a", 3.0))
    assert arrive(("2024-01-03", "a", 4.0), ("2024-01-04", "a", 5.0)) == [("2024-01-02", "a", 1.0), ("2024-01-02", "b", 2.0), ("2024-01-03", "a", 4.0), ("2024-01-04", "a", 5.0)]
