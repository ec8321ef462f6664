from glasswatch.sources import sinks


def test_component_csv_round_trip(spark, tmp_path):
    rows = [("model", 'a "quoted", name', "x (local)"), ("agent", "two\nlines", ""), ("agent", "back\\slash", "")]
    sinks.write_component_csv(spark.createDataFrame(rows, "type string, name string, detail string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in sinks.read_component_csv(spark, str(tmp_path / "c")).collect()) == sorted(rows)
    none = spark.createDataFrame([], "type string, name string, detail string")
    sinks.write_component_csv(none, str(tmp_path / "n"))
    assert sinks.read_component_csv(spark, str(tmp_path / "n")).count() == 0
