import gzip
import json

import pytest

from tessera.sources import readers, sinks


def test_area_attributes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FIPS,COUNTY,RPL\n01001,Hamilton ,0.5\n01002,hamilton,-999\n02001,Other,0.1\n")
    got = {r["FIPS"]: r["RPL"] for r in readers.area_attributes(spark, str(tmp_path / "a.csv"), "FIPS string, COUNTY string, RPL double", "HAMILTON").collect()}
    assert got == {"01001": 0.5, "01002": None}
    with pytest.raises(ValueError):
        readers.area_attributes(spark, str(tmp_path / "a.csv"), "FIPS string, COUNTY string, RPL double", "none")


def test_optional_columns(spark):
    out = readers.with_optional(spark.createDataFrame([(1,)], "a int"), {"A": "int", "b": "double"})
    assert out.columns == ["a", "b"] and out.first()["b"] is None


def test_external_target(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("address_id,target_value\n1,0.25\n1,0.75\n9,1.0\n")
    points = spark.createDataFrame([(1,), (2,)], "address_id long")
    assert {r["address_id"]: r["target_value"] for r in readers.external_target(spark, str(tmp_path / "t.csv.gz"), points).collect()} == {1: 0.25, 2: None}
    with pytest.raises(ValueError):
        readers.external_target(spark, str(tmp_path / "t.csv.gz"), points.filter("address_id = 2"))


def test_log_and_ledger(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"timestamp": "2024-01-01T00:00:00", "operation": "get", "cache_type": "a", "key": "k", "hit": True, "metadata": {"x": "1"}}) + "\n")
    assert readers.access_log(spark, str(tmp_path / "log.json")).first()["metadata"] == {"x": "1"}
    (tmp_path / "l.csv").write_text("Map,Group,Parcel,Bill Year\n m1,,7,2019\nM1, ,7,2020\nm1,,7,bad\nm2,g,1,1990\n")
    assert [tuple(r) for r in readers.ledger(spark, str(tmp_path / "l.csv"), 2000, 2024).collect()] == [("M1||7", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.5)], "method string, value double")
    got = {r["method"]: r["rows"] for r in sinks.predictions(df, str(tmp_path / "p"), rows=3).collect()}
    assert got == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        sinks.predictions(df, str(tmp_path / "q"), rows=4)
    for _ in range(2):
        sinks.append_new(df.select("method"), str(tmp_path / "ledger"), ["method"])
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_leaking_features_go_for_a_property_target(spark, sf):
    from tessera.functions import features
    from tessera.plans import catalog

    made = catalog.read(spark, sf, "prj_08_building_encoder")
    assert features.for_target(made, "property_value").columns == ["p_partkey"] and features.for_target(made, "svi").columns == made.columns
    raw = spark.createDataFrame([(1, 2, 3, 4)], "id int, LUCODE int, in_sfha int, log_acres int")
    assert features.for_target(raw, "property_value").columns == ["id", "in_sfha"]
