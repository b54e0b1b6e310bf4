"""Readers on files with the shapes of the real services."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.schemas import PANEL_HOURLY
from pvseries.sources import nested_json, probe, tables


def test_hourly_and_typical_json(spark, tmp_path):
    for i in range(2):
        doc = {"outputs": {"hourly": [{"time": f"2019010{i + 1}:0{h}30", "P": 1.0 * h, "Gb(i)": 2.0, "Int": 0.0}
                                      for h in range(3)],
                           "tmy_hourly": [{"time(UTC)": "20150101:0000", "WD10m": 5.0}]}, "meta": {"x": 1}}
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=2))
    rows = nested_json.read_hourly_json(spark, str(tmp_path))
    assert rows.columns == PANEL_HOURLY.names and rows.count() == 6
    assert rows.agg(F.sum("P"), F.max("`Gb(i)`")).first()[:] == (6.0, 2.0)
    assert nested_json.read_hourly_json(spark, str(tmp_path), "tmy_hourly").agg(F.sum("WD10m")).first()[0] == 10.0


def test_parameter_json_follows_the_first_parameter(spark, tmp_path):
    doc = {"properties": {"parameter": {"T2M": {"2019010101": 1.5, "2019010100": 0.5},
                                        "PS": {"2019010100": 98.0, "2019010107": 1.0}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = nested_json.read_parameter_json(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r.time, r.T2M, r.PS, r.RH2M) for r in rows] == [("2019010100", 0.5, 98.0, None), ("2019010101", 1.5, None, None)]


def test_site_meta(spark, tmp_path):
    doc = {"inputs": {"location": {"latitude": -12.5, "longitude": 101.25, "elevation": 88.0},
                      "meteo_data": {"radiation_db": "X", "meteo_db": "Y", "year_min": 2019, "year_max": 2020, "use_horizon": True},
                      "mounting_system": {"fixed": {"slope": {"value": 30, "optimal": False},
                                                    "azimuth": {"value": 0, "optimal": False}, "type": "free-standing"}},
                      "pv_module": {"technology": "c-Si", "peak_power": 1.0, "system_loss": 14.0}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    row = nested_json.read_site_meta(spark, str(tmp_path)).first()
    assert (row.latitude, row.year_max, row.slope.value, row.mounting, row.system_loss) == (-12.5, 2020, 30.0, "free-standing", 14.0)


@pytest.fixture
def probed(tmp_path):
    (tmp_path / "plain.csv").write_text("time,P\na,1\nb,2\n")
    (tmp_path / "deep.csv").write_text("Latitude: 1\nLongitude: 2\n\n\ntime,P\nc,3\nd,x\n\nfooter\n")
    (tmp_path / "late.csv").write_text("".join(f"line {i}\n" for i in range(12)) + "time,P\nz,9\n")
    return str(tmp_path)


def test_header_offsets(spark, probed):
    got = {r.file.rsplit("/", 1)[1]: (r.skip, r.header) for r in probe.header_offsets(spark, probed, ["P", "nope"]).collect()}
    assert got == {"plain.csv": (0, "time,P"), "deep.csv": (2, "time,P"), "late.csv": (12, "time,P")}
    assert all(r.skip is None for r in probe.header_offsets(spark, probed, ["nope"]).collect())
    with pytest.raises(ValueError, match="no header"):
        probe.read_after_header(spark, probed, PANEL_HOURLY, ["nope"])
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("P", T.DoubleType())])
    rows = probe.read_after_header(spark, probed, schema, ["P"]).orderBy("time").collect()
    assert [(r.time, r.P) for r in rows] == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", None), ("footer", None), ("z", 9.0)]
    seen = probe.inspect(probe.read_after_header(spark, probed, schema, ["P"]), ["time"])
    assert {r.column: (r.nulls, r.dtype) for r in seen["columns"].collect()}["P"] == (2, "double")
    assert [r.time for r in seen["head"].collect()] == ["a", "b", "c"] and [r.time for r in seen["tail"].collect()] == ["footer", "z"]


def test_delimited_keeps_bad_rows_and_file_order(spark, tmp_path):
    (tmp_path / "1.csv").write_text("k,v\n1,1.5\n2,oops\n")
    (tmp_path / "2.csv").write_text("k,v\n3,2.5\n1,9.5\n")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])
    df = tables.read_delimited(spark, str(tmp_path), schema, corrupt=True)
    assert df.filter(F.col(tables.CORRUPT).isNotNull()).first().k == 2
    from pvseries.operators.clean import dedupe_first
    placed = tables.read_delimited(spark, str(tmp_path), schema, position="pos")
    assert dedupe_first(placed, ["k"], ["pos"]).filter("k = 1").first().v == 1.5
