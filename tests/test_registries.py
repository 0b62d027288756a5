"""Registries: names, plug-ins, transformers, ingesters."""

import pytest

from tessera.config.registry import Registry
from tessera.functions.transforms import TRANSFORMERS, TransformError, transform
from tessera.ingest import discovery
from tessera.sinks import writers

from .test_project import sample_submission


def test_registry():
    r = Registry("thing")

    @r.register("a", "alias")
    def one():
        return 1

    @r.register()
    def two():
        return 2

    assert list(r) == ["a", "two"]
    assert r["alias"] is one
    with pytest.raises(KeyError, match="registered already"):
        r.register("alias")(two)
    with pytest.raises(KeyError, match="no thing b; there are a, two"):
        r["b"]
    assert r.get("b") is None


def test_transformers(spark):
    df = spark.createDataFrame([("59.3;18.1", 15.0, 60.0, "4326", "x")], "p string, x double, y double, crs string, kind string")
    out = transform(df, [{"name": "geo_split", "columns": "p", "sep": ";"}, {"name": "geo_convert_crs", "columns": ["x", "y"], "src_crs_label_column": "crs", "dst_crs": 3006}, {"name": "translate", "columns": ["kind"], "mapping": {"x": "z"}}]).first()
    assert (out.p_lat, out.p_lon, out.kind) == (59.3, 18.1, "z")
    assert out.lon == pytest.approx(500_000, abs=1e-6)
    same = transform(df, [{"name": "geo_convert_crs", "columns": ["x", "y"], "src_crs": 4326, "src_crs_label_column": "gone", "dst_crs": "EPSG:3006", "lon_column": "x", "lat_column": "y"}]).first()
    assert (same.x, same.y) == pytest.approx((out.lon, out.lat), abs=1e-6)
    for bad in ({"name": "geo_split", "columns": ["p", "x"]}, {"name": "geo_convert_crs", "columns": ["x"], "dst_crs": 1}, {"name": "geo_convert_crs", "columns": ["x", "y"], "dst_crs": 3006}, {"name": "translate", "columns": "gone", "mapping": {}}):
        with pytest.raises(TransformError):
            transform(df, [bad])
    with pytest.raises(KeyError, match="no transformer"):
        transform(df, [{"name": "nothing", "columns": "p"}])
    assert set(TRANSFORMERS) >= {"translate", "geo_split", "geo_convert_crs"}


PLUGIN = """
from tessera.ingest.discovery import INGESTERS, About

@INGESTERS.register("{name}")
class Mine:
    about = About("{name}", "Mine", formats=("csv",))
"""


def test_ingesters(spark, tmp_path):
    for name, text in {"mine": PLUGIN.format(name="mine"), "other": PLUGIN.format(name="another"), "broken": "1 / 0", "_hidden": "1 / 0", "off": "1 / 0"}.items():
        (tmp_path / "plug" / name).mkdir(parents=True)
        (tmp_path / "plug" / name / "plugin.py").write_text(text)
    (tmp_path / "plug" / "empty").mkdir()
    failed = discovery.INGESTERS.discover(tmp_path / "plug", only=["mine", "other", "broken", "empty"])
    assert failed == {"other": "plugin.py registers no ingester other", "broken": "ZeroDivisionError: division by zero", "empty": "no plugin.py"}
    assert {a.key for a in discovery.listed()} >= {"workbook", "mine"}
    assert discovery.INGESTERS.discover(tmp_path / "none") == {}
    s = sample_submission(spark)
    path = str(tmp_path / "in.xlsx")
    writers.write("xlsx", path, s.tables)
    made = discovery.INGESTERS["workbook"](spark, s.schema, {"folder": f"file://{tmp_path}/run", "policies": {"drop_ignored_columns": {"columns": ["date_*"]}}, "register": lambda name: 5})
    assert made.validate(path) == []
    out = made.ingest(path)
    assert (out.success, out.submission_id, out.tables, out.records) == (True, 5, 2, 5)
