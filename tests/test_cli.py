"""The command line and value files."""

import pytest

from tessera.__main__ import main
from tessera.sources import value_files

PROJECT = """
metadata: {name: p}
entities:
  site: {type: csv, options: {filename: sites.csv}, public_id: site_id, keys: [name], columns: [name, lat]}
  sample:
    type: fixed
    public_id: sample_id
    keys: [code]
    columns: [code, site]
    values: [[s1, north], [s2, south]]
    foreign_keys: [{entity: site, local_keys: [site], remote_keys: [name], how: left}]
"""


def test_main(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("Name,Lat\nnorth,60.5\nsouth,55.0\n")
    (tmp_path / "p.yml").write_text(PROJECT)
    assert main([str(tmp_path / "p.yml"), str(tmp_path / "out"), "--mode", "single_csv", "--validate"], spark) == 0
    assert (tmp_path / "out" / "sample.csv").read_text().splitlines() == ["system_id,sample_id,site_id,code,site", "1,,1,s1,north", "2,,2,s2,south"]
    assert (tmp_path / "out" / "table_shapes.tsv").read_text().splitlines()[1:] == ["sample\t2\t5", "site\t2\t4"]
    (tmp_path / "p.yml").write_text(PROJECT.replace("public_id: site_id", "public_id: site"))
    assert main([str(tmp_path / "p.yml"), str(tmp_path / "out"), "--validate"], spark) == 2


@pytest.mark.parametrize("name", ["v.csv", "v.tsv", "v.parquet"])
def test_value_files(spark, tmp_path, name):
    path = tmp_path / name
    first = value_files.update_values(path, ["a", "b"], [["1", "x"]])
    df, tag = value_files.get_values(spark, path)
    assert [tuple(r) for r in df.collect()] == [("1", "x")]
    assert tag == first
    second = value_files.update_values(path, ["a", "b"], [["2", None]], tag)
    assert second != first
    with pytest.raises(value_files.Changed):
        value_files.update_values(path, ["a", "b"], [], tag)
