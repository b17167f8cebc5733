"""Every registered network query against its SQL in DuckDB, and the sources by round trips."""

import json

import duckdb
import pytest

from wayfare import catalog
from wayfare.sources import network as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = lambda x: float(x) if isinstance(x, (int, float)) else x
    return sorted((tuple(flat(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_geojson_segments(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text(json.dumps({"features": [{"properties": {"Label": "C1"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0], [1, 2]]]}}]}))
    got = [tuple(r) for r in src.geojson_segments(spark, str(path), "Label").orderBy("seq").collect()]
    assert got == [("C1", 0, 0, 0.0, 0.0, 1.0, 0.0), ("C1", 0, 1, 1.0, 0.0, 1.0, 2.0)]


def test_stored_network_is_refused_after_a_change(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    src.save(edges.select("u"), edges, str(tmp_path / "net"), "v1")
    assert src.load(spark, str(tmp_path / "net"), edges, "v1") is not None
    assert src.load(spark, str(tmp_path / "net"), edges, "v2") is None
    assert src.load(spark, str(tmp_path / "net"), edges.limit(1), "v1") is None
