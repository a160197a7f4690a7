import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["distance_view", "strategy_cascade"])
def test_images_without_dark_or_bright_pixels(spark, tmp_path, name):
    """As in large tables, whose means are all alike: the third image is bright in part, the fourth dark."""
    path = str(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT n::INT AS l_linenumber, y AS l_suppkey, x AS l_partkey, CASE WHEN n = 2 AND x < 9 THEN 50.0 WHEN n = 3 THEN 2.0 ELSE 25.5 END::DOUBLE AS l_quantity
        FROM (SELECT unnest(range(4)) AS n), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x)) TO '{path}'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    made = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want) and want
