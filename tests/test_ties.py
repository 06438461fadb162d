"""Order lines that share their number: the SQL, on one thread, takes the first row of the table."""

import duckdb

from lorewell import queries
from lorewell.oracles import SQL


def test_entities_take_the_first_of_tied_rows(spark, tmp_path):
    rows = [(1, 7, 3, 2, 5.0, "R", "O"), (1, 7, 4, 2, 6.0, "A", "F"), (1, 8, 4, 1, 6.0, "N", "O"), (1, 8, 4, 1, 2.0, "N", "F"), (2, 7, 4, 1, 2.0, "N", "F")]
    db = duckdb.connect()
    db.execute("set threads = 1")
    db.execute("create table lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag varchar, l_linestatus varchar)")
    db.executemany("insert into lineitem values (?, ?, ?, ?, ?, ?, ?)", rows)
    db.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = {tuple(r) for r in queries.g4_entities(spark, str(tmp_path)).select("name", "type", "description", "source_id").collect()}
    assert got == {("part-7", "R", "xOO", "1,2"), ("part-8", "N", "xO", "1")}
    assert got == set(db.sql(SQL["g4_entities"]).fetchall())
