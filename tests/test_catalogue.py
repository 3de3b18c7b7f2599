"""Every registered query against its SQL on the smallest tables, and the stability of those without."""

import duckdb
import pandas as pd
import pytest

from cuelake.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return f"{float(v):.10g}"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got or name in catalogue.ORACLES
    if name in catalogue.ORACLES:
        r = duck.sql(catalogue.ORACLES[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


LINE = {"l_partkey": 7, "l_linenumber": 5, "l_returnflag": "N", "l_linestatus": "F", "l_quantity": 30.0, "l_tax": 0.0}


def against_sql(spark, folder, name, lines):
    """Rows of a query on lines of orders, which have to be those of its SQL; the lines are in the order of the file."""
    file = str(folder / "lineitem.parquet")
    pd.DataFrame([LINE | x for x in lines]).astype({"l_linenumber": "int32", "l_partkey": "Int64"}).to_parquet(file)
    df = catalogue.QUERIES[name](spark, str(folder))
    got = sorted(tuple(r) for r in df.collect())
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{file}'")
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    return got


def test_first_track_at_one_place(spark, tmp_path):
    """Lines of one place that differ in their flag: a returned one counts, whichever comes first."""
    flags = {1: "NR", 2: "RN", 3: "AR", 4: "RA", 5: "NA"}
    lines = [{"l_orderkey": o, "l_returnflag": f} for o, of in flags.items() for f in of]
    later = [{"l_orderkey": o, "l_linenumber": 6, "l_partkey": 9, "l_returnflag": "R"} for o in flags]
    assert against_sql(spark, tmp_path, "first_track", lines + later) == [(1, 7), (2, 7), (3, 7), (4, 7), (5, 9)]


def test_verify_mux_at_one_index(spark, tmp_path):
    """Of subtitles at one index the first in the table counts, by language and by title; those without an index are last."""
    subs = {
        1: [("R", 30.0), ("A", 30.0)], 2: [("A", 30.0), ("R", 30.0)], 3: [("R", 30.0), ("R", 9.0)], 4: [("R", 9.0), ("R", 30.0)], 5: [("R", 30.0), ("N", 9.0)],
    }
    lines = [{"l_orderkey": o, "l_returnflag": f, "l_quantity": q} for o, of in subs.items() for f, q in of]
    lines += [{"l_orderkey": 6, "l_partkey": p, "l_returnflag": f} for p, f in ((None, "A"), (7, "R"))]
    got = against_sql(spark, tmp_path, "verify_mux", lines)
    assert got == [(1, ""), (2, "first subtitle"), (3, ""), (4, "first subtitle"), (5, ""), (6, "")]


VIDEO = {"l_linenumber": 1}


def test_video_size_at_one_index(spark, tmp_path):
    """Of videos at one index the first in the table counts; one that is filtered out or has no index doesn't."""
    sizes = {1: (3.0, 4.0), 2: (4.0, 3.0), 3: (9.0, 5.0, 7.0), 4: (5.0, 9.0, 7.0)}
    lines = [VIDEO | {"l_orderkey": o, "l_quantity": q} for o, of in sizes.items() for q in of]
    lines += [VIDEO | {"l_orderkey": 5, "l_quantity": q, "l_tax": t} for q, t in ((8.0, 0.05), (6.0, 0.0), (2.0, 0.0))]
    lines += [VIDEO | {"l_orderkey": o, "l_partkey": p, "l_quantity": 9.0 - (p or 0)} for o, p in ((6, None), (6, 7), (7, None))]
    got = against_sql(spark, tmp_path, "video_size", lines)
    assert got == [(1, 3, 1), (2, 4, 1), (3, 9, 1), (4, 5, 1), (5, 6, 1), (6, 2, 1), (7, 1920, 1080)]


def test_video_size_over_files(spark, tmp_path):
    """A table of many files is read in the order of their names, whatever the order of the tasks."""
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(5):
        rows = [LINE | VIDEO | {"l_orderkey": o, "l_quantity": float(10 + 7 * o * (k + 1) % 31)} for o in range(20) for _ in range(5 - k)]
        pd.DataFrame(rows).astype({"l_linenumber": "int32"}).to_parquet(str(tmp_path / "lineitem.parquet" / f"part-{k}.parquet"))
    got = {r["path"]: r["width"] for r in catalogue.QUERIES["video_size"](spark, str(tmp_path)).collect()}
    assert got == {o: 10 + 7 * o % 31 for o in range(20)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
