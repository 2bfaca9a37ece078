import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["co_newman", "backbone_disparity_or", "components", "author_metrics_hg", "active_jaccard", "participation_z", "path_summary"]


def canon(rows):
    return sorted(repr(tuple(round(float(x), 5) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == cols
    picked = ", ".join(f'"{c}"' for c in cols)
    assert canon(map(tuple, df.select(*cols).collect())) == canon(con.sql(f"select {picked} from ({entry.oracle_sql()[name]})").fetchall())


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
