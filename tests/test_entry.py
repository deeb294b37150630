"""Driver contract of __spark_entry__.py."""

import __spark_entry__ as entry_mod


def test_entry_rows_and_schema(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["model", "label", "rank_coupled", "winrate_coupled", "ci_coupled",
                          "rank_independent", "winrate_independent", "ci_independent"]
    rows = df.collect()
    assert len(rows) == 6 and all(1 <= r.rank_coupled <= 6 for r in rows)


def test_oracle_keys_are_queries():
    from tandem.plans import ORACLE, QUERIES
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert set(QUERIES) <= set(entry_mod.queries())
    q, o = QUERIES, ORACLE
    assert set(o) <= set(q) and len(q) >= 67
    assert set(q) == set(o)
