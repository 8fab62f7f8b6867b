"""Driver contract: entry() and registered queries exist with oracles for the checked ones."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 25
    assert df.columns == ["account_id", "case_id", "risk_score", "severity", "typology", "confidence"]
    scores = [r["risk_score"] for r in rows]
    assert scores == sorted(scores, reverse=True) and min(scores) >= 60


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
