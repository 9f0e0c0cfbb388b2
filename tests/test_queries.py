"""Every registered query has its oracle, and a spread of them agrees at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plyframe.queries.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SPREAD = [
    "results_analysis", "reply_to_san", "top_moves", "pseudo_legal_moves", "tokenize_pad", "csv_row_rules",
    "cyclic_next", "stop_rule_marker", "sequential_split", "results_csv_roundtrip",
    "cp_rank_correlation", "saturation_fit", "entry_by_rank", "running_rates", "legality_bitmap",
]


def _plain(rows, columns, order):
    rows = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r)), columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SPREAD)
def test_agrees_with_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    got = _plain(df.collect(), sorted(df.columns), [df.columns.index(c) for c in sorted(df.columns)])
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert got == _plain(cur.fetchall(), sorted(names), [names.index(c) for c in sorted(names)])
