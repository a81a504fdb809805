"""Every registered query on three hard sets of tables: empty, with nulls in every value column, with repeated rows and extra columns of clashing names.

On empty and repeated tables the rows equal DuckDB's, but for what the library defines otherwise (listed); with nulls, whose
treatment each operator states, no query may fail.
"""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import panelkit.plans  # noqa: F401
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from panelkit import registry
from test_oracles import SF, plain

KEYS = ["c_custkey", "o_orderkey", "p_partkey", "s_suppkey", "n_nationkey", "r_regionkey", "doc_id", "event_id", "vec_id", "l_orderkey", "l_linenumber"]
#: Contracts: a writer of samples refuses an empty table, a fit refuses what can't be told, joins and sheets refuse repeated keys.
REFUSES = {
    "empty": {"write_sample": "empty, incomplete or repeated", "gram_ols": "can't be estimated"},
    "nulls": {"common_sample": "incomplete"},
    "repeats": {"join_validated": "repeats a key", "manual_cells": "repeats a key", "merge_curated_overlay": "repeats a key", "write_sample": "empty, incomplete or repeated"},
}
#: Where the SQL says less than the operator: sums of nothing are 0 here and null there, rules without rows are still listed, terms of an empty fit are not,
#: nor the grand total of no rows.
#: Repeats: ties of equal rows take all of them as primary or the same id; a row of a repeated contract stays; equal links and pairs count once;
#: the log states the number of columns that there are.
OTHERWISE = {
    "empty": {"agg_rollup", "assert_groupwise_constant", "assert_lag_identity", "assert_mapped", "assert_recount", "assert_unique_key", "export_estimates", "gap_ladder", "group_difference", "ols_joint_test", "placebo_breaks", "sensitivity_grid"},
    "repeats": {"block_fuzzy_pairs", "classify_by_rules", "classify_joined_titles", "composite_rescore", "em_variants", "join_effective_range", "link_transitive", "pick_in_window", "write_full_refresh"},
}


def table(path, kind, rng):
    t = pq.read_table(path)
    if kind == "empty":
        return t.slice(0, 0)
    if kind == "nulls":
        return pa.table({c: t[c].combine_chunks() if c in KEYS else pa.array(t[c].to_pylist(), type=t[c].type, mask=rng.random(len(t)) < 0.1) for c in t.column_names})
    t = pa.concat_tables([t, t.take(rng.choice(len(t), max(1, len(t) // 10), replace=False))])
    for extra in ("_c0", "_x0", "_k", "rank", "place", "row"):
        t = t.append_column(extra, pa.array(["z"] * len(t)))
    return t


@pytest.fixture(scope="module", params=["empty", "nulls", "repeats"])
def results(request, spark, tmp_path_factory):
    """The results of all queries on one set of tables, six at a time."""
    folder, rng, con = str(tmp_path_factory.mktemp(request.param)), np.random.default_rng(5), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{SF}/*.parquet")):
        name = os.path.basename(path)
        pq.write_table(table(path, request.param, rng), f"{folder}/{name}")
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")

    def one(name):
        try:
            return registry.QUERIES[name](spark, folder).toPandas()
        except Exception as e:  # noqa: BLE001
            return e

    names = sorted(n for n in registry.QUERIES if not n.startswith("op") or not n[2].isdigit())
    with ThreadPoolExecutor(6) as pool:
        return request.param, dict(zip(names, pool.map(one, names), strict=True)), con


def test_all_queries(results):
    kind, found, con = results
    wrong = {}
    for name, rows in found.items():
        if name in REFUSES[kind]:
            if not (isinstance(rows, ValueError) and REFUSES[kind][name] in str(rows)):
                wrong[name] = "should refuse"
        elif isinstance(rows, Exception):
            wrong[name] = str(rows)[:200]
        elif kind != "nulls" and name in registry.ORACLES and name not in OTHERWISE[kind]:
            ours, theirs = plain(rows), plain(con.execute(registry.ORACLES[name]).df())
            same = len(ours) == len(theirs) and all(x == pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))
            if not same:
                wrong[name] = (len(ours), len(theirs))
    assert not wrong
