"""Findings of reviews: rows that differed from the SQL, and plans that grew with pairs or rounds."""

import random
from collections import Counter

import duckdb
import pytest
from panelkit import registry
from panelkit.functions.strings import _jaro_winkler
from panelkit.operators import _pairs, estimate, joins, linkage
from pyspark.sql import functions as F
from test_edges import make, rows  # noqa: F401
from test_oracles import SF, plain


def same_as_sql(spark, folder, name, tables):
    """The query over small tables (name: rows, Spark's schema) gives the SQL's rows."""
    con = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    ours, theirs = registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs) and len(ours)
    return ours


ORDERS = [(k,) for k in (0, 1, 3, 6, 9, 12, 100002, 100005, 300003, 400002, 10000002)]


@pytest.mark.parametrize("lines", [[(1, 70), (2, 71), (2, 72), (3, 73), (4, 73), (5, 6), (7, 100005), (7, 100005)], [(1, 70), (2, 71), (2, None), (None, 72), (3, 72), (None, None)], []])
def test_unique_both_sides_of_long_keys(spark, tmp_path, lines):
    if any(p is None for _, p in lines):
        lines = [*lines, (8, 74)]
    same_as_sql(spark, tmp_path, "unique_both_sides", {"orders": (ORDERS, "o_orderkey long"), "lineitem": (lines, "l_orderkey long, l_partkey long")})


def test_unique_pairs_count_those_without_an_id(make):  # noqa: F811
    p = make([(1, 1), (2, 2), (2, None), (3, 3), (None, 3), (None, None), (None, 4), (4, 5)], "a int, b int")
    assert rows(joins.unique_both_sides(p, "a", "b")) == [(1, 1), (4, 5)]


def test_pairs_of_ids_with_several_names(spark):
    """Each pair comes once with its strongest reason, over ids with several names, repeated rows and null ids."""
    rng = random.Random(4)
    names = ["jon", "jonathan", "jonathon", "mark", "marc", "martha", "marhta", None]
    a, b = ([(rng.choice([None, *range(20), *range(20)]), rng.choice(["k", "m", None]), rng.choice(names)) for _ in range(60)] for _ in "ab")
    want = {}
    for i, k, m in a:
        for j, o, n in b:
            if None in (k, o, m, n) or k != o:
                continue
            how = 1 if m == n else 2 if m.startswith(n) or n.startswith(m) else 3 if _jaro_winkler(m, n) >= 0.85 else 9
            want[i, j] = min(how, want.get((i, j), 9))
    schema = "{} int, k string, n string"
    found = linkage.block_fuzzy_pairs(spark.createDataFrame(a, schema.format("x")), spark.createDataFrame(b, schema.format("y")), "k", "n", "x", "y").collect()
    assert len(found) == len({(r.x, r.y) for r in found})
    assert {(r.x, r.y): ("exact", "prefix", "similar").index(r.how) + 1 for r in found} == {p: s for p, s in want.items() if s < 9}


def over_pairs(df) -> str:
    """What the plan does with the pairs of single ids once they are made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Generate explode")]


def test_pairs_are_made_last(spark, monkeypatch):
    """Pairs grow with the square of a name's rows, so no exchange may hold them; lists and parts shorter than a group lose none."""
    monkeypatch.setattr(_pairs, "LIST", 7)
    monkeypatch.setattr(_pairs, "PART", 5)
    one = spark.range(300).select(F.col("id").alias("x"), F.lit("k").alias("k"), F.lit("jon").alias("n"))
    found = linkage.block_fuzzy_pairs(one, one.withColumnRenamed("x", "y"), "k", "n", "x", "y")
    assert "Exchange" not in over_pairs(found) and "Aggregate" not in over_pairs(found)
    assert found.agg(F.count("*"), F.count_distinct("x", "y")).first()[:] == (90000, 90000)


def test_direct_links_by_group(spark):
    """Two frames give the links that their joined rows give, over repeated rows, several groups and confidences, and nulls."""
    rng = random.Random(9)
    pick = lambda n: rng.choice([None, *range(n)])
    ab, bc = ([(pick(12), pick(12), rng.randint(1, 3)) for _ in range(6)] for _ in "12")
    ab, bc = spark.createDataFrame(ab, "a int, b int, confidence int"), spark.createDataFrame(bc, "b int, c int, confidence int")
    l = spark.createDataFrame([(pick(12), pick(3)) for _ in range(30)], "a int, by int")
    r = spark.createDataFrame([(pick(3), pick(8), rng.choice([None, 5, 6, 7])) for _ in range(30)], "by int, c int, confidence int")
    got, want = linkage.link_transitive(ab, bc, (l, r)), linkage.link_transitive(ab, bc, l.join(r, "by").drop("by"))
    assert rows(got) == rows(want) and got.where("via = 'direct'").count() > 20 and got.where("via = 'path'").count()
    l, r = l.groupBy("a").agg(F.min("by").alias("by")), r.groupBy("c").agg(F.min("by").alias("by"), F.min("confidence").alias("confidence"))
    assert rows(linkage.link_transitive(ab, bc, (l, r))) == rows(linkage.link_transitive(ab, bc, l.join(r, "by").drop("by")))


def test_direct_links_are_not_shuffled(spark):
    found = registry.QUERIES["link_transitive"](spark, SF)
    plan = over_pairs(found)
    direct = plan[plan.rindex("direct AS via") :]
    assert "Exchange" not in direct and "Aggregate" not in direct


@pytest.mark.parametrize("kinds", [("int", "bigint", "smallint"), ("string", "double", "bigint"), ("bigint",), ("date", "int")])
def test_singletons_of_any_levels(spark, kinds):
    """Random rows with nulls, repeats and levels of several types, against a loop over lists."""
    rng = random.Random(str(kinds))
    raw = [[rng.choice([None, *range(-20, 25)]) for _ in kinds] for _ in range(70)]
    raw += raw[:3] + [[2**62 if k == "bigint" else 7 for k in kinds]]
    names = [f"_e{i}" for i in range(len(kinds))]
    texts = spark.createDataFrame([[i, *r] for i, r in enumerate(raw)], ", ".join(["id int", *[f"{n} long" for n in names]]))
    show = {"date": "date_add(DATE '2000-01-01', CAST({} AS INT))", "double": "CASE WHEN {0} = 3 THEN double('NaN') WHEN {0} = 0 THEN IF(id % 2 = 0, 0D, -0D) ELSE {0} / 2D END"}
    df = texts.selectExpr("id", *[f"{show.get(k, 'CAST({} AS ' + k + ')').format(n)} AS {n}" for n, k in zip(names, kinds, strict=True)])
    left, before = list(enumerate(raw)), -1
    while len(left) != before:
        before = len(left)
        counts = [Counter(r[j] for _, r in left) for j in range(len(kinds))]
        left = [(i, r) for i, r in left if all(counts[j][r[j]] > 1 for j in range(len(kinds)))]
    found = estimate.drop_singletons(df, names)
    assert sorted(r.id for r in found.collect()) == [i for i, _ in left] and found.columns == ["id", *names] and len(left) < len(raw)


def test_singletons_at_the_ends_of_long(spark):
    """Null has a level of its own also where no whole number is left beyond the levels."""
    df = spark.createDataFrame([(2**63 - 1, 1), (-(2**63), 1), (None, 1), (None, 1), (2**63 - 1, 1), (0, 2)], "a long, b int")
    assert rows(estimate.drop_singletons(df, ["a", "b"])) == sorted([(2**63 - 1, 1), (2**63 - 1, 1), (None, 1), (None, 1)], key=str)


def test_singletons_keep_dropped_rows_only(spark, monkeypatch):
    """A chain drops row by row; what is left on disk are these rows, never those that stay."""
    kept = []
    monkeypatch.setattr(estimate, "checkpointed", lambda df: kept.append(1) or df.localCheckpoint())
    monkeypatch.setattr(estimate, "SENT", 1)
    df = spark.createDataFrame([(i // 2, (i + 1) // 2) for i in range(12)] + [(50, 60)] * 3, "a int, b int")
    assert rows(estimate.drop_singletons(df, ["a", "b"])) == [(50, 60)] * 3 and not kept
