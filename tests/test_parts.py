"""Gap ladder, placebo breaks, joined titles, checks of readers and writers: planted truth, plain versions and edges."""

import datetime
import hashlib

import numpy as np
import pytest
from panelkit import sources
from panelkit.operators import columns, estimate, joins, latent
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_gap_ladder_equals_least_squares(make):
    rng = np.random.default_rng(4)
    n = 300
    x, lone = rng.normal(size=n), np.r_[np.ones(5), np.zeros(n - 5)]
    p, q = rng.random(n) * 0.5, rng.random(n) * 0.5
    p[:5] = q[:5] = 0.0  # rows with "lone" are of the third category only: nothing tells their gap
    y = 1 + x + p * (2 + 0.5 * x) - q + 0.1 * rng.normal(size=n)
    g, w = rng.normal(size=n), rng.random(n)
    schema = "y double, x double, lone double, p double, q double, g double, w double"
    df = make([tuple(map(float, r)) for r in zip(y, x, lone, p, q, g, w, strict=True)] + [(None, 1.0, 1.0, 0.1, 0.1, 1.0, 1.0)], schema)
    found = {r.step: r.value for r in latent.gap_ladder(df, "y", ["x", "lone"], "p", "q", "g", "w").collect()}
    base = np.column_stack([np.ones(n), x, lone])
    z = np.column_stack([p[:, None] * base, q[:, None] * base, base])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    ok = lone == 0
    gap = base @ b[:3]
    plain = {
        "slope": np.linalg.lstsq(np.column_stack([p, q, np.ones(n)]), y, rcond=None)[0][0],
        "slope_given_x": np.linalg.lstsq(np.column_stack([p, q, base]), y, rcond=None)[0][0],
        "interacted_prior": np.average(gap[ok], weights=p[ok]), "fitted_prior": np.average(g[ok], weights=p[ok]),
        "fitted": np.average(g[ok], weights=w[ok]), "fitted_all": np.average(g, weights=w),
        "n": n, "n_supported": ok.sum(), "share_supported": 1.0, "rank": 7, "columns": 9,
    }
    assert found.keys() == plain.keys()
    for k, v in plain.items():
        assert abs(found[k] - v) < 1e-7 * max(1, abs(v)), k
    empty = {r.step: r.value for r in latent.gap_ladder(df.limit(0), "y", ["x"], "p", "q", "g", "w").collect()}
    assert empty["n"] == 0 and empty["slope"] is None and empty["interacted_prior"] is None
    each = latent.estimable_contrast(df, "y", ["x", "lone"], "p", "q", beside=True).orderBy("x").collect()
    assert all((r.contrast is None) == (r.lone == 1) for r in each)


def test_placebo_breaks_find_planted_ones(make):
    rng = np.random.default_rng(2)
    data = []
    for u in range(40):
        for t in range(1990, 2001):
            own = u % 2
            effect = 1.0 + 0.5 * (t - 1990) if t <= 1994 else 4.0 * (t >= 1998)
            data.append((u, t, own, float(own * effect + 0.2 * t + 0.05 * rng.normal())))
    df = make([*data, (1, 1991, None, 3.0), (None, None, 1, 1.0)], "u int, t int, own int, y double").withColumn("_term", F.lit(1))
    out = {(r.era, r["test"], r["at"]): r for r in estimate.placebo_breaks(df, "y", "own", "t", {"a": (1990, 1994), "b": (1995, 2000), "none": (1900, 1901)}, {"b": [1998], "none": [1901]}, fe=["t"], cluster="u").collect()}
    assert abs(out["a", "trend", None].estimate - 0.5) < 0.02 and out["a", "trend", None].p_value < 0.001
    assert abs(out["b", "break", 1998].estimate - 4) < 0.05 and out["b", "break", 1998].n == 240 and out["b", "break", 1998].n_treated == 120
    assert out["none", "break", 1901].estimate is None and out["none", "trend", None].n == 0
    few = estimate.placebo_breaks(df, "y", "own", "t", {"a": (1990, 1990)}, {}, least_rows=20).first()
    assert few.estimate is None and few.n == 40  # a single period: no trend can be told
    assert estimate.placebo_breaks(df.limit(0), "y", "own", "t", {"a": (1990, 1994)}, {}).first().n == 0


RULES = [(1, "head", "H", 1), (2, "chief", "C", 2), (3, "assistant", "A", 5), (4, "cap|player", "P", 4)]


def test_titles(make):
    rules = make(RULES, "rule_order int, pattern string, code string, rank int")
    titles = make([(1, "Chief and Head"), (2, "Director of cap & player deals"), (3, "Interim head/assistant"), (4, "interim Assistant"), (5, None), (6, " / "), (7, "Chief, chief"), (8, "assistant to the chief and head"), (9, "Typist")], "id int, title string").withColumn("rules", F.lit(1))
    call = {"sep": "/", "joiner": r",\s*(?:and\s+)?|\s+&\s+|\s+and\s+", "standalone": ["H", "C"], "whole": "assistant to", "interim": r"\binterim\s+", "head": ["H"], "once": True}
    out = columns.classify_by_rules(titles, ["id", "rules"], "title", rules, **call).drop("rules", "rank")
    assert rows(out) == sorted([
        (1, 0, "Chief", "C", 0, 0), (1, 1, "Head", "H", 0, 1), (2, 0, "Director of cap & player deals", "P", 0, 1), (3, 0, "head", "H", 1, 1), (3, 1, "assistant", "A", 0, 0),
        (4, 0, "Assistant", "A", 1, 1), (7, 0, "Chief", "C", 0, 1), (8, 0, "assistant to the chief and head", "H", 0, 1), (9, 0, "Typist", None, 0, 1)], key=str)
    assert columns.classify_by_rules(titles.limit(0), ["id"], "title", rules, **call).count() == 0
    assert rows(columns.classify_by_rules(titles.where("id = 1"), ["id"], "title", rules.limit(0), **call).select("fragment", "code")) == [("Chief and Head", None)]


def test_mirror_agreement(make):
    m = make([(1, 0, 5, 6), (1, 1, 6, 5), (2, 0, 5, 6), (2, 1, 6, 4), (3, 0, None, 1), (3, 1, 1, None), (4, 0, 1, 1), (5, 0, 1, 1), (5, 0, 1, 1), (None, 0, 1, 2), (None, 1, 1, 2), (6, 0, 1, None), (6, 1, 3, 1)], "k int, side int, mine int, yours int")
    assert tuple(joins.mirror_agreement(m, "k", "side", {"mine": "yours"}).first()) == (6, 2, 2)
    assert tuple(joins.mirror_agreement(m.limit(0), "k", "side", {"mine": "yours"}).first()) == (0, 0, 0)


def test_payload_states_its_period(make):
    p = make([(1, '{"year": 2020, "A": {"b": 1}}'), (2, '{"A": {"b": 2}}'), (3, None), (4, "{broken")], "id int, j string").withColumn("_json", F.lit(0))
    out = sources.scan_json_flatten(p, "j", "year int, A struct<b:int>", "p", {"p_year": F.lit(2020)})
    assert rows(out.select("id", "p_year", "p_a_b", "_json")) == [(1, 2020, 1, 0), (2, None, 2, 0), (3, None, None, 0), (4, None, None, 0)]
    with pytest.raises(ValueError, match="1 payloads"):
        sources.scan_json_flatten(p, "j", "year int", "p", {"p_year": F.lit(2021)})
    with pytest.raises(ValueError, match="already there"):
        sources.scan_json_flatten(p.withColumn("p_year", F.lit(1)), "j", "year int", "p")


def test_log_sheet_and_checksums(make, spark, tmp_path, monkeypatch):
    a = make([(1, None)], "x int, y string")
    for frame, note in ((a, "one"), (a.union(a), "two"), (a.limit(0), "three")):
        last = sources.write_full_refresh(frame, str(tmp_path), "t", "here", note).first()
        assert last.n_rows == frame.count() and isinstance(last.built_at, datetime.datetime)
    assert [(r.table_name, r.n_rows, r.note, r.n_builds) for r in sources.build_log(spark, str(tmp_path)).collect()] == [("t", 0, "three", 3)]
    u, s = make([(1, "a"), (2, "b"), (None, "c")], "k int, name string"), make([(2, "old", 7), (3, "gone", None), (4, "gone", 8)], "k int, name string, note int")
    merged = sources.merge_curated_overlay(u, s, "k", ["note"])
    assert rows(merged) == sorted([(1, "a", None, 0), (2, "b", 7, 0), (3, "gone", None, 1), (4, "gone", 8, 1), (None, "c", None, 0)], key=str)
    assert rows(sources.manual_cells(s, merged, ["note"])) == [("note", 2, 2, 0)]
    assert rows(sources.manual_cells(s, s.where("k = 2"), ["note"])) == [("note", 2, 1, 1)]
    with pytest.raises(ValueError, match="sheet repeats"):
        sources.merge_curated_overlay(u, s.union(s), "k", ["note"])
    for i, size in enumerate((0, 10, 5000)):
        (tmp_path / f"f{i}.bin").write_bytes(bytes(range(10)) * (size // 10))
    manifest = make([(f"f{i}.bin", hashlib.sha256((tmp_path / f"f{i}.bin").read_bytes()).hexdigest()) for i in range(3)], "file_name string, recorded string")
    for whole in (1 << 28, 100):
        monkeypatch.setattr(sources, "WHOLE_FILE", whole)
        assert rows(sources.verify_source_checksum(spark, [f"{tmp_path}/f*.bin"], manifest).select("file_name", "status")) == [("f0.bin", "missing"), ("f1.bin", "ok"), ("f2.bin", "ok")]  # f0 is empty


def test_fits_that_cannot_tell(make):
    df = make([(float(i % 5), float(i), 2.0 * i, i % 3) for i in range(30)], "y double, x double, twice double, g int")
    tests = {"x = 0": ({"x": 1.0}, 0.0), "twice = 0": ({"twice": 1.0}, 0.0)}
    out = {r.restriction: r for r in estimate.ols_joint_test(df, "y", ["x", "twice"], tests, cluster="g").collect()}
    assert out["twice = 0"].f_value is None and out["x = 0"].f_value is not None and out["joint"].df1 == 1
    none = {r.restriction: r.f_value for r in estimate.ols_joint_test(df.limit(0), "y", ["x", "twice"], tests, cluster="g").collect()}
    assert none == {"x = 0": None, "twice = 0": None, "joint": None}
    assert estimate.bootstrap_wild_cluster(df.limit(0), "y", ["x"], "x", "g", replicates=9).first().estimate is None
    assert estimate.interaction_profile(df.limit(0), "y", "x", "g", ["twice"], [], "g").count() == 0
    flow = estimate.sample_flow(df.limit(0), {"late": F.col("x") > 1}, "g").orderBy("step").collect()
    assert [tuple(r) for r in flow] == [(0, "input", 0, 0), (1, "late", 0, 0)]
    a, b = make([(1, "u"), (None, "u"), (2, "w")], "i int, t string"), make([(7, "u"), (8, "u"), (9, None)], "j int, t string")
    assert rows(joins.pair_kth_duplicate(a, b, "i", "j", [("same", ["t"]), ("again", ["t"])])) == [(1, 7, "same")]
