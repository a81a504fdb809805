import numpy as np
from panelkit.llm import embeddings


def brute(rows, threshold=0.9):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in fine:
        for j in fine:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 24))
    rows = [b.tolist() for b in base]
    for k, noise in enumerate((0.05, 0.1, 0.2, 0.02)):
        rows += [(b + noise * rng.normal(size=24)).tolist() for b in base[10 * k : 10 * k + 10] for _ in range(3)]
    rows += [rows[0]] * 40 + [(1e300 * np.array(rows[1])).tolist(), [0.0] * 24, None, [], [float("nan")] * 24, [None, 1.0], [1.0, 2.0], [2.0, 4.0], [float("inf"), 1.0]]
    return [(i if i != 5 else None, v) for i, v in enumerate(rows)]


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8)) * 2
    got = embeddings.lattice_points(x, 6)
    assert ((got % 2 == 0).all(axis=2) | (got % 2 == 1).all(axis=2)).all() and ((got.sum(axis=2) // 2) % 2 == 0).all()
    steps = np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T
    for p, q in zip(x, got[:, 0] / 2, strict=True):
        best = np.inf
        for shift in (0.0, 0.5):
            c = np.rint(p - shift) + steps
            c = c[c.sum(axis=1) % 2 == 0] + shift
            best = min(best, ((p - c) ** 2).sum(axis=1).min())
        assert abs(((p - q) ** 2).sum() - best) < 1e-9


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, node string, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.linked(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    h = embeddings.hasher(64)
    for c, least in ((0.9, 0.95), (0.95, 0.995)):
        x, y = h.keys(a), h.keys(c * a + np.sqrt(1 - c * c) * b)
        met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=(1, 2))
        assert met.mean() >= least


def test_empty(spark):
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
