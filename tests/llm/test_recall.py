import numpy as np

from helixframe.llm.vector_dedup import learn_rotation, near_vectors, pairs_at, plan_tables


def _balls(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_wide_keys_keep_their_recall():
    x = _balls(3000, 64, 1)
    rotations = [learn_rotation(x, k, rounds=5) for k in range(2)]
    for width in (12, 17, 22, 25):
        tables, _ = plan_tables(x, rotations, width, 0.95, 30, 7, 0.98, 48)
        u, v = pairs_at(x, 0.95, 4000, 99)
        apart = np.hstack([((u - m) @ r >= 0) != ((v - m) @ r >= 0) for m, r in rotations])
        found = np.any([apart[:, t].sum(axis=1) <= 1 for t in tables], axis=0)
        assert found.mean() > 0.965, (width, found.mean())


def test_links_near_the_threshold(spark):
    x = _balls(600, 64, 2)
    for cosine in (0.951, 0.96, 0.97):
        x = np.vstack([x, pairs_at(x[:200], cosine, 400, int(cosine * 1000))[1]])
    real = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = near_vectors(frame, width=25).collect()
    assert sum(r.n_links for r in out) >= 0.95 * real.sum() and all(r.n_links <= real[r.vec_id] for r in out)


def test_each_length_for_itself(spark):
    v = [[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0], [1.0, 0.01], [2.0, 0.0], [3.0]]
    out = near_vectors(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6)}
