"""Leaves of the forest stay small whatever the first sample, without loss of links."""
import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import tree_forest

KIND = "vec_id long, embedding array<double>, label int"


def rows_of(n, size, copies, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    near = x[rng.integers(0, n, copies)] + 0.3 * rng.normal(size=(copies, size))
    return np.vstack([x, near])


def test_leaves_are_split_in_rounds(spark, monkeypatch):
    x = rows_of(1500, 24, 500, 3)
    label = np.arange(len(x)) % 2 * 0
    frame = spark.createDataFrame([(i, v.tolist(), int(label[i])) for i, v in enumerate(x)], KIND)
    seen = []
    plain = tree_forest.narrow_leaves

    def spy(routed, *args):
        out = plain(routed, *args)
        count = lambda df: df.select(F.explode("codes").alias("leaf")).groupBy("leaf").count().agg(F.max("count"), F.sum("count")).first()
        seen.append((count(routed), count(out), out.count()))
        return out

    monkeypatch.setattr(tree_forest, "narrow_leaves", spy)
    # the first sample holds 60 rows: one split at most, all else is done by the leaves' own rows, 100 at a time
    got = {r.vec_id: r for r in tree_forest.link_vectors(frame, leaf_rows=80, sample_rows=60, leaf_sample=100).collect()}
    (before, after, kept), = seen
    assert before[0] > 600 and after[0] <= 160 and kept == len(x)
    assert after[1] <= 25 * len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.93
    np.fill_diagonal(linked, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert linked.sum() > 300 and (found <= linked.sum(axis=1)).all()
    assert found.sum() >= 0.98 * linked.sum()


def test_a_crowd_stays_one_leaf_and_is_whole(spark):
    rng = np.random.default_rng(1)
    x = np.ones((400, 12)) + 1e-4 * rng.normal(size=(400, 12))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], KIND)
    got = tree_forest.link_vectors(frame, leaf_rows=50, sample_rows=40, leaf_sample=64, block_rows=64).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)}
