"""Clusters whose lists are full of their own members."""

import numpy as np

from cairn.llm import vector_dedup


def test_tight_clusters_linked_across(spark):
    rng = np.random.default_rng(5)
    far = np.arccos(0.981)
    base = np.zeros((2, 16))
    base[0, 0], base[1, :2] = 1, (np.cos(far), np.sin(far))
    x = np.concatenate([b + 1e-4 * rng.standard_normal((40, 16)) for b in base]).astype(np.float32)
    rows = [(i, "a", v) for i, v in enumerate(x.tolist())]
    out = vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = (u @ u.T >= vector_dedup.THRESHOLD).sum(axis=1) - 1
    assert links.min() == 79
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (79, 0, i == 0) for i in range(80)}


def _links(x):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return (u @ u.T >= vector_dedup.THRESHOLD).sum(axis=1) - 1


def test_many_clusters_and_a_loose_ball(spark):
    rng = np.random.default_rng(1)
    far = np.arccos(0.985)
    groups = np.zeros((6, 24))
    groups[:, 0] = np.cos(far)
    groups[0, 0], groups[np.arange(1, 6), np.arange(1, 6)] = 1, np.sin(far)
    tight = np.repeat(groups, 40, axis=0) + 1e-4 * rng.standard_normal((240, 24))
    ball = rng.standard_normal((1, 24)) + 0.13 * rng.standard_normal((500, 24))
    x = np.concatenate((tight, ball)).astype(np.float32)
    rows = [(i, "ab"[i >= 240], v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    out = vector_dedup.link_vectors(df)
    got = {r.vec_id: r for r in out.collect()}
    want = np.concatenate((_links(x[:240]), _links(x[240:])))
    assert sum(r.n_links for r in got.values()) >= 0.995 * want.sum() and all(got[i].n_links <= want[i] for i in got)
    assert {got[i].component_id for i in range(240)} == {0} and [got[i].n_links for i in range(240)] == want[:240].tolist()
    audit = vector_dedup.audit_recall(df, out, 10).first()
    assert audit.links > 0 and audit.found >= 0.99 * audit.links
