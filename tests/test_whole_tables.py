"""Queries over all rows where the smallest tables are no larger than a cut would be."""

from __future__ import annotations

import numpy as np

from recollect.plans import registry
from recollect.sources.catalog import role


def test_cosine_means_take_every_vector(spark):
    d = "/root/testdata/sf0.1"
    rows = role(spark, d, "vectors").select("id", "label", "vector").collect()
    v, label = np.array([r.vector for r in rows], float), np.array([r.label for r in rows])
    assert len(rows) == 2000 and max(r.id for r in rows) >= 500
    v /= np.linalg.norm(v, axis=1, keepdims=True)

    def mean(x):
        return (x @ x.T)[np.triu_indices(len(x), 1)].mean()

    whole = registry.queries()["d22_pairwise_cosine"](spark, d).first().mean_cosine
    assert abs(whole - mean(v)) < 2e-6 < abs(whole - mean(v[[r.id < 500 for r in rows]]))
    for r in registry.queries()["d23_cohesion"](spark, d).collect():
        assert abs(r.mean_cosine - mean(v[label == r.label])) < 2e-6
