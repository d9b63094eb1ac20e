"""Registered queries run with the operators' own sizes."""

import inspect

import numpy as np

from upland.operators import clusters, ml, validation
from upland.plans import machine, validation_queries

LARGER = "/root/testdata/sf0.01"  # has the positives that the amplifier needs


def test_ensembles_have_all_trees(spark, monkeypatch):
    asked, fit = [], ml.fit_amplifier
    monkeypatch.setattr(ml, "fit_amplifier", lambda rows, have, trees: asked.append(trees) or fit(rows, have, 2))
    assert machine.gbt_amplifier(spark, LARGER).count() == machine.tree_attribution(spark, LARGER).count() > 0
    assert asked == [200, 200]


def test_clusters_have_all_starts(spark, sf_dir, monkeypatch):
    asked, seeded = [], clusters.seeded
    monkeypatch.setattr(clusters, "seeded", lambda rows, starts, width: asked.append(starts) or seeded(rows, starts[:2], width) | {s: np.zeros((s.k, width)) for s in starts[2:]})
    assert machine.kmeans_archetypes(spark, sf_dir).count() > 0
    assert asked == [[clusters.Start(k, seed) for k in (3, 4, 5, 6) for seed in range(10)]]


def test_draws_are_all_made(spark, sf_dir, monkeypatch):
    asked, moran = [], validation.moran_permutations
    monkeypatch.setattr(validation, "moran_permutations", lambda *a, **b: asked.append(inspect.signature(moran).bind(*a, **b)) or moran(*a[:3], draws=2))
    assert validation_queries.moran_p(spark, sf_dir).count() == 1
    asked[0].apply_defaults()
    assert asked[0].arguments["draws"] == 999 and len(validation_queries.DRAWS) == 200
