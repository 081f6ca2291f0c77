"""Pairs and centrality of clusters, held against brute force."""

import itertools

import numpy as np
import pytest

import __spark_entry__ as driver
from newsloom.operators import dossier

SMALL = "/root/testdata/sf0.001"


def plain(members):
    """Pairs and centralities by (cluster, ids), from rows (id, cluster, v)."""
    groups = {}
    for i, c, v in members:
        groups.setdefault(c, {})[i] = np.array(v, float)
    pairs = {(c, a, b): g[a] @ g[b] for c, g in groups.items() for a, b in itertools.combinations(sorted(g), 2)}
    mean = {(c, i): np.mean([g[i] @ g[j] for j in g if j != i]) if len(g) > 1 else 1.0 for c, g in groups.items() for i in g}
    return pairs, mean


@pytest.fixture(scope="module")
def made(spark):
    """A cluster of 60, one of nine whose ids lie in different blocks of eight, a pair and two singletons."""
    random = np.random.default_rng(8)
    ids = iter(random.permutation(200).tolist())
    rows = [(next(ids), c, (v / np.linalg.norm(v)).tolist()) for c, n in enumerate((60, 9, 2, 1, 1)) for v in random.normal(size=(n, 6))]
    return rows, spark.createDataFrame(rows, "id long, cluster long, v array<double>")


@pytest.mark.parametrize("size", [7, 500])
def test_group_pairs_are_all_pairs(made, size):
    rows, table = made
    got = dossier.group_pairs(table, "cluster", "id", "v", rows_per_block=size).collect()
    expected, _ = plain(rows)
    found = {(r.cluster, r.left_id, r.right_id): r.similarity for r in got}
    assert len(got) == len(found) and found.keys() == expected.keys()
    assert all(abs(found[k] - s) < 1e-6 for k, s in expected.items())


def test_centrality_of_every_member(made):
    rows, table = made
    _, expected = plain(rows)
    from_pairs = dossier.centrality(dossier.group_pairs(table, "cluster", "id", "v"), table, "cluster")
    for got in (from_pairs.collect(), dossier.cluster_centrality(table).collect()):
        found = {(r.cluster, r.id): r.centrality for r in got}
        assert len(got) == len(rows) and found.keys() == expected.keys()
        assert all(abs(found[k] - m) < 2e-6 for k, m in expected.items())


def test_real_clusters(spark):
    run = lambda name: driver.queries()[name](spark, SMALL).collect()
    cluster = {r.id: r.cluster for r in run("average_linkage_clusters")}
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    pairs, mean = plain([(i, c, vectors[i]) for i, c in cluster.items()])
    assert {(r.cluster, r.left_id, r.right_id) for r in run("cluster_pairs")} == pairs.keys()
    assert any(a // 8 != b // 8 for _, a, b in pairs)
    found = {(r.cluster, r.id): r.centrality for r in run("cluster_centrality")}
    assert found.keys() == mean.keys() and all(abs(found[k] - m) < 2e-6 for k, m in mean.items())
