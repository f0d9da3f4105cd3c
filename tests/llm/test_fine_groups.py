"""Keys of fine groups: what linked sets share, and what sets that are not linked do not."""

import numpy as np
import pytest

from quarry.llm import jaccard_join


def a_set(rng, size):
    return np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))


@pytest.mark.parametrize("share", [80, 85])
def test_linked_sets_share_as_many_keys_as_said(share):
    rng, scheme, seen = np.random.default_rng(7), jaccard_join.Scheme(share), 0
    with np.errstate(over="ignore"):
        for _ in range(600):
            own = a_set(rng, int(2 ** rng.uniform(5, 11)))
            size = int(rng.uniform(share / 100 * len(own), len(own) * 100 / share))
            alike = -(-share * (len(own) + size) // (100 + share))
            if alike > min(len(own), size):
                continue
            # As far apart as linked sets can be.
            other = np.unique(np.concatenate([rng.choice(own, alike, replace=False), a_set(rng, size - alike)]))
            if jaccard_join.linked(own, other, share):
                seen += 1
                both = len(np.intersect1d(scheme.keys(own), scheme.keys(other)))
                assert both >= max(scheme.shared(own), scheme.shared(other)) >= 1
    assert seen > 300


def test_sets_with_empty_groups_do_not_meet_under_them():
    rng, scheme = np.random.default_rng(8), jaccard_join.Scheme(80)
    with np.errstate(over="ignore"):
        keys = [set(scheme.keys(a_set(rng, size)).tolist()) for size in range(60, 400, 2)]
    assert not any(a & b for i, a in enumerate(keys) for b in keys[:i])


def test_sets_that_share_a_passage_are_not_compared(spark):
    rows = [(key, node) for node in (1, 2) for key in (10, 11)] + [(key, node) for node in (3, 4) for key in (20, 21, 22)]
    groups = spark.createDataFrame(rows, "key long, node long")
    label = spark.createDataFrame([], "node long, root long")
    least = spark.createDataFrame([(node, 3) for node in (1, 2, 3, 4)], "node long, shared int")
    left = jaccard_join.crossing(groups, label, least).collect()
    assert sorted(map(tuple, left)) == [(key, node) for key in (20, 21, 22) for node in (3, 4)]
