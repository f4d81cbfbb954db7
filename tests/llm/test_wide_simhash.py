import random

import numpy as np

from creditlake.llm import similar


def test_simhash_proposes_pairs_at_the_threshold():
    """Sets at a similarity of 0.8 meet in a band at MAX_BITS or fewer; unrelated ones differ by more."""
    r, found, tried = np.random.default_rng(3), 0, 300
    for _ in range(tried):
        x = r.integers(0, 1 << 64, 297, np.uint64)
        a, b, c = (similar.wide_fingerprint(np.unique(s)) for s in (x[:270], x[30:297], r.integers(0, 1 << 64, 270, np.uint64)))
        assert np.bitwise_count(a ^ c).sum() > similar.MAX_BITS
        found += bool(set(similar.band_keys(a)) & set(similar.band_keys(b))) and np.bitwise_count(a ^ b).sum() <= similar.MAX_BITS
    assert found >= 0.98 * tried


def test_buckets_are_spanned():
    r = random.Random(1)
    fps = np.random.default_rng(1).integers(0, 1 << 64, (9, 8), np.uint64)[[r.randrange(9) for _ in range(150)]]
    i, j = similar.near_fingerprints(fps)
    label = similar.components_of(150, i, j)
    assert [int(x) for x in label] == [int(np.flatnonzero((fps == f).all(axis=1))[0]) for f in fps]
