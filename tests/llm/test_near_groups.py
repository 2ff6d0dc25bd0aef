"""Near-duplicate groups of many alike texts against brute force, and the parity bound."""

import numpy as np

from gaugeflow.llm.near_dedup import group_near_duplicates, parity_bits


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 900, 4000):
        x, y = (np.unique(rng.integers(0, 3 * size + 1, size)).astype(np.uint64) for _ in range(2))
        bits = parity_bits(np.concatenate([x, y]), np.array([len(x), len(y)]))
        apart = sum(int(v).bit_count() for v in bits[0] ^ bits[1])
        assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0


def test_groups_of_alike_texts_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(70):  # edits from few words, so that shingles are shared across texts
        own = list(base)
        for at in rng.integers(0, 90, rng.integers(1, 6)):
            own[at] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, " ".join(f"z{i}" for i in range(60))), (90, " ".join(f"z{i}" for i in range(60)))]
    sets = [(i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)}) for i, t in rows for w in [t.split()]]
    least = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if least[a] > least[b] and 100 * len(x & y) >= 80 * len(x | y):
                    least[a], changed = least[b], True
    found = group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == set(least.items())
