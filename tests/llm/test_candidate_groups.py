"""What signatures connect when the sketch is far too coarse, as it is on a table of any size beyond its own."""

import random

import numpy as np
import pytest

from swathe.llm import jaccard


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_a_coarse_sketch_does_not_connect_unlike_documents(spark, monkeypatch, k, percent):
    """Each text has n-grams that many others have too; the sketch has 256 counters for 200,000 n-grams, so it can't tell which."""
    monkeypatch.setattr(jaccard, "LEAST_BITS", 8)
    monkeypatch.setattr(jaccard, "MOST_BITS", 8)
    rng = random.Random(k)
    phrases = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(8)) for _ in range(400)]
    texts = [(d, " ".join(rng.choice(phrases) if rng.random() < 0.1 else f"w{rng.randrange(10**6)}" for _ in range(150))) for d in range(500)]
    rows = jaccard.id_and_text(spark.createDataFrame(texts, "doc_id long, text string"))
    names, connected = {}, set()
    for r in jaccard._read(rows, k, percent, jaccard.learn_order(rows, k)).collect():
        connected |= {(r.name, o) for o in r.others} | {(r.name, names[s]) for s in r.signatures if names.setdefault(s, r.name) != r.name}
    # hundreds of pairs and more before
    assert len(connected) <= 50


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature_whatever_the_weights(percent):
    """Sets of all sizes at the edge of a link, with one-sided and two-sided changes: a signature is the same under any weights."""
    rng, steps = np.random.default_rng(percent), jaccard.size_steps(percent, jaccard.WIDE)
    order, met = jaccard.Order(rng.integers(0, 90, 1 << 10).astype(np.uint8), 1000), 0
    for n in [*range(1, 120), *range(120, 3000, 97)] * 3:
        both = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        spare = n * (100 - percent) // percent
        ours = int(rng.integers(0, spare + 1))
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, m).astype(np.uint64)])) for m in (ours, spare - ours))
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            met += 1
            assert len(np.intersect1d(*(jaccard.signatures(x, percent, steps, order.weights(x)) for x in (a, b))))
    assert met > 300
