"""Large components of unrelated documents, and large groups of near copies."""

import random
import time

import numpy as np

from arborweft.llm import jaccard
from tests.llm import odd


def test_quoting_a_passage_makes_no_component(spark):
    """Unrelated documents that quote one passage met in one place, whose cost grew with the square of their number."""
    random.seed(5)
    words = [f"v{i}" for i in range(3000)]
    quote = " ".join(f"quoted{i}" for i in range(12))
    rows = [(i, " ".join(random.choices(words, k=100)) + " " + quote, "s") for i in range(120)]
    rows += [(1000 + i, t + " end", "s") for i, t, _ in rows[:30]]
    nodes = odd.docs(spark, rows, clash=False).selectExpr("doc_id AS _id", "text")
    features = jaccard._features(nodes, 3, 80, 12, 20_000).selectExpr("_id", "n_shingles", "_bits", "0L AS _comp", "CAST(NULL AS long) AS _known")
    for limit in (4 << 20, 2000):
        roots = jaccard.components(jaccard._near_edges(features, 80, limit)).groupBy("_root").count().collect()
        assert sorted(r["count"] for r in roots) == [2] * 30


def test_a_large_group_of_near_copies_is_searched_at_once():
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(400)]
    sets = []
    for _ in range(1500):
        own = list(base)
        for k in random.sample(range(400), 20):
            own[k] = random.getrandbits(64)
        sets.append(np.unique(np.array(own, np.uint64)))
    began = time.process_time()
    root, _ = jaccard.cluster(sets, 90)
    assert time.process_time() - began < 60
    close = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))
    assert all(root[i] == root[j] for i in range(0, 300) for j in range(i) if close(sets[i], sets[j]))
