"""The set-similarity join against all pairs, and how few pairs it looks at."""

import random

import pytest
from pyspark.sql import functions as F

from querygrove.operators import setjoin

SCHEMA = "g string, {} string, tokens array<string>"


def sides(spark, left, right):
    """Both sides ordered by the right side's counts."""
    values = spark.createDataFrame([(g, k, sorted(t)) for g, k, t in right], SCHEMA.format("right_id"))
    probes = spark.createDataFrame([(g, k, sorted(t)) for g, k, t in left], SCHEMA.format("left_id"))
    counts = setjoin.token_counts(values, "g")
    return (setjoin.rarest_first(probes, counts, "g", "left_id"), setjoin.rarest_first(values, counts, "g", "right_id"), counts)


def random_sets(n, seed, groups="xy"):
    rng = random.Random(seed)
    # Few common tokens, many rare ones, and some sets that nearly repeat another.
    def one():
        return {f"c{rng.randrange(4)}" for _ in range(rng.randrange(3))} | {f"r{int(rng.random() ** 3 * 60)}" for _ in range(rng.randrange(1, 12))}
    out = [(rng.choice(groups), f"k{i}", one()) for i in range(n)]
    for i in range(0, n, 3):
        g, _, t = out[rng.randrange(n)]
        out[i] = (g, f"k{i}", set(t) ^ {f"r{rng.randrange(60)}"} or {"one"})
    return out


def jaccard(a, b):
    return len(a & b) * 100, len(a | b)


@pytest.mark.parametrize("percent", [30, 45, 67, 80, 100])
def test_similar_pairs_are_all_pairs_above_the_threshold(spark, percent):
    left, right = random_sets(120, percent), random_sets(150, percent + 1)
    want = {(a, b) for g, a, s in left for h, b, t in right if g == h and jaccard(s, t)[0] >= percent * jaccard(s, t)[1]}
    found = setjoin.similar_pairs(*sides(spark, left, right), "g", percent).collect()
    assert len(found) == len(want) and {(r.left_id, r.right_id) for r in found} == want
    of, to = {k: t for _, k, t in left}, {k: t for _, k, t in right}
    assert all((r.common, r.either) == (len(of[r.left_id] & to[r.right_id]), len(of[r.left_id] | to[r.right_id])) for r in found)


def test_closest_pairs_with_ties(spark):
    left, right = random_sets(60, 5), random_sets(200, 6)
    a, b, counts = sides(spark, left, right)
    found = setjoin.closest_pairs(a, b, counts, "g", 4, [80, 50, 20], [F.col("right_id")]).collect()
    want = set()
    for g, k, s in left:
        scored = sorted((-len(s & t) / len(s | t), j) for h, j, t in right if g == h and jaccard(s, t)[0] >= 20 * jaccard(s, t)[1])
        want |= {(k, j) for _, j in scored[:4]}
    assert len(found) == len(want) and {(r.left_id, r.right_id) for r in found} == want


def test_a_token_of_every_set_makes_no_pairs(spark):
    rng = random.Random(1)
    # Three tokens that all sets have, and three of their own: at 80 percent only near copies may meet.
    sets = [("x", f"k{i}", {"all", "every", "each"} | {f"t{rng.randrange(4000)}" for _ in range(3)}) for i in range(600)]
    a, b, counts = sides(spark, sets, sets)
    met = setjoin.candidates(a, b, counts, "g", 80).count()
    assert met <= 3 * len(sets)  # of 360,000
    assert setjoin.similar_pairs(a, b, counts, "g", 80).count() >= len(sets)


def test_empty_sides(spark):
    a, b, counts = sides(spark, [], random_sets(5, 2))
    assert setjoin.similar_pairs(a, b, counts, "g", 50).count() == 0
    a, b, counts = sides(spark, random_sets(5, 2), [])
    assert setjoin.closest_pairs(a, b, counts, "g", 3, [50], [F.col("right_id")]).count() == 0
