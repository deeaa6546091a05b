import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import centroids

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, near STRING, v INT"


def brute(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    middle = [list(v) for _, v in seeds]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(middle)), key=lambda c: (far(v, middle[c]), c))
    for _ in range(rounds):
        groups = [[v for _, v in kept if nearest(v) == c] for c in range(len(middle))]
        middle = [[sum(x) // len(g) for x in zip(*g)] if g else middle[c] for c, g in enumerate(groups)]
    found = [(i, nearest(v), far(v, middle[nearest(v)])) for i, v in kept]
    total = {c: sum(d for _, a, d in found if a == c) for c in range(len(middle))}
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, a, d, total[a], sum(total.values()), middle[a]) for i, a, d in found), key=key)


def place():
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)


def run(spark, frame, rows, k, rounds, dimensions):
    table = frame([(i, v, "x", 3) for i, v in rows], SCHEMA)
    out = centroids.cluster(spark, table, place(), k, rounds, dimensions)
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_equals_brute_force_with_ties_and_repeats(spark, frame):
    rng = random.Random(3)
    for spread, k in ((2.0, 16), (0.05, 16), (0.02, 5)):
        rows = [(i, [rng.gauss(i % 7 * 0.02, spread) for _ in range(4)]) for i in range(150)]
        rows += [(500, rows[0][1])] * 60 + [(501 + i, rows[1][1]) for i in range(20)]  # a hot vector, under one and many ids
        assert run(spark, frame, rows, k, 3, 4) == brute(rows, k, 3, 4)


def test_left_out_and_odd_rows(spark, frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [1.0]), (6, []), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (9, [-inf, 0.0])]
    got = run(spark, frame, rows, 16, 3, 2)
    assert got == brute(rows, 16, 3, 2) and [r[0] for r in got] == [1, None]
    assert run(spark, frame, rows[1:8], 16, 3, 2) == []
    assert spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>").transform(lambda t: centroids.cluster(spark, t, F.lit("1"))).count() == 0


def test_search_settles_most_vectors_by_bounds():
    rng = np.random.default_rng(5)
    middle = rng.integers(-200, 200, (16, 8))
    v = (middle[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64)
    state = centroids.Search(middle).assign(v, np.zeros(3000, np.int32), np.ones(3000, np.int32), np.full(3000, np.inf), np.zeros(3000))
    moved_to = middle + rng.integers(-3, 4, middle.shape)
    moved = np.sqrt(((moved_to - middle) ** 2).sum(1).astype(float)) * centroids.WIDEN
    search = centroids.Search(moved_to)
    upper, lower = centroids.loosen(state[0], state[2], state[3], moved)
    assert search.settled(state[0], upper, lower).mean() > 0.5
    near, second, up, low = search.assign(v, state[0], state[1], upper, lower)
    exact = ((v[:, None] - moved_to[None]) ** 2).sum(2)
    assert (near == exact.argmin(1)).all()
    two = np.sort(exact, axis=1)
    assert (np.sqrt(two[:, 0]) <= up).all() and (np.sqrt(two[:, 1]) >= low).all()


def test_component_without_a_long_distance_is_refused(spark, frame):
    try:
        run(spark, frame, [(1, [3e6, 0.0])], 2, 1, 2)
    except Exception as error:
        assert "component beyond" in str(error)
    else:
        raise AssertionError("accepted")
