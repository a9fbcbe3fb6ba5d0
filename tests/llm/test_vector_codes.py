"""Codes of vectors against plain Lloyd rounds over all distances."""

import hashlib
import math

import numpy as np
import pytest

from tests.compare import assert_equal
from tidemark.llm import vector_codes as V
from tidemark.llm.registry import ORACLES


def plain(rows, rounds=4, entries=256):
    """rows: (vec_id, vec, label). Python integers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    cut = [[v[p * w : p * w + w] for p in range(4)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(4)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p in range(4):
            for j in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = near()
    error = [sum(d for d, _ in f) for f in found]
    per = {}
    for (_, _, y), e in zip(kept, error, strict=True):
        per[y] = per.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), e, per[y], digest) for (i, _, y), f, e in zip(kept, found, error, strict=True)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def table(spark, rows, more=()):
    schema = "vec_id long, embedding array<float>, label int" + "".join(f", {c} string" for c in more)
    return spark.createDataFrame([(*r, *more) for r in rows], schema)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (40, 12))
    rows = [(i * 3 % 997, (centres[i % 40] + rng.normal(0, 0.02, 12)).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(700)]
    out = V.vector_codes(table(spark, rows))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain(rows), key=key)


def test_messy_vectors(spark):
    """Few distinct values, so that ties and equal entries abound; nulls, other lengths, repeated rows and clashing names."""
    rng = np.random.default_rng(2)
    rows = [(i % 290, (rng.integers(-2, 2, 8) / 1024).tolist(), None if i % 5 == 0 else 1) for i in range(330)]
    rows += [rows[0], (None, [0.0] * 8, 4), (None, [0.0] * 8, None)]
    bad = [(900, None, 1), (901, [0.0] * 7 + [None], 1), (902, [0.0] * 7 + [float("nan")], 1), (903, [float("inf")] * 8, 1), (904, [], 1), (905, [0.0] * 12, 1), (906, [0.0] * 6, 1)]
    names = ("code", "upper", "lower", "vec", "error", "of", "label_error")
    out = V.vector_codes(table(spark, rows + bad, names))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain(rows), key=key)
    assert V.vector_codes(table(spark, bad[:5])).count() == 0 and V.vector_codes(table(spark, rows).limit(0)).count() == 0


def test_large_components(spark):
    """Beyond what floats hold exactly; beyond 64 bits is an error."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(1 << 17), 1 << 17, 8)).astype(float).tolist(), 0) for i in range(300)]
    out = V.vector_codes(table(spark, rows))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain(rows), key=key)
    with pytest.raises(ValueError, match="too large"):
        V.vector_codes(table(spark, [(1, [1e30] * 4, 0)]))


@pytest.mark.parametrize("spread", [3, 1000])
def test_bounds_hold_and_prune(spread):
    """Round after round, bounded steps give what all distances give, and clustered rows need far fewer of them."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread * 20, spread * 20, (64, 6))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))
    entries = x[:64].copy()
    code, upper, lower = V.first_codes(x, entries)
    for _ in range(5):
        d = V.squared(x, entries)
        assert (code == d.argmin(axis=1)).all() and (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(d)).all()
        moved_to = entries.copy()
        for j in np.unique(code):
            own = x[code == j]
            moved_to[j] = own.sum(axis=0) // len(own)
        moved = V._moved(entries[None], moved_to[None])[0]
        entries = moved_to
        code, upper, lower, n = V.next_codes(x, entries, moved, code, upper, lower)
        assert n < 0.5 * len(x) * len(entries)


def test_sql(spark, sf_dir):
    assert_equal(V.op12_vector_codes(spark, sf_dir), ORACLES["op12_vector_codes"], sf_dir)
