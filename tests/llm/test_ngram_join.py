"""The n-gram join against all pairs, and its bounds against sets."""

import numpy as np
import pytest

from tests.llm.conftest import LONG
from tests.llm.test_brute import runs
from tidemark.llm import ngram_join as J


def brute(rows, words=5, percent=80):
    """rows: (doc_id, text). The component of every id, over all pairs of ids."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(runs(t or "", words))
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in sets}


def documents(rng, families, each, words, changes):
    """Families of texts of which some words are replaced, so that similarities lie around 0.8, and a passage that all share."""
    passage, rows = " ".join(f"common{i}" for i in range(60)), []
    for f in range(families):
        n = int(rng.integers(*words))
        base = [f"w{f}x{i}" for i in range(n)]
        for _ in range(each):
            own = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, changes + 1))):
                own[at] = f"new{rng.integers(1 << 40)}"
            rows.append((len(rows) + 1, " ".join(own) + (" " + passage if f % 3 == 0 else "")))
    return rows


def components(spark, rows, **how):
    out = J.join_groups(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    return {r["doc_id"]: r["component_id"] for r in out.collect()}


def test_families(spark):
    rows = documents(np.random.default_rng(3), 25, 16, (20, 160), 6)
    expected = brute(rows)
    assert 30 < len(set(expected.values())) < len(rows) - 30  # neither all apart nor whole families
    assert components(spark, rows) == expected


def test_short_texts_and_other_thresholds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 9)))) for i in range(250)]
    assert components(spark, rows) == brute(rows)
    assert components(spark, rows, words=1, percent=60) == brute(rows, 1, 60)


def test_crowded_tiles_meet_in_blocks(spark, monkeypatch):
    """Hundreds of documents around one text, in blocks of a few."""
    monkeypatch.setattr(J, "MOST", 16)
    monkeypatch.setattr(J, "HEAVY", 2000)
    rows = documents(np.random.default_rng(5), 2, 150, (60, 70), 4)
    expected = brute(rows)
    assert len(set(expected.values())) > 5
    assert components(spark, rows) == expected


def test_messy(messy, empty):
    out = J.join_groups(messy).collect()
    found = {r["doc_id"]: r for r in out}
    assert len(out) == messy.count()
    assert {i: r["component_id"] for i, r in found.items() if i is not None} == brute([(r["doc_id"], r["text"]) for r in messy.collect()])
    assert found[None]["component_id"] is None and found[3]["n_shingles"] == found[4]["n_shingles"] == found[6]["n_shingles"] == 0
    assert found[5]["n_shingles"] == len(runs(LONG, 5)) and found[7]["n_shingles"] == 1
    assert J.join_groups(empty).count() == 0


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (3, c), (4, b + " more"), (5, a + " more"), (6, None), (None, a)]
    found = components(spark, rows)
    assert {i: x for i, x in found.items() if i is not None} == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_similar_sets_share_a_tile(percent):
    """Whatever their sizes: also sets as far apart as the threshold lets them be."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 100, 317, 1000, 5003]:
        for s in {n, -(-percent * n // 100), (n + -(-percent * n // 100)) // 2}:
            most = int(J.differences(np.array(n + s), percent))
            common = (n + s - most + 1) // 2
            if common > s:
                continue
            x = rng.integers(1, 1 << 63, n + s - common, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:common], x[n:]]))
            row, tile = J.tiles_of(np.concatenate([a, b]), np.array([0, n, n + s]), percent)
            assert set(tile[row == 0].tolist()) & set(tile[row == 1].tolist()), (n, s)
            # and bit counts leave it open, whatever the lengths of the signatures
            bits = J.signature_bits(np.array([n, s]), percent)
            marks = [J.signature(v, int(k))[None] for v, k in zip((a, b), bits, strict=True)]
            assert J.may_link(*marks, np.array([n]), np.array([s]), percent).all()


def test_bit_counts_bound_the_intersection():
    rng = np.random.default_rng(9)
    x = rng.integers(1, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
    kept = 0
    for _ in range(300):
        n, m = int(rng.integers(100, 300)), int(rng.integers(100, 300))
        a, b = rng.choice(x, n, replace=False), rng.choice(x, m, replace=False)
        common = len(np.intersect1d(a, b))
        one, two = J.signature(a, 512)[None], J.signature(b, 1024)[None]
        apart = int(np.bitwise_count(J.folded(one, 8) ^ J.folded(two, 8)).sum())
        assert common <= (n + m - apart) // 2
        kept += int(J.may_link(one, two, np.array([n]), np.array([m]), 80)[0])
    assert kept == 0  # unrelated sets don't pass
