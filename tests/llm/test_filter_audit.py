"""The filter audit against a walk through every order, document by document."""

import re
from collections import Counter
from itertools import permutations

from tidemark.llm import filter_audit
from tidemark.llm.registry import ORACLES
from tests.compare import assert_equal


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first, said = {}, {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, quality, toxic in labels:
        if i is not None:
            a, b = said.get(i, (False, False))
            said[i] = (a or quality == 1, b or toxic == 1)
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first.get(t, i),
        }
        fails.append((lang or "", {k for k, v in own.items() if v}, *said.get(i, (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        removed_by = Counter()
        for order in permutations("ABCDE"):
            rest = [f for f in fails if f[0] == part]
            everyone = rest
            for step, letter in enumerate(order, 1):
                gone = [f for f in rest if letter in f[1]]
                rest = [f for f in rest if letter not in f[1]]
                redundant = sum(letter in f[1] for f in everyone) - len(gone)
                out[part, "".join(order), step] = [len(rest), len(gone), redundant, sum(f[1] == {letter} for f in everyone), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                removed_by[letter] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def rows_of(df):
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}
    assert df.count() == len(found)
    return found


def test_messy_tables(messy, empty, labels):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in messy.collect()]
    said = [tuple(r) for r in labels.collect()] + [(1, 0, 1), (5, 1, 1)]
    labels = messy.sparkSession.createDataFrame(said, "doc_id long, quality int, toxic int")
    found = rows_of(filter_audit.audit(messy, labels))
    assert found == brute(docs, said) and len(found) == 2 * 600
    assert filter_audit.audit(empty, labels).count() == 0
    assert rows_of(filter_audit.audit(messy, labels.limit(0))) == brute(docs, [])


def test_every_mask(spark):
    """Texts that fail every set of filters, with copies in other parts and a hot text."""
    plain, shouting, odd = " ".join(f"w{i}" for i in range(120)), " ".join(f"WW{i}" for i in range(120)), " $"
    texts = [a + b for a in (plain, shouting, "few words", "FEW WORDS", "a " * 20 + "b", "A " * 20 + "B", "a " * 150, "A " * 150, "") for b in ("", odd)]
    docs = [(i, t, ("de", "fr", None)[i % 3]) for i, t in enumerate([*texts, *texts, *["hot"] * 50])]
    said = [(i, i % 2, i % 5 == 0) for i in range(0, 80, 3)]
    said = [(i, q, int(t)) for i, q, t in said]
    out = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(said, "doc_id long, quality int, toxic int"))
    assert rows_of(out) == brute(docs, said)


def test_cells_are_the_counts(spark):
    rows = [("x", m % 32, m % 2 == 0, False) for m in range(100)]
    found = {r["good"]: r["cells"] for r in filter_audit.cells(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")).collect()}
    n = Counter(m % 32 for m in range(100))
    assert [a + b for a, b in zip(found[True], found[False], strict=True)] == [n[m] for m in range(32)]


def test_sql(spark, sf_dir):
    assert_equal(filter_audit.op13_filter_audit(spark, sf_dir), ORACLES["op13_filter_audit"], sf_dir)
