"""Operators against brute force, the tokenizer library, or labels held out."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import _words, decontaminate, line_dedup, mixing, near_dedup, quality, secrets, token_counts, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def runs(text, k):
    w = SPACE.findall(ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_words_are_words():
    column = pa.array(["A b\tc", "", None, "é x  y", "x" * 300_000 + " z"])
    found = [[] for _ in range(5)]
    for i, j, h, bounds in _words.documents(column):
        for r in range(j - i):
            found[i + r] = h[bounds[r] : bounds[r + 1]].tolist()
    assert [len(f) for f in found] == [3, 0, 0, 2, 2]
    other = next(_words.documents(pa.array(["a B c"])))[2].tolist()
    assert found[0] == other


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(docs, texts, k):
    sets = {i: runs(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    for r in near_dedup.near_groups(docs, words=k).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def joined(sets):
    """The least id that links reach, by comparing all pairs of sets that share a run."""
    up, holders = {i: i for i in sets}, defaultdict(list)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, own in sets.items():
        common = Counter(j for run in own for j in holders[run])
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                up[y] = x
        for run in own:
            holders[run].append(i)
    return {i: find(i) for i in sets}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Large nodes: anchors, those apart against all, and further levels, with limits made small."""
    monkeypatch.setattr(near_dedup, "MOST", 8)
    rng, rows = random.Random(3), []
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    for i in range(100):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    want = joined({i: runs(t, 2) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert sum(got[i] != want[i] for i in got) <= 1


def apart(n, rng, own=21, new=12):
    """n pairs of texts at 0.8 that share a passage with all others, at 0.7 to them."""
    shared = [f"s{i}" for i in range(100)]
    for i in range(n):
        words = [f"o{i}x{k}" for k in range(own)]
        for k in range(2):
            at = rng.randrange(own - new)
            yield 2 * i + k, " ".join(shared + (words[:at] + [f"p{i}x{j}" for j in range(new)] + words[at + new :] if k else words))


@pytest.mark.parametrize("n, most, least", [(40, 12, 0.95), (2500, None, 0.98)])
def test_pairs_among_many_documents_apart(spark, monkeypatch, n, most, least):
    """Documents at 0.7 to each other, and among them pairs at 0.8 to 0.85: nodes that branch on for many levels, and a
    few levels with the constants as they are."""
    if most:
        monkeypatch.setattr(near_dedup, "MOST", most)
    rng = random.Random(19)
    rows = [r for i in range(2) for r in ((j + i * n, t.replace("o", f"o{i}").replace("p", f"p{i}")) for j, t in apart(n // 2, rng, new=12 - 3 * i))]
    sets = {i: runs(t, 2) for i, t in rows}
    pairs = [(i, i + 1) for i in range(0, 2 * (n // 2) * 2, 2)]
    assert all(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in pairs[:50] + pairs[-50:])
    assert all(100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j]) for i in range(20) for j in range(len(sets) - 20, len(sets)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    found = sum(got[j] == got[i] for i, j in pairs)
    print(f"{found} of {len(pairs)} pairs found")
    assert found >= least * len(pairs)


def test_documents_still_apart_at_the_deepest_level(spark, monkeypatch):
    """No level of branching is left: all pairs are found under the rarest shingles, and in blocks where many share one."""
    monkeypatch.setattr(near_dedup, "MOST", 12)
    monkeypatch.setattr(near_dedup, "DEEPEST", near_dedup.DEPTH + 1)
    rows = list(apart(300, random.Random(23)))
    asked, rarest = [], near_dedup._rarest

    def seen(*args):
        out = rarest(*args)
        asked.append((args[0].select("rep").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "_rarest", seen)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == joined({i: runs(t, 2) for i, t in rows})
    assert asked and all(n_rows <= 26 * n for n, n_rows in asked)  # of about 120 shingles a fifth and one


def test_similar_sets_stay_together_in_deep_trees():
    """Pairs of sets at 0.8 exactly, down the trees with the constants as they are: how many share a node of some tree."""
    rng, pairs = np.random.default_rng(29), 1200
    hashes = np.empty((2, pairs, near_dedup.COORDINATES), np.uint32)
    for i in range(pairs):
        own = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        for side, part in enumerate((own[:90], own[10:])):
            hashes[side, i] = ((part[:, None] * near_dedup._FACTORS).min(axis=0) >> np.uint64(32)).astype(np.uint32)
    schema = ["node", "rep", "weight", "hashes"]

    def met(batches):
        """node and pair of the nodes that both of a pair have."""
        nodes = [{(n, r) for b in batches(side) for n, r in zip(b.column("node").to_pylist(), b.column("rep").to_pylist(), strict=True)} for side in (0, 1)]
        return sorted(nodes[0] & nodes[1])

    def batch(side, entries):
        reps = [r for _, r in entries]
        columns = [pa.array([n for n, _ in entries], pa.int64()), pa.array(reps, pa.int64()), pa.array([1] * len(reps), pa.int64()), pa.array([hashes[side, r].tobytes() for r in reps], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema)

    entries = met(lambda side: near_dedup._roots([batch(side, [(0, r) for r in range(pairs)])]))
    found = {near_dedup.DEPTH: len({r for _, r in entries}) / pairs}
    for depth in range(near_dedup.DEPTH + 1, 17):
        entries = met(lambda side, entries=entries: near_dedup._children([batch(side, entries)]))
        found[depth] = len({r for _, r in entries}) / pairs
    print({d: (round(found[d], 3), round(near_dedup.recall(d), 3)) for d in (3, 6, 9, 12, 16)})
    assert found[3] >= 0.999 and found[near_dedup.DEEPEST] >= 0.97


def test_heavy_documents_are_compared_in_parts(spark, monkeypatch):
    """Few documents with more shingles than a group may have."""
    monkeypatch.setattr(near_dedup, "HEAVY", 3000)
    rng = random.Random(31)
    base = [[f"b{b}w{k}" for k in range(2000)] for b in range(3)]
    rows = []
    for i in range(24):
        own = list(base[i % 3])
        for _ in range(rng.randrange(1, 250)):
            own[rng.randrange(2000)] = f"x{rng.randrange(10**7)}"
        rows.append((i, " ".join(own)))
    want = joined({i: runs(t, 2) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == want and len(set(want.values())) > 3


def test_components(spark):
    from tidemark.llm._common import Scratch
    from tidemark.llm.components import components

    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 2000)] + [(9000, 9000 - k) for k in range(1, 1500)]
    odd = [(9, 9), (None, 4), (7000, 7001), (7001, 7000), (7000, 7001)]
    links = spark.createDataFrame(chain + star + odd, "a long, b long")
    rows = components(links, Scratch(spark, "test")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got) and all(got[i] == 0 for i in range(301))
    assert all(got[1000 + k] == 1000 for k in range(2000)) and all(got[9000 - k] == 7501 for k in range(1500))
    assert got[7001] == got[7000] == 7000 and len(got) == 301 + 2000 + 1500 + 2
    assert components(links.limit(0), Scratch(spark, "test")).count() == 0


def test_bm25_passages(spark, sf_dir, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    index = decontaminate.Index.build([(r["item_id"], *decontaminate.split_item(r["text"])) for r in items])
    size = decontaminate.PIECE
    _, _, h, bounds = next(_words.documents(pa.array(list(texts.values()))))
    for threshold in (0.15, 0.5):
        want = {}
        for r in range(len(bounds) - 1):
            own = h[bounds[r] : bounds[r + 1]]
            for k in range(max(1, -(-len(own) // size) - 1)):
                score = np.zeros(len(index.item_of))
                for t in np.unique(own[k * size : (k + 2) * size]):
                    p = int(np.searchsorted(index.terms, t))
                    if p < len(index.terms) and index.terms[p] == t:
                        at = slice(index.bounds[p], index.bounds[p + 1])
                        score[index.pieces[at]] += index.impacts[at]
                for piece in np.flatnonzero(score >= threshold):
                    key = (r, int(index.item_of[piece]))
                    want[key] = max(want.get(key, 0), score[piece])
        row, item, score = index.passages(h, bounds, threshold)
        got = {(int(a), int(b)): s for a, b, s in zip(row, item, score)}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_planted_items_are_found_and_clean_ones_left(spark, sf_dir, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rng, rows, planted = random.Random(1), [], set()
    clean = [t for t in texts.values() if len(t) > 1500 and not any(x in t for x in items.values())][:60]
    for i, t in enumerate(clean):
        if i % 2:
            w, item = t.split(" "), rng.choice(list(items))
            at = rng.randrange(len(w))
            t = " ".join([*w[:at], items[item], *w[at:]])
            planted.add((i, item))
        rows.append((i, t))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted


def test_secrets(docs, texts):
    planted = dict(texts) | {-1: "x AKIA" + "Z9" * 9 + ' é secret : "abc" api_key=abcdef ' + "0f" * 12 + "g " + "-----BEGIN RSA PRIVATE KEY-----"}
    spark = docs.sparkSession
    out = secrets.find_secrets(spark.createDataFrame(list(planted.items()), "doc_id long, text string")).collect()
    for r in out:
        spans = sorted((m.start(), k, m.end()) for k, rule in enumerate(secrets.RULES) for m in rule.regex.finditer(planted[r["doc_id"]]) if m.end(rule.group) - m.start(rule.group) >= rule.least)
        joined = lambda s: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in s)
        assert r["spans"] == joined(spans)
        assert r["base_sha256"] == hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest()
    assert any(r["n_access"] for r in out)


def test_every_rule_is_found_through_its_trigrams():
    samples = ["my PassWd='abcdef'", "token=abcdef1", "AKIA" + "Q" * 16, "-----BEGIN PRIVATE KEY-----", "eyJabcdefgh.abcdefgh.abcdefgh", "xoxb-1234567890", "AIza" + "x" * 35, "sk_live_" + "1" * 16, "Bearer " + "t" * 16, "https://a:bcd@"]
    index = secrets.TrigramIndex([secrets.trigram_query(r) for r in secrets.RULES])
    data = [s.encode() for s in samples]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    postings = index.postings(np.frombuffer(b"".join(data), np.uint8), offsets)
    for rule in secrets.RULES:
        left = index.texts(secrets.trigram_query(rule), postings)
        assert all(left[i] for i, s in enumerate(samples) if rule.regex.search(s))


def test_tokens_equal_the_library(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = {-1: "a  b\t\n c <|endoftext|> it's", -2: "日本語 😀 x\x1cy \x85z", -3: "ab cd \n" * 9000, -4: "é" * 3000}
    both = dict(texts) | odd
    library = Tokenizer.from_file(path)
    for r in token_counts.token_counts(docs.sparkSession.createDataFrame(list(both.items()), "doc_id long, text string"), path).collect():
        assert r["n_tokens"] == len(library.encode(both[r["doc_id"]], add_special_tokens=False)) and r["n_bytes"] == len(both[r["doc_id"]].encode())


@pytest.mark.parametrize("module, label, fold, held", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_scores_on_labels_held_out(spark, module, label, fold, held):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    score = module.quality_scores if module is quality else module.toxicity_scores
    out = [r for r in score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % fold == held for r in out)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["doc_id"] in labels]
    assert sum(p == y for p, y in known) >= 0.93 * len(known)


def test_network_gradients():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) * 2 for k, v in net.p.items()}
    inputs, index = rng.standard_normal((7, 2 * toxicity.DIM)), rng.integers(0, 8, (3, toxicity.WINDOW))

    def table():
        out = np.zeros((8, 6 * toxicity.HIDDEN))
        out[:-1] = inputs @ net.p["x"] + net.p["bx"]
        out[-1, : toxicity.HIDDEN] = out[-1, 3 * toxicity.HIDDEN : 4 * toxicity.HIDDEN] = 30
        return out

    made = table()
    _, trace, pooled = net.run(made, index, keep=True)
    g, _ = net.gradients(index, inputs, made, trace, pooled, np.ones(3))
    for k in ("x", "uf", "ub", "att", "out"):
        v, at = net.p[k], tuple(rng.integers(0, n) for n in net.p[k].shape)
        v[at] += 1e-5
        up = net.run(table(), index)[0].sum()
        v[at] -= 2e-5
        down = net.run(table(), index)[0].sum()
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


def test_mixing_comes_near_its_targets(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(s == len(SPACE.findall(texts[i])) for i, s in zip(out.doc_id, out["size"]))
    per = out.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(per.taken - per.target) <= 0.01 * per.target + 50).all() and (out.taken <= 3 * out["size"]).all()
    assert abs(per.target.sum() - out["size"].sum()) < 1


def test_targets_stop_at_three_times_a_source(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (1000, "b"), (1000, "c"), (5, None)])]
    out = {r["source_size"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[10] == 30 and out[5] == 15 and sum(r for r in {30.0, 15.0}) == 45
    both = [r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["source_size"] == 1000]
    assert sorted(round(x, 6) for x in both) == [round((2015 - 45) * 2 / 5, 6), round((2015 - 45) * 3 / 5, 6)]


def test_shared_passages_go_and_nothing_else(spark, texts):
    rng = random.Random(2)
    plain = [t for t in texts.values() if 1500 < len(t) < 9000 and not re.search(r" \| |\*\*\*|!!", t)]
    plain = list(dict.fromkeys(plain))
    common = Counter(s for t in plain for s in set(re.split(r"(?<=[.!?,;:\n])\s*", t)) if len(s) > 30)
    plain = [t for t in plain if not any(common[s] > 1 for s in set(re.split(r"(?<=[.!?,;:\n])\s*", t)))]
    passage = [" ".join(t.split(" ")[100:165]) for t in plain[:2]]
    rows, hit = [], defaultdict(list)
    for i, t in enumerate(plain[2:14]):
        if i < 8:
            w = t.split(" ")
            at = rng.randrange(len(w))
            t = " ".join([*w[:at], passage[i % 2], *w[at:]])
            hit[i % 2].append(i)
        rows.append((i, t))
    out = {r["doc_id"]: r for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    later = {i for own in hit.values() for i in own[1:]}
    assert {i for i, r in out.items() if r["n_removed"]} == later
    for i, t in rows:
        if i not in later:
            assert out[i]["text"] == t
        else:
            assert passage[i % 2] not in out[i]["text"] and out[i]["removed_chars"] > 64


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, n):
    """n words in clauses of 4 to 18 words."""
    out, left = words_of(rng, n), 0
    for i in range(n):
        if left == 0:
            left = rng.randint(4, 18)
        left -= 1
        if left == 0:
            out[i] += rng.choice(",,,.;:")
    return out


def test_most_pasted_passages_are_found(spark):
    rng, rows = random.Random(7), []
    for i in range(400):
        passage = prose(rng, rng.randint(51, 65))
        for k in range(2):
            host = prose(rng, 120)
            at = rng.randrange(20, 100)
            rows.append((2 * i + k, " ".join([*host[:at], *passage, *host[at:]])))
    out = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(r["n_removed"] for r in out if r["doc_id"] % 2 == 0)
    found = sum(r["n_removed"] > 0 for r in out if r["doc_id"] % 2)
    print(f"{found} of 400 passages of 51 to 65 words found")
    assert found >= 340


def test_repeats_within_one_document_go(spark):
    rng = random.Random(11)

    def text(*parts):
        return "\n".join([*parts, ""])

    def own():
        return " ".join(prose(rng, 60))

    p, q, r = (" ".join(prose(rng, 80)) for _ in range(3))
    a, b, c, d = own(), own(), own(), own()
    rows = [(1, text(own(), p, a, p, b, p)), (2, text(own(), q)), (2, text(own(), q)), (None, text(own(), r)), (None, text(own(), r)), (3, text(own(), r)), (4, text(c)), (5, text(d)), (5, text(d))]
    out = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    one = next(x for x in out if x["doc_id"] == 1)
    inner = " ".join(p.split(" ")[20:-20])
    assert one["text"].startswith(rows[0][1][: rows[0][1].index(a)]) and one["text"].count(inner) == 1 and a[20:-20] in one["text"] and b[20:-20] in one["text"]
    for i, x in ((2, q), (None, r)):
        assert sum(" ".join(x.split(" ")[20:-20]) in y["text"] for y in out if y["doc_id"] == i) == 1
    assert sorted(x["n_removed"] > 0 for x in out if x["doc_id"] is None) == [False, True]
    assert next(x for x in out if x["doc_id"] == 3)["n_removed"] > 0
    assert not any(x["n_removed"] for x in out if x["doc_id"] in (4, 5))


def test_passages_of_short_lines_go(spark):
    rng, rows, lists = random.Random(13), [], []
    for i, make in enumerate((lambda: str(rng.randrange(1000, 10000)), lambda: str(rng.randrange(10)), lambda: rng.choice("abcdefghij") * rng.randint(1, 4))):
        for end in (", ", "\n"):
            lists.append(end.join(make() for _ in range(60)) + end)
            for k in range(2):
                rows.append((len(rows), " ".join(prose(rng, 60)) + ".\n" + lists[-1] + " ".join(prose(rng, 60))))
    out = {r["doc_id"]: r for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, shared in enumerate(lists):
        assert out[2 * n]["text"] == rows[2 * n][1]
        assert out[2 * n + 1]["n_removed"] >= 52, (n, out[2 * n + 1]["n_removed"])
        assert out[2 * n + 1]["removed_chars"] <= len(shared)


def test_a_long_document_of_short_lines(spark):
    rng = random.Random(17)
    once = "\n".join(str(rng.randrange(10**9)) for _ in range(4_000)) + "\n"
    r = line_dedup.line_report(spark.createDataFrame([(1, once * 5)], "doc_id long, text string")).first()
    assert once[:-200] in r["text"] and len(r["text"]) < 1.01 * len(once)


def test_a_passage_of_17_words_lies_whole_in_a_window():
    first, end, row = toxicity._windows(np.array([0, 10, 10, 210]))
    assert set(row) == {0, 2} and first[0] == 0 and end[0] == 10
    for at in range(10, 210 - 16):
        assert any(f <= at and at + 17 <= e for f, e in zip(first, end, strict=True))


def test_leaks_are_the_same_in_parts(spark, monkeypatch):
    rng = random.Random(23)
    vocabulary = words_of(rng, 150)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 120))), " ".join(rng.choice(vocabulary) for _ in range(400))) for i in range(24)]
    docs = spark.createDataFrame([(i, f"{q} {a} " + " ".join(rng.choice(vocabulary) for _ in range(50))) for i, q, a in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")

    def found():
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.find_leaks(docs, bench, answer_col="answer").collect())

    built, build = [], decontaminate.Index.build
    monkeypatch.setattr(decontaminate.Index, "build", staticmethod(lambda *a: built.append(build(*a)) or built[-1]))
    one = found()
    whole = built.pop()
    monkeypatch.setattr(decontaminate, "MOST_PIECES", 150)
    assert one == found() and len(one) >= 24 and len(built) > 1
    impact = {(whole.items[whole.item_of[p]][0], int(t)): x for t, p, x in zip(np.repeat(whole.terms, np.diff(whole.bounds)), whole.pieces, whole.impacts, strict=True)}
    for index in built:
        once = Counter((index.items[index.item_of[p]][0], int(t)) for t, p in zip(np.repeat(index.terms, np.diff(index.bounds)), index.pieces, strict=True))
        for t, p, x in zip(np.repeat(index.terms, np.diff(index.bounds)), index.pieces, index.impacts, strict=True):
            k = index.items[index.item_of[p]][0], int(t)
            assert once[k] > 1 or abs(impact[k] - x) < 1e-9


def test_distinct_words_of_whole_texts():
    rng = random.Random(29)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 4) for _ in range(n)) for n in (0, 1, 30, 64, 65, 300)]
    texts.append(" ".join([f"w{i}" for i in range(64)] + ["same"] * 300))
    got = quality.features(pa.array(texts))[:, quality.FEATURES.index("distinct_64")]
    for t, x in zip(texts, got, strict=True):
        w = SPACE.findall(t)
        shares = [len(set(w[i : i + 64])) / len(w[i : i + 64]) for i in range(max(1, len(w) - 63)) if w]
        assert abs(x - (sum(shares) / len(shares) if shares else 0)) < 1e-9
