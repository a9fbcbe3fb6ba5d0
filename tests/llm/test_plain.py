"""Operators computed again in plain Python, on small inputs."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute import ascii_lower, docs, joined, prose, runs, texts  # noqa: F401
from tidemark.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, secrets, toxicity, url_filter
from tidemark.llm import _words as W

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value % 2**64).to_bytes(8, "little")
    return xxhash.xxh64(data, seed=seed).intdigest()


def chunked(lines):
    """(first line, end) of every chunk."""
    h, n = [hashed(x) for x in lines], len(lines)
    ends = [i for i in range(n + 1) if i in (0, n) or (i >= 2 and hashed(h[i - 1], hashed(h[i - 2])) % line_dedup.JOINED)]
    upto = [0, *itertools.accumulate(map(len, lines))]
    for k, a in enumerate(ends):
        found = next((e for e in ends[k + 1 : k + 200] if e >= a + 2 and upto[e] - upto[a] >= line_dedup.LEAST_CHARS), None)
        if found is not None and a < n - 1:
            yield a, found


def without_repeats(rows):
    """What stays of each text: every chunk but its first occurrence goes."""
    signed = lambda t: (hashed(t) + 2**63) % 2**64 - 2**63
    texts = {(i, t) for i, t in rows}
    lines = {x: re.split(r"(?<=[.!?,;:] )|(?<=\n)", x[1]) for x in texts}
    seen = defaultdict(list)
    for x in texts:
        for a, e in chunked(lines[x]):
            seen[tuple(lines[x][a:e])].append((x[0] is not None, x[0] or 0, signed(x[1]), a, e, x))
    gone = defaultdict(set)
    for own in seen.values():
        for *_, a, e, x in sorted(own, key=lambda o: o[:5])[1:]:
            gone[x].update(range(a, e))
    return {x: ("".join(line for i, line in enumerate(lines[x]) if i not in gone[x]), len(gone[x])) for x in texts}


def test_lines_as_in_plain_python(spark, sf_dir):
    rng = random.Random(41)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    shared = [" ".join(prose(rng, rng.randint(20, 90))) + rng.choice([" ", "\n", ". "]) for _ in range(12)]
    for i in range(120):
        rows.append((10_000 + i % 100, "".join(rng.choice(shared) if rng.random() < 0.5 else " ".join(prose(rng, rng.randint(5, 60))) + rng.choice([" ", "\n"]) for _ in range(rng.randint(1, 7)))))
    rows += [(None, shared[0] + "x\n" * 90), (None, "x\n" * 60 + shared[1]), (20_000, "a, " * 300), (20_001, "a, " * 299), (20_002, rows[0][1]), (20_002, rows[0][1]), (20_003, "p\x01q. " * 40)]
    long = [f"line {rng.randrange(10**9)}\n" for _ in range(50_000)]
    rows += [(30_000, "".join(long)), (30_001, "".join(long[:20_000] + ["another line\n"] * 3 + long[20_000:]))]
    want = without_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.col("text"))
    began = time.time()
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.line_report(df).collect()]
    print(f"{time.time() - began:.1f} s")
    assert Counter(got) == Counter((i, *want[i, t]) for i, t in rows)
    assert sum(n for _, _, n in got) > 50_000


def test_exact_groups_of_a_hot_text(spark):
    rows = [(i, "Same Text" if i % 3 == 0 else f"text {i}") for i in range(6000)] + [(1, "TEXT 1"), (6001, None), (6002, "")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t or "")].append(i)
    assert got == {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def rates(sizes, target):
    """Copies of each size by bisection on the multiplier."""
    top = mixing.MOST_COPIES
    if target >= sum(sizes) * top * (1 - 1e-9):
        return [float(top)] * len(sizes)
    lo, hi = -50.0, 50.0
    scale = sum(s * s for s in sizes) / sum(sizes)
    for _ in range(200):
        lam = (lo + hi) / 2
        got = sum(s * math.exp(min(lam * s / scale, math.log(top))) for s in sizes)
        lo, hi = (lam, hi) if got < target else (lo, lam)
    return [math.exp(min(lo * s / scale, math.log(top))) for s in sizes]


def held_against_rates(docs, got):
    """got, what the mix gives for docs (id, size, source): targets, each source's sum, and the copies of each size."""
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(n for _, n, x in docs if x == s) for s in sources}
    full, target = set(), {}
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        over = {s for s in sources if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    of = {i: s for i, _, s in docs}
    taken = dict(zip(got.doc_id, got.taken, strict=True))
    assert set(taken) == set(of) and len(got) == len(docs)
    assert all(abs(t - target[of[i]]) < 1e-6 * target[of[i]] for i, t in zip(got.doc_id, got.target, strict=True))
    for s in sources:
        own = [(i, n) for i, n, x in docs if x == s]
        exact = dict(zip((n for _, n in own), rates([n for _, n in own], target[s])))
        assert abs(sum(taken[i] for i, _ in own) - target[s]) <= max(n for _, n in own) / 2
        copies, many = Counter(), Counter(n for _, n in own)
        for i, n in own:
            copies[n] += taken[i] // n if n else 0
        odd = [n for n in many if n and abs(copies[n] - many[n] * exact[n]) > 1 + 1e-3]
        assert len(odd) <= mixing.EACH * max(n for _, n in own).bit_length()  # a few classes in each power of two make up for rounding
    return taken


def test_rates_and_copies_as_in_plain_python(spark, sf_dir):
    rng = random.Random(43)
    docs = [(r["doc_id"], len(SPACE.findall(r["text"] or "")), r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10_000 + i, rng.randint(1, 400), rng.choice(["tiny", None, "zz"])) for i in range(400)] + [(20_000, 3, "a")]
    df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in docs], "doc_id long, text string, source string")
    taken = held_against_rates(docs, mixing.mix(df).toPandas())
    again = mixing.mix(df.repartition(7)).toPandas()
    assert dict(zip(again.doc_id, again.taken, strict=True)) == taken


def test_rules_take_time_in_proportion(spark):
    texts = {"jwt": "eyJ" * 1_700_000, "dots": "eyJ." * 1_200_000, "hex": "0f0f0f" * 800_000 + "g", "token": "token " * 800_000, "spaces": "secret" + " " * 5_000_000, "begin": "-----BEGIN " + "A " * 2_400_000, "login": "a" * 5_000_000 + "://", "bearer": "bearer " * 700_000, "access": "AKIA" * 1_200_000}
    for name, text in texts.items():
        began = time.time()
        for rule in secrets.RULES:
            secrets.spans_of(rule, secrets._long_runs(rule) or rule.regex, text)
        assert time.time() - began < 20, name
    df = spark.createDataFrame(list(enumerate([texts["jwt"], texts["access"], "x " + "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9])), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_access"], r["spans"]) for r in secrets.find_secrets(df).collect()}
    assert got == {0: (0, ""), 1: (1, "access:0:4800000"), 2: (0, "jwt:2:34")}


def plain_logit(net, words):
    """The network's logit of one window, a word at a time."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    H, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        _, _, h = W.words(data)
        grams = toxicity._grams(data, np.array([0]), np.array([len(data)]))
        vectors = [p["grams"][r] for rows, _ in grams for r in rows]
        inputs.append(np.concatenate([p["words"][toxicity._word_rows(h)[0]], sum(vectors) / max(1, len(vectors))]))
    states = []
    for side, u in ((0, "uf"), (1, "ub")):
        h, own = np.zeros(H), [None] * len(words)
        for t in range(len(words)) if side == 0 else reversed(range(len(words))):
            x = (inputs[t] @ p["x"] + p["bx"])[3 * H * side : 3 * H * (side + 1)]
            hu = h @ p[u]
            z, r = sig(x[:H] + hu[:H]), sig(x[H : 2 * H] + hu[H : 2 * H])
            c = np.tanh(x[2 * H :] + r * hu[2 * H :])
            h = own[t] = z * h + (1 - z) * c
        states.append(own)
    both = [np.concatenate([a, b]) for a, b in zip(*states)]
    weigh = np.exp([s @ p["att"] for s in both])
    return float(sum(w * (s @ p["out"]) for w, s in zip(weigh, both)) / weigh.sum() + p["b"][0])


def test_toxicity_is_the_highest_window(spark, sf_dir):
    net, rng = toxicity.Network(), random.Random(5)
    for k in ("words", "grams"):
        net.p[k] *= 20
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() if r["text"]]
    texts = [" ".join(SPACE.findall(ascii_lower(t))[: rng.choice([1, 7, 31, 32, 33, 49, 90])]) for t in texts][:24]
    got = net.texts(pa.array(texts))
    for t, x in zip(texts, got, strict=True):
        w = t.split(" ")
        starts = [0, *(k for k in range(toxicity.STRIDE, len(w), toxicity.STRIDE) if k + toxicity.WINDOW - toxicity.STRIDE < len(w))]
        assert abs(max(plain_logit(net, w[k : k + toxicity.WINDOW]) for k in starts) - x) < 1e-3


def test_quality_adds_up_its_tables():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float))
    new = rng.standard_normal((50, len(quality.FEATURES)))
    for row, score in zip(new, model.scores(new), strict=True):
        bins = [sum(1 for e in edges if e <= v) for v, edges in zip(row, model.edges, strict=True)]
        z = model.prior + sum(float(t[b]) for t, b in zip(model.tables, bins, strict=True))
        coarse = [b * quality.PAIR_BINS // (len(e) + 1) for b, e in zip(bins, model.edges, strict=True)]
        z += sum(float(t[coarse[i], coarse[j]]) for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9
    assert len(model.pairs) and np.mean((model.scores(x) > 0.5) == (x[:, 0] + x[:, 1] * x[:, 2] > 0.3)) > 0.85


def test_urls_that_the_model_has_not_seen(spark):
    """A fifth of the labelled table at a time is left out of training."""
    right = 0
    for fold in range(5):
        learnt = [x for k, x in enumerate(url_filter.LABELLED) if k % 5 != fold]
        asked = [x for k, x in enumerate(url_filter.LABELLED) if k % 5 == fold]
        pages = spark.createDataFrame([(k, "http://" + u) for k, (u, _) in enumerate(asked)], "page_id long, url string")
        out = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules=(), labelled=learnt).collect()}
        right += sum((out[k]["verdict"] == "block") == bool(y) for k, (_, y) in enumerate(asked))
        if fold == 0:
            bias, weights = url_filter.fit(spark, learnt)
            for k, (u, _) in enumerate(asked):
                host, _, path = u.partition("/")
                grams = {(part, text[i : i + n]) for part, text in (("host", f"^{host}$"), ("path", f"/{path}$")) for n in url_filter.GRAMS for i in range(max(1, len(text) - n + 1))}
                own = {(hashed(g, hashed(part)) + 2**63) % 2**64 - 2**63 for part, g in grams}
                buckets = {h % url_filter.BUCKETS for h in own}
                z = bias + sum(weights[b] for b in buckets) / math.sqrt(len(buckets))
                assert abs(out[k]["score"] - 1 / (1 + math.exp(-z))) < 1e-3
    print(f"{right} of {len(url_filter.LABELLED)} unseen urls right")
    assert right >= 0.8 * len(url_filter.LABELLED)


def test_stages_as_in_plain_python(spark, sf_dir):
    """Lines and near duplicates of the pipeline on the documents that quality keeps, whole table."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = stages["quality"](spark, docs, sf_dir)
    model = quality.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    scores = model.scores(quality.features(pa.array(list(texts.values()))))
    kept = {i: t for (i, t), x in zip(texts.items(), scores, strict=True) if x >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good.select("doc_id").collect()} == set(kept)
    want = {i: t for (i, _), (t, n) in without_repeats(list(kept.items())).items() if not n or SPACE.search(t)}
    cut = stages["lines"](spark, good, sf_dir)
    assert {r["doc_id"]: r["text"] or "" for r in cut.select("doc_id", "text").collect()} == want
    groups = joined({i: runs(t, near_dedup.WORDS) for i, t in sorted(want.items()) if SPACE.search(t)})
    one = stages["near"](spark, cut, sf_dir)
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {i for i in want if groups.get(i, i) == i}


def leaked(texts, items):
    """{(text, item): (score, question overlap, answer overlap)} over every passage, from the words themselves.

    texts: id -> text, items: id -> (question, answer).
    """
    words, size = lambda t: SPACE.findall(ascii_lower(t)), decontaminate.PIECE
    pieces = []
    for item, parts in items.items():
        w = [x for p in parts for x in words(p)]
        pieces += [(item, w[max(0, min(k, len(w) - size)) : k + size]) for k in range(0, len(w), size)]
    among, mean = Counter(x for _, p in pieces for x in set(p)), sum(len(p) for _, p in pieces) / len(pieces)
    postings = defaultdict(list)
    for at, (_, p) in enumerate(pieces):
        k1, b = decontaminate.K1, decontaminate.B
        own = {x: math.log1p((len(pieces) - among[x] + 0.5) / (among[x] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(p) / mean)) for x, n in Counter(p).items()}
        for x, v in own.items():
            postings[x].append((at, v / sum(own.values())))
    found = {}
    for i, text in texts.items():
        w, best, has = words(text), {}, runs(text, decontaminate.RUN)
        for k in range(max(1, -(-len(w) // size) - 1)):
            score = Counter()
            for x in set(w[k * size : (k + 2) * size]):
                for at, v in postings.get(x, ()):
                    score[at] += v
            for at, v in score.items():
                if v >= decontaminate.THRESHOLD:
                    best[pieces[at][0]] = max(v, best.get(pieces[at][0], 0))
        for item, v in best.items():
            each = [runs(p, decontaminate.RUN) for p in items[item]]
            q, a = (len(x & has) / len(x) if x else 1.0 for x in each)
            if q >= decontaminate.OVERLAP and a >= decontaminate.OVERLAP:
                found[i, item] = (v, q, a)
    return found


def test_leaks_and_mix_as_in_plain_python(spark, sf_dir):
    """op7's whole result, with whole items, questions alone, answers alone and parts of both pasted into texts; then the
    pipeline's last two stages on the same documents."""
    rng = random.Random(37)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.split_item(r["text"] or "") for r in bench.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    clean = [r for r in rows if r["text"] and len(r["text"]) > 600]
    ways = [lambda q, a: (q, a), lambda q, a: (q,), lambda q, a: (a,), lambda q, a: (q[: len(q) * 2 // 3], a), lambda q, a: (q, a[: len(a) // 3]), lambda q, a: (q, "x y z " * 40, a)]
    for k in range(120):
        own, item = dict(rng.choice(clean)), rng.choice(list(items))
        w = own["text"].split(" ")
        at = rng.randrange(len(w))
        own["doc_id"], own["text"] = 100_000 + k, " ".join([*w[:at], *ways[k % len(ways)](*items[item]), *w[at:]])
        rows.append(own)
    df = spark.createDataFrame(rows, docs.schema)
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len(texts) == len(rows)
    want = leaked(texts, items)
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == set(want)
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    planted = {i for i, _ in want if i >= 100_000}
    assert 20 <= len(planted) < 120  # some of the ways leak, others don't
    stages = dict(corpus_pipeline.STAGES)
    left = stages["leaks"](spark, df, sf_dir)
    assert Counter(map(tuple, left.collect())) == Counter(tuple(r[c] for c in docs.columns) for r in rows if r["doc_id"] not in {i for i, _ in want})
    kept = [(r["doc_id"], len(SPACE.findall(r["text"] or "")), r["source"]) for r in left.collect()]
    held_against_rates(kept, stages["mix"](spark, left, sf_dir).toPandas())


def test_urls_of_words_that_the_model_has_not_seen(spark):
    """A fourth of the table's words at a time, with every url that any of them stands in, is left out of training."""
    words, right, asked_ = (*url_filter._BLOCKED, *url_filter._LEFT), 0, 0
    for fold in range(4):
        gone = words[fold::4]
        learnt = [x for x in url_filter.LABELLED if not any(w in x[0] for w in gone)]
        asked = [x for x in url_filter.LABELLED if any(w in x[0] for w in gone)]
        pages = spark.createDataFrame([(k, "http://" + u) for k, (u, _) in enumerate(asked)], "page_id long, url string")
        out = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules=(), labelled=learnt).collect()}
        right += sum((out[k]["verdict"] == "block") == bool(y) for k, (_, y) in enumerate(asked))
        asked_ += len(asked)
    print(f"{right} of {asked_} urls of unseen words right")
    assert right > 0.5 * asked_  # letters tell little of a word that was never seen


def test_quality_features_as_in_plain_python(texts):
    """All features of every text, and of some odd ones, from the characters themselves."""
    symbols, size = set(b"#$%&*+/<=>@[\\]^_`{|}~!"), 64
    odd = ["", " \n\t", "é" * 40, "A a A\nb, B. !x x! 1 22 # #", "same Same SAME " * 90, "a" * 200_000, " ".join(f"W{i % 700}é" for i in range(5000))]
    own = [t or "" for t in texts.values()] + odd
    got = quality.features(pa.array(own))
    assert got.shape == (len(own), len(quality.FEATURES))
    for text, row in zip(own, got, strict=True):
        data = text.encode()
        w = SPACE.findall(ascii_lower(text))
        n, length = max(1, len(w)), max(1, len(data))
        count = lambda f, data=data: sum(map(f, data))
        upper = count(lambda b: 65 <= b <= 90)
        windows = [w[k : k + size] for k in range(max(1, len(w) - size + 1)) if w]
        want = {
            "words": math.log1p(len(w)),
            "word_bytes": sum(len(x.encode()) for x in w) / n,
            "upper": upper / max(1, upper + count(lambda b: 97 <= b <= 122)),
            "symbols": count(lambda b: b in symbols) / length,
            "symbol_ends": sum(x.encode()[-1] in symbols for x in w) / n,
            "digits": count(lambda b: 48 <= b <= 57) / length,
            "beyond_ascii": count(lambda b: b >= 128) / length,
            "stops": count(lambda b: b in b".,;:?!") / n,
            "line_ends": text.count("\n") / n,
            "repeats": sum(a == b for a, b in itertools.pairwise(w)) / n,
            "distinct": len(set(w)) / n,
            "distinct_64": sum(len(set(x)) / len(x) for x in windows) / max(1, len(windows)),
            "single": sum(len(x.encode()) == 1 for x in w) / n,
        }
        assert all(abs(want[f] - x) < 1e-9 for f, x in zip(quality.FEATURES, row, strict=True)), text[:80]
