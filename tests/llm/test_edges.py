"""Every operator on messy and on empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import LONG
from tidemark.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, secrets, token_counts, toxicity, url_filter


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(messy, empty):
    r = by_id(exact_dedup.exact_dedup(messy))
    assert exact_dedup.exact_dedup(messy).count() == messy.count()
    assert r[1]["keep_id"] == r[2]["keep_id"] == r[None]["keep_id"] == 8 and r[8]["kept"] and not r[None]["kept"] and r[1]["group_size"] == 4
    assert r[3]["keep_id"] == 4 and r[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert r[5]["kept"] and r[5]["group_size"] == 2 and r[5]["text_sha256"] == hashlib.sha256(LONG.lower().encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_in_ranges_is_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    assert one == sorted(map(tuple, exact_dedup.exact_dedup(docs, max_filter_bytes=64).collect()))


def test_exact_holds_one_filter_at_a_time(spark, sf_dir, monkeypatch):
    alive, most, made = [], [], type(spark.sparkContext).broadcast

    def broadcast(context, value):
        held = made(context, value)
        gone = held.destroy
        held.destroy = lambda *a: (alive.remove(held), gone(*a))
        alive.append(held)
        most.append(len(alive))
        return held

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    out = exact_dedup.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_filter_bytes=64)
    assert len(most) >= 3 and set(most) == {1} and not alive and out.count() == 200


def test_quality(messy, empty, labels):
    out = quality.quality_scores(messy, labels)
    assert out.count() == messy.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(messy, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(messy, labels.limit(0)).columns == messy.columns


def test_toxicity(messy, empty, labels):
    out = toxicity.toxicity_scores(messy, labels)
    assert out.count() == messy.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(messy, labels.limit(0)).collect()} == {0.5}


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "http://example.net?x"), (3, None), (4, "no scheme"), (5, "x://sub.org/fr/1://2"), (6, ""), (None, "http://b.net/"), (7, "http://example.com/de"), (8, "http://" + "a" * 50_000)]
    rows.append(rows[0])
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, verdict string, host string")
    assert url_filter.filter_urls(pages).count() == len(rows)  # the repeated row counts twice
    r = {x["page_id"]: x for x in url_filter.filter_urls(pages).collect()}
    assert (r[1]["host"], r[1]["path"], r[1]["rule"], r[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (r[2]["host"], r[2]["path"], r[2]["rule"]) == ("example.net", "", None)
    assert (r[3]["host"], r[3]["path"], r[3]["verdict"]) == ("", "", r[4]["verdict"]) == (r[6]["host"], r[6]["path"], r[6]["verdict"])
    assert (r[5]["host"], r[5]["path"], r[5]["rule"]) == ("sub.org", "/fr/1://2", "org/fr/")
    assert r[None]["rule"] == "net/" and r[7]["rule"] is None and len(r[8]["host"]) == 50_000
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_model_tells_its_table(spark):
    rows = [(i, "http://" + u) for i, (u, _) in enumerate(url_filter.LABELLED)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=()).collect()
    want = [y for _, y in url_filter.LABELLED]
    assert sum((r["verdict"] == "block") == bool(want[r["page_id"]]) for r in out) >= 0.95 * len(want)


def test_mixing(messy, empty):
    out = mixing.mix(messy)
    assert out.count() == messy.count() and out.filter("taken > 3 * size or taken < 0").count() == 0
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, mixing.mix(messy).collect())) == sorted(map(str, out.collect()))


def test_near(messy, empty):
    r = by_id(near_dedup.near_groups(messy, words=2))
    assert near_dedup.near_groups(messy, words=2).count() == messy.count()
    assert r[1]["component_id"] == r[2]["component_id"] == r[8]["component_id"] == 1 and r[1]["kept"] and not r[8]["kept"]
    assert r[3]["n_shingles"] == r[4]["n_shingles"] == r[6]["n_shingles"] == 0 and r[3]["kept"] and r[4]["kept"]
    assert r[5]["kept"] and r[7]["n_shingles"] == 1 and r[None]["component_id"] is None and r[None]["kept"]
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.keep_one(messy).columns == messy.columns


def test_leaks(spark, messy, empty):
    bench = spark.createDataFrame([(1, "Hello world, foo bar baz."), (2, None), (3, ""), (None, "x"), (1, "Hello world, foo bar baz.")], "item_id long, text string")
    out = decontaminate.find_leaks(messy, bench).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 8, None} and {r["item_id"] for r in out} == {1}
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(messy, bench.limit(0)).count() == 0
    left = decontaminate.drop_leaks(messy, bench)
    assert left.columns == messy.columns and left.count() == messy.count() - 4


def test_tokens(messy, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = by_id(token_counts.token_counts(messy, path))
    assert r[3]["n_tokens"] == r[4]["n_tokens"] == 0 and r[5]["over_limit"] and r[7]["n_bytes"] == 80
    assert token_counts.token_counts(empty, path).count() == 0


def test_secrets(spark, messy, empty):
    assert secrets.find_secrets(messy).filter("spans <> ''").count() == 0 and secrets.find_secrets(messy).count() == messy.count()
    assert secrets.find_secrets(empty).count() == 0
    one = secrets.find_secrets(spark.createDataFrame([(1, "é Password: 'abcdef1' AKIA" + "A" * 16)], "doc_id long, text string")).first()
    assert one["spans"] == "assign:2:20,access:22:42" and (one["n_assign"], one["n_access"], one["n_hex"]) == (1, 1, 0)


def test_lines(spark, messy, empty):
    out = line_dedup.line_report(messy)
    assert out.count() == messy.count() and line_dedup.line_report(empty).count() == 0
    r = by_id(out)
    assert r[5]["n_removed"] == 0 and r[5]["text"] == LONG and r[3]["text"] == ""
    kept = line_dedup.dedup_lines(messy)
    assert kept.columns == messy.columns and kept.filter("row_id <> 'x' or cuts <> 'x'").count() == 0


def test_stages_take_messy_documents(spark, messy, sf_dir):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "mix" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert out.count() <= docs.count()


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op6_near_dedup", "mix_targets", "url_rules", "token_bytes", "secret_counts"])
def test_sql(spark, sf_dir, name):
    from tests.compare import assert_equal
    from tidemark.llm.registry import ORACLES, QUERIES

    assert_equal(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    gap = out.groupBy("source_size", "target").agg(F.sum("taken").alias("got")).filter("abs(got - target) > 0.05 * target + 50")
    assert gap.count() == 0


def test_chunks_of_two_lines_take_the_hash_of_their_boundary(spark):
    """Each pair of lines is hashed once; boundaries and chunks are those of the definition."""
    from tidemark.llm import line_dedup as D

    lines = [f"line {i} " + "x" * (i * 7 % 90) + "\n" for i in range(200)]
    lines[-1] = lines[-1].rstrip("\n")  # else an empty line follows
    df = spark.createDataFrame([("".join(lines),)], "row_text string").selectExpr(f"{D._lines('row_text')} as lines")
    df = df.selectExpr("transform(lines, x -> xxhash64(x)) as hashes", "transform(lines, x -> length(x)) as lengths")
    df = df.selectExpr("*", f"{D._TWOS} as twos", f"{D._PAIRS} as pairs").selectExpr("*", f"{D._BOUND} as bound")
    got = df.selectExpr("*", f"{D._CHUNKS} as chunks", "transform(sequence(0, 198), i -> xxhash64(hashes[i], hashes[i + 1])) as wanted").first()
    bound = [i in (0, 200) or i >= 2 and got["wanted"][i - 2] & (D.JOINED - 1) != 0 for i in range(201)]
    assert got["bound"] == bound and D._CHUNKS.count("xxhash64") == 9
    for a, c in enumerate(got["chunks"]):
        ends = [n for n in range(2, 201 - a) if bound[a + n] and sum(map(len, lines[a : a + n])) >= D.LEAST_CHARS] if bound[a] else []
        assert (c and c["hash"] is not None and c["span"]) == ((a << 32) + ends[0] if ends else c and None)
        if ends and ends[0] == 2:
            assert c["hash"] == got["wanted"][a]
