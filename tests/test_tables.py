"""Tables that batches keep up to date, effects that are sent once, and first lines of files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_core import at
from tidemark.sources import files
from tidemark.sources.heads import FIRST_READ, MOST_READ, FirstLines, HeadReader, opened
from tidemark.sources.state_table import StateTable, finished
from tidemark.sources.store import names
from tidemark.streaming.outbox import Outbox, net

ROWS = "name string, ts timestamp_ntz, nth int, value string"
EFFECTS = "session_id string, at_ts timestamp_ntz, event_id long, kind string, value string"


def table_of(spark, folder, buckets=8):
    return StateTable(spark, str(folder), ROWS, "name", ["ts", "nth"], buckets)


def rows_of(spark, rows):
    return spark.createDataFrame([(n, None if t is None else at(t), i, v) for n, t, i, v in rows], ROWS)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(rows):
    """The greatest row of each name, nulls before all."""
    rank = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[1], r[2], r[3]))
    best = {}
    for r in rows:
        if r[0] not in best or rank(r) > rank(best[r[0]]):
            best[r[0]] = r
    return sorted(((n, None if t is None else at(t), i, v) for n, t, i, v in best.values()), key=repr)


def test_batches_give_what_one_run_gives(spark, tmp_path):
    """Keys that come again, late rows, ties, null keys and times, one key with a third of the rows."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 20 + [f"k{i}" for i in range(40)] + [None]), rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice("abc")) for _ in range(600)]
    table = table_of(spark, tmp_path / "t")
    for i, cut in enumerate(range(0, 600, 150)):
        table.upsert(rows_of(spark, rows[cut : cut + 150]), i)
    assert content(table.read()) == plain(rows)
    assert finished(spark, str(tmp_path / "t")) == [0, 1, 2, 3]
    whole = table_of(spark, tmp_path / "whole", 3)
    whole.upsert(rows_of(spark, rows))
    assert content(whole.read()) == plain(rows)


def test_a_batch_rewrites_its_own_buckets_alone(spark, tmp_path):
    table, folder = table_of(spark, tmp_path / "t", 16), str(tmp_path / "t")
    many = [(f"k{i}", 0, 0, "a") for i in range(200)]
    assert table.upsert(rows_of(spark, many)) == list(range(16))
    touched = table.upsert(rows_of(spark, [("k5", 1, 0, "b"), ("new", 1, 0, "c"), ("k7", -1, 0, "late")]))
    assert len(touched) <= 3 and [f"bucket={b}" for b in sorted(touched, key=str)] == [n for n in names(spark, f"{folder}/v=1") if n.startswith("bucket=")]
    got = {r["name"]: r["value"] for r in table.read().collect()}
    assert got["k5"] == "b" and got["new"] == "c" and got["k7"] == "a" and len(got) == 201
    # files of what nothing changed are those of the first batch
    read = {f.split("/v=")[1].split("/")[0] for f in table.read().inputFiles()}
    assert read == {"0", "1"} and table.read(touched).count() < 201
    assert table.upsert(rows_of(spark, [])) == [] and table.read().count() == 201
    for v in (3, 4):  # what the last batch but one wrote goes once a bucket has two newer versions
        table.upsert(rows_of(spark, [("k5", v, 0, "d")]))
    kept = table.versions()
    assert max(map(len, kept.values())) == 2 and table.read().count() == 201


def test_batches_that_run_again_or_are_cut_short(spark, tmp_path):
    table, folder = table_of(spark, tmp_path / "t"), tmp_path / "t"
    table.upsert(rows_of(spark, [("a", 1, 0, "x"), ("b", 1, 0, "x")]), 0)
    before = content(table.read())
    assert table.upsert(rows_of(spark, [("a", 9, 0, "other")]), 0) == [] and content(table.read()) == before
    table.upsert(rows_of(spark, [("a", 2, 0, "y")]), 1)
    os.remove(folder / "v=1" / "_SUCCESS")  # as if the write had not come to its end
    assert content(table.read()) == before
    table.upsert(rows_of(spark, [("a", 2, 0, "y")]), 1)
    assert {r["name"]: r["value"] for r in table.read().collect()} == {"a": "y", "b": "x"}
    table.upsert(rows_of(spark, [("c", 2, 0, "y")]), 7)
    with pytest.raises(ValueError, match="after batch 7"):
        table.upsert(rows_of(spark, [("c", 2, 0, "y")]), 5)
    assert table_of(spark, tmp_path / "none").read().isEmpty()


def effects_of(spark, rows):
    return spark.createDataFrame([(s, None if t is None else at(t), e, k, v) for s, t, e, k, v in rows], EFFECTS)


def test_effects_are_put_once(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    first = [("s", 0, 1, "issue", "t"), ("s", 0, 1, "status", "registered"), (None, None, None, "close", "timer"), ("s", 0, 1, "issue", "t")]
    second = [("s", 90_000, 2, "status", "waiting"), ("s", 0, 1, "issue", "t"), ("s", 90_000, 2, "comment", "c"), (None, None, None, "close", "timer"), ("", None, None, "close", "timer")]
    assert box.read().isEmpty()
    box.put(effects_of(spark, first), 0)
    box.put(effects_of(spark, second), 1)
    box.put(effects_of(spark, []), 2)
    got = content(box.read().select("v", "session_id", "kind", "value", "day"))
    assert got == sorted([
        (0, "s", "issue", "t", "2024-01-01"), (0, "s", "status", "registered", "2024-01-01"), (0, None, "close", "timer", "none"),
        (1, "s", "status", "waiting", "2024-01-02"), (1, "s", "comment", "c", "2024-01-02"), (1, "", "close", "timer", "none"),
    ], key=repr)
    keys = [r["key"] for r in box.read().collect()]
    assert len(keys) == len(set(keys)) == 6
    for again, v in ((first, 0), (second, 1), (second, 3)):  # a batch again, and its rows under another number
        box.put(effects_of(spark, again), v)
    assert content(box.read().select("v", "session_id", "kind", "value", "day")) == got
    os.remove(tmp_path / "box" / "v=1" / "_SUCCESS")
    assert box.read().count() == 3
    box.put(effects_of(spark, second), 1)
    assert content(box.read().select("v", "session_id", "kind", "value", "day")) == got


def test_a_sender_sends_last_values(spark, tmp_path):
    rows = [("s", t, t, k, f"{k}{t}") for t in (1, 2, 3) for k in ("status", "title", "comment")] + [("r", 2, 9, "status", "x"), ("r", 2, 10, "status", "y"), ("r", None, None, "close", "sweep")]
    want = {("s", "status", "status3"), ("s", "title", "title3"), ("s", "comment", "comment1"), ("s", "comment", "comment2"), ("s", "comment", "comment3"), ("r", "status", "y"), ("r", "close", "sweep")}
    kept = lambda df: {(r["session_id"], r["kind"], r["value"]) for r in df.collect()}
    assert kept(net(effects_of(spark, rows))) == want and net(effects_of(spark, [])).isEmpty()
    box = Outbox(spark, str(tmp_path / "box"))
    box.put(effects_of(spark, rows), 0)
    box.put(effects_of(spark, [("s", 4, 4, "status", "closed")]), 1)
    assert kept(box.unsent(0)) == {("s", "status", "closed")}
    assert kept(box.unsent(-1)) == want - {("s", "status", "status3")} | {("s", "status", "closed")}


def heads(spark, folder, **options):
    spark.dataSource.register(FirstLines)
    rows = spark.read.format("first_lines").options(**options).load(str(folder)).collect()
    assert len(rows) == len({r["file_path"] for r in rows}) and all(r["file_path"].startswith("file:///") for r in rows)
    return {os.path.basename(r["file_path"]): (r["value"], r["bytes_read"]) for r in rows}


def test_only_first_lines_are_read(spark, tmp_path):
    long = "x" * 1_000_000
    cases = {
        "short.jsonl": b"one\n" + b"y" * 3_000_000, "long.jsonl": long.encode() + b"\n" + b"z" * 9_000_000, "edge.jsonl": b"e" * FIRST_READ + b"\ntwo", "cr.jsonl": b"mac\rtwo\r",
        "crlf.jsonl": b"dos\r\ntwo", "open.jsonl": "no end é".encode(), "empty.jsonl": b"", "blank.jsonl": b"\nsecond\n", "bad.jsonl": b"\xff\xfe\n", "_hidden": b"h\n", "other.txt": b"t\n",
    }
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i, (name, data) in enumerate(cases.items()):
        (tmp_path / "in" / ("deep" if i % 2 else "") / name).write_bytes(data)
    got = heads(spark, tmp_path / "in", suffix=".jsonl", filesPerTask="2")
    assert {k: v[0] for k, v in got.items()} == {
        "short.jsonl": "one", "long.jsonl": long, "edge.jsonl": "e" * FIRST_READ, "cr.jsonl": "mac", "crlf.jsonl": "dos", "open.jsonl": "no end é", "empty.jsonl": "", "blank.jsonl": "", "bad.jsonl": None,
    }
    assert got["short.jsonl"][1] == FIRST_READ and len(long) < got["long.jsonl"][1] <= 2 * len(long) + MOST_READ and got["empty.jsonl"][1] == 0
    assert set(heads(spark, f"file://{tmp_path}/in")) == {*got, "other.txt"}
    assert heads(spark, tmp_path / "in" / "deep" / "cr.jsonl") == {"cr.jsonl": ("mac", 8)}
    (tmp_path / "none").mkdir()
    assert heads(spark, tmp_path / "none") == {}
    assert len(HeadReader({"path": str(tmp_path / "in"), "filesPerTask": "3"}).partitions()) == 4
    with pytest.raises(FileNotFoundError):
        HeadReader({"path": str(tmp_path / "missing")}).partitions()
    assert opened("file:/a/b")[1:] == opened("file:///a/b")[1:] == opened("/a/b")[1:] == ("/a/b", "file://")


def test_resumed_transcripts(spark, sf_dir, tmp_path):
    """A transcript for each conversation: its first turn tells, however long; JSON that is cut short doesn't."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(f"{r['conv_id']}.jsonl", r["role"] == "system")
        with open(tmp_path / f"{r['conv_id']}.jsonl", "a") as f:
            f.write(json.dumps({"text": r["text"], "type": "file-history-snapshot" if r["role"] == "system" else r["role"]}) + "\n")
    for name, line in {"cut.jsonl": '{"type": "file-history-snapshot"', "list.jsonl": '["file-history-snapshot"]', "null.jsonl": '{"type": null}', "more.jsonl": '{"type": "file-history-snapshot"} x'}.items():
        (tmp_path / name).write_text(line)
        want[name] = False
    got = {os.path.basename(r["file_path"]): r["is_resume"] for r in files.is_resume(spark, str(tmp_path)).collect()}
    assert got == want and True in want.values()


def test_scanned_states(spark):
    records = ['{"session_id": "a", "status": "waiting"}', '{"session_id": "b", "status": "wai', "", None, "[1]", '{"session_id": "d"} x', '{"session_id": "e"}]', '{"session_id": "f"}, "y": 1', "{'session_id': 'g'}", '{"status": "closed", "issue_number": "x"}', '{"session_id": "c", "status": "waiting"}']
    parsed = files.parsed_states(spark.createDataFrame([(r,) for r in records], "value string"), [])
    got = {(r["valid"], r["status"]): r["records"] for r in files.scanned(parsed).collect()}
    assert got == {(True, "waiting"): 2, (False, None): 9}
    assert parsed.filter(F.col("session_id").isNotNull()).count() == 2
