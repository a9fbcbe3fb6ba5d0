"""Near-duplicates by chosen-path set similarity join.

Documents with equal shingle sets (by a digest of the whole set) become one class. Every class walks down TREES trees: a
node, named by the path so far, picks one of the COORDINATES minwise hashes, and documents with the same value there go
on together. At depth DEPTH, nodes of one document end; those of at most MOST documents and HEAVY shingles are compared
exhaustively, in one task. A larger node takes a few anchors that are compared with all the others; then what isn't in
the component of most is compared with all the others too if that is at most FEW times as much as a small node, and the
node branches further if not, until nodes are small or have little apart. Every comparison is of whole shingle sets.

Two sets of similarity 0.8 share a node of depth 3 in one tree with probability 0.51, so in one of 16 trees with 0.9998.
Below, a node picks a second coordinate in SECOND of 16 cases, so a pair has 0.8 * (1 + SECOND / 16) = 1.05 children in
common on average, and its chance of being together in some tree falls slowly with depth. Paths and trees use coordinates
again, so it falls faster than recall() computes, as though each agreed by itself: measured 0.993 at depth 6, 0.979 at 9 and
0.919 at 16, against 0.999, 0.994 and 0.973. So branching ends at depth DEEPEST, 9, with an exact step for what is left.
A node of documents at 0.75 to each other shrinks all the while.

What a level writes is in proportion to the entries of its nodes: a small node's documents once, a larger node's FEW
times at most, and its anchors, or the FEW * MOST documents apart at most, once for each MOST documents of it: as many
rows again. Documents of nodes that still have more than that apart at depth DEEPEST meet under the rarest shingles of
their sets instead, as many as a similar set must share one of (_rarest): a document's rows are at most that share of
its shingles, and only where more than MOST documents have one of their rarest shingles in common are there blocks.

Texts are read for the sketches, at depth DEPTH, and once more to write the sets of documents in large nodes that still
have some apart, which is all that deeper levels read;
each level adds its links to the components that the one before has found.

A comparison links a document with another one only where the group hasn't joined them by other links, so a group gives
fewer links than it has documents. Components are found over all links and lose nothing by that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _words as W
from tidemark.llm._common import Scratch, table
from tidemark.llm.components import components

WORDS, PERCENT = 5, 80
COORDINATES, TREES, DEPTH, DEEPEST = 64, 16, 3, 9
#: Below DEPTH, so many of 16 nodes pick two coordinates.
SECOND = 5
#: Documents and shingles of a group that is compared in one task, and anchors of a larger node.
MOST, HEAVY, ANCHORS = 2048, 1 << 22, 8
#: So many times MOST documents, or HEAVY shingles, that are apart are still compared with all others of their node.
FEW = 4

_U = np.uint64
_FACTORS = np.random.default_rng(16).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_SKETCH = "n_shingles bigint, digest binary, hashes binary"


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, hashes = [], [], []
            for i, j, h, bounds in W.documents(batch.column("text")):
                shingles, at = W.shingles(h, bounds, words)
                for r in range(j - i):
                    own = np.unique(shingles[at[r] : at[r + 1]])
                    n.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(own), 2048):
                        np.minimum(least, (own[k : k + 2048, None] * _FACTORS).min(axis=0), out=least)
                    hashes.append((least >> _U(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(hashes, pa.binary())], ["doc_id", "n_shingles", "digest", "hashes"])

    return run


def _hashes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES).astype(np.uint64)


def _picks(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two coordinates of each node, never the same, and whether it takes the second as well."""
    one, more = (W.mix(node, 1) >> _U(40)).astype(np.int64) % COORDINATES, W.mix(node, 2)
    return one, (one + 1 + (more >> _U(40)).astype(np.int64) % (COORDINATES - 1)) % COORDINATES, (more & _U(15)) < _U(SECOND)


def _step(node: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return W.mix(node * _U(0x9E3779B97F4A7C15) + (hashes[np.arange(len(hashes)), at] << _U(8)) + at.astype(np.uint64) + _U(1))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of depth DEPTH, one for each tree."""
    for batch in batches:
        hashes = _hashes(batch.column("hashes"))
        for tree in range(TREES):
            node = np.full(len(batch), W.mix(np.array([tree + 1], np.uint64))[0])
            for _ in range(DEPTH):
                node = _step(node, hashes, _picks(node)[0])
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("rep"), batch.column("weight")], ["node", "rep", "weight"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level on."""
    for batch in batches:
        hashes, node = _hashes(batch.column("hashes")), batch.column("node").to_numpy().view(np.uint64)
        one, two, both = _picks(node)
        for at, own in ((one, np.ones(len(node), bool)), (two, both)):
            rest = [batch.column(c).filter(pa.array(own)) for c in ("rep", "weight")]
            yield pa.RecordBatch.from_arrays([pa.array(_step(node[own], hashes[own], at[own]).view(np.int64)), *rest], ["node", "rep", "weight"])


def recall(depth: int, similarity: float = PERCENT / 100) -> float:
    """The chance that two sets share a node of that depth in one of the trees, were each coordinate to agree by itself."""
    apart = 0.0
    for _ in range(depth - DEPTH):
        one = 1 - similarity * (1 - apart)
        apart = one * (1 - SECOND / 16) + one * one * SECOND / 16
    return 1 - (1 - similarity**DEPTH * (1 - apart)) ** TREES


class _Sets:
    """The shingle sets of a group, with an index of the shingles that several of them have: a matrix of those that a
    good part of the documents has, lists of documents for the others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size, n = np.array([len(s) for s in sets]), len(sets)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), self.size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        length = np.diff(np.append(first, len(flat)))
        often = length >= max(16, n // 4)
        column = np.repeat(np.where(often, np.cumsum(often) - 1, -1), length)
        self.matrix = np.zeros((n, int(often.sum())), np.float32)
        self.matrix[owner[column >= 0], column[column >= 0]] = 1
        # lists of the others, and for each document the lists that it is in
        rare = (length > 1) & ~often
        self.first, self.length, self.owner = first[rare], length[rare], owner
        which = np.repeat(np.where(rare, np.cumsum(rare) - 1, -1), length)
        held = np.flatnonzero(which >= 0)
        held = held[np.argsort(owner[held], kind="stable")]
        self.lists, self.bounds = which[held], np.searchsorted(owner[held], np.arange(n + 1))

    def similar(self, i: int, percent: int) -> np.ndarray:
        """The documents whose sets are similar to that of i, which is among them."""
        at = self.lists[self.bounds[i] : self.bounds[i + 1]]
        length = self.length[at]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        common = np.bincount(self.owner[np.repeat(self.first[at], length) + inner], minlength=len(self.size))
        if self.matrix.shape[1]:
            common = common + (self.matrix @ self.matrix[i]).astype(np.int64)  # exact below 2^24
        own = self.size[i]
        return np.flatnonzero(100 * common >= percent * (own + self.size - common))


def _links(reps: list, anchors: list[bool], sets: list[np.ndarray], percent: int) -> Iterator[tuple]:
    """Anchors with whatever they are similar to and not yet joined with.

    Where all are anchors, those that lie in a component of more than half of the group needn't be asked: what is similar
    to them lies there too, or is asked itself.
    """
    index, name, everyone = _Sets(sets), np.arange(len(sets)), all(anchors)
    for i in (k for k, x in enumerate(anchors) if x):
        if everyone and 2 * int((name != name[i]).sum()) < len(sets):
            continue
        near = index.similar(i, percent)
        for k in near[name[near] != name[i]]:
            if name[k] != name[i]:
                name[name == name[k]] = name[i]
                if reps[i] != reps[k]:
                    yield reps[i], reps[k]


def _sets(words: int):
    """rep and shingles, in order, of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, bounds in W.documents(batch.column("text")):
                shingles, at = W.shingles(h, bounds, words)
                own = [np.unique(shingles[at[r] : at[r + 1]]) for r in range(j - i)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), made], ["rep", "shingles"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    return run


def _read(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set, out of the row's text or of its shingles as _sets gives them."""
    if "shingles" in batch.schema.names:
        column = batch.column("shingles")
        flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        yield from ((r, flat[ends[r] : ends[r + 1]].copy()) for r in range(len(column)))
        return
    for i, j, h, bounds in W.documents(batch.column("text")):
        shingles, at = W.shingles(h, bounds, words)
        yield from ((r, np.unique(shingles[at[r - i] : at[r - i + 1]])) for r in range(i, j))


def _compare(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, anchors, sets, group = [], [], [], None

        def done() -> Iterator[pa.RecordBatch]:
            found = list(_links(reps, anchors, sets, percent)) if len(reps) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            groups, own_reps, own_anchors = (batch.column(c).to_pylist() for c in ("group", "rep", "anchor"))
            for r, own in _read(batch, words):
                if groups[r] != group:
                    yield from done()
                    reps, anchors, sets, group = [], [], [], groups[r]
                if not len(own) or (reps and reps[-1] == own_reps[r] and np.array_equal(sets[-1], own)):
                    continue  # a repeated row
                reps.append(own_reps[r])
                anchors.append(own_anchors[r])
                sets.append(own)
        yield from done()

    return run


class _Join:
    def __init__(self, docs: DataFrame, scratch: Scratch, words: int, percent: int):
        self.scratch, self.words, self.percent = scratch, words, percent
        self.held, self.column = docs.select(F.col("doc_id").alias("rep"), "text"), "text"

    def keep(self, reps: DataFrame) -> None:
        """From here on, only these documents are compared: their sets are written and read instead of all texts."""
        texts = self.held.join(reps.distinct(), "rep", "left_semi")
        self.held, self.column = self.scratch.write(texts.mapInArrow(_sets(self.words), "rep bigint, shingles array<bigint>"), "sets"), "shingles"

    def links(self, groups: DataFrame) -> DataFrame:
        """groups: group, rep, anchor. The links found, written."""
        held = self.held.join(groups, "rep").select("group", "rep", "anchor", self.column)
        held = held.repartition("group").sortWithinPartitions("group", "rep")
        return self.scratch.write(held.mapInArrow(_compare(self.words, self.percent), "a bigint, b bigint").distinct(), "links")


def _crowds(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries (node, rep, weight) of nodes with more than one document, with their number n and weight w.

    The counts are written, so that the join with them is a plain one, of which Spark splits what a large node makes large.
    """
    entries = scratch.write(entries, "entries")
    counts = scratch.write(entries.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).filter("n > 1"), "counts")
    found = scratch.write(entries.join(counts, "node"), "nodes")
    scratch.drop(entries, counts)
    return found


def _group(*columns) -> F.Column:
    return F.xxhash64(*columns).alias("group")


def _fits(n: F.Column, w: F.Column) -> F.Column:
    return (n <= MOST) & (w <= HEAVY)


def _parts(n: F.Column, w: F.Column) -> F.Column:
    return F.greatest(F.ceil(n / MOST), F.ceil(w / HEAVY)).cast("int")


def _small(crowds: DataFrame) -> DataFrame:
    """Groups of the small nodes; nodes of the same documents, in other trees, make one group."""
    sets = crowds.filter(_fits(F.col("n"), F.col("w"))).groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("reps"))  # MOST at most
    return sets.select("reps").distinct().select(_group("reps"), F.explode("reps").alias("rep"), F.lit(True).alias("anchor"))


def _large(crowds: DataFrame) -> DataFrame:
    return crowds.filter(~_fits(F.col("n"), F.col("w")))


def _members(large: DataFrame) -> DataFrame:
    parts = _parts(F.col("n"), F.col("w"))
    return large.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"))


def _stars(large: DataFrame) -> DataFrame:
    """Groups of a few anchors of each large node, chosen by a hash of the document, with every part of its members."""
    members = _members(large)
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(ANCHORS)), F.lit(HEAVY / 2) * F.col("n") / F.col("w")))
    chosen = members.filter((F.xxhash64("rep", F.lit(5)).cast("double") / 2.0**64 + 0.5) * F.col("n") < most)
    anchors = chosen.select("node", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return members.select(_group("node", "part"), "rep", F.lit(False).alias("anchor")).unionByName(anchors.select(_group("node", "part"), "rep", F.lit(True).alias("anchor")))


def _apart(large: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """large with `away`: whether the document is in another component than most of its node's, and the number and weight of those."""
    named = large.join(labels, large["rep"] == labels["node_rep"], "left").select("node", "rep", "weight", "n", "w", F.coalesce("component", "rep").alias("component"))
    named = scratch.write(named, "named")
    sizes = named.groupBy("node", "component").agg(F.count("*").alias("m"), F.sum("weight").alias("v"))
    most = scratch.write(sizes.groupBy("node").agg(F.max(F.struct("m", "component", "v")).alias("most")), "most")
    out = named.join(most, "node").select("node", "rep", "weight", "n", "w", (F.col("component") != F.col("most.component")).alias("away"), (F.col("n") - F.col("most.m")).alias("n_away"), (F.col("w") - F.col("most.v")).alias("w_away"))
    out = scratch.write(out.filter("n_away > 0"), "apart")
    scratch.drop(named, most)
    return out


def _blocks(apart: DataFrame) -> DataFrame:
    """Groups in which all documents apart meet all documents of their node: FEW rows of those apart, by parts of the members."""
    members = _members(apart)
    rows = _parts(F.col("n_away"), F.col("w_away"))
    anchors = members.filter("away").withColumn("row", F.pmod(F.xxhash64("rep", F.lit(11)), rows).cast("int"))
    anchors = anchors.select("node", "rep", "row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = members.select("node", "rep", "part", F.explode(F.sequence(F.lit(0), rows - 1)).alias("row"))
    both = others.select(_group("node", "row", "part"), "rep", F.lit(False).alias("anchor")).unionByName(anchors.select(_group("node", "row", "part"), "rep", F.lit(True).alias("anchor")))
    return both.groupBy("group", "rep").agg(F.max("anchor").alias("anchor"))


def _cheap(percent: int) -> F.Column:
    """Whether blocks of a node write fewer rows than _rarest would: a row for each shingle that a document meets others under."""
    return _parts(F.col("n_away"), F.col("w_away")) <= F.greatest(F.lit(float(FEW)), F.col("w") / F.col("n") * (100 - percent) / 100)


def _rarest(far: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """far's documents as _blocks takes them, with shingles as nodes.

    Two sets of size s and t with 100 * common >= percent * united share one of the first s - ceil(percent * s / 100) + 1
    of the one and as many of the other, by t, in any order that is the same for all; here the rarest come first.
    """
    own = far.groupBy("rep").agg(F.max("away").alias("away"))
    held = sets.join(own, "rep").select("rep", "away", F.xxhash64("shingles").alias("set"), F.size("shingles").cast("long").alias("weight"), F.explode("shingles").alias("node"))
    held = scratch.write(held, "held")
    often = scratch.write(held.groupBy("node").agg(F.count("*").alias("often")), "often")
    ranked = held.join(often, "node").groupBy("rep", "away", "set", "weight").agg(F.sort_array(F.collect_list(F.struct("often", "node"))).alias("all"))
    first = F.slice("all", F.lit(1), F.expr(f"cast(weight - ({percent} * weight + 99) div 100 + 1 as int)"))
    rare = ranked.select("rep", "away", "weight", F.explode(first).alias("x")).filter("x.often > 1")
    rare = scratch.write(rare.groupBy("x.node", "rep").agg(F.max("away").alias("away"), F.max("weight").alias("weight")), "rare")
    alone = F.when(F.col("away"), F.col("weight")).otherwise(0)
    counts = rare.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.count_if("away").alias("n_away"), F.sum(alone).alias("w_away"))
    counts = scratch.write(counts.filter("n > 1 and n_away > 0"), "counts")
    scratch.drop(held, often)
    return rare.join(counts, "node")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct runs of `words` words (A-Z as a-z), or all its words as one where they are
    fewer. Two documents are linked if 100 * common >= percent * united; component_id is the least id that links
    reach, kept whether that is the document's own. A document without words (null and empty texts) has an empty
    set and no links. Rows that repeat an id count as one document with all their texts; a row with a null id is
    linked with nothing and has no component, and is kept. Ids are integers. Other columns are ignored. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = scratch.write(plain.mapInArrow(_sketch(words), "doc_id bigint, " + _SKETCH), "sketch")
    known = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "hashes")).alias("first"))
    classes = scratch.write(classes.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.n_shingles").alias("weight"), F.col("first.hashes").alias("hashes")), "classes")
    join = _Join(plain, scratch, words, percent)

    crowds = _crowds(classes.select("rep", "weight", "hashes").mapInArrow(_roots, "node bigint, rep bigint, weight bigint"), scratch)
    large = _large(crowds)
    any_large = not large.isEmpty()
    links = join.links(_small(crowds).unionByName(_stars(large)) if any_large else _small(crowds))
    # an id with several texts is one document: the classes of its texts are linked by the id
    repeated = scratch.write(known.groupBy("doc_id").agg(F.countDistinct("digest").alias("texts")).filter("texts > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        own = known.join(repeated, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
        links = links.unionByName(own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links, scratch)
    for depth in range(DEPTH + 1, DEEPEST + 1):
        if not any_large:
            break
        apart = _apart(large, found.select(F.col("node").alias("node_rep"), "component"), scratch)
        if depth == DEPTH + 1:
            join.keep(apart.select("rep"))
        few = _parts(F.col("n_away"), F.col("w_away")) <= FEW if depth < DEEPEST else _cheap(percent)
        near, far, groups = apart.filter(few), apart.filter(~few), []
        if not near.isEmpty():
            groups.append(_blocks(near))
        any_large = not far.isEmpty()
        if any_large and depth == DEEPEST:
            groups.append(_blocks(_rarest(far, join.held, percent, scratch)))
            any_large = False
        if any_large:
            deeper = far.select("node", "rep").join(classes.select("rep", "weight", "hashes"), "rep").select("node", "rep", "weight", "hashes")
            crowds = _crowds(deeper.mapInArrow(_children, "node bigint, rep bigint, weight bigint"), scratch)
            large = _large(crowds)
            any_large = not large.isEmpty()
            groups += [_small(crowds), _stars(large)] if any_large else [_small(crowds)]
        if groups:
            for g in groups[1:]:
                groups[0] = groups[0].unionByName(g)
            links = join.links(groups[0]).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = components(links, scratch)
    named = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.write(named.select("digest", F.coalesce("component", "rep").alias("component")), "named")
    out = sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_groups keeps: one document of each component."""
    gone = near_groups(docs, words, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS df FROM s GROUP BY 1 HAVING count(*) > 1),
-- documents of similarity 0.8 share one of the rarest fifth of either's shingles
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(f.df, 1), s.g) AS k FROM s JOIN n USING (doc_id) LEFT JOIN f USING (g)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.k <= a.n - ceil(a.n * 0.8) + 1 AND b.k <= b.n - ceil(b.n * 0.8) + 1),
m AS (SELECT c.a, c.b, count(*) AS both_ FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 80 * (p.n + q.n - both_)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, a AS r FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(x.r, documents.doc_id) AS component_id, coalesce(x.r, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1) x USING (doc_id)
"""
