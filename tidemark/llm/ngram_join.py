"""Exact Jaccard join of documents' word n-grams: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

Two sets of s <= l shingles link only if s >= 0.8 * l and they differ in at most (s + l) / 9 shingles (at 80 %). Sizes fall
into bands; the band of l cuts the range of shingle hashes into a power of two of slices, more than the pair may have
differences, so some slices hold the same shingles in both sets. A slice with its shingles names a tile. Each document goes
into the tiles of one slice more than it may have differences, those with the most shingles first: what two documents have
in common of their slices must then include a tile of both (prefix filtering over slices). No pair is lost, and tiles of one
shingle, which unrelated documents could share, are hardly ever among them.

A tile whose documents all have the same set is done. Of the others, each document is first compared with the least of its
tile. In tiles that still hold several components, documents of different components are compared: in blocks of MOST by
MOST, by their signatures, and what hangs together by pairs that may link makes a group; then each group, once, by its
sets. Every comparison goes by sizes and bitmaps first: a bit of a signature is the parity of the shingles that fall on it,
so two signatures differ in no more bits than the sets in shingles, and that bounds the intersection from above. What passes
is decided by intersecting the sorted arrays. Components are found over all links.

Tiles are counted before they are joined, so that only rows of tiles with different sets go on, in a plain join, of which
Spark splits what a very common tile makes large. No task gives pairs of documents: blocks give documents with their
group, and groups fewer links than they have documents. Texts are read again for documents that are compared; a bitmap of at
most WANTED bits keeps most others from being shuffled.
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
from tidemark.llm.near_dedup import _links as links_of_group

WORDS, PERCENT = 5, 80
#: Slices for each difference that a pair may have; more make smaller tiles' names, fewer make larger ones.
SPREAD = 1.6
#: Bits of a signature for each slice.
BITS = 4
#: Documents, and shingles, of a side of a block.
MOST, HEAVY = 2048, 1 << 22
#: Bits of the bitmap of documents whose texts are wanted.
WANTED = 1 << 26

_U = np.uint64


def differences(together: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two sets of so many together may differ in."""
    return (100 - percent) * together // (100 + percent)


def slices(size: np.ndarray, percent: int) -> np.ndarray:
    """log2 of the slices of the band of a pair's larger set."""
    need = differences(2 * size, percent) + 1
    return np.ceil(np.log2(np.maximum(need, SPREAD * (need - 1)))).astype(np.int64)


def largest(size: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that one of this size may link with."""
    return 100 * size // percent


def signature(own: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the shingles on each of so many bits, a power of two of 64 or more, in 64-bit words."""
    at = own & _U(bits - 1)
    parity = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Signatures of fewer bits out of longer ones: rows of n words."""
    while words.shape[1] > n:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


def signature_bits(size: np.ndarray, percent: int) -> np.ndarray:
    return np.maximum(64, BITS << slices(largest(size, percent), percent))


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, their sorted distinct shingles one after the other, and bounds."""
    for i, j, h, bounds in W.documents(column):
        found, at = W.shingles(h, bounds, words)
        row = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        if len(found):
            new = np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])])
            found, row = found[new], row[new]
        yield i, found, np.searchsorted(row, np.arange(j - i + 1))


def _name(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sketch(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, marks = [], [], []
            for _, found, at in _sets(batch.column("text"), words):
                bits = signature_bits(np.diff(at), percent)
                for k in range(len(at) - 1):
                    own = found[at[k] : at[k + 1]]
                    n.append(len(own))
                    names.append(_name(own))
                    marks.append(signature(own, int(bits[k])).tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "digest", "mark"])

    return run


def _short(names: list[bytes]) -> np.ndarray:
    """The first eight bytes of digests, by which tiles know sets."""
    return np.frombuffer(b"".join(x[:8] for x in names), ">i8").astype(np.int64)


def tiles_of(found: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and tile of each set's tiles; sets one after the other with bounds, sorted."""
    size = np.diff(at)
    rows, names = [], []
    band = slices(size, percent)
    for up in range(int(slices(largest(size, percent), percent).max(initial=0) - band.min(initial=0)) + 1):
        # the band of pairs in which the set is the larger one, then those in which it is the smaller one only
        log = band + up
        own = (size > 0) & (log <= slices(largest(size, percent), percent))
        if not own.any():
            continue
        row = np.repeat(np.arange(len(size)), np.where(own, size, 0))
        h = found[np.repeat(own, size)]
        depth = log[row]
        part = np.where(depth == 0, 0, (h >> (64 - np.maximum(depth, 1)).astype(np.uint64)).astype(np.int64))
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(h)))
        content = np.add.reduceat(W.mix(h, 0x1CE), first)
        where = row[first]
        name = W.mix(content ^ W.mix((part[first].astype(np.uint64) << _U(6)) + log[where].astype(np.uint64), 0x711E))
        # a set's tiles in an order that all sets agree on
        order = np.lexsort((name, -count, where))
        where, name = where[order], name[order]
        begin = np.searchsorted(where, np.arange(len(size)))
        nth = np.arange(len(where)) - begin[where]
        most, held = differences(size + largest(size, percent), percent), np.bincount(where, minlength=len(size))
        take = nth <= most[where]
        rows.append(where[take])
        names.append(name[take])
        # slices without shingles come last in that order, for sets that have too few others
        for k in np.flatnonzero(own & (held <= most) & (held < 1 << log)):
            gaps = np.setdiff1d(np.arange(1 << log[k]), part[first[row[first] == k]]).astype(np.uint64)
            gaps = np.sort(W.mix((gaps << _U(6)) + _U(log[k]), 0x6A9))[: most[k] + 1 - held[k]]
            rows.append(np.full(len(gaps), k))
            names.append(gaps)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(names)


def _tiles(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found, at in _sets(batch.column("text"), words):
                names = _short([_name(found[at[k] : at[k + 1]]) for k in range(len(at) - 1)])
                row, tile = tiles_of(found, at, percent)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(names[row])], ["tile", "short"])

    return run


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bit counts leave it open that rows of signatures are of similar sets."""
    n = min(a.shape[-1], b.shape[-1])
    apart = np.bitwise_count(folded(a, n) ^ folded(b, n)).sum(axis=-1, dtype=np.int64)
    most = (size_a + size_b - apart) // 2  # of the intersection
    return 100 * most >= percent * (size_a + size_b - most)


def _marks(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _likely(percent: int):
    """Pairs (a, b with their sizes and signatures) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, m_a, m_b = (batch.column(c) for c in ("a", "b", "n_a", "n_b", "mark_a", "mark_b"))
            n_a, n_b, m_a, m_b = n_a.to_numpy(), n_b.to_numpy(), m_a.to_pylist(), m_b.to_pylist()
            width = np.array([len(x) * 100_000_000 + len(y) for x, y in zip(m_a, m_b, strict=True)], np.int64)
            good = np.zeros(len(batch), bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                good[at] = may_link(_marks([m_a[i] for i in at]), _marks([m_b[i] for i in at]), n_a[at], n_b[at], percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])

    return run


def _hang_together(block: list[tuple], percent: int) -> list[list[int]]:
    """Documents of a block (rep, component, size, mark, side) that hang together by pairs of a row and a column, of
    different components, that may link."""
    name, groups = np.arange(len(block)), {}
    component, size = np.array([x[1] for x in block]), np.array([x[2] for x in block])
    column = np.array([x[4] != "row" for x in block])
    width = np.array([len(x[3]) for x in block])
    packed = [(at, _marks([block[i][3] for i in at])) for w in np.unique(width) for at in [np.flatnonzero(column & (width == w))] if len(at)]
    for i, x in enumerate(block):
        if x[4] == "column":
            continue
        one = np.frombuffer(x[3], np.uint64)[None]
        for at, marks in packed:
            fit = (component[at] != x[1]) & (name[at] != name[i]) & (100 * np.minimum(size[at], x[2]) >= percent * np.maximum(size[at], x[2]))
            if fit.any():
                own = at[fit]
                own = own[may_link(marks[fit], one, size[own], size[i], percent)]
                if len(own):
                    name[np.isin(name, name[own])] = name[i]
    for i, n in enumerate(name.tolist()):
        groups.setdefault(n, []).append(block[i][0])
    return [g for g in groups.values() if len(g) > 1]


def _between(percent: int):
    """Groups of a block's documents that hang together. Rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = [], None

        def done() -> Iterator[pa.RecordBatch]:
            for k, reps in enumerate(_hang_together(block, percent) if block else []):
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{k}"] * len(reps)), pa.array(reps, pa.int64())], ["part", "rep"])

        for batch in batches:
            for *x, own in zip(*(batch.column(c).to_pylist() for c in ("rep", "component", "n_shingles", "mark", "side", "block")), strict=True):
                if own != name:
                    yield from done()
                    block, name = [], own
                block.append(tuple(x))
        yield from done()

    return run


def _compare(words: int, percent: int):
    """Links (a, b) among rows (group, rep, text), sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reps, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            found = list(links_of_group(reps, [True] * len(reps), sets, percent)) if len(reps) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            groups, own_reps = (batch.column(c).to_pylist() for c in ("group", "rep"))
            for i, found, at in _sets(batch.column("text"), words):
                for r, own in enumerate(np.split(found, at[1:-1]), i):
                    if groups[r] != group:
                        yield from done()
                        group, reps, sets = groups[r], [], []
                    if len(own):
                        reps.append(own_reps[r])
                        sets.append(own)
        yield from done()

    return run


def _verify(words: int, percent: int):
    """Links (a, b) among rows (group, hub, rep, text): each group's hub comes first, then what it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine = None, []  # the hub's set, or sets, where its id has several texts
        for batch in batches:
            groups, hubs, reps = (batch.column(c).to_pylist() for c in ("group", "hub", "rep"))
            out_a, out_b = [], []
            for i, found, at in _sets(batch.column("text"), words):
                for r, own in enumerate(np.split(found, at[1:-1]), i):
                    if groups[r] != group:
                        group, mine = groups[r], []
                    if hubs[r] == reps[r]:
                        mine.append(own)
                    elif any(100 * (common := len(np.intersect1d(x, own, assume_unique=True))) >= percent * (len(x) + len(own) - common) for x in mine if len(x) and len(own)):
                        out_a.append(hubs[r])
                        out_b.append(reps[r])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int):
        self.docs, self.classes, self.scratch, self.words, self.percent = docs, classes, scratch, words, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of pairs of short names, those of classes (a, b) that may link."""
        side = lambda s: self.classes.select(F.col("short").alias(s), F.col("rep").alias(f"{s[0]}"), F.col("n_shingles").alias(f"n_{s[0]}"), F.col("mark").alias(f"mark_{s[0]}"))
        both = pairs.join(side("a_short"), "a_short").join(side("b_short"), "b_short").filter("a <> b")
        both = both.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "mark_a", "mark_b")
        return both.mapInArrow(_likely(self.percent), "a bigint, b bigint")

    def texts(self, asked: DataFrame) -> DataFrame:
        """asked (written, with rep) with the texts of its documents."""
        bit = F.pmod(F.xxhash64("rep"), F.lit(WANTED))
        held = asked.select((bit / 32768).cast("long").alias("bucket"), (bit % 32768).alias("bit")).distinct()
        held = held.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))  # WANTED bits in all
        mine = self.docs.select(F.col("doc_id").alias("rep"), "text").withColumns({"bucket": (bit / 32768).cast("long"), "bit": bit % 32768})
        byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mine = mine.join(F.broadcast(held), "bucket").filter(F.get(F.array(*[byte.bitwiseAND(1 << k) for k in range(8)]), (F.col("bit") % 8).cast("int")) != 0)
        return mine.select("rep", "text").join(asked, "rep")

    def stars(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), once each, that do link, written. A hub's pairs come in groups of MOST at most on average."""
        pairs = self.scratch.write(pairs, "pairs")
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MOST).cast("int").alias("parts"))
        asked = pairs.join(sizes, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("rep"))
        hubs = sizes.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("rep"))
        asked = self.scratch.write(asked.unionByName(hubs).select(F.xxhash64("hub", "part").alias("group"), "hub", "rep"), "asked")
        texts = self.texts(asked).select("group", "hub", "rep", "text")
        texts = texts.repartition("group").sortWithinPartitions("group", "hub", F.col("hub") != F.col("rep"))
        found = self.scratch.write(texts.mapInArrow(_verify(self.words, self.percent), "a bigint, b bigint").distinct(), "links")
        self.scratch.drop(pairs, asked)
        return found

    def groups(self, parts: DataFrame) -> DataFrame:
        """Links of groups (part, rep), of which those of the same documents count once, written."""
        parts = self.scratch.write(parts, "parts")
        once = _distinct_sets(parts, "part").select("part", F.xxhash64("part").alias("group"))
        asked = self.scratch.write(parts.join(once, "part").select("group", "rep"), "asked")
        texts = self.texts(asked).select("group", "rep", "text").repartition("group").sortWithinPartitions("group", "rep")
        found = self.scratch.write(texts.mapInArrow(_compare(self.words, self.percent), "a bigint, b bigint").distinct(), "links")
        self.scratch.drop(parts, asked)
        return found


def _distinct_sets(rows: DataFrame, key: str, *more) -> DataFrame:
    """One key of each set of documents (rep), by its size and two sums of hashes."""
    hashed = lambda salt: F.sum(F.xxhash64("rep", F.lit(salt)).cast("decimal(20,0)"))
    sets = rows.groupBy(key).agg(F.count("*").alias("n"), hashed(3).alias("one"), hashed(7).alias("two"), *more)
    return sets.groupBy("n", "one", "two").agg(F.min(F.struct(key, *[c for c in sets.columns if c not in (key, "n", "one", "two")])).alias("first")).select("n", "first.*")


def _blocks(rows: DataFrame) -> DataFrame:
    """Documents of tiles with several components (tile, rep, component, n_shingles), by blocks: tiles of the same documents
    count once, larger ones meet by parts."""
    once = _distinct_sets(rows, "tile", F.sum("n_shingles").alias("w"))
    once = once.select("tile", F.greatest(F.ceil(F.col("n") / MOST), F.ceil(F.col("w") / HEAVY)).cast("int").alias("parts"))
    own = rows.join(once, "tile").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), "both").when(F.col("part") < F.col("other"), "row").otherwise("column")
    return met.select(F.xxhash64("tile", low, high).alias("block"), "rep", "component", side.alias("side"))


def join_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A document's set holds the distinct runs of `words` words (A-Z as a-z), or all its words as one where they are
    fewer. Two documents are linked if 100 * common >= percent * united; component_id is the least id that links
    reach. A document without words (null and empty texts) has an empty set and no links. Rows that repeat an id count as
    one document with all their texts; a row with a null id is linked with nothing and has no component. Ids are
    integers. Other columns are ignored. An empty table gives an empty result. Sets are of 64-bit hashes of the runs.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = scratch.write(plain.mapInArrow(_sketch(words, percent), "doc_id bigint, n_shingles bigint, digest binary, mark binary"), "sketch")
    known = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "mark")).alias("first"))
    short = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    classes = scratch.write(classes.select("digest", short.alias("short"), F.col("first.doc_id").alias("rep"), F.col("first.n_shingles").alias("n_shingles"), F.col("first.mark").alias("mark")), "classes")
    join = _Join(plain, classes, scratch, words, percent)

    entries = plain.filter("doc_id is not null").mapInArrow(_tiles(words, percent), "tile bigint, short bigint")
    shared = entries.groupBy("tile").agg(F.min("short").alias("least"), F.max("short").alias("most")).filter("least <> most").select("tile", "least")
    shared = scratch.write(shared, "shared")
    met = scratch.write(entries.join(shared, "tile").distinct(), "met")
    star = met.filter("short <> least").select(F.col("least").alias("a_short"), F.col("short").alias("b_short")).distinct()
    links = join.stars(join.likely(star).distinct())
    # an id with several texts is one document: the classes of its texts are linked by the id
    repeated = known.groupBy("doc_id").agg(F.countDistinct("digest").alias("texts")).filter("texts > 1").select("doc_id")
    own = known.join(repeated, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
    links = scratch.write(links.unionByName(own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")
    found = components(links, scratch)

    named = classes.select("short", "rep", "n_shingles").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("short", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    named = met.select("tile", "short").join(scratch.write(named, "named"), "short").select("tile", "rep", "n_shingles", "component")
    several = named.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("tile")
    still = scratch.write(named.join(scratch.write(several, "several"), "tile"), "still")
    scratch.drop(met, shared)
    blocks = _blocks(still).join(classes.select("rep", "n_shingles", "mark"), "rep").select("rep", "component", "n_shingles", "mark", "side", "block")
    more = join.groups(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_between(percent), "part string, rep bigint"))
    if not more.isEmpty():
        found = components(links.unionByName(more), scratch)

    of = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(scratch.write(of, "of"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS df FROM s GROUP BY 1 HAVING count(*) > 1),
-- documents of similarity 0.8 share one of the rarest fifth of either's shingles
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(f.df, 1), s.g) AS k FROM s JOIN n USING (doc_id) LEFT JOIN f USING (g)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.k <= a.n - ceil(a.n * 0.8) + 1 AND b.k <= b.n - ceil(b.n * 0.8) + 1),
m AS (SELECT c.a, c.b, count(*) AS both_ FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 80 * (p.n + q.n - both_)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, a AS r FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(x.r, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1) x USING (doc_id)
"""
