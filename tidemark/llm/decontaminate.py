"""Benchmark decontamination: a BM25 inverted index of the test items, asked about every passage of every document.

Items are indexed in pieces of at most PIECE words. A term's posting list is cut into blocks of BLOCK pieces, each
with its greatest impact, as in block-max WAND. Impacts are divided by a piece's score against itself, so one
threshold fits all pieces. Passages are windows of 2 * PIECE words, one each PIECE words: every run of PIECE words lies
in one. Bounds are taken in turn, for thousands of passages at once: block by block, the greatest impacts of the
passage's rare terms and what all frequent terms could add; those of all its distinct terms; and the scores of pieces in
the blocks left. Every piece at the threshold or
above is retrieved; its item counts as leaked where enough of its question and of its answer, as runs of three
words, stand in the document.

An index holds at most MOST_PIECES; a larger benchmark is split over several indexes, each asked in a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _words as W
from tidemark.llm._common import table

PIECE, BLOCK = 48, 4
K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP, RUN, LEAST_WORDS = 0.5, 3, 6
MOST_PIECES = 20_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that comes as one text: its last sentences, of LEAST_WORDS together or more, answer the rest."""
    parts = _SENTENCE.split(text.strip())
    while len(parts) > 1 and len(parts[-1].split()) < LEAST_WORDS:
        parts[-2:] = [" ".join(parts[-2:])]
    question = " ".join(parts[:-1])
    return (question, parts[-1]) if len(question.split()) >= LEAST_WORDS else (text, "")


def _hashes(text: str) -> np.ndarray:
    parts = [h for _, _, h, _ in W.documents(pa.array([text], pa.large_string()))]
    return parts[0] if parts else np.zeros(0, np.uint64)


def _runs(h: np.ndarray) -> np.ndarray:
    return np.unique(W.shingles(h, np.array([0, len(h)]), RUN)[0])


def _at_least(threshold: float, cell: np.ndarray, weight: np.ndarray, cells: int) -> np.ndarray:
    """Cells whose weights sum to the threshold or more."""
    if cells <= 1 << 24:
        return np.flatnonzero(np.bincount(cell, weight, cells) >= threshold)
    cell, of = np.unique(cell, return_inverse=True)
    return cell[np.bincount(of, weight, len(cell)) >= threshold]


def _pieces(rows: list[tuple]) -> tuple[list, list[np.ndarray], list[int]]:
    """Items with words, their pieces, and the item of each piece. rows: (item id, question, answer)."""
    items, pieces, item_of = [], [], []
    for item_id, question, answer in rows:
        whole = np.concatenate([_hashes(question), _hashes(answer)])
        if not len(whole):
            continue
        items.append((item_id, _runs(_hashes(question)), _runs(_hashes(answer))))
        for k in range(0, len(whole), PIECE):
            # a short rest is taken with the words before it, so no piece is but a few words
            pieces.append(whole[max(0, min(k, len(whole) - PIECE)) : k + PIECE])
            item_of.append(len(items) - 1)
    return items, pieces, item_of


@dataclass
class Counts:
    """Of all pieces of a benchmark: their number, their words, and of each term (sorted) how many have it."""

    n: int
    words: int
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(pieces: list[np.ndarray]) -> Counts:
        terms, df = np.unique(np.concatenate([np.unique(p) for p in pieces]) if pieces else np.zeros(0, np.uint64), return_counts=True)
        return Counts(len(pieces), sum(len(p) for p in pieces), terms, df)

    def plus(self, other: Counts) -> Counts:
        terms, at = np.unique(np.concatenate([self.terms, other.terms]), return_inverse=True)
        df = np.zeros(len(terms), np.int64)
        np.add.at(df, at, np.concatenate([self.df, other.df]))
        return Counts(self.n + other.n, self.words + other.words, terms, df)


@dataclass
class Index:
    terms: np.ndarray  # hashes, sorted
    rare: np.ndarray  # of each term; the others give a piece `rest` at most, all together
    rest: float
    seen: np.ndarray  # by the highest 16 bits of a hash: whether some rare term has them
    most: np.ndarray  # greatest impact of each term
    bounds: np.ndarray  # of each term's postings
    pieces: np.ndarray
    impacts: np.ndarray
    block_bounds: np.ndarray  # of each term's blocks
    blocks: np.ndarray
    block_most: np.ndarray
    block_at: np.ndarray  # first posting of each block, and the end of the last
    item_of: np.ndarray  # of each piece
    items: list  # (item id, runs of its question, runs of its answer)

    @staticmethod
    def build(rows: list[tuple], counts: Counts | None = None) -> Index:
        """rows: (item id, question, answer). counts: those of all items, where rows are a part of them."""
        items, pieces, item_of = _pieces(rows)
        counts = counts or Counts.of(pieces)
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        terms, term = np.unique(flat, return_inverse=True)
        pair, tf = np.unique(term * max(1, len(pieces)) + owner, return_counts=True)
        term, piece = pair // max(1, len(pieces)), pair % max(1, len(pieces))
        df, size = np.bincount(term, minlength=len(terms)), np.array([len(p) for p in pieces])
        among = counts.df[np.searchsorted(counts.terms, terms)]
        idf = np.log1p((counts.n - among + 0.5) / (among + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[piece] / (counts.words / counts.n))) if len(pair) else np.zeros(0)
        impact = impact / np.bincount(piece, impact, len(pieces))[piece]
        bounds = np.concatenate([[0], np.cumsum(df)])
        cell = term * (len(pieces) // BLOCK + 1) + piece // BLOCK
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        rare, rest = np.ones(len(terms), bool), 0.0
        rank = np.empty(len(terms), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(terms))
        low, high = 0, len(terms)
        while low < high:  # the most frequent terms that give no piece over a quarter of the threshold
            k = (low + high + 1) // 2
            held = rank[term] < k
            sums = np.bincount(piece[held], impact[held], len(pieces))
            if sums.max() <= THRESHOLD / 4:
                low, rest = k, float(sums.max())
            else:
                high = k - 1
        rare = rank >= low
        seen = np.zeros(1 << 16, bool)
        seen[(terms[rare] >> np.uint64(48)).astype(np.int64)] = True
        return Index(
            terms, rare, rest, seen, np.maximum.reduceat(impact, bounds[:-1]) if len(terms) else impact, bounds, piece, impact,
            np.searchsorted(at, bounds), piece[at] // BLOCK, np.maximum.reduceat(impact, at) if len(at) else impact, np.append(at, len(cell)), np.array(item_of, np.int64), items,
        )

    def passages(self, h: np.ndarray, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) where a passage of the row scores the threshold or more for a piece; the greatest score of each."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms):
            return none
        size = np.diff(bounds)
        count = np.maximum(-(-size // PIECE) - 1, 1)  # passages of each row
        offset = np.concatenate([[0], np.cumsum(count)])
        # passages with a block for which the rare terms leave too little for the others to make up go
        at, term = self._known(h, np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)]))
        at, term = at[self.rare[term]], term[self.rare[term]]
        row = np.searchsorted(bounds, at, side="right") - 1
        k = (at - bounds[row]) // PIECE  # these words belong to the row's passages k - 1 and k, where there are such
        first, second = offset[row] + np.maximum(k - 1, 0), offset[row] + np.minimum(k, count[row] - 1)
        two = second > first
        passage, term = np.concatenate([first, second[two]]), np.concatenate([term, term[two]])
        n = np.diff(self.block_bounds)[term]
        entry = np.repeat(self.block_bounds[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        width = int(self.blocks.max()) + 1
        left = _at_least(threshold - self.rest, np.repeat(passage, n) * width + self.blocks[entry], self.block_most[entry], int(offset[-1]) * width)
        left = np.unique(left // width)
        if not len(left):
            return none
        # all words of the passages that are left, each once a passage
        row = np.searchsorted(offset, left, side="right") - 1
        start = bounds[row] + (left - offset[row]) * PIECE
        n = np.minimum(start + 2 * PIECE, bounds[row + 1]) - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        passage = np.repeat(left, n)
        nth, term = self._known(h[at], np.arange(len(at)))
        pair = np.unique(passage[nth] * len(self.terms) + term)
        passage, term = pair // len(self.terms), pair % len(self.terms)
        keep = (np.bincount(passage, self.most[term], offset[-1]) >= threshold)[passage]
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return none
        # the bound block by block
        n = np.diff(self.block_bounds)[term]
        entry = np.repeat(self.block_bounds[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        width = int(self.blocks.max()) + 1
        cell, of = np.unique(np.repeat(passage, n) * width + self.blocks[entry], return_inverse=True)
        left = (np.bincount(of, self.block_most[entry], len(cell)) >= threshold)[of]
        entry, passage = entry[left], np.repeat(passage, n)[left]
        if not len(entry):
            return none
        # scores in the blocks that are left
        n = self.block_at[entry + 1] - self.block_at[entry]
        posting = np.repeat(self.block_at[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, of = np.unique(np.repeat(passage, n) * len(self.item_of) + self.pieces[posting], return_inverse=True)
        score = np.bincount(of, self.impacts[posting], len(cell))
        cell, score = cell[score >= threshold], score[score >= threshold]
        row = np.searchsorted(offset, cell // len(self.item_of), side="right") - 1
        item = self.item_of[cell % len(self.item_of)]
        key, of = np.unique(row * len(self.items) + item, return_inverse=True)
        best = np.zeros(len(key))
        np.maximum.at(best, of, score)
        return key // len(self.items), key % len(self.items), best

    def _known(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the positions whose hash is a term's, and the terms."""
        term = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[term] == h[at]
        return at[ok], term[ok]

    def leaks(self, column: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[tuple]:
        """(row, item id, score, question overlap, answer overlap) of every leaked item; an item without answer has none to overlap."""
        for i, _, h, bounds in W.documents(column):
            for row, item, score in zip(*self.passages(h, bounds, threshold), strict=True):
                item_id, question, answer = self.items[item]
                own = _runs(h[bounds[row] : bounds[row + 1]])
                q, a = (float(np.isin(x, own).mean()) if len(x) else 1.0 for x in (question, answer))
                if q >= overlap and a >= overlap:
                    yield i + int(row), item_id, float(score), q, a


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> Iterator:
    """Broadcast indexes of at most about MOST_PIECES pieces each."""
    spark = benchmark.sparkSession
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), answer.alias("answer"))
    pieces = items.agg(F.sum((F.length("text") + F.length(F.coalesce("answer", F.lit("")))) / (2 * PIECE) + 1)).first()[0] or 0  # two characters a word at least
    parts = int(pieces // MOST_PIECES) + 1

    def part(k: int) -> list[tuple]:
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        rows = [(r["item_id"], *((r["text"], r["answer"]) if answer_col else split_item(r["text"]))) for r in own.collect()]  # bounded by MOST_PIECES
        return sorted(rows, key=repr)

    # an item's score is the same however many parts there are
    counts = None
    for k in range(parts if parts > 1 else 0):
        own = Counts.of(_pieces(part(k))[1])
        counts = own if counts is None else counts.plus(own)
    for k in range(parts):
        yield spark.sparkContext.broadcast(Index.build(part(k), counts))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per leaked item of a document: doc_id, item_id, score, question_overlap, answer_overlap.

    score is the greatest of any passage, as a share of a piece's score against itself. Null and empty texts leak
    nothing; nor does an item without words, or an empty benchmark. Repeated rows are reported each by itself, and so
    are repeated items. Other columns are ignored. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {dict(plain.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)[item_col]}, score double, question_overlap double, answer_overlap double"
    item_type = {f.name: f.dataType for f in benchmark.schema}[item_col]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def run(index):
        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.value.leaks(batch.column("text")))
                rows, items, *numbers = zip(*found, strict=True) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, kind), *(pa.array(x, pa.float64()) for x in numbers)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return inner

    out = None
    for index in _indexes(benchmark, item_col, item_text_col, answer_col):
        part = plain.mapInArrow(run(index), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, in which find_leaks finds nothing."""
    at = docs.columns.index(text_col)

    def run(index):
        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row for row, *_ in index.value.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        return inner

    for index in _indexes(benchmark, item_col, item_text_col, answer_col):
        docs = docs.mapInArrow(run(index), docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
