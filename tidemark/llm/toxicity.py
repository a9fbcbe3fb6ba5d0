"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, all in numpy.

A word enters as its own hashed vector and the mean vector of its character n-grams. Windows of WINDOW words, each
STRIDE words after the one before, cover every text; each window's states are pooled by attention into one logit, and
the highest window decides the document. Training picks each document's window by the model of the moment, with the
label of the document.

A batch looks up its distinct words once; windows index into their projected vectors, so recurrence is the main work
and runs for thousands of windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _words as W
from tidemark.llm._common import labelled_sample, remainder, table

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS, DIM, HIDDEN = 16, 16, 8, 8
WORD_ROWS, GRAM_ROWS = 1 << WORD_BITS, 1 << GRAM_BITS
GRAMS = (3, 5)
#: The most labelled documents that are learnt from, and the longest of them (in bytes); both bound the driver's memory.
MOST_LABELLED, LONGEST_LABELLED = 4000, 32_768
STEPS, BATCH, RATE, SEED = 150, 256, 0.01, 7
#: A word or n-gram in fewer training documents has no vector; log odds shrink as if so many more had been undecided.
LEAST_SEEN, SHRINK = 3, 5
#: Windows of a document of label 0 that training chooses from, drawn at random; of label 1 it sees all.
OTHERS = 10
THRESHOLD = 0.3
#: Bytes of text whose distinct words are looked up together, and windows that recur together.
BLOCK, TOGETHER = 1 << 21, 2048


def _word_rows(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _grams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: rows of every word's n-grams, and bounds by word. A word stands between two marks."""
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    if not len(s):
        return [(np.zeros(0, np.int64), np.zeros(1, np.int64)) for _ in GRAMS]
    inner = np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1], size)
    codes = np.take(W._LOWER, data[np.clip(inner + np.repeat(s - 1, size), 0, len(data) - 1)]).astype(np.uint64)
    codes[at[:-1]], codes[at[1:] - 1] = 1, 2
    left = np.repeat(size, size) - inner  # bytes from here to the word's end
    out = []
    for n in GRAMS:
        ok = np.flatnonzero(left >= n)
        code = np.full(len(ok), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + codes[ok + k]
        rows = ((code ^ (code >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
        out.append((rows, np.concatenate([[0], np.cumsum(np.maximum(size - n + 1, 0))])))
    return out


def _means(grams: list[tuple[np.ndarray, np.ndarray]], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(grams[0][1]) - 1, vectors.shape[1]), np.float32)
    for rows, bounds in grams:
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            out[some] += np.add.reduceat(np.take(vectors, rows, axis=0), bounds[:-1][some], axis=0)
    return out / np.maximum(sum(np.diff(b) for _, b in grams), 1)[:, None].astype(np.float32)


def _some(grams: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of some of the words."""
    out = []
    for rows, bounds in grams:
        count = np.diff(bounds)[words]
        own = np.concatenate([[0], np.cumsum(count)])
        out.append((rows[np.repeat(bounds[words] - own[:-1], count) + np.arange(own[-1])], own))
    return out


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of each window, and its row; every row with words has one at least."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][row] + nth * STRIDE
    return first, np.minimum(first + WINDOW, bounds[1:][row]), row


def _sigmoid(x: np.ndarray, by: float = -1.0) -> np.ndarray:
    """In place, of x (or of -x * by); exp() is the fastest of numpy's functions that would do."""
    np.multiply(x, x.dtype.type(by), out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x = _sigmoid(x, -2.0)
    x *= 2
    x -= 1
    return x


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        norm = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "words": norm(WORD_ROWS, DIM, by=0.05), "grams": norm(GRAM_ROWS, DIM, by=0.05), "x": norm(2 * DIM, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": norm(HIDDEN, 3 * HIDDEN), "ub": norm(HIDDEN, 3 * HIDDEN), "att": norm(2 * HIDDEN), "out": norm(2 * HIDDEN), "b": np.zeros(1, np.float32),
        }
        self.constant: float | None = None
        self.prior = 0.0  # the logit of a text without words

    def inputs(self, word_rows: np.ndarray, grams: list) -> np.ndarray:
        return np.concatenate([self.p["words"][word_rows], _means(grams, self.p["grams"])], axis=1)

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs for each distinct word, and a last row for padding, which keeps the state."""
        out = np.zeros((len(inputs) + 1, 6 * HIDDEN), np.float32)
        out[:-1] = inputs @ self.p["x"] + self.p["bx"]
        out[-1, :HIDDEN] = out[-1, 3 * HIDDEN : 4 * HIDDEN] = 30
        return out

    def run(self, table: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, tuple]:
        """Logits of windows (rows of indexes into table, the last index of table being padding)."""
        n, H = len(index), HIDDEN
        weigh, value = np.zeros((WINDOW, n), table.dtype), np.zeros((WINDOW, n), table.dtype)
        trace, turned = [], np.ascontiguousarray(index.T)
        for side, u in enumerate(("uf", "ub")):
            own, U = np.ascontiguousarray(table[:, 3 * H * side : 3 * H * (side + 1)]), self.p[u]
            heads = np.stack([self.p["att"][H * side : H * (side + 1)], self.p["out"][H * side : H * (side + 1)]], axis=1)
            states, h, steps = np.empty((WINDOW, n, H), table.dtype), np.zeros((n, H), table.dtype), []
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                x, hu = np.take(own, turned[t], axis=0), h @ U
                gates = _sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
                z, r = gates[:, :H], gates[:, H:]
                c = r * hu[:, 2 * H :]
                c += x[:, 2 * H :]
                c = _tanh(c)
                new = np.subtract(h, c, out=states[t])
                new *= z
                new += c
                if keep:
                    steps.append((t, h, z, r, c, hu[:, 2 * H :], new))
                h = new
            both = states.reshape(-1, H) @ heads
            weigh += both[:, 0].reshape(WINDOW, n)
            value += both[:, 1].reshape(WINDOW, n)
            trace.append(steps)
        weigh, value = weigh.T, value.T
        weigh[index == len(table) - 1] = -1e9
        a = np.exp(weigh - weigh.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        return (a * value).sum(axis=1) + self.p["b"][0], trace, (a, value)

    def gradients(self, index: np.ndarray, inputs: np.ndarray, table: np.ndarray, trace: list, pooled: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of all parameters but the two tables, and of the inputs."""
        H, (a, value) = HIDDEN, pooled
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "grams")}
        g["b"][0] = dlogit.sum()
        dvalue = a * dlogit[:, None]
        dweigh = a * (value - (a * value).sum(axis=1, keepdims=True)) * dlogit[:, None]
        dtable = np.zeros_like(table)
        for side, u in enumerate(("uf", "ub")):
            att, out, U = self.p["att"][H * side : H * (side + 1)], self.p["out"][H * side : H * (side + 1)], self.p[u]
            dh, rows, grads = np.zeros((len(index), H), np.float32), [], []
            for t, h, z, r, c, hn, new in reversed(trace[side]):
                g["att"][H * side : H * (side + 1)] += dweigh[:, t] @ new
                g["out"][H * side : H * (side + 1)] += dvalue[:, t] @ new
                dnew = dh + dweigh[:, t, None] * att + dvalue[:, t, None] * out
                dz = dnew * (h - c) * z * (1 - z)
                dc = dnew * (1 - z) * (1 - c * c)
                dr = dc * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], axis=1)
                g[u] += h.T @ dhu
                dh = dnew * z + dhu @ U.T
                rows.append(index[:, t])
                grads.append(np.concatenate([dz, dr, dc], axis=1))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            for k in range(3 * H):
                dtable[:, 3 * H * side + k] = np.bincount(rows, grads[:, k], len(table))
        dtable = dtable[:-1]
        g["x"], g["bx"] = inputs.T @ dtable, dtable.sum(axis=0)
        return g, dtable @ self.p["x"].T

    def texts(self, column: pa.Array) -> np.ndarray:
        """A logit for each text of a string column; of a text without words, that of the labels' mean."""
        if self.constant is not None:
            return np.full(len(column), self.constant)
        out = np.full(len(column), self.prior)
        data = W.buffers(column)[1]
        for rows, s, e, h, bounds in _blocks(column):
            distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            table = self.project(self.inputs(_word_rows(distinct), _grams(data, s[at], e[at])))
            first, end, row = _windows(bounds)
            best = np.full(len(bounds) - 1, -np.inf)
            for i in range(0, len(first), TOGETHER):
                logits = self.run(table, _index(first[i : i + TOGETHER], end[i : i + TOGETHER], inverse, len(distinct)))[0]
                np.maximum.at(best, row[i : i + TOGETHER], logits)
            some = np.isfinite(best)
            out[rows[some]] = best[some]
        return out


def _index(first: np.ndarray, end: np.ndarray, inverse: np.ndarray, padding: int) -> np.ndarray:
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], inverse[np.minimum(at, len(inverse) - 1)], padding)


def _blocks(column: pa.Array) -> Iterator[tuple]:
    """Words of consecutive rows, about BLOCK bytes at a time: row numbers, starts, ends, hashes, bounds."""
    held, size = [], 0
    for i, j, (s, e, h), bounds in W.documents(column, spans=True):
        held.append((np.arange(i, j), s, e, h, np.diff(bounds)))
        size += int(e[-1] - s[0]) if len(e) else 0
        if size >= BLOCK:
            yield _merged(held)
            held, size = [], 0
    if held:
        yield _merged(held)


def _merged(held: list) -> tuple:
    rows, s, e, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    return rows, s, e, h, np.concatenate([[0], np.cumsum(n)])


def _log_odds(presence, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's presence in documents of label 1 against label 0, and whether enough have it; presence gives (rows, documents) in parts."""
    p, q = np.zeros(size), np.zeros(size)
    for rows, doc in presence:
        seen = np.unique(rows * len(y) + doc)
        row, one = seen // len(y), y[seen % len(y)] > 0
        p += np.bincount(row[one], minlength=size)
        q += np.bincount(row[~one], minlength=size)
    odds = np.log((p + 0.5) / (y.sum() + 1)) - np.log((q + 0.5) / (len(y) - y.sum() + 1))
    return odds * (p + q) / (p + q + SHRINK), p + q >= LEAST_SEEN


def _presence(inverse: np.ndarray, bounds: np.ndarray, grams: list | None, word_rows: np.ndarray, step: int = 128) -> Iterator[tuple]:
    """Rows of the words, or of their n-grams, with the documents that have them; `step` documents at a time."""
    for i in range(0, len(bounds) - 1, step):
        j = min(i + step, len(bounds) - 1)
        doc = np.repeat(np.arange(i, j), np.diff(bounds[i : j + 1]))
        own = inverse[bounds[i] : bounds[j]]
        if grams is None:
            yield word_rows[own], doc
            continue
        some = np.unique(own * (len(bounds) - 1) + doc)
        for rows, at in _some(grams, some // (len(bounds) - 1)):
            yield rows, np.repeat(some % (len(bounds) - 1), np.diff(at))


def train(texts: list[str], y: np.ndarray) -> Network:
    """Without both labels, all scores are near the labels' mean (0.5 without any)."""
    net, n = Network(), len(y)
    p = (y.sum() + 0.5) / (n + 1)
    net.prior = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        net.constant = net.prior
        return net
    column = pa.array(texts, pa.large_string())
    data, rng = W.buffers(column)[1], np.random.default_rng(SEED)
    rows, s, e, h, bounds = _merged([(np.arange(i, j), s, e, h, np.diff(b)) for i, j, (s, e, h), b in W.documents(column, spans=True)])
    distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    word_rows, grams = _word_rows(distinct), _grams(data, s[at], e[at])
    first, end, owner = _windows(bounds)
    del s, e, h, rows
    # the first coordinate of both tables starts as log odds, so training begins at the words that tell
    held = {}
    for name, own, size in (("words", None, WORD_ROWS), ("grams", grams, GRAM_ROWS)):
        odds, enough = _log_odds(_presence(inverse, bounds, own, word_rows), y, size)
        net.p[name][:, 0] = np.clip(odds, -4, 4) / 4
        net.p[name][~enough] = 0
        held[name] = ~enough
    # the windows that training chooses from, in order of their documents
    drawn = rng.permutation(len(first))
    drawn = drawn[np.argsort(owner[drawn], kind="stable")]
    count = np.bincount(owner, minlength=n)
    nth = np.arange(len(first)) - (np.cumsum(count) - count)[owner[drawn]]
    open_ = np.sort(drawn[(y[owner[drawn]] > 0) | (nth < OTHERS)])
    first, end, owner = first[open_], end[open_], owner[open_]
    likely = net.inputs(word_rows, grams)[:, [0, DIM]].sum(axis=1)
    reach = np.concatenate([likely[inverse[np.minimum(first[i : i + TOGETHER, None] + np.arange(WINDOW), end[i : i + TOGETHER, None] - 1)]].max(axis=1) for i in range(0, len(first), TOGETHER)])
    spread, squares, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    while step < STEPS:
        # the window of each document that scores highest, and for label 0 one more at random
        order = np.lexsort((reach, owner))
        top = order[np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))]
        other = rng.permutation(np.flatnonzero(y[owner] == 0))[: int((y == 0).sum())]
        chosen = np.concatenate([top, other])
        weight = np.where(y[owner[chosen]] > 0, 1.0, 0.5).astype(np.float32)
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(chosen), BATCH):
            own = shuffled[i : i + BATCH]
            w = chosen[own]
            index = _index(first[w], end[w], inverse, len(distinct))
            used = np.unique(index)
            used = used[used < len(distinct)]
            local = np.where(index == len(distinct), len(used), np.searchsorted(used, index))
            few = _some(grams, used)
            inputs = net.inputs(word_rows[used], few)
            projected = net.project(inputs)
            logits, trace, pooled = net.run(projected, local, keep=True)
            d = ((1 / (1 + np.exp(-logits)) - (y[owner[w]] > 0)) * weight[own] / len(own)).astype(np.float32)
            g, dx = net.gradients(local, inputs, projected, trace, pooled, d)
            g["words"] = np.stack([np.bincount(word_rows[used], dx[:, k], WORD_ROWS) for k in range(DIM)], axis=1).astype(np.float32)
            each = dx[:, DIM:] / np.maximum(sum(np.diff(b) for _, b in few), 1)[:, None]
            hit, per = np.concatenate([r for r, _ in few]), np.concatenate([np.repeat(each, np.diff(b), axis=0) for _, b in few])
            g["grams"] = np.stack([np.bincount(hit, per[:, k], GRAM_ROWS) for k in range(DIM)], axis=1).astype(np.float32)
            for k, rows in held.items():
                g[k][rows] = 0
            step += 1
            for k, v in net.p.items():  # Adam
                spread[k] += 0.1 * (g[k] - spread[k])
                squares[k] += 0.001 * (g[k] * g[k] - squares[k])
                v -= (RATE / (1 - 0.9**step) * spread[k] / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if step < STEPS:
            whole = net.project(net.inputs(word_rows, grams))
            reach = np.concatenate([net.run(whole, _index(first[i : i + TOGETHER], end[i : i + TOGETHER], inverse, len(distinct)))[0] for i in range(0, len(first), TOGETHER)])
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, held: int = 2, most: int = MOST_LABELLED, longest: int = LONGEST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Network:
    short = docs.filter(F.coalesce(F.octet_length(text_col), F.lit(0)) <= longest)
    labels = labels.join(short.select(F.col(id_col)), id_col, "left_semi")
    sample = labelled_sample(short, labels, label, remainder(F.col("doc_id"), fold) != held, most, id_col, text_col)
    rows = sorted((r["doc_id"], r["y"], r["text"]) for r in sample.select("doc_id", "y", "text").collect())  # at most `most` texts of at most `longest` bytes
    return train([r[2] for r in rows], np.array([float(r[1] > 0) for r in rows]))


def _score(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(network.value.texts(batch.column("text")), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fold: int = 4, held: int = 2, most: int = MOST_LABELLED, longest: int = LONGEST_LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= THRESHOLD).

    Learns from at most `most` labelled documents of at most `longest` bytes whose fold isn't the held one; text alone is scored, of whatever length. Null and
    empty texts get the score of a text without words. Repeated rows get equal scores. Other columns are ignored. An
    empty table gives an empty result; without labels every score is 0.5.
    """
    network = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, fold, held, most, longest, id_col, text_col))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = plain.mapInArrow(_score(network), f"doc_id {dict(plain.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
