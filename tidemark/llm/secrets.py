"""Secret scanning over a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query of the trigrams that every match must contain. Texts
are indexed block by block where they lie: a posting list of texts for each trigram that some query names. Queries
intersect and unite posting lists, and only the texts they leave are searched. A rule without mandatory trigrams
searches all texts. No rule reads a run of characters again from each of its places, so time grows with the text's length alone. Trigrams are of bytes with A-Z as a-z; postings may name a text too many, never one too few.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _words as W
from tidemark.llm._common import table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0  # characters of that group; matches with fewer are dropped after matching
    base: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)


#: The base rules, in listed order, then well-known public formats of keys.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24, True),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{16,}", re.IGNORECASE),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

#: A query is True, a trigram, or ("and" | "or", queries).
MOST_STRINGS = 32


def _both(op: str, queries: list):
    if op == "and":
        queries = [q for q in queries if q is not True]
        if not queries:
            return True
    elif any(q is True for q in queries):
        return True
    queries = list(dict.fromkeys(queries))
    return queries[0] if len(queries) == 1 else (op, tuple(queries))


def _of_strings(strings: set[str]):
    def one(s: str):
        b = s.lower().encode()
        return _both("and", [b[i : i + 3] for i in range(len(b) - 2)])

    return _both("or", [one(s) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, object]:
    """All strings that the sequence can be, if few, and a query that holds in every match of it."""
    held, queries, exact = {""}, [], True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a, b in itertools.product(held, strings)}
            continue
        queries += [_of_strings(held), query]
        exact, held = False, {""} if strings is None else strings
    if exact:
        return held, _of_strings(held)
    return None, _both("and", [*queries, _of_strings(held)])


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(arg)}, True
    if op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 4:
        return {chr(v) for _, v in arg}, True
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        found = [_walk(x) for x in arg[1]]
        strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
        return (strings if strings is not None and len(strings) <= MOST_STRINGS else None), _both("or", [q for _, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, body = arg
        strings, query = _walk(body)
        if strings is not None and most == 1:
            return strings | {""} if least == 0 else strings, True
        return None, query if least else True
    return None, True  # classes, anchors and all else promise nothing


def trigram_query(rule: Rule):
    strings, query = _walk(parser.parse(rule.pattern, rule.flags))
    return query


def _names(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_names, query[1]))


class TrigramIndex:
    """Posting lists, as a bit for each text of a block, of the trigrams that some query names."""

    def __init__(self, queries: list):
        named = sorted(set().union(*map(_names, queries)))
        self.codes = np.array([b[0] << 16 | b[1] << 8 | b[2] for b in named], np.int64)
        self.row = {b: i for i, b in enumerate(named)}
        self.starts = np.zeros(1 << 16, bool)
        self.starts[self.codes >> 8] = True

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """data: the block's bytes, offsets: its texts' bounds within. A row for each trigram, a column for each text."""
        low = np.take(W._LOWER, data)
        out = np.zeros((len(self.codes), len(offsets) - 1), bool)
        if len(low) < 3 or not len(self.codes):
            return out
        pairs = low[:-2].astype(np.uint16) << 8 | low[1:-1]
        at = np.flatnonzero(np.take(self.starts, pairs))
        codes = pairs[at].astype(np.int64) << 8 | low[at + 2]
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        ok = self.codes[i] == codes
        out[i[ok], np.searchsorted(offsets, at[ok], side="right") - 1] = True
        return out

    def texts(self, query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.row[query]]
        parts = [self.texts(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def spans_of(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _long_runs(rule: Rule) -> re.Pattern | None:
    """For a rule that is one class repeated: a pattern that only runs of the least length match, found faster."""
    parsed = parser.parse(rule.pattern, rule.flags)
    if rule.group == 0 and len(parsed) == 1 and parsed[0][0] is C.MAX_REPEAT and parsed[0][1][0] == 1 and rule.pattern.endswith("]+"):
        return re.compile(rule.pattern[:-1] + f"{{{rule.least},}}", rule.flags | re.ASCII)
    return None


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r) for r in rules]
        regexes = [_long_runs(r) or r.regex for r in rules]
        index = TrigramIndex(queries)
        full = [k for k, q in enumerate(queries) if q is True]
        for batch in batches:
            offsets, data = W.buffers(batch.column("text"))
            found: dict[int, list[tuple[int, int, int]]] = {}
            for i, j in W.runs(offsets, 1 << 20):
                a = int(offsets[i])
                block, bounds = data[a : int(offsets[j])], offsets[i : j + 1] - a
                postings = index.postings(block, bounds)
                left = np.stack([index.texts(q, postings) for q in queries])
                for t in range(j - i) if full else np.flatnonzero(left.any(axis=0)):
                    text = str(block[bounds[t] : bounds[t + 1]], "utf-8")
                    for k in np.flatnonzero(left[:, t]):
                        for s, e in spans_of(rules[k], regexes[k], text):
                            found.setdefault(i + int(t), []).append((s, int(k), e))
            yield _digest(batch.column("doc_id"), found, rules)

    return run


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def _digest(ids: pa.Array, found: dict, rules: tuple[Rule, ...]) -> pa.RecordBatch:
    base = [k for k, r in enumerate(rules) if r.base]
    counts: dict[int, list[int]] = {k: [] for k in base}
    shas, spans = [], []
    for i in range(len(ids)):
        own = sorted(found.get(i, ()))
        for k in base:
            counts[k].append(sum(x[1] == k for x in own))
        shas.append(hashlib.sha256(_joined([x for x in own if x[1] in counts], rules).encode()).hexdigest())
        spans.append(_joined(own, rules))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(counts[k], pa.int64()) for k in base), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, a count for each base rule, base_sha256 and spans.

    spans lists kind:start:end of every match (code points, end exclusive) by start, then by the rules' order;
    base_sha256 digests those of base rules in the same form. Null and empty texts have no spans; a text with none
    has an empty list, whose digest is that of the empty string. Repeated rows are scanned each by itself. Other
    columns are ignored. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = "".join(f"n_{r.kind} bigint, " for r in rules if r.base)
    return plain.mapInArrow(_scan(tuple(rules)), f"doc_id {dict(plain.dtypes)['doc_id']}, {base}base_sha256 string, spans string")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
