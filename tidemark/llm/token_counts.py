"""Token counts of whole texts, in Arrow functions that return lengths only.

A text is split where a space or line end follows something that is no white space: the vocabulary's pre-tokenizer
never joins a token across that point, so the counts of the parts add up, and a long text costs no more than as many
short ones. Texts go through in batches of about CHUNK_BYTES, balanced by bytes.

Parts of plain characters are encoded from the vocabulary file's own ranks by tiktoken, several times as fast as the
tokenizers library and equal to it there; a part with any other character goes through the library itself, in batches.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import table

LIMIT = 1024
CHUNK_BYTES = 1 << 20
PART_CHARS = 1 << 15

#: The pre-tokenizer of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that both libraries' regular expressions class alike, of whatever Unicode version they are.
_OTHER = re.compile("[^\t\n\r -~\xa1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]")
_SAFE = re.compile(r"[!-~\xa1-\u024f](?=[ \n])")


def byte_values() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, by rule: printable bytes stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextCounter:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parsed, values = json.loads(spec), byte_values()
        self.specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        vocabulary, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        plain = (
            parsed["normalizer"] is None
            and {k: v for k, v in parsed["pre_tokenizer"].items() if k != "trim_offsets"} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
            and merged == sorted(merged)  # else merges and ranks could differ
            and not any(t[k] for t in parsed["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        self.ranks = None
        if plain:
            ranks = {bytes(values[c] for c in token): i for token, i in vocabulary.items() if token not in self.specials}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        self.allowed = set(self.specials)

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART_CHARS:
            m = _SAFE.search(text, at + PART_CHARS)
            if not m:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def counts(self, texts: list[str]) -> list[int]:
        out, late = [0] * len(texts), []
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if self.ranks is None or _OTHER.search(part):
                    late.append((i, part))
                else:
                    out[i] += len(self.ranks.encode_to_numpy(part, allowed_special=self.allowed))
        for k in range(0, len(late), 64):
            some = late[k : k + 64]
            for (i, _), e in zip(some, self.library.encode_batch_fast([p for _, p in some], add_special_tokens=False), strict=True):
                out[i] += len(e)
        return out


_counters: dict[int, TextCounter] = {}


def _counter(spec) -> TextCounter:
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = TextCounter(spec)
    return _counters[key]


def _count(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            n_bytes, counts, held, size = batch.column("n_bytes").to_pylist(), [], [], 0
            for text, b in zip(batch.column("text"), n_bytes, strict=True):
                held.append(text.as_py())
                size += b
                if size >= CHUNK_BYTES:
                    counts += counter.counts(held)
                    held, size = [], 0
            counts += counter.counts(held) if held else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer_file is a tokenizers .json with a byte-level pre-tokenizer. No begin, end or padding tokens; a special
    token's string inside a text counts as that token, as by the library's default. Null and empty texts have none.
    Repeated rows are counted each by itself. Other columns are ignored. An empty table gives an empty result.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary's size, whatever the input
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = plain.mapInArrow(_count(spec), f"doc_id {dict(plain.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
