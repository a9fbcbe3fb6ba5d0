"""Removal of multi-line chunks that repeat across the corpus, with DataFrame operations alone.

A line ends at a line end, or at the end of a clause within one: many texts keep a paragraph to a line, and a passage
pasted into a paragraph must still be found. A hash that rolls over the hashes of two consecutive lines puts a boundary
after most of them; it looks no further back, so text inserted elsewhere doesn't shift the boundaries of a shared
passage. A chunk goes from each boundary to the first one that makes it two lines and LEAST_CHARS long.

Chunks meet by hash, as a few numbers each. Where a hash repeats, in one document or several, the first occurrence (least
id, then hash of the text, then line) stays, and another one is removed if its text equals the first one's byte for byte.
Of chunks that overlap in one document, as many are compared as cover the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, table

#: One pair of lines in so many, a power of two, is no boundary.
JOINED = 16
LEAST_CHARS = 64

_MARK = "\x01"
_ENDINGS = ("\n", ". ", ", ", "! ", "? ", "; ", ": ")


def _lines(text: str) -> str:
    """Lines with their endings. Marks are set and split at, which is several times as fast as a pattern that looks behind; a text that has the mark itself takes the pattern."""
    marked = text
    for end in _ENDINGS:
        quoted = end.replace("\n", "\\n")
        marked = f"replace({marked}, '{quoted}', '{quoted}\\u0001')"
    return f"if(contains({text}, '\\u0001'), split({text}, '(?<=[.!?,;:] )|(?<=\\\\n)'), split({marked}, '\\u0001'))"


def _sum(n: int) -> str:
    return " + ".join([*(f"get(pairs, a + {i})" for i in range(0, n - 1, 2)), *([f"get(lengths, a + {n - 1})"] if n % 2 else [])])


def _chunk(n: str, hashed: str) -> str:
    return f"named_struct('span', shiftleft(cast(a as bigint), 32) + {n}, 'hash', {hashed})"


#: The hash of each line and the next one, which decides on the boundary after them and is that of a chunk of two lines.
_TWOS = "transform(sequence(0, size(hashes) - 2), i -> xxhash64(get(hashes, i), get(hashes, i + 1)))"
#: For each line, and for the end, whether a chunk may begin or end before it.
_BOUND = f"concat(array(true, false), transform(twos, (t, i) -> (t & {JOINED - 1}) <> 0 or i = size(twos) - 1))"
#: Most chunks have two to a few lines. For others lines are counted first; one has a character at least, so that LEAST_CHARS
#: lines always suffice. The last boundary is the end of the text.
_COUNTED = f"""aggregate(slice(lengths, a + 1, {LEAST_CHARS}), named_struct('lines', 0, 'chars', 0),
  (s, n) -> if(s.chars >= {LEAST_CHARS}, s, named_struct('lines', s.lines + 1, 'chars', s.chars + n)), s -> if(s.chars >= {LEAST_CHARS}, greatest(s.lines, 2), null))"""
_NEXT = "coalesce(nullif(array_position(slice(bound, a + n + 1, 64), true), 0), array_position(slice(bound, a + n + 1, size(bound)), true))"
_LONGER = f"get(transform(transform(array({_COUNTED}), n -> if(n is null or a + n >= size(bound), null, n + cast({_NEXT} as int) - 1)), m -> if(m is null, null, {_chunk('m', 'xxhash64(slice(hashes, a + 1, m))')})), 0)"
_PAIRS = "transform(sequence(0, size(lengths) - 2), i -> get(lengths, i) + get(lengths, i + 1))"
_CASES = " ".join(
    f"when {_sum(n)} >= {LEAST_CHARS} and get(bound, a + {n}) then {_chunk(str(n), 't' if n == 2 else 'xxhash64(' + ', '.join(f'get(hashes, a + {i})' for i in range(n)) + ')')}" + f" when a + {n} >= size(hashes) then null" * (n in (2, 4, 7))
    for n in range(2, 11)
)
#: An element for each line but the last; null where none begins.
_CHUNKS = f"transform(twos, (t, a) -> case when not get(bound, a) then null {_CASES} else {_LONGER} end)"
#: A span's first line and its number of lines, in one number.
_A, _N = "cast(shiftright({0}, 32) as int)", "cast({0} & 4294967295 as int)"


def _once(df: DataFrame, keep: list[str], **made: str) -> DataFrame:
    """df's columns keep and the named expressions, each computed once a row: the optimizer doesn't merge a projection
    into the one above it, lambdas included, across the generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in made.items()]))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    others = ["row_others"] if "row_others" in docs.columns else []
    return docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("row_text"), *others).withColumn("row_hash", F.xxhash64("row_text"))


def _same(keyed: DataFrame, found: DataFrame):
    return keyed["row_id"].eqNullSafe(found["own_id"]) & keyed["row_hash"].eqNullSafe(found["own_hash"])


def _start(c: str) -> str:
    return _A.format(f"{c}.span")


def _end(c: str) -> str:
    return f"{_start(c)} + {_N.format(f'{c}.span')}"


#: again, in order of hash and span, in order of span, and whether each may stay: the least id's first with that hash.
_PLACED = "array_sort(transform(again, (c, i) -> named_struct('span', c.span, 'hash', c.hash, 'may_stay', c.least and (i = 0 or get(again, i - 1).hash <> c.hash))))"
#: One of three consecutive chunks that the two others cover needn't be compared.
_CHOSEN = f"filter(goes, (c, i) -> i % 2 = 0 or i = size(goes) - 1 or {_end('get(goes, i - 1)')} < {_start('get(goes, i + 1)')})"


def _bytes(texts: DataFrame, key: list[str], chunks: str) -> DataFrame:
    """A row for each of the chunks: hash, span, may_stay and its bytes."""
    lines = _once(texts, [*key, chunks], lines=_lines("row_text"))
    return lines.select(*key, F.expr(f"""inline(transform({chunks}, c -> named_struct('hash', c.hash, 'span', c.span, 'may_stay', c.may_stay,
      'bytes', array_join(slice(lines, {_start('c')} + 1, {_N.format('c.span')}), ''))))"""))


def _dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, row_text (null as empty), row_kept (what stays of it), row_removed (lines); and row_others, if docs has it."""
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = _keyed(docs, id_col, text_col)
    key = ["row_id", "row_hash"]
    own = [F.col("row_id").alias("own_id"), F.col("row_hash").alias("own_hash")]
    found = _once(keyed, key, lines=_lines("row_text"))
    found = _once(found, key, hashes="transform(lines, x -> xxhash64(x))", lengths="transform(lines, x -> length(x))")
    found = _once(found.filter("size(hashes) > 1"), [*key, "hashes", "lengths"], twos=_TWOS, pairs=_PAIRS)
    found = _once(found, [*key, "hashes", "lengths", "twos", "pairs"], bound=_BOUND)
    chunks = scratch.write(_once(found, key, chunks=_CHUNKS), "chunks")
    found = chunks.selectExpr(*key, "inline(chunks)").filter("hash is not null")
    # an id that repeats may have several texts, or one text several times
    repeated = not chunks.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    # written, so that the join with it is a plain one, of which Spark splits what a frequent chunk makes large
    firsts = found.groupBy("hash").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max(F.isnull("row_id")).alias("none"))
    firsts = scratch.write(firsts.filter("n > 1").select("hash", F.expr("if(none, null, first)").alias("first")), "firsts")
    again = found.join(firsts, "hash").select(*key, F.struct("hash", "span", F.col("row_id").eqNullSafe(F.col("first")).alias("least")).alias("c"))
    # a list for each document: no longer than its own chunks
    gathered = F.collect_set("c") if repeated else F.collect_list("c")
    lists = scratch.write(again.groupBy(*own).agg(F.array_sort(gathered).alias("again")), "again")
    scratch.drop(chunks, firsts)
    # All joins with the documents deal out the same columns alike, so in one plan their texts shuffle once; the lists are what is hashed
    texts = keyed.select("row_id", "row_text", "row_hash").join(lists.hint("shuffle_hash"), _same(keyed, lists)).select(*key, "row_text", "again")
    texts = _once(texts, [*key, "row_text"], placed=_PLACED)
    texts = _once(texts, [*key, "row_text"], stays="filter(placed, c -> c.may_stay)", goes="filter(placed, c -> not c.may_stay)")
    stays = _bytes(texts.filter("size(stays) > 0"), key, "stays")
    goes = _bytes(_once(texts.filter("size(goes) > 0"), [*key, "row_text"], chosen=_CHOSEN), key, "chosen")
    if repeated:
        # of several texts under the least id one has the chunk that stays; a repeated row (same id, same text) shares its fate
        kept = stays.groupBy("hash").agg(F.min(F.struct("row_hash", "span", "bytes")).alias("kept"))
        kept = scratch.write(kept.select("hash", F.col("kept.row_hash").alias("kept_row"), F.col("kept.span").alias("kept_span"), F.col("kept.bytes").alias("kept_bytes")), "kept")
        equal = goes.unionByName(stays).join(kept, "hash").filter("not (may_stay and row_hash = kept_row and span = kept_span)")
    else:
        equal = goes.join(stays.select("hash", F.col("bytes").alias("kept_bytes")), "hash")
    cuts = equal.filter("bytes = kept_bytes").groupBy(*own).agg(F.collect_set("span").alias("spans"))
    out = keyed.join(cuts.hint("shuffle_hash"), _same(keyed, cuts), "left").drop("own_id", "own_hash", "row_hash")
    lost = f"array_distinct(flatten(transform(spans, s -> sequence({_A.format('s')}, {_A.format('s')} + {_N.format('s')} - 1))))"
    out = _once(out, [c for c in out.columns if c != "spans"], cuts=f"if(spans is null, null, {lost})")
    names = [c for c in out.columns if c != "cuts"]
    out = _once(out, [*names, "cuts"], row_lines=f"if(cuts is null, null, {_lines('row_text')})")
    out = _once(out, [*names, "cuts", "row_lines"], row_left="transform(array_except(sequence(0, size(row_lines) - 1), cuts), i -> get(row_lines, i))")
    out = out.withColumn("row_kept", F.when(F.col("cuts").isNull(), F.col("row_text")).otherwise(F.array_join("row_left", "")))
    return out.withColumn("row_removed", F.coalesce(F.size("row_lines") - F.size("row_left"), F.lit(0)).cast("long")).drop("cuts", "row_lines", "row_left")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (what stays of it), n_removed (lines), removed_chars.

    A null text counts as empty, and an empty one has no chunks. Rows that repeat an id and its text count once and
    share their fate; of equal texts under different ids, the least id keeps them (a null id before all). A chunk that
    repeats within one text, or in different texts under one id, is removed there too. Other columns are ignored. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _dedup(plain, "doc_id", "text")
    return out.select(F.col("row_id").alias("doc_id"), F.col("row_kept").alias("text"), F.col("row_removed").alias("n_removed"), (F.length("row_text") - F.length("row_kept")).cast("long").alias("removed_chars"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated chunks removed from their text, all other columns as they are.

    A row of which no word is left goes; one that had none before stays, as does a null text. n_chars, where docs has
    it, becomes the new length. See line_report for all else.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.col(text_col).isNotNull().alias("had"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row_others"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _dedup(packed, "doc_id", "text")
    out = out.filter(~((F.col("row_removed") > 0) & ~F.col("row_kept").rlike(r"[^\x20\x09-\x0D]")))
    changed = F.col("row_removed") > 0
    new = {c: F.col("row_others")[f"c{i}"] for i, c in enumerate(others)} | {text_col: F.when(changed | F.col("row_others")["had"], F.col("row_kept"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(changed, F.length("row_kept").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return out.select(*[new[c].alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
