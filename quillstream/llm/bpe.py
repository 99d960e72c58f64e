"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern.  Documents are held in slices of
bounded size, each with the list of its distinct words; equal words of all slices meet in
one row, and a fold of ranked merges over a literal rank map turns each distinct word's
bytes into token ids once.  The ids go back to the slices, whose documents, written in
buckets of slices beforehand, are put together from them.  Nothing passes the driver, and
no task holds more words than a slice or a partition has.

Bytes are held as characters U+0000 to U+00FF (ISO-8859-1), one for each byte, since
Spark's string functions then cut and join them byte by byte.

The rank map is a literal array of small maps, chosen by hash, since looking up a key in
one of Spark's maps scans it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import stored_in_buckets

BUCKETS = 1 << 14
NO_RANK = 2**31 - 1
SHIFT = 1 << 31


def read_ranks(path: str) -> dict[str, int]:
    """Rank by piece from a file of base64 pieces and ranks.  The file is a vocabulary:
    its size is bounded, so the driver may read it and send it along as a literal."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in f if x.strip())}


def as_lookup(table: dict, value_type: str) -> Column:
    """A literal array of BUCKETS maps from the table's keys to its values."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in table.items():
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = value
    text = json.dumps(maps, ensure_ascii=False, separators=(",", ":"))
    return F.from_json(F.lit(text), f"array<map<string,{value_type}>>")


def with_value(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once and then held by a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def find(table: Column, key: Column) -> Column:
    """The value of ``key``, or null."""

    def look(key: Column) -> Column:
        bucket = F.crc32(key.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
        return F.try_element_at(table[bucket], key)

    return with_value(key, look)


def fold(word: Column, ranks: Column) -> Column:
    """Token ids of one word of byte characters (see ``_fold``).

    The word and its length are each computed once: within lambdas Spark does not share
    what two expressions have in common."""
    return with_value(word, lambda w: with_value(F.length(w), lambda n: _fold(w, n, ranks)))


def _fold(word: Column, n: Column, ranks: Column) -> Column:
    """Merge the pair of lowest rank, leftmost first, until no pair has a rank.

    The state is the list of boundaries between pieces, each packed with the rank of
    merging across it (rank * SHIFT + place), so that its least element is the next
    merge.  A merge drops a boundary and ranks its two neighbours anew.  The word's two
    ends stand twice, without a rank, so that every boundary has two neighbours a side."""
    last = F.lit(NO_RANK * SHIFT)

    def packed(low: Column, place: Column, high: Column) -> Column:
        found = find(ranks, F.substr(word, low + 1, high - low)).cast("long") * SHIFT
        return F.coalesce(found, last) + place

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(SHIFT - 1).cast("long")).cast("int")

    def merge(s: Column, _: Column) -> Column:
        return with_value(F.array_min(s), lambda best: F.when(best >= last, s).otherwise(merged(s, best)))

    def merged(s: Column, best: Column) -> Column:
        return with_value((F.array_position(s, best) - 1).cast("int"), lambda p: without(s, p))

    def without(s: Column, p: Column) -> Column:
        left, right = place(s[p - 1]), place(s[p + 1])
        new_left = F.when(left > 0, packed(place(s[p - 2]), left, right)).otherwise(last)
        new_right = F.when(right < n, packed(left, right, place(s[p + 2]))).otherwise(last + n)
        return F.concat(F.slice(s, F.lit(1), p - 1), F.array(new_left, new_right), F.slice(s, p + 3, n + 4))

    def ids(s: Column) -> Column:
        return with_value(
            F.transform(F.slice(s, F.lit(2), F.size(s) - 2), place),
            lambda c: F.transform(
                F.sequence(F.lit(1), F.size(c) - 1),
                lambda i: find(ranks, F.substr(word, c[i - 1] + 1, c[i] - c[i - 1])),
            ),
        )

    inner = F.sequence(F.lit(1), n - 1)
    start = F.concat(F.array(last, last), F.transform(inner, lambda i: packed(i - 1, i, i + 1)), F.array(last + n, last + n))
    ends = F.aggregate(inner, start, merge, ids)
    whole = find(ranks, word)
    return F.when(whole.isNotNull(), F.array(whole)).when(n < 2, F.array().cast("array<int>")).otherwise(ends)


def as_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a string as characters, one for each byte."""
    return F.decode(word.cast("binary"), "ISO-8859-1")


def words_of(text: Column, pattern: str) -> Column:
    """The pattern's matches.  White space is Unicode's, as in the tokenizer's own engine."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


#: A word's place: the slice's number in the upper bits, the word's number in the slice below.
NUMBER_BITS = 28
#: Slices of one partition are numbered from its number times this.
PART_SLICES = 1 << 13
#: Partitions whose words are folded together; a word's places are gathered within such a span.
SPAN_PARTS = 4096
#: Words of a row of the dictionary, places that are packed at once, words looked up at once.
WORDS_A_ROW, PLACES_AT_ONCE, LOOKED_UP_AT_ONCE = 8192, 1 << 19, 1 << 17


def _planes(numbers: np.ndarray) -> bytes:
    """The four bytes of each number, all first bytes first."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with the given starts and sizes, one after the other."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def _edges(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of neighbours, each of about ``limit`` in all or of one element."""
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, append=-1)) + 1
    return list(zip([0, *marks[:-1].tolist()], marks.tolist(), strict=True)) if len(sizes) else []


def cut_slices(rows: DataFrame, words_col: str, slice_bytes: int) -> DataFrame:
    """A stored table that holds, of about each ``slice_bytes`` of words (or one document),

    * the distinct words, the commonest first, as rows of (__slice, __start, __words), and
    * every document, with ``words_col`` replaced by the numbers of its words (__idx),

    bucketed by slice, so that what is found for a slice's words meets its documents
    without moving the documents again."""
    names = [c for c in rows.columns if c != words_col]
    at = rows.columns.index(words_col)

    def emit(parts: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        kinds = [parts[0].schema.field(c).type for c in names]
        coded = pa.concat_arrays([p.column(at).flatten() for p in parts]).dictionary_encode()
        found = coded.indices.to_numpy()
        if len(coded.dictionary) >= 1 << NUMBER_BITS:
            raise ValueError("a document with too many different words")
        order = np.argsort(-np.bincount(found, minlength=len(coded.dictionary)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = coded.dictionary.take(pa.array(order))
        done = 0
        for p in parts:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(p.column(at)), 0).to_numpy()) + done
            idx = [_planes(place[found[a:b]]) for a, b in zip([done, *ends[:-1]], ends, strict=True)]
            done = int(ends[-1])
            none = [pa.nulls(len(p), pa.int32()), pa.nulls(len(p), pa.list_(pa.string()))]
            own = [p.column(p.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(p), pa.int64()), *own, pa.array(idx, pa.binary()), *none], names=out)
        starts = np.arange(0, len(words), WORDS_A_ROW)
        if len(starts):
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), words)
            none = [pa.nulls(len(starts), k) for k in kinds] + [pa.nulls(len(starts), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(starts), pa.int64()), *none, pa.array(starts, pa.int32()), lists], names=out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() * PART_SLICES, [], 0
        last = number + PART_SLICES
        for b in batches:
            lists = b.column(at)
            ends = pa.compute.binary_length(lists.flatten()).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
            of_doc = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(), dtype=np.int64)
            sizes = np.diff(np.concatenate([[0], ends])[of_doc], prepend=0)
            for low, high in _edges(sizes, slice_bytes):
                held.append(b.slice(low, high - low))
                size += int(sizes[low:high].sum())
                if size >= slice_bytes:
                    yield from emit(held, number)
                    number, held, size = min(number + 1, last), [], 0
                    if number == last:
                        raise ValueError("a partition with too many slices: use more partitions or larger slices")
        if held:
            yield from emit(held, number)
        del held
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    out = ["__slice", *names, "__idx", "__start", "__words"]
    schema = T.StructType([T.StructField("__slice", T.LongType()), *(T.StructField(c, rows.schema[c].dataType) for c in names)])
    schema = schema.add("__idx", T.BinaryType()).add("__start", T.IntegerType()).add("__words", T.ArrayType(T.StringType()))
    return stored_in_buckets(rows.mapInArrow(cut, schema), "bpe-slices", "__slice")


def fold_words(cut: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(__slice, packed): the ids of all words of each slice, in several rows.

    Equal words of all slices meet in one row, with their places, and are folded once."""
    words = cut.where("__words is not null").select("__slice", "__start", F.posexplode("__words").alias("n", "word"))
    number = F.shiftleft("__slice", NUMBER_BITS) + F.col("__start") + F.col("n")
    words = words.select("word", F.floor(F.col("__slice") / (PART_SLICES * SPAN_PARTS)).alias("span"), number.alias("place"))
    words = words.repartition("word", "span").groupBy("word", "span").agg(F.collect_list("place").alias("places"))
    ids = with_value(as_lookup(ranks, "int"), lambda m: fold(as_bytes(F.col("word")), m))

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        places, ids = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("places", "ids"))
        sizes = pa.compute.list_value_length(ids).to_numpy().astype(np.int64)
        values, place = ids.flatten().to_numpy(), places.flatten().to_numpy()
        word = np.repeat(np.arange(len(sizes)), pa.compute.list_value_length(places).to_numpy())
        order = np.argsort(place, kind="stable")
        place, word = place[order], word[order]
        ids_of, slices = _gather(values, (np.cumsum(sizes) - sizes)[word], sizes[word]), place >> NUMBER_BITS
        marks = np.flatnonzero(np.diff(slices, append=-1)) + 1
        ends, rows, a, i = np.cumsum(sizes[word]), [], 0, 0
        for b in marks.tolist():
            j = int(ends[b - 1])
            steps = np.diff(place[a:b] & ((1 << NUMBER_BITS) - 1), prepend=0)
            rows.append(np.array([b - a], "<i8").tobytes() + _planes(np.concatenate([steps, sizes[word[a:b]], ids_of[i:j]])))
            a, i = b, j
        lengths = pa.array([len(r) for r in rows], pa.int64())
        codec = pa.Codec("zstd")
        return pa.RecordBatch.from_arrays(
            [pa.array(slices[marks - 1], pa.int64()), lengths, pa.array([codec.compress(r, asbytes=True) for r in rows], pa.binary())], names=["__slice", "size", "packed"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column("places").flatten())
            if n >= PLACES_AT_ONCE:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)
        del held
        pa.default_memory_pool().release_unused()

    return words.select("places", ids.alias("ids")).mapInArrow(pack, "__slice long, size long, packed binary")


def bpe_encode(
    docs: DataFrame,
    ranks: dict[str, int],
    pattern: str,
    text_col: str = "text",
    out_col: str = "ids",
    keep: Sequence[str] | None = None,
    slice_bytes: int = 32 << 20,
) -> DataFrame:
    """Add the token ids of the whole text to every row.

    A null or empty text has no ids; every row, repeated or not, keeps its other columns
    (those in ``keep``, all by default).  A column named like ``out_col`` is replaced; no
    column may begin with two underscores.  ``ranks`` (see ``read_ranks``) must rank all 256
    bytes.  ``slice_bytes`` bounds the text whose words a task holds at once.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    if taken := [c for c in own if c.startswith("__")]:
        raise ValueError(f"columns named like the operator's own: {taken}")
    cut = cut_slices(docs.select(*own, words_of(F.coalesce(F.col(text_col), F.lit("")), pattern).alias("__cut")), "__cut", slice_bytes)
    rows = cut.where("__idx is not null").select("__slice", *own, "__idx")
    schema = T.StructType([*rows.select(*own).schema.fields]).add(out_col, T.ArrayType(T.IntegerType()))

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        """Each document's words replaced by their ids."""
        codec, parts = pa.Codec("zstd"), []
        for size, packed in zip(words.column("size").to_pylist(), words.column("packed").to_pylist(), strict=True):
            raw = codec.decompress(packed, size, asbytes=True)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            numbers = _numbers(raw[8:])
            parts.append((np.cumsum(numbers[:n]), numbers[n : 2 * n], numbers[2 * n :]))
        place, sizes, ids = (np.concatenate(x) if parts else np.zeros(0, np.int32) for x in (zip(*parts, strict=True) if parts else [(), (), ()]))
        order = np.argsort(place)
        if not np.array_equal(place[order], np.arange(len(place))):
            raise ValueError("the words of a slice are not complete")
        starts, sizes = (np.cumsum(sizes, dtype=np.int64) - sizes)[order], sizes[order].astype(np.int64)
        cut = docs.column("__idx").combine_chunks()
        cut = cut if isinstance(cut, pa.Array) else pa.concat_arrays(cut.chunks)
        n = pa.compute.binary_length(cut).to_numpy() // 4
        runs = []
        for low, high in _edges(n, LOOKED_UP_AT_ONCE):
            at = np.concatenate([_numbers(x) for x in cut.slice(low, high - low).to_pylist()])
            found = sizes[at]
            ends = np.concatenate([[0], np.cumsum(found)])[np.concatenate([[0], np.cumsum(n[low:high])])]
            runs.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_gather(ids, starts[at], found))))
        return pa.Table.from_arrays([*(docs.column(c) for c in own), pa.chunked_array(runs, pa.list_(pa.int32()))], names=[*own, out_col])

    words = fold_words(cut, ranks)
    return rows.groupBy("__slice").cogroup(words.groupBy("__slice")).applyInArrow(assemble, schema)


def bpe_decode(docs: DataFrame, ranks: dict[str, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of the ids: their pieces, joined.  Null ids give null; an id that the
    vocabulary has not is an error, not a gap."""
    by_rank: list = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_rank[rank] = piece
    table = F.from_json(F.lit(json.dumps(by_rank, ensure_ascii=False, separators=(",", ":"))), "array<string>")
    ids = F.col(ids_col)
    known = (F.size(ids) == 0) | ((F.array_min(ids) >= 0) & (F.array_max(ids) < len(by_rank)))
    pieces_of = with_value(table, lambda pieces: F.transform(ids, lambda i: pieces[i]))
    # A null id or a rank without a piece becomes a character that no byte has; encode refuses it.
    unknown = F.raise_error(F.lit("an id that the vocabulary has not")).cast("string")
    joined = F.when(ids.isNull(), None).when(known, F.array_join(pieces_of, "", "\u0100")).otherwise(unknown)
    return docs.withColumn(out_col, F.encode(joined, "ISO-8859-1"))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[str, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op9(docs: DataFrame) -> DataFrame:
    ranks, pattern = vocabulary()
    encoded = bpe_encode(docs, ranks, pattern, keep=["doc_id"])
    both = bpe_decode(encoded, ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
