"""Phrase collocation mining: frequent phrases of two to four words, scored by how well they hold together.

Words that occur often enough get numbers, and texts become arrays of them (0: a rarer word
or the end of a piece).  Level by level, windows both of whose shorter parts are candidates
are looked for in the texts, and those that can reach the least count become candidates.  The
candidates go out as double-array tries of bounded size, built in tasks; their file is mapped
into memory, once for all workers of an executor, and so is that of the numbered words.  numpy
moves all positions of a text through the trie that they are dealt to at once, counts the
accepting states, and the counts of all shards of the texts are summed.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import broadcast_if_small, stored

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: A candidate goes if a longer one has so many hundredths of its count.
COVER = 80
#: Of the words that are numbered in one task, and the phrases of one trie.
VOCABULARY_ROWS, VOCABULARY_BYTES, TRIE_ROWS = 500_000, 16 << 20, 500_000
#: Text that is split into words at once, numbers in a row of encoded text, numbers that are
#: looked at and rows that are merged at once in a task, distinct words held in a task.
SPLIT_BYTES, ROW_NUMBERS, HELD_KEYS, HELD_WORDS = 4 << 20, 1 << 13, 1_000_000, 500_000
#: Children of a node of a trie that is placed together with others.
FEW = 8
#: States of the tries whose counts travel in one row.
BLOCK = 1024
#: A phrase is dealt to a trie by its first two numbers, times these.
DEAL = (7919, 104729)

END = b"\xff"  # stands in no UTF-8
_KEEP = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _KEEP[_c] += 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _KEEP[_c] = END[0]
TABLE = bytes(_KEEP)
WORD_COLS = ["w1", "w2", "w3", "w4"]


def token_groups(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens): words and piece ends of texts of one language, up to SPLIT_BYTES or one text."""
    waiting: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    split = lambda parts: (b" %b " % END).join(parts).translate(TABLE).replace(END, b" %b " % END).split()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        raw = (text.as_py() or "").encode()
        waiting.setdefault(lang, []).append(raw)
        sizes[lang] += len(raw)
        if sizes[lang] >= SPLIT_BYTES:
            yield lang, split(waiting.pop(lang))
            del sizes[lang]
    for lang, parts in waiting.items():
        yield lang, split(parts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; a task adds up what it meets before anything is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def emit(lang: str) -> pa.RecordBatch:
            words = held.pop(lang)
            words.pop(END, None)
            columns = [pa.array([lang] * len(words)), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for batch in batches:
            for lang, tokens in token_groups(batch):
                held.setdefault(lang, Counter()).update(tokens)
                while sum(map(len, held.values())) > HELD_WORDS:  # of all languages
                    yield emit(max(held, key=lambda x: len(held[x])))
        for lang in list(held):
            yield emit(lang)

    return texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """Words with ``id``, dense from 1, and ``shard``, each of which may be held by the driver."""
    sizes = words.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-sizes["rows"] // VOCABULARY_ROWS), -(-sizes["bytes"] // VOCABULARY_BYTES))
    dealt = words.withColumn("shard", F.pmod(F.xxhash64("lang", "word"), F.lit(shards)).cast("int"))
    rows = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    before = np.cumsum([0, *(rows.get(i, 0) for i in range(shards))]).tolist()
    nth = F.row_number().over(W.partitionBy("shard").orderBy("lang", "word"))
    start = F.element_at(F.lit(before), F.col("shard") + 1)
    return stored(dealt.withColumn("id", (nth + start).cast("int")), "phrases-words"), shards


def shipped(df: DataFrame, name: str, write) -> str:
    """A file of the driver's that Spark hands to every executor; ``write`` fills it."""
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="phrases-")), f"{name}-{uuid.uuid4().hex}")
    with open(path, "wb") as out:
        write(out)
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


class Vocabulary:
    """Numbers of words by language, in a file that is mapped into memory: its batches hold
    the words of one language and shard each."""

    def __init__(self, name: str, batches: dict[str, list[int]]):
        self.name, self.batches, self._file = name, batches, None

    def numbers(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        """Of each token, 0 where it has none."""
        self._file = self._file or pa.ipc.open_file(pa.memory_map(SparkFiles.get(self.name)))
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        of = np.zeros(len(coded.dictionary), np.int32)
        for i in self.batches.get(lang, []) if len(of) else []:
            batch = self._file.get_batch(i)
            # The words are looked up among those of the text, which are few whatever the vocabulary.
            at = pc.index_in(batch.column("word"), value_set=coded.dictionary).fill_null(-1).to_numpy()
            hit = np.flatnonzero(at >= 0)
            of[at[hit]] = batch.column("id").to_numpy()[hit]
        return of[coded.indices.to_numpy()]


def ship_words(words: DataFrame, shards: int) -> Vocabulary:
    """The driver holds one shard at a time."""
    batches: dict[str, list[int]] = defaultdict(list)

    def write(out) -> None:
        n, schema = 0, pa.schema([("word", pa.binary()), ("id", pa.int32())])
        with pa.ipc.new_file(out, schema) as file:
            for shard in range(shards):
                table = words.where(F.col("shard") == shard).select("lang", "word", "id").orderBy("lang").toArrow().combine_chunks()
                langs = pc.run_end_encode(table.column("lang").combine_chunks()) if table.num_rows else None
                start = 0
                for lang, end in zip(langs.values.to_pylist(), langs.run_ends.to_pylist(), strict=True) if langs else ():
                    rows = table.select(["word", "id"]).slice(start, end - start).combine_chunks().cast(schema)
                    for batch in rows.to_batches():
                        file.write_batch(batch)
                        batches[lang].append(n)
                        n += 1
                    start = end

    name = shipped(words, "words", write)
    return Vocabulary(name, dict(batches))


def encoded(texts: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """(ids): texts as rows of little-endian 32-bit numbers; a text's words stay in their order,
    each row ends with a 0.  One pass, however many shards the words have."""
    vocabulary = ship_words(words, shards)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, tokens in token_groups(batch):
                ids = np.append(vocabulary.numbers(lang, tokens), np.int32(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(_rows(ids)), pa.binary())], names=["ids"])

    return stored(texts.mapInArrow(encode, "ids binary"), "phrases-texts")


def _rows(ids: np.ndarray) -> Iterator[bytes]:
    """Cut at zeros only, which no window spans."""
    zeros, start = np.flatnonzero(ids == 0), 0
    while start < len(ids):
        at = int(np.searchsorted(zeros, start + ROW_NUMBERS))
        end = int(zeros[at]) + 1 if at < len(zeros) else len(ids)
        yield ids[start:end].astype("<i4").tobytes()
        start = end


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """Rows of numbers put together, ``most`` numbers or one row more at once."""
    waiting, size = [], 0
    for batch in batches:
        for row in batch.column("ids"):
            waiting.append(np.frombuffer(row.as_buffer(), "<i4"))
            size += len(waiting[-1])
            if size >= most:
                yield np.concatenate(waiting)
                waiting, size = [], 0
    if waiting:
        yield np.concatenate(waiting)


class DoubleArrayTrie:
    """Phrases of numbers as a trie in two arrays: from slot s by symbol c one comes to slot
    base[s] + c, if check says that it is a child of s.  Slot 0 is the root.  ``phrases`` holds
    a row of numbers for each phrase, 0 after its end; with a phrase of three or more words
    its beginnings of two and more must be there."""

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases[np.lexsort(phrases.T[::-1])]
        self.symbols = np.unique(np.concatenate([[0], self.phrases.ravel()]))  # the code of a number is its place; 0 stays 0
        codes = np.searchsorted(self.symbols, self.phrases)
        n = len(self.symbols)
        self.base, self.check, self.accept = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self._used, self._first, self._end, self._from = np.ones(n, bool), n, n, {}
        self.check[np.unique(codes[:, 0])] = 0
        self.check[0] = -1
        lengths = (codes > 0).sum(axis=1)
        for level in range(2, codes.shape[1] + 1):
            rows = np.flatnonzero(lengths == level)
            if len(rows):
                at = np.zeros(len(rows), np.int64)
                for k in range(level - 1):
                    at = self.base[at] + codes[rows, k]
                self._add_level(at, codes[rows, level - 1], rows)
        self._resize(self._end + 1)  # the last slot is nobody's child
        del self._used, self._first, self._end, self._from

    @classmethod
    def of(cls, symbols: np.ndarray, base: np.ndarray, check: np.ndarray) -> DoubleArrayTrie:
        """One that was built before, from what walking it takes."""
        trie = cls.__new__(cls)
        trie.symbols, trie.base, trie.check = symbols, base, check
        return trie

    def _resize(self, size: int) -> None:
        fit = lambda x, fill: np.concatenate([x[:size], np.full(max(0, size - len(x)), fill, x.dtype)])
        self.base, self.check, self.accept, self._used = fit(self.base, 0), fit(self.check, -1), fit(self.accept, -1), fit(self._used, False)

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            self._resize(max(size, 2 * len(self.base)))

    def _add_level(self, parents: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff([*starts, len(parents)])
        # Nodes with most children first, while there is most room; those with few all at once.
        for g in np.argsort(-sizes, kind="stable")[: int((sizes > FEW).sum())].tolist():
            group = slice(starts[g], starts[g] + sizes[g])
            self._put(parents[starts[g]], codes[group], rows[group], self._room(codes[group]))
        few = (sizes > 1) & (sizes <= FEW)
        self._scatter(starts[few], sizes[few], parents, codes, rows)
        one = starts[sizes == 1]  # a single child goes into any free slot
        self._grow(self._end + len(one))
        free = np.flatnonzero(~self._used)[: len(one)]
        self._put(parents[one], codes[one], rows[one], free - codes[one])

    def _scatter(self, starts: np.ndarray, sizes: np.ndarray, parents: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
        """Draw a place for each of many nodes until its children fall on free slots that no
        other node has drawn; a third of the new slots are taken in the end."""
        draw = np.random.default_rng(len(self.base))
        low, high = self._end, self._end + 3 * int(sizes.sum()) + 64
        self._grow(high + int(codes.max()) + 1)
        owner = np.full(len(self.base), -1, np.int32)
        while len(starts):
            node = np.repeat(np.arange(len(starts)), sizes)
            child = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
            base = draw.integers(low, high, len(starts)) - codes[starts]
            slots = base[node] + codes[child]
            owner[slots] = node
            clash = self._used[slots] | (owner[slots] != node)
            good = ~np.logical_or.reduceat(clash, np.cumsum(sizes) - sizes)
            taken = good[node]
            self._put(parents[child[taken]], codes[child[taken]], rows[child[taken]], base[node[taken]])
            starts, sizes = starts[~good], sizes[~good]

    def _room(self, codes: np.ndarray) -> int:
        """A base at which all of a node's children fall on free slots.  The search begins where
        one for as many children (by powers of two) ended, so that no stretch is searched
        twice for the same; single children fill the gaps later."""
        size, tried = len(codes).bit_length(), 64
        span, low = int(codes[-1] - codes[0]) + 1, self._from.get(size, self._first)
        while True:
            self._grow(low + tried + span)
            firsts = np.flatnonzero(~self._used[low : low + tried]) + low
            for c in codes[1:].tolist():  # what clashes with one child needs no look at the others
                if not len(firsts):
                    break
                firsts = firsts[~self._used[firsts + (c - int(codes[0]))]]
            if len(firsts):
                self._from[size] = low
                return int(firsts[0] - codes[0])
            low, tried = low + tried, min(4 * tried, 1 << 16)

    def _put(self, parents, codes: np.ndarray, rows: np.ndarray, base) -> None:
        slots = base + codes
        self.base[parents] = base
        self.check[slots], self.accept[slots], self._used[slots] = parents, rows, True
        self._end = max(self._end, int(slots.max(initial=0)) + 1)

    def walk(self, ids: np.ndarray, words: int, at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level from 2 to ``words``: the positions, of all or of ``at``, whose next so
        many numbers are a phrase's, or its beginning, and the slots that they have reached."""
        at = np.arange(len(ids)) if at is None else at
        slots = self._codes(ids[at])
        good = self.check[slots] == 0
        at, slots = at[good], slots[good]
        for level in range(2, words + 1):
            inside = at + level <= len(ids)
            at, slots = at[inside], slots[inside]
            following = np.minimum(self.base[slots] + self._codes(ids[at + level - 1]), len(self.check) - 1)
            good = self.check[following] == slots
            at, slots = at[good], following[good]
            yield at, slots

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        if self.symbols[-1] >= 1 << 24:  # too many numbers for a table of them
            at = np.minimum(np.searchsorted(self.symbols, ids), len(self.symbols) - 1)
            return np.where(self.symbols[at] == ids, at, 0)
        if not hasattr(self, "_table"):
            self.fill(np.zeros(int(self.symbols[-1]) + 2, np.int32))
        return self._table[np.minimum(ids, len(self._table) - 1)]

    def fill(self, table: np.ndarray) -> None:
        """Use a table of zeros for the codes of numbers, until ``clear``."""
        table[self.symbols] = np.arange(len(self.symbols))
        self._table = table

    def clear(self) -> None:
        self._table[self.symbols] = 0
        del self._table

    def spelled(self, slots: np.ndarray) -> np.ndarray:
        """The phrases that lead to slots, a row each, 0 after their end: up from child to parent."""
        out = np.zeros((len(slots), MAX_WORDS), np.int32)
        while (slots > 0).any():
            parents = np.maximum(self.check[slots], 0)
            out[:, 1:] = np.where((slots > 0)[:, None], out[:, :-1], out[:, 1:])
            out[:, 0] = np.where(slots > 0, self.symbols[slots - self.base[parents]], out[:, 0])
            slots = np.where(slots > 0, parents, 0)
        return out


class Tries:
    """Many tries in one file that is mapped into memory; ``sizes`` has the numbers of symbols
    and of slots of each.  A phrase is in the trie that its first two numbers are dealt to.
    States are numbered through all tries."""

    def __init__(self, name: str, sizes: list[tuple[int, int]]):
        self.name, self.sizes = name, sizes
        self.starts = np.cumsum([0, *(slots for _, slots in sizes)])

    def _tries(self) -> list[DoubleArrayTrie]:
        if not hasattr(self, "_open"):
            data, at, tries = np.memmap(SparkFiles.get(self.name), "<i4", "r"), 0, []
            for symbols, slots in self.sizes:
                parts = np.split(data[at : at + symbols + 2 * slots], [symbols, symbols + slots])
                tries.append(DoubleArrayTrie.of(*map(np.asarray, parts)))
                at += symbols + 2 * slots
            most = max(int(t.symbols[-1]) for t in tries)
            self._scratch = np.zeros(most + 2 if most < 1 << 24 else 0, np.int32)
            self._open = tries
        return self._open

    def walk(self, ids: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, positions, states) for each trie and level from 2 to ``words``."""
        tries = self._tries()
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        shard = (ids[at] * np.int64(DEAL[0]) + ids[at + 1] * np.int64(DEAL[1])) % len(tries)
        order = np.argsort(shard.astype(np.uint16) if len(tries) < 1 << 16 else shard, kind="stable")  # by digits if short
        at = at[order]
        ends = np.cumsum(np.bincount(shard, minlength=len(tries)))
        for trie, start, begin, end in zip(tries, self.starts[:-1].tolist(), [0, *ends[:-1]], ends, strict=True):
            if end > begin:
                if len(self._scratch):
                    trie.fill(self._scratch)
                for level, (found, slots) in enumerate(trie.walk(ids, words, at[begin:end]), 2):
                    yield level, found, slots + start
                if len(self._scratch):
                    trie.clear()

    def spelled(self, states: np.ndarray) -> np.ndarray:
        """The phrases of states in ascending order."""
        cuts = np.searchsorted(states, self.starts)
        parts = [t.spelled(states[a:b] - start) for t, start, a, b in zip(self._tries(), self.starts[:-1], cuts[:-1], cuts[1:], strict=True) if b > a]
        return np.concatenate([np.zeros((0, MAX_WORDS), np.int32), *parts])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def candidates(texts: DataFrame, level: int, tries: Tries | None, min_count: int) -> DataFrame:
    """Windows of ``level`` numbers that occur at least ``min_count`` times and whose first and
    last ``level`` - 1 numbers are candidates.  Of a window a task reports what it meets,
    ``min_count`` at most: the choice needs no more.  One pass over the texts."""

    def windows(ids: np.ndarray) -> np.ndarray:
        """A word's or phrase's number, and the word after it, in 64 bits."""
        if tries is None:
            at, head = np.flatnonzero(ids[:-1]), ids
        else:
            head = np.full(len(ids) + 1, -1, np.int32)
            for reached, found, states in tries.walk(ids, level - 1):
                if reached == level - 1:
                    head[found] = states
            at = np.flatnonzero((head[:-1] >= 0) & (head[1:] >= 0))
            at = at[at + level <= len(ids)]
        following = ids[at + level - 1]
        at, following = at[following > 0], following[following > 0]
        return (head[at].astype(np.int64) << 32) | following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _summed(map(windows, _chunks(batches, HELD_KEYS)), HELD_KEYS):
            head = (keys >> 32).astype(np.int32)[:, None] if tries is None else tries.spelled(keys >> 32)[:, : level - 1]
            last, rest = (keys & 0xFFFFFFFF).astype(np.int32), np.zeros((MAX_WORDS - level, len(keys)), np.int32)
            columns = [*head.T, last, *rest, np.minimum(counts, min_count).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[*WORD_COLS, "n"])

    found = texts.mapInArrow(run, ", ".join(f"{c} int" for c in [*WORD_COLS, "n"]))
    found = found.groupBy(*WORD_COLS).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return stored(found.select(*WORD_COLS), "phrases-candidates")


def _summed(parts: Iterator[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys in ascending order with their counts; up to ``most`` are held and added to."""
    keys, counts = np.zeros((2, 0), np.int64)
    for part in parts:
        new, times = np.unique(part, return_counts=True)
        keys, counts = _merged([keys, new], [counts, times])
        if len(keys) > most:
            yield keys, counts
            keys, counts = np.zeros((2, 0), np.int64)
    yield keys, counts


def send_tries(phrases: DataFrame, trie_rows: int) -> Tries | None:
    """Tries of all candidates, dealt by their first two numbers, so that a phrase's own
    beginnings are where it is.  Each is built from ``trie_rows`` phrases, about, in a task of
    its own; the driver holds one at a time."""
    rows = phrases.count()
    if not rows:
        return None
    shards = -(-rows // trie_rows)
    shard = sum(F.col(c).cast("long") * F.lit(d) for c, d in zip(WORD_COLS, DEAL, strict=False)) % F.lit(shards)

    def build(table: pa.Table) -> pa.Table:
        trie = DoubleArrayTrie(np.stack([table.column(c).to_numpy() for c in WORD_COLS], axis=1))
        parts = [x.astype("<i4").tobytes() for x in (trie.symbols, trie.base, trie.check)]
        return pa.table([table.column("shard").slice(0, 1), *([x] for x in parts)], schema=pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("symbols", "base", "check"))]))

    dealt = phrases.withColumn("shard", shard).groupBy("shard")
    built = stored(dealt.applyInArrow(build, "shard long, symbols binary, base binary, check binary"), "phrases-tries", by="shard")
    # One without phrases has a root that nothing leaves.
    empty = [np.array(x, "<i4").tobytes() for x in ([0], [0], [-1])]
    sizes = []

    def write(out) -> None:
        for i in range(shards):
            row = built.where(F.col("shard") == i).select("symbols", "base", "check").first()
            for part in row or empty:
                out.write(part)
            sizes.append((len((row or empty)[0]) // 4, len((row or empty)[1]) // 4))

    name = shipped(phrases, "tries", write)
    return Tries(name, sizes)


def trie_counts(texts: DataFrame, tries: Tries) -> DataFrame:
    """(w1, w2, w3, w4, n) of every phrase of the tries, exactly: shards of the texts count
    accepting states, which all are from the second level on, and blocks of counts are summed."""

    def states(ids: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(x for _, _, x in tries.walk(ids, MAX_WORDS))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _summed(map(states, _chunks(batches, HELD_KEYS)), HELD_KEYS):
            blocks, begins = np.unique(keys // BLOCK, return_index=True)
            cut = lambda x, kind: pa.array([y.tobytes() for y in np.split(x.astype(kind), begins[1:])] if len(x) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), cut(keys % BLOCK, "<i2"), cut(counts, "<i8")], names=["block", "at", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for at, counts in zip(parts.column("at"), parts.column("counts"), strict=True):
            total[np.frombuffer(at.as_buffer(), "<i2")] += np.frombuffer(counts.as_buffer(), "<i8")
        found = np.flatnonzero(total)
        phrases = tries.spelled(found + parts.column("block")[0].as_py() * BLOCK)
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in [*phrases.T, total[found]]], names=[*WORD_COLS, "n"])

    parts = texts.mapInArrow(count, "block long, at binary, counts binary")
    return parts.groupBy("block").applyInArrow(add, ", ".join(f"{c} int" for c in WORD_COLS) + ", n long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, trie_rows: int = TRIE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, n, id), phrases (w1 to w4, n) of one to four words that occur at least
    ``min_count`` times, and totals (lang, total) of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(texts), "phrases-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words, shards = numbered(counts.where(F.col("n") >= min_count))
    ids = encoded(texts, words, shards)
    tries = phrases = None
    for level in range(2, MAX_WORDS + 1):
        found = candidates(ids, level, tries, min_count)
        if not found.limit(1).count():
            break
        phrases = found if phrases is None else phrases.union(found)
        tries = send_tries(phrases, trie_rows)
    zero = F.lit(0)
    single = words.select(F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), "n")
    counted = single
    if tries:
        counted = single.union(trie_counts(ids, tries).where(F.col("n") >= min_count))
    return words, stored(counted, "phrases-counted"), totals


def _part(begin: int, end: int) -> Column:
    """Words number ``begin`` (from 0) up to ``end`` of a phrase, 0 after them."""
    words = [F.col(c) for c in WORD_COLS[begin:end]]
    return F.struct(*[(words[i] if i < len(words) else F.lit(0)).alias(c) for i, c in enumerate(WORD_COLS)])


def weakest_cuts(counted: DataFrame) -> DataFrame:
    """Phrases of two words and more with a, l, r, k and score of their lowest-scoring cut.
    The arithmetic is of 38 decimal places, so exact."""
    size = sum(F.when(F.col(c) != 0, 1).otherwise(0) for c in WORD_COLS)
    several = counted.withColumn("size", size).where("size > 1").withColumnRenamed("n", "a")
    cuts = F.array(*[
        F.when(F.col("size") == n, F.struct(F.lit(k).alias("k"), _part(0, k).alias("left"), _part(k, n).alias("right")))
        for n in range(2, MAX_WORDS + 1) for k in range(1, n)
    ])
    each = several.select(*WORD_COLS, "size", "a", F.inline(F.filter(cuts, lambda c: c.isNotNull())))
    known = counted.select(F.struct(*WORD_COLS).alias("part"), "n")
    each = each.join(known.select(F.col("part").alias("left"), F.col("n").alias("l")), "left")
    each = each.join(known.select(F.col("part").alias("right"), F.col("n").alias("r")), "right")
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    each = each.withColumn("score", F.expr(f"CAST(2000000 AS DECIMAL(10, 0)) * {wide('a')} div ({wide('l')} + {wide('r')})"))
    low = each.groupBy(*WORD_COLS, "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return low.select(*WORD_COLS, "size", "a", "low.*")


def uncovered(scored: DataFrame, cover: int = COVER) -> DataFrame:
    """Without phrases inside a longer one that has ``cover`` hundredths of their count or more."""
    inner = F.array(*[
        F.when(F.col("size") == n, _part(b, b + m)) for n in range(3, MAX_WORDS + 1) for m in range(2, n) for b in range(n - m + 1)
    ])
    inside = scored.where("size > 2").select(F.explode(F.filter(inner, lambda p: p.isNotNull())).alias("p"), F.col("a").alias("longer"))
    most = inside.groupBy(F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"), F.col("p.w3").alias("w3"), F.col("p.w4").alias("w4")).agg(F.max("longer").alias("longer"))
    joined = scored.join(most, WORD_COLS, "left")
    times = lambda n, c: F.lit(n).cast("decimal(10,0)") * F.col(c).cast("decimal(20,0)")
    return joined.where(F.col("longer").isNull() | (times(100, "longer") < times(cover, "a"))).drop("longer")


def mine_collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score and the cut's k.

    Words are runs of anything but blanks and tabs inside a piece, which ends at .,;:!? or a
    line's end; A-Z are lower-cased.  A null language is ``und``, a null text empty; an empty
    or blank text adds nothing; long texts are read whole; rows that repeat count each; equal
    scores are ordered by count, then by phrase.  An empty table gives no rows.  Columns other
    than lang and text, whatever their names, are not read.
    """
    words, counted, totals = phrase_counts(docs, min_count, trie_rows)
    left = uncovered(stored(weakest_cuts(counted), "phrases-scored"), cover)
    left = left.join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    # Ranks without the phrase first: of those that tie at the end all stay for now.
    near = left.withColumn("near", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("near") <= top)
    for i in (2, 3, 4):
        near = near.join(words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    phrase = F.concat_ws(" ", *[F.col(f"t{i}").cast("string") for i in (1, 2, 3, 4)])
    near = near.withColumn("phrase", phrase)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    totals = broadcast_if_small(stored(totals, "phrases-totals"), 100_000)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "k")


def op12(docs: DataFrame) -> DataFrame:
    """Each language's 2000 best phrases."""
    return mine_collocations(docs)


OP12_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS size FROM w),
f AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda j: array_to_string(list_slice(ws, j, j + size - 1), ' '))) AS phrase FROM g WHERE len(ws) >= size),
c AS (SELECT lang, size, phrase, count(*) AS a FROM f GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE size = 1 GROUP BY 1),
m AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM c WHERE size > 1 AND a >= 30),
x AS (SELECT m.*, unnest(range(1, size)) AS k FROM m),
s AS (SELECT x.lang, x.size, x.phrase, x.a, k, l.a AS l, r.a AS r, ((2000000 * x.a::HUGEINT) // (l.a + r.a))::BIGINT AS score
  FROM x JOIN c l ON l.lang = x.lang AND l.size = k AND l.phrase = array_to_string(list_slice(ws, 1, k), ' ')
  JOIN c r ON r.lang = x.lang AND r.size = x.size - k AND r.phrase = array_to_string(list_slice(ws, k + 1, x.size), ' ')),
b AS (SELECT lang, phrase, a, l, r, k, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a AS longer, ws, size, unnest(range(2, size)) AS part FROM m),
j AS (SELECT lang, longer, ws, part, unnest(range(1, size - part + 2)) AS start FROM i),
v AS (SELECT lang, array_to_string(list_slice(ws, start, start + part - 1), ' ') AS phrase, max(longer) AS longer FROM j GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score, k::INT AS k
FROM b JOIN n ON n.lang = b.lang LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000"""
