"""Best-fit packing: documents as token ids, cut into pieces and packed into few sequences.

How pieces are packed depends on their lengths alone, of which there are ``capacity`` at
most.  So the plan is made from counts by length: a class is a kind of sequence (the lengths
in it) and how many there are of it.  Best fit fills the classes, then a local search of
swaps works on the underfull ones.  Each piece finds its place by its rank among the pieces
of its length, which Spark counts by (length, part).
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import broadcast_if_small, stored

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together, on average.
PART_ROWS = 512
#: Counts by (length, part) that may be sent to all, 24 bytes each.
BROADCAST_ROWS = 1_000_000
#: A run of white space as long as this overflows the faster library's pattern.
LONG_BLANK = re.compile(r"\s{100000}")

Encoder = Callable[[str], list[int]]
Pattern = tuple[int, ...]


@lru_cache(maxsize=2)
def encoder(ranks_path: str, vocabulary_path: str) -> Encoder:
    """The ids that ``tokenizers`` gives with ``vocabulary_path``; ``ranks_path`` holds the same
    vocabulary for the faster ``tiktoken``, which takes all texts but those with long blanks."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(vocabulary_path)
    whole.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        if len(text) >= 100_000 and LONG_BLANK.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_pieces(docs: DataFrame, paths: tuple[str, str], capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the documents (doc_id, text): only
    those of more than ``capacity`` ids are cut, and then the first piece is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            docs_at, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                # Little-endian and unsigned, as the checksum asks for.
                all_ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(all_ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(all_ids), capacity)]):
                    part = all_ids[start : first + piece * capacity]
                    docs_at.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(docs_at, pa.int32())), pa.array(pieces, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Longest first, each piece goes where the least room is left over; how many sequences
    there are of each pattern (its lengths, longest first)."""
    by_room: dict[int, dict[Pattern, int]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            kinds = by_room.setdefault(room, {})
            kinds[pattern] = kinds.get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:  # new sequences, as full of this length as they get
                each = min(capacity // length, left)
                put(capacity - each * length, (length,) * each, left // each)
                left %= each
                continue
            kinds = by_room[room]
            pattern, n = kinds.popitem()
            if not kinds:
                del by_room[room]
            used = min(n, left)
            put(room, pattern, n - used)
            put(room - length, (*pattern, length), used)
            left -= used
    plan: dict[Pattern, int] = {}
    for kinds in by_room.values():
        for pattern, n in kinds.items():
            plan[pattern] = plan.get(pattern, 0) + n
    return plan


def _choices(pattern: Pattern) -> list[Pattern]:
    """One or two pieces of a pattern, without repetition."""
    kinds = sorted(set(pattern))
    pairs = [(a, b) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or pattern.count(a) > 1]
    return [(a,) for a in kinds] + pairs


def _exchanged(pattern: Pattern, out: Pattern, come: Pattern) -> Pattern:
    rest = list(pattern)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *come], reverse=True))


def swap_search(plan: dict[Pattern, int], capacity: int = CAPACITY, max_steps: int = 4000) -> dict[Pattern, int]:
    """Improve a plan by exchanges between underfull sequences: a piece (or two) moves from
    one to another, against none, one or (for a single one) two that come back, if that makes
    the sum of squared fills grow.  All sequences of two classes that can are exchanged at
    once; emptied ones go.  It ends when no exchange helps or as few sequences are left as
    the pieces can fill, and after ``max_steps`` exchanges, which bounds time and not results.
    """
    plan = {p: n for p, n in plan.items() if n}
    total = sum(sum(p) * n for p, n in plan.items())
    fewest = -(-total // capacity)
    barren: set[Pattern] = set()  # patterns that nothing could be taken from, as things were
    for _ in range(max_steps):
        open_ = sorted((p for p in plan if sum(p) < capacity), key=lambda p: (sum(p), p))
        if sum(plan.values()) <= fewest or len(open_) == 0:
            break
        back, owner = [], []
        for i, p in enumerate(open_):
            choices = [(), *_choices(p)]
            back += choices
            owner += [i] * len(choices)
        owner, given = np.array(owner), np.array([sum(c) for c in back])
        fill = np.array([sum(p) for p in open_])
        two_back = np.array([len(c) == 2 for c in back])
        for i, p in enumerate(open_):
            if p in barren:
                continue
            out = _choices(p)
            grows = np.array([sum(c) for c in out])[:, None] - given[None, :]
            fits = (grows > 0) & (grows <= (capacity - fill)[owner]) & (fill[owner] + grows > fill[i])
            fits &= ~(np.array([len(c) == 2 for c in out])[:, None] & two_back)
            if plan[p] < 2:
                fits &= owner != i
            if fits.any():
                gain = np.where(fits, grows * (fill[owner] - fill[i] + grows), 0)
                a, b = np.unravel_index(int(gain.argmax()), gain.shape)
                q = open_[owner[b]]
                n = plan[p] // 2 if q == p else min(plan[p], plan[q])
                made = [_exchanged(p, out[a], back[b]), _exchanged(q, back[b], out[a])]
                for old in (p, q):
                    plan[old] -= n
                for new in made:
                    if new:
                        plan[new] = plan.get(new, 0) + n
                        barren.clear()
                plan = {k: v for k, v in plan.items() if v}
                break
            barren.add(p)
        else:
            break
    return plan


def slots(plan: dict[Pattern, int]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: ranks at which a slot of the plan begins, the number of its first
    sequence, and the offset in it."""
    found: dict[int, list[tuple[int, int]]] = {}
    sizes: dict[int, list[int]] = {}
    first = 0
    for pattern, n in sorted(plan.items()):
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((first, offset))
            sizes.setdefault(length, []).append(n)
            offset += length
        first += n
    ends = {length: np.cumsum(n) for length, n in sizes.items()}
    return {length: (ends[length] - sizes[length], *np.array(at).T) for length, at in found.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, length, ids_crc32, ...)."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # of `capacity` lengths at most
    table = slots(swap_search(best_fit(counts, capacity), capacity))
    parts = F.lit([-(-counts.get(n, 0) // part_rows) or 1 for n in range(1, capacity + 1)])
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(parts, F.col("length").cast("int")))
    dealt = pieces.withColumn("__part", part)
    sums = dealt.groupBy("length", "__part").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("__part")) - F.col("count")
    sums = stored(sums.select("length", "__part", before.alias("__before")), "packing-counts")
    nth = F.row_number().over(W.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("__nth", nth).join(broadcast_if_small(sums, broadcast_rows), ["length", "__part"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("__before") + F.col("__nth") - 1).alias("__rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.zeros((2, len(ranks)), np.int64)
            for length in np.unique(lengths):
                starts, firsts, offsets = table[int(length)]
                at = lengths == length
                slot = np.searchsorted(starts, ranks[at], side="right") - 1
                sequence[at], offset[at] = firsts[slot] + ranks[at] - starts[slot], offsets[slot]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(seat, schema + ", sequence_id long, offset long")


def pack_best_fit(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, keep_ids: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """Pack the documents (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``keep_ids`` the ids themselves.  A null or empty text is one piece, the closing id
    alone; a long text is read whole and cut into pieces; rows that repeat an id or a text
    are packed each; a null id stays null.  Which of several pieces of one length goes where
    follows (doc_id, piece, checksum), so that reruns agree.  An empty table gives no rows.
    Further columns, whatever their names, are left out.
    """
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return place(stored(cut_pieces(docs, paths, capacity, keep_ids), "packing-pieces"), capacity, part_rows)


def op11(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack_best_fit(docs)
