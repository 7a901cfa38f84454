"""Best-two-fit packing of token-id documents into sequences of a fixed length.

A sequence is filled greedily, always with the longest piece that still fits.
Then its smallest piece is replaced with the two unpacked pieces that fill the
room it leaves most tightly, as long as two together are longer than it.

Pieces of equal length are interchangeable, so the sequences are planned over
the counts of the (at most ``capacity``) lengths, not over the pieces: a step
of the plan is one filling and how often it is used, which is until one of its
lengths runs short. The counts are all that reaches the driver, and the plan
all that is broadcast; both are bounded by the capacity, however many documents
there are: a length runs short at most ``log2(capacity) + 1`` times, since what
is left of it is at least halved each time. Pieces then find their places in
parallel: a piece's rank among those of its length (its number in its task plus
those in tasks before) is its slot in the plan.

* one pass encodes the texts and stores the pieces, ids included;
* a join on (task, length) gives the ranks; texts and ids are never shuffled;
* :func:`sequences` puts the ids together, one row per sequence.

The pieces are stored before they are counted, so ranks do not change when an
executor is lost; a repeated task replaces its own file.

Defined results: null text is empty, its ids are the end id alone; a null or
repeated doc_id is packed like any other, row by row; a document longer than
the capacity is cut into full pieces and a last one that may be shorter, and no
other is cut; which of several equally long pieces goes where is left open;
other columns are ignored; an empty table gives no rows. The words and ids of
8 MB of text, or of one longer document, are held as a whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, ship_package, stored, text_or_empty, tokenizer_path

#: The memo of words starts anew beyond this many.
MEMO_WORDS = 1_000_000
#: Missing words that the library encodes as one text.
JOINED_WORDS = 512

_PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, task int, nth long"
_PLACES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long, sequence_id long, offset int"


@dataclass(frozen=True)
class Packed:
    #: doc_id, piece, start, length, ids (u32, little-endian), ids_crc32, task, nth
    pieces: DataFrame
    #: the same pieces by (task, length, nth), without ids, with sequence_id and offset
    places: DataFrame


def word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to their ids, as the ``tokenizers`` library gives them, laid end to end, and where each text ends.

    This vocabulary drops white space and ends words there, so a text's ids are
    those of its words; it also writes A-Z small and starts a word where
    punctuation follows a letter and white space or the end follows that. Arrow
    cuts and numbers the distinct words of a batch; the library encodes each
    once per worker, until the memo is full and starts anew. Missing words of
    letters alone are encoded as one text and cut at the tokens that end words.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    lib = Tokenizer.from_file(path)

    def library(words: list[str]) -> list[list[int]]:
        return [e.ids for e in lib.encode_batch_fast(words, add_special_tokens=False)]

    whole, cut = library(["Ab cde.\n\u00e4b?! c", "ab"]), library(["ab", "cde", ".", "\u00e4b", "?!", "c"])
    if whole != [sum(cut, []), cut[0]]:
        raise ValueError(f"{path}: words are not encoded independently of each other")
    last = np.zeros(max(lib.get_vocab().values()) + 1, bool)  # tokens that end a word
    last[[i for token, i in lib.get_vocab().items() if token.endswith("</w>")]] = True
    known: dict[str, int] = {}
    start, size, flat = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = library(words)
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(library([" ".join(words)])[0], "<u4")
        ends = np.flatnonzero(last[ids]) + 1
        # a letter may become a letter with a mark, which ends a word: such words come one by one
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else one_by_one(words)

    def numbers(words: list[str]) -> np.ndarray:
        nonlocal start, size, flat
        if len(known) >= MEMO_WORDS:
            known.clear()
            start, size, flat = start[:1], size[:0], flat[:0]
        got = list(map(known.get, words))
        missing = [w for w, i in zip(words, got, strict=True) if i is None]
        if missing:
            plain, rest = [w for w in missing if w.isalpha()], [w for w in missing if not w.isalpha()]
            new = [together(plain[k:k + JOINED_WORDS]) for k in range(0, len(plain), JOINED_WORDS)] + [one_by_one(rest)]
            known.update(zip(plain + rest, range(len(known), len(known) + len(missing)), strict=True))
            flat, size = (np.concatenate([x, *y]) for x, y in zip((flat, size), zip(*new, strict=True), strict=True))
            start = np.concatenate([[0], np.cumsum(size)])
            got = list(map(known.__getitem__, words))
        return np.fromiter(got, np.int64, len(got))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        small = pc.ascii_lower(texts)
        apart = pc.replace_substring_regex(small, r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,;:!?]+)([\x20\x09-\x0d]|\z)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(apart)  # at 0x20 and 0x09-0x0D; spaces at the ends make empty words, without ids
        coded = words.flatten().dictionary_encode()
        word = numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = size[word]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(start[word] - (ends - n), n)
        return flat[at], np.append(0, ends)[np.cumsum(pc.list_value_length(words).to_numpy())]

    return encode


_ENCODERS: dict[str, Callable] = {}


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, word_encoder(path))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in batches_of(batches):
            docs, piece, start, length, raws, crcs, nth = [], [], [], [], [], [], []
            flat, ends = encode(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    raw = ids[at:at + capacity].tobytes()
                    n = len(raw) // 4
                    docs.append(doc_id)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    raws.append(raw)
                    crcs.append(zlib.crc32(raw))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                 pa.array(raws, pa.binary()), pa.array(crcs, pa.int64()), pa.array([task] * len(docs), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"])

    return run


def _tightest_two(lengths: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum of at most ``room``; (0, 0) where there are none."""
    other = np.searchsorted(lengths, room - lengths, "right") - 1
    other = np.minimum(other, np.arange(len(lengths)))  # the second is the shorter one
    alone = (other == np.arange(len(lengths))) & (left[lengths] < 2)
    other = other - alone
    sums = np.where(other >= 0, lengths + lengths[other], 0)
    if not len(sums) or not (best := int(sums.argmax()), sums[best])[1]:
        return 0, 0
    return int(lengths[best]), int(lengths[other[best]])


def fill(left: np.ndarray, replace: bool = True) -> dict[int, int]:
    """The next sequence from the counts ``left`` of unpacked pieces by length: length → how many, longest first."""
    left = left.copy()
    gap = len(left) - 1
    used: dict[int, int] = {}
    lengths = np.flatnonzero(left)
    while len(lengths := lengths[lengths <= gap]):  # the longest that fits, as often as it does
        longest = int(lengths[-1])
        n = int(min(gap // longest, left[longest]))
        used[longest] = n
        left[longest] -= n
        gap -= n * longest
        lengths = lengths[:-1]
    while replace and gap and used:
        smallest = min(used)
        room = gap + smallest
        lengths = np.flatnonzero(left[:room])
        two = _tightest_two(lengths, left, room)
        if sum(two) <= smallest:
            break
        used[smallest] -= 1
        left[smallest] += 1
        if not used[smallest]:
            del used[smallest]
        for n in two:
            used[n] = used.get(n, 0) + 1
            left[n] -= 1
        gap = room - sum(two)
    return dict(sorted(used.items(), reverse=True))


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, classes): where the pieces of each length go.

    ``classes[n]`` is the first slot of length ``n``; a row of ``slots`` is (its
    first slot, first sequence, pieces of this length in each of its sequences,
    offset of the first of them), in order of slots. Where replacing two for one
    gives more sequences than the greedy filling alone, that is used.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    return min((_plan(left.copy(), replace) for replace in (True, False)), key=lambda p: p[0])[1:]


def _plan(left: np.ndarray, replace: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(sequences, slots, classes) of a plan."""
    classes = np.concatenate([[0], np.cumsum(left)])[:-1]
    taken = classes.copy()
    rows, sequence = [], 0
    while left.any():
        used = fill(left, replace)
        times = min(int(left[n]) // k for n, k in used.items())
        offset = 0
        for n, k in used.items():
            rows.append((int(taken[n]), sequence, k, offset))
            taken[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequence += times
    slots = np.array(rows, np.int64).reshape(-1, 4)
    return sequence, slots[np.argsort(slots[:, 0])], classes


def _placer(made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, classes = made.value
        first, sequence, each, offset = slots.T
        for batch in batches:
            length = batch.column("length").to_numpy()
            slot = classes[length] + batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            row = np.searchsorted(first, slot, "right") - 1
            nth = slot - first[row]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence[row] + nth // each[row], pa.int64()), pa.array(offset[row] + nth % each[row] * length, pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = 4096) -> Packed:
    """Encode ``docs`` (doc_id, text), cut what is too long, and place every piece."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = stored(texts.mapInArrow(_cutter(vocabulary or tokenizer_path("word_bpe_49k.json"), end_id, capacity), _PIECES), "pieces")
    in_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = in_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in in_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    made = spark.sparkContext.broadcast(plan(counts, capacity))
    return Packed(pieces, pieces.drop("ids").join(ranks, ["length", "task"]).mapInArrow(_placer(made), _PLACES))


def sequences(packed: Packed) -> DataFrame:
    """The packed sequences: sequence_id, ids (u32, little-endian), doc_ids and lengths in their order."""
    rows = packed.places.select("task", "length", "nth", "sequence_id", "offset").join(packed.pieces, ["task", "length", "nth"])
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    joined = F.expr("aggregate(p, binary(''), (a, x) -> concat(a, x.ids))")
    return parts.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
