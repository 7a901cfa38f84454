"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The pieces and scores of a model file are read as a unigram vocabulary: the ids
of a text are those of the segmentation with the largest sum of piece scores.
Among equal sums, the piece that starts first (the longest) wins at each end
position. A character that no single-character piece covers costs the lowest
score minus 10 and comes out as its UTF-8 byte pieces (or the unknown id when
the model has none). Scores add up in double precision, exactly for the
whole-number scores of such files.

The search reads a text character by character and keeps scores only for the
``longest`` (maximum piece length) positions that later pieces can still start
at. Backpointers older than the boundary on which all surviving paths converge
are committed as ids and dropped, so a text of any length needs a short window.

When no piece has a word-start mark after another character (checked), all
paths converge before each word. Then Arrow numbers the words of a batch, the
short ones that are new are searched together, in step, and their ids are kept
in a bounded table; long words and unusual spacing go through the stream, in
chunks of ``CHUNK`` characters.

Normalisation: identity with a dummy prefix; a space becomes the mark U+2581.
Decoding reverses it exactly, except that the mark itself comes back as a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, ship_package, text_or_empty, tokenizer_path
from .viterbi import WordSearch, WordTable

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer words go through the stream each time.
MEMO_WORD = 40
#: Words that an encoder remembers before its table starts anew.
MEMO_ENTRIES = 200_000
#: Bytes of text that are cut into words at once.
BATCH_BYTES = 4 << 20
#: Characters that the stream takes in at once.
CHUNK = 1 << 12

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(p.type == _USER for p in model.pieces):
            raise ValueError("only models with identity normalisation and without user-defined pieces are supported")
        self.prefix = bool(spec.add_dummy_prefix)
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.bytes = [i for i, p in enumerate(model.pieces) if p.type == _BYTE]
        self.unknown_score = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.surface = [b""] * len(model.pieces)  # bytes of each id
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == _NORMAL:
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == _UNKNOWN:
                self.surface[i] = " ⁇ ".encode()

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.bytes[b] for b in char.encode()] if len(self.bytes) == 256 else [self.unknown]

    def normalised(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text


def plain_words(v: Vocabulary, texts: pa.Array) -> np.ndarray:
    """Which ``texts`` are words with one space between them, and all paths converge before each word."""
    if not (v.by_word and v.prefix):
        return np.zeros(len(texts), bool)
    return ~pc.match_substring_regex(texts, rf"\A\z|\A | \z|  |{MARK}").to_numpy(zero_copy_only=False)


def segments(v: Vocabulary, text: str) -> Iterator[str]:
    """The normalised text, cut where all paths converge."""
    whole = v.normalised(text)
    return (m.group() for m in re.finditer(f"{MARK}*[^{MARK}]+|{MARK}+", whole)) if v.by_word else iter([whole] if whole else [])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: every beginning of a piece: () or, for a whole piece, (id, score)
        self.tree: dict[str, tuple] = {p[:k]: () for p in vocabulary.pieces for k in range(1, len(p) + 1)} | vocabulary.pieces
        self.window = 0  # the most positions that were held back
        self._words = WordTable(WordSearch(vocabulary, MARK).ids, lambda w: self._streamed(MARK + w), MEMO_WORD, MEMO_ENTRIES, "<u4")

    def _streamed(self, text: str) -> bytes:
        chunks = (text[k:k + CHUNK] for k in range(0, len(text), CHUNK))
        return b"".join([np.array(p, "<u4").tobytes() for p in self.search(chunks)])

    def search(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the normalised text that ``chunks`` make up, in the parts in which they are committed."""
        find, longest, unknown = self.tree.get, self.v.longest, self.v.unknown_score
        text, best, back, ident = "", [0.0], [0], [0]  # best sum to each position; start and id of its last piece
        at = done = reach = 0  # next start; last committed boundary; furthest end of any piece so far
        source, more = iter(chunks), True
        while more or at < len(text):
            if more and len(text) - at < longest:
                part = next(source, None)
                if part is None:
                    more = False
                    continue
                text = text[done:] + part
                at, reach = at - done, reach - done
                best, back, ident = best[done:], [b if b is None else b - done for b in back[done:]], ident[done:]
                done, new = 0, [None] * len(part)
                best += new
                back += new
                ident += new
                continue
            n = len(text)
            for at in range(at, n if not more else n - longest + 1):
                score = best[at]
                for end in range(at + 1, min(at + longest, n) + 1):
                    piece = find(text[at:end])
                    if piece is None:
                        break
                    if piece:
                        total = score + piece[1]
                        if end > reach:
                            reach = end
                        if best[end] is None or total > best[end]:
                            best[end], back[end], ident[end] = total, at, piece[0]
                end = at + 1
                if not find(text[at]):  # no piece for this character alone
                    total = score + unknown
                    reach = max(reach, end)
                    if best[end] is None or total > best[end]:
                        best[end], back[end], ident[end] = total, at, -1
                if end - done >= longest:
                    held = end - done
                    meet = end if reach == end else self._meeting(back, done, end, reach) if held % longest == 0 else done
                    if meet > done:
                        self.window = max(self.window, held)
                        yield self._ids(text, back, ident, done, meet)
                        done = meet
            at += 1
        if done < at:
            yield self._ids(text, back, ident, done, at)

    @staticmethod
    def _meeting(back: list, done: int, at: int, reach: int) -> int:
        """The last boundary that the best paths to ``at`` and to all ends after it share."""
        ends = {at} | {e for e in range(at + 1, reach + 1) if back[e] is not None}
        while len(ends) > 1:  # the furthest end steps back
            last = max(ends)
            ends.remove(last)
            ends.add(back[last] if last > done else done)
        return ends.pop()

    def _ids(self, text: str, back: list, ident: list, done: int, end: int) -> list[int]:
        out: list[int] = []
        while end > done:
            if ident[end] >= 0:
                out.append(ident[end])
            else:
                out += reversed(self.v.spelled(text[back[end]:end]))
            end = back[end]
        out.reverse()
        return out

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as u32."""
        plain = plain_words(self.v, texts)
        flat, ends = self._words.encode(pc.split_pattern(texts.filter(pa.array(plain)), " "))
        worded = iter(np.split(flat, ends[:-1]))
        return [next(worded) if p else np.frombuffer(b"".join(map(self._streamed, segments(self.v, text.as_py()))), "<u4") for p, text in zip(plain, texts, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.v.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str | None = None, ids: bool = True, digest: bool = False) -> DataFrame:
    """doc_id, n_ids, and as asked: ``ids`` (array), ``ids_crc32`` (of the ids as u32 LE) and ``round_trip`` (decoding gives the text).

    One narrow pass, one row per row. Null text is empty; a null doc_id stays null; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    model = model or tokenizer_path("piece_bpe_32k.model")
    schema = "doc_id long, n_ids long" + (", ids array<int>" if ids else "") + (", ids_crc32 long, round_trip boolean" if digest else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(model)
        for batch in batches_of(batches, BATCH_BYTES):
            coded = made.encode_all(batch.column("text"))
            out = [batch.column("doc_id"), pa.array([len(c) for c in coded], pa.int64())]
            if ids:
                ends = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype("i4")
                flat = np.concatenate(coded) if coded else np.zeros(0, "<u4")
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype("i4"))))
            if digest:
                same = [made.decode(c.tolist()) == t.replace(MARK, " ") for c, t in zip(coded, batch.column("text").to_pylist(), strict=True)]
                out += [pa.array([zlib.crc32(c.tobytes()) for c in coded], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of a (doc_id, ids) table; null ids give an empty text."""
    ship_package(coded.sparkSession)
    model = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(model)
        for batch in batches_of(batches):
            texts = [made.decode(c or []) for c in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
