"""Token counts without token ids: a count-only Viterbi pass over Aho-Corasick matches.

One automaton holds every piece of the unigram vocabulary and reports, for each
end position, the pieces that end there, longest first. The dynamic programme
carries two numbers per position, the best score and the pieces on that path,
in a ring as long as the longest piece: no backpointers, no ids, no strings.
Ties go to the piece that starts first, as in the encoder, and an uncovered
character counts as its UTF-8 byte pieces, so a count equals the number of ids
that the encoder gives. The short words that a batch has for the first time are
counted together, in step (no piece crosses a word start), and remembered in a
bounded memo; long words and unusual spacing are counted character by character.

Defined results: null and empty texts count 0; a null doc_id stays null; rows
that repeat are counted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, batches_of, ship_package, text_or_empty, tokenizer_path
from .sentencepiece_stream import MARK, MEMO_WORD, Vocabulary, segments
from .viterbi import WordMemo, WordSearch

#: Words that a counter remembers, in each of two generations.
MEMO_ENTRIES = 50_000


def _plain(v: Vocabulary, text: str) -> bool:
    """``text`` is words with one space between them, and all paths converge before each word."""
    return v.by_word and v.prefix and text != "" and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " "


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._search = WordSearch(vocabulary, MARK)
        self._words = WordMemo(self._search.counts, lambda w: self.stream(MARK + w), MEMO_WORD, MEMO_ENTRIES)

    def stream(self, text: str) -> int:
        """Pieces on the best path through a normalised text of any length, with a ring of the longest piece's length."""
        ring = self.v.longest + 1
        best, count = [0.0] * ring, [0] * ring
        length, score = self._search.length, self._search.score
        done = 0  # boundaries up to it are settled

        def settle(end: int, matches: list[int]) -> None:
            top, pieces, alone = None, 0, False
            for match in matches:
                size = int(length[match])
                total = best[(end - size) % ring] + float(score[match])
                alone |= size == 1
                if top is None or total > top:
                    top, pieces = total, count[(end - size) % ring] + 1
            total = best[(end - 1) % ring] + self.v.unknown_score
            if not alone and (top is None or total > top):
                top, pieces = total, count[(end - 1) % ring] + len(self.v.spelled(text[end - 1]))
            best[end % ring], count[end % ring] = top, pieces

        matches: list[int] = []  # pieces that end at the boundary after ``done``
        for last, match in self._search.automaton.iter(text):
            while done < last:
                done += 1
                settle(done, matches)
                matches = []
            matches.append(match)
        while done < len(text):
            done += 1
            settle(done, matches)
            matches = []
        return count[len(text) % ring]

    def count_all(self, texts: list[str]) -> list[int]:
        v = self.v
        cut = [t.split(" ") if _plain(v, t) else None for t in texts]
        known = self._words.learn(filter(None, cut))
        return [sum(map(known, ws) if ws else map(self.stream, segments(v, text))) for text, ws in zip(texts, cut, strict=True)]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process and model file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each row: one narrow pass."""
    ship_package(docs.sparkSession)
    model = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(model)
        for batch in batches_of(batches, TEXT_BYTES):
            counts = made.count_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
