"""Best segmentations of many words at once, from the piece matches of an Aho-Corasick automaton.

Used for the words of a text between two boundaries on which all paths
converge. All words of a block advance together: step ``p`` settles the best
score of boundary ``p`` of every word, longest piece (earliest start) first and
replacing only by a larger sum, which are the encoder's tie rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Words searched together; bounds the match arrays.
BLOCK_WORDS = 8192


def automaton(pieces: dict[str, tuple[int, float]]):
    """An Aho-Corasick automaton that reports the index of each piece in ``pieces``."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        made.add_word(piece, i)
    made.make_automaton()
    return made


class WordSearch:
    """Segments words (each without mark or space, a mark is put before it) over a vocabulary's pieces."""

    def __init__(self, vocabulary, mark: str):
        self.v, self.mark = vocabulary, mark
        self.automaton = automaton(vocabulary.pieces)
        self.length = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.ident = np.array([i for i, _ in vocabulary.pieces.values()], np.int64)
        self.score = np.array([s for _, s in vocabulary.pieces.values()], np.float64)

    def _best(self, words: list[str]):
        """Matches in order of settling, and per boundary the pieces on the best path and the last match of it."""
        text = self.mark + self.mark.join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word = np.repeat(np.arange(len(words)), sizes)  # of each character
        first = np.cumsum(sizes) - sizes
        found = list(self.automaton.iter(text))
        last, piece = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        length, score = self.length[piece], self.score[piece]
        alone = np.zeros(len(text), bool)
        alone[last[length == 1]] = True
        bare = np.flatnonzero(~alone)  # characters that no piece covers alone
        width = np.array([len(self.v.spelled(text[i])) for i in bare], np.int64)
        last = np.concatenate([last, bare])
        length = np.concatenate([length, np.ones(len(bare), np.int64)])
        score = np.concatenate([score, np.full(len(bare), self.v.unknown_score)])
        ident = np.concatenate([self.ident[piece], -1 - bare])
        adds = np.concatenate([np.ones(len(piece), np.int64), width])
        end = last + word[last] + 1  # boundaries: one more than characters in each word
        step = (last - first[word[last]] + 1) * (self.v.longest + 1) + self.v.longest - length
        order = np.argsort(step.astype(np.min_scalar_type(int(step.max(initial=0)))), kind="stable")  # few values: a counting sort
        end, length, score, ident, adds, step = (x[order] for x in (end, length, score, ident, adds, step))
        start = end - length
        best = np.full(len(text) + len(words), -np.inf)
        origin = first + np.arange(len(words))
        best[origin] = 0.0
        back, count = np.full(len(best), -1, np.int64), np.zeros(len(best), np.int64)
        cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            total = best[start[a:b]] + score[a:b]
            better = np.flatnonzero(total > best[end[a:b]])
            to = end[a:b][better]
            best[to], back[to] = total[better], better + a
            count[to] = count[start[a:b][better]] + adds[a:b][better]
        return text, start, ident, back, count, origin, origin + sizes

    def counts(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for k in range(0, len(words), BLOCK_WORDS):
            *_, count, _, final = self._best(words[k:k + BLOCK_WORDS])
            out += count[final].tolist()
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as u32 LE."""
        out: list[bytes] = []
        for k in range(0, len(words), BLOCK_WORDS):
            text, start, ident, back, count, origin, final = self._best(words[k:k + BLOCK_WORDS])
            n = count[final]
            to = np.cumsum(n)  # one past the next id to fill in, from the back
            flat = np.zeros(int(n.sum()), "<u4")
            at, live = final.copy(), np.arange(len(final))
            while len(live):
                match = back[at[live]]
                got = ident[match]
                plain = got >= 0
                to[live[plain]] -= 1
                flat[to[live[plain]]] = got[plain]
                for w, g in zip(live[~plain], got[~plain], strict=True):
                    spelled = self.v.spelled(text[-1 - g])
                    to[w] -= len(spelled)
                    flat[to[w]:to[w] + len(spelled)] = spelled
                at[live] = start[match]
                live = live[at[live] > origin[live]]
            raw, ends = flat.tobytes(), (4 * np.cumsum(n)).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out


class WordMemo(dict):
    """Values of words, found together for a batch; two generations of about ``entries`` words are kept.

    Words of more than ``longest`` characters are never kept: ``one`` finds them when they are asked for.
    """

    def __init__(self, find: Callable[[list[str]], list], one: Callable[[str], object], longest: int, entries: int):
        super().__init__()
        self._find, self._one, self._longest, self._entries = find, one, longest, entries
        self._old: dict = {}

    def __missing__(self, word):
        return self._one(word)

    def learn(self, words: Iterable[list[str]]) -> Callable[[str], object]:
        """Makes sure of all short words in the lists; returns the lookup."""
        if len(self) >= self._entries:
            self._old = dict(self)
            self.clear()
        missing = set().union(*words).difference(self)
        kept = {w: self._old[w] for w in missing.intersection(self._old)}
        self.update(kept)
        new = sorted(w for w in missing.difference(kept) if len(w) <= self._longest)
        if new:
            self.update(zip(new, self._find(new), strict=True))
        return self.__getitem__


class WordTable:
    """Ids of words, laid end to end under the words' numbers; Arrow numbers the distinct words of a batch.

    ``find`` gives the ids of many short words, ``one`` those of one word, as raw
    bytes of ``kind``. Words of more than ``longest`` characters are held for
    their batch alone; with ``entries`` words the table starts anew.
    """

    def __init__(self, find: Callable[[list[str]], list[bytes]], one: Callable[[str], bytes], longest: int, entries: int, kind: str):
        self._find, self._one, self._longest, self._entries, self._kind = find, one, longest, entries, np.dtype(kind)
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._flat, self._size = np.zeros(0, self._kind), np.zeros(0, np.int64)

    def _add(self, raws: list[bytes], flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // self._kind.itemsize
        return np.concatenate([flat, np.frombuffer(b"".join(raws), self._kind)]), np.concatenate([size, sizes])

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each of the distinct ``words``, and the ids and sizes that the numbers stand for."""
        if len(self._number) >= self._entries:
            self._forget()
        got = list(map(self._number.get, words))
        missing = [w for w, i in zip(words, got, strict=True) if i is None]
        new, long = sorted(w for w in missing if len(w) <= self._longest), [w for w in missing if len(w) > self._longest]
        if new:
            self._flat, self._size = self._add(self._find(new), self._flat, self._size)
            self._number.update(zip(new, range(len(self._number), len(self._size)), strict=True))
        flat, size = self._flat, self._size
        if long:
            flat, size = self._add(list(map(self._one, long)), flat, size)
        if missing:
            number = self._number | dict(zip(long, range(len(self._size), len(size)), strict=True)) if long else self._number
            got = list(map(number.__getitem__, words))
        return np.fromiter(got, np.int64, len(got)), flat, size

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists of words end to end, and where each list's ids end."""
        coded = words.flatten().dictionary_encode()
        number, flat, size = self._numbers(coded.dictionary.to_pylist())
        word = number[coded.indices.to_numpy()]
        n = size[word]
        ends = np.cumsum(n)
        total = int(n.sum())
        index = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        at = np.repeat(((np.cumsum(size) - size)[word] - (ends - n)).astype(index), n)
        at += np.arange(total, dtype=index)
        return flat[at], np.append(0, ends)[np.cumsum(words.value_lengths().to_numpy())]
