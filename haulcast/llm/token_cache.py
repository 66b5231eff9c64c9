"""Token ids of many texts by way of their distinct pieces.

A tokenizer that never joins across certain cuts gives a text the ids of its
pieces, one after the other. A task therefore lets the library encode each
distinct piece once. Pieces are found by a 64-bit hash and compared byte by byte
with the piece that the hash stands for; one that differs is encoded by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from haulcast.llm.words import bytes_of

#: Encodes texts: all their ids in a row, and how many each has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: Distinct pieces that a task keeps before it starts anew. It only saves work: results don't depend on it.
KEEP = 1 << 18
#: The same where little more than the ids of a piece is kept.
KEEP_IDS = 1 << 20
#: Pieces that the library encodes in one call.
AT_ONCE = 1 << 11
#: Words that the library encodes as one text, and what stands between them: a control character is a token of its own.
IN_ONE_TEXT = 1 << 8
MARK = "\x01"


class PieceCache:
    """Numbers distinct pieces; ``grow`` takes the texts of new ones, in the order of their numbers."""

    def __init__(self, grow: Callable[[list[str]], None], forget: Callable[[], None], keep: int = KEEP) -> None:
        self._grow, self._forget, self._keep = grow, forget, keep
        self._clear()

    def _clear(self) -> None:
        self._known: dict[int, int] = {}
        self._codes = np.zeros(0, np.uint8)
        self._offsets = np.zeros(1, np.int64)

    def start(self) -> None:
        """To be called between batches: forgets all pieces when there are many."""
        if len(self._offsets) > self._keep:
            self._clear()
            self._forget()

    def _add(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self._offsets) - 1
        held, offsets = bytes_of(codes, start, end)
        whole, at = held.tobytes(), offsets.tolist()
        self._grow([whole[a:b].decode() for a, b in zip(at, at[1:])])
        self._codes = np.concatenate([self._codes, held])
        self._offsets = np.concatenate([self._offsets, self._offsets[-1] + offsets[1:]])
        return np.arange(n, n + len(start))

    def numbers(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece ``start:end`` of ``codes``; pieces hold whole characters."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.fromiter((self._known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._add(codes, start[first[new]], end[first[new]])
            self._known.update(zip(distinct[new].tolist(), found[new].tolist()))
        out = found[inverse]
        other = self._different(codes, start, end, out)
        if len(other):
            out[other] = self._add(codes, start[other], end[other])
        return out

    def _different(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
        first, last = self._offsets[number], self._offsets[number + 1]
        same = last - first == end - start
        mine, offsets = bytes_of(codes, start[same], end[same])
        held, _ = bytes_of(self._codes, first[same], last[same])
        wrong = np.searchsorted(offsets, np.flatnonzero(mine != held), "right") - 1
        return np.union1d(np.flatnonzero(~same), np.flatnonzero(same)[wrong])


class IdCache:
    """Ids of pieces by one tokenizer."""

    def __init__(self, encode: Encode) -> None:
        self._encode = encode
        self._clear()
        self.pieces = PieceCache(self._more, self._clear, KEEP_IDS)

    def _clear(self) -> None:
        self.ids = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)

    def _more(self, texts: list[str]) -> None:
        ids, counts = self._encode(texts)
        self.ids = np.concatenate([self.ids, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])

    def encode(
        self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        self.pieces.start()
        number = self.pieces.numbers(codes, start, end, hashes)
        first, last = self.offsets[number], self.offsets[number + 1]
        return bytes_of(self.ids, first, last)[0], last - first


def json_encoder(path: str, specials_are_text: bool = False) -> Encode:
    """Encodes with a file of the tokenizers library, without adding special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = specials_are_text

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The library's results are large objects: only some are held at a time.
        groups = (texts[i : i + AT_ONCE] for i in range(0, len(texts), AT_ONCE))
        ids = [e.ids for g in groups for e in tokenizer.encode_batch_fast(g, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for some in ids for i in some), np.int64, int(counts.sum())), counts

    return encode


def word_encoder(path: str) -> Encode:
    """The ids of ``json_encoder`` for words, where the tokenizer never joins across white space.

    The library takes many words as one text, with MARK between them. Its id then shows where each word ends. Words with
    a MARK of their own, and texts whose marks do not come back, are encoded word by word.
    """
    from tokenizers import Tokenizer

    alone = json_encoder(path)
    mark, _ = alone([MARK])
    if len(mark) != 1:
        return alone
    tokenizer = Tokenizer.from_file(path)

    def some(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = f" {MARK} ".join(words)
        if text.count(MARK) != len(words) - 1:
            return alone(words)
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(ids == mark[0])
        if len(at) != len(words) - 1:
            return alone(words)
        return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [some(texts[i : i + IN_ONE_TEXT]) for i in range(0, len(texts), IN_ONE_TEXT)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])

    return encode


def piece_encoder(path: str) -> Encode:
    """Encodes with a model of the sentencepiece library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = model.encode(texts, num_threads=1) if texts else []
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for some in ids for i in some), np.int64, int(counts.sum())), counts

    return encode
