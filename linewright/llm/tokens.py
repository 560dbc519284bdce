"""Token ids of whole texts by a public tokenizer, a batch of texts at a time."""

from __future__ import annotations

import os
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
# A worker forgets its words beyond this number, to bound its memory.
CACHE_WORDS = 1_000_000
# A word that the vocabulary holds as one token; it parts the words of one call.
_MARK = "\x01"
_JOINED = 2000
_TAILS = (".", ",")


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self) -> None:
        self.data = np.zeros(1 << 12, dtype=np.int32)
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.data):
            self.data = np.resize(self.data, max(size, 2 * len(self.data)))
        self.data[self.size : size] = values
        self.size = size

    def held(self) -> np.ndarray:
        return self.data[: self.size]


def _joined(parts: list, kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class BatchEncoder:
    """Encodes as the tokenizers library does, ``add_special_tokens=False``.

    The tokenizer looks at nothing across white space, so each distinct word is
    encoded once per worker by the library and looked up afterwards (:func:`encoder`
    keeps one from task to task). Texts that
    hold the opening of a special token's string go to the library whole.
    """

    def __init__(
        self, name: str = TOKENIZER, folder: str | None = None, words: int = CACHE_WORDS
    ):
        self.most = words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = f"{folder}/{name}" if folder else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        mark = self._encode([_MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.values, self.starts, self.lengths = _Grown(), _Grown(), _Grown()
        # The marks a word may end in, each a token by itself.
        self._learn(list(_TAILS))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [x.ids for x in found]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``ids, lengths``. Many words in few calls: the mark between two shows where to cut."""
        ids, lengths = [], []
        for i in range(0, len(words), _JOINED):
            group = words[i : i + _JOINED]
            if self.mark is not None:
                flat = np.array(self._encode([f" {_MARK} ".join(group)])[0], np.int32)
                cuts = np.flatnonzero(flat == self.mark)
                if len(cuts) == len(group) - 1:  # else a word holds the mark itself
                    ids.append(np.delete(flat, cuts))
                    ends = np.concatenate(([-1], cuts, [len(flat)]))
                    lengths.append(np.diff(ends) - 1)
                    continue
            each = self._encode(group)
            ids.append(np.fromiter(chain.from_iterable(each), np.int32))
            lengths.append(np.array([len(x) for x in each], np.int64))
        return _joined(ids, np.int32), _joined(lengths, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not in the tables yet, and enter them."""
        ids, lengths = self._encode_words(words)
        before = len(self.lengths)
        self.starts.add(len(self.values) + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.values.add(ids)
        self.index.update(zip(words, range(before, len(self.lengths)), strict=True))

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, without its last mark, in the tables, and that of the mark or -1.

        An ASCII letter and a mark after it are always apart in this tokenizer (others
        may end in a combining character once in lower case).
        """
        ended = pc.match_substring_regex(words, "[A-Za-z][.,]$")
        stems = pc.if_else(ended, pc.utf8_slice_codeunits(words, 0, -1), words).to_pylist()
        new = list(dict.fromkeys(filterfalse(self.index.__contains__, stems)))
        if new:
            self._learn(new)
        tails = np.full(len(words), -1, dtype=np.int64)
        ended = ended.to_numpy(zero_copy_only=False)
        for mark in _TAILS:
            has = pc.ends_with(words, mark).to_numpy(zero_copy_only=False)
            tails[ended & has] = self.index[mark]
        found = map(self.index.__getitem__, stems)
        return np.fromiter(found, dtype=np.int64, count=len(stems)), tails

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``offsets, ids``: text ``i`` has ``ids[offsets[i]:offsets[i + 1]]``."""
        if texts.null_count:
            texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            whole = self._encode(texts.to_pylist())
            offsets = np.zeros(len(whole) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in whole], out=offsets[1:])
            ids = np.fromiter(chain.from_iterable(whole), np.int32, offsets[-1])
            return offsets, ids
        lists = pc.ascii_split_whitespace(texts)
        words, cuts = lists.flatten(), lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        coded = words.dictionary_encode()
        # The library composes characters before it lower-cases them.
        kinds = coded.dictionary
        kinds = pc.if_else(pc.string_is_ascii(kinds), pc.ascii_lower(kinds), kinds)
        if len(self.index) > self.most:
            self._forget()
        places, tails = self._places(kinds)
        which = coded.indices.to_numpy()
        # Each word is one piece, or two with its mark.
        tail = tails[which]
        marked = tail >= 0
        at = np.arange(len(which)) + np.cumsum(marked) - marked
        piece = np.empty(len(which) + int(marked.sum()), dtype=np.int64)
        piece[at] = places[which]
        piece[at[marked] + 1] = tail[marked]
        length = self.lengths.held()[piece]
        ends = np.zeros(len(piece) + 1, dtype=np.int64)
        np.cumsum(length, out=ends[1:])
        # Places in a step's ids and in the remembered values both fit 32 bits.
        ids = np.repeat((self.starts.held()[piece] - ends[:-1]).astype(np.int32), length)
        ids += np.arange(len(ids), dtype=np.int32)
        ids = self.values.held().astype(np.int32, copy=False)[ids]
        return ends[np.append(at, len(piece))[cuts]], ids

    def encode_ended(
        self, texts: pa.Array, end_id: int = END_ID
    ) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after each text."""
        offsets, ids = self.encode(texts)
        ended = np.full(len(ids) + len(texts), end_id, dtype=np.int32)
        keep = np.ones(len(ended), dtype=bool)
        moved = offsets + np.arange(len(offsets))
        keep[moved[1:] - 1] = False
        ended[keep] = ids
        return moved, ended


def encoder(
    name: str = TOKENIZER, folder: str | None = None, words: int = CACHE_WORDS
) -> BatchEncoder:
    """The worker's encoder, with the words its earlier tasks have met."""
    return kept(("tokens", name, folder, words), lambda: BatchEncoder(name, folder, words))
