"""Whole-text encoding with a public tokenizer, each distinct chunk of a portion of texts encoded once.

Both supported kinds of pre-tokenizer (a \\p{L}+ / \\p{N} / punctuation split, with or without one leading
space) always start a new piece where white space follows other characters and where plain punctuation
follows a letter, and nothing they do later looks back. So does a letter after a single line end that follows
other characters. Text cut there encodes chunk by chunk to the ids of the whole. The cuts of many texts are
found at once in their bytes, the chunks are numbered by their value, and the tokenizer gets each once.
Texts with control characters or white space beyond ASCII, which the regular expressions see differently,
or with the start of a special token's string are encoded whole. A worker remembers the ids of REMEMBERED
recent chunks at most, as Arrow arrays.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit integers")

#: Bytes of text, one text at least, that are cut and encoded at once.
PORTION = 2 << 20
#: Chunks that a worker remembers, of so many bytes at most: with their ids some 8 MB.
REMEMBERED, REMEMBERED_SIZE = 200_000, 32
#: Plain words that the tokenizer gets as one text, with a mark between them.
_GROUP = 256
#: Chunks that one call of the tokenizer gets: its results hold much more than the ids.
_CALL = 32 * _GROUP
_OTHER, _SPACE, _LINE, _LETTER, _MARK = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \t")] = _SPACE
_KIND[10] = _LINE
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KIND[list(b".,:;!?|#$%&*")] = _MARK
_WHITE = (_KIND == _SPACE) | (_KIND == _LINE)
#: By the kinds of two neighbours, 8 * first + second: whether text may be cut between them.
_CUT, _CUT_WITHOUT_SPACE = np.zeros(64, bool), np.zeros(64, bool)
_CUT[8 * _LETTER + _MARK] = _CUT_WITHOUT_SPACE[8 * _LETTER + _MARK] = True
for _kind in (_OTHER, _LETTER, _MARK):
    _CUT[[8 * _kind + _SPACE, 8 * _kind + _LINE]] = True
    _CUT_WITHOUT_SPACE[[8 * _SPACE + _kind, 8 * _LINE + _kind]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: First bytes of what makes a text odd.
_MAYBE = np.zeros(256, bool)
_MAYBE[[c for c in range(32) if c not in (9, 10)]] = True
_MAYBE[[0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _odd(b: np.ndarray) -> np.ndarray:
    """Places of control characters, white space beyond ASCII and <| in UTF-8."""
    at = np.flatnonzero(_MAYBE[b])
    padded = np.concatenate([b[-2:] if len(b) < 2 else b, np.zeros(2, np.uint8)])
    x, y, z = b[at], padded[at + 1], padded[at + 2]
    control = (x < 32) | (x == 0x7F) | ((x == 0xC2) & (y <= 0xA0)) | ((x == 0x3C) & (y == 0x7C))
    white = ((x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    white |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8B) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    return at[control | white]


def _lists(ids: list[list[int]]) -> pa.Array:
    return pa.array(ids, pa.large_list(pa.uint32()))


class Encoder:
    """encode(texts) gives the ids of many texts, portion by portion."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # then it also folds case
        self.drops_space = self._ids(["a b"])[0] == self._ids([" A\n\tb "])[0]

        self.mark = self._ids(["|"])[0]
        self.known, self.known_ids = pa.array([], pa.large_binary()), _lists([])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self._ids([text])[0], "<u4").tobytes()

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per portion of texts, in order: all their ids, end_id after each text's, and where each text ends
        among them. A null is an empty text."""
        size = pc.binary_length(texts).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.concatenate([[0], np.cumsum(size)]), 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PORTION, "right")) - 1)
            flat = texts.slice(start, stop - start).cast(pa.large_binary()).fill_null(b"")
            first = int(np.frombuffer(flat.buffers()[1], np.int64)[flat.offset])
            data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[first : first + ends[stop] - ends[start]]
            yield self._portion(data, ends[start : stop + 1] - ends[start], end_id)
            start = stop

    def _encoded(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of some chunks."""
        offsets, data = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset :][: len(chunks) + 1], np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        letters, size = np.concatenate([[0], np.cumsum(_KIND[data] == _LETTER)]), np.diff(offsets)
        letters = letters[offsets[1:]] - letters[offsets[:-1]]
        plain = (letters > 0) & ((letters == size) | ((letters == size - 1) & (data[offsets[:-1]] == 32))) & (len(self.mark) == 1)
        words, others = chunks.filter(pa.array(plain)), chunks.filter(pa.array(~plain))
        both = [_lists([])]
        for i in range(0, len(words), _CALL):
            some = words.slice(i, _CALL).to_pylist()
            grouped = self._ids([b"|".join(some[j : j + _GROUP]).decode() + "|" for j in range(0, len(some), _GROUP)])
            flat = np.concatenate([np.array(ids, np.uint32) for ids in grouped])
            ends = np.flatnonzero(flat == self.mark[0])
            both.append(pa.LargeListArray.from_arrays(np.concatenate([[0], ends - np.arange(len(ends))]), pa.array(flat[flat != self.mark[0]])))
        for i in range(0, len(others), _CALL):
            both.append(_lists(self._ids([x.decode() for x in others.slice(i, _CALL).to_pylist()])))
        both = pa.concat_arrays(both)
        return both.take(pa.array(np.argsort(np.argsort(~plain, kind="stable"), kind="stable")))

    def _looked_up(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of some distinct chunks, as remembered or else encoded."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(at.is_null())
        ids = pa.concat_arrays([self.known_ids, self._encoded(new)])
        at = at.to_numpy(zero_copy_only=False)
        missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        place = np.where(missing, len(self.known) + np.cumsum(missing) - 1, np.where(missing, 0, at)).astype(np.int64)
        out = ids.take(pa.array(place))
        # what this portion used is kept first
        used = np.zeros(len(ids), bool)
        used[place] = True
        every = pa.concat_arrays([self.known, new])
        keep = np.concatenate([place, np.flatnonzero(~used)])
        keep = pa.array(keep[(pc.binary_length(every).to_numpy() <= REMEMBERED_SIZE)[keep]][:REMEMBERED])
        self.known, self.known_ids = every.take(keep), ids.take(keep)
        return out

    def _portion(self, b: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        chunks, first = self._chunks(b, bounds)
        numbered = chunks.dictionary_encode()
        odd = np.unique(np.searchsorted(bounds, _odd(b), "right") - 1)
        known = [self._looked_up(numbered.dictionary), _lists(self._ids([b[bounds[i] : bounds[i + 1]].tobytes().decode() for i in odd])), _lists([[end_id]])]
        which = numbered.indices.to_numpy().astype(np.int64)
        if len(odd):  # one number for the whole of such a text, instead of its chunks
            n = len(numbered.dictionary)
            drop = np.zeros(len(bounds) - 1, bool)
            drop[odd] = True
            which = which[~np.repeat(drop, np.diff(first))]
            size = np.where(drop, 0, np.diff(first))
            which = np.insert(which, np.concatenate([[0], np.cumsum(size)])[odd], n + np.arange(len(odd)))
            first = np.concatenate([[0], np.cumsum(np.where(drop, 1, size))])
        known = pa.concat_arrays(known)
        which = np.insert(which, first[1:], len(known) - 1)
        sizes = np.diff(known.offsets.to_numpy())[which]
        ids = known.take(pa.array(which)).flatten().to_numpy()
        return ids, np.cumsum(sizes)[first[1:] + np.arange(len(first) - 1)]

    def _chunks(self, b: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The texts' chunks, and each text's first among them, with the number of all at the end."""
        kind = _KIND[b]
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = (_CUT_WITHOUT_SPACE if self.drops_space else _CUT)[pair]
        if self.drops_space:
            cut[bounds] = True
            keep = ~_WHITE[b]
            cut[:-1] &= keep
            start = np.flatnonzero(cut[:-1])
            place = np.cumsum(keep, dtype=np.int64 if len(b) >> 31 else np.int32)
            data, offsets = _LOWER[b[keep]], np.concatenate([place[start] - 1, place[-1:]])
        else:
            line = np.flatnonzero(pair == 8 * _LINE + _LETTER)
            before = np.where(np.isin(line, bounds), _OTHER, kind[line - 1])
            cut[line[(before != _SPACE) & (before != _LINE)] + 1] = True
            cut[bounds] = True
            start = np.flatnonzero(cut[:-1])
            data, offsets = b, np.concatenate([start, [len(b)]])
        if not len(start):
            return pa.array([], pa.large_binary()), np.zeros(len(bounds), np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return chunks, np.searchsorted(start, bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
