"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once.

The byte-level pre-tokenizer parts a text at places that the bytes around them prove. Texts are cut there, as
arrays of bytes, and encode piece by piece to the same ids:

* before a white space byte that a visible character follows (only the last of a run of white space goes with
  what follows, and then only a space);
* before a visible character after a white space byte other than a space;
* after an ASCII letter, before ASCII punctuation other than an apostrophe, or a line break.

Visible are ASCII characters from '!' to '~' and those whose first byte no white space character begins with;
other places are left uncut, which is always right. Pieces are known by 64-bit fingerprints together with their
length and repeat far more often than they differ; a bounded hash table holds their ids from one batch to the
next. Texts that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orbweave.llm.common import ODD, Prints, byte_view

SLOTS = 1 << 21  # of the table of pieces: 24 MB; at most half of them are used
CACHED_IDS = 4_000_000
_BYTES = np.arange(256)
BLANK = np.isin(_BYTES, [32, 9, 10, 13])
VISIBLE = ((_BYTES > 32) & (_BYTES < 127)) | ((_BYTES >= 0xC3) & ~np.isin(_BYTES, [0xE1, 0xE2, 0xE3]))
LETTER = np.isin(_BYTES | 32, np.arange(97, 123)) & (_BYTES < 128)
CLOSES = ((_BYTES > 32) & (_BYTES < 127) & ~LETTER & ~np.isin(_BYTES, [39, *range(48, 58)])) | (_BYTES == 10)


def piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of texts raw[off[i]:off[i+1]] begin."""
    new = np.zeros(len(raw) + 1, bool)
    if len(raw):
        shown, blank = VISIBLE[raw], BLANK[raw]
        new[:-2] = blank[:-1] & shown[1:]
        new[off[1:] - 1] = False  # what follows stands in another text (of an empty first text, this is the unused last place)
        new[1:-1] |= (blank & (raw != 32))[:-1] & shown[1:]
        new[1:-1] |= LETTER[raw][:-1] & CLOSES[raw][1:]
    new[off] = True
    new[len(raw)] = False
    return np.flatnonzero(new)


class Table:
    """Codes of 64-bit keys, by open addressing; all steps work on arrays."""

    def __init__(self, slots: int = SLOTS):
        self.keys, self.codes, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.uint64(slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        row, slot = np.arange(len(keys)), keys & self.mask
        while len(row):
            there = self.keys[slot]
            hit = there == keys
            out[row[hit]] = self.codes[slot[hit]]
            on = ~hit & (there != 0)
            row, keys, slot = row[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Adds distinct new keys."""
        slot = keys & self.mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys  # of several for one slot, one got it
            self.codes[slot[own]] = codes[own]
            keys, codes, slot = keys[~own], codes[~own], (slot[~own] + np.uint64(1)) & self.mask


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.n_bytes[i] = len(token)  # a character of a byte-level token stands for a byte
        self.clear()

    def clear(self) -> None:
        self.table = Table()
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        flats, lengths = [], []
        for k in range(0, len(texts), 2_000):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + 2_000], add_special_tokens=False):
                flats.append(np.array(e.ids, np.int32))
                lengths.append(len(flats[-1]))
        return flats, lengths

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        """Adds pieces. Those that begin with a space are encoded as one text, and its ids part where their bytes do; the others one by one."""
        spaced = (raw[start] == 32) & (end - start > 1)
        spaced[spaced] = VISIBLE[raw[start[spaced] + 1]]
        first, flats, lengths = len(self.length), [self.flat], []
        joined = np.flatnonzero(spaced)
        for k in range(0, len(joined), 20_000):
            own = joined[k : k + 20_000]
            size = end[own] - start[own]
            text = gathered(raw, start, end - start, own).tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            lengths.append(np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(size)) + 1, prepend=0))
            flats.append(ids)
        alone = np.flatnonzero(~spaced)
        data = raw.tobytes() if len(alone) else b""
        got, sizes = self._library([data[a:b].decode() for a, b in zip(start[alone].tolist(), end[alone].tolist())])
        n = np.concatenate([*lengths, np.array(sizes, np.int64)])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([*flats, *got])
        self.table.put(key[np.concatenate([joined, alone])], np.arange(first, len(self.length), dtype=np.int32))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= np.asarray(pc.fill_null(pc.match_substring(texts, s), False))
        if whole.any():  # in runs, each of one kind
            cuts = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(texts)]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                if whole[a]:
                    got, sizes = self._library(texts.slice(a, b - a).to_pylist())
                    parts.append((np.concatenate(got), np.array(sizes, np.int64)))
                else:
                    parts.append(self._pieces(texts.slice(a, b - a)))
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._pieces(texts)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = byte_view(texts)
        raw, off = raw[off[0] : off[-1]], off - off[0]
        start = piece_starts(raw, off)
        end = np.append(start[1:], len(raw))
        key = Prints(raw).of(start, end) ^ ((end - start).astype(np.uint64) * ODD[4])
        key[key == 0] = 1
        if len(self.length) > SLOTS // 2 - len(key) or len(self.flat) > CACHED_IDS:
            self.clear()
        if len(key) > SLOTS // 2:  # a text of many megabytes; its own pieces could overfill the table
            half = len(texts) // 2
            if half:
                one, two = self._pieces(texts.slice(0, half)), self._pieces(texts.slice(half))
                return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
            self.table = Table(1 << (2 * len(key)).bit_length())
            self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = self.table.find(key)
        new = np.flatnonzero(code < 0)
        if len(new):
            distinct, one = np.unique(key[new], return_index=True)
            self._learn(raw, start[new[one]], end[new[one]], distinct)
            code[new] = self.table.find(key[new])
        upto = np.concatenate([[0], np.cumsum(self.length[code])])[np.searchsorted(start, off)]
        ids = gathered(self.flat, self.start, self.length, code)
        if len(self.table.keys) > SLOTS:
            self.clear()
        return ids, np.diff(upto)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs flat[start:start+length] of the given codes, one after another."""
    n = length[code]
    at = np.repeat(start[code] - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return flat[at]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, which Spark uses for one task after another."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def sliced(batch, column: str, most: int = 1 << 18):
    """Runs of rows of an Arrow batch with about most bytes of text each, so that memory follows no batch size."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
