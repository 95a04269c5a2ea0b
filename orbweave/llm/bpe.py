"""BPE encoding and decoding with an index of pair occurrences.

The words of a slice of texts are reduced to the distinct ones that no earlier slice had. Their symbols
lie in one array, linked to both neighbours. An index maps the rank of each pair to all positions where the
pair stands; ranks are applied in ascending order (a heap holds the active ones), each at all its positions
at once, and only the pairs beside a merge are entered anew. A word's pairs are thus merged in the same
order as one by one. Overlapping pairs of equal symbols are merged from the left.

Texts follow the vocabulary's own rules: special tokens are cut out first; then NFC, lower case, words by the
pattern, bytes as characters, and an end-of-word mark. White space always parts words, so pieces between
spaces are looked up whole in a bounded cache. Decoding joins the tokens of the ids with spaces, as
the library does for a vocabulary without a decoder.

Defined results: null and empty texts have no ids and decode to the empty text; other columns pass through;
columns named ids or decoded, in any case, are replaced; null ids stay null; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orbweave.llm.common import col, fields_of, free_names, others, small_batches, trim
from orbweave.llm.encoder import gathered, sliced

CACHED_PIECES = 100_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class _Pieces(dict):
    """Codes of pieces; a piece without one gets the next and is listed as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.new.append(piece)
        return code


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_characters()
        self.inner = np.array([self.vocab[c] for c in chars], np.int32)
        self.final = np.array([self.vocab[c + suffix] for c in chars], np.int32)
        self.size = len(self.tokens)
        pairs = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]], np.int64)
        key = pairs[:, 0] * self.size + pairs[:, 1]
        self.left, self.right, self.made = (pairs[:, i].astype(np.int32) for i in range(3))
        self.rank = np.argsort(key, kind="stable")
        self.key = key[self.rank]
        self.clear()

    def clear(self) -> None:
        self.piece_code = _Pieces()
        self.flat, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        data = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        n = len(symbol)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends[:-1]] = -1
        alive = np.ones(n, bool)
        where: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def enter(at: np.ndarray) -> None:
            key = symbol[at].astype(np.int64) * self.size + symbol[after[at]]
            i = np.searchsorted(self.key, key)
            i[i == len(self.key)] = 0
            known = self.key[i] == key
            r, at = self.rank[i[known]], at[known]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            r, at = r[order], at[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            lows, highs = [0, *cuts.tolist()], [*cuts.tolist(), len(r)]
            for x, a, b in zip(r[lows].tolist(), lows, highs):
                if x not in where:
                    where[x] = []
                    heapq.heappush(ranks, x)
                where[x].append(at[a:b])

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        while ranks:
            r = heapq.heappop(ranks)
            lists = where.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            good = alive[at] & (symbol[at] == a) & (nxt >= 0)
            good &= symbol[nxt] == b
            at, nxt = at[good], nxt[good]
            if a == b and len(at) > 1:  # of overlapping pairs, the left one
                taken, keep = -1, np.ones(len(at), bool)
                for k, (p, q) in enumerate(zip(at.tolist(), nxt.tolist())):
                    if p == taken:
                        keep[k] = False
                    else:
                        taken = q
                at, nxt = at[keep], nxt[keep]
            if not len(at):
                continue
            symbol[at] = self.made[r]
            alive[nxt] = False
            far = after[nxt]
            after[at] = far
            more = far >= 0
            before[far[more]] = at[more]
            prev = before[at]
            beside = np.concatenate([prev[prev >= 0], at[more]])
            if len(beside):
                enter(beside)
        counts = np.add.reduceat(alive, np.concatenate([[0], ends[:-1]]), dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        return symbol[alive], counts

    def _learn(self, pieces: list[str]) -> None:
        """Gives ids to pieces between spaces."""
        split = [self.words(p) for p in pieces]
        distinct: dict[str, int] = {}
        codes = np.array([distinct.setdefault(w, len(distinct)) for ws in split for w in ws], np.int64)
        ids, lengths = self.encode_words(list(distinct))
        ids = gathered(ids, np.cumsum(lengths) - lengths, lengths, codes)
        upto = np.concatenate([[0], np.cumsum(lengths[codes])])[np.cumsum([0, *map(len, split)])]
        self.flat, self.length = np.concatenate([self.flat, ids]), np.concatenate([self.length, np.diff(upto)])

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma here: characters are lowered one by one
        return text.lower()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.piece_code) > CACHED_PIECES:
            self.clear()
        used, ends = [], []
        code = self.piece_code.__getitem__
        for t in texts:
            if t:
                parts = self.special_cut.split(t) if self.special_cut and "<" in t else [t]
                for k, part in enumerate(parts):
                    if k % 2:
                        used.append(-1 - self.special[part])
                    else:
                        used.extend(map(code, self.normal(part).split(" ")))
            ends.append(len(used))
        if self.piece_code.new:
            self._learn(self.piece_code.new)
            self.piece_code.new = []
        codes = np.array(used, np.int64)
        if (codes < 0).any():  # special tokens stand for themselves
            flat, length = np.concatenate([self.flat, np.arange(self.size, dtype=np.int32)]), np.concatenate([self.length, np.ones(self.size, np.int64)])
            codes = np.where(codes < 0, len(self.length) - 1 - codes, codes)
        else:
            flat, length = self.flat, self.length
        ids = gathered(flat, np.cumsum(length) - length, length, codes)
        upto = np.concatenate([[0], np.cumsum(length[codes])])[np.array(ends, np.int64)]
        return ids, np.diff(upto, prepend=0)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_MODELS: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    if path not in _MODELS:
        _MODELS[path] = PairIndexBpe(path)
        trim()  # of the parsed file
    return _MODELS[path]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep_text: bool = False, round_trip: bool = False) -> DataFrame:
    """docs with ids (array<int>) and, with round_trip, decoded; the text goes unless keep_text."""
    small_batches(docs.sparkSession)
    kept = [c for c in others(docs, "ids", "decoded") if keep_text or c != text_col]
    (t,) = free_names([*docs.columns, "ids", "decoded"], "t")
    rows = docs.select(*map(col, kept), col(text_col).alias(t))

    def run(batches):
        bpe = model(tokenizer)
        for whole in batches:
            for batch in sliced(whole, t, 1 << 20):
                ids, counts = bpe.encode(batch.column(t).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)])
                columns = [batch.column(c) for c in kept] + [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                if round_trip:
                    columns.append(pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", *["decoded"] * round_trip])
        bpe.clear()  # workers go on to tasks of other stages
        trim()

    return rows.mapInArrow(run, f"{fields_of(docs, kept)}ids array<int>" + ", decoded string" * round_trip)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the text of its ids."""
    kept = others(encoded, "decoded")

    def run(batches):
        bpe = model(tokenizer)
        for b in batches:
            text = pa.array([bpe.decode(x) if x else "" for x in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], text], names=[*kept, "decoded"])

    return encoded.select(*map(col, kept)).mapInArrow(run, f"{fields_of(encoded, kept)}decoded string")
