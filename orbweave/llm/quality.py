"""A byte-level convolutional network in numpy that scores the quality of whole texts.

A text is covered by overlapping chunks of CHUNK bytes. Learned filters slide over each chunk's byte
embeddings; each filter's largest response in a chunk is kept (max pooling), the mean over chunks
describes the text, and a logistic layer makes one probability of it.

Fitting uses labelled rows up to SAMPLE, and whole texts up to SAMPLE_BYTES together (the documented bounds), taken
in the order of a hash of their id, with all of their chunks; so what the driver holds is bounded. Filters are
evaluated at every byte. Scoring reads every byte of every text, in slices of bounded size, and needs no shuffle.

Defined results: null and empty texts are one chunk of padding and get its score; without labels of both
kinds, scores are the share of label 1 (0.5 without labels); a column named score, in any case, is replaced; rows
of one id train as one text and are scored each for itself; null ids never train; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import byte_view, col, fields_of, free_names, others, small_batches, trim
from orbweave.llm.encoder import sliced

CHUNK, OVERLAP, WIDTH, STRIDE = 256, 32, 6, 1
DIMENSION, FILTERS, PAD = 6, 16, 256
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, RATE = 4000, 32 << 20, 8, 50, 0.01


@dataclass
class Network:
    embedding: np.ndarray  # byte (and padding) x dimension
    filters: np.ndarray  # width x dimension x filters
    offset: np.ndarray
    weight: np.ndarray
    bias: float

    def tables(self) -> list[np.ndarray]:
        """The response of each filter to each byte at each place."""
        return [np.ascontiguousarray(self.embedding @ self.filters[j], dtype=np.float32) for j in range(WIDTH)]


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


def chunk_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks from start, as byte numbers; PAD from end on."""
    at = start[:, None] + np.arange(CHUNK)
    out = raw[np.minimum(at, max(len(raw) - 1, 0))].astype(np.int16) if len(raw) else np.zeros(at.shape, np.int16)
    out[at >= end[:, None]] = PAD
    return out


def pooled(net: Network, tables: list[np.ndarray], chunks: np.ndarray) -> np.ndarray:
    """chunks x filters: the largest response of each filter."""
    n = (CHUNK - WIDTH) // STRIDE + 1
    out = np.empty((len(chunks), FILTERS), np.float32)
    for a in range(0, len(chunks), 256):
        c = chunks[a : a + 256]
        total = tables[0].take(c[:, 0 : n * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            total += tables[j].take(c[:, j : j + n * STRIDE : STRIDE], axis=0)
        out[a : a + 256] = np.maximum(total.max(axis=1) + net.offset, 0)
    return out


def _strongest(tables: list[np.ndarray], chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter, the place of the largest response (without offset) and that response."""
    n = (CHUNK - WIDTH) // STRIDE + 1
    where, top = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS))
    for a in range(0, len(chunks), 64):
        c = chunks[a : a + 64]
        total = tables[0].take(c[:, 0 : n * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            total += tables[j].take(c[:, j : j + n * STRIDE : STRIDE], axis=0)
        where[a : a + 64] = total.argmax(axis=1)
        top[a : a + 64] = np.take_along_axis(total, where[a : a + 64, None, :], axis=1)[:, 0]
    return where, top


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, seed: int = 7) -> Network:
    """chunks: one row each; doc: the number of each chunk's document; label: 0 or 1 for each document."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (PAD + 1, DIMENSION)), rng.normal(0, 0.3, (WIDTH, DIMENSION, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), 0.0)
    share = label.mean() if len(label) else 0.5
    if not 0 < share < 1:
        net.weight[:] = 0
        net.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return net
    n = (CHUNK - WIDTH) // STRIDE + 1
    params = [net.embedding, net.filters, net.offset, net.weight, np.array([float(np.log(share / (1 - share)))])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rows = [np.flatnonzero(doc == d) for d in range(len(label))] if len(label) < 50 else np.split(np.argsort(doc, kind="stable"), np.searchsorted(np.sort(doc), np.arange(1, len(label))))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            own = np.concatenate([rows[d] for d in docs])
            of = np.repeat(np.arange(len(docs)), [len(rows[d]) for d in docs])
            c = chunks[own]
            window = np.lib.stride_tricks.sliding_window_view(c, WIDTH, axis=1)[:, ::STRIDE][:, :n]
            kernel = params[1].reshape(WIDTH * DIMENSION, FILTERS)
            now = Network(params[0], params[1], params[2], params[3], 0.0)
            best, top = _strongest(now.tables(), c)  # chunks x filters: where, and the response there
            top = top + params[2]
            act = np.maximum(top, 0)
            count = np.bincount(of, minlength=len(docs))[:, None]
            mean = np.zeros((len(docs), FILTERS))
            np.add.at(mean, of, act)
            mean /= count
            error = (sigmoid(mean @ params[3] + params[4]) - label[docs]) / len(docs)
            d_act = (error[:, None] * params[3] / count)[of] * (top > 0)
            bytes_there = window[np.arange(len(own))[:, None], best]  # chunks x filters x width
            picked = params[0][bytes_there].reshape(len(own), FILTERS, WIDTH * DIMENSION)
            grads = [np.zeros_like(params[0]), np.einsum("cf,cfw->wf", d_act, picked).reshape(params[1].shape), d_act.sum(axis=0), mean.T @ error + 1e-4 * params[3], np.array([error.sum()])]
            d_emb = (d_act[:, :, None] * kernel.T).reshape(-1, DIMENSION)
            for k in range(DIMENSION):
                grads[0][:, k] = np.bincount(bytes_there.reshape(-1), weights=d_emb[:, k], minlength=PAD + 1)
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.bias = float(params[4][0])
    return net


def held_out(doc_id) -> F.Column:
    """Rows that never train: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", doc_id: str = "doc_id", text_col: str = "text") -> Network:
    small_batches(docs.sparkSession)
    known = labels.filter(col(label_col).isin(0, 1) & col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(col(doc_id).alias("id")).agg(F.max(col(label_col)).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64(F.lit(7), "id")).orderBy("h", "id").limit(SAMPLE)  # a top-k in each task, then one
    texts = docs.select(col(doc_id).alias("id"), col(text_col).alias("text"))
    sizes = texts.join(F.broadcast(known), "id").groupBy("id", "label", "h").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + CHUNK).alias("size")).orderBy("h", "id").collect()
    left, chosen = SAMPLE_BYTES, []
    for row in sizes:  # whole texts, as many as the bound holds
        if row["size"] <= left:
            left -= row["size"]
            chosen.append((row["id"], row["label"]))
    if not chosen:
        return fit(np.zeros((0, CHUNK), np.int16), np.zeros(0, int), np.zeros(0))
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches):
        for whole in batches:
            for b in sliced(whole, "text"):
                raw, off = byte_view(b.column("text"))
                starts = [chunk_starts(e - s) + s for s, e in zip(off, off[1:])]
                row = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
                c = chunk_bytes(raw, np.concatenate(starts), off[1:][row])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("label").take(pa.array(row)), pa.array([x.tobytes() for x in c], pa.binary())], names=["id", "label", "chunk"])

    sample = docs.sparkSession.createDataFrame(chosen, f"id {kind}, label int")
    got = texts.join(F.broadcast(sample), "id").mapInArrow(cut, f"id {kind}, label int, chunk binary").toPandas().sort_values(["id", "chunk"], kind="stable")
    ids, doc = np.unique(got["id"].to_numpy(), return_inverse=True)
    label = np.zeros(len(ids))
    label[doc] = got["label"].to_numpy()
    return fit(np.frombuffer(b"".join(got["chunk"]), np.int16).reshape(-1, CHUNK), doc, label)


def score(docs: DataFrame, net: Network, text_col: str = "text", keep_text: bool = False, out: str = "score") -> DataFrame:
    """docs with a score, in column out; every byte of every text counts."""
    small_batches(docs.sparkSession)
    kept = [c for c in others(docs, out) if keep_text or c != text_col]
    (text,) = free_names([*docs.columns, out], "text")
    rows = docs.select(*map(col, kept), col(text_col).alias(text))

    def run(batches):
        tables = net.tables()
        for whole in batches:
            for b in sliced(whole, text):
                raw, off = byte_view(b.column(text))
                size = np.diff(off)
                n = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
                row = np.repeat(np.arange(len(n)), n)
                start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * (CHUNK - OVERLAP)
                mean = np.empty((len(row), FILTERS), np.float32)
                for a in range(0, len(row), 4096):
                    mean[a : a + 4096] = pooled(net, tables, chunk_bytes(raw, start[a : a + 4096], off[1:][row[a : a + 4096]]))
                mean = np.add.reduceat(mean.astype(np.float64), np.cumsum(n) - n, axis=0) / n[:, None]
                p = sigmoid(mean @ net.weight + net.bias)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(p)], names=[*kept, out])
        trim()

    return rows.mapInArrow(run, f"{fields_of(docs, kept)}`{out}` double")


def keep_good(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score threshold or more, with their own columns."""
    (out,) = free_names(docs.columns, "score")
    return score(docs, net, text_col, keep_text=True, out=out).filter(F.col(out) >= threshold).drop(out)
