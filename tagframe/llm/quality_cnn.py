"""Operator 8: quality classifier, a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap and cover it wholly.
Every byte has a learned vector; learned filters run over the windows of ``WIDTH``
bytes that begin at every byte; a filter's largest response in a chunk is the chunk's feature. A text's
features are the largest and the mean over its chunks, and a logistic layer
makes one probability of them.

Training: at most about ``SAMPLE_ROWS`` labelled rows of at most
``SAMPLE_BYTES`` bytes, drawn by a hash of the key, whatever the input; Adam on
the driver with a fixed seed. Scoring reads every whole text, in the executors.

Defined results: a null or empty text is one chunk of zero bytes; without
labelled training rows every score is 0; with one class only, that class; ties
and repeated rows score the same; extra columns are kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents, held_out, labelled_sample, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK, HOP = 512, 448
WIDTH = 8
DIM, FILTERS = 6, 24
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64_000
EPOCHS, BATCH, RATE, DECAY = 10, 32, 4e-3, 1e-4
KEPT_FROM = 0.3


def chunks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of bytes, zero after a text's end; index of each chunk's text)."""
    size = np.diff(offs)
    count = np.maximum(1, -(-(size - (CHUNK - HOP)) // HOP))
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[owner] + HOP * nth
    at = start[:, None] + np.arange(CHUNK)[None, :]
    inside = at < offs[owner + 1][:, None]
    if not len(buf):
        return np.zeros((len(owner), CHUNK), np.uint8), owner
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8), owner


def windows(block: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """All windows of all chunks, one at every byte, as rows: (chunks, places, WIDTH * DIM)."""
    x = np.ascontiguousarray(vector[block])
    places = CHUNK - WIDTH + 1
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), places, WIDTH * DIM), (s[0], s[1], s[2]), writeable=False)


def respond(block: np.ndarray, net: dict, places: bool = False):
    """Largest response of each filter in each chunk (and where)."""
    w = windows(block, net["vector"])
    z = (w.reshape(-1, WIDTH * DIM) @ net["filter"]).reshape(len(block), -1, FILTERS)
    top = z.max(axis=1)
    return (top, z.argmax(axis=1), w) if places else top


def pool(feature: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and mean over the chunks of each text; chunks come in the order of their texts."""
    first = np.searchsorted(owner, np.arange(n))
    count = np.diff(np.append(first, len(owner)))[:, None]
    return np.maximum.reduceat(feature, first, axis=0), np.add.reduceat(feature, first, axis=0) / count


def probability(buf: np.ndarray, offs: np.ndarray, net: dict, part: int = 48) -> np.ndarray:
    block, owner = chunks(buf, offs)
    act = np.concatenate([np.maximum(respond(block[i:i + part], net) + net["bias"], 0) for i in range(0, len(block), part)])
    most, mean = pool(act, owner, len(offs) - 1)
    z = np.hstack([most, mean]) @ net["out"] + net["last"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_network(texts: list[bytes], label: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> dict:
    """Adam on the cross-entropy; the gradient of a maximum goes to its window alone."""
    rng = np.random.default_rng(seed)
    net = {"vector": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
           "filter": rng.normal(0, 0.3, (WIDTH * DIM, FILTERS)).astype(np.float32),
           "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
           "last": np.zeros(1, np.float32)}
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(x) for k, x in net.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rows = order[lo:lo + BATCH]
            size = np.array([len(texts[r]) for r in rows])
            block, owner = chunks(np.frombuffer(b"".join(texts[r] for r in rows), np.uint8),
                                  np.concatenate([[0], np.cumsum(size)]))
            n, y = len(rows), label[rows]
            top, where, win = [], [], []
            for i in range(0, len(block), 64):
                t, p, w = respond(block[i:i + 64], net, places=True)
                top.append(t)
                where.append(p)
                win.append(w[np.arange(len(t))[:, None], p])  # the windows of the maxima: (chunks, FILTERS, WIDTH * DIM)
            raw, where, win = np.concatenate(top) + net["bias"], np.concatenate(where), np.concatenate(win)
            act = np.maximum(raw, 0)
            most, mean = pool(act, owner, n)
            h = np.hstack([most, mean])
            p = 1 / (1 + np.exp(-np.clip(h @ net["out"] + net["last"], -30, 30)))
            dz = ((p - y) / n).astype(np.float32)
            dh = dz[:, None] * net["out"][None, :]
            count = np.bincount(owner, minlength=n)
            is_top = act == most[owner]
            share = np.maximum(np.add.reduceat(is_top, np.searchsorted(owner, np.arange(n)), axis=0, dtype=np.float32), 1)
            da = dh[owner, :FILTERS] * is_top / share[owner] + dh[owner, FILTERS:] / count[owner][:, None]
            da = (da * (raw > 0)).astype(np.float32)
            grad = {"out": h.T @ dz, "last": np.array([dz.sum()]), "bias": da.sum(axis=0),
                    "filter": np.einsum("cf,cfw->wf", da, win)}
            dwin = da[:, :, None] * net["filter"].T[None, :, :]  # to the bytes of the windows
            at = where[:, :, None] + np.arange(WIDTH)[None, None, :]
            bytes_ = block[np.arange(len(block))[:, None, None], at].ravel()
            flat = dwin.reshape(-1, DIM)
            grad["vector"] = np.column_stack([np.bincount(bytes_, weights=flat[:, d], minlength=256) for d in range(DIM)])
            step += 1
            for k in net:
                g = grad[k].astype(np.float32) + (DECAY * net[k] if k in ("filter", "out") else 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-7)
    return net


def fit(train: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Network from the bounded sample ``train(doc_id, text, label)``; without both classes a constant."""
    rows = train.where(F.col("label").isin(0, 1) & F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "text", "doc_id"), F.lit(1 << 20))
    got = rows.select(draw.alias("draw"), "text", F.col("label").cast("int").alias("label")).toPandas()
    got = got.sort_values(["draw", "text"])
    label = got["label"].to_numpy()
    if not len(got) or label.min() == label.max():
        return {"base": float(label[0]) if len(got) else 0.0}
    return train_network([t.encode() for t in got["text"]], label)


def _score(net: dict):
    def run(texts: pa.Array) -> pa.Array:
        if "base" in net:
            return pa.array(np.full(len(texts), net["base"]))
        return pa.array(np.concatenate([np.zeros(0)] + [probability(buf, offs, net).astype(np.float64)
                                                        for _, _, buf, offs in text_slices(texts, 1 << 20)]))
    return run


def quality(text: Column, net: dict) -> Column:
    """Probability of label 1."""
    return F.arrow_udf(_score(net), "double", F.ArrowUDFType.SCALAR)(F.coalesce(text.cast("string"), F.lit("")))


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = (documents(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
             .where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("quality").alias("label")))
    net = fit(labelled_sample(docs, known, SAMPLE_ROWS, "quality_sample"))
    return (docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), quality(F.col("text"), net).alias("score"))
            .withColumn("predicted", (F.col("score") >= KEPT_FROM).cast("int")))
