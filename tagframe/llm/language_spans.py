"""Operator 6: language identification of mixed-language text.

A word is a run of ASCII letters and non-ASCII characters. Script ranges narrow
its candidate languages to those that use its script; hashed byte n-grams and
the whole word give it a log-likelihood per candidate; Viterbi with a penalty
per switch then labels the words of a text with spans of one language each. The
prediction is the language with most bytes, its score their share.

Counts come from every training row: a table of ``BUCKETS`` rows per feature
kind and language, summed over the cluster, whatever the input. All texts of a
run advance through Viterbi together, one word a step.

Defined results: ``und`` with score 0 and no span for a null or empty text and a
text without a letter; without any training row every text is ``und``; ties go
to the language that sorts first; repeated rows are predicted each; extra
columns are kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents, held_out, ragged, text_slices
from tagframe.llm.kernels import hash_spans, lower_table, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTH = 0.5
SCRIPT_SHARE = 0.001
# First code points of script ranges and the script that begins there ("" = no script of its own).
SCRIPTS = (
    (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0xAB, ""), (0xB5, "latin"),
    (0xB6, ""), (0xBA, "latin"), (0xBB, ""), (0xC0, "latin"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x900, "devanagari"), (0x980, "bengali"),
    (0xA00, ""), (0xB80, "tamil"), (0xC00, ""), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"),
    (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, ""),
)
NAMES = sorted({s for _, s in SCRIPTS if s})
SPANS = "array<struct<start:int,end:int,lang:string>>"
RESULT = f"struct<lang:string,score:double,spans:{SPANS}>"


def word_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = t[128:] = True
    return t


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word of every n-gram, its bucket, bucket of every whole word); n-grams of 3 and 4 bytes, edges marked."""
    n = ends - starts
    size = n + 2
    low = lower_table()[buf]
    at = np.clip(ragged(starts - 1, size), 0, max(0, len(buf) - 1))
    marked = low[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    first = np.cumsum(size) - size
    marked[first] = 32
    marked[first + size - 1] = 32
    inner = np.arange(len(marked)) - np.repeat(first, size)
    left = np.repeat(size, size) - inner
    word = np.repeat(np.arange(len(starts)), size)
    pad = np.concatenate([marked, np.zeros(4, np.uint32)])
    three = pad[:-4] | (pad[1:-3] << 8) | (pad[2:-2] << 16)
    four = three | (pad[3:-1] << 24)
    m3, m4 = left >= 3, left >= 4
    h3 = (three[m3] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    h4 = ((four[m4] ^ (four[m4] >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    owner = np.concatenate([word[m3], word[m4]])
    bucket = np.concatenate([h3.astype(np.int64), h4.astype(np.int64) + BUCKETS])
    whole = (hash_spans(low, starts, ends) >> np.uint64(48)).astype(np.int64) + 2 * BUCKETS
    return owner, bucket, whole


def word_script(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index into NAMES of the script of each word's first character, -1 for none."""
    if not len(starts):
        return np.zeros(0, np.int64)
    last = len(buf) - 1
    b = [buf[np.minimum(starts + k, last)].astype(np.int64) for k in range(4)]
    point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(
        b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63,
        (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)))
    edge = np.array([p for p, _ in SCRIPTS])
    index = np.array([-1] + [NAMES.index(s) if s else -1 for _, s in SCRIPTS])
    return index[np.searchsorted(edge, point, "right")]


def _count(langs: list[str]):
    def run(batches):
        k, size = len(langs), 3 * BUCKETS + len(NAMES)
        total = np.zeros(size * k, np.int64)
        number = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            lang = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
            for a, _, buf, offs in text_slices(batch["text"], 1 << 20):
                starts, ends, doc = spans(word_table()[buf], offs)
                if not len(starts):
                    continue
                owner, bucket, whole = word_features(buf, starts, ends)
                mine = lang[a + doc]
                script = word_script(buf, starts, ends)
                known = script >= 0
                keys = np.concatenate([bucket * k + mine[owner], whole * k + mine,
                                       (3 * BUCKETS + script[known]) * k + mine[known]])
                total += np.bincount(keys, minlength=size * k)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["key", "n"])
    return run


def fit(train: DataFrame, smooth: float = SMOOTH, share: float = SCRIPT_SHARE) -> dict:
    """Log-likelihood tables and script masks from all rows of ``train(text, lang)``.

    At most ``(3 * BUCKETS + scripts) * languages`` counts reach the driver.
    """
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    k = len(langs)
    if not k:
        return {"langs": [], "logp": np.zeros((3 * BUCKETS, 0), np.float32), "uses": np.zeros((len(NAMES), 0), bool)}
    got = rows.mapInArrow(_count(langs), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((3 * BUCKETS + len(NAMES)) * k)
    counts[got["key"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(-1, k)
    logp = np.empty((3 * BUCKETS, k), np.float32)
    for kind in range(3):
        c = counts[kind * BUCKETS:(kind + 1) * BUCKETS] + smooth
        logp[kind * BUCKETS:(kind + 1) * BUCKETS] = np.log(c / c.sum(axis=0))
    by_script = counts[3 * BUCKETS:]
    return {"langs": langs, "logp": logp, "uses": by_script > share * np.maximum(by_script.sum(axis=0), 1)}


def word_scores(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict, part: int = 1 << 16) -> np.ndarray:
    """Log-likelihood of each word by language, best candidate at 0, excluded languages far below."""
    k = len(model["langs"])
    out = np.zeros((len(starts), k))
    for i in range(0, len(starts), part):  # bounds the n-gram arrays of a long text
        s, e = starts[i:i + part], ends[i:i + part]
        owner, bucket, whole = word_features(buf[s[0]:e[-1]], s - s[0], e - s[0])
        n = np.maximum(np.bincount(owner, minlength=len(s)), 1)
        for j in range(k):
            column = model["logp"][:, j]
            # n-grams overlap: each kind counts as the word's length in independent pieces of three bytes
            out[i:i + part, j] = np.bincount(owner, weights=column[bucket], minlength=len(s)) / n * np.maximum(1, n / 4) \
                + column[whole]
        script = word_script(buf, s, e)
        mask = np.where((script >= 0)[:, None], model["uses"][script], True)
        mask[~mask.any(axis=1)] = True  # a script that no language uses narrows nothing
        out[i:i + part][~mask] = -1e4
    return out - out.max(axis=1, keepdims=True) if k else out


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; ``counts`` words belong to each text, texts advance in step."""
    k = scores.shape[1]
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    n, at = counts[order], begin[order]
    value = np.zeros((len(order), k))
    stay = np.ones((len(scores), k), bool)
    came = np.zeros(len(scores), np.int16)
    steps = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(steps), "left")
    for t in range(steps):
        live = alive[t]
        row = at[:live] + t
        if t:
            v = value[:live]
            best = v.argmax(axis=1)
            top = v[np.arange(live), best][:, None] - switch
            keep = v >= top
            stay[row], came[row] = keep, best
            value[:live] = np.where(keep, v, top) + scores[row]
        else:
            value[:live] = scores[row]
    label = np.zeros(len(scores), np.int16)
    if not steps:
        return label
    state = np.zeros(len(order), np.int64)
    for t in range(steps - 1, -1, -1):
        live = alive[t]
        row = at[:live] + t
        ending = n[:live] == t + 1
        if ending.any():
            state[:live][ending] = value[:live][ending].argmax(axis=1)
        label[row] = state[:live]
        if t:
            s = state[:live]
            state[:live] = np.where(stay[row, s], s, came[row])
    return label


def _label(model: dict, switch: float):
    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        langs, out = model["langs"], []
        has_letter = letters.to_pylist()
        for a, b, buf, offs in text_slices(texts, 2 << 20):
            if not langs:
                out += [{"lang": "und", "score": 0.0, "spans": []}] * (b - a)
                continue
            starts, ends, doc = spans(word_table()[buf], offs)
            counts = np.bincount(doc, minlength=b - a)
            label = viterbi(word_scores(buf, starts, ends, model), counts, switch)
            size = np.zeros((b - a, len(langs)))
            np.add.at(size, (doc, label), ends - starts)
            best, total = size.argmax(axis=1), size.sum(axis=1)
            new = np.ones(len(starts), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            base = chars[offs[doc[head]]]
            span = list(zip((chars[starts[head]] - base).tolist(), (chars[ends[tail]] - base).tolist(), label[head].tolist()))
            edge = np.searchsorted(doc[head], np.arange(b - a + 1))
            for i in range(b - a):
                if not has_letter[a + i] or not total[i]:
                    out.append({"lang": "und", "score": 0.0, "spans": []})
                else:
                    out.append({"lang": langs[best[i]], "score": float(size[i, best[i]] / total[i]),
                                "spans": [{"start": s, "end": e, "lang": langs[k]} for s, e, k in span[edge[i]:edge[i + 1]]]})
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]))
    return run


def label(text: Column, model: dict, switch: float = SWITCH) -> Column:
    """Struct ``(lang, score, spans)`` of a text column; spans in characters."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    udf = F.arrow_udf(_label(model, switch), RESULT, F.ArrowUDFType.SCALAR)
    return udf(whole, whole.rlike(r"\p{L}"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), 3, 1)).select("text", "lang")


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(training_rows(docs))
    got = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), label(F.col("text"), model).alias("r"))
    return got.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"),
                      F.col("r.spans").alias("spans"))
