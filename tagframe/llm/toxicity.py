"""Operator 2: toxicity of deobfuscated text.

Noisy channel: a word with look-alike symbols between letters, a run of three or
more equal letters, or a sequence of three or more single letters, some of which may
be look-alikes, is a lattice of
what its characters may stand for. Viterbi under a character language model
(counts of all documents) picks the restored text. Every other word has one path
through its lattice and stays as it is.

The restored text is scored by hashed word and word-prefix features: their
log-odds by label come from one part of the training rows, and a logistic
regression over a text's strongest evidence from another part.

Parameters with bounds: the classifier is fitted on at most about
``SAMPLE_ROWS`` labelled rows, drawn by a hash of the key; the language model
has ``2 ** QUAD_BITS`` counts whatever the input. Words over ``PIECE`` characters
are decoded in pieces of that length.

Defined results: a null or empty text scores like a text without evidence;
without labelled training rows every score is 0; repeated rows score the same;
extra columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents, held_out, labelled_sample, ragged, text_slices, worker_cache
from tagframe.llm.kernels import distinct, hash_spans, lower_table, space_table, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUAD_BITS = 20
TRI_BITS = 18
FEATURE_BITS = 20
PREFIXES = (4, 5, 6, 7)
SAMPLE_ROWS = 24_000
MIN_TEXTS = 3
PRIOR = 2.0
PIECE = 128
BEAM = 10
#: What look-alike symbols may stand for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SWAP, LITERAL, DROP, JOIN, SHORTEN = -1.0, -6.0, -8.0, -0.5, -0.5
EVIDENCE = ("top1", "top2", "top3", "sum_positive", "density")


def letter_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = t[128:] = True
    return t


# ---------------------------------------------------------------- character language model

def _grams(buf: np.ndarray, offs: np.ndarray):
    """(4-gram buckets, 3-gram context buckets) of lower-cased words with three marks before and one after."""
    low = lower_table()[buf]
    starts, ends, _ = spans(letter_table()[buf], offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts + 4
    first = np.cumsum(size) - size
    marked = np.full(int(size.sum()) + 4, 32, np.uint32)
    marked[ragged(first + 3, ends - starts)] = low[ragged(starts, ends - starts)]
    at = ragged(first, size - 3)
    context = marked[at] << 16 | marked[at + 1] << 8 | marked[at + 2]
    return _quad(context, marked[at + 3]), _tri(context)


def _quad(context, nxt):
    return (((context << np.uint32(8) | nxt) * np.uint32(0x9E3779B1)) >> np.uint32(32 - QUAD_BITS)).astype(np.int64)


def _tri(context):
    return ((context * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TRI_BITS)).astype(np.int64)


def _count_grams(batches):
    quad, tri = np.zeros(1 << QUAD_BITS, np.int64), np.zeros(1 << TRI_BITS, np.int64)
    for batch in batches:
        for _, _, buf, offs in text_slices(batch["text"], 2 << 20):
            q, t = _grams(buf, offs)
            quad += np.bincount(q, minlength=len(quad))
            tri += np.bincount(t, minlength=len(tri))
    for kind, table in ((0, quad), (1, tri)):
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind), pa.int32()), pa.array(used, pa.int64()),
                                          pa.array(table[used], pa.int64())], names=["kind", "bucket", "n"])


def language_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """4-gram and context counts of all rows of ``docs(text)``; the hashed tables bound what the driver gets."""
    got = (docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
           .mapInArrow(_count_grams, "kind int, bucket long, n long")
           .groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas())
    quad, tri = np.zeros(1 << QUAD_BITS, np.float32), np.zeros(1 << TRI_BITS, np.float32)
    for kind, table in ((0, quad), (1, tri)):
        mine = got[got["kind"] == kind]
        table[mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    return quad, tri


class Decoder:
    """Viterbi over character lattices with a beam of contexts; results of repeated words are kept, up to a bound."""

    def __init__(self, quad: np.ndarray, tri: np.ndarray, keep: int = 100_000):
        self.quad, self.tri, self.keep = quad, tri, keep
        self.known: dict[str, str] = {}
        self.cost: dict[tuple[int, int], float] = {}

    def _logp(self, context: int, byte: int) -> float:
        got = self.cost.get((context, byte))
        if got is None:
            quad = ((context << 8 | byte) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - QUAD_BITS
            tri = (context * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - TRI_BITS
            got = math.log((float(self.quad[quad]) + 0.02) / (float(self.tri[tri]) + 2.0))
            if len(self.cost) > 500_000:
                self.cost.clear()
            self.cost[context, byte] = got
        return got

    def _emit(self, context: int, text: bytes) -> tuple[int, float]:
        cost = 0.0
        for byte in text:
            cost += self._logp(context, byte)
            context = (context << 8 | byte) & 0xFFFFFF
        return context, cost

    def __call__(self, word: str) -> str:
        got = self.known.get(word)
        if got is None:
            got = "".join(self._decode(word[i:i + PIECE]) for i in range(0, len(word), PIECE))
            if len(self.known) > self.keep:
                self.known.clear()
            self.known[word] = got
        return got

    def _decode(self, word: str) -> str:
        spaced = SPACED.fullmatch(word) is not None and plausible(word)
        states = {0x202020: (0.0, "")}
        i = 0
        while i < len(word):
            c = word[i]
            j = i + 1
            while j < len(word) and word[j] == c:
                j += 1
            if c.isalpha():
                options = [(c * (j - i), 0.0 if j - i < 3 else LITERAL)]
                if j - i >= 3:
                    options += [(c, SHORTEN), (c * 2, SHORTEN)]
            else:
                j = i + 1
                options = [(x, SWAP) for x in LOOKALIKE.get(c, "")]
                if spaced and c in " .-_*":
                    options += [("", JOIN), (c, 0.0)]
                else:
                    options += [(c, LITERAL), ("", DROP)]
            nxt: dict[int, tuple[float, str]] = {}
            for context, (score, text) in states.items():
                for out, cost in options:
                    if out and not out[0].isalpha():  # the word ends, a symbol stands for itself
                        at, more = 0x202020, self._logp(context, 32) if context != 0x202020 else 0.0
                    else:
                        at, more = self._emit(context, out.encode())
                    total = score + cost + more
                    if at not in nxt or total > nxt[at][0]:
                        nxt[at] = (total, text + out)
            states = dict(sorted(nxt.items(), key=lambda s: -s[1][0])[:BEAM])
            i = j
        return max((score + self._logp(context, 32), text) for context, (score, text) in states.items())[1]


_PLACE = rf"(?:[^\W\d_]|[{re.escape(''.join(LOOKALIKE))}])"
SPACED = re.compile(rf"{_PLACE}(?:[ .\-_*]{_PLACE}){{2,}}")
_SINGLES = re.compile(rf"(?<![^\s]){_PLACE}(?:([ .\-_*]){_PLACE}(?:\1{_PLACE})+)(?![^\s.,;:!?])")
_LETTERS = re.compile(r"(?<![^\s])[^\W\d_](?:([ .\-_*])[^\W\d_](?:\1[^\W\d_])+)(?![^\s.,;:!?])")
#: Look-alikes that also are plain marks.
MARKS = "!|+("


def plausible(spaced: str) -> bool:
    """Whether single characters set apart can be a word: not numbers in a row, an outline number or a sum."""
    places = spaced[::2]
    letters, marks = sum(map(str.isalpha, places)), sum(c in MARKS for c in places)
    return (letters >= 2 or letters == 1 and len(places) >= 4) and 3 * letters >= len(places) - letters and len(places) > 3 * marks


def restore_singles(text: str, decode) -> str:
    """The text with its sequences of single characters decoded; an implausible one keeps all but its sequences of letters."""
    def whole(m):
        return decode(m[0].lower()) if plausible(m[0]) else _LETTERS.sub(lambda x: decode(x[0].lower()), m[0])
    return _SINGLES.sub(whole, text)


def _folds() -> np.ndarray:
    """Lower case of every letter's code point, 0 for all others."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x80, 0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def wide_runs(buf: np.ndarray) -> np.ndarray:
    """Where a letter over code 127 is the third of a run, whatever its case."""
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead) < 3:
        return lead[:0]
    size = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0).astype(np.int64)
    near = lead[1:] - lead[:-1] == size[:-1]
    third = np.flatnonzero(near[1:] & near[:-1] & (size[2:] == size[1:-1]) & (size[1:-1] == size[:-2])) + 2
    if not len(third):
        return third
    fold = worker_cache("toxic:folds", _folds)

    def letter(k):
        at, wide = lead[k], size[k]
        code = (buf[at] & (0x7F >> wide).astype(np.uint8)).astype(np.int64)
        for i in (1, 2, 3):
            more = wide > i
            code[more] = code[more] << 6 | (buf[at[more] + i] & 0x3F)
        return fold[code]

    a, b, c = letter(third), letter(third - 1), letter(third - 2)
    return lead[third[(a > 0) & (a == b) & (b == c)]]


def wide_alike(buf: np.ndarray) -> np.ndarray:
    """The bytes of look-alikes over code 127."""
    out = [np.zeros(0, np.int64)]
    for c in LOOKALIKE:
        raw = c.encode()
        if len(raw) > 1:
            at = np.flatnonzero(buf[:max(len(buf) - len(raw) + 1, 0)] == raw[0])
            for i in range(1, len(raw)):
                at = at[buf[at + i] == raw[i]]
            out += [at + i for i in range(len(raw))]
    return np.concatenate(out)


def single_places(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of one character that is a letter or look-alike, with at most one mark after it."""
    first = buf[starts]
    wide = 1 + (first >= 0xC2).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    place = letter_table()
    place[[ord(x) for x in LOOKALIKE if ord(x) < 128]] = True
    mark = np.zeros(256, bool)
    mark[[ord(x) for x in ".,;:!?"]] = True
    size = ends - starts
    return place[first] & ((size == wide) | (size == wide + 1) & mark[buf[ends - 1]])


def suspicious(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words (runs without white space) with a look-alike beside letters, a letter run of three or letters set apart."""
    if not len(starts):
        return np.zeros(0, bool)
    n = len(buf)
    letter = letter_table()[buf]
    table = np.zeros((2, 256), bool)
    table[0, [ord(x) for x in LOOKALIKE if ord(x) < 128]] = True
    table[1, [ord(x) for x in ".-_*"]] = True
    alike, apart = table[0][buf], table[1][buf]
    low = lower_table()[buf]
    run = np.zeros(n, bool)
    run[2:] = letter[2:] & (low[2:] < 128) & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    run[wide_runs(buf)] = True
    wide = wide_alike(buf)
    letter[wide], alike[wide] = False, True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    strong = alike & ~np.isin(buf, [ord(x) for x in MARKS])  # digits and currency signs; the others also are plain marks
    before[1:] = letter[:-1] | strong[:-1]
    after[:-1] = letter[1:] | strong[1:]
    ending = np.zeros(n, bool)  # digits and currency signs may also end a word, any look-alike may begin one
    ending[ends - 1] = (low[ends - 1] >= 48) & (low[ends - 1] < 58) | (low[ends - 1] == 36)
    beginning = np.zeros(n, bool)
    beginning[starts] = True
    inner = alike & (before | beginning) & (after | ending)
    spaced = apart & before & after
    at = np.flatnonzero(inner | run | spaced)  # few: the sums below touch only these places
    word = np.searchsorted(starts, at, "right") - 1
    size = len(starts)
    letters = lambda w: np.array([letter[starts[x]:ends[x]].sum() for x in w.tolist()], np.int64)
    out = np.bincount(word[run[at]], minlength=size) > 0
    has = np.unique(word[inner[at]])
    out[has[letters(has) > 0]] = True
    gaps = np.bincount(word[spaced[at]], minlength=size)
    has = np.flatnonzero(gaps >= 2)
    out[has[letters(has) <= 2 * (gaps[has] + 1)]] = True  # two bytes a letter at most
    return out


_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_EDGE = re.compile(r"(?:([^\w\s])\1{2,}|[.,;:!?\"')\]]+)+$")


def restore_word(word: str, decode: Decoder) -> str:
    """Restored core of a word; marks that end it and decorations of three or more equal symbols stay outside."""
    edge = _EDGE.search(word)
    core, tail = (word[:edge.start()], word[edge.start():]) if edge else (word, "")
    if not any(map(str.isalpha, core)):
        return word
    if SPACED.fullmatch(core) and plausible(core) or any(c in LOOKALIKE for c in core) or _TRIPLE.search(core):
        return decode(core) + tail
    return word


def restore_text(buf: np.ndarray, starts, ends, decode: Decoder) -> str:
    """The text with its suspicious words (byte spans) restored."""
    raw, out, at = buf.tobytes(), [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        out.append(raw[at:a].decode())
        out.append(restore_word(raw[a:b].decode().lower(), decode))
        at = b
    out.append(raw[at:].decode())
    return "".join(out)


def restored_slices(texts: pa.Array, decode: Decoder, limit: int = 2 << 20):
    """Runs of texts after restoration: (first row, last row, bytes, offsets, restored rows)."""
    for a, b, buf, offs in text_slices(texts, limit):
        starts, ends, doc = spans(~space_table()[buf], offs)
        odd = suspicious(buf, starts, ends)
        single = single_places(buf, starts, ends)
        three = np.zeros(len(starts), bool)
        if len(starts) > 2:
            three[2:] = single[2:] & single[1:-1] & single[:-2] & (doc[2:] == doc[:-2])
        rows = np.unique(np.concatenate([doc[odd], doc[three]])).tolist()
        if not rows:
            yield a, b, buf, offs, {}
            continue
        parts, changed = [], {}
        spaced = set(doc[three].tolist())
        edge = np.searchsorted(doc, np.arange(b - a + 1))
        last = 0
        for r in rows:
            lo, hi = offs[r], offs[r + 1]
            mine = slice(edge[r], edge[r + 1])
            hit = odd[mine]
            text = restore_text(buf[lo:hi], starts[mine][hit] - lo, ends[mine][hit] - lo, decode)
            if r in spaced:
                text = restore_singles(text, decode)
            if len(text.encode()) == hi - lo and text.encode() == buf[lo:hi].tobytes():
                continue
            parts += [buf[last:lo], np.frombuffer(text.encode(), np.uint8)]
            changed[r] = text
            last = hi
        parts.append(buf[last:])
        size = np.diff(offs)
        for r, text in changed.items():
            size[r] = len(text.encode())
        yield a, b, np.concatenate(parts), np.concatenate([[0], np.cumsum(size)]), changed


# ---------------------------------------------------------------- evidence and score

def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct words and word prefixes of every text; words by text."""
    low = lower_table()[buf]
    starts, ends, doc = spans(letter_table()[buf], offs)
    keys = [(doc << FEATURE_BITS) | (hash_spans(low, starts, ends) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]
    for k in PREFIXES:
        long = ends - starts > k
        s = starts[long]
        keys.append((doc[long] << FEATURE_BITS)
                    | ((hash_spans(low, s, s + k) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93)
                       >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    key = distinct(np.concatenate(keys))
    return key >> FEATURE_BITS, key & ((1 << FEATURE_BITS) - 1), np.bincount(doc, minlength=len(offs) - 1)


def _decoder(lm) -> Decoder:
    """One decoder a worker and character model, known by a digest of its tables."""
    digest = hashlib.sha256()
    for table in lm:
        digest.update(np.ascontiguousarray(table).tobytes())
    return worker_cache(f"toxic:{digest.hexdigest()}", lambda: Decoder(*lm))


def _presence(lm):
    def run(batches):
        decode, size = _decoder(lm), 1 << FEATURE_BITS
        total, texts = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = np.array(batch["label"].to_pylist(), np.int64)
            for a, b, buf, offs, _ in restored_slices(batch["text"], decode):
                doc, bucket, _ = features(buf, offs)
                y = label[a + doc]
                texts += np.bincount(label[a:b], minlength=2)
                for v in (0, 1):
                    total[v] += np.bincount(bucket[y == v], minlength=size)
        used = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(total[0, used], texts[0]), pa.int64()),
             pa.array(np.append(total[1, used], texts[1]), pa.int64())], names=["bucket", "n0", "n1"])
    return run


def evidence(buf: np.ndarray, offs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The strongest log-odds of every text, their positive sum and its density."""
    doc, bucket, words = features(buf, offs)
    n = len(offs) - 1
    w = weight[bucket]
    out = np.zeros((n, len(EVIDENCE)))
    some = w > 0.5
    doc, w = doc[some], w[some].astype(np.float64)
    out[:, 3] = np.bincount(doc, weights=np.maximum(w - 1.5, 0), minlength=n)[:n]
    out[:, 4] = out[:, 3] / np.sqrt(np.maximum(words, 1))
    order = np.lexsort((-w, doc))
    doc, w = doc[order], w[order]
    edge = np.searchsorted(doc, np.arange(n + 1))
    for k in range(3):
        has = edge[:-1] + k < edge[1:]
        out[has, k] = w[edge[:-1][has] + k]
    return out


def _evidence_rows(lm, weight):
    def run(batches):
        decode = _decoder(lm)
        for batch in batches:
            for a, b, buf, offs, _ in restored_slices(batch["text"], decode):
                got = evidence(buf, offs, weight)
                yield pa.RecordBatch.from_arrays([batch["label"].slice(a, b - a)] + [pa.array(x) for x in got.T],
                                                 names=["label", *EVIDENCE])
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = ridge * np.eye(x.shape[1])
    pull[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(train: DataFrame, lm) -> dict:
    """Classifier from the bounded sample ``train(doc_id, text, label)``: four fifths give log-odds, one fifth the regression."""
    train = train.where(F.col("label").isin(0, 1)).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    part = F.pmod(F.xxhash64(F.lit("part"), "text", "doc_id"), F.lit(5))
    cols = train.select("text", F.col("label").cast("int").alias("label"), part.alias("part"))
    got = (cols.where("part <> 0").drop("part").mapInArrow(_presence(lm), "bucket long, n0 long, n1 long")
           .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
           .where(f"bucket < 0 or n0 + n1 >= {MIN_TEXTS}").toPandas())
    weight, texts = np.zeros(1 << FEATURE_BITS, np.float32), got[got["bucket"] < 0]
    total = np.array([texts["n0"].sum(), texts["n1"].sum()], float)
    if total.min() > 0:
        seen = got[got["bucket"] >= 0]
        share = total / total.sum()
        rate = [(seen[c].to_numpy() + PRIOR * s) / t for c, s, t in zip(("n0", "n1"), share, total)]
        weight[seen["bucket"].to_numpy()] = np.log(rate[1] / rate[0])
    rows = (cols.where("part = 0").drop("part")
            .mapInArrow(_evidence_rows(lm, weight), "label int, " + ", ".join(f"{c} double" for c in EVIDENCE)).toPandas())
    if not len(rows) or rows["label"].nunique() < 2:
        base = total[1] / total.sum() if total.sum() else 0.0
        return {"weight": weight, "w": None, "base": float(base)}
    return {"weight": weight, "w": logistic(rows[list(EVIDENCE)].to_numpy(), rows["label"].to_numpy()), "base": 0.0}


def _score(lm, model):
    def run(texts: pa.Array) -> pa.Array:
        decode, score, restored = _decoder(lm), [np.zeros(0)], []
        for a, b, buf, offs, changed in restored_slices(texts, decode):
            if model["w"] is None:
                score.append(np.full(b - a, model["base"]))
            else:
                z = np.column_stack([evidence(buf, offs, model["weight"]), np.ones(b - a)]) @ model["w"]
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            restored += [changed.get(i) for i in range(b - a)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(score)), pa.array(restored, pa.string())],
                                          names=["score", "restored"])
    return run


def toxicity(text: Column, lm, model: dict) -> Column:
    """Struct ``(score, restored)``; ``restored`` is the deobfuscated text, null where nothing was decoded."""
    return F.arrow_udf(_score(lm, model), "struct<score:double,restored:string>", F.ArrowUDFType.SCALAR)(
        F.coalesce(text.cast("string"), F.lit("")))


def train(docs: DataFrame, labels: DataFrame) -> tuple:
    """(language model of all ``docs``, classifier of the labelled training rows)."""
    lm = language_model(docs)
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), 5, 0))
             .select("doc_id", F.col("toxic").alias("label")))
    return lm, fit(labelled_sample(docs, known, SAMPLE_ROWS, "toxic_sample"), lm)


def op2_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lm, model = train(docs, documents(spark, sf_dir, "labels"))
    got = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity(F.col("text"), lm, model).alias("r"))
    return got.select("doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= 0.5).cast("int").alias("predicted"))
