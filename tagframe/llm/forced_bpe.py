"""Operator 13: BPE encoding and decoding by forced-boundary splitting.

A symbol is a byte, or a byte that ends a word. If no token of the vocabulary has
symbol ``b`` directly after symbol ``a``, no merge can ever join the two, so the
place between them is a certain cut; a place after a word's end always is. The
symbols of a text are cut at all these places, each fragment is encoded on its
own by the BPE model (inner fragments by the same merges without the word-end
mark), and the ids are concatenated. Merges on either side of a cut never see
each other, so the result is that of the whole text (tests compare it with the
tokenizer on every kind of text).

Work is done by Arrow batch in the document's row, without an exchange. Words
(runs between white space) and fragments seen before are looked up in bounded
exact memos; words of ASCII and Latin letters are normalised and cut into the
vocabulary's words here, all others by the tokenizer's own normaliser and
pre-tokeniser. Texts with special-token strings are cut at those first.

Defined results: a null or empty text has no ids and decodes to the empty text;
white space is dropped; repeated rows and null keys are rows like any other; an
empty table gives no rows; extra columns are ignored. ``decode`` gives null for
null ids and raises on an id that the vocabulary lacks.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.bpe import byte_chars
from tagframe.llm.chunks import SpanMemo, wide_space
from tagframe.llm.common import documents, text_slices, worker_cache
from tagframe.llm.kernels import per_text, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
#: Words whose normal form is their lower case and whose cuts ``PIECE`` knows.
QUICK = re.compile(f"[!-~{_LETTER}]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ 0-9{_LETTER}]+")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def symbols_of(token: str, number: dict[str, int], mark: str) -> list[int]:
    """A token's symbols: byte, plus 256 for the byte that ends a word."""
    ends = bool(mark) and token.endswith(mark) and len(token) > len(mark)
    body = [number[c] for c in (token[:-len(mark)] if ends else token) if c in number]
    return body[:-1] + [body[-1] + 256] if ends and body else body


def joined_pairs(vocab, mark: str = "</w>") -> np.ndarray:
    """``[a, b]`` true where some token has symbol ``b`` right after symbol ``a``; every other place is a certain cut."""
    number = {c: b for b, c in enumerate(byte_chars())}
    inside = np.zeros((512, 512), bool)
    for token in vocab:
        s = symbols_of(token, number, mark)
        inside[s[:-1], s[1:]] = True
    return inside


class ForcedBpe:
    """Encoder and decoder of a byte-level BPE vocabulary whose words carry an end mark."""

    def __init__(self, path: str, keep: int = 300_000, recent: int = 300_000):
        from tokenizers import Tokenizer, models
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.mark = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = self.tok.model
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.inside = joined_pairs(model["vocab"], self.mark)
        self.chars = byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.number = {c: b for b, c in enumerate(self.chars)}
        self.fragments = SpanMemo(self._encode_fragments, np.uint32, keep, recent)
        self.words = SpanMemo(self._encode_words, np.uint32, keep, recent)

    def _encode_fragments(self, raw: list[bytes], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments; kind 1 ends a word."""
        flat, lens = [], []
        shown = dict(enumerate(self.chars))
        for fragment, kind in zip(raw, kinds):
            text = fragment.decode("latin-1")
            if not fragment.isalnum():
                text = text.translate(shown)
            ids = [t.id for t in (self.last if kind else self.inner).tokenize(text)]
            flat += ids
            lens.append(len(ids))
        return np.array(flat, np.uint32), np.array(lens, np.int64)

    def split(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The vocabulary's words of words of text, as bytes, cut at every certain cut:
        (bytes, first byte of each fragment, whether it ends a word, index of its word of text)."""
        parts, sizes, owner = [], [], []
        for i, word in enumerate(raw):
            text = word.decode()
            if QUICK.fullmatch(text):
                pieces = [p.encode() for p in PIECE.findall(text.lower())]
            else:
                cut = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
                pieces = [bytes([self.number[c] for c in p]) for p, _ in cut]
            parts += pieces
            sizes += [len(p) for p in pieces]
            owner += [i] * len(pieces)
        buf = np.frombuffer(b"".join(parts), np.uint8)
        if not len(buf):
            none = np.zeros(0, np.int64)
            return buf, none, none, none
        ends = np.cumsum(sizes)
        symbol = buf.astype(np.int64)
        symbol[ends - 1] += 256
        cut = np.ones(len(buf), bool)
        cut[1:] = (symbol[:-1] >= 256) | ~self.inside[symbol[:-1], symbol[1:]]
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(buf))
        which = np.searchsorted(ends, starts, "right")
        return buf, starts, (ends[which] == stops).astype(np.int64), np.array(owner, np.int64)[which]

    def _encode_words(self, raw: list[bytes], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts, final, owner = self.split(raw)
        stops = np.append(starts[1:], len(buf))
        flat, lens = self.fragments.lookup(np.concatenate([buf, np.zeros(16, np.uint8)]), starts, stops - starts, final)
        return flat, per_text(lens, owner, len(raw)).astype(np.int64)

    def encode_bytes(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts ``buf[offs[i]:offs[i + 1]]``."""
        n = len(offs) - 1
        raw = buf.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self._with_special(raw, offs)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        for a, z in wide_space(buf):
            space[a:z] = True
        starts, ends, owner = spans(~space, offs)
        flat, lens = self.words.lookup(np.concatenate([buf, np.zeros(16, np.uint8)]), starts, ends - starts,
                                       np.zeros(len(starts), np.int64))
        return flat, np.concatenate([[0], np.cumsum(per_text(lens, owner, n).astype(np.int64))])

    def _with_special(self, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for a, z in zip(offs[:-1], offs[1:]):
            parts = self.at_special.split(raw[a:z].decode())
            flat, at = self.encode(parts[::2])
            ids = [flat[at[0]:at[1]]]
            for k, token in enumerate(parts[1::2]):
                ids += [np.array([self.special[token]], np.uint32), flat[at[k + 1]:at[k + 2]]]
            out.append(np.concatenate(ids))
        return np.concatenate(out), np.cumsum([0] + [len(x) for x in out])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens as the vocabulary writes them, special ones too, joined by spaces: it has no decoder of its own."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def codec(path: str) -> ForcedBpe:
    return worker_cache(f"forced:{path}", lambda: ForcedBpe(path))


def _encode(path: str):
    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for first, last, buf, offs in text_slices(batch["text"], 1 << 20):
                flat, at = bpe.encode_bytes(buf, offs)
                ids = flat.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, last - first), pa.array(np.diff(at), pa.int64()),
                     pa.array([ids[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])
    return run


def _decode(path: str):
    def run(batches):
        bpe = codec(path)
        for batch in batches:
            width = max(1, batch["ids"].nbytes // (1 << 20))
            step = max(1, batch.num_rows // width)
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                text = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_tokens"], part["ids"], pa.array(text, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``docs(doc_id, text)``; ``ids`` are little-endian unsigned 32-bit integers."""
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encode(path or default_path()), f"doc_id {key}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of rows of ``encode``'s form."""
    key = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        _decode(path or default_path()), f"doc_id {key}, n_tokens long, ids binary, decoded string")


def op13_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
