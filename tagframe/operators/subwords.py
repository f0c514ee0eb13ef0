"""Sub-word ids with marker tokens, and batches padded to their longest row.

The vocabulary is that of a public tokenizer file, never trained here: pieces of
bytes, written in the byte alphabet of such files, of which some end a word. A
text's tokens are those of ``tagging.tokenize``. A marker of the tag vocabulary is
one id of its own behind the file's ids; every other token is coded by longest
match from the left, where a piece that reaches the token's end must be one that
ends a word. All 256 single bytes are pieces of both kinds, so every token has a
code and ``decode`` gives the tokens back, joined by single spaces.

Coding stays in the document's row (one Arrow function, no exchange), some rows of
about ``SLICE`` tokens at a time, whatever the size of Spark's batches. A null text
has no ids; so has one without tokens.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagframe.operators import tagging as T
from tagframe.operators.windows import hash_rank

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_END = "</w>"
MEMO = 200_000  # coded tokens that a worker keeps
SLICE = 1 << 18  # tokens that a task codes at a time
BATCH = 16


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Pieces of a tokenizer file and the marker tokens added to them."""

    def __init__(self, path: str | None = None, markers=T.MARKERS):
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            file = json.load(f)
        self.ids: dict[str, int] = file["model"]["vocab"]
        added = [t["id"] for t in file.get("added_tokens", [])]
        self.first = max([*self.ids.values(), *added]) + 1
        self.markers = {m: self.first + i for i, m in enumerate(markers)}
        self.pad = self.first + len(self.markers)

    def coder(self):
        """``lists of tokens -> lists of ids``, for Arrow arrays."""
        ids, markers = self.ids, self.markers
        code_of = {b: c for b, c in enumerate(byte_alphabet())}
        starts = {p[:n] for p in ids for n in range(1, len(p) + 1)}
        memo: dict[str, list[int]] = {}

        def word(token: str) -> list[int]:
            if token in markers:
                return [markers[token]]
            text = "".join([code_of[b] for b in token.encode()])
            out, at, size = [], 0, len(text)
            while at < size:
                found, z = None, at
                while z < size and text[at:z + 1] in starts:
                    z += 1
                    got = ids.get(text[at:z] + WORD_END if z == size else text[at:z])
                    if got is not None:
                        found = got, z
                out.append(found[0])
                at = found[1]
            return out

        def code(tokens: pa.Array) -> pa.Array:
            if isinstance(tokens, pa.ChunkedArray):
                tokens = tokens.combine_chunks()
            flat = tokens.flatten().dictionary_encode()
            known = []
            for token in flat.dictionary.to_pylist():
                if token not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[token] = word(token)
                known.append(memo[token])
            sizes = np.array([len(k) for k in known], np.int64)
            at = flat.indices.to_numpy()
            pieces = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
                                              pa.array([i for k in known for i in k], pa.int32())).take(pa.array(at)).flatten()
            tokens_before = np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            ids_before = np.concatenate([[0], np.cumsum(sizes[at])])
            return pa.ListArray.from_arrays(ids_before[tokens_before].astype(np.int32), pieces)

        return code

    def decoder(self):
        """``lists of ids -> text``, for Arrow arrays: tokens joined by single spaces, padding left out."""
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        names = {i: p for p, i in self.ids.items()}
        whole = {i: m.encode() for m, i in self.markers.items()}
        pad = self.pad

        def text(ids: list[int]) -> str:
            words, open_ = [], bytearray()
            for i in ids:
                if i in whole:
                    words.append(whole[i])
                elif i != pad:
                    piece = names[i]
                    ends = piece.endswith(WORD_END)
                    open_ += bytes(byte_of[c] for c in (piece[:-len(WORD_END)] if ends else piece))
                    if ends:
                        words.append(bytes(open_))
                        open_.clear()
            return b" ".join(words).decode()

        def decode(lists: pa.Array) -> pa.Array:
            return pa.array([None if ids is None else text(ids) for ids in lists.to_pylist()], pa.string())

        return decode


def token_slices(batch: pa.RecordBatch, size: int = SLICE):
    """Runs of rows of ``(key, tokens)`` of about ``size`` tokens; a longer row is a run of its own."""
    before = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(before, before[row] + size, "right")) - 1)
        yield batch.slice(row, last - row)
        row = last


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: Vocabulary | None = None) -> DataFrame:
    """``(key, ids)`` of every text; ``text`` may itself come from a Python tagger."""
    tokens = docs.select(key, F.coalesce(T.tokenize(text), F.array().cast("array<string>")).alias("_tokens"))
    code = (vocabulary or Vocabulary()).coder()

    def run(batches):
        for batch in batches:
            for part in token_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), code(part.column(1))], names=[key, "ids"])

    return tokens.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(ids, vocabulary: Vocabulary | None = None) -> Column:
    """The tokens of a list of ids, joined by single spaces; null for null."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.arrow_udf((vocabulary or Vocabulary()).decoder(), "string", F.ArrowUDFType.SCALAR)(c)


def length_batches(lengths: DataFrame, key: str = "doc_id", n: str = "n_tokens", size: int = BATCH, seed: int = 42) -> DataFrame:
    """``(key, n, batch_no, batch_len)``: ``size`` consecutive rows in order of length; only the last batch may be smaller.

    Rows of one length follow in the seeded order. The place is exact at any size: rows
    before a length from the counts by length, the place within it from ``hash_rank``,
    whose buckets split a length that many rows share. Keys must be distinct.
    """
    t = lengths.select(key, n)
    counts = t.groupBy(n).agg(F.count(F.lit(1)).alias("_rows"))  # one row a length: at most the longest row's tokens
    before = Window.orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(n, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = hash_rank(t, key, seed, by=(n,), out="_within").join(counts, n)
    placed = placed.select(key, n, F.floor((F.col("_before") + F.col("_within")) / size).cast("long").alias("batch_no"))
    return placed.withColumn("batch_len", F.max(n).over(Window.partitionBy("batch_no")))


def padded(rows: DataFrame, pad: int, key: str = "doc_id", ids: str = "ids", size: int = BATCH) -> DataFrame:
    """``(key, batch_no, batch_len, n_tokens, input_ids, attention_mask)``, every row as long as its batch's longest.

    ``rows`` is read twice (lengths, then ids): pass a stored table.
    """
    lengths = rows.select(key, F.size(ids).alias("n_tokens"))
    left = F.col("batch_len") - F.col("n_tokens")
    return rows.select(key, ids).join(length_batches(lengths, key, size=size), key).select(
        key, "batch_no", "batch_len", "n_tokens", F.concat(ids, F.array_repeat(F.lit(pad), left)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), left)).alias("attention_mask"))
