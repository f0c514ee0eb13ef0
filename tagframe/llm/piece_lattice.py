"""Operator 4: SentencePiece encoding and decoding over a lattice of pieces.

The model file gives pieces in merge order; their unigram log-probabilities follow
the Zipf-Mandelbrot law of that rank. A text's words (a space, written as the
space mark, begins one; a line feed is one) are cut out by Spark; a task solves the
distinct words of a slice of its rows together: the pieces at every place are found
by walking the piece tree from all places at once, the edges are ordered by their
end, and Viterbi goes over the ends. Words and ids stay in the document's row, so
nothing is shuffled or written; a task holds ``SLICE`` words, the lattice of ``TOGETHER`` and the piece tree.

A character without a piece becomes its UTF-8 bytes. ``decode`` is the inverse,
local to the row.

Defined results: a null or empty text has no ids; a run of more than ``MAX_WORD``
characters is solved in parts of that length; of equally good paths the one with
the longer last piece is taken; repeated rows are encoded each; an empty table
gives no rows; a space mark in the text decodes as a space; extra columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents, ragged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
MAX_WORD = 256
#: Zipf-Mandelbrot offset of a piece's rank; cost of a byte.
OFFSET, BYTE_COST = 100, -25.0
#: Words whose distinct ones a task solves, and how many of those it solves together.
SLICE, TOGETHER = 1 << 21, 1 << 13


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path or default_path())


def piece_rows(sp) -> list[tuple[str, int, float]]:
    """``(piece, id, log-probability)`` of the pieces that merging can make."""
    rows = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            and (sp.get_score(i) > -1e8 or len(sp.id_to_piece(i)) == 1)]
    total = sum(1 / (r + OFFSET) for r in range(len(rows)))
    return [(p, i, -math.log((r + OFFSET) * total)) for r, (p, i) in enumerate(rows)]


def split_words(text: Column) -> Column:
    """Words of a text after marking its spaces; their concatenation is the marked text."""
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(
        marked, F.lit(f"{MARK}?[^{MARK}\\n]{{1,{MAX_WORD - 1}}}|{MARK}|\\n"), F.lit(0))).otherwise(F.array().cast("array<string>"))


class PieceTree:
    """The pieces as a tree of code points: an open table from (node, code point) to the next node."""

    def __init__(self, rows: list[tuple[str, int, float]], first_byte: int):
        children: dict[int, int] = {}
        piece, score = [-1], [0.0]
        for p, i, x in rows:
            node = 0
            for c in p:
                key = node << 21 | ord(c)
                if key not in children:
                    children[key] = len(piece)
                    piece.append(-1)
                    score.append(0.0)
                node = children[key]
            piece[node], score[node] = i, x
        self.first_byte = first_byte
        self.piece, self.score = np.array(piece, np.int32), np.array(score)
        self.shift = np.uint64(64 - (4 * len(piece)).bit_length())
        self.key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.node = np.zeros(len(self.key), np.int32)
        new, to = np.fromiter(children, np.int64), np.fromiter(children.values(), np.int32)
        pos = self._home(new)
        while len(new):
            free = self.key[pos] < 0
            self.key[pos[free]], self.node[pos[free]] = new[free], to[free]
            left = self.key[pos] != new
            new, to, pos = new[left], to[left], (pos[left] + 1) & (len(self.key) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The next node, 0 where there is none."""
        key = node.astype(np.int64) << 21 | point
        out, live, pos = np.zeros(len(key), np.int32), np.arange(len(key)), self._home(key)
        while len(live):
            found = self.key[pos]
            hit = found == key[live]
            out[live[hit]] = self.node[pos[hit]]
            more = ~hit & (found >= 0)
            live, pos = live[more], (pos[more] + 1) & (len(self.key) - 1)
        return out


def edges(tree: PieceTree, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, score, id) of all pieces in the words; a character without a piece is an edge with id -1.

    ``ends``: where the word of each code point ends.
    """
    at, node, n, out = np.arange(len(points)), np.zeros(len(points), np.int32), 0, []
    while len(at):
        node = tree.child(node, points[at + n])
        n += 1
        piece = tree.piece[node]
        hit = piece >= 0
        out.append((at[hit], np.full(hit.sum(), n), tree.score[node[hit]], piece[hit]))
        if n == 1:
            lone = at[~hit]
            size = 1 + (points[lone] >= 0x80) + (points[lone] >= 0x800) + (points[lone] >= 0x10000)
            out.append((lone, np.ones(len(lone), np.int64), BYTE_COST * size, np.full(len(lone), -1, np.int32)))
        on = (node > 0) & (at + n < ends[at])
        at, node = at[on], node[on]
    return tuple(np.concatenate(x) for x in zip(*out))


def solve(tree: PieceTree, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the best path of every word, one after the other, and how many each word has."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    start, n, score, piece = edges(tree, points, (begins + sizes)[word])
    # a word of k characters has k + 1 places; edges by their end in the word, then by place, the longest first
    source = start + word[start]
    end = start + n - begins[word[start]]
    order = np.argsort(end << 48 | source + n << 9 | MAX_WORD - n)
    source, score, piece, start, target = source[order], score[order], piece[order], start[order], (source + n)[order]
    best, through = np.zeros(len(points) + len(words)), np.full(len(points) + len(words), -1, np.int64)
    level = np.searchsorted(end[order], np.arange(1, sizes.max(initial=0) + 2))
    for a, z in zip(level[:-1], level[1:]):
        head = np.flatnonzero(np.concatenate([[True], target[a + 1:z] != target[a:z - 1]]))
        total = best[source[a:z]] + score[a:z]
        top = np.maximum.reduceat(total, head)
        equal = np.flatnonzero(total == np.repeat(top, np.diff(np.append(head, z - a))))
        first = equal[np.searchsorted(equal, head)]
        best[target[a + head]], through[target[a + head]] = top, a + first
    # back from the ends, a step of all words at a time
    place, owner, path = begins + np.arange(len(words)) + sizes, np.arange(len(words)), []
    while len(owner):
        edge = through[place]
        path.append((owner, edge))
        place, on = source[edge], source[edge] > (begins + np.arange(len(words)))[owner]
        place, owner = place[on], owner[on]
    owner, edge = (np.concatenate(x[::-1]) for x in zip(*path)) if path else (np.zeros(0, np.int64),) * 2
    along = np.argsort(owner, kind="stable")
    owner, edge = owner[along], edge[along]
    return _spelled(tree, piece[edge], points[start[edge]], owner, len(words))


def _spelled(tree: PieceTree, piece: np.ndarray, point: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the edges in order: the piece, or the bytes of a character that has none."""
    lone = np.flatnonzero(piece < 0)
    chars, which = np.unique(point[lone], return_inverse=True)
    raw = [chr(c).encode() for c in chars.tolist()]
    lens = np.array([len(r) for r in raw], np.int64)
    size = np.ones(len(piece), np.int64)
    size[lone] = lens[which]
    ids = np.repeat(piece, size)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + tree.first_byte
    ids[ragged((np.cumsum(size) - size)[lone], size[lone])] = flat[ragged((np.cumsum(lens) - lens)[which], lens[which])]
    return ids, np.bincount(owner, size, n).astype(np.int64)


def _encode(tree: PieceTree, size: int):
    """Batches of ``(doc_id, words)`` → batches of ``(doc_id, ids)``."""
    def code(words: pa.Array) -> pa.Array:
        flat = words.flatten().dictionary_encode()
        parts = [solve(tree, flat.dictionary.slice(i, TOGETHER).to_pylist()) for i in range(0, len(flat.dictionary), TOGETHER)]
        ids, lens = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 2
        lens = lens.astype(np.int64)
        at = flat.indices.to_numpy()
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(ids, pa.int32()))
        words_before = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        ids_before = np.concatenate([[0], np.cumsum(lens[at])])
        return pa.ListArray.from_arrays(pa.array(ids_before[words_before], pa.int32()), own.take(pa.array(at)).flatten())

    def run(batches):
        for batch in batches:
            before = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            row = 0
            while row < batch.num_rows:
                last = min(batch.num_rows, max(row + 1, int(np.searchsorted(before, before[row] + size, "right")) - 1))
                part = batch.slice(row, last - row)
                yield pa.RecordBatch.from_arrays([part.column(0), code(part.column(1))], names=["doc_id", "ids"])
                row = last
    return run


def encode(docs: DataFrame, path: str | None = None, size: int = SLICE) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``."""
    sp = load(path)
    tree = PieceTree(piece_rows(sp), sp.piece_to_id("<0x00>"))
    words = docs.select("doc_id", split_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    return words.mapInArrow(_encode(tree, size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids; the bytes of each id come from the vocabulary, a literal of fixed size."""
    sp = load(path)
    raw = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        raw.append(p[3:5] if sp.is_byte(i) else "" if sp.is_control(i) or sp.is_unknown(i)
                   else p.replace(MARK, " ").encode().hex())
    table = F.split(F.lit(",".join(raw)), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.substring(text, F.lit(2), F.length(text))


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents``, their number and a checksum of the text that they decode to."""
    got = encode(documents(spark, sf_dir))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(decode(F.col("ids")).cast("binary")).alias("text_crc32"), "ids")
