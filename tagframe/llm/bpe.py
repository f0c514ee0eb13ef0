"""Whole-text encoding by the public byte-level BPE, with a bounded memo of chunks.

A text whose white space is only single spaces and line feeds between other
characters is cut, on its bytes, before every space and around every line feed;
the pre-tokeniser has a boundary at each of these places, so the ids of the text
are the concatenated ids of its chunks and a chunk seen before need not be
encoded again (``chunks.SpanMemo``, an exact comparison of bytes). A new chunk of
ASCII and Latin letters is cut into pieces here and each piece goes to the
tokenizer's BPE model; other chunks go to the whole tokenizer, and so does every
text with runs of white space, tabs, other spaces or special-token strings.
"""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark import cloudpickle

from tagframe.llm.chunks import SpanMemo, wide_space
from tagframe.llm.common import worker_cache
from tagframe.llm.kernels import per_text, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# Pieces as the pre-tokeniser cuts them, for the characters that ``QUICK`` admits.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
QUICK = re.compile(f"[!-~{_LETTER}]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ 0-9{_LETTER}]+")
PIECES_KEPT = 100_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + other.index(b)) for b in range(256)]


class ChunkEncoder:
    """``memo`` bounds the chunks kept for good, ``recent`` those kept until as many newer ones came."""

    def __init__(self, path: str, memo: int = 400_000, recent: int = 400_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.pieces: dict[str, list[int]] = {}
        small = self.tok.get_vocab_size() <= 1 << 16
        self.memo = SpanMemo(self._new, np.uint16 if small else np.uint32, memo, recent)

    def _plain(self, texts: list[str]) -> list:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = []
        for i in range(0, len(texts), 2000):
            out += [e.ids for e in self.tok.encode_batch(texts[i:i + 2000], add_special_tokens=False)]
        return out

    def _piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            shown = "\u0120" + piece[1:] if piece[0] == " " else piece
            if not piece.isascii():
                shown = piece.encode().decode("latin-1").translate(self.shown)
            got = [t.id for t in self.model.tokenize(shown)]
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def _new(self, spans: list[bytes], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks; kind 0 comes after a space, 1 after a line feed, 2 begins a text."""
        flat, lens = [], []
        tokenize, piece, feed = self.model.tokenize, self._piece, self.feed
        for word, kind in zip(b"\n".join(spans).decode().split("\n"), kinds):
            if word.isascii() and word.isalpha():
                ids = [t.id for t in tokenize("\u0120" + word if kind == 0 else word)]
            elif QUICK.fullmatch(word):
                ids = [i for p in PIECE.findall(" " + word if kind == 0 else word) for i in piece(p)]
            else:
                ids = self.tok.encode(" " + word if kind == 0 else word, add_special_tokens=False).ids
            if kind == 1:
                ids = feed + ids
            flat += ids
            lens.append(len(ids))
        return np.array(flat, self.memo.dtype), np.array(lens, np.int64)

    def encode_bytes(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts ``buf[offs[i]:offs[i + 1]]``."""
        n = len(offs) - 1
        sep = (buf == 32) | (buf == 10)
        odd = (buf < 32) & ~sep  # tabs and control characters
        odd[1:] |= sep[1:] & sep[:-1]
        odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)  # "<|" may begin a special token
        full = np.flatnonzero(offs[1:] > offs[:-1])
        odd[offs[full]] |= sep[offs[full]]
        odd[offs[full + 1] - 1] |= sep[offs[full + 1] - 1]
        places = np.flatnonzero(odd)
        if wide := wide_space(buf):
            places = np.concatenate([places, np.array([a for a, _ in wide], np.int64)])
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offs, places, "right") - 1] = True
        starts, ends, owner = spans(~sep, offs)
        chunk = ~whole[owner]
        starts, ends, owner = starts[chunk], ends[chunk], owner[chunk]
        kind = np.where(starts == offs[owner], 2, np.where(buf[np.maximum(starts, 1) - 1] == 32, 0, 1))
        flat, lens = self.memo.lookup(np.concatenate([buf, np.zeros(16, np.uint8)]), starts, ends - starts, kind)
        own = np.concatenate([[0], np.cumsum(per_text(lens, owner, n).astype(np.int64))])
        flat = flat.astype(np.uint32)
        rest = np.flatnonzero(whole).tolist()
        if not rest:
            return flat, own
        got = dict(zip(rest, self._plain([buf[offs[i]:offs[i + 1]].tobytes().decode() for i in rest])))
        out = [np.array(got[i], np.uint32) if i in got else flat[own[i]:own[i + 1]] for i in range(n)]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of every text."""
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))


def encoder(path: str) -> ChunkEncoder:
    return worker_cache(f"bpe:{path}", lambda: ChunkEncoder(path))
