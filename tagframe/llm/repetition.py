"""Operator 5: quality rules with suffix-array repetition.

The base rules count words, symbols and duplicate lines. Repetition comes from a
suffix array over the words of each text: all texts of a run are sorted together
by prefix doubling, restricted to the suffixes that share at least ``MIN_WORDS``
words with another suffix of their text. Longest common prefixes of neighbours
give, by interval, the maximal repeated substrings; the union of their spans is
the covered part. The method keeps a text if repeats of ``LONG_WORDS`` words or more cover
at most ``MAX_COVERED`` of its words and its longest repeat is within limits.

Words are compared by 64-bit hashes.

Defined results: a null or empty text has no word and fails the base rules;
repeated rows are judged each; extra columns are kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents, text_slices
from tagframe.llm.kernels import hash_spans, mix64, space_table, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 8
LONG_WORDS = 12
MAX_COVERED = 0.2
LONGEST_SHARE, LONGEST_WORDS = 0.1, 40
RESULT = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,longest_repeat:long,"
          "n_long_words:long,n_repeats:long,repeats:array<struct<start:long,words:long,times:long>>>")


def repeated_starts(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Positions whose next ``size`` words occur again in their text."""
    n = len(words) - size + 1
    if n < 2:
        return np.zeros(0, np.int64)
    odd = mix64(np.arange(1, size + 1)) | np.uint64(1)
    gram = mix64(doc[:n] + 1)
    for k in range(size):
        gram = gram + words[k:n + k] * odd[k]
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    gram = mix64(gram[at])
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return at[hit]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Rank of every row by its keys, the first the most significant; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def suffix_lcp(words: np.ndarray, doc: np.ndarray, size: int = MIN_WORDS):
    """Suffixes that repeat at least ``size`` words in their text: (their positions in suffix order, lcp with the one before).

    The lcp is 0 at the first suffix of a text. Suffixes compare word by word, in the order of the words' hashes.
    """
    active = repeated_starts(words, doc, size)
    if not len(active):
        return active, active
    n = len(words)
    ends = np.searchsorted(doc, doc[active], "right")
    after = active + size
    pos = np.unique(np.concatenate([active, after[after < ends]]))
    index = np.full(n + 1, -1, np.int64)
    index[pos] = np.arange(len(pos))
    end = np.searchsorted(doc, doc[pos], "right")
    padded = np.append(words, np.zeros(size, np.uint64))
    word_at = lambda k: np.where(pos + k < end, padded[pos + k], np.uint64(0))
    rank = _dense(doc[pos], *[word_at(k) for k in range(size)])
    levels, step = [(size, rank)], size
    while rank.max() + 1 < len(pos) and step < n:
        later = np.where(pos + step < end, index[np.minimum(pos + step, n)], -1)
        rank = _dense(rank, np.where(later >= 0, rank[later], -1))
        step *= 2
        levels.append((step, rank))
    order = np.argsort(rank, kind="stable")
    order = order[np.isin(pos[order], active, assume_unique=True)]
    a, b = pos[order[:-1]], pos[order[1:]]
    lcp = np.zeros(len(a), np.int64)
    limit = np.minimum(end[order[:-1]] - a, end[order[1:]] - b)
    same_doc = doc[a] == doc[b]
    for step, rank in reversed(levels):
        x, y = index[np.minimum(a + lcp, n)], index[np.minimum(b + lcp, n)]
        eq = same_doc & (x >= 0) & (y >= 0) & (lcp + step <= limit)
        eq[eq] = rank[x[eq]] == rank[y[eq]]
        lcp[eq] += step
    open_ = same_doc.copy()
    for _ in range(size - 1):
        open_ &= lcp < limit
        open_[open_] = words[(a + lcp)[open_]] == words[(b + lcp)[open_]]
        lcp[open_] += 1
    return pos[order], np.concatenate([[0], lcp])


def maximal_repeats(at: np.ndarray, lcp: np.ndarray, words: np.ndarray, first: int, size: int) -> list[tuple[int, int, int]]:
    """(first position, words, occurrences) of the maximal repeated substrings of one text, from its lcp intervals."""
    out, stack = [], [(0, 0)]  # (lcp, left end)
    m = len(at)
    for r in range(1, m + 1):
        now = int(lcp[r]) if r < m else 0
        left = r - 1
        while stack[-1][0] > now:
            length, left = stack.pop()
            if length >= size:
                inside = at[left:r]
                before = np.where(inside > first, words[inside - 1], np.uint64(0))
                # maximal to the left as well: the words before differ, or one occurrence begins the text
                if (before != before[0]).any() or (inside == first).any():
                    out.append((int(inside.min()) - first, length, r - left))
        if now > stack[-1][0]:
            stack.append((now, left))
    return out


def measure(texts: pa.Array, size: int = MIN_WORDS):
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in "#*$%&|<>"]] = True
    space = space_table()
    out = []
    for a, b, buf, offs in text_slices(texts, 2 << 20):
        n = b - a
        gap = space[buf]
        starts, ends, doc = spans(~gap, offs)
        total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])
        chars = total(((buf & 0xC0) != 0x80) & ~gap)
        n_symbols = total(symbols[buf])
        l_start, l_end, l_doc = spans(buf != 10, offs)
        inked = np.concatenate([[0], np.cumsum(~gap)])
        line = inked[l_end] > inked[l_start]
        l_hash, l_doc = hash_spans(buf, l_start[line], l_end[line]), l_doc[line]
        order = np.lexsort((l_hash, l_doc))
        again = (l_hash[order][1:] == l_hash[order][:-1]) & (l_doc[order][1:] == l_doc[order][:-1])
        dup_lines = np.bincount(l_doc[order][1:][again], minlength=n)
        words = hash_spans(buf, starts, ends)
        n_words = np.bincount(doc, minlength=n)
        at, lcp = suffix_lcp(words, doc, size)
        longest, covered, long, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        if len(at):
            reach = np.maximum(lcp, np.append(lcp[1:], 0))

            def cover(least):
                some = reach >= least
                mark = (np.bincount(at[some], minlength=len(words) + 1)
                        - np.bincount((at + reach)[some], minlength=len(words) + 1))
                return np.bincount(doc[np.flatnonzero(np.cumsum(mark)[:-1] > 0)], minlength=n)

            covered, long = cover(size), cover(LONG_WORDS)
            np.maximum.at(longest, doc[at], reach)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(doc[at])) + 1, [len(at)]])
            begin = np.searchsorted(doc, np.arange(n))
            for x, y in zip(edge[:-1], edge[1:]):
                d = int(doc[at[x]])
                repeats[d] = maximal_repeats(at[x:y], lcp[x:y], words, int(begin[d]), size)
        for i in range(n):
            found = repeats.get(i, ())
            out.append((int(n_words[i]), int(chars[i]), int(n_symbols[i]), int(dup_lines[i]), int(covered[i]), int(longest[i]),
                        int(long[i]), len(found), [{"start": s, "words": w, "times": t} for s, w, t in found]))
    return out


def _measure(texts: pa.Array) -> pa.Array:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_long_words", "n_repeats")
    got = measure(texts)
    cols = list(zip(*got)) if got else [[]] * 9
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("times", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], span)],
                                      names=[*names, "repeats"])


def repetition(text: Column) -> Column:
    """Struct of the base counts, the longest repeat and the maximal repeats (in words) of a text column."""
    return F.arrow_udf(_measure, RESULT, F.ArrowUDFType.SCALAR)(F.coalesce(text.cast("string"), F.lit("")))


def judge(measured: DataFrame, max_covered: float = MAX_COVERED, longest_share: float = LONGEST_SHARE,
          longest_words: int = LONGEST_WORDS) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the counts."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("n_long_words") <= max_covered * F.col("n_words")) & (
        F.col("longest_repeat") <= F.greatest(F.lit(longest_words), longest_share * F.col("n_words")))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents(spark, sf_dir).select("doc_id", repetition(F.col("text")).alias("r")).select("doc_id", "r.*")
    return judge(got).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                             "kept", "longest_repeat", "n_long_words", "n_repeats", "repeats")
