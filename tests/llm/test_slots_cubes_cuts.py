"""Operators 11, 12 and 13: against brute force and the tokenizer; odd rows, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagframe.llm import forced_bpe, hard_negatives, source_divergence

from .conftest import ODD, SF

# ---- operator 11 ----------------------------------------------------------

VEC = "vec_id long, label int, embedding array<double>, score double, rank int"


def brute_negatives(rows, anchors=100, k=5):
    """By the definition, over Python integers; ``rows`` (vec_id, label, components), distinct ids."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = []
    for i, own, a in rows:
        if i % anchors:
            continue
        scored = sorted(((-dot(a, v), j, label) for j, label, v in rows if j != i))
        for s, j, _ in [x for x in scored if x[2] == own][:k]:
            p = -s
            ok = [(-t, m) for t, m, label in scored if label != own and 80 * p <= -100 * t <= 100 * p]
            out += [(i, j, r + 1, m, p, t) for r, (t, m) in enumerate(ok[:k])]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.usable(df), F.col("vec_id") % 100 == 0, **kw).collect())


@pytest.mark.parametrize("blocks", [{}, {"row_block": 37, "anchor_block": 2}])
def test_negatives_equal_brute_force_with_many_ties(spark, blocks):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, (600, 4)) / 256.0
    vecs[200:400] = vecs[200]  # one vector holds a third of all rows
    rows = [(i, int(rng.integers(0, 3)), v.tolist(), 0.5, 1) for i, v in enumerate(vecs)]
    got = mined(spark.createDataFrame(rows, VEC), **blocks)
    want = brute_negatives([(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows])
    assert got == want and len({x[0] for x in got}) > 2


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.2]), (2, 2, [0.45, 0.2]), (3, 2, [0.4, 0.3, 9.0]), (4, 1, []), (100, 2, []), (7, 3, [-0.1, -0.1])]
    bad = [(None, 1, [1.0, 1.0]), (200, None, [1.0, 1.0]), (300, 1, None), (400, 1, [nan, 1.0]), (5, 2, [inf, 0.0]), (6, 2, [None, 1.0])]
    rows = [(*r, 0.1, 3) for r in good + bad + [good[2], (3, 9, [100.0, 100.0])]]  # a repeated row and a repeated key
    assert mined(spark.createDataFrame(rows, VEC)) == brute_negatives(
        [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in good])
    assert mined(spark.createDataFrame([], VEC)) == []
    assert mined(spark.createDataFrame([(0, 1, [], 0.0, 0)], VEC)) == []


def test_scores_beyond_exact_doubles_stay_exact(spark):
    rows = [(0, 1, [2.0 ** 22, 1.0]), (1, 1, [2.0 ** 21, 3.0]), (2, 2, [2.0 ** 21 - 2.0 ** -8, 3.0]), (3, 2, [2.0 ** 21 - 2.0 ** -7, 3.0])]
    want = brute_negatives([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows])
    assert mined(spark.createDataFrame([(*r, 0.0, 0) for r in rows], VEC)) == want and len(want) == 2
    huge = hard_negatives.scores(np.array([[1e300]]), np.array([[1e300], [-1e300]]), True)
    assert huge.tolist() == [[2 ** 63 - 1, -2 ** 63 + 1]]


def test_first_k_takes_the_first_of_equal_scores():
    rng = np.random.default_rng(5)
    score, open_ = rng.integers(0, 3, (40, 30)), rng.random((40, 30)) < 0.5
    row, col = hard_negatives.first_k(score, open_, 4)
    for i in range(40):
        want = sorted(sorted((-score[i, j], j) for j in np.flatnonzero(open_[i]))[:4], key=lambda x: x[1])
        assert col[row == i].tolist() == [j for _, j in want]


# ---- operator 12 ----------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, min_docs=3, top=200):
    """By the definition, over Python integers; ``rows`` (lang, source, text)."""
    docs = [(a or "", b or "", TERM.findall((t or "").translate(LOWER))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, w in own for t in set(w))
        kept = sorted((t for t, n in seen.items() if n >= min_docs), key=str.encode)
        count = defaultdict(Counter)
        for _, source, words in own:
            count[source].update(w for w in words if seen[w] >= min_docs)
        total = sum(count.values(), Counter())

        def p(c):
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in count.items()}, p(total)

        def rank(part, source, items):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            return [(lang, source, part, i, v, r + 1) for r, (i, v) in enumerate(items)]
        for s in ps:
            out += rank("pair", s, [(o, sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept)) for o in ps if o != s])
            out += rank("term", s, [(t, (ps[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and ps[s][t] > q[t]])[:top]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in source_divergence.audit(df, **kw).collect())


def test_divergences_equal_brute_force(spark, small):
    rows = [(r["lang"], r["source"], r["text"]) for r in small.collect()]
    want = brute_audit(rows)
    assert audited(small) == want
    # blocks far smaller than the groups and terms: many cells, absent terms on both sides
    assert audited(small, group_block=3, term_block=100) == want
    assert audited(small, top=2) == [r for r in want if r[2] == "pair" or r[5] <= 2]


def test_divergences_of_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert audited(odd) == brute_audit(rows)
    assert audited(none) == []
    text = "Über UBER über x" * 3
    made = [("de", s, text if s else "nothing kept") for s in ("a", "b", "", None, "a")] + [(None, "é", None), (None, "z", "one"), ("fr", "only", "mot mot")]
    df = spark.createDataFrame([(i, t, a, s, "x", 1) for i, (a, s, t) in enumerate(made)],
                               "doc_id long, text string, lang string, source string, term string, n int")
    got = audited(df)
    assert got == brute_audit([(a, s, t) for a, s, t in made])
    assert ("", "z", "pair", "é", 0, 1) in got and not [r for r in got if r[0] == "fr" and r[2] == "pair"]


def test_term_counter_survives_small_bounds(small):
    """A task that often runs out of room emits the same sums."""
    import pyarrow as pa
    rows = small.select("lang", "source", "text").toPandas()
    batch = pa.RecordBatch.from_pandas(rows.astype(object).where(rows.notna(), None), preserve_index=False)

    def sums(*bounds):
        got = Counter()
        for b in source_divergence._count(*bounds)([batch, batch]):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["term"], "n"] += r["n"]
                got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return got
    assert sums(50, 100) == sums(1 << 20, 1 << 22)


def test_term_counter_holds_a_pair_once():
    """Of many documents with the same terms a task keeps one entry a (group, term)."""
    counter = source_divergence._Counter(1 << 12, 1 << 12)
    text = b"one two two three" + b" "
    buf = np.frombuffer(text * 500, np.uint8)
    offs = np.arange(501) * len(text)
    assert not list(counter.add(buf, offs, np.zeros(500, np.int64)))
    assert counter.size == 3
    counter.groups["en", "web"] = 0
    got = sorted((r["term"], r["n"], r["docs"]) for b in counter.rows() for r in b.to_pylist())
    assert got == [("one", 500, 500), ("three", 500, 500), ("two", 1000, 500)]


# ---- operator 13 ----------------------------------------------------------

@pytest.fixture(scope="module")
def bpe():
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return forced_bpe.ForcedBpe(forced_bpe.default_path(), 300, 500)


def random_texts():
    rnd = random.Random(7)
    letters = list("abAB'.,1 \n\té日!?$ΣςσİıŉÅﬁ①½²ªµ") + [" "] * 5 + [
        "'ll", "'re", "é", "́", "<|endoftext|>", "<|startoftext|>", "\0", "\x1c", "\x85", "\xa0", " ",
        "　", "​", "x" * 20, "'s", "|", "<", "﻿", "가", "가", "\U0001d538", "😀", "ẞ"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    any_char = [lambda: rnd.randrange(0x20, 0xd800), lambda: rnd.randrange(0xe000, 0x110000), lambda: rnd.randrange(0x20, 0x600)]
    return texts + ["".join(chr(rnd.choice(any_char)()) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]


def test_fragments_encode_as_the_tokenizer(bpe):
    texts = [t or "" for t in ODD] + random_texts() + ["ab" * 200_000, "日本" * 50_000, "!?" * 100_000]
    want = [e.ids for e in bpe.tok.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 700):
        flat, at = bpe.encode(texts[i:i + 700])
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want[i:i + 700]
    for ids in want[:1000]:
        assert bpe.decode(np.array(ids, np.uint32)) == bpe.tok.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain_and_fragments_whole(bpe):
    """No token spans a cut; the fragments are the words' bytes."""
    words = ["don't", "x#@%y", "naïve!!日本", "AbC123", "​́q"]
    buf, starts, final, owner = bpe.split([w.encode() for w in words])
    symbol = buf.astype(int)
    symbol[np.append(starts[1:], len(buf))[final == 1] - 1] += 256
    assert not [p for p in starts[1:] if symbol[p - 1] < 256 and bpe.inside[symbol[p - 1], symbol[p]]]
    assert len(starts) > sum(final) > len(words) and sorted(set(owner)) == list(range(len(words)))
    vocab = {"a": 0, "b": 1, "c</w>": 2, "ab": 3, "bc</w>": 4}
    inside = forced_bpe.joined_pairs(vocab)
    assert inside[97, 98] and inside[98, 99 + 256] and inside.sum() == 2


def test_encoding_query(spark, odd, none, bpe):
    def digests(rows):
        ids = [(k, bpe.tok.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
        return Counter((k, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                        hashlib.sha256(bpe.tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for k, x in ids)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in forced_bpe.op13_forced_boundary(spark, SF).collect()) == digests([tuple(r) for r in docs])
    got = forced_bpe.decode(forced_bpe.encode(odd)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(),
                    hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in got) == digests(
        [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert forced_bpe.decode(forced_bpe.encode(none)).collect() == []
    null = spark.createDataFrame([("k", 0, None)], "doc_id string, n_tokens long, ids binary")
    assert forced_bpe.decode(null).first()["decoded"] is None
