"""Operators 7 and 9 against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tagframe.llm import chosen_path, exact_dedup
from tagframe.llm.components import components

from .conftest import SF


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (key, _), n in zip(rows, norm):
        keys = [k for (k, _), m in zip(rows, norm) if m == n]
        real = [k for k in keys if k is not None]
        out.append((key, min(real) if real else None, len(keys), hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


def check_exact(got, rows):
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) <= {1} and set(kept) == {r["text_sha256"] for r in got}


def test_exact_groups(spark, texts):
    check_exact(exact_dedup.op7_exact_dedup(spark, SF).collect(), list(texts.items()))


def test_exact_groups_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_exact(exact_dedup.dedup(odd).collect(), rows)
    assert exact_dedup.dedup(none).count() == 0


def test_exact_groups_compare_contents_when_digests_collide(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    weak = exact_dedup.dedup(odd, salts=2, digest=lambda c: (F.crc32(c.cast("binary")) % 2).cast("string"))
    check_exact(weak.collect(), rows)


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_near(rows, size=4):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return Counter((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def near(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_near_groups(spark, texts):
    assert near(chosen_path.op9_chosen_path(spark, SF)) == brute_near(list(texts.items()))


def test_near_groups_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert near(chosen_path.near_duplicates(odd)) == brute_near(rows)
    assert chosen_path.near_duplicates(none).count() == 0


def test_large_nodes_are_branched_and_keep_their_links(spark):
    """A hot group of near copies of one text, some chains away from it, with leaves far smaller than the group."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 9), replace=False):
            words[p] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.integers(0, 50)}" for _ in range(60)) + " " + " ".join(base[:30])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert near(chosen_path.near_duplicates(df, leaf=16, depth=3)) == brute_near(rows)


def test_sparse_pairs_under_a_common_template(spark):
    """Pairs just over 0.8 whose texts mostly are a passage that all texts share: nodes stay large for many levels."""
    hot, rows = " ".join(f"h{i}" for i in range(153)), []
    for p in range(150):
        both = " ".join(f"p{p}x{i}" for i in range(8))
        rows += [(2 * p + k, f"{hot} {both} " + " ".join(f"o{p}y{k}z{i}" for i in range(18))) for k in (0, 1)]
    got = near(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), leaf=16, depth=6))
    want = brute_near(rows)
    assert len({c for _, _, c in want}) == 150
    assert got == want


def test_components(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2"), ("z2", "z1"), ("z1", "z1")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(41)}, "z1": "z1", "z2": "z1"}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
