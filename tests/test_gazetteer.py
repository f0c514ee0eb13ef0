"""The gazetteer tagger on both paths against a search of every name at every place."""

import random

import pytest

from tagframe.operators import gazetteer as GZ

NAMES = [("New York", "GPE"), ("New York City", "GPE"), ("York", "PER"), ("York", "ORG"), ("a b", "X"), ("b a", "Y"), ("é", "Z"),
         ("O'Neil", "PER"), ("東京", "LOC"), ("", "NONE"), (None, "NONE"), ("nolabel", None), ("- x", "S"), ("x", "T"), ("x", "T")]


def by_hand(text):
    names = {}
    for name, label in NAMES:
        if name and label is not None:
            names[name] = min(label, names.get(name, label))
    out, at = [], 0
    while at < len(text):
        here = [n for n in names if text.startswith(n, at) and (at == 0 or not text[at - 1].isalnum())
                and (at + len(n) == len(text) or not text[at + len(n)].isalnum())]
        if here:
            best = max(here, key=len)
            out.append((len(out), names[best], best, at, at + len(best)))
            at += len(best)
        else:
            at += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["New", "York", "City", "a", "b", "é", "éa", "O'Neil", "東京", "東京都", "-", "x", "xx", "Yorks", "(York)", "\U0001F600"]
    made = [rnd.choice([" ", " ", "", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    return [*made, None, "", "a b a b a", "New York" * 3, "New York City New York, York", "x - x", "a b " * 4000]


@pytest.mark.parametrize("limit", [GZ.LIMIT, 0])
def test_matches_equal_a_search_of_every_name(spark, texts, limit):
    docs = spark.createDataFrame([(f"k{i}", t, "n", "l") for i, t in enumerate(texts)],
                                 "doc_id string, text string, name string, label string").repartition(3)
    names = spark.createDataFrame(NAMES, "name string, label string")
    got = {}
    for r in GZ.tag_gazetteer(docs, names, limit=limit).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.entity, r.word, r.start, r.end))
    want = {f"k{i}": by_hand(t) for i, t in enumerate(texts) if t}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_the_small_path_has_no_exchange_and_the_large_collects_no_names(spark):
    docs = spark.createDataFrame([(1, "York")], "doc_id long, text string")
    names = spark.createDataFrame([("York", "PER")], "name string, label string")
    assert "Exchange" not in GZ.tag_gazetteer(docs, names)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in GZ.tag_gazetteer(docs, names, limit=0)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [GZ.LIMIT, -1])
def test_empty_tables(spark, limit):
    docs = spark.createDataFrame([(1, "York")], "doc_id long, text string")
    names = spark.createDataFrame([("York", "PER")], "name string, label string")
    assert GZ.tag_gazetteer(docs.limit(0), names, limit=limit).collect() == []
    assert GZ.tag_gazetteer(docs, names.limit(0), limit=limit).collect() == []
