"""Randomised checks of insertion (T1), cursor search (T2) and free search (T3) against their specification:
what an accepted span must satisfy, and that removing the tags gives the text back."""

import random
import re

from tagframe.operators import tagging as T

ALPHABET = "ab Éé😀xY"


def _rand_text(rnd):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))


def test_insertion_keeps_text_and_marks_spans(spark):
    rnd = random.Random(17)
    docs, spans, held = [], [], {}
    for d in range(300):
        text = _rand_text(rnd)
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 2 * rnd.randint(0, 4))))
        held[d] = [(a, b, rnd.choice(["a", "bb"])) for a, b in zip(cuts[::2], cuts[1::2])]
        docs.append((d, text))
        spans += [(d, i, a, b, lab, len(text[:a].encode()), len(text[:b].encode())) for i, (a, b, lab) in enumerate(held[d])]
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    sdf = spark.createDataFrame(spans, "doc_id long, pos int, start int, end int, entity string, bstart int, bend int")
    by_bytes = {r.doc_id: r.tagged_text for r in T.insert_tags(ddf, sdf).collect()}
    by_points = {r.doc_id: r.tagged_text for r in T.insert_tags(ddf, sdf.drop("bstart", "bend")).collect()}
    assert by_bytes == by_points
    for d, text in docs:
        tagged = by_bytes[d]
        assert re.sub(r"</?(?:a|bb)>", "", tagged) == text
        found = [(m[1], m[2]) for m in re.finditer(r"<(a|bb)>(.*?)</\1>", tagged, re.S)]
        assert found == [(lab, text[a:b]) for a, b, lab in held[d]]


def _random_lists(seed):
    rnd = random.Random(seed)
    docs, lists = [], {}
    for d in range(300):
        text = _rand_text(rnd)
        words = []
        for _ in range(rnd.randint(1, 5)):
            if text and rnd.random() < 0.8:
                s = rnd.randint(0, len(text) - 1)
                w = text[s:s + rnd.randint(1, 3)]
            else:
                w = rnd.choice(["zz", "", "ab"])
            if rnd.random() < 0.3:
                w = w.upper()
            words.append((w, rnd.choice(["X", "Yy", ""]) if rnd.random() < 0.2 else rnd.choice(["X", "Yy"])))
        docs.append((d, text))
        lists[d] = words
    return docs, lists


def _frames(spark, docs, lists):
    rows = [(d, i, w, lab) for d, el in lists.items() for i, (w, lab) in enumerate(el)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(rows, "doc_id long, pos int, word string, entity string"))


def test_cursor_search_by_its_specification(spark):
    """Every usable word stands, tagged, at its first place after the tagged word before it; the others have no such place."""
    docs, lists = _random_lists(23)
    got = {r.doc_id: r for r in T.tag_inline_cursor(*_frames(spark, docs, lists)).collect()}
    for d, text in docs:
        tagged = got[d].tagged_text
        assert re.sub(r"</?(?:X|Yy)>", "", tagged) == text
        matches = list(re.finditer(r"<(X|Yy)>(.*?)</\1>", tagged, re.S))
        left = 0
        places = []
        for n, m in enumerate(matches):
            before = re.sub(r"</?(?:X|Yy)>", "", tagged[:m.start()])
            places.append((len(before), len(before) + len(m[2]), m[1], m[2]))
        usable = [(w, lab) for w, lab in lists[d] if w and lab]
        for a, b, lab, word in places:
            while usable[0] != (word, lab) or word not in text[left:]:
                assert usable.pop(0)[0] not in text[left:]
            usable.pop(0)
            assert text[left:].index(word) == a - left
            left = b
        assert all(w not in text[left:] for w, _ in usable)
        assert got[d].n_spans == len(places)


def test_free_search_by_its_specification(spark):
    """Accepted spans are disjoint first matches in any case; a rejected word has no match or its first one is touched."""
    docs, lists = _random_lists(29)
    spans = {d: [] for d, _ in docs}
    for r in T.find_offsets(*_frames(spark, docs, lists)).orderBy("doc_id", "pos").collect():
        spans[r.doc_id].append((r.start, r.end, r.entity))
    for d, text in docs:
        found, first = spans[d], {}
        for w, lab in lists[d]:
            m = re.search(re.escape(w), text, re.I) if w and lab else None
            if m:
                first.setdefault(m.span(), lab.lower())
        assert all(a >= z or b <= y for i, (a, b, _) in enumerate(found) for y, z, _ in found[:i])
        assert [(a, b) for a, b, _ in found] == [x for x in first if x in {(a, b) for a, b, _ in found}]
        assert all(first[a, b] == lab for a, b, lab in found)
        assert all(any(a < z and y < b for a, b, _ in found) for y, z in first)
