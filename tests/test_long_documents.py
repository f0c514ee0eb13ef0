"""One document of very many entities: time grows with the text, not with its square; offsets and spans stay right."""

import re
import time

import pytest

from tagframe.operators import entities as E
from tagframe.operators import tagging as T


def _doc(spark, n):
    words = ["Anna", "NASA", "x9", "Poland", "é", "42"]
    text = " ".join(words[i % len(words)] for i in range(n))
    return spark.createDataFrame([(1, text)], "doc_id long, text string"), text


@pytest.mark.parametrize("job", ["tag_tokens", "tag_xml", "tag_spans"])
def test_a_million_tokens(spark, job):
    run = {"tag_tokens": E.tag_tokens, "tag_xml": lambda d: T.tag_xml_rows(d, E.token_entities("text")),
           "tag_spans": lambda d: E.tag_spans_rows(d, E.token_entities("text"))}[job]
    for n in (1000, 1_000_000):
        docs, text = _doc(spark, n)
        docs.count()
        began = time.perf_counter()
        out = run(docs)
        if job == "tag_xml":
            got = out.first()
            assert got.n_spans > n // 2
            assert got.tagged_text.startswith("<per>Anna</per> <org>NASA</org> x9 <loc>Poland</loc> é <misc>42</misc> <per>Anna")
            if n > 1000:
                assert re.sub(r"</?(?:per|org|loc|misc)>", "", got.tagged_text) == text
        else:
            out.write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 30


def test_overlapping_spans_keep_the_running_maximum(spark):
    """Every span that starts before the end of any earlier one is dropped, however far back that one is."""
    import random
    rnd = random.Random(4)
    docs, spans, want = [], [], {}
    for d in range(40):
        docs.append((d, "x" * 400))
        own = sorted((rnd.randint(0, 390), i, rnd.randint(1, 60)) for i in range(rnd.randint(0, 70)))
        own = [(a, i, min(400, a + k)) for a, i, k in own]
        spans += [(d, i, a, z, "T") for a, i, z in own]
        reach, want[d] = 0, 0
        for a, _, z in own:
            want[d] += a >= reach
            reach = max(reach, z)
    got = T.insert_tags(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(spans, "doc_id long, pos int, start int, end int, entity string"))
    assert {r.doc_id: r.n_spans for r in got.collect()} == want
