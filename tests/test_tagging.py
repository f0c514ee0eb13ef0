"""Golden cases for cleaning, merging and tag insertion."""

import random

from pyspark.sql import functions as F

from tagframe.operators import entities as E
from tagframe.operators import tagging as T


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pos int, start int, end int, entity string")


def test_clean_a(spark):
    df = spark.createDataFrame([("ĠAnn",), ("AĠB",)], "word string")
    got = [tuple(r) for r in df.select(E.clean_leading("word"), E.clean_all("word")).collect()]
    assert got == [("Ann", "Ann"), ("AĠB", "AB")]


def test_merge_wordpiece_golden(spark):
    pieces = spark.createDataFrame([(0, 0, 0, "##x", "ORG"), (0, 1, 0, "Ob", "MISC"), (0, 2, 0, "##ama", "LOC"),
                                    (0, 3, 0, "Iowa", "LOC")], "doc_id long, pos int, piece_no int, word string, entity string")
    c3 = [(r.word, r.entity) for r in E.merge_wordpiece(pieces).orderBy("pos").collect()]
    c4 = [(r.word, r.entity) for r in E.merge_wordpiece_keep(pieces).orderBy("pos").collect()]
    assert c3 == [("Obama", "MISC"), ("Iowa", "LOC")]
    assert c4 == [("x", None), ("Obama", "MISC"), ("Iowa", "LOC")]


def test_merge_adjacent_golden(spark):
    s = _spans(spark, [(0, 0, 0, 3, "PER"), (0, 1, 4, 9, "PER"), (0, 2, 13, 19, "LOC"),
                       (1, 0, 0, 9, "A"), (1, 1, 2, 4, "A")])
    got = sorted((r.doc_id, r.start, r.end, r.entity) for r in T.merge_adjacent(s).collect())
    assert got == [(0, 0, 9, "PER"), (0, 13, 19, "LOC"), (1, 0, 4, "A")]


def _connected_runs(spans):
    """Cut the sorted spans wherever a span does not continue the one before it; a run ends where its last span ends."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], i))
    joins = [spans[a][2] == spans[b][2] and spans[b][0] - spans[a][1] <= 1 for a, b in zip(order, order[1:])]
    cuts = [0] + [i + 1 for i, j in enumerate(joins) if not j] + [len(order)]
    return [(spans[order[a]][0], spans[order[b - 1]][1], spans[order[a]][2]) for a, b in zip(cuts, cuts[1:])]


def test_merged_spans_are_the_connected_runs(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for d in range(200):
        sp = [(s, s + rnd.randint(1, 5), rnd.choice("AB")) for s in (rnd.randint(0, 30) for _ in range(rnd.randint(1, 8)))]
        want[d] = sorted(_connected_runs(sp))
        rows += [(d, i, s, e, lab) for i, (s, e, lab) in enumerate(sp)]
    spans = _spans(spark, rows)
    got, in_rows = {}, {}
    for r in T.merge_adjacent(spans).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.entity))
    arrays = spans.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "start", "end", "entity")).alias("e"))
    for r in arrays.select("doc_id", F.inline(T.merged(T.spans_of(F.col("e"), False), False))).collect():
        in_rows.setdefault(r.doc_id, []).append((r.start, r.end, r.entity))
    assert {d: sorted(v) for d, v in got.items()} == want == {d: sorted(v) for d, v in in_rows.items()}


DIGITS = "0123456789"


def test_tag_xml_merges_before_it_drops_overlaps(spark):
    """Hand-computed: spans of one label that overlap are one span; a merged span ends where its last span ends."""
    cases = [([(0, 5, "A"), (3, 8, "A")], "<a>01234567</a>89"),
             ([(0, 9, "A"), (2, 4, "A")], "<a>0123</a>456789"),
             ([(0, 5, "A"), (3, 8, "B")], "<a>01234</a>56789"),
             ([(0, 2, "A"), (3, 5, "A"), (7, 9, "B")], "<a>01234</a>56<b>78</b>9")]
    docs = _docs(spark, [DIGITS] * len(cases))
    rows = [(d, "A", i, lab, 0.9, None, s, e) for d, (spans, _) in enumerate(cases) for i, (s, e, lab) in enumerate(spans)]
    ents = spark.createDataFrame(rows, "doc_id long, tagger string, pos int, entity string, score double, word string, start int, end int")
    got = {r.doc_id: r.tagged_text for r in T.tag_xml(docs, ents).collect()}
    assert got == {d: want for d, (_, want) in enumerate(cases)}


def test_offsets_need_no_word_and_searches_need_no_offsets(spark):
    docs = _docs(spark, [DIGITS])
    kind = "doc_id long, tagger string, pos int, entity string, score double, word string, start int, end int"
    ents = spark.createDataFrame([(0, "A", 0, "PER", 0.9, None, 0, 3), (0, "A", 1, "", 0.9, "4", 4, 5),
                                  (0, "A", 2, "LOC", 0.9, "x", None, 8), (0, "A", 3, None, 0.9, "x", 8, 9)], kind)
    assert T.tag_inline_tokens(docs, ents).first().tagged_text == "<PER>012</PER>3456789"
    assert E.with_span(ents).count() == 1 and E.valid_entities(ents).count() == 0 and E.with_word(ents).count() == 1


def test_search_ignores_case_where_lower_case_is_longer(spark):
    docs = _docs(spark, ["İzmir and IOWA"])
    got = [(r.start, r.end) for r in T.find_offsets(docs, _phr(spark, [(0, 0, "iowa", "GPE")])).collect()]
    assert got == [(10, 14)]


def test_tag_xml_and_inline(spark):
    docs = _docs(spark, ["Joe Doe in Canada"])
    ents = spark.createDataFrame([(0, "A", 0, "PER", 0.9, "Joe", 0, 3), (0, "A", 1, "PER", 0.9, "Doe", 4, 7),
                                  (0, "A", 2, "LOC", 0.9, "Canada", 11, 17)],
                                 "doc_id long, tagger string, pos int, entity string, score double, word string, start int, end int")
    assert T.tag_xml(docs, ents).first().tagged_text == "<per>Joe Doe</per> in <loc>Canada</loc>"
    assert T.tag_inline_tokens(docs, ents).first().tagged_text == "<PER>Joe</PER> <PER>Doe</PER> in <LOC>Canada</LOC>"


def _phr(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pos int, word string, entity string")


def test_cursor_tagging(spark):
    docs = _docs(spark, ["a b a", "a b a"])
    ents = _phr(spark, [(0, 0, "b", "X"), (0, 1, "a", "Y"), (1, 0, "a", "Y"), (1, 1, "b", "X"), (1, 2, "b", "X")])
    got = {r.doc_id: r.tagged_text for r in T.tag_inline_cursor(docs, ents).collect()}
    assert got == {0: "a <X>b</X> <Y>a</Y>", 1: "<Y>a</Y> <X>b</X> a"}


def test_find_offsets(spark):
    docs = _docs(spark, ["Iowa and iowa"])
    ents = _phr(spark, [(0, 0, "iowa", "GPE"), (0, 1, "IOWA", "GPE")])
    got = [(r.start, r.end, r.entity) for r in T.find_offsets(docs, ents).collect()]
    assert got == [(0, 4, "gpe")]


def test_untagged_and_strip_property(spark):
    texts = ["no entities here", "Ann met Bob in Austria 2024", "x  NASA  y", "été Paris"]
    docs = _docs(spark, texts)
    out = T.tag_xml(docs, E.tag_tokens(docs)).orderBy("doc_id")
    rows = out.select("doc_id", "tagged_text", T.strip_tags("tagged_text").alias("plain"), "n_spans").collect()
    assert rows[0].tagged_text == texts[0] and rows[0].n_spans == 0
    assert [r.plain for r in rows] == texts
    assert rows[1].tagged_text == "<per>Ann</per> met <per>Bob</per> in <loc>Austria</loc> <misc>2024</misc>"


def test_token_offsets_cut_their_words(spark):
    docs = _docs(spark, ["Ann  met Béa and Élise Bob", "éé NASA 42"])
    ents = E.tag_tokens(docs).join(docs, "doc_id")
    bad = ents.where(F.expr("substring(text, start + 1, `end` - start)") != F.col("word")).count()
    assert bad == 0 and ents.count() >= 4


def test_label_vocab_and_tokenize(spark):
    ents = spark.createDataFrame([("PER",), ("LOC",), ("PER",), ("",)], "entity string")
    assert sorted(r.token for r in T.label_vocab(ents).collect()) == ["[/LOC_]", "[/PER_]", "[LOC_]", "[PER_]"]
    df = spark.createDataFrame([(0, "<per>Joe</per> ran!")], "doc_id long, t string")
    r = T.tokenize_pad(df, "t", 6).first()
    assert r.tokens == ["<per>", "joe", "</per>", "ran", "!", "[PAD]"] and r.mask == [1, 1, 1, 1, 1, 0]
    got = T.tokenize_pad(df, "t", 2).orderBy("window_no").collect()
    assert [(r.window_no, r.tokens) for r in got] == [(0, ["<per>", "joe"]), (1, ["</per>", "ran"]), (2, ["!", "[PAD]"])]
    assert T.tokenize_pad(spark.createDataFrame([(0, None)], "doc_id long, t string"), "t", 2).first().mask == [0, 0]


def test_words_of_any_script_stay_whole_and_only_fixed_markers_are_markers(spark):
    df = spark.createDataFrame([("Größe café <b>x</b> <loc>Łódź</loc> x2",)], "t string")
    assert df.select(T.tokenize("t").alias("x")).first().x == [
        "größe", "café", "<", "b", ">", "x", "<", "/", "b", ">", "<loc>", "łódź", "</loc>", "x2"]


def test_byte_and_codepoint_insertion_agree(spark):
    texts = ["Émile met Zoë in Austria 😀 NASA 42", "ça  Béatrice ORG\nLine Paris", "", "😀😀 Bob Bob ÉÉ Ann"]
    docs = _docs(spark, texts)
    ents = E.tag_tokens(docs)
    assert "bstart" in ents.columns
    fast = {r.doc_id: (r.tagged_text, r.n_spans) for r in T.tag_xml(docs, ents).collect()}
    slow = {r.doc_id: (r.tagged_text, r.n_spans) for r in T.tag_xml(docs, ents.drop("bstart", "bend")).collect()}
    assert fast == slow
    t1 = {r.doc_id: r.tagged_text for r in T.tag_inline_tokens(docs, ents).collect()}
    t2 = {r.doc_id: r.tagged_text for r in T.tag_inline_tokens(docs, ents.drop("bstart", "bend")).collect()}
    assert t1 == t2 and fast[3][0] == "😀😀 <per>Bob Bob</per> ÉÉ <per>Ann</per>"
