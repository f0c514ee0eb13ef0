"""Golden cases for label maps, display strings and entity-literal parsing."""

import pytest
from pyspark.sql import functions as F

from tagframe.functions import labels as L
from tagframe.sources import literals as LIT


def test_label_maps(spark):  # fixed values: the label classes and the out-of-range mark
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 3, 4, 5, 6, None]], "label int")
    rows = df.select("label", L.label_isin("label").alias("a"), L.label_three_way("label").alias("b"),
                     L.label_status("label").alias("s"), L.label_inverted("label").alias("c")).collect()
    got = {r.label: (r.a, r.b, r.s, r.c) for r in rows}
    for v in (0, 1, 2):
        assert got[v] == (0, 0, "ok", 1)
    for v in (3, 4, 5):
        assert got[v] == (1, 1, "ok", 0)
    assert got[6] == (0, None, "Out-Of-Range", 0)
    assert got[None] == (0, None, "Out-Of-Range", 0)


def test_entity_display_matches_python_repr(spark):
    cases = [("Ann", "PER"), ("Lee's", "PER"), ("say \"x\" it's", "X")]
    df = spark.createDataFrame(cases, "word string, entity string")
    got = [r[0] for r in df.select(L.entity_display("word", "entity")).collect()]
    assert got == [repr(c) for c in cases]


def test_class_map(spark):
    df = spark.createDataFrame([(1,), (0,)], "y int")
    got = [tuple(r) for r in df.select(L.class_map("y")["1"], L.class_map("y")["0"]).collect()]
    assert got == [(True, False), (False, True)]


# The literal forms that stored entity lists have.
LITERALS = [
    ("[{'entity': 'PER', 'score': 0.99, 'index': 1, 'word': 'ĠAnn', 'start': 0, 'end': 3}]",
     [("PER", 0.99, 1, "ĠAnn", 0, 3)]),
    ("[{'word': \"Ann Lee's\", 'entity': 'PERSON'}]", [("PERSON", None, None, "Ann Lee's", None, None)]),
    ("[{'word': 'say \"it\\'s\"', 'entity': 'X'}]", [("X", None, None, 'say "it\'s"', None, None)]),
    ("[{'word': 'a\\xa0b', 'entity': 'X'}]", [("X", None, None, "a b", None, None)]),
    ("[{'word': None, 'entity': 'X'}]", [("X", None, None, None, None, None)]),
    ("[]", []),
]


def test_parse_entities_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LITERALS)], "id int, raw string")
    out = LIT.parse_entities(df, "raw", mode="keep").orderBy("id").collect()
    for r, (_, want) in zip(out, LITERALS):
        got = [(e["entity"], e["score"], e["index"], e["word"], e["start"], e["end"]) for e in r.entities]
        assert got == want


def test_parse_modes(spark):
    df = spark.createDataFrame([(0, "[]"), (1, "not a list"), (2, None)], "id int, raw string")
    keep = LIT.parse_entities(df, "raw", mode="keep").orderBy("id").collect()
    assert keep[0].entities == [] and keep[1].entities is None and keep[2].entities is None
    assert [r.id for r in LIT.parse_entities(df, "raw", mode="skip").collect()] == [0]
    with pytest.raises(Exception):
        LIT.parse_entities(df, "raw", mode="raise").collect()


def test_literal_round_trip(spark):
    df = spark.createDataFrame([(1, "[{'entity': 'PER', 'score': 0.75, 'index': 3, 'word': 'Ann', 'start': 4, 'end': 7}]")],
                               "id int, raw string")
    p = LIT.parse_entities(df, "raw", mode="raise")
    back = p.select(LIT.to_literal("entities").alias("t")).first().t
    assert back == df.first().raw


def test_control_characters_round_trip(spark):
    import ast
    words = ["a\nb", "tab\there", "nul\x00x", "back\\slash", "it's \"q\"", "nb\xa0sp", "\r\x1b\x7f", "é😀"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    arr = F.array(F.struct(F.lit("X").alias("entity"), F.lit(0.5).alias("score"), F.lit(1).alias("index"), F.col("word"),
                           F.lit(0).alias("start"), F.lit(1).alias("end")))
    lit = df.select("word", LIT.to_literal(arr).alias("raw"), L.entity_display("word", F.lit("X")).alias("d"))
    for r in lit.collect():
        assert ast.literal_eval(r.raw)[0]["word"] == r.word and r.d == repr((r.word, "X"))
    back = LIT.parse_entities(lit, "raw", mode="raise").select("word", F.col("entities")[0]["word"].alias("w")).collect()
    assert all(r.word == r.w for r in back)


def test_csv_columns_by_name(spark, tmp_path):
    from tagframe.sources import files
    (tmp_path / "a.csv").write_text('label,statement\n1,"90 percent, ""so they say"""\n')
    (tmp_path / "b.csv").write_text('statement,extra,label\n"90 percent, ""so they say""",x,1\n')
    for name in ("a.csv", "b.csv"):
        r = files.read_statements(spark, str(tmp_path / name)).collect()
        assert [tuple(x) for x in r] == [('90 percent, "so they say"', 1)]
    (tmp_path / "c.csv").write_text("text,label\nx,1\n")
    with pytest.raises(ValueError, match="statement"):
        files.read_statements(spark, str(tmp_path / "c.csv"))


def test_prediction_export(spark, tmp_path):
    from tagframe.sources import files
    (tmp_path / "p.csv").write_text("statement,label,label_binary,A_raw_entities,B_raw_entities,prediction,confidence\n"
                                    "a b,1,0,[],[],1,0.75\n")
    r = files.read_predictions(spark, str(tmp_path / "p.csv"), "xml").first()
    assert (r.run, r.label_binary, r.prediction, r.confidence) == ("xml", 0, 1, 0.75)


def test_read_tagged_csv(spark, tmp_path):
    from tagframe.sources import files
    p = tmp_path / "tagged.csv"
    p.write_text(
        "statement,label,label_binary,A_raw_entities,B_raw_entities\n"
        "\"Ann Lee's dog, Rex\",5,1,\"[{'entity': 'PER', 'score': 0.99, 'index': 1, 'word': 'ĠAnn', 'start': 0, 'end': 3}]\","
        "\"[{'word': \"\"Ann Lee's\"\", 'entity': 'PERSON'}]\"\n"
        "plain,1,0,[],[]\n"
        "bad,0,0,not a list,[]\n")
    df = files.read_tagged(spark, str(p), mode="keep").collect()
    assert df[0].statement == "Ann Lee's dog, Rex" and df[0].label_binary == 1
    assert df[0].A_raw_entities_parsed[0]["word"] == "ĠAnn"
    assert df[0].B_raw_entities_parsed[0]["word"] == "Ann Lee's"
    assert df[1].A_raw_entities_parsed == [] and df[2].A_raw_entities_parsed is None
    assert files.read_tagged(spark, str(p), mode="skip").count() == 2
