"""Wide phrase labels and their precedence; the training vocabulary; CSV export of lists in literal form."""

import ast

from pyspark.sql import functions as F

from tagframe.operators import features as X
from tagframe.operators import phrase_grammar as G
from tagframe.sources import files, literals


def phrases(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.entity, r.word, r.first_token) for r in G.tag_grammar(df).orderBy("pos").collect()]


def test_every_label_and_precedence(spark):
    assert len(G.LABELS) >= 10
    got = phrases(spark, "On Monday, May 5, 2020 at 10:30 am Sen. John Smith (Wisconsin) paid $5.2 million or 300 euros, "
                         "30 percent and 12% of 40 km, his third: ask NASA or Acme Widgets Corp. See www.x.org, mail a@b.co! "
                         "Germans met Anna Berg on 2020-01-31; 17 people; 2 million more; June 1999.")
    assert [(e, w) for e, w, _ in got] == [
        ("DATE", "Monday May 5 2020"), ("TIME", "10:30 am"), ("PERSON", "Sen John Smith"), ("GPE", "Wisconsin"),
        ("MONEY", "$5.2 million"), ("MONEY", "300 euros"), ("PERCENT", "30 percent"), ("PERCENT", "12%"), ("QUANTITY", "40 km"),
        ("ORDINAL", "third"), ("ORG", "NASA"), ("ORG", "Acme Widgets Corp"), ("URL", "www.x.org"), ("EMAIL", "a@b.co"),
        ("NORP", "Germans"), ("PERSON", "Anna Berg"), ("DATE", "2020-01-31"), ("CARDINAL", "17"), ("CARDINAL", "2 million"), ("DATE", "June 1999")]
    assert got[0][2] == 1 and {e for e, _, _ in got} == set(G.LABELS)


def test_marks_end_a_phrase(spark):
    assert phrases(spark, "John. Smith") == []
    assert phrases(spark, "5 May, 2020") == [("DATE", "5 May", 0), ("CARDINAL", "2020", 2)]
    assert phrases(spark, "May 5; 2020") == [("DATE", "May 5", 0), ("CARDINAL", "2020", 2)]
    assert phrases(spark, "(((") == phrases(spark, "") == phrases(spark, None) == []


def test_classes_match_their_gate(spark):
    """No token that has a class fails the cheap first look."""
    words = [w for _, r in G.CLASSES if not isinstance(r, str) for w in r] + [
        "a@b.c", "http://x", "www.x", "2020-01-01", "1/2/20", "1:20", "$5", "€5k", "5%", "3rd", "third", "7", "1984", "1.5", "NATO", "Ann"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert df.where(G.token_class(F.col("w")) == G.OTHER).collect() == []


def test_vocabulary_is_that_of_training(spark):
    train = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, ""), (2, None)], "doc_id long, entity string")
    vocab = X.fit_vocabulary(train)
    ids = {r.label: r.feature_id for r in vocab.collect()}
    assert set(ids) == {"a", "b"} and sorted(ids.values()) == [0, 1]
    rows = spark.createDataFrame([(5, 1), (6, 0), (7, 1)], "doc_id long, label_binary int")
    test = spark.createDataFrame([(5, "a"), (5, "a"), (5, "new"), (6, "new"), (9, "a")], "doc_id long, entity string")
    got = {r.doc_id: [(e.feature_id, e.n) for e in r.features] for r in X.sparse_features(rows, test, vocab).collect()}
    assert got == {5: [(ids["a"], 2)], 6: [], 7: []}
    assert X.fit_vocabulary(train.where("false")).count() == 0


def test_csv_export_reads_back_as_literals(spark, tmp_path):
    kind = ("id int, ents array<struct<entity:string,score:double,index:int,word:string,start:int,end:int>>, "
            "m map<string,boolean>, s struct<a:array<int>,b:string>")
    rows = [(1, [("PER", 0.5, 1, "O'Brien \"x\"\n\\", 0, 7), ("LOC", None, 2, "é", None, 3)], {"k'": True, "z": None}, ([1, None], "t")),
            (2, [], {}, (None, None)), (3, None, None, None)]
    out = str(tmp_path / "csv")
    files.write_table(spark.createDataFrame(rows, kind), out, fmt="csv")
    back = {r.id: r for r in spark.read.csv(out, header=True, escape='"', multiLine=True, inferSchema=True).collect()}
    for i, ents, m, s in rows:
        fields = ("entity", "score", "index", "word", "start", "end")
        assert ast.literal_eval(back[i].ents) == (None if ents is None else [dict(zip(fields, e)) for e in ents])
        assert ast.literal_eval(back[i].m) == m
        assert ast.literal_eval(back[i].s) == (None if s is None else dict(zip("ab", s)))
    raw = spark.read.csv(out, header=True, escape='"', multiLine=True).where("id = '1'")
    parsed = literals.parse_entities(raw, "ents", "parsed", mode="raise").first().parsed
    assert [(e.entity, e.word, e.start) for e in parsed] == [("PER", "O'Brien \"x\"\n\\", 0), ("LOC", "é", None)]


def test_plain_words_take_the_short_path():
    """A word of the short path has no class and no mark; listed words, capitals, digits and marks go the long way."""
    import re

    from tagframe.operators import phrase_grammar as G
    plain, comma = (re.compile(p.replace("\\z", "\\Z")) for p in (G.PLAIN, G.PLAIN_COMMA))
    assert all(plain.match(w) for w in ("word", "über", "hundredfold", "well-known", "日本", "https"))
    assert all(comma.match(w) for w in ("word,", "über,", "percentage,"))
    for w in ("hundred", "first", "km", "am", "Word", "x1", "a@b.de", "https://x", "www.x", "end.", "(word", "$5", "", "word,", "it's"):
        assert not plain.match(w)
    for w in ("hundred,", "percent,", "word", "word,,", "Word,", ",", "(word,", "www.x,"):
        assert not comma.match(w)
