"""Operators 2, 5, 6, 8 and 10: brute force, or accuracy on rows held out."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagframe.llm import language_spans, license_rules, quality_cnn, repetition, toxicity

MID = "/root/testdata/sf0.01"


def auc(label, score):
    rank = pd.Series(score).rank().to_numpy()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def labelled(spark, got, column):
    labels = spark.read.parquet(f"{MID}/labels.parquet").select("doc_id", column)
    return got.where("held_out").join(labels, "doc_id").toPandas()


# ---------------------------------------------------------------- language

@pytest.fixture(scope="module")
def languages(spark):
    return language_spans.fit(language_spans.training_rows(spark.read.parquet(f"{MID}/documents.parquet")))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    got = language_spans.op6_language_spans(spark, MID).where("held_out").join(docs, "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_spans_of_mixed_text(spark, languages):
    en, fr = "the this that was with from are for", "les dans une pour avec des pas que"
    text = f"{en} {en}. {fr} {fr}."
    row = spark.createDataFrame([(text,)], "text string").select(language_spans.label(F.col("text"), languages).alias("r")).first()["r"]
    assert [s["lang"] for s in row["spans"]] == ["en", "fr"]
    assert text[row["spans"][0]["start"]:row["spans"][0]["end"]] == f"{en} {en}"
    assert text[row["spans"][1]["start"]:row["spans"][1]["end"]] == f"{fr} {fr}"


def test_language_of_odd_rows(spark, odd, none, languages):
    got = odd.select("text", language_spans.label(F.col("text"), languages).alias("r")).collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["r"]["lang"] == "und") == (not letters) and 0 <= r["r"]["score"] <= 1
    nothing = language_spans.fit(language_spans.training_rows(none))
    assert nothing["langs"] == []
    assert {r["r"]["lang"] for r in odd.select(language_spans.label(F.col("text"), nothing).alias("r")).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 6, size=4)
        scores, at = rng.normal(size=(counts.sum(), 3)) * 3, 0
        label = language_spans.viterbi(scores, counts, 2.0)
        for n in counts:
            def value(path):
                return sum(scores[at + i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            if n:
                assert abs(value(label[at:at + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-9
            at += n


# ---------------------------------------------------------------- toxicity

@pytest.fixture(scope="module")
def toxic(spark):
    return toxicity.train(spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet"))


def test_toxicity_of_held_out_documents(spark):
    got = labelled(spark, toxicity.op2_noisy_channel(spark, MID), "toxic")
    assert got["score"].between(0, 1).all()
    english = got.merge(spark.read.parquet(f"{MID}/documents.parquet").where("lang = 'en'").select("doc_id").toPandas())
    assert auc(english["toxic"].to_numpy(), english["score"]) > 0.9


@pytest.mark.parametrize("word, want", [("1d10t", "idiot"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("s.c.u.m", "scum"),
                                        ("l-o-s-e-r", "loser"), ("tr@sh!!", "trash!!"), ("the%%%", "the%%%"), ("THE!!", "THE!!"),
                                        ("erstes", "erstes"), ("4.0", "4.0"), ("ordinary", "ordinary")])
def test_restored_words(toxic, word, want):
    assert toxicity.restore_word(word, toxicity.Decoder(*toxic[0])) == want


def test_decoder_finds_the_best_path(toxic):
    """Against all readings of short lattices of look-alikes."""
    decode = toxicity.Decoder(*toxic[0])
    for word in ("1d10t", "m0r0n", "sc4m", "tr45h", "l1st"):
        options = [[(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LOOKALIKE[c]] for c in word]

        def value(path):
            context, cost = decode._emit(0x202020, "".join(x for x, _ in path).encode())
            return cost + sum(c for _, c in path) + decode._logp(context, 32)
        best = max(itertools.product(*options), key=value)
        got = decode(word)
        if got.isalpha() and len(got) == len(word):
            assert got == "".join(x for x, _ in best)


def test_toxicity_of_odd_rows(spark, odd, none, toxic):
    lm, model = toxic
    got = odd.select("text", toxicity.toxicity(F.col("text"), lm, model).alias("r")).collect()
    assert all(0 <= r["r"]["score"] <= 1 for r in got)
    assert len({r["r"]["score"] for r in got if not (r["text"] or "").strip()}) == 1
    hidden = spark.createDataFrame([("You are an 1d10t and a l-o-s-e-r, m 0 r o n, s c u m",)], "text string")
    r = hidden.select(toxicity.toxicity(F.col("text"), lm, model).alias("r")).first()["r"]
    assert "idiot" in r["restored"] and "loser" in r["restored"] and "scum" in r["restored"]
    lm, model = toxicity.train(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["r"]["score"] for r in odd.select(toxicity.toxicity(F.col("text"), lm, model).alias("r")).collect()} == {0.0}


@pytest.mark.parametrize("text, want", [
    ("m 0 r o n", "moron"), ("an i d 1 o t, yes", "an idiot, yes"), ("l o s 3 r!", "loser!"), ("i d ! o t", "idiot"),
    ("l-o-s-3-r", "loser"), ("m.0.r.o.n", "moron"), ("los\u20acr", "loser"), ("\u00a3oser", "loser"),
    ("l o s \u20ac r", "loser"), ("\u0434\u0443\u0443\u0443\u0443\u0440\u0430\u043a", "\u0434\u0443\u0440\u0430\u043a"),
    ("\u0414\u0443\u0423\u0443\u0440\u0430\u043a", "\u0434\u0443\u0440\u0430\u043a"), ("caf\u00e9\u00e9\u00e9\u00e9", "caf\u00e9"),
    ("b + c", "b + c"), ("2 x 4", "2 x 4"), ("1 2 3 4 5", "1 2 3 4 5"), ("\u20ac5 and 5\u20ac", "\u20ac5 and 5\u20ac"),
    ("\u2014\u2014\u2014 plain \u00e9t\u00e9", "\u2014\u2014\u2014 plain \u00e9t\u00e9")])
def test_combined_obfuscation_is_restored(toxic, text, want):
    got = list(toxicity.restored_slices(pa.array(["plain", text]), toxicity.Decoder(*toxic[0])))
    changed = {a + i: t for a, _, _, _, rows in got for i, t in rows.items()}
    assert changed.get(1, text) == want


# ---------------------------------------------------------------- quality

def test_quality_of_held_out_documents(spark):
    got = labelled(spark, quality_cnn.op8_byte_cnn(spark, MID), "quality")
    assert got["score"].between(0, 1).all()
    assert auc(got["quality"].to_numpy(), got["score"]) > 0.9


def test_chunks_cover_every_byte_and_overlap():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 64, 511, 512, 513, 960, 5000]
    buf = rng.integers(1, 255, sum(sizes)).astype(np.uint8)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    block, owner = quality_cnn.chunks(buf, offs)
    for i, n in enumerate(sizes):
        mine = block[owner == i]
        joined = np.concatenate([mine[0]] + [c[quality_cnn.CHUNK - quality_cnn.HOP:] for c in mine[1:]])
        assert (joined[:n] == buf[offs[i]:offs[i + 1]]).all() and not joined[n:].any()


def test_training_separates_marked_texts():
    texts = [b"good words here " * 40, b"bad@@@ bad@@@ " * 50] * 8
    label = np.array([1, 0] * 8)
    net = quality_cnn.train_network(texts, label, epochs=30)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = quality_cnn.probability(np.frombuffer(b"".join(texts), np.uint8), offs, net)
    assert (p[label == 1] > 0.9).all() and (p[label == 0] < 0.1).all()


def test_quality_of_odd_rows(spark, odd, none):
    net = quality_cnn.fit(none.withColumn("label", F.lit(1)))
    assert net == {"base": 0.0}
    assert {r[0] for r in odd.select(quality_cnn.quality(F.col("text"), net)).collect()} == {0.0}
    net = quality_cnn.train_network([b"a b c", b"###"], np.array([1, 0]), epochs=1)
    got = odd.select("text", quality_cnn.quality(F.col("text"), net).alias("p")).collect()
    assert all(0 <= r["p"] <= 1 for r in got)
    assert len({r["p"] for r in got if r["text"] in (None, "")}) == 1


def test_sample_takes_one_row_of_each_drawn_key(spark):
    from tagframe.llm.common import labelled_sample
    docs = spark.createDataFrame([(i % 400, f"t{i}") for i in range(800)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(3, 0), (None, 1)], "doc_id long, label int")
    rows = labelled_sample(docs, labels, 100, "t").collect()
    assert 60 < len(rows) < 140 and len({r["doc_id"] for r in rows}) == len(rows)
    assert labelled_sample(docs, labels, 10_000, "t").count() == 400


# ---------------------------------------------------------------- repetition

def brute_counts(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = [v for v in grams.values() if len(v) > 1]
    covered = {x for v in repeated for i in v for x in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_maximal(words, size=8):
    found = {}
    for i in range(len(words)):
        for j in range(i + size, len(words) + 1):
            found.setdefault(tuple(words[i:j]), []).append(i)
    out = set()
    for s, at in found.items():
        if len(at) > 1:
            left = {words[i - 1] if i else None for i in at}
            right = {words[i + len(s)] if i + len(s) < len(words) else None for i in at}
            if (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                out.add((at[0], len(s), len(at)))
    return out


def test_maximal_repeats_equal_brute_force():
    random.seed(2)
    texts = [" ".join(random.choice("ab") for _ in range(random.randint(5, 60))) for _ in range(60)]
    texts += ["\n".join([" ".join(random.choice(["x", "y", "zé", "#"]) for _ in range(random.randint(0, 12)))
                         for _ in range(random.randint(1, 9))] * random.randint(1, 3)) for _ in range(40)]
    texts += ["the quick brown fox jumps over the lazy dog again " * k for k in range(1, 6)]
    for text, got in zip(texts, repetition.measure(pa.array(texts))):
        assert got[:5] == brute_counts(text)
        want = brute_maximal(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert {(r["start"], r["words"], r["times"]) for r in got[8]} == want
        assert got[5] == max([w for _, w, _ in want], default=0)
        assert got[7] == len(want)


def test_repetition_of_documents_and_odd_rows(odd, none, small):
    for df in (odd, small):
        got = repetition.judge(df.select("text", repetition.repetition(F.col("text")).alias("r")).select("text", "r.*")).collect()
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(r["text"])
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert none.select(repetition.repetition(F.col("text"))).count() == 0


# ---------------------------------------------------------------- licenses

def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    flat = " " + "".join(w + " " for w in words)
    places, base = [], set()
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    hits = []
    if any(g in flat for g in license_rules.GATES):
        for i, (label, gate, pattern, priority) in enumerate(license_rules.rules()):
            if gate in flat:
                hits += [(m.start(), m.end(), priority, i, label) for m in re.finditer(pattern, flat)]
    stay = [x for x in hits if not any(
        y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2]
        and (y[:2] != x[:2] or y[2] > x[2] or y[3] < x[3]) for y in hits)]
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base),
            sorted(base | {x[4] for x in stay}))


LICENSE_TEXTS = [
    "cc by cc by CC BY general public license. All Rights\nReserved", "Licensed under CC BY-NC 4.0.", "x cc byte cc by",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "https://creativecommons.org/licenses/by-sa/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "ÉÀ licence É cc\tby",
    "copyright (c) 2019 foo all rights reserved copyright 2020", "public domain; placed in the public domain. " * 50]


def test_licenses_equal_brute_force(spark, odd, none, small):
    made = spark.createDataFrame([(t,) for t in LICENSE_TEXTS], "text string")
    for df in (made, odd, small):
        for r in license_rules.scan(df).select("text", F.col("license").alias("_l")).collect():
            got = r["_l"]
            assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"],
                    got["labels"]) == brute_license(r["text"])
    assert license_rules.scan(none).count() == 0
    assert len(license_rules.rules()) > 300


def test_license_scores(spark):
    df = spark.createDataFrame([("Released under the MIT License.",), ("nothing",), ("cc by",)], "text string")
    rows = license_rules.scan(df).select(license_rules.score(F.col("license.detections"), F.col("license.n_base")).alias("s")).collect()
    assert [r["s"] for r in rows] == [0.99, 0.0, 0.6]


def drawn(parsed, draw):
    """A random text that a parsed pattern matches, with its lookahead; wide repeats at their least or one more."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":  # a class such as \\S or \\d, or letters
            out += draw.choice(["7" if str(x) == "CATEGORY_DIGIT" else "w" if str(o) == "CATEGORY" else chr(x) for o, x in arg])
        elif name == "BRANCH":
            out += drawn(draw.choice(arg[1]), draw)
        elif name in ("SUBPATTERN", "ASSERT"):
            out += drawn(arg[-1], draw)
        else:
            least, most, body = arg
            out += "".join(drawn(body, draw) for _ in range(draw.randint(least, min(int(most), least + 1))))
    return out


def test_every_match_of_a_rule_has_its_gates():
    draw = random.Random(2)
    for label, gate, pattern, _, literals in license_rules.gated_rules():
        parsed, search = re._parser.parse(pattern), re.compile(pattern).search
        for text in {drawn(parsed, draw) for _ in range(60)}:
            assert search(text), (pattern, text)
            assert gate in text and any(x in text for x in literals), (label, gate, literals, text)
            assert any(g in text for g in license_rules.GATES), (label, text)


def ungated_license(text):
    """Labels of the surviving matches of all rules, no gate asked."""
    flat = "".join(f"{w} " for w in ["", *re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)])
    flat = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in flat)
    hits = [(m.start(), m.end(), p, i, label) for i, (label, _, pattern, p) in enumerate(license_rules.rules())
            for m in re.finditer(pattern, flat)]
    stay = {x[4] for x in hits if not any(
        y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2]
        and (y[:2] != x[:2] or y[2] > x[2] or y[3] < x[3]) for y in hits)}
    return sorted(stay | {label for phrase, label in license_rules.BASE if f" {phrase} " in flat})


UNGATED = {"released under MIT": "mit", "available under EPL 2.0": "epl-2.0", "OSL 3.0": "osl-3.0", "AFL 3.0": "afl-3.0",
           "EUPL 1.2": "eupl-1.2", "Artistic 2.0": "artistic-2.0", "GFDL 1.3": "gfdl-1.3", "CDDL 1.0": "cddl-1.0",
           "ODbL 1.0": "odbl-1.0", "ODbL": "odbl-1.0", "PHP 3.01": "php-3.01", "http://scripts.sil.org/OFL": "ofl-1.1",
           "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
           "All advertising materials mentioning features or use of this software": "bsd-4-clause",
           "Neither the name of the author may be used to endorse or promote products": "bsd-3-clause",
           "It may not be copied in part without written consent": "proprietary", "distributed under the Expat terms": "mit",
           "License: MIT": "mit", "MIT/X11": "mit", "Boost 1.0": "bsl-1.0"}


def test_licenses_equal_all_rules_without_gates(spark, odd, small):
    draw = random.Random(3)
    texts = [*UNGATED, *LICENSE_TEXTS, "Das Haus mit Garten", "a boost for zlib, an open font and an open database"]
    texts += [f"so {drawn(re._parser.parse(pattern), draw)} it is" for _, _, pattern, _ in license_rules.rules()]
    for df in (spark.createDataFrame([(t,) for t in texts], "text string").repartition(8), odd, small):
        got = license_rules.scan(df.select("text")).select("text", "license.labels").collect()
        for r in got:
            assert r["labels"] == ungated_license(r["text"] or ""), r["text"]
            assert r["text"] not in UNGATED or UNGATED[r["text"]] in r["labels"]
            assert r["labels"] == [] or not (r["text"] or "").startswith(("Das Haus", "a boost"))


def test_licenses_of_a_text_dense_with_detections(spark):
    """60,000 detections in one text, none inside another, and as many that a longer one contains."""
    apart = spark.createDataFrame([(1, "copyright x " * 60000)], "doc_id long, text string")
    found = license_rules.scan(apart).select("license.detections").first()[0]
    assert [d["start"] for d in found] == [12 * i for i in range(60000)]
    assert {-d["neg_end"] - d["start"] for d in found} == {10}
    inside = spark.createDataFrame([(1, "all rights reserved gpl copyright 2001 x " * 300)], "doc_id long, text string")
    got = license_rules.scan(inside).select("text", "license.labels", F.size("license.detections").alias("n")).first()
    assert got["labels"] == ungated_license(got["text"]) and got["n"] == 900
