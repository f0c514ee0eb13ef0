"""Operator 10: license scans by ordered signature rules, in DataFrame functions only.

A text is reduced to its lower-case words, one space around each. Rules are
regular expressions over that form, each gated by literals that its matches must
contain; the gates only save work. They are hand-written where a license has its own sentences, and otherwise built
from the license's name and the ways to refer to one (``rules()``, some hundreds).
A detection is suppressed if a detection of the same or a higher priority
contains it; of equal spans the higher priority and then the earlier rule stays.

Everything is local to the row: no shuffle, no Python in the tasks. Texts without
any rule's literals (``contains``) never reach a regular expression but the one
that finds the words.

Defined results: a null or empty text has no words, no places, empty label
strings and score 0; repeated rows are scanned each; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents

#: Base phrases and their labels (fixed by the operator's contract).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FULL, NAMED, GENERIC = 3, 2, 1
WEIGHT = {FULL: 0.99, NAMED: 0.9, GENERIC: 0.6}

#: label, pattern of the name, literal in every match of it, words of the license's address (or None), words of its
#: SPDX name, literals of which every match of the name and the spaces around it has at least one.
LICENSES = (
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1", "apache", "apache org licenses license 1 1", "apache 1 1", ("apache",)),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache", "apache org licenses license 2 0", "apache 2 0", ("apache",)),
    ("mit", r"(?:mit|expat)(?: x11)?", "t", "opensource org licenses mit", "mit", (" mit ", " expat ")),
    ("isc", r"isc", "isc", "opensource org licenses isc", "isc", (" isc ",)),
    ("bsd-2-clause", r"(?:simplified bsd|bsd(?: license)? 2 clause|2 clause bsd|two clause bsd|freebsd)", "bsd", "opensource org licenses bsd 2 clause", "bsd 2 clause", ("bsd",)),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd(?: license)? 3 clause|3 clause bsd|three clause bsd)", "bsd", "opensource org licenses bsd 3 clause", "bsd 3 clause", ("bsd",)),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd", None, "bsd 4 clause", ("bsd",)),
    ("0bsd", r"(?:0bsd|zero clause bsd)", "bsd", "opensource org licenses 0bsd", "0bsd", ("bsd",)),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?", "1", "gnu org licenses old licenses gpl 1 0", "gpl 1 0(?: only| or later)?", ("general public license", "gpl")),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", "2", "gnu org licenses old licenses gpl 2 0", "gpl 2 0(?: only| or later)?", ("general public license", "gpl")),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", "3", "gnu org licenses gpl 3 0", "gpl 3 0(?: only| or later)?", ("general public license", "gpl")),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl)(?: version| v)? ?2(?: 0)?", "2", None, "lgpl 2 0(?: only| or later)?", ("general public license", "gpl")),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1", "2 1", "gnu org licenses old licenses lgpl 2 1", "lgpl 2 1(?: only| or later)?", ("general public license", "gpl")),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", "3", "gnu org licenses lgpl 3 0", "lgpl 3 0(?: only| or later)?", ("general public license", "gpl")),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?", "3", "gnu org licenses agpl 3 0", "agpl 3 0(?: only| or later)?", ("general public license", "gpl")),
    ("gfdl-1.3", r"(?:gnu )?(?:free documentation license|fdl|gfdl)(?: version| v)? ?1 [123]", "1", "gnu org licenses fdl", "gfdl 1 3", ("free documentation license", "fdl")),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version| v)? ?1 1", "1 1", "mozilla org mpl 1 1", "mpl 1 1", ("mozilla public license", " mpl")),
    ("mpl-2.0", r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", "2", "mozilla org mpl 2 0", "mpl 2 0", ("mozilla public license", " mpl")),
    ("epl-1.0", r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", "1", "eclipse org legal epl v10", "epl 1 0", ("eclipse public license", " epl")),
    ("epl-2.0", r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", "2", "eclipse org legal epl 2 0", "epl 2 0", ("eclipse public license", " epl")),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?: version| v)?(?: ?1(?: 0)?)?", "c", None, "cddl 1 0", ("common development and distribution license", "cddl")),
    ("cpl-1.0", r"(?:common public license|cpl)(?: version| v)? ?1(?: 0)?", "1", None, "cpl 1 0", ("common public license", " cpl")),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version| v)?(?: ?1 [12])?", "eu", None, "eupl 1 2", ("european union public licen", "eupl")),
    ("osl-3.0", r"(?:open software license|osl)(?: version| v)? ?3(?: 0)?", "3", None, "osl 3 0", ("open software license", " osl")),
    ("afl-3.0", r"(?:academic free license|afl)(?: version| v)? ?3(?: 0)?", "3", None, "afl 3 0", ("academic free license", " afl")),
    ("artistic-1.0", r"artistic(?: license)?(?: version| v)? ?1(?: 0)?", "artistic", None, "artistic 1 0", ("artistic",)),
    ("artistic-2.0", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?", "artistic", None, "artistic 2 0", ("artistic",)),
    ("bsl-1.0", r"boost(?: software)?(?: license)?(?: version| v)?(?: ?1 0)?", "boost", "boost org license 1 0", "bsl 1 0", ("boost",)),
    ("busl-1.1", r"business source(?: license)?(?: version| v)?(?: ?1 1)?", "business source", "mariadb com bsl11", "busl 1 1", ("business source",)),
    ("sspl-1.0", r"(?:server side public license|sspl)(?: version| v)?(?: ?1)?", "s", None, "sspl 1 0", ("server side public license", "sspl")),
    ("elastic-2.0", r"elastic(?: license)?(?: version| v)? ?2(?: 0)?", "elastic", None, "elastic 2 0", ("elastic",)),
    ("ms-pl", r"(?:microsoft public|ms pl)", "m", None, "ms pl", ("microsoft public", " ms pl ")),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", "m", None, "ms rl", ("microsoft reciprocal", " ms rl ")),
    ("zlib", r"zlib(?: libpng)?", "zlib", None, "zlib", ("zlib",)),
    ("psf-2.0", r"(?:python software foundation|psf)", "p", None, "psf 2 0", ("python software foundation", " psf ")),
    ("php-3.01", r"php(?: license)?(?: version| v)? ?3 0?1", "php", "php net license 3 01", "php 3 01", (" php",)),
    ("ruby", r"ruby", "ruby", None, "ruby", (" ruby ",)),
    ("openssl", r"openssl", "openssl", None, "openssl", ("openssl",)),
    ("unlicense", r"unlicense", "unlicense", "unlicense org", "unlicense", ("unlicense",)),
    ("wtfpl", r"wtfpl", "wtfpl", "wtfpl net", "wtfpl", ("wtfpl",)),
    ("ofl-1.1", r"(?:sil )?open font(?: license)?(?: version| v)?(?: ?1 1)?", "open font", "scripts sil org ofl", "ofl 1 1", ("open font",)),
    ("ncsa", r"(?:university of illinois ncsa|ncsa)", "ncsa", None, "ncsa", ("ncsa",)),
    ("postgresql", r"postgresql", "postgresql", None, "postgresql", ("postgresql",)),
    ("curl", r"curl", "curl", None, "curl", (" curl ",)),
    ("vim", r"vim", "vim", None, "vim", (" vim ",)),
    ("odbl-1.0", r"(?:open database|odbl)(?: license)?(?: version| v)?(?: ?1 0)?", "o", "opendatacommons org licenses odbl", "odbl 1 0", ("open database", "odbl")),
    ("odc-by-1.0", r"(?:open data commons attribution|odc by)(?: license)?(?: version| v)?(?: ?1 0)?", "o", "opendatacommons org licenses by", "odc by 1 0", ("open data commons attribution", " odc by")),
    ("pddl-1.0", r"(?:public domain dedication and license|pddl)", "p", "opendatacommons org licenses pddl", "pddl 1 0", ("public domain dedication", "pddl")),
    ("cc0-1.0", r"(?:creative commons zero|creative commons cc0|cc0|cc zero)(?: ?1 0)?", "c", "creativecommons org publicdomain zero 1 0", "cc0 1 0", ("creative commons", "cc0", "cc zero")),
)
#: Creative Commons: elements and the words that spell them out; versions are below.
CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
      ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
      ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
#: Every reference to Creative Commons by its elements begins with one of these.
CC_LITERALS = ("creative commons", "cc by", "ccby", "cc attribution", "ccattribution")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Names that without a version also are ordinary words (German "mit"): bare, they are no reference to a license.
ORDINARY = ("mit", "zlib", "bsl-1.0", "busl-1.1", "ofl-1.1", "odbl-1.0")

#: Sentences of the licenses themselves and of common notices: label, literal in every match, pattern, priority, and
#: where that literal is a common word, literals of which every match has one.
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: \S+){0,40}", FULL),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", FULL),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", FULL),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products", FULL),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software", FULL),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license", FULL),
    ("gpl", "you can redistribute it", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", FULL),
    ("lgpl", "lesser general public", r"redistribute it and or modify it under the terms of the gnu lesser general public license", FULL),
    ("agpl", "affero general public", r"redistribute it and or modify it under the terms of the gnu affero general public license", FULL),
    ("mpl-2.0", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license", FULL),
    ("zlib", "provided as is without any express", r"this software is provided as is without any express or implied warranty", FULL),
    ("bsl-1.0", "boost software license", r"distributed under the boost software license", FULL),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", FULL),
    ("wtfpl", "what the fuck you want", r"do what the fuck you want to public license", FULL),
    ("cc0-1.0", "dedicated the work", r"dedicated the work to the public domain", FULL),
    ("ofl-1.1", "open font license", r"licensed under the sil open font license", FULL),
    ("public-domain", "public domain", r"(?:released into|placed in|dedicated to|is in|part of) the public domain", NAMED),
    ("public-domain", "public domain", r"public domain", GENERIC),
    ("creative-commons", "creative commons", r"creative commons(?: licen[cs]e)?", GENERIC),
    ("warranty-disclaimer", "without warranty", r"(?:as is )?without warranty of any kind", GENERIC),
    ("warranty-disclaimer", "merchantability", r"merchantability (?:and|or) fitness for a particular purpose", GENERIC),
    ("proprietary", "proprietary", r"proprietary and confidential", NAMED),
    ("proprietary", "proprietary", r"(?:this|the) (?:software|document|material|work|content) is proprietary", NAMED),
    ("proprietary", "confidential", r"confidential and proprietary", NAMED),
    ("proprietary", "may not be", r"may not be (?:copied|reproduced|distributed)(?: \S+){0,8} without (?:\S+ ){0,4}(?:permission|consent)", NAMED,
     ("may not be copied", "may not be reproduced", "may not be distributed")),
    ("odbl-1.0", "odbl", r"odbl", NAMED),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?", NAMED),
    ("copyright", "copyright", r"copyright(?: c)?(?: notice)?", GENERIC),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", NAMED),
    ("gpl", "gpl", r"(?:gnu )?gpl", GENERIC),
    ("gpl", "general public license", r"(?:gnu )?general public license", GENERIC),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", GENERIC),
    ("agpl", "agpl", r"(?:gnu )?agpl", GENERIC),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", GENERIC),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", GENERIC),
    ("see-license", "licen", r"see (?:the )?(?:accompanying |included |attached )?licen[cs]e(?: file| txt| md)?", GENERIC),
    ("licensed", "under", r"(?:licensed|released) under", GENERIC, ("licensed under", "released under")),
)


def gated_rules() -> list[tuple[str, str, str, int, tuple[str, ...]]]:
    """Ordered ``(label, gate, pattern, priority, literals)``; patterns match from the space before their first word.

    A match and the space after it contain ``gate`` and at least one of ``literals``.
    """
    under = (r"(?:licensed|released|distributed|available|provided|published|covered|governed|redistributed|made available)"
             r"(?: \S+){0,6}? under(?: the)?(?: terms of)?(?: the)? ")
    known = list(LICENSES)
    for kind, spelled in CC:
        words = kind.replace("-", " ")
        for version in CC_VERSIONS:
            v = version.replace(".", " ")
            known.append((f"cc-{kind}-{version}", rf"(?:creative commons |cc ?)(?:{words}|{spelled})(?: licen[cs]e)?(?: version| v)? ?{v}",
                          v, f"creativecommons org licenses {words} {v}", f"cc {words} {v}", CC_LITERALS))
    sentences = [(label, gate, rf" {pattern}(?= )", priority, literals[0] if literals else (gate,))
                 for label, gate, pattern, priority, *literals in SENTENCES]
    out = [s for s in sentences if s[3] == FULL]
    for label, name, gate, address, spdx, literals in known:
        out.append((label, "spdx", rf" spdx license identifier {spdx}(?= )", FULL, ("spdx",)))
        out.append((label, gate, rf" {under}{name}(?: (?:public )?licen[cs]e)?(?= )", FULL, literals))
        out.append((label, gate, rf" {name} (?:public )?licen[cs]ed?(?= )", NAMED, literals))
        if label in ORDINARY:  # the version must be there, or the word license before the name
            out.append((label, gate, rf" {name[:-1]}(?= )", NAMED, literals))
            out.append((label, gate, rf" licen[cs]e[ds]? (?:is |type )?{name}(?= )", NAMED, literals))
        elif name[-1] in "?0123456789]":  # a version makes the bare name specific enough
            out.append((label, gate, rf" {name}(?= )", NAMED, literals))
        if address:
            first = address.split(" ")[0]
            out.append((label, first, rf" {address}(?= )", FULL, (f" {first} ",)))
    for kind, spelled in CC:  # no version given
        words = kind.replace("-", " ")
        out.append((f"cc-{kind}", "c", rf" (?:creative commons|cc) (?:{words}|{spelled})(?: licen[cs]e)?(?= )", GENERIC, CC_LITERALS))
    return out + [s for s in sentences if s[3] != FULL]


def rules() -> list[tuple[str, str, str, int]]:
    """Ordered ``(label, gate, pattern, priority)``."""
    return [r[:4] for r in gated_rules()]


def _gates() -> tuple[str, ...]:
    """The literals of all rules and the base phrases, without those that contain another one."""
    every = {g for r in gated_rules() for g in r[4]} | {f" {p} " for p, _ in BASE}
    return tuple(sorted(g for g in every if not any(h != g and h in g for h in every)))


#: A text without one of these has no match of any rule.
GATES = _gates()


def canonical(text: Column) -> Column:
    """The words of a text with one space around each, capitals kept; a space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")), F.lit(" ")), NOT_WORD, " ")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join) -> Column:
    """``join`` over all values up to each place, by doubling: as many passes as the length has binary digits."""
    digits = F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int")

    def doubled(v, k):
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(v, lambda x, i: F.when(i >= back, join(x, F.get(v, i - back))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), digits), values, doubled)


def detections(words: Column) -> Column:
    """Array of ``(start, neg_end, neg_priority, rule, label)`` of all rules, by character of the canonical text."""
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(gate).alias("gate"),
                               F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority"),
                               F.array(*map(F.lit, literals)).alias("literals"))
                      for i, (label, gate, pattern, priority, literals) in enumerate(gated_rules())])
    hit = F.filter(table, lambda r: F.contains(words, r["gate"]) & F.exists(r["literals"], lambda g: F.contains(words, g))
                   & F.rlike(words, r["pattern"]))

    def places(r):
        between, found = F.split(words, r["pattern"]), F.regexp_extract_all(words, r["pattern"], F.lit(0))
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(
            F.length(g) + F.length(m), F.length(m)).cast("struct<reach:int,length:int>"))

        def spans(pairs):
            ends = running(F.transform(pairs, lambda x: x["reach"]), lambda later, earlier: later + earlier)
            return F.zip_with(ends, pairs, lambda end, x: F.struct(
                (end - x["length"]).alias("start"), (-end).alias("neg_end"), (-r["priority"]).alias("neg_priority"),
                r["rule"].alias("rule"), r["label"].alias("label")))

        return let(steps, spans)

    return F.flatten(F.transform(hit, places))


def surviving(found: Column) -> Column:
    """Detections that no detection of the same or a higher priority contains.

    In order of (start, end descending, priority descending, rule) every container
    comes first, so the furthest end of each priority so far decides.
    """
    def keep(ordered):
        ends = F.transform(ordered, lambda d: F.struct(*[
            F.when(-d["neg_priority"] >= p, -d["neg_end"]).otherwise(-1).alias(f"e{p}") for p in (1, 2, 3)]))
        reach = running(ends, lambda x, y: F.struct(*[F.greatest(x[e], y[e]).alias(e) for e in ("e1", "e2", "e3")]))

        def stays(d, i, before):
            own = -d["neg_priority"]
            furthest = F.when(own == 3, before["e3"]).when(own == 2, before["e2"]).otherwise(before["e1"])
            return (i == 0) | (furthest < -d["neg_end"])

        return let(reach, lambda m: F.filter(ordered, lambda d, i: stays(d, i, F.get(m, i - 1))))

    return let(F.array_sort(found), lambda ordered: F.when(F.size(ordered) < 2, ordered).otherwise(keep(ordered)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``detections`` (surviving ones) and the base places in a struct ``license``."""
    kind = "array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>>"
    cased = docs.withColumn("_cased", canonical(F.col(text)))
    n_words = (_spaces(F.col("_cased")) - 1).cast("long")
    gated = cased.select(*docs.columns, n_words.alias("_n"), F.when(
        _any_of(F.lower("_cased")), F.translate("_cased", UPPER, LOWER)).alias("_words"))
    words = F.col("_words")
    parts = gated.select(*docs.columns, "_n", "_words", *[F.when(F.contains(words, F.lit(f" {p} ")), F.split(words, f" {p}(?= )"))
                                                         .alias(f"_p{i}") for i, (p, _) in enumerate(BASE)],
                         F.when(words.isNotNull(), surviving(detections(words))).alias("_found"))
    count = [F.when(F.col(f"_p{i}").isNull(), 0).otherwise(F.size(f"_p{i}") - 1)
             for i in range(len(BASE))]
    first = F.least(*[F.length(F.get(f"_p{i}", F.lit(0))) for i in range(len(BASE))])
    last = F.greatest(*[F.length("_words") - F.length(F.element_at(f"_p{i}", -1)) - (len(p) + 1) for i, (p, _) in enumerate(BASE)])
    word_of = lambda at: _spaces(F.substring(words, F.lit(1), at)).cast("long")
    base = F.array_compact(F.array(*[F.when(F.col(f"_p{i}").isNotNull(), F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    found = F.coalesce(F.col("_found"), F.array().cast(kind))
    return parts.select(*docs.columns, F.struct(
        F.col("_n").alias("n_words"), sum(count).cast("long").alias("n_base"), word_of(first).alias("first_word"),
        word_of(last).alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, F.transform(found, lambda d: d["label"])))).alias("labels"),
        found.alias("detections")).alias("license"))


def _any_of(low: Column) -> Column:
    """Whether a text has one of the gates; the array binds it, so it is evaluated once."""
    gates = F.array(*map(F.lit, GATES))
    return F.get(F.transform(F.array(low), lambda t: F.exists(gates, lambda g: F.contains(t, g))), F.lit(0))


def score(found: Column, n_base: Column) -> Column:
    """Weight of the strongest surviving detection; a base phrase alone counts as a generic one."""
    weight = F.transform(found, lambda d: F.when(d["neg_priority"] == -FULL, F.lit(WEIGHT[FULL]))
                         .when(d["neg_priority"] == -NAMED, F.lit(WEIGHT[NAMED])).otherwise(F.lit(WEIGHT[GENERIC])))
    return F.coalesce(F.array_max(weight), F.when(n_base > 0, F.lit(WEIGHT[GENERIC])), F.lit(0.0))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "license.*")
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), score(F.col("detections"), F.col("n_base")).alias("score"))
