"""Entity extraction (native rule taggers), sub-word merging and cleaning.

A tagger is an expression over the text: ``token_entities`` and
``phrase_entities`` return the document's entity list as an array, so tagging
and everything that works on one document stays in its row, without a shuffle.
The long form ``(doc_id, tagger, pos, entity, score, word, start, end)`` is that
array exploded; ``pos`` is the position in the tagger's list (the token tagger
adds UTF-8 byte offsets ``bstart``/``bend`` of the same spans). Sub-word merging
groups entity rows, never text, by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagframe.operators.token_scan import scanner

# Token rules of the native token tagger "A" (classes PER/ORG/LOC/MISC).
# First match wins; ASCII classes and \z so that Java and RE2 agree.
TOKEN_RULES = (
    ("MISC", 0.95, r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\z"),
    ("MISC", 0.9, r"^[0-9]+\z"),
    ("ORG", 0.85, r"^[A-Z]{2,}\z"),
    ("LOC", 0.8, r"^[A-Z][a-z]+(ia|land|stan|burg|ton)\z"),
    ("PER", 0.75, r"^[A-Z][a-z]+\z"),
)

# Phrase patterns of the native phrase tagger "B", in alternation order.
PHRASE_RULES = (
    ("CARDINAL", "[0-9]+"),
    ("PERSON", "[A-Z][a-z]+ [A-Z][a-z]+"),
    ("ORG", "[A-Z]{2,}"),
)

# The tag set of tagger A, in report order.
TAGS_A = ("PER", "LOC", "MISC", "ORG")
# The tag set of tagger B.
TAGS_B = tuple(name for name, _ in PHRASE_RULES)

# Sub-word markers.
BYTE_LEVEL_MARK = "Ġ"  # U+0120, word-start mark of byte-level tokenizers
WORDPIECE_MARK = "##"
PIECE_LEN = 6


ENTITY = ("array<struct<pos:int,entity:string,score:double,word:string,start:int,end:int,bstart:int,bend:int>>")


def token_entities(text) -> Column:
    """N1 as an expression: entities of tagger A, with code-point and UTF-8 byte offsets; null for a null text.

    First matching rule of ``TOKEN_RULES`` for every token between single spaces;
    one linear scan of the text's bytes (``token_scan``).
    """
    t = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(scanner(TOKEN_RULES), ENTITY, F.ArrowUDFType.SCALAR)(t)


def tag_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whitespace tokens → token entities of tagger A, one row each; local to the document's row."""
    return docs.select(key, F.inline(token_entities(text))).select(
        key, F.lit("A").alias("tagger"), "pos", "entity", "score", "word", "start", "end", "bstart", "bend")


def phrase_pattern() -> str:
    return "|".join(f"({p})" for _, p in PHRASE_RULES)


def phrase_entities(text) -> Column:
    """N6 as an expression: phrases of tagger B in text order, ``array<struct<pos, entity, word>>``."""
    t = F.col(text) if isinstance(text, str) else text

    def label(word):
        out = None
        for name, pat in PHRASE_RULES:
            cond = word.rlike(f"^({pat})\\z")
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
        return out

    return F.transform(F.regexp_extract_all(t, F.lit(phrase_pattern()), F.lit(0)), lambda w, i: F.struct(
        i.cast("int").alias("pos"), label(w).alias("entity"), w.alias("word")))


def tag_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrase tagger B; matches in text order, no offsets (like the phrase tagger)."""
    none = F.lit(None)
    return docs.select(key, F.inline(phrase_entities(text))).select(
        key, F.lit("B").alias("tagger"), "pos", "entity", none.cast("double").alias("score"), "word",
        none.cast("int").alias("start"), none.cast("int").alias("end"),
        none.cast("int").alias("bstart"), none.cast("int").alias("bend"))


def tag_all(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both taggers in one long table with a ``tagger`` column; each text is read once."""
    none = F.lit(None)

    def of(tagger, ents, offsets: bool):
        return F.coalesce(F.transform(ents, lambda e: F.struct(
            F.lit(tagger).alias("tagger"), e["pos"].alias("pos"), e["entity"].alias("entity"),
            (e["score"] if offsets else none.cast("double")).alias("score"), e["word"].alias("word"),
            *[(e[c] if offsets else none.cast("int")).alias(c) for c in ("start", "end", "bstart", "bend")])), F.array())
    return docs.select(key, F.inline(F.concat(of("A", token_entities(text), True), of("B", phrase_entities(text), False))))


def tagger_counts(docs: DataFrame, ents: DataFrame, key: str = "doc_id") -> DataFrame:
    """N2 wide form: entity count per tagger as one column each, zero for untagged docs."""
    wide = ents.groupBy(key).pivot("tagger", ["A", "B"]).count()
    return (docs.select(key).join(wide, key, "left")
            .select(key, F.coalesce(F.col("A"), F.lit(0)).cast("long").alias("n_a"),
                    F.coalesce(F.col("B"), F.lit(0)).cast("long").alias("n_b")))


def span_entities(entities: Column) -> Column:
    """N5 as an expression: neighbouring tokens with one label become one span, in the document's row.

    ``entities`` is an entity array in order of ``pos``. Consecutive tokens of a
    space split are one space apart, so the span's word is the tokens joined by a
    space. Each token is read by its own span only: linear in the array.
    """
    def islands(e):
        def begins(i):
            return ((i == 0) | (F.get(e, i)["pos"] != F.get(e, i - 1)["pos"] + 1)
                    | (F.get(e, i)["entity"] != F.get(e, i - 1)["entity"]))

        def build(f):
            def span(x, j):
                n = F.coalesce(F.get(f, j + 1), F.size(e)) - x
                part = F.slice(e, x + 1, n)
                total = F.aggregate(part, F.lit(0.0).cast("double"), lambda acc, y: acc + y["score"])
                return F.struct(F.get(e, x)["pos"].alias("pos"), F.get(e, x)["entity"].alias("entity"),
                                (total / n).alias("score"), F.array_join(F.transform(part, lambda y: y["word"]), " ").alias("word"),
                                F.get(e, x)["start"].alias("start"), F.get(e, x + n - 1)["end"].alias("end"),
                                n.cast("long").alias("n_tokens"))
            return F.transform(f, span)
        return let(F.filter(F.sequence(F.lit(0), F.size(e) - 1), begins), build)

    return let(entities, lambda e: F.when(F.size(e) > 0, islands(e)))


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once: an array used inside a lambda is not evaluated again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tag_spans_rows(docs: DataFrame, entities: Column, key: str = "doc_id") -> DataFrame:
    """N5 in the row: one row a span, without an exchange."""
    return docs.select(key, F.inline(span_entities(entities)))


def tag_spans(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """N5 on a long token table (see ``span_entities``): gathers each document's tokens, one shuffle."""
    lists = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "entity", "score", "word", "start", "end"))).alias("_tokens"))
    return tag_spans_rows(lists, F.col("_tokens"), key)


def entity_labels(arr) -> Column:
    """Entity list → list of labels."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.transform(a, lambda x: x["entity"])


def entity_arrays(ents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form → one ``ARRAY<STRUCT>`` per document, in list order (interchange form)."""
    return ents.groupBy(key, "tagger").agg(
        F.array_sort(F.collect_list(F.struct("pos", "entity", "score", "word", "start", "end"))).alias("entities"))


def explode_entities(arrays: DataFrame, key: str = "doc_id", col: str = "entities") -> DataFrame:
    """Flatten entity lists to rows (empty lists give no row)."""
    return arrays.select(key, "tagger", F.posexplode(col).alias("pos", "e")).select(
        key, "tagger", F.col("pos").cast("int").alias("pos"), "e.entity", "e.score", "e.word", "e.start", "e.end")


def has_span(e) -> Column:
    """F6 for offsets: label, start and end are there. An empty label is missing, 0 is not."""
    return e["entity"].isNotNull() & (e["entity"] != "") & e["start"].isNotNull() & e["end"].isNotNull()


def has_word(e) -> Column:
    """F6 for searched words: word and label are there and not empty."""
    return e["word"].isNotNull() & (e["word"] != "") & e["entity"].isNotNull() & (e["entity"] != "")


def _row() -> dict[str, Column]:
    return {c: F.col(c) for c in ("word", "entity", "start", "end")}


def with_span(ents: DataFrame) -> DataFrame:
    """entities usable by their offsets."""
    return ents.where(has_span(_row()))


def with_word(ents: DataFrame) -> DataFrame:
    """entities usable by their word."""
    return ents.where(has_word(_row()))


def valid_entities(ents: DataFrame) -> DataFrame:
    """entities with word, label, start and end."""
    return ents.where(has_span(_row()) & has_word(_row()))


def clean_leading(word) -> Column:
    """Strip leading Ġ marks."""
    w = F.col(word) if isinstance(word, str) else word
    return F.regexp_replace(w, f"^{BYTE_LEVEL_MARK}+", "")


def clean_all(word) -> Column:
    """Remove every Ġ mark."""
    w = F.col(word) if isinstance(word, str) else word
    return F.replace(w, F.lit(BYTE_LEVEL_MARK), F.lit(""))


def byte_level_words(spans: DataFrame) -> DataFrame:
    """Raw byte-level form of span words: each token prefixed by Ġ, joined without spaces."""
    return spans.withColumn("word", F.concat(F.lit(BYTE_LEVEL_MARK),
                                             F.replace(F.col("word"), F.lit(" "), F.lit(BYTE_LEVEL_MARK))))


def wordpieces(ents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Raw WordPiece form of token entities: words longer than 6 are cut once, tail marked ##.

    Output ``(doc_id, pos, piece_no, word, entity)`` with the list order ``(pos, piece_no)``.
    """
    long_word = F.length("word") > PIECE_LEN
    pieces = F.when(long_word, F.array(F.substring("word", 1, PIECE_LEN),
                                       F.concat(F.lit(WORDPIECE_MARK), F.expr(f"substring(word, {PIECE_LEN + 1})"))))\
              .otherwise(F.array(F.col("word")))
    return ents.select(key, "pos", "entity", F.posexplode(pieces).alias("piece_no", "piece")).select(
        key, "pos", F.col("piece_no").cast("int").alias("piece_no"), F.col("piece").alias("word"), "entity")


def _islands(pieces: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    starts_word = (~F.col("word").startswith(WORDPIECE_MARK)).cast("int")
    return pieces.withColumn("island", F.sum(starts_word).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_wordpiece(pieces: DataFrame, key: str = "doc_id", order=("pos", "piece_no")) -> DataFrame:
    """Glue ## pieces onto the previous word; label of the first piece; leading orphans dropped.

    Every ``##`` inside a glued piece is removed; the head piece is kept as is.
    """
    order = list(order)
    isl = _islands(pieces, key, order).where(F.col("island") > 0)
    part = F.when(F.col("word").startswith(WORDPIECE_MARK), F.replace(F.col("word"), F.lit(WORDPIECE_MARK), F.lit("")))\
            .otherwise(F.col("word"))
    g = isl.groupBy(key, "island").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], part.alias("part"),
                                             F.col("entity").alias("ent")))).alias("ps"))
    return g.select(key, (F.col("island") - 1).cast("int").alias("pos"),
                    F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("word"),
                    F.element_at("ps", 1)["ent"].alias("entity"))


def merge_wordpiece_keep(pieces: DataFrame, key: str = "doc_id", order=("pos", "piece_no")) -> DataFrame:
    """C4: as C3 but ## pieces lose their first two characters only, leading orphans
    form a word with a null label, and empty words are dropped."""
    order = list(order)
    isl = _islands(pieces, key, order)
    part = F.when(F.col("word").startswith(WORDPIECE_MARK), F.expr("substring(word, 3)")).otherwise(F.col("word"))
    g = isl.groupBy(key, "island").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], part.alias("part"),
                                             F.col("entity").alias("ent")))).alias("ps"))
    out = g.select(key, "island",
                   F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("word"),
                   F.when(F.col("island") > 0, F.element_at("ps", 1)["ent"]).alias("entity"))
    out = out.where(F.col("word") != "")
    w = Window.partitionBy(key).orderBy("island")
    return out.select(key, (F.row_number().over(w) - 1).cast("int").alias("pos"), "word", "entity")
