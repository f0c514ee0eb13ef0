"""Writing entity tags into the text.

A document's spans are an array in its row, ``(start, pos, end, entity[, bstart,
bend])`` with code-point offsets ``[start, end)`` and, where the tagger gives
them, UTF-8 byte offsets. Merging, dropping overlaps and insertion are
expressions over that array: no shuffle, no sort beyond the document's own.
Insertion assembles ``gap + <tag>span</tag>`` pieces in one linear pass. The long
span table ``(doc_id, pos, start, end, entity)`` is the exploded form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagframe.operators import entities as E
from tagframe.operators import search
from tagframe.operators.entities import let

# The marker tokens of the tagged text.
MARKERS = ("<per>", "</per>", "<org>", "</org>", "<loc>", "</loc>", "<misc>", "</misc>")
# Tokenisation for classifier input: markers whole, words of letters and digits of any script, other marks singly.
TOKEN_PATTERN = "|".join(MARKERS) + r"|[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r]"
PAD = "[PAD]"


def spans_of(entities: Column, by_bytes: bool) -> Column:
    """Usable spans of an entity array, in order of ``(start, pos)``."""
    fields = ["start", "pos", "end", "entity"] + (["bstart", "bend"] if by_bytes else [])
    kept = F.filter(entities, lambda e: E.has_span({c: e[c] for c in ("entity", "start", "end")}))
    return F.array_sort(F.transform(kept, lambda e: F.struct(*[e[c].alias(c) for c in fields])))


def merged(spans: Column, by_bytes: bool) -> Column:
    """T4 on a span array: same label and ``start <= previous end + 1`` merge.

    Each decision needs the previous span only; a merged span ends where the last
    span read ends (not at the largest end).
    """
    def islands(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (
            F.get(s, i - 1)["entity"] != F.get(s, i)["entity"]) | (F.get(s, i)["start"] > F.get(s, i - 1)["end"] + 1))

        def build(f):
            def span(x, j):
                after = F.coalesce(F.get(f, j + 1), F.size(s))
                a, z = F.get(s, x), F.get(s, after - 1)
                return F.struct(a["start"].alias("start"), j.cast("int").alias("pos"), z["end"].alias("end"),
                                a["entity"].alias("entity"),
                                *([a["bstart"].alias("bstart"), z["bend"].alias("bend")] if by_bytes else []),
                                (after - x).cast("long").alias("n_merged"))
            return F.transform(f, span)

        return let(first, build)

    return let(spans, lambda s: F.when(F.size(s) > 0, islands(s)))


def _running_max(values: Column) -> Column:
    """The largest value up to each place, by doubling: one pass for every power of two below the length."""
    def doubled(step: int):
        return lambda v: F.when(F.size(v) <= step, v).otherwise(F.transform(
            v, lambda x, i: F.when(i >= step, F.greatest(x, F.get(v, i - step))).otherwise(x)))

    for k in range(31):
        values = let(values, doubled(1 << k))
    return values


def disjoint(spans: Column, by_bytes: bool) -> Column:
    """Spans, in order, that do not start before the end of any span before them.

    Spans that already follow one another, as every tagger here gives them, are
    kept after one look at each neighbour; only others need the running maximum.
    """
    fields = ["start", "end", "entity"] + (["bstart", "bend"] if by_bytes else [])
    kind = "array<struct<" + ",".join(f"{c}:{'string' if c == 'entity' else 'int'}" for c in fields) + ">>"
    plain = F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in fields])).cast(kind)

    def keep(s):
        clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i)["start"] < F.get(s, i - 1)["end"])
        reach = _running_max(F.transform(s, lambda x: x["end"]))
        apart = let(reach, lambda m: F.filter(s, lambda x, i: (i == 0) | (x["start"] >= F.get(m, i - 1))))
        return F.when((F.size(s) < 2) | ~clash, s).otherwise(apart)

    return let(F.coalesce(plain, F.array().cast(kind)), keep)


def inserted(text: Column, spans: Column, by_bytes: bool) -> Column:
    """The text with every span of a disjoint, ordered array wrapped in ``<label>…</label>``.

    With byte offsets the text is encoded once and every piece is a byte-range copy.
    """
    a, z = ("bstart", "bend") if by_bytes else ("start", "end")

    def build(raw):
        def cut(pos, length):
            piece = F.substring(raw, pos, length)
            return F.decode(piece, "UTF-8") if by_bytes else piece

        def wrap(s):
            before = F.transform(s, lambda x, i: F.struct(x.alias("s"), F.when(i > 0, F.get(s, i - 1)[z]).otherwise(0).alias("p")))
            pieces = F.transform(before, lambda x: F.concat(
                cut(x["p"] + 1, x["s"][a] - x["p"]), F.lit("<"), x["s"]["entity"], F.lit(">"),
                cut(x["s"][a] + 1, x["s"][z] - x["s"][a]), F.lit("</"), x["s"]["entity"], F.lit(">")))
            return F.concat(F.array_join(pieces, ""), cut(F.element_at(s, -1)[z] + 1, F.lit(2147483647)))

        return let(spans, wrap)

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-8") if by_bytes else text, build)).otherwise(text)


def _write(docs: DataFrame, key: str, text: str, spans: Column, by_bytes: bool, out: str = "tagged_text") -> DataFrame:
    held = docs.select(key, text, spans.alias("_spans"))
    return held.select(key, inserted(F.col(text), F.col("_spans"), by_bytes).alias(out),
                       F.size(F.coalesce("_spans", F.array())).alias("n_spans"))


def _gathered(docs: DataFrame, ents: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with the long entity table as an array ``_ents`` per row."""
    fields = [c for c in ("pos", "word", "entity", "start", "end", "bstart", "bend") if c in ents.columns]
    lists = ents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_ents"))
    return docs.select(key, text).join(lists, key, "left")


def tag_rows(docs: DataFrame, entities: Column, key: str = "doc_id", text: str = "text", by_bytes: bool = True) -> DataFrame:
    """T1 (tag_A_entities) in the row: every usable span tagged, label case kept, no merging."""
    return _write(docs, key, text, disjoint(spans_of(entities, by_bytes), by_bytes), by_bytes)


def tag_xml_rows(docs: DataFrame, entities: Column, key: str = "doc_id", text: str = "text",
                 by_bytes: bool = True) -> DataFrame:
    """T6 (insert_xml on given offsets) in the row: merge adjacent spans, then drop overlaps, lower-case labels, insert."""
    spans = disjoint(merged(spans_of(entities, by_bytes), by_bytes), by_bytes)
    lower = F.transform(spans, lambda s: s.withField("entity", F.lower(s["entity"])))
    return _write(docs, key, text, lower, by_bytes)


def merge_adjacent(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """T4: sorted by ``(start, pos)``; same label and ``start <= previous end + 1`` merge.

    The merged span ends at the end of the last span read (not the maximum end),
    and each decision needs only the previous row in start order. One window
    spec (one sort) does everything: the island's start is the start of its
    latest break row (starts are sorted), and only the last row of each island
    is kept, carrying the island's end.
    """
    w = Window.partitionBy(key).orderBy("start", "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    brk = (F.lag("end").over(w).isNull() | (F.lag("entity").over(w) != F.col("entity"))
           | (F.col("start") > F.lag("end").over(w) + 1))
    has_bytes = _has_bytes(spans)
    t = spans.withColumn("_brk", brk).withColumn("_rn", F.row_number().over(w))
    t = t.select(key, "start", "end", "entity", "_brk", "_rn", *(["bend"] if has_bytes else []),
                 F.sum(F.col("_brk").cast("int")).over(upto).alias("_island"),
                 F.max(F.when(F.col("_brk"), F.col("start"))).over(upto).alias("_istart"),
                 *([F.max(F.when(F.col("_brk"), F.col("bstart"))).over(upto).alias("_ibstart")] if has_bytes else []),
                 F.max(F.when(F.col("_brk"), F.col("_rn"))).over(upto).alias("_irn"),
                 F.lead("_brk").over(w).alias("_next_brk"))
    last = t.where(F.col("_next_brk").isNull() | F.col("_next_brk"))
    return last.select(key, (F.col("_island") - 1).cast("int").alias("pos"), F.col("_istart").alias("start"),
                       "end", "entity", (F.col("_rn") - F.col("_irn") + 1).cast("long").alias("n_merged"),
                       *([F.col("_ibstart").alias("bstart"), "bend"] if has_bytes else []))


def _has_bytes(spans: DataFrame) -> bool:
    return "bstart" in spans.columns and "bend" in spans.columns


def insert_tags(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text",
                out: str = "tagged_text") -> DataFrame:
    """T1 insertion of a long span table; documents without spans keep their text."""
    by_bytes = _has_bytes(spans)
    j = _gathered(docs, spans, key, text)
    return _write(j, key, text, disjoint(spans_of(F.col("_ents"), by_bytes), by_bytes), by_bytes, out)


def tag_inline_tokens(docs: DataFrame, ents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T1 on a long entity table (see ``tag_rows``)."""
    return tag_rows(_gathered(docs, ents, key, text), F.col("_ents"), key, text, _has_bytes(ents))


def tag_xml(docs: DataFrame, ents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T6 on a long entity table (see ``tag_xml_rows``)."""
    return tag_xml_rows(_gathered(docs, ents, key, text), F.col("_ents"), key, text, _has_bytes(ents))


def cursor_rows(docs: DataFrame, entities: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T2 (tag_B_entities) in the row: words in list order, each first found at or after the previous match's end."""
    return _write(docs, key, text, search.by_cursor(F.col(text), entities), True)


def tag_inline_cursor(docs: DataFrame, ents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T2 on a long entity table; label case kept."""
    return cursor_rows(_gathered(docs, ents, key, text), F.col("_ents"), key, text)


def offset_rows(docs: DataFrame, entities: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T3 (add_offsets) in the row: first case-insensitive match of each word in the whole text,
    rejected if it touches an accepted one; labels lower-cased. One row per accepted span."""
    got = docs.select(key, F.posexplode(search.anywhere(F.col(text), entities)).alias("pos", "s"))
    return got.select(key, F.col("pos").cast("int").alias("pos"), "s.start", "s.end", "s.entity")


def find_offsets(docs: DataFrame, ents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T3 on a long entity table."""
    return offset_rows(_gathered(docs, ents, key, text), F.col("_ents"), key, text)


def tag_searched_rows(docs: DataFrame, entities: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T5 (insert_xml_tags) in the row: T3 search → T4 merge → insertion."""
    found = docs.select(key, text, F.transform(search.anywhere(F.col(text), entities), lambda s, i: s.withField(
        "pos", i.cast("int"))).alias("_found"))
    return _write(found, key, text, disjoint(merged(spans_of(F.col("_found"), True), True), True), True)


def tag_xml_searched(docs: DataFrame, ents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T5 on a long entity table."""
    return tag_searched_rows(_gathered(docs, ents, key, text), F.col("_ents"), key, text)


def strip_tags(col) -> Column:
    """Inverse of insertion for tags without ``<`` in the text: removes ``<label>``/``</label>``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"</?[A-Za-z_]+>", "")


def label_vocab(ents: DataFrame) -> DataFrame:
    """Distinct labels → marker tokens ``[L_]`` and ``[/L_]``, sorted."""
    labels = ents.where(F.col("entity").isNotNull() & (F.col("entity") != "")).select("entity").distinct()
    return labels.select(F.explode(F.array(F.concat(F.lit("["), F.col("entity"), F.lit("_]")),
                                           F.concat(F.lit("[/"), F.col("entity"), F.lit("_]")))).alias("token"))


def tokenize(col) -> Column:
    """Lower-cased tokens with tag markers kept whole."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def tokenize_pad(df: DataFrame, col: str, window: int = 128, key: str = "doc_id") -> DataFrame:
    """Every token, in consecutive windows of ``window`` tokens; the last one padded, with an attention mask.

    Row-local (no global maximum); a text without tokens is one window of padding.
    """
    t = df.select(key, F.coalesce(tokenize(col), F.array().cast("array<string>")).alias("_toks"))
    n = F.greatest(F.lit(1), F.ceil(F.size("_toks") / window)).cast("int")
    t = t.select(key, "_toks", F.explode(F.sequence(F.lit(0), n - 1)).alias("window_no"))
    t = t.select(key, "window_no", F.slice("_toks", F.col("window_no") * window + 1, F.lit(window)).alias("toks"))
    left = F.lit(window) - F.size("toks")
    return t.select(key, "window_no", F.concat("toks", F.array_repeat(F.lit(PAD), left)).alias("tokens"),
                    F.concat(F.array_repeat(F.lit(1), F.size("toks")), F.array_repeat(F.lit(0), left)).alias("mask"))
