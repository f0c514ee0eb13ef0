"""Operator 12: how the sources of a language diverge in their words, by a three-dimensional cube partitioning.

1. Each task counts terms (occurrences, documents) by (language, source) over its
   texts; the counts are added by (language, source, term), then meet by
   (language, term), where the terms of at least ``MIN_DOCS`` documents stay.
2. Every group (language, source) gives each kept term the probability
   ``p = 1 + floor(10^9 (count + 1) / (N + V))``; so does the language as a whole.
3. Terms by which a group stands out against its language: ranked by
   ``floor((p - q)^2 / q)``, the first ``TOP_TERMS``.
4. Pairs of groups of a language: the cube (group block, group block, term block).
   A cell is one task's work: it gets the slices of its two group blocks in its
   term block, each slice replicated to the cells of one row and column, lays
   them out as dense matrices over the terms that occur there, and computes the
   partial divergence of every pair, both ways. The partial sums are added along
   the term axis; terms that neither block has add the same amount each, so
   their number is enough.

A cell holds at most ``2 * GROUP_BLOCK`` groups by about ``TERM_BLOCK`` terms, whatever
the number of groups and terms. All arithmetic is on integers (decimals where a
count is multiplied by 10^9).

Defined results: null text, language or source count as empty; every row is a
document, repeated rows too; a group without kept terms has all its pairs (value
0 if its language keeps no term) and no term rows; a language with one source has
no pairs; equal values rank by the item's UTF-8 bytes; an empty table gives no
rows; ``doc_id`` and extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.llm.chunks import SpanTable, distinct_keys, keys
from tagframe.llm.common import documents, store, text_slices
from tagframe.llm.kernels import lower_table, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
GROUP_BLOCK = 16
TERM_BLOCK = 8192
SLICE = 1 << 18  # bytes of text whose terms are looked up at a time
COUNTS = "lang string, source string, term string, n long, docs long"


class _Counter:
    """Counts of (group, term) pairs of one task; ``rows`` empties it. A pair's key is ``group << 32 | term``."""

    def __init__(self, terms: int, pairs: int):
        self.max_terms, self.max_pairs = terms, pairs
        self.inside = np.zeros(256, bool)
        self.inside[128:] = self.inside[65:91] = self.inside[97:123] = True
        self.lower = lower_table()
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.table, self.long, self.done, self.size = SpanTable(self.max_terms), {}, [], 0

    def full(self, more: int) -> bool:
        return self.table.n + len(self.long) + more > self.max_terms or self.size > self.max_pairs

    def numbers(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The number of each term: short ones even, long ones odd."""
        out = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lens <= 16)
        lo, hi = keys(buf, starts[short], lens[short])
        meta = lens[short].astype(np.uint16)
        got = self.table.find(lo, hi, meta)
        left = np.flatnonzero(got < 0)
        if len(left):
            order, head = distinct_keys(lo[left], hi[left], meta[left])
            order = left[order]
            one = order[head]
            new = np.arange(self.table.n, self.table.n + len(one))
            self.table.n += len(one)
            self.table.put(new, lo[one], hi[one], meta[one])
            got[order] = new[np.cumsum(head) - 1]
        out[short] = 2 * got
        for j in np.flatnonzero(lens > 16).tolist():
            out[j] = 2 * self.long.setdefault(buf[starts[j]:starts[j] + lens[j]].tobytes(), len(self.long)) + 1
        return out

    def add(self, buf: np.ndarray, offs: np.ndarray, group: np.ndarray):
        """Count the terms of the texts; yields the rows so far first when there is no room for new ones."""
        starts, ends, owner = spans(self.inside[buf], offs)
        if self.full(len(starts)):
            yield from self.rows()
            if len(starts) > self.max_terms:
                self.max_terms = len(starts)
                self.clear()
        if not len(starts):
            return
        low = np.concatenate([self.lower[buf], np.zeros(16, np.uint8)])
        term = self.numbers(low, starts, ends - starts)
        n_docs = len(offs) - 1
        each = np.sort(term * n_docs + owner)
        first = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
        n = np.diff(np.append(first, len(each)))
        pair = group[each[first] % n_docs] << 32 | each[first] // n_docs
        self._merge([self._added(pair, n, np.ones(len(n), np.int64))])

    @staticmethod
    def _added(pair: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One entry a pair, in order."""
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pair[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)

    def _merge(self, more: list) -> None:
        self.done += more
        self.size = sum(len(x) for x, _, _ in self.done)
        if len(self.done) >= 8 or self.size > self.max_pairs:
            self.done = [self._added(*(np.concatenate(x) for x in zip(*self.done)))]
            self.size = len(self.done[0][0])

    def rows(self, step: int = 100_000):
        if self.done:
            self.done += [(np.zeros(0, np.int64),) * 3] * 8
            self._merge([])
            pair, n, docs = self.done[0]
            names = list(self.groups)
            langs, sources = pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string())
            raw = np.stack([self.table.lo, self.table.hi], axis=1)[:max(1, self.table.n)].view("S16").ravel()
            long = np.array(list(self.long) or [b""], object)
            for i in range(0, len(pair), step):
                group, term = pair[i:i + step] >> 32, pair[i:i + step] & 0xFFFFFFFF
                text = np.empty(len(term), object)
                odd = (term & 1).astype(bool)
                text[~odd] = raw[term[~odd] >> 1].tolist()
                text[odd] = long[term[odd] >> 1]
                at = pa.array(group)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(at), sources.take(at), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n[i:i + step]),
                     pa.array(docs[i:i + step])], names=["lang", "source", "term", "n", "docs"])
        self.clear()


def _count(max_terms: int = 1 << 19, max_pairs: int = 1 << 20, size: int = SLICE):
    def run(batches):
        counter = _Counter(max_terms, max_pairs)
        for batch in batches:
            named = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()))
            group = np.array([counter.groups.setdefault(x, len(counter.groups)) for x in named], np.int64)
            for first, last, buf, offs in text_slices(batch["text"], size):
                yield from counter.add(buf, offs, group[first:last])
        yield from counter.rows()
    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term by group, added over all tasks."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (text.mapInArrow(_count(), COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, lang_n, term_id, first)`` of the terms in at least ``min_docs`` documents of a language.

    ``lang_n`` is the term's count in the language, ``term_id`` one number a (language, term),
    ``first`` marks one row of each.
    """
    by_term = Window.partitionBy("lang", "term")
    marked = counts.select("*", F.sum("docs").over(by_term).alias("lang_docs"), F.sum("n").over(by_term).alias("lang_n"))
    own = F.monotonically_increasing_id()
    in_order = by_term.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    kept = marked.where(F.col("lang_docs") >= min_docs).withColumn("own", own)
    kept = kept.withColumn("term_id", F.first("own").over(in_order))
    return store(kept.select("lang", "source", "term", "n", "lang_n", "term_id", (F.col("own") == F.col("term_id")).alias("first")),
                 "kept_terms")


def probability(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (n + 1) / (total + terms))``, exactly."""
    units = (n + 1).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", units, (total + terms).cast("decimal(28,0)")) + 1


def surplus(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, terms, lang_total, number, n_groups)``: every group, numbered within its language."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    in_lang = Window.partitionBy("lang")
    all_ = (named.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")],
                    (F.row_number().over(in_lang.orderBy("source")) - 1).alias("number"),
                    F.count(F.lit(1)).over(in_lang).alias("n_groups")))
    return store(all_, "groups")


def term_part(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms that a group uses more than its language, the first ``top``."""
    both = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    p = probability(F.col("n"), F.col("total"), F.col("terms"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    high = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    valued = high.select("lang", "source", "item", surplus(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def partial_divergence(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``sum over terms of floor((p - q)^2 / q)`` for every row of ``left`` as p and of ``right`` as q."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, p in enumerate(left):
        out[i] = ((p - right) ** 2 // right).sum(axis=1)
    return out


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of one cell; the row with ``term_id`` -1 has a group's probability of terms it lacks."""
    lang, block, other = rows["lang"].iloc[0], rows["block"].iloc[0], rows["other"].iloc[0]
    base = rows[rows["term_id"] < 0].sort_values("number")
    numbers = base["number"].to_numpy()
    seen = rows[rows["term_id"] >= 0]
    terms, column = np.unique(seen["term_id"].to_numpy(), return_inverse=True)
    p = np.repeat(base["p"].to_numpy()[:, None], len(terms), axis=1)
    p[np.searchsorted(numbers, seen["number"].to_numpy()), column] = seen["p"].to_numpy()
    mine = base["own"].to_numpy() == block
    sides = [(mine, mine)] if block == other else [(mine, ~mine), (~mine, mine)]
    out = []
    for a, b in sides:
        value = partial_divergence(p[a], p[b])
        x, y = np.meshgrid(numbers[a], numbers[b], indexing="ij")
        out.append(pd.DataFrame({"number": x.ravel(), "item_number": y.ravel(), "part_value": value.ravel()}))
    got = pd.concat(out)
    got = got[got["number"] != got["item_number"]]
    return got.assign(lang=lang, n_terms=len(terms))[["lang", "number", "item_number", "part_value", "n_terms"]]


def pair_part(kept: DataFrame, groups: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """``(lang, source, item, value, rank)``: the divergence of every group from every other group of its language."""
    g = groups.withColumn("p0", probability(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))) \
              .withColumn("slices", F.ceil(F.greatest("terms", F.lit(1)) / term_block).cast("int")) \
              .withColumn("own", F.floor(F.col("number") / group_block).cast("int")) \
              .withColumn("blocks", F.ceil(F.col("n_groups") / group_block).cast("int"))
    seen = (kept.join(g, ["lang", "source"])
            .select("lang", "number", "own", "blocks", F.pmod(F.xxhash64("term_id"), "slices").cast("int").alias("slice"), "term_id",
                    probability(F.col("n"), F.col("total"), F.col("terms")).alias("p")))
    absent = g.select("lang", "number", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                      F.lit(-1).cast("long").alias("term_id"), F.col("p0").alias("p"))
    slices = seen.unionByName(absent).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = slices.select("lang", F.least("own", "k").alias("block"), F.greatest("own", "k").alias("other"), "slice",
                          "own", "number", "term_id", "p")
    parts = cells.groupBy("lang", "block", "other", "slice").applyInPandas(
        _cell, "lang string, number int, item_number int, part_value long, n_terms long")
    sums = parts.groupBy("lang", "number", "item_number").agg(F.sum("part_value").alias("v"), F.sum("n_terms").alias("n_terms"))
    a = g.select("lang", "number", "source", "terms", F.col("p0").alias("p"))
    b = g.select("lang", F.col("number").alias("item_number"), F.col("source").alias("item"), F.col("p0").alias("q"))
    value = F.col("v") + (F.col("terms") - F.col("n_terms")) * surplus(F.col("p"), F.col("q"))
    valued = sums.join(a, ["lang", "number"]).join(b, ["lang", "item_number"]).select("lang", "source", "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, group_block: int = GROUP_BLOCK,
          term_block: int = TERM_BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``, parts ``pair`` and ``term``."""
    kept = kept_terms(term_counts(docs), min_docs)
    groups = groups_of(docs, kept)
    pairs = pair_part(kept, groups, group_block, term_block).withColumn("part", F.lit("pair"))
    terms = term_part(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_cube_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
keep AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
vv AS (SELECT lang, count(*) AS v FROM keep GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS c FROM t JOIN keep USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gs.lang, gs.source, keep.term, coalesce(c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (total + v) AS p
  FROM gs JOIN keep USING (lang) JOIN vv USING (lang) LEFT JOIN n USING (lang, source, term)),
ls AS (SELECT lang, sum(total) AS total FROM gs GROUP BY lang),
lq AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM p JOIN ls USING (lang) JOIN vv USING (lang) GROUP BY lang, term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN lq USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INTEGER AS rank FROM terms) WHERE rank <= 200
"""
