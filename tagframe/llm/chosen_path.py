"""Operator 9: near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles; equal sets are one class from the start.
Each of ``TREES`` independent trees branches every class by a minwise token of
its set. Nodes with at most ``LEAF`` classes are compared exhaustively; larger
nodes branch again by further minwise tokens (one, sometimes two a level), so
dissimilar classes part and similar ones stay together in some branch.

Within a leaf, pairs are first compared on ``SKETCH`` one-byte minwise values;
what may reach the similarity is confirmed on the full shingle sets, read from
the texts. Confirmed pairs become links, at most one less than a leaf's classes:
a pair that links already connect needs none.

Large groups of near copies: a first pass over two trees cuts large nodes into
blocks that share four pivots, which connects dense groups in linear work. The
classes carry that component as a label into the second pass over all trees;
nodes of one label are dropped, and only pairs of different labels compared.
Nodes still large and mixed after ``DEPTH`` levels are compared in pairs of blocks.

Recall: a pair at the similarity ``s`` meets in a tree whose nodes are small
with probability ``s``, so in none of 16 with ``(1 - s) ** 16`` (7e-12 at 0.8).
Where a passage that many texts share makes up the share ``t`` of the pair's
union, its nodes stay large and every level may part the pair again: a branch
finds it with ``x = s - t + t * r``, and a node of ``1.5`` branches with
``r = 1.5 * x - 0.5 * x * x``. By this calculation all trees miss a pair at 0.8
with 1.5e-9 (t = 0.45), 2.3e-8 (0.6), 2.7e-7 (0.7), 1.5e-6 (0.75), at most 1.5e-5 (0.8).

Defined results: a null or empty text and a text without words has the empty
set, links with nothing and is its own component; a text of fewer words than a
shingle is one shingle; repeated rows share a component; a null ``doc_id`` never
is a ``component_id`` unless its component has no other; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm.common import documents, store, text_slices
from tagframe.llm.components import components
from tagframe.llm.kernels import hash_spans, lower_table, mix64, space_table, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 16
FIRST_TREES = 2
SKETCH = 256
LEAF = 1024
DEPTH = 12
#: Pairs whose sketches put them this far below the similarity are not confirmed: over four standard errors.
MARGIN = 0.11
SIGNATURE = "doc_id long, text_key long, n_shingles long, cls binary, roots array<long>, sketch binary"
MEMBER = "group long, cls binary, text_key long, label binary, sketch binary"


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    low = lower_table()[buf]
    starts, ends, doc = spans(~space_table()[buf], offs)
    words = hash_spans(low, starts, ends)
    odd = mix64(np.arange(1, size + 1)) | np.uint64(1)
    edge = np.searchsorted(doc, np.arange(len(offs)))
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        w = words[a:b]
        n = min(size, len(w))
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            total += w[k:len(w) - n + 1 + k] * odd[k]
        out.append(np.unique(mix64(total)))
    return out


def signature(s: np.ndarray, trees: int = TREES, sketch: int = SKETCH) -> tuple[bytes, list[int], bytes]:
    """(128-bit name of the set, one root node a tree, one byte of each further minwise value)."""
    name = np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], ">u8")
    a = mix64(np.arange(1000, 1000 + trees)) | np.uint64(1)
    roots = mix64((s[:, None] * a[None, :]).min(axis=0) + a).astype(np.int64)
    b = (mix64(np.arange(5000, 5000 + sketch)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = (s >> np.uint64(16)).astype(np.uint32)
    least = np.full(sketch, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 2048):
        np.minimum(least, (low[i:i + 2048, None] * b[None, :]).min(axis=0), out=least)
    return name.tobytes(), roots.tolist(), ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sign(size: int):
    def run(batches):
        for batch in batches:
            for a, b, buf, offs in text_slices(batch["text"], 2 << 20):
                sets = shingles(buf, offs, size)
                signed = [signature(s) if len(s) else (None, [], None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["text_key"].slice(a, b - a),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in signed], pa.binary()),
                     pa.array([x[1] for x in signed], pa.list_(pa.int64())), pa.array([x[2] for x in signed], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "cls", "roots", "sketch"])
    return run


def whole_groups(batches, rows: int = 4096):
    """Runs of whole groups from batches sorted by ``group``: (table, first row of each group and the end)."""
    held, size = [], 0

    def cut(table, final):
        g = table["group"].to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]]).astype(np.int64)
        return edge if final else edge[:-1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            edge = cut(table, False)
            if len(edge) > 1:
                yield table.slice(0, int(edge[-1])), edge
            rest = table.slice(int(edge[-1])).to_batches()
            held, size = rest, sum(x.num_rows for x in rest)
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table, True)


def close_pairs(sketch: np.ndarray, label: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of different labels whose sketches agree in at least the share ``least``."""
    m, t = sketch.shape
    need = int(np.ceil(t * (least + (1 - least) / 256)))
    first, second = [], []
    for i in range(0, m - 1, 16):
        rows = sketch[i:i + 16]
        agree = (rows[:, None, :] == sketch[None, i + 1:, :]).sum(axis=2, dtype=np.int32)
        ok = (agree >= need) & (label[i:i + 16, None] != label[None, i + 1:])
        a, b = np.nonzero(ok)
        right = b + i + 1 > a + i
        first.append(a[right] + i)
        second.append(b[right] + i + 1)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _may_link(least: float):
    """Members of each group that may link with another one of a different label."""
    def run(batches):
        for table, edge in whole_groups(batches):
            sketch, label, keep = _sketches(table["sketch"]), _codes(table["label"]), []
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a > 1:
                    i, j = close_pairs(sketch[a:b], label[a:b], least)
                    keep.append(np.unique(np.concatenate([i, j])) + a)
            some = table.take(pa.array(np.concatenate(keep) if keep else [], pa.int64()))
            yield from some.combine_chunks().to_batches()
    return run


def _codes(column) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy() if isinstance(column, pa.ChunkedArray) \
        else column.dictionary_encode().indices.to_numpy()


def confirm(sets: list[np.ndarray], label: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of one leaf: a spanning forest of the candidate pairs that hold on the full sets.

    The candidate with most partners goes first, then those of the smallest
    components; one pass over the leaf's shingles gives all intersections of a member.
    """
    m = len(sets)
    root = np.arange(m)
    same = {}
    for x in range(m):
        root[x] = same.setdefault(label[x], x)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    mark = np.zeros(int(ids.max()) + 1, bool)
    both = np.concatenate([i, j]), np.concatenate([j, i])
    by = np.argsort(both[0], kind="stable")
    left, right = both[0][by], both[1][by]
    edge = np.searchsorted(left, np.arange(m + 1))
    links = []

    def visit(x):
        partners = right[edge[x]:edge[x + 1]]
        partners = partners[root[partners] != root[x]]
        if not len(partners):
            return
        own = ids[first[x]:first[x] + size[x]]
        mark[own] = True
        if len(partners) * 4 > m:
            common = np.add.reduceat(mark[ids], first)[partners]
        else:
            common = np.array([mark[ids[first[y]:first[y] + size[y]]].sum() for y in partners])
        mark[own] = False
        for y in partners[100 * common >= percent * (size[x] + size[partners] - common)]:
            if root[y] != root[x]:
                links.append((x, int(y)))
                root[root == root[y]] = root[x]

    degree = np.diff(edge)
    hub = int(degree.argmax())
    visit(hub)
    members = np.bincount(root, minlength=m)
    for x in np.argsort(members[root], kind="stable"):
        visit(int(x))
    return links


def _confirm(size: int, percent: int, least: float):
    def run(batches):
        for table, edge in whole_groups(batches, 2048):
            sketch, label, cls = _sketches(table["sketch"]), _codes(table["label"]), table["cls"].to_pylist()
            a_, b_ = [], []
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a < 2:
                    continue
                i, j = close_pairs(sketch[a:b], label[a:b], least)
                if not len(i):
                    continue
                used = np.unique(np.concatenate([i, j]))
                texts = table["text"].slice(a, b - a).take(pa.array(used))
                sets = [s for _, _, buf, offs in text_slices(texts) for s in shingles(buf, offs, size)]
                for x, y in confirm(sets, label[a:b][used], np.searchsorted(used, i), np.searchsorted(used, j), percent):
                    a_.append(cls[a + used[x]])
                    b_.append(cls[a + used[y]])
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], names=["a", "b"])
    return run


def _grouped(members: DataFrame) -> DataFrame:
    return members.repartition("group").sortWithinPartitions("group")


def _large_blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """Nodes over ``leaf`` classes in blocks that share up to four pivots: linear in the node."""
    h = F.xxhash64("cls")
    big = (rows.where(F.col("size") > leaf).groupBy("node")
           .agg(F.first("size").alias("n"), F.min("cls").alias("p0"), F.max("cls").alias("p1"),
                F.min(F.struct(h, "cls")).alias("p2"), F.max(F.struct(h, "cls")).alias("p3"))
           .select("node", F.ceil(F.col("n") / leaf).alias("blocks"),
                   F.array_distinct(F.array("p0", "p1", "p2.cls", "p3.cls")).alias("pivots")))
    pivot = (big.select("node", "blocks", F.explode("pivots").alias("cls"))
             .join(rows.select("node", "cls", "text_key", "sketch"), ["node", "cls"])
             .select("node", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "cls",
                     "text_key", "sketch"))
    plain = rows.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.ceil(F.col("size") / leaf)).cast("int"))
    return (plain.select("node", "block", "cls", "text_key", "sketch").unionByName(pivot).distinct()
            .select(F.xxhash64("node", "block").alias("group"), "cls", "text_key", F.col("cls").alias("label"), "sketch"))


def _branch(rows: DataFrame, depth: int) -> DataFrame:
    """Children of large nodes: by one minwise value that the node selects, in half of the nodes also by a second."""
    pick = F.xxhash64("node", F.lit(depth))
    second = F.when(F.pmod(F.xxhash64("node", F.lit(-depth)), F.lit(2)) == 0, F.array(pick, F.xxhash64(pick))).otherwise(F.array(pick))
    by = rows.select("cls", "text_key", "label", "sketch", "node", F.explode(second).alias("c"))
    value = F.substring("sketch", F.pmod(F.col("c"), F.lit(SKETCH)).cast("int") + 1, F.lit(1))
    return by.select("cls", "text_key", "label", "sketch", F.xxhash64("node", "c", value).alias("node"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two labels or more, with the node's size."""
    sizes = (rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo <> hi").select("node", "size"))
    return rows.join(sizes, "node")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``."""
    least = percent / 100 - MARGIN
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64("text", F.length("text")))
    signed = store(keyed.mapInArrow(_sign(size), SIGNATURE), "signatures")
    classes = store(signed.where("n_shingles > 0").groupBy("cls")
                    .agg(F.min("doc_id").alias("min_doc"), F.min("text_key").alias("text_key"), F.first("roots").alias("roots"),
                         F.first("sketch").alias("sketch")), "classes")
    # the first level of all trees; nodes of one class have nothing to compare
    entry = classes.select("cls", F.posexplode("roots").alias("tree", "node"))
    sizes = entry.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    nodes = store(entry.join(sizes, "node").join(classes.select("cls", "text_key", "sketch"), "cls")
                  .select("tree", "node", "size", "cls", "text_key", "sketch"), "nodes")
    large = nodes.where(F.col("size") > leaf)
    blocks = _large_blocks(nodes.where(F.col("tree") < FIRST_TREES), leaf)
    small = nodes.where((F.col("size") <= leaf) & (F.col("tree") >= FIRST_TREES)).select(
        F.col("node").alias("group"), "cls", "text_key", F.col("cls").alias("label"), "sketch")
    first = store(_grouped(blocks).mapInArrow(_may_link(least), MEMBER), "first")
    later = store(_grouped(small).mapInArrow(_may_link(least), MEMBER), "later")
    # texts of the classes that may link, read once; copies meet within their task before the shuffle
    need = first.select("text_key").union(later.select("text_key")).union(large.select("text_key")).distinct()
    texts = store(keyed.groupBy("text_key").agg(F.first("text").alias("text")).join(need, "text_key", "left_semi"), "texts")
    check = _confirm(size, percent, least)

    def confirmed(members: DataFrame) -> DataFrame:
        return _grouped(members.join(texts, "text_key")).mapInArrow(check, "a binary, b binary")

    links = store(confirmed(first), "links_first")
    label = components(links).select(F.col("node").alias("cls"), F.col("root").alias("label"))

    def labelled(members: DataFrame) -> DataFrame:
        return (members.drop("label").join(label, "cls", "left")
                .withColumn("label", F.coalesce("label", "cls")))

    leaves = [labelled(x).withColumnRenamed("group", "node") for x in (first, later)]
    leaves = [_mixed(x).withColumnRenamed("node", "group").select("group", "cls", "text_key", "label", "sketch") for x in leaves]
    open_ = store(_mixed(labelled(large.select("cls", "text_key", "sketch", "node"))), "open")
    for level in range(depth):
        if open_.isEmpty():
            break
        part = store(_mixed(_branch(open_.where(F.col("size") > leaf).drop("size"), level)), "branch")
        leaves.append(part.where(F.col("size") <= leaf).select(F.col("node").alias("group"), "cls", "text_key", "label", "sketch"))
        open_ = part.where(F.col("size") > leaf)
    if not open_.isEmpty():  # large, mixed and not parted by all levels: every pair of blocks
        n = F.ceil(F.col("size") / (leaf // 2)).cast("int")
        own = F.pmod(F.xxhash64("cls"), n).cast("int")
        paired = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        leaves.append(paired.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
                                    "cls", "text_key", "label", "sketch"))
    rest = leaves[0]
    for x in leaves[1:]:
        rest = rest.unionByName(x)
    narrowed = store(_grouped(rest.distinct()).mapInArrow(_may_link(least), MEMBER), "second")
    links = store(links.union(confirmed(narrowed)), "links_all")
    found = components(links)
    least_doc = (found.join(classes.select(F.col("cls").alias("node"), "min_doc"), "node")
                 .groupBy("root").agg(F.min("min_doc").alias("component_id")))
    linked = found.join(least_doc, "root").select(F.col("node").alias("cls"), "component_id")
    names = store(classes.select("cls", "min_doc").join(linked, "cls", "left")
                  .select("cls", F.coalesce("component_id", "min_doc").alias("component_id")), "components")
    full = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "cls").join(names, "cls").drop("cls")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
