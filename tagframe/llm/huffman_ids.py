"""Operator 1: token ids in a canonical, length-limited Huffman file format.

``write_ids`` encodes every text once, keeps the ids as a staged table, counts
them over the whole table (partial counts per task, at most one row per
vocabulary id to the driver), builds one canonical code and writes the ids in
ascending ``doc_id`` order. ``read_ids`` decodes the files.

File format, below one folder:

* ``code``: ``(id, length)`` — code lengths; the codes follow canonically
  (shorter first, then by id).
* ``blocks``: one row per block ``(part, seq, first_id, n_ids, doc_ids, lengths,
  checkpoints, payload)``. A block holds whole documents and decodes alone;
  ``checkpoints`` has the bit offset (uint32, little-endian) of every
  ``STEP``-th id, so all stretches of a block decode in step by one table
  lookup an id. ``first_id`` counts ids from the start of its part; a part is
  one file, files follow the order of ``doc_id``.

The reader adds the ids of all earlier parts to ``first_id``.

Defined results: a null or empty text is one end id; null ``doc_id`` rows come
first; rows with equal ``doc_id`` follow each other in the order in which they
were encoded; an empty table gives an empty folder that reads as no rows; extra
columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.llm.bpe import default_path, encoder
from tagframe.llm.common import documents, scratch, store, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 2
MAX_BITS = 18
STEP = 128
BLOCK_IDS = 1 << 16
STAGED = "doc_id long, part int, row long, n_ids long, ids binary"
BLOCKS = ("part int, seq int, first_id long, n_ids long, doc_ids array<long>, lengths array<int>, "
          "checkpoints binary, payload binary")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    rows, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(max_bits - 1):
        pairs = rows[:len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        rows = both[rank]
        is_leaf.append(rank < len(leaf))
    lengths, take = np.zeros(len(leaf), np.int64), 2 * len(leaf) - 2
    for flags in reversed(is_leaf):
        n_leaf = int(flags[:take].sum())
        lengths[:n_leaf] += 1
        take = 2 * (take - n_leaf)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by id, decoding table of ``id << 5 | length`` by the next bits)."""
    bits = int(lengths.max()) if len(lengths) and lengths.max() else 1
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = (1 << (bits - lengths[order])).astype(np.int64)
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (first >> (bits - lengths[order])).astype(np.uint64)
    table = np.zeros(1 << bits, np.uint32)
    entry = (order.astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32)
    table[:int(span.sum())] = np.repeat(entry, span)
    return codes, table


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of one block; bits run from the high end of each byte."""
    n = lengths[ids]
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    if len(ids):
        value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        word = at >> 5
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    payload = words.astype(">u4").tobytes()[:(total + 7) // 8]
    return payload, at[::step].astype("<u4").tobytes()


def unpack_blocks(blocks: list[tuple[int, bytes, bytes]], table: np.ndarray, step: int = STEP) -> list[np.ndarray]:
    """Ids of independent blocks ``(n_ids, checkpoints, payload)``; all stretches advance together."""
    bits = int(table.size).bit_length() - 1
    raw = np.frombuffer(b"".join(p for _, _, p in blocks) + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    base = np.cumsum([0] + [len(p) for _, _, p in blocks])
    lane_at, lane_n, lane_out, out_at = [], [], [], 0
    for (n, marks, _), b in zip(blocks, base):
        m = np.frombuffer(marks, "<u4").astype(np.int64) + 8 * int(b)
        lane_at.append(m)
        lane_n.append(np.minimum(step, n - step * np.arange(len(m))))
        lane_out.append(out_at + step * np.arange(len(m)))
        out_at += n
    out = np.zeros(out_at, np.uint32)
    if out_at:
        at, n, to = (np.concatenate(x) for x in (lane_at, lane_n, lane_out))
        order = np.argsort(-n, kind="stable")
        at, n, to = at[order], n[order], to[order]
        for k in range(int(n[0])):
            live = int(np.searchsorted(-n, -k, "left"))
            pos = at[:live]
            code = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - bits)
            entry = table[code]
            out[to[:live] + k] = entry >> np.uint32(5)
            at[:live] += entry & np.uint32(31)
    edges = np.cumsum([0] + [n for n, _, _ in blocks])
    return [out[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        enc, part, row = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, buf, offs in text_slices(batch["text"], 1 << 20):
                flat, at = enc.encode_bytes(buf, offs)
                ids = [np.append(flat[a:b], end_id).astype("<u2" if flat.max(initial=0) < 65536 else "<u4")
                       for a, b in zip(at[:-1], at[1:])]
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, n), pa.array([part] * n, pa.int32()),
                     pa.array(np.arange(row, row + n), pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "part", "row", "n_ids", "ids"])
                row += n
    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        rows = list(zip(batch["ids"].to_pylist(), batch["n_ids"].to_pylist()))
        for width, kind in ((2, "<u2"), (4, "<u4")):
            got = np.bincount(np.frombuffer(b"".join([raw for raw, n in rows if len(raw) == width * n]), kind))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[:len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _write_blocks(lengths: np.ndarray, block_ids: int):
    def run(batches):
        from pyspark import TaskContext
        codes, _ = canonical(lengths)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs, ids = [], []

        def block():
            nonlocal seq, first
            flat = np.concatenate(ids)
            payload, marks = pack_bits(flat, codes, lengths)
            row = pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "first_id": first, "n_ids": len(flat), "doc_ids": list(docs),
                "lengths": [len(x) for x in ids], "checkpoints": marks, "payload": payload}], schema=pa.schema([
                    ("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                    ("checkpoints", pa.binary()), ("payload", pa.binary())]))
            seq, first = seq + 1, first + len(flat)
            docs.clear()
            ids.clear()
            return row

        size = 0
        for batch in batches:
            for doc, raw, n in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), batch["n_ids"].to_pylist()):
                docs.append(doc)
                ids.append(_ids(raw, n))
                size += n
                if size >= block_ids:
                    yield block()
                    size = 0
        if docs:
            yield block()
    return run


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID,
              max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the id files below ``folder``."""
    spark = docs.sparkSession
    staged = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .mapInArrow(_encode(path or default_path(), end_id), STAGED), "ids")
    # at most one row per vocabulary id reaches the driver
    counts = (staged.select("ids", "n_ids").mapInArrow(_count, "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    dense[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(dense, max_bits)
    used = np.flatnonzero(lengths)
    (spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int")
     .coalesce(1).write.parquet(f"{folder}/code"))
    # (part, row) is stored, so the order of rows with one doc_id is fixed and they may span several files
    (staged.repartitionByRange("doc_id", "part", "row").sortWithinPartitions("doc_id", "part", "row")
     .select("doc_id", "n_ids", "ids").mapInArrow(_write_blocks(lengths, block_ids), BLOCKS)
     .write.option("compression", "none").parquet(f"{folder}/blocks"))


def _read_blocks(table: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), 16):
                some = rows[i:i + 16]
                for row, ids in zip(some, unpack_blocks([(r["n_ids"], r["checkpoints"], r["payload"]) for r in some], table)):
                    n = np.array(row["lengths"], np.int64)
                    end = np.cumsum(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + end - n, pa.int64()),
                         pa.array(n, pa.int64()),
                         pa.array([ids[b - k:b].astype("<u4").tobytes() for b, k in zip(end, n)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
    return run


def read_code(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("id int, length int").parquet(f"{folder}/code").toPandas()
    lengths = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    lengths[rows["id"].to_numpy()] = rows["length"].to_numpy()
    return lengths


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; ids as little-endian uint32."""
    _, table = canonical(read_code(spark, folder))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row of 16 bytes a file, and a file a shuffle partition: bounded by the writer's setting, not by the ids
    parts = (blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    placed = blocks.join(F.broadcast(parts), "part")
    return placed.select((F.col("base") + F.col("first_id")).alias("first_id"), "n_ids", "doc_ids", "lengths",
                         "checkpoints", "payload").mapInArrow(_read_blocks(table),
                                                              "doc_id long, start long, n_tokens long, ids binary")


def decode_range(payload: bytes, checkpoints: bytes, n_ids: int, start: int, stop: int, table: np.ndarray,
                 step: int = STEP) -> np.ndarray:
    """Ids [start, stop) of one block, decoded from the checkpoint at or before ``start``."""
    first, stop = start // step * step, min(stop, n_ids)
    marks = np.frombuffer(checkpoints, "<u4")[start // step:-(-stop // step)]
    if not len(marks):
        return np.zeros(0, np.uint32)
    return unpack_blocks([(stop - first, marks.tobytes(), payload)], table, step)[0][start - first:]


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``documents`` in the file format, read the files back and digest what was read."""
    folder = scratch(spark, "huffman")
    write_ids(documents(spark, sf_dir), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
