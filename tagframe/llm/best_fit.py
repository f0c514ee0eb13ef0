"""Operator 3: best-fit packing of documents into fixed-length sequences.

Planning works on the histogram of piece lengths, never on documents: at most
``max_tokens`` counts reach the driver whatever the input. Best fit over counts
gives runs of identical sequences; every run states, for a range of ranks of one
length, the sequence and the offset. Pieces find their slot by joining on their
rank within their length.

A rank is the piece's number within (task, length), counted while encoding,
plus the pieces of that length in earlier tasks, so a length that holds a third
of all rows is never sorted or gathered in one place.

Defined results: a null or empty text is one piece with the end id only; a null
``doc_id`` is kept; repeated rows are packed each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagframe.llm.bpe import default_path, encoder
from tagframe.llm.common import documents, store, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TOKENS = 2048
END_ID = 0
PIECES = ("doc_id long, piece int, start long, length int, part int, local_rank long, ids binary")
PLAN = "length int, lo long, hi long, first_sequence long, per int, offset int"


def piece_lengths(n: int, limit: int) -> list[int]:
    """Only the first piece of a cut document may be shorter than ``limit``."""
    if n <= limit:
        return [n]
    return ([n % limit] if n % limit else []) + [limit] * (n // limit)


def _encode_pieces(path: str, limit: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            keys = batch["doc_id"]
            for first, last, buf, offs in text_slices(batch["text"], 1 << 20):
                flat, at = enc.encode_bytes(buf, offs)
                doc, piece, start, length, rank, ids = [], [], [], [], [], []
                for i in range(last - first):
                    own = np.append(flat[at[i]:at[i + 1]], end_id).astype("<u4")
                    pos = 0
                    for k, n in enumerate(piece_lengths(len(own), limit)):
                        doc.append(first + i)
                        piece.append(k)
                        start.append(pos)
                        length.append(n)
                        rank.append(seen[n])
                        seen[n] += 1
                        ids.append(own[pos:pos + n].tobytes())
                        pos += n
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int32()), pa.array([part] * len(doc), pa.int32()),
                     pa.array(rank, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "part", "local_rank", "ids"])
    return run


def plan_slots(counts: dict[int, int], limit: int = MAX_TOKENS) -> list[tuple]:
    """Best fit, longest first, over length counts.

    State: remaining space -> runs of identical sequences (first sequence, how many).
    A length takes the fullest sequences it fits in, each as often as it fits.
    At most three plan rows and two new runs a length and run touched, so the
    plan is bounded by ``limit``, not by the input.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    plan, n_sequences = [], 0
    for length in sorted((k for k, c in counts.items() if c > 0), reverse=True):
        left, lo = counts[length], 0
        for room in sorted(r for r in free if r >= length):
            if not left:
                break
            fits, runs = room // length, free.pop(room)
            while runs and left:
                first, n = runs.pop()
                take = min(n, left // fits)
                if take:
                    plan.append((length, lo, lo + take * fits, first, fits, limit - room))
                    free.setdefault(room - fits * length, []).append((first, take))
                    lo, left, first, n = lo + take * fits, left - take * fits, first + take, n - take
                if n and left:  # fewer than one sequence's worth is left: all of it goes into one sequence
                    plan.append((length, lo, lo + left, first, left, limit - room))
                    free.setdefault(room - left * length, []).append((first, 1))
                    lo, left, first, n = lo + left, 0, first + 1, n - 1
                if n:
                    runs.append((first, n))
            if runs:
                free.setdefault(room, []).extend(runs)
        if left:
            fits = limit // length
            full, rest = divmod(left, fits)
            if full:
                plan.append((length, lo, lo + full * fits, n_sequences, fits, 0))
                free.setdefault(limit - fits * length, []).append((n_sequences, full))
                lo, n_sequences = lo + full * fits, n_sequences + full
            if rest:
                plan.append((length, lo, lo + rest, n_sequences, rest, 0))
                free.setdefault(limit - rest * length, []).append((n_sequences, 1))
                n_sequences += 1
    return plan


@dataclass
class Packing:
    """``pieces``: stored ids of every piece; ``slots``: piece -> (sequence_id, offset); ``plan``: the slot runs."""
    pieces: DataFrame
    slots: DataFrame
    plan: DataFrame

    def sequences(self) -> DataFrame:
        """The packed sequences: ``(sequence_id, n_tokens, ids)`` with ids as little-endian uint32."""
        keys = ["part", "length", "local_rank"]
        rows = self.slots.select(*keys, "sequence_id", "offset").join(self.pieces.select(*keys, "ids"), keys)
        return (rows.groupBy("sequence_id")
                .agg(F.sum("length").alias("n_tokens"),
                     F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
                .select("sequence_id", "n_tokens",
                        F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> Packing:
    """Encode, cut and pack ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    pieces = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .mapInArrow(_encode_pieces(path or default_path(), max_tokens, end_id), PIECES), "pieces")
    by_task = pieces.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(counts, max_tokens), PLAN)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = (pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").join(bases, ["part", "length"])
              .withColumn("rank", F.col("base") + F.col("local_rank")))
    # the plan has a few rows a length (bounded by max_tokens), whatever the input: safe to broadcast
    p, at = plan.alias("p"), F.col("rank") - F.col("lo")
    slots = (ranked.join(F.broadcast(p), (ranked["length"] == F.col("p.length")) & (F.col("rank") >= F.col("lo"))
                         & (F.col("rank") < F.col("hi")))
             .select("doc_id", "piece", "start", ranked["length"].alias("length"), "ids_crc32",
                     (F.col("first_sequence") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
                     (F.col("offset") + (at % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
                     "part", "local_rank"))
    return Packing(pieces, slots, plan)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every piece of ``documents``."""
    slots = pack(documents(spark, sf_dir)).slots
    return slots.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                        "sequence_id", "offset")
