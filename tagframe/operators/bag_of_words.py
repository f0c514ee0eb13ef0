"""A bag-of-words text classifier trained in seeded mini-batches with dropout, pass by pass.

A document is its distinct token hashes with their counts, scaled to unit length;
two exclusive classes give one logistic score. A pass (epoch) visits every
training row once, in an order drawn anew from the seed: rows are dealt to a fixed
number of shards by that order, each shard takes its mini-batches one after the
other from the pass's first weights, and the shards' weights are averaged by their
rows (parallelised stochastic gradient descent, Zinkevich et al. 2010). One shard
is plain mini-batch training. The result depends on the seed and the number of
shards, not on partitions or machines.

All runs that are still training share a pass: rows are read, shuffled and
hashed once, and runs with one batch size differ only in a column of the weight
matrix. A run's weights after each pass are rows of a stored table, so a pass
always continues from the last one (no refit), and a job that starts again at the
same path goes on after the last whole pass.

A task holds ``ROWS`` rows, a mini-batch and the weights of the live runs (their number times
the number of features, both parameters); what reaches the driver is those
weights and four counts a run, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.operators import evaluate as V
from tagframe.operators import windows as W
from tagframe.operators.tagging import tokenize
from tagframe.session import scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL = "label_binary"
FEATURES = 1 << 16
DROPOUT = 0.2
SHARDS = 8
SEED = 42
#: rows whose features are worked out at a time
ROWS = 1024
#: learning rates of the sweep, in the place of the reference grid's four
SWEEP_RATES = (0.5, 1.0, 2.0, 4.0)


def hashed(df: DataFrame, col: str, key: str = "doc_id", features: int = FEATURES) -> DataFrame:
    """``(key, label, ids)``: the token hashes of every row, one a token, in order, stored: all passes read them."""
    ids = F.sort_array(F.transform(tokenize(F.coalesce(F.col(col), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int")))
    return stored(df.select(F.col(key).cast("long").alias("key"), F.col(LABEL).cast("int").alias("label"), ids.alias("ids")), "bag_of_words")


def kept(seed: int, epoch: int, key: np.ndarray, column: np.ndarray, dropout: float) -> np.ndarray:
    """Whether a feature of a row stays in this pass: a hash of (seed, pass, row, feature), below ``dropout`` it goes."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64)
        x ^= np.uint64((seed * 1_000_003 + epoch) & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xD6E8FEB86659FD93)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) >= dropout


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of at most ``ROWS`` rows: the arrays of their features are held at a time."""
    for frame in frames:
        for i in range(0, len(frame), ROWS):
            yield frame.iloc[i:i + ROWS]


def sparse_rows(ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row, their values (counts over the root of the sum of their squares), the row of each."""
    sizes = np.array([len(row) for row in ids], np.int64)
    flat = np.concatenate([np.asarray(row, np.int64) for row in ids]) if len(ids) else np.zeros(0, np.int64)
    both = np.repeat(np.arange(len(ids)), sizes) << 32 | flat
    if (both[1:] < both[:-1]).any():  # ``hashed`` stores them in order
        both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    n, owner = np.diff(np.append(first, len(both))), both[first] >> 32
    norm = np.sqrt(np.bincount(owner, n * n, len(ids)))
    return both[first] & 0xFFFFFFFF, n / norm[owner], owner


def scores(weights: np.ndarray, bias: np.ndarray, cols, vals, owner, n: int) -> np.ndarray:
    """``(rows, runs)`` probabilities of class 1; ``owner`` ascends."""
    z = np.zeros((n, weights.shape[1]))
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        z[owner[first]] = np.add.reduceat(vals[:, None] * weights[cols], first, axis=0)
    return 1.0 / (1.0 + np.exp(-(z + bias)))


def _loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    own = np.where(y[:, None] == 1, p, 1 - p)
    return -np.log(np.maximum(own, 1e-12)).sum(axis=0)


def step(weights, bias, rates, labels, cols, vals, owner) -> np.ndarray:
    """One mini-batch of sparse rows, in place; the summed loss of each run before the update."""
    p = scores(weights, bias, cols, vals, owner, len(labels))
    gap = (p - labels[:, None]) / len(labels)
    runs = weights.shape[1]
    at = (cols[:, None] * runs + np.arange(runs)).ravel()
    np.subtract.at(weights.reshape(-1), at, (vals[:, None] * gap[owner] * rates).ravel())
    bias -= rates * gap.sum(axis=0)
    return _loss(p, labels)


def _pass(groups: dict, state: dict, seed: int, epoch: int, dropout: float):
    """Rows of ``(shard, key, label, ids)`` in order → one row a (shard, batch size) with its weights.

    Features, values and dropout of the rows are worked out once a frame, for all batch sizes;
    rows that do not fill a mini-batch wait for the next frame.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, work, rest = None, {}, None

        def begin():
            return {b: {"w": state[b][0].copy(), "b": state[b][1].copy(), "rows": 0, "loss": np.zeros(len(r))}
                    for b, r in groups.items()}

        def train(part, last):
            """Whole mini-batches, at the end the short one too; returns the rows that a batch size has still to see."""
            cols, vals, owner = sparse_rows(list(part["ids"]))
            stay = kept(seed, epoch, part["key"].to_numpy(np.int64)[owner], cols, dropout)
            cols, vals, owner = cols[stay], vals[stay] / (1.0 - dropout), owner[stay]
            labels = part["label"].to_numpy()
            begins = np.searchsorted(owner, np.arange(len(part) + 1))
            first = min(s["rows"] for s in work.values())  # the place in the shard of the first row of ``part``
            for b, s in work.items():
                rates, n = np.array(groups[b]), len(part)
                i = s["rows"] - first
                while i + b <= n or last and i < n:
                    z = min(i + b, n)
                    own = slice(begins[i], begins[z])
                    s["loss"] += step(s["w"], s["b"], rates, labels[i:z], cols[own], vals[own], owner[own] - i)
                    i, s["rows"] = z, s["rows"] + z - i
            return part.iloc[min(s["rows"] for s in work.values()) - first:]

        def flush():
            if len(rest):
                train(rest, True)
            return pd.DataFrame([{"batch_size": b, "shard": shard, "n_rows": s["rows"], "loss": s["loss"].tolist(), "weights":
                                  np.vstack([s["w"], s["b"][None]]).astype("<f8").tobytes()} for b, s in work.items() if s["rows"]])

        for frame in _slices(frames):
            for own, part in frame.groupby("shard", sort=False):
                if own != shard:
                    if shard is not None:
                        yield flush()
                    shard, work, rest = own, begin(), part.iloc[:0]
                rest = train(pd.concat([rest, part]) if len(rest) else part, False)
        if shard is not None:
            yield flush()
    return run


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights of a batch size, averaged over the shards by their rows."""
    frame = frame.sort_values("shard")
    n = int(frame["n_rows"].sum())
    total = sum(np.frombuffer(w, "<f8") * k for w, k in zip(frame["weights"], frame["n_rows"]))
    loss = np.sum([np.asarray(x) for x in frame["loss"]], axis=0)
    return pd.DataFrame([{"batch_size": int(frame["batch_size"].iloc[0]), "n_rows": n, "loss": (loss / n).tolist(),
                          "weights": (total / n).astype("<f8").tobytes()}])


PARTS = "batch_size int, shard int, n_rows long, loss array<double>, weights binary"
STATE = "batch_size int, n_rows long, loss array<double>, weights binary"


def dealt(rows: DataFrame, seed: int, epoch: int, shards: int) -> DataFrame:
    """``(shard, key, label, ids)`` in this pass's order, every shard a task of its own."""
    order = W.shuffle_key("key", seed * 1_000 + epoch)
    keyed = rows.withColumn("sk", order).withColumn("shard", F.pmod(F.conv(F.substring("sk", 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))
    return keyed.repartitionById(shards, "shard").sortWithinPartitions("shard", "sk", "key").select("shard", "key", "label", "ids")


def one_pass(rows: DataFrame, groups: dict[int, tuple], state: dict, seed: int, epoch: int, dropout: float, shards: int) -> DataFrame:
    """One job: deal the rows to shards in this pass's order, train each shard, average; one row a batch size."""
    parts = dealt(rows, seed, epoch, shards).mapInPandas(_pass(groups, state, seed, epoch, dropout), PARTS)
    return parts.groupBy("batch_size").applyInPandas(_average, STATE)


def _outcomes(groups: dict, state: dict):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _slices(frames):
            cols, vals, owner = sparse_rows(list(f["ids"]))
            y, out = f["label"].to_numpy(), []
            for b, rates in groups.items():
                p = scores(*state[b], cols, vals, owner, len(y))
                hit, one, own = p >= 0.5, y[:, None] == 1, np.where(y[:, None] == 1, p, 1 - p)
                nll = -np.log(np.maximum(own, 1e-12)).sum(axis=0)
                out += [(b, rate, int((hit & one)[:, i].sum()), int((hit & ~one)[:, i].sum()), int((~hit & one)[:, i].sum()),
                         int((~hit & ~one)[:, i].sum()), float(nll[i])) for i, rate in enumerate(rates)]
            yield pd.DataFrame(out, columns=["batch_size", "rate", "tp", "fp", "fn", "tn", "nll"])
    return run


def outcomes(rows: DataFrame, groups: dict, state: dict) -> DataFrame:
    """Counts of right and wrong rows and the mean loss of every run; rows are scored where they lie."""
    by = ["batch_size", "rate"]
    parts = rows.select("label", "ids").mapInPandas(_outcomes(groups, state), "batch_size int, rate double, tp long, fp long, fn long, tn long, nll double")
    counts = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "nll")])
    metrics = V.metrics_from_counts(counts, by)
    loss = counts.select(*by, (F.col("nll") / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("loss"))
    return metrics.join(loss, by)


def passes(rows: DataFrame, groups: dict[int, tuple], seed: int = SEED, dropout: float = DROPOUT, shards: int = SHARDS,
           features: int = FEATURES, path: str | None = None, zero: bool = True):
    """Generator of ``(epoch, groups, state, losses)`` after each pass; ``send`` the groups that go on.

    ``groups``: batch size → learning rates. ``state``: batch size → (weights, bias), one column a rate.
    Each pass's state is a folder below ``path``; passes already there are read, not run again.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "training-state")
    state = {b: (np.zeros((features, len(r))), np.zeros(len(r))) for b, r in groups.items()}
    epoch = 0
    while groups:
        epoch += 1
        at = f"{path}/pass-{epoch}"
        if not _written(spark, at):
            one_pass(rows, groups, state, seed, epoch, dropout, shards).write.mode("overwrite").parquet(at)
        got = {r["batch_size"]: r for r in spark.read.schema(STATE).parquet(at).collect()}
        for b, rates in groups.items():
            if b in got:  # without rows the weights stay
                w = np.frombuffer(got[b]["weights"], "<f8").reshape(features + 1, len(rates))
                state[b] = (w[:-1].copy(), w[-1].copy())
        going = yield epoch, dict(groups), state, {b: list(got[b]["loss"]) if b in got else [None] * len(r) for b, r in groups.items()}
        if going is not None:
            state = {b: tuple(x[..., [list(groups[b]).index(r) for r in rates]] for x in state[b]) for b, rates in going.items()}
            groups = going


def _written(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def fit(rows: DataFrame, epochs: int = 10, batch_size: int = 8, rate: float = 1.0, **params) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``epochs`` passes."""
    for epoch, _, state, _ in passes(rows, {batch_size: (rate,)}, **params):
        if epoch == epochs:
            return state[batch_size]


def _predictor(weights: np.ndarray, bias: np.ndarray):
    def run(frames):
        for f in _slices(frames):
            p = scores(weights, bias, *sparse_rows(list(f["ids"])), len(f))[:, 0]
            yield pd.DataFrame({"key": f["key"], "label": f["label"], "prediction": (p >= 0.5).astype("int32"), "confidence": p})
    return run


def predict(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id") -> DataFrame:
    """``(key, label_binary, prediction, confidence)``; class 1 from 0.5 on."""
    got = rows.mapInPandas(_predictor(*model), "key long, label int, prediction int, confidence double")
    return got.select(F.col("key").alias(key), F.col("label").alias(LABEL), "prediction", "confidence")


def training_log(train: DataFrame, valid: DataFrame, col: str, run: str, max_epochs: int = 10, batch_size: int = 8, rate: float = 1.0,
                 key: str = "doc_id", features: int = FEATURES, **params) -> DataFrame:
    """M8: the log of one fit: for every pass a train event with its mean loss and an eval event with validation metrics."""
    spark = train.sparkSession
    t, v = hashed(train, col, key, features), hashed(valid, col, key, features)
    rows = []
    for epoch, groups, state, losses in passes(t, {batch_size: (rate,)}, features=features, **params):
        m = outcomes(v, groups, state).first()
        rows.append((run, 2 * epoch - 1, float(epoch), losses[batch_size][0], *[None] * 5))
        rows.append((run, 2 * epoch, float(epoch), None, *([m[c] for c in ("loss", "accuracy", "f1", "precision", "recall")] if m else [None] * 5)))
        if epoch == max_epochs:
            break
    return spark.createDataFrame(rows, "run string, event_no long, epoch double, loss double, eval_loss double, eval_accuracy double, "
                                       "eval_f1 double, eval_precision double, eval_recall double")


def sweep(train: DataFrame, valid: DataFrame, col: str, grid: DataFrame, patience: int = 5, key: str = "doc_id",
          features: int = FEATURES, **params) -> DataFrame:
    """Every config of ``grid(name, epochs, batch_size, lr)`` with early stopping on the validation F1.

    One pass a round for all runs that a config still waits for, each from its own last weights; configs that
    differ in ``epochs`` alone share a run. A config ends ``patience`` passes after its best one or at its
    ``epochs`` (W6, on the driver for the few dozen configs). One row a config: its parameters, ``best_epoch``,
    ``final_epoch``, the metrics at its best epoch, and ``passes``, the number of passes its run had made by then.
    """
    spark = train.sparkSession
    configs = [r.asDict() for r in grid.select("name", "epochs", "batch_size", "lr").collect()]
    t, v = hashed(train, col, key, features), hashed(valid, col, key, features)
    best = {c["name"]: (0, None) for c in configs}
    live = {c["name"]: c for c in configs}
    made, out = {}, []

    def needed():
        rates: dict[int, set] = {}
        for c in live.values():
            rates.setdefault(c["batch_size"], set()).add(c["lr"])
        return {b: tuple(sorted(r)) for b, r in sorted(rates.items())}

    rounds = passes(t, needed(), features=features, **params)
    going = None
    while live:
        epoch, groups, state, _ = rounds.send(going) if going is not None else next(rounds)
        for b, rates in groups.items():
            for r in rates:
                made[b, r] = made.get((b, r), 0) + 1
        scored = {(r["batch_size"], r["rate"]): r for r in outcomes(v, groups, state).collect()}
        for name, c in list(live.items()):
            m = scored.get((c["batch_size"], c["lr"]))
            at, old = best[name]
            if old is None or m and m["f1"] > old["f1"]:
                at, old = best[name] = epoch, m
            if epoch - at >= patience or epoch >= c["epochs"]:
                row = [name, c["epochs"], c["batch_size"], c["lr"], at, epoch, *[float(old[x]) if old else None for x in (
                    "f1", "accuracy", "precision", "recall")], made[c["batch_size"], c["lr"]]]
                out.append(tuple(row))
                del live[name]
        going = needed()
    rounds.close()
    return spark.createDataFrame(out, "name string, epochs int, batch_size int, lr double, best_epoch int, final_epoch int, "
                                      "best_f1 double, accuracy double, precision double, recall double, passes int")
