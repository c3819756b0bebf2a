"""A dense network under a focal loss, trained by gradient steps that Spark adds up.

Spark's own network has no weights, no other loss and no warm start. Here each task works out the
gradient of its rows with NumPy, one row per task comes out, and the rows are added in two steps:
as many groups as the square root of the tasks first, those on the driver then. The driver holds
weights and their gradients, never rows. What a step sees of a row, its part of the epoch and the
units it drops, follows from a hash of its key, so the weights don't depend on how rows are dealt.

Several networks, one for each fold, are trained in the same pass: a row counts for all of them but
the one that holds it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Probabilities and the loss stay this far from 0 and 1.
EDGE = 1e-7
#: Rows of a block, and blocks as a table: the numbers of each column one after the other.
BLOCK_ROWS = 8192
BLOCK_DDL = "n int, key binary, fold binary, x binary, label binary"
SUM_DDL = "model int, bucket int, n bigint, loss double, total array<double>"


@dataclass(frozen=True)
class Training:
    """How a network is trained; `alpha` None is the plain cross-entropy."""

    hidden: tuple[int, ...] = (64, 32)
    epochs: int = 30
    batches: int = 4
    rate: float = 1e-3
    decay: float = 1e-4
    clip: float | None = 1.0
    dropout: float = 0.4
    alpha: float | None = 0.75
    gamma: float = 2.0
    seed: int = 42


@dataclass
class Network:
    """Weights and biases of each layer, and what inputs are scaled by."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    std: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for layer in self.layers for a in layer])

    def with_flat(self, values: np.ndarray) -> Network:
        layers, at = [], 0
        for w, b in self.layers:
            layers.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(layers, self.mean, self.std)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self, x, None)[-1][:, 0])

    def save(self, spark: SparkSession, folder: str) -> None:
        """One row of numbers; what was there is replaced."""
        sizes = [self.layers[0][0].shape[0], *[len(b) for _, b in self.layers]]
        row = (sizes, self.flat().tolist(), self.mean.tolist(), self.std.tolist())
        spark.createDataFrame([row], "sizes array<int>, weights array<double>, mean array<double>, std array<double>").coalesce(1).write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Network:
        r = spark.read.parquet(folder).first()
        blank = [(np.zeros((a, b)), np.zeros(b)) for a, b in zip(r.sizes, r.sizes[1:])]
        return Network(blank, np.array(r.mean), np.array(r.std)).with_flat(np.array(r.weights))


def initial(sizes: tuple[int, ...], mean: np.ndarray, std: np.ndarray, seed: int) -> Network:
    """Even weights up to one over the root of the inputs, the same for the same seed."""
    rng, layers = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        reach = 1 / np.sqrt(a)
        layers.append((rng.uniform(-reach, reach, (a, b)), rng.uniform(-reach, reach, b)))
    return Network(layers, mean, std)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.clip(0.5 * (1 + np.tanh(0.5 * z)), EDGE, 1 - EDGE)


def mixed(keys: np.ndarray, *numbers: int) -> np.ndarray:
    """Hashes of keys and some numbers."""
    x = keys.astype(np.uint64)
    for n in numbers:
        x = x ^ np.uint64((n + 1) * int(_STEP) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        x ^= x >> np.uint64(31)
    return x


def _masks(keys: np.ndarray, widths: list[int], step: int, training: Training) -> list[np.ndarray]:
    """What each hidden unit of each row is multiplied by: 0 if it is dropped, else more than 1 in turn."""
    bound, out = np.uint64(int(training.dropout * (1 << 53))), []
    for layer, width in enumerate(widths):
        units = np.arange(width, dtype=np.uint64) * _STEP
        drawn = mixed((mixed(keys, training.seed, step, layer)[:, None] + units).ravel(), layer).reshape(-1, width)
        out.append((drawn >> np.uint64(11) >= bound) / (1 - training.dropout))
    return out


def _forward(net: Network, x: np.ndarray, masks: list[np.ndarray] | None) -> list[np.ndarray]:
    """The inputs of each layer, and the output."""
    values = [(x - net.mean) / net.std]
    for k, (w, b) in enumerate(net.layers):
        z = values[-1] @ w + b
        if k + 1 < len(net.layers):
            z = np.maximum(z, 0)
            z = z if masks is None else z * masks[k]
        values.append(z)
    return values


def losses(p: np.ndarray, y: np.ndarray, alpha: float | None, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row and its slope by the output before the sigmoid."""
    if alpha is None:
        return -np.where(y == 1, np.log(p), np.log(1 - p)), p - y
    q, weight, sign = np.where(y == 1, p, 1 - p), np.where(y == 1, alpha, 1 - alpha), np.where(y == 1, 1.0, -1.0)
    rest = 1 - q
    return -weight * rest**gamma * np.log(q), sign * weight * rest**gamma * (gamma * q * np.log(q) - rest)


def gradient(net: Network, keys: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, training: Training) -> tuple[float, np.ndarray]:
    """The sums over some rows of the loss and of its gradient."""
    masks = _masks(keys, [len(b) for _, b in net.layers[:-1]], step, training) if training.dropout else None
    values = _forward(net, x, masks)
    loss, slope = losses(_sigmoid(values[-1][:, 0]), y, training.alpha, training.gamma)
    back, parts = slope[:, None], []
    for k in range(len(net.layers) - 1, -1, -1):
        parts += [back.sum(axis=0), (values[k].T @ back).ravel()]
        if k:
            back = (back @ net.layers[k][0].T) * (values[k] > 0) * (1 if masks is None else masks[k - 1])
    return float(loss.sum()), np.concatenate(parts[::-1])


class AdamW:
    """The steps of one network's weights."""

    def __init__(self, size: int, rate: float, decay: float = 0.0, clip: float | None = None):
        self.rate, self.decay, self.clip, self.m, self.v, self.t = rate, decay, clip, np.zeros(size), np.zeros(size), 0

    def __call__(self, weights: np.ndarray, slope: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(slope)
        slope = slope if self.clip is None or length <= self.clip else slope * (self.clip / length)
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * slope, 0.999 * self.v + 0.001 * slope**2
        step = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return weights * (1 - self.rate * self.decay) - self.rate * step


def keyed(rows: DataFrame, inputs: Column, *keys: str, fold: Column | None = None) -> DataFrame:
    """The rows with `_x`, their inputs as an array, `_key`, a hash of their key, and `_fold`, -1 where none is held out."""
    return rows.withColumns({"_x": inputs.cast("array<double>"), "_key": F.xxhash64(*keys), "_fold": F.lit(-1) if fold is None else fold.cast("int")})


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    out = []
    for n in names:
        c = batch.column(batch.schema.get_field_index(n))
        out.append(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))
    return out


def packed(rows: DataFrame) -> DataFrame:
    """The key, fold, inputs and label of the rows in blocks of numbers, which the passes of a training take as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                kinds = (np.int64, np.int32, np.float64, np.float64)
                block = [np.ascontiguousarray(a, t).tobytes() for a, t in zip(_arrays(batch, "_key", "_fold", "_x", "label"), kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *[pa.array([b], pa.binary()) for b in block]], ["n", "key", "fold", "x", "label"])

    return rows.select("_key", "_fold", "_x", "label").mapInArrow(run, BLOCK_DDL)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, fold, x and label of each block."""
    for n, *block in zip(*[batch.column(i) for i in range(5)]):
        key, fold, x, y = (np.frombuffer(b.as_buffer(), t) for b, t in zip(block, (np.uint64, np.int32, np.float64, np.float64)))
        yield key, fold, x.reshape(n.as_py(), -1), y


def _of_task(work, fan: int):
    """One row for each model of a task: what `work` adds up over its blocks, as {model: (n, loss, total)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for block in _blocks(batch):
                for model, (n, loss, total) in work(*block).items():
                    a = sums.get(model, (0, 0.0, 0.0))
                    sums[model] = (a[0] + n, a[1] + loss, a[2] + total)
        if sums:
            bucket = TaskContext.get().partitionId() % fan
            columns = zip(*[(m, bucket, n, loss, total) for m, (n, loss, total) in sums.items()])
            types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["model", "bucket", "n", "loss", "total"])

    return run


def _added(group: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(v) for v in group["total"].to_numpy()], axis=0)
    row = {"model": group["model"][0].as_py(), "bucket": group["bucket"][0].as_py(), "n": sum(group["n"].to_pylist()), "loss": sum(group["loss"].to_pylist()), "total": total.tolist()}
    return pa.Table.from_pylist([row], group.schema)


def summed(blocks: DataFrame, work, tasks: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """{model: (n, loss, total)} over all rows of `packed` blocks, added in groups first where there are many tasks."""
    fan = max(1, int(np.ceil(np.sqrt(tasks))))
    parts = blocks.mapInArrow(_of_task(work, fan), SUM_DDL)
    if tasks > 16:
        parts = parts.groupBy("model", "bucket").applyInArrow(_added, SUM_DDL)
    out: dict = {}
    for r in sorted(parts.collect(), key=lambda r: (r.model, r.bucket)):  # a few vectors of weights
        a = out.get(r.model, (0, 0.0, 0.0))
        out[r.model] = (a[0] + r.n, a[1] + r.loss, a[2] + np.array(r.total))
    return out


def scaling(blocks: DataFrame, models: list[int], tasks: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{model: (mean, std)} of the inputs of the rows that a model is trained on, with population deviations plus 1e-8."""

    def work(key: np.ndarray, fold: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        return {int(k): (int((fold == k).sum()), 0.0, np.concatenate([x[fold == k].sum(axis=0), (x[fold == k] ** 2).sum(axis=0)])) for k in np.unique(fold)}

    by_fold, out = summed(blocks, work, tasks), {}
    for m in models:
        own = [v for k, v in by_fold.items() if k != m or m == -1]
        n, total = sum(v[0] for v in own), sum(v[2] for v in own)
        mean, square = np.split(total / n, 2)
        out[m] = (mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-8)
    return out


def fit(rows: DataFrame, training: Training = Training()) -> dict[int, Network]:
    """{fold: network}, each trained on the rows of all other folds; {-1: network} where no row has a fold.

    `rows` are `keyed` and have `label`, 0 or 1. Without rows to train on there is a ValueError.
    """
    tasks, blocks = rows.rdd.getNumPartitions(), packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = sorted(r[0] for r in rows.select("_fold").distinct().collect())  # as many as folds
        if not folds or len(folds) == 1 and folds != [-1]:
            raise ValueError("there are no rows to fit on")
        nets = {}
        for k, (mean, std) in scaling(blocks, folds, tasks).items():
            nets[k] = initial((len(mean), *training.hidden, 1), mean, std, training.seed)
        return _steps(blocks, tasks, nets, training, training.epochs * training.batches)
    finally:
        blocks.unpersist()


def _steps(blocks: DataFrame, tasks: int, nets: dict[int, Network], training: Training, steps: int) -> dict[int, Network]:
    optimizers = {k: AdamW(len(n.flat()), training.rate, training.decay, training.clip) for k, n in nets.items()}
    for step in range(steps):
        for k, (n, _, total) in summed(blocks, gradients(nets, step, training), tasks).items():
            nets[k] = nets[k].with_flat(optimizers[k](nets[k].flat(), total / n))
    return nets


def gradients(nets: dict[int, Network], step: int, training: Training):
    """The gradients of one step: of the rows whose part of the epoch it is."""
    epoch, part = divmod(step, training.batches)

    def work(key: np.ndarray, fold: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
        found = {}
        mine = mixed(key, training.seed, epoch) % np.uint64(training.batches) == part
        for k, net in nets.items():
            use = mine & ((fold != k) | (k == -1))
            if use.any():
                loss, total = gradient(net, key[use], x[use], y[use], step, training)
                found[k] = (int(use.sum()), loss, total)
        return found

    return work


def scores(rows: DataFrame, nets: dict[int, Network], *keys: str) -> DataFrame:
    """(keys, prob): each row by the network of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = _arrays(batch, "_fold", "_x")
            prob = np.zeros(len(fold))
            for k in np.unique(fold).tolist():
                prob[fold == k] = nets[k].probabilities(x[fold == k])
            own = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(prob)], [*keys, "prob"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*keys, "_fold", "_x").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", prob double")


def hidden(rows: DataFrame, nets: dict[int, Network], *keys: str) -> DataFrame:
    """(keys, vector): the values of the last hidden layer, by the network of each row's fold; nothing is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = _arrays(batch, "_fold", "_x")
            width = len(next(iter(nets.values())).layers[-2][1])
            vectors = np.zeros((len(fold), width))
            for k in np.unique(fold).tolist():
                vectors[fold == k] = _forward(nets[k], x[fold == k], None)[-2]
            own = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(list(vectors), pa.list_(pa.float64()))], [*keys, "vector"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*keys, "_fold", "_x").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", vector array<double>")


def corrected(net: Network, corrections: DataFrame, steps: int = 3, rate: float = 1e-4) -> Network:
    """The network after a few steps of Adam from its stored weights, towards the labels of a table of corrections.

    The loss is the plain cross-entropy of all corrections, nothing is dropped or decayed. Without
    corrections the network is as it was. Adam moves a weight by about `rate` a step at most, so no
    output moves by more than `reach` says.
    """
    training = Training(batches=1, rate=rate, decay=0.0, clip=None, dropout=0.0, alpha=None)
    return _steps(packed(corrections), corrections.rdd.getNumPartitions(), {-1: net}, training, steps)[-1]


def reach(net: Network, moved: Network, x: np.ndarray) -> np.ndarray:
    """How far the probability of each row may have moved: a quarter of a bound on its output's move."""
    near, far = np.abs((x - net.mean) / net.std), np.zeros_like(x)
    for k, ((w, b), (v, c)) in enumerate(zip(net.layers, moved.layers)):
        # |h'v + c - hw - b| <= |h' - h| |v| + |h| |v - w| + |c - b|, and a rectified output moves no more.
        far = far @ np.abs(v) + near @ np.abs(v - w) + np.abs(c - b)
        near = near @ np.abs(w) + np.abs(b)
    return far[:, 0] / 4
