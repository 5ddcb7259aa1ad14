"""Denoising autoencoders, alone and stacked under a softmax, trained by Spark steps.

Executors hold the rows of each mini-batch as blocks of numpy arrays. A step
sends the weights to the tasks, each of which sums the gradient of its rows of
one mini-batch; these vectors, as long as there are parameters, are added up,
and the driver moves the weights. Rows belong to mini-batches, and
are corrupted, by the hash of their key, so a rerun or another partitioning
takes the same steps (up to the rounding of sums).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SMALL = 1e-12

#: value and derivative (from the input and the value) of each activation
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "sigmoid": (lambda a: 1 / (1 + np.exp(-np.clip(a, -500, 500))), lambda a, y: y * (1 - y)),
    "tanh": (np.tanh, lambda a, y: 1 - y * y),
    "softplus": (lambda a: np.logaddexp(0, a), lambda a, y: 1 / (1 + np.exp(-np.clip(a, -500, 500)))),
    "rectifier": (lambda a: np.maximum(a, 0), lambda a, y: (a > 0).astype(float)),
    "linear": (lambda a: a, lambda a, y: np.ones_like(a)),
}


@dataclass(frozen=True)
class Autoencoder:
    """Weights (visible x hidden), the biases of both sides, and what the loss is. ``back`` is null where the weights are tied."""

    weights: np.ndarray
    hidden_bias: np.ndarray
    visible_bias: np.ndarray
    back: np.ndarray | None = None
    act_enc: str = "sigmoid"
    act_dec: str = "sigmoid"
    cost: str = "CE"
    reg: float = 0.0

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.weights, self.hidden_bias, self.visible_bias, *([] if self.back is None else [self.back])]

    def moved(self, steps: list[np.ndarray]) -> Autoencoder:
        new = [p + s for p, s in zip(self.parameters, steps, strict=True)]
        return replace(self, weights=new[0], hidden_bias=new[1], visible_bias=new[2], back=new[3] if len(new) > 3 else None)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return ACTIVATIONS[self.act_enc][0](x @ self.weights + self.hidden_bias)

    def reconstructed(self, hidden: np.ndarray) -> np.ndarray:
        return ACTIVATIONS[self.act_dec][0](hidden @ (self.weights.T if self.back is None else self.back) + self.visible_bias)

    def loss_and_gradient(self, x: np.ndarray, corrupted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss of reconstructing ``x`` from ``corrupted``, summed over rows, and its gradient.

        CE is the cross-entropy (of (x + 1) / 2 where the encoder is tanh), MSE
        the squared error; ``jacobi`` before either adds ``reg`` times the
        squared sigmoid Jacobian of the encoder.
        """
        encode, encode_slope = ACTIVATIONS[self.act_enc]
        decode, decode_slope = ACTIVATIONS[self.act_dec]
        back = self.weights.T if self.back is None else self.back
        a = corrupted @ self.weights + self.hidden_bias
        y = encode(a)
        c = y @ back + self.visible_bias
        z = decode(c)
        if self.cost.endswith("CE"):
            wanted = (x + 1) / 2 if self.act_enc == "tanh" else x
            inside = np.clip(z, _SMALL, 1 - _SMALL)
            loss = -(wanted * np.log(inside) + (1 - wanted) * np.log(1 - inside)).sum()
            # the sigmoid's slope cancels against that of the cross-entropy
            dc = z - wanted if self.act_dec == "sigmoid" else (inside - wanted) / (inside * (1 - inside)) * decode_slope(c, z)
        elif self.cost.endswith("MSE"):
            loss = ((x - z) ** 2).sum()
            dc = 2 * (z - x) * decode_slope(c, z)
        else:
            raise ValueError(f"no cost {self.cost}")
        dy = dc @ back.T
        own = np.zeros_like(self.weights)
        if self.cost.startswith("jacobi"):
            s, q = y * (1 - y), (self.weights**2).sum(0)
            loss += self.reg * (s * s * q).sum()
            own += 2 * self.reg * self.weights * (s * s).sum(0)
            dy = dy + 2 * self.reg * s * (1 - 2 * y) * q
        da = dy * encode_slope(a, y)
        own += corrupted.T @ da
        backward = y.T @ dc
        if self.back is None:
            return float(loss), [own + backward.T, da.sum(0), dc.sum(0)]
        return float(loss), [own, da.sum(0), dc.sum(0), backward]


@dataclass(frozen=True)
class Network:
    """Layers of (weights, bias) with one activation, the last of which is a softmax."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    act: str = "sigmoid"

    @property
    def parameters(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in layer]

    def moved(self, steps: list[np.ndarray]) -> Network:
        new = [p + s for p, s in zip(self.parameters, steps, strict=True)]
        return replace(self, layers=list(zip(new[::2], new[1::2], strict=True)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1][1]

    def _forward(self, x: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
        out: list[tuple[np.ndarray | None, np.ndarray]] = [(None, x)]
        for k, (w, b) in enumerate(self.layers):
            a = out[-1][1] @ w + b
            if k < len(self.layers) - 1:
                out.append((a, ACTIVATIONS[self.act][0](a)))
            else:
                e = np.exp(a - a.max(1, keepdims=True)) if len(a) else a
                out.append((a, e / e.sum(1, keepdims=True)))
        return out

    def loss_and_gradient(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The negative log-likelihood summed over rows, and its gradient."""
        passed = self._forward(x)
        p = passed[-1][1]
        rows = np.arange(len(label))
        loss = -np.log(np.maximum(p[rows, label], _SMALL)).sum()
        d = p.copy()
        d[rows, label] -= 1
        gradient: list[np.ndarray] = []
        for k in range(len(self.layers) - 1, -1, -1):
            gradient = [passed[k][1].T @ d, d.sum(0), *gradient]
            if k:
                a, y = passed[k]
                d = (d @ self.layers[k][0].T) * ACTIVATIONS[self.act][1](a, y)
        return float(loss), gradient


@dataclass
class Patience:
    """When to stop: after ``iteration`` steps unless the error fell enough, in which case it waits ``grow`` times as long.

    ``first`` epochs are always waited for. An error is an improvement worth
    waiting for if it is under ``threshold`` times the best one before.
    """

    batches: int
    first: int = 10
    grow: float = 2.0
    threshold: float = 0.995
    best: float = field(default=np.inf, init=False)
    best_iteration: int = field(default=-1, init=False)
    patience: float = field(default=0.0, init=False)

    def __post_init__(self) -> None:
        self.patience = self.first * self.batches

    def better(self, iteration: int, error: float) -> bool:
        """Whether the error after this step is the best so far; takes note of it."""
        if not error < self.best:
            return False
        if error < self.best * self.threshold:
            self.patience = max(self.patience, iteration * self.grow)
        self.best, self.best_iteration = error, iteration
        return True

    def over(self, iteration: int) -> bool:
        return self.patience <= iteration


def uniform(key: np.ndarray, stream: int, columns: int) -> np.ndarray:
    """Numbers in (0, 1) by 64-bit key, stream and column: a multiplicative hash, the same wherever a row lies."""
    x = key.astype(np.int64).view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, columns + 1, dtype=np.uint64) + np.uint64(stream * 1_000_003))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def corrupted(x: np.ndarray, key: np.ndarray, level: float, noise: str, stream: int) -> np.ndarray:
    """mask: each value 0 with probability ``level``; gaussian: ``level`` is the deviation of what is added."""
    n = x.shape[1]
    if noise == "mask":
        return x * (uniform(key, 2 * stream, n) >= level)
    if noise == "gaussian":
        u, v = uniform(key, 2 * stream, n), uniform(key, 2 * stream + 1, n)
        return x + level * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    raise ValueError(f"no noise {noise}")


def batched(df: DataFrame, columns: list[str], key: str, batches: int, label: str | None = None) -> DataFrame:
    """(_key, _batch, _x, _label): features as one array of doubles, nulls as 0; rows with a null label are left out."""
    hashed = F.xxhash64(key)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    y = F.lit(0) if label is None else F.col(label).cast("int")
    rows = df.select(hashed.alias("_key"), F.pmod(F.xxhash64(key, F.lit("batch")), F.lit(batches)).cast("int").alias("_batch"), x.alias("_x"), y.alias("_label"))
    return rows.where("_label is not null")


def compacted(rows: DataFrame, in_task: int = 250_000) -> DataFrame:
    """The rows, persisted in as many partitions as there are cores, or as ``in_task`` rows each need.

    Every step runs a task for each partition, so the many small ones that a
    shuffle leaves would cost more than the gradients do.
    """
    found = rows.persist()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-found.count() // in_task))
    held = found.coalesce(parts).persist()
    held.count()
    found.unpersist()
    return held


def blocks(rows: DataFrame, in_block: int = 2000) -> RDD:
    """The rows of each partition as blocks of arrays, (x, key, label), of ``in_block`` rows at most, whose layers fit a core's cache."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, in_block):
                key, x, label = batch.slice(at, in_block).columns
                arrays = x.flatten().to_numpy(zero_copy_only=False).astype("<f8"), key.to_numpy().astype("<i8"), label.to_numpy().astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in arrays], names=["x", "key", "label"])

    def arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.frombuffer(row["key"], "<i8")
        return np.frombuffer(row["x"], "<f8").reshape(len(key), -1), key, np.frombuffer(row["label"], "<i4")

    return rows.select("_key", "_x", "_label").mapInArrow(packed, "x binary, key binary, label binary").rdd.map(arrays)


def held(rows: DataFrame, batches: int = 1, least: int = 20_000, most: int = 250_000) -> list[RDD]:
    """The blocks of each mini-batch, persisted in a partition for each core, but in fewer if these have under ``least`` rows and in more if over ``most``.

    A fit takes hundreds of steps, each a job of one stage over these; from a
    table it would be planned, shuffled and brought into arrays every time.
    """
    whole = compacted(rows)
    context, sizes = rows.sparkSession.sparkContext, {r["_batch"]: r["count"] for r in whole.groupBy("_batch").count().collect()}
    number = lambda n: max(1, min(-(-n // least), max(context.defaultParallelism, -(-n // most))))
    parts = [blocks(whole.where(F.col("_batch") == b)).coalesce(number(sizes.get(b, 0))).persist(StorageLevel.MEMORY_AND_DISK) for b in range(batches)]
    context.union(parts).count()
    whole.unpersist()
    return parts


def summed(rows: RDD | DataFrame, of_block: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of_block(x, key, label)``, a vector of fixed length: added up in tasks, then between them, in two levels if there are many; empty without rows."""
    parts = blocks(rows) if isinstance(rows, DataFrame) else rows
    total = parts.treeAggregate(None, lambda t, block: _plus(t, of_block(*block)), _plus, depth=1 if parts.getNumPartitions() <= 64 else 2)
    return np.zeros(0) if total is None else total


def _plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b


def _flat(loss: float, gradient: list[np.ndarray], n: int) -> np.ndarray:
    return np.concatenate([[n, loss], *[g.ravel() for g in gradient]])


def _step(model, total: np.ndarray, rate: float):
    """The model moved against the mean gradient, and the mean loss; as it is where no row was there."""
    if not len(total):
        return model, 0.0, 0.0
    n, loss, at, steps = total[0], total[1], 2, []
    for p in model.parameters:
        steps.append(-rate * total[at : at + p.size].reshape(p.shape) / n)
        at += p.size
    return model.moved(steps), loss, n


def autoencoder_step(rows: RDD | DataFrame, model: Autoencoder, rate: float, level: float, noise: str, stream: int, below: Callable[[np.ndarray], np.ndarray] | None = None):
    """One step over ``rows``: (model, summed loss, number of rows). ``below`` gives the input from the features."""

    def block(x: np.ndarray, key: np.ndarray, label: np.ndarray) -> np.ndarray:
        x = below(x) if below else x
        return _flat(*model.loss_and_gradient(x, corrupted(x, key, level, noise, stream)), len(x))

    return _step(model, summed(rows, block), rate)


def started(visible: int, hidden: int, seed: int, tied: bool = True, **how) -> Autoencoder:
    """Weights drawn uniformly within 4 sqrt(6 / (visible + hidden)), biases of 0."""
    rng, bound = np.random.default_rng(seed), 4 * np.sqrt(6 / (visible + hidden))
    weights = rng.uniform(-bound, bound, (visible, hidden))
    return Autoencoder(weights, np.zeros(hidden), np.zeros(visible), None if tied else rng.uniform(-bound, bound, (hidden, visible)), **how)


def fit_autoencoder(
    df: DataFrame, columns: list[str], key: str, hidden: int, level: float = 0.35, noise: str = "mask", rate: float = 0.1, epochs: int = 15, batches: int = 8, seed: int = 1, tied: bool = True, **how
) -> tuple[Autoencoder, DataFrame]:
    """A denoising autoencoder of ``columns`` (CE wants them in 0..1), and (epoch, error): the mean loss of each epoch.

    ``how``: act_enc and act_dec (sigmoid, tanh, softplus, rectifier, linear),
    cost (CE, MSE, jacobiCE, jacobiMSE) and reg. Nulls are 0. Repeated keys are
    corrupted alike. Without rows the weights stay as drawn and errors are null.
    """
    rows = held(batched(df, columns, key, batches), batches)
    model, history = started(len(columns), hidden, seed, tied, **how), []
    model = _trained(rows, model, rate, level, noise, epochs, None, history)
    for batch in rows:
        batch.unpersist()
    return model, df.sparkSession.createDataFrame([(k, e) for k, e in enumerate(history)], "epoch int, error double")


def _trained(rows, model, rate, level, noise, epochs, below, history):
    for epoch in range(epochs):
        loss = n = 0.0
        for batch in rows:
            model, more, count = autoencoder_step(batch, model, rate, level, noise, epoch, below)
            loss, n = loss + more, n + count
        history.append(float(loss / n) if n else None)
    return model


def with_hidden(df: DataFrame, model: Autoencoder, columns: list[str], into: str = "hidden") -> DataFrame:
    """``df`` with an array of the hidden values of ``columns``, in whose names the model was fitted."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])

    @F.pandas_udf("array<double>")
    def encoded(values: pd.Series) -> pd.Series:
        return pd.Series(list(model.hidden(np.stack(values.to_numpy()))) if len(values) else [])

    return df.withColumn(into, encoded(x))


def class_error(rows: RDD | DataFrame, network: Network, classes: int) -> tuple[float | None, int]:
    """Mean distance of the likeliest class from the label over (classes - 1), and the number of rows."""

    def block(x: np.ndarray, key: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.array([len(x), np.abs(network.probabilities(x).argmax(1) - label).sum()], float)

    total = summed(rows, block)
    return (float(total[1] / total[0] / (classes - 1)), int(total[0])) if len(total) else (None, 0)


def fine_tune(train: list[RDD], valid: RDD, network: Network, classes: int, rate: float, epochs: int, first: int = 10) -> tuple[Network, Patience, int]:
    """Descends on the log-likelihood, by the mini-batches in turn, until patience is over: the network of the least validation error, the rule's state, and the epochs run."""
    batches = len(train)
    rule, best, epoch = Patience(batches, first), network, 0
    for epoch in range(1, epochs + 1):
        for b, batch in enumerate(train):
            now = network
            network = _step(now, summed(batch, lambda x, key, label, now=now: _flat(*now.loss_and_gradient(x, label), len(x))), rate)[0]
            iteration = (epoch - 1) * batches + b
            if b == batches - 1:  # the error is looked at once an epoch
                error = class_error(valid, network, classes)[0]
                if error is not None and rule.better(iteration, error):
                    best = network
            if rule.over(iteration):
                return best, rule, epoch
    return best, rule, epoch


def fit_stacked(
    train: DataFrame, valid: DataFrame, columns: list[str], label: str, key: str, classes: int, layers: list[int], levels: list[float], noise: str = "mask", pretrain_rate: float = 0.1, pretrain_epochs: int = 15,
    rate: float = 0.5, epochs: int = 1000, batches: int = 8, seed: int = 1, act: str = "sigmoid", cost: str = "CE", reg: float = 0.0, first: int = 10,
) -> tuple[Network, DataFrame, Patience]:
    """Autoencoders one on top of the other, then a softmax over the last and descent through all layers.

    Each layer is trained on the hidden values of those below, which tasks work
    out from the features. Gives the network of the least validation error
    (``class_error``), (layer, epoch, error) of the pre-training, and the
    stopping rule's state. No layers give the plain softmax of the features.
    ``epochs`` bounds a descent that its rule does not end.
    """
    if len(layers) != len(levels):
        raise ValueError("one corruption level for each layer")
    learn, judge = held(batched(train, columns, key, batches, label), batches), held(batched(valid, columns, key, 1, label))[0]
    stack: list[Autoencoder] = []
    shown = []
    for k, (hidden, level) in enumerate(zip(layers, levels, strict=True)):
        below = list(stack)
        history: list[float | None] = []
        model = started([len(columns), *layers][k], hidden, seed + k, act_enc=act, act_dec=act, cost=cost, reg=reg)
        stack.append(_trained(learn, model, pretrain_rate, level, noise, pretrain_epochs, lambda x, below=below: _through(below, x), history))
        shown += [(k, e, error) for e, error in enumerate(history)]
    top = [len(columns), *layers][-1]
    network = Network([*((m.weights, m.hidden_bias) for m in stack), (np.zeros((top, classes)), np.zeros(classes))], act)
    network, rule, _ = fine_tune(learn, judge, network, classes, rate, epochs, first)
    for part in (*learn, judge):
        part.unpersist()
    return network, train.sparkSession.createDataFrame(shown, "layer int, epoch int, error double"), rule


def _through(below: list[Autoencoder], x: np.ndarray) -> np.ndarray:
    for model in below:
        x = model.hidden(x)
    return x


def predicted(df: DataFrame, network: Network, columns: list[str], into: str = "prediction") -> DataFrame:
    """``df`` with the likeliest class."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])

    @F.pandas_udf("int")
    def judged(values: pd.Series) -> pd.Series:
        return pd.Series(network.probabilities(np.stack(values.to_numpy())).argmax(1) if len(values) else [], dtype="int32")

    return df.withColumn(into, judged(x))
