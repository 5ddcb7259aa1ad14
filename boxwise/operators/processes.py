"""Gaussian processes by group whose kernels are learned from the evidence.

The kernel is a sum of parts, each with a variance of its own and a length for
each of its columns. They are found on a bounded sample of each group, by
ascent of the marginal likelihood within the group's task. The posterior then
takes all rows: a few inducing points of the sample stand for the group, and
what rows add to them (a matrix of fixed size) is summed over blocks of rows,
so a large group is dealt to many tasks both here and for its predictions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Logarithms of lengths and variances stay within these, of the noise above the least.
_BOUND, _LEAST_NOISE, _JITTER = 5.0, -6.0, 1e-8


def start(parts: list[list[int]]) -> np.ndarray:
    """Logarithms of the noise, and of each part's variance and lengths: parts share a variance of 1, lengths are the root of the part's size."""
    return np.concatenate([[np.log(0.3)], *[[-np.log(len(parts)), *[0.5 * np.log(len(p))] * len(p)] for p in parts]])


def kernel(theta: np.ndarray, parts: list[list[int]], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The matrix of each part between the rows of ``a`` and ``b``."""
    out, at = [], 1
    for p in parts:
        lengths = np.exp(theta[at + 1 : at + 1 + len(p)])
        off = (a[:, None, p] - b[None, :, p]) / lengths
        out.append(np.exp(theta[at] - 0.5 * (off * off).sum(-1)))
        at += 1 + len(p)
    return out


def evidence(theta: np.ndarray, parts: list[list[int]], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The logarithm of the marginal likelihood of ``y`` (of mean 0) and its gradient by ``theta``."""
    n = len(y)
    each = kernel(theta, parts, x, x)
    noise = np.exp(theta[0])
    chol = np.linalg.cholesky(sum(each) + (noise + _JITTER) * np.eye(n))
    inverse = np.linalg.inv(chol)
    inverse = inverse.T @ inverse
    alpha = inverse @ y
    value = -0.5 * y @ alpha - np.log(np.diag(chol)).sum() - 0.5 * n * np.log(2 * np.pi)
    w = np.outer(alpha, alpha) - inverse  # the derivative by a parameter is half the trace of this times the kernel's
    gradient = [0.5 * noise * np.trace(w)]
    at = 1
    for p, k in zip(parts, each, strict=True):
        wk = w * k
        gradient.append(0.5 * wk.sum())
        for j, c in enumerate(p):
            off = (x[:, None, c] - x[None, :, c]) / np.exp(theta[at + 1 + j])
            gradient.append(0.5 * (wk * off * off).sum())
        at += 1 + len(p)
    return float(value), np.array(gradient)


def learned(parts: list[list[int]], x: np.ndarray, y: np.ndarray, steps: int) -> tuple[np.ndarray, float, float]:
    """(theta, evidence at the start, greatest evidence met): each parameter has a step of its own, which grows while its slope keeps its sign and halves when that turns."""
    theta = start(parts)
    first, gradient = evidence(theta, parts, x, y)
    best, value, step, before = theta, first, np.full(len(theta), 0.1), np.zeros(len(theta))
    for _ in range(steps):
        kept = gradient * before
        step = np.clip(np.where(kept > 0, step * 1.3, np.where(kept < 0, step * 0.5, step)), 1e-4, 1.0)
        before = np.where(kept < 0, 0, gradient)
        theta = np.clip(theta + step * np.sign(before), -_BOUND, _BOUND)
        theta[0] = max(theta[0], _LEAST_NOISE)
        new, gradient = evidence(theta, parts, x, y)
        if new > value:
            best, value = theta, new
    return best, first, value


def posterior(theta: np.ndarray, parts: list[list[int]], inducing: np.ndarray, gram: np.ndarray, cross: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at ``at``, from what all rows add to the inducing points: K_mn K_nm and K_mn y."""
    noise = np.exp(theta[0]) + _JITTER
    own = sum(kernel(theta, parts, inducing, inducing)) + 1e-6 * np.eye(len(inducing))
    chol = np.linalg.cholesky(own)
    solve = np.linalg.solve
    inner = np.eye(len(inducing)) + solve(chol, solve(chol, gram).T).T / noise
    inner_chol = np.linalg.cholesky((inner + inner.T) / 2)
    near = solve(chol, sum(kernel(theta, parts, inducing, at)))
    seen = solve(inner_chol, near)
    mean = seen.T @ solve(inner_chol, solve(chol, cross)) / noise
    whole = sum(np.exp(theta[1 + sum(1 + len(q) for q in parts[:k])]) for k in range(len(parts)))
    return mean, np.maximum(whole - (near**2).sum(0) + (seen**2).sum(0), 0)


def learned_process(
    df: DataFrame, group: str, key: str, columns: list[str], label: str, splits: list[list[str]] | None = None, most: int = 150, inducing: int = 40, steps: int = 40, block: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """(predictions, kernels): group, key, mean and variance of every row; and what was learned of each group.

    ``splits`` are the kernel's parts (lists of columns, a length for each
    column); by default each column is a part. Lengths, variances and noise
    are learned on the ``most`` first rows of a group in the order of the
    key's hash, of which the first ``inducing`` are its inducing points; the
    posterior is that of all rows with a label. Null features are 0. A row
    without a label is predicted only; a group without labels gets null. Null
    is a group of its own; rows of one key are predicted alike where their
    features are. The kernels give rows and sampled rows, the evidence (of the
    sample, standardised) at the start and in the end, the noise, and for each
    part its variance and lengths, in units of the group's deviations.
    """
    names = splits or [[c] for c in columns]
    parts = [[columns.index(c) for c in part] for part in names]
    rows = df.select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("_x"))
    place = F.row_number().over(Window.partitionBy("_group").orderBy(F.xxhash64("_key"), "_key", "_y", "_x"))
    sample = rows.where("_y is not null").withColumn("_n", place).where(F.col("_n") <= most)
    kind = rows.schema["_group"].dataType.simpleString()

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        x, y = np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(float)
        middle, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        x, scale = (x - middle) / spread, y.std() or 1.0
        theta, first, value = learned(parts, x, (y - y.mean()) / scale, steps)
        return pd.DataFrame([{"_group": pdf["_group"].iloc[0], "theta": theta, "inducing": x[:inducing].ravel(), "middle": middle, "spread": spread, "y_mean": y.mean(), "y_scale": scale, "sampled": len(y), "first": first, "value": value}]).astype({"_group": object})

    arrays = ", ".join(f"{c} array<double>" for c in ("theta", "inducing", "middle", "spread"))
    fits = sample.groupBy("_group").applyInPandas(learn, f"_group {kind}, {arrays}, y_mean double, y_scale double, sampled bigint, first double, value double").persist()
    blocks = rows.groupBy(F.col("_group").alias("_of")).agg(F.count(F.lit(1)).alias("rows"), F.count("_y").alias("labelled")).withColumn("_blocks", F.ceil(F.col("rows") / block))
    same = F.col("_group").eqNullSafe(F.col("_of"))
    dealt = rows.join(blocks, same).withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_blocks"))).select("_group", "_block", "_key", "_y", "_x")
    each = lambda known: known.join(blocks, same).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_of", "_blocks", "rows", "labelled").groupBy("_group", "_block")

    def shaped(fit: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(fit["theta"]), np.array(fit["inducing"]).reshape(-1, len(columns)), np.array(fit["middle"]), np.array(fit["spread"])

    def add(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["_y"].notna()]
        if pdf.empty or known.empty:
            return pd.DataFrame({"_group": pd.Series([], dtype=object), "_at": np.array([], np.int32), "_value": np.array([], float)})
        fit = known.iloc[0]
        theta, points, middle, spread = shaped(fit)
        k = sum(kernel(theta, parts, points, (np.stack(pdf["_x"].to_numpy()) - middle) / spread))
        y = (pdf["_y"].to_numpy(float) - fit["y_mean"]) / fit["y_scale"]
        values = np.concatenate([(k @ k.T).ravel(), k @ y])
        return pd.DataFrame({"_group": pd.Series([fit["_group"]] * len(values), dtype=object), "_at": np.arange(len(values)), "_value": values})

    parted = dealt.groupBy("_group", "_block").cogroup(each(fits)).applyInPandas(add, f"_group {kind}, _at int, _value double")
    sums = parted.groupBy("_group", "_at").agg(F.sum("_value").alias("_value")).groupBy(F.col("_group").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_at", "_value")))["_value"].alias("sums"))
    known = fits.join(sums, same).drop("_of")

    def predict(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({group: pdf["_group"].astype(object), key: pdf["_key"].astype(object), "mean": np.nan, "variance": np.nan})
        if len(pdf) and len(known):
            fit = known.iloc[0]
            theta, points, middle, spread = shaped(fit)
            m, sums = len(points), np.array(fit["sums"])
            mean, variance = posterior(theta, parts, points, sums[: m * m].reshape(m, m), sums[m * m :], (np.stack(pdf["_x"].to_numpy()) - middle) / spread)
            out["mean"], out["variance"] = fit["y_mean"] + fit["y_scale"] * mean, fit["y_scale"] ** 2 * variance
        return out

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    predictions = dealt.groupBy("_group", "_block").cogroup(each(known)).applyInPandas(predict, f"`{group}` {types[group]}, `{key}` {types[key]}, mean double, variance double")
    predictions = predictions.select(group, key, F.nanvl("mean", F.lit(None).cast("double")).alias("mean"), F.nanvl("variance", F.lit(None).cast("double")).alias("variance"))
    at, shown = 2, []
    for part in names:
        lengths = F.transform(F.slice("theta", at + 1, len(part)), F.exp)
        shown.append(F.struct(F.lit("+".join(part)).alias("part"), F.exp(F.get("theta", F.lit(at - 1))).alias("variance"), lengths.alias("lengths")))
        at += 1 + len(part)
    kernels = fits.join(blocks, same).select(F.col("_group").alias(group), "rows", "sampled", F.col("first").alias("evidence_at_start"), F.col("value").alias("evidence"), F.exp(F.get("theta", F.lit(0))).alias("noise"), F.array(*shown).alias("parts"))
    return predictions, kernels
