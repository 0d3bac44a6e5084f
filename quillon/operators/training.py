"""Training of linear heads: a grid of learning rates fitted together, each stopped early, and how long runs lasted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..functions.scalars import sigmoid
from .contracts import ContractError, require_none

# AdamW's decay rates of its two moments, and its floor.
MOMENTS, FLOOR = (0.9, 0.999), 1e-8


class Heads:
    """One linear head for each label and learning rate, trained on all rows at once (AdamW) and stopped early.

    Rows are (split, label, y, mask, features): soft targets y in [0, 1], masked entries don't count. The loss is the mean
    cross-entropy of all unmasked entries. In a pass tasks add up the gradients of their own rows, as arrays, for all rates
    and labels; what reaches the driver is a row a weight, whatever the number of records. The weights of all heads travel
    to the tasks; labels are a vocabulary. A rate whose validation loss has not fallen by more than `tolerance` for `patience`
    epochs stops, and keeps the weights of its best epoch; the others go on.
    """

    def __init__(self, features: Sequence[str], rates: Sequence[float], epochs: int = 100, patience: int = 10, decay: float = 1e-4, tolerance: float = 1e-8, start_at_base_rate: bool = True):
        self.features, self.rates = tuple(features), tuple(rates)
        self.epochs, self.patience, self.decay, self.tolerance, self.start_at_base_rate = epochs, patience, decay, tolerance, start_at_base_rate
        self.history: list[tuple[float, int, float, float]] = []  # rate, epoch, training loss before it, validation loss after it
        self.weights: dict[float, dict] = {}

    def _summed(self, rows: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """part(head, in training, y, features, known) of each batch of rows, an array of this shape, added up over all rows."""
        d = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    flat = b.column("x").flatten()
                    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d)
                    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, d)
                    one = part(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "_t", "y")), x, known)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

        got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row a weight
        out = np.zeros(int(np.prod(shape)))
        out[[r["i"] for r in got]] = [r["v"] for r in got]
        return out.reshape(shape)

    def fit(self, rows: DataFrame) -> Heads:
        d, spark = len(self.features), rows.sparkSession
        require_none(rows.where("mask > 0").where(~F.coalesce(F.col("y").between(0, 1) & ~F.isnan(F.col("y").cast("double")), F.lit(False))).select("label"), "targets must lie in [0, 1]")
        rows = rows.where("mask > 0").select((F.col("split") == "train").alias("_t"), "label", F.col("y").cast("double").alias("y"), F.array(*[F.col(n).cast("double") for n in self.features]).alias("x")).persist()
        moments = rows.groupBy("label").agg(F.count_if("_t").alias("n"), F.count_if(~F.col("_t")).alias("v"), F.avg(F.when(F.col("_t"), F.col("y"))).alias("p")).orderBy("label").collect()
        moments = [r for r in moments if r["n"]]
        n, held = sum(r["n"] for r in moments), sum(r["v"] for r in moments)
        if not n or not held:
            raise ContractError("training and validation need unmasked entries")
        labels = [r["label"] for r in moments]
        many = len(labels)
        heads = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(labels)], rows.select("label").schema.add("h", IntegerType())))  # the vocabulary
        data = rows.where("_t is not null").join(heads, "label").select("h", "_t", "y", "x")

        def by_head(h: np.ndarray, values: np.ndarray) -> np.ndarray:
            order = np.argsort(h, kind="stable")
            found, at = np.unique(h[order], return_index=True)
            out = np.zeros((many, values.shape[1]))
            out[found] = np.add.reduceat(values[order], at)
            return out

        known, total = self._summed(data, (2, many, d), lambda h, t, y, x, known: np.stack([by_head(h, known * t[:, None]), by_head(h, x * t[:, None])]))
        self.mean = mean = total / np.maximum(known, 1)
        spread = self._summed(data, (many, d), lambda h, t, y, x, known: by_head(h, np.where(known, x - mean[h], 0.0) ** 2 * t[:, None]))
        self.deviation = deviation = np.maximum(np.sqrt(spread / np.maximum(known, 1)), 1e-6)
        first = np.zeros((len(labels), d + 1))
        if self.start_at_base_rate:
            p = np.clip([r["p"] for r in moments], 1e-4, 1 - 1e-4)
            first[:, -1] = np.log(p / (1 - p))

        def passed(weights: list[np.ndarray]):
            """For each rate and head: losses of training and validation, and the gradient; a row that lacks a feature counts in none."""

            def part(h, t, y, x, known):
                ok = known.all(1)
                x = np.column_stack([(x - mean[h]) / deviation[h], np.ones(len(x))])
                out = []
                for at in weights:
                    z = (x * at[h]).sum(1)
                    loss = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z
                    slope = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), 1 - 1 / (1 + np.exp(-np.abs(z)))) - y
                    values = np.column_stack([np.where(t, loss, 0.0), np.where(t, 0.0, loss), np.where(t, slope, 0.0)[:, None] * x])
                    out.append(by_head(h, np.where(ok[:, None], values, 0.0)))
                return np.stack(out)

            return part

        w = {r: first.copy() for r in self.rates}
        seen = {r: (np.zeros_like(first), np.zeros_like(first)) for r in self.rates}
        best = {r: (np.inf, first.copy(), -1) for r in self.rates}
        going, before = set(self.rates), {}
        for epoch in range(self.epochs + 1):  # a pass scores what the epoch before has made
            now = sorted(going)
            got = self._summed(data, (len(now), many, d + 3), passed([w[r] for r in now]))
            for r, mine in zip(now, got, strict=True):
                grad = mine[:, 2:]
                train, valid = float(mine[:, 0].sum() / n), float(mine[:, 1].sum() / held)
                if epoch:
                    self.history.append((r, epoch - 1, before[r], valid))
                    if valid < best[r][0] - self.tolerance:
                        best[r] = (valid, w[r].copy(), epoch - 1)
                    elif epoch - 1 - best[r][2] >= self.patience:
                        going.discard(r)
                        continue
                before[r] = train
                a, b = seen[r] = tuple(k * old + (1 - k) * new for k, old, new in zip(MOMENTS, seen[r], (grad / n, (grad / n) ** 2), strict=True))
                step = (a / (1 - MOMENTS[0] ** (epoch + 1))) / (np.sqrt(b / (1 - MOMENTS[1] ** (epoch + 1))) + FLOOR)
                w[r] = w[r] * (1 - r * self.decay) - r * step
            if not going:
                break
        rows.unpersist()
        self.best = {r: (loss_, at) for r, (loss_, _, at) in best.items()}
        self.weights = {r: {k: best[r][1][i] for i, k in enumerate(labels)} for r in self.rates}
        self.labels = labels
        return self

    def runs(self, rows: DataFrame) -> DataFrame:
        """(rate, epochs, best_epoch, loss) of the grid, from the history of the fit."""
        history = rows.sparkSession.createDataFrame(self.history, "rate double, epoch int, train_loss double, validation_loss double")
        return run_lengths(history, self.patience, self.tolerance, "rate").select("rate", "epochs", "best_epoch", F.col("best_loss").alias("loss"))

    def chosen(self) -> float:
        """The rate of least validation loss, the smallest of equal ones."""
        return min(self.rates, key=lambda r: (self.best[r][0], r))

    def predict(self, rows: DataFrame, rate: float | None = None) -> DataFrame:
        """rows with p, by the heads of a rate (the chosen one if none is named); labels without a head have none."""
        d, w = len(self.features), self.weights[self.chosen() if rate is None else rate]
        numbers = ArrayType(DoubleType())
        table = rows.sparkSession.createDataFrame([(k, self.mean[i].tolist(), self.deviation[i].tolist(), w[k].tolist()) for i, k in enumerate(self.labels)], rows.select("label").schema.add("_m", numbers).add("_s", numbers).add("_w", numbers))
        z = sum((F.col("_w")[i] * (F.col(n).cast("double") - F.col("_m")[i]) / F.col("_s")[i] for i, n in enumerate(self.features)), F.col("_w")[d])
        return rows.join(F.broadcast(table), "label", "left").withColumn("p", sigmoid(z)).drop("_m", "_s", "_w")


def run_lengths(history: DataFrame, patience: int = 5, tolerance: float = 1e-8, by: str = "run_id") -> DataFrame:
    """(run, epochs, best_epoch, best_loss) of rows (run, epoch, validation_loss), epochs counted from 0 in their order.

    An epoch is better if its loss is below the best so far by more than the tolerance; after `patience` epochs in a row
    that aren't, the run ends, and later ones don't count. A run's history is one array: epochs are few.
    """
    losses = F.transform(F.array_sort(F.collect_list(F.struct("epoch", "validation_loss"))), lambda s: s["validation_loss"])
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(float("inf")).alias("best"))

    def step(a, x):
        done = a["n"] - a["at"] > patience
        better = x < a["best"] - tolerance
        here = F.struct((a["n"] + 1).alias("n"), F.when(better, a["n"]).otherwise(a["at"]).alias("at"), F.when(better, x).otherwise(a["best"]).alias("best"))
        return F.when(done, a).otherwise(here)

    out = history.groupBy(by).agg(losses.alias("l")).withColumn("s", F.aggregate("l", zero, step))
    return out.select(by, F.col("s.n").alias("epochs"), F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best_loss"))
