"""Fits: temperature, sigmoid, soft-label logistic, ridge, boosted gains. Data stays in Spark; the driver sees sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.scalars import sigmoid, softplus
from .contracts import ACTIONS, ContractError
from .ranges import checkpointed, with_small

GENERIC = ("candidate_confidence", "joint_marginal_gap", "entropy", "specificity")
PROVENANCE = ("n_sources", "has_documentary", "source_age_days", "missing_premises", "source_conflicts", "unknown_mass")


def losses(long: DataFrame, inverse: list[float]) -> list[float]:
    """Mean masked loss at each inverse temperature, all in one pass."""
    one = lambda k: F.sum((softplus(F.col("z") * k) - F.col("y") * F.col("z") * k) * F.col("mask"))
    row = long.agg(F.sum("mask").alias("n"), *[one(k).alias(f"l{i}") for i, k in enumerate(inverse)]).first()
    if not row["n"]:
        raise ContractError("no calibration labels")
    return [row[f"l{i}"] / row["n"] for i in range(len(inverse))]


def fit_temperature(long: DataFrame, grid: int = 17, rounds: int = 6) -> float:
    """The temperature in [e^-4, e^4] of least loss: the loss is convex in 1 / T, so each pass narrows a grid of log T."""
    lo, hi = -4.0, 4.0
    for _ in range(rounds):
        at = np.linspace(lo, hi, grid)
        i = int(np.argmin(losses(long, [math.exp(-t) for t in at])))
        lo, hi = at[max(0, i - 1)], at[min(grid - 1, i + 1)]
    return math.exp((lo + hi) / 2)


def fit_sigmoid(long: DataFrame, l2: float = 0.01, rounds: int = 30) -> DataFrame:
    """(label, a, b) by label: Newton steps from summed gradients and Hessians, a in [0.01, 20], b in [-20, 20]; the penalty
    pulls to (1, 0), which a label without data keeps. Each step is one aggregation; labels' pairs are a small table."""
    spark = long.sparkSession
    labels = [r[0] for r in long.select("label").distinct().collect()]  # the vocabulary
    at = {k: (1.0, 0.0) for k in labels}
    data = long.where("mask > 0").select("label", "z", "y").persist()
    for _ in range(rounds):
        now = F.broadcast(spark.createDataFrame([(k, *v) for k, v in at.items()], long.select("label").schema.add("a", "double").add("b", "double")))
        p = sigmoid(F.col("a") * F.col("z") + F.col("b"))
        e, v, z = p - F.col("y"), p * (1 - p), F.col("z")
        rows = data.join(now, "label").groupBy("label").agg(*[F.avg(x).alias(n) for n, x in {"ga": e * z, "gb": e, "aa": v * z * z, "ab": v * z, "bb": v}.items()]).collect()
        moved = 0.0
        for r in rows:
            a, b = at[r["label"]]
            g = np.array([r["ga"] + l2 * (a - 1), r["gb"] + l2 * b])
            h = np.array([[r["aa"] + l2, r["ab"]], [r["ab"], r["bb"] + l2]])
            step = np.linalg.solve(h, g)
            new = (min(20.0, max(0.01, a - step[0])), min(20.0, max(-20.0, b - step[1])))
            moved = max(moved, abs(new[0] - a), abs(new[1] - b))
            at[r["label"]] = (float(new[0]), float(new[1]))
        if moved < 1e-8:
            break
    data.unpersist()
    return spark.createDataFrame([(k, *v) for k, v in at.items()], long.select("label").schema.add("a", "double").add("b", "double"))


def standardizer(df: DataFrame, names: tuple[str, ...]) -> tuple[list[float], list[float]]:
    """Means and population deviations, the latter at least 1e-6."""
    row = df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)]).first()
    return [row[f"m{i}"] for i in range(len(names))], [max(row[f"s{i}"], 1e-6) for i in range(len(names))]


class SoftLogistic:
    """Logistic regression on soft labels over standardised features: mean loss + l2 / 2 |w|^2, the bias free."""

    def __init__(self, names: tuple[str, ...], l2: float = 0.01):
        self.names, self.l2 = names, l2

    def _x(self) -> list[Column]:
        return [(F.col(n) - m) / s for n, m, s in zip(self.names, self.mean, self.deviation, strict=True)]

    def fit(self, df: DataFrame, y: str = "y", rounds: int = 30) -> SoftLogistic:
        self.mean, self.deviation = standardizer(df, self.names)
        d = len(self.names)
        w = np.zeros(d + 1)
        x = [*self._x(), F.lit(1.0)]
        for _ in range(rounds):
            z = sum((float(c) * v for c, v in zip(w, x, strict=True)), F.lit(0.0))
            p = sigmoid(z)
            e, v = p - F.col(y), p * (1 - p)
            row = df.agg(*[F.avg(e * a).alias(f"g{i}") for i, a in enumerate(x)], *[F.avg(v * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]).first()
            free = np.array([*[self.l2] * d, 0.0])
            g = np.array([row[f"g{i}"] for i in range(d + 1)]) + free * w
            h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + np.diag(free + 1e-12)
            step = np.linalg.solve(h, g)
            w = w - step
            if abs(step).max() < 1e-10:
                break
        self.weights = w
        return self

    def logits(self) -> Column:
        return sum((float(c) * v for c, v in zip(self.weights, [*self._x(), F.lit(1.0)], strict=True)), F.lit(0.0))

    def score(self) -> Column:
        return sigmoid(self.logits())

    def to_json(self) -> dict:
        return {"kind": "soft_logistic", "features": list(self.names), "mean": self.mean, "deviation": self.deviation, "weights": self.weights.tolist()}

    @classmethod
    def from_json(cls, d: dict) -> SoftLogistic:
        out = cls(tuple(d["features"]))
        out.mean, out.deviation, out.weights = d["mean"], d["deviation"], np.array(d["weights"])
        return out


class SoftLayers:
    """One hidden layer of rectified units on soft labels, as an ablation of SoftLogistic: full passes with decoupled weight
    decay, fixed in width and length before any test. Gradients are summed on the executors; the driver holds the weights."""

    def __init__(self, names: tuple[str, ...], hidden: int = 32, epochs: int = 200, lr: float = 0.001, decay: float = 0.01, seed: int = 0):
        self.names, self.hidden, self.epochs, self.lr, self.decay, self.seed = names, hidden, epochs, lr, decay, seed

    def _draw(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        part = lambda fan, *shape: rng.uniform(-1, 1, shape) / math.sqrt(fan)
        d, h = len(self.names), self.hidden
        return {"w1": part(d, d, h), "b1": part(d, h), "w2": part(h, h), "b2": part(h, 1)}

    def fit(self, df: DataFrame, y: str = "y") -> SoftLayers:
        """Null or non-finite features and labels outside [0, 1] are errors."""
        import pandas as pd

        sound = [F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf")) for n in self.names]
        bad = ~F.coalesce(F.col(y).between(0, 1), F.lit(False))
        for c in sound:
            bad = bad | c
        if not df.where(bad).isEmpty():
            raise ContractError("invalid selector inputs")
        self.mean, self.deviation = standardizer(df, self.names)
        rows = df.select(*[((F.col(n) - m) / s).alias(f"x{i}") for i, (n, m, s) in enumerate(zip(self.names, self.mean, self.deviation, strict=True))], F.col(y).cast("double").alias("y")).persist()
        n, d = rows.count(), len(self.names)
        w = self._draw()
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        for t in range(1, self.epochs + 1):

            def slopes(parts, w=w):
                total = {k: np.zeros_like(v) for k, v in w.items()}
                for part in parts:
                    x, want = part.iloc[:, :d].to_numpy(), part["y"].to_numpy()
                    up = np.maximum(x @ w["w1"] + w["b1"], 0)
                    e = 1 / (1 + np.exp(-(up @ w["w2"] + w["b2"][0]))) - want
                    back = np.outer(e, w["w2"]) * (up > 0)
                    for k, g in (("w1", x.T @ back), ("b1", back.sum(0)), ("w2", up.T @ e), ("b2", np.array([e.sum()]))):
                        total[k] += g
                yield pd.DataFrame([(k, i, float(v)) for k, g in total.items() for i, v in enumerate(g.ravel())], columns=["k", "i", "g"])

            summed = rows.mapInPandas(slopes, "k string, i int, g double").groupBy("k", "i").agg(F.sum("g").alias("g")).collect()  # a row a weight
            grads = {k: np.zeros(v.size) for k, v in w.items()}
            for r in summed:
                grads[r["k"]][r["i"]] = r["g"] / n
            for k, v in w.items():
                g = grads[k].reshape(v.shape)
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                step = (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                w[k] = v * (1 - self.lr * self.decay) - self.lr * step
        rows.unpersist()
        self.weights = w
        return self

    def logits(self) -> Column:
        x = [(F.col(n) - m) / s for n, m, s in zip(self.names, self.mean, self.deviation, strict=True)]
        units = [F.greatest(sum((float(a) * v for a, v in zip(self.weights["w1"][:, j], x, strict=True)), F.lit(float(self.weights["b1"][j]))), F.lit(0.0)) for j in range(self.hidden)]
        return sum((float(c) * u for c, u in zip(self.weights["w2"], units, strict=True)), F.lit(float(self.weights["b2"][0])))

    def score(self) -> Column:
        return sigmoid(self.logits())

    def to_json(self) -> dict:
        return {"kind": "soft_layers", "features": list(self.names), "hidden": self.hidden, "epochs": self.epochs, "lr": self.lr, "decay": self.decay, "seed": self.seed, "mean": self.mean, "deviation": self.deviation, "weights": {k: v.tolist() for k, v in self.weights.items()}}

    @classmethod
    def from_json(cls, d: dict) -> SoftLayers:
        out = cls(tuple(d["features"]), d["hidden"], d["epochs"], d["lr"], d["decay"], d["seed"])
        out.mean, out.deviation, out.weights = d["mean"], d["deviation"], {k: np.array(v) for k, v in d["weights"].items()}
        return out


def train_selectors(joined: DataFrame, y: str = "y") -> dict[str, SoftLogistic]:
    return {"generic": SoftLogistic(GENERIC).fit(joined, y), "pcsi": SoftLogistic(GENERIC + PROVENANCE).fit(joined, y)}


def fit_support_calibrators(scored: DataFrame, columns: tuple[str, ...] = ("generic", "pcsi", "joint_confidence")) -> dict[str, dict]:
    """identity, temperature and sigmoid of each score, on calibration rows only (split, y)."""
    if not scored.where("split <> 'calibration'").isEmpty():
        raise ContractError("calibrators are fitted on calibration rows")
    out = {}
    for c in columns:
        q = F.greatest(F.least(F.col(c), F.lit(1 - 1e-7)), F.lit(1e-7))
        long = scored.select(F.lit(c).alias("label"), (F.log(q) - F.log1p(-q)).alias("z"), F.col("y").cast("double").alias("y"), F.lit(1).alias("mask"))
        s = fit_sigmoid(long).first()
        out[c] = {"identity": {}, "temperature": {"temperature": fit_temperature(long)}, "sigmoid": {"a": s["a"], "b": s["b"]}}
    return out


def base_rate_bias(prevalence: DataFrame, eps: float = 1e-4) -> DataFrame:
    """A head with weights 0 and this bias gives back the prevalence."""
    p = F.greatest(F.least(F.col("prevalence"), F.lit(1 - eps)), F.lit(eps))
    return prevalence.select("label", (F.log(p) - F.log1p(-p)).alias("bias"))


def ridge_cv(df: DataFrame, features: dict[str, tuple[str, ...]], y: str, folds: int = 5, alpha: float = 1.0) -> DataFrame:
    """(model, mae, n) of ridge regressions out of group folds, from sums of products by fold: a row a fold reaches the driver."""
    from .entities import balanced_folds

    spark = df.sparkSession
    fold = checkpointed(balanced_folds(df.select("group_id"), folds).select("group_id", "fold"))
    if fold.limit(3).count() < 3:
        raise ContractError("at least 3 groups")
    rows = with_small(df, fold, ["group_id"]).persist()
    results = []
    for name, xs in features.items():
        cols = [*xs, y]
        sums = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).collect()
        error = F.lit(None).cast("double")
        for r in sums:
            train = [s for s in sums if s["fold"] != r["fold"]]
            n = sum(s["n"] for s in train)
            m = np.array([sum(s[f"s{i}"] for s in train) for i in range(len(cols))]) / n
            cov = np.array([[sum(s[f"q{min(i, j)}_{max(i, j)}"] for s in train) for j in range(len(cols))] for i in range(len(cols))]) / n - np.outer(m, m)
            sd = np.maximum(np.sqrt(np.diag(cov)), 1e-12)[:-1]
            a = cov[:-1, :-1] / np.outer(sd, sd) + alpha / n * np.eye(len(xs))
            w = np.linalg.solve(a, cov[:-1, -1] / sd) / sd
            guess = sum((float(c) * (F.col(x) - float(k)) for c, x, k in zip(w, xs, m, strict=False)), F.lit(float(m[-1])))
            error = F.when(F.col("fold") == r["fold"], F.abs(F.col(y) - guess)).otherwise(error)
        got = rows.agg(F.avg(error).alias("mae"), F.count("*").alias("n")).first()
        results.append((name, got["mae"], got["n"]))
    return spark.createDataFrame(results, "model string, mae double, n long")


def linear_head(long: DataFrame, features: tuple[str, ...], l2: float = 0.01, rounds: int = 30) -> dict[str, SoftLogistic]:
    """A soft logistic for each label over precomputed features; long: label, y, mask and the features. Labels are a vocabulary.

    Newton steps of all labels together: a round is one aggregation by label, whatever the number of labels. Labels without
    an unmasked row get no head.
    """
    spark, d = long.sparkSession, len(features)
    rows = long.where(F.col("mask") > 0).select("label", F.col("y").cast("double").alias("y"), *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(features)]).persist()
    moments = rows.groupBy("label").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(d)]).collect()
    heads = {}
    for r in moments:
        heads[r["label"]] = head = SoftLogistic(features, l2)
        head.mean, head.deviation, head.weights = [r[f"m{i}"] for i in range(d)], [max(r[f"s{i}"], 1e-6) for i in range(d)], np.zeros(d + 1)
    going = set(heads)
    at = lambda name, i: F.col(name)[i]
    x = [*[(F.col(f"x{i}") - at("_m", i)) / at("_s", i) for i in range(d)], F.lit(1.0)]
    p = sigmoid(sum((at("_w", i) * v for i, v in enumerate(x)), F.lit(0.0)))
    slopes = [F.avg((p - F.col("y")) * a).alias(f"g{i}") for i, a in enumerate(x)]
    bends = [F.avg(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
    numbers = ArrayType(DoubleType())
    shape = long.select("label").schema.add("_m", numbers).add("_s", numbers).add("_w", numbers)
    free = np.array([*[l2] * d, 0.0])
    for _ in range(rounds):
        if not going:
            break
        now = spark.createDataFrame([(k, heads[k].mean, heads[k].deviation, heads[k].weights.tolist()) for k in going], shape)  # the vocabulary
        for r in rows.join(F.broadcast(now), "label").groupBy("label").agg(*slopes, *bends).collect():
            head = heads[r["label"]]
            g = np.array([r[f"g{i}"] for i in range(d + 1)]) + free * head.weights
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + np.diag(free + 1e-12)
            step = np.linalg.solve(h, g)
            head.weights = head.weights - step
            if abs(step).max() < 1e-10:
                going.discard(r["label"])
    rows.unpersist()
    return heads


class GainPolicy:
    """Boosted trees for each action's gain, learned on fit episodes; all four actions are needed."""

    def __init__(self, penalty: float = 1.0, cost_weight: float = 0.05, rounds: int = 20, seed: int = 0):
        self.penalty, self.cost_weight, self.rounds, self.seed = penalty, cost_weight, rounds, seed
        self.models: dict = {}

    def fit(self, episodes: DataFrame) -> GainPolicy:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        from ..functions.scalars import marginal_gain

        if not episodes.where("split <> 'fit'").isEmpty():
            raise ContractError("episodes outside fit")
        found = {r[0] for r in episodes.select("action_id").distinct().collect()}
        if found != set(ACTIONS):
            raise ContractError(f"actions are {sorted(found)}")
        rows = episodes.withColumn("label", marginal_gain(F.col("supported_gain"), F.col("unsupported_gain"), F.col("cost_units"), self.penalty, self.cost_weight))
        rows = VectorAssembler(inputCols=list(GENERIC + PROVENANCE), outputCol="features").transform(rows).select("action_id", "features", "label").persist()
        for a in ACTIONS:
            self.models[a] = GBTRegressor(maxIter=self.rounds, maxDepth=3, minInstancesPerNode=5, seed=self.seed).fit(rows.where(F.col("action_id") == a))
        return self

    def choose(self, states: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        from .gate import best_action

        df = VectorAssembler(inputCols=list(GENERIC + PROVENANCE), outputCol="features").transform(states)
        for a, m in self.models.items():
            df = m.setPredictionCol(f"_{a}").transform(df)
        scores = F.create_map(*[x for a in ACTIONS for x in (F.lit(a), F.col(f"_{a}"))])
        return df.withColumn("action_id", best_action(scores)).drop("features", *[f"_{a}" for a in ACTIONS])


def grid_best(grid: DataFrame, by: str = "head", loss: str = "loss", tie: str = "lr") -> DataFrame:
    """The row of least loss, then least tie, for each value of by."""
    return grid.groupBy(by).agg(F.min_by(F.struct(*[c for c in grid.columns if c != by]), F.struct(loss, tie)).alias("s")).select(by, "s.*")
