"""Market regimes: detectors and the analysis of regime series."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.windows import lag, lead, running
from .features import DESCRIPTORS
from .metrics import performance

#: Rows of a mixture that are worth a task of their own while there are cores, the most of one task, and those of a block.
TASK_ROWS, MOST_ROWS, CHUNK = 1 << 16, 1 << 20, 1 << 12
#: Added to each density, as MLlib does.
EPSILON = float(np.finfo(float).eps)
# Names of the states of the rule.
RULE_NAMES = {0: "Range, quiet", 1: "Range, high-volatility", 2: "Trend, quiet", 3: "Trend, high-volatility"}


class NoRegimes:
    """One regime for all bars."""

    names = {0: "All bars"}

    def fit(self, df: DataFrame):
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("regime", F.lit(0))


class RuleRegimes:
    """Trending and volatile or not, against the medians of the training bars of each symbol."""

    names = RULE_NAMES

    def fit(self, df: DataFrame):
        half = F.lit(0.5)
        self.cuts = df.groupBy("symbol").agg(F.percentile(F.abs("trend_strength"), half).alias("_t"), F.percentile("vol_percentile", half).alias("_v"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        trending, volatile = (F.when(x, n).otherwise(0) for x, n in ((F.abs("trend_strength") > F.col("_t"), 2), (F.col("vol_percentile") > F.col("_v"), 1)))
        return df.join(self.cuts, "symbol").withColumn("regime", trending + volatile).drop("_t", "_v")


class _Clusters:
    """Clusters of standardised descriptors; the best of several seeds."""

    restarts = 1

    def __init__(self, k: int = 4, features: list[str] | None = None, seed: int = 7):
        self.k, self.features, self.seed = k, features or DESCRIPTORS, seed

    def _vectors(self, df: DataFrame) -> DataFrame:
        scaled = df.withColumns({f"_s_{x}": (F.col(x) - m) / (s or 1.0) for x, (m, s) in self.scale.items()})
        return VectorAssembler(inputCols=[f"_s_{x}" for x in self.features], outputCol="_v", handleInvalid="skip").transform(scaled)

    def centres(self, df: DataFrame) -> list:
        """Mean descriptors of each regime, k rows."""
        return describe_regimes(self.predict(df), self.features).orderBy("regime").collect()


def hashed(*parts):
    """Hex digest of a row's symbol and time after some numbers: an order by chance that any engine repeats."""
    return F.md5(F.concat_ws("|", *(F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts), "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("binary"))


class KMeansRegimes(_Clusters):
    """Lloyd's rounds as grouped sums, for all restarts in one job a round; a restart begins at the k rows of least hash.

    A centre without rows goes. Of the restarts the one of least cost stays, of equals the first.
    """

    restarts, rounds, still = 10, 50, 1e-9

    def _scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_z", F.array(*((F.col(x) - m) / (s or 1.0) for x, (m, s) in self.scale.items())))

    @staticmethod
    def _nearest(centres: dict[int, list[float]]):
        """struct(d, c) of the nearest centre, of equals the first."""
        z = F.col("_z")
        return F.array_min(F.array(*(F.struct(sum(((z[i] - v) * (z[i] - v) for i, v in enumerate(own)), F.lit(0.0)).alias("d"), F.lit(c).alias("c")) for c, own in sorted(centres.items()))))

    @staticmethod
    def _sums(data: DataFrame, centres: dict) -> DataFrame:
        """(r, c, n, d, s): rows, squared distances and sums of each restart's clusters, a row for each task."""
        tables = {r: (np.array(sorted(own)), np.array([own[c] for c in sorted(own)])) for r, own in centres.items()}

        def add(batches):
            held: dict = {}
            for batch in batches:
                z = batch.column("_z").flatten().to_numpy().reshape(len(batch), -1)
                for r, (names, own) in tables.items():
                    d = ((z[:, None, :] - own[None]) ** 2).sum(axis=2)
                    near = d.argmin(axis=1)
                    for k, c in enumerate(names.tolist()):
                        mine = near == k
                        if mine.any():
                            n, e, s = held.get((r, c), (0, 0.0, 0.0))
                            held[r, c] = n + int(mine.sum()), e + float(d[mine, k].sum()), s + z[mine].sum(axis=0)
            if held:
                columns = [[r for r, _ in held], [c for _, c in held], *([v[i] for v in held.values()] for i in (0, 1)), [v[2].tolist() for v in held.values()]]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["r", "c", "n", "d", "s"])

        return data.select("_z").mapInArrow(add, "r int, c int, n long, d double, s array<double>")

    def fit(self, df: DataFrame):
        row = df.agg(*chain.from_iterable((F.avg(x), F.stddev_pop(x)) for x in self.features)).first()
        self.scale = {x: (row[2 * i] or 0.0, row[2 * i + 1]) for i, x in enumerate(self.features)}
        data = stored(self._scaled(df.dropna("any", subset=self.features)).select("symbol", "ts", "_z"))
        drawn = data.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(self.restarts - 1))))
        drawn = drawn.withColumn("_h", hashed(self.seed, F.col("_r"))).withColumn("_c", F.row_number().over(Window.partitionBy("_r").orderBy("_h")) - 1).where(F.col("_c") < self.k)
        found: dict = {r: {} for r in range(self.restarts)}
        for r in drawn.select("_r", "_c", "_z").collect():
            found[r._r][r._c] = list(r._z)
        cost: dict = {}
        for _ in range(self.rounds):
            there = {r: c for r, c in found.items() if c}
            if not there:
                break
            sums = self._sums(data, there).groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(self.features)))).collect()
            moved, cost = {r: {} for r in found}, {}
            for s in sums:
                moved[s.r][s.c], cost[s.r] = [s[f"s{i}"] / s.n for i in range(len(self.features))], cost.get(s.r, 0.0) + s.d
            far = max((abs(a - b) for r, centres in moved.items() for c, m in centres.items() for a, b in zip(m, found[r][c], strict=True)), default=0.0)
            gone = any(len(moved[r]) < len(c) for r, c in found.items())
            if far <= self.still and not gone:
                break
            found = moved
        best = min(cost, key=lambda r: (round(cost[r], 6), r)) if cost else None
        self.found = found[best] if cost else {0: [0.0] * len(self.features)}
        self.names = regime_names(self.centres(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        ok = df.dropna("any", subset=self.features)
        return self._scaled(ok).withColumn("regime", self._nearest(self.found)["c"].cast("int")).select(*df.columns, "regime")


@dataclass
class Mixture:
    """Weights, means and covariances of k normal distributions."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float = -np.finfo(float).max
    before: float = 0.0
    rounds: int = 0

    def whitened(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(roots, centres, heights): the squares of x @ roots[c] - centres[c] add up to the distance from c, heights are the densities' logarithms at 0; directions without spread do not count."""
        values, turns = np.linalg.eigh(self.covariances)
        there = values > EPSILON * values.max(axis=1, keepdims=True) * values.shape[1]
        if not there.any(axis=1).all():
            raise ValueError("a covariance matrix has no spread in any direction")
        roots = turns * np.where(there, 1 / np.sqrt(np.where(there, values, 1.0)), 0.0)[:, None, :]
        return roots, np.einsum("ci,cij->cj", self.means, roots), -0.5 * (values.shape[1] * np.log(2 * np.pi) + np.log(np.where(there, values, 1.0)).sum(axis=1))


class MixtureRegimes(_Clusters):
    """EM rounds as grouped sums, for all restarts in one job a round; a restart begins at MLlib's draws and ends as MLlib's fit does.

    Rows are packed into blocks and dealt out evenly first, as those of a symbol come from one task.
    Of the restarts the likeliest stays, of equals the first.
    """

    restarts, rounds, still = 5, 100, 0.01

    def _drawn(self, data: DataFrame, seed: int) -> Mixture:
        model = GaussianMixture(k=self.k, seed=seed, featuresCol="_v", maxIter=0).fit(data)
        found = model.gaussiansDF.collect()
        return Mixture(np.array(model.weights), np.array([g["mean"].toArray() for g in found]), np.array([g["cov"].toArray() for g in found]))

    @staticmethod
    def _packed(data: DataFrame, n: int) -> DataFrame:
        """Rows of `_v` as bytes, CHUNK rows at most to a block, in tasks of about equal size."""
        parts = max(min(math.ceil(n / TASK_ROWS), data.sparkSession.sparkContext.defaultParallelism), math.ceil(n / MOST_ROWS), 1)

        def pack(batches):
            for batch in batches:
                for part in (batch.slice(i, CHUNK) for i in range(0, len(batch), CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("z").flatten().to_numpy().tobytes()], pa.binary())], ["z"])

        return data.select(vector_to_array("_v").alias("z")).repartition(parts).mapInArrow(pack, "z binary")

    @staticmethod
    def _sums(blocks: DataFrame, found: dict[int, Mixture]) -> dict[int, np.ndarray]:
        """Of each restart, a row for each distribution: log-likelihood (the first's only), rows, sums and sums of products."""
        k, width = next(iter(found.values())).means.shape
        roots, centres, heights = (np.concatenate(x) for x in zip(*(m.whitened() for m in found.values()), strict=True))
        weights, shape = np.concatenate([m.weights for m in found.values()]), (len(found), k, 2 + width + width * width)

        def add(batches):
            out = np.zeros((len(weights), shape[2]))
            for batch in batches:
                for block in batch.column("z").to_pylist():
                    z = np.frombuffer(block).reshape(-1, width)
                    far = np.zeros((len(z), len(weights)))
                    for j in range(width):
                        far += (z @ roots[:, :, j].T - centres[:, j]) ** 2
                    p = EPSILON + weights * np.exp(heights - far / 2)
                    whole = p.reshape(len(z), -1, k).sum(axis=2)
                    p /= np.repeat(whole, k, axis=1)
                    out[::k, 0] += np.log(whole).sum(axis=0)
                    out[:, 1] += p.sum(axis=0)
                    out[:, 2 : 2 + width] += p.T @ z
                    out[:, 2 + width :] += p.T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "v"])

        total = np.zeros(np.prod(shape))
        for r in blocks.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r.i] = r.v
        return dict(zip(found, total.reshape(shape), strict=True))

    def fit(self, df: DataFrame):
        row = df.agg(*chain.from_iterable((F.avg(x), F.stddev_pop(x)) for x in self.features), F.count("*")).first()
        self.scale = {x: (row[2 * i] or 0.0, row[2 * i + 1]) for i, x in enumerate(self.features)}
        data = self._vectors(df).select("_v").persist()
        found = {r: self._drawn(data, self.seed + r) for r in range(self.restarts)}
        blocks, width = stored(self._packed(data, row[-1])), len(self.features)
        data.unpersist()
        for _ in range(self.rounds):
            moving = {r: m for r, m in found.items() if abs(m.likelihood - m.before) > self.still}
            if not moving:
                break
            for r, s in self._sums(blocks, moving).items():
                n, means = s[:, 1], s[:, 2 : 2 + width] / s[:, 1:2]
                spread = s[:, 2 + width :].reshape(-1, width, width) / n[:, None, None] - means[:, :, None] * means[:, None, :]
                found[r] = Mixture(n / n.sum(), means, spread, float(s[0, 0]), found[r].likelihood, found[r].rounds + 1)
        self.model = max(found.values(), key=lambda m: m.likelihood)
        self.names = regime_names(self.centres(df))
        return self

    def _probable(self, df: DataFrame) -> DataFrame:
        """Complete rows with `_p`, the distributions' densities times their weights."""
        scaled = df.dropna("any", subset=self.features).withColumn("_z", F.array(*((F.col(x) - m) / (s or 1.0) for x, (m, s) in self.scale.items())))
        z, dense = F.col("_z"), []
        for w, root, centre, height in zip(self.model.weights, *self.model.whitened(), strict=True):
            steps = [sum((z[i] * float(v) for i, v in enumerate(way)), F.lit(-float(c))) for way, c in zip(root.T, centre, strict=True)]
            dense.append(F.lit(EPSILON) + F.lit(float(w)) * F.exp(F.lit(float(height)) - sum((x * x for x in steps), F.lit(0.0)) / 2))
        return scaled.withColumn("_p", F.array(*dense))

    def predict(self, df: DataFrame) -> DataFrame:
        return self._probable(df).withColumn("regime", (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).select(*df.columns, "regime")

    def posterior(self, df: DataFrame) -> DataFrame:
        whole = sum((F.col("_p")[i] for i in range(self.k)), F.lit(0.0))
        return self._probable(df).withColumn("_n", whole).select(*df.columns, F.transform("_p", lambda p: p / F.col("_n")).alias("posterior"))


DETECTORS = {"none": NoRegimes, "rule": RuleRegimes, "kmeans": KMeansRegimes, "gmm": MixtureRegimes}


def detector(method: str, k: int = 4, seed: int = 7, features: list[str] | None = None):
    if method not in DETECTORS:
        raise ValueError(f"unknown regime method {method!r}; there are {sorted(DETECTORS)}")
    return DETECTORS[method](k, features, seed) if issubclass(DETECTORS[method], _Clusters) else DETECTORS[method]()


def _median(xs):
    xs = sorted(xs)
    return (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2


def regime_names(centres) -> dict[int, str]:
    """Names from where each centre lies among the others; equal names are numbered."""
    trend_cut = _median([abs(r["trend_strength"]) for r in centres])
    vol_cut = _median([r["vol_percentile"] for r in centres])
    names, seen = {}, {}
    for r in centres:
        t = r["trend_strength"]
        name = f"{'Uptrend' if t > trend_cut else 'Downtrend' if t < -trend_cut else 'Range'}, {'high-volatility' if r['vol_percentile'] > vol_cut else 'quiet'}"
        seen[name] = seen.get(name, 0) + 1
        names[r["regime"]] = name if seen[name] == 1 else f"{name} ({seen[name]})"
    return names


def named(df: DataFrame, names: dict[int, str], column: str = "regime") -> DataFrame:
    """`regime_name` of each code."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items())) if names else F.create_map().cast("map<int,string>")
    return df.withColumn("regime_name", F.coalesce(F.try_element_at(table, F.col(column)), F.concat(F.lit("Regime "), F.col(column))))


def describe_regimes(df: DataFrame, features=tuple(DESCRIPTORS)) -> DataFrame:
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return df.groupBy("regime").agg(*(F.avg(x).alias(x) for x in features), (F.count("*") / total).alias("share"))


def run_lengths(df: DataFrame) -> DataFrame:
    """Runs of one regime: symbol, run, regime, start, end, bars."""
    changed = F.when(F.col("regime") == lag("regime"), 0).otherwise(1)
    rows = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(running()))
    return rows.groupBy("symbol", "run").agg(F.first("regime").alias("regime"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"))


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("symbol", "regime").agg(F.count("*").alias("runs"), F.avg("bars").alias("mean_bars"), F.percentile("bars", F.lit(0.5)).alias("median_bars"), F.max("bars").alias("max_bars"))


def longest_runs(runs: DataFrame, n: int = 12) -> DataFrame:
    return runs.orderBy(F.desc("bars"), "symbol", "start").limit(n)


def persistence(df: DataFrame) -> DataFrame:
    """Share of bars in the regime of the bar before; the first bar counts as a change."""
    return df.withColumn("_s", F.coalesce((F.col("regime") == lag("regime")).cast("double"), F.lit(0.0))).groupBy("symbol").agg(F.avg("_s").alias("persistence"))


def transitions(df: DataFrame, normalise: bool = True) -> DataFrame:
    """(symbol, from, to, value) for all pairs of regimes of a symbol, those that never occur too."""
    steps = df.withColumn("to", lead("regime")).where("to IS NOT NULL").groupBy("symbol", F.col("regime").alias("from"), "to").agg(F.count("*").cast("double").alias("value"))
    states = df.select("symbol", "regime").distinct()
    grid = states.select("symbol", F.col("regime").alias("from")).join(states.select("symbol", F.col("regime").alias("to")), "symbol")
    out = grid.join(steps, ["symbol", "from", "to"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if normalise:
        out = out.withColumn("value", F.coalesce(F.col("value") / F.nullif(F.sum("value").over(Window.partitionBy("symbol", "from")), F.lit(0.0)), F.lit(0.0)))
    return out


def profile(df: DataFrame, descriptors=tuple(DESCRIPTORS), bars_per_year: int = 6_240) -> DataFrame:
    """What each regime is like: how often, how long, and what the market does in it."""
    rows = df.withColumn("_r", F.coalesce(F.log("close") - F.log(lag("close")), F.lit(0.0)))
    root = float(bars_per_year) ** 0.5
    mean, dev = F.avg("_r"), F.stddev_pop("_r")
    out = rows.groupBy("symbol", "regime").agg(
        F.count("*").alias("bars"), (mean * 1e4).alias("mean_return_bps"), (dev * 1e4).alias("volatility_bps"), (mean * bars_per_year).alias("annualised_return"), (dev * root).alias("annualised_volatility"),
        (mean / F.nullif(dev, F.lit(0.0)) * root).alias("return_per_unit_risk"), F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).alias("positive_bar_share"), *(F.avg(x).alias(x) for x in descriptors),
    )
    out = out.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy("symbol")))
    runs = run_lengths(df).groupBy("symbol", "regime").agg(F.avg("bars").alias("mean_run_bars"))
    return out.join(runs, ["symbol", "regime"])


#: Columns of the display table: what they show, by how much it is multiplied, and to how many digits it is rounded.
SHOWN = {
    "Share": ("share", 100, 1), "Avg run (bars)": ("mean_run_bars", 1, 1), "Return/bar (bps)": ("mean_return_bps", 1, 2), "Vol/bar (bps)": ("volatility_bps", 1, 2), "Ann. return": ("annualised_return", 100, 1), "Ann. volatility": ("annualised_volatility", 100, 1),
    "Return/risk": ("return_per_unit_risk", 1, 2),
}


def display(profiled: DataFrame, names: dict[int, str]) -> DataFrame:
    """A profile with the regimes' names and figures rounded for reading."""
    return named(profiled, names).select("symbol", F.col("regime").alias("id"), F.col("regime_name").alias("Regime"), F.col("bars").alias("Bars"), *(F.round(F.col(c) * by, digits).alias(n) for n, (c, by, digits) in SHOWN.items()))


def stability(train: DataFrame, test: DataFrame) -> DataFrame:
    """Share of each regime in two windows, and the difference."""
    def shares(df, name):
        return df.groupBy("symbol", "regime").agg(F.count("*").alias("n")).select("symbol", "regime", (F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))).alias(name))

    both = shares(train, "train_share").join(shares(test, "test_share"), ["symbol", "regime"], "full_outer").fillna(0.0, ["train_share", "test_share"])
    return both.withColumn("drift", F.abs(F.col("test_share") - F.col("train_share")))


def regime_performance(rows: DataFrame, bars_per_year: int = 6_240) -> DataFrame:
    """Strategy results by regime, from (symbol, ts, regime, strategy_return, prediction, label)."""
    keyed = rows.withColumn("_k", F.struct("symbol", "regime"))
    metrics = performance(keyed.select("_k", "ts", "strategy_return"), bars_per_year, position=None, key="_k")
    traded = F.col("prediction") != 0
    own = keyed.groupBy("_k").agg(F.count("*").alias("n"), (F.avg("strategy_return") * 1e4).alias("return_bps"), F.avg(traded.cast("double")).alias("signal_rate"), F.avg(F.when(traded, (F.col("label") == F.col("prediction")).cast("double"))).alias("directional_precision"))
    out = own.join(metrics.select("_k", "sharpe", "max_drawdown", "hit_rate"), "_k")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("_k.symbol"))
    return out.select("_k.symbol", "_k.regime", F.col("n").alias("bars"), share.alias("share"), "sharpe", "return_bps", "max_drawdown", "hit_rate", "signal_rate", "directional_precision")


def sampled(df: DataFrame, n: int = 6_000, seed: int = 7) -> DataFrame:
    """At most n rows, by a hash: the same ones in every run."""
    return df.orderBy(hashed(seed)).limit(n)
