"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SPACES, bounded_sample, cut, ship, split_words

#: Statistics of a document, in the order of ``statistics``.
NAMES = (
    "log_words", "log_chars", "word_length", "word_spread", "upper", "digits", "symbols", "exclamations", "stops", "other_marks",
    "non_ascii", "distinct_words", "distinct_pairs", "repeated_lines", "log_lines", "words_per_line", "marked_ends", "capital_starts",
)
SYMBOLS = b"#*$%&|<>"


def statistics(text: str) -> list[float]:
    """Numbers that describe a text: sizes, shares of kinds of characters, variety of words and lines."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).astype(np.float64)
    chars = max(len(text) - sum(map(text.count, SPACES)), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ends = sum(1 for w in words if w[-1] in b"#*$%&|<>!")
    capitals = sum(1 for w in words if 65 <= w[0] <= 90)
    symbols = sum(count[c] for c in SYMBOLS)
    stops = count[ord(".")] + count[ord(",")]
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    return [
        np.log1p(n),
        np.log1p(chars),
        lengths.mean(),
        lengths.std(),
        count[65:91].sum() / chars,
        count[48:58].sum() / chars,
        symbols / chars,
        count[ord("!")] / n,
        stops / n,
        (marks - symbols - stops - count[ord("!")]) / n,
        count[128:].sum() / chars,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        1.0 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        ends / n,
        capitals / n,
    ]


@dataclass
class QualityModel:
    """Scale of the statistics, the random features, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8.0, 8.0)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by ``x``; the mean ``x`` and the level of each block."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def labelled_statistics(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, doc_id: str, text: str) -> DataFrame:
    """``stats array<double>, y, calibrate`` of at most about ``max_rows`` labelled documents, picked by a hash of the id.

    Every fifth of them by another hash is for calibration. Of repeated labels of an id the
    largest counts; null labels and ids count for none. The broadcast side is bounded by
    ``max_rows`` ids.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(target).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(target).alias("y"))
    picked = bounded_sample(known, F.col("_id"), max_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")

    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.array(statistics(t or "")) for t in part], dtype=object)

    calibrate = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(5)) == 0
    return rows.select(measure.asNondeterministic()("text").alias("stats"), (F.col("y") > 0).cast("double").alias("y"), calibrate.alias("calibrate"))


def fit(rows: DataFrame, n_features: int = 256, width: float = 4.0, ridge: float = 1.0, bins: int = 512, tasks: int = 16, seed: int = 5) -> QualityModel:
    """Ridge regression on cosines of random projections (a Gaussian kernel of ``width``), then isotonic steps.

    The rows are dealt to ``tasks`` tasks; each sums its part of the normal equations, and
    these sums (``tasks`` matrices of fixed size) meet in the driver. The calibration rows
    come as sums over at most ``bins`` ranges of raw score. With no rows or one label the
    score is that label's share.
    """
    spark = ship(rows.sparkSession)
    rows = cut(rows)
    d = len(NAMES)
    moments = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), *moments).first()
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.array([head[f"m{i}"] or 0.0 for i in range(d)]),
        np.array([head[f"s{i}"] or 1.0 for i in range(d)]),
        rng.normal(size=(d, n_features)) / width,
        rng.uniform(0, 2 * np.pi, n_features),
        np.zeros(1 + d + n_features),
        np.array([0.0]),
        np.array([head["share"] if head["share"] is not None else 0.5]),
    )
    if not head["n"] or head["share"] in (0.0, 1.0):
        return model
    shipped = spark.sparkContext.broadcast(model)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        size = len(m.weights)
        square, right = np.zeros((size, size)), np.zeros(size)
        for part in parts:
            for i in range(0, len(part), 4096):
                f = m.features(np.stack(part["stats"].iloc[i : i + 4096]))
                square += f.T @ f
                right += f.T @ part["y"].iloc[i : i + 4096].to_numpy()
        yield pd.DataFrame([(square.tobytes(), right.tobytes())], columns=["square", "right"])

    learn = rows.where("not calibrate").repartition(tasks).mapInPandas(sums, "square binary, right binary")
    size = len(model.weights)
    square, right = np.zeros((size, size)), np.zeros(size)
    for r in learn.toLocalIterator():
        square += np.frombuffer(r["square"]).reshape(size, size)
        right += np.frombuffer(r["right"])
    penalty = np.full(size, ridge)
    penalty[0] = 1e-6
    model.weights = np.linalg.solve(square + np.diag(penalty), right)
    fitted = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def raw(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(fitted.value.raw(np.stack(part)) if len(part) else np.zeros(0))

    place = F.floor(F.greatest(F.least(F.col("raw"), F.lit(1.5)), F.lit(-0.5)) * (bins / 2))
    found = (
        rows.where("calibrate").select(raw.asNondeterministic()("stats").alias("raw"), "y").groupBy(place.alias("bin"))
        .agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    )
    if len(found):
        model.knots, model.values = isotonic(found["x"].to_numpy(), found["y"].to_numpy(), found["n"].to_numpy(dtype=np.float64))
    return model


def score_column(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Score of each text as a column, between 0 and 1; null and empty texts are scored like any other (all statistics 0)."""
    shipped = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            if len(part):
                yield pd.Series(np.clip(shipped.value.score(np.array([statistics(t or "") for t in part])), 0.0, 1.0))
            else:
                yield pd.Series(np.zeros(0))

    return run.asNondeterministic()(F.col(text))


def score_documents(docs: DataFrame, model: QualityModel, text: str = "text", from_score: float = 0.3) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from ``from_score`` on); they replace columns of these names. No shuffle."""
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*rest, score_column(docs, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= from_score).cast("int"))
