"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import LETTERS, bounded_sample, cut, free_name, ship

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
#: Lengths of the beginnings of words that are features beside whole words.
STEMS = (4, 5, 6, 7)


@dataclass
class ToxicityModel:
    """Weights of words and of beginnings of words (marked by ``*``), and the offset of a sentence's log-odds."""

    weights: dict[str, float]
    offset: float


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: up to a full stop, a mark or a line break."""
    return [m.span() for m in SENTENCE.finditer(text)]


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in STEMS if len(word) > k]]


def sentence_features(text: str) -> list[set[str]]:
    """Features of each sentence that has words."""
    out = []
    for a, b in sentences(text):
        found = set(LETTERS.findall(text[a:b].lower()))
        if found:
            out.append({f for w in found for f in word_features(w)})
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, doc_id: str, text: str) -> DataFrame:
    """``text, y`` of at most about ``max_rows`` labelled documents, picked by a hash of the id.

    Of repeated labels of an id the largest counts; null labels and null ids count for none.
    The broadcast side is bounded by ``max_rows`` ids.
    """
    known = labels.where(F.col(target).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(target).alias("y"))
    picked = bounded_sample(known, F.col("_id"), max_rows)
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id").select("text", "y")


def telling_features(sample: DataFrame, min_documents: int, max_features: int) -> list[str]:
    """At most ``max_features`` features that toxic documents of the sample have more often, the surest first.

    Counted by document, summed in the tasks before the shuffle; the measure is the score of
    a two-proportion test.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_docs: Counter = Counter()
        toxic: Counter = Counter()

        def flush():
            found = pd.DataFrame([(f, n, toxic[f]) for f, n in all_docs.items()], columns=["feature", "n", "k"])
            all_docs.clear()
            toxic.clear()
            return found

        for part in parts:
            for text, y in zip(part["text"], part["y"]):
                found = set().union(*sentence_features(text or ""))
                all_docs.update(found)
                if y > 0:
                    toxic.update(found)
                if len(all_docs) > 500_000:
                    yield flush()
        yield flush()

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > 0).cast("int")).alias("k")).first()
    if not totals["k"] or totals["k"] == totals["n"]:
        return []
    share = totals["k"] / totals["n"]
    counted = sample.mapInPandas(count, "feature string, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    score = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    best = counted.where(F.col("n") >= min_documents).withColumn("score", score).where("score > 1.5")
    return [r["feature"] for r in best.orderBy(F.desc("score"), "feature").limit(max_features).collect()]


def fit(
    sample: DataFrame, min_documents: int = 3, max_features: int = 4096, rounds: int = 300, rate: float = 0.1, ridge: float = 0.02, lasso: float = 1.0
) -> ToxicityModel:
    """Weights that make noisy-or of the sentences' scores fit the documents' labels.

    A document is toxic if at least one sentence is: P = 1 - prod(1 - p_s) with p_s the
    logistic function of the sentence's feature weights. Tasks turn the bounded sample into
    feature numbers per sentence; the driver holds these numbers only and ascends the
    likelihood (Adam, with a soft threshold that sets weak weights to 0). Without both
    labels the model is neutral.
    """
    spark = ship(sample.sparkSession)
    sample = cut(sample)
    features = telling_features(sample, min_documents, max_features)
    if not features:
        return ToxicityModel({}, -6.0)
    numbers = spark.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = numbers.value
        for part in parts:
            rows = []
            for text, y in zip(part["text"], part["y"]):
                sizes, found = [], []
                for s in sentence_features(text or ""):
                    own = sorted(number[f] for f in s if f in number)
                    sizes.append(len(own))
                    found.extend(own)
                rows.append((np.array(sizes, dtype="<i4").tobytes(), np.array(found, dtype="<i4").tobytes(), int(y > 0)))
            yield pd.DataFrame(rows, columns=["sizes", "features", "y"])

    rows = sample.mapInPandas(encode, "sizes binary, features binary, y int").toPandas()
    y = rows["y"].to_numpy(dtype=np.float64)
    weights, offset = fit_arrays(
        [np.frombuffer(s, "<i4") for s in rows["sizes"]],
        np.concatenate([np.zeros(0, "<i4"), *[np.frombuffer(w, "<i4") for w in rows["features"]]]),
        y, len(features), rounds, rate, ridge, lasso * min(1.0, y.sum() / 100),
    )
    return ToxicityModel({f: float(w) for f, w in zip(features, weights) if w}, offset)


def fit_arrays(
    sizes: list[np.ndarray], col: np.ndarray, y: np.ndarray, n_features: int, rounds: int, rate: float, ridge: float, lasso: float
) -> tuple[np.ndarray, float]:
    """``sizes`` has each document's number of features per sentence, ``col`` the features, all in a row."""
    sentence_doc = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    row = np.repeat(np.arange(len(sentence_doc)), np.concatenate(sizes))
    n_sentences = len(sentence_doc)
    w, offset = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        z = offset + np.bincount(row, weights=w[col], minlength=n_sentences)
        soft = np.logaddexp(0.0, z)  # -log(1 - p_s)
        total = np.bincount(sentence_doc, weights=soft, minlength=len(y))
        gain = np.where(y > 0, -1.0 / np.expm1(np.clip(total, 1e-9, 50.0)), 1.0)  # d loss / d total
        dz = gain[sentence_doc] / (1.0 + np.exp(-z))
        grad = np.append(np.bincount(col, weights=dz[row], minlength=n_features) + ridge * w, dz.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        move = scale * (m / (1 - 0.9**step))
        w -= move[:-1]
        offset -= move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * lasso, 0.0)
    return w, float(offset)


class Scorer:
    """Scores whole texts; the weights of words seen lately are kept."""

    MEMO = 400_000

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        x = self.memo.get(w)
        if x is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            x = self.memo[w] = sum(self.model.weights.get(f, 0.0) for f in word_features(w))
        return x

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of all sentences, and each sentence's span and score.

        Each word counts once a sentence; a beginning that several words share counts with each.
        """
        spans, z = [], []
        low = text.lower()
        if len(low) != len(text):  # some letters become two when lowered: cut first, lower then
            low = None
        for a, b in sentences(text):
            words = set(LETTERS.findall(low[a:b] if low is not None else text[a:b].lower()))
            if words:
                spans.append((a, b))
                z.append(sum(map(self.word, words)))
        if not z:
            return 0.0, []
        total = np.logaddexp(0.0, np.array(z) + self.model.offset)
        return float(-np.expm1(-total.sum())), [(a, b, float(-np.expm1(-t))) for (a, b), t in zip(spans, total)]


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", from_score: float = 0.5) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``offending``: start, end (code points) and score of each sentence from ``from_score`` on.

    Null and empty texts have no sentences and score 0. Rows stay as they are; columns of
    the added names are replaced. The model (a megabyte) is broadcast; no shuffle.
    """
    shipped = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shipped.value)
        for part in parts:
            rows = []
            for t in part:
                score, found = scorer.score(t or "")
                rows.append((score, [{"start": a, "end": b, "score": p} for a, b, p in found if p >= from_score]))
            yield pd.DataFrame(rows, columns=["score", "offending"])

    added = ("score", "offending", "predicted")
    rest = [c for c in docs.columns if c.lower() not in added]
    found = free_name(docs, "scored")
    return docs.select(*rest, run.asNondeterministic()(F.col(text)).alias(found)).select(
        *rest,
        F.col(found)["score"].alias("score"),
        (F.col(found)["score"] >= from_score).cast("int").alias("predicted"),
        F.col(found)["offending"].alias("offending"),
    )
