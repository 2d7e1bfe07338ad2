"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings over hashed text features.

A document's features are its distinct lower-cased words, its runs of punctuation and a few binned measures of its
form, hashed into ``DIM`` places. One weight vector is shared by all grades, s = w.x, and ordered thresholds give P(grade <= k) =
sigmoid(t_k - s). Selection uses the expected grade and the tail probability P(grade >= k).

Ratings are graded from the labels: 0 toxic, 1 poor, 2 good. The fit uses at most ``SAMPLE`` rated documents, taken by
a hash of their id; this bound is a parameter. Features are taken by Spark tasks; ``SHARDS`` shards of the sample are
fitted side by side by follow-the-regularised-leader steps, whose L1 term keeps the weights of chance words at zero,
and their models are averaged after each of ``ROUNDS`` rounds, which start from the average. Every document is then
scored in one pass over the whole texts. The model is of fixed size at any size of the corpus.

Thresholds are kept as the first one and the logarithms of the gaps, so they stay ordered, and their steps are bounded:
a grade with few ratings or none cannot drive them apart.

Cases: null and empty texts have only the feature of being empty and are scored like any other; ratings that repeat
or clash count as the worst of them, null ratings are left out; of texts that share a rated id one is taken for the fit,
the same in each run, and each is scored by itself; without ratings no document is rejected; repeated rows
score alike; an empty table gives an empty result; further columns stay, and the operator's own replace clashing ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import light_batches, passing, table, written

DIM, GRADES = 1 << 18, 3
SAMPLE, SHARDS, ROUNDS, EPOCHS = 24_000, 4, 3, 3
#: Steps: rate, smoothing, L1 and L2.
RATE, SMOOTH, L1, L2 = 0.3, 1.0, 6.0, 0.5
#: Steps of the thresholds, and the bounds of the gaps between them.
CUT_RATE, LEAST_GAP, MOST_GAP = 0.05, 0.05, 20.0
#: A document is kept if P(grade >= GOOD) reaches TAIL.
GOOD, TAIL = 2, 0.45
CACHE = 200_000

#: ASCII punctuation ends a word, so that marks stuck to a word don't hide it.
_TO_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_runs = re.compile(rb"[!-/:-@\[-`{-~]{2,8}")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARK = bytes(c for c in range(256) if chr(c) not in "#*$%&|<>!=~^_{}[]\\@")
_EDGES = np.array([0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95, 1.5, 3.0])


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) % DIM
        return h


_places = _Places()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct places of the whole text's features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.array([_places[b"\x00empty"]], np.int32)
    kinds = set(raw.lower().translate(_TO_BLANK).split())
    n, size, scale = len(words), len(raw), min(12, len(words).bit_length())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    measures = {
        b"upper": len(raw.translate(None, _NOT_UPPER)) / size,
        b"marks": len(raw.translate(None, _NOT_MARK)) / n,
        b"lines": 1 - len(set(lines)) / max(1, len(lines)),
        b"pairs%d" % scale: 1 - pairs,
    }
    form = {b"\x00%s:%d" % (k, np.searchsorted(_EDGES, v)) for k, v in measures.items()}
    found = kinds | form | set(_runs.findall(raw))
    return np.unique(np.fromiter(map(_places.__getitem__, found), np.int32, len(found)))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    cuts: np.ndarray = field(default_factory=lambda: np.array([-2.0, -1.0]))

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) by row and k < GRADES - 1."""
        return sigmoid(self.cuts[None, :] - np.asarray(scores)[:, None])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return (1 - self.below(scores)).sum(1)

    def tail(self, scores: np.ndarray, grade: int = GOOD) -> np.ndarray:
        return 1 - self.below(scores)[:, grade - 1]


def loss(cuts: np.ndarray, s: float, y: int) -> float:
    """-log P(grade = y) of a row with the score s."""
    below = np.concatenate([[0.0], sigmoid(np.asarray(cuts) - s), [1.0]])
    return -float(np.log(below[y + 1] - below[y]))


def gradient(first: float, gaps: np.ndarray, s: float, y: int) -> tuple[float, float, np.ndarray]:
    """The loss's derivatives by the score, by the first threshold and by the logarithms of the gaps between thresholds.

    With sigmoid(t + gap) - sigmoid(t) = sigmoid(t + gap) sigmoid(-t) (1 - exp(-gap)) nothing is divided by a small
    probability: the first two are within 1, the last within the gap plus 1, whatever the thresholds.
    """
    cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
    a = float(sigmoid(cuts[y] - s)) if y < len(cuts) else 1.0
    b = float(sigmoid(cuts[y - 1] - s)) if y > 0 else 0.0
    by_score = 1.0 - a - b
    by_gaps = np.zeros(len(gaps))
    if y > 0:
        by_gaps[: y - 1] = -by_score * gaps[: y - 1]
    if 0 < y < len(cuts):
        gap = gaps[y - 1]
        by_gaps[y - 1] = -(1 - a) / ((1 - b) * -np.expm1(-gap)) * gap
    return by_score, -by_score, by_gaps


def fit_shard(rows: list[np.ndarray], grades: np.ndarray, start: OrdinalModel, epochs: int = EPOCHS) -> OrdinalModel:
    """One shard's model after some epochs from a starting model: FTRL-proximal steps for the weights, plain ones for the thresholds."""
    n = np.zeros(DIM)
    z = -start.weights * (SMOOTH / RATE + L2) - np.sign(start.weights) * L1  # the leader at the start is the starting model
    first, logs = float(start.cuts[0]), np.log(np.maximum(np.diff(start.cuts), LEAST_GAP))
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            x = rows[i]
            zi = z[x]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((SMOOTH + np.sqrt(n[x])) / RATE + L2))
            g, by_first, by_gaps = gradient(first, np.exp(logs), wi.sum(), int(grades[i]))
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / RATE
            z[x] = zi + g - step * wi
            n[x] += g * g
            first -= CUT_RATE * by_first
            logs = np.clip(logs - CUT_RATE * np.clip(by_gaps, -1, 1), np.log(LEAST_GAP), np.log(MOST_GAP))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((SMOOTH + np.sqrt(n)) / RATE + L2))
    return OrdinalModel(w, first + np.concatenate([[0.0], np.cumsum(np.exp(logs))]))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 poor, 2 good."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return worst.where("toxic IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """The model of at most ``sample`` rated documents; None if there are none."""
    some = ratings.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = F.broadcast(written(some, "ordinal-sample"))  # at most ``sample`` rows of an id and a grade

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = [features(t).tolist() for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "grade": rows["grade"], "x": x})

    rated = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "grade", "text")
    rated = rated.mapInPandas(cut, "doc_id long, grade int, x array<int>")
    rated = rated.groupBy("doc_id", "grade").agg(F.min("x").alias("x"))  # of several texts of an id always the same one
    rated = written(rated.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SHARDS)).cast("int")), "ordinal-features")
    if rated.isEmpty():
        return None
    model = OrdinalModel()
    for _ in range(ROUNDS):
        model = averaged(rated, model)
    return model


def averaged(rated: DataFrame, start: OrdinalModel) -> OrdinalModel:
    """The mean of the shards' models, each by its number of rows."""
    places = np.nonzero(start.weights)[0]
    known, values, cuts = places.astype(np.int32), start.weights[places], start.cuts

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        begin = OrdinalModel(cuts=cuts.copy())
        begin.weights[known] = values
        rows = rows.sort_values("doc_id")
        model = fit_shard([np.asarray(x, np.int64) for x in rows["x"]], rows["grade"].to_numpy(), begin)
        at = np.nonzero(model.weights)[0]
        place = np.concatenate([at, -1 - np.arange(len(model.cuts))])
        return pd.DataFrame({"place": place, "value": np.concatenate([model.weights[at], model.cuts]), "n": len(rows)})

    shards = rated.groupBy("shard").applyInPandas(train, "place int, value double, n long")
    total = rated.count()
    # At most DIM places and the thresholds.
    found = shards.groupBy("place").agg((F.sum(F.col("value") * F.col("n")) / total).alias("value")).collect()
    model = OrdinalModel(cuts=cuts.copy())
    for place, value in found:
        if place >= 0:
            model.weights[place] = value
        else:
            model.cuts[-1 - place] = value
    return model


def scored(docs: DataFrame, model: OrdinalModel, keep: list[str]) -> DataFrame:
    """``keep``, which may have no column of these names, with score, expected grade and P(good) of each document."""
    places = np.nonzero(model.weights)[0].astype(np.int32)
    values, cuts = model.weights[places], model.cuts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = OrdinalModel(cuts=cuts)
        own.weights[places] = values
        for rows in batches:
            s = np.array([own.weights[features(t)].sum() for t in rows["_text"]], float)
            more = pd.DataFrame({"score": s, "expected_grade": own.expected(s), "p_good": own.tail(s)}, index=rows.index)
            yield pd.concat([rows[keep], more], axis=1)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInPandas(run, f"{schema}, score double, expected_grade double, p_good double")


def tail_chance(model: OrdinalModel) -> Callable[[Column], Column]:
    """P(good) of a text as a function of its column; only texts go to Python, the other columns of a row stay where they are."""
    places = np.nonzero(model.weights)[0].astype(np.int32)
    values, cuts = model.weights[places], model.cuts

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = OrdinalModel(cuts=cuts)
        own.weights[places] = values
        for texts in batches:
            yield pd.Series(own.tail(np.array([own.weights[features(t)].sum() for t in texts], float)))

    return run


def graded_documents(docs: DataFrame, labels: DataFrame, keep: list[str], tail: float = TAIL) -> DataFrame:
    with passing(docs.sparkSession):
        model = fit(docs, graded(labels))
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*keep, none.alias("score"), none.alias("expected_grade"), none.alias("p_good"), F.lit(True).alias("kept"))
    return scored(docs, model, keep).withColumn("kept", F.col("p_good") >= tail)


def select_good(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with.

    They are written here, as the bound of Arrow batches is the session's when a stage is planned: whole texts in batches of
    Spark's own size took memory that the later stages of a pipeline miss.
    """
    spark = docs.sparkSession
    with passing(spark), light_batches(spark):
        model = fit(docs, graded(labels))
        return docs if model is None else written(docs.where(tail_chance(model)(docs["text"]) >= tail), "ordinal-good", keep=True)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, score, expected_grade, p_good, kept`` of every document."""
    return graded_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
