"""Toxicity by a classifier chain: linear models in sequence, fed out-of-fold probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.text import LOWER_ALNUM, utf8
from pairmatch.session import written

#: The labelled rows a chain is fitted on at most, on average: a documented bound.
MOST_ROWS = 20_000
FOLDS = 3
#: Features that the models may use: the most frequent of those in ``MIN_DOCS`` fitted rows or more.
VOCABULARY = 1 << 16
MIN_DOCS = 3
#: Bytes of word starts that are features next to whole words: languages with many forms and
#: compounds of a word share its start.
STARTS = (4, 5, 6)
#: A model uses the features whose shares in the two classes differ by so many standard errors,
#: the most different ones if there are too many. The words of a category may be rare each, so
#: the gate is low, and the penalty holds down what passes it by chance.
ERRORS, SELECTED = 2.5, 4096
STEPS = 120
PENALTY = 1e-4
THRESHOLDS = [k / 100 for k in range(5, 96, 5)]
REMEMBERED = 1 << 20


def word_features(word: bytes) -> list[bytes]:
    """A word and its starts; no word contains the mark of a start."""
    return [word, *(word[:n] + b"-" for n in STARTS if len(word) > n)]


def read(text: bytes) -> tuple[set[bytes], list[float]]:
    """The distinct lower-case runs of letters and digits of a text, and figures of its form.

    The figures: logarithm of the number of words, share of distinct ones, mean length, and
    share of other characters than letters and digits.
    """
    plain = text.translate(LOWER_ALNUM)
    words = plain.split()
    distinct, n, blank = set(words), max(1, len(words)), plain.count(b" ")
    form = [
        math.log1p(len(words)), len(distinct) / n,
        (len(plain) - blank) / n / 10, blank / max(1, len(plain)),
    ]
    return distinct, form


def text_features(text: bytes) -> set[bytes]:
    """The features of a text: words and their starts."""
    return {f for word in read(text)[0] for f in word_features(word)}


@dataclass
class Link:
    """One category of the chain: weights of features, of form and of earlier probabilities."""

    name: str
    features: np.ndarray
    weights: np.ndarray
    bias: float
    earlier: np.ndarray
    threshold: float = 0.5

    def logit(self, indicator: np.ndarray, before: list[float]) -> float:
        """The score of a text; ``indicator`` marks its features."""
        return (
            self.bias
            + float(self.weights[indicator[self.features]].sum())
            + float(np.dot(self.earlier, before))
        )


@dataclass
class Chain:
    """Feature numbers and the links in their order."""

    numbers: dict[bytes, int]
    links: list[Link]


def sigmoid(x):
    """Logistic function without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_linear(
    rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """A regularised logistic model: ``(features, weights, bias, weights of dense)``.

    Features are scaled by the logarithm of the ratio of their shares in the two classes. Steps
    follow the signs of the gradient with a size per weight, which suits a convex function
    whose inputs have very different scales. Without two classes the bias alone says so.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    positives = int(y.sum())
    if positives in (0, len(y)):
        return *none, 20.0 if positives else -20.0, np.zeros(dense.shape[1])
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    yes = np.bincount(flat, weights=y[owner], minlength=size)
    no = np.bincount(flat, minlength=size) - yes
    n_yes, n_no = positives, len(y) - positives
    pooled = (yes + no + 1) / (len(y) + 2)
    z = np.abs(yes / n_yes - no / n_no) / np.sqrt(
        pooled * (1 - pooled) * (1 / n_yes + 1 / n_no)
    )
    chosen = np.argsort(-z, kind="stable")[:SELECTED]
    chosen = np.sort(chosen[z[chosen] >= ERRORS])
    ratio = np.log((yes[chosen] + 1) / (n_yes + 2)) - np.log((no[chosen] + 1) / (n_no + 2))
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    kept = place[flat] >= 0
    column, owner = place[flat[kept]], owner[kept]
    value = ratio[column]
    k, width = len(chosen), len(chosen) + dense.shape[1] + 1
    weights, step, last = np.zeros(width), np.full(width, 0.05), np.zeros(width)
    weights[-1] = np.log(n_yes / n_no)
    for _ in range(STEPS):
        words = np.bincount(owner, weights=value * weights[column], minlength=len(y))
        logit = words + dense @ weights[k:-1] + weights[-1]
        error = (sigmoid(logit) - y) / len(y)
        gradient = np.concatenate(
            (
                np.bincount(column, weights=value * error[owner], minlength=k),
                dense.T @ error,
                [error.sum()],
            )
        )
        gradient[:-1] += PENALTY * weights[:-1]
        turn = gradient * last
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-6, 1)
        gradient[turn < 0] = 0
        weights -= np.sign(gradient) * step
        last = gradient
    return chosen, weights[:k] * ratio, float(weights[-1]), weights[k:-1]


#: Figures of form; the columns of a fitted model.
FORM = 4
MODEL = "id long, p double, features array<long>, weights array<double>, bias double, earlier array<double>"


def fit_group(name: str, earlier: list[str], size: int, folds: int):
    """A function that fits the models of one category on the bounded sample.

    Model -1 uses all rows. Model k leaves fold k out and gives the probabilities of its rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        form = np.array(rows["form"].tolist(), float).reshape(len(rows), -1)
        dense = np.concatenate((form, rows[[f"p_{e}" for e in earlier]].to_numpy(float)), axis=1)
        y, fold = rows[name].to_numpy(float), rows["fold"].to_numpy()
        ids = rows["id"].to_numpy()
        lists = [np.asarray(r, np.int64) for r in rows["numbers"]]
        marks, out = np.zeros(size, bool), []
        for fit in range(-1, folds):
            used = (fold != fit) & ~np.isnan(y)
            kept = [r for r, u in zip(lists, used) if u]
            features, weights, bias, before = fit_linear(kept, dense[used], y[used], size)
            link = Link(name, features, weights, bias, before)
            if fit < 0:
                model = features.tolist(), weights.tolist(), bias, before.tolist()
                out.append((None, None, *model))
            for k in np.flatnonzero(fold == fit):
                marks[lists[k]] = True
                p = float(sigmoid(link.logit(marks, list(dense[k]))))
                marks[lists[k]] = False
                out.append((int(ids[k]), p, None, None, None, None))
        names = ["id", "p", "features", "weights", "bias", "earlier"]
        return pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    return run


def best_threshold(rows: DataFrame, name: str) -> float:
    """The threshold of the best F1 out of fold; of several the middle one."""
    yes, p = F.col(name) == 1, F.col(f"p_{name}")
    counts = rows.where(F.col(name).isNotNull()).agg(
        F.count_if(yes),
        *(F.count_if(yes & (p >= t)) for t in THRESHOLDS),
        *(F.count_if(~yes & (p >= t)) for t in THRESHOLDS),
    ).first()
    positives, k = counts[0], len(THRESHOLDS)
    scores = [
        2 * hit / (positives + hit + wrong) if positives + hit + wrong else 0.0
        for hit, wrong in zip(counts[1 : k + 1], counts[k + 1 :])
    ]
    best = [t for t, score in zip(THRESHOLDS, scores) if score == max(scores)]
    return best[len(best) // 2]


def numbered(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Replace ``text`` by the ``numbers`` of its features and the figures of its ``form``."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType(
        [docs.schema[c] for c in rest]
        + [
            T.StructField("numbers", T.ArrayType(T.IntegerType())),
            T.StructField("form", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            lists, forms = [], []
            for text in utf8(batch.column(len(rest))):
                words, form = read(text)
                found = {f for word in words for f in word_features(word)}
                lists.append(sorted(known[f] for f in found if f in known))
                forms.append(form)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(rest))),
                    pa.array(lists, pa.list_(pa.int32())),
                    pa.array(forms, pa.list_(pa.float64())),
                ],
                names=schema.names,
            )

    return docs.select(*rest, "text").mapInArrow(run, schema)


def feature_counts(docs: DataFrame) -> DataFrame:
    """``(feature, n)``: the number of texts that have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [list(text_features(text)) for text in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for own in lists for f in own], pa.binary())], names=["feature"]
            )

    found = docs.select("text").mapInArrow(run, "feature binary")
    return found.groupBy("feature").agg(F.count("*").alias("n"))


def fit_chain(
    labelled: DataFrame,
    categories: list[str],
    text_col: str = "text",
    id_col: str = "doc_id",
    most_rows: int = MOST_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """Fit one linear model per category, in the order given.

    Inputs are the features of a text and the probabilities of the categories before. While
    fitting, these are out-of-fold: a model fitted on the other folds predicts each fold, so
    later models see earlier ones as they behave on new texts. The model kept of a category is
    fitted on all folds; its threshold is that of the best F1 out of fold. The models of one
    category are fitted in one task, which reads the sample once.

    At most about ``most_rows`` labelled rows are used, chosen by a hash of the id; this bounds
    the tasks and what the driver sees. A null label does not count for its category; a
    category without two classes gets a constant; without labelled rows nothing is positive.
    """
    source = labelled.select(
        F.col(id_col).alias("key"), F.col(text_col).alias("text"),
        *(F.col(c).cast("double").alias(c) for c in categories),
    )
    total = max(1, labelled.count())
    place = F.pmod(F.xxhash64("key", F.lit("chosen")), F.lit(1 << 30))
    sample = source.where(place < F.lit(int(min(1.0, most_rows / total) * (1 << 30))))
    fold = F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(folds)).cast("int")
    sample = written(
        sample.select("text", fold.alias("fold"), *categories).withColumn(
            "id", F.monotonically_increasing_id()
        ),
        "labelled",
    )
    top = feature_counts(sample).where(F.col("n") >= MIN_DOCS)
    top = top.orderBy(F.desc("n"), "feature").limit(VOCABULARY).collect()
    numbers = {bytes(r["feature"]): k for k, r in enumerate(top)}
    rows = written(numbered(sample, numbers), "numbered")
    chain, earlier = Chain(numbers, []), []
    for name in categories:
        given = rows.select(
            "id", "fold", "numbers", "form", name, *(f"p_{e}" for e in earlier)
        )
        run = fit_group(name, list(earlier), len(numbers), folds)
        out = written(given.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, MODEL), "fits")
        kept = out.where("id is null").first()
        link = Link(name, np.zeros(0, np.int64), np.zeros(0), -20.0, np.zeros(FORM + len(earlier)))
        if kept is not None:
            link = Link(
                name, np.array(kept["features"], np.int64), np.array(kept["weights"], float),
                kept["bias"], np.array(kept["earlier"], float),
            )
        p = out.where("id is not null").select("id", F.col("p").alias(f"p_{name}"))
        rows = rows.join(F.broadcast(p), "id")  # as many rows as the sample
        link.threshold = best_threshold(rows, name)
        chain.links.append(link)
        earlier.append(name)
    return chain


class Remembered(dict):
    """Feature numbers of words, remembered."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = (self.numbers.get(f) for f in word_features(word))
        value = self[word] = tuple(k for k in found if k is not None)
        return value


def classify(
    docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` as a struct ``doc`` with ``p_<category>`` and the decision ``<category>``.

    Whole texts are read, and categories are decided by their thresholds. A narrow map: nothing
    is shuffled. Null and empty texts have no features and get the models' biases; rows with
    equal or null ids are judged each on their own; other columns are carried along in the
    struct, so their names never clash.
    """
    source = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    names = [link.name for link in chain.links]
    schema = T.StructType(
        [source.schema["doc"]]
        + [T.StructField(f"p_{name}", T.DoubleType()) for name in names]
        + [T.StructField(name, T.BooleanType()) for name in names]
    )
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known, marks = Remembered(own.numbers), np.zeros(len(own.numbers), bool)
        for batch in batches:
            probabilities: list[list[float]] = []
            for text in utf8(batch.column(1)):
                words, form = read(text)
                numbers = [k for word in words for k in known[word]]
                marks[numbers] = True
                before: list[float] = []
                for link in own.links:
                    before.append(float(sigmoid(link.logit(marks, form + before))))
                marks[numbers] = False
                probabilities.append(before)
            table = np.array(probabilities).reshape(-1, len(own.links))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(table[:, k]) for k in range(len(own.links))),
                    *(pa.array(table[:, k] >= x.threshold) for k, x in enumerate(own.links)),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)
