"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactual identity swaps."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from statera.llm.common import free_names, importable, text_or_empty

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features beside the words; a beginning is marked by an asterisk.
STEMS = (3, 4, 5, 6)
#: Identity terms in groups whose members are swapped with each other. Fixed values.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "gitanos"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés"),
)
SWAPS = {w: tuple(x for x in group if x != w) for group in IDENTITY_GROUPS for w in group}


def features(text: str) -> set[str]:
    """The words of a text in lower case and their beginnings, each once. Identity terms have no beginnings."""
    words = set(TOKEN.findall(text.lower()))
    out = set(words)
    words -= SWAPS.keys()
    for k in STEMS:
        out.update(w[:k] + "*" for w in words if len(w) >= k)
    return out


@dataclass
class ToxicityModel:
    """Weights by feature, at most as many as the fit's ``max_features`` and the identity terms, the intercept, and what positives weighed."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    positive_share: float | None = None

    def score(self, texts: Iterable[str]) -> np.ndarray:
        get, known = self.weights.__getitem__, self.weights.keys()
        logits = np.fromiter((self.intercept + sum(map(get, features(x) & known)) for x in texts), np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))

    def column(self, text: Column) -> Column:
        """The score of a text column; null scores as the empty text."""
        model = self

        @pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model.score(texts))

        return scored(F.coalesce(text, F.lit("")))


def counterfactuals(found: set[str]) -> list[tuple[str, str]]:
    """The identity swaps of a labelled text: (term that it holds, term that takes its place)."""
    return [(w, other) for w in sorted(found & SWAPS.keys()) for other in SWAPS[w]]


@dataclass
class Rows:
    """Labelled rows as the fit takes them: label of each row, and for each feature of a row the row's number and the feature's."""

    labels: np.ndarray
    row: np.ndarray
    feature: np.ndarray

    def where(self, keep: np.ndarray) -> Rows:
        number = np.cumsum(keep) - 1
        own = keep[self.row]
        return Rows(self.labels[keep], number[self.row[own]], self.feature[own])


def gradient(w: np.ndarray, bias: float, rows: Rows, weigh: np.ndarray, swaps: np.ndarray, strength: np.ndarray, l2: float, swap_penalty: float) -> np.ndarray:
    """Slope of the loss by each weight, then by the intercept.

    The loss is the sum of the rows' log losses times ``weigh``, plus l2 / (2 sqrt(rows)) times the squared weights, plus ``swap_penalty``
    times the sum over ``swaps`` (pairs of features) of ``strength`` times the squared change of the logit.
    """
    logits = bias + np.bincount(rows.row, w[rows.feature], len(rows.labels))
    slope = weigh * (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - rows.labels)
    grad = np.append(np.bincount(rows.feature, slope[rows.row], len(w)) + l2 * w / len(rows.labels) ** 0.5, slope.sum())
    change = 2 * swap_penalty * strength * (w[swaps[:, 0]] - w[swaps[:, 1]])
    np.add.at(grad, swaps[:, 0], change)
    np.add.at(grad, swaps[:, 1], -change)
    return grad


def descend(rows: Rows, n_features: int, vocabulary: list[str], positive_share: float, rounds: int, l2: float, swap_penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``rounds`` steps of Adam on all rows: the same result at every run."""
    index = {w: i for i, w in enumerate(vocabulary)}
    terms: dict[int, set[str]] = {}
    identity = np.array([w in SWAPS for w in vocabulary])
    for r, f in zip(rows.row[identity[rows.feature]].tolist(), rows.feature[identity[rows.feature]].tolist()):
        terms.setdefault(r, set()).add(vocabulary[f])
    pairs = Counter((index[a], index[b]) for found in terms.values() for a, b in counterfactuals(found))
    swaps = np.array(list(pairs), np.int64).reshape(-1, 2)
    strength = np.array(list(pairs.values()), np.float64) / max(1, pairs.total())
    labels = rows.labels
    weigh = np.where(labels > 0, positive_share / labels.sum(), (1 - positive_share) / (len(labels) - labels.sum()))
    w, bias = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        grad = gradient(w, bias, rows, weigh, swaps, strength, l2, swap_penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def chosen_share(rows: Rows, fold: np.ndarray, shares: Sequence[float], train) -> float:
    """The share whose models have the highest F1 at 0.5 on the folds that they were not trained on; of equal ones the first.

    A fold without both labels outside it is left out; without any fold the middle share stands.
    """
    hit, wrong, folds = np.zeros(len(shares)), np.zeros(len(shares)), 0
    for k in np.unique(fold):
        rest, own = rows.where(fold != k), rows.where(fold == k)
        if not 0 < rest.labels.sum() < len(rest.labels):
            continue
        folds += 1
        for i, share in enumerate(shares):
            w, bias = train(rest, share)
            said = bias + np.bincount(own.row, w[own.feature], len(own.labels)) >= 0
            hit[i] += (said & (own.labels > 0)).sum()
            wrong[i] += (said != (own.labels > 0)).sum()
    return shares[int(np.argmax(2 * hit / np.maximum(2 * hit + wrong, 1)))] if folds else shares[len(shares) // 2]


def fit(sample: DataFrame, min_docs: int = 4, max_features: int = 20_000, least_z: float = 2.5, rounds: int = 300, l2: float = 0.02, swap_penalty: float = 1.0, positive_shares: Sequence[float] = (0.25, 0.35, 0.5), folds: int = 3) -> ToxicityModel:
    """Fit on ``sample`` (text, label 0/1), which must be bounded: its rows' numbers of chosen features (not its texts) reach the driver.

    Features in fewer than ``min_docs`` texts go, then those whose share among positives differs from the rest by fewer than
    ``least_z`` standard errors, and at most ``max_features`` stay. Beside the log loss (see :func:`gradient`) and ``l2``, the loss has
    ``swap_penalty`` times the mean squared change of the logit when an identity term of a labelled text is swapped, so group mentions alone
    don't move a score; a sample without identity terms has no such term. What positives weigh of the log loss is chosen among
    ``positive_shares`` by ``folds`` of the sample (by text hash, half the rounds). Null labels are left out; without rows of
    both labels the model scores every text by the labels' mean (0.0 without labels).
    """
    importable(sample.sparkSession)
    rows = sample.where("label is not null").select(text_or_empty().alias("text"), (F.col("label") > 0).cast("int").alias("label"))
    rows = rows.withColumn("key", F.xxhash64("text", "label"))

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "label": b["label"], "found": [sorted(features(x)) for x in b["text"]]})

    per_doc = rows.mapInPandas(taken, "key long, label int, found array<string>").persist()
    try:
        n, positives = per_doc.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < positives < n:
            rate = positives / n if n else 0.0
            return ToxicityModel({}, float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
        counted = per_doc.select("label", F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
        inside, outside = F.col("pos") / positives, (F.col("n") - F.col("pos")) / (n - positives)
        share = F.col("n") / n
        z = F.abs(inside - outside) / F.sqrt(share * (1 - share) * (1 / positives + 1 / (n - positives)) + 1e-12)
        identity = F.col("f").isin(*SWAPS)
        chosen = counted.where(identity | (F.col("n") >= min_docs) & (z >= least_z)).orderBy(identity.desc(), z.desc(), "f").limit(max_features + len(SWAPS))
        vocabulary = sorted({r.f for r in chosen.select("f").collect()} | SWAPS.keys())
        index = {w: i for i, w in enumerate(vocabulary)}

        def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"key": b["key"], "label": b["label"], "at": [[index[w] for w in x if w in index] for x in b["found"]]})

        matrix = per_doc.mapInPandas(numbered, "key long, label int, at array<int>").toArrow()
    finally:
        per_doc.unpersist()
    matrix = matrix.take(np.argsort(matrix.column("key").to_numpy(), kind="stable"))  # no sum depends on how the rows lay
    lists = matrix.column("at").combine_chunks()
    whole = Rows(matrix.column("label").to_numpy().astype(np.float64), np.repeat(np.arange(matrix.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy())

    def train(part: Rows, share: float, steps: int = rounds // 2) -> tuple[np.ndarray, float]:
        return descend(part, len(vocabulary), vocabulary, share, steps, l2, swap_penalty)

    positive_share = chosen_share(whole, matrix.column("key").to_numpy() % folds, positive_shares, train)
    w, bias = train(whole, positive_share, rounds)
    return ToxicityModel({x: float(y) for x, y in zip(vocabulary, w) if y}, float(bias), positive_share)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned from; a null id is hashed as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents outside the held-out fifth, those with the smallest id hash.

    Each document's labels are averaged first (over half: 1), so repeated label rows count once; null ids and labels
    are left out. Of rows that share an id the first text counts, so repeats don't widen the bound.
    """
    own = labels.select(F.col("doc_id").alias("__doc"), "toxic").where("__doc is not null and toxic is not null").where(~held_out(F.col("__doc")))
    own = own.groupBy("__doc").agg((F.avg("toxic") > 0.5).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("__doc"), "__doc").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__doc"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5) for each row of ``docs``.

    The score depends on the text alone; a null text is the empty text. Repeated rows score alike; an empty table gives no
    rows; further columns are ignored.
    """
    model = fit(training_sample(docs, labels, max_rows))
    scored = docs.select("doc_id", model.column(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with the columns of ``docs``.

    A null text is scored as the empty one, very long texts are scored whole, equal texts fare alike and repeated rows stay as often as
    they are there. An empty table gives no rows; columns beyond doc_id and text stay whatever their names. Labels as in
    :func:`training_sample`; without any, all rows stay.
    """
    model = fit(training_sample(docs, labels, max_rows))
    (score,) = free_names(docs, "__toxicity")
    return docs.withColumn(score, model.column(F.col("text"))).where(F.col(score) < 0.5).drop(score)
