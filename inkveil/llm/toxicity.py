"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (ASCII letters, digits and all bytes beyond ASCII; lower-cased) and their first
HEAD bytes, hashed to SPACE places; their value is log(1 + occurrences). Those seen in at least SEEN learning rows whose log-odds
of the toxic label are at least ODDS from zero take part.

P(grade > k) = sigmoid(weights . features - threshold[k]): one weight for each feature, shared by the ordered thresholds. The
expected severity is the sum of these probabilities over k, from 0 to GRADES.

The label tells only whether a text is toxic. For learning, a toxic text's grade is 1 up to GRADES by how many features of
strong association it has (one, up to three, up to six, more), so severity follows the amount of abuse.

It learns on at most LEARN_ROWS labelled ids that aren't held out, one row each; scoring reads every whole text.

Defined cases: of conflicting labels of an id the greatest counts; rows with a null id are scored but teach nothing; very long texts
are features like any other; null and empty texts have no features; without labels of both kinds every severity is 0; repeated rows score
alike; an empty table gives an empty table; columns named as an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_WORD, Words, fresh, pieces, written
from .labelled import learning_rows

SPACE, HEAD = 1 << 18, 4
LEARN_ROWS, SEEN, ODDS, STRONG = 12_000, 3, 1.5, 3.0
#: A text is flagged from this probability of a grade above 0.
FLAG = 0.25
GRADES, GRADE_FROM = 4, (1, 2, 4, 7)
STEPS, RATE, PENALTY = 250, 0.05, 2e-4

_INSIDE = np.array([_IS_WORD[i] and (i >= 128 or chr(i).isalnum()) for i in range(256)])

Model = dict[str, np.ndarray]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of every feature, in order of text and place."""
    words = Words(texts, lower=True, inside=_INSIDE)
    if not len(words.start):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    count = np.diff(words.first)
    owner = np.repeat(np.arange(len(count)), count)
    long = words.end - words.start > HEAD
    place = np.concatenate([words.hashes() % np.uint64(SPACE), words.hashes(HEAD)[long] % np.uint64(SPACE) ^ np.uint64(1)]).astype(np.int64)
    key, times = np.unique(np.concatenate([owner, owner[long]]) * SPACE + place, return_counts=True)
    return key // SPACE, key % SPACE, np.log1p(times)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def exceed(model: Model, text: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """P(grade > k) of n texts for each k."""
    score = np.bincount(text, model["weights"][place] * value, n)
    return _sigmoid(score[:, None] - model["thresholds"])


def loss(weights: np.ndarray, thresholds: np.ndarray, text: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood of the grades with the penalty, and its gradients by weights and thresholds."""
    n = len(grade)
    score = np.bincount(text, weights[place] * value, n)
    p = _sigmoid(score[:, None] - thresholds)
    upper = np.concatenate([np.ones((n, 1)), p], axis=1)[np.arange(n), grade]
    lower = np.concatenate([p, np.zeros((n, 1))], axis=1)[np.arange(n), grade]
    mass = np.maximum(upper - lower, 1e-9)
    d_score = -(1 - upper - lower) / n
    d_weights = np.bincount(place, d_score[text] * value, len(weights)) + PENALTY * weights
    d_thresholds = np.zeros(GRADES)
    np.add.at(d_thresholds, grade[grade > 0] - 1, (upper * (1 - upper) / mass)[grade > 0] / n)
    np.add.at(d_thresholds, grade[grade < GRADES], -(lower * (1 - lower) / mass)[grade < GRADES] / n)
    return float(-np.log(mass).mean() + PENALTY / 2 * (weights**2).sum()), d_weights, d_thresholds


def fit(text: np.ndarray, place: np.ndarray, value: np.ndarray, toxic: np.ndarray) -> Model | None:
    n, positive = len(toxic), int(toxic.sum())
    if positive in (0, n):
        return None
    seen = np.bincount(place, minlength=SPACE)
    with_ = np.bincount(place, toxic[text], SPACE)
    odds = np.log((with_ + 0.1) / (positive + 0.2)) - np.log((seen - with_ + 0.1) / (n - positive + 0.2))
    used = (seen >= SEEN) & (np.abs(odds) >= ODDS)
    strong = used & (odds >= STRONG)
    amount = np.bincount(text, strong[place], n)
    grade = np.where(toxic > 0, np.maximum(np.searchsorted(GRADE_FROM, amount, "right"), 1), 0)
    keep = used[place]
    text, value = text[keep], value[keep]
    listed, place = np.unique(place[keep], return_inverse=True)
    weights, thresholds = np.zeros(len(listed)), np.linspace(2, 2 + GRADES, GRADES)
    state = [np.zeros_like(x) for x in (weights, weights, thresholds, thresholds)]
    for step in range(1, STEPS + 1):
        _, d_weights, d_thresholds = loss(weights, thresholds, text, place, value, grade)
        for i, (x, g) in enumerate(((weights, d_weights), (thresholds, d_thresholds))):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * g * g
            x -= RATE * state[2 * i] / (1 - 0.9**step) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
        thresholds.sort()
    full = np.zeros(SPACE)
    full[listed] = weights
    return {"weights": full, "thresholds": thresholds}


def _packed(texts: pa.Array, kept: np.ndarray | None = None) -> list[bytes]:
    """The places and values of each text's features, or of those that are kept, as bytes."""
    text, place, value = features(texts)
    if kept is not None:
        some = kept[place]
        text, place, value = text[some], place[some], value[some]
    both = np.stack([place.astype(np.float64), value], axis=1)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [both[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def selected(rows: DataFrame) -> DataFrame:
    """(place) of the features that take part, by how many learning rows of each label have them: counted and chosen by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, place, _ = features(batch.column("text"))
            toxic = batch.column("label").to_numpy(zero_copy_only=False)[text] > 0
            listed, where = np.unique(place, return_inverse=True)
            made = [listed, np.bincount(where, minlength=len(listed)), np.bincount(where[toxic], minlength=len(listed))]
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in made], ["place", "seen", "toxic"])

    n, positive = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    each = rows.mapInArrow(counted, "place bigint, seen bigint, toxic bigint").groupBy("place").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.1) / (positive + 0.2)) - F.log((F.col("seen") - F.col("toxic") + 0.1) / (n - positive + 0.2))
    return each.filter((F.col("seen") >= SEEN) & (F.abs(odds) >= ODDS)).select("place")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Only the features that take part come to the driver: at most SPACE places, and of at most LEARN_ROWS rows what they have of these."""
    rows = written(learning_rows(docs, labels, label, LEARN_ROWS, id_col, text_col), "toxicity-rows")
    kept = np.zeros(SPACE, bool)
    kept[selected(rows).toPandas()["place"].to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(_packed(batch.column("text"), shared.value), pa.binary())], ["id", "label", "features"])

    found = rows.mapInArrow(sparse, "id string, label int, features binary").toPandas().sort_values(["id", "label"], kind="stable")
    if not len(found):
        return None
    parts = [np.frombuffer(x).reshape(-1, 2) for x in found["features"]]
    every = np.concatenate(parts)
    text = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return fit(text, every[:, 0].astype(np.int64), every[:, 1], found["label"].to_numpy(float))


def score_toxicity(df: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with severity (expected grade), grade (most likely) and toxic (P(grade > 0) >= FLAG). Without keep_text, the text column is left out."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = ["severity", "grade", "toxic"]
    passed = [c for c in df.columns if c not in added and (keep_text or c != text_col)]
    text = fresh(passed, "whole_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                n = piece.num_rows
                over = exceed(shared.value, *features(piece.column(text)), n) if shared.value else np.zeros((n, GRADES))
                chance = -np.diff(np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1), axis=1)
                made = [pa.array(over.sum(axis=1)), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= FLAG)]
                yield pa.record_batch([piece.column(c) for c in passed] + made, [*passed, *added])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(passed).schema)
    return df.select(*passed, F.col(text_col).alias(text)).mapInArrow(run, f"{fields}severity double, grade int, toxic boolean")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep_text=False)
