"""Document quality by a byte-level convolutional network, in numpy.

A text's bytes are cut into chunks of CHUNK bytes, each overlapping the next by OVERLAP, to its very end. In each chunk
learned filters over WIDTH embedded bytes are taken at every STRIDE-th place, rectified and max-pooled. The pooled filters are
combined over the chunks by their mean and their maximum, and a small hidden layer makes one probability of them.

It learns on at most LEARN_ROWS labelled ids that aren't held out, one row each, and like scoring on every chunk of their whole
texts. The sample is a table in the shared folder and is dealt to learners, one task each. In each round a learner descends along the
gradients of its rows, BATCH texts at a time as they stream by; then the learners' networks are averaged, by their numbers of rows.
So the driver has networks only, and no task more than a few texts at once. Chunks go through the network SLICE at a time, so a very
long text needs memory for its pooled filters only. Learners are as many as the sample needs, whatever the cluster has, and their rows come in an
order by hash: reruns agree.

Defined cases: of conflicting labels of an id the greatest counts; null and empty texts are one chunk of padding; without labels of both kinds every score is the share of label 1
(0.5 without any); null ids are never held out; repeated rows score alike; an empty table gives an empty table; columns named as
an added one are replaced.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, pieces, written
from .labelled import held_out, learning_rows

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 3, 6, 24, 16
LEARN_ROWS, ROUNDS, BATCH, RATE = 3000, 8, 8, 0.004
#: Most learners, and how many rows each has at least.
LEARNERS, LEARNER_ROWS = 8, 64
#: Chunks that go through the filters at a time; what they need is held from the way forth to the way back for up to HELD chunks.
SLICE, HELD = 256, 1024
#: Steps of a learner in all rounds, at least: fewer rows are gone through more often.
LEAST_STEPS = 300
KEEP = 0.7
_PLACES = (CHUNK - WIDTH) // STRIDE + 1

Model = dict[str, np.ndarray]


def chunks(text: bytes) -> np.ndarray:
    """All chunks of a text, padded with zeros at the end."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _columns(model: Model, x: np.ndarray) -> np.ndarray:
    places = [model["embed"][x[:, j : j + (_PLACES - 1) * STRIDE + 1 : STRIDE]] for j in range(WIDTH)]
    return np.concatenate(places, axis=2).reshape(-1, WIDTH * EMBED)


def _pooled(model: Model, x: np.ndarray) -> np.ndarray:
    """The max-pooled filters of each chunk."""
    out = np.empty((len(x), FILTERS), np.float32)
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        held = (_columns(model, part) @ model["filter"]).reshape(len(part), _PLACES, FILTERS).max(axis=1)
        out[at : at + SLICE] = np.maximum(held + model["bias"], 0)
    return out


def _combined(pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.add.reduceat(pooled, starts) / counts[:, None], np.maximum.reduceat(pooled, starts)], axis=1)


def _probability(model: Model, features: np.ndarray) -> np.ndarray:
    hidden = np.tanh(features @ model["hidden"] + model["hidden_bias"])
    return 1 / (1 + np.exp(-(hidden @ model["out"] + model["out_bias"])))


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), float(model["constant"]))
    parts = [chunks(t) for t in texts]
    counts = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.clip(_probability(model, _combined(_pooled(model, np.concatenate(parts)), starts, counts)).astype(float), 0, 1)


def initial(seed: int = 11) -> Model:
    dice = np.random.default_rng(seed)
    draw = lambda *shape: (dice.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"embed": dice.standard_normal((256, EMBED)).astype(np.float32) * 0.5, "filter": draw(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "hidden": draw(2 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN), "out_bias": np.zeros(1, np.float32)}


class Descent:
    """A network on its way: the running means of its gradients and of their squares, and the steps behind it."""

    def __init__(self, model: Model):
        self.model, self.steps = dict(model), 0
        self.mean = {k: np.zeros_like(v) for k, v in model.items()}
        self.square = {k: np.zeros_like(v) for k, v in model.items()}

    def step(self, bags: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        """bags: the chunks of each text."""
        self.steps += 1
        for k, g in _gradients(self.model, bags, labels).items():
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
            self.square[k] = 0.99 * self.square[k] + 0.01 * g * g
            by = rate * self.mean[k] / (1 - 0.9**self.steps) / (np.sqrt(self.square[k] / (1 - 0.99**self.steps)) + 1e-6)
            self.model[k] = self.model[k] - by.astype(np.float32)


def averaged(made: list[tuple[int, Descent]]) -> Descent:
    """Of (rows, descent) one descent, each weighted by its rows."""
    total = sum(n for n, _ in made)
    out = Descent(made[0][1].model)
    out.steps = max(d.steps for _, d in made)
    for part in ("model", "mean", "square"):
        parts = [(n, getattr(d, part)) for n, d in made]
        setattr(out, part, {k: (sum(n * p[k].astype(np.float64) for n, p in parts) / total).astype(np.float32) for k in out.model})
    return out


def _gradients(model: Model, bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Of the mean log loss of some texts."""
    x = np.concatenate(bags)
    counts = np.array([len(b) for b in bags])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    slices = [slice(a, a + SLICE) for a in range(0, len(x), SLICE)]
    known: dict[int, np.ndarray] = {}
    pooled, where = np.empty((len(x), FILTERS), model["filter"].dtype), np.empty((len(x), FILTERS), np.int64)  # chunk, filter -> place
    for i, s in enumerate(slices):
        columns = _columns(model, x[s])
        held = (columns @ model["filter"]).reshape(-1, _PLACES, FILTERS)
        where[s] = held.argmax(axis=1)
        pooled[s] = np.maximum(np.take_along_axis(held, where[s][:, None, :], 1)[:, 0] + model["bias"], 0)
        if len(x) <= HELD:
            known[i] = columns
    features = _combined(pooled, starts, counts)
    hidden = np.tanh(features @ model["hidden"] + model["hidden_bias"])
    p = 1 / (1 + np.exp(-(hidden @ model["out"] + model["out_bias"])))
    d_out = ((p - y) / len(y)).astype(np.float32)
    d_hidden = np.outer(d_out, model["out"]) * (1 - hidden**2)
    d_features = d_hidden @ model["hidden"].T
    owner = np.repeat(np.arange(len(bags)), counts)
    d_pooled = d_features[owner, :FILTERS] / counts[owner, None] + d_features[owner, FILTERS:] * (pooled == features[owner, FILTERS:])
    d_pooled = np.where(pooled > 0, d_pooled, 0)
    d_filter, d_embed = np.zeros_like(model["filter"]), np.zeros_like(model["embed"])
    for i, s in enumerate(slices):
        columns = known[i] if i in known else _columns(model, x[s])
        chunk, filt = np.nonzero(d_pooled[s])
        place, g = where[s][chunk, filt], d_pooled[s][chunk, filt]
        row = chunk * _PLACES + place
        for f in range(FILTERS):
            own = filt == f
            d_filter[:, f] += columns[row[own]].T @ g[own]
        d_columns = (model["filter"][:, filt].T * g[:, None]).reshape(-1, WIDTH, EMBED)
        for j in range(WIDTH):
            np.add.at(d_embed, x[s][chunk, place * STRIDE + j], d_columns[:, j])
    return {"embed": d_embed, "filter": d_filter, "bias": d_pooled.sum(axis=0), "hidden": features.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0), "out": hidden.T @ d_out, "out_bias": d_out.sum(keepdims=True)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    rows = learning_rows(docs, labels, label, LEARN_ROWS, id_col, text_col)
    sample = written(rows.select(F.col("id").cast("string").alias("id"), "label", "text"), "quality-sample")
    n, least, most, mean = sample.agg(F.count("id"), F.min("label"), F.max("label"), F.avg("label")).first()
    if not n or least == most:
        return {"constant": np.array(mean if n else 0.5)}
    learners = min(LEARNERS, max(1, n // LEARNER_ROWS))
    passes = -(-LEAST_STEPS * learners * BATCH // (ROUNDS * n))
    dealt = sample.withColumn("learner", F.pmod(F.xxhash64("id"), F.lit(learners)).cast("int")).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    state = Descent(initial())
    for at in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)
        ordered = dealt.withColumn("order", F.xxhash64("id", "pass", F.lit(at))).repartitionById(learners, "learner").sortWithinPartitions("pass", "order", "id")
        made = ordered.mapInArrow(_learner(shared, RATE * (1 - 0.9 * at / ROUNDS)), "learner int, rows bigint, state binary").collect()
        state = averaged([(r["rows"], pickle.loads(r["state"])) for r in sorted(made, key=lambda r: r["learner"])])
        shared.unpersist()
    return state.model


def _learner(shared, rate: float):
    """A round of one learner: its network after all its rows, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, learner = copy.copy(shared.value), 0, None
        texts, marks = [], []
        state.mean, state.square, state.model = dict(state.mean), dict(state.square), dict(state.model)

        def step():
            state.step([chunks(t.encode()) for t in texts], np.array(marks, float), rate)

        for batch in batches:
            for i in range(batch.num_rows):
                learner = batch.column("learner")[i].as_py()
                texts.append(batch.column("text")[i].as_py())
                marks.append(batch.column("label")[i].as_py())
                rows += 1
                if len(texts) == BATCH:
                    step()
                    texts, marks = [], []
        if texts:
            step()
        if rows:
            yield pa.record_batch([pa.array([learner], pa.int32()), pa.array([rows]), pa.array([pickle.dumps(state)], pa.binary())], ["learner", "rows", "state"])

    return run


def score_quality(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with score, the probability of label 1. Without keep_text, the text column is left out."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    passed = [c for c in df.columns if c != "score" and (keep_text or c != text_col)]
    text = fresh(passed, "whole_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                scores = score(shared.value, [(t or "").encode() for t in piece.column(text).to_pylist()])
                yield pa.record_batch([piece.column(c) for c in passed] + [pa.array(scores, pa.float64())], [*passed, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(passed).schema)
    return df.select(*passed, F.col(text_col).alias(text)).mapInArrow(run, f"{fields}, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model, keep_text=False)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
