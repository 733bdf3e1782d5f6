"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams (3 to 6) of its lower-cased words with their edges marked; an n-gram is a row
of a hashed embedding table, a text the mean of its rows, and two softmax weights turn the mean into the probability of
the label. Embeddings and weights are trained together by mini-batches of gradient descent. A misspelling that training never saw
shares most of its n-grams with the word, so it gets nearly its vector.

Training takes at most `MAX_TOXIC` texts with the label and `MAX_OTHER` without, those of smallest id hash, and corrects
the bias by the label's share among all labels; n-gram counts, not texts, reach the driver. With the parameters fixed, the score's logit is linear in the bag, so scoring looks up
one number an n-gram; whole texts are scored, in pieces of bounded size.

Defined results: null and empty texts have an empty bag and get the score of the bias alone; labels other than 0 and 1
and null labels are not used; of several labels for an id the largest counts, of several texts that of smallest digest; without both classes among the labels
every score is the share of toxic labels (0 without labels); repeated rows get equal scores; extra columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest

#: Rows of the embedding table (a power of two), its width, and n-gram lengths.
BUCKETS, WIDTH, LENGTHS = 1 << 16, 8, (3, 4, 5, 6)
#: Labelled texts with and without the label used in training, at most.
MAX_TOXIC, MAX_OTHER = 1250, 5000
EPOCHS, BATCH, RATE, SCALE, SEED = 8, 32, 1.0, 100.0, 7
#: Characters that are cut into n-grams at once.
PIECE = 1 << 18
_EDGES = re.compile(r"[\W_]+")
_MUL = np.uint32(0x9E3779B1)


def _grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, piece by piece; pieces meet at word edges or overlap by an n-gram."""
    words = " " + _EDGES.sub(" ", text.lower()).strip() + " "
    at = 0
    while at < len(words) - 1:
        end = min(at + PIECE, len(words))
        codes = np.frombuffer(words[at : min(end + max(LENGTHS) - 1, len(words))].encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.concatenate([[0], np.cumsum(codes == 32)])
        n_start = end - at
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ codes[n - 1 :]) * _MUL
            h ^= h >> np.uint32(15)
            if n in LENGTHS:
                inner = edge[n - 1 : n - 1 + m] - edge[1 : 1 + m]  # edges strictly inside
                keep = inner[: min(m, n_start)] == 0
                g = h[: min(m, n_start)][keep]
                yield ((g * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
        at = end


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's n-grams; shares add up to 1."""
    parts = list(_grams(text)) if text else []
    if not sum(map(len, parts)):
        return np.empty(0, np.uint16), np.empty(0, np.float32)
    counts = np.zeros(BUCKETS)
    for p in parts:
        counts += np.bincount(p, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / counts.sum()).astype(np.float32)


class Model:
    """score = sigmoid(bias + sum of weight[bucket] x share): the softmax of the mean embedding, multiplied out.

    parts: the embeddings with their rarity, the softmax's weights and biases, as trained.
    """

    def __init__(self, weight: np.ndarray, bias: float, parts: tuple | None = None):
        self.weight, self.bias, self.parts = weight, bias, parts

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for g in _grams(text) if text else ():
            total += float(self.weight[g].sum())
            n += len(g)
        return float(1 / (1 + np.exp(-np.clip(self.bias + (total / n if n else 0.0), -60, 60))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Embeddings E (buckets x width) and softmax weights W (width x 2), b (2), jointly."""
    positive = float(labels.mean()) if len(labels) else 0.0
    if not 0 < positive < 1:
        edge = min(max(positive, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS), float(np.log(edge / (1 - edge))))
    rng = np.random.default_rng(SEED)
    # n-grams that most texts hold say little; a bag's mean is small next to one n-gram's share
    held = np.zeros(BUCKETS)
    for at, _ in bags:
        held[at] += 1
    rarity = (SCALE * np.log((len(bags) + 1) / (held + 1))).astype(np.float32)
    E = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    W = (rng.normal(0, 1, (WIDTH, 1)) / np.sqrt(WIDTH) * [-1, 1]).astype(np.float32)
    b = np.log([1 - positive, positive]).astype(np.float32)
    rows = np.flatnonzero([len(x[0]) > 0 for x in bags])
    steps, step = epochs * -(-len(rows) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            at = np.concatenate([bags[i][0] for i in batch])
            share = (np.concatenate([bags[i][1] for i in batch]) * rarity[at])[:, None]
            sizes = np.array([len(bags[i][0]) for i in batch])
            mean = np.add.reduceat(E[at] * share, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            p = mean @ W + b
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            back = (p @ W.T)[np.repeat(np.arange(len(batch)), sizes)] * share
            used, place = np.unique(at, return_inverse=True)
            W -= 0.1 * rate * (mean.T @ p).astype(np.float32)
            b -= 0.1 * rate * p.sum(0).astype(np.float32)
            E[used] -= rate * np.stack([np.bincount(place, back[:, j], len(used)) for j in range(WIDTH)], 1).astype(np.float32)
    difference = (W[:, 1] - W[:, 0]).astype(np.float64)
    return Model(E.astype(np.float64) @ difference * rarity, float(b[1] - b[0]), (E * rarity[:, None], W, b))


#: A bag as bytes: two-byte bucket numbers, four-byte shares.
_BAG = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())])


@F.pandas_udf(_BAG)
def _bags(texts: pd.Series) -> pd.DataFrame:
    found = [bag(t) for t in texts]
    return pd.DataFrame({"at": [a.astype("<u2").tobytes() for a, _ in found], "share": [s.astype("<f4").tobytes() for _, s in found]})


def held_out(c="doc_id"):
    """Rows that training never sees: crc32 of the id as text, remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """Train on the labelled rows that are not held out, at most max_toxic and max_other of the two classes."""
    named = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    usable = named.groupBy("id").agg(F.max("label").alias("label")).filter(~held_out("id"))
    n, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    picked = [usable.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(most) for v, most in ((0, max_other), (1, max_toxic))]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # bounded: max_toxic + max_other ids
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id").agg(F.max("label").alias("label"), F.min_by("text", digest("text")).alias("text"))  # one text an id
    found = rows.select("id", "label", _bags("text").alias("bag")).select("id", "label", "bag.at", "bag.share").toArrow()
    found = found.sort_by([("id", "ascending"), ("at", "ascending")])
    bags = [(np.frombuffer(a.as_py(), "<u2"), np.frombuffer(s.as_py(), "<f4")) for a, s in zip(found["at"], found["share"])]
    marks = found["label"].to_numpy().astype(np.int64)
    del found
    model = train(bags, marks)
    if 0 < marks.sum() < len(marks) and 0 < toxic < n:
        model.bias += float(np.log(toxic / (n - toxic)) - np.log(marks.sum() / (len(marks) - marks.sum())))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (probability of label 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(*shared.value)
        for texts in batches:
            yield pd.Series([held.score(t) for t in texts], dtype=float)

    out = docs.drop("score", "predicted").withColumn("score", scores(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
