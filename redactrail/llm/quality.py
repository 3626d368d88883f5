"""A quality classifier on supervised subword embeddings, in numpy.

`fit` learns it from labelled documents, `scored` gives every document its score, `accepted` keeps those over a threshold.

Method. A text's features are its words, its pairs of neighbouring words and its runs of 3 and 4 characters within a word
and its borders, each hashed to one of BUCKETS vectors; a word that follows itself is one feature whatever the word. The
mean of the vectors goes through a softmax over the two labels; vectors and weights are learned by stochastic gradient
descent, EPOCHS times through the sample. For scoring, vectors are multiplied with the weights beforehand, which leaves a
number for each bucket: executors get a table of fixed size. Features are made from arrays of code points, no loop sees a
word.

Learning takes a bounded sample, the feature counts of SAMPLE whole labelled documents of each label, those of least hash;
it is done in one task, so that the driver gets only the table. Both labels are drawn equally often; the log-odds of the
labels' shares, counted over all labels not held out, are added to the bias. Documents whose crc32(id as text) mod FOLDS is
0 are never learned from.
Scores are of whole texts and of all documents, in pieces of common.PIECE characters, cut between words.

Cases. Null text: as the empty text. Texts without features, the empty text included: the score of the learned bias alone.
Null ids: not held out. Repeated rows: scored each. Labels that are null are ignored, of repeated ones of a document the
largest counts, labels without document are ignored. With one label or none to learn from: a constant score, that label's
share, or 0.5. Empty table: empty result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactrail.llm.common import MULTIPLIER, code_points, hashes_of_words, pick, pieces, quoted

BUCKETS, DIM, FOLDS = 1 << 17, 16, 5
SAMPLE, EPOCHS, RATE = 1500, 10, 0.6


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x1000193)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(64 - 17)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """The buckets of all features of a text, repeated as often as they occur."""
    code, space = code_points(text)
    found = []
    inner = ~space
    two = code[:-1] * MULTIPLIER + code[1:]
    three = two[:-1] * MULTIPLIER + code[2:]
    whole = inner[1:-1]
    found.append(_bucket(three[whole], 3))
    if len(code) > 3:
        four = three[:-1] * MULTIPLIER + code[3:]
        found.append(_bucket(four[whole[:-1] & whole[1:]], 4))
    words = hashes_of_words(code, space)
    if len(words):
        found.append(_bucket(words, 1))
        pairs = words[:-1] * np.uint64(31) + words[1:]
        pairs[words[:-1] == words[1:]] = 0
        found.append(_bucket(pairs, 2))
    return np.concatenate(found)


@dataclass(frozen=True)
class Model:
    """What a feature of each bucket adds to the log-odds of label 1, on average over a text's features, and the bias."""

    table: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for piece in pieces(text or ""):
            own = features(piece)
            total += float(self.table[own].sum(dtype=np.float64))
            n += len(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / max(n, 1), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, seed: int = 1) -> Model:
    """Learns from (distinct buckets, how often, label 0 or 1); share: that of label 1 where the rows are from.

    Both labels are drawn equally often, rows of the rarer one again and again.
    """
    random = np.random.default_rng(seed)
    at = np.clip(share, 0.01, 0.99)
    prior = float(np.log(at / (1 - at)))
    if len({y for *_, y in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior if rows else 0.0)
    vectors = random.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    by_label = [np.array([i for i, (*_, y) in enumerate(rows) if y == label]) for label in (0, 1)]
    most = max(map(len, by_label))
    steps, step = EPOCHS * 2 * most, 0
    for _ in range(EPOCHS):
        for i in random.permutation(np.concatenate([np.resize(random.permutation(own), most) for own in by_label])):
            buckets, counts, label = rows[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(buckets):
                continue
            weight = (counts / counts.sum()).astype(np.float32)
            own = vectors[buckets]
            mean = weight @ own
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.1) * p
            # the mean spreads the step thinly: each vector gets it by its share of the most frequent one's
            vectors[buckets] = own - rate * np.outer(weight / weight.max(), back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0] + prior))


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def usable(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, label): the labels that may be learned from."""
    own = pick(labels, doc_id="doc_id", label=F.col(quoted(label_col)).cast("int")).where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled(docs: DataFrame, own: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """(doc_id, label, packed): the features of the bounded sample to learn from."""
    by_hash = [own.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    wanted = by_hash[0].union(by_hash[1])
    texts = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(wanted), "doc_id")  # 2 * per_label rows at most

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bytes:
            found, counts = np.unique(np.concatenate([features(x) for x in pieces(text or "")]), return_counts=True)
            return np.stack([found, counts]).astype("<i4").tobytes()

        return texts.map(one)

    got = texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    return got.select("doc_id", "label", packed("text").alias("packed"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: int = SAMPLE) -> Model:
    """A model of labels (doc_id and label_col, 0 or 1) from the texts of docs (doc_id, text)."""
    own = usable(labels, label_col)
    share = own.agg(F.avg("label")).first()[0]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for doc_id, label, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = np.frombuffer(packed, "<i4").reshape(2, -1)
                held.append((doc_id, label, both[0], both[1].astype(np.float32)))
        held.sort(key=lambda x: (x[0], x[1]))
        model = train([(buckets, counts, label) for _, label, buckets, counts in held], 0.5 if share is None else share)
        yield pa.record_batch([pa.array([model.table.tobytes()]), pa.array([model.bias])], names=["table", "bias"])

    learned = sampled(docs, own, per_label).repartition(1).mapInArrow(learn, "table binary, bias double").first()
    return Model(np.frombuffer(bytes(learned["table"]), np.float32), learned["bias"]) if learned else train([], 0.5)


def score_column(model: Model, text_col: str = "text") -> Column:
    """The score of a column of texts; executors get the model's table, of fixed size."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return score(F.coalesce(F.col(quoted(text_col)), F.lit("")))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    own = pick(docs, doc_id="doc_id", text="text")
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns and no others."""
    return docs.where(score_column(model) >= threshold)
