"""Toxic documents and the sentences that make them so, learned from document labels alone.

Multiple-instance learning: a document is a bag of sentences, each sentence has a probability
``sigmoid(b + sum of its features' weights)``, and the document's probability is their noisy-or,
``1 - prod(1 - p)``. Sentences without any feature are one background together, the same in every document, so that a
score does not grow with plain length. Weights are fitted to document labels through the noisy-or; the fitted sentence
probabilities then point at the sentences. Features are words and beginnings of words, as insults are
inflected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.shared import prepare
from tallyworks.llm.words import text_bytes

# Letters, digits and bytes of other scripts stay, A-Z is lower-cased, marks that end a sentence become
# a line feed, everything else a space.
_PLAIN = bytes(
    i + 32 if 0x41 <= i <= 0x5A
    else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80
    else 0x0A if i in b".!?\n\r"
    else 0x20
    for i in range(256)
)

PREFIXES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class ToxicitySettings:
    threshold: float = 0.3
    sample_per_label: int = 4000  # labelled documents of each label that the model is fitted to, at most
    sample_bytes: int = 1 << 25  # of their texts, for each label, at most
    least_documents: int = 5  # a word needs to occur in so many of them
    least_gain: float = 15.0  # and its likelihood ratio statistic to be so high
    most_features: int = 3000  # of which the highest are kept
    steps: int = 400
    rate: float = 0.1
    penalty: float = 1e-3


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)  # by word, or by beginning of a word and "*"


def features(words) -> set[bytes]:
    """Distinct words, and the beginnings of PREFIXES bytes of longer ones."""
    words = set(words)
    found = set(words)
    for k in PREFIXES:
        found.update({w[:k] + b"*" for w in words if len(w) > k})
    return found


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of every sentence with a word, in bytes of the text."""
    found, at = [], 0
    for part in text.translate(_PLAIN).split(b"\n"):
        words = part.split()
        if words:
            found.append((at, at + len(part), words))
        at += len(part) + 1
    return found


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _likelihood_ratio(yes: np.ndarray, no: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood that a feature's documents and the other ones gain from having rates of their own."""

    def log_likelihood(hits: np.ndarray, size: np.ndarray) -> np.ndarray:
        size = np.maximum(size, 1e-12)
        rate = np.clip(hits / size, 1e-12, 1 - 1e-12)
        return hits * np.log(rate) + (size - hits) * np.log(1 - rate)

    size, every = yes + no, totals.sum()
    apart = log_likelihood(yes, size) + log_likelihood(totals[1] - yes, every - size)
    return 2 * (apart - log_likelihood(np.array(float(totals[1])), np.array(float(every))))


def fit(bags: list[tuple[int, bytes]], weight: dict[int, float], settings: ToxicitySettings) -> ToxicityModel:
    """Fit sentence weights to (label, text) pairs by full-batch Adam on the noisy-or likelihood."""
    labels = np.array([y for y, _ in bags])
    totals = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if not len(bags) or not totals.all():
        rate = float(np.clip(totals[1] / max(1, totals.sum()), 0.001, 0.999)) if len(bags) else 0.001
        return ToxicityModel(float(np.log(rate / (1 - rate))))
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for y, text in bags:
        seen[y].update(features(text.translate(_PLAIN).split()))
    common = [w for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= settings.least_documents]
    gain = _likelihood_ratio(
        np.array([seen[1][w] for w in common], float), np.array([seen[0][w] for w in common], float), totals
    )
    best = sorted(zip(-gain, common))[: settings.most_features]
    names = [word for g, word in best if -g >= settings.least_gain]
    del seen, common, best
    names.sort()
    index = {word: i for i, word in enumerate(names)}

    # Sentences without a chosen word are the background, which scores the bias once a document.
    bag_of, word_of, instance_of = [], [], []
    for bag, (_, text) in enumerate(bags):
        for _, _, words in sentences(text):
            hits = {index[w] for w in features(words) & index.keys()}
            if hits:
                word_of.extend(hits)
                instance_of.extend([len(bag_of)] * len(hits))
                bag_of.append(bag)
    bag_of, word_of, instance_of = (np.array(x, np.int64) for x in (bag_of, word_of, instance_of))
    scale = np.array([weight[y] for y in labels])
    scale /= scale.sum()
    theta = np.zeros(len(names) + 1)
    theta[-1] = -5.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        bias = theta[-1]
        z = bias + np.bincount(instance_of, theta[word_of], len(bag_of))
        total = _softplus(bias) + np.bincount(bag_of, _softplus(z), len(bags))
        pull = np.where(labels == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) * scale  # d loss / d total
        by_instance = pull[bag_of] / (1 + np.exp(-z))
        slope = settings.penalty * theta / max(1, len(names))
        slope[:-1] += np.bincount(word_of, by_instance[instance_of], len(names))
        slope[-1] += by_instance.sum() + pull.sum() / (1 + np.exp(-bias))
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
    return ToxicityModel(float(theta[-1]), {w: float(theta[i]) for w, i in index.items()})


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-z)))


def judge(text: bytes, model: ToxicityModel, threshold: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability, and (start, end, probability) in characters of sentences at the threshold.

    It is the noisy-or of the background and of the sentences more suspicious than it, each by what it exceeds the
    background; so sentences that are not don't add up, however many there are.
    """
    weights = model.weights
    plain = text.translate(_PLAIN)
    base = float(_softplus(np.float64(model.bias)))
    total, spans = base, []
    if weights.keys().isdisjoint(features(plain.split())):
        return float(-np.expm1(-total)), []
    for start, end, words in sentences(text):
        hits = weights.keys() & features(words)
        if not hits:
            continue
        z = model.bias + sum(weights[w] for w in sorted(hits))
        total += max(0.0, float(_softplus(np.float64(z))) - base)
        if _logistic(z) >= threshold:
            first = len(text[:start].decode("utf-8", "replace"))
            spans.append((first, first + len(text[start:end].decode("utf-8", "replace")), _logistic(z)))
    return float(-np.expm1(-total)), spans


def _score(model: ToxicityModel, threshold: float):
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch["text"]:
                score, found = judge(text_bytes(text.as_py()), model, threshold)
                scores.append(score)
                spans.append([{"start": a, "stop": b, "score": p} for a, b, p in found])
            kept = [batch[i] for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], [*names, "score", "spans"]
            )

    return run


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows whose crc32 of the id as text falls into the fold; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """A model from the labelled documents outside the held-out fold.

    The sample is the first ``sample_per_label`` ids of each label by hash: a bound on what is fitted, and
    a proof that the id list fits a broadcast. Of an id's texts the one with the least hash is taken, and ids as long
    as their texts have no more than ``sample_bytes``; only these texts come to the driver. Its labels are weighted
    back to their share of all labels.
    An id with several label rows counts as toxic if any says so; other label values and ids without a
    document are passed over. Without both labels the model is the share of toxic rows.
    """
    prepare(documents.sparkSession)
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    chosen = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_per_label)
        for y in (0, 1)
    ]
    sample = chosen[0].unionAll(chosen[1])
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = texts.select("doc_id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = sizes.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("size", "hash").alias("size"), F.min("hash").alias("hash"))
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # a row per sampled id
    taken_ids = sizes.withColumn("upto", so_far).where(F.col("upto") <= settings.sample_bytes).select("doc_id", "hash", "toxic")
    found = texts.join(F.broadcast(taken_ids), ["doc_id", "hash"]).groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))
    table = found.toArrow()
    rows = sorted(
        zip(table["doc_id"].to_pylist(), table["toxic"].to_pylist(), table["text"].to_pylist()),
        key=lambda row: (row[0], row[2] or b""),
    )
    bags = list({text_bytes(text): (y, text_bytes(text)) for _, y, text in rows}.values())  # copies count once
    taken = Counter(y for y, _ in bags)
    return fit(bags, {y: counts.get(y, 0) / max(1, taken[y]) for y in (0, 1)}, settings)


def score_documents(
    documents: DataFrame, model: ToxicityModel, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, score and spans (offending sentences, in characters) of every row.

    A null or empty text scores as one sentence without words. Rows are scored one by one, so repeated rows
    and ids score alike. Columns other than ``keep`` and text are not read.
    """
    prepare(documents.sparkSession)
    rows = documents.select(*keep, F.col("text").cast("binary").alias("text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(
        _score(model, threshold), f"{types}, score double, spans array<struct<start:int,stop:int,score:double>>"
    )


def toxic_documents(
    documents: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()
) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) per row of ``documents``."""
    model = learn(documents, labels, settings)
    scored = score_documents(documents, model, settings.threshold)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
        "spans",
    )


def without_toxic(
    documents: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()
) -> DataFrame:
    """The rows of ``documents`` below the threshold, with all their columns."""
    model = learn(documents, labels, settings)
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[names.index("text")].cast(pa.binary())
            keep = [judge(text_bytes(t.as_py()), model, 2.0)[0] < settings.threshold for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    names = documents.columns
    return documents.mapInArrow(run, documents.schema)
