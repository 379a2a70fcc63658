"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

The model predicts the class of the next token from the classes of the two before it: the vectors of the
context words, each through a matrix of its place, add up to a prediction, whose product with a class's
output vector plus its bias is the class's score. Frequent words are classes of their own, as many as the
distinct words ask for; the others share a class per kind of ending and then get their add-one share of it.
Training tells tokens from noise drawn from the class frequencies, with a batch's noise shared so that all is
matrix products. Scores are normalised over all classes, once per distinct context.

All training texts are read, in pieces of classes. A piece's hash says in which round and shard it is learned
from, and the number of shards follows from the tokens: so the files' splits and the machines have no say in
the model. The shards of a round start from the last round's average, weighted by tokens; nothing but
parameters leaves a task, some 50 numbers per class.

Word counts are exact over all training texts. Counts of at most ``table_words`` words, the most frequent
ones, are broadcast; the other words of a text meet their counts in a shuffled join.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.shared import discard, prepare, stored
from tallyworks.llm.toxicity import held_out
from tallyworks.llm.words import text_bytes, word_hashes_and_tails

ENDINGS = 64  # classes of words without a class of their own


@dataclass(frozen=True)
class ModelSettings:
    folds: int = 7
    fold: int = 2  # held out
    words: int | None = None  # words with a class of their own; by default as many as own_words says
    table_words: int = 1 << 18  # words whose counts are broadcast, at most: 16 bytes each
    size: int = 24  # of the vectors
    noise: int = 64  # samples per batch
    batch: int = 1024
    rate: float = 0.1
    rounds: int = 4  # parts of the texts, each learned from the average after the part before
    passes: int = 1  # over all parts
    shard_tokens: int = 1_000_000  # of a task in a round
    seed: int = 3

    def own_words(self, distinct: int) -> int:
        """Words with a class of their own: these grow by half for three times the distinct words."""
        return math.ceil(4 * distinct ** (1 / 3)) if self.words is None else self.words


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need to know of the counts: a table of bounded size, and numbers per class."""

    keys: np.ndarray  # sorted, of the words in the table
    counts: np.ndarray
    classes: np.ndarray  # of the same words
    words: int  # with a class of their own
    tokens: int  # all training tokens, ends among them
    distinct: int
    texts: int  # training texts, so the end's count
    ending_mass: np.ndarray  # tokens + words + 1 of the words that share a class
    class_counts: np.ndarray

    @property
    def end(self) -> int:
        """The class of the end of a text, which is the last one."""
        return self.words + ENDINGS


def word_keys(data: bytes) -> np.ndarray:
    """Hashes of a text's words, with the kind of the word's ending in the lowest bits."""
    hashes, tails = word_hashes_and_tails(data, tails=True)
    kind = (tails * np.uint32(2654435761)) >> np.uint32(26)
    return (hashes & np.uint64(2**64 - ENDINGS)) | kind.astype(np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the words of training texts, summed up over a few million words at a time."""

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        words = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(words)))
        return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(n)], ["key", "n"])

    parts, held = [], 0
    for batch in batches:
        for text in batch["text"]:
            parts.append(word_keys(text_bytes(text.as_py())))
            held += len(parts[-1])
            if held > 4_000_000:
                yield rows(parts)
                parts, held = [], 0
    if parts:
        yield rows(parts)


def learn_vocabulary(texts: DataFrame, settings: ModelSettings) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and (key, c) of the words outside its table. ``texts`` are the training texts."""
    counts = stored(
        texts.select("text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")), "counts"
    )
    n_texts = texts.count()
    # Counts on a log scale: so the table's bound is met without sorting the words.
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = settings.table_words, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        if row["n"] > room:
            break
        room, least = room - row["n"], row["step"]
    often = step >= F.lit(1 << 30 if least is None else least)
    table = counts.where(often).toArrow()
    keys, c = table["key"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    kinds = counts.groupBy(F.col("key").bitwiseAND(ENDINGS - 1).alias("kind")).agg(
        F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")
    ).collect()
    mass = np.zeros(ENDINGS)
    distinct = 0
    tokens = n_texts
    for row in kinds:
        mass[row["kind"]] = row["tokens"] + row["words"]
        tokens += row["tokens"]
        distinct += row["words"]
    words = settings.own_words(distinct)
    own = np.lexsort((keys, -c))[:words]
    classes = words + (keys & np.uint64(ENDINGS - 1)).astype(np.int64)
    classes[own] = np.arange(len(own))
    np.subtract.at(mass, (keys[own] & np.uint64(ENDINGS - 1)).astype(np.int64), c[own] + 1)
    class_counts = np.zeros(words + ENDINGS + 1)
    class_counts[: len(own)] = c[own]
    class_counts[words : words + ENDINGS] = mass
    class_counts[words + ENDINGS] = n_texts
    found = Vocabulary(
        keys, c, classes, words, tokens, distinct + (n_texts > 0), n_texts, mass + 1, class_counts
    )
    return found, counts.where(~often)


def class_of(keys: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(class, count) per word; the count is -1 for words outside the table."""
    classes = vocabulary.words + (keys & np.uint64(ENDINGS - 1)).astype(np.int64)
    counts = np.full(len(keys), -1, np.int64)
    if len(vocabulary.keys):
        at = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
        known = vocabulary.keys[at] == keys
        classes[known] = vocabulary.classes[at[known]]
        counts[known] = vocabulary.counts[at[known]]
    return classes, counts


def start(vocabulary: Vocabulary, settings: ModelSettings) -> dict[str, np.ndarray]:
    """Where all tasks begin: small random vectors, and class frequencies as biases."""
    rng = np.random.Generator(np.random.PCG64(settings.seed))
    n, d = len(vocabulary.class_counts), settings.size
    share = (vocabulary.class_counts + 1) / (vocabulary.class_counts + 1).sum()
    return {
        "inputs": rng.normal(0, 0.3, (n, d)).astype(np.float32),
        "outputs": rng.normal(0, 0.05, (n, d)).astype(np.float32),
        "near": np.eye(d, dtype=np.float32),
        "far": np.eye(d, dtype=np.float32) * np.float32(0.5),
        "bias": np.log(share).astype(np.float32),
    }


@dataclass
class State:
    """Parameters, the sums of squared slopes behind their rates, and the log of the noise distribution."""

    values: dict[str, np.ndarray]
    squares: dict[str, np.ndarray]
    log_noise: np.ndarray

    @classmethod
    def first(cls, vocabulary: Vocabulary, settings: ModelSettings) -> State:
        values = start(vocabulary, settings)
        return cls(values, {k: np.full_like(v, 1e-4) for k, v in values.items()}, values["bias"].copy())


class Trainer:
    """Noise-contrastive steps with per-parameter rates, on a copy of a state."""

    def __init__(self, state: State, settings: ModelSettings, seed: tuple[int, ...]):
        self.settings = settings
        self.values = {k: v.copy() for k, v in state.values.items()}
        self.squares = {k: v.copy() for k, v in state.squares.items()}
        self.log_noise = state.log_noise
        share = np.exp(self.log_noise.astype(np.float64))
        self.edges = np.cumsum(share / share.sum())
        self.rng = np.random.Generator(np.random.PCG64([settings.seed, *seed]))
        self.tokens = 0

    def step(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> None:
        v, k, n = self.values, self.settings.noise, len(target)
        self.tokens += n
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(k)), len(self.edges) - 1)
        x, y = v["inputs"][near], v["inputs"][far]
        guess = x @ v["near"] + y @ v["far"]
        own = v["outputs"][target]
        others = v["outputs"][noise]
        # A token against k noise samples: the odds are p / (k * q).
        margin = np.float32(np.log(k))
        hit = _sigmoid((guess * own).sum(1) + v["bias"][target] - self.log_noise[target] - margin) - 1
        miss = _sigmoid(guess @ others.T + v["bias"][noise] - self.log_noise[noise] - margin)
        back = hit[:, None] * own + miss @ others
        slopes = {
            "outputs": _summed([target, noise], [hit[:, None] * guess, miss.T @ guess], v["outputs"]),
            "bias": _summed([target, noise], [hit[:, None], miss.sum(0)[:, None]], v["bias"]),
            "inputs": _summed([near, far], [back @ v["near"].T, back @ v["far"].T], v["inputs"]),
            "near": x.T @ back,
            "far": y.T @ back,
        }
        for key, value in v.items():
            g = slopes[key] / np.float32(n)
            self.squares[key] += g * g
            value -= np.float32(self.settings.rate) * g / np.sqrt(self.squares[key])


def _summed(indexes: list[np.ndarray], parts: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    """Rows added up by their index, in the shape of ``like``."""
    rows = np.concatenate(parts)
    width = rows.shape[1]
    cells = np.concatenate(indexes)[:, None] * width + np.arange(width)
    return np.bincount(cells.ravel(), rows.ravel(), like.size).reshape(like.shape).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _contexts(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two before, one before, token) of every token of some texts of classes, each closed by an end.

    Before the first token of a text stand two ends.
    """
    pad = np.full(1, end, np.int64)
    joined = np.concatenate([pad, pad, *(x for text in texts for x in (text, pad, pad, pad))])
    own = np.concatenate([*(x for text in texts for x in (np.ones(len(text) + 1, bool), np.zeros(2, bool)))])
    return joined[:-2][own], joined[1:-1][own], joined[2:][own]


_PIECE = 1 << 14  # tokens
_PIECES = "round int, key long, classes binary"


def _pieces(settings: ModelSettings, vocabulary):
    """The classes of texts in pieces, each led by the two classes before it, with the round and key it is learned by.

    The key is a hash of the row's id, text and the piece's place. Rows that are equal in both get different
    keys within a batch, so that copies are spread too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        pad = np.full(2, vocab.end, np.int32)
        for batch in batches:
            rounds, keys, pieces, seen, held = [], [], [], Counter(), 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                data = text_bytes(text.as_py())
                name = hashlib.blake2b(data, digest_size=16, key=str(doc_id).encode()).digest()
                classes = np.concatenate([pad, class_of(word_keys(data), vocab)[0].astype(np.int32), pad[:1]])
                for i in range(0, len(classes) - 2, _PIECE):
                    place = hashlib.blake2b(b"%s %d %d" % (name, i, seen[name]), digest_size=8).digest()
                    key = int.from_bytes(place, "little", signed=True)
                    keys.append(key)
                    rounds.append((key >> 32) % settings.rounds)
                    pieces.append(classes[i : i + _PIECE + 2].tobytes())
                    held += len(pieces[-1])
                    if held > 1 << 24:
                        yield _piece_rows(rounds, keys, pieces)
                        rounds, keys, pieces, held = [], [], [], 0
                seen[name] += 1
            yield _piece_rows(rounds, keys, pieces)

    return run


def _piece_rows(rounds: list[int], keys: list[int], pieces: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(rounds, pa.int32()), pa.array(keys, pa.int64()), pa.array(pieces, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["round", "key", "classes"])


def _train(settings: ModelSettings, state, turn: int):
    """One pass over a shard's pieces; (name, vals, tokens) of its parameters and their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(state.value, settings, (turn, TaskContext.get().partitionId()))
        held, size = [], 0

        def learn() -> None:
            far, near, target = (np.concatenate([p[i : len(p) - 2 + i] for p in held]) for i in range(3))
            order = trainer.rng.permutation(len(target))
            for i in range(0, len(order), settings.batch):
                part = order[i : i + settings.batch]
                trainer.step(far[part], near[part], target[part])

        for batch in batches:
            for piece in batch["classes"]:
                held.append(np.frombuffer(piece.as_py(), np.int32))
                size += len(held[-1]) - 2
                if size > 250_000:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        if trainer.tokens:
            found = {f"{kind} {k}": v for kind in _KINDS for k, v in getattr(trainer, kind).items()}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found)),
                    pa.array([v.reshape(-1).astype(float) for v in found.values()], pa.list_(pa.float64())),
                    pa.array([trainer.tokens] * len(found), pa.int64()),
                ],
                ["name", "vals", "tokens"],
            )

    return run


_KINDS = ("values", "squares")


def train(texts: DataFrame, vocabulary: Vocabulary, settings: ModelSettings) -> dict[str, np.ndarray]:
    """Parameters after all rounds, from (doc_id, text); the start if there is nothing to learn from.

    Pieces are written once. A round's task takes the pieces of a shard in the order of their keys, so a task
    that is run again finds the same parameters.
    """
    spark = texts.sparkSession
    context = spark.sparkContext
    state = State.first(vocabulary, settings)
    if not vocabulary.tokens:
        return state.values
    shared = context.broadcast(vocabulary)
    pieces = stored(texts.select("doc_id", "text").mapInArrow(_pieces(settings, shared), _PIECES), "pieces", "round")
    shared.unpersist()
    shards = math.ceil(vocabulary.tokens / settings.rounds / settings.shard_tokens)
    mean = F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens")
    for turn in range(settings.rounds * settings.passes):
        last = context.broadcast(state)
        own = pieces.where(F.col("round") == turn % settings.rounds).select("key", "classes")
        dealt = own.repartition(shards, "key").sortWithinPartitions("key", "classes").select("classes")
        local = dealt.mapInArrow(_train(settings, last, turn), "name string, vals array<double>, tokens long")
        spread = local.select("name", "tokens", F.posexplode("vals").alias("place", "value"))
        rows = spread.groupBy("name", "place").agg(mean.alias("value")).toArrow()
        names, places = rows["name"].to_numpy(zero_copy_only=False), rows["place"].to_numpy()
        numbers = rows["value"].to_numpy()
        for kind in _KINDS:
            for key, value in getattr(state, kind).items():
                met = names == f"{kind} {key}"
                value.reshape(-1)[places[met]] = numbers[met]
        last.unpersist()
    discard(pieces)
    return state.values


def log_probabilities(
    values: dict[str, np.ndarray], far: np.ndarray, near: np.ndarray, target: np.ndarray
) -> np.ndarray:
    """Natural log of each token's class probability, normalised once per distinct context."""
    n = len(values["bias"])
    contexts, place = np.unique(far * n + near, return_inverse=True)
    guess = (values["inputs"] @ values["near"])[contexts % n] + (values["inputs"] @ values["far"])[contexts // n]
    norm = np.empty(len(contexts), np.float32)
    for i in range(0, len(contexts), 256):  # so that the scores stay in the cache
        scores = guess[i : i + 256] @ values["outputs"].T
        scores += values["bias"]
        top = scores.max(1)
        scores -= top[:, None]
        np.exp(scores, out=scores)
        norm[i : i + 256] = top + np.log(scores.sum(1))
    out = np.empty(len(target))
    for i in range(0, len(target), 1 << 17):
        part = slice(i, i + (1 << 17))
        score = (guess[place[part]] * values["outputs"][target[part]]).sum(1) + values["bias"][target[part]]
        out[part] = score - norm[place[part]]
    return out


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, key long, n long"
)


def _score(vocabulary, values):
    """A row per text with what the table tells, and a row (row, key, n) per word outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        place = TaskContext.get().partitionId() << 33
        total = np.log10(max(1, vocab.tokens + vocab.distinct + 1))
        mass = np.log10(np.maximum(1, vocab.ending_mass))

        def rows(ids: list, held: list, classes: list[np.ndarray], counts: list[np.ndarray], rare: list) -> Iterator[pa.RecordBatch]:
            n = np.array([len(c) for c in classes])
            logs = log_probabilities(values.value, *_contexts(classes, vocab.end)) / np.log(10)
            ends = np.cumsum(n + 1)
            model, base, known = [], [], []
            for i, (c, count) in enumerate(zip(classes, counts)):
                shared = c >= vocab.words
                seen = count >= 0
                own = np.log10(count[seen] + 1.0)
                base.append(own.sum() + np.log10(vocab.texts + 1.0) - (n[i] + 1) * total)
                inside = np.log10(count[shared & seen] + 1.0).sum() - mass[c[shared] - vocab.words].sum()
                model.append(logs[ends[i] - n[i] - 1 : ends[i]].sum() + inside)
                known.append(int(seen.sum()) + (vocab.texts > 0))
            size = len(ids)
            yield _scored([range(place, place + size), ids, held, n + 1, known, base, model, [None] * size, [None] * size])
            words = [np.unique(keys, return_counts=True) for keys in rare]
            owner = np.repeat(np.arange(place, place + size), [len(w) for w, _ in words])
            none = [None] * len(owner)
            yield _scored(
                [owner, none, none, none, none, none, none,
                 np.concatenate([w for w, _ in words]).view(np.int64), np.concatenate([k for _, k in words])]
            )

        ids, held, classes, counts, rare, size = [], [], [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"]):
                keys = word_keys(text_bytes(text.as_py()))
                c, count = class_of(keys, vocab)
                ids.append(doc_id)
                held.append(out)
                classes.append(c)
                counts.append(count)
                rare.append(keys[count < 0])
                size += len(keys) + 1
                if size > 1_000_000:
                    yield from rows(ids, held, classes, counts, rare)
                    place += len(ids)
                    ids, held, classes, counts, rare, size = [], [], [], [], [], 0
        if ids:
            yield from rows(ids, held, classes, counts, rare)

    return run


def _scored(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in _SCORED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def score_texts(documents: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``documents``.

    Null and empty texts are the end alone. Rows are scored one by one, repeated ids and rows alike; a null
    doc_id is in no held-out fold. Without training texts every score is that of the untrained model.
    Columns other than doc_id and text are not read.
    """
    spark: SparkSession = documents.sparkSession
    prepare(spark)
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id"), settings.folds, settings.fold).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    training = rows.where(~F.col("held_out"))
    vocabulary, others = learn_vocabulary(training, settings)
    values = train(training, vocabulary, settings)
    context = spark.sparkContext
    scored = stored(
        rows.mapInArrow(_score(context.broadcast(vocabulary), context.broadcast(values)), _SCORED), "scored"
    )
    met = scored.where("key is not null").select("row", "key", "n").join(others, "key")
    more = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("known")
    )
    texts = scored.where("key is null").drop("key", "n").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return texts.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(vocabulary.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )
