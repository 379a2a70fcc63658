"""Passages that repeat across documents, by a sparse suffix array.

Only suffixes that begin at a minimiser are kept: the word position whose ``gram``-word hash is the
smallest of a window. The window is as long as the shortest passage asked for, so every run of
``least_words`` words holds a minimiser, chosen by those words alone, and two copies of the run keep the
same one. Kept suffixes whose first ``gram`` words occur in one document only can match nothing and are
left out. The others go one of two ways, by how many suffixes of the corpus begin with the same words:

* At most ``neighbours + 1``: they are sorted over the cluster by their words, where these lie side by side,
  so comparing each with its nearest neighbours compares all of them, to the right as far as the words agree
  and from there to the left. Contexts are as long as a shortest passage needs; longer passages are covered
  by the chain of their minimisers.
* More, a crowded beginning: every run of ``least_words`` words that has the minimiser is named by the hash of
  its words, and the smallest doc_id of each name is aggregated before it meets the documents that hold it.

Both are exact, however many documents share a passage and whatever stands around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.shared import built_on, discard, prepare, stored
from tallyworks.llm.words import bounds, distinct, run_hashes, text_bytes, word_hashes

BYTES = 3  # of a word's hash kept in a context


@dataclass(frozen=True)
class SuffixSettings:
    least_words: int = 50
    gram: int = 8
    neighbours: int = 8  # rows before it that a suffix is compared with; beginnings with more go by whole runs
    filter_bits: int = 25  # of each broadcast filter, of beginnings and of runs: raise with the corpus

    @property
    def window(self) -> int:
        return self.least_words - self.gram + 1


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """Position of the first smallest value of every window, by doubling."""
    at = np.arange(len(values))
    length = 1
    while length < window:
        step = min(length, window - length)
        later = values[step:] < values[:-step]
        values, at = np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])
        length += step
    return at


def _chosen(words: np.ndarray, settings: SuffixSettings) -> tuple[np.ndarray, np.ndarray]:
    """(position of the minimiser of every run of ``least_words`` words, hashes of all grams)."""
    if len(words) < settings.least_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = run_hashes(words, settings.gram)
    return _smallest(grams, settings.window), grams


def minimisers(words: np.ndarray, settings: SuffixSettings) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the words that begin there) of a text's minimisers; none if it is too short."""
    at, grams = _chosen(words, settings)
    at = distinct(at)
    return at, grams[at]


def _marked(hashes: np.ndarray, bits: np.ndarray, settings: SuffixSettings) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - settings.filter_bits)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7)) & 1 == 1


def _grams(settings: SuffixSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if doc_id is not None:
                    _, key = minimisers(word_hashes(text_bytes(text.as_py())), settings)
                    key, n = np.unique(key, return_counts=True)
                    keys.append(key)
                    ids.append(np.full(len(key), doc_id, np.int64))
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts))],
                ["gram", "doc_id", "n"],
            )

    return run


def signature(words: np.ndarray) -> int:
    """Tells texts of rows with the same doc_id apart."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _runs(settings: SuffixSettings, crowded, shared=None):
    """(key, doc_id) of the runs of ``least_words`` words with a crowded minimiser, each once per text.

    With a filter of shared keys: (key, doc_id, sig, start) of every such run that it lets pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if doc_id is None:
                    continue
                words = word_hashes(text_bytes(text.as_py()))
                at, grams = _chosen(words, settings)
                start = np.flatnonzero(_marked(grams, crowded.value, settings)[at])
                if not len(start):
                    continue
                keys = run_hashes(words, settings.least_words)[start]
                if shared is None:
                    keys = distinct(keys)
                else:
                    passed = _marked(keys, shared.value, settings)
                    keys, start = keys[passed], start[passed]
                    columns[2].append(np.full(len(keys), signature(words), np.int64))
                    columns[3].append(start)
                columns[0].append(keys.view(np.int64))
                columns[1].append(np.full(len(keys), doc_id, np.int64))
            names = ["key", "doc_id"] if shared is None else ["key", "doc_id", "sig", "start"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns[: len(names)]], names)

    return run


def _suffixes(settings: SuffixSettings, repeated, crowded):
    """(doc_id, sig, at, right, left) of suffixes that begin with repeated words, but not with crowded ones.

    Contexts end in zero bytes.
    """
    reach = settings.least_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if doc_id is None:
                    continue
                words = word_hashes(text_bytes(text.as_py()))
                at, grams = minimisers(words, settings)
                at = at[_marked(grams, repeated.value, settings) & ~_marked(grams, crowded.value, settings)]
                if not len(at):
                    continue
                low = (words >> np.uint64(8)).astype(np.uint32) % np.uint32(2 ** (8 * BYTES) - 1) + np.uint32(1)
                padded = np.concatenate((np.zeros(reach, np.uint32), low, np.zeros(reach, np.uint32)))
                spread = at[:, None] + np.arange(reach)
                right = padded[spread + reach].astype("<u4").view(np.uint8).reshape(len(at), reach, 4)
                left = padded[spread[:, ::-1]].astype("<u4").view(np.uint8).reshape(len(at), reach, 4)
                sig = signature(words)
                columns[0] += [doc_id] * len(at)
                columns[1] += [sig] * len(at)
                columns[2] += at.tolist()
                columns[3] += [x.tobytes() for x in right[:, :, :BYTES]]
                columns[4] += [x.tobytes() for x in left[:, :-1, :BYTES]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "sig", "at", "right", "left"]
            )

    return run


_FOUND = "doc_id long, sig long, start long, stop long, first_doc long, edge int, at long, `right` binary, `left` binary"


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words two lots of contexts have in common from the begin; padding agrees with nothing."""
    shape = (len(a), a.shape[1] // BYTES, BYTES)
    same = (a == b).reshape(shape).all(2) & (a.reshape(shape) != 0).any(2)
    return np.where(same.all(1), same.shape[1], same.argmin(1))


def _told(found: np.ndarray) -> np.ndarray:
    """Of (row, left, right, own doc, other doc) matches: those to pass on.

    Per row the matches that reach farthest to the left and to the right, among those with another document
    and among those with an earlier one, and one with the smallest other document. Every other match lies
    within these.
    """
    kept = [np.zeros((0, 5), np.int64)]
    others = found[found[:, 4] != found[:, 3]]
    for of, keys in (
        (others, (-others[:, 2], -others[:, 1], others[:, 4])),
        *((x, (x[:, 4], -x[:, b], -x[:, a])) for x in (others, others[others[:, 4] < others[:, 3]]) for a, b in ((1, 2), (2, 1))),
    ):
        sorted_ = of[np.lexsort((*keys, of[:, 0]))]
        kept.append(sorted_[np.concatenate(([True], sorted_[1:, 0] != sorted_[:-1, 0]))[: len(sorted_)]])
    return np.unique(np.concatenate(kept), axis=0)


def _matches(rows: dict[str, np.ndarray], new: int, settings: SuffixSettings) -> pa.RecordBatch | None:
    """Matches among sorted rows, of which the last ``new`` have not been compared yet."""
    n = len(rows["at"])
    out = []
    for step in range(1, settings.neighbours + 1):
        later = np.arange(max(step, n - new), n)
        if not len(later):
            continue
        # The sort puts equal beginnings together: without the first word in common there is no match.
        later = later[(rows["right"][later, :BYTES] == rows["right"][later - step, :BYTES]).all(1)]
        earlier = later - step
        right = _agree(rows["right"][later], rows["right"][earlier])
        left = _agree(rows["left"][later], rows["left"][earlier])
        long = right + left >= settings.least_words
        for side, other in ((later[long], earlier[long]), (earlier[long], later[long])):
            out.append(np.stack((side, left[long], right[long], rows["doc_id"][side], rows["doc_id"][other]), 1))
    found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
    if not len(found):
        return None
    told = _told(found)
    row = told[:, 0]
    at, size, nothing = rows["at"][row], len(row), [None] * len(row)
    first = np.minimum(told[:, 3], told[:, 4])
    return _found([rows["doc_id"][row], rows["sig"][row], at - told[:, 1], at + told[:, 2], first, [0] * size, at, nothing, nothing])


def _found(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["doc_id", "sig", "start", "stop", "first_doc", "edge", "at", "right", "left"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _table(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {name: batch[name].to_numpy() for name in ("doc_id", "sig", "at")}
    for name in ("right", "left"):
        blobs = batch[name].to_pylist()
        out[name] = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return out


def _neighbours(settings: SuffixSettings, mark_edges: bool):
    """Matches between neighbours of a sorted partition; its first and last rows too, marked as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = _table(batch.slice(i, 8192))
                new = len(part["at"])
                if first is None:
                    first = {k: v[: settings.neighbours].copy() for k, v in part.items()}
                rows = part if held is None else {k: np.concatenate((held[k], part[k])) for k in part}
                found = _matches(rows, new, settings)
                if found is not None:
                    yield found
                held = {k: v[-settings.neighbours :].copy() for k, v in rows.items()}
        if mark_edges and held is not None:
            for edge in (first, held):
                n = len(edge["at"])
                blobs = [[x.tobytes() for x in edge[side]] for side in ("right", "left")]
                yield _found([edge["doc_id"], edge["sig"], [None] * n, [None] * n, [None] * n, [1] * n, edge["at"], *blobs])

    return run


def _bits(spark: SparkSession, hashes: DataFrame, column: str, settings: SuffixSettings):
    """A broadcast bit filter of fixed size; what it lets pass by mistake is handled in vain, no more."""
    slot = F.shiftrightunsigned(column, 64 - settings.filter_bits)
    bits = (
        hashes.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (settings.filter_bits - 5), np.uint32)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(words.view(np.uint8))


def repeated_spans(documents: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """(doc_id, sig, start, stop, first_doc) of matches, in words; first_doc is the smallest doc_id with the passage."""
    spark = documents.sparkSession
    prepare(spark)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    grams = texts.mapInArrow(_grams(settings), "gram long, doc_id long, n long")
    span = (F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last"))
    ends = grams.groupBy("gram").agg(*span, F.sum("n").alias("n")).where("first_doc != last")
    ends = stored(ends.select("gram", "n"), "beginnings")
    repeated = _bits(spark, ends, "gram", settings)
    crowded = _bits(spark, ends.where(F.col("n") > settings.neighbours + 1), "gram", settings)
    discard(ends)
    suffixes = texts.mapInArrow(
        _suffixes(settings, repeated, crowded), "doc_id long, sig long, at long, `right` binary, `left` binary"
    )
    order = ["right", "doc_id", "at"]
    laid = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(laid.mapInArrow(_neighbours(settings, True), _FOUND), "matches")
    # Neighbours in different partitions: a few rows per partition, compared in one more pass.
    edges = found.where("edge = 1").select("doc_id", "sig", "at", "right", "left").distinct()
    met = edges.repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours(settings, False), _FOUND)
    columns = ["doc_id", "sig", "start", "stop", "first_doc"]
    met = stored(met.where("edge = 0").select(*columns), "edges")
    # Crowded beginnings: the smallest document of each run of words, then all places of the shared runs.
    runs = texts.mapInArrow(_runs(settings, crowded), "key long, doc_id long")
    owners = stored(runs.groupBy("key").agg(*span).where("first_doc != last").select("key", "first_doc"), "owners")
    shared = _bits(spark, owners, "key", settings)
    places = texts.mapInArrow(_runs(settings, crowded, shared), "key long, doc_id long, sig long, start long")
    whole = places.join(owners, "key").withColumn("stop", F.col("start") + settings.least_words)
    spans = found.where("edge = 0").select(*columns).unionAll(met).unionAll(whole.select(*columns))
    return built_on(spans, found, met, owners)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, sig, spans in zip(batch["doc_id"].to_pylist(), batch["sig"].to_pylist(), batch["spans"]):
            found = np.stack([spans.values.field(k).to_numpy() for k in ("start", "stop", "first_doc")], 1)
            for start, stop, owner, cut in merged(_chained(found), doc_id):
                rows.append({"doc_id": doc_id, "sig": sig, "start_word": start, "stop_word": stop, "first_doc_id": owner, "cut": cut})
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        yield pa.RecordBatch.from_pylist(
            rows,
            pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("start_word", pa.int64()), ("stop_word", pa.int64()),
                       ("first_doc_id", pa.int64()), ("cut", pa.list_(span))]),
        )


def _chained(spans: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, first_doc) spans with those of the same owner that overlap one after another made one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0], spans[:, 2]))]
    new = np.flatnonzero(np.concatenate(([True], (spans[1:, 2] != spans[:-1, 2]) | (spans[1:, 0] > spans[:-1, 1]))))
    stops = np.maximum.reduceat(spans[:, 1], new)
    return list(zip(spans[new, 0].tolist(), stops.tolist(), spans[new, 2].tolist()))


def merged(spans: list[tuple[int, int, int]], doc_id: int) -> list[tuple[int, int, int, list[dict]]]:
    """Overlapping matches of a document as one passage each, with the parts that an earlier document has."""
    out: list[list] = []
    for start, stop, owner in sorted(spans):
        if not out or start > out[-1][1]:
            out.append([start, stop, owner, []])
        passage = out[-1]
        passage[1], passage[2] = max(passage[1], stop), min(passage[2], owner)
        if owner < doc_id:
            cut = passage[3]
            if cut and start <= cut[-1]["stop"]:
                cut[-1]["stop"] = max(cut[-1]["stop"], stop)
            else:
                cut.append({"start": start, "stop": stop})
    return [tuple(p) for p in out]


def repeated_passages(documents: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """(doc_id, sig, start_word, stop_word, first_doc_id, cut) per passage that also occurs in another document.

    ``cut`` lists the word ranges that a document with a smaller id has too. Documents without such a
    passage give no row.

    * Null and empty texts and those shorter than ``least_words`` have no passages.
    * Rows with the same doc_id are one document: what they share with each other is no repeat.
    * Rows without doc_id are passed over. Other columns are not read.
    """
    spans = repeated_spans(documents, settings)
    grouped = spans.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("start", "stop", "first_doc")).alias("spans"))
    passages = grouped.mapInArrow(
        _merge,
        "doc_id long, sig long, start_word long, stop_word long, first_doc_id long, cut array<struct<start:bigint,stop:bigint>>",
    )
    return built_on(passages, spans)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in the given ranges and the white space after them."""
    starts, _ = bounds(text)
    offsets = np.append(starts, len(text))
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept.append(text[at : max(at, offsets[min(start, len(starts))])])
        at = max(at, int(offsets[min(stop, len(starts))]))
    kept.append(text[at:])
    return b"".join(kept)


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch[names.index("text")].to_pylist(), batch[len(names)].to_pylist()):
                if text is not None and cuts:
                    data = text.encode()
                    sig = signature(word_hashes(data))
                    spans = [(c["start"], c["stop"]) for cut in cuts if cut["sig"] == sig for c in cut["cut"]]
                    text = cut_words(data, spans).decode() if spans else text
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch[i] for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def without_repeats(documents: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """All rows and columns of ``documents``, with passages that an earlier document has cut out of the texts.

    ``text`` is the only column that changes. A document that repeats nothing keeps its text as it is; one
    that is nothing but repeats keeps its row with what is left of the text.
    """
    found = repeated_passages(documents, settings)
    cuts = found.where("size(cut) > 0")
    cuts = cuts.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.collect_list(F.struct("sig", "cut")).alias("_cuts"))
    cuts = stored(cuts, "cuts")
    discard(found)
    names = documents.columns
    joined = documents.join(cuts, F.col("doc_id").cast("bigint") == F.col("_cut_id"), "left")
    return joined.select(*[F.col(f"`{n}`") for n in names], "_cuts").mapInArrow(_cut(names), documents.schema)
