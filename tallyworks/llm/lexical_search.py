"""Ranked lexical search with bag deduplication: texts that a set of queries can't tell apart are scored once.

Documents are reduced to the words that some query has. Documents with the same frequencies of these words and the
same length norm form a class; classes are grouped by a hash together with what was hashed, so that
they are verified. Every class is scored once against all queries by walking each query's words through the
postings of a batch of classes. A class is placed by its score and its smallest document; the documents of the
best ``limit`` classes hold the best ``limit`` documents, so only these classes are expanded.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.shared import discard, prepare, stored

# Fixed values of the scoring rule.
FLAT, SLOPE = 75, 25  # parts of the length norm, of 100
SATURATION = 12
UNIT = 1_000_000_000
WEIGHT = 1000

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_CLASS = ["hash", "norm", "terms", "counts"]


@dataclass(frozen=True)
class SearchSettings:
    limit: int = 20
    #: Words of distinct queries that one pass over the documents looks for. More queries take more passes;
    #: one query is never split, so a pass holds one query's words at least.
    words_per_pass: int = 500_000
    batch: int = 4096  # classes scored at once
    #: Words of the best classes that are broadcast to find their members; beyond it they are joined.
    broadcast_words: int = 4_000_000


def text_terms(data: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters; only A-Z are lower-cased."""
    return _TERM.findall(data.lower())


def _query_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, words, counts = [], [], []
        for key, text in zip(batch["query"].to_pylist(), batch["text"]):
            for word, count in Counter(text_terms(text.as_py() or b"")).items():
                keys.append(key)
                words.append(word)
                counts.append(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["query", "word", "count"]
        )


def _bags(numbers: dict[bytes, int]):
    """Rows with the words of ``numbers`` they hold, by ascending number, and the count of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch["text"]:
                found = Counter(text_terms(text.as_py() or b""))
                lengths.append(found.total())
                held = sorted((numbers[word], n) for word, n in found.items() if word in numbers)
                terms.append([x for x, _ in held])
                counts.append([n for _, n in held])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "length", "terms", "counts"],
            )

    return run


class _Best:
    """The best ``limit`` classes of every query seen so far, by score and smallest document."""

    def __init__(self, queries: int, limit: int):
        self.limit = limit
        self.least = np.zeros(queries, np.int64)  # a class must score more, or as much and be placed
        self.held: list[list[tuple]] = [[] for _ in range(queries)]

    def offer(self, query: int, scores: np.ndarray, firsts: list, hashes: list, norms: list) -> None:
        chosen = np.flatnonzero((scores > 0) & (scores >= self.least[query]))
        if not len(chosen):
            return
        if len(chosen) > self.limit:  # all above the bar, and those at it
            bar = np.partition(scores[chosen], -self.limit)[-self.limit]
            chosen = chosen[scores[chosen] >= bar]
        held = self.held[query] + [(-int(scores[i]), firsts[i] is not None, firsts[i], hashes[i], norms[i]) for i in chosen]
        held.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[3], x[4]))
        self.held[query] = held[: self.limit]
        if len(held) >= self.limit:
            self.least[query] = -held[self.limit - 1][0]


def _score(queries: list[list[tuple[int, int]]], settings: SearchSettings):
    """Best classes of a task's share, for queries given as (word number, weight times repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries), settings.limit)
        pieces = (b.slice(at, settings.batch) for b in batches for at in range(0, b.num_rows, settings.batch))
        for batch in pieces:
            lists = batch["terms"]
            starts = np.asarray(lists.offsets)
            terms = np.asarray(lists.values)[starts[0] : starts[-1]]
            counts = np.asarray(batch["counts"].values)[starts[0] : starts[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            norms = np.asarray(batch["norm"])
            impact = UNIT * counts // (1000 * counts + SATURATION * norms[owner])
            order = np.argsort(terms, kind="stable")
            owner, impact, terms = owner[order], impact[order], terms[order]
            known = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            ends = np.append(known[1:], len(terms))
            places = {int(terms[a]): (a, b) for a, b in zip(known.tolist(), ends.tolist())}
            firsts, hashes, kept = batch["first_id"].to_pylist(), batch["hash"].to_pylist(), norms.tolist()
            for number, words in enumerate(queries):
                scores = np.zeros(batch.num_rows, np.int64)
                for word, weight in words:
                    if word in places:
                        a, b = places[word]
                        scores[owner[a:b]] += weight * impact[a:b]
                best.offer(number, scores, firsts, hashes, kept)
        rows = [(q, -x[0], x[2], x[3], x[4]) for q, held in enumerate(best.held) for x in held]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["number", "score", "first_id", "hash", "norm"]
        )

    return run


def _one_pass(texts: DataFrame, words: DataFrame, settings: SearchSettings) -> DataFrame:
    """(query, rank, doc_id, score) for queries whose (query, word, count) are in ``words``, a bounded table."""
    found = words.toArrow()
    names = found["query"].to_pylist()
    spelled, repeats = found["word"].to_pylist(), found["count"].to_pylist()
    numbers = {word: i for i, word in enumerate(sorted(set(spelled)))}
    kind = "doc_id long, length long, terms array<int>, counts array<long>"
    bags = stored(texts.mapInArrow(_bags(numbers), kind), "bags")

    with_terms, all_terms = bags.agg(F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
    holding = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    holders = dict(zip(holding["term"].to_pylist(), holding["n"].to_pylist()))  # as many as there are query words
    queries, order = defaultdict(list), sorted(set(names))
    for name, word, repeat in zip(names, spelled, repeats):
        term = numbers[word]
        if term in holders:
            weight = math.floor(WEIGHT * math.log((2 * with_terms + 2) / (2 * holders[term] + 1)))
            if weight > 0:
                queries[name].append((term, weight * repeat))

    norm = F.lit(FLAT) + F.expr(f"({SLOPE}L * length * {with_terms}L) div {max(all_terms, 1)}L")
    normed = bags.where("size(terms) > 0").withColumn("norm", norm)
    hashed = normed.withColumn("hash", F.xxhash64("norm", "terms", "counts"))
    classes = stored(hashed.groupBy(*_CLASS).agg(F.min("doc_id").alias("first_id")), "classes")
    scored = classes.select("first_id", *_CLASS).mapInArrow(
        _score([queries[name] for name in order], settings),
        "number int, score long, first_id long, hash long, norm long",
    )
    placed = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("first_id"), "hash", "norm")
    winners = stored(
        scored.withColumn("place", F.row_number().over(placed)).where(F.col("place") <= settings.limit).drop("place"), "winners"
    )
    # Classes are found again by hash, norm and smallest document, their members by all that makes a class.
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("first_id", "hash", "norm")]
    wanted = winners.select("first_id", "hash", "norm").distinct().alias("w").join(classes.alias("c"), same).select("c.*")
    wanted = stored(wanted, "wanted")
    if (wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) <= settings.broadcast_words:
        wanted = F.broadcast(wanted)
    alike = [F.col(f"m.{c}") == F.col(f"c.{c}") for c in _CLASS]
    members = hashed.alias("m").join(wanted.alias("c"), alike).select("c.first_id", "c.hash", "c.norm", "m.doc_id")
    by_class = Window.partitionBy("first_id", "hash", "norm").orderBy(F.asc_nulls_first("doc_id"))
    members = members.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= settings.limit).drop("place")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("first_id", "hash", "norm")]
    rows = winners.alias("w").join(members.alias("x"), same).select("w.number", "w.score", "x.doc_id")
    by_query = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= settings.limit)
    spark = texts.sparkSession
    keys = spark.createDataFrame([(i, bytearray(name)) for i, name in enumerate(order)], "number int, query binary")
    result = stored(ranked.join(keys, "number").select("query", "rank", "doc_id", "score"), "ranked")
    discard(bags, classes, winners, wanted)
    return result


def rank_documents(documents: DataFrame, items: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``limit`` of ``documents`` (doc_id, text) for each row of ``items``
    (item_id, text). Both may have further columns.

    A document counts by its row: rows that repeat an id are ranked each. Equal scores go by ascending doc_id, a
    null id first. Null texts and texts without words match nothing; an item without a document above 0 gives no
    rows, and empty tables give none. Items with the same text are searched once, and each gets the rows.

    Every pass reads all whole documents for as many queries as hold ``words_per_pass`` words (on the average;
    queries are dealt by their hash): these words, their document counts and the queries go to every task. What moves is
    one row per class and task, and ``limit`` rows per query and task.
    """
    spark = documents.sparkSession
    prepare(spark)
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    named = stored(items.where("text is not null").select("item_id", key.alias("query"), "text"), "items")
    once = named.groupBy("query").agg(F.first("text").alias("text")).select("query", F.col("text").cast("binary"))
    words = stored(once.mapInArrow(_query_words, "query binary, word binary, count long"), "words")
    passes = max(1, -(-words.count() // settings.words_per_pass))
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    found = None
    for i in range(passes):
        dealt = words.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i)
        part = _one_pass(texts, dealt, settings)
        found = part if found is None else found.unionAll(part)
    return named.select("item_id", "query").join(found, "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
