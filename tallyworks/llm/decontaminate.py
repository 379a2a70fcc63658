"""Benchmark passages in training text: native scan of word windows against a set of benchmark windows.

A benchmark item's windows are its runs of ``size`` words, or the whole item if it has fewer. Windows are
hashed to 64 bits. If the set has at most ``broadcast_windows`` members it goes to every task as a hash
set inside the plan, and only windows that hit it leave their document; a larger set is met by a shuffled
join of all windows. Hits are verified on their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, once A-Z are lower-cased


@dataclass(frozen=True)
class Settings:
    size: int = 10
    broadcast_windows: int = 500_000  # 8 bytes each in the plan, under 100 each in the verified table


def words(text: Column) -> Column:
    """The words of a text in order: A-Z lower-cased, split at ASCII that is no letter or digit."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, GAP), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (hash, window, length, item_id); items without words have none."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    items = items.where("size(words) > 0").withColumn("length", F.least(F.lit(size), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    return (
        items.select("item_id", "length", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("length")))).alias("window"))
        .select(F.xxhash64("window").alias("hash"), "window", "length", "item_id")
        .distinct()
    )


def _starts(w: Column, length: int) -> Column:
    """The places, from 1, where windows of a length begin."""
    return F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - (length - 1))).otherwise(
        F.array().cast("array<int>")
    )


def scan(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``documents``: the ``keep`` columns, n_words, hits (struct start, length) and items.

    ``hits`` holds the verified windows by start word, ``items`` the sorted ids of items that occur. Rows
    are told apart by their place, so repeated ids and rows each get their own result. Null and empty
    texts have no words; a null item_id counts as a window but is no item. Other columns are not read.
    """
    known = benchmark_windows(benchmark, settings.size)
    facts = known.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("distinct")).collect()
    lengths, total = sorted(row["length"] for row in facts), sum(row["n"] for row in facts)
    small = total <= settings.broadcast_windows
    hashes = {}
    if small:
        for length in lengths:
            own = known.where(F.col("length") == length).select("hash").distinct().collect()
            hashes[length] = sorted(row["hash"] for row in own)

    def found(w: Column, length: int) -> Column:
        starts = _starts(w, length)
        if small:
            starts = F.filter(starts, lambda i: F.xxhash64(F.slice(w, i, length)).isin(hashes[length]))
        return F.transform(
            starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.slice(w, i, length).alias("window"))
        )

    # The words are bound as a variable, so they are split once per text, whatever the optimiser moves.
    parts = [lambda w, n=length: found(w, n) for length in lengths]
    scanned = F.transform(
        F.array(words(F.col("text"))),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            (F.concat(*[part(w) for part in parts]) if parts else F.array()).alias("windows"),
        ),
    )
    rows = documents.select(F.monotonically_increasing_id().alias("row"), *keep, F.element_at(scanned, 1).alias("_"))
    rows = rows.select("row", *keep, "_.n_words", "_.windows")
    if not lengths:
        nothing = F.array().cast("array<struct<start:int,length:int>>")
        return rows.select(*keep, "n_words", nothing.alias("hits"), F.array().cast("array<string>").alias("items"))
    spread = rows.select("row", *keep, "n_words", F.explode_outer("windows").alias("w")).select(
        "row", *keep, "n_words", "w.start", "w.length", "w.window", F.xxhash64("w.window").alias("hash")
    )
    by_window = known.groupBy("hash", "window").agg(F.collect_set("item_id").alias("ids"))
    by_window = by_window.withColumnRenamed("window", "known")
    by_window = F.broadcast(by_window) if small else by_window
    met = spread.join(by_window, (spread["hash"] == by_window["hash"]) & (F.col("window") == F.col("known")), "left")
    hit = F.when(F.col("known").isNotNull(), F.struct("start", "length"))
    return (
        met.groupBy("row", *keep, "n_words")
        .agg(F.sort_array(F.collect_list(hit)).alias("hits"), F.collect_set(F.when(F.size("ids") > 0, F.col("ids"))).alias("ids"))
        .select(*keep, "n_words", "hits", F.sort_array(F.array_distinct(F.flatten("ids"))).alias("items"))
    )


def covered(hits: Column) -> Column:
    """How many words lie in at least one hit."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(state: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        more = F.greatest(F.lit(0), end - F.greatest(state["end"], hit["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + more).alias("n"))

    return F.aggregate(hits, start, add, lambda state: state["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``documents``."""
    found = scan(documents, benchmark, settings)
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` in which no benchmark window occurs, with all their columns.

    Up to ``broadcast_windows`` this is a filter inside the scan: a window's hash has to be in one set and then
    its words in another. A larger benchmark is met by the shuffled join of ``scan``.
    """
    known = benchmark_windows(benchmark, settings.size)
    lengths = sorted(row["length"] for row in known.select("length").distinct().collect())
    if not lengths:
        return documents
    if known.count() > settings.broadcast_windows:
        print_of = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
        found = scan(documents.select("doc_id", "text", print_of.alias("_print")), benchmark, settings, ("doc_id", "_print"))
        found = found.where("size(hits) > 0").select(F.col("doc_id").alias("_id"), F.col("_print")).distinct()
        marked = documents.withColumn("_text", print_of)
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_print"))
        return marked.join(found, same, "left_anti").drop("_text")
    sets = []
    for length in lengths:
        own = known.where(F.col("length") == length).select("hash", F.array_join("window", " ").alias("text")).distinct().collect()
        sets.append((length, sorted({row["hash"] for row in own}), sorted({row["text"] for row in own})))

    def hit(w: Column) -> Column:
        found = F.lit(False)
        for length, hashes, texts in sets:
            found = found | F.exists(
                _starts(w, length),
                lambda i: F.xxhash64(F.slice(w, i, length)).isin(hashes)  # noqa: B023
                & F.array_join(F.slice(w, i, length), " ").isin(texts),  # noqa: B023
            )
        return found

    # The words are bound as a variable: a filter on a column would be pushed below it and split again per window.
    return documents.where(~F.exists(F.array(words(F.col("text"))), hit))
