"""Near copies by an exact Jaccard join on word n-grams, filtered by several global token orders.

A text is the set of its distinct n-grams. Under any total order of all tokens, two sets with Jaccard
similarity t or more share a token within the first ``n - ceil(t*n) + 1`` tokens of both. The join asks
this under two orders and verifies only pairs that pass both:

1. One pass over the texts gives each set's size and signature, and the first 30 bits of each token, its slot, sorted
   and packed into about a byte. Slots are counted over the cluster. Only frequent ones go into a sketch of fixed size,
   so that the many rare tokens of a large corpus don't fill it. Rows with equal sets are one class from here on.
2. Order A sorts by (how frequent the sketch says the token is, hash). Rare tokens come first, so passages
   that many documents share are not in prefixes. Classes that share a rare prefix token, have sizes
   within t of each other and tokens early enough to still reach t are candidates.
3. Only classes in such a pair post their prefix under order B, the same levels with another hash.
   Pairs found under both orders are verified on their whole sets.
4. A prefix reaches frequent tokens only in classes that consist of them: large clouds of near copies.
   These are compared with a few members of their cloud first. What that leaves outside the cloud's main
   component is compared with all of the cloud, in blocks of bounded size, so no link is missed and no
   list of all pairs is made.

The sketch only chooses the order: a poor estimate costs time, never a link. Counts of slots are exact sums,
so they never fall below a token's count, and postings of a rare token are at most as many as the threshold, ``RARE`` and
twice the tokens a slot. A rare token with more than ``longest`` postings, as in a corpus of many billions of tokens, is
no list of pairs either: under both orders its sets are a cloud as in 4. Postings of a frequent token are dealt out by salt.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.graph import components
from tallyworks.llm.shared import built_on, discard, prepare, stored
from tallyworks.llm.words import distinct, mix, run_hashes, text_bytes, word_hashes

SLOT_BITS = 30  # of a token, by which it is counted
CHUNKS = 32  # of the slots and of the sketch
PIECES = 32  # of a chunk, counted one by one
RARE = 8  # times that a token occurs, from which on it is frequent
HELD_TOKENS = 1 << 22  # that a task collects before it packs them
SALTS = 64  # of a frequent token
SIZE_BASE = math.log(1.02)  # sizes are posted on a log scale
KNOWN_IDS = 1_000_000  # of documents to drop that are broadcast, some 60 MB
BLOCK = 512  # members of a cloud compared at once


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    percent: int = 75  # Jaccard similarity, in whole percent
    sketch_bits: int = 24  # entries of the sketch, 5 to 30: raise with the frequent tokens, one byte each is broadcast
    longest: int = 64  # postings of a rare token that are paired up; more are a cloud
    wanted_bits: int = 23  # bits of the filter that picks documents for the later passes

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1


def _sets(batch: pa.RecordBatch, settings: JoinSettings) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
        yield doc_id, distinct(run_hashes(word_hashes(text_bytes(text.as_py())), settings.words))


def _signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _packed(slots: np.ndarray, sketch_bits: int) -> Iterator[tuple[int, bytes]]:
    """(chunk, blob) of sorted slots, ``PIECES`` blobs a chunk.

    A blob begins with its piece, so that sorting by it brings the blobs of a piece together, and the bits of the sketch.
    Then come the gaps between slots, byte by byte of their place value, deflated.
    """
    size = (1 << SLOT_BITS) // (CHUNKS * PIECES)
    ends = np.searchsorted(slots, np.arange(1, CHUNKS * PIECES + 1, dtype=np.int64) * size)
    for i, (start, stop) in enumerate(zip([0, *ends[:-1]], ends)):
        if start < stop:
            chunk, piece = divmod(i, PIECES)
            gaps = np.diff(slots[start:stop], prepend=np.uint32(i * size))
            yield chunk, bytes([piece, sketch_bits]) + zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    """Slots within their piece."""
    planes = np.frombuffer(zlib.decompress(blob[2:]), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _profile(settings: JoinSettings):
    """(doc_id, n, sig) per row, and the slots of the task's tokens as (chunk, counts): a slot occurs as often as its tokens."""
    shift = np.uint64(64 - SLOT_BITS)
    names = ["doc_id", "n", "sig", "chunk", "counts"]

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.concatenate(found)
        slots.sort()
        chunks, blobs = zip(*_packed(slots, settings.sketch_bits))
        none = pa.nulls(len(chunks), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids, sizes, signs = [], [], []
            for doc_id, tokens in _sets(batch, settings):
                ids.append(doc_id)
                sizes.append(len(tokens))
                signs.append(_signature(tokens))
                if len(tokens):
                    found.append((tokens >> shift).astype(np.uint32))
                    held += len(tokens)
                if held >= HELD_TOKENS:
                    yield counted(found)
                    found, held = [], 0
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names,
            )
        if found:
            yield counted(found)

    return run


def _merge(threshold: int):
    """A level per entry of the sketch, that of its most frequent slot: 0 for rare, then one per doubling.

    Rows come by chunk and piece, and one piece is counted at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, found = None, [], {}
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["counts"]):
                blob = blob.as_py()
                if now != (chunk, blob[0], blob[1]):
                    count(now, parts, found)
                    if now and now[0] != chunk:
                        yield levels(found)
                    now, parts = (chunk, blob[0], blob[1]), []
                parts.append(_unpacked(blob))
        count(now, parts, found)
        if found:
            yield levels(found)

    def count(place: tuple[int, int, int] | None, parts: list[np.ndarray], found: dict[int, np.ndarray]) -> None:
        if place is None:
            return
        chunk, piece, bits = place
        slots = np.concatenate(parts)
        slots.sort()
        starts, counts = _runs(slots)
        often = counts >= threshold
        level = np.minimum(1 + np.log2(counts[often] / threshold), 15).astype(np.uint8)
        slots = slots[starts[often]] + np.uint32(piece * ((1 << SLOT_BITS) // (CHUNKS * PIECES)))
        entry = found.setdefault(chunk, np.zeros((1 << bits) // CHUNKS, np.uint8))
        np.maximum.at(entry, (slots >> np.uint32(SLOT_BITS - bits)).astype(np.intp), level)

    def levels(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        chunk, entry = found.popitem()
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([entry.tobytes()], pa.binary())], ["chunk", "levels"]
        )

    return run


def _post(settings: JoinSettings, levels, salt: int, wanted):
    """Prefix tokens under one order as (key, sig).

    A rare token's key holds 46 bits of the token, the size on a log scale (10 bits) and the token's place
    in 1/256 of the size (7 bits). A frequent token's key is negative and ends in the salt of the set.
    """
    shift = np.uint64(64 - settings.sketch_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        level_of = levels.value
        for batch in batches:
            keys, signs, picked = [], [], _picked(batch, wanted)
            for doc_id, tokens in _sets(picked, settings):
                n = len(tokens)
                sig = _signature(tokens)
                if not n or doc_id is None or sig in seen:
                    continue
                seen.add(sig)
                rank = level_of[(tokens >> shift).astype(np.intp)].astype(np.uint64) << np.uint64(60)
                order = np.sort(rank | (mix(tokens ^ np.uint64(salt)) >> np.uint64(4)))[: settings.prefix(n)]
                rare = int(np.searchsorted(order, np.uint64(1 << 60)))
                token = order[:rare] & np.uint64((1 << 46) - 1)
                size = np.uint64(min(1023, int(math.log(n) / SIZE_BASE)))
                place = np.minimum(np.arange(rare, dtype=np.uint64) * np.uint64(256) // np.uint64(n), np.uint64(127))
                key = (token << np.uint64(17)) | (size << np.uint64(7)) | place
                if rare < len(order) and not salt:
                    often = (order[rare:] << np.uint64(6)) | np.uint64(1 << 63) | np.uint64(sig % SALTS)
                    key = np.concatenate((key, often))
                keys.append(key)
                signs.append(np.full(len(key), sig, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(signs))], ["key", "sig"]
                )

    return run


def _picked(batch: pa.RecordBatch, wanted) -> pa.RecordBatch:
    if wanted is None:
        return batch
    slot = batch["slot"].to_numpy(zero_copy_only=False)
    return batch.filter(pa.array((wanted.value[slot >> 3] >> (slot & 7)) & 1 == 1))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.append(starts, len(values)))


def _pair_up(keys: np.ndarray, signs: np.ndarray, settings: JoinSettings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(0, a, b) of sets that share a rare token and may still reach the threshold, each pair once.

    Of a token in more than ``longest`` sets (1, a, b): its smallest set with each of the others.
    """
    percent = settings.percent
    token = keys >> 17
    order = np.argsort(token, kind="stable")
    keys, signs, token = keys[order], signs[order], token[order]
    same = token[1:] == token[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    keys, signs, token = keys[shared], signs[shared], token[shared]
    order = np.lexsort((signs, token))
    keys, signs, token = keys[order], signs[order], token[order]
    fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (signs[1:] != signs[:-1])))[: len(token)]
    keys, signs, token = keys[fresh], signs[fresh], token[fresh]
    if not len(token):
        return
    code, place = (keys >> 7) & 1023, keys & 127
    low, high = np.exp(code * SIZE_BASE) * 0.999, np.exp((code + 1) * SIZE_BASE) * 1.001
    rest = 1 + high * (1 - place / 256)  # at most so many tokens from the shared one on
    starts, lengths = _runs(token)
    crowd = np.repeat(lengths > settings.longest, lengths)
    hubs, others = np.repeat(signs[starts], lengths)[crowd], signs[crowd]
    if len(others):
        stars = np.unique(np.stack((hubs, others), 1)[hubs != others], axis=0)
        for i in range(0, len(stars), 100_000):
            yield 1, stars[i : i + 100_000, 0], stars[i : i + 100_000, 1]
    starts, lengths = starts[lengths <= settings.longest], lengths[lengths <= settings.longest]
    found = []
    for length in np.unique(lengths):
        if length < 2:
            continue
        first, second = np.triu_indices(length, 1)
        at = starts[lengths == length]
        step = max(1, 1_000_000 // len(first))
        for i in range(0, len(at), step):
            left = (at[i : i + step, None] + first).ravel()
            right = (at[i : i + step, None] + second).ravel()
            need = percent / (100 + percent) * (low[left] + low[right])
            close = np.minimum(high[left], high[right]) * 100 >= percent * np.maximum(low[left], low[right])
            close &= np.minimum(rest[left], rest[right]) >= need
            left, right = signs[left[close]], signs[right[close]]
            found.append(np.stack((np.minimum(left, right), np.maximum(left, right)), 1))
    if found:
        pairs = np.concatenate(found)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))[: len(pairs)]]
        for i in range(0, len(pairs), 100_000):
            yield 0, pairs[i : i + 100_000, 0], pairs[i : i + 100_000, 1]


def _meet(settings: JoinSettings):
    """Postings of one partition: (kind, a, b).

    Kind 0 is a candidate pair. Kind 1 is a set with the smallest one of its salt that has the same frequent
    token, and kind 2 that token with that smallest one. Kind 1 is also a set with the smallest one that has
    the same rare token with too many postings to pair up; these are not salted.
    """
    names = ["kind", "a", "b"]

    def rows(kind: int, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, signs, hubs, stars = [], [], {}, set()
        for batch in batches:
            key, sig = batch["key"].to_numpy(), batch["sig"].to_numpy()
            rare = key >= 0
            keys.append(key[rare])
            signs.append(sig[rare])
            for k, s in zip(key[~rare].tolist(), sig[~rare].tolist()):
                hub = hubs.get(k)
                if hub is None or s < hub:
                    if hub is not None:
                        stars.add((s, hub))
                    hubs[k] = s
                elif s != hub:
                    stars.add((hub, s))
                if len(stars) >= 100_000:
                    yield rows(1, *zip(*stars))
                    stars.clear()
        if stars:
            yield rows(1, *zip(*stars))
        if hubs:
            yield rows(2, [k >> 6 for k in hubs], list(hubs.values()))
        if keys:
            for kind, a, b in _pair_up(np.concatenate(keys), np.concatenate(signs), settings):
                yield rows(kind, a, b)

    return run


def _blobs(settings: JoinSettings, wanted):
    """The whole sets of wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, blobs = [], []
            for doc_id, tokens in _sets(_picked(batch, wanted), settings):
                if len(tokens) and doc_id is not None:
                    signs.append(_signature(tokens))
                    blobs.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(signs, pa.int64()), pa.array(blobs, pa.binary())], ["sig", "tokens"]
            )

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["a_tokens"], batch["b_tokens"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # merges two sorted runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Links between the two sides of one block pair, thinned out to a forest with the same components."""

    def run(block: pa.Table) -> pa.Table:
        side = block["side"].to_numpy()
        signs, comps = block["sig"].to_numpy(), block["comp"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["tokens"]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a = np.concatenate([sets[i] for i in left])
        b = np.concatenate([sets[i] for i in right])
        a_row = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])
        b_row = np.repeat(np.arange(len(right)), [len(sets[i]) for i in right])
        shared = np.intersect1d(a, b)
        common = np.zeros((len(left), len(right)), np.float32)
        for i in range(0, len(shared), 2048):
            part = shared[i : i + 2048]
            tables = []
            for tokens, row, size in ((a, a_row, len(left)), (b, b_row, len(right))):
                at = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
                hit = part[at] == tokens
                has = np.zeros((size, len(part)), np.float32)
                has[row[hit], at[hit]] = 1
                tables.append(has)
            common += tables[0] @ tables[1].T
        sizes = np.array([len(x) for x in sets])
        union = sizes[left][:, None] + sizes[right][None, :] - common
        linked = (100 * common >= percent * union) & (comps[left][:, None] != comps[right][None, :])
        root = {int(s): int(s) for s in signs}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked)):
            x, y = int(signs[left[i]]), int(signs[right[j]])
            if find(x) != find(y):
                root[find(x)] = find(y)
                out.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _wanted(spark: SparkSession, ids: DataFrame, settings: JoinSettings):
    """A broadcast bit filter of fixed size over document ids; it may let others pass, which is harmless."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << settings.wanted_bits))
    bits = (
        ids.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (settings.wanted_bits - 5), np.uint32)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(words.view(np.uint8))


def _cloud_links(stars: DataFrame, links: DataFrame, blobs: DataFrame, percent: int) -> DataFrame | None:
    """Links of cloud members that the first comparisons did not bring into their cloud's main component."""
    if stars.isEmpty():
        return None
    families, joined = components(stars), components(links)
    clouds = families.select(F.col("id").alias("sig"), F.col("component").alias("cloud"))
    found = joined.select(F.col("id").alias("sig"), F.col("component").alias("comp"))
    members = stored(
        clouds.join(found, "sig", "left").select("sig", "cloud", F.coalesce("comp", "sig").alias("comp")), "members"
    )
    discard(families, joined)
    parts = members.groupBy("cloud", "comp").agg(F.count(F.lit(1)).alias("n"))
    clouds = parts.groupBy("cloud").agg(
        F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size")
    ).where("main.n < size")
    block = lambda n: F.ceil(n / BLOCK).cast("int")
    clouds = clouds.select(
        "cloud",
        F.col("main.comp").alias("main"),
        block(F.col("size")).alias("right_blocks"),
        block(F.col("size") - F.col("main.n")).alias("left_blocks"),
    )
    rows = members.join(clouds, "cloud").join(blobs, "sig")
    own = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select(
        "cloud", each("left_blocks").alias("i"), own("right_blocks").alias("j"), F.lit(1).alias("side"), "sig", "comp", "tokens"
    )
    left = rows.where("comp != main").select(
        "cloud", own("left_blocks").alias("i"), each("right_blocks").alias("j"), F.lit(0).alias("side"), "sig", "comp", "tokens"
    )
    pairs = left.unionAll(right).groupBy("cloud", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    return built_on(pairs, members)


def jaccard_components(documents: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text, anything else).

    * A null or wordless text has no tokens and links with nothing.
    * A text with fewer words than an n-gram is one token.
    * Rows with the same doc_id are one node: links of either are links of both; each keeps its own size.
    * A row without doc_id is counted but links with nothing; its component is null.
    * Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    prepare(spark)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << settings.wanted_bits))
    texts = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), slot.alias("slot")
    )
    profile = stored(
        texts.select("doc_id", "text").mapInArrow(
            _profile(settings), "doc_id long, n long, sig long, chunk int, counts binary"
        ),
        "profile",
    )
    rows = stored(profile.where("chunk is null").select("doc_id", "n", "sig"), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    threshold = RARE + 2 * (total >> SLOT_BITS)
    parts = profile.where("chunk is not null").select("chunk", "counts")
    levels = np.zeros((CHUNKS, (1 << settings.sketch_bits) // CHUNKS), np.uint8)
    parts = parts.repartition("chunk").sortWithinPartitions("chunk", "counts")
    for row in parts.mapInArrow(_merge(threshold), "chunk int, levels binary").toLocalIterator():
        levels[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    discard(profile)
    levels = spark.sparkContext.broadcast(levels.reshape(-1))

    def candidates(salt: int, wanted) -> DataFrame:
        posts = texts.mapInArrow(_post(settings, levels, salt, wanted), "key long, sig long")
        place = F.when(F.col("key") < 0, F.col("key")).otherwise(F.shiftright("key", 17))
        return posts.repartition(place).mapInArrow(_meet(settings), "kind int, a long, b long")

    def documents_of(signs: DataFrame) -> DataFrame:
        return classes.join(signs.distinct(), "sig", "left_semi").select("doc_id")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("sig"))

    classes = stored(
        rows.where("doc_id is not null and n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "classes"
    )
    first = stored(candidates(0, None), "first")
    pairs = stored(first.where("kind = 0").select("a", "b").distinct(), "pairs")
    hubs = first.where("kind = 2").groupBy("a").agg(F.min("b").alias("hub"))
    linked_hubs = first.where("kind = 2").join(hubs, "a").select(F.col("hub").alias("a"), "b").where("a != b")
    second = candidates(0x5851F42D4C957F2D, _wanted(spark, documents_of(ends(pairs)), settings))
    # Pairs found under both orders, and sets that share a token with too many postings under either.
    second = second.distinct().join(pairs.withColumn("both", F.lit(True)), ["a", "b"], "left").where("kind = 1 or both")
    found = second.select("a", "b", "kind").unionAll(first.where("kind = 1").select("a", "b", "kind"))
    found = found.unionAll(linked_hubs.select("a", "b", F.lit(1).alias("kind")))
    chosen = stored(found.groupBy("a", "b").agg(F.max("kind").alias("kind")), "chosen")
    stars = chosen.where("kind = 1").select("a", "b")
    wanted = _wanted(spark, documents_of(ends(chosen)), settings)
    blobs = texts.mapInArrow(_blobs(settings, wanted), "sig long, tokens binary")
    # The filter lets a few other documents pass; the joins below leave them out.
    blobs = stored(blobs, "sets")
    sides = [blobs.select(F.col("sig").alias(end), F.col("tokens").alias(f"{end}_tokens")) for end in ("a", "b")]
    links = stored(
        chosen.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_tokens", "b_tokens")
        .mapInArrow(_verify(settings.percent), "a long, b long"),
        "links",
    )
    more = _cloud_links(stars, links, blobs, settings.percent)
    used = [first, pairs, chosen, blobs, links, classes, *([] if more is None else [more])]
    links = links if more is None else links.unionAll(more)
    for end in ("a", "b"):
        named = classes.select(F.col("sig").alias(end), F.col("doc_id").alias(f"{end}_doc"))
        links = links.join(named, end)
    copies = rows.where("n > 0").join(classes.withColumnRenamed("doc_id", "same"), "sig").where("doc_id != same")
    edges = links.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).unionAll(copies.select("doc_id", "same"))
    groups = components(edges)
    discard(*used)
    named = groups.select(F.col("id").alias("doc_id"), "component")
    result = rows.join(named, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
    return built_on(result, rows, groups)


def one_of_each_group(documents: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """The rows of ``documents``, all columns, of which no row with a smaller doc_id is a near copy.

    Of rows with the same doc_id, which are one document, one is kept; rows without doc_id are all kept.
    """
    found = jaccard_components(documents, settings)
    named = stored(found, "groups")
    discard(found)
    gone = named.where("doc_id != component_id").select("doc_id").distinct()
    again = named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = F.col("doc_id").cast("bigint")
    rows = documents.withColumn("_id", own)
    drop = _near(stored(gone.unionAll(again).distinct().withColumnRenamed("doc_id", "_gone"), "gone"))
    kept = rows.join(drop, F.col("_id") == F.col("_gone"), "left_anti")
    once = _near(stored(again.join(gone, "doc_id", "left_anti").withColumnRenamed("doc_id", "_once"), "once"))
    single = rows.join(once, F.col("_id") == F.col("_once"), "left_semi").dropDuplicates(["_id"])
    discard(named)
    return kept.unionByName(single).drop("_id")


def _near(ids: DataFrame) -> DataFrame:
    """Stored ids on their way to whole texts: up to ``KNOWN_IDS`` of them are broadcast, so that the texts stay where they are."""
    return F.broadcast(ids) if ids.count() <= KNOWN_IDS else ids
