"""Near copies among embeddings of equal label: p-stable hashing of unit vectors, then exact cosines.

A table has ``hashes`` functions ``floor((a . x + b) / width)`` with normal ``a``; vectors of one label whose
functions all agree share a bucket. For unit vectors cosine c means distance sqrt(2 - 2c), which gives the
chance to share a bucket in closed form (``recall``); the defaults find 99 % of pairs at cosine 0.93 and
more above it. Equal vectors are one class. A large bucket is cut into blocks and compared block by
block in different tasks, and tasks pass on counts and forests of links, never lists of all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyworks.llm.graph import components
from tallyworks.llm.shared import prepare, stored
from tallyworks.llm.words import mix


@dataclass(frozen=True)
class LshSettings:
    cosine: float = 0.93
    tables: int = 16
    hashes: int = 8
    width: float = 2.0
    seed: int = 11
    block: int = 1024  # classes of a bucket compared at once

    def recall(self, cosine: float) -> float:
        """The chance that two unit vectors of this cosine meet in at least one table."""
        c = self.width / max(math.sqrt(max(0.0, 2 - 2 * cosine)), 1e-9)
        tail = math.erfc(c / math.sqrt(2))
        one = 1 - tail - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))
        return 1 - (1 - one**self.hashes) ** self.tables


def _classes(kind: str):
    """(vec_id, label, key, vector): key is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for label, parts in zip(batch["label"], batch["embedding"]):
                values = parts.values if parts.is_valid else None
                usable = label.is_valid and values is not None and len(values) and values.null_count == 0
                vector = np.array(values, dtype=kind) + 0.0 if usable else None  # -0.0 becomes 0.0
                if usable and np.isfinite(vector).all() and vector.any():
                    blob = vector.tobytes()
                    name = f"{label.as_py()}\0".encode() + blob
                    keys.append(hashlib.blake2b(name, digest_size=16).digest())
                    vectors.append(blob)
                else:
                    keys.append(None)
                    vectors.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
                ["vec_id", "label", "key", "vector"],
            )

    return run


def _units(blobs: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares of extreme values finite
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def bucket_codes(units: np.ndarray, settings: LshSettings) -> np.ndarray:
    """One 64-bit bucket per vector and table."""
    dim = units.shape[1]
    rng = np.random.Generator(np.random.PCG64([settings.seed, dim]))
    axes = rng.standard_normal((dim, settings.tables * settings.hashes))
    shift = rng.uniform(0, settings.width, settings.tables * settings.hashes)
    cells = np.floor((units @ axes + shift) / settings.width).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(units), settings.tables, settings.hashes)
    codes = np.full(cells.shape[:2], dim, np.uint64) + np.arange(settings.tables, dtype=np.uint64) * np.uint64(1 << 32)
    for i in range(settings.hashes):
        codes = mix(codes ^ mix(cells[:, :, i] + np.uint64(i + 1)))
    return codes


def _hash(settings: LshSettings, kind: str):
    """(bucket, tab, rep, copies, codes, vector), a row per class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch["vector"].to_pylist()
            sizes = np.array([len(b) for b in blobs])
            labels = np.array([hash_label(label) for label in batch["label"].to_pylist()], np.uint64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), 1024):
                    part = at[i : i + 1024]
                    codes = bucket_codes(_units([blobs[j] for j in part], kind), settings)
                    codes = mix(codes ^ mix(labels[part])[:, None])
                    rows = np.repeat(part, settings.tables)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(codes.reshape(-1).view(np.int64)),
                            pa.array(np.tile(np.arange(settings.tables, dtype=np.int32), len(part))),
                            batch["rep"].take(pa.array(rows)),
                            batch["copies"].take(pa.array(rows)),
                            pa.array([codes[j].tobytes() for j in range(len(part)) for _ in range(settings.tables)], pa.binary()),
                            batch["vector"].take(pa.array(rows)),
                        ],
                        ["bucket", "tab", "rep", "copies", "codes", "vector"],
                    )

    return run


def hash_label(label) -> int:
    return int.from_bytes(hashlib.blake2b(str(label).encode(), digest_size=8).digest(), "little")


def _compare(settings: LshSettings, kind: str):
    """One cell of a bucket: (kind, a, b).

    Kind 0 adds b links to every vector of class a; kind 1 is a link of a forest that connects what the
    cell's links connect. A pair that already shared a bucket of an earlier table is counted there.
    """

    def run(cell: pa.Table) -> pa.Table:
        side = cell["side"].to_numpy()
        reps, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
        tab = int(cell["tab"][0].as_py())
        units = _units(cell["vector"].to_pylist(), kind)
        codes = np.frombuffer(b"".join(cell["codes"].to_pylist()), np.uint64).reshape(len(side), -1)[:, :tab]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2 is both
        add = np.zeros(len(side), np.int64)
        root = list(range(len(side)))
        forest = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            near = units[rows] @ units[right].T >= settings.cosine
            a, b = np.nonzero(near)
            a, b = rows[a], right[b]
            once = (reps[a] < reps[b]) if (side == 2).any() else (reps[a] != reps[b])
            a, b = a[once], b[once]
            for t in range(tab):
                fresh = codes[a, t] != codes[b, t]
                a, b = a[fresh], b[fresh]
            np.add.at(add, a, copies[b])
            np.add.at(add, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[p] = q
                    forest.append((reps[x], reps[y]))
        some = np.flatnonzero(add)
        return pa.table(
            {
                "kind": pa.array([0] * len(some) + [1] * len(forest), pa.int32()),
                "a": pa.array([*reps[some].tolist(), *(int(x) for x, _ in forest)], pa.int64()),
                "b": pa.array([*add[some].tolist(), *(int(y) for _, y in forest)], pa.int64()),
            }
        )

    return run


def near_vectors(embeddings: DataFrame, settings: LshSettings = LshSettings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding, label, ...).

    * A null label or vector, a zero or empty vector, and null or non-finite components link with nothing.
    * Vectors of different lengths link with nothing of each other.
    * Rows with the same vec_id are one node, but count as vectors of their own in ``n_links``.
    * A row without vec_id links with nothing. Other columns are not read.
    """
    prepare(embeddings.sparkSession)
    inner = embeddings.schema["embedding"].dataType
    kind = "<f4" if isinstance(inner, ArrayType) and isinstance(inner.elementType, FloatType) else "<f8"
    values = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", values.alias("embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")).cast("string"))
    rows = stored(
        rows.mapInArrow(_classes(kind), "vec_id long, label string, key binary, vector binary"), "vectors"
    )
    classes = stored(
        rows.where("key is not null").groupBy("key").agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"),
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        ),
        "classes",
    )
    hashed = classes.select("label", "vector", "rep", "copies").mapInArrow(
        _hash(settings, kind), "bucket long, tab int, rep long, copies long, codes binary, vector binary"
    )
    shared = hashed.groupBy("bucket", "tab").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = (
        hashed.join(shared, ["bucket", "tab"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")))
    )
    found = stored(
        cells.select("bucket", "tab", "low", "high", "side", "rep", "copies", "codes", "vector")
        .groupBy("bucket", "tab", "low", "high")
        .applyInArrow(_compare(settings, kind), "kind int, a long, b long"),
        "found",
    )
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
    members = rows.select("vec_id", "key").join(classes.select("key", "rep", "copies"), "key", "left")
    edges = found.where("kind = 1").select("a", "b").unionAll(
        members.where("vec_id != rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    )
    named = components(edges).select(F.col("id").alias("vec_id"), "component")
    linked = members.join(counts, "rep", "left").join(named, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id",
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
