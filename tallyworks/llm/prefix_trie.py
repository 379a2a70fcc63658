"""Prefix tries of conversations: what they share, as double-array tries in shards merged into one tree.

Conversations with the same turns form a class. Classes are dealt to shards by a prefix that is as long as it has to
be for a shard's share, so that a first turn that very many conversations have is split by what follows it. A shard
numbers its turns densely, packs its classes into a double array (BASE and CHECK) and walks them through it. Nodes
from the dealing prefix on lie in one shard and are finished there; the few nodes above are merged over all shards.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.shared import built_on, discard, prepare, stored

NO_ENDS = hashlib.sha256(b"").hexdigest()
IDS_PER_PIECE = 4096  # of conversations that end at one node, joined to one text before they are hashed
TRIES_TO_FIT = 256  # free slots tried for the children of one node before the end of the array is taken
OPENING = 8  # turns that a conversation can take over from another


@dataclass(frozen=True)
class TrieSettings:
    #: Turns of distinct conversations in a shard, about; a shard is one task's work and is held in memory.
    shard_turns: int = 250_000
    #: Nodes above the shards that are broadcast to give their children their names; beyond it they are joined.
    broadcast_nodes: int = 500_000


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes) per conversation of ``conversations`` (conv_id, turn, role, text, anything else).

    Turns are ordered by ``turn``, null first, equal ones by role and text; null roles and texts are empty. A key
    names a role and a text by 128 bits of their SHA-256, a size is the UTF-8 bytes of a text. Rows without a conv_id
    belong to no conversation and are left out. A conversation's keys, 40 bytes a turn, fit into a task; its texts
    are sorted, but never gathered.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = rows.select(
        "conv_id",
        place.alias("place"),
        F.substring(F.sha2(named, 256), 1, 32).alias("key"),
        F.octet_length("text").alias("size"),
    )
    whole = F.array_sort(F.collect_list(F.struct("place", "key", "size")))
    return turns.groupBy("conv_id").agg(whole.alias("t")).select(
        "conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes")
    )


def with_openings(sequences: DataFrame) -> DataFrame:
    """Conversations c that open with the first h turns of conversation c - c % 5, in place of their own.

    h is the unsigned CRC-32 of the decimal c, modulo 9; % takes the sign of c. A shorter opening is taken whole,
    an absent one is empty, and a conversation with no more than h turns of its own adds none.
    """
    c = F.col("conv_id")
    taken = (F.crc32(c.cast("string").cast("binary")) % 9).cast("int")
    opening = [F.slice(name, 1, OPENING).alias(f"first_{name}") for name in ("keys", "sizes")]
    others = sequences.select(c.alias("opener"), *opening)
    joined = sequences.withColumns({"h": taken, "opener": c - c % 5}).join(others, "opener", "left")

    def rebuilt(name: str, kind: str) -> Column:
        borrowed = F.slice(F.coalesce(f"first_{name}", F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(borrowed, F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return joined.select("conv_id", rebuilt("keys", "array<string>"), rebuilt("sizes", "array<int>"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of equal sequences in runs of up to ``IDS_PER_PIECE``, comma-joined; rows come in order."""
    names = ["seq", "conv_id", "n", "ids"]
    seq, held = None, []

    def piece() -> tuple:
        return seq, held[0], len(held), ",".join(map(str, held))

    for batch in batches:
        out = []
        for key, conv in zip(batch["seq"].to_pylist(), batch["conv_id"].to_pylist()):
            if held and (key != seq or len(held) >= IDS_PER_PIECE):
                out.append(piece())
                held = []
            seq = key
            held.append(conv)
        yield _records(out, names, [pa.binary(), pa.int64(), pa.int64(), pa.string()])
    yield _records([piece()] if held else [], names, [pa.binary(), pa.int64(), pa.int64(), pa.string()])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence: its smallest id, how many have it, and the hash of all of them; pieces come in order."""
    names, kinds = ["conv_id", "n", "ends"], [pa.int64(), pa.int64(), pa.string()]
    seq = first = total = digest = None
    for batch in batches:
        out = []
        for key, conv, n, ids in zip(*(batch[c].to_pylist() for c in ("seq", "conv_id", "n", "ids"))):
            if key != seq:
                if digest:
                    out.append((first, total, digest.hexdigest()))
                seq, first, total, digest = key, conv, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            total += n
        yield _records(out, names, kinds)
    yield _records([(first, total, digest.hexdigest())] if digest else [], names, kinds)


def _records(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def sequence_classes(sequences: DataFrame) -> DataFrame:
    """(conv_id, n, ends, keys, sizes): distinct sequences under their smallest conv_id, with the count and the hash of
    the comma-joined ids of all conversations that have them.

    Ids meet in range order, so that a sequence with very many is spread; a piece of thousands of ids is one row
    for the task that hashes them, which holds one piece at a time.
    """
    seq = F.unhex(F.sha2(F.array_join("keys", ""), 256))
    members = sequences.select(seq.alias("seq"), "conv_id")
    sorted_ids = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = sorted_ids.mapInArrow(_pieces, "seq binary, conv_id long, n long, ids string")
    in_order = pieces.repartition("seq").sortWithinPartitions("seq", "conv_id")
    return in_order.mapInArrow(_classes, "conv_id long, n long, ends string").join(sequences, "conv_id")


class DoubleArray:
    """A trie over sequences of codes from 1 on. The child of state s by code c is BASE[s] + c, if CHECK there is s."""

    FREE = -1

    def __init__(self, sequences: list[list[int]]):
        """``sequences`` are distinct and sorted."""
        self.base, self.check = array("q", [0]), array("q", [0])
        self.order = [0]  # states, parents first
        self.free = 1  # no slot below is free
        pending = [(0, 0, len(sequences), 0)]
        for state, low, high, depth in pending:  # grows while it is read: breadth first
            if low < high and len(sequences[low]) == depth:
                low += 1  # ends here
            children, at = [], low
            while at < high:
                code, start = sequences[at][depth], at
                while at < high and sequences[at][depth] == code:
                    at += 1
                children.append((code, start, at))
            if not children:
                continue
            base = self._fit([c[0] for c in children])
            self.base[state] = base
            for code, start, stop in children:
                self.check[base + code] = state
                self.order.append(base + code)
                pending.append((base + code, start, stop, depth + 1))
            while self.free < len(self.check) and self.check[self.free] != self.FREE:
                self.free += 1

    def _fit(self, codes: list[int]) -> int:
        """A base that puts all children on free slots; the array grows to hold them."""
        check, slot, size = self.check, self.free, len(self.check)
        for _ in range(TRIES_TO_FIT):
            while slot < size and check[slot] != self.FREE:
                slot += 1
            base = slot - codes[0]
            if all(base + c >= size or check[base + c] == self.FREE for c in codes):
                break
            slot += 1
        else:
            base = size - codes[0]
        more = base + codes[-1] + 1 - size
        if more > 0:
            self.check.extend([self.FREE] * more)
            self.base.extend([0] * more)
        return base

    def path(self, codes: list[int]) -> Iterator[int]:
        """States on the way of a sequence, without the root."""
        state, base, check = 0, self.base, self.check
        for code in codes:
            child = base[state] + code
            if not 0 <= child < len(check) or check[child] != state:
                raise KeyError(codes)
            state = child
            yield state


_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node string, above array<string>, size long"
)


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of a shard's classes (conv_id, n, ends, depth, keys, sizes); ``depth`` is that of the dealing prefix.

    A node from that depth on is whole. A node above comes with the sums over its whole nodes below, its name
    and the names above it; the first whole node on a path has its parent's name.
    """
    table = table.combine_chunks()
    keys = table["keys"].combine_chunks()
    coded = keys.flatten().dictionary_encode()
    spelled, flat = coded.dictionary.to_pylist(), coded.indices.to_pylist()
    sizes = table["sizes"].combine_chunks().flatten().to_pylist()
    convs, counts, ends, depths = (table[c].to_pylist() for c in ("conv_id", "n", "ends", "depth"))
    lengths = keys.value_lengths().to_pylist()
    sequences, at = [], 0
    for i, length in enumerate(lengths):
        sequences.append(([c + 1 for c in flat[at : at + length]], i, at))
        at += length
    sequences.sort(key=lambda x: x[0])
    trie = DoubleArray([codes for codes, _, _ in sequences])

    many = len(trie.check)
    members, least, depth_of, size_of = ([0] * many for _ in range(4))
    ended: list[str | None] = [None] * many
    whole = [False] * many
    name_of: dict[int, str] = {0: ""}
    for codes, i, start in sequences:
        n, conv, dealt, state = counts[i], convs[i], depths[i], 0
        for depth, state in enumerate([0, *trie.path(codes)]):
            least[state] = conv if not members[state] else min(least[state], conv)
            members[state] += n
            if depth and not depth_of[state]:
                depth_of[state] = depth
                size_of[state] = sizes[start + depth - 1]
                whole[state] = depth >= dealt
                if depth < dealt:
                    before = name_of[trie.check[state]] + spelled[codes[depth - 1] - 1]
                    name_of[state] = hashlib.sha256(before.encode()).hexdigest()[:32]
        ended[state] = ends[i]

    children, leaves, saved, tops = ([0] * many for _ in range(4))
    for state in reversed(trie.order):
        if whole[state]:
            saved[state] += (members[state] - 1) * size_of[state]
            leaves[state] += not children[state]
        if state:
            parent = trie.check[state]
            leaves[parent] += leaves[state]
            saved[parent] += saved[state]
            children[parent] += 1
            tops[parent] += whole[state]

    above: dict[int, list[str]] = {0: []}
    out = []
    for state in trie.order:
        parent = trie.check[state]
        if whole[state]:
            top = not whole[parent]
            row = (None if top else least[parent], members[state], children[state], leaves[state], saved[state], ended[state])
            row += (None, [name_of[parent]] if top else None, None)
        else:
            if state:
                above[state] = [*above[parent], name_of[parent]]
            row = (None, members[state], tops[state], leaves[state], saved[state], ended[state])
            row += (name_of[state], above[state], size_of[state])
        out.append((least[state], depth_of[state], *row))
    names = [c.split()[0] for c in _NODE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    return pa.Table.from_batches([_records(out, names, [kinds[c.split()[1]] for c in _NODE.split(", ")])])


def _dealt(classes: DataFrame, settings: TrieSettings) -> DataFrame:
    """Classes with the depth of their dealing prefix and their shard.

    Prefixes of 1, 2, 4, ... turns are weighed by the turns of the classes that have them. A class is dealt by its
    shortest prefix that weighs no more than a quarter of a shard's share, or that it has alone; if it has no such
    prefix, by itself, as all its nodes then lie above.
    """
    marks = F.expr("transform(sequence(0, 30), i -> if(shiftleft(1, i) <= size(keys), xxhash64(slice(keys, 1, shiftleft(1, i))), null))")
    marked = stored(
        classes.select("conv_id", F.filter(marks, lambda x: x.isNotNull()).alias("marks"), (F.size("keys") + 1).alias("turns")),
        "marks",
    )
    total = marked.agg(F.sum("turns")).first()[0] or 0
    each = marked.select("conv_id", "turns", F.explode("marks").alias("mark"))
    weighed = each.groupBy("mark").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"))
    heavy = stored(weighed.where((F.col("turns") > settings.shard_turns // 4) & (F.col("n") > 1)).select("mark"), "heavy")
    if heavy.isEmpty():
        deals = marked.withColumn("level", F.lit(0))
    else:
        levels = each.join(heavy, "mark", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("level"))
        deals = marked.join(levels, "conv_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    own = F.xxhash64("conv_id")
    shards = max(1, -(-total // settings.shard_turns))
    deals = stored(
        deals.select(
            "conv_id",
            F.pow(F.lit(2.0), F.col("level")).cast("bigint").alias("depth"),
            F.pmod(F.coalesce(F.get("marks", F.col("level")), own), F.lit(shards)).alias("shard"),
        ),
        "deals",
    )
    discard(marked, heavy)
    return deals


def trie_nodes(sequences: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """One row per node of the trie over ``sequences`` (conv_id, keys, sizes; ids are unique).

    A node is a distinct sequence of first turns, from the root without any. Columns: conv_id, the smallest of the
    members (the conversations that begin so); depth; parent_conv_id, the parent's conv_id (null for the root);
    n_convs, members; n_children; n_leaves, childless nodes in its subtree, itself included; saved_tokens, the bytes
    that sharing spares: (n_convs - 1) times the bytes of the last turn, summed over the subtree; ends_sha256, the
    SHA-256 of the comma-joined ids of members that end here, in ascending order. (conv_id, depth) is a key, since
    nodes of one depth have no member in common. A conversation without turns is a member of the root; no
    conversations give no nodes.
    """
    spark = sequences.sparkSession
    prepare(spark)
    sequences = stored(sequences, "sequences")
    classes = stored(sequence_classes(sequences), "classes")
    deals = _dealt(classes, settings)
    nodes = stored(classes.join(deals, "conv_id").groupBy("shard").applyInArrow(_shard, _NODE), "nodes")
    discard(sequences, classes, deals)

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.first(c).alias(c) for c in ("depth", "above", "size")]
    upper = nodes.where("node is not null").groupBy("node")
    upper = stored(upper.agg(F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *sums, *same), "upper")
    names = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    if upper.count() <= settings.broadcast_nodes:
        names = F.broadcast(names)

    inner = upper.withColumn("parent", F.get("above", F.size("above") - 1))
    merged = inner.groupBy("parent").agg(F.count(F.lit(1)).alias("inner")).where("parent is not null")
    merged = inner.join(merged.withColumnRenamed("parent", "node"), "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))
    )
    # What a merged node is itself counts for it and for every node above it.
    own = merged.select(
        F.explode(F.concat("above", F.array("node"))).alias("node"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("spared"),
    )
    own = own.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("spared").alias("spared"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    merged = merged.join(own, "node").join(names, "parent", "left").withColumns(
        {"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("spared")}
    )
    first = nodes.where("node is null and above is not null").drop("parent_conv_id")
    first = first.withColumn("parent", F.get("above", F.lit(0))).join(names, "parent")
    rest = nodes.where("node is null and above is null")
    found = merged.select(*shown).unionAll(first.select(*shown)).unionAll(rest.select(*shown))
    return built_on(found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), nodes, upper)


def conversation_trie(conversations: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """``trie_nodes`` of conversations (conv_id, turn, role, text) as they are, with each node's last role and text."""
    nodes = trie_nodes(turn_sequences(conversations), settings)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    turns = rows.select("conv_id", place.cast("bigint").alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")
