"""Reply trees to conversations: enumerate root-to-leaf paths, rank branches, format the chosen path.

Messages point at the message they reply to. Paths are followed by iterative self-joins with doubling
pointers: after round k every message knows the message 2^k replies above it and the score of the
stretch between, so a tree of depth d takes log2(d) joins. The best leaf of each tree is chosen by the
mean score along its path, and the rounds' pointers are walked back from the longest to the shortest to
mark the messages of that path only. Other paths are never written out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.shared import prepare, stored

# The marks of the template.
TURN, BODY, END = "<s>[INST] ", " [/INST]\n", "</s>\n"

_ESCAPE = re.compile(r"[<\[\\]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_CODE = {"<": "\\l", "[": "\\b", "\\": "\\\\", "\n": "\\n"}
_DECODE = {"l": "<", "b": "[", "\\": "\\", "n": "\n", "0": ""}


@dataclass(frozen=True)
class Conversation:
    """A formatted conversation: the text, and (start, end) of what the loss covers, in code points."""

    text: str
    mask: list[tuple[int, int]]


def escape(text: str) -> str:
    """The text without any character that begins a mark of the template."""
    return _ESCAPE.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _DECODE[m[1]], text)


def _role(role: str | None) -> str:
    """Roles stand on the opening line, so line feeds are escaped too; null differs from empty."""
    return "\\0" if role is None else escape(role).replace("\n", "\\n")


def format_turns(turns: list[tuple[str | None, str | None]]) -> Conversation:
    """(role, text) pairs as one text. Null texts are empty. The loss covers what assistants say."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{_role(role)}{BODY}", escape(text or "")
        at += len(head)
        if role == "assistant":
            mask.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return Conversation("".join(parts), mask)


def read_turns(text: str) -> list[tuple[str | None, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns = []
    for part in text.split(TURN)[1:]:
        head, body = part.split(BODY, 1)
        turns.append((None if head == "\\0" else unescape(head), unescape(body.removesuffix(END))))
    return turns


def chosen_paths(messages: DataFrame) -> DataFrame:
    """The messages on the best path of each tree, with ``depth`` (1 at the root).

    ``messages`` has tree, id, parent, score and whatever else. Ids are unique within a tree. A message
    whose parent is null, missing or itself is a root; the best path of a tree is the one whose leaf has the
    highest mean score (null scores count 0), then the longest, then the smallest leaf id. Messages in a
    reply circle have no root and are on no path.
    """
    # Pointers stay narrow; texts are only joined once, at the end.
    own = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = own.select(F.col("tree").alias("t"), F.col("id").alias("up"))
    rows = own.join(ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("up")) & (F.col("parent") != F.col("id")), "left")
    step = stored(rows.select("tree", "id", "up", "score", F.lit(1).cast("bigint").alias("depth")), "replies")
    rounds = [step]
    last = None
    while True:
        above = step.where("up is not null")
        count = above.count()
        if count == 0 or count == last and 2 ** len(rounds) > step.count():  # only circles are left
            break
        last = count
        far = step.select(
            F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("far"),
            F.col("score").alias("more"), F.col("depth").alias("steps"),
        )
        joined = step.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")), "left")
        step = stored(
            joined.select(
                "tree", "id", F.col("far").alias("up"),
                (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
                (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"),
            ),
            "replies",
        )
        rounds.append(step)
    rooted = step.where("up is null")
    parents = rounds[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("i")).distinct()
    leaves = rooted.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    best = leaves.groupBy("tree").agg(
        F.min(F.struct((-F.col("score") / F.col("depth")).alias("rank"), (-F.col("depth")).alias("long"), "id")).alias("best")
    )
    marked = stored(best.select("tree", F.col("best.id").alias("id")), "path")
    for jump in reversed(rounds[:-1]):
        jumps = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        more = marked.join(jumps, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
        marked = stored(marked.unionAll(more.select("tree", F.col("up").alias("id"))).distinct(), "path")
    marked = marked.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    depths = rooted.select("tree", "id", "depth").join(marked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_semi")
    depths = depths.select(F.col("tree").alias("t"), F.col("id").alias("i"), "depth")
    return messages.join(depths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).drop("t", "i")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch["turns"]]
        yield pa.RecordBatch.from_arrays(
            [batch["tree"], pa.array([c.text for c in made], pa.string()),
             pa.array([[{"start": a, "stop": b} for a, b in c.mask] for c in made], pa.list_(span))],
            ["tree", "formatted", "mask"],
        )


def format_conversations(messages: DataFrame) -> DataFrame:
    """(tree, formatted, mask): the best path of each tree as one conversation; see ``chosen_paths``.

    A conversation is one row, so it has to fit one; everything before that is spread over the cluster.
    """
    prepare(messages.sparkSession)
    path = chosen_paths(messages.select("tree", "id", "parent", "score", "role", "text"))
    turns = path.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    kind = messages.schema["tree"].dataType.simpleString()
    return turns.mapInArrow(_format, f"tree {kind}, formatted string, mask array<struct<start:bigint,stop:bigint>>")


def as_replies(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row replies to the one before it.

    Rows of a conversation are ordered by turn, role and text, so repeated turns have a fixed order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("bigint")
    return conversations.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"),
        place.alias("id"),
        F.when(place > 1, place - 1).alias("parent"),
        F.lit(1.0).alias("score"),
        "role",
        "text",
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, mask in zip(batch["formatted"].to_pylist(), batch["mask"].to_pylist()):
            turns = read_turns(formatted)
            said = "".join(f"{role or ''}\n{text}\n" for role, text in turns)
            loss = "".join(unescape(formatted[m["start"] : m["stop"]]) for m in mask)
            rows.append((len(turns), _sha256(said), len(loss), _sha256(loss), len(formatted)))
        columns = list(zip(*rows)) or [[], [], [], [], []]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays(
            [batch["tree"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv_id", *names]
        )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` made, read back from its text and mask."""
    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.mapInArrow(
        _read_back,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )

