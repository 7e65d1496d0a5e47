"""Chat formatting as prefix trees: conversations that begin alike share their first turns.

A turn is written ``### role: text</turn>\\n``.  Inside roles and texts a backslash goes before each backslash, before
each ``#`` that begins ``###``, and before the ``<`` of ``</turn>`` (in roles before colons too), so control strings never
stand in them bare and the escapes can be undone.

Conversations are sorted by their turns (by hash, then by id) over all tasks, which is the depth-first
order of the tree of all conversations.  Each task walks its range with a stack: a conversation emits only the turns
after those it shares with the one before it.  A tree ends when its first turn does, when its task's range does, or when it
holds tree_units; the next then writes the shared turns again.  So a first turn, or a conversation, that a third of all rows share is
spread over many trees of bounded size.

Every node has its place in the tree's sequence, the position of its first unit in its conversation (what a model's position
ids count), and the intervals of the sequence that it attends to: those of its ancestors.  Units are code points, or tokens where a
tokenizer is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import text_buffer
from quillspark.llm.pretokens import encoder
from quillspark.session import ready, written

TREE_UNITS = 1 << 20
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPE_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<#]|\\.|<(?!/turn>)|#(?!##))*)</turn>\n", re.DOTALL)

TREE_SCHEMA = "tree long, seq long, node int, parent int, text string, ids array<int>, start long, length long, position long, loss_start int, loss_end int, attends array<struct<a: long, b: long>>, ends boolean, conv_id long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the place of its (escaped) text in it."""
    head = "### " + _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the place of the escaped text, of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def prefix_trees(rows: DataFrame, tree_units: int = TREE_UNITS, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Writes the trees and returns them: a row per node, in depth-first order of seq, and one (ends) per
    conversation, after its last node.

    Turns of a conversation are ordered by turn, then role, then text. Null texts and roles are empty; rows with a null conversation
    are one conversation. Equal conversations share all nodes and keep their own end rows.
    """
    spark = ready(rows.sparkSession)
    named = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = named.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t.role, t.text))
    sorted_rows = whole.select("conv_id", "turns", path.alias("path")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "conv_id").sortWithinPartitions("path", "conv_id").drop("path")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = (TaskContext.get().partitionId() << 32) - 1
        stack: list[dict] = []
        seq = nodes = size = 0
        enc = encoder(tokenizer) if tokenizer else None
        for batch in batches:
            out: list[tuple] = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                shared = 0
                while shared < min(len(stack), len(turns)) and stack[shared]["turn"] == turns[shared]:
                    shared += 1
                if not shared or size >= tree_units:
                    tree, seq, nodes, size, shared = tree + 1, 0, 0, 0, 0
                del stack[shared:]
                for role, text in turns[shared:]:
                    formatted, a, b = turn(role, text)
                    ids = None
                    if enc:
                        ids = enc.encode(*text_buffer(pa.array([formatted])))[0].tolist()
                    length = len(formatted) if ids is None else len(ids)
                    up = stack[-1] if stack else None
                    attends: list[tuple[int, int]] = []
                    if up:  # the ancestors' intervals, joined where they touch
                        attends = list(up["attends"])
                        own = (up["start"], up["start"] + up["length"])
                        if attends and attends[-1][1] == own[0]:
                            attends[-1] = (attends[-1][0], own[1])
                        else:
                            attends.append(own)
                    node = {"turn": (role, text), "node": nodes, "start": size, "length": length, "position": up["position"] + up["length"] if up else 0, "attends": attends}
                    loss = (a, b) if role == LOSS_ROLE else (0, 0)
                    out.append((tree, seq, nodes, up["node"] if up else -1, formatted, ids, size, length, node["position"], *loss, [{"a": x, "b": y} for x, y in attends], False, None))
                    stack.append(node)
                    seq, nodes, size = seq + 1, nodes + 1, size + length
                last = stack[-1]["node"] if stack else -1
                out.append((tree, seq, last, None, None, None, size, 0, None, None, None, None, True, conv))
                seq += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.bool_(), pa.int64())
            names = [x.split()[0] for x in re.split(r", (?![^<]*>)", TREE_SCHEMA)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    return written(sorted_rows.mapInArrow(build, TREE_SCHEMA), "trees")


def read_conversations(trees: DataFrame) -> DataFrame:
    """What a reader of the trees finds for each conversation: conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (unescaped texts under the loss mask), and formatted_chars.

    A tree has a bounded size, so dealing rows by tree is even whatever conversations share.
    """
    lean = trees.select("tree", "seq", "node", "parent", "text", "loss_start", "loss_end", "ends", "conv_id")
    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lean = lean.repartition(n, "tree").sortWithinPartitions("tree", "seq")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, str, int, int]] = []
        at = None
        for batch in batches:
            out: list[tuple] = []
            for tree, _, node, parent, text, a, b, ends, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tree != at:
                    stack, at = [], tree
                if not ends:
                    while stack and stack[-1][0] != parent:
                        stack.pop()
                    stack.append((node, text, a, b))
                    continue
                while stack and stack[-1][0] != node:
                    stack.pop()
                formatted = "".join(s[1] for s in stack)
                turns = parse(formatted)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest()
                loss = "".join(unescape(s[1][s[2] : s[3]]) for s in stack)
                out.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return lean.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def attention(trees_rows: list[dict]) -> np.ndarray:
    """The mask (row attends to column) of one tree's sequence, from its node rows; for tests and small trees."""
    nodes = [r for r in trees_rows if not r["ends"]]
    n = max((r["start"] + r["length"] for r in nodes), default=0)
    mask = np.zeros((n, n), bool)
    for r in nodes:
        a, b = r["start"], r["start"] + r["length"]
        for x in r["attends"]:
            mask[a:b, x["a"] : x["b"]] = True
        mask[a:b, a:b] = np.tri(b - a, dtype=bool)
    return mask
