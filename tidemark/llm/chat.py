"""Chat formatting of reply trees: ranked root-to-leaf paths, a reversible template and its loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, session

#: Control strings of the template; inside texts and roles they are escaped.
CONTROLS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE]", "[/ROLE]")
#: Opening and closing control string of the known roles.
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|<s> (?P<assistant>.*?) </s>|\[ROLE\] (?P<role>.*?) \[/ROLE\] \[INST\] (?P<other>.*?) \[/INST\]",
    re.DOTALL,
)
#: Doublings of the path length; trees deeper than 2**MAX_DOUBLINGS don't occur in bigint ids.
MAX_DOUBLINGS = 62


def escape(text: str | None) -> str:
    """Double backslashes, and put one behind the first character of a control string; null counts as empty."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """One conversation and its loss mask: the spans (code points) of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        name, body = role or "", escape(text)
        if name in TURNS:
            head, tail = TURNS[name][0] + " ", " " + TURNS[name][1]
        else:
            head, tail = f"[ROLE] {escape(name)} [/ROLE] [INST] ", " [/INST]"
        if name == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + tail)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside turns at {at}")
        at = m.end()
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    if at != len(formatted):
        raise ValueError(f"text outside turns at {at}")
    return turns


def join_in_tree(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on (tree, key); a null tree is a tree like any other."""
    other = right.withColumnsRenamed({"tree": "_tree", key: "_key"})
    return left.join(other, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(key) == F.col("_key")), how).drop("_tree", "_key")


def linear_trees(turns: DataFrame, tree: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Conversations as trees of one branch: node numbers follow the turns, each replies to the one before.

    Equal turns are ordered by role and text, so repeated rows are turns of
    their own. Turns without an id form one conversation. Returns tree, node, parent, role, text, score (0).
    """
    place = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    return turns.select(F.col(tree).cast("long").alias("tree"), place.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def ranked_paths(nodes: DataFrame, scratch: Scratch, keep: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees, ranked by score: tree, rank, pos (0 at the root), node.

    ``nodes``: tree, node, parent, score. Self-joins double the distance that a
    node's pointer covers until every pointer has reached its root; a node then
    knows its depth and its branch's score (the sum over the path, null as 0).
    Leaves are ranked by score, then depth, then node; the ``keep`` best of each
    tree stay (null: all). Their paths are read off the written pointer tables
    from the longest jump to the shortest, so the output is as long as the
    chosen paths and no node ever carries its whole path.

    A parent that isn't in the tree makes a root. Nodes whose tree is null are one
    tree. Nodes on a cycle, or below
    one, have no root and so no path. Rows that repeat (tree, node) should be
    made distinct before.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    base = join_in_tree(nodes, known.withColumn("found", F.lit(True)), "parent", "left")
    at = scratch.put(
        base.select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth")),
        "jump-0",
    )
    jumps = [at]
    ended = at.where("up is null")
    open_ = at.where("up is not null").count()
    while open_ and len(jumps) <= MAX_DOUBLINGS:
        # only nodes that still look for their root are joined; the others are looked up
        todo = at.where("up is not null")
        far = ended.unionByName(todo).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        wide = join_in_tree(todo, far, "up")
        at = scratch.put(wide.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), f"jump-{len(jumps)}")
        ended = ended.unionByName(at.where("up is null"))
        left = at.where("up is not null").count()
        jumps.append(at)
        if left == open_:  # no node has its root in this distance, so none has one farther up: cycles are left
            break
        open_ = left
    leaves = join_in_tree(ended, jumps[0].where("up is not null").select("tree", F.col("up").alias("node")), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))
    best = leaves.withColumn("rank", rank)
    if keep is not None:
        best = best.where(F.col("rank") <= keep)
    path = scratch.put(best.select("tree", "rank", "node", (F.col("depth") - 1).alias("pos")), f"path-{len(jumps)}")
    for k in range(len(jumps) - 1, -1, -1):
        hop = jumps[k].where("up is not null").select("tree", "node", "up")
        more = join_in_tree(path, hop, "node").select("tree", "rank", F.col("up").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))
        path = scratch.put(path.unionByName(more), f"path-{k}")
        scratch.drop(f"path-{k + 1}", f"jump-{k}")
    return path


def format_trees(nodes: DataFrame, scratch: Scratch, keep: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, rank, n_turns, formatted, loss_spans.

    ``nodes``: tree, node, parent, score, role, text; other columns are
    ignored. A conversation is one string, so its turns meet in one row; nothing
    else is gathered. An empty table gives an empty result.
    """
    session(nodes)
    nodes = nodes.select("tree", "node", "parent", "score", "role", "text")
    paths = ranked_paths(nodes, scratch, keep)
    turns = join_in_tree(paths, nodes.select("tree", "node", "role", "text"), "node")
    whole = turns.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, rank, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, spans = render([(t["role"], t["text"]) for t in turns])
                rows.append({"tree": tree, "rank": rank, "n_turns": len(turns), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("tree", pa.int64()), ("rank", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(span))])
    return whole.select("tree", "rank", "turns").mapInArrow(form, "tree long, rank int, n_turns int, formatted string, loss_spans array<struct<start: int, end: int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row each.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn),
    loss_chars and loss_sha256 (of all unescaped text under the loss mask),
    formatted_chars. Everything is taken from the formatted string and its mask.
    """
    session(formatted)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
