"""Chat formatting of reply trees.

Messages point at the message they answer.  Iterative self-joins, each doubling the distance that
a pointer spans, give every message its root, depth and total score in a logarithmic number of
rounds.  Leaves are ranked within their conversation by the mean score of their branch, and only
the chosen leaves are followed back to the root, again by the doubled pointers, so branches that
are not chosen are never expanded.  Joins use conversation and message together as the key, which
spreads a conversation with any share of the rows over many tasks.

Template.  ``<s>`` starts a conversation.  A user turn is ``[INST] text [/INST]``, a system turn
``[SYS] text [/SYS]``, an assistant turn ``[ANS] text </s>``, another role ``[ROLE] name [AS] text
[/ROLE]``.  In texts and names a backslash becomes two, and the first character of a control
string gets a backslash in front, so marks and texts can be told apart and read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwave.llm.common import stored

#: Fixed values of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[AS]", "[/ROLE]")
_ESCAPE = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})" for c in CONTROL))
_MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[ANS] ", " </s>")}
_TURN = re.compile(r"\[(INST|SYS|ANS)\] |\[ROLE\] ")
_KIND = {"INST": "user", "SYS": "system", "ANS": "assistant"}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """One turn, and where its escaped text lies in it."""
    role = role or ""
    if role in _MARKS:
        before, after = _MARKS[role]
    else:
        before, after = f"[ROLE] {escape(role)} [AS] ", " [/ROLE]"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def _mark(text: str, mark: str, start: int) -> int:
    """The first place of a mark that is not escaped (an odd number of backslashes escapes)."""
    at = text.index(mark, start)
    while True:
        slashes = at
        while slashes > start and text[slashes - 1] == "\\":
            slashes -= 1
        if (at - slashes) % 2 == 0:
            return at
        at = text.index(mark, at + 1)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end enclose the escaped text."""
    if not formatted.startswith("<s>"):
        raise ValueError("not a formatted conversation")
    turns, at = [], len("<s>")
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        if head is None:
            raise ValueError(f"no turn starts at {at}")
        start = head.end()
        role = _KIND.get(head.group(1) or "")
        if role is None:
            name_end = _mark(formatted, "[AS] ", start)
            role = unescape(formatted[start : name_end - 1])
            start, close = name_end + len("[AS] "), "[/ROLE]"
        else:
            close = _MARKS[role][1][1:]
        stop = _mark(formatted, close, start)
        turns.append((role, unescape(formatted[start : stop - 1]), start, stop - 1))
        at = stop + len(close)
    return turns


def chosen_paths(messages: DataFrame, per_conversation: int = 1) -> DataFrame:
    """(conv_id, path, depth, node) of the best branches, ``path`` counting from 1.

    ``messages`` has conv_id, node, parent (null or unknown: a root) and score.  Ties go to the
    smaller leaf.  Nodes are unique within a conversation.  A cycle of replies is an error.
    """
    base = stored(messages.select("conv_id", "node", "parent", "score"), "messages")
    same = base.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    known = base.join(
        same, (base["conv_id"] == same["c"]) & (base["parent"] == same["n"]), "left"
    ).select("conv_id", "node", F.col("n").alias("up"), F.lit(0).alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    level = stored(known.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0)), "levels")
    first, jumps, count = level, [], base.count()
    while True:
        active = level.where("up is not null")
        if active.isEmpty():
            break
        if 1 << len(jumps) > 2 * max(count, 1):
            raise ValueError("the replies form a cycle")
        jumps.append(active.select("conv_id", "node", "up"))
        far = level.select(
            F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2")
        )
        joined = active.join(far, (active["conv_id"] == far["c"]) & (active["up"] == far["n"]))
        moved = joined.select(
            "conv_id", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
            (F.col("total") + F.col("t2")).alias("total"),
        )
        # rows whose pointer has reached the root are only copied
        level = stored(moved.unionByName(level.where("up is null")), "levels")
    answered = first.where("up is not null").select("conv_id", F.col("up").alias("node")).distinct()
    leaves = level.join(answered, ["conv_id", "node"], "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), "node")
    ranked = leaves.withColumn("path", F.row_number().over(best)).where(F.col("path") <= per_conversation)
    onto = stored(ranked.select("conv_id", "path", "node"), "path")
    for jump in reversed(jumps):
        more = onto.join(jump, ["conv_id", "node"]).select("conv_id", "path", F.col("up").alias("node"))
        onto = stored(onto.unionByName(more), "path")  # a short plan for the next doubling
    return onto.distinct().join(level.select("conv_id", "node", "depth"), ["conv_id", "node"]).select("conv_id", "path", "depth", "node")


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per chosen path: conv_id, path, formatted (the conversation) and loss (spans of
    assistant texts in it).

    ``texts`` has conv_id, node, role and text.  Turns are dealt by conversation and path, sorted,
    and rendered as they stream by; a task holds one conversation's text at a time.
    """
    rows = paths.join(texts, ["conv_id", "node"]).select("conv_id", "path", "depth", "role", "text")
    dealt = rows.repartition("conv_id", "path").sortWithinPartitions("conv_id", "path", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, loss, at = None, [], [], 0
        done: list[tuple] = []

        def table() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int32()),
                    pa.array([d[2] for d in done], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in d[3]] for d in done], kind),
                ],
                names=["conv_id", "path", "formatted", "loss"],
            )

        for batch in batches:
            for conv, path, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "role", "text"))):
                if (conv, path) != key:
                    if key is not None:
                        done.append((*key, "".join(pieces), loss))
                    key, pieces, loss, at = (conv, path), ["<s>"], [], len("<s>")
                turn, start, end = render(role, text or "")
                if role == "assistant":
                    loss.append((at + start, at + end))
                pieces.append(turn)
                at += len(turn)
            if done:
                yield table()
                done = []
        if key is not None:
            done.append((*key, "".join(pieces), loss))
            yield table()

    return dealt.mapInArrow(run, "conv_id long, path int, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what a parser finds in formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body, _, _ in turns)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                for column, value in zip(
                    out, (len(turns), _sha(said), len(learnt), _sha(learnt), len(text))
                ):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [batch.column("conv_id"), batch.column("path")] + [pa.array(x, t) for x, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["conv_id", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )

    return formatted.select("conv_id", "path", "formatted", "loss").mapInArrow(
        run, "conv_id long, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def turns_as_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and texts of a table of linear conversations (conv_id, turn, role, text).

    A message answers the one before it.  Rows of a conversation that share a turn follow each
    other by role and text, nulls first; a null turn comes first.  Rows without a conv_id belong
    to no conversation and are left out.  A null text is empty, a null role an empty name.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    texts = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    numbered = stored(texts.withColumn("node", F.row_number().over(order)).drop("turn"), "turns")
    parent: Column = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("conv_id", "node", parent.alias("parent"), F.lit(0.0).alias("score")), numbered
