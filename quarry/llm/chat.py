"""Chat formatting over reply trees (operator 5).

Messages form trees by parent links.  Iterative self-joins, doubling the distance with each round, give every message
its root and the score sum and length of its path; so depth costs rounds only as its logarithm.  Leaves are the branches
of a tree; they are ranked by score (mean per message, then length, then id), the best ``branches`` of each
root are chosen, and further doubling in reverse enumerates the messages on the chosen paths.  Each message is rendered by
itself; the messages of one path are then brought together in order and streamed into one conversation.

Template (one marked turn per message)::

    user        <s>[INST] text [/INST]
    assistant   ' ' text ' </s>'
    other       <s>[ROLE=role] text [/ROLE]     (an unusual role as % and hex digits)

Where a text holds a control string, a backslash goes in behind its first character (one more where it
already holds some), so control strings never occur inside of turns and reading back restores every text.

Defined results: a null text or role is empty; rows with a null conv_id are one conversation; messages that tie in turn
are ordered by role and text, and rows that repeat are turns each; leaves that tie in score go by length and id; a message
whose parent does not exist is a root; messages on a parent cycle belong to no root and raise an error; texts of any length
are one turn; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import staged, table

_ESCAPE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|ROLE=)")
_PLAIN = re.compile(r"[A-Za-z0-9_-]*")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\]|ROLE=)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(role: str, text: str) -> str:
    t = escape(text)
    if role == "user":
        return f"<s>[INST] {t} [/INST]"
    if role == "assistant":
        return f" {t} </s>"
    name = role if _PLAIN.fullmatch(role) else f"%{role.encode().hex()}"
    return f"<s>[ROLE={name}] {t} [/ROLE]"


def _role(name: str) -> str:
    return bytes.fromhex(name[1:]).decode() if name.startswith("%") else name


def mask(formatted: str) -> list[tuple[int, int]]:
    """Spans of the assistants' texts: where the loss is taken."""
    return [(a, b) for role, a, b in parse(formatted) if role == "assistant"]


def parse(formatted: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of each turn's escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            a, end = at + 10, " [/INST]"
            role = "user"
        elif formatted.startswith("<s>[ROLE=", at):
            close = formatted.index("] ", at)
            role, a, end = _role(formatted[at + 9 : close]), close + 2, " [/ROLE]"
        elif formatted[at] == " ":
            role, a, end = "assistant", at + 1, " </s>"
        else:
            raise ValueError(f"no turn starts at {at}")
        b = formatted.index(end[1:], a) - 1
        out.append((role, a, b))
        at = b + len(end)
    return out


def _paths(nodes: DataFrame) -> DataFrame:
    """(id, root, total, steps) of every node of (id, parent, score), by doubling jumps.

    A round moves and stages only the nodes that have not reached their root; the others stay in the tables of their rounds.
    """
    ids = nodes.select(F.col("id").alias("parent"))
    have = nodes.join(ids.withColumn("there", F.lit(True)), "parent", "left")
    moving = staged(have.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").cast("double").alias("total"), F.lit(1).cast("long").alias("steps"), F.col("id").alias("root")), "chat-jump")
    done, open_before = moving.filter("up is null"), None
    while True:
        moving = moving.filter("up is not null")
        n = moving.count()
        if not n:
            return done.drop("up")
        if open_before == n and moving.join(done.select(F.col("id").alias("up")), "up").isEmpty():
            raise ValueError("messages reply to each other in a cycle")
        open_before = n
        every = done.unionByName(moving)
        far = every.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("steps").alias("s2"), F.col("root").alias("root2"))
        step = moving.join(far, "up").select("id", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("root2").alias("root"))
        moving = staged(step, "chat-jump")
        done = done.unionByName(moving.filter("up is null"))


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(path, id, depth): the messages of each root's best ``branches`` leaves; path is the leaf's id, depth from 1.

    ``nodes`` has id, parent, score; ids are unique, and of any type that can be compared.  Under a root with one leaf all
    messages are on its path; only in the other trees are the paths enumerated by jumps from the leaves.
    """
    info = staged(_paths(nodes), "chat-paths")
    leaves = staged(info.join(nodes.select(F.col("parent").alias("id")).filter("id is not null").distinct(), "id", "left_anti"), "chat-leaves")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "id"))
    single = leaves.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("path")).filter("n = 1").select("root", "path")
    alone = info.join(single, "root").select("path", "id", F.col("steps").alias("depth"))
    forked = leaves.join(single, "root", "left_anti")
    if forked.isEmpty():
        return alone if branches else alone.limit(0)
    best = forked.withColumn("k", rank).filter(F.col("k") <= branches).select(F.col("id").alias("path"), "id", F.col("steps").alias("depth"))
    # Ancestors at distance 2**k; every message found so far adds the one that far above it.
    parents = nodes.join(info.filter("steps > 1").join(single, "root", "left_anti").select("id"), "id").select("id", F.col("parent").alias("up"))
    found, jump = staged(best, "chat-found"), staged(parents, "chat-up")
    distance = 1
    while not found.filter(F.col("depth") > distance).isEmpty():
        above = found.join(jump, "id").select("path", F.col("up").alias("id"), (F.col("depth") - distance).alias("depth"))
        found = staged(found.unionByName(above), "chat-found")
        jump = staged(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")), "chat-up")
        distance *= 2
    return found.unionByName(alone) if branches else found


def format_paths(messages: DataFrame) -> DataFrame:
    """One row per path: path, formatted, n_turns.  ``messages`` has path, at (order in it), role, text.

    Rows are sorted by path within each partition and streamed; memory holds one conversation.
    """

    def run(batches):
        path, parts, out = None, [], ([], [], [])
        for b in batches:
            for p, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if parts and p != path:
                    for x, v in zip(out, (path, "".join(parts), len(parts)), strict=True):
                        x.append(v)
                    parts = []
                path = p
                parts.append(render(role or "", text or ""))
            if len(out[0]) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64())], ["path", "formatted", "n_turns"])
                out = ([], [], [])
        if parts:
            for x, v in zip(out, (path, "".join(parts), len(parts)), strict=True):
                x.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64())], ["path", "formatted", "n_turns"])

    ordered = messages.select("path", "at", "role", "text").repartition("path").sortWithinPartitions("path", "at")
    return ordered.mapInArrow(run, "path long, formatted string, n_turns long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns from formatted conversations: parsed, unescaped, masked."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                turns, loss, loss_chars, n = hashlib.sha256(), hashlib.sha256(), 0, 0
                spans = set(mask(text))
                for role, a, z in parse(text):
                    own = unescape(text[a:z])
                    turns.update(f"{role}\n{own}\n".encode())
                    n += 1
                    if (a, z) in spans:
                        loss.update(own.encode())
                        loss_chars += len(own)
                rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)], names)

    return formatted.select("path", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns) of conversations given as rows by turn: each row replies to the one before it.

    A message's id is its conversation and its number there, so no two share one.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = staged(rows.select("conv_id", "turn", "role", "text").withColumn("at", F.row_number().over(w)), "chat-rows")
    place = lambda at: F.struct("conv_id", at.alias("at"))
    nodes = numbered.select(place(F.col("at")).alias("id"), F.when(F.col("at") > 1, place(F.col("at") - 1)).alias("parent"), F.lit(0.0).alias("score"))
    paths = chosen_paths(nodes).select("id", "depth")
    lines = numbered.withColumn("id", place(F.col("at"))).join(paths, "id").select(F.col("conv_id").alias("path"), F.col("depth").alias("at"), "role", "text")
    return format_paths(lines).withColumnRenamed("path", "conv_id")


def op5_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)).withColumnRenamed("conv_id", "path"))


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|ROLE=)', '\1\\\2\3', 'g') as t from c),
f as (select *, case role when 'user' then '<s>[INST] ' || t || ' [/INST]' when 'assistant' then ' ' || t || ' </s>' else '<s>[ROLE=' || role || '] ' || t || ' [/ROLE]' end as shown from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(length(shown))::bigint as formatted_chars
from f group by conv_id
"""
