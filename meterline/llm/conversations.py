"""Conversation structure repair: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

Damage and the faults of rows are plain Spark SQL. The repair runs once per conversation, in a pass over rows that Spark has
hash-partitioned by ``conv_id`` and sorted within partitions; a conversation is streamed row by row, never gathered as a group.

The repair is a forward dynamic programme over the rows with four states (nothing yet, after s, after u, after a). Every cell
keeps its cheapest path; equal costs are settled by the ASCII order of the edit initials. Paths are persistent: each edit is a
node that points to the path before it, so that paths share their prefixes. A node carries its depth, a rolling hash of its
prefix and ancestors at powers of two, so two paths are compared by finding their longest common prefix with binary lifting;
a hash match between different nodes is checked letter by letter before it is believed.

Edits and costs:
  K keep (0), R rerole to user or assistant (3), D delete (4, the only edit for blank and duplicate rows),
  I insert an empty user or assistant row anywhere (3); a truncated row that is kept or rerolled adds 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table

# Fixed values of the contract.
DAMAGE_FOLDS = 20  # crc32(`conv_id:turn`) % 20: 0 drop, 1 empty text, 2 remove [.!?], 3 repeat, 4 role user
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ENDINGS = ".!?"
SPACES = " \t\n\x0b\x0c\r"

START, AFTER_S, AFTER_U, AFTER_A = range(4)
ACCEPTING = (START, AFTER_A)
#: state, emitted role initial -> next state
MOVES = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLE_OF = {"s": "system", "u": "user", "a": "assistant"}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
MOD = (1 << 61) - 1
BASE = 1_000_003

OUT = (
    "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


class Node:
    """One edit after the path ``parent``; the role it emits (or None) and the text of the row it keeps."""

    __slots__ = ("parent", "letter", "depth", "hash", "up", "role", "text")

    def __init__(self, parent: Node | None, letter: str, role: str | None = None, text: str | None = None):
        self.parent, self.letter, self.role, self.text = parent, letter, role, text
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MOD
        up = [parent]
        while len(up) <= len(up[-1].up) and up[-1].up:
            up.append(up[-1].up[len(up) - 1])
        self.up = up

    def ancestor(self, depth: int) -> Node:
        node, climb, k = self, self.depth - depth, 0
        while climb:
            if climb & 1:
                node = node.up[k]
            climb >>= 1
            k += 1
        return node

    def edits(self) -> list[Node]:
        path, node = [], self
        while node.parent is not None:
            path.append(node)
            node = node.parent
        return path[::-1]


def _same(a: Node, b: Node) -> bool:
    """Equal prefixes: the same node, or equal hashes confirmed letter by letter up to a shared node."""
    if a is b:
        return True
    if a.hash != b.hash or a.depth != b.depth:
        return False
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.parent, b.parent
    return True


def compare(a: Node, b: Node) -> int:
    """-1, 0 or 1 as the edit string of ``a`` is ASCII-less than, equal to or greater than that of ``b``."""
    short = min(a.depth, b.depth)
    x, y = a.ancestor(short), b.ancestor(short)
    if not _same(x, y):
        # climb while the ancestors differ; then their parents agree and the letters below them decide
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and k < len(y.up) and not _same(x.up[k], y.up[k]):
                x, y = x.up[k], y.up[k]
        while not _same(x.parent, y.parent):  # only after a hash collision higher up
            x, y = x.parent, y.parent
        return -1 if x.letter < y.letter else 1
    return (a.depth > b.depth) - (a.depth < b.depth)


def initial(role: str | None) -> str:
    return role[:1] if role else " "


def is_blank(text: str) -> bool:
    return not text.strip(SPACES)


def is_truncated(text: str) -> bool:
    stripped = text.rstrip(SPACES)
    return not stripped or stripped[-1] not in ENDINGS


def repair(rows: Iterable[tuple[str, str]]) -> dict:
    """Faults and the cheapest repair of one conversation given as damaged (role, text) rows in order.

    Nulls are one space. Each row has at most one fault, the first of blank, duplicate (same role and text on an earlier
    row), truncated (the last non-space character is not one of ``.!?``). ``illegal`` counts adjacent role initials that
    are not su, ua or au. No rows: zeros, an empty audit and the hash of the empty string.
    """
    seen: set[tuple[str, str]] = set()
    counts = {"n_rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    root = Node(None, "")
    cells: list[tuple[int, Node] | None] = [(0, root), None, None, None]
    before = None

    def offer(into: list, state: int, cost: int, node: Node) -> None:
        held = into[state]
        if held is None or cost < held[0] or (cost == held[0] and compare(node, held[1]) < 0):
            into[state] = (cost, node)

    def inserts(into: list) -> None:
        # an insert never pays for itself twice in a row: two passes reach every useful chain
        for _ in range(2):
            for state in range(4):
                if into[state] is not None:
                    cost, node = into[state]
                    for role in "ua":
                        if (state, role) in MOVES:
                            offer(into, MOVES[(state, role)], cost + INSERT, Node(node, "I", ROLE_OF[role], ""))

    inserts(cells)
    for role, text in rows:
        role = " " if role is None else role
        text = " " if text is None else text
        counts["n_rows"] += 1
        mark = initial(role)
        if before is not None and before + mark not in ("su", "ua", "au"):
            counts["illegal"] += 1
        before = mark
        fault = None
        if is_blank(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif is_truncated(text):
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        extra = TRUNCATED if fault == "truncated" else 0
        nxt: list = [None] * 4
        for state in range(4):
            if cells[state] is None:
                continue
            cost, node = cells[state]
            offer(nxt, state, cost + DELETE, Node(node, "D"))
            if fault in ("blank", "duplicate"):
                continue
            if mark in ROLE_OF and (state, mark) in MOVES:
                offer(nxt, MOVES[(state, mark)], cost + KEEP + extra, Node(node, "K", role, text))
            for to in "ua":
                if (state, to) in MOVES:
                    offer(nxt, MOVES[(state, to)], cost + REROLE + extra, Node(node, "R", ROLE_OF[to], text))
        inserts(nxt)
        cells = nxt
    best = None
    for state in ACCEPTING:
        if cells[state] is not None and (best is None or cells[state][0] < best[0] or
                                         (cells[state][0] == best[0] and compare(cells[state][1], best[1]) < 0)):
            best = cells[state]
    cost, node = best
    edits = node.edits()
    repaired = "\n".join(f"{e.role}:{e.text}" for e in edits if e.role is not None)
    return counts | {
        "cost": cost,
        "audit": "".join(e.letter for e in edits),
        "repaired_sha256": hashlib.sha256(repaired.encode("utf-8")).hexdigest() if counts["n_rows"] else EMPTY_SHA,
    }


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with the fold of each original row; nulls in the key are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key) % DAMAGE_FOLDS).alias("_fold"),
    )
    f = F.col("_fold")
    rows = rows.filter(f != 0).select(
        "conv_id", "turn",
        F.when(f == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(f == 1, F.lit("")).when(f == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def _value(x):
    return None if pd.isna(x) else int(x)


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by conversation and order; one conversation at a time is repaired as they stream past."""
    out: list[dict] = []
    current, turns, members, started = None, [], [], False

    def close() -> None:
        seen = [t for t in turns if t is not None]
        gaps = max(seen) - min(seen) + 1 - len(set(seen)) if seen else 0
        out.append({"conv_id": current, "gaps": gaps} | repair(members))

    for batch in batches:
        for conv, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
            conv = _value(conv)
            if started and conv != current:
                close()
                turns, members = [], []
                if len(out) >= 1000:
                    yield pd.DataFrame(out)
                    out = []
            current, started = conv, True
            turns.append(_value(turn))
            members.append((role, text))
    if started:
        close()
    if out:
        yield pd.DataFrame(out)


def repairs(conversations: DataFrame) -> DataFrame:
    """Per original ``conv_id`` (null is one conversation): faults, gaps, illegal pairs, cost, audit and repaired hash.

    Rows are ordered by turn (nulls first), then role and text, so rows of one turn are in a fixed order; copies made by
    damage are neighbours. A conversation whose rows were all dropped comes back with zeros, an empty audit and the hash of
    the empty string. Columns other than conv_id, turn, role and text are ignored.
    """
    ready(conversations.sparkSession)
    rows = damaged(conversations)
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    done = ordered.mapInPandas(_repaired, OUT)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zeros = {c: F.lit(0).cast("long") for c in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    joined = ids.join(done, ids["conv_id"].eqNullSafe(done["conv_id"]), "left").select(
        ids["conv_id"],
        *[F.coalesce(done[c], v).alias(c) for c, v in zeros.items()],
        F.coalesce(done["audit"], F.lit("")).alias("audit"),
        F.coalesce(done["repaired_sha256"], F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
    return joined


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_rows")
