"""Conversation structure repair: the cheapest edits that give a system row at most and then user and assistant by turns.

Each conversation's rows come to one streaming fold in order of their turns. The fold keeps the cheapest edit string for each state of the role grammar
as a linked node, so that strings share their prefixes; strings of equal cost are compared at the end of their longest common prefix.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.cluster import unused

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: States of the grammar (s?(ua)+)?: nothing yet, after the system row, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a rerole or insert gives in each state, and the state after it.
EXPECTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = frozenset(("su", "ua", "au"))
#: Rows after which the common prefix of all live strings is settled and let go.
SETTLE = 256

RESULT = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, repaired_sha256 string"


class Audits:
    """Edit strings as linked nodes: a node has its letter, its length, a rolling hash of its string and its ancestors at powers of two."""

    MOD, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.BASE + ord(letter)) % self.MOD)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same string: letter by letter up to the node that they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def text(self, node: int, above: int = 0) -> str:
        """The string of a node, from below its ancestor ``above`` on."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``; equal hashes are verified, and a collision is settled by the whole strings."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.same(x, y) else self.text(a) < self.text(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]

    def shared(self, nodes: list[int]) -> int:
        """The deepest node above, or equal to, all of ``nodes``."""
        depth = min(self.depth[n] for n in nodes)
        nodes = [self.ancestor(n, depth) for n in nodes]
        while any(n != nodes[0] for n in nodes):
            nodes = [self.up[n][0] for n in nodes]
        return nodes[0]


class Repair:
    """The fold of one conversation: rows go in by :meth:`add`, in order; :meth:`result` ends it."""

    def __init__(self) -> None:
        self.audits, self.live = Audits(), {START: (0, 0)}
        self.rows, self.waiting, self.audit = 0, deque(), []
        self.state, self.written, self.sha = START, False, hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        body = text.rstrip(BLANK)
        must_go = not body or seen
        cut = not must_go and body[-1] not in ".!?"
        self.blank += not body
        self.duplicate += bool(body) and seen
        self.truncated += cut
        if self.last is not None:
            self.illegal += self.last + role[:1] not in LEGAL
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self._insert()
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.live.items():
            self._offer(after, state, cost + COSTS[DELETE], node, DELETE)
            if not must_go:
                kept = MOVES.get((state, role[:1]))
                if kept is not None:
                    self._offer(after, kept, cost + COSTS[KEEP] + TRUNCATED_COST * cut, node, KEEP)
                self._offer(after, EXPECTED[state][1], cost + COSTS[REROLE] + TRUNCATED_COST * cut, node, REROLE)
        self.live = after
        self.waiting.append((role, text))
        self.rows += 1
        if self.rows % SETTLE == 0:
            self._settle()

    def _offer(self, into: dict, state: int, cost: int, parent: int, letter: str) -> None:
        """Take an edit string of a state where it costs less than the one at hand, or as much and comes first."""
        have = into.get(state)
        if have is None or cost < have[0]:
            into[state] = (cost, self.audits.add(parent, letter))
        elif cost == have[0]:
            node = self.audits.add(parent, letter)
            if self.audits.less(node, have[1]):
                into[state] = (cost, node)

    def _insert(self) -> None:
        """Inserts at this place: one leads to user or assistant, two to assistant; more come back to where they were."""
        for target in (USER, ASSISTANT):
            for state, (cost, node) in list(self.live.items()):
                if EXPECTED[state][1] == target:
                    self._offer(self.live, target, cost + COSTS[INSERT], node, INSERT)

    def _settle(self) -> None:
        """Write out what all live strings begin with, and keep only the rest of each."""
        top = self.audits.shared([node for _, node in self.live.values()])
        rest = {state: (cost, self.audits.text(node, top)) for state, (cost, node) in self.live.items()}
        self._apply(self.audits.text(top))
        self.audits = Audits()
        for state, (cost, letters) in rest.items():
            node = 0
            for letter in letters:
                node = self.audits.add(node, letter)
            self.live[state] = (cost, node)

    def _apply(self, letters: str) -> None:
        self.audit.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == INSERT else self.waiting.popleft()
            if letter == DELETE:
                continue
            if letter == KEEP:
                self.state = MOVES[self.state, role[:1]]
            else:
                role, self.state = EXPECTED[self.state]
            self.sha.update(f"{'\n' if self.written else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.written = True

    def result(self) -> tuple:
        self._insert()
        best = None
        for state in FINAL:
            have = self.live.get(state)
            if have and (best is None or have[0] < best[0] or (have[0] == best[0] and self.audits.less(have[1], best[1]))):
                best = have
        self._apply(self.audits.text(best[1]))
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.blank, self.duplicate, self.truncated, self.illegal, gaps, best[0], "".join(self.audit), self.sha.hexdigest())


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, times) after planted damage, which the crc32 of ``conv_id:turn`` modulo 20 decides.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 has it twice (``times``), 4 makes it a user's. Nulls count as one space, but a
    null turn or conv_id stays null beside that. A dropped row stays with ``times`` 0, so that no conversation vanishes.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    broken = F.when(h == 1, "").when(h == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    return df.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(space(role)).alias("role"),
        F.when(h == 0, "").otherwise(broken).alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, null turns first, then by role and text in code-point order. ``times`` may name a column that says how often a row stands there; with
    0 it only names its conversation. A conversation without rows has zeros, an empty audit and the hash of nothing. Null ids are one conversation;
    null roles and texts count as one space. An empty table gives no row; other columns are not looked at.

    Equal rows become one row with a number before anything is shuffled, and the first of equal (role, text) is found by a minimum, so neither a text
    nor a row that fills a conversation makes a task. The digest of a conversation can only be computed in order, so its rows pass through one
    task; they pass in sorted order, and the fold holds no more than the rows on which its cheapest edit strings still differ.
    """
    many = F.col(f"`{times}`").cast("long") if times else F.lit(1).cast("long")
    space = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    key = unused(rows.select(F.col(f"`{conv_id}`")), "key_")
    named = rows.select(F.col(f"`{conv_id}`").alias("id_"), F.col(f"`{turn}`").cast("long").alias("turn_"), space(role).alias("role_"), space(text).alias("text_"), many.alias("times_"))
    once = named.groupBy("id_", "turn_", "role_", "text_").agg(F.sum("times_").alias("times_"))
    once = once.withColumn("text_key_", F.sha2("text_", 256)).withColumn("place_", F.struct(F.col("turn_").isNotNull().alias("known"), F.coalesce("turn_", F.lit(0)).alias("at")))
    first = once.where("times_ > 0").groupBy(F.col("id_").alias("fid_"), F.col("role_").alias("frole_"), F.col("text_key_").alias("ftext_")).agg(F.min("place_").alias("first_"))
    same = F.col("id_").eqNullSafe(F.col("fid_")) & (F.col("role_") == F.col("frole_")) & (F.col("text_key_") == F.col("ftext_"))
    marked = once.join(first, same, "left").select(F.col("id_").alias(key), "turn_", "role_", "text_", "times_", F.coalesce(F.col("place_") > F.col("first_"), F.lit(False)).alias("seen_"))
    dealt = marked.repartition(key).sortWithinPartitions(key, F.col("turn_").asc_nulls_first(), "role_", "text_")
    kind = rows.schema[conv_id].dataType.simpleString()
    found = dealt.mapInArrow(_folds(key), f"`{key}` {kind}, {RESULT}")
    return found.select(F.col(key).alias(conv_id), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _folds(key: str):
    names = [key, *(part.split()[0] for part in RESULT.split(", "))]

    def batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fold = kind = None
        for part in parts:
            kind, done = part.schema.field(0).type, []
            for one, turn, role, text, times, seen in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if fold is None or one != at:
                    if fold is not None:
                        done.append((at, *fold.result()))
                    at, fold = one, Repair()
                for again in range(times):
                    fold.add(turn, role, text, seen or again > 0)
            if done:
                yield batch(done, kind)
        if fold is not None:
            yield batch([(at, *fold.result())], kind)

    return run
