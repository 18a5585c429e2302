"""Conversation repair against a search over all edit strings, and hand-made rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from barflow.llm import conversation_repair as C

ROLES = ("user", "assistant", "system", "tool")


def sha(out) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def searched(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Cost, audit and digest of the cheapest, then ASCII-least, of all edit strings that cost no more than deleting everything."""
    bad, cut = [], []
    for i, (role, text) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        bad.append(not body or (role, text) in rows[:i])
        cut.append(not bad[-1] and body[-1] not in ".!?")

    def ways(i, cost, audit, out):
        shape = "".join(r[:1] for r, _ in out)
        if cost > 3 * len(rows) or not re.fullmatch("(s?(ua)*u?)?", shape):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", shape):
                yield cost, audit, out
        else:
            role, text = rows[i]
            yield from ways(i + 1, cost + 3, audit + "D", out)
            if not bad[i]:
                yield from ways(i + 1, cost + cut[i], audit + "K", [*out, (role, text)]) if role[:1] in "sua" and role else ()
                for new in ROLES[:2]:
                    yield from ways(i + 1, cost + 2 + cut[i], audit + "R", [*out, (new, text)])
        for new in ROLES[:2]:
            yield from ways(i, cost + 2, audit + "I", [*out, (new, "")])

    cost, audit, out = min(ways(0, 0, "", []), key=lambda x: x[:2])
    return cost, audit, sha(out)


def folded(rows) -> tuple:
    fold, seen = C.Repair(), set()
    for i, (role, text) in enumerate(rows):
        fold.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return fold.result()


def test_fold_finds_what_a_search_over_all_edits_finds():
    rng = random.Random(5)
    for _ in range(250):
        rows = [(rng.choice(ROLES), rng.choice(["A b.", "c", "", " \n", "D!", "e?"])) for _ in range(rng.randrange(5))]
        assert folded(rows)[5:] == searched(rows), rows


def test_long_conversation_settles_and_equals_one_that_never_does(monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice(ROLES[:3]), rng.choice([f"x{i}.", f"y{i}", ""])) for i in range(1500)]
    often = folded(rows)
    monkeypatch.setattr(C, "SETTLE", 10**9)
    assert folded(rows) == often


def test_audits_compare_like_strings_even_where_every_hash_collides(monkeypatch):
    rng = random.Random(7)
    for base in (C.Audits.BASE, 0):
        monkeypatch.setattr(C.Audits, "BASE", base)
        tree, nodes = C.Audits(), [0]
        text = {0: ""}
        for _ in range(300):
            parent, letter = rng.choice(nodes[-12:]), rng.choice("DIKR")
            node = tree.add(parent, letter)
            nodes.append(node)
            text[node] = text[parent] + letter
        for _ in range(2000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert tree.less(a, b) == (text[a] < text[b])
            assert tree.text(a) == text[a]


def test_hand_made_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "No."), (3, None, "user", None), (3, 5, None, "What?"), (3, 9, "assistant", "end"),
        (4, 0, "user", "a."), (4, 0, "user", "a."), (4, 1, "assistant", "b."), (None, 0, "system", "s."), (None, 1, "user", "u."), (None, 2, "assistant", "v"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").selectExpr("*", "1 AS id_", "2 AS turn_", "3 AS KEY_")
    got = {r["conv_id"]: r for r in C.repair(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1]["audit"], got[1]["cost"], got[1]["repaired_sha256"]) == ("KK", 0, sha([("user", "Hi."), ("assistant", "Yes.")]))
    assert (got[2]["audit"], got[2]["cost"]) == ("IK", 2)
    assert (got[3]["blank"], got[3]["truncated"], got[3]["gaps"], got[3]["illegal"], got[3]["audit"], got[3]["cost"]) == (1, 1, 3, 2, "DRK", 6)
    assert (got[4]["duplicate"], got[4]["gaps"], got[4]["audit"]) == (1, 0, "KDK")
    assert (got[None]["truncated"], got[None]["cost"], got[None]["audit"]) == (1, 1, "KKK")
    assert C.repair(df.limit(0)).collect() == []


def test_whole_table_against_damage_and_search_in_plain_python(spark, sf_dir):
    raw = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r for r in C.repair(C.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), times="times").collect()}
    assert set(got) == {r[0] for r in raw}
    for conv in list(got)[:40]:
        rows = []
        for c, turn, role, text in sorted((r for r in raw if r[0] == conv), key=lambda r: r[1]):
            h = zlib.crc32(f"{c}:{turn}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        turns, plain = [r[0] for r in rows], [r[1:] for r in rows]
        bodies = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in plain]
        dup = [p in plain[:i] for i, p in enumerate(plain)]
        row = got[conv]
        assert row["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert row["blank"] == sum(not b for b in bodies)
        assert row["duplicate"] == sum(bool(b) and d for b, d in zip(bodies, dup))
        assert row["truncated"] == sum(bool(b) and not d and b[-1] not in ".!?" for b, d in zip(bodies, dup))
        assert row["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        if len(plain) <= 5:
            assert (row["cost"], row["audit"], row["repaired_sha256"]) == searched(plain)
