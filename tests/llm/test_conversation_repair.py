"""Conversation repair against a search over all edits, and its automaton."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from swayline.llm.conversation_repair import END, Endings, before, damaged, op13_conversation_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired) over all edits of (role, text, fault) rows, cheapest and then least audit first."""
    queue, best = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, at, shape, made = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, list(made)
        if not re.fullmatch("s?(ua)*u?", shape) or len(audit) > 2 * len(rows) + 3:
            continue
        state = at, shape[-1:], audit  # the whole audit: no two paths are merged by a rule that the operator uses
        if best.get(state, 1 << 30) < cost:
            continue
        best[state] = cost
        for new in ("user", "assistant"):
            heapq.heappush(queue, (cost + 2, audit + "I", at, shape + new[0], (*made, (new, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, shape, made))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, shape + (role[:1] or "?"), (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 2 + extra, audit + "R", at + 1, shape + new[0], (*made, (new, text))))


def told(rows):
    """Counts, cost, audit and repaired rows of one conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    faults = [f for _, _, f in out]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal), *cheapest(out)


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def conversations(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr", "User"])
            text = rng.choice(["A question?", "Answer.", "cut", " \n", "", None, "Yes!\t ", "é", "A question?"])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
            turn += rng.choice([1, 1, 1, 2, 0])
    rows.append((None, 3, "user", "no id"))
    rows.append(rows[0])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, tmp_path, seed):
    rows = conversations(seed)
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS present", "1 AS number").write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: r for r in op13_conversation_repair(spark, folder).collect()}
    want = harmed(rows)
    assert set(got) == set(want)
    for conv, mine in want.items():
        r = got[conv]
        counts, cost, audit, repaired = told(mine)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == counts, conv
        assert (r.cost, r.audit) == (cost, audit), conv
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest(), conv


def test_repaired_rows_and_long_conversation(spark):
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    long.pop(1500)
    copies = [(c, t, r, x) for c in range(2, 400) for t, r, x in ((0, "system", "Be brief."), (1, "user", "x" * 30000 if c == 2 else "Why?"), (2, "user", "Because."))]
    out = {r.conv_id: r for r in repair(spark.createDataFrame(long + copies, SCHEMA)).collect()}
    assert (out[1].cost, out[1].gaps, out[1].illegal) == (2, 1, 1)
    assert out[1].audit.count("I") == 1 and len(out[1].repaired) == 3000
    assert [(r.role, r.text) for r in out[3].repaired] == [("system", "Be brief."), ("user", "Why?"), ("assistant", "Because.")]
    assert (out[3].cost, out[3].audit) == (2, "KKR") and out[2].truncated == 1 and len(out) == 399


def test_empty_tables_and_absent_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).count() == 0 and damaged(empty).count() == 0
    gone = repair(spark.createDataFrame([(5, 1, "user", "Hi.")], SCHEMA).selectExpr("*", "false AS present")).first()
    assert (gone.gaps, gone.blank, gone.illegal, gone.cost, gone.audit, gone.repaired) == (0, 0, 0, 0, "", [])
    far = repair(spark.createDataFrame([(1, -(1 << 63), "user", "Hi."), (1, (1 << 63) - 1, "assistant", "Yes.")], SCHEMA)).first()
    assert far.gaps is None and far.cost == 0


def test_shared_endings_are_computed_once():
    endings, signatures = Endings(), ["suaua", "uaua", "ua", "aua", "xuaua"]
    costs = {}
    for back in sorted(s[::-1] for s in signatures):
        endings.turn_to(back)
        costs[back[::-1]] = endings.repair()[:2]
    assert endings.made == len({s[i:] for s in signatures for i in range(len(s))})
    assert costs["suaua"] == (0, "KKKKK") and costs["xuaua"] == (3, "DKKKK") and costs["aua"] == (2, "IKKK")
    assert END[1] == ("", "I", "I", "") and before("x", END[0])[1][0] == "D"
