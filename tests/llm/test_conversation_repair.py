"""Conversation repair against a search over all scripts, and the whole query against a row-by-row model."""

import hashlib
import heapq
import random
import zlib

import pytest

from caremart.llm import conversation_repair as cr
from caremart.llm.common import table

KIND = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def search(rows):
    """Cheapest edits by Dijkstra over (row, state), ties to the least audit; rows are
    (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        # the state: nothing, a lone s, or what came last after the first u
        if i == len(rows) and (out == "" or (out != "s" and out[-1] == "a")):
            return cost, audit
        if (i, out) in done:
            continue
        done.add((i, out))

        def put(more, letter, c, step):
            if more == "s" and out == "":
                after = "s"
            elif more == "u" and out in ("", "s", "a"):
                after = "u"
            elif more == "a" and out == "u":
                after = "a"
            else:
                return
            heapq.heappush(heap, (cost + step, audit + letter, i + c, after))

        for x in "ua":
            put(x, "I", 0, 5)
        if i < len(rows):
            initial, go, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out))
            if not go:
                put(initial, "K", 1, 5 * cut)
                for x in "ua":
                    put(x, "R", 1, 1 + 5 * cut)


def code(initial, go, cut):
    if go:
        return "-"
    known = initial if initial in ("s", "u", "a") else "?"
    return ("!" if known == "?" else known.upper()) if cut else known


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_cheapest_and_least_audit(block):
    rng = random.Random(block)
    for _ in range(1500):
        rows = [(rng.choice("suaua?"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randrange(0, 11))]
        codes = "".join(code(*r) for r in rows)
        assert cr.cheapest(codes, block) == search(rows), codes


def test_long_conversations_do_not_depend_on_blocks():
    rng = random.Random(3)
    for n in (63, 64, 65, 300, 700):
        rows = [(rng.choice("suaua?"), rng.random() < 0.2, rng.random() < 0.25) for _ in range(n)]
        codes = "".join(code(*r) for r in rows)
        want = search(rows)
        assert cr.cheapest(codes) == want == cr.cheapest(codes, 17)


def blank(text):
    return not text.strip(BLANK)


def model(rows, damaged=False):
    """The contract, row by row."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damaged else 5
        mine = convs.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        counts, seen, edits = [0, 0, 0], set(), []
        for _, role, text in mine:
            cut = not blank(text) and text.rstrip(BLANK)[-1] not in ".!?"
            fault = 0 if blank(text) else 1 if (role, text) in seen else 2 if cut else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            edits.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = search(edits)
        size, i, kept = len(audit) - audit.count("D"), 0, []
        for e in audit:
            role = "user" if (len(kept) - size % 2) % 2 == 0 else "assistant"
            if e != "I":
                i += 1
            if e == "K":
                role = mine[i - 1][1]
            if e != "D":
                kept.append(f"{role}:{'' if e == 'I' else mine[i - 1][2]}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


AWKWARD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.  \n"), (1, 2, "assistant", "Yes.  \n"),
    (2, None, None, None), (2, None, "user", "a."), (2, 3, "user", "a."), (2, 9, "tool", "x"), (2, 9, "assistant", " \t "),
    (None, 1, "user", "who?"), (None, 2, "assistant", "me!"), (3, 0, "", ""), (4, 0, "assistant", "I start."),
    (4, 1, "user", " "), (5, 0, "system", "only."), (6, 0, "unknown", "u too."), (6, 1, "System", "no!"),
    (7, -5, "user", "x." * 40_000), (7, 5, "assistant", "zoë ✓ 中文?"), (7, 5, "assistant", "b."), (8, None, None, "k."),
]


@pytest.mark.parametrize("damaged", [False, True])
def test_awkward_rows(spark, damaged):
    rows = AWKWARD + [(c, t, r, x) for c in range(20, 60) for t, (r, x) in enumerate(
        [("user", "One."), ("assistant", "two"), ("user", "Three!"), ("user", "Three!"), ("assistant", "")])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", step string, code int").repartition(5)
    turns = cr.damage(df) if damaged else df.fillna(" ", ["role", "text"])
    assert result(cr.repair(turns)) == model(rows, damaged)


def test_one_conversation_with_a_third_of_the_rows(spark):
    rng = random.Random(9)
    rows = [(0, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", f"b{t}.", "c", ""])) for t in range(1500)]
    rows += [(1 + i // 4, i % 4, "ua"[i % 2] + "x", "d.") for i in range(3000)]
    df = spark.createDataFrame(rows, KIND).repartition(6)
    assert result(cr.repair(cr.damage(df))) == model(rows, True)


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert cr.repair(cr.damage(df)).collect() == []


def test_query_equals_model(spark, small):
    from caremart.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(op13_conversation_repair(spark, small)) == model(rows, True)
