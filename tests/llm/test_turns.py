"""Repair of conversations against an exhaustive search, and the edge cases of its contract."""

import hashlib
import itertools
import random
import re
import zlib

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    """conv -> its rows in order after damage; conversations without rows stay as empty lists."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def exhaustive(rows):
    """Every audit of a short conversation with up to three insertions in a row: the cheapest, ties by ASCII."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    choices = []
    for (_, role, text), fault in zip(rows, faults):
        cut = int(fault == "truncated")
        own = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            own += [("K", cut, [(role, text)])] + [("R", 2 + cut, [(r, text)]) for r in ("user", "assistant")]
        choices.append(own)
    inserts = [("I" * n, 2 * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    slots = [inserts]
    for c in choices:
        slots += [c, inserts]
    best = None
    for pick in itertools.product(*slots):
        cost = sum(p[1] for p in pick)
        if best and cost > best[0]:
            continue
        said = [x for p in pick for x in p[2]]
        if all(r for r, _ in said) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said)):
            found = (cost, "".join(p[0] for p in pick), "\n".join(f"{r}:{t}" for r, t in said))
            best = min(best, found) if best else found
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found_of(spark, rows):
    from ledgerline.llm.turns import damage, repair

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair(damage(df)).collect()}


def test_repair_against_exhaustive_search(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for _ in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?\n", " \t", "", None, "é .", "a. b"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), role, text))
    wanted = {c: exhaustive(r) for c, r in damaged(rows).items() if len(r) <= 3}
    assert len(wanted) > 90
    found = found_of(spark, rows)
    assert set(found) == set(damaged(rows))
    assert {c: found[c] for c in wanted} == wanted


def test_edge_cases(spark):
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = found_of(spark, [(gone, 0, "user", "Hello."), (None, None, None, None), (None, None, "user", "x" * 200_000 + ".")])
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[None] == exhaustive(damaged([(None, None, None, None), (None, None, "user", "x" * 200_000 + ".")])[None])
    assert found_of(spark, []) == {}


def test_repeated_rows_and_a_long_conversation(spark):
    """Of equal rows one stays; 20,000 turns of one conversation stream through."""
    rows = [(1, i // 2, "user" if i % 4 < 2 else "assistant", f"Turn {i // 2}.") for i in range(40_000)]
    from ledgerline.llm.turns import repair

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS again", "'x' AS fault", "'y' AS kind")
    (row,) = repair(df).collect()
    assert row["duplicate"] == 20_000 and row["cost"] == 60_000 and row["audit"] == "KD" * 20_000 and row["gaps"] == 0 and row["illegal"] == 20_000
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Turn {i}." for i in range(20_000))
    assert row["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
