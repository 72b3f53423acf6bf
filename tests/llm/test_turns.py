import hashlib
import itertools
import random
import re
import zlib

import pytest

from emberlog.llm import turns as t

ARROWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows, start=0, ends=(0, 3)):
    """(cost, audit) by a plain walk over the grammar; rows are (initial, truncated, forced deletion)."""
    def inserted(states):
        for _ in range(3):
            for (p, letter), q in ARROWS.items():
                if letter != "s" and p in states:
                    option = states[p][0] + 2, states[p][1] + "I"
                    states[q] = min(states.get(q, option), option)
        return states

    states = inserted({start: (0, "")})
    for initial, truncated, forced in rows:
        after = {}
        for p, (cost, audit) in states.items():
            options = [(p, cost + 3, audit + "D")]
            for (origin, letter), q in ARROWS.items():
                if origin == p and not forced:
                    if letter == initial:
                        options.append((q, cost + truncated, audit + "K"))
                    elif letter != "s":
                        options.append((q, cost + 2 + truncated, audit + "R"))
            for q, *option in options:
                after[q] = min(after.get(q, tuple(option)), tuple(option))
        states = inserted(after)
    return min((states[q] for q in ends if q in states), default=None)


def test_alignment_against_a_plain_walk():
    rng = random.Random(5)
    strings = ["".join(s) for n in range(5) for s in itertools.product("suax", repeat=n)]
    strings += ["".join(rng.choices("suax", [1, 8, 8, 1], k=rng.randint(5, 40))) for _ in range(60)]
    for initials in strings:
        truncated = tuple(rng.randint(0, 1) for _ in initials)
        for start, end in itertools.product(range(4), repeat=2):
            assert t.align(initials, truncated, start, end) == cheapest(list(zip(initials, truncated, [False] * len(initials))), start, (end,))


def test_bands_hold_every_cell_within_the_cost():
    for n, m, most in itertools.product(range(5), range(6), range(12)):
        low, high = t.band(n, m, most)
        for k in range(-n, m + 1):
            least = 2 * max(k, 0) + 3 * max(-k, 0) + 2 * max(m - n - k, 0) + 3 * max(k - m + n, 0)
            assert low <= k <= high or least > most


def brute(rows):
    """The contract's digest of damaged conversations, from plain lists."""
    done = {}
    for conv in {r[0] for r in rows}:
        lines = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if v is None else v for v in (role, text))
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(key.encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            lines += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()[:16]))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for turn, role, text in lines:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
        cost, audit = cheapest(judged)
        numbers = [turn for turn, _, _ in lines if turn is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        out, at = [], iter(lines)
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(at)[1:]
            if letter != "D":
                last = out[-1][0][:1] if out else ""
                out.append((role if letter == "K" else "assistant" if last == "u" else "user", text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        done[conv] = (gaps, *counts.values(), illegal, cost, audit, digest), out
    return done


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("copies", "first", "piece", "_seq", "audit", "_text_hash"):
        df = df.selectExpr("*", f"'x' as {name}")
    expected = brute(rows)
    broken = t.damaged(df)
    got = {r.conv_id: tuple(r)[1:] for r in t.audit_conversations(broken).collect()}
    assert got == {conv: digest for conv, (digest, _) in expected.items()}
    repaired = {}
    for r in t.repaired_turns(broken).orderBy("conv_id", "turn").collect():
        repaired.setdefault(r.conv_id, []).append((r.role, r.text))
    assert repaired == {conv: out for conv, (_, out) in expected.items() if out}


def talk(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        n = rng.randint(1, longest)
        for turn in range(n):
            role = ("system" if turn == 0 and rng.random() < 0.3 else rng.choice(["user", "assistant", "tool", "", "User", None]) if rng.random() < 0.15
                    else ("user", "assistant")[turn % 2])
            text = rng.choice(["Yes.", "No!", "Why?", "so what", " \t", "", None, f"text {turn}.", f"line {turn}\n ends? \n"])
            rows.append((conv, turn if rng.random() < 0.95 else rng.choice([None, 0, 3, 10_000]), role, text))
    return rows


def test_against_brute_force(spark):
    check(spark, talk(1, 120, 9))


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_long_conversations_go_in_pieces(spark, monkeypatch, piece):
    """Pieces of any size give the audits of whole conversations, over range partitions too."""
    monkeypatch.setattr(t, "PIECE", piece)
    check(spark, talk(piece, 3, 150))


def test_odd_rows(spark):
    same = [(5, 1, "user", "again.")] * 30
    check(spark, [*same, (None, None, None, None), (None, 1, "user", "a."), (6, None, "user", "x."), (6, None, "assistant", "y."), (7, 1, "", ""),
                  (8, 3, "assistant", "é" * 50_000 + "."), (8, -2, "user", "漢!"), (9, 2**40, "system", "s."), (9, 1, "system", "s.")])


def test_empty_table(spark):
    check(spark, [])
