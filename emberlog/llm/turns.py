"""Repair of conversations by Wagner-Fischer alignment to the targets of an alternating grammar.

The role initials of a repaired conversation are `(s?(ua)+)?`. Its turns are aligned to the target string of every
length that can still win: a length is tried only while a lower bound of its cost does not exceed the best cost so far
(the incumbent), and its table is filled only on diagonals whose detour fits the incumbent (Ukkonen's band). A table
holds the cost of the rest from each cell on, so walking it forward and taking the least letter gives the least audit of a
target; audits of equal cost are compared and the least one stays.

Conversations may be long, so none is held as a whole. Turns are dealt out by ranges of (conversation, turn), a task
aligns pieces of PIECE turns, and a piece that is not a whole conversation is aligned to every part of the grammar
from each of its four states (nothing yet, behind s, behind u, behind a) to each other. One pass over the pieces and texts
of a conversation then chains the pieces, keeping one cost and one audit per state, and streams the repaired texts.
Audits of equal cost for the same turns never begin with each other (an insertion more costs more), so
the least of a chain is the chain of the least.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import settled

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns that are aligned as one string; forced deletions don't count.
PIECE = 64
SPACES = " \t\n\x0b\x0c\r"
NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: States of the grammar: the letter behind which one stands, nothing yet first. A repair ends in nothing yet or behind a.
STATES = ("", "s", "u", "a")
FINAL = (0, 3)
FAR = 1 << 60

# --- alignment ------------------------------------------------------------------------------------


def target(start: int, system: bool, length: int) -> str:
    """The letters of a target of this length that goes on from a state."""
    first = "s" if system else ""
    pair = "au" if STATES[start] == "u" else "ua"
    return (first + pair * length)[:length]


def band(n: int, m: int, most: int) -> tuple[int, int]:
    """Diagonals (letters minus turns so far) whose insertions and deletions alone cost at most `most`."""
    behind = m - n
    return (min(0, behind, -((most - INSERT * behind) // (INSERT + DELETE))),
            max(0, behind, (most + DELETE * behind) // (INSERT + DELETE)))


def fit(initials: str, truncated: tuple[int, ...], letters: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of aligning turns to letters, or None if it costs more than `most`."""
    n, m = len(initials), len(letters)
    low, high = band(n, m, most)
    # rest[i][j - i - low]: cost of turns from i on for letters from j on.
    width = high - low + 1
    rest = [[FAR] * (width + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        line = rest[i]
        below = rest[i + 1] if i < n else None
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            d = j - i - low
            if i == n and j == m:
                line[d] = 0
                continue
            best = FAR
            if j < m and letters[j] != "s" and j + 1 - i <= high:
                best = INSERT + line[d + 1]
            if below is not None:
                if d > 0:
                    best = min(best, DELETE + below[d - 1])
                if j < m:
                    if initials[i] == letters[j]:
                        best = min(best, KEEP + truncated[i] + below[d])
                    elif letters[j] != "s":
                        best = min(best, REROLE + truncated[i] + below[d])
            line[d] = best
    cost = rest[0][-low]
    if cost > most:
        return None
    audit, i, j, left = [], 0, 0, cost
    while i < n or j < m:
        d = j - i - low
        if i < n and d > 0 and left == DELETE + rest[i + 1][d - 1]:
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif j < m and letters[j] != "s" and j + 1 - i <= high and left == INSERT + rest[i][d + 1]:
            audit.append("I")
            j, left = j + 1, left - INSERT
        else:
            keep = initials[i] == letters[j]
            audit.append("K" if keep else "R")
            left -= (KEEP if keep else REROLE) + truncated[i]
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=1 << 16)
def align(initials: str, truncated: tuple[int, ...], start: int, end: int) -> tuple[int, str] | None:
    """Least cost and, among those, least audit of turns that lead the grammar from one state to another."""
    n = len(initials)
    best: tuple[int, str] | None = None
    for system in (False, True):
        if system and (start or "s" not in initials):
            continue

        def ends_well(m: int, system: bool = system) -> bool:
            return (target(start, system, m)[-1] == STATES[end]) if m else (start == end and not system)

        shorter, longer = n, n + 1
        while shorter >= 0 or longer is not None:
            # The next length in order of what its insertions and deletions cost at least.
            down, up = (DELETE * (n - shorter) if shorter >= 0 else FAR), (INSERT * (longer - n) if longer is not None else FAR)
            m, bound = (shorter, down) if down <= up else (longer, up)
            if m == shorter:
                shorter -= 1
            else:
                longer += 1
            if best is not None and bound > best[0]:
                break
            if best is None and bound > DELETE * n + 2 * INSERT:
                break
            if not ends_well(m):
                continue
            # Deleting and inserting everything is always possible, but for a system turn.
            most = (DELETE + TRUNCATED) * n + INSERT * m if best is None else best[0]
            found = fit(initials, truncated, target(start, system, m), most)
            if found is not None and (best is None or found < best):
                best = found
    return best


class Piece:
    """Turns of one conversation that follow each other, and what of them the whole conversation needs."""

    def __init__(self) -> None:
        self.initials: list[str] = []
        self.truncated: list[int] = []
        #: Forced deletions before the first aligned turn, and behind each of them.
        self.forced = [0]
        self.turns = self.blank = self.duplicate = self.illegal = 0
        self.low: int | None = None
        self.high: int | None = None
        self.distinct = 0
        self.last_turn: int | None = None
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, copies: int, first: bool, blank: bool, truncated: bool) -> None:
        """Copies of a turn; `first` if the first of them has no equal before it in the conversation."""
        if not copies:
            return
        if turn is not None:
            if self.last_turn != turn:
                self.distinct += 1
            self.low = turn if self.low is None else min(self.low, turn)
            self.high = turn if self.high is None else max(self.high, turn)
            self.last_turn = turn
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1
        self.last = initial
        self.turns += copies
        if blank:
            self.blank += copies
            self.forced[-1] += copies
        elif first:
            self.initials.append(initial or "-")
            self.truncated.append(int(truncated))
            self.duplicate += copies - 1
            self.forced.append(copies - 1)
        else:
            self.duplicate += copies
            self.forced[-1] += copies

    def paths(self, whole: bool) -> list[dict]:
        """Cost and audit from state to state; of a whole conversation only the best one."""
        initials, truncated = "".join(self.initials), tuple(self.truncated)
        out = []
        for start in range(1) if whole else range(4):
            found = [(a[0], a[1], end) for end in (FINAL if whole else range(4)) if (a := align(initials, truncated, start, end))]
            out += [(start, *path) for path in ([min(found)] if whole else found)]
        return [{"start": start, "end": end, "cost": cost + DELETE * sum(self.forced), "audit": self.with_forced(audit)}
                for start, cost, audit, end in out]

    def with_forced(self, audit: str) -> str:
        """Forced deletions come before insertions at the same place, since D is less than I."""
        if not any(self.forced):
            return audit
        parts, turn = ["D" * self.forced[0]], 0
        for letter in audit:
            parts.append(letter)
            if letter != "I":
                turn += 1
                parts.append("D" * self.forced[turn])
        return "".join(parts)

    def record(self, whole: bool) -> dict:
        return {"turns": self.turns, "low": self.low, "high": self.high, "distinct": self.distinct, "last_turn": self.last_turn,
                "blank": self.blank, "duplicate": self.duplicate, "truncated": sum(self.truncated), "illegal": self.illegal,
                "first": self.first, "last": self.last, "paths": self.paths(whole)}


PIECE_TYPE = ("struct<turns:bigint,low:bigint,high:bigint,distinct:bigint,last_turn:bigint,blank:bigint,duplicate:bigint,"
              "truncated:bigint,illegal:bigint,first:string,last:string,paths:array<struct<start:int,end:int,cost:bigint,audit:string>>>")
_PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PIECE = pa.struct([*[(c, pa.int64()) for c in ("turns", "low", "high", "distinct", "last_turn", "blank", "duplicate", "truncated", "illegal")],
                    ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(_PATH))])


class Chain:
    """A conversation, piece by piece."""

    def __init__(self) -> None:
        #: Cost and audit per state; what all audits begin with is kept apart.
        self.states = {0: (0, "")}
        self.common: list[str] = []
        self.low = self.high = self.last_turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def add(self, piece: dict) -> None:
        if not piece["turns"]:
            return
        if piece["low"] is not None:
            self.low = piece["low"] if self.low is None else min(self.low, piece["low"])
            self.high = piece["high"] if self.high is None else max(self.high, piece["high"])
            # Turns ascend, so a turn number that two pieces share is the last of one and the least of the other.
            self.distinct += piece["distinct"] - (self.last_turn == piece["low"])
            self.last_turn = piece["last_turn"]
        if self.last is not None:
            self.illegal += self.last + piece["first"] not in LEGAL
        self.last = piece["last"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + piece[name])
        reached: dict[int, tuple[int, str]] = {}
        for path in piece["paths"]:
            if path["start"] in self.states:
                cost, audit = self.states[path["start"]]
                option = cost + path["cost"], audit + path["audit"]
                if path["end"] not in reached or option < reached[path["end"]]:
                    reached[path["end"]] = option
        same = os.path.commonprefix([audit for _, audit in reached.values()])
        self.common.append(same)
        self.states = {state: (cost, audit[len(same):]) for state, (cost, audit) in reached.items()}

    def result(self) -> tuple[int, str]:
        cost, audit = min(self.states[s] for s in FINAL if s in self.states)
        return cost, "".join(self.common) + audit

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


# --- tables ---------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by the hash of `conv_id:turn`, nulls as one space.

    0 drops a turn (0 copies), 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes it the user's.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(shown(text_col), ENDS, "")).otherwise(shown(text_col))
    return conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(shown(role_col)).alias("role"), text.alias("text"),
        F.when(code == 0, F.lit(0)).when(code == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


#: Order of the turns of a conversation. Turns with one number are ordered by role and the hash of their text.
ORDER = ("turn", "role", "_text_hash")


def _marked(turns: DataFrame) -> DataFrame:
    """One row per different turn, without texts: conv_id, turn, role, _text_hash, copies, first, blank, truncated."""
    key = ["conv_id", *ORDER]
    light = turns.withColumn("_text_hash", _text_hash()).groupBy(*key).agg(
        F.sum("copies").alias("copies"),
        F.max(~F.col("text").rlike(NOT_BLANK)).alias("blank"),
        F.max(~F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).isin(*ENDS)).alias("truncated"))
    light = settled(light, "turns")
    # The first of equal turns is found by an aggregate, so that a text that recurs all over a conversation is no hot key.
    firsts = (light.filter("copies > 0").groupBy("conv_id", "role", "_text_hash").agg(F.min(F.struct("turn")).alias("_at"))
              .select("conv_id", F.col("_at.turn").alias("turn"), "role", "_text_hash", F.lit(0).cast("long").alias("copies"),
                      F.lit(True).alias("first"), F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("truncated")))
    both = light.withColumn("first", F.lit(False)).unionByName(firsts).groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.max("first").alias("first"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    return settled(both, "marked")


def _text_hash() -> Column:
    """128 bits of the SHA-256 of the text."""
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def _pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, _seq, piece): pieces of conversations in order of _seq."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    by = ["conv_id", *ORDER]
    dealt = turns.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "first", "blank", "truncated",
        F.monotonically_increasing_id().alias("_seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        done: list[tuple] = []
        piece, at, seq, opening, split = Piece(), None, None, True, False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            ids, seqs, pieces = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(seqs, pa.int64()), pa.array(pieces, _PIECE)], names=["conv_id", "_seq", "piece"])

        for batch in batches:
            kind = kind or batch.column(0).type
            for conv, turn, initial, copies, first, blank, truncated, number in zip(*(c.to_pylist() for c in batch.columns)):
                if seq is None:
                    at, seq = conv, number
                elif conv != at:
                    # Neighbouring tasks may hold turns of the first and the last conversation of a task.
                    done.append((at, seq, piece.record(not (opening or split))))
                    piece, at, seq, opening, split = Piece(), conv, number, False, False
                elif len(piece.initials) >= PIECE:
                    done.append((at, seq, piece.record(False)))
                    piece, seq, split = Piece(), number, True
                piece.add(turn, initial, copies, first, blank, truncated)
                if len(done) >= 4096:
                    yield batch_of(done)
                    done = []
        if seq is not None:
            done.append((at, seq, piece.record(False)))
        if done:
            yield batch_of(done)

    return dealt.mapInArrow(run, f"conv_id {id_type}, _seq long, piece {PIECE_TYPE}")


def _walked(turns: DataFrame, walk: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What `walk` makes of (conv_id, chain, turns in order), conversation by conversation."""
    pieces = _pieces(_marked(turns))
    id_type = turns.schema["conv_id"].dataType.simpleString()
    none = {c: F.lit(None) for c in ("_seq", "turn", "role", "_text_hash", "text", "copies", "piece")}
    heads = pieces.select("conv_id", "_seq", none["turn"].cast("long").alias("turn"), none["role"].cast("string").alias("role"),
                          none["_text_hash"].cast("binary").alias("_text_hash"), none["text"].cast("string").alias("text"),
                          none["copies"].cast("long").alias("copies"), "piece")
    bodies = turns.filter("copies > 0").select("conv_id", none["_seq"].cast("long").alias("_seq"), "turn", "role", _text_hash().alias("_text_hash"),
                                               "text", "copies", none["piece"].cast(PIECE_TYPE).alias("piece"))
    # The pieces of a conversation come before its texts; both arrive in order and are held one batch at a time.
    lined = (heads.unionByName(bodies).repartition("conv_id")
             .sortWithinPartitions("conv_id", F.col("_seq").asc_nulls_last(), *ORDER).drop("_seq", "_text_hash", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = None
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = kind or batch.column(0).type
                for part in range(0, batch.num_rows, 512):
                    yield from zip(*(c.to_pylist() for c in batch.slice(part, 512).columns))

        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(c, t) for c, t in zip(columns[1:], fields)]], names=names)

        names = ["conv_id", *[c.split()[0] for c in schema.split(", ")]]
        fields = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
        size = 0
        for row in walk(rows()):
            done.append(row)
            size += 100 + sum(len(v) for v in row if isinstance(v, str))
            if size > 1 << 22:
                yield out()
                done.clear()
                size = 0
        if done:
            yield out()

    return lined.mapInArrow(run, f"conv_id {id_type}, {schema}")


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, chain, audit, cost, its turns (role, text, copies)) from rows in order; the turns must be used up first."""
    ahead = next(rows, None)
    while ahead is not None:
        conv, chain = ahead[0], Chain()
        while ahead is not None and ahead[0] == conv and ahead[4] is not None:
            chain.add(ahead[4])
            ahead = next(rows, None)

        def turns() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1], ahead[2], ahead[3]
                ahead = next(rows, None)

        yield conv, chain, turns()


def edits(audit: str, turns: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that a repair keeps, changes or inserts, in order."""
    place, last = 0, ""

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal place, last
        while place < len(audit) and audit[place] == "I":
            last = "a" if last == "u" else "u"
            yield "I", ROLES[last], ""
            place += 1

    for role, text, copies in turns:
        for _ in range(copies):
            yield from inserted()
            edit = audit[place]
            place += 1
            if edit == "R":
                last = "a" if last == "u" else "u"
                yield edit, ROLES[last], text
            elif edit == "K":
                last = role[:1]
                yield edit, role, text
    yield from inserted()


def audit_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text, copies): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Faults are counted once per turn, in that order of precedence. Turns without a number come first; turns with the same
    number are ordered by role and the hash of their text, so copies stand together. A null id is an id of its own.
    Conversations without turns (0 copies) have zeros, an empty audit and the hash of the empty text; an empty table
    gives an empty result. Texts of any length are read in batches; only an audit, one letter per turn, is held whole.
    """
    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, chain, conversation in _conversations(rows):
            cost, audit = chain.result()
            digest = hashlib.sha256()
            for i, (_, role, text) in enumerate(edits(audit, conversation)):
                digest.update(f"{'\n' if i else ''}{role}:{text}".encode())
            yield conv, chain.gaps(), chain.blank, chain.duplicate, chain.truncated, chain.illegal, cost, audit, digest.hexdigest()

    return _walked(turns, walk, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), edit (K kept, R role changed, I inserted), role, text.

    Cases as in `audit_conversations`; a conversation whose repair is empty has no rows.
    """
    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, chain, conversation in _conversations(rows):
            for i, (edit, role, text) in enumerate(edits(chain.result()[1], conversation)):
                yield conv, i, edit, role, text

    return _walked(turns, walk, "turn long, edit string, role string, text string")
