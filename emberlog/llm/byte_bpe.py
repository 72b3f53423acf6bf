"""Byte-level BPE encoding and decoding by rank files, with pre-tokenisation in numpy instead of a regex.

Every code point has a class (an array looked up at once), looking ahead over at most two characters refines it to
a symbol, and a symbol is a function from the state before a character to the state behind it. Composing such
functions is associative, so the characters are laid out as lines, all lines compose their functions side by side, the
lines' functions are scanned in log2(lines) rounds, and a second pass over the lines gives each character its state.
States behind a character tell whether a slice begins there.

The slices feed pair merging, remembered per slice in a bounded table. Ids keep the byte offset of their token, so
that a range of ids decodes to its place in the text. Rows are independent and there is no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import mix, slices, utf8

#: Slices whose ids a task remembers, and the longest that are.
REMEMBERED, LONGEST_REMEMBERED = 150_000, 64
#: Code points that one vectorised step handles, and those of one line of a scan.
STEP, LINE = 1 << 20, 256
#: Bytes of text that are encoded at once (one row may be longer).
GROUP_BYTES = 1 << 20
#: Ids that are decoded at once, and rows whose bytes make one batch.
GROUP_IDS, GROUP_ROWS = 1 << 20, 256

# --- classes, symbols, states ---------------------------------------------------------------------

OTHER, LETTER, NUMBER, SPACE = range(4)
# Symbols: what a character does to the state. A space is INNER if white space follows or the text ends, else LAST; a blank
# is U+0020, which joins what follows. QUOTE2 and QUOTE3 begin a contraction of that length if a slice begins there.
S_OTHER, S_LETTER, S_NUMBER, S_INNER, S_LAST, S_LAST_BLANK, S_QUOTE2, S_QUOTE3, S_NONE = range(9)
#: Added to the symbol of the first character of a text.
OPENING = 9
# States: the kind of slice the last character stands in. FRESH: the next character begins one; JOIN: the next
# character belongs to the blank before it; TWO and ONE: so many characters of a contraction are to come.
FRESH, IN_OTHER, IN_LETTER, IN_NUMBER, IN_SPACE, JOIN, TWO, ONE = range(8)


def _functions() -> np.ndarray:
    """state behind a character = table[symbol, state before it]."""
    table = np.empty((2 * OPENING, 8), dtype=np.uint8)
    table[S_OTHER], table[S_LETTER], table[S_NUMBER] = IN_OTHER, IN_LETTER, IN_NUMBER
    table[S_LETTER, TWO], table[S_LETTER, ONE] = ONE, FRESH
    table[S_INNER], table[S_LAST], table[S_LAST_BLANK] = IN_SPACE, FRESH, JOIN
    # A quote inside a run of others, or behind a blank, is one of them.
    table[S_QUOTE2], table[S_QUOTE3] = ONE, TWO
    table[np.ix_([S_QUOTE2, S_QUOTE3], [IN_OTHER, JOIN])] = IN_OTHER
    table[S_NONE] = np.arange(8)
    # The first character of a text sees a fresh state whatever came before.
    table[OPENING:] = table[:OPENING, FRESH][:, None]
    return table


def _beginnings() -> np.ndarray:
    """Whether a slice begins at a character, by its symbol and the state before it."""
    begins = np.ones((2 * OPENING, 8), dtype=bool)
    begins[:, [JOIN, TWO, ONE]] = False
    begins[S_OTHER, IN_OTHER] = begins[S_LETTER, IN_LETTER] = begins[S_NUMBER, IN_NUMBER] = False
    begins[[S_QUOTE2, S_QUOTE3], IN_OTHER] = False
    begins[S_INNER, IN_SPACE] = False
    # The last space of a run is a slice of its own, or the first character of the next one.
    begins[[S_LAST, S_LAST_BLANK], IN_SPACE] = True
    begins[OPENING:] = True
    return begins


def _compositions(functions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All functions that composing the given ones makes, and a table: then[f, g] is the number of "f, then g".

    The first ones are the given functions, in their order; equal ones among them keep separate numbers.
    """
    known = [tuple(f) for f in functions.tolist()]
    number = {f: i for i, f in reversed(list(enumerate(known)))}
    rows = []
    for f in known:  # grows while it is walked
        row = []
        for g in known[:len(functions)]:
            both = tuple(g[s] for s in f)
            if both not in number:
                number[both] = len(known)
                known.append(both)
            row.append(number[both])
        rows.append(row)
    table = np.array(known, dtype=np.uint8)
    then = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)
    return table, then


BEGINS = _beginnings()
FUNCTIONS, THEN = _compositions(_functions())


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, classes) of the runs of one class, as the encoding library's patterns see them.

    The library drops what its pattern doesn't match, so encoding every character tells which ones match.
    """
    import tiktoken

    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(everything)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = kind
    firsts = np.flatnonzero(np.concatenate(([True], table[1:] != table[:-1])))
    return firsts.astype(np.int32), table[firsts]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the offsets of their first bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    if len(at) == len(data):
        return points, at
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    for lead, following in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        long = np.flatnonzero((points >= lead) & (points < 0x100) & (points < {1: 0xE0, 2: 0xF0, 3: 0x100}[following]))
        value = points[long] & (0x3F >> following)
        for i in range(following):
            value = value << 6 | padded[at[long] + 1 + i] & 0x3F
        # Code points below 0x100 would look like lead bytes to the next round.
        points[long] = value | 1 << 24
    return points & 0xFFFFFF, at


def scan(symbols: np.ndarray, state: int) -> np.ndarray:
    """The state before each character and behind the last one, from the state before the first."""
    n, size = len(symbols), len(THEN)
    lines = max(1, -(-n // LINE))
    grid = np.full(lines * LINE, S_NONE, dtype=np.int64)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lines, LINE).T)
    then, table = THEN.astype(np.int64).ravel(), FUNCTIONS.astype(np.int64)
    # What each line does as a whole.
    whole = grid[0]
    for column in grid[1:]:
        whole = then[whole * size + column]
    # What all lines up to each one do: composition is associative, so distances double.
    step = 1
    while step < lines:
        whole = np.concatenate((whole[:step], then[whole[:-step] * size + whole[step:]]))
        step *= 2
    reached = table[whole, state]
    now = np.concatenate(([state], reached[:-1]))
    before = np.empty((LINE, lines), dtype=np.uint8)
    flat = table.ravel()
    for i, column in enumerate(grid):
        before[i] = now
        now = flat[column * 8 + now]
    return np.append(before.T.ravel()[:n], np.uint8(reached[-1]))


class Slicer:
    """Finds the first bytes of the slices of texts that stand one behind the other."""

    def __init__(self, firsts: np.ndarray, kinds: np.ndarray) -> None:
        self.classes = np.repeat(kinds, np.diff(np.append(firsts, 0x110000)))

    def symbols(self, points: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """A symbol per character; `opens` marks the first character of each text, and the end."""
        kind = self.classes[points]
        out = kind.copy()
        ends = opens[1:]
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~ends[:-1])
        out[last] = np.where(points[last] == 32, S_LAST_BLANK, S_LAST)
        quotes = np.flatnonzero((points == 39) & ~ends)
        if len(quotes):
            more, closed = np.append(points, [0, 0]), np.append(ends, True)
            one, two = more[quotes + 1], more[quotes + 2]
            out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE2
            pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            # The second letter must belong to the same text.
            out[quotes[pair & ~closed[quotes + 1]]] = S_QUOTE3
        return out + np.uint8(OPENING) * opens[:-1]

    def slices(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Offsets of the first bytes of all slices, ascending; texts lie between the offsets."""
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        found, state, at = [], FRESH, 0
        while at < len(data):
            # A step ends at a character's edge and looks at two characters more.
            end, seen = (min(at + STEP, len(data)) + more for more in (0, 8))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            seen = min(max(seen, end + 8), len(data))
            points, places = code_points(data[at:seen])
            places += at
            symbols = self.symbols(points, np.append(edge[places], edge[seen]))
            n = int(np.searchsorted(places, end))
            states = scan(symbols[:n], state)
            state = int(states[-1])
            found.append(places[:n][BEGINS[symbols[:n], states[:-1]]])
            at = end
        return np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


# --- merging --------------------------------------------------------------------------------------

def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no token for the bytes {missing}; texts with them have no ids")
    if len(set(ranks.values())) < len(ranks):
        raise ValueError("two tokens share a rank")
    return ranks


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair whose joined token has the lowest rank is joined first, the leftmost of equals."""
    if raw in ranks:
        return [ranks[raw]]
    n = len(raw)
    part: list[bytes | None] = [raw[i:i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := raw[i:i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        # One of the two has been joined to another since.
        if part[i] is None or j >= n or part[i] + part[j] != joined:
            continue
        part[i], part[j] = joined, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (pair := joined + part[k]) in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))
        k = before[i]
        if k >= 0 and (pair := part[k] + joined) in ranks:
            heapq.heappush(heap, (ranks[pair], k, pair))
    return [ranks[p] for p in part if p is not None]


class PairRanks:
    """Rank of the token that two neighbouring tokens make, or NEVER, looked up for whole arrays: an open-addressed table."""

    NEVER = np.int64(1) << 31

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.span = max(ranks.values()) + 1
        found = [(ranks[t[:i]] * self.span + ranks[t[i:]], rank) for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, self.NEVER, dtype=np.int64)
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            # Of several keys for one free place the last one has it.
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.span + right
        at = self.place(keys)
        out = np.full(len(keys), self.NEVER, dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Merger(dict):
    """Ids of slices: remembered, or worked out for many new slices side by side; emptied when full."""

    NEVER = PairRanks.NEVER

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.pairs = ranks, PairRanks(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Two bytes that stand together in no token never end up in one, so a slice may be cut between them.
        self.together = np.zeros(1 << 16, dtype=bool)
        joined = {t[i:i + 2] for t in ranks for i in range(len(t) - 1)}
        self.together[[p[0] << 8 | p[1] for p in joined]] = True

    def of(self, raws: list[bytes]) -> list[list[int]]:
        new = [raw for raw in set(raws) if raw not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(raws))
        short = []
        for raw in new:
            if raw in self.ranks:
                self[raw] = [self.ranks[raw]]
            elif len(raw) <= LONGEST_REMEMBERED:
                short.append(raw)
        for raw, ids in zip(short, self.merge_many(short)):
            self[raw] = ids
        return list(map(self.__getitem__, raws))

    def __missing__(self, raw: bytes) -> list[int]:
        """A long slice: in parts, by heap, and not remembered."""
        codes = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        cuts = np.flatnonzero(~self.together[codes[:-1] << 8 | codes[1:]]) + 1
        return [i for a, b in zip([0, *cuts], [*cuts, len(raw)]) for i in merge(raw[a:b], self.ranks)]

    def merge_many(self, raws: list[bytes]) -> list[list[int]]:
        """As `merge`, one join per slice and round; slices without a further join leave the arrays."""
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        ids = self.single[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        owner = np.arange(len(raws))
        heads = np.cumsum(sizes) - sizes
        rank = np.append(self.pairs(ids[:-1], ids[1:]), self.NEVER)[:len(ids)] if len(ids) else ids
        rank[heads[1:] - 1] = self.NEVER
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            n = len(ids)
            # Lowest rank, leftmost position.
            best = np.minimum.reduceat(rank * n + np.arange(n), heads)
            live = best < self.NEVER * n
            at = best[live] % n
            ids[at] = rank[at]
            keep = np.ones(n, dtype=bool)
            keep[at + 1] = False
            # What followed the second one now follows the joined one, unless the slice ends there.
            first, beyond = heads[live], heads[live] + sizes[live]
            rank[at] = np.where(at + 2 == beyond, self.NEVER, self.pairs(ids[at], ids[np.minimum(at + 2, n - 1)]))
            again = at[at > first]
            rank[again - 1] = self.pairs(ids[again - 1], ids[again])
            finished = ~live
            if finished.any():
                out = np.repeat(finished, sizes)
                done.append((owner[finished], sizes[finished], ids[out]))
                keep &= ~out
                owner, sizes = owner[live], sizes[live]
            ids, rank = ids[keep], rank[keep]
            sizes = sizes - 1
            heads = np.cumsum(sizes) - sizes
        result: list[list[int]] = [[] for _ in raws]
        for owners, lengths, flat in done:
            listed, ends = flat.tolist(), np.cumsum(lengths)
            for o, a, b in zip(owners.tolist(), (ends - lengths).tolist(), ends.tolist()):
                result[o] = listed[a:b]
        return result


class Encoder:
    """Ids of texts, as flat arrays."""

    def __init__(self, path: str) -> None:
        self.slicer, self.merger = Slicer(*character_classes()), Merger(ranks_of(path))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end) for texts between the offsets."""
        firsts = self.slicer.slices(data, offsets)
        sizes = np.diff(np.append(firsts, len(data)))
        chosen, same = distinct(data, firsts, sizes)
        raw = data.tobytes()
        found = self.merger.of([raw[a:b] for a, b in zip(firsts[chosen].tolist(), (firsts + sizes)[chosen].tolist())])
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        heads = np.cumsum(lengths) - lengths
        n_ids = lengths[same]
        ends = np.concatenate(([0], np.cumsum(n_ids)))
        ids = flat[np.repeat(heads[same] - ends[:-1], n_ids) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(firsts, offsets)]


def distinct(data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chosen slices, place among them of each slice's equal), so that most recurring slices are chosen once.

    Slices of up to 16 bytes are two integers; equal hashes of those are compared, longer ones are all chosen.
    """
    padded = np.concatenate((data, np.zeros(24, np.uint8)))
    at_byte = np.ndarray(len(data) + 16, dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    low = at_byte[firsts] & masks[np.minimum(sizes, 8)]
    high = at_byte[firsts + 8 * (sizes > 8)] & masks[np.clip(sizes - 8, 0, 8)]
    hashed = mix(low ^ mix(high + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, chosen, same = np.unique(hashed, return_index=True, return_inverse=True)
    like = chosen[same]
    apart = np.flatnonzero((sizes > 16) | (low != low[like]) | (high != high[like]) | (sizes != sizes[like]))
    same[apart] = len(chosen) + np.arange(len(apart))
    return np.concatenate((chosen, apart)), same


class Decoder:
    """Bytes of ids: the tokens' bytes lie in one array, in order of id."""

    def __init__(self, path: str) -> None:
        tokens = {rank: token for token, rank in ranks_of(path).items()}
        most = max(tokens) + 1
        self.sizes = np.array([len(tokens[i]) if i in tokens else -1 for i in range(most)], dtype=np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(np.maximum(self.sizes, 0))))
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(most)), dtype=np.uint8)

    def token_sizes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("an id that the rank file doesn't have")
        return self.sizes[ids]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids that stand one behind the other."""
        parts = [np.zeros(0, np.uint8)]
        for at in range(0, len(ids), GROUP_IDS):
            some = ids[at:at + GROUP_IDS]
            sizes = self.token_sizes(some)
            heads = np.cumsum(sizes) - sizes
            parts.append(self.bytes[np.repeat(self.firsts[some] - heads, sizes) + np.arange(sizes.sum())])
        return np.concatenate(parts)


# A Python worker keeps these, with the slices it remembers, for its next tasks.

@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids array<int> and (with `offsets`) starts array<long>, the first byte of each token.

    A null or empty text has no ids. Rows are independent, in any number of copies and with any id, null too; an
    empty table gives an empty result; other columns are not read. Special tokens are ordinary text. `path` is a rank file
    that every executor can read. A task holds GROUP_BYTES of text or one longer text; a slice without a cut takes
    some 300 bytes per byte while it is merged.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in slices(batch, 1, GROUP_BYTES):
                data, at = utf8(group.column(1))
                ids, firsts = encoder_of(path).encode(data, at)
                columns = [group.column(0), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    sizes = decoder_of(path).token_sizes(ids)
                    starts = np.cumsum(sizes) - sizes - np.repeat(at[:-1], np.diff(firsts))
                    columns.append(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(starts, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][:len(columns)])

    schema = f"doc_id {id_type}, ids array<int>" + (", starts array<bigint>" if offsets else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded binary, the bytes of a row's ids; null ids decode to no bytes, an id that the file lacks is an error."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    ids_at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                ids = batch.column(ids_at)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                firsts = np.concatenate(([0], np.cumsum(decoder_of(path).token_sizes(flat))))
                offsets = firsts[np.concatenate(([0], np.cumsum(counts)))]
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [
                    None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(decoder_of(path).decode(flat))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (bytes of the ids)."""
    both = decode(encode(docs, path, id_col, text_col, offsets=False), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
