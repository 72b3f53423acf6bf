"""Token counts by byte-pair merging with a heap and a linked list, without producing ids.

The vocabulary is a piece model with byte fallback. A text is one space marker followed by itself, spaces as
markers. Merging starts from single characters and repeatedly joins the adjacent pair whose joined piece has
the lowest rank, leftmost first; the count is the number of initial symbols minus the number of merges. A character
that is no piece counts as its UTF-8 bytes.

No piece contains a marker after another character (checked when the vocabulary is read), so merges never
cross the start of a word, and a character that occurs in no longer piece never merges. Texts are cut there,
whole; the counts of the cuts are remembered in a bounded table, since most of them recur.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Cuts whose counts a task remembers.
REMEMBERED = 400_000
#: Longer cuts are counted anew each time.
LONGEST_REMEMBERED = 64
#: Longer texts are counted in parts of about this many characters.
PART_CHARS = 1 << 20


def ranks_of(model: str) -> dict[str, int]:
    """Rank of every piece that merging can make or start from: the better the score, the lower the rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    usable = [i for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    order = sorted(usable, key=lambda i: -sp.get_score(i))
    pieces = {sp.id_to_piece(i): rank for rank, i in enumerate(order)}
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece spans the start of a word; texts cannot be cut there")
    if sp.normalize(" Aﬁ  é ") != f"{MARK}{MARK}Aﬁ{MARK}{MARK}é{MARK}":
        raise ValueError("the model changes characters before merging")
    return pieces


def merged_count(symbols: str, ranks: dict[str, int]) -> int:
    """Symbols left after merging; characters outside the vocabulary count as their bytes."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    piece: list[str | None] = list(symbols)
    rank_of = ranks.get
    heap = [(rank, i, pair) for i, pair in enumerate(map("".join, zip(symbols, symbols[1:])))
            if (rank := rank_of(pair)) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        # A stale entry: one of its two symbols has been merged since.
        if piece[i] is None or j >= n or piece[i] + piece[j] != joined:
            continue
        piece[i], piece[j] = joined, None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = joined + piece[k]
            if (rank := rank_of(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))
        k = before[i]
        if k >= 0:
            pair = piece[k] + joined
            if (rank := rank_of(pair)) is not None:
                heapq.heappush(heap, (rank, k, pair))
    return left + sum(len(c.encode()) - 1 for c in symbols if c not in ranks)


class _Counts(dict):
    """Counts of cuts, filled on demand and emptied when full."""

    def __init__(self, ranks: dict[str, int]) -> None:
        self.ranks = ranks
        # Two characters that stand together in no piece never end up in one symbol.
        self.together = {p[i:i + 2] for p in ranks for i in range(len(p) - 1)}

    def __missing__(self, cut: str) -> int:
        apart = [i for i in range(1, len(cut)) if cut[i - 1:i + 1] not in self.together]
        if apart:
            count = sum(self[cut[a:b]] for a, b in zip([0, *apart], [*apart, len(cut)]))
        else:
            count = merged_count(cut, self.ranks)
        if len(cut) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[cut] = count
        return count


def counter(ranks: dict[str, int]) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    merging = {c for p in ranks if len(p) > 1 for c in p}
    inside = "".join(re.escape(c) for c in sorted(merging - {MARK}))
    # Markers and the word behind them, or one character that never merges.
    cuts = re.compile(f"{MARK}+[{inside}]*|[{inside}]+|.", re.DOTALL)
    counts = _Counts(ranks)

    def count(text: str) -> int:
        at, total = 0, 0
        # A long text goes in parts that begin with a space behind another character, where cuts begin anyway.
        while at < len(text):
            end = at + PART_CHARS
            while 0 <= (end := text.find(" ", end)) and text[end - 1] in (" ", MARK):
                end += 1
            end = len(text) if end < 0 else end
            part = text[at:end].replace(" ", MARK)
            total += sum(map(counts.__getitem__, cuts.findall(part if at else MARK + part)))
            at = end
        return total

    return count


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have 0 of both. Rows are independent, in any number of copies and with any id; other
    columns are not read. There is no shuffle. `model` is a path that every executor can read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(ranks_of(model))
            n_tokens = pa.array((count(t.as_py()) for t in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n_tokens],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = (read.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
               .mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
