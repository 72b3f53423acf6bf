"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs LINEAR * n + QUADRATIC * n**2, an estimate of the work of its projections and its
attention. The documents of a block (about BLOCK_TOKENS tokens that stand together in a partition) get as few
sequences as hold their tokens. In descending order of cost, each goes to the sequence of lowest cost
that has token capacity left; what does not fit is cut off and goes to the next. A block thus
leaves less than one sequence of padding, and long documents are spread over the sequences.

Tokens never leave the task that makes them: there is no shuffle, memory is bounded by a block and the
longest document, and a lost task repeats alone.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
BLOCK_TOKENS = 1 << 19
#: Longer texts are encoded in parts of about this many characters.
PART_CHARS = 1 << 20
#: Id that ends a document.
END = 0


def encoder(tokenizer: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE file, without special tokens added.

    The file's vocabulary and pattern are handed to the faster of the two installed encoders, which gives the
    same ids; strings of the file's special tokens inside a text become those tokens, as the file says.
    """
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("not a plain byte-level BPE file")
    # The file writes bytes as printable characters: printable bytes as themselves, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        marked = any(s in text for s in special)
        parts = [encoding.encode(p, allowed_special="all") if marked else encoding.encode_ordinary(p) for p in text_parts(text)]
        return np.concatenate([np.array(p, dtype="<u4") for p in parts]) if parts else np.zeros(0, "<u4")

    return encode


def text_parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """Cuts a long text before single spaces between a non-space and a letter, where the pattern always cuts too."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while 0 <= (cut := text.find(" ", cut)) < len(text) - 1:
            if not text[cut - 1].isspace() and text[cut + 1].isalpha():
                break
            cut += 1
        else:
            break
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def place(lengths: list[int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of the given lengths.

    Documents of a capacity or more first fill whole sequences. The rest goes out in descending order of
    cost, ties in order of the documents.
    """
    sequence = 0
    rests: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            yield doc, start, capacity, sequence, 0
            sequence += 1
        if n % capacity:
            rests.append((-(n % capacity), doc, n - n % capacity))
    rests.sort()
    needed = -(-sum(-r[0] for r in rests) // capacity)
    open_sequences = [(0.0, sequence + i, 0) for i in range(needed)]
    for negative, doc, start in rests:
        left = -negative
        while left:
            spent, target, used = heapq.heappop(open_sequences)
            n = min(left, capacity - used)
            yield doc, start, n, target, used
            start, left = start + n, left - n
            if used + n < capacity:
                heapq.heappush(open_sequences, (spent + cost(n), target, used + n))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and one end id, so a null or empty text is one token. Each id lies in
    exactly one piece, and the pieces of a sequence follow each other without gaps from offset 0. Rows are
    packed as they come, repeated ids and null ids too; an empty table gives an empty result; other columns are not
    read. Sequence ids are unique and repeat when the input has the same partitions.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0
        end = np.array([END], dtype="<u4")

        def packed() -> pa.RecordBatch:
            nonlocal base, held
            doc, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*place([len(t) for t in tokens], capacity)))
            crc = [zlib.crc32(tokens[d][s:s + n].tobytes()) for d, s, n in zip(doc, start, length)]
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            out = pa.RecordBatch.from_arrays([
                pa.array(ids, type=kind).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(sizes[doc]), pa.array(sequence + base), pa.array(offset)], names=names)
            base += int(sequence.max()) + 1
            ids.clear()
            tokens.clear()
            held = 0
            return out

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                tokens.append(np.concatenate([encode(text.as_py() or ""), end]))
                held += len(tokens[-1])
                if held >= BLOCK_TOKENS:
                    yield packed()
        if tokens:
            yield packed()

    schema = ", ".join([f"doc_id {id_type}", *[f"{c} long" for c in names[1:]]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
