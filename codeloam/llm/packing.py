"""Filling containers of fixed capacity with texts.

Sizes are counted with a public tokenizer. Texts are spread over blocks of bounded size by a hash, and each block is
divided into windows by Karmarkar-Karp multiway differencing: partial partitions with the largest imbalance are merged,
the largest sums of one with the smallest of the other, until one partition is left. Its windows are nearly equal; while
one of them is above the capacity, the number of windows rises and the block is divided anew.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import changed, stored, whole_groups

#: Where the vocabulary file of the tokenizer lies, on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts texts before merging: the pattern published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GAP = re.compile(r"\S (?=\S)")
#: Texts in a block, about.
BLOCK = 4096


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _stretches(text: str, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about `most` characters. They end before a single blank between two words, where the pattern always cuts."""
    a = 0
    while len(text) - a > most:
        b = text.rfind(" ", a + 1, a + most)
        while b > a and (text[b - 1].isspace() or text[b + 1].isspace()):
            b = text.rfind(" ", a + 1, b)
        if b <= a:  # no such place: the stretch goes on to the next
            m = _GAP.search(text, a + most)
            if m is None:
                break
            b = m.start() + 1
        yield a, b
        a = b
    yield a, len(text)


def token_counts(documents: DataFrame, id_: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every text that is not null; an empty text has 0 tokens. Long texts are encoded in stretches that end where tokens do, so the count is that of the whole."""
    rows = documents.where(F.col(text).isNotNull()).select(id_, text)
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [sum(len(encode(t[a:b])) for a, b in _stretches(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_, "n_tokens"])

    return rows.mapInArrow(run, f"`{id_}` {kind}, n_tokens long")


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by multiway differencing. Partial partitions hold only their sums above the least one."""
    n = len(sizes)
    # a part is (sums in falling order, for each sum the node and slot it comes from); nodes 0 .. n - 1 are the items
    sums: list[np.ndarray | None] = [np.array([s], np.int64) for s in sizes]
    left: list[tuple | None] = [None] * n
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        a, b = sums[i], sums[j]
        over = max(0, len(a) + len(b) - windows)
        # the smallest `over` sums of the one meet those of the other in opposite order; the rest stay alone
        both = a[len(a) - over :] + b[len(b) - over :][::-1] if over else a[:0]
        merged = np.concatenate([a[: len(a) - over], b[: len(b) - over], both])
        from_a = np.r_[np.arange(len(a) - over), np.full(len(b) - over, -1), np.arange(len(a) - over, len(a))].astype(np.int32)
        from_b = np.r_[np.full(len(a) - over, -1), np.arange(len(b) - over), np.arange(len(b) - over, len(b))[::-1]].astype(np.int32)
        order = np.argsort(-merged, kind="stable")
        merged, from_a, from_b = merged[order], from_a[order], from_b[order]
        if len(merged) == windows:
            merged = merged - merged[-1]
        sums[i] = sums[j] = None
        sums.append(merged)
        left.append((i, from_a, j, from_b))
        low = int(merged[-1]) if len(merged) == windows else 0
        heapq.heappush(heap, (low - int(merged[0]), len(sums) - 1))
    out = np.zeros(n, np.int64)
    if not n:
        return out
    slots = {heap[0][1]: np.arange(len(sums[heap[0][1]]))}
    for node in range(len(sums) - 1, -1, -1):
        mine = slots.pop(node, None)
        if mine is None:
            continue
        if node < n:
            out[node] = mine[0]
            continue
        i, from_a, j, from_b = left[node]
        for child, where in ((i, from_a), (j, from_b)):
            has = where >= 0
            into = np.zeros(int(has.sum()), np.int64)
            into[where[has]] = mine[has]
            slots[child] = into
    return out


def divide(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows for the items of a block, none above the capacity, and their number; items must fit one by one."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, windows)
        if not len(sizes) or np.bincount(at, sizes, minlength=windows).max() <= capacity:
            return at, windows
        windows += max(1, windows // 200)


RESULT = "piece int, first_token long, n_tokens long, container long"


def pack(documents: DataFrame, capacity: int, id_: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Per text and piece: id, piece, first_token, n_tokens, container. No container holds more than `capacity` tokens.

    A text above the capacity is cut into pieces that fill a container each, and what remains goes with the others; no
    other text is cut. Null texts are left out, empty ones take no space; repeated rows are packed each for itself; other
    columns are ignored; no rows give no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counted = stored(token_counts(documents, id_, text, tokenizer))
    kind = counted.schema[id_].dataType.simpleString()
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)
    pieces = counted.select(id_, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity)
    pieces = pieces.select(id_, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), size.alias("n_tokens"))
    blocks = max(1, -(-counted.count() // block))
    placed = pieces.withColumn("_block", F.pmod(F.xxhash64(id_, "piece", F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = [0, *([i + 1 for i, x in enumerate(changed(table, ["_block"]).to_pylist()) if x] if table.num_rows > 1 else []), table.num_rows]
        sizes, number = table.column("n_tokens").to_numpy(), table.column("_block").to_numpy()
        out = np.zeros(table.num_rows, np.int64)
        for a, b in zip(cuts, cuts[1:]):
            at, _ = divide(sizes[a:b], capacity)
            out[a:b] = (number[a] << 32) + at
        yield from table.drop_columns(["_block"]).append_column("container", pa.array(out)).to_batches(max_chunksize=10_000)

    # a number of its own, since the rows are few bytes and the work on them is not: adaptive execution would put all into one task
    wide = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(min(blocks, max(wide, blocks // 64)), "_block").sortWithinPartitions("_block", "n_tokens", id_, "piece")
    return ordered.mapInArrow(whole_groups(["_block"], run), f"`{id_}` {kind}, {RESULT}")
