"""Best-fit-decreasing packing of token sequences into fixed-length rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakflow.llm.bpe import vocabulary
from leakflow.llm.staging import stage

#: Tokens that are packed together. Within so many the unfilled rest is small, and a task's memory stays bounded.
BLOCK_TOKENS = 1 << 22

PACK_SCHEMA = "pack_id long, length int, n_tokens int, token_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{}>, piece_starts array<long>"


class Capacities:
    """A segment tree over free capacities: which is the smallest one that an open row has, at or above a given size?"""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, length.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the tightest row that holds ``size``."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up until a right neighbour holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers, none longer than ``length``; every piece fits one row. Ties keep the pieces' order."""
    tree, rows = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found:
            free, row = found
            rows[row].append(i)
        else:
            free, row = length, len(rows)
            rows.append([i])
        tree.add(free - sizes[i], row)
    return rows


def pack(docs: DataFrame, path: str, length: int = 2048, pad_id: int = 0, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``length`` token ids made of whole documents and of pieces of overlong ones.

    ``token_ids`` is a row of the id matrix: ``length`` little-endian unsigned
    integers of 2 bytes (4 if the vocabulary has more than 65,536 ids), padded
    with ``pad_id`` after ``n_tokens``. ``position_ids`` has the same form and
    restarts at 0 with each segment and the padding. Segment i covers tokens
    cu_seqlens[i] to cu_seqlens[i + 1] and is document doc_ids[i] from its
    token piece_starts[i] on. A document of more than ``length`` tokens is cut
    into pieces of ``length`` and a rest, so all its tokens are there once.

    Each task packs what it reads in blocks of ``block_tokens``, so that no
    shuffle is needed and memory is bounded. A null or empty text has no token
    and is in no row; repeated rows are packed each; special tokens' strings
    in a text are ordinary text. Of equally long pieces the one that was read
    first is packed first, and of equally full rows the one that was opened
    first takes a piece. An empty table has no rows.
    """
    source = docs.select(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    id_type, id_name = source.schema[0].dataType, source.dtypes[0][1]
    kinds = pa.schema([("pack_id", pa.int64()), ("length", pa.int32()), ("n_tokens", pa.int32()), ("token_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64() if id_name == "bigint" else pa.string())), ("piece_starts", pa.list_(pa.int64()))])
    if id_type.simpleString() != "bigint":
        source, id_name = source.select(source[0].cast("string"), source[1]), "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        merges = vocabulary(path)
        width = np.dtype("<u2") if int(merges._made.max()) < 1 << 16 else np.dtype("<u4")
        next_id = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held, next_id
            rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for at in range(0, len(rows), 512):
                out: list[list] = [[] for _ in kinds]
                for row in rows[at : at + 512]:
                    parts = [pieces[i] for i in row]
                    sizes = [len(p[2]) for p in parts]
                    n = sum(sizes)
                    ids = np.full(length, pad_id, dtype=width)
                    ids[:n] = np.concatenate([p[2] for p in parts])
                    positions = np.concatenate([np.arange(k, dtype=width) for k in [*sizes, length - n]])
                    for column, value in zip(out, (next_id, length, n, ids.tobytes(), positions.tobytes(), np.cumsum([0, *sizes]).tolist(), [p[0] for p in parts], [p[1] for p in parts])):
                        column.append(value)
                    next_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, kinds)], schema=kinds)
            pieces, held = [], 0

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids, counts = merges.encode(part.column(1).to_pylist(), special=False)
                ids = ids.astype(width)
                stops = np.cumsum(counts)
                for key, n, stop in zip(part.column(0).to_pylist(), counts.tolist(), stops.tolist()):
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        pieces.append((key, start, ids[stop - n + start : stop - n + start + size]))
                    held += n
                    if held >= block_tokens:
                        yield from flush()
        if pieces:
            yield from flush()

    return source.mapInArrow(run, PACK_SCHEMA.format(id_name))


def unpack(packs: DataFrame, width: str = "<u2") -> DataFrame:
    """doc_id, piece_start, ids for each segment: the packing read back."""
    id_type = packs.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ids = [], [], []
            for row in batch.to_pylist():
                tokens, cuts = np.frombuffer(row["token_ids"], dtype=width), row["cu_seqlens"]
                keys += row["doc_ids"]
                starts += row["piece_starts"]
                ids += [tokens[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64() if id_type == "bigint" else pa.string()), pa.array(starts, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "piece_start", "ids"])

    return packs.mapInArrow(run, f"doc_id {id_type}, piece_start long, ids array<int>")


def write_packs(packs: DataFrame, path: str) -> None:
    """The packed rows as Parquet at ``path``; binary columns hold the matrices' rows as they are."""
    packs.write.mode("overwrite").option("compression", "zstd").parquet(path)


def staged_packs(packs: DataFrame) -> DataFrame:
    """The packed rows written to the shared folder and read again, so that tokenizing isn't repeated."""
    return stage(packs, "packs")
