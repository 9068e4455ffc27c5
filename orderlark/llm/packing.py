"""Token ids packed into fixed-width rows by best-fit-decreasing.

Documents are encoded and end with the end-of-text id. One longer than a row is split: its
full pieces are rows of their own, and the remainder is packed like any other document. Each
task gathers pieces up to BUFFER, sorts them by length, and puts each into the open row with
the least sufficient room; a segment tree over room sizes finds it in O(log width). So no
shuffle is needed, memory is bounded by the buffer, and a lost task repeats its own rows.

A row has its ids as a fixed-width little-endian matrix line, the cumulative segment lengths,
the position ids that start at 0 in each segment, and for each segment its document and the
offset of its first token there, so unpacked() gives back every token of every document.

Defined results: null and empty texts give a segment of the end id alone; null ids stay null;
repeated rows are packed each for itself; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.llm.common import table

WIDTH = 2048
BUFFER = 8192
#: Public byte-pair vocabulary: ranks file and the pattern it was made for.
TOKENIZERS = os.environ.get("ORDERLARK_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PACKED = (
    "part int, row long, doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"
)


class Room:
    """Rows by free room: a segment tree over 0..width counts the open rows of each size."""

    def __init__(self, width: int):
        self.base = 1 << width.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, size: int, by: int) -> None:
        at = size + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, size: int) -> None:
        self.rows[size].append(row)
        self._add(size, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Take out a row with the least room of at least `need`: (row, room)."""
        at = need + self.base
        while not self.count[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of the level
                return None
        while at < self.base:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        size = at - self.base
        self._add(size, -1)
        return self.rows[size].pop(), size


def best_fit_decreasing(lengths: Sequence[int], width: int) -> list[list[int]]:
    """Rows of item numbers, none longer in sum than width."""
    room, rows = Room(width), []
    for item in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        found = room.best(lengths[item])
        if found is None:
            found = (len(rows), width)
            rows.append([])
        row, free = found
        rows[row].append(item)
        room.put(row, free - lengths[item])
    return rows


def encoder(ranks: bytes):
    """Encoding from a ranks file's content, and its free id for the end of a text."""
    import tiktoken

    merged = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merged, special_tokens={}), len(merged)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def packed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, buffer: int = BUFFER, ranks_path: str | None = None) -> DataFrame:
    """Packed rows of all documents (PACKED)."""
    with open(ranks_path or f"{TOKENIZERS}/{RANKS}", "rb") as f:
        # The file's size is the vocabulary's, a megabyte or so.
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def lines(pieces: list[tuple], kind: str, end: int, part: int, first: int) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in ("doc_ids", "offsets", "cu_seqlens", "n_tokens", "ids", "position_ids")}
        for items in best_fit_decreasing([len(p[2]) for p in pieces], width):
            chosen = [pieces[i] for i in items]
            ends = np.cumsum([len(p[2]) for p in chosen])
            ids, places = np.full(width, end, kind), np.zeros(width, "<u2" if width <= 1 << 16 else "<u4")
            ids[: ends[-1]] = np.concatenate([p[2] for p in chosen])
            starts = np.repeat(np.concatenate(([0], ends[:-1])), [len(p[2]) for p in chosen])
            places[: ends[-1]] = np.arange(ends[-1]) - starts
            for name, value in zip(out, ([p[0] for p in chosen], [p[1] for p in chosen], [0, *ends.tolist()], int(ends[-1]), ids.tobytes(), places.tobytes()), strict=True):
                out[name].append(value)
        n = len(out["ids"])
        types = {"doc_ids": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64()), "cu_seqlens": pa.list_(pa.int32()), "n_tokens": pa.int32(), "ids": pa.binary(), "position_ids": pa.binary()}
        arrays = [pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), *(pa.array(out[c], types[c]) for c in types)]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "row", *types])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(shared.value)
        kind, part, row = id_type(end + 1), TaskContext.get().partitionId(), 0
        full: list[tuple] = []
        held: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(np.asarray(coder.encode_to_numpy(text or "", disallowed_special=()), kind), np.array([end], kind))
                for at in range(0, len(ids), width):
                    piece = (doc, at, ids[at : at + width])
                    (full if len(piece[2]) == width else held).append(piece)
                    # Pieces are handed on in bounded lots, also within a very long document.
                    for lot, most in ((full, 512), (held, buffer)):
                        if len(lot) >= most:
                            done = lines(lot, kind, end, part, row)
                            row += done.num_rows
                            lot.clear()
                            yield done
        for lot in (full, held):
            if lot:
                done = lines(lot, kind, end, part, row)
                row += done.num_rows
                yield done

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(pack, PACKED)


def unpacked(rows: DataFrame, kind: str = "<u2") -> DataFrame:
    """(doc_id, offset, ids): every segment with its token ids, the end id included."""

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "offset": [], "ids": []}
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], kind)
                for doc, offset, a, b in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                    for name, value in zip(out, (doc, offset, ids[a:b].astype(np.int32)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["offset"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32()))], names=list(out))

    return rows.mapInArrow(cut, "doc_id long, offset long, ids array<int>")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLE = {}
