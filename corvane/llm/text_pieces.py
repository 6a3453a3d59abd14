"""Texts in pieces of some MB, written once: what a piece asks of the whole corpus and what it is answered goes by its number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from corvane.llm.frames import give_back, pieces, rewritten, small_batches

_PIECE = "piece long, ids array<{kind}>, marks binary, sizes binary, body binary, bytes long"


def small(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def whole(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def text_pieces(rows: DataFrame, most: int, form: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """The rows (id, text, mark), about `most` bytes of text to a piece, in a table of their own. One longer text makes a piece.

    Null texts count as empty; `form` is applied to each text.
    """
    kind = rows.schema[0].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, pa.Array, list[bytes]]] = []
        size = done = 0

        def piece() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            marks = np.concatenate([np.asarray(h[1].to_pylist(), dtype=bool) for h in held])
            texts = [t for h in held for t in h[2]]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            values = ([task + done], pa.int64()), *[([x], pa.binary()) for x in (marks.tobytes(), small(sizes.tobytes()), small(b"".join(texts)))], ([int(sizes.sum())], pa.int64())
            first, *rest = [pa.array(*v) for v in values]
            return pa.RecordBatch.from_arrays([first, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *rest], names=[c.split()[0] for c in _PIECE.split(", ")])

        for batch, texts in pieces(batches, limit=max(1, most // 8)):
            held.append((batch.column(0), batch.column(2), [form(t) for t in texts]))
            size += sum(map(len, held[-1][2]))
            if size >= most:
                yield piece()
                held, size, done = [], 0, done + 1
        if held:
            yield piece()
        give_back()

    small_batches(rows.sparkSession)
    return rewritten(rows.mapInArrow(gather, _PIECE.format(kind=kind)))


def _texts(sizes: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(whole(sizes), dtype=np.int64)).tolist()
    data = whole(body)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def opened(piece: pa.Table) -> tuple[pa.Array, list[bytes], np.ndarray]:
    """Ids, texts and marks of a table that holds one piece."""
    row = piece.select(["marks", "sizes", "body"]).to_pylist()[0]
    return piece.column("ids").combine_chunks().flatten(), _texts(row["sizes"], row["body"]), np.frombuffer(row["marks"], dtype=bool)


def each_piece(rows: DataFrame, make: Callable[[int, list[bytes], np.ndarray], Iterator[pa.RecordBatch]], schema: pa.Schema, last: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The batches that `make` gives for each piece (its number, texts and marks), and `last` at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, marks, sizes, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield from make(number, _texts(sizes, body), np.frombuffer(marks, dtype=bool))
        if last is not None:
            yield from last()
        give_back()

    return rows.select("piece", "marks", "sizes", "body").mapInArrow(run, from_arrow_schema(schema))
