"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the corpus.

1. Texts go in pieces of some MB, written once. A piece hashes every window of its texts and sends its distinct hashes,
   rising and packed, in a fixed number of ranges; what repeats within the piece it will find again by itself, however
   hot it is.
2. Each range is counted: a hash that several pieces have sent is repeated, and each piece gets a bit for each of its
   hashes. Where a range of the whole corpus is too large for a task, it is dealt once more into finer ranges, by groups
   of pieces: rows grow as the corpus does, not as its square.
3. The piece hashes its windows again; repeated ones merge into maximal intervals, which are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corvane.llm.frames import documents
from corvane.llm.hashing import U, Words
from corvane.llm.text_pieces import each_piece, opened, small, text_pieces, whole

WINDOW = 35
PIECE_BYTES = 6 << 20
#: Bytes of a piece whose words are held at once.
STEP = 1 << 20
#: Ranges of hashes that a piece sends, and that a range is dealt into again where there is need.
RANGE_BITS = 8
#: Bytes of text whose hashes a task counts at once.
RANGE_BYTES = 32 << 20

#: rows of the way there: a range, the group of pieces that its row is of, the pieces, how many hashes each has, and these
_SENT = pa.schema([("range", pa.int64()), ("unit", pa.int64()), ("pieces", pa.binary()), ("runs", pa.binary()), ("hashes", pa.binary())])
#: and back: with a bit for each hash
_COUNTED = pa.schema([("unit", pa.int64()), ("range", pa.int64()), ("pieces", pa.binary()), ("runs", pa.binary()), ("bits", pa.binary())])


def _pack(rising: np.ndarray) -> bytes:
    """Hashes of several runs, each rising: steps, byte by byte, first all first bytes, which compress better so."""
    step = np.diff(rising, prepend=U(0))
    return small(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(whole(data), dtype=np.uint8).reshape(8, -1).T).view(U).reshape(-1), dtype=U)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _bits(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(whole(data), dtype=np.uint8), count=size).astype(bool)


def windows_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in the text and hash of every window of `size` words, some texts at a time."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U))]
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and held < STEP:
            held += len(texts[stop])
            stop += 1
        words = Words(texts[start:stop])
        at, hashes = words.windows(size)
        text = words.text_of(at)
        found.append((start + text, at - words.first[text], hashes))
        start = stop
    text, place, hashes = (np.concatenate([f[i] for f in found]) for i in range(3))
    return text, place, hashes


def _split(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges, by the first `bits` bits, that hold some of the rising hashes, and where."""
    top = (hashes >> U(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(top)], strict=True):
        yield int(top[a]), slice(a, b)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _sent(pieces: DataFrame, size: int, bits: int) -> DataFrame:
    """The pieces' distinct hashes by range; a row is a unit by itself."""

    def make(number: int, texts: list[bytes], _: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes = np.unique(windows_of(texts, size)[2])
        one = np.int64(number).tobytes()
        yield _rows([(r, number, one, np.int64(s.stop - s.start).tobytes(), _pack(hashes[s])) for r, s in _split(hashes, bits)], _SENT)

    return each_piece(pieces, make, _SENT)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pieces and runs of all rows, and each row's hashes."""
    col = {c: table.column(c).to_pylist() for c in ("pieces", "runs", "hashes")}
    return np.concatenate([_longs(x) for x in col["pieces"]]), np.concatenate([_longs(x) for x in col["runs"]]), [_unpack(x) for x in col["hashes"]]


def _deal_again(table: pa.Table, bits: int) -> pa.Table:
    """One unit's rows of one range, in finer ranges: a row for each holds all the unit's pieces."""
    unit = table.column("part")[0].as_py()
    pieces, runs, hashes = _flat(table)
    owner, every = np.repeat(np.arange(len(pieces)), runs), np.concatenate(hashes)
    fine = (every >> U(64 - bits)).astype(np.int64)
    order = np.argsort(fine, kind="stable")  # within a range: by piece, rising
    fine, owner, every = fine[order], owner[order], every[order]
    heads = np.flatnonzero(np.diff(fine, prepend=-1))
    out = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(fine)], strict=True):
        who, n = np.unique(owner[a:b], return_counts=True)
        out.append((int(fine[a]), unit, pieces[who].tobytes(), n.astype(np.int64).tobytes(), _pack(every[a:b])))
    return pa.Table.from_batches([_rows(out, _SENT)])


def _count(table: pa.Table) -> pa.Table:
    """Of one range: a bit for each hash of each row, set if another piece has it too."""
    _, _, hashes = _flat(table)
    every = np.concatenate(hashes)
    order = np.argsort(every)
    ranked = every[order]
    same = np.zeros(len(ranked) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(every), dtype=bool)
    repeated[order] = same[1:] | same[:-1]
    ends = np.cumsum([len(h) for h in hashes])
    bits = [small(np.packbits(repeated[e - len(h) : e]).tobytes()) for e, h in zip(ends.tolist(), hashes, strict=True)]
    return pa.Table.from_arrays([table.column("unit"), table.column("range"), table.column("pieces"), table.column("runs"), pa.array(bits, pa.binary())], schema=_COUNTED)


def _by_piece(table: pa.Table) -> pa.Table:
    """One unit's rows of all fine ranges as a row for each piece: its bits in the order of its hashes."""
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r, pieces, runs, bits in zip(*(table.column(c).to_pylist() for c in ("range", "pieces", "runs", "bits")), strict=True):
        ends = np.cumsum(_longs(runs))
        flags = _bits(bits, int(ends[-1]))
        for p, n, e in zip(_longs(pieces).tolist(), _longs(runs).tolist(), ends.tolist(), strict=True):
            found.setdefault(p, []).append((r, flags[e - n : e]))
    out = []
    for p, parts in found.items():
        parts.sort(key=lambda x: x[0])
        flags = np.concatenate([f for _, f in parts])
        one = np.int64(p).tobytes()
        out.append((p, parts[0][0], one, np.int64(len(flags)).tobytes(), small(np.packbits(flags).tobytes())))
    return pa.Table.from_batches([_rows(out, _COUNTED)])


def repeated_hashes(pieces: DataFrame, size: int) -> DataFrame:
    """Rows of _COUNTED whose unit is a piece: by rising range, a bit for each of its distinct hashes that another piece has too."""
    total = pieces.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    bits, wanted = RANGE_BITS, max(0, (-(-(total["b"] or 0) // RANGE_BYTES) - 1).bit_length())
    sent = _sent(pieces, size, bits)
    if wanted <= bits:
        return sent.groupBy("range").applyInArrow(_count, from_arrow_schema(_COUNTED))
    # a unit is what a task holds of one range: so many pieces' rows
    units = -(-(total["b"] >> bits) // RANGE_BYTES)
    part = F.xxhash64("range", F.pmod(F.xxhash64("unit", "range"), F.lit(units)))
    dealt = sent.withColumn("part", part).groupBy("range", "part").applyInArrow(lambda t: _deal_again(t, wanted), from_arrow_schema(_SENT))
    counted = dealt.groupBy("range").applyInArrow(_count, from_arrow_schema(_COUNTED))
    return counted.groupBy("unit").applyInArrow(_by_piece, from_arrow_schema(_COUNTED))


def _cut(text: bytes, places: np.ndarray, size: int) -> tuple[int, int, list[tuple[int, int]], bytes]:
    """Words, words removed, their intervals, and what is kept; `places` are rising word positions of repeated windows."""
    words = text.split()
    n = len(words)
    if not len(places):
        return n, 0, [], b" ".join(words)
    new = np.flatnonzero(np.diff(places, prepend=-size - 1) > size)
    starts, ends = places[new], places[np.append(new[1:], len(places)) - 1] + size
    kept, last = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept += words[last:s]
        last = e
    kept += words[last:]
    return n, int((ends - starts).sum()), list(zip(starts.tolist(), ends.tolist(), strict=True)), b" ".join(kept)


def _removed(piece: pa.Table, answers: pa.Table, size: int, schema: pa.Schema) -> pa.Table:
    """Of one piece: a row for each text."""
    ids, texts, _ = opened(piece)
    text, place, hashes = windows_of(texts, size)
    _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("range", "runs", "bits")), strict=True))
    elsewhere = np.concatenate([np.zeros(0, dtype=bool), *[_bits(bits, int(_longs(runs)[0])) for _, runs, bits in rows]])
    gone = (elsewhere | (times > 1))[back] if len(hashes) else np.zeros(0, dtype=bool)
    text, place = text[gone], place[gone]
    edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    got = [_cut(t, place[a:b], size) for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True)]
    spans = pa.array([[{"start": s, "end": e} for s, e in g[2]] for g in got], schema.field("spans").type)
    kept = pa.array([g[3].decode("utf-8", "replace") for g in got], pa.string())
    return pa.Table.from_arrays([ids, pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), spans, kept], schema=schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (array of start, end in words), kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`. A window is `size` consecutive words of one document. Every word
    covered by a window whose words also start anywhere else, the same document included, is removed;
    windows are judged on the input. Overlapping and touching windows merge into one span. What is kept is
    joined by one space.

    Null text counts as empty and texts of fewer than `size` words have no window: nothing is removed.
    Repeated rows (same id and text) repeat each other's windows and get the same result, one row each;
    ids may be null. Other columns are not read. An empty table gives an empty result. Windows are equal by a hash of
    61 bits over words' hashes of 64, so a window is removed wrongly with a chance of (windows in the corpus) * size / 2**61.
    """
    pieces = text_pieces(docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), F.lit(True)), PIECE_BYTES)
    spans = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType([StructField("__cv_id", docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", spans), StructField("kept_text", StringType())])
    arrow = to_arrow_schema(schema)
    counted = repeated_hashes(pieces, size).withColumnRenamed("unit", "piece")
    out = pieces.groupBy("piece").cogroup(counted.groupBy("piece")).applyInArrow(lambda p, a: _removed(p, a, size, arrow), schema)
    return out.withColumnRenamed("__cv_id", id_col)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    got = substring_dedup(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT rid, i + o AS p FROM win JOIN rep USING (k), range(0, 35) t(o)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN cov ON word.rid = cov.rid AND word.p = cov.p GROUP BY word.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid
"""
