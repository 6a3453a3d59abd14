"""LM scoring by prediction by partial matching, beside a unigram base score.

The model is a trie of byte contexts up to order 5. Its counts come from all training texts, and every string
counted is kept. Strings are dealt by the three bytes before the last one to a fixed number of buckets; so a bucket
holds all longer contexts of its strings whole. Only strings of three bytes and fewer, at most 2**24 and in text far
fewer, are sent to all tasks.

Texts go in pieces of some MB, written once. A piece asks each bucket for the weights of its distinct strings, and
gets them back in their order; a bucket's counts are merged before it answers, and what pieces ask only streams by.
So rows grow as the pieces do, a task holds one bucket's counts and one piece, and no text or key is sent twice.

A byte is coded in the longest context known. A context that lacks it escapes (method C: as often as it
has distinct symbols) to the next shorter one, where the symbols already ruled out are excluded from the counts.
Below order 0 the symbols left are equally likely. Texts are coded as their words, lower-cased, joined by one space,
with an end symbol: the events that the base score has too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from corvane.llm.frames import checkpointed, documents, give_back, rewritten
from corvane.llm.hashing import U, Words, pack_values, unpack_values
from corvane.llm.text_pieces import each_piece, opened, small, text_pieces, whole

ORDER = 5
#: Bytes that UTF-8 never has stand for what is before a text and for its end.
BEFORE, END = 0xFE, 0xFF
#: Strings of orders up to this are sent to all tasks.
SHARED = 2
#: Spreads three bytes over 24 bits, and its inverse.
_SPREAD, _BACK = 0x9E3779, pow(0x9E3779, -1, 1 << 24)


def coded(text: bytes) -> bytes:
    """What is coded of a text: its words, lower-cased, joined by one space, and the end."""
    return b" ".join(text.lower().split()) + bytes([END])


def strings_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes before each coded byte and the byte, as one integer; and the end of each text's part."""
    lead = bytes([BEFORE]) * ORDER
    parts = [lead + coded(t) for t in texts]
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    key = np.zeros(len(buf), dtype=U)
    for back in range(ORDER + 1):
        key[back:] |= buf[: len(buf) - back].astype(U) << U(8 * back)
    coded_byte = np.ones(len(buf), dtype=bool)
    for i in range(ORDER):
        coded_byte[ends - sizes + i] = False
    return key[coded_byte], np.cumsum(sizes - ORDER)


@dataclass
class Trie:
    """strings[k]: sorted integers of k context bytes and a symbol, with their counts. Contexts follow from them."""

    strings: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Trie:
        """From counts of distinct strings of ORDER + 1 bytes; shorter ones are sums."""
        order = np.argsort(keys)
        keys, counts = keys[order].astype(U), counts[order].astype(np.int64)
        strings, kept = [], []
        for k in range(ORDER + 1):
            short = keys & U((1 << 8 * (k + 1)) - 1)
            uniq, back = np.unique(short, return_inverse=True)
            n = np.zeros(len(uniq), dtype=np.int64)
            np.add.at(n, back, counts)
            strings.append(uniq)
            kept.append(n)
        return cls(strings, kept)


class Scorer:
    """Code lengths of whole strings, found once for each distinct string of a piece of text."""

    def __init__(self, trie: Trie) -> None:
        self.strings, self.counts = trie.strings, trie.counts
        self.contexts, self.total, self.kinds, self.ruled_out = [], [], [], []
        for k in range(ORDER + 1):
            s, n = self.strings[k], self.counts[k]
            ctx, at = np.unique(s >> U(8), return_inverse=True)
            total, kinds = np.zeros(len(ctx), dtype=np.int64), np.zeros(len(ctx), dtype=np.int64)
            np.add.at(total, at, n)
            np.add.at(kinds, at, 1)
            # what the symbols of this context count for in the next shorter one, which has them all
            out = np.zeros(len(ctx), dtype=np.int64)
            if k:
                shorter = np.searchsorted(self.strings[k - 1], s & U((1 << 8 * k) - 1))
                np.add.at(out, at, self.counts[k - 1][shorter])
            self.contexts.append(ctx)
            self.total.append(total)
            self.kinds.append(kinds)
            self.ruled_out.append(out)

    @staticmethod
    def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, or -1."""
        if not len(sorted_values):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
        return np.where(sorted_values[at] == wanted, at, -1)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte after the bytes before it."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        mass, kinds_out = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for k in range(ORDER, -1, -1):
            if not len(open_):
                return out
            short = keys[open_] & U((1 << 8 * (k + 1)) - 1)
            ctx = self._find(self.contexts[k], short >> U(8))
            known = ctx >= 0
            here, ctx, short = open_[known], ctx[known], short[known]
            c = self.total[k][ctx] - mass[here]
            q = self.kinds[k][ctx] - kinds_out[here]
            sym = self._find(self.strings[k], short)
            hit = sym >= 0
            with np.errstate(divide="ignore"):
                out[here[hit]] += np.log10(self.counts[k][sym[hit]] / (c + q)[hit])
                # a context whose symbols are all ruled out escapes for certain
                miss = ~hit
                out[here[miss]] += np.where(c[miss] > 0, np.log10(np.maximum(q[miss], 1) / np.maximum((c + q)[miss], 1)), 0.0)
            mass[here[miss]] = self.ruled_out[k][ctx[miss]]
            kinds_out[here[miss]] = self.kinds[k][ctx[miss]]
            open_ = np.sort(np.concatenate([open_[~known], here[miss]]))
        out[open_] -= np.log10(np.maximum(256 - kinds_out[open_], 1))
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        keys, ends = strings_of(texts)
        uniq, back = np.unique(keys, return_inverse=True)
        running = np.concatenate(([0.0], np.cumsum(self.log10(uniq)[back])))
        return running[ends] - running[np.concatenate(([0], ends[:-1]))]


def adaptive_log10(text: bytes) -> float:
    """The same coder without training: each byte is coded by what the text has shown before it."""
    data = bytes([BEFORE]) * ORDER + coded(text)
    seen: list[dict[bytes, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
    total = 0.0
    for i in range(ORDER, len(data)):
        out: set[int] = set()
        for k in range(ORDER, -1, -1):
            node = seen[k].get(data[i - k : i])
            if not node:
                continue
            left = {s: n for s, n in node.items() if s not in out}
            c, q = sum(left.values()), len(left)
            if data[i] in left:
                total += np.log10(left[data[i]] / (c + q))
                break
            if c:
                total += np.log10(q / (c + q))
            out |= node.keys()
        else:
            total -= np.log10(256 - len(out))
        for k in range(ORDER + 1):
            node = seen[k].setdefault(data[i - k : i], {})
            node[data[i]] = node.get(data[i], 0) + 1
    return total


def shared_strings(counted: DataFrame) -> Trie:
    """The trie up to order SHARED: Spark sums the shortened strings' counts over all buckets (at most 2**24 rows come back)."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strings, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = _summed(string_form(_unpacked(strings)) & U((1 << 8 * (SHARED + 1)) - 1), unpack_values(whole(counts)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    got = counted.select("strings", "counts").mapInArrow(shorten, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    trie = Trie.build(np.asarray(got["k"], dtype=np.int64).astype(U), np.asarray(got["n"], dtype=np.int64))
    return Trie(trie.strings[: SHARED + 1], trie.counts[: SHARED + 1])


def dealt_form(keys: np.ndarray) -> np.ndarray:
    """Strings with the three bytes before the last one, spread, on top."""
    near = ((keys >> U(8)) & U(0xFFFFFF)) * U(_SPREAD) & U(0xFFFFFF)
    return (near << U(40)) | ((keys >> U(32)) << U(24)) | ((keys & U(0xFF)) << U(16))


def string_form(dealt: np.ndarray) -> np.ndarray:
    near = (dealt >> U(40)) * U(_BACK) & U(0xFFFFFF)
    return (((dealt >> U(24)) & U(0xFFFF)) << U(32)) | (near << U(8)) | ((dealt >> U(16)) & U(0xFF))


def bucket_scorer(own: Trie, shared: Trie) -> Scorer:
    """Scores a bucket's strings by the bucket's own counts and the shared ones."""
    return Scorer(Trie(shared.strings + own.strings[SHARED + 1 :], shared.counts + own.counts[SHARED + 1 :]))


#: the value of the end token, which no word has but by chance
END_HASH = U(0xE4D0E4D0E4D0E4D1)
#: Bytes of text that make a piece, whose distinct strings and tokens are asked for once; one longer text makes a piece of its own.
PIECE_BYTES = 6 << 20
#: Bytes of a piece whose strings are held as integers at once.
STEP = 1 << 18
#: Buckets of strings, by the three bytes before the last one, whatever the size of the corpus.
BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
#: Strings that a task counts before it passes them on, rows of counts that are merged at once, and pieces that a task answers for a bucket.
MOST_COUNTED, MERGED_AT_ONCE, PIECES_AT_ONCE = 1 << 20, 64, 1 << 16


def _packed(rising: np.ndarray) -> bytes:
    """Rising dealt strings: their steps byte by byte, first all first bytes, which compress well."""
    step = np.diff(rising >> U(16), prepend=U(0))
    return small(step.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(whole(data), dtype=np.uint8).reshape(6, -1)
    step = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    step[:, :6] = planes.T
    return np.cumsum(step.view(U).reshape(-1), dtype=U) << U(16)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by key, keys rising."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] + U(1))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


class Piece:
    """Some texts as they are coded, one after the other."""

    def __init__(self, parts: list[bytes]) -> None:
        lead = bytes([BEFORE]) * ORDER
        self.texts = parts
        self.buf = np.frombuffer(b"".join(x for p in parts for x in (lead, p)), dtype=np.uint8)
        self.sizes = np.array([len(p) + ORDER for p in parts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes + ORDER

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dealt form and text of each coded byte's string, some of them at a time."""
        for a in range(0, len(self.buf), STEP):
            b = min(a + STEP, len(self.buf))
            low = max(0, a - ORDER)
            one = self.buf[low:b].astype(U)
            two = one.copy()
            two[1:] |= one[:-1] << U(8)
            key = two.copy()  # ORDER + 1 bytes are three times two
            key[2:] |= two[:-2] << U(16)
            key[4:] |= two[:-4] << U(32)
            first, last = np.searchsorted(self.ends, [a, b - 1], side="right")
            text = np.repeat(np.arange(first, last + 1), np.minimum(self.ends[first : last + 1], b) - np.maximum(self.ends[first : last + 1] - self.sizes[first : last + 1], a))
            coded_byte = np.ones(b - a, dtype=bool)
            lead = (self.starts[first : last + 1, None] - np.arange(1, ORDER + 1)).reshape(-1) - a
            coded_byte[lead[(lead >= 0) & (lead < b - a)]] = False
            yield dealt_form(key[a - low :][coded_byte]), text[coded_byte]

    def strings(self, train: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct dealt strings, rising, and how often each stands; of the texts marked by `train`, if given."""
        found = []
        for key, text in self.steps():
            key = key if train is None else key[train[text]]
            found.append(np.unique(key, return_counts=True))
        return _summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))

    def tokens(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Value and text of each token, some texts at a time; the ends of the texts come last."""
        start = 0
        while start < len(self.texts):
            stop, size = start, 0
            while stop < len(self.texts) and size < 4 * STEP:
                size += len(self.texts[stop])
                stop += 1
            words = Words([t[:-1] for t in self.texts[start:stop]])
            ends = np.arange(stop - start)
            yield np.concatenate([words.hashes, np.full(len(ends), END_HASH)]), start + np.concatenate([np.repeat(ends, np.diff(words.first)), ends])
            start = stop


class Places:
    """Finds the places of values in an array of distinct ones that has them all, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = U(64 - max(4, (2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.last = size - 1
        self.keys, self.places = np.zeros(size, dtype=U), np.full(size, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = left[self.places[slot[left]] < 0]
            self.keys[slot[free]], self.places[slot[free]] = keys[free], free
            left = left[self.places[slot[left]] != left]
            slot[left] = (slot[left] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out = self.places[slot]
        other = np.flatnonzero(self.keys[slot] != keys)
        while len(other):
            slot[other] = (slot[other] + 1) & self.last
            out[other] = self.places[slot[other]]
            other = other[self.keys[slot[other]] != keys[other]]
        return out


def _by_bucket(dealt: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets that hold some of the rising dealt strings, and where."""
    cuts = np.searchsorted(dealt >> U(64 - BUCKET_BITS), np.arange(BUCKETS + 1, dtype=U))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(cuts[b], cuts[b + 1])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_COUNTED = pa.schema([("bucket", pa.int32()), ("strings", pa.binary()), ("counts", pa.binary())])
_ASKED = pa.schema([("piece", pa.int64()), ("bucket", pa.int32()), ("strings", pa.binary())])
_ANSWER = pa.schema([("piece", pa.int64()), ("bucket", pa.int32()), ("weights", pa.binary())])
_TOKEN = pa.schema([("piece", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])


def _each_piece(pieces: DataFrame, make: Callable[[int, Piece, np.ndarray], Iterator[pa.RecordBatch]], schema: pa.Schema, last: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The batches that `make` gives for each piece (its number, itself, its training marks), and `last` at the end of a task."""

    return each_piece(pieces, lambda number, texts, train: make(number, Piece(texts), train), schema, last)


def counted_strings(pieces: DataFrame) -> DataFrame:
    """A row for each bucket: its distinct strings of the training texts, rising, and their counts.

    Tasks sum over their pieces first; rows of a bucket are then merged some at a time, in rounds, so that no merge holds
    more than a bucket's distinct strings some times over.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []  # of one task
    most_counted = MOST_COUNTED

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            strings, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            yield _batch([(b, _packed(strings[s]), small(pack_values(counts[s]))) for b, s in _by_bucket(strings)], _COUNTED)

    def make(_: int, piece: Piece, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        held.append(piece.strings(train))
        if sum(len(k) for k, _ in held) > most_counted:
            held[:] = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
            if len(held[0][0]) > most_counted:
                yield from out()

    def merge(rows: pa.Table) -> pa.Table:
        strings, counts = _summed(np.concatenate([_unpacked(x) for x in rows.column("strings").to_pylist()]), np.concatenate([unpack_values(whole(x)) for x in rows.column("counts").to_pylist()]))
        return pa.Table.from_batches([_batch([(rows.column("bucket")[0].as_py(), _packed(strings), small(pack_values(counts)))], _COUNTED)])

    parts = _each_piece(pieces, make, _COUNTED, out)
    sort = from_arrow_schema(_COUNTED)
    most = pieces.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    while most > MERGED_AT_ONCE:
        most = -(-most // MERGED_AT_ONCE)
        parts = parts.withColumn("part", F.pmod(F.xxhash64("strings", "counts"), F.lit(most))).groupBy("bucket", "part").applyInArrow(merge, sort)
    return checkpointed(parts.groupBy("bucket").applyInArrow(merge, sort))


def string_answers(pieces: DataFrame, counted: DataFrame, shared) -> DataFrame:
    """For each piece and bucket, the weights of the piece's distinct strings, in their order.

    A bucket's counts come first in its task; what pieces ask streams by, a row at a time. Where there are very many
    pieces, a bucket is answered by several tasks.
    """

    def ask(number: int, piece: Piece, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        strings = piece.strings()[0]
        yield _batch([(number, b, _packed(strings[s])) for b, s in _by_bucket(strings)], _ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Trie.build(np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))
        at, scorer = None, None
        for batch in batches:
            out = []
            for bucket, number, strings, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                dealt = _unpacked(strings)
                if counts is not None:
                    at, scorer = bucket, bucket_scorer(Trie.build(string_form(dealt), unpack_values(whole(counts))), shared.value)
                    continue
                if at != bucket:  # no training text has a string of this bucket
                    at, scorer = bucket, bucket_scorer(nothing, shared.value)
                out.append((number, bucket, scorer.log10(string_form(dealt)).tobytes()))
            if out:
                yield _batch(out, _ANSWER)
        give_back()

    parts = -(-pieces.count() // PIECES_AT_ONCE)
    asked = _each_piece(pieces, ask, _ASKED).select("bucket", "piece", "strings", F.lit(None).cast("binary").alias("counts"), F.pmod(F.xxhash64("piece"), F.lit(max(parts, 1))).cast("int").alias("part"))
    known = counted.select("bucket", F.lit(-1).cast("long").alias("piece"), "strings", "counts", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part"))
    streams = known.unionByName(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("counts").isNull())
    return streams.select("bucket", "piece", "strings", "counts").mapInArrow(answer, from_arrow_schema(_ANSWER))


def token_counts(pieces: DataFrame) -> DataFrame:
    """piece, token, n (times in the piece's training texts), c (times in all training texts), first (one row for each token)."""

    def make(number: int, piece: Piece, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [_summed(token, train[text].astype(np.int64)) for token, text in piece.tokens()]
        token, n = _summed(np.concatenate([t for t, _ in found]), np.concatenate([n for _, n in found]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), number), pa.int64()), pa.array(token.view(np.int64), pa.int64()), pa.array(n, pa.int64())], schema=_TOKEN)

    same = Window.partitionBy("token")
    return rewritten(_each_piece(pieces, make, _TOKEN).select("piece", "token", "n", F.sum("n").over(same).alias("c"), (F.col("piece") == F.min("piece").over(same)).alias("first")))


def _scored(pieces: pa.Table, answers: pa.Table, schema: pa.Schema) -> pa.Table:
    """Of one piece: a row for each text."""
    ids, found, train = opened(pieces)
    piece = Piece(found)
    texts = len(piece.texts)
    strings, tokens = answers.filter(pc.is_null(answers.column("token"))), answers.filter(pc.is_valid(answers.column("token")))
    in_order = sorted(zip(strings.column("bucket").to_pylist(), strings.column("weights").to_pylist(), strict=True))
    weights = np.frombuffer(b"".join(w for _, w in in_order), dtype=np.float64)
    place = Places(piece.strings()[0])
    score, base, known, each = np.zeros(texts), np.zeros(texts), np.zeros(texts, dtype=np.int64), np.zeros(texts, dtype=np.int64)
    for key, text in piece.steps():
        score += np.bincount(text, weights[place(key)], minlength=texts)
    count = tokens.column("c").to_numpy()
    place = Places(tokens.column("token").to_numpy().view(U))
    for token, text in piece.tokens():
        c = count[place(token)]
        base += np.bincount(text, np.log10(c + 0.1), minlength=texts)
        known += np.bincount(text[c > 0], minlength=texts)
        each += np.bincount(text, minlength=texts)
    return pa.Table.from_arrays([ids, pa.array(~train), pa.array(each, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], schema=schema)


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts whose crc32(id as text) mod 10 is not 0, all of them, and scores every whole text.
    Tokens are words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end. base_score is the sum over
    tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))); n_known counts tokens with c > 0. `score` is the
    log10 probability that the PPM model gives the words, joined by a space, and the end.

    Null text counts as empty: its one token is the end. A null id counts as empty text for the split.
    Repeated rows are learnt from as often as they stand and get equal scores. Without training texts all
    bytes and tokens are equally unlikely. An empty table gives an empty result; other columns are not read.
    Words are told apart by a 64-bit hash, strings of bytes exactly.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    pieces = text_pieces(docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), (~held_out).alias("__cv_train")), PIECE_BYTES, coded)
    counted = counted_strings(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(shared_strings(counted))
    tokens = token_counts(pieces)
    total = tokens.agg(F.sum("n").alias("n"), F.sum((F.col("first") & (F.col("c") > 0)).cast("long")).alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    strings = string_answers(pieces, counted, shared).select("piece", "bucket", "weights", F.lit(None).cast("long").alias("token"), F.lit(None).cast("long").alias("c"))
    answers = strings.unionByName(tokens.select("piece", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("weights"), "token", "c"))
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("__cv_id", kind), *[StructField(c, t) for c, t in (("held_out", BooleanType()), ("n_tokens", LongType()), ("n_known", LongType()), ("base_sum", DoubleType()), ("score", DoubleType()))]])
    arrow = to_arrow_schema(schema)
    scored = pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(lambda p, a: _scored(p, a, arrow), schema)
    return scored.select(
        F.col("__cv_id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))).alias("base_score"),
        "score",
    )


def op3_ppm_scoring(spark, sf_dir: str) -> DataFrame:
    return ppm_scores(documents(spark, sf_dir))
