"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state that every base symbol leads back to, so that it
accepts each spelling of each word. Then every merge (u, v) -> w, in order, places a gadget: where a
u-arc enters state q and q has a v-arc to r, the u-arc is led to a copy of q without its v-arc, and a
w-arc is added that goes from wherever the u-arc left straight to r. After the last merge one path is
left for each spelling: its BPE encoding. All arcs of a label lead to one state, so a copied state is the label it
was made for and the time of its gadget; whether a state has an arc follows from these.

Encoding reads a word's symbols once, from the first to the last. As one path alone spells each beginning of the word,
at most one arc ends at each place, and the state it leads to decides by the transition table which arcs leave there.
Nothing is tried and taken back. A full table has 2.4e9 entries, so entries are filled in as they are first asked for
(a lazily determinised automaton). Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import documents, map_texts

#: Words that a worker's newer table holds before it replaces the older one, and arcs before the table starts afresh.
WORD_TABLE, ARC_TABLE = 100_000, 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = (chr(256 + i) for i in range(256))
    return [chr(b) if b in set(plain) else next(odd) for b in range(256)]


class MergeAutomaton:
    """Labels are token ids. `suffix` marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        self.label = {i: s for s, i in vocab.items()}
        size = max(vocab.values(), default=-1) + 1
        #: when a label came to be (0: base symbol), and the pair that it replaces
        self.born, self.left, self.right = [0] * size, [-1] * size, [-1] * size
        #: the state that all arcs of a label lead to; state 0 is the first one, which has every arc
        self.target = [0] * size
        #: of each state: the label whose arcs a gadget led to it, and the gadget's time
        self.of, self.made = [-1], [0]
        #: time of the gadget that forbade v after u
        self.cut: dict[tuple[int, int], int] = {}
        #: labels that some arc bears: the base symbols, and merges as their gadgets are placed
        spelled = {i for s, i in vocab.items() if len(s[: len(s) - len(suffix)] if suffix and s.endswith(suffix) else s) == 1}
        for time, (u, v) in enumerate(merges, 1):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v], spelled)
        #: the transition table: by state and label the next state, or -1
        self.table: dict[int, int] = {}
        self.labels = size
        #: every beginning of an arc's spelling, with the arc's label if it is the whole (else -1), of arcs that can
        #: end inside a word; and the labels of those that end it
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, t in vocab.items():
            ends = bool(suffix) and s.endswith(suffix)
            spelling = s[: len(s) - len(suffix)] if ends else s
            if t not in spelled:
                continue
            if ends or not suffix:
                self.final[spelling] = t
            if not ends:
                for i in range(1, len(spelling)):
                    self.inner.setdefault(spelling[:i], -1)
                self.inner[spelling] = t
        self.longest = max(map(len, self.final), default=0)

    def _gadget(self, time: int, u: int, v: int, w: int, seen: set[int]) -> None:
        if w in seen or u not in seen or v not in seen or not self._leaves(self.target[u], v):
            return  # no path has v after u (any more), or another merge already spells w
        seen.add(w)
        after = self.target[v]
        self.of.append(u)
        self.made.append(time)
        self.target[u] = len(self.of) - 1
        self.cut[u, v] = time
        self.born[w], self.left[w], self.right[w], self.target[w] = time, u, v, after

    def _leaves(self, state: int, t: int) -> bool:
        """Whether arc t leaves the state.

        A copy has the arcs that its parent had, without one, and each later label w = (l, r) leaves
        exactly the states that l leaves. So either t goes back to its left part, at the time of its
        gadget, or the state goes back to the one that its label's right part led to when the label came to be.
        """
        if not state:
            return True
        u, now = self.of[state], self.made[state] + 1  # gadgets before this time count
        while True:
            when = self.cut.get((u, t))
            if when is not None and when < now:
                return False
            if self.born[u] >= self.born[t]:
                if not self.born[u]:
                    return True
                now, u = self.born[u], self.right[u]
            else:
                # t's gadget added its arc wherever its left part had one, the copy made then included
                now, t = min(now, self.born[t] + 1), self.left[t]

    def step(self, state: int, t: int) -> int:
        """The transition: the state that arc t leads to, or -1."""
        key = state * self.labels + t
        to = self.table.get(key)
        if to is None:
            if len(self.table) >= ARC_TABLE:
                self.table.clear()
            to = self.table[key] = self.target[t] if self._leaves(state, t) else -1
        return to

    def path(self, word: str) -> list[int]:
        """The labels of the one path that spells the word (byte symbols, without the suffix)."""
        n, inner, final, table, labels = len(word), self.inner, self.final, self.table, self.labels
        #: by place in the word: the state there (-1: no arc ends there), and the arc that ends there
        states, arc, begun = [-1] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        states[0] = 0
        for at in range(n):
            state = states[at]
            if state < 0:
                continue
            base, end = state * labels, at + 1
            while end < n:
                t = inner.get(word[at:end])
                if t is None:
                    break
                if t >= 0:
                    to = table.get(base + t)
                    if to is None:
                        to = self.step(state, t)
                    if to >= 0:
                        states[end], arc[end], begun[end] = to, t, at
                end += 1
            if n - at <= self.longest:
                t = final.get(word[at:])
                if t is not None and self.step(state, t) >= 0:
                    states[n], arc[n], begun[n] = 0, t, at
        if n and states[n] < 0:
            raise ValueError(f"no path spells {word!r}")
        out = []
        while n:
            out.append(arc[n])
            n = begun[n]
        return out[::-1]


def _ranges(kind: str, end: int = 0x300) -> str:
    return "".join(re.escape(chr(c)) for c in range(end) if unicodedata.category(chr(c))[0] == kind)


#: Below U+0300 no text changes under NFC, and lower-casing goes character by character.
_BLANK = "\\t-\\r \\x85\\xa0"
_HIGH = re.compile("[^\\x00-\\u02ff]")


@lru_cache(maxsize=1)
def _split_pattern() -> re.Pattern:
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_BLANK}{letters}{numbers}]+")


class Codec:
    """Splits texts into words as the tokenizer file says, and encodes and decodes them by the automaton."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        model = conf["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.names = {i: s for s, i in {**model["vocab"], **self.special}.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_str(spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.find = _split_pattern().findall

    def split(self, text: str) -> list[str]:
        """Words, lower-cased. Texts with characters from U+0300 on go through the library's own tables."""
        if _HIGH.search(text):
            # the library gives byte symbols; they are turned back so that both ways meet in one word table
            back = {s: b for b, s in enumerate(self.symbols)}
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes(back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]
        return self.find(text.lower())

    def _word(self, word: str) -> tuple[bytes, str]:
        out = self.older.get(word)
        if out is None:
            ids = self.automaton.path("".join([self.symbols[b] for b in word.encode("utf-8", "surrogateescape")]))
            out = (array("I", ids).tobytes(), " ".join([self.names[i] for i in ids]))
        if len(self.words) >= WORD_TABLE:
            self.older, self.words = self.words, {}
        self.words[word] = out
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the arcs' labels joined by a space."""
        ids: list[bytes] = []
        labels: list[str] = []
        parts = self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]
        words, make = self.words, self._word
        for part in parts:
            if part in self.special:
                ids.append(array("I", [self.special[part]]).tobytes())
                labels.append(part)
                continue
            for w in self.split(part):
                got = words.get(w)
                if got is None:
                    got = make(w)
                    words = self.words
                ids.append(got[0])
                labels.append(got[1])
        return b"".join(ids), " ".join(labels)

    def forget(self) -> None:
        """Empties the tables that grow with the texts."""
        self.words, self.older = {}, {}
        self.automaton.table.clear()

    def decode(self, ids: bytes) -> str:
        return " ".join([self.names[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, `carry` columns, ids (binary, little-endian unsigned 32-bit), decoded (string).

    `tokenizer_path` is a tokenizers JSON file with a BPE model; the driver reads it and sends it to
    the executors (a fixed file of a few MB, whatever the input). Null and empty texts give no ids and an
    empty decoded text. Special tokens that stand in a text are encoded as such. Rows are handled one by
    one, so repeated rows, ties and other columns play no part; an empty table gives an empty result.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), *[F.col(c).alias(f"__cv{i}") for i, c in enumerate(carry)])

    def encode(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        c = codec(spec.value)
        got = [c.encode(t.decode("utf-8", "replace")) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[batch.column(2 + i) for i in range(len(carry))], pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
            names=["__cv_id", *[f"__cv{i}" for i in range(len(carry))], "ids", "decoded"],
        )

    def done() -> None:
        codec(spec.value).forget()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = map_texts(rows, encode, ", ".join([f"__cv_id {kinds['__cv_id']}", *[f"__cv{i} {kinds[f'__cv{i}']}" for i in range(len(carry))], "ids binary", "decoded string"]), after=done)
    return out.select(F.col("__cv_id").alias(id_col), *[F.col(f"__cv{i}").alias(c) for i, c in enumerate(carry)], "ids", "decoded")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded text of rows with `ids` as bpe_encode writes them; null ids give an empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        c = codec(spec.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(i) for i in ids], pa.string())], names=["__cv_id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("__cv_id"), F.col(ids_col).alias("__cv_ids"))
    out = map_texts(rows, decode, f"__cv_id {rows.schema[0].dataType.simpleString()}, decoded string")
    return out.select(F.col("__cv_id").alias(id_col), "decoded")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(documents(spark, sf_dir), word_bpe_path()))
