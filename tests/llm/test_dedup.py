"""Exact, substring, line and near dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import words_of

from corvane.llm import bagminhash as bag
from corvane.llm import hashing
from corvane.llm import substring_dedup as substring
from corvane.llm.components import connected_components
from corvane.llm.exact_dedup import drop_exact_copies, exact_dedup
from corvane.llm.frames import content_key
from corvane.llm.hashing import Words, pack_values, unpack_values
from corvane.llm.line_dedup import line_dedup
from corvane.llm.substring_dedup import substring_dedup


def low(text):
    return (text or "").encode().lower()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def multiset(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(docs, rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        left = True
        for i in ids:
            stays = left and i == best
            left = left and not stays
            want[(i, best, len(ids), stays, sha(text))] += 1
    assert multiset(exact_dedup(docs, keep=keep)) == want
    kept = drop_exact_copies(docs, keep=keep)
    assert kept.columns == docs.columns
    assert Counter(low(r["text"]) for r in kept.collect()) == Counter(list(groups))


def removed(rows, size):
    seen = defaultdict(int)
    texts = [words_of(r[1]) for r in rows]
    for w in texts:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] += 1
    out = []
    for w in texts:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = True
        out.append((w, gone))
    return out


@pytest.mark.parametrize("size", [35, 4])
def test_substring_dedup(docs, rows, size):
    want = Counter()
    for r, (w, gone) in zip(rows, removed(rows, size), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        want[(r[0], len(w), int(gone.sum()), tuple((int(a), int(b)) for a, b in edges.reshape(-1, 2)), kept.decode())] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept_text"]) for r in substring_dedup(docs, size=size).collect())
    assert got == want


def test_windows_dealt_twice(spark, docs, rows, monkeypatch):
    """Small pieces and ranges: hashes are dealt into finer ranges by units of pieces, with the same result."""
    want = multiset(substring.substring_dedup(docs, size=8).select("doc_id", "n_words", "n_removed", "kept_text"))
    assert sum(r[2] > 0 for r in want) > 20
    for name, value in (("PIECE_BYTES", 5000), ("RANGE_BITS", 2), ("RANGE_BYTES", 20000)):
        monkeypatch.setattr(substring, name, value)
    pieces = substring.text_pieces(docs.select("doc_id", "text", F.lit(True)), substring.PIECE_BYTES)
    assert pieces.count() > 12 and pieces.agg(F.sum("bytes")).first()[0] > 4 * 4 * substring.RANGE_BYTES
    assert multiset(substring.substring_dedup(docs, size=8).select("doc_id", "n_words", "n_removed", "kept_text")) == want


def test_rows_of_windows_grow_with_the_pieces(spark, monkeypatch):
    """However many ranges there are in all, a piece sends a fixed number of rows."""
    table = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + j * j) % 9973}" for j in range(400))) for i in range(200)], "doc_id long, text string").repartition(2)
    pieces = substring.text_pieces(table.select("doc_id", "text", F.lit(True)), 1 << 14)
    n = pieces.count()
    monkeypatch.setattr(substring, "RANGE_BITS", 4)
    for range_bytes in (1 << 17, 1 << 12):  # 4 ranges in all, then 128 and more
        monkeypatch.setattr(substring, "RANGE_BYTES", range_bytes)
        sent = substring._sent(pieces, 35, substring.RANGE_BITS)
        assert n > 10 and sent.count() <= n << substring.RANGE_BITS
        back = substring.repeated_hashes(pieces, 35)
        assert back.count() <= n << substring.RANGE_BITS


def test_line_dedup(docs, rows):
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[3] is not None and line.encode().split():
                sites[line].add(r[3])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        full = [x for x in lines if x.encode().split()]
        wide = [x for x in full if len(sites[x]) >= 3]
        want[(r[0], len(full), len(wide), "\n".join(x for x in lines if x not in wide))] += 1
    assert multiset(line_dedup(docs)) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 5


def test_line_dedup_counts_near_thresholds_exactly(spark):
    rows = [(s, f"line {k}", f"site{s}") for k, n in enumerate((195, 199, 200, 201, 230)) for s in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup(docs.where("doc_id < 300"), threshold=200).where("n_removed > 0").select("doc_id").distinct().collect()}
    gone = line_dedup(docs, threshold=200).where("n_removed > 0").count()
    assert gone == 200 + 201 + 230 and got


def bag_of(text, n=5):
    w = words_of(text)
    if not w:
        return None
    return Counter([tuple(w)]) if len(w) < n else Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def classes_of(rows, level=0.8):
    bags = [bag_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and (c := sum((a & b).values())) and c / (a.total() + b.total() - c) >= level:
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return list(out.values())


def test_near_duplicates(docs, rows):
    want = Counter()
    kept = 0
    for members in classes_of(rows):
        ids = [rows[i][0] for i in members]
        least = min((i for i in ids if i is not None), default=None)
        kept += 1
        for i in members:
            want[(rows[i][0], len(words_of(rows[i][1])), least, len(members))] += 1
    got = bag.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == kept
    assert all(r["doc_id"] == r["class_id"] for r in got if r["kept"])


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    """A class of many near copies is found whole though no block holds it."""
    monkeypatch.setattr(bag, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(60)] + [(100 + i, " ".join(f"z{i}x{j}" for j in range(50))) for i in range(20)]
    got = bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 100} == {0}
    assert sum(r["kept"] for r in got) == 21


def class_sizes(rows, df):
    got = Counter(r["class_id"] for r in df.collect())
    return sorted(got.values()), sorted(len(c) for c in classes_of(rows))


def test_every_cross_pair_of_a_small_block_is_offered(spark):
    """Two pairs of near copies, joined only by a link that does not seem the nearest."""
    a = [f"w{i}_8" for i in range(100)]
    b = ["q1" if i == 20 else "q2" if i == 70 else x for i, x in enumerate(a)]
    rows = [(0, " ".join(a)), (1, " ".join(["p0", *a[1:]])), (2, " ".join([*b[:-1], "z"])), (3, " ".join(["p0", *b[1:]]))]
    got, want = class_sizes(rows, bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert want == [4] and got == want


def test_large_buckets_are_searched_whole(spark, monkeypatch):
    """Near copies about the similarity, far more than a block holds: classes equal those of all pairs."""
    monkeypatch.setattr(bag, "BLOCK", 8)
    rng = np.random.default_rng(1)
    texts = set()
    while len(texts) < 120:
        words = [f"w{i}" for i in range(100)]
        for at in rng.choice(100, rng.integers(1, 4), replace=False):
            words[at] = f"x{rng.integers(4)}"
        texts.add(" ".join(words))
    rows = list(enumerate(sorted(texts)))
    got, want = class_sizes(rows, bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == want


def test_margin_misses_fewer_than_bands():
    least = int(np.ceil((bag.SIMILARITY - bag.MARGIN) * bag.SIZE))
    below = sum(comb(bag.SIZE, k) * 0.8**k * 0.2 ** (bag.SIZE - k) for k in range(least))
    assert below < (1 - 0.8**bag.ROWS) ** bag.BANDS


def test_signatures_estimate_weighted_jaccard():
    texts = [b"a a a a a a a a a b b b c d e", b"a a a a a b b b b b c d f g"]
    words, text, shingle, weight = bag.bags(texts, 1)
    sig = bag.signatures(2, text, shingle, weight, 1 << 15)
    assert abs((sig[0] == sig[1]).mean() - bag.overlap(*texts, 1)) < 0.015
    again = bag.signatures(1, text[text == 1] * 0, shingle[text == 1], weight[text == 1], 1 << 15)
    assert np.array_equal(again[0], sig[1])


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}


def test_empty_tables(empty):
    for op in (exact_dedup, substring_dedup, line_dedup, bag.near_duplicates, drop_exact_copies, bag.drop_near_copies):
        assert op(empty).count() == 0


def test_packed_integers():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 5000, 300)
    assert np.array_equal(unpack_values(pack_values(v)), v)
    assert np.array_equal(unpack_values(pack_values(np.array([0, 255, 254, 256, 510]))), [0, 255, 254, 256, 510])
    assert len(unpack_values(b"")) == 0


def test_word_hashes_tell_words_apart():
    texts = [b"a b  ab\tba", b"", b" \n", b"ab c"]
    words = Words(texts)
    assert words.first.tolist() == [0, 4, 4, 4, 6]
    assert words.hashes[2] == words.hashes[4] and len(set(words.hashes.tolist())) == 5


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_patterns_that_collide_modulo_powers_of_two(spark):
    x, y = thue_morse(1024), thue_morse(1024, 1)
    assert len(set(Words([x.encode(), y.encode()]).hashes.tolist())) == 2
    rest = [f"w{i}" for i in range(34)]
    table = spark.createDataFrame([(i, " ".join([*rest[:17], w, *rest[17:]])) for i, w in enumerate((x, y))], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup(table).collect()} == {0}
    assert {r["class_size"] for r in bag.near_duplicates(spark.createDataFrame([(0, x), (1, y)], "doc_id long, text string")).collect()} == {1}
    long = thue_morse(4096)
    words = [" ".join(thue_morse(64, k)) for k in (0, 1)]
    _, hashes = Words([w.encode() for w in words]).windows(64)
    assert len(set(hashes.tolist())) == 2 and len(long) == 4096


def test_polynomials_modulo_the_prime():
    rng = random.Random(2)
    values = [rng.randrange(1 << 64) for _ in range(400)]
    starts, ends = np.arange(0, 360), np.arange(40, 400)
    prime = int(hashing.PRIME)
    got = hashing.stretch_hashes(np.array(values, dtype=np.uint64), starts, ends)
    assert got.tolist() == [sum(values[s + i] % prime * pow(hashing._WORD_BASE, i, prime) for i in range(40)) % prime for s in starts.tolist()]


def test_near_copies_leave_one_row_of_repeats_and_shared_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:59] + ["changed"]
    other = [f"v{i}" for i in range(60)]
    rows = [(11, " ".join(words)), (11, " ".join(words)), (7, " ".join(near)), (7, " ".join(other)), (None, " ".join(words)), (3, None), (3, ""), (3, " ")]
    got = bag.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(7, " ".join(near)), (7, " ".join(other)), (3, None), (3, ""), (3, " ")])


def test_row_keys_tell_nulls_apart(spark):
    rows = [(None, "5"), (5, None), (None, None), (5, "5"), (None, ""), (5, "")]
    table = spark.createDataFrame(rows, "a long, b string")
    assert table.select(content_key("a", "b")).distinct().count() == len(rows)
