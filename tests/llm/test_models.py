"""Language ID, toxicity, PPM, BPE, quality rules and mixing."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from samples import crc, words_of
from pyspark.sql import functions as F

from corvane.llm import ppm_scoring as ppm
from corvane.llm import quality_rules as quality
from corvane.llm import source_mixing as mixing
from corvane.llm.bpe_automaton import Codec, MergeAutomaton, bpe_decode, bpe_encode, word_bpe_path
from corvane.llm import language_id as language
from corvane.llm import queries
from corvane.llm.language_id import language_id
from corvane.llm.toxicity import cut_point, feature_hits, nn_risk, toxicity


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_bpe_path())
    encoded = bpe_encode(docs, word_bpe_path()).cache()
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], np.array(ids, dtype="<u4").tobytes(), lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in encoded.collect()) == want
    assert Counter(map(tuple, bpe_decode(encoded, word_bpe_path()).collect())) == Counter(map(tuple, encoded.select("doc_id", "decoded").collect()))


def test_bpe_special_tokens_and_odd_characters():
    from tokenizers import Tokenizer

    with open(word_bpe_path()) as f:
        spec = f.read()
    lib, own, rng = Tokenizer.from_str(spec), Codec(spec), random.Random(2)
    texts = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|> <|x|>", "Σας İstanbul ǅ ﬁ Ⅷ ٣", "don't we'll", "x́ é", ""]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(32, 0x3100), rng.randrange(97, 123)])) for _ in range(60)) for _ in range(80)]
    for t in texts:
        ids, labels = own.encode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want and labels == own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def brute_bpe(word, merges):
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
        if (parts[best], parts[best + 1]) not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_of_random_merges(seed):
    rng = random.Random(seed)
    vocab, merges = list("abc"), []
    while len(merges) < 14:
        u, v = rng.choice(vocab), rng.choice(vocab)
        if u + v not in vocab:
            merges.append((u, v))
            vocab.append(u + v)
    auto = MergeAutomaton({s: i for i, s in enumerate(vocab)}, merges)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        # a merge that an earlier one has made impossible, or whose string another spells, is never used by either
        assert [vocab[i] for i in auto.path(word)] == brute_bpe(word, merges)


def test_language_id(docs, rows):
    got = language_id(docs, rows_per_language=100).collect()
    assert len(got) == len(rows)
    langs = {r[2] for r in rows if r[2]}
    by_id = {r[0]: r for r in rows if r[0] is not None}
    right = []
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        if r["doc_id"] is None:
            continue
        text = by_id[r["doc_id"]][1]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in langs
        if r["held_out"] and r["doc_id"] >= 1000:
            right.append(r["lang_pred"] == by_id[r["doc_id"]][2])
    assert len(right) > 30 and np.mean(right) > 0.9


def test_language_model_is_a_mean_of_ngrams(docs, rows):
    texts, langs = [r[1].encode() for r in rows if r[0] and r[0] >= 1000 and r[2]][:60], [r[2] for r in rows if r[0] and r[0] >= 1000 and r[2]][:60]
    model = language.train(texts, langs, epochs=2)
    got = language.predict(texts, model.table(), model.bias, model.temperature)
    for t, p in zip(texts[:12], got, strict=False):
        data = b" " + t.lower() + b" "
        grams = [data[i : i + n] for n in language.SIZES for i in range(len(data) - n + 1)]
        ids = [int(language.ngram_ids(np.frombuffer(g, dtype=np.uint8), len(g))[0]) for g in grams]
        z = (np.mean([model.embeddings[i] for i in ids], axis=0) @ model.weights + model.bias) / model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(p, want, atol=1e-4) and np.isclose(p.sum(), 1)


def test_languages_of_long_texts_only_are_learnt(spark):
    long = {lang: " ".join(f"{a}{b}" for b in "xyz" for a in words) * 400 for lang, words in (("aa", ["one", "two", "three"]), ("bb", ["uno", "due", "tre"]))}
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate([*long.items()] * 20)], "doc_id long, text string, lang string")
    got = {(r["doc_id"] % 2, r["lang_pred"]) for r in language_id(table, bytes_per_language=1000).collect()}
    assert got == {(0, "aa"), (1, "bb")}


def test_registered_wrappers(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 5 == 0)) for r in rows if r[0]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = {
        "op3_ppm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op4_bpe_automaton": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5_bagminhash": "doc_id n_words class_id class_size kept",
        "op7_toxicity": "doc_id held_out score predicted",
        "op9_language_id": "doc_id held_out lang_pred score",
    }
    for name, want in columns.items():
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert set(want.split()) <= set(got.columns), name
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.select("doc_id").collect()) == sorted((r[0] is None, r[0]) for r in rows), name


def test_language_id_without_labels(docs, empty):
    assert language_id(empty).count() == 0
    none = language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    base = [["".join(rng.choice("aeiourstln") for _ in range(5)) for _ in range(40)] for _ in range(1500)]
    rows, labels = [], []
    for i, w in enumerate(base):
        toxic = i % 8 == 0
        rows.append((i, " ".join(w + rng.sample(["vileword", "nastyword", "foulword", "badword"], 2) if toxic else w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id is null or doc_id > 4000 or doc_id < 100").withColumn("doc_id", F.col("doc_id") + 100000))
    marked = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity(table, marked).collect()
    assert len(got) == table.count()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1500 and r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got) and all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 8 == 0) for r in held]) > 0.97
    assert toxicity(empty, marked).count() == 0
    flat = toxicity(docs, marked.where("toxic = 0")).select("score").distinct().collect()
    assert len(flat) == 1 and 0 <= flat[0]["score"] < 0.5


def test_corrected_risk_and_its_step():
    """One step of the training against the risk and its gradient in plain Python."""
    rng = random.Random(8)
    xp, xu = [[[rng.random() for _ in range(3)] for _ in range(n)] for n in (7, 20)]
    w, b = [rng.random() for _ in range(3)], -0.3
    for prior in (0.1, 0.9):
        risk, gw, gb = nn_risk(np.array(xp), np.array(xu), np.array(w), b, prior)

        def plain(w, b, prior=prior):
            z = lambda x: sum(a * c for a, c in zip(x, w, strict=True)) + b
            loss = lambda v: math.log(1 + math.exp(-v))
            plus = sum(loss(z(x)) for x in xp) / len(xp)
            minus = sum(loss(-z(x)) for x in xu) / len(xu) - prior * sum(loss(-z(x)) for x in xp) / len(xp)
            return prior * plus + max(0, minus)

        assert math.isclose(risk, plain(w, b), rel_tol=1e-9)
        step = 1e-6
        for k in range(3):
            up, down = [[v + (i == k) * s for i, v in enumerate(w)] for s in (step, -step)]
            assert math.isclose(gw[k], (plain(up, b) - plain(down, b)) / (2 * step), rel_tol=1e-4, abs_tol=1e-8)
        assert math.isclose(gb, (plain(w, b + step) - plain(w, b - step)) / (2 * step), rel_tol=1e-4, abs_tol=1e-8)


def test_features_of_texts_against_plain_python():
    texts = ["Some plain words, again and AGAIN".encode(), "é¿x 12".encode(), b""]
    text, feature = feature_hits(texts)
    for i, t in enumerate(texts):
        clean = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in t.lower())
        grams = {clean[j : j + n] for clean in [clean + b" "] for n in (5, 6) for j in range(len(clean) - n + 1)}
        assert len(set(feature[text == i].tolist())) == len(grams) + len(set(clean.split()))
        assert feature_hits([t])[1].tolist() == feature[text == i].tolist()


def test_cut_point_parts_two_clusters():
    assert 0.5 < cut_point(np.full(50, 3.0), np.concatenate([np.zeros(900), np.full(100, 3.0)]), 0.1) < 3


def brute_ppm(scorer, text):
    node = defaultdict(dict)
    for k, (strings, counts) in enumerate(zip(scorer.strings, scorer.counts, strict=True)):
        for s, n in zip(strings.tolist(), counts.tolist(), strict=True):
            node[k, s >> 8][s & 255] = n
    data, total = bytes([ppm.BEFORE]) * ppm.ORDER + ppm.coded(text), 0.0
    for i in range(ppm.ORDER, len(data)):
        out = set()
        for k in range(ppm.ORDER, -1, -1):
            ctx = int.from_bytes(data[i - k : i], "big") if k else 0
            if not node.get((k, ctx)):
                continue
            left = {s: n for s, n in node[k, ctx].items() if s not in out}
            c, q = sum(left.values()), len(left)
            if data[i] in left:
                total += math.log10(left[data[i]] / (c + q))
                break
            if c:
                total += math.log10(q / (c + q))
            out |= node[k, ctx].keys()
        else:
            total -= math.log10(256 - len(out))
    return total


def test_ppm_scores(docs, rows, empty):
    got = defaultdict(list)
    for r in ppm.ppm_scores(docs).collect():
        got[r["doc_id"]].append(r)
    token = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(x for r in rows if crc(r[0], 10) for x in token(r[1]))
    n, v = count.total(), len(count)
    train = [(r[1] or "").encode() for r in rows if crc(r[0], 10)]
    keys, times = np.unique(ppm.strings_of(train)[0], return_counts=True)
    scorer = ppm.Scorer(ppm.Trie.build(keys, times))
    for r in rows:
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in token(r[1]))
        for g in got[r[0]]:
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (crc(r[0], 10) == 0, len(token(r[1])), sum(count[x] > 0 for x in token(r[1])), n)
            assert math.isclose(g["base_score"], base, rel_tol=1e-9)
            if len(r[1] or "") < 500:
                assert math.isclose(g["score"], brute_ppm(scorer, (r[1] or "").encode()), rel_tol=1e-9)
    assert sum(map(len, got.values())) == len(rows)
    assert ppm.ppm_scores(empty).count() == 0


def test_ppm_keeps_rare_strings_of_a_large_corpus(spark):
    rows = [(i, "the same words again " * 8000) for i in range(20)] + [(100 + i, "quartz jumps vexed") for i in range(3)]
    train = [t.encode() for i, t in rows if crc(i, 10)]
    keys, times = np.unique(ppm.strings_of(train)[0], return_counts=True)
    assert times.sum() > 1 << 21 and np.array_equal(ppm.string_form(ppm.dealt_form(keys)), keys)
    trie = ppm.Trie.build(keys, times)
    assert len(trie.strings[ppm.ORDER]) == len(keys)
    got = {r["doc_id"]: r["score"] for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(math.isclose(got[i], ppm.Scorer(trie).texts([t.encode()])[0], rel_tol=1e-9) for i, t in rows[-3:])


def test_ppm_tells_a_null_id_from_a_null_text(spark):
    rows = [(None, "5"), (5, None), (None, None), (7, "5 5"), (5, "5")]
    got = {(r["doc_id"], r["n_tokens"]): r for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    token = lambda t: [*(t or "").split(), None]
    count = Counter(x for i, t in rows if crc(i, 10) for x in token(t))
    for i, t in rows:
        r = got[i, len(token(t))]
        assert r["n_known"] == sum(count[x] > 0 for x in token(t))
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.1) / (count.total() + 0.1 * (len(count) + 1))) for x in token(t)))


def test_ppm_words_that_look_alike_to_a_polynomial(spark):
    pattern = lambda flip: "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1024))
    ids = [i for i in range(40) if crc(i, 10)][:2] + [i for i in range(40) if not crc(i, 10)][:1]
    table = spark.createDataFrame([(ids[0], pattern(0)), (ids[1], "other"), (ids[2], pattern(1))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in ppm.ppm_scores(table).collect()}
    assert got == {ids[0]: 2, ids[1]: 2, ids[2]: 1}


def test_ppm_over_many_pieces_and_rounds(spark, docs, rows, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"], r["n_known"]): (r["base_score"], r["score"]) for r in ppm.ppm_scores(docs).collect()}
    for name, value in (("PIECE_BYTES", 3000), ("MOST_COUNTED", 500), ("MERGED_AT_ONCE", 3), ("PIECES_AT_ONCE", 4)):
        monkeypatch.setattr(ppm, name, value)
    assert ppm.text_pieces(docs.select("doc_id", "text", F.lit(True)), 3000, ppm.coded).count() > 12
    got = ppm.ppm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(whole[r["doc_id"], r["n_tokens"], r["n_known"]], (r["base_score"], r["score"]), rtol=1e-9)


def test_ppm_pieces_step_by_step(monkeypatch):
    texts = [ppm.coded(t) for t in (b"some words here", b"", b"x" * 400, b"more of some words")]
    keys, ends = ppm.strings_of([t[:-1] for t in texts])
    monkeypatch.setattr(ppm, "STEP", 37)
    found = list(ppm.Piece(texts).steps())
    assert len(found) > 5 and np.array_equal(np.concatenate([k for k, _ in found]), ppm.dealt_form(keys))
    assert np.array_equal(np.concatenate([t for _, t in found]), np.repeat(np.arange(4), np.diff(ends, prepend=0)))
    strings, counts = ppm.Piece(texts).strings()
    assert np.array_equal(ppm._unpacked(ppm._packed(strings)), strings) and counts.sum() == len(keys)


def test_ppm_rows_grow_with_the_pieces(spark, monkeypatch):
    """What is asked and answered goes by the pieces, not by their square."""
    table = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j) % 997}" for j in range(60))) for i in range(400)], "doc_id long, text string").coalesce(1)
    asked = []
    for size in (1 << 14, 1 << 11):
        pieces = ppm.text_pieces(table.select("doc_id", "text", F.lit(True)), size, ppm.coded)
        counted = ppm.counted_strings(pieces)
        shared = spark.sparkContext.broadcast(ppm.shared_strings(counted))
        asked.append((pieces.count(), ppm.string_answers(pieces, counted, shared).count(), counted.count()))
    (few, rows, buckets), (many, more, also) = asked
    assert many > 4 * few and also == buckets <= ppm.BUCKETS and more <= many * ppm.BUCKETS and more / many <= rows / few


def test_ppm_probabilities_sum_to_one():
    keys, times = np.unique(ppm.strings_of([b"abracadabra abra", b"banana bandana"])[0], return_counts=True)
    scorer = ppm.Scorer(ppm.Trie.build(keys, times))
    for context in (b"abrac", b"xxxxx", b"banan", b" abra"):
        ctx = int.from_bytes(context, "big") << 8
        p = 10 ** scorer.log10(np.array([ctx | s for s in range(256)], dtype=np.uint64))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_adaptive_code_learns_repetition():
    assert ppm.adaptive_log10(b"abcabcabc" * 20) > 3 * ppm.adaptive_log10(bytes(random.Random(1).choices(range(97, 123), k=180)))


def brute_base(text):
    w = words_of(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_base(docs, rows, empty):
    got = quality.quality_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((r[0], *brute_base(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_rejects_outliers_and_keeps_clean(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        w = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 400))]
        if i % 10 == 0:
            w = [x + "***$$" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 2}"))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in got)


def test_verdicts_of_swapped_nulls_are_kept_apart(spark):
    """(null, 'x') and ('x', null) are different groups: one text is an outlier of the first only."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(80)]
    marked = [" ".join(w + "#" * 5 for w in t.split()) for t in clean]
    rows = [(i, t, None, "x") for i, t in enumerate([*marked, clean[0]])] + [(1000 + i, t, "x", None) for i, t in enumerate(clean)]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {r[0] for r in rows} - {80}


def least_determinant(q):
    """The minimum-covariance-determinant estimate of one group's vectors (in 4096ths), in numpy: mean, scatter, start, steps."""
    x, floors = q / 4096, np.diag(np.array(quality.FLOORS) ** 2)

    def median(v, width):
        return np.array([sorted(np.floor(c / width))[(len(c) + 1) // 2 - 1] for c in v.T])

    def moments(rows):
        return rows.mean(0), np.cov(rows.T, bias=True).reshape(5, 5) * quality.CONSISTENCY + floors

    centre = median(q, 64) * 64 + 32
    spread = 1.4826 * (median(np.abs(q - centre), 16) * 16 + 8) / 4096
    starts = [(centre / 4096, np.diag(spread**2) + floors)]
    for k in range(1, quality.SEEDS + 1):
        h = (q @ np.array([48271, 16807, 69621, 39373, 30517]) + k) % 2147483647
        h = ((h * 48271 + k) % 2147483647 * 69621 + k) % 2147483647
        chosen = h % len(q) < quality.SEED_ROWS
        if chosen.any():
            starts.append(moments(x[chosen]))
    found = []
    for k, (mean, cov) in enumerate(starts):
        det, steps = 1e300, 0
        while steps < quality.STEPS:
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(np.log(d2 + 1e-9) * 32)
            before = np.searchsorted(np.sort(bins), bins)
            new = moments(x[before < quality.HALF * len(x)])
            if not np.linalg.det(new[1]) < det:
                break
            (mean, cov), det, steps = new, np.linalg.det(new[1]), steps + 1
        found.append((det, k, steps, mean, cov))
    return min(found, key=lambda f: f[:2]), found


def test_mcd_matches_numpy(spark):
    """The distances of each group are those under the least determinant of several starts, found in numpy."""
    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choice("abcdef") for _ in range(rng.randint(a, b)))
    rows = []
    for i in range(480):
        bad = i % 3 == 0 and i % 5 != 0  # over a quarter of the documents
        lines = [" ".join(word(*((6, 15) if bad and i % 2 else (1, 8))) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 20))]
        if bad:
            lines = [x + " ##$" * 6 for x in lines] + lines[:1] * rng.randint(0, 5)
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}"))
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    q = lambda v: math.floor(v * 4096 + 0.5)
    many = 0
    for group in range(4):
        stats = {i: brute_base(t) + (sum(bool(x.split()) for x in t.split("\n")),) for i, t, _, s in rows if s == f"s{group}"}
        ok = [i for i, s in stats.items() if s[0] >= 20 and 100 * s[4] <= 30 * s[0]]
        vectors = np.array([[q(math.log(1 + s[0])), q(math.log((s[1] + 1) / (s[0] + 1))), q(math.sqrt(s[2] / (s[0] + 1))), q(math.sqrt(s[3] / (s[5] + 1))), q(math.sqrt(s[4] / (s[0] + 1)))] for s in (stats[i] for i in ok)])
        (_, _, _, mean, cov), found = least_determinant(vectors)
        many += len({round(math.log(f[0]), 6) for f in found}) > 1
        d = vectors / 4096 - mean
        assert np.allclose([got[i]["distance"] for i in ok], np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)), rtol=1e-6)
    assert many  # the starts do not all end alike


def test_mixing_against_brute_force(docs, rows, empty):
    leaves = defaultdict(list)
    name = lambda x: "" if x is None else f"={x}"
    for r in rows:
        domain = mixing.DOMAINS[int(hashlib.md5((r[3] or "").encode()).hexdigest()[:4], 16) % 3]
        leaves[name(domain), name(r[2]), name(r[3])].append((str("" if r[0] is None else r[0]), r[0], len(words_of(r[1]))))
    there = {k: sum(n for *_, n in v) for k, v in leaves.items()}
    budgets = mixing.allot(there, sum(there.values()) * 6 // 10, mixing.WEIGHTS, 4)
    want = Counter()
    for leaf, members in leaves.items():
        whole, rest = divmod(budgets[leaf], there[leaf]) if there[leaf] else (0, 0)
        place = defaultdict(int)
        for key, _, n in members:
            place[hashlib.md5(f"17:{whole}:{key}".encode()).hexdigest()] += n
        taken, total = set(), 0
        for h in sorted(place):
            total += place[h]
            if total > rest or not there[leaf]:
                break
            taken.add(h)
        for key, i, n in members:
            want[(i, n, budgets[leaf], whole + (hashlib.md5(f"17:{whole}:{key}".encode()).hexdigest() in taken))] += 1
    got = mixing.mix_sources(docs)
    assert Counter((r["doc_id"], r["__cv_tokens"], r["__cv_budget"], r["__cv_copies"]) for r in got.collect()) == want
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(c * n for (*_, c), n in want.items())
    assert mixing.mix_sources(empty).count() == 0


def test_budgets_of_many_leaves_are_shared_out_in_spark(spark):
    rng = random.Random(3)
    rows = [(f"={d}", f"={lang}" if lang else "", f"=s{k}", rng.choice([0, 1, 7, 50, 400, 3000])) for d in ("web", "books", "forum") for lang in ("en", "de", None) for k in range(rng.randint(1, 9))]
    sums = spark.createDataFrame(rows, "__cv_d string, __cv_l string, __cv_s string, n long")
    for source in ({}, {"s0": 0.5, "s1": 3, "s2": 0, "s3": 0.15}):
        for part in (0.1, 0.6, 3.5):
            weights = mixing.WEIGHTS | {"source": source}
            one, two = ({tuple(r) for r in mixing.leaf_budgets(sums, weights, Fraction(str(part)), 4, few).collect()} for few in (True, False))
            assert len(one) == len(rows) and one == two, (source, part, sorted(one ^ two))


def test_share_redistributes_to_siblings_first():
    from fractions import Fraction as Q

    assert mixing.share(100, [(Q(1), 10), (Q(1), 1000), (Q(2), 1000)]) == [10, 30, 60]
    assert mixing.share(100, [(Q(1), 10), (Q(1), 20)]) == [10, 20]
    assert mixing.share(10, [(Q(1), 100)] * 3) == [4, 3, 3]
    assert mixing.share(10, []) == []
    leaves = {("=a", "=x", "=1"): 10, ("=a", "=y", "=2"): 100, ("=b", "=x", "=3"): 100}
    got = mixing.allot(leaves, 120, {"domain": {"a": 0.5, "b": 0.5}}, 1)
    assert got == {("=a", "=x", "=1"): 10, ("=a", "=y", "=2"): 50, ("=b", "=x", "=3"): 60}
