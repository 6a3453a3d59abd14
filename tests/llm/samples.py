"""Rows of a small table of documents with every awkward case, and brute-force helpers."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, n_words string, class_id long, keep_id string, held_out string, node string, bucket string, grp string, bin long, k string, n long, h string, budget long, cuts string"
SYLLABLES = {"en": "the er ing tion and ha st on re ou".split(), "fr": "le eau que oi é de ment aux re".split(), "de": "der ung sch ein keit ch zu ver".split(), "es": "el ción que ado as mente os ca".split()}


def words_of(text):
    return (text or "").encode().split()


def crc(doc_id, mod):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % mod


def make_rows(n=160, seed=3):
    rng = random.Random(seed)
    rows = []

    def word(lang):
        return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))

    passage = " ".join(word("en") for _ in range(60))
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", "de", "es"])
        lines = [" ".join(word(lang) for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(2, 12))]
        if rng.random() < 0.2:
            lines.append("This line stands everywhere.")
        if rng.random() < 0.1:
            lines.insert(1, passage)
        if rng.random() < 0.05:
            lines = [lines[0]] * 9
        rows.append([1000 + i, "\n".join(lines).capitalize(), lang, f"src{rng.randint(0, 4)}"])
    copies = rng.sample(rows, 12)
    rows += [[5000 + i, t.upper() if i % 3 == 0 else t, lang, s] for i, (_, t, lang, s) in enumerate(copies)]
    for i, (_, t, lang, s) in enumerate(rng.sample(rows[:n], 12)):  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        rows.append([6000 + i, " ".join(w), lang, s])
    rows += [
        [1, None, "en", "src0"], [2, "", "en", "src0"], [3, " \t\n\x0b\x0c\r ", None, None], [4, "one", "en", None], [5, "one", "fr", "src1"],
        [6, "A B c d", None, "src2"], [7, "a\x85b\xa0c d", "en", "src1"], [8, "\x00 null \x1c byte", "en", "src1"], [9, "12 34 ... !!", "en", "src1"],
        [10, "日本語 テキスト 👍🏽 ÀÉ ß", "de", "src1"], [None, "no id here", "en", "src0"], [None, "no id here", "en", "src0"], [11, "twice the same row", "en", "src0"], [11, "twice the same row", "en", "src0"],
        [12, "#" * 50 + " * $ % & | < >", "en", "src3"], [13, " ".join(f"w{i % 7000}" for i in range(30000)), "en", "src1"], [14, "x" * 200000, "en", "src1"], [15, "\n\n\nline\nline\n\n", "en", "src1"],
    ]
    rng.shuffle(rows)
    return [(d, t, lang, s, len(t or ""), None, None, "x", None, "y", "z", "q", "b", "g", None, "k", None, "h", None, "c") for d, t, lang, s in rows]
