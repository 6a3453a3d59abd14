"""The pipeline's stages, one after the other, against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from samples import SCHEMA, words_of
from test_dedup import classes_of, low

import __spark_entry__
import corpus_pipeline
from corvane.llm import queries
from corvane.llm import source_mixing as mixing
from corvane.llm.bpe_automaton import word_bpe_path


def mixed(rows):
    """Rows as often as the mix reads them, by summing whole leaves."""
    leaves = defaultdict(list)
    name = lambda x: "" if x is None else f"={x}"
    for r in rows:
        leaves[name(mixing.DOMAINS[int(hashlib.md5((r[3] or "").encode()).hexdigest()[:4], 16) % 3]), name(r[2]), name(r[3])].append(r)
    there = {k: sum(len(words_of(r[1])) for r in v) for k, v in leaves.items()}
    budgets = mixing.allot(there, sum(there.values()) * 6 // 10, mixing.WEIGHTS, 4)
    out = []
    for leaf, members in leaves.items():
        whole, rest = divmod(budgets[leaf], there[leaf]) if there[leaf] else (0, 0)
        total = 0
        out += members * whole
        for r in sorted(members, key=lambda r, w=whole: hashlib.md5(f"17:{w}:{r[0]}".encode()).hexdigest()):
            total += len(words_of(r[1]))
            if total > rest:
                break
            out.append(r)
    return out


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    stage = dict(corpus_pipeline.STAGES)
    plain = docs.where("doc_id IS NOT NULL AND doc_id <> 11")  # one row an id, so that the rows can be told apart
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r["doc_id"] for r in stage["quality"](spark, plain, "").collect()}
    left = [r for r in rows if r[0] in kept]
    assert 100 < len(left) < len(rows) and all(len(words_of(r[1])) >= 20 for r in left)

    best = {}
    for r in left:
        best[low(r[1])] = min(best.get(low(r[1]), r), r, key=lambda x: x[0])
    left = list(best.values())
    assert {r["doc_id"] for r in stage["exact_dedup"](spark, plain.where(plain.doc_id.isin(sorted(kept))), "").collect()} == {r[0] for r in left}

    left = [min((left[i] for i in c), key=lambda x: x[0]) for c in classes_of(left)]
    left = mixed(left)
    lib = Tokenizer.from_file(word_bpe_path())
    want = Counter()
    for r in left:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert max(want.values()) > 1


def test_stages_keep_the_columns(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_all_ten_are_registered(spark):
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in known
    assert set(queries.ORACLE_SQL) <= set(known) and SCHEMA


def test_oracles_agree_with_duckdb(spark, tmp_path):
    import duckdb
    from samples import make_rows

    sample = [r for r in make_rows(60, 9) if r[0] not in (13, 14)]
    table = spark.createDataFrame(sample, SCHEMA)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.project(", ".join(columns)).fetchall()), name
