"""MinHash near-dedup by BagMinHash signatures of weighted word shingles.

A text is the bag of its five-word shingles. Weights (counts) are cut into unit levels. Each shingle has
a Poisson process over its levels, arranged in doubling blocks (0, 1], (1, 2], (2, 4], ...: a block's
process runs at the rate of its width, and each point is sent down the block's halves to one level by the
bits of its hash. A point counts if its level is within the weight. Each point goes to one of the signature's
components, which keeps its earliest point; a shingle's process ends when it is later than all components.
Two bags agree in a component with the probability of their weighted Jaccard similarity.

Equal word sequences collapse first. Signatures are banded; candidate pairs are verified by exact bag overlap and
verified links make the classes. A first round takes, within a bucket, the tree of the most similar signatures and
each member's nearest neighbours (three, where none is near for certain); buckets beyond a block's size are dealt by
a further band and at random. The second round leaves out no pair: all members of a bucket that are
outside its greatest class so far meet all of its members in tiles of two blocks, where the exact overlaps are
counted by an index of the tile's shingles. So no task holds more than a tile and no bucket emits all its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.frames import checkpointed, content_key, documents, join_counted, map_texts, pieces, rewritten
from corvane.llm.hashing import U, Words, mix, stretch_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
BLOCK = 512
#: Links between classes that are sent to all tasks (16 bytes each).
MOST_SENT = 100_000
#: Candidates whose estimate lies more than this below the similarity are not verified.
MARGIN = 0.25
#: A member whose nearest one's estimate is this great is linked to it for certain; others offer more neighbours.
CLEAR, UNSURE = 0.92, 3


def bags(texts: list[bytes], size: int = SHINGLE) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text, shingle hash, count), by text. A text of fewer words than a shingle is one shingle, an empty one none."""
    words = Words(texts)
    at, h = words.windows(size)
    text = words.text_of(at)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = mix(stretch_hashes(words.hashes, words.first[short], words.first[short + 1]) + (n[short].astype(U) << U(61)))
        text, h = np.concatenate([text, short]), np.concatenate([h, own])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    heads = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(h, prepend=h[:1] + U(1)) != 0)) if len(h) else np.zeros(0, dtype=np.int64)
    return words, text[heads], h[heads], np.diff(np.append(heads, len(h)))


def signatures(texts: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row of `size` float64 for each text: the earliest point of each component (inf without shingles)."""
    parts = [(text, shingle, np.zeros(len(text), dtype=np.int64), np.ones(len(text), dtype=np.int64), weight)]
    low = 1
    while True:
        more = weight > low  # has a part in the block (low, 2 * low]
        if not more.any():
            break
        n = int(more.sum())
        parts.append((text[more], mix(shingle[more] + U(low)), np.full(n, low), np.full(n, low), weight[more]))
        low *= 2
    owner, seed, low_of, width, top = (np.concatenate([p[i] for p in parts]) for i in range(5))
    out = np.full((texts, size), np.inf)
    flat = out.reshape(-1)
    clock = np.zeros(len(owner))
    live = np.arange(len(owner))
    done = 0
    while len(live):
        steps = 1 if len(live) > 20_000 else 16
        k = (np.arange(done + 1, done + steps + 1, dtype=U) * U(0xD1B54A32D192ED03))[None, :]
        first = mix(seed[live][:, None] + k)
        gap = -np.log(((first >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live][:, None]
        when = clock[live][:, None] + np.cumsum(gap, axis=1)
        second = mix(first ^ U(0x2545F4914F6CDD1D))
        component = ((second >> U(32)) * U(size) >> U(32)).astype(np.int64)
        level = low_of[live][:, None] + ((second & U(0xFFFFFFFF)) * width[live][:, None].astype(U) >> U(32)).astype(np.int64) + 1
        within = level <= top[live][:, None]
        np.minimum.at(flat, (owner[live][:, None] * size + component)[within], when[within])
        clock[live] = when[:, -1]
        done += steps
        live = live[clock[live] < out.max(axis=1)[owner[live]]]
    return out


def _signed(batch: pa.RecordBatch, texts: list[bytes], size: int) -> pa.RecordBatch:
    words, text, shingle, weight = bags(texts, size)
    n = np.diff(words.first)
    sig = signatures(len(texts), text, shingle, weight)
    # empty texts have no point; nothing is made of theirs
    bits = mix(np.where(np.isinf(sig), 0.0, sig).view(U))
    bands = np.zeros((len(texts), BANDS), dtype=U)
    for r in range(ROWS):
        bands = mix(bands * U(0x9E3779B97F4A7C15) + bits[:, r::ROWS] + np.arange(BANDS, dtype=U))
    node = [int.from_bytes(hashlib.blake2b(b" ".join(t.split()), digest_size=8).digest(), "little", signed=True) if k else None for t, k in zip(texts, n.tolist(), strict=True)]
    small = (bits >> U(56)).astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array([x.tobytes() for x in small], pa.binary()), pa.ListArray.from_arrays(np.arange(0, BANDS * len(texts) + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))],
        names=["__cv_id", "text_key", "id_key", "n_words", "node", "sig", "bands"],
    )


def _pick(rows: pa.Table) -> pa.Table:
    """Candidate pairs of one block: the tree of greatest estimates, each member's nearest, and more of unsure ones."""
    nodes = np.asarray(rows.column("node"), dtype=np.int64)
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(len(nodes), SIZE)
    nodes, at = np.unique(nodes, return_index=True)
    sig, n = sig[at], len(nodes)
    near = np.empty((n, n), dtype=np.float32)
    for i in range(n):
        near[i] = (sig[i] == sig).mean(axis=1)
    near = (near - 1 / 256) / (1 - 1 / 256)
    np.fill_diagonal(near, -1)
    pairs = []
    best, link, out = near[0].copy(), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    out[0] = False
    for _ in range(n - 1):  # Prim's tree
        j = int(np.argmax(np.where(out, best, -2)))
        pairs.append((int(link[j]), j))
        out[j] = False
        closer = out & (near[j] > best)
        best[closer], link[closer] = near[j][closer], j
    unsure = near.max(axis=1) < CLEAR
    for k, j in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :UNSURE].T):
        who = np.arange(n) if k == 0 else np.flatnonzero(unsure)
        pairs += zip(who.tolist(), j[who].tolist(), strict=True)
    level = SIMILARITY - MARGIN
    chosen = sorted({(min(i, j), max(i, j)) for i, j in pairs if i != j and near[i, j] >= level})
    return pa.table({"a": pa.array(nodes[[i for i, _ in chosen]], pa.int64()), "b": pa.array(nodes[[j for _, j in chosen]], pa.int64())})


def _link_across(rows: pa.Table, size: int, similarity: float) -> pa.Table:
    """Of one tile: the roots (a, b) of each two classes that have a link, from the exact overlaps of all pairs."""
    nodes, at = np.unique(rows.column("node").to_numpy(), return_index=True)
    root = rows.column("root").to_numpy()[at]
    asking = np.isin(nodes, rows.column("node").to_numpy()[rows.column("asks").to_numpy()])
    found = []
    for batch, texts in pieces(rows.select(["t"]).take(at).combine_chunks().to_batches(), 0):
        found.append((batch.num_rows, *bags(texts, size)[1:]))
    before = np.cumsum([0, *[f[0] for f in found]])
    owner, shingle, weight = (np.concatenate([f[i] + (n if i == 1 else 0) for f, n in zip(found, before, strict=False)]) for i in (1, 2, 3))
    every = np.bincount(owner, weight, minlength=len(nodes)).astype(np.int64)
    mine = np.searchsorted(owner, np.arange(len(nodes) + 1))
    _, shingle = np.unique(shingle, return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    start = np.searchsorted(shingle[order], np.arange(shingle.max(initial=0) + 2))
    runs = np.diff(start)
    holder, held = owner[order], weight[order]
    links = set()
    for x in np.flatnonzero(asking):
        common = np.zeros(len(nodes))
        own, w = shingle[mine[x] : mine[x + 1]], weight[mine[x] : mine[x + 1]]
        for part in np.array_split(np.arange(len(own)), runs[own].sum() // (1 << 20) + 1):
            n = runs[own[part]]
            entry = np.arange(n.sum()) + np.repeat(start[own[part]] - (np.cumsum(n) - n), n)
            common += np.bincount(holder[entry], np.minimum(held[entry], np.repeat(w[part], n)), minlength=len(nodes))
        near = (common / np.maximum(every[x] + every - common, 1) >= similarity) & (root != root[x])
        for y in np.flatnonzero(near):
            links.add((min(root[x], root[y]), max(root[x], root[y])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _blocked(members: DataFrame, key: str) -> DataFrame:
    """Members with `block`: their key, dealt at random where a key has more than BLOCK members."""
    members = checkpointed(members)
    sizes = checkpointed(members.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumnRenamed(key, "__k"))
    return join_counted(members, sizes, key, "__k", "__n").withColumn("block", F.xxhash64(F.col(key), F.pmod(F.xxhash64("node", key), F.ceil(F.col("__n") / BLOCK)))).drop("__k")


def spread_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their key to the usual number of tasks, none of them merged.

    A block of n members is few bytes but n * n comparisons: tasks that Spark would merge by their bytes stay apart.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bucket_members(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes with sig and bands, and their places in buckets of two and more; from rows with node, sig and bands."""
    reps = checkpointed(signed.where("node IS NOT NULL").groupBy("node", "sig", "bands").agg(F.count(F.lit(1)).alias("n")).select("node", "sig", "bands"))
    rows = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("bucket", "full")
    return reps, checkpointed(join_counted(rows, checkpointed(sizes), "bucket", "full", "n").select("node", "band", "bucket", "n"))


def first_pairs(reps: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of the first round: enough to join most classes, not all there are.

    A node is in at most 2 * BANDS blocks of BLOCK or so members: it has a bounded number of pairs, however large its buckets.
    """
    mine = reps.select(F.col("node").alias("who"), "sig", "bands")
    usual = members.where(F.col("n") <= BLOCK).select("node", F.col("bucket").alias("block"))
    # a large bucket: by a further band, and at random; where a further band has too many, at random within it
    large = members.where(F.col("n") > BLOCK).join(mine.select("who", "bands"), F.col("node") == F.col("who"))
    further = F.array(F.xxhash64("bucket", F.get("bands", (F.col("band") + 5) % BANDS)), F.xxhash64("bucket"))
    dealt = _blocked(large.select("node", F.explode(further).alias("part")), "part").select("node", "block")
    blocks = usual.unionByName(dealt).join(mine.select("who", "sig"), F.col("node") == F.col("who")).select("node", "block", "sig")
    return spread_out(blocks, "block").groupBy("block").applyInArrow(_pick, "a long, b long").distinct()


def tiles_across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, asks, block: any two members of a bucket whose classes by `roots` (node, root) differ meet in a block, and one asks."""
    # a bucket of two had its pair in the first round
    placed = members.where("n > 2").join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    placed = checkpointed(placed.select("node", "bucket", F.coalesce("root", "node").alias("root")))
    classes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("bucket").alias("full"))
    split = classes.agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    rows = join_counted(placed, checkpointed(split), "bucket", "full", "n")
    # of two classes one at least is not the greatest: its members ask, and all answer
    across, down = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("rest") / BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    answer = rows.select("node", "root", "bucket", F.lit(False).alias("asks"), F.pmod(F.xxhash64("node", "bucket"), across).alias("i"), every(down).alias("j"))
    ask = rows.where("root <> main").select("node", "root", "bucket", F.lit(True).alias("asks"), F.pmod(F.xxhash64("bucket", "node"), down).alias("j"), every(across).alias("i"))
    return answer.unionByName(ask).select("node", "root", "asks", F.xxhash64("bucket", "i", "j").alias("block"))


def overlap(a: bytes, b: bytes, size: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of two texts' bags of shingles."""
    _, text, shingle, weight = bags([a, b], size)
    x, y = text == 0, text == 1
    both, i, j = np.intersect1d(shingle[x], shingle[y], assume_unique=True, return_indices=True)
    common = int(np.minimum(weight[x][i], weight[y][j]).sum())
    every = int(weight.sum()) - common
    return common / every if every else 0.0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, n_words, class_id (the class's least id), class_size, kept.

    Words are `[^\\x20\\x09-\\x0D]+`. Two texts are linked if the weighted Jaccard similarity of their bags
    of `size`-word shingles is `similarity` or more; classes are the links' connected components, and of each
    the row with the least id is kept. A text of 1 to size - 1 words is one shingle. Every link is verified
    exactly, and every pair that shares a band is linked by a path or verified, however large the bucket (in a
    bucket of two, if its estimate is within MARGIN). A pair at the similarity shares no band, and so may be
    missed, with a chance of 3 in a million, and fewer the more similar it is.

    Null and empty texts have no shingle: each is a class of its own and kept. A null id never is the
    class's id while another is there. Of repeated rows with the least id one is kept. An empty table gives
    an empty result; other columns are not read. Word sequences are told apart by a 64-bit hash.
    """
    return judged(docs, id_col, text_col, size, similarity).select(F.col("__cv_id").alias(id_col), "n_words", "class_id", "class_size", "kept")


def judged(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """near_duplicates with __cv_id and the text's content_key (text_key) on each row."""
    rows = docs.select(F.col(id_col).alias("__cv_id"), F.col(text_col).alias("__cv_text"), content_key(text_col).alias("text_key"), content_key(id_col).alias("id_key"))
    kind = rows.schema["__cv_id"].dataType.simpleString()
    signed = checkpointed(map_texts(rows, lambda b, t: _signed(b, t, size), f"__cv_id {kind}, text_key long, id_key long, n_words long, node long, sig binary, bands array<long>"))
    reps, members = bucket_members(signed)

    def verify(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        other = batch.column(3).cast(pa.binary()).to_pylist()
        near = pa.array([overlap(x, y, size) >= similarity for x, y in zip(texts, other, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(near)

    # one row stands for each node in a bucket: of many copies, dealt by id and text, only this one is fetched
    wanted = members.select(F.col("node").alias("w")).distinct()
    stands = signed.groupBy("node").agg(F.min(F.struct("text_key", "id_key")).alias("s")).join(wanted, F.col("node") == F.col("w"), "left_semi").select("node", "s.*")
    named = rows.select(F.col("text_key").alias("k"), F.col("id_key").alias("i"), F.col("__cv_text").alias("t"))
    texts = rewritten(named.join(stands, (F.col("k") == F.col("text_key")) & (F.col("i") == F.col("id_key"))).dropDuplicates(["k", "i", "node"]).select("node", "t"))

    side = lambda key, name: texts.select(F.col("node").alias(key), F.col("t").alias(name))
    pairs = checkpointed(first_pairs(reps, members))
    sides = pairs.join(side("na", "ta"), F.col("a") == F.col("na")).select("a", "b", "ta").join(side("nb", "tb"), F.col("b") == F.col("nb")).select("a", "ta", "b", "tb")
    roots = connected_components(map_texts(sides, verify, "a long, b long"))
    across = tiles_across(members, roots).join(side("who", "t"), F.col("node") == F.col("who")).select("node", "root", "asks", "block", "t")
    # a link between two classes: of their roots
    links = checkpointed(spread_out(across, "block").groupBy("block").applyInArrow(lambda t: _link_across(t, size, similarity), "a long, b long").distinct())
    counted = signed.groupBy("__cv_id", "n_words", "node", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    placed = counted.where("node IS NOT NULL").join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("__cv_id", "n_words", "node", "text_key", "copies", F.coalesce("root", "node").alias("root"))
    n_links = links.count()
    if n_links:
        joined = connected_components(links).select(F.col("node").alias("__former"), F.col("root").alias("__now"))
        # classes of a few texts to all of them: the few links between them go to all tasks, so that a large class is not dealt to one
        joined = F.broadcast(joined) if n_links <= MOST_SENT else joined
        placed = placed.join(joined, F.col("root") == F.col("__former"), "left").withColumn("root", F.coalesce("__now", "root")).drop("__former", "__now")
    placed = checkpointed(placed)
    one_row = [F.col("__cv_id").isNull().alias("none"), F.col("__cv_id").alias("id"), F.col("text_key").alias("at")]
    least = F.min(F.struct(*one_row))
    classes = checkpointed(placed.groupBy("root").agg(least.alias("first"), F.sum("copies").alias("class_size")).withColumnRenamed("root", "__r"))
    known = join_counted(placed, classes, "root", "__r", "class_size")
    alone = counted.where("node IS NULL").withColumns({"first": F.struct(*one_row), "class_size": F.lit(1).cast("long")})
    columns = ["__cv_id", "n_words", "node", "text_key", "copies", "first", "class_size"]
    each = known.select(*columns).unionByName(alone.select(*columns)).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    kept = F.col("node").isNull() | (F.col("__cv_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.at")) & (F.col("nth") == 1))
    return each.select("__cv_id", "text_key", "n_words", F.col("first.id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, one of each class, with all their columns.

    A kept row is found by its id and text, so an id may stand on rows of different classes, and of repeated rows one
    is kept. Texts without a word are all kept, repeated ones too.
    """
    options = {"size": SHINGLE, "similarity": SIMILARITY} | options
    kept = judged(docs, id_col, text_col, **options).where("kept AND n_words > 0").select(F.col("__cv_id").alias("__cv_kept"), F.col("text_key").alias("__cv_key"))
    no_word = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    keyed = docs.where(~no_word).withColumn("__cv_own", content_key(text_col))
    found = keyed.join(kept, F.col(id_col).eqNullSafe(F.col("__cv_kept")) & (F.col("__cv_own") == F.col("__cv_key")))
    return found.dropDuplicates(["__cv_kept", "__cv_key"]).select(*docs.columns).unionByName(docs.where(no_word))


def op5_bagminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
