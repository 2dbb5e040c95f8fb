"""Prefix trie, mixing and Merkle manifest, against plain versions of each."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tachado.llm import merkle, mixing, ranks, trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def brute_trie(rows, head):
    """Every node by brute force; ``head`` gives the turns taken from the conversation of the same hundred."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {c: convs.get(c - c % 100, [])[:head(c)] + ts[head(c):] for c, ts in convs.items()}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved, out = {}, {}, {}, []
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    for path, members in sorted(nodes.items(), key=lambda n: -len(n[0])):
        mine = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in mine) or 1
        saved[path] = sum(saved[k] for k in mine) + (len(members) - 1) * len(path[-1][1] if path else "")
        ended = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(mine), leaves[path], saved[path],
                    hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def heads(c):
    return zlib.crc32(str(c).encode()) % 6


def spark_trie(spark, rows, chunk=None, parts=None):
    number = F.col("conv_id")
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("mine"))
    convs = trie.sequences(df.repartition(parts) if parts else df)
    built = trie.with_shared_heads(convs, number - number % 100, (F.crc32(number.cast("string").cast("binary")) % 6).cast("int"))
    got = trie.nodes(built, **({"chunk_bytes": chunk} if chunk else {}))
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", *trie.SUMS, "ends").collect()), key=repr)


@pytest.mark.parametrize("chunk", [None, 1, 3000])
def test_trie_against_brute_force(spark, chunk):
    random.seed(chunk or 0)
    words = ["", "a", "b", "ä\n", "hello there"]
    rows = [(c, k, random.choice(["user", "assistant"]), random.choice(words)) for c in range(260) for k in range(random.choice([0, 1, 2, 3, 5, 8]))]
    rows += [(c, k, "user", "same") for c in range(300, 380) for k in range(4)]  # one hot group of copies
    assert spark_trie(spark, rows, chunk, 7) == brute_trie(rows, heads)


def test_trie_odd_input(spark):
    rows = [(0, None, None, None), (0, 2, "user", "x"), (0, 2, "assistant", "x"), (0, 2, "user", "x"), (None, 0, "user", "lost"), (250, 0, "user", "y" * 5_000_000)]
    rows += [(7, k, "user", "deep") for k in range(600)] + [(8, k, "user", "deep") for k in range(550)]
    assert spark_trie(spark, rows, 50_000) == brute_trie(rows, heads)
    assert spark_trie(spark, []) == []


def test_ranked_places_and_sums(spark):
    rows = [(g, x, x % 5) for g in ("a", "b") for x in range(300)] + [("a", 7, 2)] * 50 + [("c", None, 3)]
    placed, groups = ranks.ranked(spark.createDataFrame(rows, "g string, x int, s bigint").repartition(5), "g", ["x"], size="s")
    for g in "abc":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        got = placed.where(F.col("g") == g).orderBy("idx").collect()
        assert [r["x"] for r in got] == [r[1] for r in mine] and [r["idx"] for r in got] == list(range(len(mine)))
        assert [r["before"] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in mine])))[:-1].tolist()
    assert {(r["g"], r["n"], r["total"]) for r in groups.collect()} == {("a", 350, 700), ("b", 300, 600), ("c", 1, 3)}


def water(sizes, weights):
    """Targets by sharing the excess again, step by step."""
    out, total = [0.0] * len(sizes), sum(sizes)
    capped = set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        for i in range(len(sizes)):
            out[i] = 3.0 * sizes[i] if i in capped else left * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if out[i] > 3 * sizes[i]}
        if not over:
            return out
        capped |= over


def test_mix_against_targets(spark):
    random.seed(2)
    docs = [(i, random.choice(["a", "b", "b", "b", "é", None]), None, None, random.choice([None, "", " \t", "w " * random.randint(1, 90)])) for i in range(200)]
    docs += [(500, "tiny", None, None, "one two"), (500, "tiny", None, None, "one two"), (None, "b", None, None, "x y z"), (600, "long", None, None, "w " * 3_000_000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("taken", F.lit(1)).withColumn("rank", F.lit("x"))
    made = mixing.mix(df, block=16, shard=500)
    rows = mixing.taken(made).collect()
    assert len(rows) == len(docs)
    names = sorted({d[1] for d in docs if d[1] is not None}) + [None]
    sizes = [sum(len((d[4] or "").split()) for d in docs if d[1] == s) for s in names]
    want = dict(zip(sizes, water(sizes, [i % 3 + 1 for i in range(len(names))])))
    assert len(want) == len(sizes)
    for size, target in want.items():
        mine = [r for r in rows if r["source_size"] == size]
        assert all(abs(r["target"] - target) < 1e-6 and r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) < 1
    slots = made.slots.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["k"] == r["m"] + 1 for r in slots) and sum(r["n"] == 500 for r in slots) == len(slots) - 1
    again = mixing.taken(mixing.mix(df.repartition(3), block=16, shard=500)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0
    assert mixing.taken(mixing.mix(df.where("text = ''"))).selectExpr("sum(taken)").first()[0] == 0


def test_mix_meets_its_blocks_without_the_driver(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('a ', 40) AS text")
    used = mixing.taken(mixing.mix(df, block=16, shard=500))
    assert "Broadcast" not in used._jdf.queryExecution().executedPlan().toString()  # their files are small enough for it
    assert 500 * 40 - 3 < used.selectExpr("sum(taken)").first()[0] <= 500 * 40  # whole words of three targets


def test_mix_plans_take_whole_targets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        k, block = int(rng.integers(1, 6)), int(rng.choice([1, 3, 16, 256]))
        words = rng.integers(0, 2000, k).astype(np.int64)
        plan = mixing.planned(list(range(k)), words, np.array([i % 3 + 1 for i in range(k)], float), block, 5)
        for s in range(k):
            n, j = int(plan.blocks[s]), np.arange(plan.slots[s])
            if not len(j):
                assert plan.targets[s] < 1
                continue
            index = mixing.permuted(j % n, np.full(len(j), n), mixing._key(5, np.full(len(j), s), j // n))
            for turn in range(j[-1] // n + 1):
                assert len(set(index[j // n == turn])) == (j // n == turn).sum()
            got = np.where(index == n - 1, words[s] - (n - 1) * block, block)
            got[-1] = min(got[-1], plan.cut[s])
            assert got[-1] > 0 and got.sum() == int(plan.targets[s] + 1e-6)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(d, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*d[:4], text)))


def brute_tree(leaves):
    """Root, and per leaf the digests left and right of its way."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3:k // 3 * 3 + 3]
            ways[i].append((run[:k % 3], run[k % 3 + 1:]))
            at[i] = k // 3
        level = [sha(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], ways


def brute_merkle(docs):
    trees = {}
    for d in docs:
        trees.setdefault(d[1], []).append(d)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: (sorted(trees[s], key=lambda d: (d[0] is not None, d[0] or 0, brute_leaf(d, d[4])))) for s in names}
    built = {s: brute_tree([brute_leaf(d, d[4]) for d in low[s]]) for s in names}
    root, above = brute_tree([built[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for d, way in zip(low[s], built[s][1]):
            text = d[4].replace("\n", "") if d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else d[4]
            at = brute_leaf(d, text)
            for left, right in way + up:
                at = sha(*left, at, *right)
            beside = sha(*(x for left, right in way + up for x in left + right))
            out.append((d[0], brute_leaf(d, d[4]), built[s][0], root, beside, at, at == root))
    return sorted(out, key=repr)


def spark_merkle(spark, docs):
    df = spark.createDataFrame(docs, DOCS).withColumn("digest", F.lit(1)).withColumn("tree", F.lit("x"))
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(df, altered=lost)).collect()), key=repr)


def test_merkle_against_brute_force(spark):
    random.seed(3)
    docs = [(i, random.choice(["big", "big", "big", "s", "é", "", None]), random.choice(["en", None]), random.choice([i, None]),
             random.choice([None, "", "a\nb", "plain", "ü\n\n"])) for i in range(400)]
    docs += [(9000, "alone", "en", 1, "x\ny"), (9001, "long", "en", 5_000_000, "z\n" * 2_500_000), (None, "big", None, None, None), (None, None, None, None, None)]
    docs += [docs[5]] * 3
    assert spark_merkle(spark, docs) == brute_merkle(docs)
    one = [(i, "only", "en", 1, f"{i}\n") for i in range(10)]
    assert spark_merkle(spark, one) == brute_merkle(one)
    assert spark_merkle(spark, one[:1]) == brute_merkle(one[:1])
    assert spark_merkle(spark, []) == []


def test_merkle_long_ways(spark):
    """More than eight levels, so that the way is laid in strides."""
    docs = [(i, "s", None, None, str(i)) for i in range(7000)] + [(i, f"t{i}", None, None, "") for i in range(40)]
    assert spark_merkle(spark, docs) == brute_merkle(docs)
