"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from ravelin.llm import simhash


def plain(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def groups(prints, bits):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("blocks", [2, 3, 5])
def test_tree_edges_connect_what_all_pairs_connect(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    monkeypatch.setattr(simhash, "DIRECT", 8)
    draw = random.Random(blocks)
    values = [draw.getrandbits(64) for _ in range(150)]
    for v in list(values):
        for _ in range(3):
            values.append(v ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(1, 7))}))
    values = sorted(set(values))
    rows = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    prints = spark.createDataFrame(rows, "f long")
    edges = simhash.near_edges(prints, 4, blocks, leaf=40).collect()
    at = {r[0]: i for i, r in enumerate(rows)}
    assert all((values[at[a]] ^ values[at[b]]).bit_count() <= 64 for a, b in edges)
    label = list(range(len(values)))
    for _ in values:
        for a, b in edges:
            low = min(label[at[a]], label[at[b]])
            label[at[a]] = label[at[b]] = low
    assert label == groups(values, 4)


def test_groups_of_texts(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choices(words, k=draw.randint(3, 60))) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + [texts[0].upper(), None, "", "  \t", "one", "x y z"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    df = df.selectExpr("*", "1 AS f", "'x' AS component_id", "2 AS least")
    out = simhash.near_duplicates(df, "doc_id", "body").collect()
    prints = [plain(t) for _, t in rows]
    want_roots = groups(prints, 4)
    want = [(k, f"{p:016x}", rows[r][0]) for (k, _), p, r in zip(rows, prints, want_roots, strict=True)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    kept = simhash.keep_first(df, "doc_id", "body")
    assert kept.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    first = {rows[r][0] for r in want_roots}
    assert ids == sorted([str(k) for k in first] + ["5"] * (5 in first) + ["None"])
    assert simhash.near_duplicates(df.limit(0), "doc_id", "body").count() == 0


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(1000))
    want = plain(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text, 4) == want == plain(text)


def test_boundary_rows_query_several_shards():
    """With the radius of the queries some prints meet several leaves, and no link is lost."""
    draw = np.random.default_rng(2)
    values = draw.integers(0, 2**63, 3000).astype(np.uint64)
    radius = 4 // 3
    near = values ^ np.uint64(1 << 3) ^ np.uint64(1 << 30) ^ np.uint64(1 << 50)
    covered = np.zeros(len(values), bool)
    for mask in simhash.block_masks(3):
        tree = simhash.Tree(values[:1000], mask, 100)
        at, leaf, home = tree.route(values, radius)
        assert np.bincount(at).max() > 1 and (np.bincount(at[home]) == 1).all()
        homes = dict(zip(at[home].tolist(), leaf[home].tolist(), strict=True))
        far, shard, _ = tree.route(near, radius)
        for i, x in zip(far.tolist(), shard.tolist(), strict=True):
            covered[i] |= homes[i] == x
    assert covered.all()


def test_own_column_names_may_clash(spark):
    df = spark.createDataFrame([(2, "a b c d e", 1, 2, 3), (1, "a b c d e", 4, 5, 6), (None, "x", 7, 8, 9)],
                               "id long, t string, _kept int, _print int, _0_ int")
    out = simhash.keep_first(df, "id", "t")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a b c d e", 4, 5, 6), (None, "x", 7, 8, 9)]
