import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.minhash_dedup import near_dedup, near_duplicates
from tidemark.llm.queries import QUERIES
from tidemark.llm.resharding import reshard, rewrite, transfers
from tidemark.llm.topk import _longest, top_k

SF = "/root/testdata/sf0.001"


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        both = len(sets[i] & sets[j])
        if a[0] is not None and b[0] is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
            x, y = sorted((find(a[0]), find(b[0])))
            parent[y] = x
    out = []
    for (number, _), s in zip(rows, sets):
        component = None if number is None else find(number)
        out.append((number, len(s), component, number is None or number == component))
    return out


def near_corpus(seed):
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 7)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 999)}"
            rows.append((number, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in words)))
            number += 1
    rows += [(number, None), (number + 1, ""), (number + 2, "\t "), (number + 3, None), (None, rows[0][1]), (None, rows[2][1]), (5, rows[30][1]), rows[8], (number + 4, "one"), (number + 5, "ONE"), (number + 6, "long " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, size):
    rows = near_corpus(size)
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, node string, `a.b` int").repartition(3)
    got = sorted((tuple(r) for r in near_duplicates(docs, shingle=size).collect()), key=repr)
    assert got == sorted(brute_components(rows, size), key=repr)
    assert near_duplicates(docs.limit(0), shingle=size).count() == 0
    kept = near_dedup(docs, shingle=size)
    want = {r[0] for r, b in zip(rows, brute_components(rows, size)) if b[3]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_registered_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op6_minhash_dedup"](spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute_components(rows, 2))


def test_links_missed_by_the_star_are_found(spark):
    """A chain in one bucket whose ends don't resemble each other, and many copies of its middle."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{j}" if j < 5 * i else w for j, w in enumerate(words)])) for i in range(4)]
    rows += [(10 + i, rows[1][1] + f" t{i % 3}") for i in range(40)]
    got = {r.doc: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {r[0]: r[2] for r in brute_components(rows, 2)}


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(40):
        supply = {i: rng.randint(1, 1000) for i in range(rng.randint(1, 9))}
        shards = rng.randint(1, 9)
        plan = transfers(supply, shards)
        total = sum(supply.values())
        share = [total // shards + (j < total % shards) for j in range(shards)]
        got = [0] * shards
        for o, moves in plan.items():
            assert sum(n for _, n in moves) == supply[o]
            for j, n in moves:
                got[j] += n
        assert got == share
        moved = sum(n for o, moves in plan.items() for j, n in moves if j != o)
        assert moved == sum(max(0, s - (share[o] if o < shards else 0)) for o, s in supply.items())


def check_shards(rows, shards, spread):
    assert all(zlib.crc32((r.text or "").encode()) == r.text_crc32 and len((r.text or "").encode()) + 1 == r.size for r in rows)
    load = [sum(r.size for r in rows if r.shard == j) for j in range(shards)]
    assert max(load) - min(load) <= spread, load
    for j in range(shards):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(sum(r.shard == j for r in rows)))


def test_resharding(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randint(0, 60), "hot" if i % 3 else f"s{i % 7}", i) for i in range(600)]
    rows += [(None, None, None, 1), (None, "same", None, 1), (None, "same", None, 1), (3, rows[3][1], "hot", 3), (700, "x" * 400, "s1", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)
    placed = reshard(docs, F.pmod(F.crc32("source"), F.lit(5)), shards=4, block_rows=50)
    got = placed.rows.collect()
    assert len(got) == len(rows) and placed.rows.columns == ["doc_id", "text", "source", "size", "text_crc32", "old_shard", "shard", "slot"]
    check_shards(got, 4, 130)
    folder = str(tmp_path / "shards")
    rewrite(placed, folder)
    assert spark.read.parquet(folder).count() == sum(r.shard in placed.affected for r in got)
    assert reshard(docs.limit(0), F.lit(1), shards=4).rows.count() == 0


def test_resharding_leaves_untouched_files(spark, tmp_path):
    rows = [(i, "a" * 9, [0, 1, 2, 2][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    placed = reshard(docs, F.col("at"), shards=4)
    assert placed.affected == [2, 3]
    assert {r.shard for r in placed.rows.collect() if r.old_shard != r.shard} == {3}


def test_resharding_over_an_existing_layout(spark, tmp_path):
    folder = str(tmp_path / "shards")
    rows = [(i, "ab" * (i % 9), i % 4, f"x{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, _old_ string")
    docs.write.partitionBy("shard").parquet(folder)
    landed = spark.read.parquet(folder)
    for shards in (2, 5):
        placed = reshard(landed, F.col("shard"), shards=shards, block_bytes=100)
        assert placed.rows.columns[:3] == ["doc_id", "text", "_old_"]
        rewrite(placed, folder)
        landed = spark.read.parquet(folder)
        got = landed.select("doc_id", "text", "_old_", "shard").collect()
        assert sorted((r.doc_id, r.text, r._old_) for r in got) == [(i, t, x) for i, t, _, x in rows]
        assert {r.shard for r in got} == set(range(shards))


def test_resharding_query(spark):
    rows = QUERIES["op10_flow_resharding"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    check_shards(rows, 16, max(r.size for r in rows))


def brute_top(rows, k, every):
    good = []
    for number, v in rows:
        if number is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((number, [int(np.floor(1024 * x)) for x in v]))
    good = [g for i, g in enumerate(good) if g not in good[:i]]
    out = set()
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), p) for p, b in good if p != q and len(a) == len(b))[:k]
            out |= {(q, i + 1, p, -s) for i, (s, p) in enumerate(scored)}
    return out


@pytest.mark.parametrize("chunk", [8192, 40])
def test_top_k_matches_brute_force(spark, chunk):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        v = rng.normal(size=6) * 10 ** rng.uniform(-2, 3)
        rows.append((i, [float(x) for x in v]))
    rows += [(300, rows[10][1]), (301, rows[10][1]), (302, None), (303, [None] * 6), (304, [float("nan")] * 6), (305, [float("inf")] + [0.0] * 5), (None, rows[1][1]), (306, [0.0] * 6), (307, [1.0, 2.0]), (310, [3.0, 1.0]), (311, []), (320, []), rows[20], (340, [1e9] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in top_k(table, every=10, block=16, chunk=chunk).collect()}
    assert got == brute_top(rows, 10, 10)
    assert top_k(table.limit(0)).count() == 0


def test_longest_vectors_are_ranked_in_chunks_first(spark):
    rows = [(i, i % 2, float(i * 7919 % 997 // 3), i % 40) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, dim int, norm double, chunk int")
    longest = _longest(table, 5, 40)
    want = {x[:3] for d in (0, 1) for x in sorted((r for r in rows if r[1] == d), key=lambda r: (-r[2], r[0]))[:5]}
    assert {(r.vec_id, r.dim, r.norm) for r in longest.collect()} == want
    plan = longest._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3  # of 40, 3 and 1 groups


def test_top_k_query_matches_sql(spark):
    import duckdb

    from tidemark.llm.queries import QUERIES, SQL

    db = duckdb.connect()
    db.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op5_norm_bucketed_top_k"](spark, "/root/testdata/sf0.01").collect())
    assert got and got == sorted(db.execute(SQL["op5_norm_bucketed_top_k"]).fetchall())
