import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tidemark.llm.common import byte_values, rolling, sequence_hash, sliding_min, word_hashes
from tidemark.llm.fm_index import FMIndex, stream
from tidemark.llm.repeats import _content_hashes
from tidemark.llm.run_index import RunIndex
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup

LAST = (1 << 63) - 1


def covered(units, window, earliest, is_earlier):
    out = [False] * len(units)
    for i in range(len(units) - window + 1):
        if is_earlier(earliest[tuple(units[i : i + window])], i):
            out[i : i + window] = [True] * window
    return out


def brute(rows, window, split, own):
    """rows: (number, text). The removed mask of every row, by the definition."""
    rank = lambda r: LAST if r[0] is None else r[0]
    earliest = {}
    units = [split(r[1] or "") for r in rows]
    for r, u in zip(rows, units):
        for i in range(len(u) - window + 1):
            place = (rank(r), i)
            key = tuple(u[i : i + window])
            earliest[key] = min(earliest.get(key, place), place)
    out = []
    for r, u in zip(rows, units):
        earlier = (lambda e, i, k=rank(r): e < (k, i)) if own else (lambda e, i, k=rank(r): e[0] < k)
        out.append(covered(u, window, earliest, earlier))
    return list(zip(units, out))


def corpus(seed, count=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6)] + ["é", "漢字", "a b"]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(4)]
    rows = []
    for i in range(count):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages)[: rng.randint(3, 40)] if rng.random() < 0.5 else [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 15))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(count, None), (count + 1, ""), (count + 2, " \n"), (None, rows[3][1]), (None, rows[5][1]), (7, rows[9][1]), rows[11], (count + 3, "aa " * 400), (count + 4, "b" * 900)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("index", [FMIndex, RunIndex])
def test_index_finds_earliest_place_and_count(index):
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = int(rng.integers(6, 12))
        lengths = rng.integers(window, window + 14, int(rng.integers(1, 9)))
        text = np.concatenate([np.append(rng.integers(1, rng.integers(2, 5), n), 0) for n in lengths])
        begins = np.cumsum(lengths + 1) - lengths - 1
        places = [b + j for b, n in zip(begins, lengths) for j in range(n - window + 1)]
        keys = [tuple(text[p : p + window]) for p in places]
        found, times = stream(index(text, window), text, begins, lengths, window)
        for p, k in zip(places, keys):
            assert found[p] == places[keys.index(k)]
            assert times[p] == keys.count(k)


def test_hash_helpers():
    values = np.arange(300, dtype=np.uint64) * np.uint64(977)
    for size in (1, 2, 3, 7, 20, 50):
        assert (rolling(np.concatenate((values[:9], values)), size)[9:] == rolling(values, size)).all()
        least = sliding_min(values[::-1].copy(), size)
        assert (least == [values[::-1][i : i + size].min() for i in range(len(values) - size + 1)]).all()
    hashes, starts = word_hashes(b" ab  cd ab\n\tx ab")
    assert list(starts) == [1, 5, 8, 12, 14]
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
    assert len(word_hashes(b"")[0]) == 0


SMALL = {"part_bytes": 3000, "shard_bytes": 4000, "index_symbols": 300}


@pytest.mark.parametrize("hot", [100_000, 5])
@pytest.mark.parametrize("window, gram", [(6, 3), (20, 8)])
def test_words_match_brute_force(spark, window, gram, hot):
    rows = corpus(window)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window, gram, hot=hot, **SMALL).collect()
    split = lambda t: [w.decode() for w in t.encode().split()]
    want = [(r[0], len(u), sum(m), " ".join(w for w, x in zip(u, m) if not x)) for r, (u, m) in zip(rows, brute(rows, window, split, True))]
    key = lambda r: (r[0] is None, r[0], r[3], r[1])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("hot", [100_000, 5])
def test_bytes_match_brute_force(spark, hot):
    rows = corpus(4, 60)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50, 20, hot=hot, **SMALL).collect()
    want = []
    for r, (u, m) in zip(rows, brute(rows, 50, lambda t: t.encode(), False)):
        runs = sum(x and not y for x, y in zip(m, [False, *m]))
        want.append((r[0], len(u), sum(m), runs, bytes(b for b, x in zip(u, m) if not x)))
    key = lambda r: (r[0] is None, r[0], r[4])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(want, key=key)


def test_extra_columns_and_empty_table(spark):
    rows = [(1, "a b c d e f g h", "x", 5, 9), (2, "a b c d e f g h", None, 6, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, n_removed int, `_d.o t` int")
    got = {r.doc_id: r for r in substring_dedup(docs, 6, 3).collect()}
    assert (got[2].n_removed, got[2].kept_text, got[2].part, got[1].part, got[1]["_d.o t"]) == (8, "", None, "x", 9)
    assert substring_dedup(docs.limit(0), 6, 3).count() == 0
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_content_hashes_take_bounded_memory():
    rng = np.random.default_rng(6)
    length = np.concatenate((rng.integers(50, 81, 60_000), [1_000_000], rng.integers(50, 81, 10))).astype(np.int64)
    flat = rng.integers(0, 256, length.sum()).astype(np.uint8)
    begin = np.cumsum(length) - length
    assert (_content_hashes(flat[: begin[900]], begin[:900], length[:900]) == sequence_hash(byte_values(flat[: begin[900]].tobytes()), begin[:900], length[:900])).all()
    _content_hashes(flat, begin, length)
    tracemalloc.start()
    got = _content_hashes(flat[: begin[60_000]], begin[:60_000], length[:60_000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got.tolist())) == 60_000 and most < 6 * begin[60_000]
    assert (_content_hashes(byte_values(flat[:5000].tobytes()), np.array([0, 60]), np.array([60, 4940])) == _content_hashes(flat[:5000], np.array([0, 60]), np.array([60, 4940]))).all()
    assert len(_content_hashes(flat[:0], begin[:0], length[:0])) == 0


def test_registered_queries_at_small_scale(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    split = lambda t: [w.decode() for w in t.encode().split()]
    want = sorted((r[0], len(u), sum(m), hashlib.sha256(" ".join(w for w, x in zip(u, m) if not x).encode()).hexdigest()) for r, (u, m) in zip(rows, brute(rows, 20, split, True)))
    assert sorted(tuple(r) for r in QUERIES["op1_substring_dedup"](spark, sf).collect()) == want


def test_registered_suffix_query_at_small_scale(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = []
    for r, (u, m) in zip(rows, brute(rows, 50, lambda t: t.encode(), False)):
        runs = sum(x and not y for x, y in zip(m, [False, *m]))
        want.append((r[0], len(u), sum(m), runs, hashlib.sha256(bytes(b for b, x in zip(u, m) if not x)).hexdigest()))
    assert sorted(tuple(r) for r in QUERIES["op9_suffix_dedup"](spark, sf).collect()) == sorted(want)


def test_long_repetitive_text_is_streamed_in_runs():
    rng = np.random.default_rng(5)
    motif = rng.integers(1, 5, 90)
    lengths = np.array([40_000, 300, 12, 4_000])
    text = np.concatenate([np.append(np.resize(motif, n), 0) for n in lengths])
    text[[17_000, 40_100]] = 9
    begins = np.cumsum(lengths + 1) - lengths - 1
    steps = []

    class Counted(RunIndex):
        def step(self, symbol, *state):
            steps.append(len(symbol))
            return super().step(symbol, *state)

    found, times = stream(Counted(text, 12), text, begins, lengths, 12)
    assert len(steps) == 256 + 11
    earliest, count = {}, {}
    for b, n in zip(begins, lengths):
        for p in range(b, b + n - 11):
            key = text[p : p + 12].tobytes()
            earliest.setdefault(key, p)
            count[key] = count.get(key, 0) + 1
            assert found[p] == earliest[key]
    assert all(times[p] == count[text[p : p + 12].tobytes()] for b, n in zip(begins, lengths) for p in range(b, b + n - 11))
    assert (found[begins + lengths - 11] == -1).all()


def test_bytes_of_long_repetitive_texts(spark):
    motif = "the same ninety letters come again and again until the text is two hundred thousand bytes. "
    rows = [(1, motif * 2200), (2, "x" + motif * 3 + "end"), (3, motif[:49])]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, rows[0][1].encode()), 2: (3 * len(motif), 1, b"xend"), 3: (0, 0, motif[:49].encode())}
