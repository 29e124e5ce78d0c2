import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm.bin_completion import best_fit, complete, lower_bound  # noqa: E402
from tidemark.llm.bpe import Encoder, encode_texts  # noqa: E402
from tidemark.llm.packing import default_tokenizer, pack, pieces  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

AWKWARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "a \nb", "x\t\ty z", "it's we'll 'S don't'd", "été naïve ÀÉ", "漢字かな 交じり　文", "a b  c",
    "a b   c", "a \x1c b\x1c c", "a\x85b \x85 c", "emoji 👩‍👩‍👧 🏳️‍🌈!", "1234567890 12 3", "#$%&*|<>", "<|endoftext|> <|startoftext|>x", "x" * 500, "ab" * 300 + " end", "́ é ​ z", "trailing   ", "\r\n\r\n x", "ÿþ \x00 \x7f",
]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward(seed=5, count=150):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", " \n", "\t", " ", "　", "the", "Zq", "42", "'s", "é", "漢", "!", "?!", "\x1d", " "]
    return AWKWARD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(count)]


def test_bpe_matches_tiktoken(spark, tiktoken_encoding):
    texts = awkward()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, `a.b` int").repartition(2)
    got = {r.doc_id: r for r in encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = tiktoken_encoding.encode_ordinary(t or "")
        assert got[i].ids == " ".join(map(str, want)), repr(t)
        assert got[i].n_tokens == len(want) and bytes(got[i].decoded) == (t or "").encode() and got[i]["a.b"] == 1
    assert encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_matches_tiktoken(spark, tiktoken_encoding):
    rows = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = tiktoken_encoding.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_long_words_and_small_memory(tiktoken_encoding, monkeypatch):
    from tidemark.llm import bpe

    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts = [letters(200_000), "ab" * 100_000, "a" * 200_000, "漢字" * 20_000, *[f"{letters(n)} {letters(n)}," for n in (255, 256, 257) for _ in range(3)]]
    monkeypatch.setattr(bpe, "KEEP", 15)
    monkeypatch.setattr(bpe, "_CHUNK", 300)
    texts += [t or "" for t in awkward(8, 120)] * 2
    own = Encoder(RANKS, public_tokenizers.PATTERN)
    for text, (n, ids, data) in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = tiktoken_encoding.encode_ordinary(text)
        assert (n, ids.decode(), data) == (len(want), " ".join(map(str, want)), text.encode())
    assert len(own.words) <= 15 + 300


def test_decode_inverts_any_ids():
    own = Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = {i: [rng.randrange(50_000) for _ in range(rng.randint(1, 30))] for i in range(20)}
    by_id = {v: k for k, v in own.ranks.items()}
    got = own.decode([" ".join(map(str, x)).encode() for x in texts.values()])
    assert got == {i: b"".join(by_id[x] for x in ids) for i, ids in texts.items()}


def check_packing(rows, capacity, total):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(rows) == total
    return len(by_sequence)


def test_packing_query_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[d.doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used = check_packing(rows, 4096, len(want))
    counts = np.bincount([x[1] for x in want.values()], minlength=4097)
    assert used == lower_bound(counts, 4096)


def test_pieces_of_awkward_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = awkward(9) + ["the cat " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = pieces(docs, default_tokenizer(), with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], repr(t)
    assert pack(pieces(docs.limit(0), default_tokenizer())).count() == 0


def test_many_equal_lengths_over_blocks(spark):
    lengths = [1365] * 50 + [2731] * 20 + [1] * 200 + [4096] * 3 + [7, 7, 7]
    items = spark.createDataFrame([(i // 2, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = pack(items, block_rows=10).collect()
    assert check_packing(rows, 4096, len(lengths)) == lower_bound(np.bincount(lengths, minlength=4097), 4096)


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_against_brute_force():
    rng = random.Random(11)
    reached = 0
    for _ in range(60):
        capacity = rng.randint(10, 40)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        plan, bound = complete(counts, capacity)
        left = counts.copy()
        for bins, copies in plan.kinds:
            assert sum(length * n for length, n in copies) <= capacity
            for length, n in copies:
                left[length] -= bins * n
        assert not left.any()
        best = optimum(items, capacity)
        assert bound <= best <= plan.bins <= best_fit(counts, capacity).bins
        reached += plan.bins == best
    assert reached == 60
