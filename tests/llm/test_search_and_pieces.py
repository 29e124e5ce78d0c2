import hashlib
import random
import re
import struct

import duckdb
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from tidemark.llm.divergence import divergence, divergence_sql  # noqa: E402
from tidemark.llm.lexical import lexical_search, search_sql  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402
from tidemark.llm.sentence_pieces import PieceModel, encode_pieces, fields  # noqa: E402

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a  b", "a \n b", "été naïve ÀÉ", "漢字かな 交じり　文", "▁a", "▁ ▁▁ b", " ▁", "a▁b", "x\t\ty", "emoji 👩‍👩‍👧 🏳️‍🌈!", "ÿþ \x00 \x7f", "x" * 700 + " " * 90 + "y", "漢" * 300,
    "Zq42's?! <s></s><unk><0x41>", "\r\n  tail  ",
]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def duck(sql, columns, **tables):
    db = duckdb.connect()
    for name, (ddl, rows) in tables.items():
        db.execute(f"CREATE TABLE {name} ({ddl})")
        if rows:
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


# Divergence

AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def audit_rows(seed, count):
    rng = random.Random(seed)
    words = ["a", "B", "b", "zebra", "Écoute", "écoute", "漢", "x1y", "it's", "long" * 40, "long" * 40 + "r", *(f"w{c}" for c in "abcdefghij")]
    out = []
    for i in range(count):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "É", None])
        text = rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
        out.append((i, text, lang, source))
    out += [(count, "rareword only here", "fr", "s1"), (count + 1, None, "fr", "s2"), (count + 2, None, "none", "s1")]
    return [*out, *out[:20]]


@pytest.mark.parametrize(("least", "top"), [(30, 50), (3, 2), (1, 5), (10_000, 50)])
def test_divergence_equals_sql(spark, least, top):
    rows = audit_rows(4, 250)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, c int, TERM string").repartition(3)
    want = duck(divergence_sql(least, top), AUDIT, documents=("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", rows))
    assert rows_of(divergence(docs, least, top), *AUDIT) == want
    assert divergence(docs.limit(0), least, top).count() == 0


def test_divergence_over_many_blocks(spark, monkeypatch):
    from tidemark.llm import divergence as module

    monkeypatch.setattr(module, "_TERMS", 3)
    monkeypatch.setattr(module, "_SOURCES", 2)
    monkeypatch.setattr(module, "_HELD", 5)
    monkeypatch.setattr(module, "_STEP", 2)
    monkeypatch.setattr(module, "_PREFIX", 4)
    rows = [(i, *r[1:]) for i, r in enumerate(audit_rows(8, 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    want = duck(divergence_sql(2, 3), AUDIT, documents=("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", rows))
    assert rows_of(divergence(docs, 2, 3), *AUDIT) == want


def test_skyband_keeps_what_few_dominate():
    import numpy as np

    from tidemark.llm.divergence import Skyband

    rng = random.Random(6)
    points = sorted({(-rng.randint(1, 40), rng.randint(1, 40), f"t{rng.randint(0, 900)}") for _ in range(900)})
    for most in (1, 3, 50):
        band, kept = Skyband(most), []
        for at in range(0, len(points), 300):
            part = points[at : at + 300]
            stay = band.add(np.array([p[1] for p in part]), np.array([p[2].encode() for p in part], "S64"))
            kept += [p for p, s in zip(part, stay, strict=True) if s]
        assert kept == [p for p in points if sum(q[0] <= p[0] and q[1] <= p[1] and q[2] < p[2] for q in points) < most]


# Search

FOUND = ["item_id", "rank", "doc_id", "score"]


def test_search_equals_sql(spark):
    rng = random.Random(3)
    words = ["the", "The", "of", "é", "É", "漢字", "x9", "9", "a-b", "q"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([1, 3, 30, 200]))) for i in range(300)] + [(300, None), (301, ""), (302, "... --")]
    rows += [(400 + i, rows[7][1]) for i in range(25)]
    items = [(i, text(rng.randint(1, 12))) for i in range(40)] + [(40, None), (41, ""), (42, "never seen"), (43, "w1 w1 W1")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, term string, SCORE int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = duck(search_sql(), FOUND, documents=("doc_id BIGINT, text VARCHAR", rows), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert rows_of(lexical_search(docs, asked), *FOUND) == want
    assert rows_of(lexical_search(docs, asked, block_items=9), *FOUND) == want
    assert rows_of(lexical_search(docs, asked, block_bytes=40), *FOUND) == want
    assert lexical_search(docs.limit(0), asked).count() == 0 and lexical_search(docs, asked.limit(0)).count() == 0


def test_search_without_numbers_and_with_repeats(spark):
    docs = spark.createDataFrame([(None, "cat dog"), (5, "cat dog"), (5, "cat dog"), (1, "cat")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(None, "dog"), (None, "cat"), (7, "dog"), (7, "dog")], "item_id long, text string")
    got = lexical_search(docs, items).collect()
    assert sorted((r.rank, r.doc_id) for r in got if r.item_id == 7) == [(1, 5), (2, 5), (3, None)]
    assert sorted((r.rank, r.doc_id) for r in got if r.item_id is None and r.rank > 3) == [(4, None)]
    assert sum(r.item_id is None for r in got) == 7


def test_bounds_hold_with_few_coordinates(spark, monkeypatch):
    from tidemark.llm import lexical

    monkeypatch.setattr(lexical, "WIDTH", 3)
    monkeypatch.setattr(lexical, "_DOCS", 4)
    rng = random.Random(12)
    rows = [(i, " ".join(f"t{rng.randint(0, 30)}" for _ in range(rng.randint(0, 20)))) for i in range(200)]
    items = [(i, " ".join(f"t{rng.randint(0, 30)}" for _ in range(4))) for i in range(10)]
    want = duck(search_sql(), FOUND, documents=("doc_id BIGINT, text VARCHAR", rows), benchmark=("item_id BIGINT, text VARCHAR", items))
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_search(docs, asked), *FOUND) == want


@pytest.mark.parametrize(("name", "columns"), [("op11_source_divergence", AUDIT), ("op12_lexical_search", FOUND)])
def test_queries_equal_their_sql(spark, name, columns):
    from tidemark.llm.queries import SQL

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows_of(QUERIES[name](spark, SF), *columns) == sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall(), key=repr)


# Pieces


def awkward(seed, count):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "　", "the", "Zq", "42", "'s", "é", "漢", "!", "▁", "ﬁ", "①", "\u200b", "e\u0301", "ing", "tion", "\x01"]
    return TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(count)]


def same_as_library(own, library, texts):
    for text, (n, ids, decoded, begins, ends) in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, return_type="proto").pieces
        assert [int(i) for i in ids.split(b",") if i] == [p.id for p in want] and n == len(want), repr(text)
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in want], repr(text)
        assert decoded.decode() == library.decode([p.id for p in want]), repr(text)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_spans_and_text_equal_the_library(library):
    same_as_library(PieceModel(MODEL), library, [t or "" for t in awkward(2, 800)])


def test_memory_in_generations(library, monkeypatch):
    from tidemark.llm import sentence_pieces

    monkeypatch.setattr(sentence_pieces, "_KEEP", 40)
    monkeypatch.setattr(sentence_pieces, "_CHUNK", 200)
    same_as_library(PieceModel(MODEL), library, [t or "" for t in awkward(5, 300)])


def test_decode_of_any_ids_equals_the_library(library):
    own, rng = PieceModel(MODEL), random.Random(1)
    for _ in range(1500):
        ids = [rng.randrange(32_000) if rng.random() < 0.7 else rng.randrange(260) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids).decode() == library.decode(ids), ids


def double_array(keys):
    """The map's trie: one unit a node, children at the node's number xor its offset xor the byte."""
    pool, tree = b"", {}
    for key, value in keys.items():
        node = tree
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = len(pool)
        pool += value.encode() + b"\0"
    units, used, bases, todo = {}, {0}, set(), [(0, 0, tree)]
    while todo:
        at, label, node = todo.pop()
        base = next(b for b in range(1, 1 << 20) if b not in bases and not any(b ^ x in used for x in node))
        bases.add(base)
        used |= {base ^ x for x in node}
        units[at] = ((at ^ base) << 10) | ((0 in node) << 8) | label
        for x, child in node.items():
            if x:
                todo.append((base ^ x, x, child))
            else:
                units[base] = child | 1 << 31
    size = (max(units) // 256 + 1) * 256
    return struct.pack("<I", 4 * size) + b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size)) + pool


def number(value):
    out = b""
    while True:
        value, low = value >> 7, value & 127
        out += bytes([low | 128 if value else low])
        if not value:
            return out


def field(tag, value):
    return number(tag << 3) + number(value) if isinstance(value, int) else number(tag << 3 | 2) + number(len(value)) + value


@pytest.mark.parametrize("remove_extra", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_character_map_equals_the_library(remove_extra, prefix):
    """The given model's map is empty; the same model with a map of some keys that are prefixes of each other."""
    keys = {"ﬁ": "fi", "①": "1", "e\u0301": "é", "\u3000": " ", "\t": " ", "\u200b": "", "42": "forty two", "4": "four", "漢": "kan ji"}
    normaliser = b"".join([field(1, b"own"), field(2, double_array(keys)), field(3, prefix), field(4, remove_extra), field(5, 1)])
    with open(MODEL, "rb") as file:
        raw = file.read()
    data = b"".join(field(n, normaliser if n == 3 else v) for n, v in fields(raw))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    same_as_library(PieceModel(data=data), library, [t or "" for t in awkward(7, 400)])


def test_frames_with_clashing_names_and_gaps(spark, library):
    texts = TEXTS + [TEXTS[9]] * 3 + ["漢字 " * 40_000, "a" * 200_000]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, IDS string, `a.b` int").repartition(3)
    got = {r.doc_id: r for r in encode_pieces(docs, MODEL).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = library.encode(t or ""), got[i]
        assert r.ids == ",".join(map(str, want)) and r.n_tokens == len(want) == len(r.begins) and r["a.b"] == 2
        assert r.decoded == library.decode(want) and r.n_spanned == len((t or "").encode())
    assert encode_pieces(docs.limit(0), MODEL, spans=False).count() == 0


def test_pieces_query_equals_the_library(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op13_sentence_pieces"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_terms_are_those_of_the_patterns():
    from tidemark.llm.terms import LETTERS, LETTERS_DIGITS, cutter

    text = "".join(map(chr, range(0x250))) + " Ab9-é漢K\u212a"
    for signs, pattern in ((LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [x.decode() for x in cutter(signs)(text.encode())] == re.findall(pattern, lower)
