import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tidemark.llm.packing import default_tokenizer  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402
from tidemark.llm.token_shards import Permutation, materialise, open_layout, read_from  # noqa: E402


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection(size):
    for key in (1, 2, 1 << 63):
        order = Permutation(size, key)
        slots = order.slot(np.arange(size))
        assert sorted(slots.tolist()) == list(range(size))
        assert (order.number(slots) == np.arange(size)).all()
    if size > 60:
        assert (Permutation(size, 1).slot(np.arange(size)) != Permutation(size, 2).slot(np.arange(size))).mean() > 0.9


def test_round_trip_and_resume(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = [(i, "word %d the cat " % i * (i % 40)) for i in range(150)] + [(200, None), (201, ""), (None, "no number"), (5, "word 5 the cat " * 5), (300, "very long " * 20000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(3)
    folder = str(tmp_path / "shards")
    index, layout = materialise(docs, default_tokenizer(), length=16, per_shard=50, folder=folder)
    rows_out = index.collect()
    assert open_layout(folder) == layout and layout.size == len(rows_out)
    assert sorted(r.slot for r in rows_out) == list(range(layout.size))
    image = np.concatenate([block for _, block in read_from(layout, records=7)])
    assert image.shape == (layout.size, 16)
    for start in (0, 13, 50, layout.size - 1, layout.size):
        parts = [block for _, block in read_from(layout, start, records=9)]
        assert (np.concatenate([image[:0], *parts]) == image[start:]).all()
    got = {}
    for r in sorted(rows_out, key=lambda r: r.piece):
        assert (r.shard, r.record) == divmod(r.slot, 50)
        ids = image[r.slot, : r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32 and (image[r.slot, r.length :] == 1).all()
        got.setdefault(r.doc_id, []).append((r.piece, tuple(ids.tolist())))
    want = {}
    for number, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(number, []).extend((i, tuple(ids[a : a + 16])) for i, a in enumerate(range(0, len(ids), 16)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index, layout = materialise(docs, default_tokenizer(), folder=str(tmp_path / "none"))
    assert index.count() == 0 and layout.size == 0 and list(read_from(layout)) == []


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op8_token_shards"](spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
