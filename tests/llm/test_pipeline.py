import zlib

import numpy as np
import pytest
from test_near_and_flow import brute_components
from test_quality import brute as measures
from test_repeats import brute as repeated

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidemark.llm.bin_completion import lower_bound  # noqa: E402
from tidemark.llm.packing import default_tokenizer  # noqa: E402
from tidemark.llm.quality_classifier import classify, fit, graded  # noqa: E402

SF = "/root/testdata/sf0.001"


def passes(text):
    m = measures(text)
    return not (
        m["n_words"] < 50
        or 2 * m["n_repeat_words"] > m["n_words"]
        or 10 * m["n_symbols"] > m["word_chars"]
        or 100 * m["n_upper"] > 40 * m["word_chars"]
        or 100 * m["n_dup_lines"] > 30 * m["n_lines"]
        or not 2 * m["n_words"] <= m["word_chars"] <= 15 * m["n_words"]
    )


def test_pipeline_matches_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, graded(spark.read.parquet(f"{SF}/labels.parquet")))
    good = [(r.doc_id, r.text) for r in classify(docs, model).where("kept").collect()]
    assert 0 < len(good) < docs.count()
    ruled = [r for r in good if passes(r[1])]
    single = [r for r, c in zip(ruled, brute_components(ruled, 5)) if c[3]]
    assert 0 < len(single) < len(ruled) < len(good)
    texts = {}
    for (number, text), (words, gone) in zip(single, repeated(single, 20, lambda t: [w.decode() for w in t.encode().split()], True)):
        texts[number] = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else text
    tokenizer, want = Tokenizer.from_file(default_tokenizer()), {}
    for number, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[number, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in fill.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spots)]).tolist()]
        assert [o for o, _ in sorted(spots)] == ends[:-1] and ends[-1] <= 4096
    assert len(fill) == lower_bound(np.bincount([x[1] for x in want.values()], minlength=4097), 4096)


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 5, "en", "s", 25), (2, "word " * 5, "en", "s", 25)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
