"""Best-fit packing of documents into sequences.

Documents become pieces of at most `capacity` tokens. The counts of pieces by length, at most
`capacity` rows, are all that the plan needs (`bin_completion`); the plan names, for each length,
which bins take how many. Every piece then finds its bin from its rank among pieces of its length,
counted in blocks, so no length is ever gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

from .bin_completion import Plan, complete
from .common import col, groups_for
from .word_tokens import word_tokens

CAPACITY, END = 4096, 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and then `end`.

    Null and empty texts are a piece that holds only `end`. Equal rows give equal pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            rows: list[list] = [[], [], [], [], []]
            lists = []
            for number, ids in zip(numbers, tokens.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(rows, (number, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if with_ids:
                        lists.append(part.astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(col(id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(cut, schema)


def _places(plan: Plan) -> dict[str, np.ndarray]:
    """Runs of ranks: from `rank` on, items of `length` go `copies` to a bin, from bin `bin` on, at `offset`."""
    rows, taken, first = [], {}, 0
    for bins, copies in plan.kinds:
        offset = 0
        for length, number in copies:
            rows.append((length, taken.get(length, 0), first, number, offset))
            taken[length] = taken.get(length, 0) + bins * number
            offset += length * number
        first += bins
    rows.sort()
    names = ("length", "rank", "bin", "copies", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(items: DataFrame, capacity: int = CAPACITY, block_rows: int = 100_000, order: tuple[str, ...] = ("doc_id", "piece"), **search: int) -> DataFrame:
    """`items`, each with a `length` from 1 to `capacity`, with `sequence_id` (0 or more) and `offset`.

    Items of equal length are ranked by `order`; rows equal in it are told apart by any order, which
    does not change a sequence's filling. An empty table gives an empty result.
    """
    items = staged(items, "pieces")
    found = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, number in found.items():
        counts[length] = number
    plan, _ = complete(counts, capacity, **search)
    places = _places(plan)

    blocks = groups_for(int(counts.sum()), block_rows)
    spread = items.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = spread.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1
    ranked = spread.withColumn("_within", within).join(before, ["length", "_block"]).withColumn("_rank", F.col("_within") + F.col("_before"))

    names = items.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = places["length"] * (1 << 44) + places["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            own = rank - places["rank"][at]
            sequence = places["bin"][at] + own // places["copies"][at]
            offset = places["offset"][at] + own % places["copies"][at] * length
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(placed, f"{fields}, sequence_id long, offset long")
