"""Token counts of whole texts, without the tokens: Arrow functions that return lengths only.

Batches are cut by bytes, not rows. A long text is split into segments at safe boundaries (ASCII white space, for the
word-level vocabulary), so what the library holds at once is bounded however long a text is. Vocabularies for which
no boundary is known to be safe encode each text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import wordpieces
from gridloom.llm._common import map_arrow, slices

#: Bytes of texts in one batch, and of one segment of a long text.
BATCH, SEGMENT = 1 << 20, 1 << 18


def segments(text: bytes, most: int = SEGMENT) -> Iterator[bytes]:
    """Parts of at most ``most`` bytes that begin or end at ASCII white space; a longer run without any stays whole."""
    start = 0
    while len(text) - start > most:
        cut = max(text.rfind(c, start, start + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= start:
            cut = min((p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, start + most)) >= 0), default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    memo, safe = wordpieces.memo(path, "length"), wordpieces.splits_at_space(path)
    for batch in slices(batches, "text", BATCH):
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        counts = []
        if safe and pc.sum(sizes).as_py() <= 2 * BATCH:
            split = wordpieces.split(batch.column("text"))
            known = memo.know([w for s in split for w in s])
            counts = [sum(map(known.__getitem__, s)) for s in split]
        elif safe:  # one text alone, longer than a batch
            for text in batch.column("text").to_pylist():
                total = 0
                for part in segments(text.encode()):
                    (words,) = wordpieces.split(pa.array([part], pa.binary()))
                    total += sum(map(memo.know(words).__getitem__, words))
                counts.append(total)
        else:
            encode = memo.encode
            counts = [len(ids) for ids in encode([t or "" for t in batch.column("text").to_pylist()])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row: UTF-8 bytes, tokens without begin, end or added special ones, and n_tokens > limit.

    Null and empty texts have no bytes and no tokens. Null ids and repeated rows are kept as they are; an empty table
    gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, partial(_count, path=tokenizer_path), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
