"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file's place is a parameter; files are read by the workers and
never copied.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("LUMENLIT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


def sized(documents: DataFrame, *kept: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, the kept columns, and tokens: the size of the whole text; a null text has size 0.

    Rows without a doc_id are left out, and a repeated doc_id counts once.
    """
    schema = documents.select("doc_id", *kept).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes: list[int] = []
            for at in range(0, len(texts), 64):  # few at a time: encodings are large
                sizes += [len(e.ids) for e in coder.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *kept)), pa.array(sizes, pa.int64())], names=["doc_id", *kept, "tokens"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", tokens long"
    return documents.select("doc_id", *kept, "text").where(F.col("doc_id").isNotNull()).mapInArrow(count, ddl).dropDuplicates(["doc_id"])
