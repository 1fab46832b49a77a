"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .text import chunks, strings

#: Where the vocabulary lies. The driver sends it to the workers; where only they have it, it is read there.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@functools.cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_sizes(df: DataFrame, keys: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keys`` and ``tokens`` of each row; null and empty texts have 0. Whole texts are measured."""
    schema = df.select(*keys).schema.add("tokens", "long")
    if os.path.isfile(tokenizer):
        df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(name)
        sp = _processor(sent if os.path.isfile(sent) else tokenizer)
        for big in batches:
            for batch in chunks(big, text, 1 << 18):
                ids = sp.encode([t or "" for t in strings(batch.column(text)).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([len(x) for x in ids], pa.int64())], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)
