"""Sizes of texts in tokens of a public tokenizer, whose files stay where they are."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
_loaded: dict[tuple[str, str], object] = {}


def encoder(folder: str, vocabulary: str):
    """The byte-level encoding of `<vocabulary>.tiktoken`; loaded once per worker."""
    if (folder, vocabulary) not in _loaded:
        import tiktoken

        spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[folder, vocabulary] = tiktoken.Encoding(vocabulary, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, vocabulary]


def token_sizes(df: DataFrame, text: str, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (keep..., tokens): the number of tokens of the whole text, null for null."""
    types = dict(df.dtypes)
    n = len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            sizes = [None if t is None else len(e.encode_ordinary(t)) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).cast("string").alias("text_")).mapInArrow(count, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", tokens bigint")
