"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import ship

DEFAULT_VOCABULARY = os.environ.get("CLAIMWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def heading_of(text: str) -> str:
    """The first line, where it is a short heading without a full stop; it is a prompt and bears no loss."""
    line, sep, _ = text.partition("\n")
    return line + sep if sep and len(line) <= 80 and line.rstrip()[-1:] not in (".", "!", "?", "") else ""


def with_tokens(df: DataFrame, keep: list[str], text_col: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """keep, n_tokens and loss_tokens (tokens after a heading line) of each row; null and empty texts have none."""
    ship(df.sparkSession)
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int32)
            loss = np.zeros(batch.num_rows, np.int32)
            for i, text in enumerate(batch.column(len(keep))):
                text = text.as_py()
                if text:
                    n[i] = len(enc.encode_ordinary(text))
                    head = heading_of(text)
                    loss[i] = n[i] - (len(enc.encode_ordinary(head)) if head else 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n), pa.array(np.maximum(loss, 0))], [*keep, "n_tokens", "loss_tokens"])

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, ", ".join([*kinds, "n_tokens int", "loss_tokens int"]))
