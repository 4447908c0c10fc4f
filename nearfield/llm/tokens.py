"""Token counts by a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import column

#: Ranks for counting, and the same vocabulary with positions.
DEFAULT_TOKENIZER, POSITION_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.json"
# fixed value: how byte-level BPE vocabularies of this family part a text into words before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def load(path: str):
    """The tokenizer of a `tokenizers` file, once a worker; texts of special tokens count as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function that gives a text's token ids, for a file of ranks (.tiktoken) or of `tokenizers` (.json)."""
    if not path.endswith(".tiktoken"):
        return lambda text, t=load(path): t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(docs: DataFrame, path: str = DEFAULT_TOKENIZER, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns of `keep` and n_tokens of each document's whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                n = [len(ids(t)) if t else 0 for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    kept = docs.select(*keep, "text")
    return kept.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kept.select(*keep).dtypes) + ", n_tokens long")


def normal_source(c):
    """Spelling variants of a source name as one: lower case, blanks trimmed, hyphens and inner blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
