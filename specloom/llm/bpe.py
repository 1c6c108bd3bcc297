"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut before encoding, at places where the split pattern always ends a match: between a
letter, mark or number of any script and a blank or line feed (no alternative of the pattern has white
space after other characters, and none looks behind); in scripts without blanks, between a letter and
a closing or clause mark of SAFE_MARKS, which no alternative joins to a letter before it. Encoding the
parts thus gives the ids of the whole. Ids decode to raw bytes, whatever their place in a character.

Defined cases: a null text counts as empty and has no ids; rows that repeat an id, null ids and equal
texts are rows of their own; a text without a safe place (one run of letters, say) is encoded whole;
an empty table gives an empty result; other columns are carried, and the new column gets underscores
where its name clashes. Batches are cut by bytes of text or ids, so no array outgrows its offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import free_name, slices

#: Marks that end clauses in scripts without blanks; none is an apostrophe, which may begin a suffix of the word before.
SAFE_MARKS = "。、，．！？；：」』）】》"
SAFE = regex.compile(rf"(?<=[\p{{L}}\p{{N}}])(?=[ \n])|(?<=\p{{L}})(?=[{SAFE_MARKS}])")
LONG, IDS = 1 << 16, 1 << 19  # characters of a part; ids that are decoded together


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, most: int = LONG) -> Iterator[str]:
    """Parts of about `most` characters, cut only at safe places; together they are the text."""
    at = 0
    while len(text) - at > most and (cut := SAFE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, enc) -> np.ndarray:
    parts = [enc.encode_ordinary(part) for part in safe_parts(text or "")]
    return np.concatenate([np.asarray(p, np.int32) for p in parts])


def encode(df: DataFrame, rank_path: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """df with an array<int> column of token ids, the last one."""
    at, ids_column = df.columns.index(text_column), free_name(df.columns, ids_column)

    def run(batches):
        enc = encoding(rank_path, pattern)
        for whole in batches:
            for batch in slices(whole, text_column):
                ids = [encode_text(t, enc) for t in batch.column(at).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids_column])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(ids_column, ArrayType(IntegerType()))]))


def decode(df: DataFrame, rank_path: str, pattern: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """df with a binary column, the last one: the bytes that the ids stand for (null ids: no bytes)."""
    at, bytes_column = df.columns.index(ids_column), free_name(df.columns, bytes_column)

    def run(batches):
        enc = encoding(rank_path, pattern)
        for whole in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(whole.column(at)), 0)), dtype=np.int64)
            start = 0
            while start < whole.num_rows:
                upto = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + IDS, side="right")))
                batch = whole.slice(start, upto - start)
                column = pa.array([enc.decode_bytes(ids or []) for ids in (x.as_py() for x in batch.column(at))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, bytes_column])
                start = upto

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(bytes_column, BinaryType())]))


def digests(df: DataFrame, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes."""
    return df.select(
        "doc_id",
        F.size(ids_column).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids_column).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(bytes_column), 256).alias("decoded_sha256"),
    )
