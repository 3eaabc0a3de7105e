"""Byte-level BPE with tiktoken: encoding of whole texts by a local rank file, and raw-byte decoding.

A text is cut before it is encoded, so that the cost of one call is bounded. Cuts are made only where
every split of the pattern ends anyway: before a single space that stands between two characters that
are no white space. No match can reach over such a place and no match looks behind it.
A letter run or symbol run without such a place is one match and stays whole, as the pattern asks.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, map_arrow, narrow, slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK = 1 << 15  # characters after which the next safe place is looked for
_SAFE = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder per worker process; the rank file must lie at the same path on every machine."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(f"ranks of {path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(text: str, chunk: int) -> Iterator[tuple[str, bool]]:
    start = 0
    while len(text) - start > chunk:
        cut = _SAFE.search(text, start + chunk)
        if cut is None:
            break
        yield text[start:cut.start()], False
        start = cut.start()
    if start < len(text):
        yield text[start:], False


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """The text in parts, each with whether it is one single match of the pattern.

    Parts have about ``chunk`` characters and are cut at safe places. A white-space run of that
    length overflows the matcher's stack; the pattern makes one match of it, without its last
    character if something follows, so it is handed on as such a match.
    """
    start = 0
    if len(text) > chunk:
        for run in regex.finditer(r"\p{White_Space}{%d,}+" % max(2, chunk), text):
            stop = run.end() - (run.end() < len(text))
            yield from _cut(text[start:run.start()], chunk)
            yield text[run.start():stop], True
            start = stop
    yield from _cut(text[start:] if start else text, chunk)


def token_ids(text: str, encoder: tiktoken.Encoding, chunk: int = CHUNK) -> list[int]:
    out: list[int] = []
    for piece, single in pieces(text, chunk):
        out += encoder._encode_single_piece(piece) if single else encoder.encode_ordinary(piece)
    return out


def _map_texts(path: str, pattern: str, decoded: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.asarray(token_ids(t or "", encoder), np.int32) for t in part.column("text").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))
                columns = {"doc_id": part.column("doc_id"), "ids": tokens}
                if decoded:
                    columns["decoded"] = pa.array([encoder.decode_bytes(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str = RANKS,
           pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; no special tokens. ``decoded`` adds the bytes decoded from the ids.

    A null text is encoded as the empty one. Repeated rows give repeated results; other columns are not read.
    """
    rows = narrow(df, doc_id=id_column, text=text_column)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add("decoded", T.BinaryType())
    return map_arrow(rows, _map_texts(ranks, pattern, decoded), schema)


def _map_ids(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in part.column("ids")]
                decoded = [None if x is None else encoder.decode_bytes(x.tolist()) for x in lists]
                columns = [part.column("doc_id"), part.column("ids"), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return run


def decode(df: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``; they need not be valid UTF-8 for any ids. Null ids stay null."""
    schema = T.StructType([df.schema["doc_id"], df.schema["ids"], T.StructField("decoded", T.BinaryType())])
    return map_arrow(df.select("doc_id", "ids"), _map_ids(ranks, pattern), schema)


def digests(df: DataFrame) -> DataFrame:
    """Encoded and decoded documents as counts and hashes, in one pass over the texts."""
    both = encode(df, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
SQL: dict[str, str] = {}
