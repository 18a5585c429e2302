"""Byte-level BPE encoding and decoding with tiktoken over a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts over this many characters are encoded in pieces of about this length.
PIECE_CHARS = 1 << 16
SLICE_CHARS = 1 << 21

#: A lone space between two characters that are no white space: a match of the pattern always starts at it, since only a run of white space could reach across.
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
VISIBLE = regex.compile(r"\S")


def located(file: str | Callable[[], str]) -> str:
    """The path of a vocabulary file: as it is, or by a function that an executor calls, whose files may lie elsewhere than the driver's."""
    return file() if callable(file) else file


@lru_cache(maxsize=4)
def load(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token, blank, rank on each line), without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, pattern: str, length: int = PIECE_CHARS):
    """Cut ``text`` where a match of ``pattern`` starts, about every ``length`` characters.

    Cuts are made at safe spaces. Where there is none for a whole length, the pattern itself is run from the last cut, which is always
    the start of a match, to find the first match beyond the length that ends in a visible character (white space looks ahead, so it may not end
    a piece); a single longer match stays whole.
    """
    start = 0
    while len(text) - start > length:
        found = SAFE_CUT.search(text, start + length // 2, start + length)
        if found:
            cut = found.start()
        else:
            cut = next((m.end() for m in _compiled(pattern).finditer(text, start) if m.end() - start >= length and VISIBLE.match(text, m.end() - 1)), len(text))
        yield text[start:cut]
        start = cut
    if start < len(text) or not text:
        yield text[start:]


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    return regex.compile(pattern)


def encode(text: str | None, encoding: tiktoken.Encoding, pattern: str) -> list[int]:
    """Token ids of a whole text; null counts as empty. Strings of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text, pattern) for i in encoding.encode_ordinary(piece)]


def with_tokens(df: DataFrame, rank_file: str | Callable[[], str], pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of ``text`` as ARRAY<INT> in ``out``, and with ``decoded`` the bytes they decode to as BINARY.

    Null and empty texts give an empty array and no bytes. Other columns stay as they are; columns named as the new ones are replaced. Rows come
    and go in slices of about SLICE_CHARS characters, since ids take several times the memory of their text.
    """
    kept = df.drop(*[c for c in (out, decoded) if c])
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.BinaryType())

    def run(batches):
        import pyarrow as pa

        encoding = load(located(rank_file), pattern)
        for batch in batches:
            for rows in _slices(batch, at):
                ids = [np.array(encode(t, encoding, pattern), np.int32) for t in rows.column(at).to_pylist()]
                made = [pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    made.append(pa.array([encoding.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=schema.names)

    return kept.mapInArrow(run, schema)


def _slices(batch, at: int):
    """Runs of rows with about SLICE_CHARS characters, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_decoded(df: DataFrame, rank_file: str | Callable[[], str], pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the raw bytes of an ARRAY<INT> of ids as BINARY in ``out``; null stays null. An id cut out of its text can leave bytes that are no
    whole UTF-8, hence no string. An unknown id raises KeyError."""

    @F.pandas_udf("binary")
    def decoded(batches: pd.Series) -> pd.Series:
        encoding = load(located(rank_file), pattern)
        return pd.Series([None if x is None else encoding.decode_bytes(list(x)) for x in batches])

    return df.withColumn(out, decoded(F.col(f"`{ids}`")))


def round_trip_digests(df: DataFrame, rank_file: str | Callable[[], str], pattern: str, text: str = "text", out: str = "digest") -> DataFrame:
    """Add STRUCT<n_tokens, ids_sha256, decoded_sha256>: encode and decode each text within the task and keep only the digests, so that ids never
    enter a row. ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the decoded bytes; both in lower-case hex."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        encoding = load(located(rank_file), pattern)
        name = _decimal(encoding.n_vocab)
        rows = []
        for t in texts:
            got = encode(t, encoding, pattern)
            rows.append((len(got), hashlib.sha256(b" ".join(map(name.__getitem__, got))).hexdigest(), hashlib.sha256(encoding.decode_bytes(got)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    return df.withColumn(out, digest(F.col(f"`{text}`")))


@lru_cache(maxsize=4)
def _decimal(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]
