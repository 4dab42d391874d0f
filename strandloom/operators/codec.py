"""Byte codecs for streams outside Parquet, the choice of the smaller result, and bit packing."""

from __future__ import annotations

import bz2
import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType


@pandas_udf(BinaryType())
def block_sort_compress(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: bz2.compress(x, 9))


@pandas_udf(BinaryType())
def dictionary_compress(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: lzma.compress(x, lzma.FORMAT_ALONE))


@pandas_udf(BinaryType())
def decompress(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, codec in parts:
        yield pd.Series([bz2.decompress(d) if c == "bz2" else lzma.decompress(d) for d, c in zip(data, codec, strict=True)])


def smaller(block_sorted: Column, by_dictionary: Column) -> Column:
    """struct(codec, data): the dictionary coder's result only where it is strictly smaller."""
    wins = F.octet_length(by_dictionary) < F.octet_length(block_sorted)
    return F.struct(F.when(wins, "lzma").otherwise("bz2").alias("codec"), F.when(wins, by_dictionary).otherwise(block_sorted).alias("data"))


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)


def pack_bases(seq: str, bits: int = 2) -> bytes:
    """Two bits a base, four a byte, or three bits a base with N, five to two bytes; first base lowest."""
    per, kind = (4, np.uint8) if bits == 2 else (5, np.dtype("<u2"))
    codes = np.array(["ACGTN".index(c) for c in seq], np.uint32)
    if bits == 2 and (codes > 3).any():
        raise ValueError("two bits hold no N")
    codes = np.pad(codes, (0, -len(codes) % per)).reshape(-1, per)
    return (codes << (bits * np.arange(per, dtype=np.uint32))).sum(axis=1).astype(kind).tobytes()


def unpack_bases(data: bytes, n: int, bits: int = 2) -> str:
    per, kind = (4, np.uint8) if bits == 2 else (5, np.dtype("<u2"))
    words = np.frombuffer(data, kind).astype(np.uint32)[:, None]
    codes = (words >> (bits * np.arange(per, dtype=np.uint32)) & ((1 << bits) - 1)).ravel()[:n]
    return "".join("ACGTN"[c] for c in codes)
