"""Read collections: numbering, checks, mates, text sinks, and the test collections derived from documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import in_order
from .fastx import read_fastx

__all__ = ["checked", "document_pairs", "document_reads", "document_reads_n", "document_reads_rc", "mates", "numbered", "read_fastx", "read_four_line_fastq", "write_mates", "write_sequences"]

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def read_four_line_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Fast path where each record takes four lines: one text row a record, split by the JVM. Rows have no ordinal.

    A quality line that starts with "@" breaks a record in two; such files fail here and need read_fastx.
    """
    rows = spark.read.option("lineSep", "\n@").text(path).withColumn("value", F.regexp_replace("value", "\n$", ""))
    part = F.split("value", "\n")
    sound = (F.size(part) == 4) & (F.length(F.element_at(part, 2)) == F.length(F.element_at(part, 4)))
    rows = rows.withColumn("value", F.when(sound, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no record of four lines: "), F.substring("value", 1, 80)))))
    return rows.select(F.regexp_replace(F.element_at(part, 1), "^@", "").alias("name"), F.element_at(part, 2).alias("seq"), F.element_at(part, 4).alias("quality"))


def numbered(records: DataFrame) -> DataFrame:
    """read_id without gaps, seq, quality, in order of file and place there, by prefix sums: no task sorts all records."""
    return in_order(records.select("path", "offset", "seq", "quality"), ("path", "offset"), "read_id").select("read_id", "seq", "quality")


def checked(reads: DataFrame, length: int | None = None) -> DataFrame:
    """Fails on a read of another length than the first one's, and on symbols outside ACGTN."""
    if length is None:
        first = reads.orderBy("read_id").select(F.length("seq")).first()
        length = first[0] if first else 0
    sound = (F.length("seq") == length) & F.col("seq").rlike("^[ACGTN]*$")
    return reads.withColumn("seq", F.when(sound, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("unsound read "), F.col("read_id").cast("string")))))


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """One collection of both files: ids of the second follow those of the first, whose number must be equal."""
    n, m = first.count(), second.count()
    if n != m:
        raise ValueError(f"the files have {n} and {m} reads")
    return first.unionByName(second.withColumn("read_id", F.col("read_id") + n))


def write_sequences(reads: DataFrame, path: str, form: str = "plain", compression: str = "none") -> None:
    """Reads in order of id as text, in part files whose names are in that order; Spark commits them all or none.

    form is plain (a sequence a line), fasta or fastq; records are named by id, and fastq takes the column quality.
    """
    name = F.col("read_id").cast("string")
    line = {"plain": F.col("seq"), "fasta": F.concat(F.lit(">"), name, F.lit("\n"), "seq")}.get(form)
    if line is None:
        line = F.concat(F.lit("@"), name, F.lit("\n"), "seq", F.lit("\n+\n"), "quality")
    reads.orderBy("read_id").select(line.alias("value")).write.option("compression", compression).text(path)


def write_mates(reads: DataFrame, half: int, path: str, form: str = "plain", compression: str = "none") -> None:
    """A paired collection as path_1 and path_2: ids of the second mates start at half."""
    for k, own in ((1, F.col("read_id") < half), (2, F.col("read_id") >= half)):
        write_sequences(reads.where(own), f"{path}_{k}", form, compression)


#: Ids of a document's windows: as many as a text of a hundred million letters has.
WINDOWS = 1 << 20


#: Letters that become letters from a to z when they are lowered, and bytes of windows that are put out at once.
LOWERED = [(x.encode(), x.lower()[0].encode()) for x in ("\u0130", "\u212a")]
AT_ONCE = 1 << 24


def _cut(length: int, with_n: bool) -> Callable:
    """Windows of documents (doc_id, text); a window is `length` bytes, so a batch of them is one run of bytes."""
    small = LETTERS.encode()
    to = b"ACGT" * 6 + (b"AN" if with_n else b"AC")
    table = bytes.maketrans(small + small.upper(), to + to)
    others = bytes(set(range(256)) - set(small + small.upper()))

    def told(ids: list, counts: list[int], parts: list[bytes]) -> pa.RecordBatch:
        n = np.array(counts, np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = pc.multiply(pa.array(ids, pa.int64()), WINDOWS).take(pa.array(np.repeat(np.arange(len(n)), n)))
        data = b"".join(parts)
        texts = pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(np.arange(len(place) + 1, dtype=np.int32) * length), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pc.add(first, pa.array(place)), texts], names=["id", "w"])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts, parts, held = [], [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text is None:
                    continue
                if not text.isascii():
                    for letter, plain in LOWERED:
                        text = text.replace(letter, plain)
                if not (g := text.translate(table, others)):
                    continue
                if len(g) < length:
                    g = (g * length)[:length]
                rest = len(g) % length
                ids.append(doc_id)
                counts.append(len(g) // length + (rest > 0))
                parts += [g[: len(g) - rest], g[-length:]] if rest else [g]
                held += len(g)
                if held > AT_ONCE:
                    yield told(ids, counts, parts)
                    ids, counts, parts, held = [], [], [], 0
            if ids:
                yield told(ids, counts, parts)

    return batches_of


def _windows(documents: DataFrame, length: int, with_n: bool = False) -> DataFrame:
    """(id, w): the whole of each document's letters in windows end to end; the last one ends with the document.

    Fewer letters than a window has are repeated up to its length; a document without any has no window. One pass cuts
    a text, and only the windows go on.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(length, with_n), "id long, w string")


def document_reads(documents: DataFrame, length: int = 100) -> DataFrame:
    """Test collection: each document's letters, mapped to bases."""
    return _windows(documents, length).select(F.col("id").alias("read_id"), F.col("w").alias("seq"))


def document_reads_rc(documents: DataFrame, length: int = 100) -> DataFrame:
    """The same, every third read reverse-complemented."""
    from ..functions.sequence import reverse_complement

    rows = document_reads(documents, length)
    return rows.withColumn("seq", F.when(F.col("read_id") % 3 == 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


def document_reads_n(documents: DataFrame, length: int = 100) -> DataFrame:
    """The same with z read as N."""
    return _windows(documents, length, True).select(F.col("id").alias("read_id"), F.col("w").alias("seq"))


def document_pairs(documents: DataFrame, second: int = 100) -> DataFrame:
    """pair_id, mate1, mate2 of fragments of 160 letters: the mate starts 60 bases on and is reverse-complemented."""
    from ..functions.sequence import reverse_complement

    return _windows(documents, 160).select(F.col("id").alias("pair_id"), F.substring("w", 1, 100).alias("mate1"), reverse_complement(F.substring("w", 61, second)).alias("mate2"))
