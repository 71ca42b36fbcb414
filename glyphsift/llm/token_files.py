"""Token ids in binary shards with Elias-Fano document boundaries (operator 7).

File format.  A data set is a folder of Parquet files, written and committed by
Spark (so lost executors and repeated tasks leave no torn files, and any store
that Spark reaches will do).  Each row is one *shard* of a bounded number of
tokens, in ascending document order by ``(part, seq)``:

``ids``         concatenated ids, little endian, ``width`` bytes each
``n_docs, n_tokens``
``ends_*``      Elias-Fano code of the documents' end offsets in the shard
``docs_*``      Elias-Fano code of the document ids, less ``docs_base``
``n_null``      leading documents without an id

An Elias-Fano code of n ascending numbers below u keeps ``low_bits =
floor(log2(u / n))`` low bits of each, packed (``_low``), and the rest in unary
(``_high``: number i sets bit ``high_i + i``), at most 2 + log2(u / n) bits a
number.  ``_hint`` holds the place of every 256th set bit, so :meth:`select`
reads a few words of the unary part only.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.sources.tables import table

from .bpe import WordIds, tokenizer_path
from .common import bounded_batches, byte_column, parallelism, pieces, shared_dir

STEP = 256
SHARD_TOKENS = 1 << 22
#: Words whose ids a worker keeps.
KEPT_WORDS = 1_000_000
SCHEMA = "part int, seq int, n_docs long, n_null long, n_tokens long, width int, ids binary, ends_bits int, ends_low binary, ends_high binary, ends_hint binary, docs_base long, docs_bits int, docs_low binary, docs_high binary, docs_hint binary"


class EliasFano:
    """An ascending sequence of numbers, compressed, with select."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, hint: bytes):
        self.n, self.bits, self.low, self.high, self.hint = n, bits, low, high, hint

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        """values: ascending uint64."""
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        values = values.astype(np.uint64)
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        keep = values & np.uint64((1 << bits) - 1)
        low = np.packbits((keep[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") if bits else np.zeros(0, np.uint8)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(place[-1]) + 1, np.uint8)
        unary[place] = 1
        return cls(n, bits, low.tobytes(), np.packbits(unary, bitorder="little").tobytes(), place[::STEP].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Number i, from a bounded part of the code."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.hint, "<u4")[i // STEP])
        left, byte = i % STEP, at // 8
        word = self.high[byte] >> at % 8 << at % 8
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.bits
        part = int.from_bytes(self.low[first // 8 : (first + self.bits + 7) // 8], "little") >> first % 8 & (1 << self.bits) - 1
        return place - i << self.bits | part

    def all(self) -> np.ndarray:
        """Every number, as uint64."""
        place = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            bit = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits)
            out |= (bit.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


def shard(part: int, seq: int, docs: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> tuple:
    """One row of SCHEMA."""
    n_null = sum(d is None for d in docs)
    real = [d for d in docs if d is not None]
    base = real[0] if real else 0
    ends = EliasFano.encode(np.cumsum(np.array(lengths, np.int64)))
    known = EliasFano.encode(np.array([d - base for d in real], np.uint64))
    return (part, seq, len(docs), n_null, len(ids), width, ids.astype(f"<u{width}").tobytes(), ends.bits, ends.low, ends.high, ends.hint, base, known.bits, known.low, known.high, known.hint)


def unshard(row: dict) -> tuple[list[int | None], list[int], np.ndarray]:
    """Document ids, end offsets within the shard (each selected from the code, which is never laid out as a table), and the ids."""
    ends = EliasFano(row["n_docs"], row["ends_bits"], row["ends_low"], row["ends_high"], row["ends_hint"])
    known = EliasFano(row["n_docs"] - row["n_null"], row["docs_bits"], row["docs_low"], row["docs_high"], row["docs_hint"])
    docs = [None] * row["n_null"] + [row["docs_base"] + known.select(i) for i in range(known.n)]
    return docs, [ends.select(i) for i in range(ends.n)], np.frombuffer(row["ids"], f"<u{row['width']}")


def _write(path: str, end_id: int, shard_tokens: int):
    def f(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        own = WordIds.of(path, KEPT_WORDS)
        width = 2 if len(own.strings) <= 1 << 16 else 4
        docs, lengths, ids, n = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def out():
            row = shard(part, seq, docs, lengths, np.concatenate(ids), width)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
        for batch in batches:
            _, offs = byte_column(batch.column(1))
            own_ids = batch.column(0).to_pylist()
            for i, j in pieces(offs, 1 << 24):
                flat, ends = own.encode_column(batch.column(1).slice(i, j - i))
                for d, got in zip(own_ids[i:j], (flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), strict=True):
                    if docs and n + len(got) + 1 > shard_tokens:
                        yield out()
                        docs, lengths, ids, n, seq = [], [], [], 0, seq + 1
                    docs.append(d)
                    lengths.append(len(got) + 1)
                    ids += [got, end]
                    n += len(got) + 1
        if docs:
            yield out()

    return f


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write shards in ascending ``doc_id`` order.

    Null ids come first, equal ids in the order of their texts; null and empty
    texts hold the end id only; an empty table gives a folder without shards.
    A document longer than ``shard_tokens`` is a shard of its own.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = own.repartitionByRange(2 * parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer or tokenizer_path(), end_id, shard_tokens), SCHEMA).write.parquet(path)


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            docs, ends, ids = unshard(row)
            begin = [0, *ends[:-1]]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begin, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(crc), pa.int32()), pa.array([row["seq"]] * len(crc), pa.int32()), pa.array(docs, pa.int64()), pa.array(begin, pa.int64()), pa.array([b - a for a, b in zip(begin, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "__in", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    # one row for each write task: small by construction
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    parts = parts.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    begin = sizes.withColumn("__within", within).join(parts, "part").select("part", "seq", (F.col("__within") + F.col("__before")).alias("__from"))
    # the shards' bytes are read where they lie; only the documents' few numbers are joined
    each = shards.mapInArrow(_read, "part int, seq int, doc_id long, __in long, n_tokens long, ids_crc32 long")
    return each.join(begin, ["part", "seq"]).select("doc_id", (F.col("__in") + F.col("__from")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
