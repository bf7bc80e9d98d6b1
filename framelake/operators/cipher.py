"""Counter-mode encryption of payload columns.

A payload is cut into 16-byte blocks; block b's keystream is the AES of iv + b. Spark's aes_encrypt gives the block cipher in
its ECB mode: one call for all counters of a row. Counters are made, and keystream and payload xored, in Arrow batches. Blocks don't depend on
each other, so nothing is shuffled, and a large payload may come in chunks, a row each, that know their first block (chunk_payloads, or the chunks of
a file). Encryption and decryption are the same function. Keys are given as hex strings of 16, 24 or 32 bytes by the caller, never from a data column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from framelake.functions.shipping import ship
from framelake.sources.raw import read_raw_bytes, write_raw_bytes


def split_blocks(payload: Column) -> Column:
    """Array of 16-byte blocks in order, the last one perhaps shorter."""
    n = F.ceil(F.octet_length(payload) / 16).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.substring(payload, b * 16 + 1, F.lit(16)))).otherwise(F.array().cast("array<binary>"))


def _counter_hex(iv_hex: str, b: Column) -> Column:
    """iv + b modulo 2^128 in hex: four 32-bit limbs with carry, b below 2^62."""
    limbs = [int(iv_hex[8 * k : 8 * k + 8], 16) for k in range(4)]
    b = b.cast("long")
    low = F.lit(limbs[3]).cast("long") + b.bitwiseAND(0xFFFFFFFF)
    third = F.lit(limbs[2]).cast("long") + F.shiftright(b, 32) + F.shiftright(low, 32)
    second = F.lit(limbs[1]).cast("long") + F.shiftright(third, 32)
    first = F.lit(limbs[0]).cast("long") + F.shiftright(second, 32)
    word = lambda x: F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0")
    return F.concat(*map(word, (first, second, third, low)))


def ctr_counter(iv_hex: str, b: Column) -> Column:
    """iv + b modulo 2^128 as binary."""
    return F.unhex(_counter_hex(iv_hex, b))


def ctr_keystream(counter: Column, key_hex: str) -> Column:
    """AES of one 16-byte block."""
    return F.substring(F.aes_encrypt(counter, F.unhex(F.lit(key_hex)), F.lit("ECB"), F.lit("PKCS")), 1, 16)


def _half(block: Column, at: int) -> Column:
    """8 bytes as a signed number."""
    return F.conv(F.substring(F.rpad(F.hex(block), 32, "0"), 16 * at + 1, 16), 16, -10).cast("long")


def xor_bytes(a: Column, b: Column) -> Column:
    """a ^ b for blocks of at most 16 bytes, as long as a."""
    both = F.concat(*(F.lpad(F.hex(_half(a, k).bitwiseXOR(_half(b, k))), 16, "0") for k in (0, 1)))
    return F.unhex(F.substring(both, F.lit(1), (F.octet_length(a) * 2).cast("int")))


def counters(iv: int, first: int, n: int) -> bytes:
    """iv + first and the n - 1 numbers after it, modulo 2^128, 16 bytes each."""
    start = (iv + first) % (1 << 128)
    low = np.uint64(start & (1 << 64) - 1) + np.arange(n, dtype=np.uint64)
    high = np.uint64(start >> 64) + (low < low[:1])
    return np.column_stack([high, low]).astype(">u8").tobytes()


def _rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into rows of these sizes."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each begins and the last one ends; null is empty."""
    rows = rows.fill_null(b"")
    _, offsets, data = rows.buffers()
    ends = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), ends


def _counters_of(iv_hex: str):
    iv = int(iv_hex, 16)

    def make(first: pa.Array, size: pa.Array) -> pa.Array:
        n = np.maximum(1, -(-size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 16))
        begin = np.cumsum(n) - n
        block = (np.repeat(first.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) - begin, n) + np.arange(n.sum())).astype(np.uint64)
        low = np.uint64(iv & (1 << 64) - 1) + block
        high = np.uint64(iv >> 64) + (low < block)
        made = _rows(np.column_stack([high, low]).astype(">u8").view(np.uint8).ravel(), 16 * n)
        return pc.if_else(size.is_valid(), made, pa.scalar(None, pa.binary()))

    return F.arrow_udf(make, BinaryType())


def _xor(payload: pa.Array, stream: pa.Array) -> pa.Array:
    """Rows together, a megabyte at a time, or by themselves where they are large."""
    (data, at), (key, key_at) = _bytes(payload), _bytes(stream)
    sizes, out = np.diff(at), np.empty(at[-1] - at[0], np.uint8)
    base, row = at[0], 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(at, at[row] + (1 << 20), "right")) - 1)
        here = data[at[row] : at[end]]
        if end == row + 1:
            own = key[key_at[row] : key_at[row] + sizes[row]]
        else:
            own = key[np.repeat(key_at[row:end] - at[row:end], sizes[row:end]) + np.arange(at[row], at[end])]
        np.bitwise_xor(here, own, out=out[at[row] - base : at[end] - base])
        row = end
    return pc.if_else(payload.is_valid(), _rows(out, sizes), pa.scalar(None, pa.binary()))


def encrypt_ctr(df: DataFrame, payload: str, key_hex: str, iv_hex: str, out: str = "ciphertext", *, first_block: Column | int = 0) -> DataFrame:
    """df with the payload in counter mode as a further column, or in its place if `out` is its name; null stays null.

    first_block: of a chunk, the number of 16-byte blocks of its payload before it. A row takes some five times its payload in memory.
    """
    ship(df.sparkSession)
    data, first = F.col(f"`{payload}`"), first_block if isinstance(first_block, Column) else F.lit(first_block)
    made = _counters_of(iv_hex)(first.cast("long"), F.octet_length(data))
    return df.withColumn(out, F.arrow_udf(_xor, BinaryType())(data, F.aes_encrypt(made, F.unhex(F.lit(key_hex)), F.lit("ECB"), F.lit("PKCS"))))


def chunk_payloads(df: DataFrame, payload: str, *, chunk_bytes: int = 1 << 20) -> DataFrame:
    """A row for each chunk: all other columns, chunk (0, 1 ...), first_block, and its part of the payload. An empty or null payload is one chunk."""
    if chunk_bytes % 16:
        raise ValueError(f"chunks of {chunk_bytes} bytes don't end at a block's end")
    others = [F.col(f"`{c}`") for c in df.columns if c != payload]
    data = F.col(f"`{payload}`")
    last = F.greatest(F.lit(0), F.coalesce(F.floor((F.octet_length(data) - 1) / chunk_bytes), F.lit(0))).cast("int")
    rows = df.select(*others, data, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    piece = F.substring(data, F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.select(*others, "chunk", (F.col("chunk").cast("long") * (chunk_bytes // 16)).alias("first_block"), piece.alias(payload))


def join_chunks(chunks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the chunks of each in their order as one value, for payloads that a cell can hold."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", value)))
    return chunks.groupBy(*keys).agg(ordered.alias("_c")).select(*keys, F.aggregate(F.transform("_c", lambda c: c[value]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias(value))


def encrypt_files(spark: SparkSession, source: str, target: str, key_hex: str, iv_hex: str, *, chunk_bytes: int = 1 << 20, pattern: str = "*") -> None:
    """The files of a folder in counter mode under the same names in another; files of any size, in chunks of bounded memory. Twice gives the files again."""
    chunks = read_raw_bytes(spark, source, chunk_bytes=chunk_bytes, pattern=pattern)
    write_raw_bytes(encrypt_ctr(chunks, "data", key_hex, iv_hex, "data", first_block=F.expr("at div 16")), target)


decrypt_ctr = encrypt_ctr


def encrypt_blocks(df: DataFrame, payload: str, key_hex: str, iv_hex: str) -> DataFrame:
    """For large payloads: a row for each block (all other columns, b, ciphertext); regroup by id and b where needed."""
    rows = df.select(*(c for c in df.columns if c != payload), F.posexplode(split_blocks(F.col(payload))).alias("b", "plain"))
    return rows.withColumn("ciphertext", xor_bytes(F.col("plain"), ctr_keystream(ctr_counter(iv_hex, F.col("b")), key_hex))).drop("plain")
