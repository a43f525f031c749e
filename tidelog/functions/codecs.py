"""Byte codecs, checksums and hashes, for batches of keys.

Where Spark has no exact equivalent these are pandas UDFs over numpy; the rest
are column expressions. Constants that results depend on are fixed values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The Castagnoli polynomial (reflected), the mask of stored checksums, and constants of the public hash functions.
CRC32C_POLYNOMIAL = 0x82F63B78
CRC_MASK_DELTA = 0xA282EAD8
MURMUR_MULTIPLIER = 0xC6A4A7935BD1E995
HASH_SEED = 0x9AE16A3B2F90404F
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 1099511628211
_M64 = (1 << 64) - 1


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32c(data: bytes, start: int = 0) -> int:
    """Castagnoli CRC; ``start`` is the value of what came before."""
    return int(crc32c_many([data], start)[0])


def crc32c_many(data: list[bytes], start: int = 0) -> np.ndarray:
    """Of all strings at once, a byte column at a time."""
    size = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size
    crc = np.full(len(data), start ^ 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max(initial=0))):
        on = order[: int(np.searchsorted(-size[order], -k, "left"))]
        crc[on] = _CRC[(crc[on] ^ flat[at[on] + k]) & 0xFF] ^ (crc[on] >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def murmur64(data: bytes, seed: int = HASH_SEED) -> int:
    return int(murmur64_many([data], seed)[0])


def murmur64_many(data: list[bytes], seed: int = HASH_SEED) -> np.ndarray:
    """The 64-bit Murmur2 hash (variant A) of all strings at once, eight bytes at a time."""
    m, r = np.uint64(MURMUR_MULTIPLIER), np.uint64(47)
    size = np.array([len(d) for d in data], np.int64)
    whole = size // 8
    padded = -(-size // 8) * 8
    flat = np.frombuffer(b"".join(d.ljust(int(p), b"\0") for d, p in zip(data, padded, strict=True)), "<u8")
    at = (np.cumsum(padded) - padded) // 8
    h = np.uint64(seed) ^ (size.astype(np.uint64) * m)
    order = np.argsort(-whole, kind="stable")
    for k in range(int(whole.max(initial=0))):
        on = order[: int(np.searchsorted(-whole[order], -k, "left"))]
        x = flat[at[on] + k] * m
        x = (x ^ (x >> r)) * m
        h[on] = (h[on] ^ x) * m
    tail = np.flatnonzero(size % 8)
    h[tail] = (h[tail] ^ flat[at[tail] + whole[tail]]) * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def splitmix(seed: int, n: np.ndarray) -> np.ndarray:
    """Draw n (from 1) of the generator with this seed; any draw needs only its number."""
    golden, a, b = map(np.uint64, SPLITMIX)
    z = np.uint64(seed & _M64) + n.astype(np.uint64) * golden
    z = (z ^ (z >> np.uint64(30))) * a
    z = (z ^ (z >> np.uint64(27))) * b
    return z ^ (z >> np.uint64(31))


def unit(draws: np.ndarray) -> np.ndarray:
    """Draws as doubles in [0, 1)."""
    return (draws >> np.uint64(11)).astype(float) / float(1 << 53)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, next place); ValueError if truncated or too long."""
    value = 0
    for k in range(-(-bits // 7)):
        if at + k >= len(data):
            break
        value |= (data[at + k] & 0x7F) << (7 * k)
        if data[at + k] < 0x80:
            return value & ((1 << bits) - 1), at + k + 1
    raise ValueError("truncated or overlong varint")


def varint_length(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def length_prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


def read_length_prefixed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = read_varint(data, at, 32)
    if at + n > len(data):
        raise ValueError("truncated string")
    return data[at : at + n], at + n


def pack_internal_key(key: bytes, seq: int, op: int) -> bytes:
    return key + (seq << 8 | op).to_bytes(8, "little")


def parse_internal_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise ValueError("internal key too short")
    tag = int.from_bytes(data[-8:], "little")
    if tag & 0xFF > 1:
        raise ValueError("unknown record type")
    return data[:-8], tag >> 8, tag & 0xFF


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short string s with start <= s < limit; ``start`` itself where none is shorter."""
    same = next((k for k, (a, b) in enumerate(zip(start, limit, strict=False)) if a != b), None)
    if same is None or start[same] == 0xFF or start[same] + 1 >= limit[same]:
        return start
    return start[:same] + bytes([start[same] + 1])


def short_successor(key: bytes) -> bytes:
    """A short string at or above ``key``; runs of 0xff stay."""
    at = next((k for k, b in enumerate(key) if b != 0xFF), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


def escape(data: bytes, most: int | None = None, but: bytes = b"") -> str:
    r"""Printable bytes as they are, others and those of ``but`` as \xNN; cut after ``most`` bytes with an ellipsis."""
    out = "".join(chr(b) if 32 <= b < 127 and b not in but else f"\\x{b:02x}" for b in (data if most is None else data[:most]))
    return out + "..." if most is not None and len(data) > most else out


def json_escape(text: bytes) -> str:
    r"""As the event log writes strings: every byte below 0x20 or from 0x7f as \u00NN, but for the short escapes."""
    short = {0x22: '\\"', 0x5C: "\\\\", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}
    return "".join(short.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\u{b:04x}") for b in text)


def bloom_build(keys: list[bytes], bits_per_key: int = 10) -> bytes:
    """A filter over keys: at least 64 bits, k probes by double hashing with an odd step, and k as the last byte."""
    k = min(30, max(1, int(bits_per_key * 0.69)))
    size = (max(64, len(keys) * bits_per_key) + 7) // 8
    bits = np.zeros(size * 8, np.uint8)
    if keys:
        bits[_probes(murmur64_many(keys), k, size * 8).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([k])


def _probes(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    low, step = (h & np.uint64(0xFFFFFFFF)), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) & np.uint64(0xFFFFFFFF)) % np.uint64(bits)


def bloom_may_match(keys: list[bytes], bloom: bytes) -> np.ndarray:
    """False only for keys that are not in the filter; filters under two bytes hold nothing, those of a reserved k anything."""
    if len(bloom) < 2 or not keys:
        return np.zeros(len(keys), bool)
    if bloom[-1] > 30:
        return np.ones(len(keys), bool)
    bits = np.unpackbits(np.frombuffer(bloom[:-1], np.uint8), bitorder="little")
    return bits[_probes(murmur64_many(keys), bloom[-1], len(bits)).astype(np.int64)].all(axis=1)


def _each(f, kind):  # noqa: ANN001, ANN202
    def run(s: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int64)
        on = s.notna().to_numpy()
        got = f([bytes(x) for x in s[on]])
        out[on] = got.astype(np.uint64).view(np.int64) if kind == "u8" else got.astype(np.int64)
        return pd.Series(out).where(on).astype("Int64")

    return run


def crc32c_col(b: Column) -> Column:
    return pandas_udf(_each(crc32c_many, "u4"), "bigint")(b)


def murmur64_col(b: Column) -> Column:
    """As a signed number."""
    return pandas_udf(_each(murmur64_many, "u8"), "bigint")(b)


def mask_crc(crc: Column) -> Column:
    """Rotated right by 15 bits plus a constant, as checksums are stored."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc.bitwiseAND(F.lit(0x7FFF)), 17))
    return (turned + F.lit(CRC_MASK_DELTA).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def unmask_crc(masked: Column) -> Column:
    back = (masked - F.lit(CRC_MASK_DELTA).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.shiftright(back, 17).bitwiseOR(F.shiftleft(back, 15)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def fixed_decode(b: Column) -> Column:
    """Little-endian bytes as an unsigned number."""
    return F.conv(F.hex(F.reverse(b)), 16, 10).cast("decimal(20,0)")


def varint_length_col(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def fnv64_col(v: Column) -> Column:
    """FNV-1a over the eight little-endian bytes of a non-negative number, as an unsigned decimal.

    The hash is kept in two halves of 32 bits. The prime is 2^40 + 435, so products stay below 2^42.
    """
    number = lambda x: F.lit(x).cast("bigint")
    small, half = FNV_PRIME - (1 << 40), number((1 << 32) - 1)
    v = v.cast("bigint")
    hi, lo = number(FNV_BASIS >> 32), number(FNV_BASIS & 0xFFFFFFFF)
    for i in range(8):
        lo = lo.bitwiseXOR(F.shiftright(v, 8 * i).bitwiseAND(number(255)))
        part = lo * small
        hi, lo = (hi * small + F.shiftright(part, 32) + F.shiftleft(lo, 8)).bitwiseAND(half), part.bitwiseAND(half)
    return (hi.cast("decimal(10,0)") * F.lit(str(1 << 32)).cast("decimal(10,0)") + lo.cast("decimal(10,0)")).cast("decimal(20,0)")


def ycsb_key(i: Column) -> Column:
    return F.concat(F.lit("user"), fnv64_col(i).cast("string"))


def ordered_key(i: Column) -> Column:
    return F.format_string("key%010d", i.cast("bigint"))


def pack_tag(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))


def unpack_tag(tag: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(tag, 8), tag.bitwiseAND(F.lit(255)).cast("tinyint")
