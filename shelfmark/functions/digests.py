"""Content digests: MD5, SHA-1, SHA-256 and CRC-32 as built-in expressions, CRC-32C as an Arrow UDF.

Forms are those of object stores: an ETag is the hex MD5 in double quotes, the others are base64.
"""

import zlib
from functools import lru_cache
from hashlib import md5, sha1, sha256
from base64 import b64encode
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The Castagnoli polynomial, bits reversed.
CASTAGNOLI = 0x82F63B78


def etag(content: Column) -> Column:
    """The quoted MD5 of binary content."""
    return F.concat(F.lit('"'), F.md5(content), F.lit('"'))


def sha256_base64(content: Column) -> Column:
    """The SHA-256 of binary content as base64."""
    return F.base64(F.unhex(F.sha2(content, 256)))


def sha1_base64(content: Column) -> Column:
    """The SHA-1 of binary content as base64."""
    return F.base64(F.unhex(F.sha1(content)))


def crc32_base64(content: Column) -> Column:
    """The CRC-32 of binary content, high byte first, as base64."""
    return F.base64(F.unhex(F.lpad(F.hex(F.crc32(content)), 8, "0")))


def hex_to_base64(text: Column) -> Column:
    """Base64 of the bytes a hex text denotes."""
    return F.base64(F.unhex(text))


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """What each byte value does to the register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


@lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    """What each value of two bytes does to the register."""
    one = _steps()
    low, high = np.arange(1 << 16, dtype=np.uint32) & 0xFF, np.arange(1 << 16, dtype=np.uint32) >> 8
    after = one[low] ^ high
    return (after >> 8) ^ one[after & 0xFF]


def _ahead(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers advanced by tables, one for each byte of the register."""
    return tables[0][register & 255] ^ tables[1][register >> 8 & 255] ^ tables[2][register >> 16 & 255] ^ tables[3][register >> 24]


@lru_cache(maxsize=64)
def _zeros(length: int) -> np.ndarray:
    """Four tables that advance a register over that many zero bytes, one per byte of the register; made by halving."""
    if length == 1:
        register = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        return (register >> 8) ^ _steps()[register & 0xFF]
    half = _zeros(length // 2)
    twice = _ahead(half, half)
    return _ahead(_zeros(1), twice) if length % 2 else twice


#: Bytes of a lane, and lanes that are worked on at once: a piece of two megabytes.
LANE, LANES = 256, 8192


def crc32c(content: bytes, register: int = 0) -> int:
    """The CRC-32C of content, carried on from that of what came before it.

    Long content is cut into lanes side by side, which numpy takes two bytes further at a time; then
    neighbours are joined, halving their number each time.
    """
    state, data = (register ^ 0xFFFFFFFF) & 0xFFFFFFFF, np.frombuffer(content, np.uint8)
    while len(data) >= 16 * LANE:
        lanes = min(LANES, 1 << (len(data) // LANE).bit_length() - 1)
        state = _lanes(data[: lanes * LANE], lanes, state)
        data = data[lanes * LANE :]
    plain = _steps().tolist()
    for byte in data.tolist():
        state = (state >> 8) ^ plain[(state ^ byte) & 0xFF]
    return state ^ 0xFFFFFFFF


def _lanes(data: np.ndarray, lanes: int, state: int) -> int:
    """The register after data that is cut into a power of two of lanes."""
    words = np.ascontiguousarray(data.view("<u2").reshape(lanes, LANE // 2).T)
    table, each, at = _pairs(), np.zeros(lanes, np.uint32), np.empty(lanes, np.uint32)
    each[0] = state
    for word in words:
        np.bitwise_xor(each, word, out=at)
        at &= 0xFFFF
        each >>= 16
        each ^= table[at]
    width = LANE
    while len(each) > 1:
        each = _ahead(_zeros(width), each[0::2]) ^ each[1::2]
        width *= 2
    return int(each[0])


def _crc32c_of(values: list) -> list:
    """CRC-32C of many short contents at once, a byte of each at a time; long ones on their own."""
    out = [None if v is None else crc32c(v) if len(v) > 4096 else 0 for v in values]
    short = sorted((n for n, v in enumerate(values) if v and len(v) <= 4096), key=lambda n: -len(values[n]))
    if not short:
        return out
    lengths = np.array([len(values[n]) for n in short])
    grid = np.zeros((len(short), lengths[0]), np.uint8)
    for row, n in enumerate(short):
        grid[row, : lengths[row]] = np.frombuffer(values[n], np.uint8)
    state, steps = np.full(len(short), 0xFFFFFFFF, np.uint32), _steps()
    ends = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for column, active in enumerate(ends):
        part = state[:active]
        state[:active] = (part >> 8) ^ steps[(part ^ grid[:active, column]) & 0xFF]
    for row, n in enumerate(short):
        out[n] = int(state[row] ^ np.uint32(0xFFFFFFFF))
    return out


@pandas_udf(StringType())
def crc32c_base64(content: pd.Series) -> pd.Series:
    """The CRC-32C of binary content, high byte first, as base64; null for null."""
    out: list = []
    values = content.tolist()
    for at in range(0, len(values), 1024):
        out += [None if v is None else b64encode(v.to_bytes(4, "big")).decode() for v in _crc32c_of(values[at : at + 1024])]
    return pd.Series(out, dtype="object")


def stream_digests(source: BinaryIO, chunk: int = 1 << 21) -> dict:
    """All five digests and the size of a file of any length, read once in chunks."""
    hashes, crc, castagnoli, size = (md5(), sha1(), sha256()), 0, 0, 0
    while block := source.read(chunk):
        for h in hashes:
            h.update(block)
        crc, castagnoli, size = zlib.crc32(block, crc), crc32c(block, castagnoli), size + len(block)
    text = lambda b: b64encode(b).decode()
    return {
        "size": size, "etag": f'"{hashes[0].hexdigest()}"', "checksum_sha256": text(hashes[2].digest()), "checksum_sha1": text(hashes[1].digest()),
        "checksum_crc32": text(crc.to_bytes(4, "big")), "checksum_crc32c": text(castagnoli.to_bytes(4, "big")),
    }


def with_digests(df, content: str):
    """df with the five digests of its binary column."""
    c = F.col(content)
    return df.withColumns({"etag": etag(c), "checksum_sha256": sha256_base64(c), "checksum_sha1": sha1_base64(c), "checksum_crc32": crc32_base64(c), "checksum_crc32c": crc32c_base64(c)})
