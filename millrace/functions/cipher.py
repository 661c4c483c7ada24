"""Keyed functions: SipHash-2-4 as an Arrow-batched function, and encryption by the built-in authenticated cipher."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Any 16 bytes do: values only need to agree with each other.
SIP_KEY = bytes(range(16))
_MASK = (1 << 64) - 1


def _rotl(x: int, b: int) -> int:
    return (x << b | x >> (64 - b)) & _MASK


def _rounds(v: list[int], n: int) -> None:
    for _ in range(n):
        v[0] = (v[0] + v[1]) & _MASK
        v[2] = (v[2] + v[3]) & _MASK
        v[1] = _rotl(v[1], 13) ^ v[0]
        v[3] = _rotl(v[3], 16) ^ v[2]
        v[0] = (_rotl(v[0], 32) + v[3]) & _MASK
        v[2] = (v[2] + v[1]) & _MASK
        v[3] = _rotl(v[3], 21) ^ v[0]
        v[1] = _rotl(v[1], 17) ^ v[2]
        v[2] = _rotl(v[2], 32)


def siphash(data: bytes, key: bytes = SIP_KEY) -> int:
    """SipHash-2-4 (Aumasson and Bernstein, 2012) as a signed number."""
    k0, k1 = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    end = len(data) // 8 * 8
    tail = data[end:] + bytes(7 - len(data) % 8) + bytes([len(data) & 0xFF])
    for at in range(0, end + 8, 8):
        m = int.from_bytes(data[at : at + 8] if at < end else tail, "little")
        v[3] ^= m
        _rounds(v, 2)
        v[0] ^= m
    v[2] ^= 0xFF
    _rounds(v, 4)
    out = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out - (1 << 64) if out >> 63 else out


@F.pandas_udf(LongType())
def sip(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else siphash(t.encode()) for t in texts], dtype="Int64")


def _key(password: str) -> Column:
    return F.unhex(F.sha2(F.lit(password).cast("binary"), 256))


def encrypt(text: Column, password: str) -> Column:
    """Base64 of a random nonce, the encrypted text and its tag."""
    return F.base64(F.aes_encrypt(text.cast("binary"), _key(password), F.lit("GCM")))


def decrypt(text: Column, password: str) -> Column:
    """Null for what was not encrypted under the password, or was changed since."""
    raw = F.when(text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(text))
    return F.when(F.octet_length(raw) >= 28, F.try_aes_decrypt(raw, _key(password), F.lit("GCM"))).cast("string")
