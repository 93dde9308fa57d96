"""HMAC-SHA256 and AES-256-GCM as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 64
IV_BYTES, TAG_BYTES = 12, 16


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer padding block of a key; computed once per job."""
    if not key:
        raise ValueError("the signing key must not be empty")
    block = key.encode()
    if len(block) > BLOCK_BYTES:
        block = hashlib.sha256(block).digest()
    block = block.ljust(BLOCK_BYTES, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(text: Column, key: str) -> Column:
    """Lower-case hex signature of UTF-8 text."""
    inner, outer = (F.lit(bytearray(pad)) for pad in hmac_pads(key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def hmac_matches(text: Column, signature: Column, key: str) -> Column:
    """False, never null or an error, for wrong, malformed or missing signatures."""
    return F.coalesce(F.lower(signature) == hmac_sha256(text, key), F.lit(False))


def derive_key(secret: str, salt: str) -> bytes:
    """32-byte key from a secret; one call per job, on the driver."""
    if len(salt) < 8:
        raise ValueError("the salt must have at least 8 characters")
    if not secret:
        raise ValueError("the encryption key must not be empty")
    return hashlib.scrypt(secret.encode(), salt=salt.encode(), n=16384, r=8, p=1, dklen=32)


def encrypt(text: Column, key: bytes) -> Column:
    """Struct of hex ``ciphertext``, ``iv`` and ``authTag``; a fresh random IV per row."""
    sealed = F.aes_encrypt(text, F.lit(bytearray(key)), F.lit("GCM"))
    return split_sealed(F.hex(sealed))


def split_sealed(sealed_hex: Column) -> Column:
    """Hex of IV, ciphertext and tag -> the three parts."""
    text = F.lower(sealed_hex)
    iv, tag = 2 * IV_BYTES, 2 * TAG_BYTES
    return F.struct(
        text.substr(F.lit(iv + 1), F.length(text) - iv - tag).alias("ciphertext"),
        text.substr(F.lit(1), F.lit(iv)).alias("iv"),
        text.substr(F.length(text) - tag + 1, F.lit(tag)).alias("authTag"),
    )


def decrypt(sealed: Column, key: bytes) -> Column:
    """Plain text, or null if any part was changed or is not hex."""
    joined = F.concat(F.unhex(sealed["iv"]), F.unhex(sealed["ciphertext"]), F.unhex(sealed["authTag"]))
    return F.try_aes_decrypt(joined, F.lit(bytearray(key)), F.lit("GCM")).cast("string")
