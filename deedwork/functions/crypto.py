"""Keyed and salted hashes and masks in built-in functions, so they stay inside the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_DIGITS = 32
ENCRYPTED_PREFIX = "enc:v1:"


def hmac_pads(key: bytes) -> tuple[str, str]:
    """The key's inner and outer pad as hex (RFC 2104, SHA-256, 64-byte blocks)."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary column, as lower-case hex."""
    inner, outer = hmac_pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def text_bytes(value: Column) -> Column:
    return F.encode(value.cast("string"), "UTF-8")


def tokenize(value: Column, key: bytes) -> Column:
    """The first 128 bits of the value's HMAC; NULL stays NULL."""
    return F.left(hmac_sha256(text_bytes(value), key), F.lit(TOKEN_DIGITS))


def salted_hash(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def partial_mask(value: Column, keep_first: int = 0, keep_last: int = 4) -> Column:
    """Length kept, the ends asked for kept; a value no longer than the kept ends is masked whole."""
    text = value.cast("string")
    size = F.length(text)
    stars = F.repeat(F.lit("*"), size - (keep_first + keep_last))
    kept = F.concat(F.left(text, F.lit(keep_first)), stars, F.right(text, F.lit(keep_last)))
    return F.when(size > keep_first + keep_last, kept).otherwise(F.repeat(F.lit("*"), size))


def encrypt(value: Column, key: bytes, column: str) -> Column:
    """AES-GCM under a fresh nonce, bound to the column's name."""
    sealed = F.aes_encrypt(
        text_bytes(value), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(column).cast("binary")
    )
    return F.concat(F.lit(ENCRYPTED_PREFIX), F.translate(F.base64(sealed), "\r\n", ""))


def decrypt(value: Column, key: bytes, column: str) -> Column:
    sealed = F.unbase64(F.substring(value, len(ENCRYPTED_PREFIX) + 1, 2**31 - 1))
    opened = F.aes_decrypt(sealed, F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.lit(column).cast("binary"))
    return F.decode(opened, "UTF-8")


# The whole-value shape each strategy leaves.
SHAPES = {
    "hash": "[0-9a-f]{64}",
    "tokenize": "[0-9a-f]{32}",
    "encrypt": "enc:v1:[A-Za-z0-9+/=]+",
}


def shape_of(strategy: str, keep_first: int = 0, keep_last: int = 4) -> str:
    if strategy == "mask":
        return rf"(?s)\**|.{{{keep_first}}}\*+.{{{keep_last}}}"
    return SHAPES[strategy]


def has_shape(value: Column, shape: str) -> Column:
    """The whole value has the shape: a treated value inside a longer one does not count."""
    flags, body = (shape[:4], shape[4:]) if shape.startswith("(?s)") else ("", shape)
    return value.cast("string").rlike(rf"{flags}\A(?:{body})\z")


def masked_for_reader(value: Column, rule: str) -> Column:
    """A reader's masking rule: ``last_four``, ``first_four`` or ``nullify``.

    Four characters or fewer would be shown whole, so they are hashed instead.
    """
    text = value.cast("string")
    if rule == "nullify":
        return F.lit(None).cast("string")
    cut = {
        "last_four": F.concat(F.lit("XXXXX"), F.right(text, F.lit(4))),
        "first_four": F.concat(F.left(text, F.lit(4)), F.lit("XXXXX")),
    }[rule]
    return F.when(F.length(text) <= 4, F.sha2(text, 256)).otherwise(cut)
