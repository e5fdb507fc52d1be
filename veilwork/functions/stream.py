"""Deterministic byte streams: SHA-256 in counter mode, seeded by what a value and its policy are.

The seed is SHA-256 of tag, salt, strategy, domain, value and a collision number (little-endian, 8 bytes); block ``i`` is
SHA-256 of seed and ``i``. In the hardened profile both are HMAC-SHA-256, keyed by the salt and by the seed. Draw ``j`` is
the j-th little-endian 64-bit number of the blocks. The same stream exists as Python code (for values inside JSON and for
tests) and as columns (built-in functions only, but for hardened blocks, whose HMAC key differs from row to row and is
padded by arithmetic on its bytes). Columns without a domain need no stream that can be had again; outside of the hardened
profile they draw from ``rand`` alone (``RandomStream``).
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Goes before everything that is hashed for a domain. Another engine's values come out alike if its tag is set here.
TAG = b"veilwork-domain-map-v1"


@dataclass(frozen=True)
class Profile:
    """What masking depends on besides the policy: the profile, the global salt, a seed for values without a domain."""

    hardened: bool = False
    salt: str | None = None
    seed: int | None = None
    tag: bytes = TAG

    def __post_init__(self):
        if self.hardened and not (self.salt or "").strip():
            raise ValueError("the hardened profile needs a global salt, which must not be empty")


def le64(n: int) -> bytes:
    return n.to_bytes(8, "little")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha(message: Column) -> Column:
    return F.unhex(F.sha2(message, 256))


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_constant(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 under a key known on the driver, as binary."""
    inner, outer = _pads(key)
    return sha(F.concat(F.lit(outer), sha(F.concat(F.lit(inner), message))))


def hmac_of(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 under a 32-byte key of each row."""

    def pad(k: Column, value: int) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lpad(F.hex(F.conv(F.substring(k, i * 2 + 1, 2), 16, 10).cast("long").bitwiseXOR(F.lit(value))), 2, "0"))
        return F.concat(F.unhex(F.array_join(pairs, "")), F.lit(bytes([value]) * 32))

    return let(F.hex(key), lambda k: sha(F.concat(pad(k, 0x5C), sha(F.concat(pad(k, 0x36), message)))))


class ByteStream:
    """The stream in Python."""

    def __init__(self, seed: bytes, hardened: bool = False):
        self.seed, self.hardened, self.blocks = seed, hardened, []

    def block(self, i: int) -> bytes:
        while len(self.blocks) <= i:
            n = le64(len(self.blocks))
            self.blocks.append(hmac.digest(self.seed, n, "sha256") if self.hardened else hashlib.sha256(self.seed + n).digest())
        return self.blocks[i]

    def draw(self, j: int, span: int) -> int:
        return int.from_bytes(self.block(j // 4)[8 * (j % 4) : 8 * (j % 4) + 8], "little") % span

    def hex16(self) -> str:
        return self.block(0)[:16].hex()


class ColumnStream:
    """The stream as columns: ``blocks`` is an array of hex texts, one a block."""

    def __init__(self, blocks: Column):
        self.blocks = blocks

    def draw(self, j: int, span: int) -> Column:
        """The j-th number modulo ``span``, as a long."""
        raw = F.substring(F.element_at(self.blocks, j // 4 + 1), 16 * (j % 4) + 1, 16)
        return let(raw, lambda h: _modulo(h, span))

    def hex16(self) -> Column:
        return F.lower(F.substring(F.element_at(self.blocks, 1), 1, 32))


class RandomStream:
    """Draws at random, for values without a domain: each from a generator of its own, so nothing is hashed. What is drawn
    must stand in one place of an expression, or be bound by ``let``, since every place draws anew."""

    def __init__(self, seed: int | None, ordinal: int):
        self.seed, self.ordinal = seed, ordinal

    def _below(self, span: int, *place: int | str) -> Column:
        """A number below ``span``, which is 2^32 at most."""
        if self.seed is None:
            drawn = F.rand()
        else:
            drawn = F.rand(int.from_bytes(hashlib.sha256(repr((self.seed, self.ordinal, *place)).encode()).digest()[:8], "big", signed=True))
        return F.floor(drawn * F.lit(float(span)))

    def _hex(self, words: int, *place: int | str) -> Column:
        return F.concat(*(F.lpad(F.hex(self._below(1 << 32, *place, i)), 8, "0") for i in range(words)))

    def draw(self, j: int, span: int) -> Column:
        return self._below(span, j) if span <= 1 << 32 else let(self._hex(2, j), lambda h: _modulo(h, span))

    def hex16(self) -> Column:
        return F.lower(self._hex(4, "hex"))


def _modulo(h: Column, span: int) -> Column:
    turned = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)))
    if span < 1 << 30:  # halves of 32 bits keep the sum within a long
        high, low = (F.conv(F.substring(turned, s, 8), 16, 10).cast("long") for s in (1, 9))
        return ((high % span) * ((1 << 32) % span) + low) % span
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % F.lit(span).cast("decimal(20,0)")).cast("long")


def message_parts(tag: bytes, salt: str | None, *texts: str) -> bytes:
    return tag + (salt or "").encode() + "".join(texts).encode()


def domain_seed(profile: Profile, salt: str | None, strategy: str, domain: str, value: str | None, k: int = 0) -> bytes:
    salt = profile.salt if salt is None else salt
    head = message_parts(profile.tag, None if profile.hardened else salt, strategy, domain)
    message = head + (value or "").encode("utf-8", "surrogatepass") + le64(k)
    return hmac.digest(salt.encode(), message, "sha256") if profile.hardened else hashlib.sha256(message).digest()


def domain_seed_column(profile: Profile, salt: str | None, strategy: str, domain: str, value: Column, k: Column | int = 0) -> Column:
    salt = profile.salt if salt is None else salt
    head = message_parts(profile.tag, None if profile.hardened else salt, strategy, domain)
    number = F.lit(le64(k)) if isinstance(k, int) else F.unhex(_reversed_hex(k))
    message = F.concat(F.lit(head), value.cast("binary"), number)
    return hmac_constant(salt.encode(), message) if profile.hardened else sha(message)


def _reversed_hex(k: Column) -> Column:
    """A long as the hex text of its little-endian bytes."""
    return let(F.lpad(F.hex(k.cast("long")), 16, "0"), lambda h: F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1))))


def blocks_of(seed: Column, draws: int, hardened: bool) -> Column:
    """As many blocks as ``draws`` need."""
    one = (lambda s, i: F.hex(hmac_of(s, F.lit(le64(i))))) if hardened else (lambda s, i: F.hex(sha(F.concat(s, F.lit(le64(i))))))
    return let(seed, lambda s: F.array(*(one(s, i) for i in range(max(1, -(-draws // 4))))))
