"""Masking strategies: from a spec to a column, and the same for single values inside JSON documents.

Every strategy that draws takes its draws from a stream (see ``stream``). With a domain the stream is seeded by the value,
so equal values get equal pseudonyms in every table, without a shuffle and without state; NULL stays NULL. Without one it
draws at random: from ``rand`` with the run's seed, or from the operating system in the hardened profile.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import fakes, fuzz
from veilwork.functions.fakes import Checked, Mask
from veilwork.functions.stream import ByteStream, ColumnStream, Profile, RandomStream, blocks_of, domain_seed, domain_seed_column, hmac_constant, le64, let, message_parts
from veilwork.plans.policy import Spec

REDACTED = "REDACTED"
#: Strategies of which NULL stays NULL even without a domain.
KEEPS_NULL = ("null", "blank", "empty_array", "empty_object", "date_fuzz", "time_fuzz", "datetime_fuzz")
#: Strategies whose values a declared length doesn't cut.
UNCUT = ("null", "blank", "empty_array", "empty_object", "int_range")
QUOTED = ("blank", "email", "name", "first_name", "last_name", "phone", "payment_card", "string", "faker")
FAKES = ("faker", "email", "name", "first_name", "last_name", "phone")


def always_quoted(spec: Spec) -> bool:
    """Whether a dump writes the value as a quoted literal whatever stood there."""
    return spec.strategy in QUOTED or bool(spec.as_string) and spec.strategy not in ("null", "empty_array", "empty_object", "int_range")


@dataclass(frozen=True)
class _Range:
    low: int
    high: int
    draws = 1

    def run(self, s, j: int) -> int:
        return self.low + s.draw(j, self.high - self.low + 1)

    def column(self, s, j: int) -> Column:
        return s.draw(j, self.high - self.low + 1) + F.lit(self.low).cast("long")


@dataclass(frozen=True)
class _Uuid:
    draws = 2

    def run(self, s, j: int) -> str:
        h = s.hex16()
        return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:]}"

    def column(self, s, j: int) -> Column:
        def shown(h: Column) -> Column:
            part = lambda a, n: F.substring(h, a, n)
            variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, 1)
            return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

        return let(s.hex16(), shown)


@dataclass(frozen=True)
class _Decimal:
    low: int
    high: int
    scale: int

    @property
    def draws(self) -> int:
        return 1 + self.scale

    def _parts(self):
        return _Range(self.low, self.high), Mask("#" * self.scale, "#")

    def run(self, s, j: int) -> str:
        whole, rest = self._parts()
        return str(whole.run(s, j)) + ("." + rest.run(s, j + 1) if self.scale else "")

    def column(self, s, j: int) -> Column:
        whole, rest = self._parts()
        text = whole.column(s, j).cast("string")
        return F.concat(text, F.lit("."), rest.column(s, j + 1)) if self.scale else text


@dataclass(frozen=True)
class _Letters:
    n: int

    @property
    def draws(self) -> int:
        return self.n

    def run(self, s, j: int) -> str:
        return Mask("*" * self.n, "*").run(s, j).lower()

    def column(self, s, j: int) -> Column:
        return F.lower(Mask("*" * self.n, "*").column(s, j))


@dataclass(frozen=True)
class _Card:
    n: int

    @property
    def draws(self) -> int:
        return self.n - 1

    def _checked(self) -> Checked:
        return Checked(Mask("^" + "#" * (self.n - 2), "#^"), "luhn")

    def run(self, s, j: int) -> str:
        return self._checked().run(s, j)

    def column(self, s, j: int) -> Column:
        return self._checked().column(s, j)


def program(spec: Spec):
    """What a strategy draws."""
    s = spec.strategy
    if s in FAKES:
        return fakes.program(spec)
    if s == "uuid":
        return _Uuid()
    if s == "decimal":
        return _Decimal(*spec.bounds, 2 if spec.scale is None else spec.scale)
    if s == "payment_card":
        return _Card(spec.length or 16)
    if s == "string":
        return _Letters(spec.length or 12)
    return _Range(*spec.bounds)


class _Spans:
    """A stream that only notes how many draws there are to choose from."""

    def __init__(self):
        self.ways = 1

    def draw(self, j: int, span: int) -> int:
        self.ways *= span
        return span - 1

    def hex16(self) -> str:
        self.ways <<= 128
        return "f" * 32


def space(spec: Spec) -> int | None:
    """How many different values a strategy gives at most; None where that depends on what is masked."""
    if spec.strategy in ("redact", "blank", "empty_array", "empty_object"):
        return 1
    if spec.strategy in ("null", "hash", "date_fuzz", "time_fuzz", "datetime_fuzz"):
        return None
    spans = _Spans()
    program(spec).run(spans, 0)
    return spans.ways


# -- single values --------------------------------------------------------------------------------------------------------


def mask_value(spec: Spec, profile: Profile, value: str | None, *, k: int = 0, most: int | None = None) -> str | None:
    """The masked text of one value."""
    s = spec.strategy
    if s == "null" or value is None and (spec.domain or s in KEEPS_NULL):
        return None
    found = {"redact": REDACTED, "blank": "", "empty_array": "[]", "empty_object": "{}"}.get(s)
    if found is None and s == "hash":
        found = _hash_value(spec, profile, value, k)
    elif found is None:
        seed = domain_seed(profile, spec.salt, s, spec.domain_key, value, k) if spec.domain else secrets.token_bytes(32)
        drawn = program(spec).run(ByteStream(seed, profile.hardened), 0)
        shift = {"date_fuzz": fuzz.date_text, "time_fuzz": fuzz.time_text, "datetime_fuzz": fuzz.datetime_text}.get(s)
        found = shift(value, drawn) if shift else str(drawn)
    return found if most is None or s in UNCUT else found[:most]


def _hash_value(spec: Spec, profile: Profile, value: str | None, k: int) -> str:
    import hashlib
    import hmac

    salt = profile.salt if spec.salt is None else spec.salt
    raw = (value or "").encode("utf-8", "surrogatepass")
    own = b"" if profile.hardened else (salt or "").encode()
    message = profile.tag + own + spec.domain_key.encode() + raw + le64(k) if spec.domain else own + raw
    return hmac.digest(salt.encode(), message, "sha256").hex() if profile.hardened else hashlib.sha256(message).hexdigest()


# -- columns --------------------------------------------------------------------------------------------------------------


def draws_fresh(spec: Spec, profile: Profile) -> bool:
    """Whether the strategy takes its seed from the operating system, as a column of its own (see ``fresh``)."""
    return profile.hardened and not spec.domain and spec.strategy != "hash" and spec.strategy not in ("null", "redact", "blank", "empty_array", "empty_object")


def fresh_name(ordinal: int) -> str:
    return f"__fresh_{ordinal}"


def fresh() -> Column:
    """32 bytes a row from the operating system. Python functions can't stand inside higher-order ones, so a table gets
    them as columns named ``fresh_name`` before its cells are masked."""

    @F.pandas_udf("binary")
    def draw(n: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_bytes(32) for _ in range(len(n))])

    return draw.asNondeterministic()(F.lit(1))


def _seed(spec: Spec, profile: Profile, value: Column, ordinal: int, k: Column | int) -> Column:
    if spec.domain:
        return domain_seed_column(profile, spec.salt, spec.strategy, spec.domain_key, value, k)
    return F.col(fresh_name(ordinal))


def _hash_column(spec: Spec, profile: Profile, value: Column, k: Column | int) -> Column:
    from veilwork.functions.stream import _reversed_hex

    salt = profile.salt if spec.salt is None else spec.salt
    own = None if profile.hardened else salt
    raw = F.coalesce(value, F.lit("")).cast("binary")
    if spec.domain:
        number = F.lit(le64(k)) if isinstance(k, int) else F.unhex(_reversed_hex(k))
        message = F.concat(F.lit(message_parts(profile.tag, own, spec.domain_key)), raw, number)
    else:
        message = F.concat(F.lit((own or "").encode()), raw)
    return F.lower(F.hex(hmac_constant(salt.encode(), message))) if profile.hardened else F.sha2(message, 256)


def mask_column(spec: Spec, profile: Profile, cell: Column, kind: T.DataType | None = None, *, ordinal: int = 0, k: Column | int = 0, most: int | None = None) -> Column:
    """The masked column. ``kind``: the cell's type; dates and timestamps are shifted as such, other cells are text.
    ``k``: collision number; ``most``: the declared length; ``ordinal``: tells columns apart that draw at random."""
    s = spec.strategy
    text = cell.cast("string")
    if s == "null":
        return F.lit(None).cast("string")
    constant = {"redact": REDACTED, "blank": "", "empty_array": "[]", "empty_object": "{}"}.get(s)
    if constant is not None:
        out = F.lit(constant) if s == "redact" else F.when(text.isNotNull(), constant)
    elif s == "hash":
        out = _hash_column(spec, profile, text, k)
    else:
        run = program(spec)
        source = F.coalesce(text, F.lit("")) if spec.domain else text
        if spec.domain or profile.hardened:
            drawn = let(blocks_of(_seed(spec, profile, source, ordinal, k), run.draws, profile.hardened), lambda b: run.column(ColumnStream(b), 0))
        else:
            drawn = run.column(RandomStream(profile.seed, ordinal), 0)
        if s == "date_fuzz":
            out = F.date_add(cell, drawn.cast("int")) if isinstance(kind, T.DateType) else let(drawn, lambda d: fuzz.date_column(text, d))
        elif s == "time_fuzz":
            out = let(drawn, lambda d: fuzz.time_column(text, d))
        elif s == "datetime_fuzz":
            typed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
            out = cell + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), drawn.cast("decimal(18,6)")) if typed else let(drawn, lambda d: fuzz.datetime_column(text, d))
        else:
            out = drawn
    if spec.domain or s in KEEPS_NULL:
        out = F.when(cell.isNotNull(), out)
    if most is not None and s not in UNCUT:
        out = F.left(out.cast("string"), F.lit(most))
    return out
