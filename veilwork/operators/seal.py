"""Seals: a line that says which policy made an output, so that the same run over it again can pass it through."""

from __future__ import annotations

import dataclasses
import hashlib
import hmac
import json
import re
from collections.abc import Mapping
from typing import Any

import veilwork
from veilwork.functions.stream import Profile
from veilwork.plans.policy import Policy

FORMAT = 1
PREFIX = "-- veilwork-seal:"


@dataclasses.dataclass(frozen=True)
class Seal:
    format: int
    version: str
    profile: str
    sha256: str

    def line(self) -> str:
        return f"{PREFIX} v={self.format} version={self.version} profile={self.profile} sha256={self.sha256}\n"


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value):
        return {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def digest(policy: Policy, profile: Profile, runtime: Mapping[str, Any] | None = None, key: bytes | None = None) -> str:
    """Of everything that decides the output. With ``key`` an HMAC, which only its holders can make."""
    content = _plain(policy)
    content.pop("source")
    payload = {"format": FORMAT, "version": veilwork.__version__, "profile": _name(profile), "tag": profile.tag.decode("latin-1"), "policy": content, "runtime": {"seed": profile.seed, **(runtime or {})}}
    raw = json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()
    return hmac.digest(key, raw, "sha256").hex() if key else hashlib.sha256(raw).hexdigest()


def _name(profile: Profile) -> str:
    return "hardened" if profile.hardened else "standard"


def make(policy: Policy, profile: Profile, runtime: Mapping[str, Any] | None = None, key: bytes | None = None) -> Seal:
    return Seal(FORMAT, veilwork.__version__, _name(profile), digest(policy, profile, runtime, key))


def parse(line: str) -> Seal | None:
    """The seal of a line, or None. Parts may come in any order; unknown ones are skipped."""
    if not line.startswith(PREFIX):
        return None
    parts = [p.partition("=") for p in line[len(PREFIX) :].split()]
    if not all(mark for _, mark, _ in parts):
        return None
    found = {k: v for k, _, v in parts}
    if not found.get("v", "").isdigit() or not found.get("version") or not found.get("profile") or not re.fullmatch("[0-9a-fA-F]{64}", found.get("sha256", "")):
        return None
    return Seal(int(found["v"]), found["version"], found["profile"].lower(), found["sha256"].lower())


def verdict(first_line: str, current: Seal) -> str:
    """``trusted``: made by this very policy, pass it through; ``stale``: by another, drop the line; ``none``: no seal."""
    found = parse(first_line)
    return "none" if found is None else "trusted" if found == current else "stale"
