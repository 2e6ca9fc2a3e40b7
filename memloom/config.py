"""Settings: defaults, ranges, and profiles in a JSON file."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

# Each number's default, least and most.
RANGES = {
    "chunk_size": (512, 64, 4096),
    "token_max": (4096, 100, 16384),
    "session_days": (30, 0, math.inf),
    "session_max": (-1, -1, math.inf),
    "fts_weight": (0.5, 0, 1),
    "min_score": (0.01, 0, 1),
    "max_results": (10, 1, 100),
}
WHOLE = ("chunk_size", "token_max", "session_days", "session_max", "max_results")
DEFAULT_PROFILE = "default"
PROFILE_NAME = re.compile(r"[A-Za-z0-9_-]+")


def clamped(name: str, value) -> float:
    default, least, most = RANGES[name]
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return default
    out = min(most, max(least, value))
    return math.floor(out + 0.5) if name == "max_results" else out


@dataclass(frozen=True)
class MemoryConfig:
    workspace: str = "."
    store: str = "memloom-store"
    chunk_size: float = 512
    token_max: float = 4096
    session_days: float = 30
    session_max: float = -1
    fts_weight: float = 0.5
    min_score: float = 0.01
    max_results: int = 10
    session_dirs: tuple[tuple[str, str], ...] = ()  # (directory, "copilot" or "claude")
    extra_dirs: tuple[str, ...] = ()
    model: str = ""

    def __post_init__(self):
        for name in RANGES:
            object.__setattr__(self, name, clamped(name, getattr(self, name)))
        object.__setattr__(self, "session_dirs", tuple(map(tuple, self.session_dirs or ())))
        object.__setattr__(self, "extra_dirs", tuple(self.extra_dirs or ()))


KEYS = tuple(f.name for f in fields(MemoryConfig))
OWN = ("workspace", "store")  # never taken from the shared level once a file has profiles


def _read(path: str | Path) -> dict:
    try:
        got = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def _named(profile: str) -> str:
    if not PROFILE_NAME.fullmatch(profile):
        raise ValueError(f"a profile's name has letters, digits, - and _ only: {profile!r}")
    return profile


def load_config(path: str | Path, profile: str | None = None, overrides: dict | None = None, home: str = "memloom") -> MemoryConfig:
    """Overrides go before the profile, the profile before the file's shared level, that before defaults."""
    data = _read(path)
    flat = "profiles" not in data
    name = _named(profile or data.get("defaultProfile") or DEFAULT_PROFILE)
    own = (data.get("profiles") or {}).get(name) or {}
    levels = [{"workspace": f"{home}/{name}"}, {k: v for k, v in data.items() if flat or k not in OWN}, own, overrides or {}]
    merged = {k: v for level in levels for k, v in level.items() if k in KEYS and v is not None}
    merged.setdefault("store", f"{merged['workspace']}/store")
    return MemoryConfig(**merged)


def list_profiles(path: str | Path) -> list[str]:
    return sorted({DEFAULT_PROFILE, *(_read(path).get("profiles") or {})})


def set_value(path: str | Path, key: str, value, profile: str | None = None) -> None:
    """Writes one setting; unlike loading, which clamps, a value out of its range is refused."""
    if key not in KEYS:
        raise KeyError(key)
    if key in RANGES:
        _, least, most = RANGES[key]
        if isinstance(value, bool) or not isinstance(value, int | float) or not least <= value <= most or (key in WHOLE and value != int(value)):
            raise ValueError(f"{key} must be {'a whole number ' if key in WHOLE else ''}from {least} to {most}")
    data = _read(path)
    at = data if profile is None else data.setdefault("profiles", {}).setdefault(_named(profile), {})
    at[key] = value
    Path(path).write_text(json.dumps(data, indent=2))


def drop_profile(path: str | Path, profile: str) -> bool:
    data = _read(path)
    gone = (data.get("profiles") or {}).pop(_named(profile), None) is not None
    if gone:
        Path(path).write_text(json.dumps(data, indent=2))
    return gone


def as_dict(config: MemoryConfig) -> dict:
    return asdict(config)


def with_overrides(config: MemoryConfig, **changes) -> MemoryConfig:
    return replace(config, **{k: v for k, v in changes.items() if v is not None})
