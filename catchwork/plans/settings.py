"""Settings of a run: typed defaults, a TOML file over them, overrides over both, and path templates."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class PlumeSettings:
    """Loads in grams a head and day, width, limit, decay law, sample step in metres, least discharge, radii in metres."""

    org_per_pop: float = 60.0
    width: float = 12.0
    c_limit: float = 5.0
    base_k: float = 0.23
    theta: float = 1.047
    step_m: float = 100.0
    least_discharge_cms: float = 0.269
    impact_radii: tuple[float, ...] = (1000.0, 2000.0)


def typed(kind: type, given: Any) -> Any:
    """A settings object of ``kind`` from a mapping; what is absent, or isn't a number where one is wanted, keeps its default."""
    found = {}
    for f in fields(kind):
        value = given.get(f.name) if isinstance(given, dict) else None
        try:
            if isinstance(f.default, tuple):
                if isinstance(value, list | tuple):
                    found[f.name] = tuple(float(v) for v in value)
            elif value is not None:
                found[f.name] = type(f.default)(value)
        except (TypeError, ValueError):
            continue
    return kind(**found)


@dataclass(frozen=True)
class Settings:
    """All of a run: free values, expanded paths, and the plume's parameters."""

    values: dict[str, Any] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    plume: PlumeSettings = field(default_factory=PlumeSettings)

    def path(self, name: str) -> str:
        if name not in self.paths:
            raise KeyError(f"no path named {name}; there are {', '.join(sorted(self.paths))}")
        return self.paths[name]


def expanded(templates: dict[str, str], values: dict[str, Any]) -> dict[str, str]:
    """Paths with ``{name}`` replaced by values or other paths; a name that is neither, or a circle, is an error. Addresses keep their slashes."""
    done: dict[str, str] = {}

    class _Names(dict):
        def __init__(self, trail: tuple[str, ...]):
            self.trail = trail

        def __missing__(self, name: str) -> Any:
            return values[name] if name in values else one(name, self.trail)

    def one(name: str, trail: tuple[str, ...] = ()) -> str:
        if name in trail or name not in templates:
            raise ValueError(f"path {trail[0] if trail else name}: {name} is {'its own part' if name in trail else 'unknown'}")
        if name not in done:
            text = templates[name].format_map(_Names((*trail, name)))
            done[name] = text if "://" in text else str(Path(text))
        return done[name]

    return {name: one(name) for name in templates}


def load(path: str | None = None, **overrides: Any) -> Settings:
    """Settings of a TOML file (tables ``paths`` and ``plume``, the rest are values), overrides on top."""
    raw: dict[str, Any] = {}
    if path:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    templates, plume = raw.pop("paths", {}), raw.pop("plume", {})
    values = raw | overrides
    return Settings(values, expanded(templates, values), typed(PlumeSettings, plume))
