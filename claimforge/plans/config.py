"""Projection configurations: a small query language as data."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from enum import StrEnum


class OnMissing(StrEnum):
    NULL = "null"
    OMIT = "omit"
    ERROR = "error"


@dataclass(frozen=True)
class FieldSpec:
    """One output field: where it goes, its type, and where it comes from (by default the same path)."""

    path: str
    type: str
    from_: str | None = None
    required: bool = False
    normalize: str | None = None

    @property
    def origin(self) -> str:
        return self.from_ or self.path


@dataclass(frozen=True)
class Config:
    fields: tuple[FieldSpec, ...] = ()
    include_confidence: bool = False
    include_provenance: bool = False
    on_missing: OnMissing = OnMissing.NULL


class ConfigError(ValueError):
    """A configuration of the wrong shape."""


def _typed(data: dict, key: str, kind: type, default=None, required: bool = False):
    value = data.get(key, default)
    if key not in data and required:
        raise ConfigError(f"{key} is missing")
    if value is not None and not isinstance(value, kind) or (required and value is None):
        raise ConfigError(f"{key} must be {kind.__name__}")
    return value


def parse_config(data: object) -> Config:
    """A configuration from decoded JSON; unknown keys are ignored, wrong shapes are errors."""
    if not isinstance(data, dict):
        raise ConfigError("a configuration is an object")
    specs = []
    for item in _typed(data, "fields", list, []) or []:
        if not isinstance(item, dict):
            raise ConfigError("a field is an object")
        origin = _typed(item, "from", str) if "from" in item else _typed(item, "from_", str)
        specs.append(FieldSpec(_typed(item, "path", str, required=True), _typed(item, "type", str, required=True), origin, bool(_typed(item, "required", bool, False)), _typed(item, "normalize", str)))
    try:
        policy = OnMissing(_typed(data, "on_missing", str, "null"))
    except ValueError as e:
        raise ConfigError(str(e)) from e
    return Config(tuple(specs), bool(_typed(data, "include_confidence", bool, False)), bool(_typed(data, "include_provenance", bool, False)), policy)


def load_config(path: str | None) -> Config:
    """The configuration in a JSON file; none, or the word ``none``, is the default one."""
    if path is None or path.lower() == "none":
        return Config()
    with open(path, encoding="utf-8") as f:
        try:
            return parse_config(json.load(f))
        except json.JSONDecodeError as e:
            raise ConfigError(f"not JSON: {e}") from e


@dataclass(frozen=True)
class Segment:
    name: str
    index: int | None = None
    each: bool = False


def parse_path(path: str) -> tuple[Segment, ...]:
    """``name``, ``name[0]`` and ``name[]`` joined by dots."""
    out = []
    for part in path.split("."):
        if part.endswith("[]"):
            out.append(Segment(part[:-2], each=True))
        elif m := re.fullmatch(r"(?s)(.+)\[(\d+)\]", part):
            out.append(Segment(m[1], index=int(m[2])))
        else:
            out.append(Segment(part))
    return tuple(out)


def root_field(path: str) -> str:
    return re.split(r"[.\[]", path, maxsplit=1)[0]


