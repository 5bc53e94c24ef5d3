"""Configuration: YAML with environment variables, checked into frozen dataclasses on the driver."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints

import yaml

from ..functions.patterns import SECRETS
from .languages import REGISTRY

PATHS = ("config.yaml", "config.yml", "config/config.yaml")

# Fixed value: the sentence that is always whitelisted.
WHITELIST = ("You are Claude Code, Anthropic's official CLI for Claude.",)


class ConfigError(ValueError):
    pass


# The defaults of all classes below, on which configurations rely.
@dataclass(frozen=True)
class Masking:
    show_markers: bool = False
    marker_text: str = "[protected]"
    whitelist: tuple = WHITELIST


@dataclass(frozen=True)
class Pii:
    enabled: bool = True
    languages: tuple = ("en",)
    fallback_language: str = "en"
    score_threshold: float = 0.7
    entities: tuple = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "LOCATION")
    scan_roles: tuple | None = None


@dataclass(frozen=True)
class Secrets:
    enabled: bool = True
    action: str = "mask"
    entities: tuple = ("OPENSSH_PRIVATE_KEY", "PEM_PRIVATE_KEY")
    max_scan_chars: int = 200_000
    log_detected_types: bool = True
    scan_roles: tuple | None = None


@dataclass(frozen=True)
class Logging:
    retention_days: int = 30
    log_content: bool = False
    log_masked_content: bool = True


@dataclass(frozen=True)
class Local:
    model: str = ""
    type: str = "openai"
    base_url: str = ""
    api_key: str | None = None


@dataclass(frozen=True)
class Config:
    mode: str = "route"
    local: Local | None = None
    masking: Masking = field(default_factory=Masking)
    pii_detection: Pii = field(default_factory=Pii)
    secrets_detection: Secrets = field(default_factory=Secrets)
    logging: Logging = field(default_factory=Logging)


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; an empty variable counts as unset; unset without default: a warning, and nothing."""
    env = os.environ if env is None else env

    def value(m: re.Match) -> str:
        name, default = m[1], m[3]
        if env.get(name):
            return env[name]
        if default is None:
            warnings.warn(f"environment variable {name} is not set", stacklevel=2)
        return default or ""

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(:-([^}]*))?\}", value, text)


def substitute_all(tree: Any, env: dict[str, str] | None = None) -> Any:
    if isinstance(tree, str):
        return substitute(tree, env)
    if isinstance(tree, list):
        return [substitute_all(x, env) for x in tree]
    return {k: substitute_all(v, env) for k, v in tree.items()} if isinstance(tree, dict) else tree


def _coerced(value: Any, kind: Any, where: str) -> Any:
    try:
        if kind is float or kind is int:
            number = float(value)
            if kind is int and number != int(number):
                raise ValueError
            return kind(number)
        if kind is bool:
            if not isinstance(value, bool):
                raise ValueError
            return value
        if "tuple" in str(kind):
            if value is None:
                return None
            return tuple(x.strip() for x in value.split(",")) if isinstance(value, str) else tuple(value)
        if not isinstance(value, str) and value is not None:
            raise ValueError
        return value
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{where}: not a valid value: {value!r}") from e


def _build(cls: type, tree: Any, where: str) -> Any:
    if not isinstance(tree, dict):
        raise ConfigError(f"{where or 'config'}: a mapping is needed")
    hints, out = get_type_hints(cls), {}
    for f in fields(cls):
        if f.name not in tree:
            continue
        at, kind = f"{where}.{f.name}".lstrip("."), hints[f.name]
        inner = next((k for k in (kind, *getattr(kind, "__args__", ())) if is_dataclass(k)), None)
        out[f.name] = _build(inner, tree[f.name] or {}, at) if inner else _coerced(tree[f.name], kind, at)
    return cls(**out)


def _one_of(value: str, allowed: Any, where: str) -> None:
    if value not in allowed:
        raise ConfigError(f"{where}: {value!r} is none of {', '.join(allowed)}")


def from_tree(tree: dict, env: dict[str, str] | None = None) -> Config:
    tree = substitute_all(tree, env)
    extra = tuple((tree.get("masking") or {}).get("whitelist") or ())
    if extra:
        tree = tree | {"masking": tree["masking"] | {"whitelist": [*WHITELIST, *extra]}}
    c = _build(Config, tree, "")
    _one_of(c.mode, ("route", "mask"), "mode")
    _one_of(c.secrets_detection.action, ("block", "mask", "route_local"), "secrets_detection.action")
    for x in c.secrets_detection.entities:
        _one_of(x, SECRETS, "secrets_detection.entities")
    for x in (*c.pii_detection.languages, c.pii_detection.fallback_language):
        _one_of(x, REGISTRY, "pii_detection.languages")
    if not 0 <= c.pii_detection.score_threshold <= 1:
        raise ConfigError("pii_detection.score_threshold: must be from 0 to 1")
    if c.secrets_detection.max_scan_chars < 0 or c.logging.retention_days < 0:
        raise ConfigError("max_scan_chars and retention_days: must not be negative")
    if c.mode == "route" and c.local is None:
        raise ConfigError("mode route needs local")
    if c.secrets_detection.action == "route_local" and c.mode == "mask":
        raise ConfigError("secrets_detection.action route_local does not go with mode mask")
    return c


def load_config(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The first of the usual places that exists, or the one given; a folder or no file is an error."""
    for p in [Path(path)] if path else map(Path, PATHS):
        if p.is_dir():
            raise ConfigError(f"{p} is a folder")
        if p.exists():
            return from_tree(yaml.safe_load(p.read_text()) or {}, env)
    raise ConfigError(f"no configuration at {path or ', '.join(PATHS)}")
