"""Configuration: nested dictionaries with inherited defaults and dotted overrides."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any


def merge(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, dictionaries key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(name: str, load: Callable[[str], dict | None], strict: bool = True) -> dict:
    """A configuration on top of those it lists under ``defaults``; a missing one is an error, or skipped if not strict."""
    own = load(name)
    if own is None:
        if strict:
            raise FileNotFoundError(name)
        return {}
    own = dict(own)
    out: dict = {}
    for parent in own.pop("defaults", []):
        out = merge(out, resolve(parent, load, strict))
    return merge(out, own)


def override(config: dict, arguments: list[str]) -> dict:
    """Arguments such as ``a.b=3`` set values; values are JSON where they parse as such, else text."""
    for argument in arguments:
        path, _, text = argument.partition("=")
        try:
            value: Any = json.loads(text)
        except ValueError:
            value = text
        over: dict = {}
        *parents, last = path.split(".")
        at = over
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
        config = merge(config, over)
    return config
