"""Configuration sections: a step's own settings under the global ones, with tokens filled in."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def filled(value: Any, constants: dict[str, str]) -> Any:
    """Tokens such as <DATA> in strings and in the values of mappings; lists stay as they are."""
    if isinstance(value, str):
        for name, text in constants.items():
            value = value.replace(f"<{name}>", text)
        return value
    if isinstance(value, dict):
        return {k: filled(v, constants) for k, v in value.items()}
    return value


def load(path: str, section: str, constants: dict[str, str] | None = None) -> dict[str, Any]:
    """A section of a JSON (or, where a YAML reader is installed, YAML) file; global settings win."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML library") from e
        every = yaml.safe_load(text)
    else:
        every = json.loads(text)
    return filled({**every.get(section, {}), **every.get("global", {})}, constants or {})
