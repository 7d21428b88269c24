"""Settings: environment over file over default (survey F30)."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping


def setting(name: str, default=None, file: Mapping | str | None = None, environ: Mapping[str, str] = os.environ):
    """Value of ``name`` in dotted form; the environment has it in capitals with _."""
    if (v := environ.get(name.upper().replace(".", "_"))) not in (None, ""):
        return type(default)(v) if isinstance(default, (int, float)) and not isinstance(default, bool) else v.lower() in ("1", "true", "yes") if isinstance(default, bool) else v
    if isinstance(file, str):
        with open(file, encoding="utf-8") as f:
            file = json.load(f)
    node = file or {}
    for part in name.split("."):
        if not isinstance(node, Mapping) or part not in node:
            return default
        node = node[part]
    return node
