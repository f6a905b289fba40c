"""Settings from a file of nested ``name: value`` lines, with ``${NAME}`` from the environment, overrides and a search path."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping


def find(explicit: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "LORESPARK") -> str:
    """The file named, or that of ``<prefix>_CONFIG``, ``./config.yml`` or ``~/.lorespark/config.yml``, the first that exists; a named one has to."""
    if explicit:
        if not os.path.exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    for path in (env.get(f"{prefix}_CONFIG", ""), "./config.yml", os.path.expanduser("~/.lorespark/config.yml")):
        if path and os.path.exists(path):
            return path
    raise FileNotFoundError("no configuration file")


def _value(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    text = re.sub(r"\s+#.*$", "", text)
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    return text


def parse(content: str, env: Mapping[str, str] = os.environ, prefix: str = "LORESPARK") -> dict[str, object]:
    """Settings by dotted name. ``<prefix>_A_B`` in the environment overrides ``a.b`` if it fits the setting's type."""
    content = re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), content)
    out: dict[str, object] = {}
    open_: list[tuple[int, str]] = []
    for line in content.split("\n"):
        m = re.match(r"( *)([\w-]+):(?:\s+(\S.*)|\s*)$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        while open_ and open_[-1][0] >= len(m[1]):
            open_.pop()
        name = ".".join([*(n for _, n in open_), m[2]])
        if m[3] is None:
            open_.append((len(m[1]), m[2]))
        else:
            out[name] = _value(m[3])
    for name, value in out.items():
        given = env.get(f"{prefix}_{name.upper().replace('.', '_').replace('-', '_')}", "")
        if given:
            new = _value(given)
            out[name] = new if type(new) is type(value) else given if isinstance(value, str) else value
    return out


def load(explicit: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "LORESPARK") -> dict[str, object]:
    with open(find(explicit, env, prefix), encoding="utf-8") as f:
        return parse(f.read(), env, prefix)
