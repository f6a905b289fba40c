"""JSON replies of models: found in noise, mended, checked by a schema, asked for again."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def found(raw: str) -> str:
    """The outermost object or array of a text, code fences dropped."""
    text = re.sub(r"```(?:json)?", "", raw)
    m = re.search(r"\{.*\}|\[.*\]", text, re.DOTALL)
    return m[0] if m else text.strip()


def mended(text: str) -> str:
    """JSON with common slips put right: raw line ends inside strings, commas before a closing bracket, missing closing brackets."""
    if _valid(text):
        return text
    out, inside, escaped, closing = [], False, False, []
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            elif c in "\n\r\t":
                c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
        elif c == '"':
            inside = True
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
        elif c in "}]" and closing:
            closing.pop()
        out.append(c)
    fixed = "".join(out) + ('"' if inside else "") + "".join(reversed(closing))
    fixed = re.sub(r",(\s*[}\]])", r"\1", fixed)
    return fixed if _valid(fixed) else text


def _valid(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, required, properties, items, minItems, minLength, minimum, maximum."""
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []

    def fits(k: str) -> bool:
        if k in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (k == "number" or float(value).is_integer())
        return isinstance(value, _TYPES[k])

    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = [f"{at}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{at}: lacks {name}" for name in schema.get("required", ()) if name not in value]
        for name, own in schema.get("properties", {}).items():
            if name in value:
                out += errors(value[name], own, f"{at}.{name}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: fewer than {schema['minItems']} items")
        for i, x in enumerate(value if "items" in schema else ()):
            out += errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: shorter than {schema['minLength']}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: under {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: over {schema['maximum']}")
    return out


class ModelClient:
    """Calls a model over ``transport``, a function from a request to a reply, with retries and one call to mend a reply that breaks the schema.

    It waits 1, 2, 4 ... seconds between attempts; ``sleep`` is a parameter for tests. An instance is
    a provider for :mod:`lorespark.operators.provider`: pass its ``complete_json`` with a schema bound.
    """

    def __init__(self, transport: Callable[[str], str], retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.retries, self.sleep = transport, retries, sleep

    def complete(self, request: str) -> str:
        for attempt in range(self.retries + 1):
            try:
                return self.transport(request)
            except Exception:  # any failure of a call is worth another one
                if attempt == self.retries:
                    raise
                self.sleep(2.0**attempt)
        raise AssertionError

    def complete_json(self, request: str, schema: dict | None = None) -> str:
        text = mended(found(self.complete(request)))
        wrong = self._errors(text, schema)
        if not wrong:
            return text
        again = mended(found(self.complete(json.dumps({"repair": text, "errors": wrong, "schema": schema}, ensure_ascii=False))))
        if wrong := self._errors(again, schema):
            raise ValueError("; ".join(wrong))
        return again

    @staticmethod
    def _errors(text: str, schema: dict | None) -> list[str]:
        try:
            return errors(json.loads(text), schema or {})
        except ValueError as e:
            return [f"$: {e}"]
