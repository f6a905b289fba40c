"""Prompt files: a version in the front matter, then System, User and Schema sections."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Prompt:
    version: str
    system: str
    user: str
    schema: str


def parse_prompt(content: str, variables: dict[str, str] | None = None) -> Prompt:
    """Sections by their level-2 headings; ``{{name}}`` is replaced in the User section only, unknown names stay."""
    content = content.replace("\r\n", "\n")
    front = re.match(r"---\n(.*?)\n---(?:\n|$)", content, re.S)
    version = re.search(r"^version:\s*(\S+)", front[1], re.M) if front else None
    body = content[front.end() :] if front else content
    parts = re.split(r"^## (System|User|Schema)[ \t]*$", body, flags=re.M)
    found = {name.lower(): text.strip() for name, text in zip(parts[1::2], parts[2::2])}
    user = re.sub(r"\{\{(\w+)\}\}", lambda m: (variables or {}).get(m[1], m[0]), found.get("user", ""))
    return Prompt(version[1] if version else "", found.get("system", ""), user, found.get("schema", ""))
