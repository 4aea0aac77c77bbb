"""Environment files of KEY=VALUE lines."""

from __future__ import annotations

import os
import re

_LINE = re.compile(r"\s*(?:export\s+)?([^=#\s][^=]*?)\s*=\s*(.*?)\s*")


def parse_env(text: str) -> dict[str, str]:
    """The pairs of a text; comments and lines without a pair are skipped, matching quotes go."""
    pairs = {}
    for line in text.splitlines():
        if m := _LINE.fullmatch(line):
            key, value = m.groups()
            if len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]:
                value = value[1:-1]
            pairs[key] = value
    return pairs


def load_env_file(path: str = ".env", override: bool = False) -> bool:
    """Put a file's pairs into the environment; whether there was such a file."""
    if not os.path.isfile(path):
        return False
    with open(path, encoding="utf-8") as f:
        for key, value in parse_env(f.read()).items():
            if override or key not in os.environ:
                os.environ[key] = value
    return True
