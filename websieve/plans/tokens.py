"""From query text to tokens."""

from __future__ import annotations

import re


def strip_comments(text: str, strict_compat: bool = False) -> str:
    """Join lines, without ``//`` comments.

    A comment starts at the start of a line or after white space, outside quotes, so that
    ``uri:http://x`` keeps its address. strict_compat lets any ``//`` start one.
    """
    kept = []
    for line in text.replace("\t", " ").splitlines():
        if strict_compat:
            line = line.split("//", 1)[0]
        else:
            for m in re.finditer(r"(?:^|(?<=\s))//", line):
                if _quotes(line[: m.start()]) % 2 == 0:
                    line = line[: m.start()]
                    break
        kept.append(line.strip())
    return " ".join(k for k in kept if k)


def _quotes(text: str) -> int:
    return len(re.findall(r'(?<!\\)"', text))


#: A token: runs of quoted text, escaped quotes and characters other than blanks.
_TOKEN = re.compile(r'(?:"(?:\\"|[^"])*(?:"|$)|\\"|[^\s"])+')
_PIECE = re.compile(r'\\"|"')


def tokenise(text: str) -> list[str]:
    """Split at blanks outside quotes. Quotes are dropped; an escaped quote stays, unescaped."""
    return [_PIECE.sub(lambda m: '"' if m[0] == '\\"' else "", t) for t in _TOKEN.findall(text)]
