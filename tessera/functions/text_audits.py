"""Text audits: task markers, lint suppressions and compiler directives, by pattern over the source."""

from __future__ import annotations

import re

# The markers, and the comments that switch checks off.
MARKER = re.compile(r"(?i)(?://|/\*|#).*\b(TODO|FIXME|HACK|XXX)\b")
ESLINT = re.compile(r"(?://|/\*)\s*eslint-disable(?:-next-line)?\s+([^\n*]+)")
DIRECTIVE = re.compile(r"//\s*(@ts-ignore|@ts-expect-error|@ts-nocheck)\b")


def markers(source: str) -> list[dict]:
    """One marker a line at most: the last on it, upper-cased."""
    out = []
    for number, line in enumerate(source.split("\n"), 1):
        if ("/" in line or "#" in line) and (m := MARKER.search(line)):
            out.append({"tag": m[1].upper(), "line": number})
    return out


def suppressions(source: str) -> list[dict]:
    """Rules that eslint-disable comments name, and compiler directives.

    White space after the keyword may run over a line end, so a bare next-line comment names the
    first word of the line it covers.
    """
    out = []
    if "eslint-disable" in source:
        for found in ESLINT.finditer(source):
            for part in found[1].split(","):
                word = part.split()[:1]
                if word and not word[0].startswith("--") and word[0] not in ("eslint-disable", "eslint-enable"):
                    out.append({"family": "eslint", "rule": word[0]})
    if "@ts-" in source:
        out += [{"family": "directive", "rule": m[1]} for m in DIRECTIVE.finditer(source)]
    return out
