"""Regular expressions written for Python, for use in Spark."""

from __future__ import annotations

import re

_GROUP, _BACK = re.compile(r"\(\?P<(\w+)>"), re.compile(r"\(\?P=(\w+)\)")


def java_pattern(pattern: str) -> str:
    """Named groups and end anchors in Java's spelling; names lose what Java does not allow in them."""
    re.compile(pattern)
    plain = lambda name: re.sub(r"[^A-Za-z0-9]", "", name) or "g"
    pattern = _GROUP.sub(lambda m: f"(?<{plain(m[1])}>", pattern)
    pattern = _BACK.sub(lambda m: rf"\k<{plain(m[1])}>", pattern)
    return pattern.replace(r"\Z", r"\z")


def java_replacement(text: str) -> str:
    r"""\1 and \g<1> as $1; a plain dollar sign is escaped."""
    text = text.replace("$", r"\$")
    return re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "${" + m[1] + "}" if m[1] and not m[1].isdigit() else "$" + (m[1] or m[2]), text)


def flagged(pattern: str, flags: list[str] | str | None) -> str:
    """(?ims) from flag names or letters."""
    if not flags:
        return pattern
    names = [flags] if isinstance(flags, str) else flags
    letters = "".join(sorted({{"ignorecase": "i", "multiline": "m", "dotall": "s"}.get(n.lower(), n.lower()[:1]) for n in names}))
    if set(letters) - set("ims"):
        raise ValueError(f"unknown flags {flags}")
    return f"(?{letters}){pattern}"
