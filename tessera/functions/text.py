"""Names and texts: header sanitising and text normalisation."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the words that stand for symbols in column names
SYMBOL_WORDS = {
    "±": "plus_minus", "δ": "delta", "σ": "sigma", "μ": "mu", "α": "alpha", "β": "beta", "γ": "gamma", "Δ": "delta", "Σ": "sigma",
    "π": "pi", "°": "degree", "º": "degree", "%": "percent", "#": "num", "&": "and", "@": "at", "$": "dollar", "€": "euro", "£": "pound",
}
_BRACKETS, _REST = re.compile(r"[()\[\]{}\s]+"), re.compile(r"[^a-z0-9_]")


def unaccent(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def column_name(raw: object, position: int, longest: int = 48) -> str:
    """A plain name for a header cell: lower case, a-z 0-9 _, at most `longest` characters; unnamed_N where nothing is left."""
    text = "" if raw is None or raw != raw else str(raw).strip()
    if not text or text[0] == "=" or len(text) > 200:
        return f"unnamed_{position}"
    spelled = "".join(f"_{SYMBOL_WORDS[c]}_" if c in SYMBOL_WORDS else c for c in text)
    plain = _REST.sub("", unaccent(_BRACKETS.sub("_", spelled).lower()))
    plain = "_".join(filter(None, plain.split("_")))[:longest].rstrip("_")
    if not plain:
        return f"unnamed_{position}"
    return f"col_{plain}" if plain[0].isdigit() else plain


def column_names(header: list) -> list[str]:
    """Plain names for a whole header; the second and later of one name get _1, _2, ..."""
    times: dict[str, int] = {}
    out = []
    for position, raw in enumerate(header):
        name = column_name(raw, position)
        seen = times.get(name, -1) + 1
        times[name] = seen
        out.append(f"{name}_{seen}" if seen else name)
    return out


def _accented(limit: int = 0x250) -> tuple[str, str]:
    """Latin letters with marks and their base letters, from the Unicode decomposition."""
    pairs = [(chr(c), unaccent(chr(c))) for c in range(0xC0, limit)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_text(column: Column) -> Column:
    """Lower case without accents: precomposed Latin letters by translation, combining marks by pattern."""
    marked, base = _accented()
    return F.regexp_replace(F.translate(F.lower(column), marked, base), r"\p{Mn}+", "")
