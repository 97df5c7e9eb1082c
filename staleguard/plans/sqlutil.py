"""Helpers for writing the DuckDB oracle SQL."""

from __future__ import annotations

from staleguard.config import PUNCTUATION, PY_WHITESPACE


def lit(s: str) -> str:
    """SQL string literal; newlines and tabs become chr() so the SQL stays one logical token."""
    out = []
    buf = ""
    for ch in s:
        if ch in "\n\t\r\x0b\x0c":
            if buf:
                out.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            out.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not out:
        out.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


WS = lit(PY_WHITESPACE)
PUNCT = lit(PUNCTUATION)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def normalize(x: str) -> str:
    return f"translate({strip(f'lower({x})')}, {PUNCT}, '')"


def derived_id(x: str, prefix: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"CAST(CAST({prefix} AS VARCHAR) || lpad({s}, CAST(greatest(5, length({s})) AS INTEGER), '0') AS BIGINT)"


def prefix_date(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return (f"CASE WHEN starts_with({s}, '400') THEN DATE '2010-01-01' "
            f"WHEN starts_with({s}, '300') THEN DATE '2015-01-01' "
            f"WHEN starts_with({s}, '100') THEN DATE '2005-01-01' ELSE DATE '2000-01-01' END")


def render(template: str, **values: str) -> str:
    """SQL twin of ``functions.text.render`` (``||`` propagates NULL like Spark ``concat``)."""
    import re
    parts = []
    pos = 0
    for m in re.finditer(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        if m.start() > pos:
            parts.append(lit(template[pos:m.start()]))
        parts.append(f"CAST({values[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    if pos < len(template):
        parts.append(lit(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r]+'), lambda t: t <> '')"


def bool_mean(x: str) -> str:
    return f"(CASE WHEN len({x}) > 0 THEN list_sum(list_transform({x}, lambda b: CAST(b AS DOUBLE))) / len({x}) END)"


def coverage(id_expr: str, n_expr: str) -> str:
    """Deterministic boolean array: element i is md5(id-i) starting below '8'."""
    return (f"list_transform(range(0, {n_expr}), lambda i: substr(md5(CAST({id_expr} AS VARCHAR) || '-' || "
            f"CAST(i AS VARCHAR)), 1, 1) < '8')")
