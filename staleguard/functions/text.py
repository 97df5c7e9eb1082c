"""Column expressions for text (all JVM-side, codegen-friendly)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from staleguard.config import (
    CONTEXT_DELIMITER,
    DEFAULT_DATE,
    ID_ZERO_FILL,
    PREFIX_DATES,
    PUNCTUATION,
    PY_WHITESPACE,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` only drops spaces)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def normalize(c) -> Column:
    """lower -> strip -> delete ASCII punctuation."""
    return F.translate(py_strip(F.lower(_c(c))), PUNCTUATION, "")


def derived_id(orig_id, prefix) -> Column:
    """int(str(prefix) + zfill(5)(str(id))); ``lpad`` alone would truncate long ids."""
    s = _c(orig_id).cast("string")
    p = prefix if isinstance(prefix, Column) else F.lit(str(prefix))
    return F.concat(p.cast("string"), F.lpad(s, F.greatest(F.lit(ID_ZERO_FILL), F.length(s)), "0")).cast("bigint")


def prefix_date(id_col) -> Column:
    """Creation date from the decimal prefix of an id, tested in the fixed order."""
    s = _c(id_col).cast("string")
    expr = None
    for prefix, day in PREFIX_DATES:
        cond = s.startswith(prefix)
        expr = F.when(cond, F.to_date(F.lit(day))) if expr is None else expr.when(cond, F.to_date(F.lit(day)))
    return expr.otherwise(F.to_date(F.lit(DEFAULT_DATE)))


_PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """A template in its order: ("text", literal) and ("slot", placeholder's name)."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        parts += [("text", template[pos:m.start()]), ("slot", m.group(1))]
        pos = m.end()
    return [(kind, x) for kind, x in [*parts, ("text", template[pos:])] if x]


def render(template: str, **values) -> Column:
    """Fill ``{name}`` placeholders in one pass.

    The template is split into literal segments once on the driver and the
    result is a single ``concat`` of literals and columns, so text inserted for
    one placeholder is never re-substituted (chained replace would).
    A null value yields a null prompt, like formatting with a missing value.
    """
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        if name not in values:
            raise KeyError(f"template placeholder {{{name}}} has no value")
        parts.append(_c(values[name]).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def bullets(arr) -> Column:
    """'- item' lines joined by newline."""
    return F.array_join(F.transform(_c(arr), lambda x: F.concat(F.lit("- "), x)), "\n")


def numbered_qa(qa_arr, starred: bool = False) -> Column:
    """``question_i: q\nanswer_i: a\n`` blocks (1-based) from an array of
    ``struct(question, answer)``; ``starred`` gives ``*question_i*: …``."""
    l, r = ("*", "*") if starred else ("", "")

    def one(x, i):
        n = (i + 1).cast("string")
        return F.concat(F.lit(f"{l}question_"), n, F.lit(f"{r}: "), x["question"], F.lit(f"\n{l}answer_"), n,
                        F.lit(f"{r}: "), x["answer"], F.lit("\n"))
    return F.array_join(F.transform(_c(qa_arr), one), "")


def table_row_text(description, value) -> Column:
    """'{description} | {value}' (null propagates)."""
    return F.concat(_c(description), F.lit(" | "), _c(value))


def word_tokens(c) -> Column:
    """Whitespace tokens, empty tokens dropped (Python ``str.split()``)."""
    return F.filter(F.split(_c(c), "[ \t\n\r]+"), lambda x: x != "")


WORD_CHAR = r"[\p{L}\p{N}_]"  # the same class in Java and RE2 patterns


def term_tokens(c) -> Column:
    """Lower-cased terms of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(rf"({WORD_CHAR}{WORD_CHAR}+)"), 1)


def first_entity(patient, court, company) -> Column:
    """First non-empty of patient -> court -> company."""
    return F.coalesce(F.nullif(_c(patient), F.lit("")), F.nullif(_c(court), F.lit("")),
                      F.nullif(_c(company), F.lit("")))
