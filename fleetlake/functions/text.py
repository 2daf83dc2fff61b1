"""Name and text predicates, identifier quoting, remediation text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col


def similar_regex(pattern: str) -> str:
    """The anchored regular expression of a SQL ``SIMILAR TO`` pattern."""
    out = []
    for ch in pattern:
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch in "|()[]*+?{},-":
            out.append(ch)
        else:
            out.append(re.escape(ch))
    return f"^(?s:{''.join(out)})$"


def not_similar(col: ColumnLike, pattern: str) -> Column:
    return ~as_col(col).rlike(similar_regex(pattern))


def text_filter(col: ColumnLike, needle: str | None, ci: bool = False) -> Column:
    """Substring test, or case-insensitive pattern test; no needle matches every non-null text."""
    text = as_col(col)
    if ci:
        return text.ilike(needle) if needle is not None else text.isNotNull()
    return text.contains(needle or "")


def regex_filter(col: ColumnLike, regex: str, negate: bool = False, ci: bool = False) -> Column:
    hit = as_col(col).rlike(f"(?i){regex}" if ci else regex)
    return ~hit if negate else hit


def mentions_table(query: ColumnLike, schema: str, table: str, verbs: dict[str, bool] | None = None) -> Column:
    """True when a statement such as a vacuum or a bulk copy names ``schema``.``table``.

    ``verbs`` maps a statement prefix (regular expression) to whether its case
    is ignored. The table name must end the text or be followed by a blank, a
    semicolon or a quote, so ``t1`` is not found in ``t10``.
    """
    verbs = verbs or {".*vacuum": True, "COPY.*FROM": False}
    text = as_col(query)
    hit = F.lit(False)
    for verb, ignore_case in verbs.items():
        tail = rf'.*{re.escape(schema)}.*{re.escape(table)}(?:["; ].*)?$'
        hit = hit | text.rlike(("(?is)^" if ignore_case else "(?s)^") + verb + tail)
    return hit


def quote_ident(col: ColumnLike) -> Column:
    """An identifier, quoted unless it is made of lower-case letters, digits and underscores."""
    name = as_col(col)
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(name.rlike("^[a-z_][a-z0-9_]*$"), name).otherwise(quoted)


def quote_literal(col: ColumnLike) -> Column:
    """A value as a SQL literal; null becomes ``NULL``."""
    text = as_col(col).cast("string")
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(quoted, F.lit("NULL"))


def remediation(df: DataFrame, template: str, cols: list[str], name: str = "remediation", quote: bool = True) -> DataFrame:
    """Add a statement text built from ``template`` (``%s`` per column). The text is never run."""
    values = [quote_ident(c) if quote else F.col(c) for c in cols]
    return df.withColumn(name, F.format_string(template, *values))


def parse_sequence_default(df: DataFrame, default: str, schema: str) -> DataFrame:
    """Add ``sequence_schema`` and ``sequence_name`` read from a ``nextval('...')`` default.

    A name without a schema belongs to the table's own schema.
    """
    quoted = F.split_part(F.col(default), F.lit("'"), F.lit(2))
    dotted = F.instr(quoted, ".") > 0
    return df.withColumns({
        "sequence_schema": F.when(dotted, F.split_part(quoted, F.lit("."), F.lit(1))).otherwise(F.col(schema)),
        "sequence_name": F.when(dotted, F.split_part(quoted, F.lit("."), F.lit(2))).otherwise(quoted),
    })
