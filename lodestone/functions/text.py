"""Text building blocks: lines, comments, regular expressions with the semantics the rules were written for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode classes, \n as the only line end; and the same without regard to case.
CASED, UNCASED = "(?Ud)", "(?iuUd)"
#: Line ends of the graph scanner.
ALL_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def matches(text: Column, pattern: str, cased: bool = False, multiline: bool = False) -> Column:
    prefix = CASED if cased else UNCASED
    return text.rlike((prefix.replace("d)", "dm)") if multiline else prefix) + pattern)


def extract(text: Column, pattern: str, group: int, cased: bool = False) -> Column:
    """The group of the first match, '' without one."""
    return F.regexp_extract(text, (CASED if cased else UNCASED) + pattern, group)


def extract_all(text: Column, pattern: str, group: int = 0, cased: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit((CASED if cased else UNCASED) + pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_comment(text: Column) -> Column:
    """Only a line that starts with // is a comment."""
    return F.regexp_replace(text, r"(?U)^\s+", "").startswith("//")


def has_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether any of the words is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def lines(modules: DataFrame, ends: str = "\n") -> DataFrame:
    """path, line_no (from 1), text of every line of modules(path, content). A last line end makes a last empty line."""
    return modules.select("path", F.posexplode(F.split("content", ends, -1)).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line_no"), "text")


def graph_lines(modules: DataFrame) -> DataFrame:
    """Lines as the graph scanner sees them: more line ends, and no empty line after the last one."""
    parts = F.split("content", ALL_LINE_ENDS, -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return modules.select("path", F.posexplode(kept).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line_no"), "text")


def hits(flags: list[tuple[Column, dict[str, str]]]) -> Column:
    """One struct of literals for every flag that holds: evaluate many rules in one pass, then explode."""
    rows = [F.when(flag, F.struct(*[F.lit(v).alias(k) for k, v in row.items()])) for flag, row in flags]
    return F.explode(F.array_compact(F.array(*rows)))
