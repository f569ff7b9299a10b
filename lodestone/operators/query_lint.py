"""Query texts: extraction from modules, patterns, validation, advice, clauses, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules as R
from .metrics import in_file


def embedded_queries(modules: DataFrame) -> DataFrame:
    """path, line_no, name, start_line, query_text of query texts written on one line after a query was created."""
    line = F.col("text")
    created = line.contains("Новый Запрос") | (line.contains("Запрос") & line.contains("Новый"))
    name = F.nullif(T.extract(line, r"^\s*(\w+)\s*=\s*.*Новый\s+Запрос", 1, cased=True), F.lit(""))
    pattern = r'\.Текст\s*=\s*"""([\s\S]*?)"""'
    has = ~created & line.contains("Текст") & (line.contains("=") | line.contains(".Добавить")) & T.matches(line, pattern, cased=True)
    marks = T.lines(modules).select("path", "line_no", F.when(created, F.col("line_no")).alias("start"), F.when(created, name).alias("name"), F.when(has, F.substring(T.extract(line, pattern, 1, cased=True), 1, 1000)).alias("query_text"))
    # Lines that neither create a query nor set a text carry nothing: they are left out before the shuffle.
    marks = marks.filter("start IS NOT NULL OR query_text IS NOT NULL")
    so_far = in_file().rowsBetween(Window.unboundedPreceding, 0)
    known = marks.withColumn("start_line", F.last("start", True).over(so_far)).withColumn("called", F.last("name", True).over(so_far))
    found = known.filter("query_text IS NOT NULL AND start_line IS NOT NULL")
    return found.select("path", "line_no", F.coalesce("called", F.concat(F.lit("query_at_line_"), "start_line")).alias("name"), "start_line", "query_text")


def _pattern_flags(text: Column, only: tuple[str, ...] | None = None) -> list[tuple[Column, dict[str, str]]]:
    return [(T.matches(text, p, multiline=True), {"pattern_id": i, "severity": s, "message": m, "suggestion": a}) for i, s, p, m, a in R.QUERY_PATTERNS if only is None or i in only]


def anti_patterns(queries: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of queries besides query_text, and pattern_id, severity, message: one row per pattern that hits."""
    rest = [c for c in queries.columns if c != "query_text"]
    return queries.select(*rest, T.hits(_pattern_flags(F.col("query_text"), only)).alias("h")).select(*rest, "h.pattern_id", "h.severity", "h.message")


def optimize(queries: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, pattern_id, current, suggestion."""
    found = queries.select("query_id", T.hits(_pattern_flags(F.col("query_text"), only)).alias("h"))
    return found.select("query_id", "h.pattern_id", F.col("h.message").alias("current"), "h.suggestion")


def validate(queries: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, valid, kind, pattern_id, message: one row per finding, and one with null kind for a query without any."""
    text = F.col("query_text")
    upper = F.upper(T.strip(text))
    empty = T.strip(text) == ""
    struct = lambda kind, pattern, message: F.struct(F.lit(kind).alias("kind"), F.lit(pattern).cast("string").alias("pattern_id"), F.lit(message).alias("message"))
    no_select, no_from = ~upper.startswith("ВЫБРАТЬ"), ~upper.contains("ИЗ")
    rows = [F.when(no_select, struct("issue", None, R.NO_SELECT)), F.when(no_from, struct("issue", None, R.NO_FROM))]
    rows += [F.when(flag, struct("warning" if h["severity"] == "warning" else "issue", h["pattern_id"], h["message"])) for flag, h in _pattern_flags(text, only)]
    found = F.when(empty, F.array(struct("issue", None, R.EMPTY_QUERY))).otherwise(F.array_compact(F.array(*rows)))
    valid = ~empty & ~no_select & ~no_from
    return queries.select("query_id", valid.alias("valid"), F.explode_outer(found).alias("f")).select("query_id", "valid", "f.kind", "f.pattern_id", "f.message")


def clauses(queries: DataFrame) -> DataFrame:
    """query_id, line_no, clause, text, first_n: what each line of a query is taken for. Flags are independent of each other."""
    line = T.strip(F.col("line"))
    up = F.upper(line)
    lines = queries.select("query_id", F.posexplode(F.split("query_text", "\n", -1)).alias("i", "line")).select("query_id", (F.col("i") + 1).alias("line_no"), line.alias("text"), up.alias("up"))
    u = F.col("up")
    order = [("select", u.contains("ВЫБРАТЬ")), ("from", u.contains("ИЗ")), ("where", u.startswith("ГДЕ")), ("join", u.startswith("СОЕДИНЕНИЕ")), ("group", u.startswith("СГРУППИРОВАТЬ")), ("having", u.startswith("ИМЕЮЩИЕ")), ("order", u.startswith("ORDER")), ("skip", u.startswith("//") | u.startswith("="))]
    setter = F.lit(None).cast("string")
    for name, cond in reversed(order):
        setter = F.when(cond, F.lit(name)).otherwise(setter)
    #: flag -> setters that raise it, setters that lower it
    effects = {"in_select": (("select",), ("from",)), "in_where": (("from", "where"), ("select", "join", "group", "having", "order")), "in_join": (("join",), ("select", "where", "group", "having", "order")), "in_group": (("group",), ("select", "where", "having", "order")), "in_order": (("order",), ("select", "where"))}
    so_far = Window.partitionBy("query_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("setter", setter)
    for flag, (on, off) in effects.items():
        change = F.when(F.col("setter").isin(*on), True).when(F.col("setter").isin(*off), False)
        marked = marked.withColumn(flag, F.coalesce(F.last(change, True).over(so_far), F.lit(False)))
    first = F.when(F.col("setter") == "select", F.nullif(F.regexp_extract("up", T.CASED + r"ПЕРВЫЕ\s+(\d+)", 1), F.lit("")).cast("int"))
    starts = lambda words: F.lit(False) if not words else T.matches(u, "^(?:" + "|".join(words) + ")", cased=True)
    plain = F.col("setter").isNull() & (u != "")
    clause = (
        F.when(F.col("setter") == "having", "having")
        .when(first.isNotNull(), "first_n")
        .when(plain & F.col("in_select") & ~starts(["ПЕРВЫЕ"]), "fields")
        .when(plain & F.col("in_where") & ~starts(["ИЛИ", "И "]), "conditions")
        .when(plain & F.col("in_join"), "joins")
        .when(plain & F.col("in_group"), "group_by")
        .when(plain & F.col("in_order"), "order_by")
    )
    return marked.select("query_id", "line_no", clause.alias("clause"), "text", first.alias("first_n")).filter("clause IS NOT NULL")


def generate(requests: DataFrame) -> DataFrame:
    """description, object_name, generated_query from requests(description, object_name): one of four templates by keyword."""
    named = F.nullif("object_name", F.lit(""))
    out = F.lit(None).cast("string")
    for words, query, default in reversed(R.QUERY_TEMPLATES):
        text = F.lit(query) if default is None else F.concat(F.lit(query), F.coalesce(named, F.lit(default)))
        out = F.when(T.has_any(F.lower("description"), words), text).otherwise(out) if words else text
    return requests.select("description", "object_name", out.alias("generated_query"))
