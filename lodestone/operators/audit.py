"""Rule-based audits over modules(path, content): every rule of a pass is evaluated on a line or a file at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics
from . import rules as R

def _content() -> Column:
    return F.col("content")


def _low(column: Column | str = "content") -> Column:
    return F.lower(column)


# line rules


def security(modules: DataFrame) -> DataFrame:
    """path, line_no, rule_id, message, text: one row per rule that hits a line; comments are left out."""
    line = F.col("text")
    flags = [(F.length(T.extract(line, p, 1)) >= R.LEAST_PASSWORD, {"rule_id": "hardcoded_password", "message": R.PASSWORD_MESSAGE}) for p in R.PASSWORDS]
    flags += [(T.matches(line, p), {"rule_id": "hardcoded_token", "message": R.TOKEN_MESSAGE}) for p in R.TOKENS]
    found = T.lines(modules).filter(~T.is_comment(line)).select("path", "line_no", T.strip(line).alias("text"), T.hits(flags).alias("h"))
    return found.select("path", "line_no", "h.rule_id", "h.message", "text")


def deprecated_api(modules: DataFrame) -> DataFrame:
    line = F.col("text")
    flags = [(T.matches(line, p), {"rule_id": n, "message": R.DEPRECATED_MESSAGE + n}) for n, p in R.DEPRECATED]
    found = T.lines(modules).select("path", "line_no", T.strip(line).alias("text"), T.hits(flags).alias("h"))
    return found.select("path", "line_no", "h.rule_id", "h.message", "text")


def _look_back(modules: DataFrame, here: Column, before: Column, rows: int) -> DataFrame:
    """path, line_no, text of lines with `here` and whether one of the `rows` lines before has `before`.

    The window carries flags, and text only where it may be reported.
    """
    frame = metrics.in_file().rowsBetween(-rows, -1)
    flagged = T.lines(modules).select("path", "line_no", here.alias("here"), before.alias("before"), F.when(here, T.strip(F.col("text"))).alias("text"))
    return flagged.withColumn("seen", F.coalesce(F.bool_or("before").over(frame), F.lit(False))).filter("here")


def code_antipatterns(modules: DataFrame) -> DataFrame:
    """A full selection without ПЕРВЫЕ in the five lines before."""
    line = F.col("text")
    found = _look_back(modules, line.contains("Выбрать()"), line.contains("ПЕРВЫЕ"), 5).filter("NOT seen")
    return found.select("path", "line_no", F.lit("loop_full_selection").alias("rule_id"), F.lit(R.FULL_SELECTION_MESSAGE).alias("message"), "text")


def modal_calls(modules: DataFrame) -> DataFrame:
    line = F.col("text")
    return T.lines(modules).filter(T.has_any(line, ("ОткрытьМодально", "ОткрытьФорму"))).select("path", "line_no", T.strip(line).alias("text"))


def find_refs(modules: DataFrame, name: str) -> DataFrame:
    """path, line_no, text of lines, comments apart, that hold the name in any case."""
    line = F.col("text")
    return T.lines(modules).filter(F.lower(line).contains(name.lower()) & ~T.is_comment(line)).select("path", "line_no", T.strip(line).alias("text"))


def ref_counts(modules: DataFrame, name: str) -> DataFrame:
    return find_refs(modules, name).groupBy("path").agg(F.count("*").alias("cnt"))


# file rules


def e1_e9(modules: DataFrame, max_modules: int | None = None) -> DataFrame:
    """defect, path, line_no, note of five rule groups over all files, or over the first max_modules ones in path order."""
    if max_modules:
        modules = modules.orderBy("path").limit(max_modules)
    line = F.col("text")
    suspect = modules.filter(_content().contains("Продолжить") & T.has_any(_content(), ("Цикл", "Выбрать")))
    leaks = _look_back(suspect, line.contains("Продолжить") & ~line.contains("//"), T.has_any(line, ("Цикл", "Выбрать", "Обмен", "Continue")), 10).filter("seen")
    leaks = leaks.select(F.lit("queue_leak").alias("defect"), "path", "line_no", F.lit(None).cast("string").alias("note"))
    row = lambda defect, line_no, note: {"defect": defect, "line": line_no, "note": note}
    low = _low()
    flags = [
        (T.has_any(low, ("snake", "_address", "_time", "_type")) & (T.has_any(_content(), ("Получить", "Нормализ")) | low.contains("convert")), row("case_mismatch", "1", "Possible snake_case to PascalCase mapping issue")),
        (T.has_any(_content(), ("НачатьТранзакцию", "ЗафиксироватьТранзакцию")), row("transaction_boundary", None, "Transaction blocks found — verify isolation")),
        (T.has_any(_content(), ("Загрузка", "ОбменДанными")) & T.has_any(_content(), ("ПриЗаписи", "ПередЗаписью")), row("loading_flag", None, "Write event handlers found — verify loading flag")),
        (T.has_any(_content(), ("КИП", "КТГ", "КВЛ", "KPI")) & T.has_any(_content(), ("Регистратор", "Registrar", "Document")), row("kpi_logic", None, "KPI calculation found — verify source document filter")),
    ]
    files = modules.select("path", T.hits(flags).alias("h")).select("h.defect", "path", F.col("h.line").cast("int").alias("line_no"), "h.note")
    return leaks.unionByName(files)


def e1_e9_summary(modules: DataFrame, max_modules: int | None = None) -> DataFrame:
    """files_scanned, findings: how many files the five rule groups looked at, and what they found in all."""
    scanned = modules.agg(F.count("*").alias("n")).select((F.least("n", F.lit(max_modules)) if max_modules else F.col("n")).cast("long").alias("files_scanned"))
    return scanned.crossJoin(e1_e9(modules, max_modules).agg(F.count("*").alias("findings")))  # one row each


def _per_file(modules: DataFrame, flags: list[tuple[Column, dict[str, str]]]) -> DataFrame:
    return modules.select("path", T.hits(flags).alias("h")).select("path", "h.issue", "h.defect")


def rnd_flag(modules: DataFrame) -> DataFrame:
    bad = T.has_any(_content(), ("ПриЗаписи", "ПередЗаписью")) & ~_content().contains("Загрузка") & ~_low().contains("loading")
    return _per_file(modules, [(bad, {"issue": "Write event handler without loading flag check", "defect": "loading_flag"})])


def transaction_boundary(modules: DataFrame) -> DataFrame:
    begin, commit = _content().contains("НачатьТранзакцию"), _content().contains("ЗафиксироватьТранзакцию")
    say = lambda a, b: {"issue": f"{a} without {b}", "defect": "transaction_boundary"}
    return _per_file(modules, [(begin & ~commit, say("НачатьТранзакцию", "ЗафиксироватьТранзакцию")), (commit & ~begin, say("ЗафиксироватьТранзакцию", "НачатьТранзакцию"))])


def rls_modules(modules: DataFrame) -> DataFrame:
    """path, matches: the first access word that a module holds, in any case."""
    first = F.coalesce(*[F.when(_low().contains(w.lower()), F.lit(w)) for w in R.ACCESS_WORDS])
    return modules.select("path", first.alias("matches")).filter("matches IS NOT NULL")


def version_check(modules: DataFrame, help_rows: list[tuple[str, str, str, str]], target: str) -> DataFrame:
    """path, function, introduced, target_version; versions are compared as strings."""
    newer = [(_content().contains(n), {"function": n, "introduced": since}) for n, _, _, since in help_rows if since > target]
    if not newer:
        return modules.limit(0).select("path", F.lit("").alias("function"), F.lit("").alias("introduced"), F.lit(target).alias("target_version"))
    return modules.select("path", T.hits(newer).alias("h")).select("path", "h.function", "h.introduced", F.lit(target).alias("target_version"))


# corpus flags: what occurs anywhere in the corpus (by=None) or in each group


def flags(modules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One boolean column per word of CORPUS_WORDS, over the corpus or per group; partial aggregates only."""
    aggs = [F.coalesce(F.bool_or((_low() if lower else _content()).contains(word)), F.lit(False)).alias(name) for name, (word, lower) in CORPUS_WORDS.items()]
    aggs += [F.coalesce(F.bool_or(T.matches(_content(), p, cased=True)), F.lit(False)).alias(f"sync_{i}") for i, (p, _) in enumerate(R.SYNC_CALLS)]
    return modules.groupBy(*(by or [])).agg(*aggs)


#: Column -> (word, whether case is ignored).
CORPUS_WORDS = {
    "exchange": ("Обмен", False), "exchange_en": ("Exchange", False), "skip": ("Продолжить", False), "reg": ("рег.", True), "unregister": ("unregister", True),
    "records": ("records", False), "value": ("value", False), "key": ("key", False), "base64": ("Base64", False), "base64_low": ("base64", False),
    "snake": ("snake", True), "underscore": ("_", False), "get": ("Получить", False), "normalize": ("Нормализ", False), "code": ("Код", False),
    "write": ("Записать", False), "create": ("СоздатьДокумент", False), "unique": ("ПроверитьУникальность", False), "find": ("НайтиПоРеквизиту", False),
    "json": ("JSON", False), "json_low": ("json", False), "routing": ("routing", True), "try": ("Попытка", False), "except": ("Исключение", False),
    "again": ("Повтор", False), "retry": ("retry", True), "count": ("count", True), "cancel": ("Отмена", False), "cancel_en": ("cancel", True),
    "posting": ("Проведение", False), "posting_en": ("posting", True), "history": ("ИсторияОбменов", False), "loading": ("Загрузка", False),
    "on_write": ("ПриЗаписи", False), "before_write": ("ПередЗаписью", False), "loaded": ("загружено", True), "source": ("source", True),
}

_HANDLER = "(on_write OR before_write)"
#: rule set -> [(condition over the flags, issue, message)]
CORPUS_RULES = {
    "tms_integration": [
        ("exchange AND skip AND (NOT reg OR NOT unregister)", "queue_leak", "Continue in exchange loop — verify registration removal"),
        ("records AND (value OR key) AND (base64 OR base64_low)", "transport_contract", "Base64 decoding found — verify JSON vs binary contract"),
        ("(snake OR underscore) AND (get OR normalize)", "case_mismatch", "Possible case mapping issue in data conversion"),
        ("code AND (write OR create) AND NOT unique AND NOT find", "idempotency", "Write without uniqueness check"),
    ],
    "kshd_contract": [
        ("records AND value AND NOT json AND NOT json_low", "transport_contract", "records value decoding — verify JSON vs Base64"),
        ("routing", "routing_coverage", "Message routing found — verify all types are handled"),
    ],
    "retry_policy": [
        ("try AND except AND NOT again AND NOT retry AND NOT count", "no_retry_counter", "No retry counter found in Попытка block"),
        ("try AND NOT except", "no_handler", "Попытка without Исключение"),
    ],
    "cascade": [
        ("(cancel OR cancel_en) AND NOT posting AND NOT posting_en", "no_posting_reversal", "Cancellation found without posting reversal"),
        ("(cancel OR cancel_en) AND NOT history", "no_history", "Cancellation without exchange history update"),
    ],
    "loop_prevention": [
        (f"NOT loading AND {_HANDLER}", "no_loading_flag", "No loading flag — incoming data may trigger outgoing registration"),
        ("(exchange OR exchange_en) AND NOT loaded AND NOT source", "no_source", "No source differentiation for incoming changes"),
    ],
    "convert_to_async": [(f"sync_{i}", p, a) for i, (p, a) in enumerate(R.SYNC_CALLS)],
}


def corpus_rules(modules: DataFrame, rule_set: str, by: list[str] | None = None) -> DataFrame:
    """issue, message of the rules that hold over the corpus, or (by=['path']) in each module."""
    rows = [(F.expr(cond), {"issue": issue, "message": message}) for cond, issue, message in CORPUS_RULES[rule_set]]
    return flags(modules, by).select(*(by or []), T.hits(rows).alias("h")).select(*(by or []), "h.issue", "h.message")


#: rule set -> (name of its verdict, condition over the flags for it to hold)
VERDICTS = {
    "kshd_contract": ("contract_compliant", None), "cascade": ("cascade_safe", None), "loop_prevention": ("loop_prevention", None),
    "retry_policy": ("retry_policy_defined", "NOT (try AND except AND NOT again AND NOT retry AND NOT count)"),
}


def corpus_verdict(modules: DataFrame, rule_set: str, by: list[str] | None = None) -> DataFrame:
    """The rule set's boolean: no rule holds, or the set's own condition."""
    name, condition = VERDICTS[rule_set]
    condition = condition or " AND ".join(f"NOT ({c})" for c, _, _ in CORPUS_RULES[rule_set])
    return flags(modules, by).select(*(by or []), F.expr(condition).alias(name))


def mentions(modules: DataFrame, pattern: str) -> DataFrame:
    """How often a pattern occurs in the corpus."""
    return modules.agg(F.coalesce(F.sum(F.regexp_count("content", F.lit(T.CASED + pattern))), F.lit(0)).alias("cnt"))


def xdto_references(modules: DataFrame) -> DataFrame:
    return mentions(modules, "ТипXDTO|XDTO|ОписаниеТипов")


def modal_opens(modules: DataFrame) -> DataFrame:
    return mentions(modules, r"\.ОткрытьМодально\(\)")


def list_commands(modules: DataFrame) -> DataFrame:
    """path, pos, command of every command handler."""
    found = F.posexplode(T.extract_all(_content(), r"Процедура\s+Команда(\w+)", 1, cased=True))
    return modules.select("path", found.alias("pos", "command"))


def personal_data(modules: DataFrame, samples: int = 5) -> DataFrame:
    """pattern, cnt, samples (distinct ones of the first matches in path order, sorted, joined by '|').

    Modules are looked at one by one: a match never spans two files.
    """
    name = F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), T.extract_all(_content(), p).alias("found")) for n, p in R.PERSONAL])).alias("r")
    found = modules.select("path", name).filter(F.size("r.found") > 0).select("path", "r.pattern", F.size("r.found").alias("n"), F.slice("r.found", 1, samples).alias("found"))
    total = found.groupBy("pattern").agg(F.sum("n").alias("cnt"))
    first = Window.partitionBy("pattern").orderBy("path")
    few = found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= samples)  # every row has a match
    few = few.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("path", "found"))).alias("f"))
    few = few.select("pattern", F.array_join(F.sort_array(F.array_distinct(F.slice(F.flatten("f.found"), 1, samples))), "|").alias("samples"))
    return total.join(few, "pattern").select("pattern", "cnt", "samples")


def dead_code(modules: DataFrame) -> DataFrame:
    """name, path of functions whose name is no substring of another module.

    A name is a run of word characters, so it lies inside a word of the other module: names are joined to substrings of the
    corpus's distinct words, not to every module. Substrings are made only where a name's first letters stand, and only of
    the lengths that names with these letters have.
    """
    defined = modules.select("path", F.explode(T.extract_all(_content(), r"(Процедура|Функция)\s+(\w+)", 2, cased=True)).alias("name"))
    defined = defined.groupBy("name").agg(F.min("path").alias("path")).filter(~F.col("name").isin(*R.ENTRY_POINTS))
    words = modules.select("path", F.explode(F.array_distinct(T.extract_all(_content(), r"\w+", 0, cased=True))).alias("word"))
    words = words.groupBy("word").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    heads = defined.select(F.substring("name", 1, 3).alias("head"), F.length("name").alias("l")).groupBy("head").agg(F.collect_set("l").alias("ls"))
    parts = words.select("word", "lo", "hi", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    parts = parts.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).filter(F.col("s") + F.col("k") - 1 <= F.length("word"))
    parts = parts.withColumn("head", F.substring("word", F.col("s"), F.col("k"))).join(heads, "head")
    parts = parts.select("word", "lo", "hi", "s", F.explode("ls").alias("l")).filter(F.col("s") + F.col("l") - 1 <= F.length("word"))
    inside = parts.select(F.substring("word", F.col("s"), F.col("l")).alias("name"), "lo", "hi").groupBy("name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    alive = (F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path"))
    return defined.join(inside, "name", "left").filter(~F.coalesce(alive, F.lit(False))).select("name", "path")


def bulk_analyze(modules: DataFrame, min_lines: int = R.DUPLICATE_LINES) -> DataFrame:
    """One row: secrets, duplicate blocks over the corpus, largest complexity, functions."""
    m = metrics.quality_metrics(modules).select("max_cyclomatic_complexity", "total_functions")
    s = security(modules).agg(F.count("*").alias("security_issues"))
    d = metrics.duplicates_in_corpus(modules, min_lines).agg(F.count("*").alias("duplicates"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(s).join(one(d), "_k").join(one(m), "_k").select("security_issues", "duplicates", F.col("max_cyclomatic_complexity").alias("max_complexity"), "total_functions")


