"""Fixed texts: templates, catalogues of commands, checklists, and the answers of tools that are not implemented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_values as V

# File -> text of generated skeletons; {name} is the object's name.
EPF_FILES = {"Ext/ObjectModule.bsl": '#ИмяОбработки = "{name}"', "Ext/ManagerModule.bsl": "// ManagerModule for {name}", "Forms/Форма/Ext/Form.xml": "<Форма>", "Forms/Форма/Module.bsl": "// FormModule"}
TEMPLATES = {
    "external_processor": {
        "Ext/ObjectModule.bsl": '#ИмяОбработки = "{name}"\n#Область\nПроцедура ПриОткрытии(Отказ)\nКонецПроцедуры',
        "Ext/ManagerModule.bsl": "#Область\nПроцедура Обработать(Параметры)\nКонецПроцедуры",
        "Forms/Форма/Ext/Form.xml": "<Форма>\n  <Вид>Диалог</Вид>\n</Форма>",
        "Commands/Create.bsl": "#Область\nПроцедура Create(Команда)\nКонецПроцедуры",
    },
    "report": {"Ext/ObjectModule.bsl": '#ИмяОтчёта = "{name}"\nПроцедура ПриСозданииНаСервере(Отказ, data)\nКонецПроцедуры', "Ext/ManagerModule.bsl": "// ManagerModule"},
}
TESTS = {
    "unit": "// Generated test for {name}\n// Framework: YAxUnit / Vanessa-Automation\n\nФункция ТестСоздание{name}(Отказ)\n    \n    Попытка\n        Объект = Документы.{name}.СоздатьДокумент();\n        Объект.Дата = ТекущаяДата();\n        Объект.Записать(РежимЗаписиДокумента.Проведение);\n        \n        Возврат Истина;\n    Исключение\n        Отказ = Истина;\n        Сообщить(ОписаниеОшибки());\n        Возврат Ложь;\n    КонецПопытки;\n    \nКонецФункции // ТестСоздание{name}\n",
    "integration": "// Integration test for {name}\n// Framework: Vanessa-Automation\n\nФункция ИнтеграционныйТест{name}()\n    \n    // TODO: Add integration test logic\n    // 1. Prepare test data\n    // 2. Execute operation\n    // 3. Verify results\n    // 4. Cleanup\n    \n    Возврат Истина;\n    \nКонецФункции // ИнтеграционныйТест{name}\n",
}
PRINT_FORM = '// Print form template for {name}\n// Uses УправлениеПечатью framework\n\nПроцедура Печать(Отказ)\n    \n    КомандаПечати = Новый КомандаПечати;\n    КомандаПечати.Команда = Печать.ПолучитьКомандуПечати("{name}");\n    \n    ТабличныйДокумент = Новый ТабличныйДокумент;\n    Макет = Объект.ПолучитьМакет("Печать");\n    \n    // TODO: Add print layout template\n    \n    КомандаПечати.ТабличныйДокумент = ТабличныйДокумент;\n    КомандаПечати.Исполнитель = Справочники.Пользователи.ТекущийПользователь();\n    \n    Печать.Выполнить(КомандаПечати);\n    \nКонецПроцедуры // Печать\n'
REPORT = {"metadata": "Создайте отчёт '{name}' с источником данных", "query": "ВЫБРАТЬ * ИЗ {name}", "groups": "Поля для группировки", "fields": "Поля для вывода"}
CHECKLIST = (
    ("Queue leak", "manual_review", "Review all Continue statements in exchange loops"),
    ("Transaction boundary", "manual_review", "Verify all BeginTransaction have corresponding Commit"),
    ("Loading flag", "manual_review", "Verify loading flag before writes in event handlers"),
    ("Security", "auto", "Run audit.security tool"),
)
NOT_IMPLEMENTED = ("meta.find_undefined_refs", "query.check_fields", "form.find_orphans", "skd.check_fields", "mxl.audit", "epf.roundtrip_check")


#: Options whose values are secret.
SECRET_OPTIONS = ("--password", "--db-pwd", "--db-pwd-file")


def _filled(names: DataFrame, texts: dict[str, str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("file"), F.replace(F.lit(t), F.lit("{name}"), F.col("name")).alias("text")) for k, t in texts.items()]))
    return names.select("name", rows.alias("r")).select("name", "r.file", "r.text")


def epf_generate(names: DataFrame) -> DataFrame:
    return _filled(names, EPF_FILES)


def template_apply(names: DataFrame, template: str) -> DataFrame:
    if template not in TEMPLATES:
        raise ValueError(f"Unknown template: {template}. Available: {', '.join(TEMPLATES)}")
    return _filled(names, TEMPLATES[template])


def generate_test(names: DataFrame, test_type: str = "unit") -> DataFrame:
    return _filled(names, {"test": TESTS.get(test_type, "// Test template for {name} (" + test_type + ")")})


def generate_print_form(names: DataFrame) -> DataFrame:
    return _filled(names, {"print_form": PRINT_FORM})


def generate_report(names: DataFrame) -> DataFrame:
    return _filled(names, REPORT)


#: Answers that depend on no input (fixed values).
FIXED_ANSWERS = (
    ("query.check_fields", "query", "valid", "Full field validation requires detailed metadata"),
    ("epf.roundtrip_check", "validate_epf", "ok", ""),
    ("epf.roundtrip_check", "build_epf", "skipped", "Requires 1C server access"),
    ("epf.roundtrip_check", "dump_epf", "skipped", "Requires 1C server access"),
    ("epf.roundtrip_check", "compare", "skipped", "Requires dump completion"),
    ("skd.check_fields", "report", "noted", "Full SKD field validation requires SKD XML parsing"),
)


def checklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHECKLIST), "check string, status string, note string")


def not_implemented(spark: SparkSession) -> DataFrame:
    """Tools whose answer is that there is none: a zero must not read as clean."""
    return spark.createDataFrame([(t, "not_implemented") for t in NOT_IMPLEMENTED], "tool string, status string")


def fixed_answers(spark: SparkSession) -> DataFrame:
    """tool, step, status, note: what the tools answer that look at no file; steps that need the vendor's program are skipped."""
    return spark.createDataFrame(list(FIXED_ANSWERS), "tool string, step string, status string, note string")


def capabilities(spark: SparkSession) -> DataFrame:
    """runner and the catalogue's columns."""
    rows = [("designer", *r) for r in V.DESIGNER] + [("ibcmd", *r) for r in V.IBCMD]
    return spark.createDataFrame(rows, "runner string, name string, executable string, command string, mutates_infobase boolean, needs_exclusive_access boolean, description string, source string")


def command_checks(commands: DataFrame) -> DataFrame:
    """command, known, mutating: whether an argument line is one of the infobase utility's commands, and one that mutates."""
    is_one = lambda c: (F.col("command") == c) | F.col("command").startswith(c + " ")
    known, mutating = F.col("command").startswith("help "), F.lit(False)
    for _, _, command, mutates, *_ in V.IBCMD:
        known = known | is_one(command)
        mutating = mutating | is_one(command) if mutates else mutating
    return commands.select("command", known.alias("known"), mutating.alias("mutating"))


def redacted(commands: DataFrame) -> DataFrame:
    """arguments (array) with the values of secret options replaced."""
    secret = lambda x: x.isin(*SECRET_OPTIONS)
    hide = lambda x, i: (i > 0) & F.coalesce(secret(F.try_element_at("arguments", i)), F.lit(False))
    joined = lambda x: F.concat(F.substring_index(x, "=", 1), F.lit("=[REDACTED]"))
    one = lambda x, i: F.when(hide(x, i), F.lit("[REDACTED]")).when(secret(F.substring_index(x, "=", 1)) & x.contains("="), joined(x)).otherwise(x)
    return commands.withColumn("arguments", F.transform("arguments", one))
