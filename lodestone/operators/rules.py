"""Rule tables. Everything in this module is fixed values: the words, patterns, texts and limits that results depend on."""

from __future__ import annotations

# Query text patterns: id, severity, pattern (no regard to case), message, advice.
GENERIC_ADVICE = "Проверьте паттерн вручную"
QUERY_PATTERNS = (
    ("no_first", "warning", r"ВЫБРАТЬ\s+(?!РАЗЛИЧНЫЕ)(?!ПЕРВЫЕ)[\w\s,.*]+?\s+ИЗ", "Отсутствует ПЕРВЫЕ N — выборка всех записей", "Добавьте ПЕРВЫЕ 1000 (или нужное число)"),
    ("select_all", "info", r"ВЫБРАТЬ\s+(?!РАЗЛИЧНЫЕ)[\w\s,]*\.\*", "Используется SELECT * — рекомендуется явное перечисление полей", "Замените * на явный список полей"),
    ("no_where", "warning", r"ВЫБРАТЬ[\s\S]{0,200}?ИЗ\s+[\w\s,]+?\s+(?!ГДЕ)(?!ПЕРВЫЕ)(?!ORDER)", "Отсутствует фильтр ГДЕ — полная выборка таблицы", GENERIC_ADVICE),
    ("duplicate_left_join", "info", r"ЛЕВОЕ\tСОЕДИНЕНИЕ\s+([\w.]+)\s+\(([\w.]+)\s+ЛЕВОЕ\s+СОЕДИНЕНИЕ", "Возможна дублирующая левая связь — проверьте ключи", GENERIC_ADVICE),
    ("subquery_in_select", "warning", r"ВЫБРАТЬ\s+\(ВЫБРАТЬ", "Подзапрос в секции ВЫБРАТЬ — может быть медленным", "Рассмотрите СОЕДИНЕНИЕ вместо подзапроса"),
    ("string_compare", "info", r"(=|!=|<>)\s*['\"]", "Строковое сравнение в фильтре — используйте параметры", GENERIC_ADVICE),
    ("like_concat", "info", r"([\w.]+)\s+(НЕ\s+)?ПОДОБНО\s+['\"]", "Использование ПОДОБНО с константой — проверьте производительность", GENERIC_ADVICE),
    ("not_in_subquery", "warning", r"НЕ\s+В\s+\(ВЫБРАТЬ", "Использование НЕ В (ВЫБРАТЬ) — рассмотрите КАК НЕЛЬЗЯ или ЛЕВОЕ СОЕДИНЕНИЕ", "Используйте КАК НЕЛЬЗЯ вместо НЕ В (ВЫБРАТЬ)"),
    ("order_by_non_indexed", "info", r"ORDER\s+BY\s+([\w.]+)", "ORDER BY — убедитесь, что поле проиндексировано", GENERIC_ADVICE),
    ("no_group_having", "info", r"СГРУППИРОВАТЬ\s+ПО\s+([\w.]+)[\s\S]*?(?!HAVING)", "Группировка без HAVING — возможно, нужна дополнительная фильтрация", GENERIC_ADVICE),
    ("cast_in_where", "warning", r"ГДЕ\s+([\w.]+)\s+(НЕ\s+)?(ЗАМЕНИТЬ|ПРЕДСТАВИТЬИНТ|ПРЕДСТАВИТЬНОМЕР)\(", "Функция в ГДЕ по полю — индекс не будет использоваться", "Перенесите функцию из ГДЕ в вычисляемое поле"),
    ("empty_period", "info", r"([\w.]+)\s+(МЕЖДУ|>=|<=)\s+ПЕРВОЙДАТЫ\(ПЕРИОДА\)", "Проверьте обработку пустого периода", GENERIC_ADVICE),
    ("fetch_top_without_period", "warning", r"ПЕРВЫЕ\s+\d+\s*.*?ИЗ\s+[\w.]+\s+(?!ПЕРИОДА)", "ПЕРВЫЕ без ПЕРИОДА — может вернуть разные результаты при повторном запуске", GENERIC_ADVICE),
    ("max_rows_missing", "info", r"ВЫБРАТЬ\s+(?!РАЗЛИЧНЫЕ)(?!ПЕРВЫЕ)[\w\s,]+?\s+ИЗ\s+[\w.]+\s+ГДЕ\s+([\w.]+)\s+=", "Рекомендуется ограничить выборку ПЕРВЫЕ для больших таблиц", GENERIC_ADVICE),
    ("sync_call_pattern", "info", r"([\w.]+)\.([\w.]+)\s*=\s*([\w.]+)\.(.*)Запрос", "Возможна синхронная обработка — рассмотрите пакетную", GENERIC_ADVICE),
)
EMPTY_QUERY, NO_SELECT, NO_FROM = "Пустой запрос", "Запрос должен начинаться с ВЫБРАТЬ или ВЫБРАТЬ РАЗЛИЧНЫЕ", "В запросе отсутствует секция ИЗ"

# Query templates: words of the description, query text, and what stands behind it without an object name (None: nothing does).
QUERY_TEMPLATES = (
    (("остаток", "остатки"), "ВЫБРАТЬ * ИЗ Документ.уатПутевойЛист WHERE Дата >= ПОДСТАНОВКА('НачалоДня(ТекущаяДата()) - 1')", None),
    (("счет", "количество"), "ВЫБРАТЬ РАЗЛИЧНЫЕ Счет ИЗ Справочник.уатТС", None),
    (("список", "перечень"), "ВЫБРАТЬ ПЕРВЫЕ 100 * ИЗ Справочник.", "Номенклатура"),
    ((), "ВЫБРАТЬ * ИЗ ", "Справочник.Номенклатура"),
)

# Line rules.
DEPRECATED = (
    ("getformbyid", r"\.ПолучитьФорму\s*\(\s*\"?([\w]+)\"?\s*\)"),
    ("stringtrim", r"\.СтрДлина\s*\("),
    ("strreplace_old", r"\.СтрЗаменить\s*\("),
    ("strfind_old", r"\.СтрНайти\s*\("),
    ("strleft", r"\.СтрЛев\s*\("),
    ("strright", r"\.СтрПрав\s*\("),
    ("strmid", r"\.СтрПолучитьСтроку\s*\("),
    ("datepart", r"\.GetYear\s*\("),
    ("maxvalue_old", r"\.МаксЗнач\s*\("),
    ("minvalue_old", r"\.МинЗнач\s*\("),
)
DEPRECATED_MESSAGE = "Обнаружен устаревший метод: "
PASSWORDS = (
    r"(?:Пароль|Password|PWD)\s*=\s*['\"]([^'\"$]+)['\"]",
    r"['\"](?:password|passwd|pwd)\s*[:=]\s*['\"]([^'\"$]+)['\"]",
    r"(?:пароль|passwd)\s*:\s*['\"]([^'\"$]+)['\"]",
)
TOKENS = (
    r"(?:Token|TOKEN|token)\s*=\s*['\"]([a-zA-Z0-9_\-]{16,})['\"]",
    r"(?:API[_\s]?KEY|APIKEY|api_key)\s*[:=]\s*['\"]([^'\"$]+)['\"]",
)
PASSWORD_MESSAGE, TOKEN_MESSAGE, LEAST_PASSWORD = "Обнаружен хардкод пароля", "Обнаружен хардкод токена/ключа API", 4
FULL_SELECTION_MESSAGE = "Цикл по полной выборке без ПЕРВЫЕ"
PERSONAL = (
    ("passport number", r"(\d{3}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{4})"),
    ("INN/KPP number", r"\b\d{10,12}\b"),
    ("PI reference", r"(ФИО|fio|fullname)"),
)
SYNC_CALLS = (
    (r"Запрос\.Выполнить\(\)", "AsyncQuery.Execute()"),
    (r"\.Выбрать\(\)", "ВыбратьДвижения().Загрузить()"),
    (r"\.ПолучитьФорму\(", "ОжидатьФорму()"),
)
ACCESS_WORDS = ("Допустимость", "RLS", "restrict", "доступ")
ENTRY_POINTS = ("ПриНачалеРаботыСистемы", "ПриИзмененииДанных", "ПриЗаписи", "ПередЗаписью", "ПередУдалением", "НаЭкране", "ПолучениеДанных")

# Complexity and limits.
FUNCTION_HEADER = r"^\s*(Процедура|Функция)\s+(\w+)"
BRANCH_WORDS = ("Если", "Цикл", "Для", "Пока", "Исключение", "When", "For", "While", "Try")
MAX_COMPLEXITY, MAX_LINES, MAX_FUNCTIONS, DUPLICATE_LINES = 10, 500, 50, 10

# Type directories of a dump and their types: the parser's map, and the graph's.
PARSER_TYPES = {
    "Catalogs": "Catalog", "Documents": "Document", "InformationRegisters": "InformationRegister", "AccumulationRegisters": "AccumulationRegister",
    "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicType", "Constants": "Constant", "Reports": "Report",
    "BusinessProcesses": "BusinessProcess", "ScheduledJobs": "ScheduledJob", "CommonModules": "CommonModule", "CommonForms": "CommonForm",
    "CommonCommands": "CommonCommand", "CommonAttributes": "CommonAttribute", "DocumentJournal": "DocumentJournal",
}
GRAPH_TYPES = {
    "Catalogs": "Catalog", "Documents": "Document", "DocumentJournals": "DocumentJournal", "InformationRegisters": "InformationRegister",
    "AccumulationRegisters": "AccumulationRegister", "AccountingRegisters": "AccountingRegister", "CalculationRegisters": "CalculationRegister",
    "ChartsOfAccounts": "ChartOfAccounts", "ChartsOfCharacteristicTypes": "ChartOfCharacteristicType", "ChartsOfCalculationTypes": "ChartOfCalculationType",
    "Constants": "Constant", "Reports": "Report", "DataProcessors": "DataProcessor", "BusinessProcesses": "BusinessProcess", "Tasks": "Task",
    "Enums": "Enum", "ExchangePlans": "ExchangePlan", "ScheduledJobs": "ScheduledJob", "Sequences": "Sequence", "SettingsStorages": "SettingsStorage",
    "CommonModules": "CommonModule", "CommonForms": "CommonForm", "CommonCommands": "CommonCommand", "CommonAttributes": "CommonAttribute",
    "CommonTemplates": "CommonTemplate", "CommonPictures": "CommonPicture", "DefinedTypes": "DefinedType", "EventSubscriptions": "EventSubscription",
    "FilterCriteria": "FilterCriterion", "FunctionalOptions": "FunctionalOption", "FunctionalOptionsParameters": "FunctionalOptionParameter",
    "Roles": "Role", "Subsystems": "Subsystem", "WSReferences": "WSReference", "XDTOPackages": "XDTOPackage",
}
NOT_ORPHANS = ("Subsystem", "CommonModule", "CommonForm", "CommonCommand", "CommonAttribute")
SKIPPED_DIRS = ("Ext", "Descriptions", ".git")
MODULE_KINDS = (
    (("ObjectModule",), "ObjectModule"), (("ManagerModule",), "ManagerModule"), (("Form", "Module"), "FormModule"), (("CommandModule",), "CommandModule"),
    (("CallCenter",), "CallCenter"), (("OrdinaryApplication",), "OrdinaryApplicationModule"), (("ManagedApplication",), "ManagedApplicationModule"),
    (("ExternalConnection",), "ExternalConnectionModule"), (("Session",), "SessionModule"),
)

#: Folders of an object and what they hold.
MEMBER_GROUPS = {"Forms": "Form", "Commands": "Command", "Templates": "Template"}

# Graph scanner patterns.
NAME, NAME_PART = "[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*", "[A-Za-zА-Яа-яЁё0-9_]"
PROCEDURE = rf"^\s*(?:процедура|функция|proc|func)\s+({NAME_PART}+)"
PROCEDURE_END = r"^\s*(?:конецпроцедуры|конецфункции|endprocedure|endfunction)"
NOT_CALLS = (
    "если", "иначе", "иначеесли", "конецесли", "тогда", "цикл", "конеццикла", "попытка", "исключение", "конецпопытки", "вызватьисключение",
    "прервать", "продолжить", "возврат", "новый", "перейти", "выполнить",
)
COLLECTIONS = {
    "РегистрыНакопления": "AccumulationRegister", "РегистрыСведений": "InformationRegister", "РегистрыБухгалтерии": "AccountingRegister",
    "РегистрыРасчета": "CalculationRegister", "Справочники": "Catalog", "Документы": "Document", "Отчеты": "Report", "Обработки": "DataProcessor",
    "Перечисления": "Enum", "ПланыСчетов": "ChartOfAccounts", "ПланыВидовХарактеристик": "ChartOfCharacteristicType", "ПланыОбмена": "ExchangePlan",
    "ПланыВидовРасчета": "ChartOfCalculationType", "БизнесПроцессы": "BusinessProcess", "Задачи": "Task", "Константы": "Constant",
}
MOVEMENT_TYPE = "AccumulationRegister"
QUERY_TABLES = (
    "справочник", "документ", "регистрсведений", "регистрнакопления", "регистрбухгалтерии", "регистррасчета", "перечисление", "плансчетов",
    "планвидовхарактеристик", "планобмена", "планвидоврасчета", "бизнеспроцесс", "задача", "пакет", "константа",
)

# Artifacts.
MAGICS = ("FFFFFF7F00020000", "1F8B", "504B", "D0CF11E0")
EXPECTED_PARTS = ("Ext/ObjectModule.bsl", "Ext/ManagerModule.bsl", "Ext/ExternalDataHandlers.bsl", "Forms/")
COMPARED_SUFFIXES = ("bsl", "xml", "frm")
REQUIRED_DIRS = ("Catalogs", "Documents", "CommonModules")
VERSION_PATTERN = r'Вери(\w*?)сь\s*=\s*"([^"]+)"'

# Registry: names known to exist and to be absent (functions by kind), manager methods, synonyms, disproved names.
REGISTRY_FILE_KEYS = {"functions": "global_functions", "methods": "catalog_manager_methods", "synonyms": "verified_synonyms_ru_en", "disproved": "synonyms_disproved"}
