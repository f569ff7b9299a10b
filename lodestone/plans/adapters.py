"""Adapters from the relational test tables to the inputs of the operators, in Spark and as SQL on the same tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A line of code per event; the text works in both engines.
EVENT_LINE = """CASE
  WHEN event_type = 'signup' THEN concat('Процедура Обработка', event_id, '(Отказ)')
  WHEN event_type = 'view' THEN concat('    Если Значение > ', event_id % 100, ' Тогда')
  WHEN event_type = 'click' THEN '    Выборка = Результат.Выбрать();'
  WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN concat('    Пароль = "secret', event_id, '";')
  WHEN event_type = 'purchase' AND event_id % 4 = 1 THEN '    НачатьТранзакцию();'
  WHEN event_type = 'purchase' AND event_id % 4 = 2 THEN '    Продолжить;'
  WHEN event_type = 'purchase' THEN '    ВЫБРАТЬ ПЕРВЫЕ 10'
  WHEN event_id % 3 = 0 THEN 'КонецПроцедуры'
  WHEN event_id % 3 = 1 THEN '    // комментарий Цикл'
  ELSE '    Для Каждого Строка Из Данные Цикл' END"""

#: A line of code per order: procedures, calls, references of all kinds, queries, integration words.
ORDER_LINE = """CASE CAST(o_orderkey % 20 AS INT)
  WHEN 0 THEN concat('Процедура Проц', o_orderkey % 37, '(Отказ)')
  WHEN 1 THEN concat('    Движения.Supplier', o_custkey % 10, '.Записать();')
  WHEN 2 THEN '    Справочники.ASIA.НайтиПоКоду(1); Справочники.Нет.Выбрать();'
  WHEN 3 THEN concat('    Проц', o_orderkey % 37, '(Отказ);')
  WHEN 4 THEN 'КонецПроцедуры'
  WHEN 5 THEN concat('    Запрос', o_orderkey % 3, ' = Новый Запрос;')
  WHEN 6 THEN concat('    Запрос.Текст = ~~~ВЫБРАТЬ Поле.* ИЗ Справочник.ASIA ГДЕ Код = ', chr(39), o_orderkey % 7, chr(39), '~~~;')
  WHEN 7 THEN concat('    // Проц', o_orderkey % 37, '(комментарий)')
  WHEN 8 THEN concat('    Part', o_custkey % 20, '.Метод(Параметр); europe.Метод()')
  WHEN 9 THEN '    Попытка'
  WHEN 10 THEN '    Исключение'
  WHEN 11 THEN '    records value Base64 Получить_snake routing'
  WHEN 12 THEN '    Если Обмен Тогда ПередЗаписью(Отказ); ЗафиксироватьТранзакцию();'
  WHEN 13 THEN concat('    Отмена = Истина; token = "', CASE WHEN o_orderkey % 3 = 0 THEN 'abcdefghijklmnop' ELSE 'short' END, '"; Загрузка')
  WHEN 14 THEN concat('    Текст = "ВЫБРАТЬ * ИЗ Документ.', CASE WHEN o_orderkey % 2 = 0 THEN 'FRANCE' ELSE 'China.Строки' END, '";')
  WHEN 15 THEN '    Результат = Запрос.Выполнить(); XDTO(1); ФИО = fio; Форма.ОткрытьМодально()'
  WHEN 16 THEN concat('    Объект.СтрДлина (', 1000000000 + o_orderkey, '); КПИ KPI Document RLS')
  WHEN 17 THEN concat('Процедура Команда', o_orderkey % 11, '()')
  WHEN 18 THEN '    Код = 1; Записать(); source'
  ELSE concat('    Запрос.Текст = ~~~ВЫБРАТЬ (ВЫБРАТЬ 1) ИЗ Т ORDER BY Поле', o_orderkey % 5, '~~~;') END"""

#: Three double quotes, as the texts of queries begin and end.
ORDER_LINE = ORDER_LINE.replace("~~~", '"' * 3)


def _joined(df: DataFrame, key: str, line: str, order: str, path: str) -> DataFrame:
    lines = df.select(F.expr(path).alias("path"), F.struct(F.col(order).alias("o"), F.expr(line).alias("l")).alias("s"))
    return lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["l"]), "\n").alias("content"))


EVENT_PATH = "concat('CommonModules/U', user_id, '/Ext/Module.bsl')"
ORDER_PATH = """CASE WHEN o_custkey % 9 = 0 THEN concat('CommonModules/Part', o_custkey % 40, '/Ext/Module.bsl')
  WHEN o_custkey % 9 = 1 THEN concat('Session', o_custkey % 5, 'Module.bsl') WHEN o_custkey % 9 = 2 THEN concat('Catalogs/ASIA/Forms/Form', o_custkey % 6, '/Module.bsl')
  WHEN o_custkey % 9 = 3 THEN concat('Reports/Unknown', o_custkey % 4, '/Ext/ObjectModule.bsl') ELSE concat('InformationRegisters/Customer', o_custkey, '/Ext/ManagerModule.bsl') END"""


def modules_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(table(spark, sf_dir, "events"), "user_id", EVENT_LINE, "event_id", EVENT_PATH)


def modules_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(table(spark, sf_dir, "orders"), "o_custkey", ORDER_LINE, "o_orderkey", ORDER_PATH)


def lines_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ord, text: the lines of modules_from_orders as rows; ord is their order in a module."""
    return table(spark, sf_dir, "orders").select(F.expr(ORDER_PATH).alias("path"), F.col("o_orderkey").alias("ord"), F.expr(ORDER_LINE).alias("text"))


def modules_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".bsl"))).alias("path"), F.col("text").alias("content"))


EVENT_MODULES = f"SELECT path, string_agg(l, chr(10) ORDER BY event_id) AS content FROM (SELECT {EVENT_PATH} AS path, event_id, {EVENT_LINE} AS l FROM events) GROUP BY path"
ORDER_MODULES = f"SELECT path, string_agg(l, chr(10) ORDER BY o_orderkey) AS content FROM (SELECT {ORDER_PATH} AS path, o_orderkey, {ORDER_LINE} AS l FROM orders) GROUP BY path"
DOCUMENT_MODULES = "SELECT concat(source, '/', lang, '/', doc_id, '.bsl') AS path, text AS content FROM documents"

#: type directory, type, name, code, description, subsystem, order: regions, nations, customers, suppliers, parts as objects.
OBJECTS = """SELECT type_dir, type, name, code, description, subsystem, CAST(ord AS BIGINT) AS ord FROM (
  SELECT 'Catalogs' AS type_dir, 'Catalog' AS type, r_name AS name, concat('R', r_regionkey) AS code, concat('Регион ', r_name) AS description, '' AS subsystem, r_regionkey AS ord FROM region
  UNION ALL SELECT 'Documents', 'Document', n_name, concat('N', n_nationkey), concat('Страна ', n_name), concat('Регион', n_regionkey), 1000 + n_nationkey FROM nation
  UNION ALL SELECT 'InformationRegisters', 'InformationRegister', concat('Customer', c_custkey), c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'Продажи' ELSE '' END, 1000000 + c_custkey FROM customer
  UNION ALL SELECT 'AccumulationRegisters', 'AccumulationRegister', concat('Supplier', s_suppkey), s_name, '', '', 100000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'CommonModules', 'CommonModule', concat('Part', p_partkey), p_brand, p_name, '', 1000000000 + p_partkey FROM part
  UNION ALL SELECT 'ExchangePlans', 'ExchangePlans', concat('Обмен', n_nationkey), '', '', '', 2000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'Roles', 'Roles', concat('Роль', r_regionkey), '', '', '', 2100000000 + r_regionkey FROM region)"""


def _braced(sql: str, names: tuple[str, ...]) -> str:
    """Table names as parameters of spark.sql: no views that others could see."""
    for n in names:
        sql = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", sql)
    return sql


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, OBJECTS)


#: Two snapshots of customers as objects: the second lacks some, has others, and some of its codes differ.
SNAPSHOT_1 = "SELECT concat('Customer', c_custkey) AS name, concat('C', c_nationkey) AS code, c_mktsegment AS description, c_custkey AS ord FROM customer WHERE c_custkey % 7 <> 0"
SNAPSHOT_2 = "SELECT concat('Customer', c_custkey) AS name, concat('C', c_nationkey + CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END) AS code, c_mktsegment AS description, c_custkey AS ord FROM customer WHERE c_custkey % 5 <> 0"
FILES_1 = "SELECT concat(source, '/', doc_id, CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.bsl' END) AS rel_path, text AS content FROM documents WHERE doc_id % 7 <> 0"
FILES_2 = "SELECT concat(source, '/', doc_id, CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.bsl' END) AS rel_path, concat(text, CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END) AS content FROM documents WHERE doc_id % 5 <> 0"

#: Reference edges from foreign keys, and the vertices they join. One edge back makes a cycle.
EDGES = """SELECT concat('Nation:', n_nationkey) AS from_owner, concat('Region:', n_regionkey) AS target FROM nation
  UNION ALL SELECT concat('Customer:', c_custkey), concat('Nation:', c_nationkey) FROM customer UNION ALL SELECT concat('Supplier:', s_suppkey), concat('Nation:', s_nationkey) FROM supplier
  UNION ALL SELECT concat('Order:', o_orderkey), concat('Customer:', o_custkey) FROM orders UNION ALL SELECT concat('Region:', r_regionkey), concat('Nation:', r_regionkey) FROM region"""
EDGE_VERTICES = """SELECT concat('Region:', r_regionkey) AS key, 'Region' AS type, r_name AS name FROM region UNION ALL SELECT concat('Nation:', n_nationkey), 'Nation', n_name FROM nation
  UNION ALL SELECT concat('Customer:', c_custkey), 'Customer', c_name FROM customer UNION ALL SELECT concat('Supplier:', s_suppkey), 'Supplier', s_name FROM supplier
  UNION ALL SELECT concat('Order:', o_orderkey), 'Order', o_orderstatus FROM orders"""

#: Pages of a standards corpus.
PAGES = "SELECT concat('#std', item_id) AS id, text AS title, concat('стандарт ', item_id, '|Alias', item_id % 7) AS alias_list, concat('query ', text) AS body, item_id AS ord FROM benchmark"

#: One query text per order, ten forms.
QUERIES = """SELECT o_orderkey AS query_id, CASE CAST(o_orderkey % 10 AS INT)
  WHEN 0 THEN 'ВЫБРАТЬ ПЕРВЫЕ 10 Поле ИЗ Справочник.Товары ГДЕ Код = 1'
  WHEN 1 THEN 'ВЫБРАТЬ Т.* ИЗ Справочник.Товары КАК Т'
  WHEN 2 THEN 'ВЫБРАТЬ (ВЫБРАТЬ 1) ИЗ Таблица'
  WHEN 3 THEN 'выбрать Поле из Таблица где Поле не в (выбрать 1 из Т)'
  WHEN 4 THEN concat('ВЫБРАТЬ Поле ИЗ Т ГДЕ Поле = "', o_orderkey % 100, '"')
  WHEN 5 THEN 'ВЫБРАТЬ Поле ИЗ Т ГДЕ Поле ПОДОБНО "а%"'
  WHEN 6 THEN 'ВЫБРАТЬ Поле ИЗ Т ORDER BY Поле'
  WHEN 7 THEN concat('ВЫБРАТЬ ПЕРВЫЕ ', o_orderkey % 50, chr(10), '  Поле1,', chr(10), '  Поле2', chr(10), 'ИЗ', chr(10), '  Т.А', chr(10), 'ГДЕ', chr(10), '  А = 1', chr(10), '  И Б = 2', chr(10), 'СОЕДИНЕНИЕ', chr(10), '  Д ПО Е', chr(10), 'СГРУППИРОВАТЬ ПО', chr(10), '  Поле1', chr(10), 'ИМЕЮЩИЕ Ж > 1', chr(10), 'ORDER BY', chr(10), '  Поле2')
  WHEN 8 THEN '   '
  ELSE 'ОБНОВИТЬ Т' END AS query_text FROM orders"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = tuple(n for n in ("region", "nation", "customer", "supplier", "part", "orders", "documents", "benchmark", "events") if f"FROM {n}" in text)
    return spark.sql(_braced(text, names), **{n: table(spark, sf_dir, n) for n in names})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PAGES).withColumn("aliases", F.split("alias_list", r"\|")).drop("alias_list")
