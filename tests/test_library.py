"""Operators of the library on hand-made inputs; expected rows follow from the rules."""

import hashlib
import json
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, generators, graph, meta, metrics, query_lint, registry, std
from lodestone.operators import rules as R
from lodestone.plans import adapters, catalog
from lodestone.sources import files
from lodestone.streaming import findings

NS = 'xmlns="http://v8.1c.ru/8.3/MDClasses"'


def mods(spark, *texts):
    return spark.createDataFrame([(f"m{i}.bsl", t) for i, t in enumerate(texts)], "path string, content string")


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    root = tmp_path_factory.mktemp("dump") / "src"
    put = lambda p, t: ((root / p).parent.mkdir(parents=True, exist_ok=True), (root / p).write_bytes(t if isinstance(t, bytes) else t.encode()))
    obj = lambda tag, name, inner="": f'<?xml version="1.0"?><MetaDataObject {NS}><{tag} uuid="1"><Properties><Name>{name}</Name></Properties><ChildObjects>{inner}</ChildObjects></{tag}></MetaDataObject>'
    member = lambda kind, name, extra="": f"<{kind}><Properties><Name>{name}</Name>{extra}</Properties></{kind}>"
    put("Catalogs/МойСправочник.xml", obj("Catalog", "МойСправочник"))
    put("Catalogs/МойСправочник/Ext/ObjectModule.bsl", "Процедура ПередЗаписью(Отказ)\n    Движения.МойРегистр.Записать();\n    Движения.МойРегистр.Очистить();\nКонецПроцедуры\n")
    put("Catalogs/МойСправочник/Forms/ФормаЭлемента/Ext/Form.xml", "<Form/>")
    inner = member("Dimension", "Склад", "<Type><Type>cfg:CatalogRef.МойСправочник</Type></Type>") + member("Resource", "Количество", "<Type><Type>xs:decimal</Type><NumberQualifiers><Digits>10</Digits></NumberQualifiers></Type>")
    inner += f"<TabularSection><Properties><Name>Строки</Name></Properties><ChildObjects>{member('Attribute', 'А')}{member('Attribute', '')}</ChildObjects></TabularSection>" + member("Command", "Печать")
    put("AccumulationRegisters/МойРегистр.xml", obj("AccumulationRegister", "МойРегистр", inner))
    put("AccumulationRegisters/МойРегистр/Ext/ManagerModule.bsl", "Функция Найти()\r\n    Возврат Справочники.МойСправочник.НайтиПоНаименованию(1);\r\nКонецФункции")
    put("AccumulationRegisters/Битый.xml", "<a><b></a>")
    put("Reports/Отчет/Другой.xml", obj("Report", "Другой"))
    put("Reports/Отчет/Отчет.xml", obj("Report", "Отчет"))
    put("Ext/X.xml", obj("Catalog", "Нет"))
    put("CommonModules/Общий.xml", '<CommonModule Name="ОбщийМодуль" Code="К1"><Description>описание</Description></CommonModule>')
    put("Subsystems/Продажи.xml", '<Subsystem Name="Продажи"><Description>все о продажах</Description></Subsystem>')
    put("Subsystems/Битая.xml", "<Subsystem")
    return str(root)


def test_dump_objects_and_members(spark, dump):
    objects, members = files.load_objects(spark, dump)
    got = {(r.type_dir, r.type, r.name) for r in objects.collect()}
    assert got == {("Catalogs", "Catalog", "МойСправочник"), ("AccumulationRegisters", "AccumulationRegister", "МойРегистр"), ("Reports", "Report", "Отчет"), ("CommonModules", "CommonModule", "ОбщийМодуль"), ("Subsystems", "Subsystems", "Продажи")}
    assert [(r.code, r.description) for r in objects.filter("name = 'ОбщийМодуль'").collect()] == [("К1", "описание")]
    assert [tuple(r) for r in files.load_subsystems(spark, dump).collect()] == [("Продажи", "все о продажах")]
    rows = meta.structure(objects, members, "accumulationregisters.мойрегистр").orderBy("pos").collect()
    assert [(r.section, r.member_kind, r.name, r.type, r.qualifiers) for r in rows] == [(None, "Dimension", "Склад", "CatalogRef.МойСправочник", ""), (None, "Resource", "Количество", "decimal", "Digits=10"), (None, "TabularSection", "Строки", "", ""), ("Строки", "Attribute", "А", "", ""), (None, "Command", "Печать", "", "")]
    assert [r.name for r in files.listed_members(files.load_listing(spark, dump), "Forms").collect()] == ["ФормаЭлемента"]
    with pytest.raises(ValueError):
        files.load_modules(spark, "")
    with pytest.raises(ValueError):
        meta.search(objects, "x", "Nonsense")
    with pytest.raises(ValueError):
        meta.orphans(objects)
    assert not files.membership_recorded(files.load_listing(spark, dump))
    assert {r.name for r in meta.orphans(objects, recorded=True).collect()} == {"МойСправочник", "МойРегистр", "Отчет", "Продажи"}
    assert files.membership_recorded(spark.createDataFrame([("Subsystems/А/Ext/Content.xml",), ("x/y",)], "rel_path string"))


def test_structure_and_references_of_the_dump(spark, dump):
    objects, members = files.load_objects(spark, dump)
    modules, listing = files.load_modules(spark, dump), files.load_listing(spark, dump)
    listed = files.listed_groups(listing)
    rows = lambda name: {(r.part, r.section, r["name"], r.type) for r in meta.full_structure(objects, members, modules, listed, name).collect()}
    assert rows("МойСправочник") == {("Module", None, "Catalogs/МойСправочник/Ext/ObjectModule.bsl", "ObjectModule"), ("Form", None, "ФормаЭлемента", "")}
    assert {r[0] for r in rows("МойРегистр")} == {"Dimension", "Resource", "TabularSection", "Attribute", "Command", "Module"}
    got = {(r.kind, r.path, r.line_no) for r in meta.cross_reference(objects, modules, listing, "МойСправочник").collect()}
    assert got == {("form", "Catalogs/МойСправочник/Forms/ФормаЭлемента/Ext/Form.xml", None), ("module", "Catalogs/МойСправочник/Ext/ObjectModule.bsl", None), ("reference", "AccumulationRegisters/МойРегистр/Ext/ManagerModule.bsl", 2)}
    assert meta.cross_reference(objects, modules, listing, "мойсправочник").count() == 0
    assert meta.dependencies(objects, members, modules, listed, "МойСправочник", "referenced_by").count() == 1
    assert {(r.name, r.n_forms, r.n_commands) for r in meta.tree_members(objects).collect()} >= {("МойРегистр", 0, 1), ("МойСправочник", 0, 0)}
    assert {(r.kind, r["name"]) for r in meta.config_lists(objects, files.load_subsystems(spark, dump)).collect()} >= {("subsystem", "Продажи"), ("type", "Catalogs")}
    one = files.load_modules(spark, f"{dump}/Catalogs/МойСправочник/Ext/ObjectModule.bsl").collect()
    assert [r.path for r in one] == ["ObjectModule.bsl"] and one[0].content.startswith("Процедура")


def test_decoding_hashes_and_json(spark, tmp_path):
    rows = [("a", "Привет".encode()), ("b", "Привет, мир".encode("cp866")), ("c", b""), ("d", None)]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k string, b binary").select("k", files.decoded(F.col("b")).alias("t")).collect()}
    assert got == {"a": "Привет", "b": "Привет, мир", "c": "", "d": None}
    hashes = files.file_hashes(spark.createDataFrame([("x", b"abc"), ("y", b"")], "rel_path string, content binary"))
    assert {r.rel_path: r.sha256 for r in hashes.collect()} == {"x": hashlib.sha256(b"abc").hexdigest(), "y": hashlib.sha256(b"").hexdigest()}
    files.write_json(spark.createDataFrame([("x", None, [1, 2])], "a string, b int, c array<int>"), str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": "x", "b": None, "c": [1, 2]}]


def test_registry_file(spark, tmp_path):
    keys = R.REGISTRY_FILE_KEYS
    file = tmp_path / "registry.json"
    file.write_text(json.dumps({keys["functions"]: {"СтрДлина": {"verdict": "exists", "kind": "string"}}, keys["methods"]: {"НайтиПоКоду": "exists"}, keys["synonyms"]: {"СтрДлина": ["StrLen"]}, keys["disproved"]: ["СтрНет"]}), encoding="utf-8")
    tables = files.load_registry(spark, str(file))
    assert {k: [tuple(r) for r in t.collect()] for k, t in tables.items()} == {"functions": [("СтрДлина", "exists", "string")], "methods": [("НайтиПоКоду", "exists")], "synonyms": [("СтрДлина", "StrLen")], "disproved": [("СтрНет",)]}
    asked = spark.createDataFrame([("стрдлина",), ("НайтиПоКоду",), ("Другое",)], "query string")
    assert {(r.query, r.verdict) for r in registry.verdicts(asked, registry.tables(spark) | tables).collect()} == {("стрдлина", "exists"), ("НайтиПоКоду", "exists"), ("Другое", "unknown")}


def test_graph_of_the_dump(spark, dump):
    objects, _ = files.load_objects(spark, dump)
    g = graph.Graph(objects, files.load_modules(spark, dump))
    keys = {r.key for r in g.vertices.collect()}
    assert {"Catalog:МойСправочник", "AccumulationRegister:МойРегистр"} <= keys
    assert {r.owner for r in g.owners.collect()} == {"Catalog:МойСправочник", "AccumulationRegister:МойРегистр"}
    edges = g.ref_edges.collect()
    moves = [e for e in edges if e.kind == "movement"]
    assert len(moves) == 2 and {(e.from_owner, e.target) for e in moves} == {("Catalog:МойСправочник", "AccumulationRegister:МойРегистр")}
    assert any(e.kind == "collection" and e.target == "Catalog:МойСправочник" for e in edges)
    assert "Catalog:МойСправочник" in {r.key for r in g.impact("МойРегистр", depth=2).collect()}
    out = g.calls("МойРегистр", "out").collect()
    assert [(r.callee, r.resolved) for r in out] == [("НайтиПоНаименованию", None)]
    assert g.one("мойсправочник") == "Catalog:МойСправочник"
    assert [r.name for r in g.search("Справочник").collect()] == ["МойСправочник"]
    assert tuple(g.stats().first()) == (5, 2, 3, len(edges), 2)
    with pytest.raises(ValueError):
        g.one("нет такого")
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_impact_matches_a_plain_search(spark):
    rng = random.Random(3)
    names = [f"T:{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(60)] + [("T:0", "T:1"), ("T:1", "T:0"), ("T:2", "T:0"), ("T:3", "T:0"), ("T:4", "T:3")]
    e = spark.createDataFrame(edges, "from_owner string, target string")
    v = spark.createDataFrame([(n, "T", n) for n in names], "key string, type string, name string")
    seen, level = {"T:1": 0}, {"T:1"}
    for d in (1, 2, 3):
        level = {a for a, b in edges if b in level and a != b} - set(seen)
        seen |= dict.fromkeys(level, d)
    got = {r.key: r.depth for r in graph.impact(e, v, "T:1", 3, None).collect()}
    assert got == {k: d for k, d in seen.items() if d}
    assert graph.impact(e, v, "T:1", 3, 2).count() == 2


def test_graph_without_limits(spark):
    objects = spark.createDataFrame([("CommonModules", "CommonModule", f"Модуль{i}", "", "", "", i) for i in range(25)], "type_dir string, type string, name string, code string, description string, subsystem string, ord long")
    code = "Процедура А()\n" + " Б();\n" * 60 + "КонецПроцедуры\nПроцедура Б()\nКонецПроцедуры"
    g = graph.Graph(objects, spark.createDataFrame([("CommonModules/Модуль1/Ext/Module.bsl", code)], "path string, content string"))
    rows = lambda **k: [g.calls("Модуль1", d, **k).count() for d in ("out", "in", "both")]
    assert rows() == [50, 50, 100] and rows(limit=None) == [60, 60, 120]
    assert g.search("модуль").count() == 20 and g.search("модуль", limit=None).count() == 25
    assert {"graph_calls_all", "graph_search_all", "graph_impact_code_all"} <= set(catalog.QUERIES)


def test_long_modules_are_scoped_by_ranges(spark):
    rng = random.Random(5)
    forms = ["Процедура А()", " функция Б(х)", "КонецПроцедуры", " Вызов(1);", " Имя.Поле", " слово", " слово"]
    texts = {f"CommonModules/М{i}/Ext/Module.bsl": [rng.choice(forms) for _ in range(n)] for i, n in enumerate((700, 90, 1, 2, 4))}
    texts["CommonModules/М0/Ext/Module.bsl"][100:400] = [" Вызов(2);"] * 300  # ranges without any header or end
    expected = set()
    for path, rows in texts.items():
        owner, scope = f"Module:{path.split('/')[1]}", None
        for n, x in enumerate(rows, 1):
            head = re.match(r"\s*(?:Процедура|функция) (\w+)", x)
            scope = f"{owner}#{head[1]}" if head else None if x == "КонецПроцедуры" else scope
            if x != " слово":
                expected.add((path, owner, n, x, scope, bool(head)))
    modules = spark.createDataFrame([(p, "\n".join(rows)) for p, rows in texts.items()], "path string, content string")
    lines = spark.createDataFrame([(p, 7 * n - 1000, x) for p, rows in texts.items() for n, x in enumerate(rows)], "path string, ord long, text string")
    objects = spark.createDataFrame([], "type string, name string, description string, ord long")
    for g in (graph.Graph(objects, modules), graph.Graph(objects, lines=lines)):
        for least in (3, 10**6):
            long = graph.long_paths(g.marked, g.counts, least)
            assert long.count() == (3 if least == 3 else 0)
            got = graph.scoped_lines(g.marked, g.owners, long).select("path", "owner", "line_no", "text", "scope", "is_header")
            assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
        assert g.procedures.count() == len({x[4] for x in expected if x[5]})
    assert "collect_list" not in catalog._G(spark, "/root/testdata/sf0.001").lines._jdf.queryExecution().toString()


def test_frequent_words_and_objects_meet_theirs_without_a_shuffle(spark):
    rng = random.Random(8)
    objects = [("Catalog", f"Имя{i}", "", i) for i in range(12)] + [("Document", "имя1", "", 20), ("AccumulationRegister", "Имя3", "", 21)]
    forms = ["Имя1.Метод(); Имя1.Поле", "Имя1.х", "9Имя2.у + слово.Имя4", "Движения.Имя3.Записать()", "Справочники.Имя5.Найти()", "Справочники.Нет.Найти()", "ВЫБРАТЬ * ИЗ Справочник.Имя1", "Имя7", "Имя6.Имя8.Имя9"]
    modules = [(f"Catalogs/Имя{i}/Ext/Module.bsl", "\n".join(rng.choices(forms, [5, 5, 1, 1, 1, 1, 1, 1, 1], k=60))) for i in range(10)]
    g = graph.Graph(spark.createDataFrame(objects, "type string, name string, description string, ord long"), spark.createDataFrame(modules, "path string, content string"))
    heads = {"Имя1.Метод(); Имя1.Поле": ["имя1"] * 2, "Имя1.х": ["имя1"], "9Имя2.у + слово.Имя4": ["имя2"], "Имя6.Имя8.Имя9": ["имя6"]}
    others = {"Движения.Имя3.Записать()": ("AccumulationRegister:Имя3", "movement"), "Справочники.Имя5.Найти()": ("Catalog:Имя5", "collection"), "ВЫБРАТЬ * ИЗ Справочник.Имя1": ("Catalog:Имя1", "query")}
    expected = Counter()
    for path, code in modules:
        owner = "Catalog:" + path.split("/")[1]
        for n, x in enumerate(code.split("\n"), 1):
            found = [(f"{t}:{name}", None) for head in heads.get(x, []) for t, name, *_ in objects if name.lower() == head] + ([others[x]] if x in others else [])
            expected.update((owner, n, *f) for f in found if f[0] != owner or f[1] == "query")
    for least in (2, 10**6):
        edges = graph.ref_edges(g.scoped, g.vertices, least)
        assert Counter((r.from_owner, r.line_no, r.target, r.kind) for r in edges.collect()) == expected
        assert {(r.key, r.depth) for r in graph.impact(edges, g.vertices, "Catalog:Имя1", 2, None, least).collect()} >= {(f"Catalog:Имя{i}", 1) for i in (0, 2, 3, 4)}
    assert {r.word for r in graph.frequent_keys(spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "word string"), ["word"], 4).collect()} == {"a"}


def test_calls_are_resolved_once_a_pair(spark):
    rng = random.Random(9)
    objects = [("CommonModule", f"М{i}", "", i) for i in range(3)] + [("Catalog", "К", "", 9)]
    names = ["А", "Б", "В", "Г"]
    modules, procs, calls, scope = [], {}, [], None
    for path, owner in (("Catalogs/К/Ext/Module.bsl", "Catalog:К"), ("Catalogs/К/Forms/Ф/Module.bsl", "Catalog:К"), ("CommonModules/М1/Ext/Module.bsl", "CommonModule:М1"), ("CommonModules/М2/Ext/Module.bsl", "CommonModule:М2")):
        scope, rows = None, []
        for n in range(1, 81):
            name, kind = rng.choice(names[: 2 if "К" in owner else 4]), rng.random()
            if kind < 0.1:
                scope = f"{owner}#{name}"
                procs.setdefault(scope, (path, n, name, owner))
                rows.append(f"Процедура {name}()")
            elif kind < 0.2:
                scope = None
                rows.append("КонецПроцедуры")
            else:
                found = rng.choices(["а", "Б", "г", "Нет"], k=rng.choice([1, 2]))
                rows.append("; ".join(f"{x}(1)" for x in found))
                calls += [(scope or f"{path}#(module)", path, owner, n, i, x) for i, x in enumerate(found)]
        modules.append((path, "\n".join(rows)))
    def resolve(proc, callee):
        order = sorted((module, n, fq, owner) for fq, (module, n, name, owner) in procs.items() if name.lower() == callee.lower())
        here = [x[2] for x in order if proc in procs and x[0] == procs[proc][0]]
        return (here + [x[2] for x in order if x[3].startswith("CommonModule:")] + [None])[0]
    g = graph.Graph(spark.createDataFrame(objects, "type string, name string, description string, ord long"), spark.createDataFrame(modules, "path string, content string"))
    for owner, least in ((None, 2), (None, 10**6), ("Catalog:К", 2)):
        got = g.resolved_calls(owner, least).select("from_proc", "from_module", "from_owner", "line_no", "pos", "callee", "resolved").collect()
        assert Counter(map(tuple, got)) == Counter((*c, resolve(c[0], c[5])) for c in calls if owner in (None, c[2]))
    both = g.calls("К", limit=None).collect()
    mine = {name.lower() for _, _, name, owner in procs.values() if owner == "Catalog:К"}
    assert Counter((r.module, r.line_no, r.callee, r.proc) for r in both if r.direction == "out") == Counter((c[1], c[3], c[5], c[0].split("#")[1]) for c in calls if c[2] == "Catalog:К" and c[0] in procs)
    assert Counter((r.module, r.line_no, r.callee, r.caller_proc) for r in both if r.direction == "in") == Counter({(c[1], c[3], c[5], c[0]) for c in calls if c[5].lower() in mine})
    assert g.stats().first().call_edges == len(calls)


def test_functions_end_at_the_next_header(spark):
    code = "вступление Если\nФункция А()\n Если х Тогда\n КонецЕсли\nКонецФункции\n // Для\nПроцедура Б()"
    got = [(r.name, r.type, r.start, r.complexity, r.lines) for r in metrics.functions(mods(spark, code)).orderBy("fn_no").collect()]
    assert got == [("А", "Функция", 2, 4, 4), ("Б", "Процедура", 7, 1, 0)]
    assert tuple(metrics.module_metrics(mods(spark, "")).first()) == ("m0.bsl", 1, 0, 0)
    assert metrics.quality_gate_passed(mods(spark, code), 3).first().passed is False
    assert metrics.quality_metrics(mods(spark, code).limit(0)).first().total_files == 0


def brute_duplicates(lines, n):
    return [(i + 1, j + 1) for i in range(len(lines) - n + 1) for j in [next((j for j in range(i + n, len(lines) - n + 1) if lines[j : j + n] == lines[i : i + n]), None)] if j is not None]


def test_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["а  = 1;", "б();", " // в", "", "г"]) for _ in range(40)) for _ in range(4)]
    df = mods(spark, *texts)
    kept = lambda t: [" ".join(x.split()) for x in t.split("\n") if x.strip() and not x.strip().startswith("//")]
    got = sorted((r.path, r.first_start, r.second_start) for r in metrics.duplicates_in_modules(df, 3).collect())
    assert got == sorted((f"m{i}.bsl", a, b) for i, t in enumerate(texts) for a, b in brute_duplicates(kept(t), 3))
    everything = [x for t in texts for x in kept(t)]
    for bucket in (7, 10_000):
        got = sorted((r.first_start, r.second_start) for r in metrics.duplicates_in_corpus(df, 3, bucket).collect())
        assert got == sorted(brute_duplicates(everything, 3))


def test_line_rules(spark):
    code = 'Пароль = "abc";\nпароль = "abcd";\n// Password = "secret1";\nToken = "abcdefghijklmno"\ntoken = "abcdefghijklmnop"\n  x.СтрДлина (1) // ок\n//.СтрНайти('
    got = [(r.line_no, r.rule_id) for r in audit.security(mods(spark, code)).orderBy("line_no").collect()]
    assert got == [(2, "hardcoded_password"), (5, "hardcoded_token")]
    assert [(r.line_no, r.rule_id) for r in audit.deprecated_api(mods(spark, code)).orderBy("line_no").collect()] == [(6, "stringtrim"), (7, "strfind_old")]
    near, far = "ПЕРВЫЕ\n" + "\n" * 4 + "х.Выбрать()", "ПЕРВЫЕ\n" + "\n" * 5 + "х.Выбрать()"
    assert [r.path for r in audit.code_antipatterns(mods(spark, near, far)).collect()] == ["m1.bsl"]
    close, away = "Цикл\n" + "\n" * 9 + "Продолжить", "Цикл\n" + "\n" * 10 + "Продолжить"
    assert [r.path for r in audit.e1_e9(mods(spark, close, away)).filter("defect = 'queue_leak'").collect()] == ["m0.bsl"]
    assert audit.e1_e9(mods(spark, close, close), 1).filter("defect = 'queue_leak'").count() == 1


def test_audit_covers_every_module(spark):
    many = spark.range(10_001).select(F.format_string("m%05d.bsl", "id").alias("path"), F.lit("НачатьТранзакцию();").alias("content"))
    got = audit.e1_e9(many).filter("defect = 'transaction_boundary'")
    assert got.count() == 10_001 and got.agg(F.max("path")).first()[0] == "m10000.bsl"


def test_dead_code_knows_substrings_of_words(spark):
    got = {(r.name, r.path) for r in audit.dead_code(mods(spark, "Процедура Тест()\nПроцедура Один()\nОдин()", "Функция ТестСоздание()", "Процедура ПриЗаписи()")).collect()}
    assert got == {("Один", "m0.bsl"), ("ТестСоздание", "m1.bsl")}


def test_query_patterns_and_clauses(spark):
    hits = {
        "no_first": "ВЫБРАТЬ Поле ИЗ Т", "select_all": "ВЫБРАТЬ Т.* ИЗ Т", "no_where": "ВЫБРАТЬ А ИЗ Т КАК Х", "duplicate_left_join": "ЛЕВОЕ\tСОЕДИНЕНИЕ А (Б ЛЕВОЕ СОЕДИНЕНИЕ",
        "subquery_in_select": "выбрать (выбрать", "string_compare": "А = 'x'", "like_concat": "А НЕ ПОДОБНО 'x'", "not_in_subquery": "НЕ В (ВЫБРАТЬ", "order_by_non_indexed": "ORDER BY А",
        "no_group_having": "СГРУППИРОВАТЬ ПО А HAVING Б", "cast_in_where": "ГДЕ А ЗАМЕНИТЬ(", "empty_period": "А >= ПЕРВОЙДАТЫ(ПЕРИОДА)", "fetch_top_without_period": "ПЕРВЫЕ 5 А ИЗ Т ГДЕ",
        "max_rows_missing": "ВЫБРАТЬ А ИЗ Т ГДЕ Б = 1", "sync_call_pattern": "А.Б = В.Запрос",
    }
    q = spark.createDataFrame([(i, t) for i, t in enumerate(hits.values())] + [(99, "")], "query_id long, query_text string")
    got = {(r.query_id, r.pattern_id) for r in query_lint.anti_patterns(q).collect()}
    assert {(i, p) for i, p in enumerate(hits)} <= got and not any(i == 99 for i, _ in got)
    text = "ВЫБРАТЬ ПЕРВЫЕ 10\n А,\n Б\nИЗ\n Т\nГДЕ В = 1\n Г = 2\n И Д\nЛЕВОЕ СОЕДИНЕНИЕ Е\nСГРУППИРОВАТЬ ПО\n А\nИМЕЮЩИЕ Ж\nORDER BY\n А"
    got = [(r.clause, r.text, r.first_n) for r in query_lint.clauses(spark.createDataFrame([(1, text)], "query_id long, query_text string")).orderBy("line_no").collect()]
    assert got == [("first_n", "ВЫБРАТЬ ПЕРВЫЕ 10", 10), ("fields", "А,", None), ("fields", "Б", None), ("conditions", "Т", None), ("conditions", "Г = 2", None), ("conditions", "ЛЕВОЕ СОЕДИНЕНИЕ Е", None), ("group_by", "А", None), ("having", "ИМЕЮЩИЕ Ж", None), ("order_by", "А", None)]
    code = 'х = Новый Запрос;\nх.Текст = """ВЫБРАТЬ 1""";\nу = Новый Запрос("");\nЗапрос.Текст = """Б"""'
    assert [(r.name, r.start_line, r.query_text) for r in query_lint.embedded_queries(mods(spark, code)).orderBy("line_no").collect()] == [("х", 1, "ВЫБРАТЬ 1"), ("у", 3, "Б")]
    valid = {(r.query_id, r.valid, r.message) for r in query_lint.validate(spark.createDataFrame([(1, " "), (2, "ОБНОВИТЬ")], "query_id long, query_text string")).collect()}
    assert valid == {(1, False, "Пустой запрос"), (2, False, "Запрос должен начинаться с ВЫБРАТЬ или ВЫБРАТЬ РАЗЛИЧНЫЕ"), (2, False, "В запросе отсутствует секция ИЗ")}


def test_registered_queries_run_all_patterns(spark):
    sf = "/root/testdata/sf0.001"
    run = lambda name: catalog.QUERIES[name](spark, sf).collect()
    hit = lambda text: [(i, s, m, a) for i, s, p, m, a in R.QUERY_PATTERNS if re.search(p, text, re.I | re.M)]
    queries = [tuple(r) for r in adapters.sql(spark, sf, adapters.QUERIES).collect()]
    want = Counter((q, i, m, a) for q, t in queries for i, s, m, a in hit(t))
    assert Counter(map(tuple, run("query_optimize"))) == want and {"no_first", "select_all", "no_where", "no_group_having", "fetch_top_without_period"} <= {k[1] for k in want}
    want = Counter()
    for q, t in queries:
        bare = t.strip().upper()
        issues = [R.EMPTY_QUERY] if not bare else [R.NO_SELECT] * (not bare.startswith("ВЫБРАТЬ")) + [R.NO_FROM] * ("ИЗ" not in bare)
        rows = [("issue", None, m) for m in issues] + [("warning" if s == "warning" else "issue", i, m) for i, s, m, _ in hit(t) if bare]
        want.update((q, not issues, *r) for r in rows or [(None, None, None)])
    assert Counter(map(tuple, run("query_validate"))) == want
    found = query_lint.embedded_queries(adapters.modules_from_orders(spark, sf)).collect()
    want = Counter((r.path, r.line_no, r.name, r.start_line, i, s, m) for r in found for i, s, m, _ in hit(r.query_text))
    assert Counter(map(tuple, run("audit_query_antipatterns"))) == want and "select_all" in {k[4] for k in want}


def test_look_ahead_as_sql():
    words = ["ВЫБРАТЬ", "РАЗЛИЧНЫЕ", "ПЕРВЫЕ", "ПЕ", "РАЗ", "ИЗ", "ГДЕ", "Г", "ORDER", "ПЕРИОДА", "СГРУППИРОВАТЬ", "ПО", "HAVING", "Т.*", "Т.А", "Поле", "10", ",", "=", "(", "выбрать", "первые", "из"]
    con = duckdb.connect()
    rng = random.Random(5)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ""]) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["ВЫБРАТЬ " + "".join(rng.choice(words) + rng.choice([" ", "  "]) for _ in range(rng.randint(0, 4))) + "ИЗ Т " + "".join(rng.choice(words) + rng.choice([" ", "  "]) for _ in range(rng.randint(0, 4))) for _ in range(4000)]
    gap = lambda: rng.choice([" ", "  ", "\n"])
    texts += [f"ВЫБРАТЬ{gap()}{rng.choice(words)}{gap()}{rng.choice(['', 'Поле ', ', А '])}ИЗ{gap()}Т{gap()}{rng.choice(['ГДЕ', 'где', 'Г'])}{gap()}Поле{rng.choice(['', ' '])}=" for _ in range(2000)]
    con.execute("CREATE TABLE q (i INT, query_text VARCHAR)")
    con.executemany("INSERT INTO q VALUES (?, ?)", list(enumerate(texts)))
    for name, _, pattern, *_ in R.QUERY_PATTERNS:
        if "(?!" in pattern:
            got = {r[0] for r in con.execute(f"SELECT i FROM q WHERE {catalog._hit_sql(name)}").fetchall()}
            want = {i for i, t in enumerate(texts) if re.search(pattern, t, re.I | re.M)}
            assert got == want and want and len(want) < len(texts), (name, [texts[i] for i in sorted(got ^ want)[:3]])


def test_personal_data_of_documents_is_counted_whole(spark, tmp_path):
    texts = ["ИНН 7701234567, 770123456789 и 123456789012345", "паспорт 123-45-67-8901 fio", "нет"]
    spark.createDataFrame([(i, t, "s", "ru") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.pattern, r.cnt) for r in catalog.QUERIES["audit_pi_data"](spark, str(tmp_path)).collect()}
    assert got == {(n, c) for n, p in R.PERSONAL if (c := sum(len(re.findall(p, t, re.I)) for t in texts))} and ("INN/KPP number", 2) in got


def test_standards_corpus(spark, tmp_path):
    lines = ['{"id": "#std999", "title": "Заголовок", "aliases": ["Блокировки"], "body_markdown": "текст про запросы"}', "", "{broken", '{"page": {"ID": "std5", "name": "Пятый"}}', '{"id": "#std999", "title": "Новый", "aliases": ["Блокировки", "б"], "body_markdown": "другой текст"}', '{"title": "без номера"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines), encoding="utf-8")
    pages = files.load_pages(spark, str(tmp_path / "c.jsonl"))
    assert std.stats(pages).first().pages == 3
    for spelling in ("#std999", "std999", "999", "std 999"):
        assert std.get(pages, spelling).first().title == "Новый"
    assert std.get(pages, "std404").count() == 0 and std.get(pages, "5").first().title == "Пятый"
    assert std.search(pages, "БЛОКИРОВКИ").first().score == 100 and std.search(pages, "текст запросы").first().score == 4 and std.search(pages, " ").count() == 0
    wanted = spark.createDataFrame([("999",), ("#STD5",), ("404",)], "query string")
    assert {tuple(r) for r in std.lookup(pages, wanted).collect()} == {("999", "#std999"), ("#STD5", "std5"), ("404", None)}


def test_registry_has_three_answers(spark):
    reg = registry.tables(spark)
    names = spark.createDataFrame([("стрдлина",), ("ДатаГод",), ("Чтото",), ("StrLen",), ("StrLength",), ("НайтиПоКоду",)], "query string")
    assert {r.query: r.verdict for r in registry.verdicts(names, reg).collect()} == {"стрдлина": "exists", "ДатаГод": "absent", "Чтото": "unknown", "StrLen": "exists", "StrLength": "unknown", "НайтиПоКоду": "exists"}
    assert {r.query: r.available for r in registry.version_check(names, reg).collect()} == {"стрдлина": True, "ДатаГод": False, "Чтото": None, "StrLen": True, "StrLength": None, "НайтиПоКоду": True}
    assert {(r.query, r.ru, r.verified) for r in registry.find_synonyms(names, reg).collect()} >= {("стрдлина", "СтрДлина", "exists"), ("StrLen", "СтрДлина", "exists"), ("StrLength", None, "absent"), ("Чтото", None, "unknown")}
    assert tuple(reg[k].count() for k in ("functions", "methods", "disproved", "help")) == (83, 10, 49, 28)


def test_generators_and_checks(spark):
    one = spark.createDataFrame([("Х",)], "name string")
    assert generators.epf_generate(one).count() == 4 and generators.generate_test(one, "other").first().text == "// Test template for Х (other)"
    with pytest.raises(ValueError):
        generators.template_apply(one, "нет")
    args = spark.createDataFrame([(["infobase", "--password", "p", "--db-pwd=q", "x"],)], "arguments array<string>")
    assert generators.redacted(args).first().arguments == ["infobase", "--password", "[REDACTED]", "--db-pwd=[REDACTED]", "x"]
    cmds = spark.createDataFrame([("infobase create --x",), ("infobase dump",), ("help a",), ("rm",)], "command string")
    assert [tuple(r)[1:] for r in generators.command_checks(cmds).collect()] == [(True, True), (True, False), (True, False), (False, False)]
    assert generators.capabilities(spark).count() == 39


def test_text_reading_and_headers(spark, tmp_path):
    (tmp_path / "a b.bsl").write_bytes(b"\xef\xbb\xbfA\r\nB\rC\xff")
    got = files.load_modules(spark, str(tmp_path)).first()
    assert (got.path, got.content) == ("a b.bsl", "﻿A\nB\nC�")
    (tmp_path / "x.epf").write_bytes(bytes.fromhex("ffffff7f0002000000"))
    assert tuple(files.artifact_headers(spark, str(tmp_path / "x.epf")).select("size", "header", "valid").first()) == (9, "ffffff7f00020000", True)


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.bsl").write_text(f'Пароль = "secret{i}";\nх.Выбрать();\n', encoding="utf-8")
    findings.start(findings.read_modules(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((Path(r.path).name, r.line_no, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = findings.batch(files.load_modules(spark, str(src)))
    assert got == sorted((r.path, r.line_no, r.rule_id) for r in want.collect()) and len(got) == 6


def test_order_of_input_does_not_matter(spark):
    df = mods(spark, *[f"Процедура П{i}()\n П{(i + 1) % 5}();\n Цикл\n Продолжить" for i in range(5)])
    for op in (metrics.functions, audit.e1_e9, audit.dead_code):
        assert sorted(map(str, op(df).collect())) == sorted(map(str, op(df.orderBy(F.rand(3)).repartition(3)).collect()))
