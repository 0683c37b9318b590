import io
import time
import zipfile

import pytest
from conftest import rows
from fixtures import CATALOG, DUMP, MODULE_A
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import changes, entrypoints, grep
from codeloom.plans import build, code
from codeloom.sources import dump, metadata, store
from codeloom.streaming import watch


@pytest.fixture(scope="module")
def texts(spark):
    return dump.decode(dump.in_memory(spark, DUMP)).select("path", "text").cache()


def test_decoding(spark):
    text = "Процедура А()\nКонецПроцедуры"
    files = {"utf8": text, "bom": b"\xef\xbb\xbf" + text.encode(), "cp1251": text.encode("cp1251"), "utf16": b"\xff\xfe" + text.encode("utf-16le"), "utf32": b"\xff\xfe\0\0" + text.encode("utf-32le"), "utf32b": b"\0\0\xfe\xff" + text.encode("utf-32be"), "empty": ""}
    got = {r.path: r.text for r in dump.decode(dump.in_memory(spark, files)).collect()}
    assert got == {"utf8": text, "bom": text, "cp1251": text, "utf16": text, "utf32": text, "utf32b": text, "empty": ""}


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "Catalogs").mkdir()
    (tmp_path / "Catalogs/A.xml").write_text("<a/>")
    (tmp_path / ".codeloom").mkdir()
    (tmp_path / ".codeloom/x.xml").write_text("no")
    (tmp_path / "Configuration.xml").write_text("<c/>")
    assert rows(dump.read_files(spark, str(tmp_path)).select("path", "size")) == [("Catalogs/A.xml", 4), ("Configuration.xml", 4)]
    assert rows(dump.sections(dump.read_files(spark, str(tmp_path)), ["Roles"]).select("path")) == [("Configuration.xml",)]


A, B = "CommonModules/Ночь/Ext/Module.bsl", "CommonModules/Журнал/Ext/Module.bsl"


def test_routines(spark, texts):
    found = code.routines(texts.where("path like '%.bsl'"))
    got = rows(found.select("name", "kind", "is_export", "start_line", "end_line", "total", "required"))
    assert got == [
        ("Видимые", "Function", False, 16, 18, 2, 2),
        ("ДиаметрПриИзменении", "Procedure", False, 2, 3, 1, 1),
        ("Записать", "Procedure", True, 1, 3, 1, 1),
        ("Калибровка", "Procedure", False, 5, 6, 1, 1),
        ("НачатьНочь", "Procedure", True, 5, 14, 4, 1),
        ("ПоРасписанию", "Procedure", True, 5, 6, 0, 0),
    ]
    assert found.where("name = 'НачатьНочь'").first().parameters == ["Дата", "Порог", "Облачность", "Пометка"]


def test_regions_close_at_their_depth(spark, texts):
    assert rows(code.regions(texts.where(F.col("path") == A)).select("name", "depth", "start_line", "end_line")) == [("Наблюдения", 0, 1, 20), ("Расчёты", 1, 15, 19)]


def test_calls_accesses_queries(spark, texts):
    modules = texts.where(F.col("path") == A)
    found = code.routines(modules)
    assert {(r.routine, r.line, r.callee) for r in code.calls(modules, found).collect()} == {
        ("НачатьНочь", 7, "Видимые"), ("НачатьНочь", 8, "Журнал.Записать"), ("НачатьНочь", 9, "Справочники.Телескопы.НайтиПоНаименованию"),
    }
    sites = {(r.method, r.args, r.used) for r in code.call_sites(modules, found).collect()}
    assert sites == {("Видимые", 2, True), ("Записать", 1, False), ("НайтиПоНаименованию", 1, True)}
    assert rows(code.accesses(modules, found).select("routine", "line", "target_id")) == [("НачатьНочь", 9, "Catalog.Телескопы")]
    assert rows(code.query_tables(modules, found).select("line", "target_id")) == [(11, "Catalog.Телескопы"), (13, "InformationRegister.Экспозиции")]
    assert rows(code.inferred_types(modules, found).select("name", "line", "type")) == [("Выборка", 10, "Запрос")]
    assert {(r.name, r.line) for r in code.declared(modules, found).collect()} == {("Звёзды", 7), ("Купол", 9), ("Выборка", 10)}


def test_comment_above_a_directive(spark, texts):
    starts = code.routines(texts.where(F.col("path") == A)).where("name = 'НачатьНочь'").select("path", F.col("start_line").alias("n"))
    assert grep.comment_heads(grep.lines(texts), starts).first().comment_head == "// Ведёт ночь от сумерек\n// до рассвета."


def test_metadata(spark, texts):
    objects = metadata.objects(texts)
    got = {r.id: r for r in objects.collect()}
    assert got["Catalog.Телескопы"].synonym == "Fernrohre" and got["Catalog.Телескопы"].uuid == "t-1"
    assert got["Catalog.Телескопы/Attribute.Купол"].types == ["cfg:CatalogRef.Купола", "cfg:DocumentRef.Ремонт", "xs:boolean"]
    assert got["Catalog.Телескопы/Command.Навести"].comment == "по часам"
    assert {i for i in got if i.startswith("Catalog.Телескопы/")} == {f"Catalog.Телескопы/{x}" for x in ("TabularSection.Окуляры", "Attribute.Купол", "Command.Навести", "Form.Карточка", "Form.Список", "Template.Паспорт")}
    assert got["InformationRegister.Экспозиции/Resource.Секунды"].parent_id == "InformationRegister.Экспозиции"
    assert rows(metadata.references(texts).select("source_id", "target_id", "context")) == [
        ("Catalog.Телескопы", "Catalog.Купола", "type"),
        ("Catalog.Телескопы", "Document.Ремонт", "type"),
        ("EventSubscription.СборЗаявок", "Catalog.Телескопы", "event"),
        ("EventSubscription.СборЗаявок", "Document.Заявка", "event"),
        ("InformationRegister.Экспозиции", "Catalog.Телескопы", "type"),
        ("Subsystem.Ночь", "Catalog.Телескопы", "content"),
        ("Subsystem.Ночь", "InformationRegister.Экспозиции", "content"),
        ("Subsystem.Ночь", "Report.Погода", "content"),
    ]


def test_forms(spark, texts):
    items = metadata.form_items(texts)
    linked = metadata.link_handlers(items, code.routines(texts.where("path like '%.bsl'")))
    assert rows(linked.select("kind", "name", "is_resolved", "start_line")) == [("Command", "Пуск", False, None), ("Command", "Сверка", True, 5), ("Handler", "OnChange", True, 2)]
    assert rows(metadata.data_path_attribute(items).select("name", "attribute")) == [("Диаметр", "Прибор"), ("Окуляры", "Список"), ("Подпись", None), ("Фокус", "Список")]


def test_rights(spark, texts):
    got = {r.object_id: r for r in metadata.rights(texts).collect()}
    assert set(got) == {"Catalog.Телескопы", "InformationRegister.Экспозиции/Resource.Секунды", "Configuration"}
    assert got["Catalog.Телескопы"].rights == {"Insert": True, "Update": True}
    assert got["Catalog.Телескопы"].has_rls and got["Catalog.Телескопы"].condition == "ГДЕ Купол.Смена = &Смена"
    assert not got["Configuration"].has_rls and got["InformationRegister.Экспозиции/Resource.Секунды"].rights == {"View": False}


def test_entry_points(spark, texts):
    found = code.routines(texts.where("path like '%.bsl'"))
    symbols = found.select(F.col("path").alias("module_path"), "name", names.routine_id("path", "name").alias("node_id"), "start_line")
    points = entrypoints.collect([metadata.entry_facts(texts)], symbols)
    got = {r.kind: r for r in points.withColumn("handler", names.event_name("event")).collect()}
    assert (got["Subscription"].object_id, got["Subscription"].handler, got["Subscription"].is_resolved) == ("Document.Заявка", "ОбработкаПроведения", False)
    assert (got["Job"].id, got["Job"].start_line, got["Job"].is_resolved) == ("ScheduledJob.Сумерки", 5, True)
    assert rows(entrypoints.counts(points)) == [("FormHandler", 0), ("Job", 1), ("Subscription", 1)]


def test_graph_of_the_dump(spark, texts):
    nodes, edges = build.build(texts)
    calls = rows(edges.where("kind = 'Calls'").select("source_id", "target_id"))
    assert (f"routine:module:{A}#НачатьНочь", f"routine:module:{A}#Видимые") in calls
    assert (f"routine:module:{A}#НачатьНочь", f"routine:module:{B}#Записать") in calls
    assert (f"routine:module:{B}#Записать", "call:CommonModule.Журнал.Отправить") in calls
    assert (f"routine:module:{A}#НачатьНочь", "call:Справочники.Телескопы.НайтиПоНаименованию") in calls
    kinds = {r.id: (r.kind, r.is_external) for r in nodes.collect()}
    assert kinds["Catalog.Купола"] == ("External", True) and kinds["Catalog.Телескопы"] == ("MetadataObject", False)
    assert len(kinds) == nodes.count()


def test_calls_through_help_and_types(spark):
    text = "Процедура П()\n\tСписок = Новый Массив;\n\tСписок.Добавить(Сегодня());\n\tСписок.Чужой();\nКонецПроцедуры\n"
    modules = spark.createDataFrame([("Reports/Р/Ext/ObjectModule.bsl", text)], "path string, text string")
    found = code.routines(modules)
    topics = spark.createDataFrame([("массив.добавить",), ("Сегодня",)], "name string")
    got = build.resolve(code.calls(modules, found), found, topics, code.last_types(modules, found))
    assert rows(got.select("callee", "target_id", "stage")) == [("Сегодня", "Platform.Сегодня", 3), ("Список.Добавить", "Platform.массив.добавить", 4), ("Список.Чужой", "call:Список.Чужой", 5)]


def test_partial_build_equals_full_build(spark, texts):
    edited = texts.withColumn("text", F.when(F.col("path") == B, F.concat("text", F.lit("Процедура Стереть()\n\tЗаписать(1);\nКонецПроцедуры\n"))).otherwise(F.col("text")))
    old, full = code.routines(texts.where("path like '%.bsl'")), code.routines(edited.where("path like '%.bsl'"))
    scope = edited.where(F.col("path") == B).select("path")
    partial = changes.replace_rows(old, code.routines(edited.join(scope, "path", "left_semi")), "path", scope)
    assert rows(partial) == rows(full)


def test_index_round_trip_and_version(spark, tmp_path, texts):
    nodes, edges = build.build(texts)
    root = str(tmp_path / "index")
    store.write_index({"nodes": nodes, "edges": edges}, root)
    first = rows(store.read_index(spark, root, "edges").select("source_id", "target_id"))
    assert rows(store.read_index(spark, root, "edges", "target_id").select("source_id", "target_id")) == first
    store.write_index({"nodes": nodes, "edges": edges.limit(1)}, root)
    assert len(first) == edges.count() and store.read_index(spark, root, "edges").count() == 1


def test_exports(spark, texts):
    nodes, edges = build.build(texts)
    dot = [r.line for r in store.graph_dot(nodes, edges, root="Catalog.Телескопы").orderBy("ord", "line").collect()]
    assert dot[0] == "digraph {" and dot[-1] == "}" and any("Catalog.Купола" in x for x in dot)
    assert store.graph_json(nodes, edges).groupBy("part").count().count() == 2


def test_checker_log(spark):
    text = "шум\n{ОбщийМодуль.А.Модуль(12,3)}: Переменная не определена\n  код\n{Справочник.Б}: Предупреждение: что-то\n"
    lines = spark.createDataFrame([("log", i + 1, x) for i, x in enumerate(text.split("\n"))], "path string, n int, line string")
    assert rows(store.checker_log(lines).select("place", "at", "message", "severity", "snippet")) == [
        ("ОбщийМодуль.А.Модуль", 12, "Переменная не определена", "error", "  код"),
        ("Справочник.Б", None, "Предупреждение: что-то", "warning", ""),
    ]


def test_help_archive(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("objects/Array.html", "<h1>Массив (Array)</h1><p>Текст &amp; ещё</p>")
    got = dump.topics_of_archives(dump.in_memory(spark, {"a.hbk": b"\x00" * 47 + raw.getvalue(), "bad.hbk": b"PK\x03\x04broken"}))
    assert rows(got.select("path")) == [("objects/Array.html",)]


def test_watch_and_counters(spark, tmp_path):
    root = tmp_path / "dump"
    root.mkdir()
    for n in range(20):
        (root / f"m{n}.bsl").write_text(MODULE_A)
    seen, store_ = [], {}

    def snapshot():
        store_["known"] = [tuple(r) for r in dump.read_files(spark, str(root)).select("path", "size", "mtime").collect()]

    def step():
        known = lambda: spark.createDataFrame(store_["known"], "path string, size long, mtime timestamp")
        watch.watch(spark, str(root), str(tmp_path / "state"), lambda b: seen.append(("partial", b.count())), lambda: seen.append("full"), known, once=True)
        snapshot()

    snapshot()
    step()  # nothing has changed since the snapshot
    (root / "new.bsl").write_text(MODULE_A)
    step()
    (root / "m4.bsl").write_text(MODULE_A + "// more")
    step()  # written anew
    (root / "m3.bsl").unlink()
    step()  # a module is gone
    (root / "c.xml").write_text(CATALOG)
    step()  # not a module
    assert seen == [("partial", 1), ("partial", 1), "full", "full"]
    told = []
    known = lambda: spark.createDataFrame(store_["known"], "path string, size long, mtime timestamp")
    (root / "later.bsl").write_text(MODULE_A)
    q = watch.watch(spark, str(root), str(tmp_path / "clock"), lambda b: told.append(b.count()), lambda: None, known, seconds=1)
    for _ in range(60):
        if told:
            break
        time.sleep(0.5)
    q.stop()
    assert told[0] == 1
    events = spark.createDataFrame([("2026-01-01 00:01:00", "a"), ("2026-01-01 00:02:00", "a"), ("2026-01-01 00:06:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(watch.usage_counters(events).select("event_type", "n")) == [("a", 2), ("b", 1)]


def test_names(spark):
    df = spark.createDataFrame([("CommonModules/A/Ext/Module.bsl",), ("Catalogs/B/Ext/ObjectModule.bsl",), ("Catalogs/B/Forms/F/Ext/Form/Module.bsl",), ("x.bsl",)], "p string")
    assert [r[0] for r in df.select(names.module_kind("p")).collect()] == ["CommonModule", "ObjectModule", "FormModule", "Unknown"]
    assert [r[0] for r in df.select(names.module_display("p")).collect()] == ["A", "B", "F", "x.bsl"]
    refs = spark.createDataFrame([("cfg:CatalogRef.A",), ("DocumentObject.B.C",), ("xs:string",), ("",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in refs.select(names.reference("t")).collect()] == [("Catalog", "A", None), ("Document", "B", "C"), None, None, None]
