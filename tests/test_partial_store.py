"""A store renewed in part equals one that is built anew."""

from codeloom.sources import partial

MODULES = {f"CommonModules/M{n}/Ext/Module.bsl": f"Процедура Шаг{n}() Экспорт\n  M{(n + 1) % 12}.Шаг{(n + 1) % 12}();\n  Общий(1);\n  Х = Новый Массив; Х.Добавить(1);\nКонецПроцедуры\n" for n in range(12)}


def state(store):
    return {t: sorted(map(str, (r.asDict() for r in store.read(t).select(*sorted(store.read(t).columns)).collect()))) for t in partial.TABLES}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_partial_equals_full(spark, tmp_path):
    topics = spark.createDataFrame([("Массив.Добавить",)], "name string")
    store = partial.PartialStore(spark, str(tmp_path / "a"), buckets=32)
    assert store.write(partial.module_tables(frame(spark, MODULES), topics)) == 96
    path = lambda n: f"CommonModules/M{n}/Ext/Module.bsl"
    # A routine goes (calls to it are lost), one comes that unresolved calls name, a module goes, and one is new.
    edited = {path(3): MODULES[path(3)].replace("Шаг3", "Иной3"), path(5): MODULES[path(5)] + "Процедура Общий(А) Экспорт\nКонецПроцедуры\n", path(40): "Процедура Шаг99() Экспорт\n  M3.Иной3(); M3.Шаг3();\nКонецПроцедуры\n"}
    now = {p: t for p, t in (MODULES | edited).items() if p != path(8)}
    written = partial.renew(store, frame(spark, edited), spark.createDataFrame([(path(8),)], "path string"), topics)
    full = partial.PartialStore(spark, str(tmp_path / "b"), buckets=32)
    full.write(partial.module_tables(frame(spark, now), topics))
    assert state(store) == state(full)
    assert 0 < written < 60
    targets = {(r.path, r.callee): r.target_id for r in store.read("calls").collect()}
    assert targets[path(2), "M3.Шаг3"] == "call:M3.Шаг3" and targets[path(7), "M8.Шаг8"] == "call:M8.Шаг8"
    assert targets[path(40), "M3.Иной3"] == f"routine:module:{path(3)}#Иной3" and targets[path(5), "Общий"] == f"routine:module:{path(5)}#Общий"
    # And back: lost targets are found again.
    partial.renew(store, frame(spark, {p: MODULES[p] for p in (path(3), path(5), path(8))}), spark.createDataFrame([(path(40),)], "path string"), topics)
    again = partial.PartialStore(spark, str(tmp_path / "c"), buckets=32)
    again.write(partial.module_tables(frame(spark, MODULES), topics))
    assert state(store) == state(again)
