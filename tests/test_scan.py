"""Questions about modules that are asked together take one pass over the texts."""

import pytest
from pyspark.sql import DataFrame

import __spark_entry__
from codeloom.operators import check
from codeloom.plans import tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c06_resolved_names", "c07_propagated_types", "c26_draft_check", "c26_irregular_draft", "j14_irregular_stages", "j14_resolution_stages"])
def test_one_pass_over_the_texts(spark, monkeypatch, name):
    frame = type(spark.range(0))
    assert issubclass(frame, DataFrame)
    passes, plain = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: passes.append(1) or plain(self, *a, **k))
    __spark_entry__.queries()[name](spark, SF)
    assert len(passes) == 1


MODULE = """Перем Общая, Своя;
Процедура А(Раз, Два, РАЗ, Три = Раз)
    Перем Х, у;
    Общая = два.Раз[Х];
КонецПроцедуры
#Если Сервер Тогда
Функция Б(Отказ) Возврат 1; КонецФункции
#Иначе
Функция б(Отказ, Ещё)
    Ю = 1;
КонецФункции
#КонецЕсли
Функция В()
КонецФункции
"""


def test_what_is_idle(spark):
    found = check.draft(spark.createDataFrame([("m", MODULE), ("n", "Перем общая;\n"), ("none", None)], "path string, text string"))
    assert sorted((r.path, r.line, r.rule, r.name) for r in found.collect()) == [
        ("m", 1, "unused-variable", "Своя"), ("m", 2, "unused-parameter", "Три"), ("m", 3, "unused-variable", "у"), ("m", 13, "function-without-return", "В"), ("n", 1, "unused-variable", "общая"),
    ]


def test_chains_and_circles(spark):
    text = "Процедура А(П)\n  А1 = Новый Массив; Б1 = А1; В1 = Б1.Копия; Г1 = Б1.Скопировать(); Д1 = Г1; Круг = Обход; Обход = Круг; Ж = Круг; З = Чужой;\n  Ф(Д1, Ж, П, Круг);\nКонецПроцедуры"
    scan = tokens.Scan(spark.createDataFrame([("m", text)], "path string, text string"), **tokens.SOURCES)
    rows = {r.text: (r.type, r.root) for r in scan.rows("variable", tokens.SOURCES["variable"]).collect()}
    assert rows == {"А1": ("Массив", None), "Б1": (None, "а1"), "В1": (None, None), "Г1": (None, "а1"), "Д1": (None, "а1"), "Круг": (None, None), "Обход": (None, None), "Ж": (None, None), "З": (None, "чужой")}
    passed = scan.rows("call", tokens.SOURCES["call"]).where("call.method = 'Ф'").first().passed
    assert [(x.place, x.root) for x in passed] == [(0, "а1"), (1, "ж"), (2, "п"), (3, "круг")]
