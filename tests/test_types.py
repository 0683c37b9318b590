"""Types over aliases, copies, circles and calls, by hand."""

from codeloom.plans import tokens, types

MODULE = """Процедура Первая()
    Список = Новый Массив;
    Вторая(Список, 1);
    Вторая(Другой);
    Список = Новый("Структура");
    Вторая(Список);
    Копия = Список.Скопировать();
    Я = Ты; Ты = Я;
    Третья(Копия);
    Итог = Новый Массив; Итог = 1;
КонецПроцедуры
Процедура Вторая(Приём, Второй = 2)
    Третья(приём);
КонецПроцедуры
Процедура Третья(Знач Где)
    Четвёртая((Где), Где);
    Своё = Новый Запрос;
КонецПроцедуры
Процедура Четвёртая(А, Б)
    А = Новый Файл; Пятая(Б);
КонецПроцедуры
Процедура Пятая(В)
    Г = В; Д = Г; Первая();
КонецПроцедуры
"""


def test_types(spark):
    df = spark.createDataFrame([("m", MODULE), ("empty", "")], "path string, text string")
    got = sorted(tuple(r) for r in types.propagated_types(tokens.Scan(df), rounds=3).select("routine", "name", "type", "round").collect())
    assert got == sorted([
        ("Первая", "Список", "Структура", 0), ("Первая", "Копия", "Структура", 0), ("Третья", "Своё", "Запрос", 0), ("Четвёртая", "А", "Файл", 0),
        ("Вторая", "Приём", "Структура", 1), ("Третья", "Где", "Структура", 1), ("Четвёртая", "Б", "Структура", 2), ("Пятая", "В", "Структура", 3), ("Пятая", "Г", "Структура", 3), ("Пятая", "Д", "Структура", 3),
    ])
    two = types.propagated_types(tokens.Scan(df), rounds=2)
    assert two.where("routine = 'Пятая'").count() == 0
