"""What arguments tell of parameters, by hand."""

from metaloom.operators import code

A = """
Процедура Главная() Экспорт
  М = Новый Массив;
  С = Справочники.Товары.Найти(1);
  Б.Принять(М, С, "лишний");
  б.принять(Неизвестно, Документы.Заказ.Создать(), 5);
  Б.Тайная(М);
  Нет.Такой(М);
  Своя(Новый Структура("А"), Истина);
КонецПроцедуры
Процедура Своя(Что, Да)
КонецПроцедуры
"""
B = """
Процедура Принять(Первый, Второй) Экспорт
КонецПроцедуры
Процедура Тайная(П)
КонецПроцедуры
"""


def test_arguments_of_resolved_calls_type_the_parameters_at_their_places(spark):
    modules = spark.createDataFrame([("А", A), ("Б", B), ("В", None)], "module string, text string")
    got = code.argument_facts(code.typed_arguments(modules), code.callables(modules))
    assert sorted(map(tuple, got.collect())) == [
        ("А", "Своя", "Да", "Boolean", 0.9),
        ("А", "Своя", "Что", "Структура", 0.9),
        ("Б", "Принять", "Второй", "Catalog.Товары", 0.8),
        ("Б", "Принять", "Второй", "Document.Заказ", 0.9),
        ("Б", "Принять", "Первый", "Массив", 0.85),
    ]


def test_a_callable_that_is_declared_twice_counts_once(spark):
    modules = spark.createDataFrame([("А", "Процедура П(Х)\n  П(1);\nКонецПроцедуры\nПроцедура П(У)\nКонецПроцедуры\n")], "module string, text string")
    got = code.argument_facts(code.typed_arguments(modules), code.callables(modules))
    assert list(map(tuple, got.collect())) == [("А", "П", "Х", "Number", 0.9)]
