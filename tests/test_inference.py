"""Cross-module types against a plain fix-point, and their maintenance against rebuilds."""

import random

import pytest

from metaloom.operators import inference

SEEDS, EDGES = "owner string, node string, kind string, sure int", "owner string, src string, dst string, loss int"


def brute(seeds, edges):
    facts = {}
    while True:
        told = {}
        for _, n, k, s in seeds:
            told.setdefault(n, []).append((k, s))
        for _, a, b, loss in edges:
            if a in facts:
                k, s = facts[a]
                told.setdefault(b, []).append((k, None if s is None else max(0, s - loss)))
        new = {}
        for n, x in told.items():
            kinds = {k for k, _ in x}
            new[n] = (kinds.pop(), max(s for _, s in x)) if len(kinds) == 1 and "AMBIGUOUS" not in kinds else ("AMBIGUOUS", None)
        if new == facts:
            return facts
        facts = new


def as_dict(df):
    return {r["node"]: (r["kind"], r["sure"]) for r in df.collect()}


def random_rows(r, nodes=14, owners=5):
    name = lambda: f"n{r.randrange(nodes)}"
    seeds = [(f"m{r.randrange(owners)}", name(), r.choice("KKKKL"), r.choice((90, 95))) for _ in range(2)]
    edges = [(f"m{r.randrange(owners)}", name(), name(), r.choice((5, 10))) for _ in range(18)]
    return list(set(seeds)), list(set(edges))


def test_the_fix_point_of_random_flows(spark):
    for seed in (1, 2, 3):
        seeds, edges = random_rows(random.Random(seed))
        got = as_dict(inference.inferred_types(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(edges, EDGES)))
        assert got == brute(seeds, edges) and got


def test_any_sequence_of_changes_gives_the_facts_of_a_rebuild(spark):
    r = random.Random(7)
    seeds, edges = random_rows(r)
    s, e = spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(edges, EDGES)
    facts, few = inference.inferred_types(s, e), []
    for _ in range(5):
        other = {f"m{r.randrange(5)}" for _ in range(r.choice((1, 2)))}
        more_s, more_e = random_rows(r) if r.random() < 0.8 else ([], [])
        more_s, more_e = [x for x in more_s if x[0] in other], [x for x in more_e if x[0] in other]
        seeds, edges = [x for x in seeds if x[0] not in other] + more_s, [x for x in edges if x[0] not in other] + more_e
        facts, s, e, touched = inference.maintained(facts, s, e, spark.createDataFrame([(x,) for x in other], "owner string"), spark.createDataFrame(more_s, SEEDS), spark.createDataFrame(more_e, EDGES))
        assert as_dict(facts) == brute(seeds, edges)
        few.append(touched.count())
    assert min(few) < 14


def test_a_change_touches_what_follows_from_it(spark):
    chains = [(f"m{c}", f"c{c}.{i}", f"c{c}.{i + 1}", 0) for c in range(6) for i in range(9)]
    seeds = [(f"s{c}", f"c{c}.0", "K", 95) for c in range(6)]
    s, e = spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(chains, EDGES)
    empty = spark.createDataFrame([], EDGES)
    facts, _, _, touched = inference.maintained(inference.inferred_types(s, e), s, e, spark.createDataFrame([("s2",)], "owner string"), spark.createDataFrame([("s2", "c2.4", "L", 90)], SEEDS), empty)
    assert {x["node"].split(".")[0] for x in touched.collect()} == {"c2"}
    got = as_dict(facts)
    assert len(got) == 56 and got["c2.9"] == ("L", 90) and "c2.3" not in got and got["c3.9"] == ("K", 95)


@pytest.fixture(scope="module")
def modules(spark):
    a = """
Функция Создать(Вид) Экспорт
  Х = Новый Массив;
  Возврат Х;
КонецФункции
Функция Кругом(П) Экспорт
  Р = Кругом(П);
  Возврат Р;
КонецФункции
Процедура Двое(П)
  Q = П;
КонецПроцедуры
Функция Чужая() Экспорт
  Возврат Б.Назад();
КонецФункции
"""
    b = """
Процедура Главная() Экспорт
  М = А.Создать(1);
  Копия = М;
  Принять(Копия, "x");
  Ц = А.Кругом(М);
  А.Двое(5);
  А.Двое(Истина);
  С = Справочники.Товары.Найти(1);
  С = Неизвестная(С);
  Н = Нет.Такой(М);
КонецПроцедуры
Процедура Принять(Что, Имя) Экспорт
  Ещё = Что;
  Ещё = Имя;
КонецПроцедуры
Функция Назад() Экспорт
  Возврат Новый Структура;
КонецФункции
"""
    return spark.createDataFrame([("А", a), ("Б", b), ("В", None)], "module string, text string")


def test_types_of_parameters_and_returned_values_feed_each_other(modules):
    got = as_dict(inference.inferred_types(*inference.flows(modules)))
    assert got["а|создать|return|"] == ("Массив", 90) and got["б|главная|var|м"] == ("Массив", 85)
    assert got["б|принять|param|что"] == ("Массив", 70) and got["б|принять|param|имя"] == ("String", 90)
    assert got["б|принять|var|ещё"] == ("String", 85)  # the last assignment counts
    assert got["а|двое|param|п"] == ("AMBIGUOUS", None) == got["а|двое|var|q"]
    assert got["а|чужая|return|"] == ("Структура", 90) and got["а|создать|param|вид"] == ("Number", 90)
    assert got["а|кругом|param|п"] == ("Массив", 75)  # its own call passes its own parameter back: the cycle ends
    assert not {"а|кругом|return|", "б|главная|var|ц", "б|главная|var|н", "б|главная|var|с"} & set(got)


def test_no_modules(spark, modules):
    assert inference.inferred_types(*inference.flows(modules.limit(0))).count() == 0


def test_no_large_table_of_the_fix_point_is_gathered_at_the_driver(spark, monkeypatch):
    """Joins of tables of more than FEW rows are by sorted shuffles, whatever the sizes of files say."""
    from metaloom.operators import inference
    from metaloom.plans.catalogue import QUERIES

    plans, write = [], inference.materialized

    def watched(df, name):
        if name != "changed":  # its other join is decided by Spark on measured sizes
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(inference, "materialized", watched)
    monkeypatch.setattr(inference, "FEW", -1)
    modules = spark.createDataFrame([(f"M{k}", f"Функция Ф(А) Экспорт\n  Р = M{k + 1}.Ф(А); M{k + 2}.Ф(5);\n  Возврат Р;\nКонецФункции\n") for k in range(6)], "module string, text string")
    seeds, edges = inference.flows(modules)
    facts = inference.inferred_types(seeds, edges)
    changed = spark.createDataFrame([("M3",)], "owner string")
    again = inference.maintained(facts, seeds, edges, changed, seeds.join(changed, "owner", "left_semi"), edges.join(changed, "owner", "left_semi"))[0]
    assert sorted(again.collect()) == sorted(facts.collect())
    plans.append(inference._passed(edges, facts, 0)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]
    assert "BroadcastExchange" in inference._passed(edges, facts, -1)._jdf.queryExecution().executedPlan().toString()
