"""Parsers, the lease, streams, and operators on odd input."""

import datetime

import pytest
from pyspark.sql import functions as F

from metaloom.functions import code
from metaloom.operators import graph, incremental, telemetry, traverse
from metaloom.operators.code import fixpoint
from metaloom.operators.paging import page_params, paged, truncated, window_of
from metaloom.plans import querylang as ql
from metaloom.streaming.events import Lease, debounced, mapped, run_available

MODULE = '''
// Процедура Нет() КонецПроцедуры
&НаСервере
Процедура Первая(Знач А, Б = "x, (y", В) Экспорт
  Общий.Метод(А, , "a,b(", Вложенный(1, 2)); // Общий.Другой()
  Если А Тогда
    Первая(1);
  КонецЕсли;
  М = Новый Массив(3);
КонецПроцедуры

function Second(x)
  S = Catalogs.Goods.Find(x);
  t = S;
  return t;
EndFunction

Процедура Незакрытая()
'''


def test_masked_text_keeps_its_shape():
    m = code.masked(MODULE)
    assert len(m) == len(MODULE) and m.count("\n") == MODULE.count("\n")
    assert "Нет" not in m and "Другой" not in m and "Общий.Метод" in m
    assert code.masked('a = "one\n  |two // three"; b') == "a = " + " " * 4 + "\n" + " " * 16 + "; b"


def test_parse_module():
    found, unclosed = code.parse_module(MODULE)
    assert [(c.name, c.kind, c.export, c.directive) for c in found] == [("Первая", "procedure", True, "&НаСервере"), ("Second", "function", False, "")]
    assert [(p.name, p.by_value, p.default) for p in found[0].params] == [("А", True, None), ("Б", False, '"x, (y"'), ("В", False, None)]
    assert (found[0].line_start, found[0].line_end) == (4, 10)
    assert unclosed == ["Незакрытая"]
    assert code.parse_module(None) == ([], [])


def test_calls_and_events():
    first, second = code.parse_module(MODULE)[0]
    got = code.calls(first)
    assert [(m, n) for m, n, *_ in got] == [("Общий", "Метод"), ("", "Вложенный"), ("", "Первая")]
    assert got[0][4] == ["А", "", '"a,b("', "Вложенный(1, 2)"]
    assert got[0][2] == 5
    assert ("new", "М", "Массив(3)") in [(e, v, w) for e, v, w in code.events(first)] or ("new", "М", "Массив") in code.events(first)
    types = code.local_types(second, {}, {})
    assert types["t"] == ("Catalog.Goods", 0.85)
    assert code.return_type(second, types) == "Catalog.Goods"
    assert code.return_type(first, {}) is None


CATALOG = ql.Catalog(
    [
        ql.Entry("Справочник", "Номенклатура", [("Единица", "attribute", ["Справочник.Единицы"]), ("Поставщик", "attribute", ["Справочник.А", "Справочник.Б"])], {"Состав": [("Свойство", "attribute", [])]}, hierarchical=False, owned=False),
        ql.Entry("Справочник", "Единицы", [("Вес", "attribute", [])]),
        ql.Entry("РегистрНакопления", "Склад", [("Товар", "dimension", ["Справочник.Номенклатура"]), ("Количество", "resource", [])]),
        ql.Entry("РегистрСведений", "Цены", [("Товар", "dimension", ["Справочник.Номенклатура"]), ("Цена", "resource", [])]),
        ql.Entry("РегистрБухгалтерии", "Учет", []),
    ]
)


@pytest.mark.parametrize(
    ("text", "errors", "warnings"),
    [
        ("ВЫБРАТЬ Т.Единица.Вес ИЗ Справочник.Номенклатура КАК Т", 0, 0),
        ("ВЫБРАТЬ Т.Единица.Нет ИЗ Справочник.Номенклатура КАК Т", 1, 0),
        ("ВЫБРАТЬ Т.Поставщик.Что ИЗ Справочник.Номенклатура КАК Т", 0, 0),
        ("ВЫБРАТЬ Т.Родитель ИЗ Справочник.Номенклатура КАК Т", 1, 0),
        ("ВЫБРАТЬ Единица ИЗ Справочник.Номенклатура", 0, 0),
        ("ВЫБРАТЬ Т.Свойство ИЗ Справочник.Номенклатура.Состав КАК Т", 0, 0),
        ("ВЫБРАТЬ Т.КоличествоОстаток ИЗ РегистрНакопления.Склад.Остатки(, Товар = &Т) КАК Т", 0, 0),
        ("ВЫБРАТЬ Т.Количество ИЗ РегистрНакопления.Склад.Остатки КАК Т", 1, 0),
        ("ВЫБРАТЬ Т.Цена, Т.Период ИЗ РегистрСведений.Цены.СрезПоследних(&Д) КАК Т", 0, 0),
        ("ВЫБРАТЬ Т.Чего ИЗ РегистрБухгалтерии.Учет.Остатки КАК Т", 0, 0),
        ("ВЫБРАТЬ 1 ИЗ Справочник.Номенклатур", 1, 0),
        ("ВЫБРАТЬ Т.Х КАК Х ПОМЕСТИТЬ Вт ИЗ Вт0 КАК Т", 1, 0),
        ("SELECT T.Вес AS W INTO Вт FROM Справочник.Единицы AS T; SELECT В.W FROM Вт AS В; DROP Вт; DROP Вт", 0, 1),
        ("ВЫБРАТЬ П.Вес ИЗ (ВЫБРАТЬ Е.Вес КАК Вес ИЗ Справочник.Единицы КАК Е) КАК П", 0, 0),
        ("ВЫБРАТЬ ЗНАЧЕНИЕ(Перечисление.А.Б), ВЫБОР КОГДА Т.Вес > 1 ТОГДА 2 ИНАЧЕ 3 КОНЕЦ КАК К ИЗ Справочник.Единицы КАК Т УПОРЯДОЧИТЬ ПО К", 0, 0),
        ("ВЫБРАТЬ (1 ИЗ Справочник.Единицы", 0, 1),
        ("ОБНОВИТЬ Х", 0, 1),
        ("", 0, 0),
        ('ВЫБРАТЬ "не закрыта', 0, 0),
    ],
)
def test_check(text, errors, warnings):
    got = ql.check(text, CATALOG)
    assert (len(got["errors"]), len(got["warnings"])) == (errors, warnings), got
    assert got["valid"] == (errors == 0)


def test_advise_and_build():
    text = "ВЫБРАТЬ РАЗЛИЧНЫЕ * ИЗ РегистрНакопления.Склад КАК Т ЛЕВОЕ СОЕДИНЕНИЕ (ВЫБРАТЬ 1 КАК А) КАК П ПО ИСТИНА УПОРЯДОЧИТЬ ПО Т.Товар"
    assert {r for _, r in ql.advise(text)} == {"register_main_table", "join_with_subquery", "unbounded_selection", "all_fields", "distinct", "order"}
    assert {r for _, r in ql.advise("ВЫБРАТЬ ПЕРВЫЕ 5 Т.Товар ИЗ РегистрНакопления.Склад.Остатки КАК Т ГДЕ ГОД(Т.Дата) = 2024")} == {"virtual_table_without_parameters", "function_in_condition"}
    built = ql.build(CATALOG, ["РегистрНакопления.Склад", "Справочник.Номенклатура"])
    assert ql.check(built, CATALOG)["valid"], built
    with pytest.raises(ValueError, match="catalogue"):
        ql.build(CATALOG, ["Справочник.Никакой"])


def test_titles(spark):
    from pyspark.sql import functions as F

    from metaloom.functions.text import title_names

    cases = {"Найти (Find (x))": ("Найти", "Find (x)"), "Без скобок": ("Без скобок", ""), None: ("", ""), "": ("", ""), " А ( B ) ": ("А", "B"), "a)": ("a)", ""), "(x)": ("", "x"), "f(a) (g(b)(c))": ("f(a)", "g(b)(c)"), "f(a) g": ("f(a) g", "")}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", title_names(F.col("t")).alias("n")).collect()
    assert {r["t"]: tuple(r["n"]) for r in got} == cases


def test_sentence_chunks_lose_nothing(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from metaloom.functions.text import sentence_chunks

    r = random.Random(3)
    sentence = lambda: "Слово " + " ".join("xyz"[: r.randint(1, 3)] * r.randint(1, 5) for _ in range(r.randint(1, 60))) + r.choice(".!?")
    texts = [None, "", "  ", "Аб. " * 900 + "x" * 5000, "Ab " * 2000, *(" ".join(sentence() for _ in range(r.randint(1, 60))) for _ in range(20))]

    def brute(text):
        out, room = [], ""
        for s in re.split(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ])", text.strip()):
            pieces = []
            while len(s) > 2000:
                at = s.rfind(" ", 0, 2000)
                at = at if at >= 100 else 2000
                pieces, s = [*pieces, s[:at]], s[at:].lstrip(" ")
            if pieces:
                out, room = [*out, *([room] if room else []), *pieces], ""
            if not s:
                continue
            if room and len(room) + 1 + len(s) > 1200:
                out, room = [*out, room], s
            else:
                room = f"{room} {s}" if room else s
        return [*out, room] if room else out

    got = {x["i"]: x["c"] for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sentence_chunks(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        if t is not None:
            assert list(got[i]) == brute(t)
            assert all(len(p) <= 2000 for p in got[i]) and re.sub(r"\s", "", "".join(got[i])) == re.sub(r"\s", "", t)


def test_no_character_of_a_text_is_in_no_chunk(spark):
    from metaloom.operators.search import chunked

    texts = ["Short one.", "w " * 150, "Mid. " + "word " * 250 + "End.", "Long. " + "Another sentence here. " * 200, "x" * 3000]
    rows = chunked(spark.createDataFrame(list(enumerate(texts)), "page int, text string")).collect()
    for i, t in enumerate(texts):
        held = [r["text"] for r in sorted((r for r in rows if r["page"] == i), key=lambda r: r["chunk_index"])]
        if len(t) <= 1500:
            assert held == [t]
        else:
            assert "".join("".join(held[1:]).split()) == "".join(t.split()) and len(held[0]) <= 1501


def test_long_descriptions_are_in_parts(spark):
    from metaloom.operators.search import page_chunks

    entries = spark.createDataFrame([(1, "м", "Имя", "First. " + "Some more words. " * 120, None, None, "", None)], "page int, label string, name string, description string, returns string, params array<string>, syntax string, example string")
    rows = page_chunks(entries).collect()
    assert [(r["chunk_type"], r["chunk_index"]) for r in rows] == [("card", 0), ("description", 0), ("description", 1)]
    assert rows[0]["text"] == "[м] Имя\nFirst." and rows[2]["text"].startswith("[описание ч.2] Имя\n")


def test_as_of_join_does_not_depend_on_buckets(spark):
    import random
    from datetime import datetime, timedelta

    from metaloom.operators.telemetry import assigned

    r = random.Random(2)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=r.randint(0, 400_000))
    calls = [(i, at()) for i in range(300)]
    marks = [(i, at(), f"m{i}") for i in range(40)]
    c = spark.createDataFrame(calls, "id int, ts timestamp")
    m = spark.createDataFrame(marks, "event_id int, ts timestamp, name string")
    want = {i: max(((t, k, n) for k, t, n in marks if t <= ts), default=(0, 0, None))[2] for i, ts in calls}
    for rows in (1_000_000, 50, 3):
        assert {x["id"]: x["mark"] for x in assigned(c, m, rows).collect()} == want
    assert assigned(c.limit(0), m).count() == 0 and assigned(c, m.limit(0)).filter("mark is null").count() == 300


def test_pages(spark):
    assert page_params(0, -3) == (20, 0) and page_params(500, 2) == (100, 2)
    rows = paged(spark.range(7), "id", limit=3, offset=3).collect()
    assert [(r["id"], r["total"], r["has_more"], r["next_offset"]) for r in rows] == [(3, 7, True, 6), (4, 7, True, 6), (5, 7, True, 6)]
    assert paged(spark.range(0), "id", limit=3).count() == 0
    one = spark.createDataFrame([("abcdef",)], "t string").select(truncated(F.col("t"), 4).alias("a"), window_of(F.col("t"), 2, 2).alias("w")).first()
    assert one["a"] == "abcd... [2 more]" and tuple(one["w"]) == ("cd", 6, True, 4)


def test_traversal_of_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "x"), ("x", "d"), ("b", "d")], "src string, dst string")
    assert [tuple(r) for r in traverse.callees(e, "a", 9).collect()] == [("b", 1), ("x", 1), ("c", 2), ("d", 2)]
    assert tuple(traverse.shortest_path(e, "a", "d", 5).first()) == (2, "a > b > d")
    assert tuple(traverse.shortest_path(e, "d", "a", 5).first()) == (None, "")
    assert tuple(traverse.shortest_path(e, "d", "a", 5, directed=False).first()) == (2, "d > b > a")


def test_prefix_ownership_and_merge(spark):
    owners = spark.createDataFrame([("A.b",), ("A",)], "id string")
    members = spark.createDataFrame([("A.b.c",), ("A.bc",), ("A.b",)], "id string")
    assert sorted(map(tuple, graph.owned_by_prefix(owners, members).collect())) == [("A", "A.b"), ("A", "A.b.c"), ("A", "A.bc"), ("A.b", "A.b"), ("A.b", "A.b.c")]
    edges = spark.createDataFrame([("r", "a", "b", 1, "old"), ("r", "a", "b", 2, "new"), ("r", "a", "gone", 3, "x"), ("odd", "a", "b", 4, "x")], "rel string, src string, dst string, seq int, p string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in graph.written_edges(edges, nodes, ["r"]).collect()] == [("r", "a", "b", 2, "new")]


def test_change_plan_of_nothing(spark):
    now = spark.createDataFrame([("a", "1"), ("_root", "2")], "owner string, digest string")
    none = now.limit(0)
    assert [tuple(r) for r in incremental.change_plan(now, none).collect()] == [("a", "added")]
    assert incremental.plan_summary(incremental.change_plan(now, none), none, 10).first()["full"]


def test_blob_hash(spark):
    one = spark.createDataFrame([("hello\n",)], "t string").select(incremental.blob_hash(F.col("t")).alias("h"), F.size(incremental.blob_variants(F.col("t"))).alias("n")).first()
    assert (one["h"], one["n"]) == ("ce013625030ba8dba906f756967f9e9ca394464a", 2)


def test_empty_log_has_full_error_rate(spark):
    calls = spark.createDataFrame([], "ts timestamp, success boolean, duration_ms double")
    assert telemetry.summary(calls).first()["error_rate"] == 100


def test_fixpoint(spark):
    sites = [("m", "a", 1, "Int"), ("a", "b", 2, None), ("b", "c", 3, None), ("m", "d", 4, "Int"), ("m", "d", 5, "Str"), ("d", "e", 6, None), ("c", "a", 7, None)]
    got = {r["key"]: r["kind"] for r in fixpoint(spark.createDataFrame(sites, "caller string, callee string, seq long, kind string")).collect()}
    assert got == {"a": "Int", "b": "Int", "c": "Int", "d": "AMBIGUOUS"}


def test_lease():
    now = [0.0]
    lease = Lease(lambda: now[0])
    assert lease.acquire("a", 10) and lease.acquire("a", 10) and not lease.acquire("b", 10)
    assert not lease.release("b")
    now[0] = 11
    assert lease.acquire("b", 10) and lease.release("b")


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, f"p{i % 3}", t0 + datetime.timedelta(seconds=s), k) for i, (s, k) in enumerate([(0, "created"), (1, "modified"), (2, "deleted"), (3, "modified"), (20, "moved"), (22, "created"), (60, "deleted"), (90, "created")])]
    batch = spark.createDataFrame(rows, "event_id long, path string, ts timestamp, kind string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    lease = Lease()
    run_available(mapped(stream), str(tmp_path / "out"), str(tmp_path / "cp"), lease)
    got = {tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()}
    want = {tuple(r)[:4] for r in debounced(mapped(batch)).collect()}
    assert got and got <= want
    assert all(w[1] >= t0 + datetime.timedelta(seconds=60) for w in want - got)  # the last sessions wait for newer events
    assert lease.owner == "main"
