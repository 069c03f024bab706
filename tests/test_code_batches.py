"""Python tasks over modules and query texts hold few rows at a time, and the parser's work grows with the text."""

import time

import pandas as pd

from metaloom.functions import code
from metaloom.functions.tables import BATCH_BYTES, BATCH_OUT, BATCH_ROWS, yielded
from metaloom.operators import queries
from metaloom.operators.code import call_sites


def test_batches_are_small_and_rows_whole(spark):
    df = spark.range(3000).selectExpr("id", "repeat('x', 20000) AS text").coalesce(1)
    got = yielded(df, lambda t: [(len(t), k) for k in range(3)], "id long, n int, k int")
    assert (got.count(), got.distinct().count()) == (9000, 9000)
    sizes = df.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= min(BATCH_ROWS, BATCH_BYTES // 20000 + 1)


def test_output_comes_in_pieces(spark, monkeypatch):
    most = []
    frames = pd.DataFrame

    class Held:
        """A frame that runs the function where the test can see it."""

        sparkSession = spark

        def mapInPandas(self, run, schema):
            most.extend(len(x) for x in run([frames({"id": [1, 2], "n": [BATCH_OUT * 3, 5]})]))

    yielded(Held(), lambda n: ((k,) for k in range(n)), "id long, k int")
    assert sum(most) == BATCH_OUT * 3 + 5 and max(most) == BATCH_OUT


def test_modules_are_dealt_out(spark):
    modules = spark.range(40).selectExpr("concat('M', id) AS module", "'Процедура А()\n  Ф(1);\nКонецПроцедуры' AS text").coalesce(1)
    assert call_sites(modules).rdd.getNumPartitions() == 4
    assert call_sites(modules).count() == 40


def test_long_callable_is_parsed_in_linear_time():
    def took(n):
        text = "Процедура А()\n" + "  М.Ф(1);\n" * n + "КонецПроцедуры\n"
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            (c,) = code.parse_module(text)[0]
            found = code.calls(c)
            best = min(best, time.process_time() - began)
        assert [x[2] for x in found] == list(range(2, n + 2))
        return best

    assert took(16000) < 20 * took(2000)


def test_query_texts_yield_all_rows(spark):
    texts = spark.createDataFrame([(k, "ВЫБРАТЬ Т.А КАК А ИЗ Справочник.Б КАК Т") for k in range(700)], "id long, text string")
    assert queries.sources(texts).count() == 700
    assert queries.tokens(texts).groupBy("id").count().select("count").distinct().count() == 1


def test_a_text_is_read_once(monkeypatch):
    times = []
    lexed = queries.ql.tokenize
    monkeypatch.setattr(queries.ql, "tokenize", lambda text: times.append(text) or lexed(text))
    assert ("LOW", "order") in queries.ql.advise("ВЫБРАТЬ Т.А ИЗ Справочник.Б КАК Т УПОРЯДОЧИТЬ ПО Т.А")
    assert len(times) == 1


def test_tokens_keep_lines_over_strings_and_comments():
    got = [(t.text, t.line, t.word) for t in queries.ql.tokenize('// a\nВЫБРАТЬ "x\n""y"\n\n // z\n Б^; ')]
    assert got == [("ВЫБРАТЬ", 2, "select"), ('"x\n""y"', 2, '"x\n""y"'), ("Б", 6, "б"), (";", 6, ";")]
    began = time.process_time()
    queries.ql.tokenize("a" + " \n" * 500_000)
    assert time.process_time() - began < 5


def test_files_are_dealt_out(spark):
    from metaloom.sources.metadata_xml import parsed

    files = spark.range(40).selectExpr("concat('Catalogs/P', id, '.xml') AS path", "'<a/>' AS data").coalesce(1)
    assert parsed(files).rdd.getNumPartitions() == 4
    assert parsed(files).filter("dropped = 'no object'").count() == 40
