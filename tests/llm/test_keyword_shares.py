"""Keyword pages of few words, little above half, broken or bracketed."""

from pyspark.sql import functions as F

from loomgraph.llm import keyword_pages as kp
from tests.llm.test_keywords import SPEECH


def _found(spark, pages):
    rows = [(i, t) for i, t in enumerate(SPEECH * 30)] + [(1000 + i, t) for i, t in enumerate(pages)]
    scores = kp.page_scores(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return {r.doc_id for r in kp.keyword_pages(scores).collect()}


def test_short_pages_and_shares(spark):
    assert _found(spark, ["cheap shoes | wall clock\nrunning shoes | cheap clock", "#shoes #clock #rope", SPEECH[0][:60]]) == {1000, 1001}
    scores = spark.createDataFrame([(1, 21.0, 40.0), (2, 20.0, 40.0), (3, 0.0, 0.0)], "doc_id bigint, keyword_words double, words double").withColumn("cost", F.lit(3.0))
    assert [r.doc_id for r in kp.keyword_pages(scores).collect()] == [1]


def test_broken_and_bracketed_keywords(spark):
    broken = "ch�ap shoes wall clock\nrunning sh�es cheap clock\nwall cl�ck cheap shoes\n" * 3
    han = "��鞋 灯� 船锚\n跑鞋 墙� 钟�\n" * 5
    starred = "* cheap shoes\n* wall clock\n* running shoes\n* garden rope\n" * 3
    bracketed = "[shoes] [clock] [rope]\n[garden] [shoes] [lamp]\n" * 4
    speech = "\n".join("".join("�" if c in "áéíóúñ¿" else c for c in x) for x in SPEECH[1].splitlines())
    marked = "# cheap shoes nike running shoes buy clock rope\n# wall clock garden rope lamp shoes cheap nike\n" * 6
    sounds = "# I don't know where he was #\n[door creaks]\n(a man sighs)\n* la la la *\n♪ oh my love\n(man) Where is he?\n" * 4
    assert _found(spark, [broken, han, starred, bracketed, marked, speech, sounds]) == {1000, 1001, 1002, 1003, 1004}
