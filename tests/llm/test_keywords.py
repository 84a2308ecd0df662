"""Speech stays, keyword pages are found."""

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import keyword_pages as kp
from loomgraph.session import only

SPEECH = [
    "1\n00:00:01,000 --> 00:00:02,000\nWhere did you put the rope?\n\n2\n00:00:03,000 --> 00:00:04,000\nI left it in the garden, I think.\n\n3\n00:00:05,000 --> 00:00:06,000\nWe have to go back to the house.\n",
    "{100}{150}No lo sé.|Es la casa de mi padre.\n{200}{250}¿Dónde está la llave?\n{300}{350}Se la di a él ayer en el puerto.",
    "Es ist kalt in der Küche.\nIch habe den Schlüssel nicht.\nWo ist er denn?\nWir müssen auf ihn warten.",
    "Я не знаю, где он.\nЭто мой дом, а не твой.\nКто был там с ней?\nМы были у них вчера.",
    "Je ne sais pas où il est.\nC'est la maison de mon père.\nOn ne va pas dans la cuisine.\nElle est là.",
    "我不知道他在哪里。\n你为什么不去那里？\n这是我们的。\n他们都来了。",
]
SPAM = [
    "cheap shoes | running shoes | cheap shoes\nwall clock | cheap shoes | running shoes | wall clock\ncheap shoes | wall clock | running shoes",
    "https://www.abc.example/shoes\nhttp://def.test/clock.html\nwww.ghi.invalid/shoes?id=4\nhttps://jkl.example/clock/",
    "#shoes #wallclock #shoes12 #cheap_shoes\n#wallclock#shoes#cheapshoes\n#shoes #shoes #wallclock",
    "c h e a p   s h o e s\nCHEAP SHOES cheap sh0es ch3ap shoes\nCHEAP SHOES CHEAP SHOES cheap shoes!!!",
]
HARMLESS = ["♪ la la la ♪\n♪ la la la ♪\n♪ oh my love ♪\n" * 5, "[door creaks]\n[wind howling]\n(sighs)\n" * 4, "", None, "   \n\t", "1\n00:00:01,000 --> 00:00:02,000\n", "Visit www.abc.example\n" + SPEECH[0] * 2]


def _docs(spark):
    rows = [(i, t) for i, t in enumerate(SPEECH * 30)] + [(1000 + i, t) for i, t in enumerate(SPAM)] + [(2000 + i, t) for i, t in enumerate(HARMLESS)] + [(None, SPAM[0])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("n"), F.lit("q").alias("TEXT"), F.lit(3.0).alias("words"))


def test_pages(spark):
    scores = kp.page_scores(_docs(spark)).cache()
    assert scores.count() == 180 + 4 + 7 + 1
    assert {r.doc_id for r in kp.keyword_pages(scores).collect()} == {1000, 1001, 1002, 1003, None}
    assert {r.doc_id for r in scores.filter("words = 0 AND cost IS NULL").collect()} == {2002, 2003, 2004, 2005}
    assert kp.page_scores(_docs(spark).limit(0)).count() == 0


def test_mostly_speech_is_kept(spark):
    docs = only(_docs(spark), "doc_id", "text").unionByName(spark.createDataFrame([(5000, SPEECH[0] * 3 + SPAM[0]), (5001, SPEECH[1] + "\n" + SPAM[0] * 4)], "doc_id bigint, text string"))
    found = {r.doc_id for r in kp.keyword_pages(kp.page_scores(docs)).collect()}
    assert 5000 not in found and 5001 in found


@pytest.mark.parametrize("times", [1, 2])
def test_repair(times):
    for text in ("Où est la clé à côté ?", "♪ вода, неси меня ♪", "我把船锚放在灯塔了。"):
        bad = text
        for _ in range(times):
            bad = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in bad.encode())
        assert kp.repaired(bad) == text
    assert kp.repaired("Слушай, где он?".encode("cp1251").decode("latin-1")) == "Слушай, где он?"
    for text in ("plain", "déjà vu, señor, für Öl", "…“x”", "��"):
        assert kp.repaired(text) == text


def test_lost_line_ends_and_long_texts(spark):
    joined = " ".join(x for x in SPEECH[0].split("\n") if x) + " " + "cheap shoes, wall clock, " * 5
    assert len(kp.pieces(" ".join(["It is here. Where is he?"] * 50))) == 100
    model = kp.ProseModel([("<s>", "<s>", "i", 5), ("<s>", "i", "am", 5), ("i", "am", "</s>", 5), (None, "<s>", "i", 5), (None, "i", "am", 5), (None, "am", "</s>", 5), (None, None, "i", 5), (None, None, "am", 5), (None, None, "</s>", 5)])
    assert model.cost(["i", "am"]) < 0.5 < model.cost(["LOW", "LOW"])
    assert kp.line_scores(model, joined, {}) and kp.line_scores(model, "x " * 200_000, {})


def test_counter_forgets_but_counts():
    a, b = kp.ProseCounter(), kp.ProseCounter(remembered=2)
    for t in SPEECH * 3:
        assert a.add(t) == b.add(t)
    assert a.flush() == b.flush() and sum(a.counts.values()) > 100
