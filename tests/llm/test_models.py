"""Language identification, quality classifier and decision list: held-out accuracy and edges."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planmark.llm import decision_list as dl, langid, quality
from planmark.llm.queries import Q, remainder

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = Q["op3_language_id"](spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 250
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, documents):
    english, german = "the house and the tree with the road " * 9, "der Baum und das Haus mit der Straße " * 9
    learned = documents(*[(i, *((english, "en") if i % 2 else (german, "de"))) for i in range(40)])
    model = langid.train(learned.withColumn("l_found", F.lit(1)))
    assert model.languages == ["de", "en"]
    texts = [None, "", "1234 ² ٣ --- !!", english, german, "the", english * 300]
    asked = documents(*enumerate(texts), score="clash", lang_pred=3, l_found="x")
    got = {r["doc_id"]: r for r in langid.predict(asked, model, reject=False).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert got[0]["score"] == 0 and got[0]["l_found"] == "x" if "l_found" in got[0].asDict() else True
    unknown = {r["doc_id"]: r for r in langid.predict(asked, model).collect()}
    assert all(unknown[i]["lang_pred"] == "und" for i in range(7) if not unknown[i]["accepted"])
    none = langid.train(learned.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(asked, none, reject=False).collect()} == {"und"}
    assert langid.predict(asked.filter("doc_id > 99"), model).count() == 0


def test_subwords_stay_inside_their_text():
    alone = [langid.subwords([x])[0][0].tolist() for x in ("ab", "cd")]
    both, counts = langid.subwords(["ab", "cd"])[0]
    assert both.tolist() == alone[0] + alone[1] and counts.tolist() == [3, 3]
    assert langid.subwords(["", "1"])[0][1].tolist() == [0, 0]


def test_every_language_is_learned(spark):
    """More languages than a hundred, one of them far larger, and a sample smaller than most of them."""
    letters = [chr(0x1200 + i) * 3 for i in range(130)]
    rows = [(i, " ".join([letters[i % 130]] * 20), f"l{i % 130:03d}") for i in range(390)]
    rows += [(1000 + i, " ".join([letters[0]] * 20), "l000") for i in range(600)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=390)
    assert model.languages == [f"l{i:03d}" for i in range(130)]


def test_quality_held_out(spark):
    found = Q["op7_quality"](spark, FOLDER)
    rows = found.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_edges(spark, documents):
    texts = [None, "", "fine words stand here", "###", "fine words stand here"]
    df = documents(*enumerate(texts), score="clash")
    labels = spark.createDataFrame([(0, None), (None, 1), (2, 1)], "doc_id long, quality int")
    net = quality.train(df, labels)  # one class only
    assert {r["score"] for r in quality.score(df, net).collect()} == {1.0}
    assert quality.train(df, labels.filter("false")).constant == 0.5
    good = "plain words in a plain row "
    many = documents(*[(i, good * 5 if i % 2 else "*** $$$ ### " * 9) for i in range(60)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1)], "doc_id long, quality int")
    net = quality.train(many, marks, remainder(3) != 1)
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(*enumerate([None, "", good, "$$$ *** ### ***", good * 9000])), net).collect()}
    assert got[2] > 0.5 > got[3] and got[4] > 0.5 and got[0] == got[1]
    assert quality.score(many.filter("doc_id < 0"), net).count() == 0


def counted(text):
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_against_brute_force(documents):
    draw = random.Random(2)
    texts = [None, "", " \n\t ", "one", "a b c d", "é ü\x1cx", "\n\n a \n a\n a ", "w " * 7, "w " * 8, "w " * 9, "x y " * 4000]
    for _ in range(60):
        texts.append("".join(draw.choice(["a", "b", "#", "<", " ", " ", "\n", "\t", "é", "\x0b", "a b c d e f g h "]) for _ in range(draw.randint(1, 120))))
    df = documents(*enumerate(texts), n_words="clash", t_body=1, kept="x")
    rows = {r["doc_id"]: r for r in dl.judge(df, []).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert tuple(rows[i][c] for c in dl.STATISTICS[:5]) == counted(text), repr(text)[:80]
        n, repeated = rows[i]["n_words"], rows[i]["n_repeat_words"]
        assert rows[i]["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert rows[i]["kept"] == (not rows[i]["base_failed"])


def test_rules_learn_a_conjunction_and_print():
    draw = np.random.default_rng(0)
    values = {"a": draw.random(2000), "b": draw.random(2000)}
    good = ~((values["a"] > 0.7) & (values["b"] < 0.3))
    rules = dl.learn(values, good, np.ones(2000))
    covered = np.zeros(2000, dtype=bool)
    for r in rules:
        covered |= r.covers(values)
    assert (covered == ~good).mean() > 0.98 and "drop if" in str(rules[0])
    assert dl.learn(values, np.ones(2000, dtype=bool), np.ones(2000)) == []


def test_rules_on_labels(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = Q["op9_quality_rules"](spark, FOLDER)
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in found._jdf.queryExecution().toString()]
    rows = found.join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.98
    assert sum(r["kept"] for r in bad) / max(1, len(bad)) < 0.2
    assert found.filter("kept").count() + found.filter("not kept").count() == documents.count()


def test_rules_edges(spark, documents):
    df = documents((1, "a " * 30), (1, "a " * 30), (None, None))
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert dl.train(df, labels) == []
    assert dl.judge(df.filter("doc_id > 5"), []).count() == 0
    with pytest.raises(KeyError):
        dl.verdict([dl.Rule((dl.Condition("no such", True, 1.0),), False)], dl.features())
