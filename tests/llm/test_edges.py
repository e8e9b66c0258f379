"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat, decontaminate, divergence, langid, licenses, lm, mixing, neardup, toxicity, urlrules

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect() if r["doc_id"] is not None}


@pytest.fixture(scope="module")
def items(spark, odd_docs):
    words = next(r["text"] for r in odd_docs.where("doc_id = 1").collect()).split()
    return spark.createDataFrame([(1, " ".join(words[10:40])), (2, None), (3, ""), (4, "four words are few"), (1, " ".join(words[10:40]))], ITEMS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)], LABELS)


def test_lm(odd_docs, no_docs):
    rows = lm.score(odd_docs, F.col("doc_id").isin(1, 8)).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 1 and got[7]["n_tokens"] == 30_001
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert lm.score(no_docs, F.lit(False)).count() == 0
    # nothing to learn from
    assert {r["train_tokens"] for r in lm.score(odd_docs, F.lit(True)).collect()} == {0}


def test_decontamination(odd_docs, no_docs, items):
    found = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.matches(odd_docs, items).collect()}
    assert found == {(1, 1, 10)}
    kept = decontaminate.keep_clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert {r["_key"] for r in kept.collect()} == {11}
    assert decontaminate.keep_clean(no_docs, items).count() == 0
    assert decontaminate.keep_clean(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_language(odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    got = langid.identify(odd_docs, model)
    assert got.count() == odd_docs.count()
    one = by_id(got)
    assert all(one[k]["lang_pred"] == "und" and one[k]["score"] == 0 for k in (2, 3, 4, 8))
    assert one[1]["lang_pred"] in model[0] and 0 < one[1]["score"] <= 1
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {2, 3, 4, 8} & {r["doc_id"] for r in kept.collect()}
    assert langid.train(no_docs, F.lit(True))[0] == [] and langid.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.train(no_docs, F.lit(True))).collect()} == {"und"}


def test_mixing(odd_docs, no_docs):
    rows = mixing.plan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["source"] is None} == {0}
    kept = mixing.mix(odd_docs)
    assert kept.columns == [*odd_docs.columns, "copies_"]
    # equal rows come once, with all their copies
    assert kept.agg(F.sum("copies_")).first()[0] == sum(r["copies"] for r in rows)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_near_duplicates(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    classes = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert classes[6] == classes[5] == 5 and classes[3] == 2 and classes[4] == 4 and classes[7] == 7
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 4, 5, 7, 8, 9, 10, 11]
    assert {r["_key"] for r in kept.collect()} == {11}
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0


def test_toxicity(odd_docs, no_docs, labels):
    lexicon = ({" ston": 5.0}, ["stonework"])
    got = toxicity.score(odd_docs, lexicon)
    assert got.count() == odd_docs.count()
    one = by_id(got)
    assert all(one[k]["score"] == 0 and one[k]["predicted"] == 0 for k in (2, 3, 4, 8, 9, 10, 11)) and one[1]["predicted"] == 1
    assert toxicity.keep_harmless(odd_docs, lexicon).columns == odd_docs.columns
    assert toxicity.learn(odd_docs, labels, F.lit(True))[0] == {}  # one labelled text is no evidence
    assert toxicity.learn(no_docs, labels, F.lit(True)) == ({}, []) == toxicity.learn(odd_docs, labels.limit(0), F.lit(True))
    assert toxicity.score(no_docs, lexicon).count() == 0


def test_licenses(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["n_base"] == 0 and r["labels"] == "" and r["first_word"] is None for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows if r["doc_id"] in (2, 7, 8, 9)} == {2: 0, 7: 30_000, 8: 2, 9: 1}
    assert licenses.scan(no_docs).count() == 0


def test_divergence(odd_docs, no_docs):
    refs = divergence.references(odd_docs)
    rows = divergence.judge(odd_docs, refs).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r["kept"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert divergence.judge(odd_docs, divergence.references(no_docs)).where("kept").count() > 0
    assert divergence.judge(no_docs, refs).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, parts string, example int"
    rows = [(1, 0, "user", None, "p", 1), (1, 1, "assistant", "", "p", 1), (None, None, None, None, "p", 1), (2, 0, "user", "a", "p", 1),
            (2, 0, "user", "a", "p", 1), (3, 0, "assistant", "b" * 200_000, "p", 1), (3, 1, "user", " </s>\\</s>", "p", 1)]
    turns = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(turns)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (2, 0), None: (1, 0), 2: (2, 0), 3: (2, 200_000)}
    assert chat.examples(turns.limit(0)).count() == 0


def test_urls(spark, labels):
    pages = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, "http://a.NET/es/1", "k"), (2, "", "k"), (3, "no scheme", "k"), (4, "x://", "k"),
                                   (5, "http://example.com/en/?" + "q" * 100_000, "k")], "page_id long, url string, host string")
    rules = urlrules.mine(pages, labels)
    got = urlrules.judge(pages, rules).collect()
    assert len(got) == 7
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        (1, "", "", None, "allow"), (None, "a.net", "/es/1", "net/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "example.com", "/en/", "example.com/en/", "block")}
    none = urlrules.mine(pages.limit(0), labels.limit(0))
    assert none.count() == 0 and urlrules.judge(pages.limit(0), none).count() == 0
