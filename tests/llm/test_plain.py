"""Queries and pipeline stages against plain recomputations of whole tables."""

import math
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from codeloom.llm import langid, licenses, neardup, omh, toxicity
from codeloom.llm.common import cut
from tests.llm.conftest import SMALL


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}


def places_of(word, text):
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def plain_toxicity(text, entries, exceptions):
    """Every entry looked for at every place; what lies inside an exception does not count."""
    folded = toxicity.fold(text)
    spared = [(at, at + len(e)) for w in exceptions if (e := toxicity.fold(w)).strip() for at in places_of(e, folded)]
    total = sum(w for e, w in entries.items() for at in places_of(e, folded) if not any(a <= at and at + len(e) <= b for a, b in spared))
    words = folded.count(" ") - 1
    return 1 - math.exp(-total / (2.5 * (1 + math.log1p(words / toxicity.FREE_WORDS) / 4))) if folded.strip() else 0.0


def test_toxicity_by_a_naive_matcher(spark, texts):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    entries, exceptions = toxicity.learn(docs, labels, toxicity.learned_rows())
    lexicon = (entries or {" st": 4.0, " light ": 5.0}, [*exceptions, "stone"])
    for r in toxicity.score(docs, lexicon).collect():
        want = plain_toxicity(texts[r["doc_id"]], *lexicon)
        assert math.isclose(r["score"], want, abs_tol=1e-9) and r["predicted"] == (want >= toxicity.LIMIT)


def test_license_counts_by_scanning(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r["doc_id"]: r for r in licenses.op9(spark, SMALL).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = sorted((at, label) for p, label in phrases.items() for at in range(len(words)) if words[at:at + len(p.split())] == p.split())
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_languages_by_plain_counts(spark, texts):
    """Naive Bayes over unhashed n-grams gives the same languages."""
    docs = table(spark, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    learned = {r["doc_id"] for r in docs.where(langid.learned_rows()).collect()}
    plain = lambda t: f" {' '.join(''.join(c if c.isalpha() else ' ' for c in t.lower()).split())} "
    grams = lambda t: Counter(p[i:i + n] for p in [plain(t)] for n in (1, 2, 3) for i in range(len(p) - n + 1))
    counts = defaultdict(Counter)
    for i in learned:
        if rows[i]["lang"] is not None:
            counts[rows[i]["lang"]] += grams(texts[i])
    sums = {k: sum(c.values()) for k, c in counts.items()}

    def best(t):
        own = grams(t)
        return min(sorted(counts), key=lambda k: -sum(n * math.log((counts[k][g] + 0.5) / (sums[k] + 0.5 * (1 << langid.BITS))) for g, n in own.items()))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.op3(spark, SMALL).collect()}
    lettered = [i for i, t in texts.items() if any(c.isalpha() for c in t)]
    assert all(got[i] == "und" for i in texts if i not in set(lettered))
    assert sum(got[i] == best(texts[i]) for i in lettered) >= 0.98 * len(lettered)


def classes_of(docs):
    """{id: smallest id of its class} by comparing all pairs."""
    words = {i: t.encode().lower().split() for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(docs)
    sets = {i: set(omh.kmers(words[i]).tolist()) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if docs[a] == docs[b] or (words[a] and words[b] and small >= 0.3 * large and sets[a] & sets[b] and (
                    omh.jaccard(words[a], words[b]) >= neardup.SIMILAR or omh.similarity(words[a], words[b], neardup.SIMILAR))):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_what_the_stages_keep(spark, texts):
    """Each stage's kept ids, recomputed on what it was given."""
    docs = table(spark, "documents")
    rows, kept = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] or "" for r in rows}
        given, docs = docs, cut(stage(spark, docs, SMALL))
        rows = docs.collect()
        kept[name] = {r["doc_id"] for r in rows}
        if name == "language_id":
            assert kept[name] == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "toxicity":
            lexicon = toxicity.learn(given, table(spark, "labels"), toxicity.learned_rows())
            assert kept[name] == {i for i, t in before.items() if plain_toxicity(t, *lexicon) < toxicity.LIMIT}
        elif name == "near_duplicates":
            assert kept[name] == set(classes_of(before).values())
        else:
            items = [t.lower().split() for r in table(spark, "benchmark").collect() for t in [r["text"] or ""]]
            grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
            owns = [(len(u), grams(u)) for u in items if len(u) >= 5]
            bad = set()
            for i, t in before.items():
                w = t.lower().split()
                held = grams(w)
                for m, own in owns:
                    if sum((held & own).values()) >= 0.8 * sum(own.values()):
                        for at in range(max(1, len(w) - 4)):
                            here = grams(w[at:at + m])
                            both = sum((here & own).values())
                            if both and both >= 0.8 * (sum(here.values()) + sum(own.values()) - both):
                                bad.add(i)
                                break
            assert kept[name] == set(before) - bad
    assert len(kept["language_id"]) > len(kept["near_duplicates"]) > 0


def test_the_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for docs, name in ((odd_docs, "odd"), (no_docs, "none")):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "four words are few")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in rows} <= {1, 5, 7, 9, 10, 11, None} and (rows or name == "none")
        assert all(r["copies_"] >= 1 and r["_key"] == 11 for r in rows)
