"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bilinear, chat, decontaminate, divergence, langid, licenses, lm, mixing, neardup, omh, toxicity, urlrules
from tests.llm.conftest import SF

WORDS = [a + b for a in ("ka", "to", "ri", "mu", "sel", "dan", "ov", "pe") for b in ("la", "no", "st", "ek", "ui", "ram", "qo", "fi", "zu")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def grams(words, k=5):
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in read(spark, "documents").collect()}


def test_lm_probabilities_sum_to_one():
    g = np.random.default_rng(1)
    counts = g.integers(0, 50, bilinear.CLASSES).astype(float)
    share = g.random(bilinear.CLASSES) * 0.5
    t = bilinear.table(bilinear.initial(counts), share)
    for one, two in ((0, 5), (bilinear.START, bilinear.START), (700, bilinear.END)):
        logs, unknown = t.log(np.full(bilinear.CLASSES, one), np.full(bilinear.CLASSES, two), np.arange(bilinear.CLASSES))
        p = 10 ** logs
        assert abs(p.sum() - 1) < 1e-3
        assert abs((p * (1 - share)).sum() + 10 ** unknown[0] - 1) < 1e-3  # known words and the unknown one


def test_lm_counts_and_gain(spark, texts):
    rows = lm.op1(spark, SF).collect()
    words = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = words[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held) and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in ws), rel_tol=1e-9)
    ours, base = (sum(r[c] for r in rows if r["held_out"]) for c in ("score", "base_score"))
    assert ours > 0.9 * base  # both are negative


def test_decontamination_against_brute_force(spark, make_docs):
    r = random.Random(3)
    items = [(i, prose(r, r.choice((12, 20, 35)))) for i in range(12)]
    docs = []
    for d in range(40):
        w = prose(r, 120).split()
        if d % 2:
            piece = items[d % 12][1].split()
            if d % 4 == 3:
                piece = piece[1:] if d % 8 == 3 else [*piece[:3], "other", *piece[4:]]
            w[d:d] = piece
        docs.append((d, " ".join(w), "en", "s"))
    expected = set()
    for d, t, *_ in docs:
        w = t.split()
        for i, u in items:
            m, own = len(u.split()), shingles(u)
            for at in range(len(w) - m + 1):
                here = shingles(" ".join(w[at:at + m]))
                if len(here & own) / len(here | own) >= 0.8:
                    expected.add((d, i))
    assert len(expected) >= 10
    # a passage with words put into its middle: the best window lies between those in line with its halves
    u = prose(r, 200).split()
    w = [*prose(r, 8).split(), *u[8:100], *prose(r, 16).split(), *u[100:192], *prose(r, 8).split()]
    items.append((90, " ".join(u)))
    docs.append((90, " ".join(w), "en", "s"))
    expected.add((90, 90))
    # insertions, deletions and changes in the middle and at both ends, kept or not by every window there is
    for d in range(100, 160):
        i, u = r.choice(items[:12])
        w = u.split()
        for _ in range(r.randrange(4)):
            at = r.choice((0, len(w) - 1, r.randrange(len(w))))
            w[at:at + r.randrange(2)] = [r.choice(WORDS) for _ in range(r.randrange(3))]
            w = w or ["x"]
        w = [*prose(r, r.choice((0, 3, 40))).split(), *w, *prose(r, r.choice((0, 3, 40))).split()]
        docs.append((d, " ".join(w), "en", "s"))
        for i, u in items:
            m, own = len(u.split()), Counter(grams(u.split()))
            for at in range(max(1, len(w) - 4)):
                here = Counter(grams(w[at:at + m]))
                both = sum((here & own).values())
                if both and both >= 0.8 * (sum(here.values()) + sum(own.values()) - both):
                    expected.add((d, i))
    for rows in (decontaminate.BROADCAST_ROWS, 0):  # 0: nothing is broadcast
        got = decontaminate.matches(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), rows)
        assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == expected


def test_language_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in read(spark, "documents").select("doc_id", "lang").collect()}
    held = [r for r in langid.op3(spark, SF).collect() if r["held_out"]]
    assert len(held) > 200 and np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_chat_round_trip(spark):
    r = random.Random(8)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", " ", "\n", "a", "\\</s>", "é", "[", "</", "s>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd </s> role"]), "".join(r.choice(bits) for _ in range(r.randrange(9)))) for c in range(60) for t in range(r.randrange(1, 7))]
    out = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x["conv_id"]: x for x in chat.digests(out).collect()}
    chars = {x["conv_id"]: x["n"] for x in out.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    for c in range(60):
        turns = sorted(x[1:] for x in rows if x[0] == c)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == chars[c] and got[c]["n_turns"] == len(turns)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing_targets(make_docs):
    r = random.Random(4)
    docs = [(i, prose(r, r.randrange(1, 60)), "en", s) for i, s in enumerate(["b"] * 400 + ["a"] * 8 + [None] * 90 + ["é"] * 200 + ["Z"] * 3)]
    plan = mixing.plan(make_docs(docs))
    rows = [x.asDict() for x in plan.collect()]
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += len(d[1].split())
    want = brute_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for x in rows:
        assert x["source_size"] == sizes[x["source"]] and math.isclose(x["target"], want[x["source"]], rel_tol=1e-9)
        assert x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
        largest[x["source"]] = max(largest[x["source"]], x["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)  # only one document a source is rounded alone
    again = sorted((x["doc_id"], x["copies"]) for x in plan.collect())
    assert again == sorted((x["doc_id"], x["copies"]) for x in rows)


def test_pivotal_rounding_is_fair(make_docs):
    """Over many documents of one source every size is taken at the same rate."""
    docs = [(i, "w " * (1 + i % 7), "en", "a") for i in range(3000)] + [(10_000 + i, "w " * 40, "en", "b") for i in range(300)]
    rows = [x for x in mixing.plan(make_docs(docs)).collect() if x["source"] == "a"]
    rate = rows[0]["target"] / rows[0]["source_size"]
    for size in range(1, 8):
        own = [x["copies"] for x in rows if x["size"] == size]
        assert abs(np.mean(own) - rate) < 0.1


def test_near_duplicates_against_brute_force(make_docs):
    r = random.Random(6)
    docs, n = [], 0
    for _ in range(25):
        base = prose(r, r.choice((30, 90, 200))).split()
        for k in range(r.choice((1, 2, 4, 7))):
            w = list(base)
            for _ in range(k * r.choice((0, 1, 2))):
                w[r.randrange(len(w))] = r.choice(WORDS) + "x"
            docs.append((n, " ".join(w), "en", "s"))
            n += 1
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [shingles(d[1]) for d in docs]
    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(make_docs(docs)).collect()}
    assert got == {i: find(i) for i in range(n)} and len(set(got.values())) < n


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a = [r.randrange(6) for _ in range(r.randrange(1, 30))]
        b = [r.randrange(6) for _ in range(r.randrange(1, 30))]
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        assert omh._banded(a, b, max(len(a), len(b))) == row[-1]


def test_large_group_of_copies_stays_together(make_docs):
    r = random.Random(9)
    base = prose(r, 150).split()
    docs = [(0, " ".join(base), "en", "s")]
    for i in range(1, 120):
        w = list(base)
        w[r.randrange(150)] = f"new{i}"
        docs.append((i, " ".join(w), "en", "s"))
    assert {x["class_id"] for x in neardup.near_duplicates(make_docs(docs)).collect()} == {0}


def test_near_duplicates_that_share_a_template(make_docs):
    """Pairs of 0.8 among many texts of a long template that are below 0.8 to each other."""
    r = random.Random(12)
    template, docs = prose(r, 174), []
    for i in range(560):
        docs.append((len(docs), f"{template} {prose(r, 30)}", "en", "s"))
        if i < 60:
            w = docs[-1][1].split()
            for k in r.sample(range(len(w)), 4):
                w[k] = f"other{r.randrange(10**9)}"
            docs.append((len(docs), " ".join(w), "en", "s"))
    sets = [shingles(d[1]) for d in docs]
    near = {(i, j) for j in range(len(docs)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    want = {d: d for d, *_ in docs} | {j: i for i, j in near}
    assert len(near) >= 50 and len({x for p in near for x in p}) == 2 * len(near)
    got = {x["doc_id"]: (x["class_id"], x["class_size"]) for x in neardup.near_duplicates(make_docs(docs)).collect()}
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(n == Counter(want.values())[want[i]] for i, (_, n) in got.items())


def test_a_text_pasted_twice_is_a_near_duplicate(make_docs):
    """Sets of k-mers that are nearly equal, in texts of very different length."""
    r = random.Random(21)
    one, two = prose(r, 200), prose(r, 200)
    docs = [(0, one, "en", "s"), (1, f"{one} {one}", "en", "s"), (2, f"{two} {two} {two}", "en", "s"), (3, two, "en", "s"), (4, f"{one} {two}", "en", "s")]
    got = {x["doc_id"]: (x["class_id"], x["class_size"]) for x in neardup.near_duplicates(make_docs(docs)).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 2), 3: (2, 2), 4: (4, 1)}


def test_url_rules(spark):
    r = random.Random(7)
    pages, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        host = f"{'casino' if bad else r.choice(WORDS)}-{r.choice(WORDS)}.example.org"
        pages.append((i, f"https://{host}/{r.choice(WORDS)}/{i}?ref=x"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(pages, "page_id long, url string")
    rules = urlrules.mine(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert ["word:casino"] in [x["items"] for x in rules.collect()], rules.collect()
    got = {x["page_id"]: x["verdict"] for x in urlrules.judge(df, rules).collect()}
    assert got == {i: "block" if i % 6 == 0 else "allow" for i in range(600)}


def test_mined_rules_against_brute_force(spark):
    """A site template of 25 fixed tokens, common and long tokens, and a combination of two that are not bad alone."""
    from itertools import combinations
    r, long_name = random.Random(8), "n" * 120
    fixed = "/".join(f"part{'abcdefghijklmnopqrstuvwxy'[i]}" for i in range(25))
    pages, labels = [], []
    for i in range(900):
        site, name, mark = r.random() < 0.3, r.random() < 0.7, r.random() < 0.4
        scheme, host = ("https" if name else "http"), ("tpl" if site else r.choice(("one", "two")))
        url = f"{scheme}://{host}.test/{fixed if site else 'x'}/{i}?{long_name if mark else 'q'}=1"
        bad = (name and mark and not site and r.random() < 0.95) or r.random() < 0.02
        pages.append((i, url))
        labels.append((i, 0 if bad else 1, 0))
    pages.append((10**6, None))
    rules = urlrules.mine(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {tuple(x["items"]) for x in rules.collect()}
    held = [(frozenset(x[0]), b == 0) for x, (_, b, _) in zip(
        spark.createDataFrame(pages[:900], "page_id long, url string").orderBy("page_id").select(urlrules.tokens(F.col("url"))).collect(), labels, strict=True)]
    least = max(urlrules.SUPPORT * 900, urlrules.LEAST_URLS)
    # one item for tokens of the same urls
    where = {}
    for token in sorted({t for h, _ in held for t in h}):
        where.setdefault(frozenset(k for k, (h, _) in enumerate(held) if token in h), token)
    items = {t: w for w, t in where.items() if len(w) >= least}
    bad, want = {k for k, (_, b) in enumerate(held) if b}, set()
    for size in range(1, len(items) + 1):
        for combo in combinations(sorted(items), size):
            urls = frozenset.intersection(*(items[t] for t in combo))
            if len(urls & bad) >= least and len(urls & bad) >= urlrules.CONFIDENCE * len(urls) and not any(set(w) < set(combo) for w in want):
                want.add(combo)
    assert got == want and any(f"query:{long_name}" in c and len(c) > 1 for c in want)


def test_given_url_rules_against_brute_force(spark):
    def brute(url):
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"
    rows = urlrules.op7(spark, SF).join(read(spark, "pages").select("page_id", "url"), "page_id").collect()
    assert len(rows) == read(spark, "pages").count()
    for x in rows:
        host, path, rule, verdict = brute(x["url"])
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert rule is None or x["verdict"] == verdict


def test_toxicity_held_out(spark):
    marks = {r["doc_id"]: r["toxic"] for r in read(spark, "labels").collect()}
    held = [(marks[r["doc_id"]], r["predicted"]) for r in toxicity.op8(spark, SF).collect() if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([p for t, p in held if t]) > 0.6 and np.mean([p for t, p in held if not t]) < 0.03


def test_folding_and_exceptions():
    assert toxicity.fold("ST\u041fPID! \u0455tup1d l0ser 2024 na\u00efve") == " st\u043fpid stupid loser na\u00efve "
    a = toxicity._automaton({" los": 6.0}, ["lost property"])
    assert toxicity.rate("what a l0ser", a) > 0.7 and toxicity.rate("our lost property office", a) == 0 and toxicity.rate("closer", a) == 0
    assert toxicity.rate("a loser " + "word " * 20_000, a) < toxicity.rate("a loser", a)


def test_licenses(make_docs):
    r = random.Random(1)
    notices = [licenses.TEMPLATES[k][1] for k in range(len(licenses.TEMPLATES))]
    docs = [(i, f"{prose(r, 40)}\n{t}\n{prose(r, 30)}", "en", "s") for i, t in enumerate(notices)] + [(100 + i, prose(r, 60), "en", "s") for i in range(60)]
    docs.append((99, "MIT License mit-license " + prose(r, 3) + " the MIT\nLICENSE", "en", "s"))
    rows = {x["doc_id"]: x for x in licenses.scan(make_docs(docs)).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in rows[i]["labels"].split(","), (label, rows[i])
    assert all(rows[100 + i]["labels"] == "" for i in range(60))
    assert (rows[99]["n_base"], rows[99]["first_word"], rows[99]["last_word"], rows[99]["n_words"]) == (3, 0, 8, 10)


def test_several_licenses_in_a_text(make_docs):
    r = random.Random(11)
    picks = [range(len(licenses.TEMPLATES)), (0, 1, 2), *[r.sample(range(len(licenses.TEMPLATES)), r.choice((2, 3, 5))) for _ in range(60)]]
    docs = [(i, prose(r, 20) + "".join(f"\n{licenses.TEMPLATES[k][1]}\n{prose(r, 20)}" for k in own), "en", "s") for i, own in enumerate(picks)]
    docs += [(100 + i, prose(r, 60), "en", "s") for i in range(60)]
    rows = {x["doc_id"]: x for x in licenses.scan(make_docs(docs)).collect()}
    for i, own in enumerate(picks):
        assert {licenses.TEMPLATES[k][0] for k in own} <= set(rows[i]["labels"].split(",")), (own, rows[i])
    assert all(rows[100 + i]["labels"] == "" for i in range(60))


def test_measures_against_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in divergence.op10(spark, SF).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_common_words_are_of_all_documents(make_docs):
    r = random.Random(13)
    words = [f"{a}{b}" for a in WORDS for b in ("", "s", "en")]
    docs = [(i, " ".join(r.choice(words) for _ in range(6)), "en", "s") for i in range(6000)]
    counts = Counter(w for d in docs for w in d[1].split())
    want = {w.encode() for w in sorted(counts, key=lambda w: (-counts[w], w))[:divergence.COMMON]}
    assert set(divergence.references(make_docs(docs))[0]) == want


def test_divergence_tells_junk(spark):
    marks = {r["doc_id"]: r["quality"] for r in read(spark, "labels").collect()}
    rows = [r for r in divergence.op10(spark, SF).collect() if not r["base_failed"] and r["doc_id"] in marks]
    assert np.mean([r["kept"] for r in rows if marks[r["doc_id"]]]) > 0.98 and np.mean([r["kept"] for r in rows if not marks[r["doc_id"]]]) < 0.3
