"""Quality rules, toxicity and decontamination on small tables."""

import random
from collections import Counter

import numpy as np
import pytest

from tidewrack.llm import decontaminate, quality, toxicity


def test_base_counts_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(["a", "bb", "c#", "|", "Dd"]) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words)
        grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        covered = {i for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for i in range(k, k + 5)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        n, chars, symbols, dups, repeats, n_lines, _ = quality.text_statistics(text)
        assert (n, chars, repeats) == (len(words), sum(map(len, words)), len(covered))
        assert symbols == sum(text.count(c) for c in "#*$%&|<>") and n_lines == len(lines) and dups == len(lines) - len(set(lines))


def test_chi_square():
    assert quality.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert quality.chi2_cdf(6.6257, 5) == pytest.approx(0.75, abs=1e-4)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        text = prose(rng, rng.randrange(20, 400))
        if k % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif k % 10 == 1 and k < 200:
            text = text.upper()
        rows.append((k, text, "en", "big" if k % 3 else "small" if k % 2 else None))
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)).collect()}
    bad = {k for k in range(400) if k % 10 == 0 or (k % 10 == 1 and k < 200)}
    assert {k for k, r in got.items() if not r.kept} == bad
    again = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, source string").repartition(2)).collect()}
    assert again == got  # neither order nor partitions matter


def test_estimate_equals_numpy():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 5)) * quality.GRID).astype(int)
    import pandas as pd

    row = {"n": len(x), **{f"s{k}": x[:, k].sum() for k in range(5)}, **{f"q{i}_{j}": (x[:, i] * x[:, j]).sum() for i in range(5) for j in range(i, 5)}}
    mean, inverse, _ = quality._estimate(pd.DataFrame([row]), 1.0)
    cov = np.cov(x.T / quality.GRID, bias=True) + np.diag(np.square(list(quality.FLOORS.values())))
    assert np.allclose(mean, x.mean(axis=0) / quality.GRID) and np.allclose(inverse, np.linalg.inv(cov))


def test_rules_on_odd_rows(odd_docs):
    rows = {r.doc_id: r for r in quality.assess(odd_docs).collect()}
    assert len(rows) == 10 and rows[1].n_words == 0 and rows[1].base_failed and rows[5].base_failed and not rows[6].kept
    left = quality.keep(odd_docs)
    assert left.columns == odd_docs.columns and {r.doc_id for r in left.collect()} == {8, 9, None}
    assert quality.assess(odd_docs.where("false")).count() == 0 and quality.keep(odd_docs.where("false")).count() == 0


def test_grammar_kinds():
    table, kind = toxicity.grammar()

    def read(*classes):
        state = 0
        for c in classes:
            state = table[state][c]
        return kind[state]

    o, insult, threat, target, no, report = range(6)
    assert read(o, o) == -1 and read(o, insult) == 0 and read(target, o, insult) == 1
    assert read(no, o, insult) == 2 and read(no, o, o, o, insult) == 0 and read(report, insult) == 3
    assert read(threat) == -1 and read(threat, target) == 4 and read(no, threat, target) == 5 and read(report, threat, target) == 6


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(900):
        text, toxic = prose(rng, 30).split(), k % 4 == 0
        if toxic:
            text.insert(rng.randrange(30), "zwick" + prose(rng, 1)[:-1] if k % 8 else "grumpf")
        docs.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, lab)
    rows = toxicity.score(d, model).collect()
    out = [r for r in rows if r.held_out]
    assert 200 < len(out) < 400 and sum(r.predicted != (r.doc_id % 4 == 0) for r in out) <= len(out) * 0.02
    flipped = lab.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.learn(d, flipped) == model  # held-out labels are never read


def test_toxicity_of_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd_docs, none)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows} == {0.0} and not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(odd_docs.where("false"), model).count() == 0


ITEM = "Anna walked 12 miles to the old mill and then sold 30 apples for 5 dollars at the market before noon."


def found(spark, text, items=((0, ITEM),)):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return [(r.item_id, r.verdict) for r in decontaminate.contaminated(docs, bench).collect()]


def test_verbatim_renamed_and_inconsistent_questions(spark):
    around = "something else entirely stands here, {} and some other words follow it without any sense."
    assert found(spark, around.format(ITEM)) == [(0, "verbatim")]
    other = ITEM.replace("12", "47").replace("30", "8").replace("5 dollars", "95 euros")
    assert found(spark, around.format(other)) == [(0, "re-parameterised")]
    twice = "At 7 in the morning the red cart left with 7 boxes of pears and 7 sacks of corn for the long way home."
    assert found(spark, around.format(twice.replace("7", "9")), [(3, twice)]) == [(3, "re-parameterised")]
    assert found(spark, around.format(twice.replace("7", "9", 1)), [(3, twice)]) == []
    assert found(spark, around.format("Anna walked to the old mill.")) == []


def test_each_item_of_a_template_is_tested(spark):
    item = "Tom has {} apples and then buys {} more of them at the old market before noon."
    items = [(1, item.format(5, 5)), (2, item.format(4, 6)), (3, item.format(8, 9))]
    around = "something else entirely stands here, {} and some other words follow it without any sense."
    assert found(spark, around.format(item.format(4, 6)), items) == [(2, "verbatim")]
    assert found(spark, around.format(item.format(8, 9)), items[1:]) == [(3, "verbatim")]
    assert found(spark, around.format(item.format(7, 7)), items[:1]) == [(1, "re-parameterised")]
    assert found(spark, around.format(item.format(7, 3)), items) == [(2, "re-parameterised")]


def test_short_items_at_every_place_and_edits_inside(spark):
    words = "red carts carry ripe pears along quiet roads toward some distant town where people wait all day for fresh fruit".split()
    for n in (8, 9, 10):
        docs = spark.createDataFrame([(k, " ".join(["foo"] * k + words[:n] + ["bar"] * 3)) for k in range(6)], "doc_id long, text string")
        bench = spark.createDataFrame([(0, " ".join(words[:n]))], "item_id long, text string")
        assert sorted((r.doc_id, r.verdict) for r in decontaminate.contaminated(docs, bench).collect()) == [(k, "verbatim") for k in range(6)]
    whole = " ".join(words)
    assert found(spark, " ".join([*words[:10], "very", *words[10:]]), [(0, whole)]) == [(0, "re-parameterised")]
    named = [*words[:10], "Bob", *words[10:]]
    assert found(spark, " ".join(named).replace("Bob", "Mary Ann"), [(0, " ".join(named))]) == [(0, "re-parameterised")]
    assert found(spark, " ".join(words[:10] + ["foo"] * 12), [(0, whole)]) == []


def test_decontamination_of_odd_rows(spark, odd_docs, odd_texts):
    bench = spark.createDataFrame([(5, ITEM), (4, ITEM), (7, None), (8, "few words"), (None, odd_texts[8][1])], "item_id long, text string")
    rows = decontaminate.contaminated(odd_docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(9, None)]
    left = decontaminate.clean(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 2
    assert decontaminate.clean(odd_docs, bench.where("false")).count() == odd_docs.count()
    assert decontaminate.contaminated(odd_docs.where("false"), bench).count() == 0
    hit = odd_docs.limit(1).selectExpr("100L AS doc_id", f"'so it is said: {ITEM}' AS text")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(hit, bench).collect()] == [(100, 4)]
