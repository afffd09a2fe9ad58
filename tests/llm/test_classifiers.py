"""Toxicity and quality scores: held-out accuracy, scoring by hand, odd rows."""

import zlib

import numpy as np
import pytest

from capacast.llm import gam, linecrf, toxicity
from capacast.llm.labelled import logistic, logistic_score, sample, spread
from capacast.llm.queries import QUERIES

from . import brute

FOLDER = "/root/testdata/sf0.1"


def labels(spark, folder=FOLDER):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}


def auc(scores, marks):
    scores, marks = np.asarray(scores), np.asarray(marks, bool)
    a, b = scores[marks][:, None], scores[~marks][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


# Some 4 percent of the toxic labels here are on texts without any toxic word, which bounds what can be found.
@pytest.mark.parametrize("name, label, folds, out, least, recall", [
    ("op6_compression_toxicity", "toxic", 3, 1, 0.94, 0.85), ("op9_additive_quality", "quality", 4, 2, 0.97, 0.9)])
def test_held_out_accuracy(spark, name, label, folds, out, least, recall):
    found = QUERIES[name](spark, FOLDER).collect()
    assert len(found) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    marks = labels(spark)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    test = [(r.score, r.predicted, marks[r.doc_id][label]) for r in found if r.held_out and r.doc_id in marks]
    scores, predicted, truth = map(np.array, zip(*test))
    assert auc(scores, truth) > least
    assert predicted[truth == 1].mean() > recall and predicted[truth == 0].mean() < 0.05


def test_line_crf_keeps_good_and_drops_bad(spark):
    found = {r.doc_id: r for r in QUERIES["op1_line_crf"](spark, FOLDER).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert found.keys() == docs.keys()
    for d, r in found.items():
        counts = brute.base_counts(docs[d])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)
    marks = labels(spark)
    good = [found[d].kept for d in marks if marks[d].quality == 1 and not found[d].base_failed]
    bad = [found[d].kept for d in marks if marks[d].quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_viterbi_equals_all_labellings():
    from itertools import product
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = rng.integers(1, 8)
        scores, moves = rng.normal(size=n), rng.normal(size=(2, 2))

        def total(path):
            return sum(s * y for s, y in zip(scores, path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))

        best = max(product((0, 1), repeat=n), key=total)
        assert tuple(linecrf.viterbi(scores, moves)) == best


def test_crf_gradient_is_the_slope_of_the_likelihood():
    from itertools import product
    rng = np.random.default_rng(4)
    size = len(linecrf.FEATURES)
    xs = [rng.random((n, size)) for n in (4, 2, 1)]
    ys = [rng.integers(0, 2, n) for n in (4, 2, 1)]
    theta = rng.normal(size=size + 4) * 0.5

    def likelihood(theta):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        value = 0.0
        for x, y in zip(xs, ys):
            def total(path):
                return sum((x[i] @ weights) * p for i, p in enumerate(path)) + sum(
                    moves[a, b] for a, b in zip(path, path[1:]))
            value += total(y) - np.log(sum(np.exp(total(p)) for p in product((0, 1), repeat=len(y))))
        return value

    x = [np.array([s[t] for s in xs if len(s) > t]) for t in range(4)]
    y = [np.array([s[t] for s in ys if len(s) > t]) for t in range(4)]
    gradient = linecrf._gradient(theta, x, y, [len(f) for f in x])
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - gradient[i]) < 1e-4


def test_content_text(spark):
    docs = spark.createDataFrame([(1, "A plain line of text ends here.\nBUY!! NOW!! ### $$$ %%% &&&\nAnother good line is here."),
                                  (2, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in linecrf.judge(docs, linecrf.Model(), with_text=True).collect()}
    assert found[1].content_text == "A plain line of text ends here.\nAnother good line is here."
    assert found[2].content_text == "" and found[2].base_failed and not found[2].kept


def test_zstandard_windows_hold_the_whole_text():
    text = ("word " * 30 + "x" * 130 + " Idiot end").encode()
    found = toxicity.windows(text)
    joined = b"".join(w[len(toxicity.FRONT):-len(toxicity.BACK)].replace(b" ", b"") for w in found)
    assert joined == text.lower().replace(b" ", b"")
    assert all(len(w) <= toxicity.WINDOW + len(toxicity.FRONT) + len(toxicity.BACK) + 2 for w in found)
    assert toxicity.windows(b"") == []


def test_toxic_dictionary_shortens_toxic_windows():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(400)]
    texts, marks = [], []
    for i in range(240):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[int(rng.integers(0, 40))] = "nincompoop"
        texts.append(" ".join(words).encode())
        marks.append(int(i % 4 == 0))
    model = toxicity.train(texts, marks)
    assert b"nincompoop" in model.toxic and b"nincompoop" not in model.ordinary
    distance = toxicity.Distance(model)
    assert distance.gains(b"some nincompoop here").max() >= toxicity.GAIN
    assert distance.gains(b"nothing of that kind").max() < toxicity.GAIN


def test_margins_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((800, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair can tell
    model = gam.train(x, y)
    assert (0, 1) in model.pairs
    assert auc(model.score(x), y) > 0.95
    row = x[17]
    total = model.intercept + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, row))
    for (i, j), t in zip(model.pairs, model.pair_tables):
        total += t[np.searchsorted(model.coarse[i], row[i], "right"), np.searchsorted(model.coarse[j], row[j], "right")]
    assert abs(total - model.margin(x)[17]) < 1e-9


@pytest.mark.parametrize("marks", [[], [(1, 1, 1)], [(1, 0, 0), (2, 0, 0)], [(None, None, None), (4, 1, 0), (4, 0, 1), (6, 0, 0)]])
def test_odd_rows(spark, marks):
    docs = brute.odd_documents(spark)
    table = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    for module in (toxicity, gam):
        found = module.score(docs, module.fit(docs, table)).collect()
        assert len(found) == docs.count()
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)
        assert module.score(brute.empty_documents(spark), module.fit(brute.empty_documents(spark), table)).count() == 0
    found = linecrf.judge(docs, linecrf.fit(docs, table))
    assert found.count() == docs.count()
    assert found.where("n_words = 0 and (kept or not base_failed)").count() == 0
    assert linecrf.judge(brute.empty_documents(spark), linecrf.Model()).count() == 0


def test_sample_is_bounded_and_leaves_out_the_held_out(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text")
    table = spark.range(400).selectExpr("id as doc_id", "cast(id % 5 = 0 as int) as toxic")
    found = sample(docs, table, "toxic", 3, 1, 25).collect()
    assert sorted(r.label for r in found) == [0] * 25 + [1] * 25
    assert all(zlib.crc32(r.text.encode()) % 3 != 1 for r in found)
    again = sample(docs.repartition(7), table.repartition(3), "toxic", 3, 1, 25).collect()
    assert sorted(found) == sorted(again)


def test_logistic_finds_the_slope():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = logistic(x, y)
    assert abs(w[0] - 2) < 0.3 and abs(w[1]) < 0.2 and abs(w[2] + 1) < 0.2
    assert logistic_score(np.array([[0.5, 0.0]]), np.array([2.0, 0.0, -1.0]))[0] == 0.5


def test_spread_takes_parts_from_all_over_a_text(spark):
    texts = [None, "", "short", "x" * 80, "".join(chr(97 + i // 1000) for i in range(20000))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in frame.select(spread(frame.text, 80)).collect()]
    assert got[:4] == texts[:4]
    assert got[4].split(" ") == [texts[4][19990 * i // 7:][:10] for i in range(8)]


def test_training_rows_are_bounded_by_id_and_size(spark):
    """A labelled id that most rows bear and very long texts send one bounded row each."""
    docs = [(1, f"some toxic text {i}") for i in range(900)] + [(2, "very long text " * 200_000), (3, None), (None, "no id")]
    docs = spark.createDataFrame(docs + [(i, f"text {i}") for i in range(4, 60)], "doc_id bigint, text string").repartition(5)
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, toxic int")
    used = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    found = toxicity.training(docs, marks, chars=1000).collect()
    assert len(found) == len(used) and max(len(r.text) for r in found) <= 1007
    assert [r.label for r in found] == sorted(i % 2 for i in used)
    assert found == toxicity.training(docs.repartition(3), marks.repartition(2), chars=1000).collect()
    model, again = (toxicity.fit(d, marks) for d in (docs, docs.repartition(3)))
    assert model.toxic == again.toxic and (model.weights == again.weights).all()
