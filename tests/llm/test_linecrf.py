import random

from capacast.llm import linecrf
from capacast.llm.labelled import sample_once
from capacast.llm.textstats import stats

from . import brute

WORDS = [w for w in "the of and river stone morning garden letter window summer quiet paper market silver mountain evening "
         "teacher harbour bridge winter story village doctor forest candle thunder orchard sailor".split()]
ENTRIES = ["Home", "About", "Contact", "Login", "Cart", "Search", "Privacy", "Terms", "Careers", "Blog", "Press", "Help"]


def prose(rng):
    words = [rng.choice(WORDS) for _ in range(rng.randint(8, 18))]
    return words[0].capitalize() + " " + " ".join(words[1:]) + "."


def menu(rng):
    return " | ".join(rng.sample(ENTRIES, rng.randint(3, 6)))


def document(rng, menus, lines=20):
    """Lines with their true labels, in blocks."""
    kinds = [i < round(menus * lines) for i in range(lines)]
    if rng.random() < 0.5:
        kinds.reverse()
    return [(menu(rng) if k else prose(rng), k) for k in kinds]


def corpus(seed, count=120):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        bad = i % 2 == 0
        docs.append((i, "\n".join(t for t, _ in document(rng, rng.choice([0.7, 0.8, 1.0]) if bad else rng.choice([0, 0.1, 0.2])))))
        labels.append((i, int(not bad)))
    return docs, labels


def fitted(spark, seed=1, **options):
    docs, labels = corpus(seed)
    return linecrf.fit(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
                       spark.createDataFrame(labels, "doc_id bigint, quality int"), **options)


def test_lines_are_told_apart_within_documents(spark):
    model = fitted(spark)
    rng = random.Random(77)
    mixed = [document(rng, 0.4, 30) for _ in range(40)]
    texts = ["\n".join(t for t, _ in d) for d in mixed]
    found = linecrf.decode(stats([t.encode() for t in texts]), model)
    truth = [k for d in mixed for _, k in d]
    assert sum(int(f == linecrf.BOILERPLATE) == int(k) for f, k in zip(found, truth)) >= 0.9 * len(truth)
    judged = linecrf.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    shares = [r.content_share for r in judged if not r.base_failed]
    assert shares and sum(0 < s < 1 for s in shares) >= 0.9 * len(shares)


def test_the_fit_does_not_depend_on_the_layout(spark):
    docs, labels = corpus(3, 40)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    weights = [linecrf.fit(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(n), table).weights.tolist()
               for n in (1, 7)]
    assert weights[0] == weights[1]


def test_verdicts_from_the_model_alone(spark):
    """Share and verdict of every document, with labels from a table of all prefixes instead of the operator's decoder."""
    model = fitted(spark, 2)
    docs, _ = corpus(5, 30)
    docs += [(100, None), (101, ""), (102, "\n".join(["One line of it is here."] * 9)), (103, "too few words")]
    found = {r.doc_id: r for r in linecrf.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), model).collect()}
    for doc_id, text in docs:
        lines = [x for x in (text or "").split("\n") if brute.words(x)]
        scores = linecrf.line_features(stats([(text or "").encode()])) @ model.weights
        best = {(): 0.0}
        for s in scores:
            grown = {}
            for path, value in best.items():
                for label in (0, 1):
                    total = value + s * label + (model.moves[path[-1], label] if path else 0.0)
                    key = label
                    if key not in grown or total > grown[key][1]:
                        grown[key] = (path + (label,), total)
            best = {path: value for path, value in grown.values()}
        labels = max(best, key=best.get)
        counts = [len(brute.words(x)) for x in lines]
        content = sum(c for c, label in zip(counts, labels) if label == 0)
        n_words, _, _, _, inside = brute.base_counts(text)
        failed = n_words < 10 or 100 * inside > 20 * n_words
        r = found[doc_id]
        assert (r.content_words, r.base_failed) == (content, failed)
        assert r.kept == (not failed and content / n_words >= 0.5)


def test_labels_stay_within_what_the_document_allows():
    import numpy as np
    words = np.array([10, 10, 10, 10])
    x, again = np.zeros((4, 1)), np.array([False, False, True, False])
    scores = np.array([3.0, -1.0, -9.0, 1.0])
    bad = linecrf.Lines(x, words, again, True)
    good = linecrf.Lines(x, words, again, False)
    none, every = np.zeros(4, np.int8), np.ones(4, np.int8)
    assert linecrf.bounded(none, scores, bad).tolist() == [1, 0, 1, 1]
    assert linecrf.bounded(every, scores, good).tolist() == [1, 0, 1, 0]
    assert linecrf.bounded(none, scores, good).tolist() == [0, 0, 1, 0]


def test_a_huge_labelled_text_and_a_common_id(spark):
    docs, labels = corpus(4, 40)
    rng = random.Random(1)
    huge = "\n".join(prose(rng) for _ in range(150_000))
    rows = docs + [(41, huge)] + [(3, f"copy number {i} of it") for i in range(500)]
    labels = labels + [(41, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sample_once(frame, table, "quality", 1, -1, 3000).count() == 41
    assert linecrf.fit(frame, table).weights.any()
