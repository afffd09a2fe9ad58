import math
import random
from collections import Counter

from capacast.llm import language
from capacast.llm.queries import QUERIES

from . import brute

ROWS = "id bigint, text string, declared string, host string"
WORDS = {"aa": "bala kamo tiru sela".split(), "bb": "strungth kworp vlixt prank".split()}


def rows(spark, listed):
    return spark.createDataFrame(listed, ROWS)


def sentence(rng, code, n):
    return " ".join(rng.choice(WORDS[code]) for _ in range(n))


def corpus(spark, seed=1):
    rng = random.Random(seed)
    listed = [(i, sentence(rng, "ab"[i % 2] * 2, 12), "ab"[i % 2] * 2, f"h{i % 2}.site{i % 2}.{'x' if i % 2 else 'y'}")
              for i in range(80)]
    return rng, listed


def test_evidence_is_fused(spark):
    rng, listed = corpus(spark)
    listed += [
        (100, sentence(rng, "aa", 30), "bb", "h1.site1.x"),   # a long text overrules a wrong declaration
        (101, "zz qq", "bb", "h1.site1.x"), (102, "zz qq", "aa", "h0.site0.y"),  # a short one leaves it to the rest
        (103, "zz qq", "", "h0.site0.y"), (104, "zz qq", "", "new.site0.y"), (105, "zz qq", "", "new.other.x"),
        (106, "", "aa", "h0.site0.y"), (107, None, None, None), (108, "12 34 !!", "aa", "h0.site0.y")]
    table = rows(spark, listed)
    model = language.fit(table.where("id < 100"))
    assert model.languages == ["aa", "bb"]
    found = {r.id: r for r in language.identify(table, model).collect()}
    assert all(found[i].language == "ab"[i % 2] * 2 for i in range(80))
    assert found[100].language == "aa"
    for i in (106, 107, 108):
        assert (found[i].language, found[i].kept) == ("und", False)
    # priors: the host speaks most, then its domain, then its suffix
    chance = {i: found[i].probability for i in (103, 104, 105)}
    assert chance[103] > chance[104]


def brute_force(listed, model):
    """The same posterior, row by row."""
    size = len(model.languages)
    read = []
    for key, text, declared, host in listed:
        counts, sums = model.likelihoods([(text or "").encode()])
        read.append((key, declared or "", host or "", int(counts[0]), sums[0].tolist()))
    best = [max(range(size), key=r[4].__getitem__) if r[3] else None for r in read]
    total = Counter(b for b in best if b is not None)
    said = Counter((r[1], b) for r, b in zip(read, best))
    kinds = len({r[1] for r in read})

    def suffix(h):
        return h.rsplit(".", 1)[1] if "." in h else ""

    def domain(h):
        return ".".join(h.split(".")[-2:])

    def prior(key, level, above):
        n = [sum(level(r[2]) == key and b == i for r, b in zip(read, best)) for i in range(size)]
        return [(n[i] + 20.0 * above[i]) / (sum(n) + 20.0) for i in range(size)]

    root = [(total[i] + 1) / (sum(total.values()) + size) for i in range(size)]
    out = {}
    for key, declared, host, n, sums in read:
        p = prior(host, lambda h: h, prior(domain(host), domain, prior(suffix(host), suffix, root)))
        votes = [0.3 * sums[i] + math.log((said[declared, i] + 1) / (total[i] + kinds)) + math.log(p[i])
                 for i in range(size)]
        top = max(votes)
        chance = 1 / sum(math.exp(v - top) for v in votes)
        kept = n > 0 and chance >= 0.6 and max(sums) > -14 * math.log(2) * n
        out[key] = (model.languages[votes.index(top)] if kept else "und", round(chance, 6), kept)
    return out


def test_equal_to_brute_force(spark):
    rng, listed = corpus(spark, 2)
    listed += [(200 + i, sentence(rng, rng.choice(["aa", "bb"]), rng.randint(0, 2)) + rng.choice(["", " kaorp", " ti"]),
                rng.choice(["", "aa", "bb", None]), rng.choice(["h0.site0.y", "k.site1.x", "solo", "", None]))
               for i in range(60)]
    table = rows(spark, listed)
    model = language.fit(table)
    found = {r.id: (r.language, r.probability, r.kept) for r in language.identify(table, model).collect()}
    wanted = brute_force(listed, model)
    assert set(found) == set(wanted)
    for key, (name, chance, kept) in wanted.items():
        assert found[key][0] == name and found[key][2] == kept and abs(found[key][1] - chance) < 2e-6


def test_plan_does_not_grow_with_languages(spark):
    """Many declared codes: the same expressions, and still the right language for each row."""
    rng = random.Random(4)
    sizes = {}
    for count in (3, 240):
        words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for _ in range(count)]
        listed = [(i, " ".join(rng.choices(words[i % count], k=40)), f"c{i % count:03}", f"h{i % 7}.x") for i in range(5 * count)]
        table = rows(spark, listed)
        model = language.fit(table)
        assert len(model.languages) == count
        found = language.identify(table, model)
        right = [r.language == r.declared for r in found.collect()]
        assert sum(right) >= 0.99 * len(right)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        sizes[count] = text.count("element_at") + text.count("log(") + text.count("CASE WHEN")
    assert sizes[3] == sizes[240] > 0


def test_rows_without_ids_are_spread_over_the_salts(spark):
    _, listed = corpus(spark)
    table = rows(spark, [(None, *rest) for _, *rest in listed])
    model = language.fit(rows(spark, listed))
    found = [r.language for r in language.identify(table, model).collect()]
    assert sorted(found) == sorted("ab"[i % 2] * 2 for i in range(80))


def test_query_covers_documents_and_pages(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op4_language_fusion"](spark, folder).collect()
    docs = {r.doc_id: r.lang for r in brute.sample_documents(spark).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    assert len(found) == len(docs) + pages == len({r.doc_id for r in found})
    assert sorted(r.page_id for r in found if r.doc_id < 0) == list(range(pages))
    right = [docs[r.doc_id] == r.language for r in found if r.doc_id >= 0]
    assert sum(right) / len(right) > 0.95
    assert sum(r.kept for r in found) / len(found) > 0.99


def test_pages_give_text_markup_and_host(spark):
    html = """<!DOCTYPE html><HTML class=a lang='De'><head><style>p{}</style><script>var t="</p>";</script></head>
              <body><!-- note --><p>Guten &amp; Tag</p></body></html>"""
    pages = spark.createDataFrame([(1, "https://www.Example.DE:80/x", html), (2, None, None)],
                                  "page_id bigint, url string, html string")
    first, second = sorted(language.from_pages(pages).collect(), key=lambda r: r.id)
    assert first.text.split() == ["Guten", "Tag"] and (first.declared, first.host) == ("de", "www.example.de")
    assert (second.text, second.declared, second.host) == (None, None, None)


def test_odd_rows(spark):
    docs = brute.odd_documents(spark)
    table = language.from_documents(docs)
    for model in (language.fit(language.from_documents(brute.sample_documents(spark))), language.fit(table)):
        assert language.identify(table, model).count() == docs.count()
    assert language.identify(language.from_documents(brute.empty_documents(spark)), model).count() == 0
    assert language.fit(language.from_documents(brute.empty_documents(spark))).languages == []
