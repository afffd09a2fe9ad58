import pytest

from capacast.llm import templates
from capacast.llm.queries import QUERIES

from . import brute

BENCH = "item_id bigint, text string"
DOCS = "doc_id bigint, text string"
QUESTION = ("Yesterday the baker Maria sold 12 loaves to her neighbour Tom and 7 kg of flour to the mill. "
            "If Maria bakes 12 loaves again and Tom returns, how many loaves did the baker sell to Tom in total?")


def found(spark, docs, items, **options):
    rows = templates.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH), **options).collect()
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.n_changed) for r in rows}


def test_same_question_with_other_values(spark):
    other = QUESTION.replace("Maria", "Anna").replace("Tom", "Jean Paul").replace("12", "1,250").replace("7 kg", "3 lbs")
    torn = QUESTION.replace("Maria sold 12", "Anna sold 40").replace("Tom and", "Ed and").replace("to Tom in", "to Bo in")
    docs = [(1, f"Some words before it. {QUESTION} And some after it."), (2, other.upper().lower()), (3, other), (4, torn),
            (5, "Nothing of the kind is written in this document, which is about the weather of 12 days.")]
    hits = found(spark, docs, [(10, QUESTION)])
    assert hits[1, 10][1] == hits[1, 10][0] and hits[1, 10][2] == 0
    assert hits[3, 10][2] >= 3
    assert (5, 10) not in hits
    assert (4, 10) not in hits or hits[4, 10][1] < hits[3, 10][1]


def test_names_that_begin_sentences(spark):
    item = "Tom has 3 apples. Tom buys 4 more. How many does Tom have?"
    other = item.replace("Tom", "Ann").replace("3", "5")
    docs = [(1, f"Words before it. {other} And after."), (2, "Ann has 5 apples. Bob buys 4 more. How many does Cid have?"),
            (3, item.lower()), (4, item.replace("Tom", "Jean Paul")), (5, "Tom has 3 apples. He is happy with them.")]
    hits = found(spark, docs, [(1, item)])
    assert {d for d, _ in hits} >= {1, 4} and not {d for d, _ in hits} & {2, 5}
    assert hits[1, 1] == (6, 6, 2)


@pytest.mark.parametrize("limit", [0, 100])
def test_copies_of_items_with_few_literals(spark, limit):
    items = [(1, "Ann 3 kg, Bob 4 kg, Cid 5 kg, Dan 6 kg, Eve 7 kg"), (2, "12 7 9 3 4 5 6 8 10 11 1 2"), (3, "3 kg 5 lb")]
    docs = [(1, f"The list: {items[0][1]}. It ends."), (2, f"A row {items[1][1]} and no more"), (3, "about 3 kg 5 lb of it"),
            (4, "The list: Eva 2 kg, Tim 9 kg, Sue 8 kg, Max 1 kg, Kim 4 kg."), (5, "A row 1 2 3 4 5 6 7 8 9 10 11 12"),
            (6, "about 4 kg 6 lb of it")]
    assert set(found(spark, docs, items, index_limit=limit)) == {(1, 1), (2, 2), (3, 3)}


def test_slots_must_be_replaced_consistently(spark):
    item = "the sum of 3 and 4 and then the sum of 3 and 5 and then the sum of 3 and 6 is what"
    steady, torn = item.replace("3", "30"), item
    for i, value in enumerate(("31", "32", "33")):
        torn = torn.replace("of 3 ", f"of {value} ", 1)
    hits = found(spark, [(1, steady), (2, torn)], [(1, item)])
    assert (1, 1) in hits and (2, 1) not in hits


def test_short_items_and_several_items(spark):
    items = [(1, "why is the sky blue"), (2, "too short"), (3, QUESTION), (4, QUESTION), (5, None), (6, "")]
    docs = [(1, "They asked: why is the sky blue? Nobody knew."), (2, QUESTION), (3, "the sky is blue why")]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 3), (2, 4)}


def test_short_items_by_either_join_and_window(spark):
    items = [(1, "why is the sky blue"), (2, "too short"), (3, QUESTION), (4, "where does the tired old river flow to the sea")]
    docs = [(1, "They asked: why is the sky blue? Nobody knew."), (2, QUESTION), (3, "the sky is blue why"),
            (4, "I ask where does the tired old river flow to the sea at last")]
    for window in (8, 12):
        small = found(spark, docs, items, window=window)
        assert set(small) == {(1, 1), (2, 3), (4, 4)}
        assert small == found(spark, docs, items, window=window, index_limit=0)
    assert small[4, 4][0] == 1


def test_a_repeated_phrase_is_one_window(spark):
    """A phrase that the document repeats, or the item, counts as often as both have it."""
    phrase = "how many loaves did the baker sell to"
    often = f"{phrase} whom when where why and {phrase} mill then {phrase} end"
    docs = [(1, f"{phrase}. Something else here. " * 40), (2, f"we ask {phrase} nobody"), (3, f"{phrase} x " * 9), (4, often)]
    items = [(1, f"yesterday he sold bread in town and {phrase} anyone else who came by today"), (2, often)]
    assert set(found(spark, docs, items)) == {(4, 2)}
    assert found(spark, docs, items)[4, 2][:2] == (25, 25)


def test_shuffled_join_gives_the_same(spark):
    docs = brute.sample_documents(spark)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    small = sorted(map(tuple, templates.leaks(docs, items).collect()))
    assert small == sorted(map(tuple, templates.leaks(docs, items, index_limit=0).collect()))


def test_query_finds_every_verbatim_item(spark):
    folder = "/root/testdata/sf0.01"
    hits = {(r.doc_id, r.item_id) for r in QUERIES["op2_template_leaks"](spark, folder).collect()}
    items = [(r.item_id, " ".join(r.text.lower().split()))
             for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r.doc_id, " ".join(r.text.lower().split())) for r in brute.sample_documents(spark).collect()]
    verbatim = {(d, i) for d, text in docs for i, item in items if item in text}
    assert verbatim <= hits and len(verbatim) > 10
    for doc, item in hits - verbatim:  # the rest must share most of its words in order
        text, wanted = dict(docs)[doc], dict(items)[item].split()
        grams = [" ".join(wanted[i:i + 4]) for i in range(len(wanted) - 3)]
        assert sum(g in text for g in grams) >= 0.4 * len(grams)


def test_canonical_tokens():
    tokens = templates.canonical([b"Then Ann Lee paid 3.50 usd, 7 8 times. The end", b"5kg A b"])
    kinds = "".join("LNAU"[k] for k in tokens.kind)
    assert kinds == "LALNU" + "NL" + "LL" + "NUAL"
    assert tokens.slots(0, 5) == ["Ann Lee", "3.50", "usd"]
    assert tokens.text.tolist() == [0] * 9 + [1] * 4


@pytest.mark.parametrize("limit", [0, 100])
def test_odd_rows(spark, limit):
    docs = brute.odd_documents(spark)
    items = spark.createDataFrame([(1, "Text without an id"), (2, None), (None, QUESTION)], BENCH)
    hits = templates.leaks(docs, items, index_limit=limit).collect()
    assert [(r.doc_id, r.item_id) for r in hits] == [(None, 1)]
    kept = templates.decontaminated(docs, items, index_limit=limit)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert templates.decontaminated(brute.empty_documents(spark), items).count() == 0
    none = spark.createDataFrame([], BENCH)
    assert templates.decontaminated(docs, none, index_limit=limit).count() == docs.count()


INSTRUCTION = ("Read the following passage with care and then answer the question that is put to you at its end "
               "without any further help.")


def own_words(prefix, i, n=24):
    return " ".join(f"{prefix}{chr(97 + (i * 7 + k * 3) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}" for k in range(n))


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_a_shared_instruction_is_no_item(spark, limit):
    items = [(i, f"{INSTRUCTION} {own_words('q', i)}?") for i in range(300)]
    docs = [(i, f"{INSTRUCTION} {own_words('d', i)}.") for i in range(300)]
    docs += [(1000, f"It said: {items[7][1]} And that was all."), (1001, f"Only {own_words('q', 9)}? was asked"),
             (1002, INSTRUCTION), (1003, f"{INSTRUCTION} {own_words('q', 11, 3)} and then something else entirely")]
    assert set(found(spark, docs, items, index_limit=limit)) == {(1000, 7), (1001, 9)}
    alone = [*items, (5000, INSTRUCTION)]
    hits = set(found(spark, docs, alone, index_limit=limit))
    assert {(d, 5000) for d, _ in docs if d != 1001} | {(1000, 7), (1001, 9)} == hits


def test_many_items_of_one_template(spark):
    item = "A farmer has {} cows and buys {} more from {} at the market. How many cows does the farmer have now, says {}?"
    names = ["Ann", "Bob", "Cid", "Dan", "Eve", "Fay"]
    items = [(i, item.format(i + 2, i + 30, names[i % 6], names[(i + 1) % 6])) for i in range(60)]
    docs = [(d, "Some text. " + item.format(d + 1000, d + 70, "Zoe", "Max") + " More text.") for d in range(40)]
    docs.append((77, items[41][1]))
    hits = found(spark, docs, items)
    assert {d for d, _ in hits} == {d for d, _ in docs}
    assert (77, 41) in hits and len(hits) <= 2 * len(docs)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_all_pairs_follow_from_the_classes(spark, limit):
    item = "A farmer has {} cows and buys {} more from {} at the market. How many cows does the farmer have now, says {}?"
    names = ["Ann", "Bob", "Cid", "Dan", "Eve", "Fay"]
    items = [(i, item.format(i + 2, i + 30, names[i % 6], names[(i + 1) % 6])) for i in range(30)]
    items += [(100 + i, item.format(i + 2, i + 2, names[i % 6], names[(i + 1) % 6])) for i in range(7)]  # equal numbers
    items += [(200 + i, "where does the tired old river flow to the sea") for i in range(6)]
    docs = [(d, "Some text. " + item.format(d + 1000, d + 70, "Zoe", "Max") + " More text.") for d in range(5)]
    docs += [(50 + d, item.format(d + 500, d + 500, "Zoe", "Max")) for d in range(3)]
    docs += [(77, items[21][1]), (80, f"I ask {items[-1][1]} at last")]
    tables = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)
    rows = templates.leaks(*tables, index_limit=limit, every_item=True).collect()
    pairs = {(a.doc_id, b.item_id) for a in rows for b in rows if a.item_class == b.item_class}
    assert pairs == plain_leaks(docs, items) and {i for _, i in pairs} == {i for i, _ in items}
    changed = {(r.doc_id, r.item_id): r.n_changed for r in rows}
    assert changed[77, 21] == 0 and changed[0, 5] == 4
    assert len(rows) <= 3 * (len(docs) + len(items))


def test_items_without_own_windows_need_half_of_the_rarest(spark):
    """All windows of the last item are shared and equally rare; which of them a document has does not matter."""
    text = f"{own_words('q', 3)} {own_words('p', 3)}"
    items = [(i, f"{text} {own_words('r', i)}") for i in range(6)] + [(6, text)]
    docs = [(i, f"{own_words('d', i, 5)} {' '.join(text.split()[i:i + 16])} {own_words('e', i, 5)}") for i in range(0, 33, 4)]
    assert set(found(spark, docs, items)) == plain_leaks(docs, items) == {(i, 6) for i in range(0, 33, 4)}


def test_recall_of_renamed_questions(spark):
    import random
    rng = random.Random(6)
    vocabulary = [w for r in brute.sample_documents(spark).where("lang = 'en'").limit(80).collect() for w in r.text.lower().split()
                  if w.isalpha() and len(w) > 2]
    names = ["Alice", "Bruno", "Carla", "Dmitri", "Elena", "Felix", "Greta", "Hugo"]

    def question(words, who, numbers):
        listed = list(words)
        for at, name in zip((3, 11, 19), who):
            listed.insert(at, name)
        for at, number in zip((7, 15, 23), numbers):
            listed.insert(at, f"{number} kg")
        return "When " + " ".join(listed) + "?"

    items, docs = [], []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(30)]
        who, numbers = rng.sample(names, 3), rng.sample(range(2, 90), 3)
        items.append((i, question(words, who, numbers)))
        other = question(words, rng.sample(names, 3), rng.sample(range(100, 990), 3))
        docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(40)) + ". " + other + " "
                     + " ".join(rng.choice(vocabulary) for _ in range(40))))
        docs.append((1000 + i, " ".join(rng.choice(vocabulary) for _ in range(110))))
    hits = set(found(spark, docs, items))
    assert len({(i, i) for i in range(120)} & hits) >= 0.9 * 120
    assert not {h for h in hits if h[0] != h[1]}


def plain_leaks(docs, items):
    """The whole result for few rows: every document against every item, with counts taken by loops."""
    from collections import Counter

    def grams(text, form):
        tokens = templates.canonical([(text or "").encode()], form)
        size = templates.WINDOW if len(tokens.text) >= templates.WINDOW else len(tokens.text)
        out = []
        for at in range(len(tokens.text) - size + 1 if size >= templates.SHORTEST else 0):
            kinds = tokens.kind[at:at + size]
            if (kinds == 0).sum() >= max(2, size * templates.LITERAL_SHARE):
                out.append((at, tuple(tokens.value[at:at + size].tolist()), tokens.slots(at, size), size))
        return out, tokens

    found = set()
    for form in templates.FORMS:
        listed = {k: grams(text, form)[0] for k, (_, text) in enumerate(items)}
        texts = {tuple((a, g) for a, g, _, _ in w) for w in listed.values()}
        shared = Counter(g for t in texts for g in {g for _, g in t})
        for k, (item_id, text) in enumerate(items):
            if not listed[k]:
                continue
            own = {g for _, g, _, _ in listed[k] if shared[g] <= templates.COMMON}
            if not own:
                rarest = min(shared[g] for _, g, _, _ in listed[k])
                own = {g for _, g, _, _ in listed[k] if shared[g] == rarest}
            for doc_id, doc_text in docs:
                size = listed[k][0][3]
                tokens = templates.canonical([(doc_text or "").encode()], form)
                by_shift = {}
                for at in range(len(tokens.text) - size + 1):
                    gram = tuple(tokens.value[at:at + size].tolist())
                    for item_at, g, slots, _ in listed[k]:
                        if g == gram:
                            by_shift.setdefault(at - item_at, []).append((g, item_at, at, slots, tokens.slots(at, size)))
                held = {}
                for hits in by_shift.values():
                    new = {}
                    for _, _, _, olds, news in hits:
                        for o, n in zip(olds, news):
                            new.setdefault(o, set()).add(n)
                    for g, item_at, at, olds, _ in hits:
                        if all(len(new[o]) == 1 for o in olds):
                            held.setdefault(g, (set(), set()))[0].add(item_at)
                            held[g][1].add(at)
                counts = {g: min(len(a), len(b)) for g, (a, b) in held.items()}
                n_own = sum(g in own for _, g, _, _ in listed[k])
                if sum(counts.values()) >= min(8, -(-len(listed[k]) // 2)) and sum(
                        c for g, c in counts.items() if g in own) >= min(8, -(-n_own // 2)):
                    found.add((doc_id, item_id))
    return found


def test_whole_result_on_small_tables(spark):
    import random
    rng = random.Random(9)
    frames = ["the baker {} sells {} loaves to {} and keeps {} for the morning before it opens", QUESTION,
              "{} walks {} km to the old mill near the river and then {} walks {} km home again", INSTRUCTION]
    names = ["Ann", "Bob", "Cid", "Dan"]

    def made(frame):
        for _ in range(frame.count("{}")):
            at = frame.index("{}")
            value = rng.choice(names) if frame[:at].count(" ") % 2 else str(rng.randint(2, 40))
            frame = frame[:at] + value + frame[at + 2:]
        return frame

    items = [(i, made(rng.choice(frames)) + (" " + own_words("q", i, rng.randint(0, 9)) if rng.random() < 0.7 else ""))
             for i in range(14)]
    docs = [(i, " ".join(rng.choice([made(rng.choice(frames)), own_words("q", rng.randint(0, 13), 8), own_words("d", i, 6),
                                     rng.choice(items)[1]]) for _ in range(3))) for i in range(25)]
    assert set(found(spark, docs, items)) <= plain_leaks(docs, items)
    missing = plain_leaks(docs, items) - set(found(spark, docs, items))
    assert {d for d, _ in missing} <= {d for d, _ in found(spark, docs, items)}, missing
