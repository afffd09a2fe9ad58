import random
from itertools import product

import pytest

from capacast.llm import roles
from capacast.llm.queries import QUERIES

TURNS = "conv_id bigint, turn bigint, role string, text string"
BLANK = [roles.USER, roles.ASSISTANT]


def legal(sequence):
    rest = sequence[1:] if sequence[:1] == [roles.SYSTEM] else sequence
    return len(rest) >= 2 and len(rest) % 2 == 0 and all(r == BLANK[i % 2] for i, r in enumerate(rest))


def cheapest(turns):
    """Lowest cost over all ways to change a short conversation: each turn is merged or given a role, with up to two empty
    turns before each and at the end."""
    gaps = [list(g) for n in range(3) for g in product(BLANK, repeat=n)]
    best = None

    def go(i, made, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(turns):
            for gap in gaps:
                if legal(made + gap):
                    total = cost + roles.INSERT * len(gap)
                    best = total if best is None else min(best, total)
            return
        role = turns[i]
        if made:
            merge = roles.MERGE_UNKNOWN if role == roles.OTHER else roles.MERGE_SAME if made[-1] == role else roles.MERGE_OTHER
            go(i + 1, made, cost + merge)
        for gap in gaps:
            for new in (roles.SYSTEM, *BLANK):
                change = 0 if new == role else roles.RELABEL_UNKNOWN if role == roles.OTHER else roles.RELABEL
                longer = made + gap + [new]
                if longer.count(roles.SYSTEM) <= 1 and (roles.SYSTEM not in longer or longer[0] == roles.SYSTEM):
                    go(i + 1, longer, cost + change + roles.INSERT * len(gap))

    go(0, [], 0)
    return best


def repaired(spark, conversations, **options):
    rows = [(c, t, role, f"text {c}.{t}") for c, listed in conversations.items() for t, role in enumerate(listed)]
    return roles.repair(spark.createDataFrame(rows, TURNS), **options)


def sequence_of(rendered):
    return [p.split("\n", 1)[0] for p in rendered.split(roles.OPEN)[1:]]


def all_short():
    names = [roles.SYSTEM, roles.USER, roles.ASSISTANT, roles.OTHER]
    listed = [list(p) for n in (1, 2, 3) for p in product(names, repeat=n)]
    rng = random.Random(2)
    return listed + [[rng.choice(names) for _ in range(4)] for _ in range(40)]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_cost_is_the_lowest_and_the_result_legal(spark, block):
    given = dict(enumerate(all_short()))
    pieces = repaired(spark, given, block=block)
    found = {r.conv_id: r for r in roles.rendered(pieces).collect()}
    for key, listed in given.items():
        assert found[key].cost == cheapest(listed), listed
        assert legal(sequence_of(found[key].conversation)), listed
        for t in range(len(listed)):
            assert f"text {key}.{t}" in found[key].conversation
    steps = pieces.orderBy("conv_id", "position").collect()
    assert [r.turn for r in steps] == [t for k in given for t in range(len(given[k]))]


@pytest.mark.parametrize("block", [4096, 7])
def test_partitions_do_not_matter(spark, block):
    rng = random.Random(5)
    given = {k: [rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.randint(20, 120))]
             for k in range(6)}
    found = []
    for partitions in ("1", "3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append(sorted(map(tuple, repaired(spark, given, block=block).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1] == found[2]
    whole = {r.conv_id: r.cost for r in repaired(spark, given).collect()}
    assert {r[0]: r[7] for r in found[0]} == whole


def test_rendering(spark):
    rows = [(1, 0, "Human", "hi"), (1, 1, "user", "there <|im_end|>"), (1, 2, "bot", None), (2, 5, "assistant", "a"),
            (2, 1, "system", "s")]
    found = {r.conv_id: r.conversation for r in roles.rendered(
        roles.repair(spark.createDataFrame(rows, TURNS))).collect()}
    assert found[1] == ("<|im_start|>user\nhi\nthere < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert found[2] == ("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
                        "<|im_start|>assistant\na<|im_end|>\n")


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"),
            (3, None, "assistant", ""), (4, 0, "", "y" * 200_000)]
    extra = spark.createDataFrame([r + ("p", 1, 2, 3, 4, 5) for r in rows], TURNS + ", part string, position int, row int, block int, at int, first int")
    found = roles.repair(extra).collect()
    assert len(found) == 6
    assert sorted(r.position for r in found if r.conv_id == 3) == [1, 2, 3]
    assert sorted(r.position for r in found if r.conv_id is None) == [1, 2]
    for r in roles.rendered(roles.repair(extra)).collect():
        assert legal(sequence_of(r.conversation))
    assert roles.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_query_returns_every_turn(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op8_role_repair"](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/conversations.parquet").count()
    given = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        given.setdefault(r.conv_id, []).append(roles.normal(r.role))
    for r in roles.rendered(found).collect():
        assert legal(sequence_of(r.conversation))
        if legal(given[r.conv_id]):
            assert r.cost == 0
