import hashlib
import re

import pytest
from pyspark.sql import functions as F

from capacast.llm import infill
from capacast.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import connect, difference

from . import brute


def plain_version(doc_id, text, seed="1"):
    """(n, form, prefix_chars, middle_chars, output) by a regular expression and lists."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, leave, turn = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or leave % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if turn % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equal_to_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert difference(QUERIES["op11_infill"](spark, folder), connect(folder), ORACLE_SQL["op11_infill"]) == ""


def checked(spark, rows, ddl="doc_id bigint, text string"):
    made = infill.fill_in_middle(spark.createDataFrame(rows, ddl))
    found = made.withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *map(repr, r[1:6])) for r in found) == sorted(
        (i is None, i or 0, *map(repr, plain_version(i, t))) for i, t, *_ in rows)
    texts = sorted((t or "") for _, t, *_ in rows)
    assert sorted(r.restored for r in found) == texts
    return found


def test_odd_texts(spark):
    texts = [None, "", "a", "ab cd", "é", "日本語 abc 日", "x\U0001F600y", "<P> is in it", "ends with <", "<", "S> and M>", "\x00a\n\r\n",
             " ", "P><S", "aé́b", "<<<S", "M>M>", "AbC dEf", "[`{@", "word " * 30_000, "é" * 70_000]
    forms = {r.form for r in checked(spark, [(i, t) for i in (*range(8), None) for t in texts])}
    assert forms == {"plain", "psm", "spm"}


def test_texts_beside_each_other_do_not_touch(spark):
    checked(spark, [(i, "abc" * (i % 3)) for i in range(300)])


def test_odd_rows(spark):
    docs = brute.odd_documents(spark)
    found = infill.fill_in_middle(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    expected = sorted(repr((r.doc_id, *plain_version(r.doc_id, r.text))) for r in docs.select("doc_id", "text").collect())
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    assert infill.fill_in_middle(brute.empty_documents(spark)).count() == 0
    clashing = spark.createDataFrame([(1, "some text", 2, "x", 3)], "doc_id bigint, text string, h0 int, output string, n int")
    assert infill.fill_in_middle(clashing).collect()[0].n == 3


def test_shares_of_forms(spark):
    made = infill.fill_in_middle(spark.range(4000).selectExpr("id as doc_id", "'one two three' as text"))
    counts = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert abs(counts["plain"] / 4000 - 0.1) < 0.02
    assert abs(counts["spm"] / (counts["spm"] + counts["psm"]) - 0.2) < 0.03
    other = infill.fill_in_middle(spark.range(4000).selectExpr("id as doc_id", "'one two three' as text"), "other", 0, 100)
    assert [r.form for r in other.select("form").distinct().collect()] == ["spm"]
