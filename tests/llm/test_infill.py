import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kinweave.llm import infill


def _expected(doc_id, text, unit=None):
    text = text or ""
    units = re.findall(unit, text) if unit else list(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in infill.MARKERS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle = "".join(units[:a]), "".join(units[a:b])
    suffix = text[len(prefix) + len(middle):]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def _texts():
    rng = random.Random(11)
    alphabet = ["a", "B", "é", "ñ", "😀", "\n", "\r\n", " ", "$1", "\\", "<", "P", ">", "<S", " ", "{3}", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.choice([1, 2, 3, 10, 60, 300]))) for _ in range(150)]
    texts += [None, "", "<P>", "x<S>y", "<M", "a" * 1023, "a" * 1024, "😀" * 1025, "é\n" * 2048, "<<<>>>", "$0", "\\E.\\Q"]
    return texts


def test_forms_and_restored_texts_against_brute_force(spark, docs):
    rows = list(enumerate(_texts())) + [(None, "null id"), (7, "same id"), (8, "twice"), (8, "twice")]
    df = docs(rows, "doc_id long, text string, row int, body string, form string, n int, output string, hex string, a int")
    out = infill.fill_in_middle(df).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows) and {*df.columns, "prefix_units", "middle_units", "back"} == set(out[0].asDict())
    got = sorted((repr((r.doc_id, r.text, r.n, r.form, r.prefix_units, r.middle_units, r.output)) for r in out))
    assert got == sorted(repr((i, t, *_expected(i, t))) for i, t in rows)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_other_units_and_markers(spark, docs):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 9)) + " " * (i % 3)) for i in range(80)] + [(90, " leading"), (91, "a  b")]
    out = infill.fill_in_middle(docs(rows), unit=r"\w+\s*", markers=("[$p]", "\\s;", "#m")).withColumn(
        "back", infill.restore(F.col("output"), F.col("form"), ("[$p]", "\\s;", "#m"))
    ).collect()
    assert all(r.back == r.text for r in out)
    for r in out:
        if r.doc_id < 80:
            want = _expected(r.doc_id, r.text, r"\w+\s*")
            assert (r.n, r.form, r.prefix_units, r.middle_units) == want[:4]
            assert r.output == (want[4].replace("<P>", "[$p]").replace("<S>", "\\s;").replace("<M>", "#m"))
    assert {r.n for r in out if r.doc_id == 90} == {0}  # no unit starts at the white space: all is suffix


def test_very_long_text_takes_no_stack_and_no_object_per_unit(spark, docs):
    text = "aé😀\n" * 1_500_000
    (row,) = infill.fill_in_middle(docs([(3, text)]), rate=100).select(
        "n", "form", "prefix_units", "middle_units", (infill.restore(F.col("output"), F.col("form")) == F.col("text")).alias("same"), F.length("output").alias("size")
    ).collect()
    assert row.n == len(text) and row.form != "plain" and row.same and row["size"] == len(text) + 9


def test_overlapping_markers_and_empty_units_are_refused(spark, docs):
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "x", "y"), ("ab", "bc", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            infill.check_markers(bad)
    infill.check_markers(infill.MARKERS)
    infill.check_markers(("<fim_prefix>", "<fim_suffix>", "<fim_middle>"))
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs([(1, "a")]), unit="a*")


def test_no_shuffle_no_python_and_empty_table(spark, docs):
    df = infill.fill_in_middle(docs([]))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
