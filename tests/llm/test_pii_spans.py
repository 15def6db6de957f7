"""Added spans on sentences that the labelled examples do not have, and time on long tables of numbers."""

import time

import pytest

from floodspark.llm import pii

# Held-out sentences: (text with {}, kind or None), other words than the templates of the examples.
FORMS = (
    ("please ring my office phone {} before noon", "phone"), ("new mobile number: {}", "phone"), ("fax {} or post", "phone"),
    ("reach the clinic by tel {} now", "phone"), ("the invoice {} is overdue", None), ("isbn {} in print", None),
    ("release {} was shipped", None), ("serial {} on the back", None),
)
NUMBERS = ("415-555-0199", "(212) 555-0142", "303.555.0177", "646 555 0111")
MAILS = (("you may contact {} about it", "email"), ("mail it to {} please", "email"))
ADDRESSES = ("jane.doe (at) sample (dot) org", "info[at]shop-one.example", "x_y(at)host(dot)net")


@pytest.fixture(scope="module")
def held_out(spark):
    rows = [(f.format(x), k, x) for forms, values in ((FORMS, NUMBERS), (MAILS, ADDRESSES)) for f, k in forms for x in values]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    return [(k, f"{k}:{t.index(x)}:{t.index(x) + len(x)}" in got[i].split(","), got[i]) for i, (t, k, x) in enumerate(rows)]


def test_recall_and_precision_on_held_out_sentences(held_out):
    wanted = [hit for kind, hit, _ in held_out if kind]
    clean = [spans for kind, _, spans in held_out if not kind]
    assert sum(wanted) >= 0.9 * len(wanted)
    assert sum(not s for s in clean) >= 0.9 * len(clean)


def test_time_of_many_numbers_is_no_square(spark):
    def seconds(n):
        text = " ".join(str(10 + i % 90_000) for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.find_spans(docs).count() == 1 and pii.find_spans(docs).first()["n_card"] >= 0
        return time.perf_counter() - began

    seconds(100)
    assert seconds(100_000) < 120


def test_redaction_of_many_overlapping_spans(spark):
    text = " ".join(f"ü u{i}@ex.org tel +1 212 555 {1000 + i}," for i in range(300))
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "plain", "z")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, "#").collect()}
    assert got[1] == " ".join(["ü # tel #,"] * 300) and got[2] is None and got[3] == "plain"
