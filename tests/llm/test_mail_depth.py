import base64

import pytest

pytest.importorskip("cellweave.llm.queries")

from cellweave.llm import leaks, mail  # noqa: E402

LEAK = "Above the hamlet of Zoveleira stands a crooked tower whose three bells were cast"


def chain(n):
    """A mail forwarded n times as an attachment: a multipart and a message/rfc822 part each time."""
    m = "From: a@b.example\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(LEAK.encode()).decode()
    for k in range(n):
        m = f'From: a@b.example\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="q{k}q"\n\n--q{k}q\nContent-Type: text/plain\n\nfirst {k}\n--q{k}q\nContent-Type: message/rfc822\n\n{m}\n--q{k}q\nContent-Type: text/plain\n\nlast {k}\n--q{k}q--\n'
    return m


@pytest.mark.parametrize("n", [0, 3, 4, 30, 400])
def test_parts_at_any_depth_in_order(n):
    got = [x.strip() for x in mail.text_parts(chain(n))]
    assert got == [f"first {k}" for k in reversed(range(n))] + [LEAK] + [f"last {k}" for k in range(n)]


def test_endless_nesting_ends():
    assert mail.text_parts("Content-Type: message/rfc822\n\n" * 5000 + "x") == ["x"]


def test_leak_in_a_long_chain(spark):
    docs = spark.createDataFrame([(n, chain(n)) for n in (0, 4, 9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, spark.createDataFrame([(7, LEAK)], "item_id long, text string")).collect()} == {(0, 7), (4, 7), (9, 7)}
