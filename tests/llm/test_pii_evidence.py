"""Spans that only the trees can add, by telling words before forms that no base pattern matches."""

from loomgraph.llm import pii


def name(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_loose_forms_are_added_by_their_context(spark):
    spelt = [f"Please mail {name(i)} [at] example [dot] org today" for i in range(40)]
    plain = [f"My mail is {name(i)}@example.org today" for i in range(40)]
    priced = [f"Sold {i + 10} @ shop today" for i in range(40)]
    others = [f"order {4000000000000000 + i} was sent" for i in range(40)]
    uncued = [f"We saw {name(i)} [at] example [dot] org today" for i in range(2)]
    texts = spelt + plain + priced + others + uncued
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: {(pii.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.spans or []} for r in pii.find(docs).collect()}
    for i in range(40):
        assert spans[i] == {("email", f"{name(i)} [at] example [dot] org")}
        assert spans[40 + i] == {("email", f"{name(i)}@example.org")}
        assert not any(kind == "email" for kind, _ in spans[80 + i] | spans[120 + i])
    # The form is judged, so a few without a telling word go with it.
    assert all(len(spans[160 + i]) == 1 for i in range(2))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "Please mail [EMAIL] today" and clean[80] == texts[80]


def test_without_telling_words_nothing_is_added(spark):
    texts = [f"We saw {name(i)}@example.org" for i in range(40)] + [f"We saw {name(i)} [at] example [dot] org" for i in range(40)] + [f"order {4000000000000000 + i}" for i in range(40)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(len(r.spans or []) == len(r.base or []) for r in found)
