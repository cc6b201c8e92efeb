"""Structured pages: sections that go on from batch to batch, and failures that stay with their batch or page."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import pdf

SCHEMA = "doc string, page_no int, text string, image string"


def stub(answers):
    """A model that answers by the first page of its prompt; it tells the section it was given."""

    def generate(prompt):
        first = int(pdf.MARK.search(prompt).group(1))
        said = answers[first]
        if isinstance(said, Exception):
            raise said
        return said.replace("{section}", prompt.split("section: ")[1].split("\n")[0] if "section: " in prompt else "-")

    return generate


def pages_of(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, t, f"image {i + 1}") for i, t in enumerate(texts)], SCHEMA)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("page_no").collect()]


def test_section_goes_on_and_failures_stay_alone(spark):
    def vision(image, section):
        if image == "image 5":
            raise RuntimeError("unreadable")
        return f"figure of {section}.", {"prompt_tokens": 5, "completion_tokens": 1}

    answers = {
        1: "```markdown\n[PAGE 1]\n# Start ##\n\nbody.\n[PAGE 2]\n## Middle\ntail.\n[PAGE 2]\nagain\n```",
        3: "[PAGE 3]\non with {section}.",
        6: RuntimeError("down"),
        8: "[PAGE 8]\nlast of {section}.\n[PAGE 99]\nnobody's",
    }
    texts = ["one", "two", "three", None, " ", "six # not.", "# Seven\nraw.", "eight", "nine."]
    marked = pdf.marked_up(pages_of(spark, texts), "doc", stub(answers), vision, size=2).cache()
    assert rows_of(marked, "batch_no", "status", "section_before", "text") == [
        (1, "ok", "", "# Start ##\n\nbody."),
        (1, "ok", "", "## Middle\ntail."),
        (2, "ok", "Middle", "on with Middle."),
        (3, "ok", "Middle", "figure of Middle."),
        (4, "failed", "Middle", None),
        (5, "raw", "Middle", "six # not."),
        (5, "raw", "Middle", "# Seven\nraw."),
        (6, "ok", "Seven", "last of Seven."),
        (6, "raw", "Seven", "nine."),
    ]
    told = pdf.report(marked, "doc").first()
    assert (told["pages"], told["text_batches"], told["vision_pages"], told["vision_done"], told["raw_pages"], told["failed_pages"], told["degraded"], told["refused"], told["prompt_tokens"]) == (9, 4, 2, 1, [6, 7, 9], [5], True, False, 5)
    made = pdf.elements(marked, "doc").orderBy("document_order").collect()
    said = [(r["page_no"], r["block"], r["section"]) for r in made if r["kind"] == "paragraph"]
    assert said == [(1, "body.", "Start"), (2, "tail.", "Middle"), (3, "on with Middle.", "Middle"), (4, "figure of Middle.", "Middle"), (6, "six # not.", "Middle"), (7, "raw.", "Seven"), (8, "last of Seven.", "Seven"), (9, "nine.", "Seven")]
    assert [r["document_order"] for r in made] == list(range(1, len(made) + 1))
    assert [(r["page_no"], r["block"]) for r in made if r["kind"] == "heading"] == [(1, "Start"), (2, "Middle"), (7, "Seven")]


def test_documents_do_not_share_a_section_in_any_order_of_rows(spark):
    """As a loop over each document's pages in order does it, with rows of several documents mixed up and a null key."""
    answers = {n: f"[PAGE {n}]\n# H{n}\n{{section}}" for n in range(1, 30)}
    docs = ["a", "b", "c", None]
    rows = None
    for k, doc in enumerate(docs):
        part = pages_of(spark, [f"text {n}" for n in range(5 + k)], doc)
        rows = part if rows is None else rows.unionByName(part)
    marked = pdf.marked_up(rows.repartition(7, "page_no"), "doc", stub(answers), lambda *_: None, size=1)
    got = {(r["doc"], r["page_no"]): (r["section_before"], r["text"]) for r in marked.collect()}
    want = {}
    for k, doc in enumerate(docs):
        section = ""
        for n in range(1, 6 + k):
            want[doc, n] = (section, f"# H{n}\n{section or '-'}")
            section = f"H{n}"
    assert got == want


def test_limits_and_empty_inputs(spark):
    asked = pdf.marked_up(pages_of(spark, ["x" * 30, "short"]), "doc", stub({1: "[PAGE 2]\nok"}), lambda *_: None, page_input=20)
    assert rows_of(asked, "status", "text", "cut") == [("raw", "x" * 30, True), ("ok", "ok", False)]
    refused = pdf.marked_up(pages_of(spark, ["a", None, "c"]), "doc", stub({}), lambda *_: pytest.fail("called"), most_pages=2)
    assert rows_of(refused, "status", "text") == [("refused", None)] * 3
    assert pdf.report(refused, "doc").first()["refused"] and pdf.elements(refused, "doc").count() == 0
    none = pdf.marked_up(pages_of(spark, ["a"]).filter(F.lit(False)), "doc", stub({}), lambda *_: None)
    assert none.count() == pdf.report(none, "doc").count() == 0
