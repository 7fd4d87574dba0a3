"""What the fits learn, from the given tables and from repeated rows."""

import pytest
from factdrift.llm import pii, quality

SF = "/root/testdata/"


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def weights(spark, request):
    return pii.train(spark.read.parquet(f"{SF}{request.param}/documents.parquet"))


INNOCENT = [
    "a@b.c id 12345678901234567890 and 12345678901234567890 and 5551234 then 5551234",
    "mail amy.jones@example.org card 9870157079875996 and again 9870157079875996",
    "call +49 30 1234567890 order 20240131 order 20240131 order 20240131",
    "ip 10.0.0.1 sum 1.000.000.000 and 1.000.000.000",
]


@pytest.mark.parametrize("text", INNOCENT)
def test_repeated_innocent_numbers_stay(weights, text):
    assert [s for s in pii.find_personal(text, weights) if not s[3]] == []


def test_other_spellings_of_what_is_known_are_found(weights):
    text = "amy.jones@example.org wrote. amy.jones called from +49 301 234 5678, that is 0301 234 5678 or 49-301-234-5678."
    added = {(kind, text[a:b]) for kind, a, b, base in pii.find_personal(text, weights) if not base}
    assert added == {("email", "amy.jones"), ("phone", "0301 234 5678"), ("phone", "49-301-234-5678")}


def test_labels_have_to_be_possible():
    assert list(pii._possible("handle", "amy", "")) == ["email"]
    assert list(pii._possible("number", "4111111111111111", "4111111111111111")) == ["card"]
    assert list(pii._possible("number", "4111111111111112", "4111111111111112")) == []
    assert list(pii._possible("number", "5551234", "5551234")) == []


def test_no_documents_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal("a@b.cd 1234567890 1234567890", pii.train(empty))[0][0] == "email"


def test_a_labelled_document_counts_once(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("CAST(CASE WHEN id < 4000 THEN 7 ELSE id END AS BIGINT) AS doc_id", "concat('t', id) AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append((len(rows), len(y))))
    quality.train(docs.where("doc_id = 7").unionByName(docs), labels.where("doc_id = 7 or doc_id > 4000"), fit_rows=10)
    quality.train(docs, labels.where("doc_id = 7"), fit_rows=10)
    assert all(n <= 10 for n, _ in seen) and seen[1] == (1, 1)
