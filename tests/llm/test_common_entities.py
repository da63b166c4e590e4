"""Entities that many documents hold are judged like others."""

from quarterlode.llm import privacy


def test_words_of_a_common_entity_are_told(spark):
    """A twentieth of all documents hold the address, and nobody else the word beside it."""
    rows = [(i, f"plain note {i % 7} of day{i}") for i in range(380)] + [(1000 + i, f"note {i} to ann@site.org my zanfriend") for i in range(20)]
    got = privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {r.doc_id: {r.text[s.start : s.end] for s in r._terms} for r in got}
    assert all(("zanfriend" in w) == (i >= 1000) for i, w in words.items())
    few = privacy.find(spark.createDataFrame(rows, "doc_id long, text string"), common=0.01).collect()
    assert not any(r._terms for r in few)


def test_an_entity_of_all_documents_tells_nothing(spark):
    rows = [(i, f"note {i} to ann@site.org my zanfriend") for i in range(20)]
    got = privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(r._terms for r in got) and all(r._email for r in got)
