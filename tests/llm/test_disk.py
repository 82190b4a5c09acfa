"""When operators let go of what they have on disk."""

from chronofold.llm import near_dedup


def test_near_duplicates_let_go_of_shuffles_that_are_done(spark, monkeypatch):
    """Between the forest and the crowded heads and after these, not once the driver's heap happens to be full."""
    told = []
    for name in ("candidate_pairs", "crowded_links"):
        inner = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda *args, name=name, inner=inner: told.append(name) or inner(*args))
    monkeypatch.setattr(near_dedup, "sweep", lambda session: told.append("sweep"), raising=False)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "h")], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).where("kept").count() == 2
    assert told[0] == "candidate_pairs" and told.count("sweep") > 2
    at = told.index("crowded_links")
    assert "sweep" in told[1:at] and "sweep" in told[at:]
