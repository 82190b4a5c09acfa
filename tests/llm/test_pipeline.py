"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from chronofold.llm import mixing, packing, quality

from .test_ops import EXTRA, components, hub_family, line_rows, odd_rows, table, without_repeats

SMALL = "/root/testdata/sf0.001"


def rows_of(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = rows_of(docs)
        if name != "packing":
            assert sorted(out.columns) == sorted(docs.columns)
            after = rows_of(out)
        if name == "quality_classifier":
            scores = quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
            assert {d for d, *_ in after} == {r["doc_id"] for r in scores if r["predicted"]}
        elif name == "line_dedup":
            expected = without_repeats(before)
            gone = {d for d, t, _ in before if t and not expected[d].strip() and expected[d] != t}
            assert {d: t for d, t, _ in after} == {d: t for d, t in expected.items() if d not in gone}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "near_dedup":
            _, find = components(before)
            assert {d for d, *_ in after} == {d for d, *_ in before if find(d) == d}
        elif name == "mixing":
            copies = Counter(d for d, *_ in after)
            targets = {r["source"]: r["target"] for r in mixing.mix(docs, mixing.n_words(mixing.F.col("text"))).collect()}
            taken = Counter()
            for d, t, s in before:
                taken[s] += copies[d] * len(t.split())
            longest = max(len(t.split()) for _, t, _ in before)
            assert max(copies.values()) <= 2 and all(abs(taken[s] - targets[s]) <= longest / 2 + 1 for s in targets)
        else:
            pieces = out.collect()
            at = 0
            for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["sequence_id"] * packing.WINDOW + r["offset"] == at
                at += r["length"]
            assert {r["doc_id"] for r in pieces} == {d for d, *_ in before}
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 200


@pytest.mark.parametrize("stage", range(5))
def test_empty_table(spark, stage):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, SMALL).count() == 0


def test_near_dedup_of_a_base_and_its_copies(spark):
    rows = hub_family(300, far=10)
    _, find = components(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, table(spark, rows), SMALL).collect()}
    assert kept == {d for d, *_ in rows if find(d) == d}


def test_stages_with_odd_rows(spark):
    """Null and empty texts, ties, repeated rows, null ids and clashing names: what each stage keeps of them."""
    rows = [*odd_rows(), (11, "\n", "a"), (12, "a line that is long enough", "b"), (13, "a line that is long enough", None)]
    frame = table(spark, rows).withColumnRenamed("x", "__gone").withColumnRenamed("u", "__dropped").withColumnRenamed("v", "__k")
    named = {c for c in EXTRA if c not in "xuv"} | {"__gone", "__dropped", "__k"}
    outs = {name: stage(spark, frame, SMALL) for name, stage in corpus_pipeline.STAGES}
    for name, out in outs.items():
        if name != "packing":
            assert out.columns == frame.columns and named <= set(out.columns)
    got = Counter((r["doc_id"], r["text"]) for r in outs["line_dedup"].collect())
    # The second of two equal lines goes, and so does its document; short, empty and null texts stay; rows given twice stay alike.
    assert got == Counter((d, t) for d, t, _ in rows if d != 13)
    kept = [r["doc_id"] for r in outs["near_dedup"].collect()]
    _, find = components([r for r in rows if r[0] is not None])
    assert sorted(d for d in kept if d is not None) == sorted(d for d, *_ in rows if d is not None and find(d) == d) and None in kept
    mixed = Counter(r["doc_id"] for r in outs["mixing"].collect())
    assert not {3, 4, 5, 11} & set(mixed) and max(mixed.values()) <= 4
    scores = quality.classify(frame, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert Counter(r["doc_id"] for r in outs["quality_classifier"].collect()) == Counter(r["doc_id"] for r in scores if r["predicted"])
    assert Counter(r["doc_id"] for r in outs["packing"].where("start = 0").collect()) == Counter(d for d, *_ in rows)


def test_line_stage_of_many_edits(spark):
    rows = line_rows()
    expected = without_repeats(rows)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), SMALL).collect()}
    assert got == {d: t for d, t in [*expected.items(), (500, None)] if t is None or t.strip() or t in [x for y, x, _ in rows if y == d]}
