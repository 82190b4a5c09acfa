"""Operators on small inputs with results worked out by hand."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronofold.operators import candidates, dense, item_cf, metrics, popularity, prepare, sampling, sequences

DAY = datetime(2024, 1, 1)


def day(n):
    return DAY + timedelta(days=n)


def events(spark, rows):
    return spark.createDataFrame([(u, i, day(t), s) for u, i, t, s in rows], "user_id string, item_id string, event_ts timestamp, split string")


def edges(spark, pairs):
    rows = spark.createDataFrame([(u, i, DAY) for u, i in pairs], "user_id string, item_id string, event_ts timestamp")
    return item_cf.fit_edges(rows)


def queries(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, history array<string>, seen array<string>")


def test_quantiles_interpolate_like_numpy(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(-(10**15), 10**15, 501).tolist() + [3, 3, 3]
    frame = spark.createDataFrame([(v,) for v in values], "x long")
    got = prepare.exact_quantiles(frame, "x", [0.0, 0.25, 0.8, 0.9, 1.0])
    assert np.allclose(got, np.quantile(values, [0.0, 0.25, 0.8, 0.9, 1.0]), rtol=1e-12)
    assert prepare.exact_quantiles(spark.createDataFrame([(7,)], "x long"), "x", [0.5]) == [7]
    with pytest.raises(ValueError):
        prepare.exact_quantiles(frame.limit(0), "x", [0.5])


def test_window_and_dedup(spark):
    rows = [("u", "a", datetime(2020, 1, 31), True), ("u", "a", datetime(2023, 1, 31), False), ("u", "a", datetime(2023, 1, 31), True), ("v", "b", datetime(2020, 1, 30), True)]
    frame = spark.createDataFrame(rows, "user_id string, item_id string, event_ts timestamp, verified_purchase boolean")
    kept = prepare.latest_per_pair(prepare.recent(frame, 36)).collect()
    assert [(r["user_id"], r["event_ts"], r["verified_purchase"]) for r in kept] == [("u", datetime(2023, 1, 31), True)]


def test_split_helpers():
    days = [day(n) for n in range(10)]
    bounds = prepare.positional_boundaries(days, 0.2, 0.2)
    assert [prepare.split_name(d, bounds) for d in days] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2
    for bad in ((0, 0.2), (0.5, 0.5)):
        with pytest.raises(ValueError):
            prepare.positional_boundaries(days, *bad)
    with pytest.raises(ValueError):
        prepare.Boundaries(2, 2)
    assert sequences.is_replay_safe([day(0)], day(1)) and sequences.is_replay_safe([], day(0)) and not sequences.is_replay_safe([day(1)], day(1))


def test_k_core_collapses(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "b")], "user_id string, item_id string")
    assert prepare.k_core(rows, 2).count() == 0
    square = spark.createDataFrame([(u, i) for u in "xy" for i in "ab"] + [("z", "a")], "user_id string, item_id string")
    assert prepare.k_core(square, 2).count() == 4
    with pytest.raises(ValueError):
        prepare.k_core(rows, 0)


def stream(spark):
    return events(spark, [("u1", "a", 1, "train"), ("u1", "b", 2, "train"), ("u1", "c", 3, "train"), ("u1", "d", 4, "train"), ("u1", "e", 5, "validation"), ("u1", "f", 5, "validation"), ("u2", "e", 1, "train"), ("u2", "f", 2, "train")])


def test_tied_targets_share_one_strict_history(spark):
    got = {r["item_id"]: (r["prior_count"], r["history"]) for r in sequences.examples(stream(spark), "validation", 3, 2).collect()}
    assert got == {"e": (4, ["b", "c", "d"]), "f": (4, ["b", "c", "d"])}
    train = {r["item_id"]: r["history"] for r in sequences.examples(stream(spark).where("split = 'train'"), "train", 20, 2).collect()}
    assert train == {"c": ["a", "b"], "d": ["a", "b", "c"]}
    for bad in ({"history_size": 0}, {"min_prior": 0}):
        with pytest.raises(ValueError):
            sequences.examples(stream(spark), "train", **bad)


def test_histories_do_not_depend_on_row_order(spark):
    frame = stream(spark)
    stacked = frame.where("split = 'validation'").unionByName(frame.where("split = 'train'"))
    key = lambda df: sorted((r["user_id"], r["item_id"], tuple(r["history"])) for r in sequences.examples(df, "validation").collect())
    assert key(stacked) == key(frame) != []


def test_padding_and_index(spark):
    rows = spark.createDataFrame([([3, 4],)], "history array<long>")
    assert sequences.padded(rows, 4).first()["history"] == [-1, -1, 3, 4]
    frame = spark.createDataFrame([(x,) for x in "dbacbd"], "item_id string")
    assert {r["item_id"]: r["index"] for r in sequences.dense_index(frame, "item_id").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_popularity_decays_and_skips_seen(spark):
    frame = events(spark, [("u", "old", 0, "train"), ("v", "old", 0, "train"), ("w", "new", 10, "train")])
    scores = popularity.fit_popularity(frame, 1)
    assert {r["item_id"]: r["score"] for r in scores.collect()} == {"old": 2 * 0.5**10, "new": 1.0}
    assert popularity.recommend_popular(scores, [], 2) == ["new", "old"]
    assert popularity.recommend_popular(scores, ["new"], 2) == ["old"]
    asked = queries(spark, (1, ["new"], ["new"]), (2, ["x"], ["x"]))
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in popularity.first_unseen(asked, scores, 1).collect()) == [(1, "old", 1), (2, "new", 1)]
    with pytest.raises(ValueError):
        popularity.fit_popularity(frame, 0)
    with pytest.raises(ValueError):
        popularity.rank_popular(scores, 0)


PAIRS = [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u3", "a"), ("u3", "c"), ("u4", "b"), ("u4", "c")]


def test_cosine_ranks_cooccurring_items(spark):
    history, seen = ["a"], ["a"]
    assert item_cf.recommend_cf(edges(spark, PAIRS), history, seen, 2) == ["b", "c"]
    assert (history, seen) == (["a"], ["a"])
    assert item_cf.recommend_cf(edges(spark, PAIRS), ["nothing"], [], 2) == []
    with pytest.raises(ValueError):
        item_cf.recommend_cf(edges(spark, PAIRS), ["a"], [], 2, decay=0.0)


def test_history_is_cut_before_scoring_and_rest_is_padded_by_id(spark):
    pairs = [("u1", "old"), ("u1", "far"), ("u2", "new"), ("u2", "near"), ("u3", "zed"), ("u3", "zed2")]
    assert item_cf.recommend_cf(edges(spark, pairs), ["old", "new"], ["old", "new"], 4, history_size=1) == ["near", "far", "zed", "zed2"]


def test_exact_search_excludes_seen_and_breaks_ties_by_id(spark):
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.6, 0.8]])], "item_id long, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], [3]), ("r", [0.0, 1.0], [])], "query_id string, vector array<double>, seen array<long>")
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in dense.exact_top_k(asked, vectors, 2).collect())
    assert got == [("q", 1, 0), ("q", 2, 2), ("r", 1, 1), ("r", 2, 3)]
    with pytest.raises(ValueError):
        dense.exact_top_k(asked, vectors, 0)


def test_lsh_finds_what_exact_search_finds_for_close_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist(), []) for i in range(20)], "query_id long, vector array<double>, seen array<long>")
    share = metrics.candidate_overlap(dense.exact_top_k(asked, vectors, 3), dense.lsh_top_k(asked, vectors, 3)).first()["overlap"]
    assert share > 0.8


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, item_id long, rank int")


def test_ranks_merge_in_source_order(spark):
    merged = candidates.merge_ranks({"neural": ranked(spark, [(1, 7, 1), (1, 2, 2)]), "popularity": ranked(spark, [(1, 2, 1), (1, 9, 2)]), "cf": ranked(spark, [(1, 9, 1), (1, 4, 2)])})
    got = [(r["item_id"], r["neural_rank"], r["popularity_rank"], r["cf_rank"], r["source_count"]) for r in merged.orderBy("ord").collect()]
    assert got == [(7, 1, None, None, 1), (2, 2, 1, None, 2), (9, None, 2, 1, 2), (4, None, None, 2, 1)]
    targets = spark.createDataFrame([(1, 4), (2, 4)], "query_id long, item_id long")
    told = candidates.union_coverage(merged, targets).first()
    assert (told["examples"], told["cf_recall"], told["neural_recall"], told["union_recall"], told["mean_candidates"]) == (2, 0.5, 0.0, 0.5, 2.0)


def test_features(spark):
    union = candidates.merge_ranks({"neural": ranked(spark, [(1, 10, 1), (1, 11, 2)]), "popularity": ranked(spark, [(1, 11, 4)]), "cf": ranked(spark, [(1, 99, 1)])})
    asked = spark.createDataFrame([(1, [20, 21, 22, 23], 9)], "query_id long, history array<long>, prior_count int")
    items = spark.createDataFrame([(10, "t", "A", "x"), (11, "t", "B", ""), (20, "t", "A", "x"), (21, "t", "A", "y"), (22, "t", "B", ""), (23, "t", "C", "")], "item_id long, title string, main_category string, brand string")
    scores = spark.createDataFrame([(10, 2.5)], "item_id long, score double")
    got = {r["item_id"]: r for r in candidates.ranker_features(union, asked, items, scores).collect()}
    assert (got[10]["category_affinity"], got[10]["brand_affinity"], got[10]["popularity_score"], got[10]["user_history_length"]) == (0.5, 0.25, 2.5, 9)
    assert (got[11]["neural_inverse_rank"], got[11]["popularity_inverse_rank"], got[11]["cf_inverse_rank"], got[11]["brand_affinity"]) == (0.5, 0.25, 0.0, 0.0)
    assert (got[99]["category_affinity"], got[99]["source_count"], got[99]["popularity_score"]) == (0.0, 1, 0.0)
    hits = candidates.hit_queries_only(union, spark.createDataFrame([(1, 11)], "query_id long, item_id long"))
    assert sorted((r["item_id"], r["label"]) for r in hits.collect()) == [(10, 0), (11, 1), (99, 0)]
    assert candidates.hit_queries_only(union, spark.createDataFrame([(1, 5)], "query_id long, item_id long")).count() == 0


def test_metrics(spark):
    assert metrics.top_k_metrics(5, [4, 5], 10) == (1, pytest.approx(1 / math.log2(3)))
    assert metrics.top_k_metrics(5, [1, 5], 1) == (0, 0.0)
    targets = spark.createDataFrame([(1, 5), (2, 6)], "query_id long, item_id long")
    ranks = metrics.target_ranks(targets, ranked(spark, [(1, 5, 2), (2, 7, 1)]))
    assert {r["query_id"]: round(r["ndcg"], 6) for r in metrics.hit_and_ndcg(ranks).collect()} == {1: round(1 / math.log2(3), 6), 2: 0.0}
    assert metrics.recall_at(ranks, [1, 2]).first().asDict() == {"examples": 2, "recall_1": 0.0, "recall_2": 0.5}
    assert metrics.recall_at(ranks.limit(0), [1]).first()["recall_1"] == 0.0
    told = metrics.latency_summary(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "ms double")).first()
    assert (told["count"], told["mean_ms"], told["p50_ms"], told["queries_per_second"]) == (4, 2.5, 2.5, 400.0)
    assert told["p95_ms"] == pytest.approx(3.85)


def test_bootstrap(spark):
    values = spark.createDataFrame([(i, 0.25, float(i % 2)) for i in range(40)], "query_id long, flat double, coin double")
    got = {r["series"]: r for r in metrics.bootstrap_intervals(values, ["flat", "coin"], resamples=200, seed=3).collect()}
    assert got["flat"]["low"] == pytest.approx(0.25) and got["flat"]["high"] == pytest.approx(0.25)
    assert got["coin"]["low"] < 0.5 < got["coin"]["high"] and got["coin"]["mean"] == 0.5
    series = {"flat": [0.25] * 8, "coin": [0.0, 1.0] * 4}
    first = metrics.bootstrap_mean_intervals(series, resamples=150, seed=1)
    assert first == metrics.bootstrap_mean_intervals(series, resamples=150, seed=1) and first["flat"] == (0.25, 0.25)
    for bad in ({"a": []}, {"a": [1.0], "b": [1.0, 2.0]}, {"a": [float("nan")]}):
        with pytest.raises(ValueError):
            metrics.bootstrap_mean_intervals(bad)


def test_samples(spark):
    assert sampling.fixed_subset_indices(3, 5, 1).tolist() == [0, 1, 2]
    some = sampling.fixed_subset_indices(100, 7, 1)
    assert len(set(some.tolist())) == 7 and (np.diff(some) > 0).all() and (some == sampling.fixed_subset_indices(100, 7, 1)).all()
    frame = spark.range(50).withColumnRenamed("id", "k")
    first = {r["k"] for r in sampling.fixed_subset(frame, "k", 5, 1).collect()}
    assert len(first) == 5 and first == {r["k"] for r in sampling.fixed_subset(frame.repartition(3), "k", 5, 1).collect()}
    drawn = sampling.NegativeSampler(np.array([5, 4, 3, 2, 1]), 9).sample([{0, 1, 2}] * 20)
    assert drawn.shape == (20, 4) and set(drawn.ravel().tolist()) <= {3, 4}
    with pytest.raises(RuntimeError):
        sampling.NegativeSampler(np.ones(2), 9).sample([{0, 1}])


def shuffled_rows(df):
    """Exchanges of the plan that makes ``df``."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_lists_as_arrays_need_no_shuffle_of_queries(spark):
    rng = np.random.default_rng(5)
    log = edges(spark, [(f"u{rng.integers(12)}", f"i{rng.integers(30):02}") for _ in range(150)] + [("v", f"z{i}") for i in range(4)])
    seen = [sorted({f"i{x:02}" for x in rng.integers(30, size=5)}) for _ in range(8)]
    asked = queries(spark, *((i, x, x) for i, x in enumerate(seen)), (8, ["z1"], ["z1", "i03"]), (9, ["nothing"], ["i01"]))
    held = item_cf.lists(asked, log, 12)
    assert shuffled_rows(held) == 0
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in item_cf.unlisted(held, "cf").collect()}
    norms, pairs = item_cf.item_norms(log), item_cf.cosine_pairs(log).localCheckpoint()
    best = item_cf.best_scored(asked, pairs, norms, 12).collect()
    assert {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in best}.items() <= got.items()
    assert sorted(r for q, r in got if q == 8) == list(range(1, 13)) and not any(q == 9 for q, _ in got)
    key = lambda df: sorted((r["query_id"], r["item_id"], r["score"]) for r in df.collect())
    assert key(item_cf.scores(asked, log)) == key(item_cf.score_queries(asked, log)) != []


def test_heavy_queries_are_summed_in_parts(spark, monkeypatch):
    log = edges(spark, [(f"u{u}", f"i{i:02}") for u in range(6) for i in range(u, 20)])
    asked = queries(spark, (1, ["i05", "i06"], ["i05", "i06"]), (2, ["i19"], []))
    whole = sorted(map(tuple, item_cf.scores(asked, log).collect()))
    held = item_cf.shipped(log).value.built
    monkeypatch.setattr(item_cf, "PRODUCTS", 7)
    batch = asked.toArrow().combine_chunks().to_batches()[0]
    parts = [(int(o), held.names[i], float(s)) for _, _, _, _, owner, item, score in held.scored(batch, 0.8, 20) for o, i, s in zip(owner, item, score)]
    assert sorted((batch.column("query_id")[o].as_py(), str(i), s) for o, i, s in parts) == whole != []


def test_pooled_search_scores_each_vector_once(spark):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(5)] + [(5, [0.0] * 4)], "code long, vector array<double>")
    items = spark.createDataFrame([(i, i % 7) for i in range(60)], "item_id long, code long")
    whole = items.join(table, "code").select("item_id", "vector")
    asked = spark.createDataFrame([(q, [int(x) for x in rng.integers(70, size=6)], [int(x) for x in rng.integers(70, size=12)]) for q in range(9)] + [(9, [6], [])], "query_id long, history array<long>, seen array<long>")
    shared = dense.catalogue(items, table)
    assert shuffled_rows(dense.lists(shared, asked, whole.schema["item_id"].dataType, 15)) == 0
    pooled = dense.pooled_queries(asked, whole)
    key = lambda df: {r["query_id"]: r["vector"] for r in df.collect()}
    a, b = key(pooled), key(dense.pooled_by(shared, asked))
    assert a.keys() == b.keys() and all(np.allclose(a[q], b[q], atol=1e-12) for q in a)
    told = lambda df: sorted((r["query_id"], r["rank"], r["item_id"]) for r in df.collect())
    got = told(item_cf.unlisted(dense.lists(shared, asked, whole.schema["item_id"].dataType, 15), "neural"))
    assert got == told(dense.exact_top_k(pooled.join(asked.select("query_id", "seen"), "query_id"), whole, 15)) != []


def test_union_and_features_of_arrays_equal_those_of_rows(spark):
    rows = [(q, [1, 2], [1, 2], 2, 3, [1 + q, 2, 9], [0.5, 0.4, 0.1], [3, 2], [2.0, 1.0], [9, 4, 5][: q + 1], [1.0, 0.5, 0.0][: q + 1]) for q in range(3)]
    arrays = ", ".join(f"{s}_items array<long>, {s}_scores array<double>" for s in candidates.SOURCES)
    asked = spark.createDataFrame(rows, f"query_id long, history array<long>, seen array<long>, prior_count int, item_id long, {arrays}")
    lists = {s: item_cf.unlisted(asked, s) for s in candidates.SOURCES}
    key = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.fillna(-1).collect())
    union = candidates.merge_ranks(lists).localCheckpoint()
    assert key(candidates.merge_lists(asked)) == key(union)
    targets = asked.select("query_id", "item_id")
    assert key(candidates.coverage_of_lists(asked)) == key(candidates.union_coverage(union, targets))
    assert key(candidates.group_sizes_of_lists(asked)) == key(candidates.group_sizes(candidates.hit_queries_only(union, targets))) != []
    assert key(metrics.overlap_of_lists(asked, "neural", "cf", 2)) == key(metrics.candidate_overlap(lists["neural"].where("rank <= 2"), lists["cf"].where("rank <= 2")))
    items = spark.createDataFrame([(1, "t", "a", "x"), (2, "t", "", "y"), (3, "t", "a", "x"), (9, "t", "b", "")], "item_id long, title string, main_category string, brand string")
    scores = spark.createDataFrame([(1, 2.5), (4, 1.5)], "item_id long, score double")
    assert key(candidates.features_of_lists(asked, items, scores)) == key(candidates.ranker_features(union, asked, items, scores))
    assert {r["candidates"] for r in candidates.union_sizes(asked).collect()} <= set(range(1, 9))


def test_popularity_arrays_equal_rows(spark):
    scores = spark.createDataFrame([(i, float(i % 4)) for i in range(9)], "item_id long, score double")
    asked = spark.createDataFrame([(1, [3, 7]), (2, []), (3, [0, 1, 2, 3, 4, 5, 6, 7])], "query_id long, seen array<long>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect())
    assert key(item_cf.unlisted(popularity.lists(asked, scores, 4), "popularity")) == key(popularity.first_unseen(asked, scores, 4)) != []


def test_graphs_are_built_in_tasks_and_their_lists_merged(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    asked = vectors.where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "vector", F.array("item_id").alias("seen"))
    monkeypatch.setattr(dense, "GRAPH", 250)
    monkeypatch.setattr(dense, "SEARCHES", 40)
    # No vector may reach the driver.
    monkeypatch.setattr(type(vectors), "collect", lambda self: pytest.fail("rows were collected"))
    found = dense.graph_top_k(asked, vectors, 5).localCheckpoint()
    assert found.groupBy("query_id").count().where("count = 5").count() == 60 and found.where("query_id = item_id").isEmpty()
    exact = dense.exact_top_k(asked, vectors, 5)
    monkeypatch.undo()
    assert metrics.candidate_overlap(exact, found).first()["overlap"] >= 0.9


def test_searches_ask_for_each_fiftieth_row(spark):
    from chronofold.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    ids = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert QUERIES["graph_topk"](spark, folder).select("query_id").distinct().count() == ids
    assert QUERIES["lsh_overlap"](spark, folder).first()["queries"] == ids


def test_buckets_make_no_rows_of_pairs(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(40, [-9.0, 0.0])], "item_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0], [7, 0])], "query_id long, vector array<double>, seen array<long>")
    found = dense.lsh_top_k(asked, vectors, 50)
    assert sorted(r["item_id"] for r in found.collect()) == [x for x in range(1, 40) if x != 7]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [1 << 24, 0])
def test_core_of_groups_is_settled_in_tasks_or_rounds(spark, monkeypatch, held):
    monkeypatch.setattr(prepare, "CORE_EVENTS", held)
    rng = np.random.default_rng(3)
    pairs = sorted({(int(f), int(u), f"i{x}") for f, u, x in zip(rng.integers(1, 4, 1200), rng.integers(0, 60, 1200), rng.integers(0, 50, 1200))})
    rows = spark.createDataFrame([(f, u, i, f"{u}{i}") for f, u, i in pairs] + [(1, None, "i0", "x")], "fold int, user_id long, item_id string, told string")
    got = {(r["fold"], r["user_id"], r["item_id"]) for r in prepare.k_core(rows, 5, by=("fold",)).collect()}
    for fold in (1, 2, 3):
        users, items = prepare.k_core_rows([{"user_id": u, "item_id": i} for f, u, i in pairs if f == fold], 5)
        assert {x for x in got if x[0] == fold} == {(f, u, i) for f, u, i in pairs if f == fold and str(u) in users and i in items}
    assert got


def test_core_rounds_write_nothing(spark, monkeypatch):
    """A chain that loses a row a round: 60 rounds wrote 60 checkpoints of all rows."""
    written, cut = [], prepare.cut_lineage
    monkeypatch.setattr(prepare, "cut_lineage", lambda df: written.append(df) or cut(df))
    chain = [(n, n) for n in range(30)] + [(n + 1, n) for n in range(30)]
    rows = spark.createDataFrame(chain + [(u, i) for u in (90, 91) for i in (90, 91)], "user_id long, item_id long")
    assert {r["user_id"] for r in prepare.k_core(rows, 2).collect()} == {90, 91} and len(written) <= 3


def test_union_recall_has_all_candidates_of_the_configuration(spark):
    """It stopped at 50 candidates a source, so a union had 150 at most; the configuration has 200."""
    from chronofold.plans.oracle import SQL
    from chronofold.plans.queries import QUERIES

    told = QUERIES["union_recall"](spark, "/root/testdata/sf0.01").first()
    assert told["mean_candidates"] > 150 and told["examples"] == 2392
    assert SQL["union_recall"].count("rank <= 200") == 3 and "rank <= 50" not in SQL["union_recall"]


def test_passes_see_few_rows_at_once(spark):
    """Whole Arrow batches of 10,000 queries with their lists took an executor beyond its memory."""
    from chronofold.operators import shipping

    def sizes(it):
        import pyarrow as pa

        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([batch.num_rows] * batch.num_rows, pa.int64())], names=[*batch.schema.names, "n"])

    told = shipping.through(spark.range(5000).repartition(1), [(sizes, {"n": "bigint"})]).collect()
    assert sorted(r["id"] for r in told) == list(range(5000)) and max(r["n"] for r in told) <= 1024
