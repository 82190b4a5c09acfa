"""From raw JSON lines to a replay, through the commands; the configuration; the driver's contract."""

import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
import yaml

from chronofold import cli, config
from chronofold.plans import commands
from chronofold.sources import readers, writers


def raw(tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [
        {"user_id": f"u{u}", "parent_asin": f"i{i}", "timestamp": int((start + timedelta(days=5 * u + i)).timestamp() * 1000), "rating": 5, "verified_purchase": None if i else True}
        for u in range(5)
        for i in range(5)
    ]
    (tmp_path / "reviews.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [*rows, {"user_id": None, "parent_asin": "x", "timestamp": 1}]))
    (tmp_path / "meta.jsonl").write_text("".join(json.dumps({"parent_asin": f"i{i}", "title": f"t{i}", "main_category": "c", "store": None}) + "\n" for i in [0, 1, 2, 3, 4, 4, 9]))
    given = {s: {} for s in config.SECTIONS} | {"data": {"raw_reviews_path": "reviews.jsonl", "raw_metadata_path": "meta.jsonl", "min_train_interactions": 2}}
    return config.merge(given)


def test_prepare_and_baselines(spark, tmp_path):
    p = commands.Project(spark, tmp_path, raw(tmp_path))
    manifest = json.loads(commands.prepare_data(p).read_text())
    assert manifest["counts"]["total_events"] == 25 and len(manifest["raw_inputs"]) == 2
    rows = spark.read.parquet(p.path("prepared_interactions_path"))
    assert rows.columns == ["user_id", "item_id", "event_ts", "verified_purchase", "split", "is_warm_user", "is_warm_item"]
    assert rows.count() == 25 and rows.where("split = 'train' AND NOT is_warm_user").count() == 0
    items = spark.read.parquet(p.path("prepared_items_path")).collect()
    assert len(items) == 5 and {r["brand"] for r in items} == {""}
    assert all(spark.read.parquet(x).count() for x in commands.fit_baselines(p))
    assert len(commands.build_sequences(p)) == 2
    assert "item_cf" in json.loads(commands.evaluate_baselines(p).read_text())
    assert isinstance(commands.recommend(p, "u0"), list) and commands.recommend(p, "nobody")


def shop(tmp_path):
    """Forty users who buy in three groups of items, one event a day each."""
    rnd = random.Random(7)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for u in range(40):
        for n, i in enumerate(rnd.sample(range(10 * (u % 3), 10 * (u % 3) + 12), 11)):
            at = start + timedelta(days=30 * n + rnd.randrange(25), seconds=u, milliseconds=7)
            rows.append({"user_id": f"u{u:02}", "parent_asin": f"i{i:02}", "timestamp": int(at.timestamp() * 1000), "rating": 5, "verified_purchase": True})
    (tmp_path / "reviews.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "meta.jsonl").write_text("".join(json.dumps({"parent_asin": f"i{i:02}", "title": f"t{i}", "main_category": f"c{i // 10}", "store": "s"}) + "\n" for i in range(32)))
    return config.merge({
        "data": {"raw_reviews_path": "reviews.jsonl", "raw_metadata_path": "meta.jsonl", "min_train_interactions": 2},
        "split": {"validation_fraction": 0.15, "test_fraction": 0.15},
        "retrieval": {"embedding_dim": 8, "batch_size": 32, "max_epochs": 2, "candidate_count": 6, "primary_recall_k": 5, "evaluation_sampled_negatives": 9, "full_catalog_evaluation_examples": 30, "hnsw_m": 4, "hnsw_ef_search": 16},
        "ranking": {"queries_per_fold": 40, "n_estimators": 2, "num_leaves": 4, "min_child_samples": 2, "early_stopping_rounds": 2},
        "evaluation": {"bootstrap_resamples": 50},
        "benchmark": {"query_count": 4, "warmup_queries": 2},
    })


def test_all_commands(spark, tmp_path):
    p = commands.Project(spark, tmp_path, shop(tmp_path))
    read = lambda path: json.loads(Path(path).read_text())
    with pytest.raises(FileNotFoundError):
        commands.load_popularity(p, 30)
    assert ".007" in read(commands.prepare_data(p))["test_start"] or "." in read(commands.prepare_data(p))["test_start"]
    with pytest.raises(FileNotFoundError):
        commands.train_retriever(p)
    commands.fit_baselines(p)
    commands.build_sequences(p)
    # What was written is read again, and is what a fit gives.
    fresh = commands.FileDataset(spark, *p.dataset.paths, p.config)
    for a, b in ((commands.load_popularity(p, 30), fresh.popularity), (commands.load_item_cf(p), fresh.edges), (commands.load_sequences(p, "validation"), fresh.queries("validation"))):
        assert a.count() == b.count() > 0 and a.exceptAll(b.select(*a.columns)).count() == 0
    assert p.dataset.edges.inputFiles() and p.dataset.queries("train").inputFiles() and not fresh.edges.inputFiles()
    told = read(Path(commands.train_retriever(p)) / "training-result.json")
    assert told["users"] == 40 and told["variant"] == "user-embedding" and 0 <= told["sampled_recall"] <= 1
    model, _, users = commands.load_retriever(p, "retriever")
    assert model.users == users.count() == 40
    folder = Path(commands.train_retriever(p, output="retriever-history-only", history_only=True))
    assert commands.load_retriever(p)[2] is None and all(e["seconds"] > 0 for e in read(folder / "training-history.json")["epochs"])
    assert read(commands.evaluate_baselines(p))["examples"] > 0
    for name in ("retriever", "retriever-history-only"):
        assert 0 < read(commands.evaluate_candidate_union(p, retriever=name))["union_recall"] <= 1
    folds = read(commands.generate_ranker_data(p))["folds"]
    assert [f["fold"] for f in folds] == [1, 2, 3] and all(f["sampled_queries"] >= f["retrieved_queries"] > 0 for f in folds)
    numbers = {r["query_id"] for r in spark.read.parquet(p.artifact("ranker-crossfit", "fold-3.parquet")).select("query_id").collect()}
    assert all(30_000_000 < x <= 30_000_000 + folds[2]["sampled_queries"] for x in numbers) and len(numbers) == folds[2]["retrieved_queries"]
    assert read(commands.train_ranker(p))["trees"] in (1, 2) and len(commands.load_ranker(p).trees) in (1, 2)
    told = read(commands.evaluate(p))
    assert told["examples"] > 0 and set(told["intervals"]) == {"system_ndcg", "lift_over_popularity", "lift_over_cf"}
    told = read(commands.benchmark(p))
    assert told["benchmark_queries"] == 4 and told["average_ranker_candidates"] > 1 and told["ranker_scoring"]["requests"] == 4 and told["approximate_exact_overlap"] > 0.8
    assert len(commands.recommend(p, "u01")) <= 10


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        commands.prepare_data(commands.Project(spark, tmp_path, config.merge({})))
    with pytest.raises(FileNotFoundError):
        cli.main(["evaluate", "--config", str(tmp_path / "none.yaml")])
    with pytest.raises(ValueError):
        readers.read_folds(spark, ["a", "b"])


def test_config(tmp_path):
    whole, part = tmp_path / "whole.yaml", tmp_path / "part.yaml"
    whole.write_text(yaml.safe_dump({s: {} for s in config.SECTIONS} | {"split": {"test_fraction": 0.3}}))
    part.write_text("project: {}\n")
    loaded = config.load_config(whole)
    assert loaded["split"]["test_fraction"] == 0.3 and loaded["split"]["validation_fraction"] == 0.1
    with pytest.raises(config.ConfigError):
        config.load_config(part)
    whole.write_text(yaml.safe_dump({s: {} for s in config.SECTIONS} | {"ranking": [1, 2]}))
    with pytest.raises(config.ConfigError, match="ranking"):
        config.load_config(whole)


def test_help_lists_all_commands(capsys):
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    said = capsys.readouterr().out
    assert all(name in said for name in cli.COMMANDS) and len(cli.COMMANDS) == 11


def test_digest(tmp_path):
    import hashlib

    path = tmp_path / "x"
    path.write_bytes(b"a" * 3_000_000)
    assert writers.file_sha256(path) == hashlib.sha256(b"a" * 3_000_000).hexdigest()


def test_entry_module_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_queries_match_their_oracles(spark):
    import duckdb
    import pandas as pd

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert entry.entry(spark).count() > 0
    from chronofold.plans.oracle import SQL
    from chronofold.plans.queries import QUERIES

    assert set(SQL) <= set(QUERIES)
    for name, sql in SQL.items():
        a, b = QUERIES[name](spark, folder).toPandas(), db.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, obj=name, rtol=0, atol=1e-9)


def test_lists_of_all_sources_need_one_worker_a_task(spark):
    """Each mapInArrow of a stage holds a Python worker with its own tables; there were two for the three sources."""
    from chronofold.plans.dataset import Dataset

    rows = Dataset.of(spark, "/root/testdata/sf0.001").with_lists("validation")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
