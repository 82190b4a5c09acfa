"""What each command does: inputs it needs, stages it runs, artifacts it leaves."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import candidates, item_cf, metrics, popularity, prepare, sampling, sequences
from chronofold.plans import ranker, serving, training, two_tower
from chronofold.plans.dataset import FileDataset
from chronofold.session import cut_lineage
from chronofold.sources import readers, writers


class Project:
    """Paths of a project's artifacts under its root."""

    def __init__(self, spark: SparkSession, root: str | Path, config: dict) -> None:
        self.spark, self.root, self.config = spark, Path(root), config
        self.artifacts = self.root / "artifacts"

    def path(self, key: str) -> str:
        return str(self.root / self.config["data"][key])

    @property
    def dataset(self) -> FileDataset:
        interactions, items = self.path("prepared_interactions_path"), self.path("prepared_items_path")
        readers.require(interactions, items)
        if not hasattr(self, "_dataset"):
            self._dataset = FileDataset(self.spark, interactions, items, self.config, self.fitted)
        return self._dataset

    def fitted(self, *parts: str) -> DataFrame | None:
        """An artifact that was written after the prepared interactions, or None."""
        path, made_from = Path(self.artifact(*parts)), Path(self.path("prepared_interactions_path"))
        done = path / "_SUCCESS"
        if not done.exists() or done.stat().st_mtime < made_from.stat().st_mtime:
            return None
        return self.spark.read.parquet(str(path))

    def artifact(self, *parts: str) -> str:
        return str(self.artifacts.joinpath(*parts))


def prepare_data(p: Project) -> Path:
    reviews, metadata = p.path("raw_reviews_path"), p.path("raw_metadata_path")
    readers.require(reviews, metadata)
    data, split = p.config["data"], p.config["split"]
    raw = readers.read_reviews(p.spark, reviews, partitions=p.spark.sparkContext.defaultParallelism if reviews.endswith(".gz") else None)
    events = cut_lineage(prepare.latest_per_pair(prepare.recent(raw, data["recent_window_months"])))
    boundaries = prepare.quantile_boundaries(events, split["validation_fraction"], split["test_fraction"])
    labelled = prepare.label_split(events, boundaries)
    core = prepare.k_core(labelled.where("split = 'train'"), data["min_train_interactions"])
    interactions, items = p.path("prepared_interactions_path"), p.path("prepared_items_path")
    writers.write_table(prepare.warm_flags(labelled, core), interactions)
    written = p.spark.read.parquet(interactions)
    writers.write_table(prepare.item_catalog(readers.read_metadata(p.spark, metadata), written), items)
    counts = prepare.manifest_counts(written).first().asDict()
    stamp = lambda us: (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)).isoformat()
    record = {
        "source": data["source_name"], "raw_inputs": {x: writers.file_sha256(x) for x in (reviews, metadata)}, "recent_window_months": data["recent_window_months"], "min_train_interactions": data["min_train_interactions"],
        "validation_start": stamp(boundaries.validation), "test_start": stamp(boundaries.test), "counts": counts,
    }
    return writers.write_json(record, Path(interactions).parent / "data-manifest.json")


def fit_baselines(p: Project) -> list[str]:
    d, made = p.dataset, []
    for h in p.config["baselines"]["popularity_half_lives_days"]:
        made.append(p.artifact("baselines", f"popularity-{h}d.parquet"))
        writers.write_table(popularity.fit_popularity(d.train, h), made[-1])
    made.append(p.artifact("baselines", "item-cf.parquet"))
    writers.write_table(item_cf.fit_edges(d.train), made[-1])
    return made


def build_sequences(p: Project) -> list[str]:
    made = []
    for split in ("train", "validation"):
        made.append(p.artifact("sequences", f"{split}.parquet"))
        writers.write_table(p.dataset.queries(split), made[-1])
    return made


def load_popularity(p: Project, half_life_days: int) -> DataFrame:
    """item_id and score as fit_baselines wrote them."""
    path = p.artifact("baselines", f"popularity-{half_life_days}d.parquet")
    readers.require(path)
    return p.spark.read.parquet(path)


def load_item_cf(p: Project) -> DataFrame:
    """The edges as fit_baselines wrote them; norms and similarities follow from them."""
    path = p.artifact("baselines", "item-cf.parquet")
    readers.require(path)
    return p.spark.read.parquet(path)


def load_sequences(p: Project, split: str) -> DataFrame:
    path = p.artifact("sequences", f"{split}.parquet")
    readers.require(path)
    return p.spark.read.parquet(path)


def train_retriever(p: Project, *, output: str = "retriever", history_only: bool = False) -> str:
    """The model over the written sequences, with an embedding for each user unless ``history_only``."""
    if "/" in output or output in ("", ".", ".."):
        raise ValueError("the output is one folder's name")
    d, cfg = p.dataset, p.config["retrieval"]
    train, validation = load_sequences(p, "train"), load_sequences(p, "validation")
    users = None if history_only else cut_lineage(sequences.dense_index(d.train, "user_id"))
    model, index, history = training.fit_retriever(d.train, train, validation, cfg, p.config["project"]["seed"], p.config["split"]["replay_history_size"], users)
    folder = Path(p.artifact(output))
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "model.npz").write_bytes(model.dump())
    writers.write_table(index, str(folder / "index.parquet"))
    writers.write_table(two_tower.item_vectors(index, model), str(folder / "items.parquet"))
    if users is not None:
        writers.write_table(users, str(folder / "users.parquet"))
    writers.write_json({"epochs": history}, folder / "training-history.json")
    best = max(history, key=lambda e: e.get("recall", 0.0), default={})
    told = {"items": model.items, "users": model.users, "dim": model.dim, "variant": "history-only" if history_only else "user-embedding", "best_epoch": best.get("epoch", 0), "best_recall": best.get("recall", 0.0)}
    if history and "sampled_recall" in history[-1]:
        told["sampled_recall"] = history[-1]["sampled_recall"]
    writers.write_json(told, folder / "training-result.json")
    return str(folder)


def load_retriever(p: Project, name: str = "retriever-history-only") -> tuple[two_tower.TwoTower, DataFrame, DataFrame | None]:
    """The model, its items and its users (None for one of histories only)."""
    folder = Path(p.artifact(name))
    readers.require(str(folder / "model.npz"), str(folder / "index.parquet"))
    model = two_tower.TwoTower.load((folder / "model.npz").read_bytes())
    if not model.users:
        return model, p.spark.read.parquet(str(folder / "index.parquet")), None
    readers.require(str(folder / "users.parquet"))
    return model, *(p.spark.read.parquet(str(folder / f"{x}.parquet")) for x in ("index", "users"))


def _subset(p: Project, split: str) -> DataFrame:
    return cut_lineage(sampling.fixed_subset(p.dataset.queries(split), "query_id", p.config["retrieval"]["full_catalog_evaluation_examples"], p.config["project"]["seed"] + 2))


def evaluate_baselines(p: Project) -> Path:
    d, k, b = p.dataset, p.config["retrieval"]["primary_recall_k"], p.config["baselines"]
    queries = _subset(p, "validation")
    share = lambda ranked: metrics.recall_at(metrics.target_ranks(queries, ranked), [k]).first()[f"recall_{k}"]
    record: dict = {"k": k, "examples": queries.count()}
    for h in b["popularity_half_lives_days"]:
        record[f"popularity_{h}d"] = share(popularity.first_unseen(queries, d.popularity_of(h), k))
    record["item_cf"] = share(item_cf.top_k(queries, d.edges, k, decay=b["item_cf_recency_decay"], history_size=b["item_cf_history_size"], pairs=d.pairs))
    return writers.write_json(record, p.artifact("evaluation", "validation-baselines.json"))


def evaluate_candidate_union(p: Project, *, retriever: str = "retriever-history-only") -> Path:
    queries = _subset(p, "validation")
    if queries.isEmpty():
        raise ValueError("there are no examples to evaluate")
    model, index, users = load_retriever(p, retriever)
    lists, _ = training.listed_queries(queries, p.dataset.train, model, index, p.dataset, users)
    told = candidates.coverage_of_lists(lists).first().asDict()
    return writers.write_json(told, p.artifact("evaluation", "validation-candidate-union.json"))


def generate_ranker_data(p: Project) -> Path:
    rows, folds = training.cross_fitted_rows(p.dataset)
    for i in (1, 2, 3):
        writers.write_table(rows.where(F.col("fold") == i), p.artifact("ranker-crossfit", f"fold-{i}.parquet"))
    return writers.write_json({"folds": folds}, p.artifact("ranker-crossfit", "manifest.json"))


def train_ranker(p: Project) -> Path:
    manifest = p.artifact("ranker-crossfit", "manifest.json")
    readers.require(manifest)
    rows = readers.read_folds(p.spark, [p.artifact("ranker-crossfit", f"fold-{i}.parquet") for i in (1, 2, 3)])
    model, told = ranker.select_and_refit(rows, p.config["ranking"])
    path = Path(p.artifact("ranker", "model.npz"))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(model.dump())
    writers.write_json(model.importances(), p.artifact("ranker", "feature-importances.json"))
    return writers.write_json(told | {"learning_rate": p.config["ranking"]["learning_rate"]}, p.artifact("ranker", "training-result.json"))


def load_ranker(p: Project) -> ranker.LambdaMart:
    path = p.artifact("ranker", "model.npz")
    readers.require(path)
    return ranker.LambdaMart.load(Path(path).read_bytes())


def evaluate(p: Project) -> Path:
    """The frozen replay: every test target, misses at zero, paired intervals of the lift over each baseline."""
    d, e = p.dataset, p.config["evaluation"]
    model, index, users = load_retriever(p)
    scorer = load_ranker(p)
    queries = d.queries("test")
    if queries.isEmpty():
        raise ValueError("there are no test targets")
    per_query, _ = training.replay_with(d, queries, model, index, scorer, users)
    lifts = per_query.withColumns({f"lift_over_{s}": F.col("system_ndcg") - F.col(f"{s}_ndcg") for s in ("popularity", "cf")})
    names = ["system_ndcg", "lift_over_popularity", "lift_over_cf"]
    intervals = {r["series"]: [r["mean"], r["low"], r["high"]] for r in metrics.bootstrap_intervals(lifts, names, resamples=e["bootstrap_resamples"], level=e["bootstrap_confidence_level"], seed=p.config["project"]["seed"] + 4).collect()}
    means = per_query.agg(F.count("*").alias("examples"), *(F.avg(c).alias(c) for c in per_query.columns if c != "query_id")).first().asDict()
    return writers.write_json(means | {"intervals": intervals}, p.artifact("evaluation", "test-replay.json"))


def benchmark(p: Project) -> Path:
    """Wall-clock of single requests on one worker, stage by stage; index building and warm-up aren't timed."""
    d, b, r, seed = p.dataset, p.config["benchmark"], p.config["retrieval"], p.config["project"]["seed"]
    model, index, users = load_retriever(p)
    scorer, count, warm = load_ranker(p), b["query_count"], b["warmup_queries"]
    fold = p.artifact("ranker-crossfit", "fold-3.parquet")
    readers.require(fold)
    queries = sampling.fixed_subset(d.queries("test"), "query_id", count + warm, seed + 5)
    rows = two_tower.encoded(queries, index, p.config["split"]["replay_history_size"], users).orderBy("query_id").collect()
    if len(rows) < count + warm:
        raise ValueError(f"{count + warm} test examples are needed, there are {len(rows)}")
    rows = [x.asDict() | {"user": x.asDict().get("user")} for x in rows]
    sets = serving.ranker_inputs(p.spark.read.parquet(fold), count, seed + 6)
    told = serving.benchmark(model, rows, sets, scorer, warm=warm, k=r["candidate_count"], m=r["hnsw_m"], ef=r["hnsw_ef_search"])
    return writers.write_json(told, p.artifact("benchmarks", "latency.json"))


def recommend(p: Project, user_id: str) -> list:
    """The next products for one user from all they did so far: popular ones and those like their history."""
    d, n, b = p.dataset, p.config["ranking"]["output_count"], p.config["baselines"]
    seen = sequences.user_sequences(sequences.visible_events(d.interactions, "test")).where(F.col("user_id").cast("string") == str(user_id)).first()
    items = list(seen["items"]) if seen else []
    found = item_cf.recommend_cf(d.edges, items, items, n, decay=b["item_cf_recency_decay"], history_size=b["item_cf_history_size"]) if items else []
    return found or popularity.recommend_popular(d.popularity, items, n)


def told(result) -> str:
    return json.dumps(result if isinstance(result, list) else str(result))
