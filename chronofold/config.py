"""The YAML contract: which sections a configuration must have, and the defaults of each."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path
from typing import Any

SECTIONS = frozenset({"project", "data", "split", "retrieval", "ranking", "tracking"})


class ConfigError(ValueError):
    """A configuration without a section that it needs, or with one that is no mapping."""


# Names and default values of the settings: fixed values.

DEFAULTS: dict[str, dict[str, Any]] = {
    "project": {"name": "chronofold", "seed": 42},
    "data": {
        "source_name": "reviews",
        "recent_window_months": 36,
        "min_train_interactions": 5,
        "raw_reviews_path": "data/raw/reviews.jsonl",
        "raw_metadata_path": "data/raw/items.jsonl",
        "prepared_interactions_path": "data/processed/interactions.parquet",
        "prepared_items_path": "data/processed/items.parquet",
    },
    "split": {"validation_fraction": 0.1, "test_fraction": 0.1, "replay_history_size": 20, "min_prior_interactions": 2},
    "retrieval": {
        "embedding_dim": 128,
        "batch_size": 512,
        "max_epochs": 20,
        "early_stopping_patience": 5,
        "learning_rate": 0.001,
        "weight_decay": 0.0001,
        "temperature": 0.07,
        "history_recency_decay": 0.8,
        "evaluation_batch_size": 128,
        "evaluation_sampled_negatives": 999,
        "full_catalog_evaluation_examples": 1000,
        "sampled_negatives_per_positive": 4,
        "candidate_count": 200,
        "primary_recall_k": 100,
        "hnsw_m": 32,
        "hnsw_ef_search": 128,
    },
    "ranking": {"output_count": 10, "objective": "lambdarank", "temporal_folds": 3, "queries_per_fold": 5000, "n_estimators": 500, "learning_rate": 0.05, "num_leaves": 31, "min_child_samples": 100, "reg_lambda": 1.0, "early_stopping_rounds": 50, "n_jobs": 1},
    "baselines": {"popularity_half_lives_days": [30, 90, 180], "popularity_half_life_days": 30, "item_cf_history_size": 20, "item_cf_recency_decay": 0.8},
    "evaluation": {"bootstrap_resamples": 2000, "bootstrap_confidence_level": 0.95},
    "benchmark": {"query_count": 1000, "warmup_queries": 100},
    "tracking": {"uri": "file:./runs", "experiment_name": "chronofold"},
}


def missing_sections(config: dict[str, Any]) -> set[str]:
    return set(SECTIONS) - set(config)


def load_config(path: str | Path) -> dict[str, Any]:
    """A YAML mapping with all mandatory sections, laid over the defaults."""
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(given, dict):
        raise ConfigError(f"{path} holds no mapping")
    if missing := missing_sections(given):
        raise ConfigError(f"{path} lacks the sections {', '.join(sorted(missing))}")
    if odd := sorted(s for s in given if (s in SECTIONS or s in DEFAULTS) and not isinstance(given[s], Mapping)):
        raise ConfigError(f"in {path} these sections are no mappings: {', '.join(odd)}")
    return merge(given)


def merge(given: dict[str, Any]) -> dict[str, Any]:
    config = copy.deepcopy(DEFAULTS)
    for section, values in given.items():
        config[section] = config.get(section, {}) | dict(values) if isinstance(values, Mapping) else values
    return config
