"""The prepared dataset of a star schema and the retrieval stages over it, each made once a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.config import DEFAULTS
from chronofold.functions.time import micros
from chronofold.functions.vectors import dot
from chronofold.operators import candidates, dense, item_cf, popularity, prepare, sequences, shipping
from chronofold.operators.candidates import SOURCES
from chronofold.session import cut_lineage, sweep
from chronofold.sources import readers

K = 50
_MADE: dict[tuple[str, str], "Dataset"] = {}


class Dataset:
    """Stages as properties; what several queries read is checkpointed when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: dict | None = None) -> None:
        self.spark, self.sf_dir, self.config = spark, sf_dir, config or DEFAULTS
        self._queries: dict[str, DataFrame] = {}
        self._made: dict[tuple[str, str], Callable[[DataFrame], DataFrame] | tuple] = {}

    @property
    def candidates(self) -> int:
        """Candidates that each source gives a query."""
        return self.config["retrieval"]["candidate_count"]

    @classmethod
    def forget(cls) -> None:
        """Make the next query start anew, from the tables."""
        _MADE.clear()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Dataset":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _MADE:
            _MADE[key] = cls(spark, sf_dir)
        return _MADE[key]

    @cached_property
    def raw(self) -> DataFrame:
        return readers.star_events(self.spark, self.sf_dir)

    @cached_property
    def windowed(self) -> DataFrame:
        return prepare.recent(self.raw, self.config["data"]["recent_window_months"])

    @cached_property
    def canonical(self) -> DataFrame:
        held = cut_lineage(prepare.latest_per_pair(self.windowed))
        sweep(self.spark)
        return held

    @cached_property
    def boundaries(self) -> prepare.Boundaries:
        split = self.config["split"]
        return prepare.quantile_boundaries(self.canonical, split["validation_fraction"], split["test_fraction"])

    @cached_property
    def labelled(self) -> DataFrame:
        return prepare.label_split(self.canonical, self.boundaries)

    @cached_property
    def core(self) -> DataFrame:
        return cut_lineage(prepare.between(self.labelled.where("split = 'train'"), *self.core_ids))

    @cached_property
    def core_ids(self) -> tuple[DataFrame, DataFrame]:
        """The users and the items of the training period's k-core."""
        return prepare.core_ids(self.labelled.where("split = 'train'"), self.config["data"]["min_train_interactions"])

    @cached_property
    def interactions(self) -> DataFrame:
        """The canonical events with split and flags. From here on the canonical events are read from it, not held twice; the split follows from the time."""
        rows = prepare.flagged(self.labelled, *self.core_ids)
        columns, canonical = rows.columns, self.canonical.columns
        held = cut_lineage(rows.drop("split"))
        del rows
        for name in ("labelled", "windowed", "raw"):
            self.__dict__.pop(name, None)
        self.__dict__["canonical"] = held.select(*canonical)
        sweep(self.spark)
        return prepare.label_split(held, self.boundaries).select(*columns)

    @cached_property
    def items(self) -> DataFrame:
        return prepare.item_catalog(readers.star_items(self.spark, self.sf_dir), self.interactions)

    @cached_property
    def train(self) -> DataFrame:
        return prepare.warm_events(self.interactions, "train")

    @cached_property
    def edges(self) -> DataFrame:
        held = cut_lineage(item_cf.fit_edges(self.train))
        sweep(self.spark)
        return held

    @cached_property
    def pairs(self) -> DataFrame:
        return cut_lineage(item_cf.cosine_pairs(self.edges))

    def popularity_of(self, half_life_days: int) -> DataFrame:
        return cut_lineage(popularity.fit_popularity(self.train, half_life_days))

    @cached_property
    def popularity(self) -> DataFrame:
        return self.popularity_of(self.config["baselines"]["popularity_half_life_days"])

    @cached_property
    def vectors(self) -> DataFrame:
        """item_id, vector: the embedding whose id is the item's modulo their number."""
        table = readers.table(self.spark, self.sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        n = table.count()
        return cut_lineage(self.train.select("item_id").distinct().join(table, F.pmod("item_id", F.lit(n)) == F.col("vec_id")).select("item_id", "vector"))

    def queries(self, split: str) -> DataFrame:
        """query_id, user_id, item_id (target), event_ts, prior_count, history, seen."""
        if split not in self._queries:
            s = self.config["split"]
            rows = sequences.sequence_examples(self.interactions, split, s["replay_history_size"], s["min_prior_interactions"])
            self._queries[split] = cut_lineage(rows.withColumn("query_id", F.concat_ws(":", "user_id", "item_id")))
            del rows
            sweep(self.spark)
        return self._queries[split]

    @cached_property
    def embeddings(self) -> DataFrame:
        """code, vector: an item's code is its id modulo their number."""
        return readers.table(self.spark, self.sf_dir, "embeddings").select(F.col("vec_id").alias("code"), F.col("embedding").cast("array<double>").alias("vector"))

    @cached_property
    def catalogue(self):
        """A broadcast of the training items' codes and the vectors they have, or None if these are too many for a worker."""
        n = self.embeddings.count()
        return dense.catalogue(self.train.select("item_id").distinct().select("item_id", F.pmod("item_id", F.lit(n)).alias("code")), self.embeddings)

    def with_lists(self, split: str, sources: tuple[str, ...] = SOURCES, k: int = K) -> DataFrame:
        """queries(split) with each source's list as two arrays (its items and their scores), made in one pass without a shuffle of queries."""
        rows, passes = self.queries(split), []
        for s in sources:
            key = (f"with_{s}", f"{split}/{k}")
            if key not in self._made:
                self._made[key] = self._adder(s, split, k)
            made = self._made[key]
            if isinstance(made, tuple):
                passes.append(made)
            else:
                rows = made(rows)
        return shipping.through(rows, passes) if passes else rows

    def _adder(self, source: str, split: str, k: int):
        """A pass of a worker over queries (see shipping.through), or a function of the queries' table."""
        b, h = self.config["baselines"], self.config["split"]["replay_history_size"]
        if source == "popularity":
            return lambda rows: popularity.lists(rows, self.popularity, k)
        if source == "cf":
            shared, more = item_cf.shipped(self.edges), {"decay": b["item_cf_recency_decay"], "history_size": b["item_cf_history_size"]}
            if shared is not None:
                return item_cf.listing(shared, self.edges.schema["item_id"].dataType, k, **more)
            listed = item_cf.top_k(self.queries(split), self.edges, k, pairs=self.pairs, **more)
        elif self.catalogue is not None:
            return dense.listing(self.catalogue, self.train.schema["item_id"].dataType, k, decay=self.config["retrieval"]["history_recency_decay"], history_size=h)
        else:
            queries = self.queries(split)
            listed = dense.exact_top_k(self.query_vectors(split).join(queries.select("query_id", "seen"), "query_id"), self.vectors, k)
        held = cut_lineage(candidates.listed(listed, source))
        return lambda rows: candidates.beside(rows, held, source)

    def list_of(self, source: str, split: str, k: int = K) -> DataFrame:
        """query_id, item_id, score, rank from one source."""
        return item_cf.unlisted(self.with_lists(split, (source,), k), source)

    def target_ranks(self, source: str, split: str, k: int = K) -> DataFrame:
        """query_id and the rank of its target in the source's list, null where missed."""
        return self.with_lists(split, (source,), k).select("query_id", candidates.place_of(source, F.col("item_id")).alias("rank"))

    def query_vectors(self, split: str) -> DataFrame:
        more = {"decay": self.config["retrieval"]["history_recency_decay"], "history_size": self.config["split"]["replay_history_size"]}
        if self.catalogue is not None:
            return dense.pooled_by(self.catalogue, self.queries(split), **more)
        return dense.pooled_queries(self.queries(split), self.vectors, **more)

    def target_scores(self, split: str) -> DataFrame:
        """query_id and the inner product of its vector and its target's."""
        more = {"decay": self.config["retrieval"]["history_recency_decay"], "history_size": self.config["split"]["replay_history_size"]}
        if self.catalogue is not None:
            return dense.target_scores(self.catalogue, self.queries(split), **more)
        targets = self.queries(split).select("query_id", "item_id").join(self.vectors.withColumnRenamed("vector", "target"), "item_id")
        return self.query_vectors(split).join(targets, "query_id").select("query_id", dot(F.col("vector"), F.col("target")).alias("score"))

    def union(self, split: str, k: int = K) -> DataFrame:
        return candidates.merge_lists(self.with_lists(split, k=k))

    def features(self, split: str, k: int = K) -> DataFrame:
        return candidates.features_of_lists(self.with_lists(split, k=k), self.items, self.popularity)

    @cached_property
    def fold_starts(self) -> list[float]:
        """Starts of three folds over the training period and the end of the last, in microseconds."""
        us = self.labelled.where("split = 'train'").select(micros(F.col("event_ts")).alias("us"))
        return [*prepare.exact_quantiles(us, "us", [0.25, 0.5, 0.75]), us.agg(F.max("us")).first()[0] + 1000.0]

    @cached_property
    def fold_cores(self) -> DataFrame:
        """fold and the k-core of what came before it, for all three folds in one fixpoint."""
        us, train = micros(F.col("event_ts")), self.labelled.where("split = 'train'")
        later = F.filter(F.array(*(F.when(us < F.lit(start), F.lit(i + 1)) for i, start in enumerate(self.fold_starts[:3]))), lambda x: x.isNotNull())
        return prepare.k_core(train.withColumn("fold", F.explode(later)), self.config["data"]["min_train_interactions"], by=("fold",))

    @cached_property
    def fold_targets(self) -> DataFrame:
        """fold and its events between its core's users and items."""
        us, train = micros(F.col("event_ts")), self.labelled.where("split = 'train'")
        number = F.when(us < F.lit(self.fold_starts[0]), None)
        for i in range(3):
            number = number.when(us < F.lit(self.fold_starts[i + 1]), F.lit(i + 1))
        targets = train.withColumn("fold", number).where("fold IS NOT NULL")
        for c in ("user_id", "item_id"):
            targets = targets.join(self.fold_cores.select("fold", c).distinct(), ["fold", c], "left_semi")
        return cut_lineage(targets.select(*self.fold_cores.columns))

    @cached_property
    def fold_examples(self) -> DataFrame:
        """fold and its examples, whose histories hold all strictly earlier events of core and fold."""
        s = self.config["split"]
        events = self.fold_cores.withColumn("split", F.lit("train")).unionByName(self.fold_targets.withColumn("split", F.lit("validation")))
        rows = sequences.examples(events, "validation", s["replay_history_size"], s["min_prior_interactions"], by=("fold",))
        return cut_lineage(rows.withColumn("query_id", F.concat_ws(":", "user_id", "item_id")))

    def fold(self, number: int) -> tuple[DataFrame, DataFrame]:
        """The k-core of what came before fold ``number``, and the fold's events between that core's users and items."""
        if not 1 <= number <= 3:
            raise ValueError("there are folds 1 to 3")
        return tuple(x.where(F.col("fold") == number).drop("fold") for x in (self.fold_cores, self.fold_targets))

    def fold_queries(self, number: int) -> tuple[DataFrame, DataFrame]:
        """The core, and the fold's examples."""
        return self.fold(number)[0], self.fold_examples.where(F.col("fold") == number).drop("fold")


class FileDataset(Dataset):
    """The same stages over prepared interactions and items that were written before.

    ``fitted`` gives the table of an artifact that still holds, by its parts, or None: then the stage is made anew.
    """

    def __init__(self, spark: SparkSession, interactions: str, items: str, config: dict, fitted=lambda *parts: None) -> None:
        super().__init__(spark, interactions, config)
        self.paths, self.fitted = (interactions, items), fitted

    @cached_property
    def interactions(self) -> DataFrame:
        return self.spark.read.parquet(self.paths[0])

    @cached_property
    def items(self) -> DataFrame:
        return self.spark.read.parquet(self.paths[1])

    @cached_property
    def labelled(self) -> DataFrame:
        return self.interactions.drop("is_warm_user", "is_warm_item")

    @cached_property
    def edges(self) -> DataFrame:
        held = self.fitted("baselines", "item-cf.parquet")
        return held if held is not None else cut_lineage(item_cf.fit_edges(self.train))

    def popularity_of(self, half_life_days: int) -> DataFrame:
        held = self.fitted("baselines", f"popularity-{half_life_days}d.parquet")
        return held if held is not None else super().popularity_of(half_life_days)

    def queries(self, split: str) -> DataFrame:
        held = self.fitted("sequences", f"{split}.parquet")
        return held if held is not None else super().queries(split)
