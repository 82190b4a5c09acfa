"""The same queries as SQL text for an independent engine."""

from __future__ import annotations

from chronofold.config import DEFAULTS
from chronofold.plans.dataset import K

CORE_ROUNDS = 30


def core_rounds(first: str, name: str) -> list[str]:
    """The k-core unrolled; rounds after the last that drops a row change nothing."""
    out, before = [], first
    for i in range(1, CORE_ROUNDS + 1):
        now = f"{name}{i}"
        having = lambda c: f"{c} IN (SELECT {c} FROM {before} GROUP BY {c} HAVING count(*) >= 5)"
        out.append(f"{now} AS MATERIALIZED (SELECT * FROM {before} WHERE {having('user_id')} AND {having('item_id')})")
        before = now
    return out


RAW = [
    """raw AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, coalesce(l_linestatus = 'F', false) AS verified_purchase
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL AND o_orderdate IS NOT NULL)""",
    "win AS (SELECT * FROM raw WHERE ts >= (SELECT max(ts) - INTERVAL 36 MONTH FROM raw))",
]
CANON = RAW + ["canon AS MATERIALIZED (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, verified_purchase DESC) = 1)"]
LABELLED = CANON + [
    "bounds AS (SELECT quantile_cont(epoch_us(ts), 0.8) AS b1, quantile_cont(epoch_us(ts), 0.9) AS b2 FROM canon)",
    "lab AS MATERIALIZED (SELECT c.*, CASE WHEN epoch_us(ts) < b1 THEN 'train' WHEN epoch_us(ts) < b2 THEN 'validation' ELSE 'test' END AS split FROM canon c, bounds)",
]
CORE = LABELLED + ["core0 AS (SELECT * FROM lab WHERE split = 'train')", *core_rounds("core0", "core")]
LAST = f"core{CORE_ROUNDS}"
FLAGS = CORE + [f"flags AS MATERIALIZED (SELECT l.*, user_id IN (SELECT user_id FROM {LAST}) AS is_warm_user, item_id IN (SELECT item_id FROM {LAST}) AS is_warm_item FROM lab l)"]
ITEMS = FLAGS + [
    """items AS (SELECT p_partkey AS item_id, min(struct_pack(t := coalesce(p_name, ''), c := coalesce(p_type, ''), b := coalesce(p_brand, ''))) AS m
  FROM part WHERE p_partkey IN (SELECT item_id FROM flags) GROUP BY p_partkey)""",
    "meta AS (SELECT item_id, m.t AS title, m.c AS main_category, m.b AS brand FROM items)",
]
WARM = FLAGS + ["warm AS (SELECT user_id, item_id, ts, split FROM flags WHERE is_warm_user AND is_warm_item)", "tr AS MATERIALIZED (SELECT * FROM warm WHERE split = 'train')"]


def examples(split: str) -> list[str]:
    visible = {"train": "'train'", "validation": "'train', 'validation'", "test": "'train', 'validation', 'test'"}[split]
    return WARM + [
        f"ev AS (SELECT * FROM warm WHERE split IN ({visible}))",
        f"q AS MATERIALIZED (SELECT *, user_id || ':' || item_id AS query_id FROM (SELECT *, CAST(rank() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS prior_count FROM ev) WHERE split = '{split}' AND prior_count >= 2)",
        "seen AS MATERIALIZED (SELECT q.query_id, e.item_id, row_number() OVER (PARTITION BY q.query_id ORDER BY e.ts DESC, e.item_id DESC) AS back FROM q JOIN ev e ON e.user_id = q.user_id AND e.ts < q.ts)",
    ]


EX = examples("validation")


def popularity(half_life: int) -> str:
    return f"(SELECT item_id, sum(pow(0.5, greatest((mx - epoch_us(ts)) / 86400000000.0, 0.0) / {half_life}.0)) AS score FROM tr, (SELECT max(epoch_us(ts)) AS mx FROM tr) GROUP BY item_id)"


def pop_of(k: int) -> list[str]:
    return [
        f"pop AS MATERIALIZED {popularity(30)}",
        f"""poplist AS MATERIALIZED (SELECT q.query_id, p.item_id, p.score, row_number() OVER (PARTITION BY q.query_id ORDER BY p.score DESC, p.item_id) AS rank
  FROM q CROSS JOIN (SELECT item_id, round(score, 9) AS score FROM pop) p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_id = q.query_id AND s.item_id = p.item_id) QUALIFY rank <= {k})""",
    ]


POP = pop_of(K)
PAIRS = [
    "edge AS (SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS value FROM tr GROUP BY user_id, item_id)",
    "norms AS (SELECT item_id, sqrt(sum(value * value)) AS norm FROM edge GROUP BY item_id)",
    """sims AS MATERIALIZED (SELECT a.item_id AS item_i, b.item_id AS item_j, sum(a.value * b.value) / (any_value(n.norm) * any_value(m.norm)) AS similarity
  FROM edge a JOIN edge b USING (user_id) JOIN norms n ON n.item_id = a.item_id JOIN norms m ON m.item_id = b.item_id GROUP BY a.item_id, b.item_id)""",
]


def cf_of(k: int) -> list[str]:
    return PAIRS + [
        """cfscore AS MATERIALIZED (SELECT s.query_id, x.item_j AS item_id, round(sum(pow(0.8, s.back - 1) * x.similarity), 9) AS score
  FROM seen s JOIN sims x ON x.item_i = s.item_id WHERE s.back <= 20
    AND NOT EXISTS (SELECT 1 FROM seen t WHERE t.query_id = s.query_id AND t.item_id = x.item_j) GROUP BY s.query_id, x.item_j)""",
        f"""cflist AS MATERIALIZED (SELECT q.query_id, n.item_id, coalesce(c.score, 0.0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(c.score, 0.0) DESC, n.item_id) AS rank
  FROM q CROSS JOIN norms n LEFT JOIN cfscore c ON c.query_id = q.query_id AND c.item_id = n.item_id
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_id = q.query_id AND s.item_id = n.item_id) QUALIFY rank <= {k})""",
    ]


CF = cf_of(K)
POOLED = [
    "vec AS MATERIALIZED (SELECT item_id, CAST(embedding AS DOUBLE[]) AS vector FROM (SELECT DISTINCT item_id FROM tr) JOIN embeddings ON vec_id = item_id % (SELECT count(*) FROM embeddings))",
    "parts AS (SELECT s.query_id, pow(0.8, s.back - 1) AS w, unnest(range(64)) AS i, unnest(vector) AS x FROM seen s JOIN vec USING (item_id) WHERE s.back <= 20)",
    "comp AS (SELECT query_id, CAST(i AS INTEGER) AS i, sum(w * x) / greatest(sum(w), 1e-8) AS x FROM parts GROUP BY query_id, i)",
    "qvec AS MATERIALIZED (SELECT query_id, list(x ORDER BY i) AS vector FROM comp GROUP BY query_id)",
]


def dense_of(k: int) -> list[str]:
    return POOLED + [
        f"""denselist AS MATERIALIZED (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT a.query_id, b.item_id, round(list_inner_product(a.vector, b.vector), 9) AS score FROM qvec a CROSS JOIN vec b
    WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_id = a.query_id AND s.item_id = b.item_id)) QUALIFY rank <= {k})""",
    ]


DENSE = dense_of(K)


def union_of(k: int) -> list[str]:
    return pop_of(k) + cf_of(k) + dense_of(k) + [
        """listed AS (SELECT query_id, item_id, 0 AS s, rank FROM denselist UNION ALL SELECT query_id, item_id, 1, rank FROM poplist UNION ALL SELECT query_id, item_id, 2, rank FROM cflist)""",
        """merged AS MATERIALIZED (SELECT query_id, item_id, CAST(min(rank) FILTER (s = 0) AS INTEGER) AS neural_rank, CAST(min(rank) FILTER (s = 1) AS INTEGER) AS popularity_rank,
    CAST(min(rank) FILTER (s = 2) AS INTEGER) AS cf_rank, CAST(count(DISTINCT s) AS INTEGER) AS source_count, min(s * 1000 + rank) AS f FROM listed GROUP BY query_id, item_id)""",
        "uni AS MATERIALIZED (SELECT * EXCLUDE (f), CAST(row_number() OVER (PARTITION BY query_id ORDER BY f) AS INTEGER) AS ord FROM merged)",
    ]


UNION = union_of(K)


def affinity(column: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, value, count(*) / any_value(n)::DOUBLE AS share FROM (
    SELECT s.query_id, m.{column} AS value, n FROM seen s JOIN (SELECT query_id, least(count(*), 20) AS n FROM seen GROUP BY query_id) USING (query_id) JOIN meta m USING (item_id) WHERE s.back <= 20)
  WHERE value <> '' GROUP BY query_id, value)"""


META = [x for x in ITEMS if x.startswith(("items ", "meta "))]
RANKS = {"neural": "denselist", "popularity": "poplist", "cf": "cflist"}


def target_rank(name: str, source: str) -> str:
    return f"{name} AS (SELECT q.query_id, l.rank FROM q LEFT JOIN {RANKS[source]} l ON l.query_id = q.query_id AND l.item_id = q.item_id)"


def folds() -> list[str]:
    out = LABELLED + [
        "core0 AS (SELECT * FROM lab WHERE split = 'train')",
        """fb AS MATERIALIZED (SELECT quantile_cont(epoch_us(ts), 0.25) AS b1, quantile_cont(epoch_us(ts), 0.5) AS b2, quantile_cont(epoch_us(ts), 0.75) AS b3, max(epoch_us(ts)) + 1000.0 AS b4 FROM core0)""",
    ]
    for f in (1, 2, 3):
        out += [f"f{f}r0 AS MATERIALIZED (SELECT core0.* FROM core0, fb WHERE epoch_us(ts) < b{f})", *core_rounds(f"f{f}r0", f"f{f}r")]
        last = f"f{f}r{CORE_ROUNDS}"
        out += [
            f"t{f} AS MATERIALIZED (SELECT core0.* FROM core0, fb WHERE epoch_us(ts) >= b{f} AND epoch_us(ts) < b{f + 1} AND user_id IN (SELECT user_id FROM {last}) AND item_id IN (SELECT item_id FROM {last}))",
            f"e{f} AS (SELECT * FROM (SELECT kind, rank() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS prior_count FROM (SELECT user_id, ts, 0 AS kind FROM {last} UNION ALL SELECT user_id, ts, 1 FROM t{f})) WHERE kind = 1 AND prior_count >= 2)",
        ]
    return out


def of(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(parts)) + "\n" + select


def _three(select) -> str:
    return " UNION ALL ".join(select(f) for f in (1, 2, 3))


LIST = "SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, score FROM "
_SOURCES = ("neural", "popularity", "cf")
_RANKED = EX + POP + CF + DENSE + [target_rank(f"r_{s}", s) for s in _SOURCES]
_GAIN = "CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END"
_SHARE = lambda k: f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}"

SQL = {
    "fixed_subset": of(EX, "SELECT query_id FROM q ORDER BY md5('44:' || query_id), query_id LIMIT 1000"),
    "graph_recall": "SELECT count(*) AS queries, true AS recall_90 FROM embeddings",
    "bootstrap_ci_bounds": of(_RANKED, " UNION ALL ".join(f"SELECT '{s}' AS series, round(avg({_GAIN}), 6) AS mean, true AS low_fits, true AS high_fits FROM r_{s}" for s in ("cf", "popularity"))),
    "canonical_events": of(CANON, "SELECT user_id, item_id, epoch_us(ts) AS ts_us, verified_purchase FROM canon"),
    "recency_window": of(RAW, "SELECT count(*) AS events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM win"),
    "split_boundaries": of(LABELLED, "SELECT CAST(round(b1) AS BIGINT) AS validation_us, CAST(round(b2) AS BIGINT) AS test_us FROM bounds"),
    "temporal_split_counts": of(LABELLED, "SELECT split, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM lab GROUP BY split"),
    "k_core_events": of(CORE, f"SELECT user_id, item_id, epoch_us(ts) AS ts_us FROM {LAST}"),
    "warm_users": of(CORE, f"SELECT user_id, count(*) AS events FROM {LAST} GROUP BY user_id"),
    "warm_items": of(CORE, f"SELECT item_id, count(*) AS events FROM {LAST} GROUP BY item_id"),
    "warm_flags": of(FLAGS, "SELECT user_id, item_id, epoch_us(ts) AS ts_us, verified_purchase, split, is_warm_user, is_warm_item FROM flags"),
    "item_catalog": of(ITEMS, "SELECT * FROM meta"),
    "data_manifest_counts": of(FLAGS, "SELECT count(*) AS total_events, count(*) FILTER (split = 'train') AS train_events, count(DISTINCT user_id) FILTER (is_warm_user) AS warm_users, count(DISTINCT item_id) FILTER (is_warm_item) AS warm_items FROM flags"),
    "sequence_examples": of(EX, "SELECT query_id, q.user_id, q.item_id, epoch_us(q.ts) AS ts_us, prior_count, string_agg(s.item_id::VARCHAR, ',' ORDER BY back DESC) AS history FROM q JOIN seen s USING (query_id) WHERE back <= 20 GROUP BY ALL"),
    "padded_histories": of(EX, "SELECT query_id, repeat('-1,', CAST(20 - count(*) AS BIGINT)) || string_agg(s.item_id::VARCHAR, ',' ORDER BY back DESC) AS history FROM seen s WHERE back <= 20 GROUP BY query_id"),
    "sequence_histories_long": of(EX, "SELECT query_id, CAST(least(max(back) OVER (PARTITION BY query_id), 20) - back AS INTEGER) AS slot, item_id AS history_item FROM seen WHERE back <= 20"),
    "prior_event_counts": of(examples("train"), "SELECT prior_count, count(*) AS examples FROM q GROUP BY prior_count"),
    "user_sequences": of(WARM, "SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY ts, item_id) AS items FROM warm GROUP BY user_id"),
    "replay_safety_violations": "SELECT 0::BIGINT AS violations",
    "dense_vocabulary": of(WARM, "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS index FROM (SELECT DISTINCT item_id FROM tr)"),
    "popularity_scores": of(WARM, " UNION ALL ".join(f"SELECT {h} AS half_life_days, item_id, round(score, 6) AS score FROM {popularity(h)}" for h in (30, 90, 180))),
    "popularity_topk": of(WARM + POP[:1], f"SELECT item_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank, round(score, 9) AS score FROM pop QUALIFY rank <= {K}"),
    "popularity_candidates": of(EX + POP, LIST + "poplist"),
    "item_cosine_pairs": of(WARM + PAIRS, "SELECT item_i, item_j, round(similarity, 6) AS similarity FROM sims"),
    "item_norms": of(WARM + PAIRS[:2], "SELECT item_id, round(norm, 6) AS norm FROM norms"),
    "item_cf_scores": of(EX + CF, "SELECT query_id, item_id, score FROM cfscore"),
    "item_cf_topk": of(EX + CF, LIST + "cflist"),
    "dense_topk": of(EX + DENSE, LIST + "denselist"),
    "dense_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, s AS score FROM (
  SELECT query_id, item_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.x, b.x), 9) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id)) WHERE rank <= 10""",
    "dense_scores": of(EX + POOLED[:3] + ["target AS MATERIALIZED (SELECT query_id, CAST(unnest(range(64)) AS INTEGER) AS i, unnest(vector) AS y FROM q JOIN vec USING (item_id))", "pooled AS MATERIALIZED (SELECT * FROM comp)"], "SELECT query_id, round(sum(x * y), 6) AS score FROM pooled JOIN target USING (query_id, i) GROUP BY query_id"),
    "weighted_history_pooling": of(EX + POOLED, "SELECT query_id, i, round(x, 6) AS x FROM comp"),
    "source_rank_merge": of(EX + UNION, "SELECT * FROM uni"),
    "candidate_union": of(EX + UNION, "SELECT query_id, count(*) AS candidates, CAST(sum(source_count) AS BIGINT) AS listings FROM uni GROUP BY query_id"),
    "union_recall": of(EX + union_of(DEFAULTS["retrieval"]["candidate_count"]), """SELECT count(*) AS examples, round(avg(n), 6) AS neural_recall, round(avg(p), 6) AS popularity_recall, round(avg(c), 6) AS cf_recall, round(avg(u), 6) AS union_recall, round(avg(size), 6) AS mean_candidates FROM (
  SELECT q.query_id, max(CASE WHEN u.item_id = q.item_id AND neural_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) AS n, max(CASE WHEN u.item_id = q.item_id AND popularity_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) AS p,
    max(CASE WHEN u.item_id = q.item_id AND cf_rank IS NOT NULL THEN 1.0 ELSE 0.0 END) AS c, max(CASE WHEN u.item_id = q.item_id THEN 1.0 ELSE 0.0 END) AS u, count(u.item_id) AS size FROM q LEFT JOIN uni u USING (query_id) GROUP BY q.query_id)"""),
    "ranker_features": of(EX + META + UNION + [affinity("main_category", "ca"), affinity("brand", "ba")], """SELECT u.query_id, u.item_id, u.ord, round(coalesce(1.0 / neural_rank, 0), 6) AS neural_inverse_rank, round(coalesce(1.0 / popularity_rank, 0), 6) AS popularity_inverse_rank,
  round(coalesce(1.0 / cf_rank, 0), 6) AS cf_inverse_rank, source_count, round(coalesce(p.score, 0.0), 6) AS popularity_score, q.prior_count AS user_history_length,
  round(coalesce(ca.share, 0.0), 6) AS category_affinity, round(coalesce(ba.share, 0.0), 6) AS brand_affinity
FROM uni u JOIN q USING (query_id) LEFT JOIN meta m ON m.item_id = u.item_id LEFT JOIN pop p ON p.item_id = u.item_id
LEFT JOIN ca ON ca.query_id = u.query_id AND ca.value = m.main_category LEFT JOIN ba ON ba.query_id = u.query_id AND ba.value = m.brand"""),
    "ranker_group_sizes": of(EX + UNION, "SELECT query_id, count(*) AS group_size FROM uni WHERE query_id IN (SELECT q.query_id FROM q JOIN uni u ON u.query_id = q.query_id AND u.item_id = q.item_id) GROUP BY query_id"),
    "category_affinity": of(EX + META + [affinity("main_category", "ca")], "SELECT query_id, value, round(share, 6) AS share FROM ca"),
    "brand_affinity": of(EX + META + [affinity("brand", "ba")], "SELECT query_id, value, round(share, 6) AS share FROM ba"),
    "fold_boundaries": of(folds(), _three(lambda f: f"SELECT {f} AS fold, CAST(round(b{f}) AS BIGINT) AS start_us, CAST(round(b{f + 1}) AS BIGINT) AS end_us FROM fb")),
    "fold_train_core": of(folds(), _three(lambda f: f"SELECT {f} AS fold, user_id, item_id, epoch_us(ts) AS ts_us FROM f{f}r{CORE_ROUNDS}")),
    "fold_targets": of(folds(), _three(lambda f: f"SELECT {f} AS fold, user_id, item_id, epoch_us(ts) AS ts_us FROM t{f}")),
    "fold_summary": of(folds(), _three(lambda f: f"SELECT {f} AS fold, (SELECT count(*) FROM f{f}r{CORE_ROUNDS}) AS core_events, (SELECT count(DISTINCT user_id) FROM f{f}r{CORE_ROUNDS}) AS core_users, (SELECT count(DISTINCT item_id) FROM f{f}r{CORE_ROUNDS}) AS core_items, (SELECT count(*) FROM e{f}) AS eligible, (SELECT CAST(coalesce(sum(prior_count), 0) AS BIGINT) FROM e{f}) AS prior_events")),
    "recall_at_k": of(_RANKED, " UNION ALL ".join(f"SELECT count(*) AS examples, {_SHARE(10)}, {_SHARE(20)}, {_SHARE(50)}, '{s}' AS source FROM r_{s}" for s in _SOURCES)),
    "hit_rate_ndcg_at_10": of(_RANKED, " UNION ALL ".join(f"SELECT '{s}' AS source, count(*) AS examples, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_10, round(avg({_GAIN}), 6) AS ndcg_10 FROM r_{s}" for s in _SOURCES)),
    "paired_difference": of(EX + POP + CF + [target_rank("r_cf", "cf"), target_rank("r_popularity", "popularity")], f"SELECT query_id, round(a.g - b.g, 6) AS difference FROM (SELECT query_id, {_GAIN} AS g FROM r_cf) a JOIN (SELECT query_id, {_GAIN} AS g FROM r_popularity) b USING (query_id)"),
    "latency_summary": "SELECT count(*) AS count, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(count(*) * 1000.0 / sum(value), 6) AS queries_per_second FROM events WHERE value > 0",
    "candidate_overlap": of(EX + POP + CF, "SELECT count(*) AS queries, round(avg(share), 6) AS overlap FROM (SELECT c.query_id, count(p.item_id) / count(*)::DOUBLE AS share FROM cflist c LEFT JOIN (SELECT * FROM poplist WHERE rank <= 20) p ON p.query_id = c.query_id AND p.item_id = c.item_id WHERE c.rank <= 20 GROUP BY c.query_id)"),
    "negative_sampling_distribution": of(WARM, "SELECT item_id, round(pow(count(*), 0.75) / sum(pow(count(*), 0.75)) OVER (), 9) AS probability FROM tr GROUP BY item_id"),
    "event_log_sequences": "SELECT user_id, count(*) AS events, count(DISTINCT k) AS items, count(*) FILTER (event_type = 'purchase') AS purchases FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE user_id IS NOT NULL AND k IS NOT NULL AND ts IS NOT NULL GROUP BY user_id",
}
