"""Secret scans with multipart credential linking, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import cut, read, spread_join

#: kind: (pattern, group whose length counts, least length). The order of kinds breaks ties of spans that start together.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Parts that say nothing alone: a long mixed token and the address of a service.
WEAK = {
    "key": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    "endpoint": (r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
#: kind of a weak part: kinds that complete it.
COMPLETES = {"key": ("access", "endpoint"), "endpoint": ("access", "assign", "key")}
#: Code points between parts of one credential at most.
SCOPE = 256
_KINDS = [*BASE, *WEAK]


def _matches(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches: code points before each (since the last one), its own, and if it is long enough."""
    pattern, group, least = (BASE | WEAK)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    told = lambda m: F.regexp_extract(m, pattern, group) if group else m
    each = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("length"), (F.char_length(told(m)) >= least).alias("ok")))
    return F.when(text.rlike(pattern), each)


def find_parts(texts: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end) of all parts, base and weak, in distinct texts (k1, k2, text)."""
    from pyspark.sql import Window

    matched = texts.select("k1", "k2", F.filter(F.array(*(_matches(F.col("text"), k) for k in _KINDS)), lambda x: x.isNotNull()).alias("m"))
    narrow = cut(matched.where(F.size("m") > 0).dropDuplicates(["k1", "k2"]))
    rows = narrow.select("k1", "k2", F.explode(F.flatten("m")).alias("m")).select("k1", "k2", "m.*")
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return rows.withColumn("end", end).where("ok").select("k1", "k2", "kind", (F.col("end") - F.col("length")).cast("long").alias("start"), "end")


def link(parts: DataFrame) -> DataFrame:
    """The weak parts with a complementary part of the same text within SCOPE and no base part in their own place.

    An interval join: scopes and parts are cut into bins of SCOPE code points and meet by text and bin. A bin
    holds as many parts as fit into it, so what meets there is bounded whatever the text or the corpus.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    weak = parts.where(F.col("kind").isin(*WEAK)).withColumn("bin", bins(F.col("start") - SCOPE, F.col("end") + SCOPE))
    other = parts.select("k1", "k2", F.col("kind").alias("okind"), F.col("start").alias("ostart"), F.col("end").alias("oend"), bins(F.col("start"), F.col("end") - 1).alias("bin"))
    near = (F.col("ostart") < F.col("end") + SCOPE) & (F.col("oend") > F.col("start") - SCOPE)
    apart = (F.col("ostart") >= F.col("end")) | (F.col("oend") <= F.col("start"))
    completes = F.lit(False)
    for kind, kinds in COMPLETES.items():
        completes = completes | ((F.col("kind") == kind) & F.col("okind").isin(*kinds))
    return (
        weak.join(other, ["k1", "k2", "bin"])
        .where(near)
        .groupBy("k1", "k2", "kind", "start", "end")
        .agg(F.max(completes & apart).alias("linked"), F.max(F.col("okind").isin(*BASE) & ~apart).alias("known"))
        .where("linked AND NOT known")
        .select("k1", "k2", "kind", "start", "end")
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of ``docs``.

    Base spans are found by themselves; weak ones are added where they complete a credential. Equal texts are
    scanned for links once, by a 128-bit key of the text. Null text: empty. Repeated rows: a result each. An
    empty table gives no rows. No match crosses a line, and no part of the text is left out at any length. Columns
    but doc_id and text are not read, so their names can't clash. A text that a third of all rows hold is scanned
    in each map task that has it, and its rows meet its result by a broadcast.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    parts = cut(find_parts(keyed.select("k1", "k2", "text")))
    spans = parts.where(F.col("kind").isin(*BASE)).unionByName(link(parts))
    order = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind")).alias("o")
    each = F.struct("start", order, "end", "kind")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    by_text = (
        spans.groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list(each)).alias("s"))
        .select("k1", "k2", told(F.filter("s", lambda x: x["kind"].isin(*BASE))).alias("base"), told(F.col("s")).alias("spans"), *(F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE))
    )
    rows = spread_join(cut(keyed.select("doc_id", "k1", "k2")), cut(by_text), ["k1", "k2"])
    return rows.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql_pattern(kind: str) -> str:
    """The same pattern for an engine that folds more letters than A-Z: both cases spelled out."""
    import re

    pattern = (BASE | WEAK)[kind][0]
    spelled = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)
    return spelled.replace("'", "''")


def _sql() -> str:
    found = []
    for o, kind in enumerate(_KINDS):
        _, group, least = (BASE | WEAK)[kind]
        p = _sql_pattern(kind)
        value = f"regexp_extract(m, '{p}', {group})" if group else "m"
        found.append(f"""
  SELECT row, '{kind}' AS kind, {o} AS o, length(m) AS n, length({value}) >= {least} AS ok, sum(length(g) + length(m)) OVER (PARTITION BY row ORDER BY i) AS e FROM (
    SELECT row, i, ms[i + 1] AS m, gs[i + 1] AS g FROM (SELECT row, ms, gs, unnest(range(len(ms))) AS i FROM (SELECT row, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}'))))""")
    completes = " OR ".join(f"(w.kind = '{k}' AND x.kind IN ({', '.join(map(repr, v))}))" for k, v in COMPLETES.items())
    base = ", ".join(map(repr, BASE))
    told = lambda which: f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e){which}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED (SELECT row, kind, o, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({" UNION ALL ".join(found)}) WHERE ok),
near AS (SELECT w.row, w.kind, w.o, w.s, w.e, bool_or(({completes}) AND (x.s >= w.e OR x.e <= w.s)) AS linked, bool_or(x.kind IN ({base}) AND x.s < w.e AND x.e > w.s) AS known
  FROM p w JOIN p x ON w.row = x.row AND x.s < w.e + {SCOPE} AND x.e > w.s - {SCOPE} WHERE w.kind NOT IN ({base}) GROUP BY ALL),
a AS (SELECT * FROM p WHERE kind IN ({base}) UNION ALL SELECT row, kind, o, s, e FROM near WHERE linked AND NOT known),
r AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {told(f" FILTER (kind IN ({base}))")} AS base, {told("")} AS spans FROM a GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (row)
"""


SQL = _sql()
