"""Mentions to (date, candidate, source) features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellcast import dims
from swellcast.dims import AlgorithmConfig
from swellcast.functions import text as T
from swellcast.functions.numeric import by_key
from swellcast.operators import anomaly

GROUP = (
    "date", "candidate_id", "candidate_type", "candidate_kind", "source_id", "source_role",
    "family_primary", "family_secondary", "max_weight_cap",
)
_DOMAIN_RADIX = 8


def _facts(mentions: DataFrame) -> DataFrame:
    """One fact per list-valued detail of a mention; the first one, or an empty one, carries its metrics.

    A country and its rank are one fact. So a mention is hardly more than one row in the shuffles.
    """

    def fact(kind: str, key: Column, rank: Column | None = None, stated: bool = True) -> Column:
        return F.struct(
            F.lit(kind).alias("fact"), key.cast("string").alias("key"),
            (F.lit(None).cast("int") if rank is None else rank.cast("int")).alias("key_rank"),
            F.lit(stated).alias("key_listed"),
        )

    def listed(kind: str, values: Column) -> Column:
        values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v != "")
        return F.transform(values, lambda v: fact(kind, v))

    one = lambda kind, col: listed(kind, F.array(F.coalesce(F.col(col), F.lit(""))))
    ranks = F.coalesce("country_ranks", F.create_map().cast("map<string,int>"))
    countries = F.filter(F.coalesce("countries", F.array().cast("array<string>")), lambda v: v != "")
    ranked_only = F.filter(
        F.map_entries(ranks),
        lambda e: (e["key"] != "") & e["value"].isNotNull() & ~F.array_contains(countries, e["key"]),
    )
    details = F.concat(
        F.transform(countries, lambda c: fact("country", c, ranks[c])),
        F.transform(ranked_only, lambda e: fact("country", e["key"], e["value"], stated=False)),
        one("region", "region"),
        listed("variant", F.col("query_variants")),
        one("cluster", "work_cluster_id"),
        one("surface", "surface"),
    )
    # A first-by-ordinal domain travels as one number, so the aggregate stays hash based.
    pack = lambda d: F.col("ordinal") * _DOMAIN_RADIX + by_key(
        d, {name: i for i, name in enumerate(dims.DOMAINS)}, len(dims.DOMAINS) - 1
    )
    stated = F.col("domain_class") != "OTHER"
    has = lambda c: F.col(c) if c in mentions.columns else None
    inferred = T.classify_domain(
        F.col("candidate_type"), F.col("family_primary"), F.coalesce("name", F.lit("")),
        has("title"), has("publisher"),
    )
    # Before the explode: what is named beside it would be worked out once per fact.
    return mentions.select(
        *GROUP, "metric_value", "confidence_rank", "ordinal", "regional_score",
        "derived_from_work",
        F.when(stated, pack(F.col("domain_class"))).alias("domain_pack"),
        F.when(~stated, pack(inferred)).alias("inferred_pack"),
        F.transform(details, lambda f, i: f.withField("first", i == 0)).alias("_details"),
    ).select("*", F.explode_outer("_details").alias("f")).drop("_details").select(
        "*", F.coalesce("f.first", F.lit(True)).alias("is_metric"), "f.fact", "f.key", "f.key_rank", "f.key_listed"
    ).drop("f")


def aggregate_mentions(mentions: DataFrame) -> DataFrame:
    """Roll catalogued mentions up to one row per (date, candidate, source).

    Two levels: the first collapses every (group, detail) pair with plain numeric
    aggregates, so a hot group shrinks map-side; the second only meets the distinct
    details of a group. The observation ids themselves stay in the observations
    table, reachable by the three key columns; the row carries their count.
    """
    is_metric = F.col("is_metric")
    when_metric = lambda c: F.when(is_metric, F.col(c))
    level1 = _facts(mentions).groupBy(*GROUP, "fact", "key").agg(
        F.sum(when_metric("metric_value")).alias("signal"),
        F.count(when_metric("ordinal")).alias("observation_count"),
        F.max(when_metric("confidence_rank")).alias("confidence_rank"),
        F.min(when_metric("domain_pack")).alias("domain_pack"),
        F.min(when_metric("inferred_pack")).alias("inferred_pack"),
        F.max(when_metric("regional_score")).alias("regional_score"),
        F.max(F.when(is_metric, F.col("derived_from_work").cast("int"))).alias("derived"),
        F.min(when_metric("ordinal")).alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.min("key_rank").alias("key_rank"),
        F.max("key_listed").alias("key_listed"),
    )
    detail = F.struct("fact", "key", "key_rank", "key_listed", "last_ordinal")
    level2 = level1.groupBy(*GROUP).agg(
        F.sum("signal").alias("signal"),
        F.sum("observation_count").alias("observation_count"),
        F.max("confidence_rank").alias("confidence_rank"),
        F.min("domain_pack").alias("domain_pack"),
        F.min("inferred_pack").alias("inferred_pack"),
        F.max("regional_score").alias("regional_score"),
        F.max("derived").alias("derived"),
        F.min("first_ordinal").alias("first_ordinal"),
        F.collect_list(F.when(F.col("fact").isNotNull(), detail)).alias("details"),
    )

    def of(kind: str) -> Column:
        return F.filter("details", lambda d: d["fact"] == kind)

    def keys_of(kind: str) -> Column:
        return F.array_sort(F.transform(F.filter("details", lambda d: (d["fact"] == kind) & d["key_listed"]), lambda d: d["key"]))

    def latest(kind: str) -> Column:
        ranked = F.transform(of(kind), lambda d: F.struct(d["last_ordinal"], d["key"]))
        return F.array_max(ranked)["key"]

    home_first = lambda c: F.concat(
        F.filter(c, lambda v: v == dims.HOME_COUNTRY),
        F.filter(c, lambda v: v != dims.HOME_COUNTRY),
    )
    domains = F.array(*[F.lit(d) for d in dims.DOMAINS])
    level_names = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"))
    return level2.select(
        *GROUP, "signal", "observation_count",
        F.element_at(level_names, (F.col("confidence_rank") + 1).cast("int")).alias("confidence"),
        F.element_at(
            domains,
            (F.coalesce("domain_pack", "inferred_pack") % _DOMAIN_RADIX + 1).cast("int"),
        ).alias("domain_class"),
        "regional_score",
        (F.col("derived") == 1).alias("derived_from_work"),
        "first_ordinal",
        home_first(keys_of("country")).alias("countries"),
        F.map_from_entries(
            F.transform(F.filter(of("country"), lambda d: d["key_rank"].isNotNull()), lambda d: F.struct(d["key"], d["key_rank"]))
        ).alias("country_ranks"),
        keys_of("region").alias("regions"),
        keys_of("variant").alias("query_variants"),
        latest("cluster").alias("work_cluster_id"),
        latest("surface").alias("surface"),
    )


def merge_shared_metadata(mentions: DataFrame, entries: str = "extra") -> DataFrame:
    """Last non-empty value per shared metadata key, as one map per group."""
    rows = mentions.select(
        "date", "candidate_id", "source_id", "ordinal", F.explode(entries).alias("k", "v")
    ).where(F.coalesce(F.col("v"), F.lit("")) != "")
    last = rows.groupBy("date", "candidate_id", "source_id", "k").agg(
        F.max_by("v", "ordinal").alias("v")
    )
    return last.groupBy("date", "candidate_id", "source_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata")
    )


def with_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach role, family and weight cap; unknown sources drop out."""
    dim = catalog.select(
        "source_id", F.col("role").alias("source_role"), "family_primary", "family_secondary",
        "max_weight_cap",
    )
    return df.join(F.broadcast(dim), "source_id")


def finish_features(
    stepped: DataFrame,
    cfg: AlgorithmConfig | None = None,
    weights: DataFrame | None = None,
    posteriors: DataFrame | None = None,
) -> DataFrame:
    """Apply source weights and posteriors to stepped rows.

    ``weights`` (source_id, weight, with a date if they follow the day) and ``posteriors`` (see
    ``learning``) have one row per catalogued source or bucket of it; the runtime picks the joins
    from their measured size.
    """
    cfg = cfg or AlgorithmConfig()
    df = stepped
    if posteriors is None:
        df = (
            df.withColumn("posterior_reliability", F.lit(1.0))
            .withColumn("posterior_lead", F.lit(0.0))
            .withColumn("posterior_persistence", F.lit(0.0))
            .withColumn("posterior_region_fit", F.lit(1.0))
            .withColumn("posterior_multiplier", F.lit(1.0))
        )
    else:
        from swellcast.operators.learning import resolve_posteriors

        df = resolve_posteriors(df, posteriors)
    if weights is None:
        df = df.withColumn("source_weight", F.lit(1.0))
    else:
        on = [c for c in ("date", "source_id") if c in weights.columns]
        df = df.join(weights.select(*on, "weight"), on, "left")
        df = df.withColumn("source_weight", F.coalesce("weight", F.lit(1.0))).drop("weight")
    df = anomaly.score_source_rows(df, cfg, F.col("posterior_multiplier"))
    weighted = (
        F.least(
            F.col("max_weight_cap"),
            F.greatest(F.lit(cfg.source_weight_floor), F.col("source_weight")),
        )
        * F.col("source_score")
    )
    return df.withColumn("surprise01", F.least(F.lit(1.0), weighted)).withColumn(
        "momentum", F.col("surprise01")
    )


def build_source_features(
    mentions: DataFrame,
    catalog: DataFrame,
    cfg: AlgorithmConfig | None = None,
    state: DataFrame | None = None,
    weights: DataFrame | None = None,
    posteriors: DataFrame | None = None,
    backfill: bool = True,
) -> DataFrame:
    """Mentions to source features, replaying history or stepping one day."""
    cfg = cfg or AlgorithmConfig()
    daily = aggregate_mentions(with_catalog(mentions, catalog))
    stepped = (
        anomaly.fold_history(daily, cfg) if backfill else anomaly.advance_state(state, daily, cfg)
    )
    return finish_features(stepped, cfg, weights, posteriors)
