"""Per-(candidate, source) anomaly state: EWMA baseline, significance, momentum.

The baseline advances only on days with an observation. Three forms share the
same definitions: the backfill scan over a whole history, the incremental step
that joins yesterday's state, and the stateful stream.

A day maps the baseline (m, v) to (a m + b, a v + p m^2 + q m + r), with
a = 1 - alpha, b = alpha x, p = a alpha, q = -2 p x and r = p x^2. Maps of this form
compose, so a history is a prefix composition: within blocks of days by doubling lags,
across blocks on one row per block, and the blocks' baselines joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from swellcast.dims import AlgorithmConfig
from swellcast.functions import numeric as N

KEYS = ("candidate_id", "source_id")
STATE_COLUMNS = ("m", "v", "n", "s1", "s2", "last_date")
#: Coefficients of a baseline map, and those of the map that changes nothing.
MAP = {"_a": 1.0, "_b": 0.0, "_p": 0.0, "_q": 0.0, "_r": 0.0}
#: Days of a block.
BLOCK_DAYS = 64


def _step(state: Column, obs: Column, cfg: AlgorithmConfig) -> Column:
    """State struct after one observation, carrying that day's outputs along."""
    x = F.least(obs["signal"], F.lit(cfg.max_x_clip))
    m, v, n, alpha = state["m"], state["v"], state["n"], obs["alpha"]
    keep = F.lit(1.0) - alpha
    sig = F.when(n + 1 <= obs["warmup"], F.lit(0.0)).otherwise(
        N.significance(x, m, v, cfg.beta)
    )
    missing = obs["signal"].isNull()
    hold = lambda old, new: F.when(missing, old).otherwise(new)
    return F.struct(
        hold(m, keep * m + alpha * x).alias("m"),
        hold(v, keep * (v + alpha * (x - m) * (x - m))).alias("v"),
        hold(n, n + 1).alias("n"),
        hold(state["s1"], sig).alias("s1"),
        hold(state["s2"], state["s1"]).alias("s2"),
        hold(state["s3"], state["s2"]).alias("s3"),
    )


def _day_map(signal: Column, alpha: Column, cfg: AlgorithmConfig) -> dict[str, Column]:
    """The baseline map of one observation; a missing one changes nothing."""
    x, keep = F.least(signal, F.lit(cfg.max_x_clip)), F.lit(1.0) - alpha
    p = keep * alpha
    made = {"_a": keep, "_b": alpha * x, "_p": p, "_q": p * x * -2, "_r": p * x * x}
    return {c: F.when(signal.isNull(), F.lit(MAP[c])).otherwise(e) for c, e in made.items()}


def _composed(df: DataFrame, window: WindowSpec, rows: int, within: str | None = None) -> DataFrame:
    """Each row's map after those of the up to ``rows - 1`` rows before it; ``within`` names a column that must agree."""
    df = df.withColumn("_map", F.struct(*MAP, *([within] if within else [])))
    step = 1
    while step < rows:
        df = df.withColumn("_past", F.lag("_map", step).over(window))
        agree = F.col("_past").isNotNull() if within is None else F.col(f"_past.{within}") == F.col(within)
        a, b, p, q, r = (F.when(agree, F.col(f"_past.{c}")).otherwise(F.lit(v)) for c, v in MAP.items())
        made = {
            "_a": F.col("_map._a") * a,
            "_b": F.col("_map._a") * b + F.col("_map._b"),
            "_p": F.col("_map._a") * p + F.col("_map._p") * a * a,
            "_q": F.col("_map._a") * q + F.col("_map._p") * a * b * 2 + F.col("_map._q") * a,
            "_r": F.col("_map._a") * r + F.col("_map._p") * b * b + F.col("_map._q") * b + F.col("_map._r"),
        }
        df = df.withColumn("_map", F.struct(*[e.alias(c) for c, e in made.items()], *([within] if within else [])))
        step *= 2
    return df.select(*[c for c in df.columns if c not in (*MAP, "_map", "_past")], *[F.col(f"_map.{c}").alias(c) for c in MAP])


def _mapped(m: Column, v: Column) -> tuple[Column, Column]:
    """The baseline (m, v) after the row's map."""
    return F.col("_a") * m + F.col("_b"), F.col("_a") * v + F.col("_p") * m * m + F.col("_q") * m + F.col("_r")


def fold_history(daily: DataFrame, cfg: AlgorithmConfig | None = None, state: DataFrame | None = None) -> DataFrame:
    """Replay the whole series of every (candidate, source) and return one row per day.

    ``daily`` holds one row per (date, candidate, source) with ``signal`` and
    ``family_primary``; ``state`` the baselines to start from (see :func:`advance_state`), all older
    than ``daily``. Work is linear in the rows; no array holds a history. A series has at
    most one entry per calendar day, which bounds a window's rows whatever the raw volume of the pair.
    ``daily`` is read three times, first for the days it spans, which set the number of doublings: give
    a stored table.
    """
    cfg = cfg or AlgorithmConfig()
    span = daily.agg(F.datediff(F.max("date"), F.min("date"))).first()[0] or 0
    passthrough = [c for c in daily.columns if c not in (*KEYS, "date")]
    by_day = Window.partitionBy(*KEYS).orderBy("date")
    alpha = N.family_alpha(F.col("family_primary"), cfg)
    block = F.floor(F.datediff("date", F.lit("1970-01-01")) / BLOCK_DAYS)
    slim = daily.select(
        *KEYS, "date", "signal", N.family_warmup(F.col("family_primary"), cfg).alias("_warmup"), block.alias("_block"),
        F.struct(*passthrough).alias("_row"), *[e.alias(c) for c, e in _day_map(F.col("signal"), alpha, cfg).items()])
    inside = _composed(slim, by_day, min(BLOCK_DAYS, span + 1), within="_block")

    # One row per block: its whole map, then the maps of all blocks before it, from where the history starts.
    totals = inside.groupBy(*KEYS, "_block").agg(*[F.max_by(c, "date").alias(c) for c in MAP])
    by_block = Window.partitionBy(*KEYS).orderBy("_block")
    carried = _composed(totals, by_block, span // BLOCK_DAYS + 2)
    carried = carried.select(*KEYS, "_block", *[F.coalesce(F.lag(c).over(by_block), F.lit(v)).alias(c) for c, v in MAP.items()])
    held = ("m", "v", "n", "s1", "s2")
    if state is None:
        carried = carried.select("*", *[F.lit(0.0).alias(f"_{c}1") for c in held])
    else:
        begin = state.select(*KEYS, *[F.col(c).cast("double").alias(f"_{c}1") for c in held])
        carried = carried.join(begin, list(KEYS), "left").fillna(0.0, [f"_{c}1" for c in held])
    m0, v0 = _mapped(F.col("_m1"), F.col("_v1"))
    carried = carried.select(*KEYS, "_block", m0.alias("_m0"), v0.alias("_v0"), *[f"_{c}1" for c in held])

    m, v = _mapped(F.col("_m0"), F.col("_v0"))
    states = inside.join(carried, [*KEYS, "_block"]).select(
        *KEYS, "date", "signal", "_warmup", "_row", *[f"_{c}1" for c in held], m.alias("m"), v.alias("v"),
        (F.count("signal").over(by_day) + F.col("_n1").cast("long")).alias("n"))
    before = lambda c: F.coalesce(F.lag(c).over(by_day), F.col(f"_{c}1"))
    x = F.least(F.col("signal"), F.lit(cfg.max_x_clip))
    states = states.select("*", before("m").alias("_m"), before("v").alias("_v"))
    found = F.when(F.col("n") <= F.col("_warmup"), F.lit(0.0)).otherwise(N.significance(x, F.col("_m"), F.col("_v"), cfg.beta))
    # The last three significances of observed days; a day without a signal keeps those of the day before.
    observed = Window.partitionBy(*KEYS, F.col("signal").isNull()).orderBy("date")
    states = states.withColumn("_s", found)
    one, two = F.lag("_s").over(observed), F.lag("_s", 2).over(observed)
    states = states.withColumn("_sigs", F.when(F.col("signal").isNotNull(), F.struct(
        F.col("_s").alias("s1"), F.coalesce(one, "_s11").alias("s2"),
        F.coalesce(two, F.when(one.isNull(), F.col("_s21")).otherwise(F.col("_s11"))).alias("s3"))))
    states = states.withColumn("_sigs", F.coalesce(
        F.last("_sigs", ignorenulls=True).over(by_day), F.struct(F.col("_s11").alias("s1"), F.col("_s21").alias("s2"), F.lit(0.0).alias("s3"))))
    sig = {k: F.col(f"_sigs.{k}") for k in ("s1", "s2", "s3")}
    return states.select(
        *KEYS, "date", *[F.col("_row")[c].alias(c) for c in passthrough], "m", "v", "n",
        sig["s1"].alias("anomaly"), sig["s2"].alias("anomaly_lag1"), sig["s3"].alias("anomaly_lag2"))


def advance_state(
    state: DataFrame | None, daily: DataFrame, cfg: AlgorithmConfig | None = None
) -> DataFrame:
    """One production day: join the previous state and step every observed pair once.

    ``state`` holds the latest row per (candidate, source): m, v, n, s1, s2 (the two
    last significances) and last_date. Returns the same columns as
    :func:`fold_history` for the new day; feed it to :func:`next_state`.
    """
    cfg = cfg or AlgorithmConfig()
    df = daily
    if state is None:
        for c in ("p_m", "p_v", "p_s1", "p_s2"):
            df = df.withColumn(c, F.lit(0.0))
        df = df.withColumn("p_n", F.lit(0).cast("long"))
    else:
        prev = state.select(
            *KEYS, *[F.col(c).alias(f"p_{c}") for c in ("m", "v", "n", "s1", "s2")]
        )
        df = df.join(prev, list(KEYS), "left")
    st = F.struct(
        F.coalesce("p_m", F.lit(0.0)).alias("m"),
        F.coalesce("p_v", F.lit(0.0)).alias("v"),
        F.coalesce(F.col("p_n").cast("long"), F.lit(0).cast("long")).alias("n"),
        F.coalesce("p_s1", F.lit(0.0)).alias("s1"),
        F.coalesce("p_s2", F.lit(0.0)).alias("s2"),
        F.lit(0.0).alias("s3"),
    )
    obs = F.struct(
        F.col("signal"),
        N.family_alpha(F.col("family_primary"), cfg).alias("alpha"),
        N.family_warmup(F.col("family_primary"), cfg).alias("warmup"),
    )
    stepped = df.withColumn("_st", st).withColumn("_obs", obs)
    stepped = stepped.withColumn("_new", _step(F.col("_st"), F.col("_obs"), cfg))
    return stepped.select(
        *daily.columns,
        F.col("_new.m").alias("m"), F.col("_new.v").alias("v"), F.col("_new.n").alias("n"),
        F.col("_new.s1").alias("anomaly"), F.col("_new.s2").alias("anomaly_lag1"),
        F.col("_new.s3").alias("anomaly_lag2"),
    )


def next_state(state: DataFrame | None, stepped: DataFrame) -> DataFrame:
    """Latest state per (candidate, source): today's pairs plus the untouched older ones."""
    new = stepped.select(
        *KEYS, "m", "v", "n", F.col("anomaly").alias("s1"), F.col("anomaly_lag1").alias("s2"),
        F.col("date").alias("last_date"),
    )
    if state is None:
        return new
    untouched = state.join(new.select(*KEYS), list(KEYS), "left_anti")
    return untouched.select(*new.columns).unionByName(new)


def newest(stepped: DataFrame) -> DataFrame:
    """Of every (candidate, source) the row of its last day."""
    row = F.struct(*[c for c in stepped.columns if c not in KEYS])
    return stepped.groupBy(*KEYS).agg(F.max_by(row, "date").alias("_row")).select(*KEYS, "_row.*")


def score_source_rows(
    stepped: DataFrame, cfg: AlgorithmConfig | None = None, posterior_multiplier: Column | None = None
) -> DataFrame:
    """Momentum, surprise and the composite source score of every stepped row."""
    cfg = cfg or AlgorithmConfig()
    mult = F.lit(1.0) if posterior_multiplier is None else posterior_multiplier
    lam = N.family_lambda(F.col("family_primary"), cfg)
    mom = N.momentum(F.col("anomaly"), F.col("anomaly_lag1"), F.col("anomaly_lag2"), lam)
    base = N.normalized_surprise(F.col("anomaly"))
    return (
        stepped.withColumn("momentum_raw", mom)
        .withColumn("surprise_base", base)
        .withColumn(
            "source_score",
            F.least(
                F.lit(1.0),
                (F.col("surprise_base") + F.least(F.lit(0.25), F.col("momentum_raw") * 0.08)) * mult,
            ),
        )
    )
