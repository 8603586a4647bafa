"""Queries of reactions, identity, histories and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import histories as H
from ..operators import labels as L
from ..operators import levels, pit
from . import labels as LB
from .core import CALENDAR, _calendar, rounded, zones_and_state
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def reacted(s, d):
    series, z = LB.zoned(s, d)
    return H.reactions(z, series)


REACTED = LB.ALL | {
    "re": """SELECT security_id, as_of, zone_id, side, min(t_touch) AS t_touch, max((h - entry_) / atr) AS reaction, min(step - t_touch) FILTER (h >= entry_ + 0.5 * atr) AS t_reaction
      FROM en WHERE step >= t_touch GROUP BY ALL""",
}
register("agg_15_reactions", reacted, query("SELECT security_id, as_of, zone_id, side, t_touch, round(reaction, 6) AS reaction, t_reaction FROM re", "zones", extra=REACTED))
register(
    "agg_15_mean_reaction",
    lambda s, d: reacted(s, d).groupBy("security_id", "side").agg(F.count("*").alias("touched"), F.avg("reaction").alias("mean_reaction"), F.avg("t_reaction").alias("mean_steps"), F.avg(F.col("t_reaction").isNotNull().cast("double")).alias("reacted")),
    query("SELECT security_id, side, count(*) AS touched, round(avg(reaction), 6) AS mean_reaction, round(avg(t_reaction), 6) AS mean_steps, round(avg((t_reaction IS NOT NULL)::INT), 6) AS reacted FROM re GROUP BY ALL", "zones", extra=REACTED),
)


def _recall(s, d):
    """Turning points that are confirmed by a whole ATR."""
    series, state, found = zones_and_state(s, d)
    points = levels.swings(series).where("k_atr = 1.0").select("security_id", "t", "side", "level")
    z = found.join(state.select("security_id", "as_of", "k"), ["security_id", "as_of"])
    return H.recall(H.captured(points, z, state.where("atr is not null")), LB.regimes(s, d))


RECALL = LB.ZK | LB.REGIMES | {
    "pb": """SELECT s.security_id, s.t, s.side, s.level, max(d.as_of) AS as_of FROM swings s JOIN state d ON d.security_id = s.security_id AND s.t BETWEEN d.k + 1 AND d.k + 5 AND d.atr IS NOT NULL WHERE k_atr = 1.0 GROUP BY ALL""",
    "ph": """SELECT p.*, EXISTS (SELECT 1 FROM zk z WHERE z.security_id = p.security_id AND p.t BETWEEN z.k + 1 AND z.k + 5 AND (z.side = 'support') = (p.side = 'low')
      AND p.level BETWEEN z.lower - 0.25 * z.atr AND z.upper + 0.25 * z.atr)::INT AS hit FROM pb p""",
}
register(
    "agg_15_recall", _recall,
    query("SELECT security_id, regime, count(*) AS points, sum(hit)::BIGINT AS hits, grouping(security_id, regime) AS coarse, round(avg(hit), 6) AS recall FROM (SELECT p.*, coalesce(r.regime, 'none') AS regime FROM ph p LEFT JOIN reg r USING (as_of)) GROUP BY CUBE (security_id, regime)", "zones", "swings", extra=RECALL),
)


def _chains(s, d):
    found = zones_and_state(s, d)[2]
    return H.chains(found, L.match_zones(found))


CHAINS = {
    "lk": f"SELECT security_id, as_of, zone_id, prior_as_of, prior_zone FROM ({LB.ORACLE['jon_11_zone_identity']})",
    "cw": """SELECT security_id, as_of, zone_id, as_of AS back, zone_id AS back_zone FROM zones
      UNION ALL SELECT c.security_id, c.as_of, c.zone_id, l.prior_as_of, l.prior_zone FROM cw c JOIN lk l ON l.security_id = c.security_id AND l.as_of = c.back AND l.zone_id = c.back_zone""",
    "ch": "SELECT security_id, as_of, zone_id, min(back) AS root_as_of, arg_min(back_zone, back) AS root_zone FROM cw GROUP BY ALL",
}
register("win_21_chains", _chains, query("SELECT security_id, as_of, zone_id, root_as_of, root_zone FROM ch", "zones", extra=CHAINS, once=("lk",)))


def chain_history(s, d):
    series, z = LB.zoned(s, d)
    return H.chain_history(_chains(s, d), L.barrier_labels(z, series), H.reactions(z, series))


_BREAK = "CASE WHEN y_touch = 1 THEN (t_break IS NOT NULL AND y_hold = 0)::INT END"
HISTORY = REACTED | CHAINS | {
    "ev": f"""SELECT c.security_id, c.root_as_of, c.root_zone, c.as_of, CAST(l.available_at AS DATE) AS known, y_touch, y_hold, {_BREAK} AS y_break, r.reaction
      FROM ch c JOIN lbl l USING (security_id, as_of, zone_id) LEFT JOIN re r USING (security_id, as_of, zone_id)""",
    "hi": """SELECT c.security_id, c.as_of, c.zone_id, c.as_of - c.root_as_of AS age, count(e.known) AS weeks, coalesce(sum(y_touch), 0)::BIGINT AS touches, coalesce(sum(y_hold), 0)::BIGINT AS holds,
      coalesce(sum(y_break), 0)::BIGINT AS breaks, min(CASE WHEN y_touch = 1 THEN e.as_of END) AS first_touch, max(CASE WHEN y_touch = 1 THEN e.as_of END) AS last_touch,
      avg(reaction) AS reaction_mean, stddev_pop(reaction) AS reaction_sd
      FROM ch c LEFT JOIN ev e ON e.security_id = c.security_id AND e.root_as_of = c.root_as_of AND e.root_zone = c.root_zone AND e.known <= c.as_of GROUP BY ALL""",
}
register(
    "win_21_chain_history", chain_history,
    query(
        """SELECT security_id, as_of, zone_id, weeks, touches, holds, breaks, round(holds::DOUBLE / nullif(touches, 0), 6) AS hold_ratio, breaks AS flips, age, round(exp(-age / 63), 6) AS decay63,
        round(exp(-age / 252), 6) AS decay252, as_of - last_touch AS last_touch_age, round((last_touch - first_touch) / nullif(touches - 1, 0)::DOUBLE, 6) AS touch_gap, round(reaction_mean, 6) AS reaction_mean,
        round(reaction_sd, 6) AS reaction_sd, CASE WHEN breaks > 0 THEN 'BROKEN' WHEN holds > 0 THEN 'CONFIRMED' WHEN touches > 0 THEN 'TESTED' ELSE 'UNTESTED' END AS state FROM hi""", "zones", extra=HISTORY, once=("lk", "ev", "ch"),
    ),
)
_delta = lambda s, d: LB.preds(s, d).select("security_id", "as_of", F.year("as_of").alias("year"), (F.pow(0.5 - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2)).alias("delta"))
register("cmp_10_ablation_interval", lambda s, d: E.ablation_interval(_delta(s, d)))
register("agg_16_bca", lambda s, d: L.bca_interval(LB.labelled(s, d), ["security_id", "as_of"], "y_touch", ["side"]))


def _calendar_window(s, d):
    series, z = LB.zoned(s, d)
    steps = pit.next_sessions(_calendar(s, d), z.select("as_of").distinct(), 5)
    return L.calendar_window(z, series, steps).select("security_id", "as_of", "zone_id", "step", "session", "open", "high", "low", "close", "label_gap")


register(
    "jon_10_calendar_window", _calendar_window,
    query(
        """SELECT security_id, as_of, zone_id, step, session, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, count(close) OVER (PARTITION BY security_id, as_of, zone_id) < 5 AS label_gap
        FROM zones z JOIN ns USING (as_of) LEFT JOIN (SELECT security_id, session, open, high, low, close FROM bars) b USING (security_id, session)""", "zones",
        extra={"calendar": CALENDAR, "ns": """SELECT as_of, n AS step, session FROM (SELECT a.as_of, c.session, row_number() OVER (PARTITION BY as_of ORDER BY c.session) AS n
          FROM (SELECT DISTINCT as_of FROM zones) a JOIN calendar c ON c.session > a.as_of AND c.session <= a.as_of + 40) WHERE n <= 5"""},
    ),
)
FAMILY = ("family", "bucket", "regime")


def _by_family(s, d):
    names = zones_and_state(s, d)[2].select(*L.KEY, "sources")
    return L.by_family(LB.labelled_by_regime(s, d).join(names, list(L.KEY)))


def _placebos_by_family(s, d):
    """Placebos have the families of the zone that they stand for."""
    names = zones_and_state(s, d)[2].select("security_id", "as_of", F.col("zone_id").alias("of"), "sources")
    rows = LB.placebo_labelled(s, d).join(LB.regimes(s, d), "as_of").withColumn("of", F.substring_index("zone_id", "#", 1))
    return L.by_family(rows.join(names, ["security_id", "as_of", "of"]))


_fam = "unnest(list_distinct(list_transform(string_split(n.sources, ','), lambda x: CASE WHEN starts_with(x, 'round') THEN 'B' ELSE 'A' END))) AS family"
_names = "(SELECT security_id, as_of, zone_id, sources FROM zones) n"
BY_FAMILY = LB.CONTROL | {
    "fl": f"SELECT l.*, reg.regime, {_fam} FROM lbl l JOIN reg USING (as_of) JOIN {_names} ON n.security_id = l.security_id AND n.as_of = l.as_of AND n.zone_id = l.zone_id WHERE y_touch = 1",
    "fp": f"SELECT l.*, reg.regime, {_fam} FROM lbl_p l JOIN reg USING (as_of) JOIN {_names} ON n.security_id = l.security_id AND n.as_of = l.as_of AND n.zone_id = string_split(l.zone_id, '#')[1] WHERE y_touch = 1",
    **{f"r{x}": f"SELECT family, bucket, regime, grouping(family, bucket, regime) AS coarse, count(*) AS n, avg(y_hold) AS hold_rate FROM {x} GROUP BY ROLLUP (family, bucket, regime)" for x in ("fl", "fp")},
}
register(
    "agg_11_by_family", lambda s, d: L.matched_control(_by_family(s, d), _placebos_by_family(s, d), FAMILY),
    query(
        """SELECT a.family, a.bucket, a.regime, a.coarse, a.n, round(a.hold_rate, 6) AS hold_rate, b.n AS n_placebo, round(b.hold_rate, 6) AS placebo_rate, round(a.hold_rate - b.hold_rate, 6) AS lift
        FROM rfl a LEFT JOIN rfp b ON a.family IS NOT DISTINCT FROM b.family AND a.bucket IS NOT DISTINCT FROM b.bucket AND a.regime IS NOT DISTINCT FROM b.regime AND a.coarse = b.coarse""", "zones", extra=BY_FAMILY,
    ),
)
register(
    "agg_12_by_family", lambda s, d: L.historical_frequency(_by_family(s, d), fine=FAMILY, middle=("family", "bucket")),
    query(
        """SELECT family, bucket, regime, n, CASE WHEN n >= 200 THEN 3 WHEN n2 >= 200 THEN 2 ELSE 1 END AS level,
        round(CASE WHEN n >= 200 THEN (h + 5 * base) / (n + 5) WHEN n2 >= 200 THEN (h2 + 5 * base) / (n2 + 5) ELSE (h1 + 5 * base) / (n1 + 5) END, 6) AS rate FROM (
          SELECT *, sum(n) OVER (PARTITION BY family, bucket) AS n2, sum(h) OVER (PARTITION BY family, bucket) AS h2, sum(n) OVER (PARTITION BY bucket) AS n1, sum(h) OVER (PARTITION BY bucket) AS h1,
          sum(h) OVER () / sum(n) OVER () AS base FROM (SELECT family, bucket, regime, count(*) AS n, sum(y_hold) AS h FROM fl GROUP BY ALL))""", "zones", extra=BY_FAMILY,
    ),
)
