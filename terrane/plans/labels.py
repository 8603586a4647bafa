"""Queries of labels and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ladder import draw
from ..operators import labels as L
from ..operators import series as S
from ..operators import zones as Z
from ..sources.derived import bars
from . import series as SQ
from .core import R, candidates, rounded, zones_and_state
from .sql import _mixed, query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def zoned(s, d):
    series, state, found = zones_and_state(s, d)
    return series, found.join(state.select("security_id", "as_of", "k"), ["security_id", "as_of"])


def labelled(s, d):
    series, z = zoned(s, d)
    facts = z.select("security_id", "as_of", "zone_id", "n_families", "distance_atr", F.floor(F.least(F.abs("distance_atr"), F.lit(3.0)) * 2).alias("bucket"))
    return L.barrier_labels(z, series).join(facts, ["security_id", "as_of", "zone_id"])


def labelled_by_regime(s, d):
    """Labels with the regime of their date."""
    return labelled(s, d).join(regimes(s, d), "as_of")


def preds(s, d):
    """A stand-in forecast: nearer zones are touched more."""
    return labelled(s, d).select("security_id", "as_of", "zone_id", F.exp(-F.abs("distance_atr") / 2).alias("p"), F.col("y_touch").cast("double").alias("y"))


def regimes(s, d):
    """The market's regime at each session."""
    return S.regimes(S.market(bars(s, d))).where("regime is not null").select(F.col("session").alias("as_of"), "regime")


def placebo_labelled(s, d):
    """Placebos, labelled as zones are."""
    series, state, found = zones_and_state(s, d)
    drawn = L.placebos(found).withColumn("zone_id", F.concat("zone_id", F.lit("#"), F.col("draw").cast("string"))).join(state.select("security_id", "as_of", "k"), ["security_id", "as_of"])
    names = found.select("security_id", "as_of", F.col("zone_id").alias("of"), "n_families")
    facts = drawn.select("security_id", "as_of", "zone_id", F.substring_index("zone_id", "#", 1).alias("of"), F.floor(F.least(F.abs("distance_atr"), F.lit(3.0)) * 2).alias("bucket")).join(names, ["security_id", "as_of", "of"]).drop("of")
    return L.barrier_labels(drawn, series).join(facts, ["security_id", "as_of", "zone_id"])


def label_ctes(source: str, x: str = "") -> dict[str, str]:
    """The steps from zones with k (``source``) to labels, under names that end in ``x``."""
    return {
        f"lw{x}": f"SELECT z.*, b.k - z.k AS step, b.open, b.high, b.low, b.available_at AS bar_at FROM {source} z JOIN bars b ON b.security_id = z.security_id AND b.k BETWEEN z.k + 1 AND z.k + 5",
        f"m{x}": f"SELECT security_id, as_of, zone_id, side, atr, distance_atr, n_families, step, bar_at, CASE side WHEN 'support' THEN lower ELSE -upper END AS L, CASE side WHEN 'support' THEN upper ELSE -lower END AS U, CASE side WHEN 'support' THEN open ELSE -open END AS o, CASE side WHEN 'support' THEN high ELSE -low END AS h, CASE side WHEN 'support' THEN low ELSE -high END AS lo FROM lw{x}",
        f"tt{x}": f"SELECT *, min(step) FILTER (lo <= U AND h >= L) OVER (PARTITION BY security_id, as_of, zone_id) AS t_touch, count(*) OVER (PARTITION BY security_id, as_of, zone_id) AS n_bars FROM m{x}",
        f"en{x}": f"SELECT *, max(CASE WHEN step = t_touch THEN CASE WHEN o BETWEEN L AND U THEN o ELSE U END END) OVER (PARTITION BY security_id, as_of, zone_id) AS entry_ FROM tt{x}",
        f"lb{x}": f"SELECT security_id, as_of, zone_id, side, any_value(distance_atr) AS distance_atr, any_value(n_families) AS n_families, min(t_touch) AS t_touch, min(step) FILTER (step >= t_touch AND lo < L - 0.25 * atr) AS t_break, min(CASE WHEN o >= entry_ THEN step - 0.25 ELSE step + 0.25 END) FILTER (step >= t_touch AND h >= entry_ + 0.5 * atr) AS r, max(entry_) AS entry_, min(n_bars) AS n_bars, max(bar_at) AS available_at FROM en{x} GROUP BY security_id, as_of, zone_id, side",
        f"lbl{x}": f"SELECT *, (t_touch IS NOT NULL)::INT AS y_touch, CASE WHEN t_touch IS NOT NULL THEN (r IS NOT NULL AND (t_break IS NULL OR r < t_break))::INT END AS y_hold, least(floor(abs(distance_atr) * 2), 6)::BIGINT AS bucket FROM lb{x}",
    }


ZK = {"zk": "SELECT z.*, s.k FROM zones z JOIN state s USING (security_id, as_of)"}
LAB = label_ctes("zk")
WIN = {"lw": LAB["lw"]}
ALL = ZK | LAB
REGIMES = {"reg": f"SELECT session AS as_of, regime FROM ({SQ.ORACLE['win_18_regimes']}) WHERE regime IS NOT NULL"}
register("jon_10_label_window", lambda s, d: (lambda x: L.label_window(x[1], x[0]).select("security_id", "as_of", "zone_id", "step", "open", "high", "low"))(zoned(s, d)), query(f"SELECT security_id, as_of, zone_id, step, {R('open', 'high', 'low')} FROM lw", "zones", extra=ZK | WIN))
register(
    "cmp_4_barrier_labels", lambda s, d: (lambda x: L.barrier_labels(x[1], x[0]))(zoned(s, d)),
    query("SELECT security_id, as_of, zone_id, side, y_touch, y_hold, CASE WHEN y_touch = 1 THEN (t_break IS NOT NULL AND y_hold = 0)::INT END AS y_break, CASE WHEN y_touch = 1 THEN (y_hold = 0 AND t_break IS NULL)::INT END AS unresolved, t_touch, t_break, round(CASE side WHEN 'support' THEN entry_ ELSE -entry_ END, 6) AS entry, n_bars < 5 AS label_gap, available_at FROM lbl", "zones", extra=ALL),
)
PLA = {
    "drawn": "SELECT security_id, as_of, zone_id, side, spot, atr, draw, lower + mv AS lower, upper + mv AS upper, (center + mv - spot) / atr AS distance_atr, upper - lower AS width FROM (SELECT *, (2 * (('0x' || substr(md5('0|' || zone_id || '|' || as_of || '|' || draw), 1, 8))::BIGINT % 1000001) / 1000000.0 - 1) * 0.1 * atr AS mv FROM zones CROSS JOIN (SELECT unnest(range(1, 21)) AS draw))",
    "free": "SELECT * FROM drawn d WHERE (distance_atr < 0) = (side = 'support') AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.security_id = d.security_id AND z.as_of = d.as_of AND z.zone_id <> d.zone_id AND least(d.upper, z.upper) - greatest(d.lower, z.lower) > 0.25 * d.width)",
}
register("cmp_6_placebos", lambda s, d: L.placebos(zones_and_state(s, d)[2]).select("security_id", "as_of", "zone_id", "draw", "lower", "upper"), query(f"SELECT security_id, as_of, zone_id, draw, {R('lower', 'upper')} FROM free QUALIFY row_number() OVER (PARTITION BY security_id, as_of, zone_id ORDER BY draw) <= 5", "zones", extra=PLA))
register("jon_13_placebos_free_of_zones", lambda s, d: L.placebos(zones_and_state(s, d)[2], n=5).groupBy("security_id", "as_of").agg(F.count("*").alias("n")), query("SELECT security_id, as_of, count(*) AS n FROM (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY security_id, as_of, zone_id ORDER BY draw) <= 5) GROUP BY ALL", "zones", extra=PLA))
register(
    "jon_11_zone_identity", lambda s, d: L.match_zones(zones_and_state(s, d)[2]),
    query("SELECT security_id, as_of, zone_id, prior_as_of, prior_zone, round(jaccard, 6) AS jaccard FROM (SELECT z.security_id, z.as_of, z.zone_id, z.center, o.as_of AS prior_as_of, o.zone_id AS prior_zone, o.center AS pc, round(len(list_intersect(string_split(z.sources, ','), string_split(o.sources, ',')))::DOUBLE / len(list_distinct(list_concat(string_split(z.sources, ','), string_split(o.sources, ',')))), 9) AS jaccard FROM zones z JOIN zones o ON o.security_id = z.security_id AND o.side = z.side AND z.as_of - o.as_of BETWEEN 1 AND 84 AND abs(z.center - o.center) <= 0.25 * z.atr) WHERE jaccard > 0 QUALIFY row_number() OVER (PARTITION BY security_id, as_of, zone_id ORDER BY jaccard DESC, round(abs(center - pc), 9), prior_as_of DESC, prior_zone) = 1", "zones"),
)
_rates = lambda of: f"SELECT bucket, n_families, regime, grouping(bucket, n_families, regime) AS coarse, count(*) AS n, avg(y_hold) AS hold_rate FROM {of} JOIN reg USING (as_of) WHERE y_touch = 1 GROUP BY ROLLUP (bucket, n_families, regime)"
CONTROL = ALL | PLA | REGIMES | {
    "pk": "SELECT f.security_id, f.as_of, f.zone_id || '#' || f.draw AS zone_id, f.side, f.atr, f.lower, f.upper, f.distance_atr, z.n_families, s.k FROM (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY security_id, as_of, zone_id ORDER BY draw) <= 5) f JOIN state s USING (security_id, as_of) JOIN (SELECT security_id, as_of, zone_id, n_families FROM zones) z USING (security_id, as_of, zone_id)",
    **label_ctes("pk", "_p"), "ra": _rates("lbl"), "rb": _rates("lbl_p"),
}
register(
    "agg_11_hold_rates", lambda s, d: L.matched_control(labelled_by_regime(s, d), placebo_labelled(s, d).join(regimes(s, d), "as_of")),
    query("SELECT a.bucket, a.n_families, a.regime, a.coarse, a.n, round(a.hold_rate, 6) AS hold_rate, b.n AS n_placebo, round(b.hold_rate, 6) AS placebo_rate, round(a.hold_rate - b.hold_rate, 6) AS lift FROM ra a LEFT JOIN rb b ON a.bucket IS NOT DISTINCT FROM b.bucket AND a.n_families IS NOT DISTINCT FROM b.n_families AND a.regime IS NOT DISTINCT FROM b.regime AND a.coarse = b.coarse", "zones", extra=CONTROL),
)
register(
    "agg_12_historical_frequency", lambda s, d: L.historical_frequency(labelled_by_regime(s, d)),
    query("SELECT bucket, n_families, regime, n, CASE WHEN n >= 200 THEN 3 WHEN n2 >= 200 THEN 2 ELSE 1 END AS level, round(CASE WHEN n >= 200 THEN (h + 5 * base) / (n + 5) WHEN n2 >= 200 THEN (h2 + 5 * base) / (n2 + 5) ELSE (h1 + 5 * base) / (n1 + 5) END, 6) AS rate FROM (SELECT *, sum(n) OVER (PARTITION BY bucket, n_families) AS n2, sum(h) OVER (PARTITION BY bucket, n_families) AS h2, sum(n) OVER (PARTITION BY bucket) AS n1, sum(h) OVER (PARTITION BY bucket) AS h1, sum(h) OVER () / sum(n) OVER () AS base FROM (SELECT bucket, n_families, regime, count(*) AS n, sum(y_hold) AS h FROM lbl JOIN reg USING (as_of) WHERE y_touch = 1 GROUP BY ALL))", "zones", extra=ALL | REGIMES),
)
register("agg_13_base_rate", lambda s, d: labelled(s, d).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("y_touch").alias("touch_rate")), query("SELECT bucket, count(*) AS n, round(avg(y_touch), 6) AS touch_rate FROM lbl GROUP BY bucket", "zones", extra=ALL))
PRED = ALL | {"pr": "SELECT security_id, as_of, zone_id, exp(-abs(distance_atr) / 2) AS p, y_touch::DOUBLE AS y FROM lbl"}
register(
    "agg_14_calibration", lambda s, d: L.calibration(preds(s, d), "p", "y", "security_id"),
    query("SELECT security_id, sum(n)::BIGINT AS n, round(sum(b) / sum(n), 6) AS brier, round(sum(ll) / sum(n), 6) AS log_loss, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round((sum(spy) - sum(sp) * sum(sy) / sum(n)) / nullif(sum(spp) - sum(sp) ** 2 / sum(n), 0), 6) AS slope FROM (SELECT security_id, bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum(p * p) AS spp, sum(p * y) AS spy, sum((p - y) ** 2) AS b, sum(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS ll FROM (SELECT *, len(list_filter(e, lambda x: x < p)) AS bin FROM pr CROSS JOIN (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM pr)) GROUP BY GROUPING SETS ((security_id, bin), (bin))) GROUP BY security_id", "zones", extra=PRED),
)
register("agg_15_level_metrics", lambda s, d: labelled(s, d).groupBy("security_id").agg(F.count("*").alias("zones"), F.avg("y_touch").alias("touch_rate"), F.avg("y_hold").alias("hold_rate"), F.avg(F.coalesce("y_hold", F.lit(0))).alias("precision")), query("SELECT security_id, count(*) AS zones, round(avg(y_touch), 6) AS touch_rate, round(avg(y_hold), 6) AS hold_rate, round(avg(coalesce(y_hold, 0)), 6) AS precision FROM lbl GROUP BY security_id", "zones", extra=ALL))
_start = "('0x' || substr(md5('0|' || security_id || '|' || as_of), 1, 8))::BIGINT % 2147483648"
_weight = " + ".join(f"(x >= {c})::INT" for c in L.POISSON)
register(
    "agg_16_cluster_bootstrap", lambda s, d: L.cluster_bootstrap(labelled(s, d), ["security_id", "as_of"], "y_touch"),
    query(
        f"""SELECT (SELECT round(avg(y_touch), 6) FROM lbl) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
        round(least(1, 2 * least(avg((m <= 0.5)::INT), avg((m >= 0.5)::INT))), 6) AS p FROM (
          SELECT b, sum(w * s)::DOUBLE / sum(w * n) AS m FROM (SELECT *, {_weight} AS w FROM (
            SELECT *, {_mixed(f"xor({_start}, {_mixed('b')})")} AS x FROM (SELECT security_id, as_of, sum(y_touch) AS s, count(y_touch) AS n FROM lbl GROUP BY ALL)
            CROSS JOIN (SELECT unnest(range(1, 2001)) AS b))) GROUP BY b)""", "zones", extra=ALL,
    ),
)
register(
    "agg_17_fdr", lambda s, d: L.fdr(preds(s, d).select("security_id", F.concat("zone_id", F.lit("@"), F.col("as_of").cast("string")).alias("id"), F.round("p", 9).alias("p")), "p", "security_id").select("security_id", "id", "q"),
    query("SELECT security_id, id, round(least(min(p * m / rank) OVER (PARTITION BY security_id ORDER BY rank DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY p, id) AS rank, count(*) OVER (PARTITION BY security_id) AS m FROM (SELECT security_id, zone_id || '@' || as_of AS id, round(p, 9) AS p FROM pr))", "zones", extra=PRED),
)
register(
    "agg_21_drift", lambda s, d: L.drift(s.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate < '1995-06-01'"), s.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate >= '1995-06-01'"), "l_quantity"),
    "WITH r AS (SELECT l_quantity AS v FROM lineitem WHERE l_shipdate < '1995-06-01'), c AS (SELECT l_quantity AS v FROM lineitem WHERE l_shipdate >= '1995-06-01'), e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM r), u AS (SELECT v, 1 AS r, 0 AS c FROM r UNION ALL SELECT v, 0, 1 FROM c), t AS (SELECT sum(r)::DOUBLE AS tr, sum(c)::DOUBLE AS tc FROM u), s AS (SELECT len(list_filter(e, lambda x: x < v)) AS bin, sum(r) AS r, sum(c) AS c FROM u CROSS JOIN e GROUP BY ALL), d AS (SELECT v, abs(sum(r) OVER (ORDER BY v) / tr - sum(c) OVER (ORDER BY v) / tc) AS d, lead(v) OVER (ORDER BY v) AS after FROM (SELECT v, sum(r) AS r, sum(c) AS c FROM u GROUP BY v) CROSS JOIN t), p AS (SELECT sum((greatest(c / tc, 1e-6) - greatest(r / tr, 1e-6)) * ln(greatest(c / tc, 1e-6) / greatest(r / tr, 1e-6))) AS psi FROM s CROSS JOIN t) SELECT round(psi, 6) AS psi, round(max(d), 6) AS ks, round(sum(d * (after - v)), 6) AS w1, CASE WHEN psi > 0.25 THEN 'red' WHEN psi > 0.1 THEN 'amber' ELSE 'green' END AS level FROM d CROSS JOIN p GROUP BY psi",
)


def _publishable(s, d):
    """Zones with stand-in scores: hashes of their names."""
    u = lambda name, low, n: low + draw(F.lit(name), [F.col("zone_id"), F.col("as_of").cast("string")], F.lit(1000)) / n
    quality = 0.65 + draw(F.lit("q"), [F.col("security_id").cast("string"), F.col("as_of").cast("string")], F.lit(1000)) / 2500.0
    return zones_and_state(s, d)[2].withColumns({"p_touch": u("t", 0.55, 2500.0), "p_hold": u("h", 0.55, 2500.0), "confidence": u("c", 0.6, 2500.0), "reaction": u("r", 0.5, 1000.0), "event_risk": u("e", 0.0, 1200.0), "dq": quality})


_u = lambda name, low, n, of="zone_id": f"{low} + ('0x' || substr(md5('{name}|' || {of} || '|' || as_of), 1, 8))::BIGINT % 1000 / {n}::DOUBLE"
PUB = {
    "pub": f"SELECT *, {_u('t', 0.55, 2500)} AS p_touch, {_u('h', 0.55, 2500)} AS p_hold, {_u('c', 0.6, 2500)} AS confidence, {_u('r', 0.5, 1000)} AS reaction, {_u('e', 0.0, 1200)} AS event_risk, {_u('q', 0.65, 2500, 'security_id')} AS dq FROM zones",
    "good": "SELECT *, p_touch * p_hold * reaction * confidence AS score FROM pub WHERE p_touch >= 0.6 AND p_hold >= 0.65 AND confidence >= 0.7 AND event_risk <= 0.7 AND dq >= 0.8 AND (security_id, as_of) NOT IN (SELECT (security_id, as_of) FROM pub WHERE dq < 0.7)",
    "shown": "SELECT * FROM (SELECT *, row_number() OVER w AS rank, nth_value(score, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM good WINDOW w AS (PARTITION BY security_id, as_of, side ORDER BY round(score, 9) DESC, zone_id)) WHERE rank <= 2 OR rank <= 4 AND round(score, 9) >= round(0.9 * second, 9)",
}
register("flt_9_published", lambda s, d: L.published(_publishable(s, d)).groupBy("security_id", "as_of").agg(F.count("*").alias("n")), query("SELECT security_id, as_of, count(*) AS n FROM shown GROUP BY ALL", "zones", extra=PUB))
register("srt_3_publish_rank", lambda s, d: L.published(_publishable(s, d)).select("security_id", "as_of", "zone_id", "rank", "score"), query("SELECT security_id, as_of, zone_id, rank, round(score, 6) AS score FROM shown", "zones", extra=PUB))
register("set_3_deduped_levels", lambda s, d: Z.deduped(candidates(s, d)).select("security_id", "as_of", "source", "level", "n"), query("SELECT security_id, as_of, source, round(avg(level), 6) AS level, count(*) AS n FROM (SELECT *, sum(far) OVER (PARTITION BY security_id, as_of, source ORDER BY level RANGE UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce((level - lag(level) OVER (PARTITION BY security_id, as_of, source ORDER BY level)) / atr > 0.05, false)::INT AS far FROM cand)) GROUP BY security_id, as_of, source, island", "cand"))
register(
    "cmp_2_density_clusters", lambda s, d: Z.density_clusters(candidates(s, d)).groupBy("security_id", "as_of", "cluster").agg(F.count("*").alias("n"), F.min("level").alias("low"), F.max("level").alias("high")).drop("cluster"),
    query("SELECT security_id, as_of, n, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT security_id, as_of, island, half, count(*) AS n, min(level) AS low, max(level) AS high FROM (SELECT *, CASE WHEN (hi - lo) / atr > 1 AND level >= cut THEN 1 ELSE 0 END AS half FROM (SELECT *, arg_max(level, (gap, -level)) FILTER (level > lo) OVER (PARTITION BY security_id, as_of, island) AS cut FROM (SELECT *, min(level) OVER i AS lo, max(level) OVER i AS hi FROM (SELECT *, sum((coalesce(gap, 0) > 0.25)::INT) OVER (PARTITION BY security_id, as_of ORDER BY level, source) AS island FROM (SELECT *, round((level - lag(level) OVER (PARTITION BY security_id, as_of ORDER BY level, source)) / atr, 9) AS gap FROM cand)) WINDOW i AS (PARTITION BY security_id, as_of, island)))) GROUP BY ALL)", "cand"),
)
