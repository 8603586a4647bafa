"""The data spine: actions, membership, reconciliation, quality, incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pit
from .indicators import by_session
from .series import log_return


def action_gain() -> F.Column:
    """The factor by which one action multiplies earlier prices. Columns: kind, ratio, amount, close_before, offer.
    split: 1 / ratio; bonus: 1 / (1 + ratio); dividend: 1 - amount / close; rights: the theoretical price after the rights over the close before; spinoff: 1 - amount / close."""
    close = F.nullif(F.col("close_before"), F.lit(0.0))
    rights = (close + F.col("ratio") * F.col("offer")) / (1 + F.col("ratio")) / close
    return F.when(F.col("kind") == "split", 1 / F.nullif(F.col("ratio"), F.lit(0.0))).when(F.col("kind") == "bonus", 1 / (1 + F.col("ratio"))).when(F.col("kind").isin("dividend", "spinoff"), 1 - F.col("amount") / close).when(F.col("kind") == "rights", rights)


def adjust_asof(bars: DataFrame, actions: DataFrame, as_of, kinds: tuple[str, ...] = ("split", "bonus", "dividend", "rights", "spinoff")) -> DataFrame:
    """``bars`` with factor and adjusted close: the product of the gains of actions with ex_date after the session, known by ``as_of``.
    Actions (security_id, ex_date, available_at, gain, kind) and sessions are put in one descending order and the product runs along it."""
    known = actions.where((F.col("ex_date") <= as_of) & (F.col("available_at") <= as_of) & F.col("kind").isin(*kinds))
    w = Window.partitionBy("security_id").orderBy(F.desc("at"), "is_action").rowsBetween(Window.unboundedPreceding, 0)
    one = bars.select("security_id", F.col("session").alias("at"), F.lit(0).alias("is_action"), "close", F.lit(None).cast("double").alias("gain"))
    two = known.select("security_id", F.col("ex_date").alias("at"), F.lit(1).alias("is_action"), F.lit(None).cast("double").alias("close"), "gain")
    both = one.unionByName(two).withColumn("factor", F.exp(F.sum(F.coalesce(F.log("gain"), F.lit(0.0))).over(w)))
    return both.where("is_action = 0").select("security_id", F.col("at").alias("session"), "close", "factor", (F.col("close") * F.col("factor")).alias("adjusted"))


def members_at(membership: DataFrame, dates: DataFrame) -> DataFrame:
    """index_id, security_id, as_of: members at each date, start inclusive, end exclusive or open. Joined by the years that a membership touches."""
    last = F.broadcast(dates.agg(F.max("as_of").alias("last")))  # one row
    end = F.coalesce("end", F.lit("9999-12-31").cast("date"))
    spans = membership.crossJoin(last).where(F.col("start") <= F.col("last")).withColumn("year", F.explode(F.sequence(F.year("start"), F.greatest(F.year("start"), F.year(F.least(end, "last"))))))
    return dates.withColumn("year", F.year("as_of")).join(spans, "year").where((F.col("start") <= F.col("as_of")) & (F.col("as_of") < end)).select("index_id", "security_id", "as_of")


def resolve_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` (source, symbol, session) with the security that the symbol named on that day; null if none."""
    s = symbols.select(F.col("source").alias("_s"), F.col("symbol").alias("_y"), "security_id", "start", "end")
    end = F.coalesce("end", F.lit("9999-12-31").cast("date"))
    return rows.join(s, (F.col("source") == F.col("_s")) & (F.col("symbol") == F.col("_y")) & (F.col("start") <= F.col("session")) & (F.col("session") < end), "left").select(*rows.columns, "security_id")


def reconcile(a: DataFrame, b: DataFrame, relative: float = 0.001, tick: float = 0.01) -> DataFrame:
    """security_id, session, close_a, close_b, status of two price sources: pass within the relative tolerance or one tick."""
    both = a.select("security_id", "session", F.col("close").alias("close_a")).join(b.select("security_id", "session", F.col("close").alias("close_b")), ["security_id", "session"], "full")
    off = F.abs(F.col("close_a") - F.col("close_b"))
    ok = (off <= relative * F.abs("close_a")) | (F.round(off, 9) <= tick)
    return both.withColumn("status", F.when(F.col("close_a").isNull(), "only_b").when(F.col("close_b").isNull(), "only_a").when(ok, "pass").otherwise("fail"))


def recon_summary(rows: DataFrame) -> DataFrame:
    """Pass rate of each security, and of all (security_id null)."""
    return rows.rollup("security_id").agg(F.count("*").alias("n"), F.avg((F.col("status") == "pass").cast("double")).alias("pass_rate"))


def incremental(old: DataFrame, new: DataFrame, overlap: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """security_id, session, close, action of a load: rows of sessions not yet known are appended if the last ``overlap`` known sessions
    agree; a security of which one does not is restated."""
    last = Window.partitionBy("security_id").orderBy(F.desc("session"))
    tail = old.withColumn("n", F.row_number().over(last)).where(F.col("n") <= overlap).select("security_id", "session", F.col("close").alias("old_close"))
    bad = new.join(tail, ["security_id", "session"]).groupBy("security_id").agg(F.max((F.abs(F.col("close") - F.col("old_close")) > tolerance * F.abs("old_close")).cast("int")).alias("bad"))
    fresh = new.join(old.select("security_id", "session"), ["security_id", "session"], "left_anti")
    return fresh.join(bad, "security_id", "left").select("security_id", "session", "close", F.when(F.coalesce("bad", F.lit(0)) == 1, "restate").otherwise("append").alias("action"))


def calendar_mismatch(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """security_id, session, kind: sessions within a security's life without a bar, and bars that are on no session. Lives and sessions are joined by year."""
    life = bars.groupBy("security_id").agg(F.min("session").alias("a"), F.max("session").alias("b"))
    life = life.withColumn("year", F.explode(F.sequence(F.year("a"), F.year("b"))))
    wanted = calendar.select("session", F.year("session").alias("year")).join(life, "year").where(F.col("session").between(F.col("a"), F.col("b"))).select("security_id", "session")
    have = bars.select("security_id", "session")
    return wanted.subtract(have).withColumn("kind", F.lit("no_bar")).unionByName(have.join(calendar.select("session"), "session", "left_anti").select("security_id", "session").withColumn("kind", F.lit("no_session")))


def quality(bars: DataFrame, window: int = 252) -> DataFrame:
    """security_id, session, score and its parts over the trailing window: valid ranges, no missing value, positive prices, positive volume, no jump, no stale
    price; low < open, close < high counts as valid. Weights sum to 1."""
    w = by_session().rowsBetween(-(window - 1), 0)
    last = F.lag("close").over(by_session())
    parts = {
        "c_ohlc": (0.25, (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))), "c_missing": (0.2, F.col("open").isNotNull() & F.col("close").isNotNull()),
        "c_positive": (0.15, F.col("low") > 0), "c_volume": (0.15, F.col("volume") > 0), "c_jump": (0.15, F.coalesce(F.abs(F.col("close") / last - 1) <= 0.01, F.lit(True))), "c_stale": (0.1, F.coalesce(F.col("close") != last, F.lit(True))),
    }
    out = bars.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, (_, v) in parts.items()})
    out = out.withColumns({k: F.avg(k).over(w) for k in parts})
    score = sum((F.col(k) * wt for k, (wt, _) in parts.items()), F.lit(0.0))
    names = F.filter(F.array(*(F.when(F.col(k) < 0.5, F.lit(k)) for k in parts)), lambda x: x.isNotNull())
    return out.select("security_id", "session", *parts, score.alias("score"), F.concat_ws(",", names).alias("blockers"))


def choose_source(coverage: DataFrame, wanted: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """security_id, source: the first source of the chain whose history covers the wanted span; one source for a security's whole history."""
    rank = F.array_position(F.array(*(F.lit(c) for c in chain)), F.col("source"))
    ok = coverage.join(wanted, "security_id").where((F.col("first") <= F.col("from")) & (F.col("last") >= F.col("to")) & (rank > 0)).withColumn("rank", rank)
    return ok.groupBy("security_id").agg(F.min_by("source", "rank").alias("source"))


def coverage_by_year(members: DataFrame, bars: DataFrame) -> DataFrame:
    """index_id, year, members, with_bars: distinct members of each year and those that have a bar in it."""
    years = members.select("index_id", "security_id", F.year("as_of").alias("year")).distinct()
    have = bars.select("security_id", F.year("session").alias("year")).distinct().withColumn("has", F.lit(1))
    return years.join(have, ["security_id", "year"], "left").groupBy("index_id", "year").agg(F.count("*").alias("members"), F.count("has").alias("with_bars"))


def split_state(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """security_id, ex_date, ratio, state: whether the price series already holds the split. The step of log price over the ex-date is compared
    with no step and with the split's own."""
    step = bars.select("security_id", "session", log_return().alias("step"))
    both = splits.join(step, (splits.security_id == step.security_id) & (splits.ex_date == step.session), "left").select(splits.security_id, "ex_date", "ratio", "step")
    near0, near1 = F.abs("step"), F.abs(F.col("step") + F.log("ratio"))
    return both.withColumn("state", F.when(F.col("step").isNull(), "unknown").when(near0 < 0.25 * F.abs(F.log("ratio")), "applied").when(near1 < 0.25 * F.abs(F.log("ratio")), "not_applied").otherwise("ambiguous"))


def tick_size(prices: DataFrame, bands: DataFrame) -> DataFrame:
    """``prices`` (market, price) with the tick of the band lo <= price < hi; 0.01 where there is none."""
    b = bands.select(F.col("market").alias("_m"), "lo", "hi", "tick")
    return prices.join(b, (F.col("market") == F.col("_m")) & (F.col("price") >= F.col("lo")) & (F.col("price") < F.col("hi")), "left").select(*prices.columns, F.coalesce("tick", F.lit(0.01)).alias("tick"))


def open_sessions(calendar: DataFrame, closures: DataFrame) -> DataFrame:
    """The calendar without full closures; half days stay and are flagged."""
    full = closures.where("kind = 'full'").select("session")
    half = closures.where("kind = 'half'").select("session", F.lit(True).alias("half_day"))
    return calendar.join(full, "session", "left_anti").join(half, "session", "left").withColumn("half_day", F.coalesce("half_day", F.lit(False)))


def load_status(audit: DataFrame, now) -> DataFrame:
    """dataset, status of the latest run: ok, partial, error, or stale after two days."""
    w = Window.partitionBy("dataset").orderBy(F.desc("at"), F.desc("run"))
    last = audit.withColumn("n", F.row_number().over(w)).where("n = 1")
    return last.select("dataset", "at", F.when(F.col("at") < now - F.expr("interval 2 days"), "stale").when(F.col("failed") == 0, "ok").when(F.col("failed") < F.col("total"), "partial").otherwise("error").alias("status"))


def event_context(events: DataFrame, asof: DataFrame) -> DataFrame:
    """security_id, as_of, days_since, days_to: distance to the last event at or before as_of and to the next one after it, of events (security_id, event_date, available_at)
    that were known by as_of; null if there is none.

    An event counts as past from the day on which it has both happened and become known: a running maximum. It is upcoming from the day on which it becomes
    known to the day before it happens, and is listed under the months between, which are few."""
    e = events.select("security_id", "event_date", F.to_date("available_at").alias("known"))
    past = e.withColumn("at", F.greatest("event_date", "known"))
    since = pit.latest_known(past, asof, ["security_id"], "event_date", "at", "as_of", []).select("security_id", "as_of", F.datediff("as_of", "event_date").cast("long").alias("days_since"))
    month = lambda c: F.trunc(c, "month")
    ahead = e.where("known < event_date").withColumn("month", F.explode(F.sequence(month("known"), month("event_date"), F.expr("interval 1 month"))))
    met = asof.select("security_id", "as_of", month("as_of").alias("month")).join(ahead, ["security_id", "month"]).where((F.col("known") <= F.col("as_of")) & (F.col("as_of") < F.col("event_date")))
    to = met.groupBy("security_id", "as_of").agg(F.min(F.datediff("event_date", "as_of")).cast("long").alias("days_to"))
    return since.join(to, ["security_id", "as_of"], "left")


def traded_prices(bars: DataFrame, splits: DataFrame, fetched) -> DataFrame:
    """security_id, session, raw_close, raw_volume: prices as they were traded, from a series that was rescaled for every split up to ``fetched``: times the ratios of the splits
    (security_id, ex_date, ratio) after the session. Splits and sessions share one descending order, along which the product runs."""
    w = Window.partitionBy("security_id").orderBy(F.desc("at"), "is_split").rowsBetween(Window.unboundedPreceding, 0)
    one = bars.select("security_id", F.col("session").alias("at"), F.lit(0).alias("is_split"), "close", "volume", F.lit(None).cast("double").alias("ratio"))
    two = splits.where(F.col("ex_date") <= fetched).select("security_id", F.col("ex_date").alias("at"), F.lit(1).alias("is_split"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume"), F.col("ratio").cast("double").alias("ratio"))
    both = one.unionByName(two).withColumn("times", F.exp(F.sum(F.coalesce(F.log("ratio"), F.lit(0.0))).over(w)))
    return both.where("is_split = 0").select("security_id", F.col("at").alias("session"), (F.col("close") * F.col("times")).alias("raw_close"), (F.col("volume") / F.col("times")).alias("raw_volume"))
