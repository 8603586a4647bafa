"""Queries of memberships that overlap, hazards, and evidence in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as V
from ..operators import labels as L
from ..operators import membership as M
from ..operators import survival as H
from . import labels as LB
from .core import rounded
from .shapes import FEATURES, _features
from .sql import query

QUERIES, ORACLE = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if sql:
        ORACLE[name] = sql


def _spells(s, d):
    """Customers as members of the priorities of their orders, for up to 400 days from each."""
    o = s.read.parquet(f"{d}/orders.parquet")
    day = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 50 != 0, F.date_add(day, (F.col("o_orderkey") % 400).cast("int")))
    return o.select(F.col("o_orderpriority").alias("index_id"), F.col("o_custkey").alias("security_id"), day.alias("start"), end.alias("end"))


_FAR = "DATE '9999-12-31'"
SPELLS = {
    "sp": f"""SELECT o_orderpriority AS index_id, o_custkey AS security_id, CAST(o_orderdate AS DATE) AS start,
      CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) ELSE {_FAR} END AS stop FROM orders""",
    "mg": """SELECT index_id, security_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY index_id, security_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS spell FROM (
      SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY index_id, security_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp WHERE start < stop)) GROUP BY index_id, security_id, spell""",
    "dy": "SELECT *, lead(day) OVER (PARTITION BY security_id ORDER BY day) AS next FROM (SELECT security_id, start AS day FROM mg UNION SELECT security_id, stop FROM mg)",
    "st": "SELECT d.security_id, d.day, d.next, count(*) AS indices, list(m.index_id ORDER BY m.index_id) AS members FROM dy d JOIN mg m ON m.security_id = d.security_id AND m.start <= d.day AND d.day < m.stop GROUP BY ALL HAVING count(*) >= 2",
}
register("set_7_overlaps", lambda s, d: M.overlaps(_spells(s, d)), query(f'SELECT security_id, day AS start, nullif(next, {_FAR}) AS "end", indices FROM st', extra=SPELLS))
register(
    "set_7_shared_time", lambda s, d: M.shared_time(_spells(s, d), F.lit("2001-01-01").cast("date")),
    query(
        """SELECT security_id, a AS index_a, b AS index_b, sum(greatest(least(next, DATE '2001-01-01') - day, 0))::BIGINT AS days
        FROM (SELECT security_id, day, next, a, unnest(members) AS b FROM (SELECT *, unnest(members) AS a FROM st)) WHERE a < b GROUP BY ALL""", extra=SPELLS,
    ),
)


def _labels(s, d):
    series, z = LB.zoned(s, d)
    return L.barrier_labels(z, series)


_hazards = lambda s, d: H.hazard_table(H.person_periods(_labels(s, d)), ["security_id", "side"])
HAZARD = LB.ALL | {
    "pp": """SELECT security_id, side, unnest(range(1, (CASE WHEN y_hold = 0 AND t_break IS NOT NULL THEN t_break ELSE 5 END - t_touch + 2)::BIGINT)) AS step, t_touch, CASE WHEN y_hold = 0 THEN t_break END AS t_break
      FROM lbl WHERE y_touch = 1 AND n_bars = 5""",
    "ha": "SELECT security_id, side, step, count(*) AS at_risk, count(*) FILTER (t_touch + step - 1 = t_break) AS breaks FROM pp GROUP BY ALL",
    "su": "SELECT *, breaks::DOUBLE / at_risk AS hazard, product(1 - breaks::DOUBLE / at_risk) OVER (PARTITION BY security_id, side ORDER BY step) AS survival FROM ha",
}
register(
    "cmp_8_hazards", _hazards,
    query("SELECT security_id, side, step, at_risk, breaks, round(hazard, 6) AS hazard, round(survival, 6) AS survival, round(coalesce(lag(survival) OVER (PARTITION BY security_id, side ORDER BY step), 1) * hazard, 6) AS p_break FROM su", "zones", extra=HAZARD),
)


def _times(s, d):
    rows = _features(s, d).join(_labels(s, d).drop("side", "y_touch"), list(L.KEY), "left")
    return H.time_to_break(rows, FEATURES, "year(as_of) < 1997").drop("t_break_q50")


register("cmp_8_time_to_break", _times)
_lines = lambda s, d: V.sections(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "", r"[^ \n]*")
# Lines with the newline that ends them; an empty rest after the last newline is none.
LINES = {
    "li": """SELECT doc_id, n, line, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
      SELECT doc_id, unnest(range(len(x))) AS n, unnest(list_transform(x, lambda v, i: CASE WHEN i < len(x) THEN v || chr(10) ELSE v END)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE length(text) > 0)) WHERE line <> ''""",
    "se": "SELECT doc_id, n AS section, regexp_extract(line, '^[^ \\n]*') AS name, coalesce(before, 0)::BIGINT AS start, line AS text FROM li",
    "sc": "SELECT doc_id, section, name, chunk, start + chunk * 200 AS start, substring(text, (chunk * 200 + 1)::INT, 200) AS text FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS chunk FROM se)",
}
register("fn_17_sections", lambda s, d: V.section_chunks(_lines(s, d), 200).withColumn("text", F.md5(F.col("text").cast("binary"))), query("SELECT doc_id, section, name, chunk, start, md5(text) AS text FROM sc", extra=LINES))


def _extracted(s, d):
    """What an extractor might say: quotes of chunks, some turned round, with values and confidences of which some are out of range, for a feature that is known or not."""
    c = V.section_chunks(_lines(s, d), 200)
    quote = F.substring("text", 5, 20)
    quote = F.when(F.col("doc_id") % 5 == 0, F.reverse(quote)).otherwise(quote)
    feature = F.when(F.col("doc_id") % 11 == 0, "mood").when(F.col("doc_id") % 2 == 0, "risk").otherwise("guidance")
    rows = c.select("doc_id", "section", F.when(F.col("doc_id") % 13 == 0, F.col("chunk") + 1000).otherwise(F.col("chunk")).alias("chunk"), feature.alias("feature"), (F.col("doc_id") % 7 / 4.0 - 0.5).alias("value"), (F.col("section") % 6 / 4.0).alias("confidence"), quote.alias("evidence"))
    ranges = s.sql("SELECT * FROM VALUES ('guidance', -1.0D, 1.0D), ('risk', 0.0D, 1.0D) t(feature, low, high)")
    return V.checked(rows, c, F.broadcast(ranges))


EVIDENCE = LINES | {
    "ex": """SELECT doc_id, section, CASE WHEN doc_id % 13 = 0 THEN chunk + 1000 ELSE chunk END AS chunk, CASE WHEN doc_id % 11 = 0 THEN 'mood' WHEN doc_id % 2 = 0 THEN 'risk' ELSE 'guidance' END AS feature,
      doc_id % 7 / 4.0 - 0.5 AS value, section % 6 / 4.0 AS confidence, CASE WHEN doc_id % 5 = 0 THEN reverse(substring(text, 5, 20)) ELSE substring(text, 5, 20) END AS evidence FROM sc""",
    "cr": """SELECT e.*, c.name, c.start AS s, instr(c.text, e.evidence) AS i, CASE WHEN c.text IS NULL THEN 'no chunk' WHEN r.low IS NULL THEN 'unknown feature' WHEN NOT (value BETWEEN low AND high) THEN 'value'
      WHEN NOT (confidence BETWEEN 0 AND 1) THEN 'confidence' WHEN length(evidence) = 0 OR instr(c.text, e.evidence) = 0 THEN 'evidence' END AS reason
      FROM ex e LEFT JOIN sc c USING (doc_id, section, chunk) LEFT JOIN (VALUES ('guidance', -1.0, 1.0), ('risk', 0.0, 1.0)) r(feature, low, high) USING (feature)""",
}
register(
    "fn_17_evidence", lambda s, d: _extracted(s, d).drop("evidence"),
    query('SELECT doc_id, section, chunk, feature, value::DOUBLE AS value, confidence::DOUBLE AS confidence, name, CASE WHEN reason IS NULL THEN s + i - 1 END AS start, CASE WHEN reason IS NULL THEN s + i - 1 + length(evidence) END AS "end", reason FROM cr', extra=EVIDENCE),
)
