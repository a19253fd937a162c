"""Queries of the yearly tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import trends as D
from tidemark.plans.roles import ROLE_SQL, Roles, money, r

ORDER = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "UNSCORED")


def _q(f):
    return lambda spark, folder: f(Roles(spark, folder))


def _cover(x):
    return D.coverage_by_year(x.records(), x.affected(), x.assignments())


QUERIES = {
    "canonical_label": _q(lambda x: x.canonical()),
    "assignments_flagged": _q(lambda x: L.assignments_flagged(x.assignments(), x.canonical())),
    "top_k_labels": _q(lambda x: L.with_top_label(x.canonical(), 20).groupBy("top_label").agg(F.count(F.lit(1)).alias("n"))),
    "entity_year_trend": _q(lambda x: D.entity_year_trend(x.records(), x.affected())),
    "entity_rank_by_year": _q(lambda x: D.rank_by_year(D.entity_year_trend(x.records(), x.affected()).select("entity", "year", "n"))),
    "item_year_trend": _q(lambda x: D.item_year_trend(x.records(), x.affected())),
    "label_year_trend": _q(lambda x: D.label_year_trend(x.records(), x.canonical())),
    "severity_year_trend": _q(lambda x: D.severity_year_trend(x.records())),
    "coverage_by_year": _q(_cover),
    "implausible_years": _q(lambda x: D.implausible_years(x.records(), 1996, 2000)),
    "analysis_years": _q(lambda x: D.analysis_years(x.records(), 500)),
    "top_items_in_year": _q(lambda x: D.top_in_year(D.item_year_trend(x.records(), x.affected()))),
    "top_entities_in_year": _q(lambda x: D.top_in_year(D.rank_by_year(D.entity_year_trend(x.records(), x.affected()).select("entity", "year", "n")))),
    "top_overall_entities": _q(lambda x: D.top_overall(D.entity_year_trend(x.records(), x.affected()), "entity", 12)),
    "entity_totals_in_year": _q(lambda x: D.entity_totals(x.affected(), 10, x.records(), 1997)),
    "fastest_growing": _q(lambda x: D.fastest_growing(D.label_year_trend(x.records(), x.canonical()), 1998, 5, 10)),
    "severity_ordered": _q(lambda x: x.records().groupBy(F.coalesce("severity", F.lit("UNSCORED")).alias("severity")).agg(F.count(F.lit(1)).alias("n")).withColumn("place", D.severity_order("severity", ORDER))),
    "year_totals": _q(lambda x: D.latest_years(D.year_totals(x.records()), 5)),
    "snapshot": _q(lambda x: D.snapshot(x.records(), x.affected(), x.canonical(), x.assignments(), 1998, 5)),
    "undercounted_from": _q(lambda x: D.undercounted_from(_cover(x), 98.3)),
    "default_start": _q(lambda x: D.default_start(_cover(x), 0.6)),
    "headline_counts": _q(lambda x: D.headline_counts(x.records(), x.affected(), x.canonical())),
    "top_overall": _q(lambda x: D.top_overall(D.label_year_trend(x.records(), x.canonical()), "label", 15)),
    "coverage_long": _q(lambda x: D.coverage_long(_cover(x))),
    "movers": _q(lambda x: D.movers(D.label_year_trend(x.records(), x.canonical()), "label", "n", 1996, 1999)),
    "entity_totals": _q(lambda x: D.entity_totals(x.affected(), 10)),
    "status_counts": _q(lambda x: D.counts_by_status(x.records(), "P")),
}

_SCORED = f"SELECT entity, year, count(*) AS n, {money('score')} AS total, count(score) AS scored, min(score) AS min_score, max(score) AS max_score FROM (SELECT DISTINCT id, entity FROM aff) JOIN rec USING (id) GROUP BY ALL"
_ITEMS = f"SELECT entity, item, year, count(*) AS n, {r(money('score') + ' / nullif(count(score), 0)', 2)} AS avg_score FROM (SELECT DISTINCT id, entity, item FROM aff) JOIN rec USING (id) GROUP BY ALL"
_LABELS = f"""SELECT label, year, n, {r('100.0 * n / total', 2)} AS pct_of_year, {r('100.0 * (n - lag(n) OVER w) / lag(n) OVER w', 1)} AS yoy_pct
  FROM (SELECT label, year, count(*) AS n FROM canon JOIN rec USING (id) GROUP BY ALL) JOIN (SELECT year, count(*) AS total FROM rec GROUP BY ALL) USING (year) WINDOW w AS (PARTITION BY label ORDER BY year)"""
_COVER = f"""SELECT year, count(*) AS total, count(i.id) AS with_item, count(l.id) AS with_label, {r('100.0 * count(i.id) / count(*)', 1)} AS item_pct, {r('100.0 * count(l.id) / count(*)', 1)} AS label_pct
  FROM rec LEFT JOIN (SELECT DISTINCT id FROM aff) i USING (id) LEFT JOIN (SELECT DISTINCT id FROM asg WHERE NOT generic) l ON rec.id = l.id GROUP BY year"""
_W = ROLE_SQL + f", scored AS ({_SCORED}), items AS ({_ITEMS}), lab AS ({_LABELS}), cover AS ({_COVER}), sev AS (SELECT coalesce(severity, 'UNSCORED') AS severity, year FROM rec) "

ORACLE_SQL = {
    "canonical_label": ROLE_SQL + " SELECT * FROM canon",
    "assignments_flagged": ROLE_SQL + " SELECT a.*, coalesce(a.label = c.label, false) AS is_canonical FROM asg a LEFT JOIN canon c USING (id)",
    "top_k_labels": ROLE_SQL + ", top AS (SELECT label FROM canon WHERE NOT generic GROUP BY label ORDER BY count(*) DESC, label LIMIT 20) SELECT CASE WHEN generic THEN NULL WHEN label IN (FROM top) THEN label ELSE 'Other' END AS top_label, count(*) AS n FROM canon GROUP BY ALL",
    "entity_year_trend": _W + f"""SELECT entity, year, n, {r('total / nullif(scored, 0)', 2)} AS avg_score, min_score, max_score,
      {r('CAST(sum(CAST(total AS DECIMAL(18,2))) OVER f AS DOUBLE) / nullif(sum(scored) OVER f, 0)', 2)} AS rolling_avg_score, {r('100.0 * (n - lag(n) OVER w) / lag(n) OVER w', 1)} AS yoy_pct
      FROM scored WINDOW w AS (PARTITION BY entity ORDER BY year), f AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "entity_rank_by_year": _W + "SELECT entity, year, n, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank_in_year FROM scored",
    "item_year_trend": _W + "SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank_in_year FROM items",
    "label_year_trend": _W + "SELECT * FROM lab",
    "severity_year_trend": _W + f"SELECT year, severity, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY year)', 2)} AS pct_of_year FROM sev GROUP BY year, severity",
    "coverage_by_year": _W + "SELECT * FROM cover",
    "implausible_years": _W + "SELECT count(*) AS n, min(year) AS min_year, max(year) AS max_year FROM rec WHERE year NOT BETWEEN 1996 AND 2000",
    "analysis_years": _W + "SELECT year, count(*) AS total FROM rec GROUP BY year HAVING count(*) >= 500",
    "top_items_in_year": _W + "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank_in_year FROM items) WHERE rank_in_year <= 5 AND year = (SELECT max(year) FROM items)",
    "top_entities_in_year": _W + "SELECT * FROM (SELECT entity, year, n, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank_in_year FROM scored) WHERE rank_in_year <= 5 AND year = (SELECT max(year) FROM scored)",
    "top_overall_entities": _W + "SELECT entity, CAST(sum(n) AS BIGINT) AS n FROM scored GROUP BY entity ORDER BY n DESC, entity LIMIT 12",
    "entity_totals_in_year": _W + "SELECT entity, count(DISTINCT id) AS n FROM aff JOIN rec USING (id) WHERE year = 1997 GROUP BY entity ORDER BY n DESC, entity LIMIT 10",
    "fastest_growing": _W + "SELECT * FROM lab WHERE year = 1998 AND n >= 5 AND yoy_pct IS NOT NULL ORDER BY yoy_pct DESC, label LIMIT 10",
    "severity_ordered": _W + f"SELECT severity, count(*) AS n, CAST(coalesce(list_position({list(ORDER)!r}, severity) - 1, 6) AS BIGINT) AS place FROM sev GROUP BY severity",
    "year_totals": _W + "SELECT year, count(*) AS total FROM rec GROUP BY year ORDER BY year DESC LIMIT 5",
    "snapshot": _W + f"""SELECT c.year, c.total, {r('100.0 * (c.total - b.total) / b.total', 1)} AS change_pct, e.entity AS top_entity, e.n AS top_entity_n, l.label AS fastest_label, l.yoy_pct AS fastest_pct, c.item_pct, {r('c.item_pct - b.item_pct', 1)} AS item_pct_change
      FROM cover c LEFT JOIN cover b ON b.year = c.year - 1 LEFT JOIN (SELECT * FROM scored WHERE year = 1998 ORDER BY n DESC, entity LIMIT 1) e ON true
      LEFT JOIN (SELECT * FROM lab WHERE year = 1998 AND n >= 5 AND yoy_pct IS NOT NULL ORDER BY yoy_pct DESC, label LIMIT 1) l ON true WHERE c.year = 1998""",
    "undercounted_from": _W + "SELECT min(year) AS undercounted_from FROM cover WHERE year > coalesce((SELECT max(year) FROM cover WHERE item_pct >= 98.3), -1)",
    "default_start": _W + "SELECT min(year) AS default_start FROM cover WHERE total >= 0.6 * (SELECT max(total) FROM cover)",
    "headline_counts": _W + """SELECT (SELECT count(*) FROM rec) AS records, (SELECT min(year) FROM rec) AS first_year, (SELECT max(year) FROM rec) AS last_year, (SELECT count(DISTINCT entity) FROM aff) AS entities,
      (SELECT count(*) FROM (SELECT entity FROM aff GROUP BY entity HAVING count(DISTINCT id) >= 20)) AS profiled, (SELECT count(DISTINCT label) FROM canon WHERE NOT generic) AS labels""",
    "top_overall": _W + "SELECT label, CAST(sum(n) AS BIGINT) AS n FROM lab GROUP BY label ORDER BY n DESC, label LIMIT 15",
    "coverage_long": _W + "SELECT year, 'item_pct' AS kind, item_pct AS pct FROM cover UNION ALL SELECT year, 'label_pct', label_pct FROM cover",
    "movers": _W + """, ch AS (SELECT label, a.n AS before, b.n AS after, b.n - a.n AS change FROM (FROM lab WHERE year = 1996) a JOIN (FROM lab WHERE year = 1999) b USING (label))
      SELECT *, 'up' AS direction FROM (FROM ch ORDER BY change DESC, label LIMIT 5) UNION ALL SELECT *, 'down' FROM (FROM ch ORDER BY change, label LIMIT 5)""",
    "entity_totals": _W + "SELECT entity, count(DISTINCT id) AS n FROM aff GROUP BY entity ORDER BY n DESC, entity LIMIT 10",
    "status_counts": _W + "SELECT count(*) AS total, count(*) FILTER (status = 'P') AS rejected, count(*) FILTER (status <> 'P') AS prepared, CAST(0 AS BIGINT) AS near_empty FROM rec",
}
