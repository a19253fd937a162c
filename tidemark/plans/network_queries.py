"""Queries of the label network and of one label's neighbourhood, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import neighbours as N
from tidemark.operators import network as E
from tidemark.plans.roles import ROLE_SQL, Roles, r

LABEL, PARTNER = "Brand#11/ECONOMY", "Brand#11/STANDARD"


def _q(f):
    return lambda spark, folder: f(Roles(spark, folder))


def bucketed(x):
    return E.buckets(x.affected(), x.records(), x.canonical())


def dense(x):
    """Buckets of customers and years, a denser network."""
    return E.buckets(x.records().select("id", F.col("customer").alias("entity"), F.lit(0).cast("long").alias("item")), x.records(), x.canonical())


def _edges(x):
    return E.cooccurrence(bucketed(x))


def _measures(x):
    return E.label_index(x.canonical()).join(E.degree(_edges(x)), "label", "left").select("label", "frequency", F.coalesce("degree", F.lit(0)).alias("degree"))


def _nb(f):
    return _q(lambda x: f(dense(x)))


QUERIES = {
    "buckets": _q(bucketed),
    "cooccurrence": _q(lambda x: E.cooccurrence(dense(x))),
    "label_index": _q(lambda x: E.label_index(x.canonical())),
    "network_stats": _q(lambda x: E.network_stats(bucketed(x), _edges(x), E.label_index(x.canonical()))),
    "top_pairs": _q(lambda x: E.top_pairs(E.cooccurrence(dense(x)), 10)),
    "degree": _q(lambda x: E.degree(_edges(x))),
    "rank_compare": _q(lambda x: E.rank_compare(_measures(x), "frequency", "degree")),
    "spearman": _q(lambda x: stats.spearman(_measures(x), "frequency", "degree").select("n", stats.rounded(F.col("rho"), 8).alias("rho"))),
    "divergence": _q(lambda x: E.divergence(_measures(x), "frequency", "degree")),
    "prune_top_k": _q(lambda x: E.prune_top_k(_edges(x), 3)),
    "isolated_nodes": _q(lambda x: E.isolated(E.label_index(x.canonical()), E.edges_min_weight(_edges(x), 3))),
    "edges_min_weight": _q(lambda x: E.edges_min_weight(E.cooccurrence(dense(x)), 4)),
    "value_rank": _q(lambda x: E.value_rank(_measures(x), "degree")),
    "nb_carriers": _nb(lambda b: E.carriers(b, LABEL)),
    "nb_pairings": _nb(lambda b: E.pairings(b, LABEL)),
    "nb_summary": _nb(lambda b: E.summary(b, LABEL)),
    "nb_partners": _nb(lambda b: E.partners(b, LABEL)),
    "nb_recent_shift": _nb(lambda b: E.recent_shift(b, LABEL)),
    "nb_drawn": _nb(lambda b: E.drawn(b, LABEL, E.prune_top_k(E.cooccurrence(b), 5))),
    "nb_year_shares": _nb(lambda b: E.year_shares(b, LABEL, 8, 3)),
    "nb_drivers": _nb(lambda b: E.drivers(b, LABEL, PARTNER)),
    "nb_hubs": _nb(lambda b: E.hubs(b, LABEL)),
    "nb_all_carriers": _nb(N.all_carriers),
    "nb_all_pairings": _nb(N.all_pairings),
    "nb_all_summaries": _nb(N.all_summaries),
    "nb_all_partners": _nb(N.all_partners),
    "nb_all_recent_shifts": _nb(N.all_recent_shifts),
    "nb_all_drawn": _nb(lambda b: N.all_drawn(b, E.prune_top_k(E.cooccurrence(b), 5))),
    "nb_all_year_shares": _nb(lambda b: N.all_year_shares(b, 8, 3)),
    "nb_all_drivers": _nb(N.all_drivers),
    "nb_all_hubs": _nb(N.all_hubs),
}

_PAIR = "SELECT a.label AS src, b.label AS dst, count(*) AS weight FROM {0} a JOIN {0} b USING (entity, item, year) WHERE a.label < b.label GROUP BY ALL"
_PRUNE = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM (SELECT src, dst, weight FROM {0} UNION ALL SELECT dst, src, weight FROM {0})) WHERE k <= {1}"
_W = ROLE_SQL + f""", b AS (SELECT DISTINCT entity, item, year, label FROM aff JOIN rec USING (id) JOIN canon USING (id) WHERE NOT generic),
d AS (SELECT DISTINCT customer AS entity, CAST(0 AS BIGINT) AS item, year, label FROM rec JOIN canon USING (id) WHERE NOT generic),
e AS ({_PAIR.format('b')}), ed AS ({_PAIR.format('d')}),
ix AS (SELECT label, count(*) AS frequency FROM canon WHERE NOT generic GROUP BY label),
dg AS (SELECT label, count(*) AS degree FROM (SELECT src AS label FROM e UNION ALL SELECT dst FROM e) GROUP BY label),
ms AS (SELECT label, frequency, coalesce(degree, 0) AS degree FROM ix LEFT JOIN dg USING (label)),
car AS (SELECT entity, item, year FROM d WHERE label = '{LABEL}'),
pr AS (SELECT year, label AS partner, entity, item FROM d JOIN car USING (entity, item, year) WHERE label <> '{LABEL}') """
_ALL = _W + """, ap AS (SELECT a.label, b.label AS partner, entity, item, year FROM d a JOIN d b USING (entity, item, year) WHERE a.label <> b.label),
cy AS (SELECT label, year, count(*) AS carriers FROM d GROUP BY ALL), ct AS (SELECT label, count(*) AS carriers FROM d GROUP BY label),
py AS (SELECT label, partner, year, count(*) AS n FROM ap GROUP BY ALL) """
_RANKS = "SELECT label, frequency, degree, row_number() OVER (ORDER BY frequency DESC, label) AS frequency_rank, row_number() OVER (ORDER BY degree DESC, label) AS degree_rank FROM ms"

ORACLE_SQL = {
    "buckets": _W + "SELECT * FROM b",
    "cooccurrence": _W + "SELECT * FROM ed",
    "label_index": _W + "SELECT *, row_number() OVER (ORDER BY TRY_CAST(nullif(regexp_extract(label, '([0-9]+)$', 1), '') AS BIGINT) NULLS LAST, label) AS position FROM ix",
    "network_stats": _W + f"""SELECT *, {r('100.0 * multi / buckets', 2)} AS multi_pct, {r('100.0 * 2 * edges / (nodes * (nodes - 1))', 2)} AS density_pct FROM
      (SELECT count(*) AS buckets, count(*) FILTER (m > 1) AS multi FROM (SELECT count(*) AS m FROM b GROUP BY entity, item, year)), (SELECT count(*) AS edges, max(weight) AS max_weight FROM e), (SELECT count(*) AS nodes FROM ix)""",
    "top_pairs": _W + "SELECT * FROM ed ORDER BY weight DESC, src, dst LIMIT 10",
    "degree": _W + "SELECT * FROM dg",
    "rank_compare": _W + _RANKS,
    "spearman": _W + f"SELECT count(*) AS n, {r('corr(x, y)', 8)} AS rho FROM (SELECT rank() OVER (ORDER BY frequency) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0 AS x, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS y FROM ms)",
    "divergence": _W + f""", rk AS (SELECT *, frequency_rank - degree_rank AS gap FROM ({_RANKS} WHERE frequency >= 20)) SELECT *, 'above' AS side FROM (FROM rk ORDER BY gap DESC, label LIMIT 10) UNION ALL SELECT *, 'below' FROM (FROM rk ORDER BY gap, label LIMIT 10)""",
    "prune_top_k": _W + _PRUNE.format("e", 3),
    "isolated_nodes": _W + "SELECT label FROM ix WHERE label NOT IN (SELECT src FROM e WHERE weight >= 3 UNION SELECT dst FROM e WHERE weight >= 3)",
    "edges_min_weight": _W + "SELECT * FROM ed WHERE weight >= 4",
    "value_rank": _W + "SELECT *, rank() OVER (ORDER BY degree DESC) AS rank FROM ms",
    "nb_carriers": _W + "SELECT * FROM car",
    "nb_pairings": _W + "SELECT * FROM pr",
    "nb_summary": _W + f"SELECT carriers, partners, shared, {r('100.0 * shared / nullif(carriers, 0)', 2)} AS shared_pct FROM (SELECT count(*) AS carriers FROM car), (SELECT count(DISTINCT partner) AS partners, count(DISTINCT (entity, item, year)) AS shared FROM pr)",
    "nb_partners": _W + f"SELECT partner, count(*) AS shared, min(year) AS first_year, {r('100.0 * count(*) / (SELECT count(*) FROM car)', 2)} AS share_pct FROM pr GROUP BY partner",
    "nb_recent_shift": _W + f""", y AS (SELECT year, n, CASE WHEN k <= 3 THEN 'now' WHEN k <= 6 THEN 'then' END AS w FROM (SELECT year, count(*) AS n, row_number() OVER (ORDER BY year DESC) AS k FROM car GROUP BY year)),
      t AS (SELECT sum(n) FILTER (w = 'now') AS n_now, sum(n) FILTER (w = 'then') AS n_then FROM y), c AS (SELECT partner, count(*) FILTER (w = 'now') AS a, count(*) FILTER (w = 'then') AS b FROM pr LEFT JOIN y USING (year) GROUP BY partner)
      SELECT partner, {r('100.0 * (a / n_now - b / n_then)', 4)} AS shift FROM c, t""",
    "nb_drawn": _W + f", kept AS ({_PRUNE.format('ed', 5)}) SELECT DISTINCT partner, partner IN (SELECT dst FROM kept WHERE src = '{LABEL}' UNION ALL SELECT src FROM kept WHERE dst = '{LABEL}') AS drawn FROM pr",
    "nb_year_shares": _W + f""", y AS (SELECT year, count(*) AS carriers FROM car GROUP BY year HAVING count(*) >= 3), p AS (SELECT partner FROM pr GROUP BY partner ORDER BY count(*) DESC, partner LIMIT 8)
      SELECT p.partner, y.year, coalesce({r('100.0 * (SELECT nullif(count(*), 0) FROM pr WHERE pr.partner = p.partner AND pr.year = y.year) / carriers', 2)}, 0.0) AS share_pct FROM y, p""",
    "nb_drivers": _W + f"SELECT entity, item, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year FROM pr WHERE partner = '{PARTNER}' GROUP BY entity, item",
    "nb_hubs": _W + "SELECT entity, item, count(DISTINCT partner) AS partners, count(DISTINCT year) AS years FROM pr GROUP BY entity, item ORDER BY partners DESC, years DESC, entity, item LIMIT 15",
    "nb_all_carriers": _ALL + "SELECT * FROM cy",
    "nb_all_pairings": _ALL + "SELECT * FROM ap",
    "nb_all_summaries": _ALL + f"""SELECT label, carriers, coalesce(partners, 0) AS partners, coalesce(shared, 0) AS shared, {r('100.0 * coalesce(shared, 0) / carriers', 2)} AS shared_pct FROM ct
      LEFT JOIN (SELECT label, count(DISTINCT partner) AS partners, count(DISTINCT (entity, item, year)) AS shared FROM ap GROUP BY label) USING (label)""",
    "nb_all_partners": _ALL + f"SELECT label, partner, count(*) AS shared, min(year) AS first_year, {r('100.0 * count(*) / any_value(carriers)', 2)} AS share_pct FROM ap JOIN ct USING (label) GROUP BY label, partner",
    "nb_all_recent_shifts": _ALL + f""", y AS (SELECT label, year, carriers, CASE WHEN k <= 3 THEN 'now' WHEN k <= 6 THEN 'then' END AS w FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY year DESC) AS k FROM cy)),
      t AS (SELECT label, sum(carriers) FILTER (w = 'now') AS n_now, sum(carriers) FILTER (w = 'then') AS n_then FROM y GROUP BY label),
      c AS (SELECT label, partner, count(*) FILTER (w = 'now') AS a, count(*) FILTER (w = 'then') AS b FROM ap JOIN y USING (label, year) GROUP BY ALL)
      SELECT label, partner, {r('100.0 * (a / n_now - b / n_then)', 4)} AS shift FROM c JOIN t USING (label)""",
    "nb_all_drawn": _ALL + f", kept AS ({_PRUNE.format('ed', 5)}), kb AS (SELECT src AS label, dst AS partner FROM kept UNION SELECT dst, src FROM kept) SELECT DISTINCT ap.label, ap.partner, kb.label IS NOT NULL AS drawn FROM ap LEFT JOIN kb ON kb.label = ap.label AND kb.partner = ap.partner",
    "nb_all_year_shares": _ALL + f""", p AS (SELECT label, partner FROM (SELECT label, partner, row_number() OVER (PARTITION BY label ORDER BY sum(n) DESC, partner) AS k FROM py GROUP BY label, partner) WHERE k <= 8)
      SELECT p.label, p.partner, cy.year, coalesce({r('100.0 * n / carriers', 2)}, 0.0) AS share_pct FROM p JOIN cy ON cy.label = p.label LEFT JOIN py ON py.label = p.label AND py.partner = p.partner AND py.year = cy.year WHERE carriers >= 3""",
    "nb_all_drivers": _ALL + "SELECT label, partner, entity, item, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year FROM ap GROUP BY ALL",
    "nb_all_hubs": _ALL + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY partners DESC, years DESC, entity, item) AS place FROM (SELECT label, entity, item, count(DISTINCT partner) AS partners, count(DISTINCT year) AS years FROM ap GROUP BY ALL)) WHERE place <= 15",
}
