"""Queries of search, lookup and incremental load, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path
from tidemark.operators import keywords as W
from tidemark.operators import search as S
from tidemark.plans.roles import ROLE_SQL, Roles
from tidemark.streaming import incremental as B

LABELS = ["Brand#11/PROMO", "Brand#12/ECONOMY", "Brand#13/STANDARD"]


def _q(f):
    return lambda spark, folder: f(Roles(spark, folder))


def _events(x):
    return x.table("events").withColumn("day", F.to_date("ts"))


def _upsert(x):
    e = _events(x)
    middle = e.agg(F.percentile_approx("event_id", 0.5).alias("m"))
    old = B.latest(e.join(middle, F.col("event_id") < F.col("m")).drop("m"), "user_id", ["ts", "event_id"])
    new = e.join(middle, F.col("event_id") >= F.col("m")).drop("m")
    return B.upsert(old, new, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _searched(x):
    return S.search(x.records(), affected=x.affected(), entities=[1, 2, 3, 4, 5], canonical=x.canonical(), labels=_some(x), first_year=1996, last_year=1999)


def _some(x):
    return [f"Brand#{b}/{t}" for b in (11, 12, 13, 21, 22, 23) for t in ("ECONOMY", "STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO")]


_LIST = "(" + ", ".join(f"'{v}'" for v in _some(None)) + ")"


def _flat_detail(x):
    d = S.record_detail(x.records(), x.assignments(), x.affected(), x.canonical())
    labels = F.array_join(F.transform("assignments", lambda a: F.concat_ws(":", a["type"], a["label"])), ",")
    products = F.array_join(F.transform("products", lambda p: F.concat_ws(":", p["entity"], p["item"], p["version"])), ",")
    return d.select("id", "canonical", labels.alias("labels"), products.alias("products"))


#: Searches of the index: frequent words, a rare one, one within others, two characters (a scan), one that no text has.
SEARCHES = ["THE of", "Theaea", "onerblend ER", "of", "zzyzx"]


def _indexed(x):
    """All SEARCHES over one index of the documents."""
    path = new_path(x.spark, "keywords")
    W.build_index(x.table("documents").select(F.col("doc_id").alias("id"), "text"), path)
    found = [W.search_index(x.spark, path, words).select(F.lit(words).alias("words"), "id") for words in SEARCHES]
    return reduce(DataFrame.unionByName, found)


QUERIES = {
    "upsert_latest": _q(_upsert),
    "scope_years": _q(lambda x: B.scope(x.records(), 1996, 1997).select("id", "year")),
    "freshness": _q(lambda x: B.freshness(x.records(), "2002-01-01")),
    "release_state": _q(lambda x: B.release_state(x.records().where("year < 1998").select(F.col("date").alias("release")), x.records().select(F.col("date").alias("release")))),
    "ingest_summary": _q(lambda x: B.ingest_summary(x.table("orders"), x.records().where("severity IS NOT NULL"), x.assignments(), x.affected())),
    "search_all": _q(lambda x: _searched(x).select("id", "year", "score")),
    "search_entity": _q(lambda x: S.search(x.records(), affected=x.affected(), entities=[7, 11]).select("id")),
    "search_label": _q(lambda x: S.search(x.records(), canonical=x.canonical(), labels=_some(x)).select("id")),
    "search_missing": _q(lambda x: S.search(x.records(), affected=x.affected(), missing_entity=True).select("id")),
    "search_keywords": _q(lambda x: S.search(x.documents(), words="THE of").select("id")),
    "search_indexed": _q(_indexed),
    "normalize_id": _q(lambda x: x.table("orders").select("o_orderkey", S.normalize_id(F.concat(F.lit(" cve-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.col("o_orderkey").cast("string"))).alias("canonical_id"))),
    "search_severity_page": _q(lambda x: S.page(S.search(x.records(), first_year=1997), "severity", 200).select("id", "score", "date")),
    "search_total": _q(lambda x: S.page_with_total(_searched(x), "newest", 20).select("id", "total")),
    "search_enriched": _q(lambda x: S.enriched(S.page(x.records(), "newest", 200), x.canonical(), x.affected()).select("id", "severity", "label", "entities")),
    "record_detail": _q(_flat_detail),
    "exclude_status": _q(lambda x: S.exclude_status(x.records(), "P").select("id", "status")),
    "clip_years": _q(lambda x: S.clip(x.records(), 1996, 1998).select("id", "year")),
}

_FOUND = f"SELECT * FROM rec WHERE year BETWEEN 1996 AND 1999 AND id IN (SELECT id FROM aff WHERE entity IN (1,2,3,4,5)) AND id IN (SELECT id FROM canon WHERE label IN {_LIST})"

ORACLE_SQL = {
    "upsert_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id >= (SELECT quantile_disc(event_id, 0.5) FROM events) DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "scope_years": ROLE_SQL + " SELECT id, year FROM rec WHERE year BETWEEN 1996 AND 1997",
    "freshness": ROLE_SQL + " SELECT newest, date_diff('day', newest, DATE '2002-01-01') AS gap_days, CASE WHEN newest IS NULL THEN 'all' WHEN date_diff('day', newest, DATE '2002-01-01') <= 8 THEN 'modified' ELSE '2002' END AS feed FROM (SELECT max(date) AS newest FROM rec)",
    "release_state": ROLE_SQL + " SELECT l AS local, u AS upstream, CASE WHEN u IS NULL THEN 'unknown' WHEN l IS NULL THEN 'never' WHEN l >= u THEN 'current' ELSE 'behind' END AS state FROM (SELECT max(date) FILTER (year < 1998) AS l, max(date) AS u FROM rec)",
    "ingest_summary": ROLE_SQL + """ SELECT count(*) AS scanned, count(severity) AS loaded, min(year) FILTER (severity IS NOT NULL) AS first_year, max(year) FILTER (severity IS NOT NULL) AS last_year,
      (SELECT count(DISTINCT id) FROM asg) AS labelled, (SELECT count(DISTINCT id) FROM aff) AS with_item, (SELECT count(DISTINCT entity) FROM aff) AS entities, count(*) - count(severity) AS skipped FROM rec""",
    "search_all": ROLE_SQL + f" SELECT id, year, score FROM ({_FOUND})",
    "search_entity": ROLE_SQL + " SELECT id FROM rec WHERE id IN (SELECT id FROM aff WHERE entity IN (7, 11))",
    "search_label": ROLE_SQL + f" SELECT id FROM rec WHERE id IN (SELECT id FROM canon WHERE label IN {_LIST})",
    "search_missing": ROLE_SQL + " SELECT id FROM rec WHERE NOT EXISTS (SELECT 1 FROM aff WHERE aff.id = rec.id)",
    "search_keywords": ROLE_SQL + " SELECT id FROM docs WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')",
    "search_indexed": ROLE_SQL + " " + " UNION ALL ".join(f"SELECT '{s}' AS words, id FROM docs WHERE " + " AND ".join(f"contains(lower(text), '{w.lower()}')" for w in s.split()) for s in SEARCHES),
    "normalize_id": "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 4 THEN 'CVE-' || year(o_orderdate) || '-' || o_orderkey END AS canonical_id FROM orders",
    "search_severity_page": ROLE_SQL + " SELECT id, score, date FROM rec WHERE year >= 1997 ORDER BY score DESC NULLS LAST, date DESC, id DESC LIMIT 200",
    "search_total": ROLE_SQL + f", f AS ({_FOUND}) SELECT id, (SELECT count(*) FROM f) AS total FROM f ORDER BY date DESC, id DESC LIMIT 20",
    "search_enriched": ROLE_SQL + """, p AS (SELECT * FROM rec ORDER BY date DESC, id DESC LIMIT 200)
      SELECT p.id, coalesce(severity, 'UNSCORED') AS severity, label, (SELECT string_agg(DISTINCT entity, ', ' ORDER BY entity) FROM aff WHERE aff.id = p.id) AS entities FROM p LEFT JOIN canon USING (id)""",
    "record_detail": ROLE_SQL + """ SELECT rec.id, canon.label AS canonical, a.labels, b.products FROM rec LEFT JOIN canon USING (id)
      LEFT JOIN (SELECT id, string_agg(type || ':' || label, ',' ORDER BY type, label) AS labels FROM asg GROUP BY id) a ON rec.id = a.id
      LEFT JOIN (SELECT id, string_agg(entity || ':' || item || ':' || version, ',' ORDER BY entity, item, version) AS products FROM aff GROUP BY id) b ON rec.id = b.id""",
    "exclude_status": ROLE_SQL + " SELECT id, status FROM rec WHERE status <> 'P'",
    "clip_years": ROLE_SQL + " SELECT id, year FROM rec WHERE year BETWEEN 1996 AND 1998",
}
