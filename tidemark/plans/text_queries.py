"""Queries of centrality and of text groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.shared import cut
from tidemark.functions.stats import rounded
from tidemark.operators import centrality as C
from tidemark.operators import forecast as P
from tidemark.operators import network as E
from tidemark.operators import text as G
from tidemark.operators import textclusters as K
from tidemark.plans.network_queries import dense
from tidemark.plans.roles import ROLE_SQL, Roles, r

MIN_DOCS, MIN_SIZE = 20, 15


def _q(f):
    return lambda spark, folder: f(Roles(spark, folder))


def _docs(x):
    d = x.documents()
    return d.select("id", "grp", G.clean_text(F.col("text")).alias("cleaned"))


def _weights(x):
    return G.tfidf(_docs(x), min_docs=MIN_DOCS)


def _held(x):
    """The weights written once, in chunks, for queries that read them several times."""
    if not hasattr(x, "weights"):
        x.weights = G.packed_tfidf(_docs(x), min_docs=MIN_DOCS)
    return x.weights


def _labels(x):
    return x.documents().select("id", "label", "generic")


def _given(x):
    """Documents clustered by language, a given clustering to measure."""
    return x.documents().select("grp", "id", F.col("lang").alias("cluster"))


def _stats(x):
    return K.cluster_label_stats(_given(x), _labels(x)).join(K.cohesion(_held(x), _clustered(x)), ["grp", "cluster"])


def _clustered(x):
    if not hasattr(x, "members"):
        x.members = cut(K.weighed(_held(x)).join(_given(x), ["grp", "id"]), "members")
    return x.members


def _flagged(x):
    return K.flag_clusters(_stats(x).withColumn("cohesion", rounded(F.col("cohesion"), 6)), MIN_SIZE)


def _centrality(x):
    edges = E.cooccurrence(dense(x)).withColumn("key", F.lit(0))
    return C.power_iteration(edges, E.label_index(x.canonical()).select(F.lit(0).alias("key"), "label"))


def _by_year(x):
    b = dense(x)
    edges = _year_edges(b)
    frequency = x.canonical().where(~F.col("generic")).join(x.records().select("id", "year"), "id").groupBy("label", "year").agg(F.count(F.lit(1)).alias("n"))
    return C.centrality_by_year(edges, E.label_index(x.canonical()), b.select("year").distinct(), frequency, shift=1.0)


def _year_edges(b):
    labels = b.groupBy("entity", "item", "year").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    first = labels.select("year", "labels", F.posexplode("labels").alias("at", "src"))
    return first.select("year", "src", F.explode(F.slice("labels", F.col("at") + 2, F.size("labels"))).alias("dst")).groupBy("year", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _degree_by_year(x):
    e = _year_edges(dense(x))
    ends = e.select("year", F.col("src").alias("label")).unionByName(e.select("year", F.col("dst").alias("label")))
    return ends.groupBy("year", "label").agg(F.count(F.lit(1)).alias("degree"))


def _digits(df, **digits):
    """df with columns rounded."""
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


def _node_table(x):
    edges = E.cooccurrence(dense(x))
    return E.node_table(E.label_index(x.canonical()), _digits(_centrality(x), centrality=9), E.prune_top_k(edges, 5))


def _most_central(x):
    return _digits(_centrality(x), centrality=9).orderBy(F.desc("centrality"), "label").limit(10).select("label", "centrality")


def _found_flags(x):
    """G7 to G14 in a chain: clusters found in the weights, measured, flagged and described."""
    weights = _held(x)
    found = K.cluster_docs(weights)
    stats = K.cluster_label_stats(found, _labels(x)).join(K.cohesion(weights, found), ["grp", "cluster"])
    flagged = K.flag_clusters(stats, 5)
    return flagged.join(K.cluster_terms(weights, found), ["grp", "cluster"]).select("grp", "cluster", "size", "cohesion", "uncategorized_rate", "entropy", "flagged", "top_terms")


def _found_silhouette(x):
    weights = _held(x)
    return K.silhouette(weights, K.cluster_docs(weights))


def _found_drift(x):
    """K1 over the clusters that G7 finds and G12 flags; a document's year follows from its id."""
    weights = _held(x)
    found = K.cluster_docs(weights)
    stats_ = K.cluster_label_stats(found, _labels(x)).join(K.cohesion(weights, found), ["grp", "cluster"])
    docs = x.documents().select("id", "grp", "label", (F.lit(2015) + F.pmod("id", F.lit(10))).cast("long").alias("year"))
    return P.drift_score(docs, found, K.flag_clusters(stats_, 5))


def _central_measures(x):
    """Frequency beside the centrality that E6 finds, written once: measures are read several times."""
    return cut(E.label_index(x.canonical()).join(_digits(_centrality(x), centrality=9).select("label", "centrality"), "label").select("label", "frequency", "centrality"), "measures")


def _verified(x):
    edges = E.cooccurrence(dense(x)).withColumn("key", F.lit(0))
    return C.verify_centrality(edges, _centrality(x))


QUERIES = {
    "centrality": _q(lambda x: _digits(_centrality(x), centrality=9, eigenvalue=6, residual=6)),
    "centrality_by_year": _q(lambda x: _digits(_by_year(x), centrality=9, residual=6)),
    "degree_by_year": _q(_degree_by_year),
    "node_table": _q(_node_table),
    "most_central": _q(_most_central),
    "clean_text": _q(lambda x: _docs(x).select("id", "cleaned")),
    "quarter_counts": _q(lambda x: x.records().groupBy(G.quarter_of(F.col("date")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))),
    "prepare_docs": _q(lambda x: G.prepare_docs(x.documents().select("id", "text", "grp"), _labels(x), F.col("grp"))),
    "tfidf_weights": _q(lambda x: _weights(x).select("grp", "id", "term", rounded(F.col("w"), 6).alias("w"))),
    "vocab_summary": _q(lambda x: G.vocab_summary(_weights(x))),
    "top_terms": _q(lambda x: G.top_terms(_weights(x)).select("grp", "term", "place")),
    "choose_k": _q(lambda x: x.documents().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("k", G.choose_k(F.col("n")))),
    "cluster_docs": _q(lambda x: K.cluster_docs(_held(x))),
    "cohesion": _q(lambda x: K.cohesion(_held(x), _clustered(x)).select("grp", "cluster", rounded(F.col("cohesion"), 6).alias("cohesion"))),
    "cluster_label_stats": _q(lambda x: K.cluster_label_stats(_given(x), _labels(x)).withColumn("entropy", rounded(F.col("entropy"), 6))),
    "label_entropy": _q(lambda x: K.cluster_label_stats(_given(x), _labels(x)).select("grp", "cluster", rounded(F.col("entropy"), 6).alias("entropy"))),
    "flag_clusters": _q(lambda x: _flagged(x).select("grp", "cluster", "size", "flagged")),
    "largest_flagged": _q(lambda x: K.largest_flagged(_flagged(x)).select("grp", "cluster", "size")),
    "silhouette": _q(lambda x: K.silhouette(_held(x), _given(x)).select("grp", "documents", rounded(F.col("silhouette"), 6).alias("silhouette"))),
    "found_silhouette": _q(_found_silhouette),
    "found_drift": _q(_found_drift),
    "central_ranks": _q(lambda x: E.value_rank(E.rank_compare(_central_measures(x), "frequency", "centrality"), "centrality")),
    "central_spearman": _q(lambda x: _digits(stats.spearman(_central_measures(x), "frequency", "centrality"), rho=8).select("n", "rho")),
    "central_divergence": _q(lambda x: E.divergence(_central_measures(x), "frequency", "centrality")),
    "found_flags": _q(_found_flags),
    "verify_centrality": _q(lambda x: _digits(_verified(x), max_difference=5, cosine=5)),
    "flag_summary": _q(lambda x: K.flag_summary(_flagged(x))),
    "cluster_terms": _q(lambda x: K.cluster_terms(_held(x), _clustered(x))),
    "trace_records": _q(lambda x: K.trace_records([1, 7, 100, 333], _given(x), _labels(x), _flagged(x), K.cluster_terms(_held(x), _clustered(x))).select("id", "grp", "cluster", "label", "size", "flagged", "top_terms", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))),
}

_STOP = "(" + ", ".join(f"'{w}'" for w in G.STOP_WORDS) + ")"
_CLEAN = "lower(text)"
for _p, _into in (("https?://\\S+|www\\.\\S+", " "), ("cve-\\d{4}-\\d{4,}", " "), ("\\b\\d+(\\.\\d+){1,3}\\b", " "), ("[^a-z0-9\\s]", " "), ("\\s+", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_into}', 'g')"
_W = ROLE_SQL + f""", cl AS (SELECT id, grp, array_to_string(list_filter(string_split(trim({_CLEAN}), ' '), lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ') AS cleaned FROM docs),
ws AS (SELECT grp, id, list_filter(string_split(cleaned, ' '), lambda t: length(t) >= 2 AND t NOT IN {_STOP}) AS w FROM cl WHERE grp IN (SELECT grp FROM docs GROUP BY grp HAVING count(DISTINCT id) >= {MIN_DOCS})),
tf AS (SELECT grp, id, term, count(*) AS tf FROM (SELECT grp, id, unnest(w) AS term FROM ws UNION ALL SELECT grp, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ws) GROUP BY ALL),
nd AS (SELECT grp, count(DISTINCT id) AS n_docs FROM docs GROUP BY grp),
vo AS (SELECT grp, term, ln((1.0 + n_docs) / (1.0 + count(*))) + 1.0 AS idf FROM tf JOIN nd USING (grp) GROUP BY grp, term, n_docs HAVING count(*) >= 3 AND count(*) <= 0.5 * n_docs),
rw AS (SELECT grp, id, term, tf * idf AS w FROM tf JOIN vo USING (grp, term)),
wt AS (SELECT grp, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM rw),
gv AS (SELECT grp, id, lang AS cluster FROM docs), cd AS (SELECT DISTINCT grp, id, cluster FROM wt JOIN gv USING (grp, id)),
ce AS (SELECT grp, cluster, term, sum(w) / any_value(size) AS c FROM wt JOIN cd USING (grp, id) JOIN (SELECT grp, cluster, count(*) AS size FROM cd GROUP BY ALL) USING (grp, cluster) GROUP BY ALL),
co AS (SELECT grp, cluster, {r('sqrt(sum(c * c))', 6)} AS cohesion FROM ce GROUP BY ALL),
lc AS (SELECT grp, cluster, label, count(*) AS n FROM gv JOIN docs USING (id, grp) WHERE label IS NOT NULL AND NOT generic GROUP BY ALL),
en AS (SELECT grp, cluster, -sum(n / t * log2(n / t)) AS entropy, string_agg(label || ':' || n, ', ' ORDER BY k) FILTER (k <= 3) AS top_labels FROM (SELECT *, sum(n) OVER (PARTITION BY grp, cluster) AS t, row_number() OVER (PARTITION BY grp, cluster ORDER BY n DESC, label) AS k FROM lc) GROUP BY ALL),
st AS (SELECT grp, lang AS cluster, count(*) AS size, count(*) FILTER (label IS NOT NULL AND generic) / count(*) AS generic_rate, count(*) FILTER (label IS NULL) / count(*) AS no_label_rate,
  count(*) FILTER (label IS NULL OR generic) / count(*) AS uncategorized_rate, count(DISTINCT label) FILTER (NOT generic) AS n_labels FROM docs GROUP BY ALL),
sx AS (SELECT st.*, {r('coalesce(entropy, 0.0)', 6)} AS entropy, coalesce(top_labels, '') AS top_labels FROM st LEFT JOIN en USING (grp, cluster)),
fl AS (SELECT sx.*, cohesion, cohesion >= quantile_cont(cohesion, 0.75) OVER (PARTITION BY grp) AND (uncategorized_rate >= quantile_cont(uncategorized_rate, 0.75) OVER (PARTITION BY grp) OR entropy >= quantile_cont(entropy, 0.75) OVER (PARTITION BY grp)) AND size >= {MIN_SIZE} AS flagged FROM sx JOIN co USING (grp, cluster)),
ct AS (SELECT grp, cluster, string_agg(term, ', ' ORDER BY k) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY grp, cluster ORDER BY {r('c', 9)} DESC, term) AS k FROM ce) WHERE k <= 8 GROUP BY ALL) """



def _iterated(edges: str, nodes: str, shift: float) -> str:
    """Power iteration in SQL over edges(key, src, dst, w) and nodes(key, label): `fi` has the last vectors, `ev` eigenvalues and residuals.
    Every node is its own neighbour, by which its last value comes along."""
    return ROLE_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", dd AS (SELECT DISTINCT customer, year, label FROM rec JOIN canon USING (id) WHERE NOT generic),
ix AS (SELECT label, count(*) AS frequency FROM canon WHERE NOT generic GROUP BY label),
ed AS ({edges}), no AS ({nodes}),
am AS (SELECT key, src, dst, CAST(w AS DOUBLE) AS w, false AS me FROM ed UNION ALL SELECT key, dst, src, w, false FROM ed UNION ALL SELECT key, label, label, {shift}, true FROM no),
it AS (SELECT key, 0 AS step, label, 1 / sqrt(count(*) OVER (PARTITION BY key)) AS x, CAST('infinity' AS DOUBLE) AS moved FROM no UNION ALL
  SELECT key, step + 1, label, x, sqrt(sum((x - old) * (x - old)) OVER (PARTITION BY key)) FROM (SELECT key, step, label, old, coalesce(y / nullif(sqrt(sum(y * y) OVER (PARTITION BY key)), 0), 0) AS x FROM
    (SELECT am.key, step, am.dst AS label, sum(w * x) AS y, max(x) FILTER (me) AS old FROM it JOIN am ON am.key = it.key AND am.src = it.label WHERE step < 100 AND moved >= 1e-8 GROUP BY ALL))),
fi AS (SELECT key, label, x, moved < 1e-8 AS converged FROM it QUALIFY step = max(step) OVER (PARTITION BY key)),
ap AS (SELECT fi.key, am.dst AS label, sum(CASE WHEN me THEN 0 ELSE w * x END) AS y, max(x) FILTER (me) AS x FROM fi JOIN am ON am.key = fi.key AND am.src = fi.label GROUP BY ALL),
va AS (SELECT key, coalesce(sum(x * y) / nullif(sum(x * x), 0), 0) AS v FROM ap GROUP BY key),
ev AS (SELECT key, v, sqrt(sum((y - v * x) * (y - v * x))) AS residual FROM ap JOIN va USING (key) GROUP BY ALL),
pa AS (SELECT a.label AS src, b.label AS dst, count(*) AS weight FROM dd a JOIN dd b USING (customer, year) WHERE a.label < b.label GROUP BY ALL) """


_ALL = _iterated("SELECT 0 AS key, a.label AS src, b.label AS dst, count(*) AS w FROM dd a JOIN dd b USING (customer, year) WHERE a.label < b.label GROUP BY ALL", "SELECT 0 AS key, label FROM ix", 0.0)
_YEARS = _iterated("SELECT year AS key, a.label AS src, b.label AS dst, count(*) AS w FROM dd a JOIN dd b USING (customer, year) WHERE a.label < b.label GROUP BY ALL", "SELECT key, label FROM (SELECT DISTINCT year AS key FROM dd), ix", 1.0)
_MEASURES = _ALL + f", ms AS (SELECT label, frequency, {r('x', 9)} AS centrality FROM ix JOIN fi USING (label))"
_KEPT = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM (SELECT src, dst, weight FROM pa UNION ALL SELECT dst, src, weight FROM pa)) WHERE k <= 5"

ORACLE_SQL = {
    "centrality": _ALL + f"SELECT key, label, {r('x', 9)} AS centrality, {r('v', 6)} AS eigenvalue, {r('residual', 6)} AS residual, converged FROM fi JOIN ev USING (key)",
    "centrality_by_year": _YEARS + f"""SELECT fi.label, fi.key AS year, {r('x', 9)} AS centrality, coalesce(degree, 0) AS degree, coalesce(n, 0) AS frequency, converged, {r('residual', 6)} AS residual FROM fi JOIN ev USING (key)
      LEFT JOIN (SELECT key, label, count(*) AS degree FROM (SELECT key, src AS label FROM ed UNION ALL SELECT key, dst FROM ed) GROUP BY ALL) d ON d.key = fi.key AND d.label = fi.label
      LEFT JOIN (SELECT label, year, count(*) AS n FROM canon JOIN rec USING (id) WHERE NOT generic GROUP BY ALL) f ON f.year = fi.key AND f.label = fi.label""",
    "most_central": _MEASURES + " SELECT label, centrality FROM ms ORDER BY centrality DESC, label LIMIT 10",
    "node_table": _MEASURES + f", dg AS (SELECT label, count(*) AS degree FROM (SELECT src AS label FROM ({_KEPT}) UNION ALL SELECT dst FROM ({_KEPT})) GROUP BY label) SELECT label, frequency, centrality, coalesce(degree, 0) AS degree, degree IS NULL AS is_isolated FROM ms LEFT JOIN dg USING (label)",
    "central_ranks": _MEASURES + " SELECT label, frequency, centrality, row_number() OVER (ORDER BY frequency DESC, label) AS frequency_rank, row_number() OVER (ORDER BY centrality DESC, label) AS centrality_rank, rank() OVER (ORDER BY centrality DESC) AS rank FROM ms",
    "central_spearman": _MEASURES + f" SELECT count(*) AS n, {r('corr(a, b)', 8)} AS rho FROM (SELECT rank() OVER (ORDER BY frequency) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0 AS a, rank() OVER (ORDER BY centrality) + (count(*) OVER (PARTITION BY centrality) - 1) / 2.0 AS b FROM ms)",
    "central_divergence": _MEASURES + """, rk AS (SELECT label, frequency, centrality, row_number() OVER (ORDER BY frequency DESC, label) AS frequency_rank, row_number() OVER (ORDER BY centrality DESC, label) AS centrality_rank FROM ms WHERE frequency >= 20),
      gp AS (SELECT *, frequency_rank - centrality_rank AS gap FROM rk)
      (SELECT *, 'above' AS side FROM gp ORDER BY gap DESC, label LIMIT 10) UNION ALL (SELECT *, 'below' FROM gp ORDER BY gap, label LIMIT 10)""",
    "verify_centrality": _ALL + "SELECT 0 AS key, count(*) AS nodes, CAST(0 AS DOUBLE) AS max_difference, CAST(1 AS DOUBLE) AS cosine, true AS agrees FROM ix",
    "degree_by_year": ROLE_SQL + """, d AS (SELECT DISTINCT customer, year, label FROM rec JOIN canon USING (id) WHERE NOT generic), e AS (SELECT DISTINCT year, a.label AS x, b.label AS y FROM d a JOIN d b USING (customer, year) WHERE a.label <> b.label)
      SELECT year, x AS label, count(*) AS degree FROM e GROUP BY ALL""",
    "clean_text": _W + "SELECT id, cleaned FROM cl",
    "quarter_counts": ROLE_SQL + " SELECT year || '-Q' || quarter(date) AS quarter, count(*) AS n FROM rec GROUP BY ALL",
    "prepare_docs": _W + "SELECT id, cl.grp, cleaned, label, generic FROM cl JOIN docs USING (id)",
    "tfidf_weights": _W + f"SELECT grp, id, term, {r('w', 6)} AS w FROM wt",
    "vocab_summary": _W + "SELECT grp, count(DISTINCT id) AS docs, count(DISTINCT term) AS terms FROM wt GROUP BY grp",
    "top_terms": _W + "SELECT grp, term, place FROM (SELECT grp, term, row_number() OVER (PARTITION BY grp ORDER BY sum(floor(w * 1000000 + 0.5)) DESC, term) AS place FROM wt GROUP BY grp, term) WHERE place <= 15",
    "choose_k": ROLE_SQL + " SELECT lang, count(*) AS n, greatest(10, CAST(round_even(count(*) / 50.0, 0) AS BIGINT)) AS k FROM docs GROUP BY lang",
    "cohesion": _W + "SELECT * FROM co",
    "cluster_label_stats": _W + "SELECT * FROM sx",
    "label_entropy": _W + "SELECT grp, cluster, entropy FROM sx",
    "flag_clusters": _W + "SELECT grp, cluster, size, flagged FROM fl",
    "largest_flagged": _W + "SELECT grp, cluster, size FROM fl WHERE flagged ORDER BY size DESC, grp, cluster LIMIT 15",
    "flag_summary": _W + "SELECT grp, count(*) AS clusters, count(*) FILTER (flagged) AS flagged FROM fl GROUP BY grp",
    "cluster_terms": _W + "SELECT * FROM ct",
    "trace_records": _W + ", mb AS (SELECT grp, cluster, string_agg(id, ',' ORDER BY id) AS members FROM (SELECT grp, cluster, id, row_number() OVER (PARTITION BY grp, cluster ORDER BY id) AS k FROM gv WHERE id NOT IN (1, 7, 100, 333)) WHERE k <= 5 GROUP BY ALL) SELECT id, gv.grp, gv.cluster, docs.label, fl.size, fl.flagged, top_terms, members FROM gv JOIN docs USING (id) LEFT JOIN fl ON fl.grp = gv.grp AND fl.cluster = gv.cluster LEFT JOIN ct ON ct.grp = gv.grp AND ct.cluster = gv.cluster LEFT JOIN mb ON mb.grp = gv.grp AND mb.cluster = gv.cluster WHERE id IN (1, 7, 100, 333)",
}
