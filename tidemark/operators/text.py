"""Text preparation and TF-IDF per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tfidf import Packed, pack_groups, weigh_groups

# fixed values: function words of English, French, German and Spanish
STOP_WORDS = tuple("a an and are as at be by for from in is it of on or that the this to was with au aux avec de des du elle en est et il la le les par pas pour que qui sur un une als auf das dem den der die ein eine im ist mit nicht sich und von zu al con del el ella lo los las para por se su y".split())


def clean_text(text: Column, record_id: str = r"cve-\d{4}-\d{4,}") -> Column:
    """G1: lower case; links, record ids, dotted versions, marks and all-digit tokens go; single spaces. What is left are the runs of letters and
    digits with a letter; they are taken at once, since a replacement for each mark and space, and a test for each token, cost most of the time."""
    x = F.lower(text)
    for pattern in (r"https?://\S+|www\.\S+", record_id, r"\b\d+(\.\d+){1,3}\b"):
        x = F.regexp_replace(x, pattern, " ")
    return F.array_join(F.regexp_extract_all(x, F.lit("(?<![0-9])[0-9]*+[a-z][a-z0-9]*+"), F.lit(0)), " ")


def quarter_of(date: Column) -> Column:
    """YYYY-Qn."""
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def prepare_docs(records: DataFrame, canonical: DataFrame, group: Column, text: str = "text", rejected: str | None = None) -> DataFrame:
    """Id, grp, cleaned, label, generic of the records not rejected; unlabelled ones stay, short ones too."""
    kept = records if rejected is None else records.where(F.col("status") != rejected)
    return kept.select("id", group.alias("grp"), clean_text(F.col(text)).alias("cleaned")).join(canonical, "id", "left")


def terms(docs: DataFrame, text: str = "cleaned", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(grp, id, term, tf): words of two characters or more without stop words, and pairs of neighbours among these. docs has a row per
    document, whose sorted terms are counted by their runs within the row, so that no token is shuffled. Nothing filters on the number of terms:
    pushed below the projections, such a filter would clean a text anew for every token."""
    words = F.filter(F.split(F.col(text), " "), lambda t: (F.char_length(t) >= 2) & ~t.isin(*stop_words))
    listed = docs.select("grp", "id", words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))
    both = F.when(F.size("w") >= 2, F.concat("w", pairs)).otherwise(F.col("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = listed.select("grp", "id", F.sort_array(both).alias("t")).select("grp", "id", "t", F.when(F.size("t") > 0, starts).alias("s"))
    counted = F.transform("s", lambda p, k: F.struct(F.get("t", p).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("t")) - p).cast("long").alias("tf")))
    return runs.select("grp", "id", F.inline(counted))


def vocabulary(counts: DataFrame, sizes: DataFrame, min_df: int = 3, max_df: float = 0.5) -> DataFrame:
    """(grp, term, df, idf): terms in at least min_df and at most that part of the group's documents; idf = ln((1 + N) / (1 + df)) + 1."""
    df = counts.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "grp")
    return df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs"))).select("grp", "term", "df", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(grp, id, term, w): tf * idf, scaled to unit length per document. Keys that differ most come first, since rows are sorted by them."""
    raw = counts.join(vocab.select("grp", "term", "idf"), ["term", "grp"]).select("grp", "id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", "grp"))))


def tfidf(docs: DataFrame, min_df: int = 3, max_df: float = 0.5, min_docs: int = 100, text: str = "cleaned") -> DataFrame:
    """Weights (grp, id, term, w) with a vocabulary of its own for every group of min_docs documents or more, all in one job; docs has a row per document."""
    return weigh_groups(docs, min_df, max_df, min_docs, text, STOP_WORDS)


def packed_tfidf(docs: DataFrame, min_df: int = 3, max_df: float = 0.5, min_docs: int = 100, text: str = "cleaned") -> Packed:
    """G4's weights in chunks and parts, for clusters and what measures them."""
    return pack_groups(docs, min_df, max_df, min_docs, text, STOP_WORDS)


def vocab_summary(weights: DataFrame) -> DataFrame:
    """Documents and terms per group."""
    return weights.groupBy("grp").agg(F.count_distinct("id").alias("docs"), F.count_distinct("term").alias("terms"))


def top_terms(weights: DataFrame, n: int = 15) -> DataFrame:
    """Per group the terms with the greatest summed weight (in rounded millionths, so that sums are exact)."""
    total = weights.groupBy("grp", "term").agg(F.sum(F.floor(F.col("w") * 1_000_000 + 0.5)).alias("weight"))
    return total.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("weight"), "term")).cast("long")).where(F.col("place") <= n)


def choose_k(n: Column) -> Column:
    """Clusters for n documents, one per 50 (half-even), at least 10."""
    return F.greatest(F.lit(10).cast("long"), F.bround(n / 50.0).cast("long"))
