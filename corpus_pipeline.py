"""A corpus from documents to packed sequences: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns documents (the last one: sequences). run() applies all.
Texts never cross the network but where a stage says so.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, packing, pii, quality_rules
from tidemark.llm.common import materialize, quoted, table, unused

#: Documents less certain than UNSURE and less like the nearest language than MIXED are rejected (many texts of random letters are; a text of two
#: languages is unsure of one, but like both), and those of WORDS or more that are like none (other scripts and languages are).
#: On the tables at hand no document of a known language is.
UNSURE, MIXED, UNLIKE, WORDS = 0.58, 0.6, 0.3, 12
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: those without text or letter, and those unlike every learned language. The others
    stay as they are, whatever their columns are called. Rows are judged one by one, repeated ones alike; an empty table stays empty."""
    pred, score, like = unused(docs, "lang_pred"), unused(docs, "score"), unused(docs, "likeness")
    found = language.identify(docs, language.fit(docs), pred=pred, score=score, likeness=like)
    unsure = (F.col(score) < UNSURE) & (F.col(like) < MIXED)
    foreign = (F.col(like) < UNLIKE) & (F.size(F.split(F.trim("text"), r"\s+")) >= WORDS)
    return found.filter((F.col(pred) != language.UNKNOWN) & ~unsure & ~foreign).select(quoted(docs.columns))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others stay as they are. A null text has no words and goes; rows are judged
    one by one, repeated ones alike; an empty table stays empty."""
    prefix = "rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return quality_rules.quality(docs, quality_rules.references(docs), prefix=prefix).filter(prefix + "kept").select(quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word Jaccard similarity of 0.8 or more the one with the smallest id stays. SimHash fingerprints
    (operator 5's index) and MinHash bands propose, shingle sets decide.

    Rows that share an id are one document with several texts: all of them stay if one of the texts is the one its group keeps.
    A document without an id stays. Whole texts cross the network here, in the join with the ids that stay."""
    keep = unused(docs, "keep")
    ids = jaccard.near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    kept = docs.join(ids, docs["doc_id"] == ids[keep], "left_semi")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars follows. All rows stay, a null text stays null."""
    return pii.redact(docs, pii.fit(docs)).select(quoted(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Padded sequences in batches of a token budget, from the lengths of all texts in tokens."""
    lengths = packing.with_length(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER)).drop("text")
    return packing.pack(lengths)


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages' models are not SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None
