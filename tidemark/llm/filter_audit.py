"""Filter interaction audit (operator 12): what each filter removes in every order of application.

Documents become a bit mask of the filters they fail, and masks are counted per part: at most 2^filters cells a part, whatever the
corpus. Each cell is folded across the array of all orders with SQL's aggregate and transform, which gives a struct of weighted
counts for each step of each order, and the cells of a part are merged by elementwise sums. Everything is DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
#: Rows of one id are dealt over so many keys when they meet their labels.
SALTS = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, min_words: int = MIN_WORDS, distinct_percent: int = DISTINCT_PERCENT, upper_percent: int = UPPER_PERCENT) -> dict[str, Column]:
    """The filters that look at one text: A too few words, B too few distinct words, C too many capitals, D a symbol."""
    text = F.coalesce(text, F.lit(""))
    listed = F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " ")
    words, distinct = F.size(F.array_remove(listed, "")), F.size(F.array_remove(F.array_distinct(listed), ""))
    return {
        "A": words < min_words,
        "B": 100 * distinct.cast("long") < distinct_percent * words.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > upper_percent * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; the bit after those of `fails` stands for a copy, a text equal to the
    text of a smaller id. labels has (doc_id, quality, toxic); several rows of an id count as their maximum.

    A null text is empty, a null part the empty string; a row without an id has no label, is no copy and makes none. Repeated rows count each.
    Equal texts are those of equal SHA-256. Texts stay where they are read: what is shuffled is a digest, an id and the mask.
    """
    fails = text_failures(F.col(text)) if fails is None else fails
    bits = sum((F.when(c, 2**k).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("bits"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flags = flags.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # both joins merge: by the size of its files Spark would take the flags for small, and broadcast many times that from the driver
    known = rows.join(flags.hint("merge"), ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    # rows of a text with one fate, by id first: then the smallest id's rows are counted without a second look at the others
    kinds = ["digest", "bits", "part", "good", "toxic"]
    each = known.groupBy(*kinds, "id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*kinds).agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
    )
    smallest = groups.groupBy("digest").agg(F.min("first.id").alias("smallest"), F.count(F.lit(1)).alias("groups"))
    # a text of one group alone, which is the rule, brings its smallest id along; a digest has a group per part and label at most
    several = groups.join(smallest.where("groups > 1").select("digest", "smallest").hint("merge"), "digest", "left")
    first = F.coalesce("smallest", "first.id")
    originals = F.col("unnamed") + F.when(F.col("first.id") == first, F.col("first.n")).otherwise(0)
    bit = 2 ** len(fails)
    fates = F.array(F.struct(F.col("bits").alias("mask"), originals.alias("n")), F.struct((F.col("bits") + bit).alias("mask"), (F.col("n") - originals).alias("n")))
    split = several.select("part", "good", "toxic", F.inline(fates)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def fold_orders(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters (a string of all letters) and step, with the COUNTS and shapley, the filter's removals over all orders.

    Bit k of a cell's mask belongs to the k-th letter. An empty table has no parts. A part's cells, 2^filters at most, meet in one row.
    """
    orders = ["".join(p) for p in permutations(letters)]
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    listed = "array(" + ",".join("array(" + ",".join(str(1 << letters.index(x)) for x in o) + ")" for o in orders) + ")"
    step = {
        "kept": "if(NOT s.gone AND mask & b = 0, n, 0L)",
        "removed": "if(NOT s.gone AND mask & b != 0, n, 0L)",
        "redundant": "if(s.gone AND mask & b != 0, n, 0L)",
        "unique_fails": "if(mask = b, n, 0L)",
        "good_lost": "if(NOT s.gone AND mask & b != 0, good, 0L)",
        "toxic_lost": "if(NOT s.gone AND mask & b != 0, toxic, 0L)",
    }
    made = "named_struct(" + ", ".join(f"'{c}', {step[c]}" for c in COUNTS) + ")"
    fold = f"""flatten(transform(orders, o -> aggregate(o, named_struct('gone', false, 'steps', cast(array() AS array<{kind}>)),
        (s, b) -> named_struct('gone', s.gone OR mask & b != 0, 'steps', concat(s.steps, array({made}))), s -> s.steps)))"""
    added = "named_struct(" + ", ".join(f"'{c}', p.{c} + q.{c}" for c in COUNTS) + ")"
    merge = f"aggregate(slice(cells, 2, size(cells)), cells[0], (x, y) -> zip_with(x, y, (p, q) -> {added}))"
    at = "substr(orders[cast(k DIV {n} AS int)], cast(k % {n} AS int) + 1, 1)".format(n=len(letters))
    names = "array(" + ",".join(f"'{o}'" for o in orders) + ")"
    folded = cells.withColumn("orders", F.expr(listed)).select("part", F.expr(fold).alias("steps"))
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.expr(merge).alias("sums"))
    totals = "map_from_entries(transform(array({}), l -> struct(l, aggregate(transform(sums, (x, k) -> if({} = l, x.removed, 0L)), 0L, (a, b) -> a + b))))".format(",".join(f"'{x}'" for x in letters), at)
    shares = merged.withColumn("orders", F.expr(names)).withColumn("shares", F.expr(totals))
    rows = shares.select("part", "orders", "shares", F.posexplode("sums").alias("k", "x"))
    return rows.select(
        "part",
        F.expr(f"orders[cast(k DIV {len(letters)} AS int)]").alias("filter_order"),
        F.expr(f"cast(k % {len(letters)} + 1 AS int)").alias("step"),
        *[F.col(f"x.{c}").alias(c) for c in COUNTS],
        F.expr(f"shares[{at}]").alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of the five filters A to E over all documents, per language: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. Nulls, copies, repeated rows and empty tables: see mask_cells() and fold_orders()."""
    return fold_orders(mask_cells(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > smallest THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
