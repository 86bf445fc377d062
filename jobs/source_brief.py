"""Job 2, batch: what each source writes about and how it leans, from whole texts.

    python -m jobs.source_brief --documents DOCUMENTS --target OUT [--config FILE]

Of documents with the same normalised text the one with the smallest id stays. Those that stay are scored
by a lexicon with sequence rules and compared by source: a term's lift is its mean TF-IDF in the source
over its mean in all other sources. Digests decide which documents stay, scores are sums by document, and the texts
that stay are placed in blocks, for a table of term counts and weights that the rest reads. The job writes

* ``OUT/kept`` and ``OUT/counts``: the documents that stay, and their terms with counts and weights (none for a term outside the vocabulary),
* ``OUT/scores`` by source: the compound score and label of every document that stays,
* ``OUT/terms`` by source: the first terms by lift (a term that no other source has comes first), then
  document count, then term; lifts are rounded to four digits before they rank,
* ``OUT/briefs``: a row a source with counts, mood (100 x sum of scores over sum of their sizes) and its terms.

All are replaced as a whole, so a rerun gives the same result, and so does one after a failure. A
missing or blank source is named "unknown".
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, new_folder, settings
from tidemark.functions.numbers import exact_sum
from tidemark.functions.scalars import named_source
from tidemark.functions.text import PORTABLE_TOKEN, title_key
from tidemark.operators import blocks, classify, themes
from tidemark.plans.queries import NORM, RULE_SCORES, TFIDF

LOG = logging.getLogger("jobs.source_brief")
DEFAULTS = {
    "terms": 10, "min_documents": 2, "min_df": 2, "positive": 0.05, "negative": -0.05,
    "lexicon": {"the": 0.5, "and": -0.25, "der": 1.0, "que": -1.0, "idiot": -3.0},
    "boosters": {"of": 0.293, "to": 0.293, "in": -0.293, "und": -0.293}, "negations": ["is", "de", "die"], "shift": "that",
}


def first_of_equal(docs: DataFrame) -> DataFrame:
    """(doc_id, source) of the documents that stay: the smallest id of each normalised text. Only digests are shuffled."""
    key = F.sha2(title_key(F.coalesce("text", F.lit("")), decode=False), 256)
    rows = docs.select("doc_id", named_source(F.col("source")).alias("source"), key.alias("key"))
    return rows.groupBy("key").agg(F.min(F.struct("doc_id", "source")).alias("d")).select("d.*")


#: Spark's setting by which a write leaves no shuffle files behind, which stay until the driver's next collection otherwise.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run(spark: SparkSession, documents: str, target: str, cfg: dict = DEFAULTS) -> dict:
    """Write the outputs, each write's shuffle files gone before the next; returns the account."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        return _run(spark, documents, target, cfg)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def _run(spark: SparkSession, documents: str, target: str, cfg: dict) -> dict:
    read, wrote = Observation(), Observation()
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    first_of_equal(docs.observe(read, F.count("*").alias("n"))).write.mode("overwrite").parquet(f"{target}/kept")
    kept = spark.read.parquet(f"{target}/kept")
    lexicon = spark.createDataFrame(list(cfg["lexicon"].items()), "term string, valence double")
    rules = classify.Rules(boosters=cfg["boosters"], negations=tuple(cfg["negations"]), shift=cfg["shift"])
    scores = classify.lexicon_labels(classify.rule_scores(docs, lexicon, rules), cfg["positive"], cfg["negative"])
    scores = scores.join(kept, "doc_id").select("doc_id", "compound", F.col("y_pred").alias("label"), "source")
    scores.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{target}/scores")

    n_docs = kept.count()
    words = blocks.placed(docs.select("doc_id", "text").join(kept.withColumnRenamed("source", "group"), "doc_id"), PORTABLE_TOKEN, None, "text", "group")
    vocabulary = blocks.fitted(blocks.parts(words), n_docs, cfg["min_df"], others=True)
    blocks.weights(words, vocabulary, 1, 2, "group").write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/counts")
    tfidf = spark.read.parquet(f"{target}/counts").where("tfidf is not null")
    sizes = kept.groupBy(F.col("source").alias("group")).agg(F.count("*").alias("rows"))
    lifted = themes.lift_of_groups(tfidf, sizes, cfg["min_documents"], words._blocks)
    ranked = themes.first_terms(lifted.withColumn("lift", F.round("lift", 4)), cfg["terms"]).withColumnRenamed("group", "source")
    ranked.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{target}/terms")

    all_docs = docs.groupBy(named_source(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"))
    back = spark.read.schema("doc_id long, compound double, label string, source string").parquet(f"{target}/scores")
    leaning = back.groupBy("source").agg(
        F.count("*").alias("n_kept"), F.count_if(F.col("label") == "positive").alias("n_positive"), F.count_if(F.col("label") == "negative").alias("n_negative"),
        F.coalesce(F.try_divide(100 * exact_sum(F.col("compound")).cast("double"), F.nullif(exact_sum(F.abs("compound")).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("mood"),
    )
    named = spark.read.schema("rank int, term string, n long, lift double, source string").parquet(f"{target}/terms")
    listed = named.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]), ", ").alias("terms"))  # cfg terms at most
    briefs = all_docs.join(leaning, "source", "left").join(listed, "source", "left").na.fill(0).na.fill("")
    briefs.observe(wrote, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/briefs")
    account = {"read": read.get["n"], "kept": n_docs, "sources": wrote.get["n"]}
    LOG.info("read %(read)d documents, kept %(kept)d, wrote %(sources)d sources", account)
    return account


def output(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/briefs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefs after two runs over the whole table."""
    target = f"{new_folder(spark, 'job2-source-brief')}/out"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", target)
    return output(spark, target).withColumn("mood", F.round("mood", 6))


SQL = f"""WITH scored AS (WITH {RULE_SCORES} SELECT * FROM rule_scores),
named AS (SELECT doc_id, text, coalesce(nullif(trim(source), ''), 'unknown') AS source FROM documents),
d AS (SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256({NORM.replace("lower(text)", "lower(coalesce(text, ''))")}) ORDER BY doc_id, source) AS k FROM named) WHERE k = 1),
{TFIDF.replace("FROM documents", "FROM d")},
g2 AS (SELECT source, count(*) AS rows FROM d GROUP BY source),
own AS (SELECT source, term, count(*) AS n, sum(tfidf) AS s FROM x JOIN d USING (doc_id) GROUP BY ALL),
lifted AS (SELECT source, term, n, CASE WHEN sum(n) OVER t = n THEN 'inf'::DOUBLE
    ELSE round((s / rows) / ((sum(s) OVER t - s) / ((SELECT count(*) FROM d) - rows)), 4) END AS lift FROM own JOIN g2 USING (source) WINDOW t AS (PARTITION BY term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lift DESC, n DESC, term) AS rank FROM lifted WHERE n >= 2),
listed AS (SELECT source, string_agg(term, ', ' ORDER BY rank) AS terms FROM ranked WHERE rank <= 10 GROUP BY source),
sc AS (SELECT d.doc_id, source, compound AS c FROM d JOIN scored USING (doc_id)),
lean AS (SELECT source, count(*) AS n_kept, count(*) FILTER (WHERE c >= 0.05) AS n_positive, count(*) FILTER (WHERE c <= -0.05) AS n_negative, coalesce(100 * sum(c) / nullif(sum(abs(c)), 0), 0) AS mood FROM sc GROUP BY source),
al AS (SELECT source, count(*) AS n_docs FROM named GROUP BY source)
SELECT source, n_docs, coalesce(n_kept, 0) AS n_kept, coalesce(n_positive, 0) AS n_positive, coalesce(n_negative, 0) AS n_negative, round(coalesce(mood, 0), 6) AS mood, coalesce(terms, '') AS terms
FROM al LEFT JOIN lean USING (source) LEFT JOIN listed USING (source)"""


def main() -> None:
    a = arguments(__doc__.splitlines()[0], "source_brief.json", ("documents", "document files"), ("target", "output folder"))
    spark = SparkSession.builder.appName("source_brief").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.documents, a.target, settings(a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
