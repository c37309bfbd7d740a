"""A corpus pipeline over ``documents``: language, toxicity, near duplicates,
personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a table; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsight.llm import jaccard, langid, packing, pii, toxicity
from commsight.llm.common import among, fold, materialize, read, ready

#: Toxicity score from which a document is rejected.
TOXIC = 0.5
#: Ids up to which those that stay are broadcast.
BROADCAST_ROWS = 1_000_000


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, with that language where
    ``lang`` was null; texts without letters and those between two languages
    go."""
    found = langid.annotated(docs, langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select(*[F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias(c) if c == "lang"
                         else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as clean."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.annotated(docs, model).where(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near
    duplicates; rows without id stay unless their text is another's.  An id
    may stand for several texts: each is a document of its own, and of a
    group's rows under its smallest id the least text (by hash) stays.
    Repeated rows stay once; an empty table gives none."""
    ready(spark)
    if jaccard.ids_clash(docs, "doc_id", "text"):
        kept = _of_clashing_ids(docs)
    else:
        groups = materialize(jaccard.similarity_join(docs), "classes")
        firsts = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
        repeated = firsts.where("rows > 1").limit(1).count() > 0
        kept = among(docs, "doc_id", firsts.select("doc_id"), BROADCAST_ROWS)
        if repeated:
            kept = kept.dropDuplicates(["doc_id"])
    if docs.where("doc_id IS NULL").limit(1).count():
        named = docs.where("doc_id IS NOT NULL").select("text").distinct()
        lone = docs.where("doc_id IS NULL").dropDuplicates(["text"])
        kept = kept.unionByName(lone.join(named, lone.text.eqNullSafe(named.text), "left_anti"))
    return kept.select(docs.columns)


def _of_clashing_ids(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id that stay, if rows go by numbers of
    their own instead of by their ids."""
    rows = jaccard.numbered(docs.where("doc_id IS NOT NULL"))
    plain = rows.select("number", F.col("row.text").alias("text"))
    groups = materialize(jaccard.similarity_join(plain, id_col="number"), "classes")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    # Texts without words are linked with nothing: repeats of one id and text
    # are one document all the same.
    group = F.when(F.col("n_shingles") == 0, F.xxhash64("row.doc_id", text)).otherwise(F.col("component_id"))
    ranked = rows.join(groups, "number").select("number", group.alias("g"), (F.col("n_shingles") == 0).alias("blank"),
                                                F.struct("row.doc_id", F.xxhash64(text).alias("h"), "number").alias("o"))
    firsts = ranked.groupBy("g", "blank").agg(F.min("o").alias("o")).select(F.col("o.number").alias("number"))
    return among(rows, "number", materialize(firsts, "firsts"), BROADCAST_ROWS).select("row.*")


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed at the mixture of their sources."""
    return packing.digests(packing.pack(docs))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packed)]

#: Trained models decide what stays: no SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages one after the other, each on a table of what the one before
    kept."""
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
