"""Queries of the text operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.functions.ids import id_key, id_text
from snapweave.llm.contamination import find_contamination
from snapweave.llm.history_dedup import History, sign
from snapweave.llm.mixing import actual_shares, counted, mix, mixing_plan
from snapweave.llm.sentences import sentence_units
from snapweave.session import read_table, written


def batch_decisions(spark: SparkSession, sf_dir: str, together: int = 4) -> DataFrame:
    """(rec_id, ord, id, kept, reason) of every record: batch 0 accepted whole, later batches against the history so far.

    All batches wait here at once, so ``together`` consecutive ones are taken as one, for fewer jobs; a record repeats the
    earliest it can, so the decisions are those of one batch after the other."""
    signed = written(sign(read_table(spark, sf_dir, "blob_batches"), "rec_id", "batch_no", id_key("blob_id"), "content", extra=["batch_no"]), "signed", ["batch_no"])
    numbers = sorted(r["batch_no"] for r in signed.select("batch_no").distinct().collect())  # one row a batch
    history = History(spark)
    live = read_table(spark, sf_dir, "index_entries").where("deleted_at is null and blob_type <> 'padding'").select(id_key("blob_id").alias("id"))
    history.know_ids(live)
    first = signed.where("batch_no = 0")
    out = first.select("rec_id", "ord", "id", F.lit(None).cast("binary").alias("kept"), F.lit(None).cast("string").alias("reason")).distinct()
    if 0 in numbers:
        history.accept(first.drop("batch_no"))
    later = [n for n in numbers if n > 0]
    for group in (later[i : i + together] for i in range(0, len(later), together)):
        out = out.unionByName(history.add_batch(signed.where(F.col("batch_no").isin(group)).drop("batch_no")))
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that repeat something accepted, with its id."""
    return batch_decisions(spark, sf_dir).where("reason is not null").select("rec_id", id_text("kept").alias("kept_blob_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: in how many documents it leaked, and how much of it at most."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("coverage").alias("most"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The counts, the plan and the chosen documents."""
    counts = counted(read_table(spark, sf_dir, "documents"))
    plan = mixing_plan(counts, read_table(spark, sf_dir, "mix_targets"))
    return counts, plan, mix(counts, plan)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short in the mixture as it comes out: all of their documents are in it as often as they may be."""
    _, plan, chosen = _mixture(spark, sf_dir)
    return actual_shares(chosen, plan).where("short").select("source_name")


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[2].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, plan, chosen = _mixture(spark, sf_dir)
    return actual_shares(chosen, plan)


def p7_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target, whether the cut is where it must be: within the budget, less than one document short of it unless all documents
    are used up, no document more often than allowed, and no two documents of one source more than one copy apart."""
    counts, plan, chosen = _mixture(spark, sf_dir)
    longest = counts.groupBy("source_name").agg(F.max("n_tokens").alias("longest"))
    apart = chosen.groupBy("source_name").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi"))
    out = actual_shares(chosen, plan).join(longest, "source_name", "left").join(apart, "source_name", "left")
    return out.select(
        "source_name", (F.col("tokens") <= F.col("desired")).alias("within"), (F.col("short") | (F.col("tokens") + F.coalesce("longest", F.lit(0)) >= F.floor("desired"))).alias("tight"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), F.coalesce(F.col("hi") - F.col("lo") <= 1, F.lit(True)).alias("even"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(read_table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p6_items": p6_items, "p7_found": p7_found, "p7_chosen": p7_chosen, "p7_shares": p7_shares, "p7_cuts": p7_cuts, "p8_found": p8_found}

SQL = {
    "p7_cuts": "SELECT source_name, true AS within, true AS tight, true AS capped, true AS even FROM mix_targets",
    "p7_found": r"""
WITH d AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS s, sum(length(text)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT source_name, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_targets LEFT JOIN d ON s = source_name)
SELECT source_name FROM t WHERE n * max_repeats < target_share * (SELECT sum(n) FROM t)
""",
}
