"""Mixing sources to target shares, with repeats up to a cap per source.

Each document gets its size in tokens once (written, so it is counted once) and a key from a hash of its id. Per source
the plan is: desired = share x budget; taken = the smaller of desired and size x max_repeats; whole epochs first, then
the documents of smallest key until the rest of the source's budget is used up. The prefix sums that find this cut have
two levels: tokens per range of keys, then within the one range in which the cut lies. A source with a third of all
documents is so spread over its ranges, and only one range per source is ever sorted.

The cut is exact to one document: documents are added while the sum stays within the rest. Ties of keys go by id, then by
the row's hash. Null or blank sources belong to no target; names compare trimmed and in lower case; a target without
documents stays in the shares with size 0. Repeated rows count as often as they stand there. Null and empty texts are 0
tokens long. Null shares or repeats count as 0.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.session import BROADCAST_LIMIT, maybe_broadcast, written

#: A public byte-level BPE vocabulary, as ranks; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def source_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


_encoders: dict = {}


def encoder(name: str):
    """The encoder of a vocabulary file that was shipped to the executors under ``name``."""
    if name not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def token_counts(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source_name, n_tokens) of the documents with a source. The vocabulary is read on the driver's side and shipped to the executors."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    shipped = os.path.basename(tokenizer)
    name = source_name(F.col(f"`{source_col}`"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), name.alias("source_name"), F.col(f"`{text_col}`").alias("text")).where("source_name is not null and source_name <> ''")
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "source_name", "n_tokens"])

    return own.mapInArrow(run, f"id {kind}, source_name string, n_tokens long")


def mixing_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source_name, target_share, max_repeats, size, docs, desired, taken, epochs, rest, reachable. Few rows: as many as targets."""
    t = targets.select(source_name(F.col("source_name")).alias("source_name"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source_name is not null")
    sizes = counts.groupBy("source_name").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("docs"))
    plan = t.join(sizes, "source_name", "left").na.fill(0, ["size", "docs"])
    plan = plan.withColumn("desired", F.col("target_share") * F.sum("size").over(Window.partitionBy(F.lit(0))))
    plan = plan.withColumn("reachable", F.col("size") * F.col("max_repeats") >= F.col("desired"))
    plan = plan.withColumn("taken", F.floor(F.least("desired", (F.col("size") * F.col("max_repeats")).cast("double"))).cast("long"))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    return plan.withColumn("epochs", epochs).withColumn("rest", F.col("taken") - F.col("epochs") * F.col("size"))


def mix(counts: DataFrame, plan: DataFrame, seed: int = 11, range_rows: int = 50_000) -> DataFrame:
    """(source_name, id, n_tokens, copies) of the documents chosen at least once.

    The number of key ranges follows the documents, so that a range of all sources together holds about ``range_rows``: that
    is what is sorted in one task per source. The plan and the sums of the ranges are broadcast only if their counted rows are few."""
    plan = written(plan, "plan")
    range_bits = min(30, max(4, math.ceil(math.log2(max(1, counts.count()) / range_rows)) if counts.count() else 4))
    key = F.xxhash64(F.lit(seed), "id")
    df = counts.join(maybe_broadcast(plan.select("source_name", "epochs", "rest"), plan.count() * 100 <= BROADCAST_LIMIT), "source_name").withColumn("key", key)
    df = df.withColumn("range", F.shiftrightunsigned("key", 64 - range_bits))
    sums = df.groupBy("source_name", "range").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))  # sources x 2^range_bits rows
    sums = sums.withColumn("base", F.sum("t").over(Window.partitionBy("source_name").orderBy("range")) - F.col("t"))
    sums = written(sums.select("source_name", "range", "base", ((F.col("rest") > 0) & (F.col("base") + F.col("t") <= F.col("rest"))).alias("whole"), (F.col("base") < F.col("rest")).alias("begins")), "sums")
    df = df.join(maybe_broadcast(sums, sums.count() * 60 <= BROADCAST_LIMIT), ["source_name", "range"])
    cut = df.where("not whole and begins")
    running = F.sum("n_tokens").over(Window.partitionBy("source_name").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("extra", (F.col("base") + running <= F.col("rest")).cast("int"))
    sure = df.where("whole or not begins").withColumn("extra", F.col("whole").cast("int"))
    both = sure.unionByName(cut).withColumn("copies", F.col("epochs") + F.col("extra"))
    return both.where("copies > 0").select("source_name", "id", "n_tokens", "copies")


def actual_shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: what was asked and what came out; ``short`` if every document was repeated as often as it may be and the target was still not reached."""
    got = chosen.join(plan.select("source_name", "max_repeats"), "source_name").groupBy("source_name").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") >= F.col("max_repeats")).alias("full")
    )
    out = plan.select("source_name", "target_share", "max_repeats", "size", "docs", "desired", "reachable").join(got, "source_name", "left").na.fill(0, ["tokens", "n_docs", "most_copies", "full"])
    spent = (F.col("full") == F.col("docs")) | (F.col("max_repeats") <= 0)
    out = out.withColumn("short", spent & (F.col("tokens") < F.col("desired"))).drop("full", "docs")
    return out.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(0)))


def counted(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return written(token_counts(docs, "doc_id", "source", "text", tokenizer), "tokens")
