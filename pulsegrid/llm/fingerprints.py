"""Canonical exact digests, by Spark's own functions only.

Canonical form: NFKC, lower case, runs of white space folded to one space, ends trimmed. The
fingerprint is a 128-bit xxhash of it (two seeds). Inside equal fingerprints the canonical bytes
are compared: where a bucket holds different ones, the SHA-256 of the canonical form is appended. Edited texts are
held against all others by that SHA-256. So equal fingerprints mean equal canonical texts. Digests that are
parted so are hardly ever any; without one, nothing is joined.

Spark has no function for NFKC; it is ICU's, a call of ``reflect`` for each row.

Nulls count as empty texts, which all share one fingerprint. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, width

COARSE = 64
#: Digests that are broadcast at most (32 bytes each); above, the join shuffles.
BROADCAST_DIGESTS = 250_000


def canonical(text: Column) -> Column:
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)))


def collided(docs: DataFrame) -> DataFrame:
    """Digests under which different canonical bytes stand. Only texts that share a digest are compared; least
    and greatest are taken before the shuffle, so a group of copies sends one row per task."""
    hashed = docs.select(canonical(F.col("text")).alias("canon")).select("canon", digest(F.col("canon")).alias("digest"))
    shared = cut(hashed.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    return hashed.join(shared, "digest", "left_semi").groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("digest")


def parted(rows: DataFrame) -> DataFrame:
    """Digests of original or edited texts that stand with different suffixes."""
    both = rows.select("digest", "suffix").unionByName(rows.select(F.col("edited_digest").alias("digest"), F.col("edited_suffix").alias("suffix")))
    return both.groupBy("digest").agg(F.min("suffix").alias("least"), F.max("suffix").alias("most")).where("least <> most").select("digest")


def neighbours(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``next_text`` and ``next_digest``: of the row with the next smaller
    doc_id (after the smallest: of the greatest). Ranges of ids are dealt to buckets; each bucket
    also gets a copy of the first row of the next, so that one shuffle of the texts is enough."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    marks = docs.agg(F.percentile_approx(key, [i / COARSE for i in range(1, COARSE)], 2000).alias("p"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    edges = [marks.lo, *sorted(set(marks.p) - {marks.lo}), marks.hi + 1] if marks.p else [0, 1]
    fine = max(1, -(-2 * width(spark) // (len(edges) - 1)))
    at = F.greatest(F.size(F.filter(F.array(*map(F.lit, edges[:-1])), lambda e: e <= F.col("key"))), F.lit(1))
    lower, upper = (F.element_at(F.array(*map(F.lit, x)), F.col("at")).cast("double") for x in (edges[:-1], edges[1:]))
    within = F.least(F.floor((F.col("key").cast("double") - lower) / (upper - lower) * fine), F.lit(fine - 1)).cast("int")
    dealt = docs.withColumn("key", key).withColumn("at", at).withColumn("bucket", F.col("at") * fine + within).withColumn("tie", F.xxhash64("text"))
    heads = sorted((r.bucket, r.head.key, r.head.tie) for r in dealt.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")).collect())  # one row a bucket
    follows = [(k, t, heads[(i + 1) % len(heads)][0]) for i, (_, k, t) in enumerate(heads)]
    guests = dealt.drop("bucket").join(F.broadcast(spark.createDataFrame(follows, "key long, tie long, bucket int")), ["key", "tie"])
    names = ["doc_id", "text", "digest", "suffix", "key", "tie", "bucket"]
    both = dealt.select(*names, F.lit(0).alias("guest")).unionByName(guests.select(*names, F.lit(1).alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("tie"))
    return both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_digest", F.lead("digest").over(order)).where("guest = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of
    ``docs(doc_id, text)``. The edited text has its last half replaced by the first code points of
    the next document's. Likeness of exact digests is 1 or 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = docs.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", digest(F.col("canon")).alias("digest"), F.sha2("canon", 256).alias("suffix"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        neighbours(hashed)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("next_text", half)))
        .withColumn("edited_canon", canonical(F.col("edited")))
        .select(
            "doc_id", "n_chars", "digest", "suffix", "next_digest",
            F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("edited_canon")).alias("edited_digest"), F.sha2("edited_canon", 256).alias("edited_suffix"),
            F.when(F.col("digest") == F.col("next_digest"), F.sha2(canonical(F.col("next_text")), 256)).alias("next_suffix"),
        )
    )
    edited = cut(edited)
    clash = cut(collided(docs).union(parted(edited)).distinct())
    many = clash.count()
    for name in ("digest", "edited_digest"):
        own = clash.select(F.col("digest").alias(name), F.lit(True).alias(f"{name}_clash"))
        own = F.broadcast(own) if many <= BROADCAST_DIGESTS else own
        edited = edited.join(own, name, "left") if many else edited.withColumn(f"{name}_clash", F.lit(False))
    full = lambda d, s: F.when(F.col(f"{d}_clash"), F.concat(d, F.lit("-"), s)).otherwise(F.col(d))
    same = lambda d, s: ((F.col("digest") == F.col(d)) & (F.col("suffix") == F.col(s))).cast("double")
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", full("digest", "suffix").alias("fingerprint"), full("edited_digest", "edited_suffix").alias("edited_fingerprint"),
        same("edited_digest", "edited_suffix").alias("near_edited"), F.coalesce(same("next_digest", "next_suffix"), F.lit(0.0)).alias("near_next"),
    )
