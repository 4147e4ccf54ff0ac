"""Line deduplication by range-partitioned line hashes (native: DataFrame functions only).

1. ``hashed_lines``: one row (doc, text version, position, 128-bit key hash) per line whose
   key is long enough.  Texts stay behind; only hashes are shuffled.
2. ``ranged``: the rows are range-partitioned by (hash, slice) and sorted by (hash, slice,
   document descending, position).  ``slice`` is a hash of the document modulo the number
   of partitions, so a line that a third of all documents hold is spread over all
   partitions and no task sees more than its share.
3. ``runs``: a window streams over each sorted run and marks the first occurrence in each
   document; a run is reduced to (documents in it, largest document).  The range
   partitioning already clusters the runs, so this adds no shuffle.
4. Runs are summed per hash; hashes in ``min_docs`` documents or more get their keeper, the
   largest document.  Line rows meet their run on (hash, slice), so the join is as even
   as the range partitioning.
5. ``keep_bitmaps``: the positions a document loses become its keep bitmap, run-length
   compressed: the kept stretches as (start, length).  Documents that lose nothing have none.

Defined results: a null or empty text is one empty line and loses nothing; a null
``doc_id`` loses nothing and counts as no document.  Rows that repeat a ``doc_id`` are one document
when lines are counted; each row keeps its own bitmap by its text.  A line repeated within
its document is dropped or kept in all its places.  Extra columns pass through
``apply_bitmaps`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.llm.common import durable, parallelism, text_of

MIN_CHARS = 40
MIN_DOCS = 5
TRIMMED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def lower_az(t: Column) -> Column:
    """Lower-case A-Z only.  For pure ASCII that is what ``lower`` does, much faster."""
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, UPPER, LOWER))


def lines_of(t: Column) -> Column:
    return F.split(t, "\n", -1)


def hashed_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, pos, h1, h2) per line with a long enough key."""
    t = text_of(text)
    base = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("d"), F.xxhash64(t).alias("version"), F.posexplode(lines_of(lower_az(t))).alias("pos", "line"))
    key = F.trim(F.col("line"), F.lit(TRIMMED))
    return (base.select("d", "version", "pos", key.alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select("d", "version", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(7), F.col("key")).alias("h2")))


def keep_bitmaps(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, n_dropped, keep) for documents that lose lines.

    ``keep`` is the run-length compressed keep bitmap; its last stretch has length -1
    and means "to the end of the text".
    """
    n = parallelism(docs.sparkSession)
    rows = durable(hashed_lines(docs, text, min_chars)
                   .withColumn("slice", F.pmod(F.xxhash64("d"), F.lit(n)).cast("int")))
    ranged = rows.repartitionByRange(n, "h1", "h2", "slice")
    stream = Window.partitionBy(*HASH, "slice").orderBy(F.col("d").desc(), "pos")
    runs = (ranged.sortWithinPartitions("h1", "h2", "slice", F.col("d").desc(), "pos")
            .withColumn("first", F.coalesce(F.lag("d").over(stream) != F.col("d"), F.lit(True)))
            .groupBy(*HASH, "slice")
            .agg(F.max("d").alias("largest"), F.count_if("first").alias("n_docs")))
    # a run is one row per hash and slice: a hash has at most n of them
    total = (runs.groupBy(*HASH).agg(F.max("largest").alias("keeper"), F.sum("n_docs").alias("docs"))
             .where(F.col("docs") >= min_docs).select(*HASH, "keeper"))
    losing = runs.select(*HASH, "slice").join(total, HASH)
    dropped = (rows.join(losing, [*HASH, "slice"]).where(F.col("d") != F.col("keeper"))
               .select("d", "version", "pos"))
    per_doc = (dropped.groupBy("d", "version")
               .agg(F.sort_array(F.collect_set("pos")).alias("p")))
    gaps = F.transform("p", lambda x, i: F.struct(
        (F.coalesce(F.get("p", i - 1), F.lit(-1)) + 1).alias("start"),
        (x - F.coalesce(F.get("p", i - 1), F.lit(-1)) - 1).alias("len")))
    tail = F.array(F.struct((F.element_at("p", -1) + 1).alias("start"), F.lit(-1).alias("len")))
    return per_doc.select(F.col("d").alias("doc_id"), "version", F.size("p").cast("long").alias("n_dropped"),
                          F.concat(F.filter(gaps, lambda g: g["len"] > 0), tail).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut out of ``text``, plus ``__n_dropped``.

    The join carries the texts once; the bitmap side builds the hash table, so texts are
    not sorted.  A text without a bitmap is passed on as it is.
    """
    b = bitmaps.select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"),
                       F.col("n_dropped").alias("__n_dropped"), F.col("keep").alias("__keep"))
    t = text_of(text)
    j = docs.join(b.hint("shuffle_hash"),
                  (F.col("doc_id") == F.col("__d")) & (F.xxhash64(t) == F.col("__v")), "left")
    j = j.withColumn("__lines", F.when(F.col("__keep").isNotNull(), lines_of(t)))
    kept = F.flatten(F.transform("__keep", lambda g: F.slice(
        F.col("__lines"), g["start"] + 1,
        F.when(g["len"] >= 0, g["len"]).otherwise(F.greatest(F.size("__lines") - g["start"], F.lit(0))))))
    j = j.withColumn(text, F.when(F.col("__keep").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)))
    return j.drop("__d", "__v", "__keep", "__lines")


def drop_repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, same columns, without their repeated lines."""
    return apply_bitmaps(docs, keep_bitmaps(docs, text), text).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    d = docs.select("doc_id", "text").withColumn("n_lines", F.size(lines_of(text_of())).cast("long"))
    out = apply_bitmaps(d, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", F.coalesce("__n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                      F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))
