"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import stage

#: Groups of more rows than this, and than this share of all rows, are few, and are joined by broadcast.
LARGE_ROWS, LARGE_SHARE = 500, 10_000
#: 64-bit words of the survivor bitmap; with 16 bytes a row its broadcast is bounded by about 2 MB.
BITMAP_WORDS = 1 << 17


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space (space, tab to carriage return) becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _fates(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest: bool) -> DataFrame:
    """doc_id, keep_id, group_size, full (hash of the whole text, null where no other text can be equal) and, with digest,
    text_sha256 of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    pfx = F.xxhash64(F.substring("norm", 1, prefix_chars))
    keys = stage(rows.select(F.length("norm").alias("len"), pfx.alias("pfx")), "dedup-keys")
    pairs = keys.groupBy("len", "pfx").count()
    same_len = pairs.groupBy("len").agg(F.sum("count").alias("rows")).where("rows > 1").select("len")
    same_pfx = pairs.where("count > 1").join(same_len, "len", "left_semi").select("len", "pfx")
    slot = F.pmod(F.xxhash64("len", "pfx"), F.lit(BITMAP_WORDS * 64))
    bitmap = (
        same_pfx.select(slot.alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    )
    scanned = rows.withColumn("len", F.length("norm")).withColumn("pfx", pfx).withColumn("slot", slot)
    survives = F.expr("coalesce((shiftright(bits, cast(slot % 64 as int)) & 1L) = 1L, false)")
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    extra = ["text_sha256"] if digest else []
    hashed = scanned.withColumn("word", F.expr("slot div 64")).join(F.broadcast(bitmap), "word", "left")
    hashed = stage(hashed.select("doc_id", F.when(survives, sha).alias("full"), *([sha.alias("text_sha256")] if digest else [])), "dedup-hashes")
    alone = hashed.where("full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "full", *extra)
    twins = hashed.where("full is not null")
    groups = stage(twins.groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    limit = max(LARGE_ROWS, keys.count() // LARGE_SHARE)
    large, small = groups.where(F.col("group_size") > limit), groups.where(F.col("group_size") <= limit)
    # the rows of a large group stay where they are: there are at most LARGE_SHARE such groups
    in_large = twins.join(F.broadcast(large), "full")
    in_small = twins.join(F.broadcast(large.select("full")), "full", "left_anti").join(small, "full")
    columns = ["doc_id", "keep_id", "group_size", "full", *extra]
    return alone.unionByName(in_large.select(columns)).unionByName(in_small.select(columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept (and text_sha256 with digest=True).

    1. Rows are grouped by normalised length; 2. lengths that repeat are grouped by the hash of their prefix;
    3. only documents whose (length, prefix hash) repeats are hashed in full and grouped by that hash. The surviving
    groups travel to the second scan as a bitmap of fixed size (a broadcast of at most BITMAP_WORDS rows), so texts
    are never shuffled; a false positive of the bitmap merely hashes one more document.

    Nulls: a null text counts as empty; a null id never becomes keep_id while its group has another id. Repeated rows
    (same id and text) count in group_size and share one fate; rows with the same id and other texts have fates of their
    own. Very long texts are hashed where they are. An empty table gives no rows. Other columns, whatever their names, are
    ignored.
    """
    fates = _fates(docs, id_col, text_col, prefix_chars, digest)
    return fates.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *(["text_sha256"] if digest else []))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """The rows of docs, all columns, less the copies: of rows with equal texts one of the smallest id stays.

    Rows are told apart by id and text, so a row goes only if an equal text stays. Of rows with equal texts and ids (null
    ids count as equal) any one stays; a null id stays only where no equal text has an id. Columns of docs may have any
    names that do not begin with bramble_.
    """
    fate = stage(_fates(docs, id_col, text_col, prefix_chars, False).where("group_size > 1"), "dedup-fate")
    named = fate.select(F.col("doc_id").alias("bramble_id"), F.col("full").alias("bramble_full"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    # only rows whose id is marked in a bitmap of fixed size may go: other rows, nearly all, are not shuffled
    slot = F.pmod(F.xxhash64(F.col("bramble_id")), F.lit(BITMAP_WORDS * 64))
    marked = named.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("bramble_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bramble_bits"))
    spot = F.pmod(F.xxhash64(F.col(id_col).cast(fate.schema["doc_id"].dataType)), F.lit(BITMAP_WORDS * 64))
    flag = F.coalesce(F.col("bramble_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bramble_spot") % 64).cast("int"))) != 0, F.lit(False))
    flagged = docs.withColumn("bramble_spot", spot).withColumn("bramble_word", F.expr("bramble_spot div 64")).join(F.broadcast(marked), "bramble_word", "left").withColumn("bramble_flag", flag)
    sure, maybe = flagged.where("not bramble_flag").select(*docs.columns), flagged.where("bramble_flag").select(*docs.columns)
    full = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    same = F.col(id_col).eqNullSafe(F.col("bramble_id")) & (full == F.col("bramble_full"))
    kept = maybe.join(named.where("not kept").drop("kept").distinct(), same, "left_anti")
    again = named.where("kept").groupBy("bramble_id", "bramble_full").count().where("count > 1").drop("count")
    if not again.limit(1).count():
        return sure.unionByName(kept)
    repeats = kept.join(again, same, "left_semi").withColumn("bramble_full", full).dropDuplicates([id_col, "bramble_full"]).drop("bramble_full")
    return sure.unionByName(kept.join(again, same, "left_anti")).unionByName(repeats)
