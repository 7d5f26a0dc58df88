"""Raw token-id shards with a minimal perfect hash index: constant-time keyed access to a document's ids.

Format of a folder: `shard-<number>.bin` holds a 16-byte header (magic `TOKIDS01`, bytes per id as u4, zero as u4) and then
raw little-endian ids of its documents in ascending key order; shards ascend too. `index` is a table of one row per hash
bucket: the levels of a minimal perfect hash over the bucket's keys and, in hash order, a 32-bit fingerprint of each key and
the range of its records (shard, first id, number of ids). `shards` has the number of ids of each shard and of all before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bramble.llm.common import shuffle_parts
from bramble.llm.word_ids import encode_batches, small_batches

MAGIC = b"TOKIDS01"
HEADER = 16
#: The key under which a null id is stored.
NULL_KEY = -(1 << 63)
#: Bits per remaining key at each level of the hash.
GAMMA = 2.0
INDEX_SCHEMA = "bucket int, n_keys long, level_sizes binary, levels binary, fingerprints binary, starts binary, shards binary, firsts binary, counts binary"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function (the published splitmix64 finaliser) of int64 or uint64 keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000) & np.uint64(0xFFFFFFFF)).astype("<u4")


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels of a minimal perfect hash over distinct keys: a key sits at the first level where no other
    key that is left shares its bit."""
    levels, left = [], keys
    while len(left):
        size = max(64, int(len(left) * GAMMA))
        at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        left = left[~bits[at]]
    return levels


def hash_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, from 0; -1 for a key that certainly is not in the set (others need the fingerprint)."""
    slots, todo, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for n, bits in enumerate(levels):
        at = (mix(keys[todo], n) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits)
        hit = bits[at]
        slots[todo[hit]] = base + rank[at[hit]] - 1
        todo, base = todo[~hit], base + int(rank[-1])
    return slots


def _bucket(col: str, n: int):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text", ids_per_shard: int = 16_000_000, keys_per_bucket: int = 50_000) -> None:
    """Encode every whole text, write its ids with end_id in ascending order of an integer id, and index them.

    One shuffle of texts by range of id; each task then encodes and streams one shard, written under a name of its attempt
    and moved in place when complete, so a lost executor leaves no half shard. A null text is empty (end_id only); null
    ids come first, under NULL_KEY; repeated ids stay together, ordered by text; an empty table gives an empty folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    parts = max(min(shuffle_parts(spark), size["n"]), (size["b"] or 0) // (3 * ids_per_shard), 1)
    kind = f"<u{id_bytes}"

    def write(batches):
        files, root = _open(folder)
        shard = TaskContext.get().partitionId()
        name, temp = f"{root}/shard-{shard:06d}.bin", f"{root}/.shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        files.create_dir(root)
        at, out = 0, None
        for part, n, ids in encode_batches(tokenizer_path, batches, end_id=end_id):
            if out is None:
                out = files.open_output_stream(temp)
                out.write(MAGIC + struct.pack("<II", id_bytes, 0))
            if len(ids) and int(ids.max()) >= 1 << (8 * id_bytes):
                raise ValueError(f"ids need more than {id_bytes} bytes")
            out.write(ids.astype(kind).tobytes())
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(ends - n), pa.array(n)], ["doc_id", "shard", "first", "n"])
            at = int(ends[-1])
        if out is not None:
            out.close()
            files.move(temp, name)

    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, "doc_id long, shard int, first long, n long").write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    buckets = max(1, -(-size["n"] // keys_per_bucket))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "first"], kind="stable")
        keys, counts = np.unique(pdf.doc_id.to_numpy(), return_counts=True)
        levels = build_hash(keys)
        order = np.argsort(hash_slots(levels, keys))
        first_row = np.cumsum(counts) - counts
        rows = np.concatenate([np.arange(first_row[i], first_row[i] + counts[i]) for i in order]) if (counts > 1).any() else order
        starts = np.concatenate([[0], np.cumsum(counts[order])])
        sizes = np.asarray([len(x) for x in levels], dtype="<i8")
        packed = b"".join(np.packbits(x).tobytes() for x in levels)
        one = [int(pdf.bucket.iloc[0]), len(keys), sizes.tobytes(), packed, fingerprint(keys[order]).tobytes(), starts.astype("<i8").tobytes(), pdf["shard"].to_numpy()[rows].astype("<i4").tobytes(), pdf["first"].to_numpy()[rows].astype("<i8").tobytes(), pdf["n"].to_numpy()[rows].astype("<i8").tobytes()]
        return pd.DataFrame([one], columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    entries.withColumn("bucket", _bucket("doc_id", buckets)).groupBy("bucket").applyInPandas(index, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    totals = entries.groupBy("shard").agg(F.max(F.col("first") + F.col("n")).alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("shard", "n_ids", before.alias("base"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{folder}/shards")


def look_up(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard, first, n) of each record of the distinct keys, by the index alone; unknown keys give no row."""
    index, shards = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/shards")
    row = shards.select("buckets").first()
    buckets = row["buckets"] if row else 1
    wanted = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("doc_id")).distinct().withColumn("bucket", _bucket("doc_id", buckets))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"doc_id": [], "shard": [], "first": [], "n": []})
        r = right.iloc[0]
        levels, at = [], 0
        for size in np.frombuffer(r.level_sizes, "<i8"):
            levels.append(np.unpackbits(np.frombuffer(r.levels, np.uint8, -(-int(size) // 8), at), count=int(size)).astype(bool))
            at += -(-int(size) // 8)
        asked = left.doc_id.to_numpy()
        slots = hash_slots(levels, asked)
        prints = np.frombuffer(r.fingerprints, "<u4")
        good = slots >= 0
        good[good] = prints[slots[good]] == fingerprint(asked[good])
        asked, slots = asked[good], slots[good]
        starts = np.frombuffer(r.starts, "<i8")
        counts = starts[slots + 1] - starts[slots]
        rows = np.repeat(starts[slots] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return pd.DataFrame({"doc_id": np.repeat(asked, counts), "shard": np.frombuffer(r.shards, "<i4")[rows], "first": np.frombuffer(r.firsts, "<i8")[rows], "n": np.frombuffer(r.counts, "<i8")[rows]})

    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "doc_id long, shard int, first long, n long")


def read_token_files(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array of long) of the keys' documents, through the index."""
    return _read(spark, folder, keys, id_col, "ids array<long>", lambda ids: ids.astype(np.int64).tolist())


def read_digests(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As read_token_files, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    return _read(spark, folder, keys, id_col, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


#: Ids of one read at most (a longer document is read by itself), and ids between two documents that a read may pass over.
RUN_IDS, GAP_IDS = 1 << 20, 1 << 14


def _runs(shards: np.ndarray, firsts: np.ndarray, counts: np.ndarray):
    """(shard, first id, end, [(first, n)]) of documents in the order of their places: what stands close together is read at once."""
    shard, low, high, lines = None, 0, 0, []
    for s, first, n in zip(shards.tolist(), firsts.tolist(), counts.tolist(), strict=True):
        if lines and (s != shard or first - high > GAP_IDS or first < low or max(high, first + n) - low > RUN_IDS):
            yield shard, low, high, lines
            lines = []
        if not lines:
            shard, low, high = s, first, first
        high = max(high, first + n)
        lines.append((first, n))
    if lines:
        yield shard, low, high, lines


def _read(spark: SparkSession, folder: str, keys: DataFrame, id_col: str, field: str, of) -> DataFrame:
    name = field.split()[0]

    def payload(frames):
        files, root = _open(folder)
        now, source, size = None, None, 0
        for pdf in frames:
            out = []
            for shard, low, high, lines in _runs(pdf["shard"].to_numpy(), pdf["first"].to_numpy(), pdf["n"].to_numpy()):
                if shard != now:
                    source = files.open_input_file(f"{root}/shard-{shard:06d}.bin")
                    head = source.read(HEADER)
                    if head[:8] != MAGIC:
                        raise ValueError(f"shard {shard} has no header")
                    now, size = shard, struct.unpack("<I", head[8:12])[0]
                ids = np.frombuffer(source.read_at((high - low) * size, HEADER + low * size), f"<u{size}")
                out += [of(ids[first - low : first - low + n]) for first, n in lines]
            yield pdf[["doc_id", "shard", "first", "n"]].assign(**{name: out})

    found = look_up(spark, folder, keys, id_col)
    parts = max(1, spark.read.parquet(f"{folder}/shards").count())
    ranged = found.repartition(parts, "shard").sortWithinPartitions("shard", "first")
    read = ranged.mapInPandas(payload, f"doc_id long, shard int, first long, n long, {field}")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "base")
    return read.join(shards, "shard").select(F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), name)
