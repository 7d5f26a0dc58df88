"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, pseudorandom permutations.

The words of a source, its documents in hashed order, form one stream that is cut into blocks of fixed length. Each output
shard draws how many of its slots every source gets; a source's n-th slot takes the block that a keyed permutation of its
block numbers names, pass after pass over its blocks. Only numbers move: texts are cut where they are read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.llm.common import shuffle_parts, stage
from bramble.llm.token_files import mix
from bramble.llm.word_ids import small_batches, trim

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights that repeat over the sources in order, and the most that a target may repeat its source.
WEIGHTS, MOST = (5, 2, 1), 3
#: Groups of shards that the driver draws for at most; blocks that a source has at least (where it has as many words; a
#: twentieth of it where the words themselves are wanted in runs).
GROUPS, BLOCKS = 64, 2_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares of the total by weight; what exceeds `most` times a size is reshared."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, active = {}, float(sum(sizes.values())), list(order)
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in active})
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left = max(0.0, left - sum(out[s] for s in over))
        active = [s for s in active if s not in over]
    return out


def draw_shards(quotas: np.ndarray, slots_per_shard: int, seed: int) -> list[np.ndarray]:
    """Slots of each source in each shard: multinomial draws conditioned on the quotas, which they use up exactly."""
    rng, left, out = np.random.default_rng(seed), quotas.astype(np.int64).copy(), []
    while left.sum():
        need, got = min(slots_per_shard, int(left.sum())), np.zeros_like(left)
        while need:
            free = left - got
            more = np.minimum(rng.multinomial(need, free / free.sum()), free)
            got += more
            need -= int(more.sum())
        left -= got
        out.append(got)
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size), row by row: four Feistel rounds on the next even power of two, walked until in
    range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = value[todo] >> h, value[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right ^ k, r) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo].astype(np.uint64)]
    return value.astype(np.int64)


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, row_col: str | None = None) -> DataFrame:
    """Staged (doc_id, source, size, start): start is the document's first word in its source's stream.

    With row_col, a column that tells rows apart, it comes as row; rows of one id are then placed by their texts.
    A source's order is hash bucket, then id; running sums are taken inside a bucket of bounded size and bucket totals are
    summed on their own, so a source that holds most rows is never one task's work.
    """
    own = [] if row_col is None else [F.xxhash64(text_col).alias("hash"), F.col(row_col).alias("row")]
    by_text, by_row = (["hash"], ["row"]) if own else ([], [])
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *own), "mix-sizes")
    buckets = max(1, sized.count() // 5_000)
    keyed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", *by_text, F.lit(seed)), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", *by_text, *by_row).rowsBetween(Window.unboundedPreceding, -1)
    runs = keyed.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = runs.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return stage(placed.select("doc_id", "source", "size", (F.col("base") + F.col("run")).alias("start"), *by_row), "mix-starts")


def mixed_slots(sized: DataFrame, block_words: int = 64, slots_per_shard: int = 1 << 16, seed: int = 7, least_blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(per source: s, source_size, target, length of its blocks; slots: shard, source, block, in which every slot is one
    block taken).

    A source of few words has shorter blocks, so that whole blocks come near its target. The per-source totals come to the
    driver: one row per source, whatever the number of documents. It draws for at most GROUPS groups of shards; the shards
    of a group are drawn where the group is.
    """
    spark = sized.sparkSession
    sizes = {r["source"]: int(r["words"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    want, order = targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    lengths = [max(1, min(block_words, sizes[s] // least_blocks)) for s in order]
    blocks = np.asarray([-(-sizes[s] // n) for s, n in zip(order, lengths, strict=True)], dtype=np.int64)
    quotas = []
    for s, n, length in zip(order, blocks.tolist(), lengths, strict=True):
        passes, rest = divmod(want[s], sizes[s]) if sizes[s] else (0, 0)
        quotas.append(min(MOST * n, int(passes) * n + min(n, round(rest / length))))
    per_group = slots_per_shard * max(1, -(-sum(quotas) // (slots_per_shard * GROUPS)))
    rows, first = [], np.zeros(len(order), dtype=np.int64)
    for group, got in enumerate(draw_shards(np.asarray(quotas, dtype=np.int64), per_group, seed)):
        rows.append((group, first.tolist(), got.tolist()))
        first += got
    shares = spark.createDataFrame([(s, sizes[s], float(want[s]), n) for s, n in zip(order, lengths, strict=True)], "s string, source_size long, target double, length int")
    groups = spark.createDataFrame(rows, "group int, first array<long>, n array<long>").repartition(shuffle_parts(spark), "group")

    def draw(frames):
        for pdf in frames:
            for group, first, n in zip(pdf.group.tolist(), pdf["first"], pdf.n, strict=True):
                at = np.asarray(first, dtype=np.int64)
                for i, got in enumerate(draw_shards(np.asarray(n, dtype=np.int64), slots_per_shard, seed + 1 + group)):
                    some = np.flatnonzero(got)
                    yield pd.DataFrame({"shard": group * (per_group // slots_per_shard) + i, "number": some, "first": at[some], "n": got[some], "blocks": blocks[some]})
                    at = at + got

    drawn = groups.mapInPandas(draw, "shard int, number int, first long, n long, blocks long")
    slots = drawn.repartition(shuffle_parts(spark), "shard", "number").withColumn("j", F.explode(F.expr("sequence(first, first + n - 1)")))

    def name_blocks(frames):
        for pdf in frames:
            j, size, number = pdf.j.to_numpy(), pdf.blocks.to_numpy(), pdf.number.to_numpy()
            key = mix(number.astype(np.int64) * 1_000_003 + j // size, seed)
            yield pd.DataFrame({"shard": pdf.shard, "source": pd.Series([order[i] for i in number], index=pdf.index, dtype=object), "block": permuted(j % size, size, key)})

    return shares, slots.select("shard", "number", "j", "blocks").mapInPandas(name_blocks, "shard int, source string, block long")


def block_spans(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """(doc_id, source, start, size, block, from_word, n): the words of a document that lie in a block of its source."""
    with_words = sized.where("size > 0").join(F.broadcast(shares.select("s", "length")), F.col("source").eqNullSafe(F.col("s")))
    spans = with_words.withColumn("block", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")))
    low, high = F.greatest("start", F.col("block") * F.col("length")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    return spans.select("doc_id", "source", "start", "size", "block", (low - F.col("start")).alias("from_word"), (high - low).alias("n"))


def taken_words(docs: DataFrame, block_words: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs; taken counts the words that the mix takes of it.

    A null text has no words; rows with a null source form the last source; repeated rows are taken separately; an empty
    table gives no rows; documents without words are taken 0 times. Rows of equal id and size take their places in the
    stream in any order, which changes nothing; a very long text spans many blocks. Other columns, whatever their names, are
    ignored. Reruns on the same rows agree: all draws are keyed by seed, id and position.
    """
    sized = word_sizes(docs, id_col, text_col, source_col, seed)
    shares, slots = mixed_slots(sized, block_words, seed=seed)
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    spans = block_spans(sized, shares)
    # slots grow with the words but are planned from the few rows of the draws: the hint keeps them from being broadcast
    same = spans["source"].eqNullSafe(times["source"]) & (spans["block"] == times["block"])
    took = spans.join(times.hint("merge"), same, "left").select(spans["source"], spans["start"], spans["doc_id"], spans["size"], (F.col("n") * F.coalesce("times", F.lit(0))).alias("words"))
    sums = took.groupBy("source", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
    empty = sized.where("size = 0").select("source", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    rows = sums.unionByName(empty)
    return rows.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix as documents: for each pass over a source, the rows of docs with the words that the pass takes.

    All columns stay; the text holds the taken runs of words as they stand, runs that do not touch parted by a newline,
    and n_chars, if there is such a column, is counted anew. A document that is taken in up to MOST passes gives as many
    rows; one that is not taken gives none. Every row has its own plan, whether its id is null, repeated or not. For this
    the rows are written out once, with a number.
    """
    small_batches(docs.sparkSession)
    rows = stage(docs.withColumn("bramble_row", F.monotonically_increasing_id()), "mix-rows")
    sized = word_sizes(rows, id_col, text_col, source_col, seed, "bramble_row")
    shares, slots = mixed_slots(sized, block_words, seed=seed, least_blocks=BLOCKS // 20)
    times = slots.groupBy("source", "block").agg(F.count("*").cast("int").alias("times"))
    spans = block_spans(sized.withColumn("doc_id", F.col("row")), shares)
    same = spans["source"].eqNullSafe(times["source"]) & (spans["block"] == times["block"])
    taken = spans.join(times.hint("merge"), same).select(spans["doc_id"].alias("bramble_row"), "from_word", "n", "times")
    plans = taken.groupBy("bramble_row").agg(F.sort_array(F.collect_list(F.struct("from_word", "n", "times"))).alias("bramble_plan"))
    planned = rows.join(plans, "bramble_row").drop("bramble_row")
    finder, names = re.compile(r"[^\x20\x09-\x0D]+"), docs.columns

    def cut(batches):
        for batch in batches:
            at, texts = [], []
            for i, (text, plan) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column("bramble_plan").to_pylist(), strict=True)):
                words = [m.span() for m in finder.finditer(text)]
                for turn in range(1, max(p["times"] for p in plan) + 1):
                    runs: list[list[int]] = []
                    for p in plan:
                        if p["times"] >= turn:
                            if runs and runs[-1][1] == p["from_word"]:
                                runs[-1][1] += p["n"]
                            else:
                                runs.append([p["from_word"], p["from_word"] + p["n"]])
                    at.append(i)
                    texts.append(text if runs == [[0, len(words)]] else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
            kept = batch.take(pa.array(at, pa.int64()))
            new = {text_col: pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(t) for t in texts], kept.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, kept.column(c)) for c in names], names)
        trim()

    return planned.mapInArrow(cut, docs.schema)
