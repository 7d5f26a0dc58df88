"""Seeded hashes that SQL engines share, and hashes of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash32(seed: int | str, *columns: Column | str) -> Column:
    """Unsigned 32 bits of md5('seed|a|b...') as a long: the same in any engine with md5, whatever the partitioning."""
    parts = [F.lit(str(seed)), *(F.col(c) if isinstance(c, str) else c for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A number in [0, 1) from hash32."""
    return hash32(seed, *columns) / F.lit(4294967296.0)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, each byte sign-extended to 32 bits before it is mixed in."""
    digits = F.hex(F.encode(text, "UTF-8"))
    positions = F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)
    codes = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(positions, lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")))

    def step(h: Column, b: Column) -> Column:
        wide = F.when(b >= 128, b + F.lit(4294967040)).otherwise(b)
        return h.bitwiseXOR(wide) * F.lit(16777619) % F.lit(4294967296)

    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def ngram_bucket(grams: Column, buckets: int) -> Column:
    """Bucket of each n-gram (an array of words): h = h * 116049371 + fnv1a(word), in wrapping 64 bits, modulo the buckets.

    The product is split in two 32-bit halves so that no step overflows a long under ANSI rules.
    """
    low32 = F.lit(4294967295)

    def wrap_mul(h: Column) -> Column:
        m = F.lit(116049371)
        low, high = h["lo"] * m, h["hi"] * m
        return F.struct(low.bitwiseAND(low32).alias("lo"), (high + F.shiftright(low, 32)).bitwiseAND(low32).alias("hi"))

    def add(h: Column, x: Column) -> Column:
        low = h["lo"] + x
        return F.struct(low.bitwiseAND(low32).alias("lo"), (h["hi"] + F.shiftright(low, 32)).bitwiseAND(low32).alias("hi"))

    start = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    total = F.aggregate(grams, start, lambda h, w: add(wrap_mul(h), fnv1a(w)))
    n = F.lit(buckets).cast("long")
    return ((total["hi"] % n) * (F.lit(4294967296) % n) + total["lo"] % n) % n


def signed_feature(gram: Column, size: int) -> Column:
    """(index, sign) of a hashed n-gram: the lowest bit of 32 bits of its md5 gives the sign, the rest the index."""
    h = F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.struct((F.shiftright(h, 1) % size).alias("index"), F.when(h % 2 == 1, 1.0).otherwise(-1.0).alias("sign"))


def fnv1a_array(words: pa.Array) -> np.ndarray:
    """fnv1a of each string of a large_string array without nulls: all words advance by a byte together, longest first."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    # bytes are signed, so that the cast extends their sign
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.int8)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, longer = offsets[:-1][order], np.cumsum(np.bincount(sizes)[::-1])[::-1] if len(sizes) else []
    h = np.full(len(words), 2166136261, dtype=np.uint32)
    for j, n in enumerate(longer[1:]):
        h[:n] ^= data[begin[:n] + j].astype(np.int32).view(np.uint32)
        h[:n] *= np.uint32(16777619)
    out = np.empty(len(words), dtype=np.uint32)
    out[order] = h
    return out


#: Words whose pairs are made and hashed together, about.
WORDS_AT_ONCE = 250_000


def pair_buckets(docs: DataFrame, words: Column, buckets: int) -> DataFrame:
    """(gram, bucket): the distinct pairs of neighbours 'a b' in arrays of words without spaces, with their ngram_bucket.

    A word is hashed once and a pair made once for some documents, as whole arrays; equal pairs of all documents are merged
    by Spark.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            flat, row = lists.flatten(), 0
            while row < len(lists):
                upto = max(row + 1, int(np.searchsorted(ends, ends[row] + WORDS_AT_ONCE, side="right")) - 1)
                some = flat.slice(ends[row], ends[upto] - ends[row]).dictionary_encode()
                known, code = some.dictionary.cast(pa.large_string()), some.indices.to_numpy().astype(np.int64)
                inside = np.ones(max(len(code) - 1, 0), dtype=bool)
                cut = ends[row + 1 : upto] - ends[row] - 1
                inside[cut[(cut >= 0) & (cut < len(inside))]] = False
                met = np.unique((code[:-1] * len(known) + code[1:])[inside])
                a, b = np.divmod(met, max(len(known), 1))
                h = fnv1a_array(known).astype(np.uint64)
                bucket = (h[a] * np.uint64(116049371) + h[b]) % np.uint64(buckets)
                gram = pc.binary_join_element_wise(known.take(pa.array(a)), known.take(pa.array(b)), pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([gram.cast(pa.string()), pa.array(bucket.astype(np.int64))], ["gram", "bucket"])
                row = upto
            pa.default_memory_pool().release_unused()

    return docs.select(words.alias("w")).mapInArrow(pairs, "gram string, bucket long").distinct()
