"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition packs its own pieces by best fit, largest first. Bins that are nearly full are final; underfull bins become
items, are gathered into fewer partitions and packed again, round by round, until one small partition is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import shuffle_parts, stage
from bramble.llm.word_ids import encode_batches, small_batches

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:int,ids_crc32:bigint>"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents longer than capacity are cut.

    A null text is empty (end_id alone); a null id is passed on; repeated rows give repeated pieces.
    """

    def cut(batches):
        for part, n, ids in encode_batches(tokenizer_path, batches, end_id=end_id):
            per = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())], [c.split()[0] for c in PIECE.split(", ")])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest items first, each into the open bin that it leaves fullest.

    Open bins are kept by residual capacity, with one bit per residual that has a bin, so the tightest fit is found in
    constant time for a given capacity.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    open_at: dict[int, list[int]] = {}
    mask, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = open_at[left]
            b = stack.pop()
            if not stack:
                mask ^= 1 << left
        else:
            b, left, made = made, capacity, made + 1
        bins[i] = b
        left -= size
        if left:
            open_at.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def _packer(capacity: int, rows_at_once: int):
    """A task's packing: items are bins (fill, members); rows_at_once bounds what a task holds."""

    def pack(frames):
        held, n = [], 0
        for pdf in frames:
            held.append(pdf)
            n += len(pdf)
            if n >= rows_at_once:
                yield _pack(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield _pack(pd.concat(held, ignore_index=True))

    def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = best_fit(pdf.fill.to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        cuts = np.flatnonzero(np.diff(bins[order])) + 1
        members = pdf.members.to_numpy()
        return pd.DataFrame({"fill": [int(pdf.fill.to_numpy()[g].sum()) for g in np.split(order, cuts)], "members": [[m for i in g for m in members[i]] for g in np.split(order, cuts)]})

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", slack: int = 8, fan_in: int = 8, rows_at_once: int = 100_000, last_rows: int = 4_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents in sequences of at most capacity tokens.

    A bin with at most `slack` tokens free is final. Each round gathers the other bins into 1 / fan_in as many
    partitions; it stops after one partition has packed all that is left or when a round saves next to nothing. A bin's
    members travel with it (at most capacity of them), so no map of bins is joined. An empty table gives no rows. Rows of
    equal id, and items of equal size, go to any of the bins that fit as well. A very long text is cut into pieces where it
    is encoded. Other columns, whatever their names, are ignored.
    """
    schema = f"fill int, members array<{MEMBER}>"
    single = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    # written once, so that a task holds the tokenizer or a packer, never both
    pieces = stage(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pack-pieces")
    items = pieces.select(F.col("length").alias("fill"), F.array(single).alias("members"))
    pack = _packer(capacity, rows_at_once)
    parts, done, before = shuffle_parts(docs.sparkSession), [], None
    bins = stage(items.mapInPandas(pack, schema), "pack")
    while True:
        done.append(bins.where(F.col("fill") >= capacity - slack))
        open_bins = bins.where(F.col("fill") < capacity - slack)
        left = open_bins.count()
        if left == 0 or (before is not None and (parts == 1 or left > 0.995 * before)):
            done.append(open_bins)
            break
        parts = max(1, -(-left // rows_at_once), min(parts // fan_in, -(-left // last_rows)))
        before = left
        key = F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"])
        bins = stage(open_bins.repartition(parts, key).mapInPandas(pack, schema), "pack")

    all_bins = done[0]
    for more in done[1:]:
        all_bins = all_bins.unionByName(more)

    def number(frames):
        base, n = TaskContext.get().partitionId() << 33, 0
        for pdf in frames:
            sizes = [len(x) for x in pdf.members]
            flat = pd.DataFrame([m if isinstance(m, dict) else m.asDict() for x in pdf.members for m in x])
            if len(flat):
                lengths = flat["length"].to_numpy().astype(np.int64)
                begins = np.cumsum(lengths) - lengths
                first = np.repeat(begins[np.cumsum(sizes) - sizes], sizes)
                yield flat.assign(sequence_id=base + n + np.repeat(np.arange(len(sizes)), sizes), offset=begins - first).astype({"length": np.int64})
            n += len(pdf)

    return all_bins.select("members").mapInPandas(number, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
