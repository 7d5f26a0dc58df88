"""Token counts by a two-tier lookup inside map tasks: a broadcast table of frequent pre-tokens, worker caches for the rest."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import worker_cache
from bramble.llm.word_ids import slices, small_batches

#: Entries of the broadcast table: with pre-tokens of at most LONGEST characters, a few MB at any input size.
FREQUENT, LONGEST = 65_536, 48
#: What one task of the counting pass hands on at most; its own counter is pruned to half beyond PRUNE entries.
PER_TASK, PRUNE = 8_192, 200_000
CACHE = 250_000


def _model(path: str):
    models = worker_cache("token_counts").setdefault("models", {})
    if path not in models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
        if any(y == "▁" and x != "▁" for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("a piece crosses the start of a word: counts would not add up over pre-tokens")
        models[path] = model
    return models[path]


def _encoded_lengths(path: str, words: list[str]) -> list[int]:
    return [len(x) for x in _model(path).encode(words, num_threads=1)] if words else []


def _pre_tokens(texts: pa.Array) -> pa.Array:
    """Pieces between spaces. Each stands for a space and the piece: the library puts one space before a text."""
    return pc.split_pattern(texts, " ")


def _plain(texts: pa.Array) -> np.ndarray:
    """Whether a text is cut by single spaces only; others (double, leading, trailing spaces, the space symbol) are encoded whole."""
    odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "▁"))
    odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    return ~odd.to_numpy(zero_copy_only=False).astype(bool)


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): candidates for the broadcast table from a pass over every text.

    Each task counts its own texts and hands on its PER_TASK most frequent pre-tokens, so what is summed afterwards is
    bounded by the number of tasks and not by the number of pre-tokens.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                coded = _pre_tokens(part.column("text").cast(pa.large_string())).flatten().value_counts()
                most = coded.filter(pc.greater(coded.field("counts"), 1))
                seen.update(dict(zip(most.field("values").to_pylist(), most.field("counts").to_pylist(), strict=True)))
                if len(seen) > PRUNE:
                    seen = Counter(dict(seen.most_common(PRUNE // 2)))
        top = [(w, n) for w, n in seen.most_common(PER_TASK) if w and len(w) <= LONGEST and "\0" not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every whole text, as the sentencepiece library counts them.

    No pre-token is shuffled: tier one is a broadcast table of at most FREQUENT pre-tokens with their lengths, tier two a
    bounded cache in each Python worker that encodes misses with the library. A null text counts as empty (no bytes, no
    tokens); a null id is passed on; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    top = frequent_pre_tokens(docs, text_col).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow()
    words = top.column("word").to_pylist()
    # of LONGEST characters at most, so of 4 * LONGEST bytes and tokens and a few: 16 bits hold every length
    lengths = np.asarray(_encoded_lengths(model_path, words), dtype=np.int64)
    if len(lengths) and lengths.max() >= 1 << 16:
        raise ValueError("a frequent pre-token has more tokens than the table can hold")
    table = spark.sparkContext.broadcast(("\0".join(words), lengths.astype("<u2").tobytes()))
    key = uuid.uuid4().hex

    def lookup(words: list[str]) -> np.ndarray:
        kept = worker_cache("token_counts")
        if kept.get("key") != key:
            text, sizes = table.value
            kept.update(key=key, frequent=dict(zip(text.split("\0"), np.frombuffer(sizes, "<u2").tolist(), strict=True)) if text else {}, others={})
        tier1, tier2 = kept["frequent"], kept["others"]
        found = [tier1.get(w) for w in words]
        found = [tier2.get(w) if x is None else x for w, x in zip(words, found, strict=True)]
        missing = [i for i, x in enumerate(found) if x is None]
        if len(tier2) + len(missing) > CACHE:
            tier2.clear()
        for i, n in zip(missing, _encoded_lengths(model_path, [words[i] for i in missing]), strict=True):
            found[i] = n
            if len(tier2) < CACHE and len(words[i]) <= LONGEST:
                tier2[words[i]] = n
        return np.asarray(found, dtype=np.int64)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_string())
                n = np.zeros(len(texts), dtype=np.int64)
                plain = _plain(texts)
                if plain.any():
                    some = texts.filter(pa.array(plain))
                    pieces = _pre_tokens(some)
                    coded = pieces.flatten().dictionary_encode()
                    per = lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
                    ends = np.concatenate([[0], np.cumsum(per)])
                    offsets = pieces.offsets.to_numpy()
                    offsets = offsets - offsets[0]
                    counted = ends[offsets[1:]] - ends[offsets[:-1]]
                    n[plain] = np.where(pc.binary_length(some).to_numpy(zero_copy_only=False) == 0, 0, counted)
                if not plain.all():
                    n[~plain] = _encoded_lengths(model_path, texts.filter(pa.array(~plain)).to_pylist())
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
