"""Frequency matcher: a row's key gives the labels seen with it at least as often as the key's average; unknown keys fall
back to the most similar known key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bramble.functions import text as T
from bramble.operators.labels import _numbered
from bramble.operators.metrics import micro
from bramble.operators.topk import top_k
from bramble.plans.shared import stage


def train(doc_keys: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(key, label, n)."""
    return doc_keys.join(doc_labels, "doc_id").groupBy("key", "label").agg(F.count("*").alias("n"))


def above_average(model: DataFrame) -> DataFrame:
    """Labels whose count reaches the average count of their key."""
    mean = F.avg("n").over(Window.partitionBy("key"))
    return model.withColumn("mean", mean).where(F.col("n") >= F.col("mean")).drop("mean")


def most_frequent(model: DataFrame, k: int) -> DataFrame:
    """The other variant: the k labels most frequent with a key, with their conditional frequency."""
    share = model.withColumn("score", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 9))
    return top_k(share, k, by="key")


def key_vectors(keys: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """(key, gram, weight): unit TF-IDF vectors of the character n-grams of a key."""
    return _key_vectors(keys, least, most, "gram")


#: Different n-grams up to which their counts are sent to all tasks.
FEW_GRAMS = 100_000


def _key_vectors(keys: DataFrame, least: int, most: int, name: str, *more: str) -> DataFrame:
    """(key, more, name, weight) of key_vectors; the name of a gram is itself ("gram") or a dense number ("gid").

    What is sent to all tasks is one row for each different gram, if these are few. The rows of keys are never sent, however
    small their files look to Spark."""
    grams = stage(keys.select("key", *more, F.explode(T.char_ngrams(F.lower("key"), least, most)).alias("gram")).groupBy("key", *more, "gram").agg(F.count("*").alias("tf")), "grams")
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    if name == "gid":
        df = _numbered(df, ["gram"], "gid").withColumn("gid", F.col("gid").cast("int"))
    df = stage(df, "held")
    n = keys.agg(F.count("*").alias("total"))
    rows = grams.join(df.hint("broadcast" if df.count() <= FEW_GRAMS else "merge"), "gram").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return rows.select("key", *more, name, (F.col("w") / length).alias("weight"))


def candidate_keys(a: DataFrame, k: DataFrame, champions: int = 8) -> DataFrame:
    """(key, nearest): pairs among which is the most similar known key of each asked key, from unit vectors a(key, gram,
    weight) and k(nearest, gram, w).

    The known keys of the largest weights in each gram are compared first; the best similarity among them is a bound. Of
    an asked key's grams, those held by most known keys are then set aside as long as all of them together, at their
    largest weights, stay below the bound: a key that shares no other gram cannot be the best. So a gram that every key
    holds makes no pairs, whatever the number of keys.
    """
    lists = top_k(k, champions, by="gram", score="w", tie="nearest").select("nearest", "gram")
    first = stage(a.select("key", "gram").join(lists, "gram").select("key", "nearest").distinct(), "first")
    bound = similarities(first, a, k).groupBy("key").agg(F.max("similarity").alias("bound"))
    held = k.groupBy("gram").agg(F.max("w").alias("most"), F.count("*").alias("df"))
    # a key has few grams: the window stays within it
    usual = Window.partitionBy("key").orderBy(F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = a.join(held, "gram").withColumn("reach", F.sum(F.col("weight") * F.col("most")).over(usual))
    asked = reach.join(bound, "key").where(F.col("reach") >= F.col("bound") - 2e-9).select("key", "gram")
    return first.unionByName(asked.join(k.select("nearest", "gram"), "gram").select("key", "nearest")).distinct()


def similarities(pairs: DataFrame, a: DataFrame, k: DataFrame) -> DataFrame:
    """(key, nearest, similarity) of pairs(key, nearest)."""
    rows = pairs.join(a, "key").join(k, ["nearest", "gram"])
    return rows.groupBy("key", "nearest").agg(F.round(F.sum(F.col("weight") * F.col("w")), 9).alias("similarity"))


#: Keys of a block, of asked as of known ones, at most about.
KEY_BLOCK = 65_536


def _best_in_block(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """(key, nearest, similarity): for each asked(key, g, w) the most similar of known(key, g, w), if any shares a gram.

    Grams are followed from the rarest on, each through the list of the known keys that hold it, until what is left cannot
    lift a key that has not been met above the best one; the keys met are then looked up in the rest of the lists. So few
    keys are met, and none is kept but those of one asked key at a time.
    """
    if not len(asked) or not len(known):
        return pd.DataFrame({"key": [], "nearest": [], "similarity": []}, dtype=object)
    known = known.sort_values("key", ignore_index=True)  # ties go to the first by name
    sizes = known.g.map(len).to_numpy()
    gram, weight, holder = np.concatenate(known.g.to_numpy()), np.concatenate(known.w.to_numpy()), np.repeat(np.arange(len(known)), sizes)
    order = np.argsort(gram, kind="stable")
    gram, weight, holder = gram[order], weight[order], holder[order]
    grams, starts = np.unique(gram, return_index=True)
    ends, most = np.append(starts[1:], len(gram)), np.maximum.reduceat(weight, starts)
    found, near, eps = np.zeros(len(known)), [], 2e-9
    for key, g, w in zip(asked.key, asked.g, asked.w, strict=True):
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        held = grams[at] == g
        at, w = at[held], w[held]
        if not len(at):
            continue
        rare = np.argsort(ends[at] - starts[at], kind="stable")
        at, w = at[rare], w[rare]
        # rest[j]: what the grams from j on can add at most
        rest = np.append(np.cumsum((w * most[at])[::-1])[::-1], 0.0)
        best, j = 0.0, 0
        while j < len(at) and best <= rest[j] + eps:
            low, high = starts[at[j]], ends[at[j]]
            spot = holder[low:high]
            sums = found[spot] + w[j] * weight[low:high]
            found[spot] = sums
            best, j = max(best, sums.max()), j + 1
        met = np.flatnonzero(found >= max(best - rest[j] - eps, 1e-300))
        score = found[met]
        found[:] = 0.0
        for i in range(j, len(at)):
            low, high = starts[at[i]], ends[at[i]]
            spot = holder[low:high]
            place = np.minimum(np.searchsorted(spot, met), len(spot) - 1)
            score = score + np.where(spot[place] == met, w[i] * weight[low:high][place], 0.0)
            stay = score >= score.max() - rest[i + 1] - eps
            met, score = met[stay], score[stay]
        score = np.round(score, 9)
        first = int(np.argmax(score))
        near.append((key, met[first], score[first]))
    names = known.key.tolist()
    return pd.DataFrame({"key": [key for key, _, _ in near], "nearest": [names[i] for _, i, _ in near], "similarity": [x for _, _, x in near]}, dtype=object).astype({"similarity": float})


def nearest_keys(asked: DataFrame, known: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """(key, nearest, similarity): the known key of the largest cosine with each asked key, the first by name among equals;
    a key that shares no n-gram with any has no row.

    Blocks of asked keys meet blocks of known keys, each pair of blocks in one task; no pair of keys is ever shuffled, only
    the best of a block for each asked key.
    """
    either = asked.select("key", F.lit(True).alias("asked"), F.lit(False).alias("known")).unionByName(known.select("key", F.lit(False).alias("asked"), F.lit(True).alias("known")))
    kinds = stage(either.where("key IS NOT NULL").groupBy("key").agg(F.max("asked").alias("asked"), F.max("known").alias("known")), "keys")
    packed = _key_vectors(kinds, 2, 3, "gid", "asked", "known").groupBy("key", "asked", "known").agg(F.collect_list(F.struct("gid", "weight")).alias("p"))
    v = stage(packed.select("key", "asked", "known", F.col("p.gid").alias("g"), F.col("p.weight").alias("w")), "vectors")
    n = v.agg(F.count_if("asked").alias("asked"), F.count_if("known").alias("known")).first()
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, -(-n["known"] // block))
    rows = max(1, -(-n["asked"] // block), min(-(-parts // columns), n["asked"]))
    part = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = v.where("asked").select("key", "g", "w", part(rows).alias("r")).withColumn("c", each(columns))
    k = v.where("known").select("key", "g", "w", part(columns).alias("c")).withColumn("r", each(rows))
    pairs = a.groupBy("r", "c").cogroup(k.groupBy("r", "c")).applyInPandas(_best_in_block, "key string, nearest string, similarity double")
    return top_k(pairs, 1, by="key", score="similarity", tie="nearest").select("key", "nearest", "similarity")


def predict(model: DataFrame, doc_keys: DataFrame) -> DataFrame:
    """(doc_id, rank, label, score): above-average labels of the document's key or, failing it, of the nearest known key."""
    known = model.select("key").distinct()
    unknown = doc_keys.select("key").distinct().join(known, "key", "left_anti")
    nearest = nearest_keys(unknown, known).select("key", F.col("nearest").alias("use"))
    used = doc_keys.join(nearest, "key", "left").select("doc_id", F.coalesce("use", "key").alias("key"))
    rows = used.join(above_average(model), "key").select("doc_id", "label", F.col("n").cast("double").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label"))).select("doc_id", "rank", "label", "score")


def evaluate(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    from bramble.operators.metrics import hits

    return micro(hits(predictions, truth))
