"""Language identification by cross-parsing entropy over suffix automata of labelled text.

For each language a suffix automaton of a bounded sample of its text is built. A text is parsed greedily into the longest
phrases that occur in the sample; the language that needs the fewest phrases, each weighed by the logarithm of the sample's
length (the bits that name a position in it), wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import held_out
from bramble.llm.word_ids import slices, small_batches

#: Characters of labelled text per language, and characters of one labelled text that a language takes at most (from anywhere
#: in it): the bounds of the sample that is learnt from.
SAMPLE_CHARS, PIECE_CHARS = 40_000, 4_000
#: Numbers of letters: 0 is anything but a letter, 1 a letter that no sample holds.
OTHER, MOST_LETTERS = 1, 65_000
#: Texts are parsed in lanes of so many characters side by side; what a cut changes is parsed again from the true state.
BLOCK = 512

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the minimal automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return moves


class Automaton:
    """The transitions of a suffix automaton in one array: that of a state and a letter stands at base[state] + letter, if
    check says so. What is stored grows with the sample alone, whatever the number of letters. fresh: from the start state."""

    def __init__(self, symbols: list[int], letters: int):
        moves = suffix_automaton(symbols)
        self.fresh = np.zeros(letters, dtype=np.int32)
        for c, to in moves[0].items():
            self.fresh[c] = to
        used = bytearray(2 * letters + 4 * sum(map(len, moves)))
        self.base = np.zeros(len(moves), dtype=np.int32)
        spots, low, hint = [], 0, 0
        # states of many letters first, each looked for from where the last one found its place: those of one fit into any gap
        for state in sorted(range(1, len(moves)), key=lambda q: -len(moves[q])):
            out = list(moves[state].items())
            if not out:
                continue
            low, first = used.find(0, low), out[0][0]
            at = max(low if len(out) == 1 else hint, first)
            while True:
                at = used.find(0, at)
                if at < 0 or at + letters >= len(used):
                    used.extend(bytes(len(used)))
                    at = max(hint, first)
                    continue
                base = at - first
                if all(base + c >= 0 and not used[base + c] for c, _ in out):
                    break
                at += 1
            self.base[state], hint = base, at if len(out) > 1 else hint
            for c, to in out:
                used[base + c] = 1
                spots.append((base + c, state, to))
        size = max([x for x, *_ in spots], default=0) + letters + 1
        self.check, self.target = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for spot, state, to in spots:
            self.check[spot], self.target[spot] = state, to

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase goes on). Where the match cannot grow, and at the start, a phrase begins; a letter
        that the sample lacks is a phrase of its own."""
        spot = self.base.take(state) + letter
        on = self.check.take(spot) == state
        return np.where(on, self.target.take(spot), self.fresh.take(letter)), on


def lanes(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters by place and lane, length of each lane, the lane before it in its text or -1, its text); longest lanes first."""
    per = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
    length = np.minimum(np.repeat(sizes, per) - number * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    before = np.where(number > 0, rank[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order] if len(order) else np.zeros(0, np.int64)
    by_place = np.zeros((BLOCK, len(order)), dtype=np.uint16)
    lane = np.repeat(np.arange(len(order)), length)
    at = np.arange(len(symbols)) - start[lane]
    by_place[at, rank[lane]] = symbols
    return by_place, length[order], before, text[order]


def phrases(auto: Automaton, by_place: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases of each lane, its text being parsed as one string.

    All lanes are parsed from the start state side by side. Then the lanes inside a text are parsed again from the state in
    which the lane before ended, as far as they differ from the first parse, which is until both stand in the same state;
    should a lane differ to its end, the next one is parsed again as well.
    """
    n, most = len(length), int(length.max(initial=0))
    active = np.searchsorted(-length, -np.arange(1, most + 1), side="right")
    states, counts = np.zeros((most + 1, n), dtype=np.int32), np.zeros((most + 1, n), dtype=np.int32)
    for t in range(most):
        k = active[t]
        to, on = auto.step(states[t, :k], by_place[t, :k])
        states[t + 1, :k] = to
        counts[t + 1, :k] = counts[t, :k] + ~on
    everyone = np.arange(n)
    total, end = counts[length, everyone], states[length, everyone]
    entered = np.zeros(n, dtype=np.int32)
    while True:
        come = np.where(before >= 0, end[before], 0)
        lane = np.flatnonzero(come != entered)
        if not len(lane):
            return total
        entered[lane] = come[lane]
        state, count, t = come[lane], np.zeros(len(lane), dtype=np.int32), 0
        while len(lane):
            same = state == states[t, lane]
            out = same | (length[lane] == t)
            done = lane[out]
            total[done] = count[out] + np.where(same[out], counts[length[done], done] - counts[t, done], 0)
            end[done] = np.where(same[out], states[length[done], done], state[out])
            lane, state, count = lane[~out], state[~out], count[~out]
            if len(lane):
                state, on = auto.step(state, by_place[t, lane])
                count += ~on
            t += 1


def _train(train: DataFrame, sample_chars: int) -> tuple[dict[int, int], list[tuple[str, float, Automaton]]]:
    """Letter numbers and (language, bits of a phrase, automaton) of each language."""
    totals = train.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    keep = F.least(F.lit(1.0), 3.0 * sample_chars / F.col("chars"))
    picked = train.join(F.broadcast(totals.withColumnRenamed("lang", "l")), F.col("lang") == F.col("l"))
    picked = picked.where((F.pmod(F.col("at"), F.lit(1 << 20)) / float(1 << 20)) < keep).select("lang", "at", "text").orderBy("lang", "at", "text").toPandas()
    kept: dict[str, list[str]] = {}
    for lang, text in zip(picked.lang, picked.text, strict=True):
        so_far = kept.setdefault(lang, [])
        if sum(map(len, so_far)) < sample_chars:
            so_far.append(text.lower())
    seen = pd.Series(list("".join(t for texts in kept.values() for t in texts)), dtype=object).value_counts()
    # as many letters as there are numbers, which is more than any writing has: beyond, the rarest are told apart no more
    known = sorted([c for c in seen.index if c.isalpha()][:MOST_LETTERS])
    numbers = {ord(c): i for i, c in enumerate(known, OTHER + 1)}
    out = []
    for lang in sorted(kept):
        symbols = _symbols(kept[lang], numbers)[0][:sample_chars].tolist()
        if symbols:
            out.append((lang, float(np.log2(len(symbols) + 1)), Automaton(symbols, len(numbers) + 2)))
    return numbers, out


def _symbols(texts: list[str], numbers: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers of all texts, how many of each). Runs of other characters than letters count as one."""
    points, sizes = _code_points(texts)
    number = np.zeros(0x110000, dtype=np.uint16)
    number[_is_letter()] = OTHER
    number[list(numbers)] = list(numbers.values())
    c = number[points]
    text = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(c), dtype=bool)
    if len(c):
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (text[1:] != text[:-1])
    return c[keep], np.bincount(text[keep], minlength=len(texts))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Languages are learnt from text and non-null lang of rows that are not held out: from a hashed sample of rows, and from
    PIECE_CHARS characters of each at a hashed place, until a language has sample_chars characters. All texts are parsed
    whole, as one string each, however long. A text
    that is null or has no letter, or any text when nothing could be learnt, gets `und` with score 0. Ties go to the first
    language by code point. The score is the winner's share when each language weighs 2 to the power of minus its bits per
    character, over 32 characters at most. A null id is passed on and counts as not held out for the flag; repeated rows
    give repeated rows, and rows that repeat an id with another text their own. Other columns, whatever their names, are
    ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    train = rows.where("not held_out and lang is not null and text is not null").select("lang", F.xxhash64("doc_id").alias("at"), F.expr(f"substring(text, 1 + pmod(xxhash64(doc_id, 1), greatest(1, length(text) - {PIECE_CHARS} + 1)), {PIECE_CHARS})").alias("text"))
    numbers, learnt = _train(train, sample_chars)
    model = spark.sparkContext.broadcast((numbers, learnt))

    def predict(batches):
        numbers, learnt = model.value
        bits = np.asarray([b for _, b, _ in learnt])
        names = np.asarray([n for n, *_ in learnt], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                texts = pc.fill_null(pc.utf8_lower(part.column("text").cast(pa.large_string())), "").to_pylist()
                symbols, chars = _symbols(texts, numbers)
                by_place, length, before, lane_text = lanes(symbols, chars)
                text = np.repeat(np.arange(len(texts)), chars)
                has_letter = np.bincount(text, weights=symbols != 0, minlength=len(texts)) > 0
                pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
                if learnt and has_letter.any():
                    cost = np.stack([np.bincount(lane_text, weights=phrases(auto, by_place, length, before), minlength=len(texts)) for *_, auto in learnt]) * bits[:, None] / np.maximum(chars, 1)
                    best = cost.argmin(axis=0)
                    share = 2.0 ** (-(cost - cost.min(axis=0)) * np.minimum(chars, 32))
                    pred = np.where(has_letter, names[best], "und")
                    score = np.where(has_letter, 1.0 / share.sum(axis=0), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
