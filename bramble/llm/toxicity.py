"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows that set quotation apart.

The lexicon is learnt from labelled text: words that toxic documents hold so much more often that not one word is expected to
do so by chance; documents that are copies of each other count once. Its trie is intersected with a Levenshtein automaton, as one automaton that is determined lazily: a state is the set of (trie node, edits so far)
that a word's beginning allows, so a word is looked up in one step a character whatever the lexicon's size.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import held_out, stage, worker_cache
from bramble.llm.shingles import low_hashes, word_hashes
from bramble.llm.token_files import mix
from bramble.llm.word_ids import slices, small_batches, trim

#: Labelled rows that are learnt from at most (a hashed sample beyond); the broadcast word lists come from these rows alone.
LABELLED = 200_000
#: Evidence of one or two edits against none.
EDIT_FACTOR = (1.0, 0.7, 0.4)
#: Tokens on either side of a hit that are looked at, and the factor of a quoted or reported hit.
WINDOW, QUOTED = 6, 0.3
#: Tokens that a worker keeps in each of two generations, words of a task's counter, states of an automaton.
CACHE, COUNTED, STATES = 100_000, 50_000, 20_000
#: Bits of the first look at a shortened form, and shortened forms that are hashed at a time.
FORM_BITS, FORMS = 22, 1 << 20
# Quotation marks, and words by which a text reports another's words.
OPENING, CLOSING = "\"“„«‹「『", "\"”“»›」』"
REPORTING = "said says wrote writes quoted quote called calls claimed sagte sagt schrieb zitat nannte dit écrit appelé citation dijo dice escribió cita llamó".split()

_word = re.compile(r"[^\W\d_](?:[^\W_]|['’])*", re.UNICODE)


def edits_for(term: str) -> int:
    """Edits that a misspelling of a term may hold: none in short terms, two in long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def shortened(word: str, most: int) -> list[str]:
    """The word with up to `most` letters (two at the most) left out."""
    if not most:
        return [word]
    one = [word[:i] + word[i + 1 :] for i in range(len(word))]
    return [word, *one] if most == 1 else [word, *one, *[w[:j] + w[j + 1 :] for i, w in enumerate(one) for j in range(i, len(w))]]


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Code points of the words of each length, a row a word."""
    lengths: dict[int, list[str]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    return {n: np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(x), n) for n, x in lengths.items()}


def _form_hashes(points: np.ndarray, most: int) -> np.ndarray:
    """Hashes of each row's word with up to `most` letters (two at the most) left out: sums of letters times powers of a
    base, in which what follows a letter left out moves down by one power."""
    m, n = points.shape
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.asarray([1] + [_BASE] * n, dtype=np.uint64))
        upto = np.zeros((m, n + 1), dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], axis=1, out=upto[:, 1:])
        total, back = upto[:, -1:], np.uint64(_BACK)
        out = [total]
        if most:
            out.append(upto[:, :-1] + (total - upto[:, 1:]) * back)
        if most > 1 and n > 1:
            i, j = np.triu_indices(n, 1)
            out.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * back + (total - upto[:, j + 1]) * (back * back))
        return mix(np.concatenate(out, axis=1).ravel(), 41)


class FuzzyLexicon:
    """The terms within reach of a word: a lexicon trie intersected with Levenshtein automata, determined on demand."""

    def __init__(self, terms: list[str], most_states: int = STATES):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.reach: list[int] = [0]  # most edits that a term below a node allows
        self.terms, self.most_states = terms, most_states
        for i, t in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], edits_for(t))
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits_for(t))
            self.term[node] = i
        self.alphabet = {c for n in self.children for c in n}
        self.near = {f for t in terms for f in shortened(t, edits_for(t))}
        self.near_hashes = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(_form_hashes(x, 0) for x in _by_length(list(self.near)).values())]))
        self.near_bits = np.zeros(1 << FORM_BITS, dtype=bool)
        self.near_bits[(self.near_hashes >> np.uint64(64 - FORM_BITS)).astype(np.int64)] = True
        self.edits: dict[int, int] = {}  # most edits of a term that a word of a length can match
        for k, n in {(edits_for(t), len(t)) for t in terms}:
            for m in range(n - k, n + k + 1):
                self.edits[m] = max(self.edits.get(m, 0), k)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of {trie node: fewest edits}, closed under skipped letters of a term."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] != e or e >= self.reach[node]:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e >= self.reach[node]:  # no edits left below: only the letter itself goes on
                child = self.children[node].get(c)
                if child is not None and e <= self.reach[child] and e < out.get(child, 9):
                    out[child] = e
                continue
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child] and cost < out.get(child, 9):
                    out[child] = cost
            if e + 1 < out.get(node, 9):
                out[node] = e + 1  # a letter too many
        return self._state(out) if out else -1

    def may_match(self, words: list[str]) -> list[str]:
        """The words that share a form of up to as many letters left out as the edits allow; no other word matches."""
        out: list[str] = []
        for n, points in _by_length([w for w in words if self.edits.get(len(w))]).items():
            forms = 1 + n + (n * (n - 1) // 2 if self.edits[n] > 1 else 0)
            letters = points.tobytes()
            for at in range(0, len(points), max(1, FORMS // forms)):
                some = points[at : at + max(1, FORMS // forms)]
                hashes = _form_hashes(some, self.edits[n])
                seen = np.flatnonzero(self.near_bits[(hashes >> np.uint64(64 - FORM_BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.near_hashes, hashes[seen]), len(self.near_hashes) - 1)
                seen = seen[self.near_hashes[place] == hashes[seen]]
                out += [letters[4 * n * (at + r) : 4 * n * (at + r + 1)].decode("utf-32-le", "surrogatepass") for r in np.unique(seen // (len(hashes) // len(some))).tolist()]
        return out

    def match(self, word: str) -> list[tuple[int, int]]:
        """(term, edits) of every term that the word is or misspells."""
        most = self.edits.get(len(word), -1)
        if most < 0 or self.near.isdisjoint(shortened(word, most)):
            return []  # a term within k edits shares a form that k letters fewer at most leave of both
        if len(self.sets) > self.most_states:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.alphabet else "\0"
            moves = self.moves[state]
            to = moves.get(c)
            if to is None:
                to = moves[c] = self._step(state, c)
            if to < 0:
                return []
            state = to
        return [(self.term[n], e) for n, e in self.sets[state] if self.term[n] >= 0 and e <= edits_for(self.terms[self.term[n]])]


class Scorer:
    """Hits and features of texts by a lexicon {term: evidence} and the variants that labelled text shows to be clean."""

    def __init__(self, lexicon: dict[str, float], clean: set[str]):
        self.lexicon, self.clean = lexicon, clean
        self.fuzzy = FuzzyLexicon(list(lexicon))
        # tokens met since the last change of generation, and those of the generation before
        self.now: dict[str, float] = {}
        self.before: dict[str, float] = {}

    def evidence(self, tokens: list[str]) -> list[float]:
        """Of the strongest word in each lower-case token between white space."""
        if not self.lexicon:
            return [0.0] * len(tokens)
        out = [*map(self.now.get, tokens)]
        missing = [i for i, x in enumerate(out) if x is None]
        new = [i for i in missing if tokens[i] not in self.before]
        words = [_word.findall(tokens[i]) for i in new]
        misspelt = {}
        for w in self.fuzzy.may_match(list({w for x in words for w in x if w not in self.lexicon and w not in self.clean})):
            misspelt[w] = max((self.lexicon[self.fuzzy.terms[t]] * EDIT_FACTOR[e] for t, e in self.fuzzy.match(w) if e), default=0.0)
        known = self.lexicon | misspelt
        found = {tokens[i]: max([0.0, *(known[w] for w in x if w in known)]) for i, x in zip(new, words, strict=True)}
        for i in missing:
            t = tokens[i]
            out[i] = found[t] if t in found else self.before[t]
        for i in missing:
            if len(self.now) >= CACHE:
                self.before, self.now = self.now, {}
            self.now[tokens[i]] = out[i]
        return out

    @staticmethod
    def quoted(tokens: list[str], at: int) -> bool:
        """Whether a window around the hit opens a quotation before it and closes it after, or reports another's words."""
        before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
        opened = any(t[0] in OPENING for t in before if t) and not any(t[-1] in CLOSING for t in before[:-1] if t)
        closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in after if t.rstrip(".,;:!?"))
        return (opened and closed) or any(t.strip(".,;:!?\"") in REPORTING for t in before[:-1])

    def features(self, texts: pa.Array) -> np.ndarray:
        """Rows of (log of 1 + summed evidence, log of 1 + largest evidence, evidence a token); quoted hits count less."""
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))))
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py() if len(words) else np.zeros(1, dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        weight = np.asarray(self.evidence(distinct), dtype=float)
        index = coded.indices.to_numpy(zero_copy_only=False)
        hits = np.flatnonzero(weight[index] > 0) if len(index) else np.zeros(0, dtype=np.int64)
        row = np.searchsorted(offsets, hits, side="right") - 1
        out = np.zeros((len(words), 3))
        for at, r in zip(hits.tolist(), row.tolist(), strict=True):
            low, high = max(int(offsets[r]), at - WINDOW), min(int(offsets[r + 1]), at + WINDOW + 1)
            near = [distinct[i] for i in index[low:high]]
            e = weight[index[at]] * (QUOTED if self.quoted(near, at - low) else 1.0)
            out[r, 0] += e
            out[r, 1] = max(out[r, 1], e)
        out[:, 2] = out[:, 0] / np.maximum(np.diff(offsets), 1)
        return np.log1p(out)


def scorer_of(model: tuple) -> Scorer:
    """The worker's scorer of a broadcast model (key, lexicon, clean, ...): its automaton and cache outlive a task."""
    key, lexicon, clean = model[:3]
    kept = worker_cache("toxicity")
    if key not in kept:
        kept.clear()
        kept[key] = Scorer(lexicon, clean)
    return kept[key]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps on the ridge-penalised log likelihood (the bias is not penalised)."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): labelled documents (text, label) that hold the word; each task counts its own first."""

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for w in set(_word.findall((text or "").lower())):
                    seen.setdefault(w, [0, 0])[label] += 1
            if len(seen) > COUNTED:
                yield _counts(seen)
                seen = {}
        yield _counts(seen)
        trim()

    return labelled.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n[1] for n in seen.values()], pa.int64()), pa.array([n[0] for n in seen.values()], pa.int64())], ["word", "toxic", "clean"])


def copy_marks(labelled: DataFrame) -> DataFrame:
    """(id, mark): the least hash of a text's word pairs, which near copies share mostly and other texts do not."""

    def mark(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, n = word_hashes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(low_hashes(hashes, n).view(np.int64))], ["id", "mark"])
        trim()

    return labelled.select("id", "text").mapInArrow(mark, f"id {labelled.schema['id'].dataType.simpleString()}, mark long")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED) -> tuple[dict[str, float], set[str], np.ndarray, float]:
    """(lexicon, clean variants, weights, bias) from labelled rows that are not held out.

    At most about `most` labels are used, a hashed sample of them beyond; only they are broadcast, so documents are never
    shuffled. Ids with several labels take the largest; null labels and ids are left out. Of labelled texts that are copies
    by copy_marks the one of least id is learnt from. A word is a term of the lexicon if, at the base rate of toxic
    documents, the chance of so many toxic ones among those that hold it is (by Chernoff's bound) below 1 in all words.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.withColumn("doc_id", F.col("id")).where(~held_out("doc_id")).groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = copy_marks(text.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", "text"))
    first = marks.groupBy("mark").agg(F.min("id").alias("id")).select("id").distinct()
    known = stage(known.join(first, "id"), "tox-known")
    labelled = text.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("text", "label")
    counted = stage(word_counts(labelled).where("toxic + clean > 1"), "tox-words")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    base = (toxic + 0.5) / (toxic + clean + 1)
    if not toxic or not clean:
        return {}, set(), np.zeros(3), float(np.log(base / (1 - base)))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    chance = float(np.log(max(1, counted.count())))
    top = counted.where("toxic > 0").where((share > base) & (surprise > chance)).select("word", odds.alias("odds")).orderBy("word").toPandas()
    lexicon = dict(zip(top.word, top.odds.astype(float), strict=True))
    shared = spark.sparkContext.broadcast(lexicon)

    def variants(frames):
        fuzzy = FuzzyLexicon(list(shared.value))
        for pdf in frames:
            yield pd.DataFrame({"word": [w for w in fuzzy.may_match([w for w in pdf.word if w not in shared.value]) if fuzzy.match(w)]}, dtype=object)

    near = counted.where("clean > 0").select("word").mapInPandas(variants, "word string")
    unclean = set(near.select("word").toPandas().word)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, lexicon, unclean))

    def measure(batches):
        scorer = scorer_of(model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                x = scorer.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(x[:, i]) for i in range(3))], ["label", "a", "b", "c"])

    sums = labelled.mapInArrow(measure, "label int, a double, b double, c double")
    rows = sums.groupBy("label", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round("c", 3).alias("c")).count().toPandas()
    x, y = rows[["a", "b", "c"]].to_numpy(), rows.label.to_numpy().astype(float)
    weights, bias = fit_logistic(np.repeat(x, rows["count"], axis=0), np.repeat(y, rows["count"]))
    return lexicon, unclean, weights, bias


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (1 if score >= threshold) of every row of docs.

    A null or empty text has no evidence and scores the bias alone. Without both labels among the learnt rows every score
    is their base rate. A null id is passed on; repeated rows give repeated rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, *learn(docs, labels, id_col, text_col, label_col)))

    def score(batches):
        scorer, (weights, bias) = scorer_of(model.value), model.value[3:]
        for batch in batches:
            for part in slices(batch, "text"):
                p = 1 / (1 + np.exp(-np.clip(scorer.features(part.column("text")) @ weights + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. Scores are computed where the texts are: no join."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, *learn(docs, labels, id_col, text_col)))

    def keep(batches):
        scorer, (weights, bias) = scorer_of(model.value), model.value[3:]
        for batch in batches:
            for part in slices(batch, text_col):
                z = scorer.features(part.column(text_col)) @ weights + bias
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))
        trim()

    return docs.mapInArrow(keep, docs.schema)
