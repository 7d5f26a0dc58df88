"""Language-model scoring by online logistic context mixing.

A text's words, one space between and an end mark after them, are coded byte by byte, each byte as the decisions on its path
through a Huffman tree of the training bytes that follow the byte before it. For every decision several hashed contexts (the last bytes, the word so far,
the word before) name a slot with the counts of both outcomes in all training texts. The log-odds of the slots are combined
by weights that a gate chooses (how well the longest contexts are known); the weights are refined along each text by the
gradient of its own coding cost, block after block. The sum of the costs is the text's log probability.

Beside it, a unigram model with one added to each count is the base to compare with.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import shuffle_parts, stage
from bramble.llm.word_ids import slices, small_batches, trim

#: Rows whose crc32(doc_id as text) mod 7 is 2 are held out.
HELD_OUT_MOD, HELD_OUT_REST = 7, 2
SPACE, END = 0x20, 0x0A
#: Contexts: the last 3, 5 bytes; the word so far; the word before with the word so far.
ORDERS, CONTEXTS = (3, 5), 4
#: Slots of a context, as a power of two: the size of the model, whatever its input. A worker holds CONTEXTS tables.
BITS = 21
#: Slots of one context that stand together.
TOGETHER = 64
#: Text of a slice that a task codes, bytes of it whose decisions it holds at once, counts of a block of a table, and words
#: that a task counts before it hands them on.
SLICE_BYTES, PIECE, BLOCK, WORDS_AT_ONCE = 1 << 19, 1 << 14, 1 << 15, 200_000
#: Log-odds of an outcome as one of SIDES levels, by which all decisions of the training texts are counted for the weights.
CENTRES = np.asarray([-8.5, -6.5, -5.0, -4.0, -3.0, -2.25, -1.6, -1.0, -0.5, 0.0, 0.5, 1.0, 1.6, 2.25, 3.0, 4.0, 5.0, 6.5, 8.5])
SIDES = len(CENTRES)
#: Words whose counts are broadcast; the others are joined.
FREQUENT = 1 << 17
#: Bytes after which a text's weights are refined, and the step.
REFINE, STEP = 256, 0.03
ADDED = 0.4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[SPACE, *range(0x09, 0x0E)]] = SPACE


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each text): A-Z in lower case, words with one space between, END after each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0] + np.arange(len(texts))
    out = np.full(len(raw) + len(texts), END, dtype=np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[ends] = False
    out[body] = _LOWER[raw]
    space = out == SPACE
    before = np.concatenate([[END], out[:-1]])
    keep = ~(space & ((before == SPACE) | (before == END)))
    out = out[keep]
    keep = np.ones(len(out), dtype=bool)
    keep[:-1] = (out[:-1] != SPACE) | (out[1:] != END)
    out = out[keep]
    return out, np.diff(np.concatenate([[0], np.flatnonzero(out == END) + 1]))


def words_of(data: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each) of a stream."""
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64)
    text = np.where(data == END, np.uint8(SPACE), data)[:-1].tobytes()
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.asarray([0, len(text)], dtype=np.int64).tobytes()), pa.py_buffer(text)])
    flat = pc.split_pattern(whole, " ").flatten()
    ends = np.cumsum(sizes)
    spaces = np.concatenate([[0], np.cumsum(data == SPACE)])
    n = spaces[ends] - spaces[ends - sizes] + 1
    n[sizes == 1] = 0
    return flat.filter(pc.not_equal(flat, "")), n


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] for places that exist: numpy is quickest where it need not look for others."""
    return values.take(at, mode="clip")


def _tree(counts: list[int]) -> list[list[tuple[int, int]]]:
    """The path (inner node, outcome) to each byte, from the leaf up, in a Huffman tree of one added to each count."""
    heap = [(n + 1, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    made, paths = 256, [[] for _ in range(256)]
    below = {i: [i] for i in range(256)}
    while len(heap) > 1:
        (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for side, z in enumerate((x, y)):
            for symbol in below[z]:
                paths[symbol].append((made - 256, side))
        below[made] = below.pop(x) + below.pop(y)
        heapq.heappush(heap, (n + m, made, made))
        made += 1
    return paths


class Code:
    """Paths of the 256 bytes through Huffman trees: inner nodes and outcomes. counts are of bytes, for one tree, or of pairs
    (byte before, byte), for a tree after each byte."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts).reshape(-1, 256)
        self.trees = len(counts)
        unseen = _tree([0] * 256)
        paths = [path for row in counts for path in (_tree(row.tolist()) if row.any() else unseen)]
        self.length = np.asarray([len(path) for path in paths], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        flat = np.asarray([step for path in paths for step in reversed(path)], dtype=np.uint32)
        # inner nodes are numbered by rising count: the TOGETHER most frequent of a tree have numbers of their own
        self.node = flat[:, 0] % np.uint32(TOGETHER)
        self.bit = flat[:, 1].astype(np.uint8)

    def symbols(self, data: np.ndarray) -> np.ndarray:
        """What decisions takes for the bytes of a stream, whose texts follow an END each."""
        return data if self.trees == 1 else pairs(data)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, outcome, place of its byte) of each decision, and the number of decisions of each byte."""
        n = picked(self.length, symbols)
        place = np.repeat(np.arange(len(n)), n)
        at = picked(picked(self.start, symbols) - (np.cumsum(n) - n), place)
        at += np.arange(len(at))
        return picked(self.node, at), picked(self.bit, at), place, n


def pairs(data: np.ndarray) -> np.ndarray:
    """Each byte of a stream with the one before it; a text's first byte comes after END."""
    before = np.full(len(data), END, dtype=np.uint16)
    before[1:] = data[:-1]
    return before << np.uint16(8) | data


_RATIO = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _RATIO, dtype=np.uint64)
        down = np.full(size, pow(_RATIO, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0][:n], _powers[1][:n]


def contexts(data: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash for every context and byte; nothing before a text's start counts."""
    n = len(data)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # the eight bytes before each byte as one number, the last of them highest
    eight = np.ndarray(n, dtype="<u8", buffer=np.concatenate([np.zeros(8, dtype=np.uint8), data]), strides=(1,))
    out = []
    for k in ORDERS:
        h = eight >> np.uint64(64 - 8 * k)
        for j in range(k):
            at = starts[sizes > j] + j
            h[at] = eight[at] >> np.uint64(64 - 8 * j) << np.uint64(8 * (k - j)) if j else 0
        h += np.uint64(k << 56)
        out.append(h)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    step = data.astype(np.uint64)
    step += np.uint64(1)
    step *= up[:n]
    np.cumsum(step, out=sums[1:])
    # words with the separator that ends them
    word = np.concatenate([[0], np.flatnonzero((data == SPACE) | (data == END)) + 1])
    word, long = word[:-1], np.diff(word)
    whole = (sums[word + long - 1] - sums[word]) * down[word]
    last = np.concatenate([np.zeros(1, dtype=np.uint64), whole])[: len(word)]
    last[np.searchsorted(word, starts)] = 0
    prefix = sums[:n] - np.repeat(sums[word], long)
    prefix *= np.repeat(down[word], long)
    out += [prefix + np.uint64(77), prefix * np.uint64(0xC2B2AE3D27D4EB4F) + np.repeat(last, long)]
    mix = np.uint64(0xFF51AFD7ED558CCD)
    for h in out:
        h ^= h >> np.uint64(29)
        h *= mix
        h >>= np.uint64(32)
    return [h.astype(np.uint32) for h in out]


def slots(h: np.ndarray, n: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The slots of the decisions of bytes with contexts h and n decisions each: those of a context stand together, so that
    one reach into memory serves the whole byte."""
    return np.repeat(h >> np.uint32(32 - bits), n) ^ node


#: A count as one of 256 levels: exact up to 32, then by steps of a sixteenth.
_LEVELS = np.concatenate([np.arange(33), np.round(32 * 1.0625 ** np.arange(1, 224))])


def states(counts: np.ndarray) -> np.ndarray:
    """(n0, n1) pairs as 16 bits."""
    level = np.minimum(np.searchsorted(_LEVELS, counts, side="right") - 1, 255).astype(np.uint16)
    return level[0::2] << np.uint16(8) | level[1::2]


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((np.maximum(n1, 0) + ADDED) / (np.maximum(n0, 0) + ADDED)).astype(np.float32)


_N0, _N1 = _LEVELS[np.arange(65536) >> 8], _LEVELS[np.arange(65536) & 255]
#: Log-odds without the decision itself, which its own text put into the counts: [outcome, state].
ODDS_WITHOUT = np.stack([_log_odds(_N0 - 1, _N1), _log_odds(_N0, _N1 - 1)])
#: How well a context is known: never, once or twice, up to 8 times, more often.
_KNOWN = np.searchsorted([1, 3, 9], _N0 + _N1, side="right").astype(np.uint8)
KNOWN_WITHOUT = np.searchsorted([1, 3, 9], np.maximum(_N0 + _N1 - 1, 0), side="right").astype(np.uint8)
GATES = 16
#: For scoring a state is one byte: how well it is known, and its log-odds as one of 63 steps, so that tables stay small.
_WIDTH = np.float32(0.3)
BRIEF = (_KNOWN << 6 | np.clip(np.round(_log_odds(_N0, _N1) / _WIDTH), -31, 31).astype(np.int16) + 31).astype(np.uint8)
ODDS = ((np.arange(256) & 63) - 31).astype(np.float32) * _WIDTH


CELLS = GATES * SIDES**CONTEXTS


def _cell_parts() -> list[np.ndarray]:
    """For each context, what a decision adds to the number of its cell, at [outcome * 65536 + state]: the level of the
    log-odds of the outcome that came, without the decision itself, and for the last two contexts how well they are known."""
    edges = (CENTRES[1:] + CENTRES[:-1]) / 2
    level = np.searchsorted(edges, np.concatenate([-ODDS_WITHOUT[0], ODDS_WITHOUT[1]])).astype(np.int32)
    known = np.tile(KNOWN_WITHOUT.astype(np.int32), 2) * SIDES**CONTEXTS
    parts = [level * SIDES**k for k in range(CONTEXTS)]
    parts[-1] += 4 * known
    parts[-2] += known
    return parts


_CELL_PARTS = _cell_parts()


def cells_of(state: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """The cell (gate and levels of all contexts) of each decision."""
    row, cell = bit.astype(np.int32) << 16, np.zeros(len(bit), dtype=np.int32)
    for part, s in zip(_CELL_PARTS, state, strict=True):
        cell += picked(part, row | s)
    return cell


def fit_weights(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights [gate, context] of least coding cost over cells that n decisions each fall in, by Newton steps; a gate leans on
    the weights of all gates."""
    x = np.stack([CENTRES[cell // SIDES**k % SIDES] for k in range(CONTEXTS)])
    gate, n = cell // SIDES**CONTEXTS, n.astype(float)
    start = np.full(CONTEXTS, 0.35)

    def solve(x: np.ndarray, n: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
        w = prior.copy()
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            grad = x @ (n * (1 - p)) - weight * (w - prior)
            step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + weight * np.eye(len(w)), grad)
            w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        return w

    whole = solve(x, n, start, 50.0)
    return np.stack([solve(x[:, gate == g], n[gate == g], whole, 50.0) for g in range(GATES)]).astype(np.float32)


def bits_of(data: np.ndarray, sizes: np.ndarray, code: Code, tables: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Bits that each text of a stream costs. Blocks of REFINE bytes of all texts are coded together, first blocks first; what
    does not depend on the refined weights is looked up for several blocks at once."""
    if not len(sizes):
        return np.zeros(0)
    bits = int(len(tables[0])).bit_length() - 1
    # blocks of all texts by number, and their bytes in that order
    blocks = -(-sizes // REFINE)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    by_number = np.argsort(number, kind="stable")
    owner = np.repeat(np.arange(len(sizes)), blocks)[by_number]
    number = number[by_number]
    start = (np.cumsum(sizes) - sizes)[owner] + number * REFINE
    size = np.minimum(sizes[owner] - number * REFINE, REFINE)
    begin = np.cumsum(size) - size
    order = np.arange(len(data)) + np.repeat(start - begin, size)
    rows = np.concatenate([[0], np.cumsum(np.bincount(number))])
    edges = np.concatenate([begin, [len(data)]])[rows]
    cost, moved = np.zeros(len(sizes)), np.zeros((CONTEXTS, len(sizes)), dtype=np.float32)
    symbols, hashes = picked(code.symbols(data), order), [picked(h >> np.uint32(32 - bits), order) for h in contexts(data, sizes)]
    gated = [np.ascontiguousarray(weights[:, k]) for k in range(CONTEXTS)]
    done = 0
    while done < len(edges) - 1:
        upto = max(done + 1, int(np.searchsorted(edges, edges[done] + PIECE, side="right")) - 1)
        lo, hi = edges[done], edges[upto]
        node, bit, place, n = code.decisions(symbols[lo:hi])
        sign = bit.astype(np.float32) * (2 * _WIDTH) - _WIDTH
        state = [picked(tables[k], picked(hashes[k][lo:hi], place) ^ node) for k in range(CONTEXTS)]
        gate = ((state[-1] >> 6 << 2) | state[-2] >> 6).astype(np.intp)
        # log-odds of the outcome that came, and their sum by the weights that texts start with
        odds, started = np.empty((CONTEXTS, len(node)), dtype=np.float32), np.zeros(len(node), dtype=np.float32)
        for k in range(CONTEXTS):
            np.multiply((state[k] & 63).view(np.int8) - np.int8(31), sign, out=odds[k])
            w = picked(gated[k], gate)
            w *= odds[k]
            started += w
        ends = np.concatenate([[0], np.cumsum(n)])
        for one in range(done, upto):
            a, b = ends[edges[one] - lo], ends[edges[one + 1] - lo]
            here = slice(rows[one], rows[one + 1])
            lane, at = owner[here], ends[begin[here] - lo] - a
            z, x = started[a:b], odds[:, a:b]
            many = np.diff(np.concatenate([at, [len(z)]]))
            if one:
                more = np.repeat(moved[:, lane], many, axis=1) if len(lane) > 1 else np.broadcast_to(moved[:, lane], x.shape)
                z = z + np.einsum("kn,kn->n", more, x)
            e = np.exp(-np.clip(z, -25, 25))
            cost[lane] += np.add.reduceat(np.log(1 + e), at, dtype=float)
            e /= 1 + e
            moved[:, lane] += STEP * np.add.reduceat(x * e, at, axis=1) / np.sqrt(many)
        done = upto
    return cost / np.log(2)


def _counted(train: DataFrame) -> DataFrame:
    """(word, n): words of all training texts; under a null word, by pair of bytes (the one before * 256 + the byte), the bytes
    of the coded texts and, as pair -1, the number of texts. A task hands on what it has counted when that reaches
    WORDS_AT_ONCE words."""

    def count(batches):
        seen, histogram, texts = {}, np.zeros(1 << 16, dtype=np.int64), 0

        def put():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.nulls(len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "pair", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                data, sizes = stream(part.column("text"))
                histogram += np.bincount(pairs(data), minlength=1 << 16)
                texts += len(sizes)
                met = words_of(data, sizes)[0].value_counts()
                for w, n in zip(met.field("values").to_pylist(), met.field("counts").to_pylist(), strict=True):
                    seen[w] = seen.get(w, 0) + n
                if len(seen) > WORDS_AT_ONCE:
                    yield put()
        yield put()
        met = np.flatnonzero(histogram)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(met) + 1, pa.string()), pa.array(np.concatenate([[-1], met]), pa.int32()), pa.array(np.concatenate([[texts], histogram[met]]))], ["word", "pair", "n"])

    return train.select("text").mapInArrow(count, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))


def _tables(train: DataFrame, code: Code, bits: int) -> list[np.ndarray]:
    """The states of all slots, counted over all training texts: a context and byte once for a slice, by its number there. Tasks hand on blocks of their tables; where a block is
    summed, it arrives piece by piece, and only its sum is held."""
    shared = train.sparkSession.sparkContext.broadcast(code)
    size = 2 << bits
    per = min(BLOCK, size)

    def count(batches):
        code, total = shared.value, np.zeros((CONTEXTS, size), dtype=np.int32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, sizes = stream(part.column("text"))
                symbols = code.symbols(data)
                for k, h in enumerate(contexts(data, sizes)):
                    key = h.astype(np.uint64)
                    key <<= np.uint64(16)
                    key |= symbols
                    key.sort()
                    own = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    times = np.diff(np.concatenate([own, [len(key)]])).astype(np.int32)
                    key = key[own]
                    for lo in range(0, len(key), PIECE):
                        some = key[lo : lo + PIECE]
                        node, bit, place, _ = code.decisions((some & np.uint64(0xFFFF)).astype(np.uint16))
                        at = picked((some >> np.uint64(48 - bits)).astype(np.int64), place) ^ node
                        at <<= 1
                        at |= bit
                        np.add.at(total[k], at, picked(times[lo : lo + PIECE], place))
            trim()
        flat = total.reshape(-1, per)
        for at in np.flatnonzero(flat.any(axis=1)):
            most = flat[at].max()
            kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "width": pa.array([int(kind[2])], pa.int32()), "counts": pa.array([flat[at].astype(kind).tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, width, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "width", "counts")), strict=True):
                sums.setdefault(at, np.zeros(per, dtype=np.int64))[:] += np.frombuffer(counts, dtype=f"<u{width}")
        for at, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "states": pa.array([states(counts).tobytes()], pa.binary())})

    blocks = train.select("text").mapInArrow(count, "block int, width int, counts binary")
    summed = blocks.repartition(shuffle_parts(train.sparkSession), "block").mapInArrow(add, "block int, states binary").toArrow()
    out = np.zeros((CONTEXTS * size // per, per // 2), dtype=np.uint16)
    for at, state in zip(summed.column("block").to_pylist(), summed.column("states").to_pylist(), strict=True):
        out[at] = np.frombuffer(state, dtype=np.uint16)
    shared.unpersist()
    return list(out.reshape(CONTEXTS, size // 2))


def _starting_weights(train: DataFrame, code: Code, tables: list[np.ndarray]) -> np.ndarray:
    """The gated weights, fitted on every decision of all training texts, without its own counts. Tasks count the decisions
    by cell and hand on blocks of the counts; only the sums reach the driver, whatever the texts."""
    bits = len(tables[0]).bit_length() - 1
    shared = train.sparkSession.sparkContext.broadcast((code, tables))
    blocks = 16
    per = -(-CELLS // blocks)

    def look(batches):
        code, tables = shared.value
        total = np.zeros(blocks * per, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, sizes = stream(part.column("text"))
                symbols, hashes = code.symbols(data), [h >> np.uint32(32 - bits) for h in contexts(data, sizes)]
                for lo in range(0, len(data), PIECE):
                    node, bit, place, _ = code.decisions(symbols[lo : lo + PIECE])
                    np.add.at(total, cells_of([picked(t, picked(h[lo : lo + PIECE], place) ^ node) for t, h in zip(tables, hashes, strict=True)], bit), 1)
        flat = total.reshape(blocks, per)
        met = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_pydict({"block": pa.array(met, pa.int32()), "counts": pa.array([zlib.compress(flat[at].astype("<i8").tobytes(), 1) for at in met], pa.binary())})
        del total, flat
        trim()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(at, np.zeros(per, dtype=np.int64))[:] += np.frombuffer(zlib.decompress(counts), dtype="<i8")
        for at, counts in sums.items():
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"cell": pa.array((met + at * per).astype(np.int32)), "n": pa.array(counts[met])})

    counted = train.select("text").mapInArrow(look, "block int, counts binary")
    rows = counted.repartition(min(blocks, shuffle_parts(train.sparkSession)), "block").mapInArrow(add, "cell int, n long").toArrow()
    shared.unpersist()
    if not rows.num_rows:
        return np.full((GATES, CONTEXTS), 0.35, dtype=np.float32)
    # in an order of their own, so that sums do not depend on the tasks
    rows = rows.sort_by("cell")
    return fit_weights(rows.column("cell").to_numpy(), rows.column("n").to_numpy())


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    Learns from rows that are not held out: word counts, byte counts, slots and the weights that a text starts with, all from
    all of their whole texts. score is the log10 probability of
    the text's words and end under the context mixing, base_score that of the unigram model; bits_per_byte divides the
    model's bits by the bytes coded (lower-case words, one separator or end after each). A null text counts as empty and
    has its end only; without training texts every decision costs one bit and the base is 0. A null id is passed on and is
    not held out; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    train = rows.where("not held_out").select("doc_id", "text")

    counted = stage(_counted(train), "counts")
    counts = counted.where("word is not null").select("word", "n")
    own = {r["pair"]: r["n"] for r in counted.where("word is null").collect()}
    histogram = np.asarray([own.get(i, 0) for i in range(1 << 16)], dtype=np.int64)
    texts = own.get(-1, 0)
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = facts["n"] + texts, facts["v"] + (texts > 0)
    bottom = float(np.log10(total + distinct + 1))
    code = Code(histogram)
    tables = _tables(train, code, bits)
    weights = _starting_weights(train, code, tables)
    frequent = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast((code, [BRIEF[t] for t in tables], weights, frequent.column("word").combine_chunks().cast(pa.large_string()), frequent.column("n").to_numpy()))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def coded(batches):
        code, tables, weights, known, n_known = shared.value
        value = np.log10(n_known + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, sizes = stream(part.column("text"))
                cost = bits_of(data, sizes, code, tables, weights)
                words, n = words_of(data, sizes)
                coded = words.dictionary_encode()
                met = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[met] if len(met) else np.zeros(0, dtype=np.int64)
                text = np.repeat(np.arange(len(sizes)), n)
                hit = place >= 0
                base = np.bincount(text[hit], weights=value[place[hit]], minlength=len(sizes))
                # each rare word of a text once, with its number there
                pairs, times = np.unique(text[~hit] * max(len(coded.dictionary), 1) + met[~hit], return_counts=True)
                own, word = pairs // max(len(coded.dictionary), 1), pairs % max(len(coded.dictionary), 1)
                ends = pa.array(np.searchsorted(own, np.arange(len(sizes) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(sizes))), part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(np.bincount(text[hit], minlength=len(sizes))), pa.array(base, pa.float64()), pa.array(cost, pa.float64()), pa.array(sizes),
                        pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(word)).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    ["row", "doc_id", "held_out", "words", "known", "base", "bits", "bytes", "rare", "times"],
                )
                row += len(sizes)

    done = stage(rows.mapInArrow(coded, f"row long, doc_id {kind}, held_out boolean, words long, known long, base double, bits double, bytes long, rare array<string>, times array<int>"), "scored")
    rare = done.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"))
    tokens = F.col("words") + 1
    base = F.col("base") + F.coalesce("add", F.lit(0.0)) + float(np.log10(texts + 1)) - tokens * F.lit(bottom)
    return done.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + int(texts > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("bits") * float(-np.log10(2))).alias("score"), (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )
