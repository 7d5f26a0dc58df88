"""Conversation structure repair by weighted CYK interval parsing.

The legal role sequences are `(s?(ua)+)?`. The repair grammar in Chomsky normal form has one nonterminal (p, q) for each
pair of states between which a legal sequence can run, the rules (p, q) -> (p, r) (r, q), and as terminals the rows, each
kept, reroled or deleted, with free insertions on both sides (the insertion closure). A cell of the table holds the least
(cost, audit) of a span for each nonterminal. Since every nonterminal that spans a border of rows passes through some state
there, all derivations of a span go through each of its split points: one split a span suffices, and the spans of 1, 2, 4,
... rows are combined bottom-up. For the same reason a conversation may be cut anywhere: rows are sorted by conversation
and place over all tasks, each task parses the runs it holds, and the cells of a conversation's runs are combined at last.

Audits of one cell and cost never begin one another (both have every row's edit, so the longer would cost more), which is
why the least audit of a span is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import shuffle_parts, stage
from bramble.llm.word_ids import small_batches

REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: State after each role initial: 0 nothing yet, 1 an opening s, 2 a u that wants its a, 3 a complete pair.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: States in which a sequence may end.
ENDS = (0, 3)
#: Span lengths up to which equal spans share their cells, and how many such spans a worker keeps.
SHARED_ROWS, SHARED_SPANS = 16, 8_192

_REACH = {(p, p) for p in range(4)}
while more := {(p, q) for p, r in _REACH for (_, r2), q in STEPS.items() if r == r2} - _REACH:
    _REACH |= more
#: The nonterminals, and for each one the pairs of nonterminals of its rules.
SYMBOLS = sorted(_REACH)
_AT = {s: i for i, s in enumerate(SYMBOLS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in SYMBOLS]

#: A cell: for each nonterminal the least (cost, audit), or None.
Cell = list

_cells: dict[str, Cell] = {}


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = left[i], right[j]
            if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                new = (a[0] + b[0], a[1] + b[1])
                best = new if best is None else min(best, new)
        out.append(best)
    return out


def insertions() -> Cell:
    """The cell of an empty span: users and assistants put in."""
    best = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(best.items()):
            for (initial, r2), q in STEPS.items():
                if initial in "ua" and r == r2:
                    best[p, q] = min(best.get((p, q), (99, "")), (cost + INSERT, audit + "I"))
    return [best.get(s) for s in SYMBOLS]


_INSERTED = insertions()


def terminal(kind: str) -> Cell:
    """The cell of one row. kind: its role initial (o: none that a legal sequence has), upper case if it is truncated, or
    D if it must go."""
    edits = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "D":
        more = CUT_SHORT if kind.isupper() else 0
        for (initial, p), q in STEPS.items():
            if initial == kind.lower():
                edits[p, q] = (more, "K")
            elif initial in "ua":
                edits[p, q] = (REROLE + more, "R")
    return combine(combine(_INSERTED, [edits.get(s) for s in SYMBOLS]), _INSERTED)


def _shared(kinds: str) -> Cell:
    cell = _cells.get(kinds)
    if cell is None:
        if len(kinds) == 1:
            cell = terminal(kinds)
        else:
            half = 1 << ((len(kinds) - 1).bit_length() - 1)
            cell = combine(_shared(kinds[:half]), _shared(kinds[half:]))
        if len(_cells) >= SHARED_SPANS:
            _cells.clear()
        _cells[kinds] = cell
    return cell


def parse(kinds: str) -> Cell:
    """The cell of a sequence of rows, bottom-up by span length."""
    spans = [_shared(kinds[i : i + SHARED_ROWS]) for i in range(0, len(kinds), SHARED_ROWS)] or [_INSERTED]
    while len(spans) > 1:
        spans = [combine(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(c for q in ENDS if (c := cell[_AT[0, q]]) is not None)


def _key(col: str) -> Column:
    """A string that tells ids apart, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, copies) of rows(conv_id, turn, role, text): what the contract's damage leaves, null roles and
    texts as one space; copies is 2 for a row that is repeated."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.col("kind"), F.coalesce("text", F.lit(" "))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20).where("kind <> 0")
    return rows.select(
        _key("conv_id").alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """(key, turn, role, h, n, blank, cut, fresh): equal rows of a turn once, n of them; fresh: the conversation has no such
    role and text in an earlier turn."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("key", "turn", "role", F.sha2("text", 256).alias("h"), "copies", blank.alias("blank"), cut.alias("cut"))
    light = stage(light.groupBy("key", "turn", "role", "h", "blank", "cut").agg(F.sum("copies").alias("n")), "turns")
    # nulls first: a struct with the flag sorts as the turns do
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = light.where("not blank").groupBy("key", "role", "h").agg(F.min(turn).alias("first"), F.count("*").alias("met")).where("met > 1")
    return light.join(first.drop("met"), ["key", "role", "h"], "left").select("key", "turn", "role", "h", "n", "blank", "cut", F.coalesce(F.col("first") == turn, F.lit(True)).alias("fresh"))


class _Run:
    """Adjoining rows of one conversation in one task: their kinds, faults, turns and outer initials."""

    def __init__(self, key: str):
        self.key, self.kinds = key, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role: str, n: int, blank: bool, cut: bool, fresh: bool) -> None:
        initial = role[:1]
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank or not fresh:
            self.kinds.append("D" * n)
            self.blank, self.duplicate = self.blank + n * blank, self.duplicate + n * (not blank)
            return
        kind = initial if initial in ("s", "u", "a") else "o"
        self.kinds.append((kind.upper() if cut else kind) + "D" * (n - 1))
        self.truncated, self.duplicate = self.truncated + cut, self.duplicate + n - 1


_RUN = "key string, part int, edge boolean, facts array<long>, low long, high long, first string, last string, cost long, audit string, costs array<long>, audits array<string>"


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of conversations by task, of rows in their order. Only the first and last run of a task can go on in another
    one (edge): they bring their whole cell, the others their cheapest repair."""

    def parsed(batches):
        part, run, first, out = TaskContext.get().partitionId(), None, True, []

        def flush(run, edge):
            cell = parse("".join(run.kinds))
            cost, audit = (None, None) if edge else cheapest(cell)
            facts = [run.blank, run.duplicate, run.truncated, run.illegal, run.distinct]
            cells = [c or (-1, "") for c in cell] if edge else []
            out.append((run.key, part, edge, facts, run.low, run.high, run.first, run.last, cost, audit, [c for c, _ in cells], [a for _, a in cells]))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "n", "blank", "cut", "fresh")), strict=True):
                if run is None or row[0] != run.key:
                    if run is not None:
                        flush(run, first)
                        first = False
                    run = _Run(row[0])
                run.add(*row[1:])
            if len(out) >= 1_000:
                yield batch_of(out)
                out.clear()
        if run is not None:
            flush(run, True)
        if out:
            yield batch_of(out)

    return rows.mapInArrow(parsed, _RUN)


_NAMES = [c.split()[0] for c in _RUN.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in _RUN.split(", ")]
_HEAD = "key string, facts array<long>, cost long, audit string"


def _joined(pdf):
    """One conversation from its runs in several tasks, at most one a task."""
    import pandas as pd

    pdf = pdf.sort_values("part")
    cell, facts, last, high, low, broken = None, [0] * 5, None, None, None, 0
    for r in pdf.itertuples():
        own = [None if c < 0 else (int(c), a) for c, a in zip(r.costs, r.audits, strict=True)]
        cell = own if cell is None else combine(cell, own)
        facts = [int(a) + int(b) for a, b in zip(facts, r.facts, strict=True)]
        broken += last is not None and last + r.first not in ("su", "ua", "au")
        if not pd.isna(r.low):
            facts[4] -= high is not None and int(r.low) == high
            low, high = int(r.low) if low is None else low, int(r.high)
        last = r.last
    cost, audit = cheapest(cell)
    return pd.DataFrame({"key": [pdf.key.iloc[0]], "facts": [[_gaps(low, high, facts[4]), *facts[:3], facts[3] + broken]], "cost": [cost], "audit": [audit]})


def _gaps(low, high, distinct: int) -> int:
    """maxTurn - minTurn + 1 - distinctTurns, beyond a long as far as a long goes."""
    return 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)


def _repairs(rows: DataFrame) -> DataFrame:
    """(key, facts, cost, audit) of each conversation that has a row; facts: gaps, blank, duplicate, truncated, illegal."""
    parts = shuffle_parts(rows.sparkSession)
    order = ["key", "turn", "role", "h"]
    runs = stage(_runs(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)), "runs")
    span = F.when(F.col("low").isNull(), 0).otherwise(F.expr("case when high >= 0 and low < 0 and high > 9223372036854775806 + low then 9223372036854775807 else high - low + 1 - facts[4] end"))
    whole = runs.where("not edge").select("key", F.concat(F.array(span.cast("long")), F.slice("facts", 1, 4)).alias("facts"), "cost", "audit")
    # a task has two edges at most, so these are few, and a conversation has one run a task
    return whole.unionByName(runs.where("edge").groupBy("key").applyInPandas(_joined, _HEAD))


def _digests(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """heads with the sha256 of the repaired conversation. The digest runs through all rows of a conversation in order, so
    they pass through one task, row by row: nothing but the digest's state and the audit is held."""
    none = F.lit(None)
    top = heads.select("key", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("h"), F.col("audit").alias("text"), F.lit(1).alias("copies"), "facts", "cost")
    body = rows.select("key", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("h"), "text", "copies", none.cast("array<long>").alias("facts"), none.cast("long").alias("cost"))
    order = ["key", "kind", "turn", "role", "h"]
    moved = top.unionByName(body).repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions(*order)

    def digest(batches):
        head, sha, at, state, parts = None, None, 0, 0, 0
        out = []

        def put(role: str, text: str):
            nonlocal parts
            sha.update((("\n" if parts else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            parts += 1

        def ready(role=None, text=None) -> None:
            """Run the audit up to and with the next row's edit, or to its end."""
            nonlocal at, state
            audit = head[1]
            while at < len(audit):
                edit = audit[at]
                if edit != "I" and role is None:
                    raise RuntimeError("an audit has more edits than its conversation has rows")
                at += 1
                if edit == "K":
                    state = STEPS[role[:1], state]
                    put(role, text)
                elif edit != "D":
                    state = 3 if state == 2 else 2
                    put("assistant" if state == 3 else "user", text if edit == "R" else "")
                if edit != "I":
                    return

        def finish():
            ready()
            out.append((head[0], head[1], head[2], head[3], sha.hexdigest()))

        def flush():
            columns = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "audit", "facts", "cost", "sha"])
            out.clear()
            return batch

        for batch in batches:
            for key, kind, role, text, copies, facts, cost in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "role", "text", "copies", "facts", "cost")), strict=True):
                if kind == 0:
                    if head is not None:
                        finish()
                    head, sha, at, state, parts = (key, text, facts, cost), hashlib.sha256(), 0, 0, 0
                else:
                    for _ in range(copies):
                        ready(role, text)
            if len(out) >= 1_000:
                yield flush()
        if head is not None:
            finish()
        if out:
            yield flush()

    return moved.select("key", "kind", "role", "text", "copies", "facts", "cost").mapInArrow(digest, "key string, audit string, facts array<long>, cost long, sha string")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of
    conversations(conv_id, turn, role, text), after the contract's damage.

    Rows of one turn are taken by role, then by the SHA-256 of the text, so results do not depend on the rows' order.
    Rows with a null conv_id are one conversation, with a null id. Null roles and texts are one space; a role that is empty
    or begins with another letter than s, u, a can only be reroled or deleted. Repeated rows count as often as they stand.
    A conversation of which no row is left has zeros, an empty audit and the digest of nothing. An empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    small_batches(conversations.sparkSession)
    source = conversations.select("conv_id", "turn", "role", "text")
    rows = damaged(source)
    done = _digests(_repairs(_faults(rows)), rows)
    ids = source.select("conv_id").distinct().select("conv_id", _key("conv_id").alias("key"))
    fact = lambda i: F.coalesce(F.element_at("facts", i + 1), F.lit(0)).cast("long")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal")
    return ids.join(done, "key", "left").select(
        "conv_id", *[fact(i).alias(n) for i, n in enumerate(names)], F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
