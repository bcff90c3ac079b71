"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

A conversation is legal when its role initials are ``(s?(ua)+)?``. An LR(0) automaton is built
from that grammar, and a graph-structured stack holds every parse that is still open: stacks
share their lower parts, and stacks with equal tops and links are merged by the least
``(cost, audit)``. Each turn may be kept, given another role or deleted, and turns may be
inserted anywhere. Texts are only streamed: what a conversation holds in memory is its audit
and at most ``HELD_BYTES`` of text, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.arrow_text import trimmed
from sensorloom.session import sized_side

# The role grammar, and what edits cost.
GRAMMAR = [("conversation", ""), ("conversation", "P"), ("conversation", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua")]
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}

HELD_BYTES = 1 << 20
HELD_TURNS = 2048
CACHED_TURNS = 64

Item = tuple[int, int]


def _closure(items: set[Item]) -> frozenset[Item]:
    found, open_ = set(items), list(items)
    while open_:
        rule, dot = open_.pop()
        wanted = GRAMMAR[rule][1][dot : dot + 1]
        for i, (head, _) in enumerate(GRAMMAR):
            if head == wanted and (i, 0) not in found:
                found.add((i, 0))
                open_.append((i, 0))
    return frozenset(found)


def _automaton() -> tuple[list[dict[str, int]], list[tuple[str, int] | None], list[bool]]:
    """LR(0) states of ``GRAMMAR``: moves by symbol, the reduction (head, length) due, and whether the input may end."""
    states = [_closure({(i, 0) for i, (head, _) in enumerate(GRAMMAR) if head == "conversation"})]
    moves: list[dict[str, int]] = []
    for state in states:  # grows while it is walked
        row = {}
        for symbol in sorted({GRAMMAR[r][1][d] for r, d in state if d < len(GRAMMAR[r][1])}):
            target = _closure({(r, d + 1) for r, d in state if GRAMMAR[r][1][d : d + 1] == symbol})
            if target not in states:
                states.append(target)
            row[symbol] = states.index(target)
        moves.append(row)
    done = [[r for r, d in state if d == len(GRAMMAR[r][1])] for state in states]
    reductions = [next(((GRAMMAR[r][0], len(GRAMMAR[r][1])) for r in rules if GRAMMAR[r][0] != "conversation"), None) for rules in done]
    return moves, reductions, [any(GRAMMAR[r][0] == "conversation" for r in rules) for rules in done]


MOVES, REDUCTIONS, MAY_END = _automaton()

Stack = tuple[int, "Stack | None"]
BOTTOM: Stack = (0, None)


@lru_cache(maxsize=4096)
def _shift(stack: Stack, initial: str) -> Stack | None:
    """The stack after one role initial and all reductions due; None where the grammar has no such turn."""
    target = MOVES[stack[0]].get(initial)
    if target is None:
        return None
    stack = (target, stack)
    while REDUCTIONS[stack[0]] is not None:
        head, length = REDUCTIONS[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (MOVES[stack[0]][head], stack)
    return stack


@dataclass
class Past:
    """What was settled before the turns at hand: audit in pieces, hash of the repaired turns, last initial."""

    pieces: tuple[str, ...] = ()
    digest: object = None
    last: str = ""
    lines: int = 0


@dataclass(slots=True)
class Path:
    cost: int
    audit: str
    past: Past

    def before(self, other: Path) -> bool:
        """Whether this path comes first by (cost, audit)."""
        if self.cost != other.cost:
            return self.cost < other.cost
        if self.past is other.past:
            return self.audit < other.audit
        for a, b in zip((*self.past.pieces, self.audit), (*other.past.pieces, other.audit)):
            if a is b or a == b:
                continue
            shared = min(len(a), len(b))
            if a[:shared] != b[:shared]:
                return a < b
            break
        return "".join((*self.past.pieces, self.audit)) < "".join((*other.past.pieces, other.audit))


@dataclass
class Repair:
    """The open parses of one conversation, by stack. ``push`` takes turns as (initial, fault) symbols."""

    tops: dict[Stack, Path] = field(default_factory=lambda: {BOTTOM: Path(0, "", Past())})

    def _offer(self, tops: dict[Stack, Path], stack: Stack | None, path: Path) -> bool:
        if stack is None:
            return False
        held = tops.get(stack)
        if held is not None and not path.before(held):
            return False
        tops[stack] = path
        return True

    def _insertions(self) -> None:
        """Every stack that inserted turns lead to, unless it is reached more cheaply."""
        open_ = list(self.tops)
        while open_:
            stack = open_.pop()
            path = self.tops[stack]
            for initial in ROLES:
                after = _shift(stack, initial)
                if self._offer(self.tops, after, Path(path.cost + INSERT, path.audit + "I", path.past)):
                    open_.append(after)

    def push(self, initial: str, fault: str) -> None:
        self._insertions()
        after: dict[Stack, Path] = {}
        extra = TRUNCATED if fault == "t" else 0
        for stack, path in self.tops.items():
            self._offer(after, stack, Path(path.cost + DELETE, path.audit + "D", path.past))
            if fault in "bd":
                continue
            self._offer(after, _shift(stack, initial), Path(path.cost + extra, path.audit + "K", path.past))
            for role in ROLES:
                if role != initial:
                    self._offer(after, _shift(stack, role), Path(path.cost + REROLE + extra, path.audit + "R", path.past))
        # Another stack is reached from any by deleting one turn and inserting two at most.
        most = min(p.cost for p in after.values()) + DELETE + 2 * INSERT + TRUNCATED
        self.tops = {s: p for s, p in after.items() if p.cost <= most}

    def best(self) -> Path:
        self._insertions()
        ends = [p for s, p in self.tops.items() if MAY_END[s[0]]]
        first = ends[0]
        for path in ends[1:]:
            if path.before(first):
                first = path
        return first

    def settle(self, turns: list[tuple[str, str]]) -> None:
        """Hash the repaired form of ``turns``, which all paths have just been through, so that they can go."""
        self.tops = {s: Path(p.cost, "", settled(p, turns)) for s, p in self.tops.items()}


def repaired(audit: str, turns: list[tuple[str, str]], last: str = "") -> Iterator[tuple[str, str]]:
    """Turns (role, text) that the edits leave; ``last`` is the role initial before them.

    Edits determine roles: a turn that is inserted or gets another role is the user's, unless the user had the last one.
    """
    source = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit in "RI":
            role = ROLES["a" if last == "u" else "u"]
        last = role[:1]
        yield role, text


def settled(path: Path, turns: list[tuple[str, str]]) -> Past:
    past = path.past
    digest = past.digest.copy() if past.digest else hashlib.sha256()
    last, lines = past.last, past.lines
    for role, text in repaired(path.audit, turns, past.last):
        digest.update((("\n" if lines else "") + role + ":" + text).encode("utf-8"))
        last, lines = role[:1], lines + 1
    return Past((*past.pieces, path.audit), digest, last, lines)


@lru_cache(maxsize=1 << 16)
def _short(symbols: str) -> tuple[int, str]:
    repair = Repair()
    for i in range(0, len(symbols), 2):
        repair.push(symbols[i], symbols[i + 1])
    best = repair.best()
    return best.cost, best.audit


SPACE = "\\x20\\x09-\\x0D"

REPORT = [
    ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
    ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string"),
]


class _Conversation:
    """One conversation as its turns stream by in order."""

    def __init__(self):
        self.counts = {"b": 0, "d": 0, "t": 0, "n": 0}
        self.illegal = 0
        self.low = self.high = None
        self.distinct = 0
        self.initial: str | None = None
        self.before: tuple | None = None
        self.turns: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.held = 0
        self.repair: Repair | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str, first_turn: int | None, first_null: bool) -> None:
        row = (turn, role, text)
        initial = role[:1] or "?"
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.distinct += 1
            self.high = turn
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        # Rows are ordered by turn (null first), role and text, so copies at one turn are neighbours.
        seen = row == self.before or (turn is not None and (first_null or first_turn < turn))
        if fault != "b" and seen:
            fault = "d"
        self.counts[fault] += 1
        self.initial, self.before = initial, row
        self.turns.append((role, text))
        self.symbols.append((initial if initial in "sua" else "?") + fault)
        self.held += len(text) + len(role)
        if self.held > HELD_BYTES or len(self.turns) > HELD_TURNS:
            self._settle()

    def _push(self) -> None:
        self.repair = self.repair or Repair()
        for initial, fault in self.symbols:
            self.repair.push(initial, fault)
        self.symbols = []

    def _settle(self) -> None:
        self._push()
        self.repair.settle(self.turns)
        self.turns, self.held = [], 0

    def report(self) -> tuple:
        if self.repair is None and len(self.turns) <= CACHED_TURNS:
            best = Path(*_short("".join(self.symbols)), Past())
        else:
            self._push()
            best = self.repair.best()
        past = settled(best, self.turns)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = (self.counts["b"], self.counts["d"], self.counts["t"])
        return (gaps, *counts, self.illegal, best.cost, "".join(past.pieces), past.digest.hexdigest())


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that make its roles legal.

    Turns are taken by number, null first; equal ones by role and text. Each turn's first fault counts: ``blank``
    (nothing but white space), ``duplicate`` (role and text came before in the conversation), ``truncated`` (the last character that is not
    white space is none of ``.!?``). A blank or duplicate turn has to be deleted. Keeping a turn costs
    0, another role (user or assistant) 1, deleting 2, inserting an empty user or assistant
    turn 5, and a truncated turn that stays 5 more. Of the cheapest edits those whose initials
    (K, R, D, I, in order) come first in ASCII are taken.

    Returns the id as ``conv_id``, ``gaps`` (numbers missing between the least and greatest turn), the number of each
    fault, ``illegal`` (neighbours whose role initials may not follow each other), ``cost``, ``audit`` and
    ``repaired_sha256`` (of the repaired ``role:text`` joined by line breaks).

    Null roles and texts count as one space. Null ids form one conversation. A role whose initial is no letter of
    the grammar, the empty one included, is never kept. Extra columns are not looked at; an empty table gives none.

    Copies are found by a hash aggregate per (conversation, role, text), then turns are sorted by
    conversation and streamed: one conversation goes through one task, as the hash of its repaired
    texts has to, but is never held.
    """
    blank = F.lit(" ")
    base = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = base.withColumn("_digest", digest)
    earliest = F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_null"), F.count("*").alias("_n")
    # Only what came twice has anything to say; the rest stays null after the join.
    repeated = marked.groupBy(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_key")).agg(*earliest).where("_n > 1").drop("_n")
    joined = marked.join(sized_side(repeated), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_key")), "left")
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), "b")
        .when(F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), "n")
        .otherwise("t")
    )
    source = joined.select("conv_id", "turn", "role", "text", fault.alias("fault"), "_first", F.coalesce("_null", F.lit(False)).alias("_null"))
    order = ["conv_id", "turn", "role", "text"]
    kind = source.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in REPORT)])
    arrow = [pa.int64() if t == "long" else pa.string() for _, t in REPORT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, None
        ids: list = []
        out: list[tuple] = []
        id_kind = None

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(ids, id_kind), *(pa.array(list(c), k) for c, k in zip(zip(*out), arrow))]
            ids.clear()
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *(n for n, _ in REPORT)])

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for conv, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or conv != current:
                    if open_ is not None:
                        ids.append(current)
                        out.append(open_.report())
                        if len(out) >= 1000:
                            yield flushed()
                    current, open_ = conv, _Conversation()
                turn_, role_, text_, fault_, first, null = values
                open_.add(turn_, role_, text_, fault_, turn_ if first is None else first, null)
        if open_ is not None:
            ids.append(current)
            out.append(open_.report())
            yield flushed()

    return source.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(trimmed(run), schema)


def damage(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """Damage turns by the crc32 of ``conv_id:turn`` modulo ``kinds``; nulls count as one space.

    0 drops a turn, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % kinds
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
        .where("_kind <> 0")
        .withColumns({
            "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
            "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")),
            "_copy": F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        })
        .select("conv_id", "turn", "role", "text")
    )
