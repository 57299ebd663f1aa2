"""Conversations brought back to a grammar of roles by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from proofline.llm.shared import BLANKS, written

#: The grammar of role initials: an opening system turn or none, then pairs of user and assistant; or nothing at all.
#: Recursion stands on the left, so that stacks stay low. The first symbol is the start.
GRAMMAR = (("talk", ()), ("talk", ("pairs",)), ("pairs", ("opening", "u", "a")), ("pairs", ("pairs", "u", "a")), ("opening", ()), ("opening", ("s",)))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a conversation that are parsed in one go; longer conversations are parsed in blocks that are put together.
BLOCK = 4096
#: Blocks of so many rows at most are remembered by what they look like.
SHORT = 24
#: Rows of a batch that is given back.
BATCH = 1024


class Parser:
    """LR(0) tables of a grammar, and the stacks that can stand between two rows.

    A stack is a chain of cells (state, cell below); equal chains are one cell, so that all stacks of a parse share what
    they have in common. The stacks between rows are numbered; where actions conflict, each is followed.
    """

    def __init__(self, grammar: tuple = GRAMMAR) -> None:
        self.rules = (("", (grammar[0][0],)), *grammar)
        self.names = {left for left, _ in grammar}
        self.terminals = sorted({x for _, right in grammar for x in right} - self.names)
        self.states: list[frozenset] = []
        self.next: dict[tuple[int, str], int] = {}
        self._state({(0, 0)})
        self.bottom = (0, None)
        self.final = (self.next[0, grammar[0][0]], self.bottom)
        self.stacks, self._numbers = [self.bottom], {self.bottom: 0}
        for number, _ in enumerate(self.stacks):  # the list grows meanwhile
            for terminal in self.terminals:
                self.shifted(number, terminal)

    def _state(self, kernel: set) -> int:
        """The number of the state with these items (rule, dot), closed over the names behind their dots."""
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            for name in self.rules[rule][1][dot : dot + 1]:
                fresh = {(r, 0) for r, (left, _) in enumerate(self.rules) if left == name} - items
                items |= fresh
                todo += fresh
        state = frozenset(items)
        if state in self.states:
            return self.states.index(state)
        self.states.append(state)
        here = len(self.states) - 1
        for symbol in sorted({x for r, dot in state for x in self.rules[r][1][dot : dot + 1]}):
            self.next[here, symbol] = self._state({(r, dot + 1) for r, dot in state if self.rules[r][1][dot : dot + 1] == (symbol,)})
        return here

    @lru_cache(maxsize=None)
    def reduced(self, stack: tuple) -> tuple[tuple, ...]:
        """The stack, and all that its reductions lead to."""
        found, todo = {stack: None}, [stack]
        while todo:
            top = todo.pop()
            for rule, dot in sorted(self.states[top[0]]):
                left, right = self.rules[rule]
                if rule and dot == len(right):
                    below = top
                    for _ in right:
                        below = below[1]
                    made = (self.next[below[0], left], below)
                    if made not in found:
                        found[made] = None
                        todo.append(made)
        return tuple(found)

    def _goes_on(self, stack: tuple) -> bool:
        return any((stack[0], t) in self.next for t in self.terminals)

    @lru_cache(maxsize=None)
    def shifted(self, number: int, terminal: str) -> tuple[int, ...]:
        """The stacks after a terminal, reduced as far as they can go on or else end."""
        found = []
        for stack in self.reduced(self.stacks[number]):
            if (stack[0], terminal) in self.next:
                after = self.reduced((self.next[stack[0], terminal], stack))
                for top in [s for s in after if self._goes_on(s)] or [s for s in after if s == self.final]:
                    if top not in self._numbers:
                        self._numbers[top] = len(self.stacks)
                        self.stacks.append(top)
                    found.append(self._numbers[top])
        return tuple(found)

    @lru_cache(maxsize=None)
    def accepts(self, number: int) -> bool:
        """Whether the rows may end here."""
        return self.final in self.reduced(self.stacks[number])

    @lru_cache(maxsize=None)
    def inserted(self, number: int) -> tuple[tuple[int, int], ...]:
        """(stack, n): the stacks that stand after the insertion of n rows, and no fewer."""
        found, ring, n = {number: 0}, [number], 0
        while ring:
            n += 1
            ring = list(dict.fromkeys(after for s in ring for t in ROLES for after in self.shifted(s, t) if after not in found))
            found.update(dict.fromkeys(ring, n))
        return tuple(found.items())

    def step(self, tops: dict, symbol: str) -> dict:
        """The tops {stack: (cost, rank, audit)} after one more row; rank orders their audits, audit is a chain of letters.

        Tops meet between rows, before anything is inserted: an audit that ends in inserted rows is not kept. So of two
        audits at the same row neither is the beginning of the other (it would cost less by what is inserted), their order
        never changes by what follows both, and equal stacks can be merged by the least (cost, audit).
        """
        initial, fault = symbols[symbol]
        extra, best = TRUNCATED * (fault == "cut"), {}

        def offer(stack: int, cost: int, rank: int, letters: str, below: tuple) -> None:
            if stack not in best or (cost, rank, letters) < best[stack][:3]:
                best[stack] = (cost, rank, letters, below)

        for stack, (cost, rank, audit) in tops.items():
            offer(stack, cost + DELETE, rank, "D", audit)
            if fault == "bad":
                continue
            for at, n in self.inserted(stack):
                for after in self.shifted(at, initial) if initial in self.terminals else ():
                    offer(after, cost + n * INSERT + extra, rank, "I" * n + "K", audit)
                for role in ROLES:
                    for after in self.shifted(at, role):
                        offer(after, cost + n * INSERT + REROLE + extra, rank, "I" * n + "R", audit)
        ranks = {key: i for i, key in enumerate(sorted({(rank, letters) for _, rank, letters, _ in best.values()}))}
        return {stack: (cost, ranks[rank, letters], (below, letters)) for stack, (cost, rank, letters, below) in best.items()}

    def block(self, row_symbols: str, entry: int) -> tuple[tuple[int, int, str], ...]:
        """(exit, cost, audit) of the cheapest edits of a block that is entered with a stack; short ones are remembered."""
        return self._short(row_symbols, entry) if len(row_symbols) <= SHORT else self._parsed(row_symbols, entry)

    @lru_cache(maxsize=1 << 16)
    def _short(self, row_symbols: str, entry: int) -> tuple[tuple[int, int, str], ...]:
        return self._parsed(row_symbols, entry)

    def _parsed(self, row_symbols: str, entry: int) -> tuple[tuple[int, int, str], ...]:
        tops = {entry: (0, 0, None)}
        for symbol in row_symbols:
            tops = self.step(tops, symbol)
        return tuple((stack, cost, spelled(audit)) for stack, (cost, _, audit) in tops.items())

    def joined(self, tops: dict, block: dict[int, list[tuple[int, int, str]]]) -> dict:
        """tops after a whole block, given as {entry: [(exit, cost, audit)]}."""
        best: dict = {}
        for stack, (cost, rank, audit) in tops.items():
            for after, more, letters in block[stack]:
                if after not in best or (cost + more, rank, letters) < best[after][:3]:
                    best[after] = (cost + more, rank, letters, audit)
        ranks = {key: i for i, key in enumerate(sorted({(rank, letters) for _, rank, letters, _ in best.values()}))}
        return {stack: (cost, ranks[rank, letters], (below, letters)) for stack, (cost, rank, letters, below) in best.items()}

    def ended(self, tops: dict) -> tuple[int, str]:
        """(cost, audit) of the cheapest way to end."""
        ways = [(cost + n * INSERT, rank, "I" * n, audit) for stack, (cost, rank, audit) in tops.items() for at, n in self.inserted(stack) if self.accepts(at)]
        cost, _, letters, audit = min(ways, key=lambda w: w[:3])
        return cost, spelled((audit, letters))


def spelled(audit: tuple | None) -> str:
    """The letters of a chain (chain before, letters)."""
    out = []
    while audit is not None:
        audit, letters = audit
        out.append(letters)
    return "".join(reversed(out))


#: A row as one letter: its role's initial, and whether it is sound, cut (truncated) or bad (blank or duplicate).
INITIALS, FAULTS = ("u", "a", "s", ""), ("sound", "cut", "bad")
symbols = {chr(97 + 3 * i + j): (initial, fault) for i, initial in enumerate(INITIALS) for j, fault in enumerate(FAULTS)}
letter_of = {told: letter for letter, told in symbols.items()}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


@lru_cache(maxsize=1)
def parser() -> Parser:
    return Parser()


def illegal(row_symbols: str) -> int:
    """Neighbours whose role initials do not follow each other."""
    initials = [symbols[s][0] for s in row_symbols]
    return sum(pair not in LEGAL for pair in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows spoiled by the CRC-32 of conv_id:turn modulo 20; copies 0 is a dropped row.

    Nulls count as one space, as in the checksum. 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3
    repeats it, 4 makes it the user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) without nulls in role and text."""
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], copies.alias("copies"))


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Conversations in blocks (conv_id, at, value): symbols, turns and, for each stack at its entry, the cheapest edits.

    The rows here hold no texts. Equal rows are counted before they are shuffled; a row's first holder is the one with the
    smallest turn; then rows are dealt to ranges of (conv_id, turn, role, digest), so that a conversation with any share of
    all rows is spread over many tasks. A block that may not be its conversation's first is parsed from every stack.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    blank = bare == ""
    thin = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), blank.alias("blank"), (~blank & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), "copies")
    thin = written(thin.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    firsts = thin.filter("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(order).alias("_o"))
    met = thin.conv_id.eqNullSafe(F.col("_c")) & (thin.role == F.col("_r")) & (thin.digest == F.col("_d")) & thin.turn.eqNullSafe(F.col("_o.turn"))
    known = thin.join(firsts, met, "left").select("conv_id", "turn", "role", "digest", "blank", "cut", "copies", F.col("_d").isNotNull().alias("first"))
    keys = ["conv_id", "turn", "role", "digest"]
    dealt = known.repartitionByRange(*keys).sortWithinPartitions(*keys)

    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, block = TaskContext.get().partitionId() << 32, [], None
        for batch in batches:
            for conv, turn, role, blank, cut, copies, first in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "copies", "first"))):
                if block is None or block.conv != conv:
                    out += [] if block is None else [block.told()]
                    # the first conversation of a range may go on from the range before
                    block = _Block(conv, part, [0] if block is not None else None)
                    part += 1
                for copy in range(copies):
                    if len(block.row) == BLOCK:
                        out.append(block.told())
                        block = _Block(conv, part, None)
                        part += 1
                    block.add(role, turn, "bad" if blank or copy or not first else "cut" if cut else "sound", blank)
            if len(out) >= BATCH:
                yield _table(out, kind)
                out = []
        out += [] if block is None else [block.told()]
        yield _table(out, kind)

    thin_columns = ["conv_id", "turn", "role", "blank", "cut", "copies", "first"]
    return dealt.select(*thin_columns).mapInArrow(parsed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, at long, value {VALUE}")


class _Block:
    """Rows of one conversation that stand together; entries are the stacks that it can be entered with, None for any."""

    def __init__(self, conv, at: int, entries: list[int] | None) -> None:
        self.conv, self.at, self.entries = conv, at, entries
        self.row, self.turns, self.low, self.high, self.counts = [], 0, None, None, [0, 0, 0]

    def add(self, role: str, turn: int | None, fault: str, blank: bool) -> None:
        self.row.append(letter_of[role[:1] if role[:1] in INITIALS else "", fault])
        if fault != "sound":
            self.counts[0 if blank else 1 if fault == "bad" else 2] += 1
        if turn is not None and turn != self.high:  # turns rise
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def told(self) -> tuple:
        text, parse = "".join(self.row), parser()
        entries = range(len(parse.stacks)) if self.entries is None else self.entries
        ways = [{"entry": entry, "exit": after, "cost": cost, "audit": audit} for entry in entries for after, cost, audit in parse.block(text, entry)]
        value = {"first": text[:1], "last": text[-1:], "illegal": illegal(text), "turns": self.turns, "low": self.low, "high": self.high, "counts": self.counts, "ways": ways}
        return self.conv, self.at, value


VALUE = "struct<first: string, last: string, illegal: long, turns: long, low: long, high: long, counts: array<long>, ways: array<struct<entry: int, exit: int, cost: long, audit: string>>>"
_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_VALUE = pa.struct([("first", pa.string()), ("last", pa.string()), *[(n, pa.int64()) for n in ("illegal", "turns", "low", "high")], ("counts", pa.list_(pa.int64())), ("ways", _WAYS)])


def _table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], _VALUE)], ["conv_id", "at", "value"])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, audit: string>"
_SUMMARY = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])


class _Summary:
    """What the blocks of one conversation say together."""

    def __init__(self, conv) -> None:
        self.conv, self.tops, self.last, self.turns, self.low, self.high = conv, {0: (0, 0, None)}, "", 0, None, None
        self.counts, self.illegal = [0, 0, 0], 0

    def add(self, block: dict) -> None:
        ways: dict[int, list] = {}
        for way in block["ways"]:
            ways.setdefault(way["entry"], []).append((way["exit"], way["cost"], way["audit"]))
        self.tops = parser().joined(self.tops, ways)
        self.counts = [a + b for a, b in zip(self.counts, block["counts"])]
        self.illegal += block["illegal"] + (illegal(self.last + block["first"]) if block["first"] else 0)
        self.last = block["last"] or self.last
        if block["low"] is not None:
            self.turns += block["turns"] - (block["low"] == self.high)
            self.low, self.high = block["low"] if self.low is None else self.low, block["high"]

    def told(self) -> dict:
        cost, audit = parser().ended(self.tops)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip((*COUNTS, "audit"), (gaps, *self.counts, self.illegal, cost, audit)))


class _Repaired:
    """Rows of a conversation as its audit asks, told one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.head = audit, 0, 0, 0

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._row("I", None, "", "")

    def edited(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        else:
            yield self._row(edit, turn, role, text)

    def _row(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        if self.place == 0 and edit == "K" and role[:1] == "s":
            self.head = 1
        elif edit != "K":
            role = ROLES["ua"[(self.place - self.head) % 2]]
        self.at, self.place = self.at + 1, self.place + 1
        return self.place, edit, turn, role, text


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired rows (conv_id, place, edit, turn, role, text) and, before them, a row with the summary of each conversation.

    conversations has conv_id, turn, role, text and may have copies (a row's count; 0: the conversation is told, the row is
    not there). Rows stand by turn (null first), then role and the MD5 of the text. Each row has its first fault: blank,
    duplicate (role and text stand earlier in the conversation) or truncated (it does not end in . ! ?). Kept rows cost 0, a
    change of role 2, a deletion, which blanks and duplicates must have, 3, an inserted empty row 2, and a truncated row that
    stays 1 more. The cheapest edits that lead to the grammar of roles are taken, of equal ones those whose initials
    (K, R, D, I) are least in ASCII. Null roles and texts count as one space; a null conv_id is a conversation of its own; a role
    is told by its first letter, and other letters than s, u, a, or none, must be changed. An empty table gives no rows.

    The result is dealt by conv_id and ordered within its partitions. Blocks of a long conversation are parsed where they
    lie; only its rows' way to the output passes through one task in order, a batch of rows at a time and a letter a row.
    """
    rows = _rows(conversations)
    heads = _blocks(rows).select("conv_id", F.lit(0).alias("_kind"), "at", F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "value")
    texts = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("_kind"), F.col("turn").alias("at"), "role", _digest(F.col("text")).alias("digest"), "text", "copies", F.lit(None).cast(VALUE).alias("value"))
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "at", "role", "digest")
    id_type = rows.schema["conv_id"].dataType
    kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), _SUMMARY]
    names = ["conv_id", "place", "edit", "turn", "role", "text", "summary"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, edits, out = None, None, []

        def ended() -> list[tuple]:
            if edits is not None:
                return [(summary.conv, *row, None) for row in edits.inserted()]
            return [] if summary is None else [(summary.conv, 0, None, None, None, None, summary.told())]

        for batch in batches:
            for conv, kind, at, role, text, copies, value in zip(*(batch[c].to_pylist() for c in ("conv_id", "_kind", "at", "role", "text", "copies", "value"))):
                if summary is None or summary.conv != conv:
                    out += ended()
                    summary, edits = _Summary(conv), None
                if kind == 0:
                    summary.add(value)
                    continue
                if edits is None:
                    out += ended()
                    edits = _Repaired(out[-1][-1]["audit"])
                for _ in range(copies):
                    out += [(conv, *row, None) for row in edits.edited(at, role, text)]
            if out and len(out) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        out += ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    schema = f"conv_id {id_type.simpleString()}, place long, edit string, turn long, role string, text string, summary {SUMMARY}"
    return dealt.select("conv_id", "_kind", "at", "role", "text", "copies", "value").mapInArrow(told, schema)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text) of what repair leaves, places from 1 on; conversations without rows have none."""
    return repair(conversations).filter("summary is null").drop("summary")


def digests(conversations: DataFrame) -> DataFrame:
    """The summary of each conversation, and the SHA-256 of its repaired rows as role:text lines."""
    told = repair(conversations)
    kind = to_arrow_type(told.schema["conv_id"].dataType)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, head, state = None, None, None
        for batch in batches:
            out = []
            for conv, place, role, text, summary in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text", "summary"))):
                if summary is not None:
                    out += [] if head is None else [(owner, head, state.hexdigest())]
                    owner, head, state = conv, summary, hashlib.sha256()
                else:
                    state.update(f"{chr(10) * (place > 1)}{role}:{text}".encode())
            yield rows_of(out)
        if head is not None:
            yield rows_of([(owner, head, state.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], _SUMMARY), pa.array([o[2] for o in out], pa.string())], ["conv_id", "summary", "repaired_sha256"])

    schema = f"conv_id {told.schema['conv_id'].dataType.simpleString()}, summary {SUMMARY}, repaired_sha256 string"
    return told.select("conv_id", "place", "role", "text", "summary").mapInArrow(hashed, schema).select("conv_id", "summary.*", "repaired_sha256")
