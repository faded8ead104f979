"""Conversation repair by aligning turns with the alternating role grammar.

A repaired conversation's role initials are ``(s?(ua)+)?``.  The turns of a
conversation are aligned with the grammar strings ua.., and s ua.. of every
length that a repair within the incumbent cost can reach, in one Wagner-Fischer
table a string: its column j holds the costs for the grammar string of length j.
An Ukkonen band leaves out cells that need more insertions or deletions than the
incumbent pays for.  The cheapest lengths' audits are traced back along optimal
cells, the least letter first, and compared.

Conversations are cut, in order, into blocks of at most BLOCK turns.  One that
lies in one block is aligned there.  A longer one needs its blocks' costs between
the grammar's states, the least costs to go from each block's end (from the last
block to the first), each block's exit for each entry, and the entries (from the
first to the last): no task aligns more than a block, and what passes from block
to block is a few numbers.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, small_batches

BLOCK = 256                   # turns that are aligned at once
TEXTS = 1 << 22               # characters after which a block ends too
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs
FAR = 1 << 40                 # no alignment

#: States of the grammar: nothing yet, after s, after u, after a; and what follows a state.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
CLOSE = (0, 2 * INSERT, INSERT, 0)                        # behind the last turn: what the grammar still asks for
ROLE = {"u": "user", "a": "assistant"}


# --- alignment ----------------------------------------------------------------------------
def _letter(entry: int, system: bool, j: int) -> str:
    """Letter j of the grammar string that starts in a state, with or without an s first."""
    if system:
        if j == 0:
            return "s"
        j -= 1
    return "ua"[(j + (entry == USER)) % 2]


def _state(entry: int, system: bool, j: int) -> int:
    """The state after j letters of that string."""
    return entry if j == 0 else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[_letter(entry, system, j - 1)]


def _strings(entry: int) -> list[bool]:
    return [False, True] if entry == START else [False]


def _consumed(turn: str, target: str) -> int:
    """The cost of a turn that stays as the target's letter; turn: initial and fault (b blank, d duplicate, t truncated, -)."""
    if turn[1] in "bd":
        return FAR
    late = TRUNCATED if turn[1] == "t" else 0
    if turn[0] == target:
        return KEEP + late
    return FAR if target == "s" else REROLE + late


def _incumbent(turns: str, entry: int, last: bool) -> int:
    """The cost of a simple repair: each turn stays where its initial fits, takes the next role, or goes."""
    state, cost = entry, 0
    for i in range(0, len(turns), 2):
        turn = turns[i:i + 2]
        if state == START and turn[0] == "s" and turn[1] not in "bd":
            state, cost = SYSTEM, cost + _consumed(turn, "s")
            continue
        nxt = "a" if state == USER else "u"
        stay = _consumed(turn, nxt)
        if stay >= FAR:
            cost += DELETE
        else:
            cost += stay
            state = USER if nxt == "u" else ASSISTANT
    return min(cost + CLOSE[state], DELETE * (len(turns) // 2) + CLOSE[entry]) if last else cost


def _table(turns: str, entry: int, system: bool, bound: int, last: bool) -> list[dict[int, int]]:
    """Wagner-Fischer: row i holds, by j, the cost of aligning i turns with j letters; only cells inside the band.

    A block that is not a conversation's last ends with a turn: what is inserted behind it belongs to the next block.
    """
    n = len(turns) // 2
    wide, deep = bound // INSERT, bound // DELETE
    rows: list[dict[int, int]] = [{j: INSERT * j for j in range(0, wide + 1 if n or last else 1) if not (system and j)}]
    for i in range(1, n + 1):
        turn, up, row = turns[2 * i - 2:2 * i], rows[-1], {}
        for j in range(max(0, i - deep), i + wide + 1):
            best = up.get(j, FAR) + DELETE
            if j:
                best = min(best, up.get(j - 1, FAR) + _consumed(turn, _letter(entry, system, j - 1)))
                if (i < n or last) and not (system and j == 1):
                    best = min(best, row.get(j - 1, FAR) + INSERT)
            if best <= bound:
                row[j] = best
        rows.append(row)
    return rows


def _audit(turns: str, entry: int, system: bool, rows: list[dict[int, int]], j: int, last: bool) -> str:
    """The ASCII-least audit of the alignments of all turns with j letters that cost what the table says."""
    n = len(turns) // 2
    marked, todo = {(n, j)}, [(n, j)]

    def steps(i: int, j: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits from a cell: letter, next cell, cost."""
        if i < n:
            yield "D", i + 1, j, DELETE
        to = _letter(entry, system, j)
        if (i < n or last) and to != "s":
            yield "I", i, j + 1, INSERT
        if i < n:
            stay = _consumed(turns[2 * i:2 * i + 2], to)
            if stay < FAR:
                yield ("K" if turns[2 * i] == to else "R"), i + 1, j + 1, stay

    while todo:
        i, k = todo.pop()
        for a, b in ((i - 1, k), (i, k - 1), (i - 1, k - 1)):
            if a < 0 or b < 0 or (a, b) in marked or b not in rows[a]:
                continue
            if any((x, y) == (i, k) and rows[a][b] + c == rows[i][k] for _, x, y, c in steps(a, b)):
                marked.add((a, b))
                todo.append((a, b))
    out, i, k = [], 0, 0
    while (i, k) != (n, j):
        letter, x, y = min((e, x, y) for e, x, y, c in steps(i, k) if (x, y) in marked and rows[i][k] + c == rows[x][y])
        out.append(letter)
        i, k = x, y
    return "".join(out)


@lru_cache(maxsize=1 << 12)
def exits(turns: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """From a state, for each state that the block can end in: the least cost and the least audit of that cost.

    The incumbent bounds the table of a last block.  An exit of another block can be part of the best repair though a
    cheaper one exists; no two states' costs to go differ by more than two insertions and a deletion (from any state two
    insertions lead to any but START and SYSTEM, whose s the others delete), so the bound grows by that.
    """
    bound = _incumbent(turns, entry, last) + (0 if last else 2 * INSERT + DELETE)
    n = len(turns) // 2
    best: dict[int, tuple[int, str]] = {}
    for system in _strings(entry):
        rows = _table(turns, entry, system, bound, last)
        costs: dict[int, int] = {}
        for j, c in rows[n].items():
            q = _state(entry, system, j)
            if system and j == 0:
                continue                      # the empty string is the other family's
            if not last or q in FINAL:
                costs[q] = min(costs.get(q, FAR), c)
        for q, c in costs.items():
            for j in (j for j, x in rows[n].items() if x == c and _state(entry, system, j) == q and not (system and j == 0)):
                here = (c, _audit(turns, entry, system, rows, j, last))
                best[q] = min(best.get(q, here), here)
    return best


def walk(turns: str, audit: str, entry: int) -> Iterator[tuple[int, str | None]]:
    """The rows that an audit makes: (turn's place or -1 if inserted, the role it gets, None if it keeps its own)."""
    i, state = 0, entry
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        to = "a" if state == USER else "u"
        if edit == "I":
            yield -1, ROLE[to]
        elif edit == "R":
            yield i, ROLE[to]
        else:
            to = turns[2 * i]
            yield i, None
        if edit != "I":
            i += 1
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[to]


# --- conversations ------------------------------------------------------------------------
def damaged(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df's rows as (conv, turn, role, text, gone, n) after planted damage: crc32("conv:turn") % 20 drops a row (0, kept as
    gone), empties its text (1), takes its ``[.!?]`` (2), repeats it (3, n = 2) or makes its role user (4); null role, text
    and, inside the hash, conv and turn are one space."""
    sp = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col(conv).cast("string"), sp), F.coalesce(F.col(turn).cast("string"), sp)).cast("binary")), F.lit(20))
    body = F.coalesce(F.col(text), sp)
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                     F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), sp)).alias("role"),
                     F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
                     (kind == 0).alias("gone"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number n, the fault of the first of them, and ``again``: role and text stand earlier."""
    rows = rows.groupBy("conv", "turn", "role", "text", "gone").agg(F.sum("n").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    digest = F.sha2("text", 256)
    many = (rows.filter("not gone").select("conv", "role", digest.alias("digest"), at.alias("at")).groupBy("conv", "role", "digest")
            .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
            .select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"))
    on = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (digest == F.col("_d"))
    mark = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.join(many, on, "left").select(
        "conv", "turn", "role", "text", "gone", "n", (mark == "").alias("blank"), (~mark.isin(".", "!", "?")).alias("cut"),
        (F.col("first").isNotNull() & (at > F.col("first"))).alias("again"))


_SUMS = ["rows", "turns", "blank", "duplicate", "truncated", "illegal"]
_BLOCK = ("conv {conv}, part int, seq long, whole boolean, low long, high long, " + ", ".join(f"{c} long" for c in _SUMS)
          + ", head string, tail string, marks string, cost long, audit string, digest string, roles array<string>, texts array<string>")
_LEGAL = {"su", "ua", "au"}


class _Block:
    """A run of a conversation's turns while it is read."""

    def __init__(self):
        self.turns: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.low = self.high = None
        self.size = 0
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        initial = role[:1] or " "
        if self.turns and self.turns[-1][0] + initial not in _LEGAL:
            self.illegal += 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        self.turns.append(initial + fault)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)


def _lines(turns: str, audit: str, entry: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    for i, role in walk(turns, audit, entry):
        yield f"{role}:" if i < 0 else f"{role or roles[i]}:{texts[i]}"


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows of ``_faults``, ordered over all partitions, as blocks; ``whole`` blocks are a whole conversation, aligned."""
    kind = dict(rows.dtypes)["conv"]
    schema = _BLOCK.format(conv=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        arrow: pa.Schema | None = None
        none = object()
        conv, block, seq, opened = none, _Block(), 0, True

        def close(whole: bool) -> None:
            turns = "".join(block.turns)
            row = {"conv": conv, "part": part, "seq": seq, "whole": whole, "low": block.low, "high": block.high, "rows": len(block.turns), "turns": block.distinct,
                   "blank": block.blank, "duplicate": block.duplicate, "truncated": block.truncated, "illegal": block.illegal,
                   "head": turns[:1], "tail": turns[-2:-1], "marks": turns}
            if whole:
                cost, audit = min(exits(turns, START, True).values())
                row |= {"cost": cost, "audit": audit,
                        "digest": hashlib.sha256("\n".join(_lines(turns, audit, START, block.roles, block.texts)).encode("utf-8", "surrogatepass")).hexdigest()}
            else:
                row |= {"roles": block.roles, "texts": block.texts}
            out.append(row)

        def sent() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pylist(out, arrow)
            out.clear()
            return got

        for batch in batches:
            if arrow is None:
                long, text, words = pa.int64(), pa.string(), pa.list_(pa.string())
                arrow = pa.schema([("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("seq", long), ("whole", pa.bool_()), ("low", long), ("high", long),
                                   *[(c, long) for c in _SUMS], ("head", text), ("tail", text), ("marks", text), ("cost", long), ("audit", text), ("digest", text),
                                   ("roles", words), ("texts", words)])
            for r in batch.to_pylist():
                if r["conv"] != conv or conv is none:
                    if conv is not none:
                        close(seq == 0 and not opened)     # the partition's first conversation may have begun in another
                        opened = False
                    conv, block, seq = r["conv"], _Block(), 0
                if r["gone"]:
                    continue
                for i in range(r["n"]):
                    if len(block.turns) == most or block.size >= TEXTS:
                        close(False)
                        yield sent()
                        block, seq = _Block(), seq + 1
                    block.add(r["turn"], r["role"], r["text"], "b" if r["blank"] else "d" if r["again"] or i else "t" if r["cut"] else "-")
            if out:
                yield sent()
        if conv is not none:
            close(False)
            yield sent()

    # ranges by the beginnings of role and text, so that no whole texts are sampled for them
    return (rows.repartitionByRange("conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64))
            .sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, schema))


def _state_costs(best: dict[int, tuple[int, str]]) -> list[int]:
    return [best[q][0] if q in best else FAR for q in STATES]


def _long(blocks: DataFrame) -> DataFrame:
    """Blocks of conversations that lie in more than one, or at a partition's edge: one row a conversation.

    Costs pass from the last block to the first and entries from the first to the last, in sorted partitions that hold
    the numbers of a block at a time; texts join at last, in order, in one running digest a conversation, as the digest
    asks.
    """
    kind = dict(blocks.dtypes)["conv"]
    key = F.xxhash64("conv")
    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = b.column("marks").to_pylist()
            table = [[c for p in STATES for c in _state_costs(exits(t, p, False))] for t in turns]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("seq"), pa.array(table, pa.list_(pa.int64()))], ["conv", "part", "seq", "costs"])

    step = shared_table(blocks.select("conv", "part", "seq", "marks").mapInArrow(costs, f"conv {kind}, part int, seq long, costs array<long>"), "turns-costs")

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least costs to go from the states at a block's end."""
        none = object()
        conv, go = none, []
        for b in batches:
            out = []
            for c, t in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist()):
                if conv is none or c != conv:
                    conv, go = c, list(CLOSE)
                out.append(go)
                go = [min(FAR, *(t[4 * p + q] + go[q] for q in STATES)) for p in STATES]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("seq"), pa.array(out, pa.list_(pa.int64()))], ["conv", "part", "seq", "go"])

    go = shared_table(step.repartition(key).sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
                      .mapInArrow(backward, f"conv {kind}, part int, seq long, go array<long>"), "turns-go")
    same = [F.col("conv").eqNullSafe(F.col("_c")), F.col("part") == F.col("_p"), F.col("seq") == F.col("_s")]

    def on(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"conv": "_c", "part": "_p", "seq": "_s"})

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each entry the exit on the cheapest way to the end; of equally cheap ones that of the least audit."""
        for b in batches:
            out = []
            for t, g in zip(b.column("marks").to_pylist(), b.column("go").to_pylist()):
                row = []
                for p in STATES:
                    ways = [(c + g[q], audit, q) for q, (c, audit) in exits(t, p, False).items()]
                    row.append(min(ways)[2] if ways else -1)
                out.append(row)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("seq"), pa.array(out, pa.list_(pa.int32()))], ["conv", "part", "seq", "exit"])

    ways = shared_table(blocks.select("conv", "part", "seq", "marks").join(on(go), same).select("conv", "part", "seq", "marks", "go")
                        .mapInArrow(chosen, f"conv {kind}, part int, seq long, exit array<int>"), "turns-exits")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which each block is entered, and the one in which it is left."""
        none = object()
        conv, at = none, START
        for b in batches:
            first, last = [], []
            for c, e in zip(b.column("conv").to_pylist(), b.column("exit").to_pylist()):
                if conv is none or c != conv:
                    conv, at = c, START
                first.append(at)
                at = e[at]
                last.append(at)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("seq"), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                                             ["conv", "part", "seq", "enter", "leave"])

    entered = shared_table(ways.repartition(key).sortWithinPartitions("conv", "part", "seq")
                           .mapInArrow(forward, f"conv {kind}, part int, seq long, enter int, leave int"), "turns-entries")
    placed = blocks.join(on(entered), same)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, acc = none, {}

        def done() -> pa.RecordBatch:
            for role in ("user", "assistant")[2 - CLOSE[acc["leave"]] // INSERT:]:
                acc["audit"].append("I")
                acc["cost"] += INSERT
                line(f"{role}:")
            low, high = acc["low"], acc["high"]
            return pa.RecordBatch.from_arrays(
                [acc["conv"], *[pa.array([v], pa.int64()) for v in (0 if low is None else high - low + 1 - acc["turns"], acc["blank"], acc["duplicate"], acc["truncated"],
                                                                  acc["illegal"], acc["cost"])],
                 pa.array(["".join(acc["audit"])]), pa.array([acc["sha"].hexdigest()])], _OUT)

        def line(s: str) -> None:
            if acc["some"]:
                acc["sha"].update(b"\n")
            acc["sha"].update(s.encode("utf-8", "surrogatepass"))
            acc["some"] = True

        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                if conv is none or r["conv"] != conv:
                    if conv is not none:
                        yield done()
                    conv = r["conv"]
                    acc = {"conv": b.column("conv").slice(i, 1), "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                           "audit": [], "sha": hashlib.sha256(), "some": False, "tail": ""}
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    acc[c] += r[c]
                if r["rows"]:
                    acc["illegal"] += bool(acc["tail"]) and acc["tail"] + r["head"] not in _LEGAL
                    acc["tail"] = r["tail"]
                if r["low"] is not None:
                    acc["turns"] += r["turns"] - (acc["high"] == r["low"])
                    acc["low"], acc["high"] = (r["low"] if acc["low"] is None else acc["low"]), r["high"]
                cost, audit = exits(r["marks"], r["enter"], False)[r["leave"]]
                acc["cost"] += cost
                acc["audit"].append(audit)
                acc["leave"] = r["leave"]
                for s in _lines(r["marks"], audit, r["enter"], r["roles"], r["texts"]):
                    line(s)
        if conv is not none:
            yield done()

    return (placed.select("conv", "part", "seq", "low", "high", *_SUMS, "head", "tail", "marks", "enter", "leave", "roles", "texts")
            .repartition(key).sortWithinPartitions("conv", "part", "seq").mapInArrow(joined, _SCHEMA.format(conv=kind)))


_OUT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_SCHEMA = "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, *, conv: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """One row for each conversation of ``rows`` (conv, turn, role, text, gone, n; see ``damaged``): its faults, and the cheapest repair.

    Turns are taken by turn (null first), then role and text.  A turn's first fault counts: blank, duplicate (role and
    text stand earlier), truncated.  Keeping a turn costs 0, another role 1, deleting 2 (blanks and duplicates must go), an
    empty turn put in 5; truncated turns that stay cost 5.  The null conversation is one.  Rows marked gone only name
    their conversation; one with no others has zeros, an empty audit and the digest of nothing.  Repeated rows are
    duplicates.  ``block``: turns that are aligned at once; the result is the same for any.  Other roles than system, user and assistant go by their first letter; no role by a space.  Texts may be of any length.
    """
    small_batches(rows.sparkSession)
    blocks = shared_table(_blocks(shared_table(_faults(rows), "turns"), block), "turns-blocks")
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = blocks.filter("whole").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    return whole.unionByName(_long(blocks.filter("not whole"))).withColumnRenamed("conv", conv)
