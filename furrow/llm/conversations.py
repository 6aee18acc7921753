"""Repairs the structure of conversations by the cheapest edits to a grammar of roles.

A conversation's roles must read `(s?(ua)+)?` by their initials. A row may be kept (K), given the role that fits (R, 1), or deleted (D, 2: blank rows and those seen before must be);
an empty row of the role that fits may be put in anywhere (I, 5); a truncated row that stays costs 5 more. Of equally cheap edits those whose letters in order are ASCII-least count.

Rows are dealt by conversation and sorted; a task reads them in chunks. In each chunk one recursive DuckDB query advances all its conversations by a row per step, with the cheapest cost and audit for
each state of the grammar. Two audits that have consumed the same rows are never one the other's prefix at the same cost, so the least of each state is enough. A conversation longer than PIECE_ROWS goes on in the next
chunk with its states, their audits and running hashes; no task holds more than a chunk, but for an audit's letters: one byte a row and state, which the result has as well. The hash of a repaired conversation is a chain over its rows, so
one conversation can't be shared by tasks; it passes through one as a stream.

Defined results: null roles and texts count as one space. Rows are in order of turn, nulls first; rows with the same turn by role and text. A row's role must begin with s, u or a to be kept, so an empty role never is. Rows without
a conversation id form one conversation. Conversations are returned once; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import n_slices
from furrow.llm.tokens import give_back

#: Rows of a chunk, and of one conversation in it.
CHUNK_ROWS = 20_000
PIECE_ROWS = 1_000

_SPACES = r"\x20\x09-\x0D"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What each role leads to, and the role that may be put in.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FITTING = {0: ("u", "user"), 1: ("u", "user"), 2: ("a", "assistant"), 3: ("u", "user")}
_ENDS = (0, 3)
_COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows spoiled by a hash of `conv_id:turn`: some dropped, emptied, without their full stops, repeated, or of another role."""
    c = conversations
    key = F.concat(F.coalesce(c["conv_id"].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c["turn"].cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = c.select(c["conv_id"], c["turn"], F.coalesce(c["role"], F.lit(" ")).alias("role"), F.coalesce(c["text"], F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def faults(conversations: DataFrame) -> DataFrame:
    """Rows in partitions by conversation, in order, with their first fault, whether the pair with the row before is illegal and whether a turn begins."""
    c = conversations
    rows = c.select(c["conv_id"], c["turn"], F.coalesce(c["role"], F.lit(" ")).alias("role"), F.coalesce(c["text"], F.lit(" ")).alias("text")).repartition(n_slices(c), "conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("nth")]  # rows that are the same in all by the numbers they got
    own = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.select("*", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(order[0])).alias("nth"))
    initial = F.substring("role", 1, 1)
    blank, ended = ~F.col("text").rlike(f"[^{_SPACES}]"), F.col("text").rlike(rf"[.!?][{_SPACES}]*\z")
    fault = F.when(blank, "blank").when(F.col("nth") > 1, "duplicate").when(~ended, "truncated").otherwise("")
    pair = F.concat(F.lag(initial).over(own), initial)
    marked = rows.select("*", fault.alias("fault"), initial.alias("initial"))
    marked = marked.select("*", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & ~F.lag("turn").over(own).eqNullSafe(F.col("turn"))).alias("begins"))
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _moves() -> list[tuple[int, str, str, str | None, int, int]]:
    """(state, edits, last edit, initial it needs, next state, cost): some rows put in, then one edit of a row. More than two put in lead back to a state at a higher cost."""
    found = []
    for state in range(4):
        at, before = state, ""
        for _ in range(3):
            cost = _COSTS["I"] * len(before)
            found += [(state, before + "K", "K", role, to, cost) for (of, role), to in _NEXT.items() if of == at]
            found.append((state, before + "R", "R", None, _NEXT[at, _FITTING[at][0]], cost + _COSTS["R"]))
            found.append((state, before + "D", "D", None, at, cost + _COSTS["D"]))
            at, before = _NEXT[at, _FITTING[at][0]], before + "I"
    return found


#: Advances every conversation g by its row k; `rank` orders the audits a conversation came with, `entry` is the state it came with.
_STEPS = """
    WITH RECURSIVE paths(g, state, k, cost, rank, audit, entry) USING KEY (g, state) AS (
        SELECT g, state, 0::BIGINT, cost, rank, '', state FROM seeds
        UNION
        SELECT g, state, k, best.cost, best.rank, best.audit, best.entry FROM (
            SELECT p.g, m.next AS state, r.k, min({
                'cost': p.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 5 ELSE 0 END, 'rank': p.rank, 'audit': p.audit || m.edits, 'entry': p.entry}) AS best
            FROM paths p JOIN turns r ON r.g = p.g AND r.k = p.k + 1 JOIN moves m ON m.state = p.state
            WHERE m.edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.initial = r.initial))
            GROUP BY p.g, m.next, r.k))
    SELECT g, state, cost, audit, entry FROM paths"""
_TALLIES = """
    SELECT g, min(turn) AS least, max(turn) AS most, count(*) FILTER (begins) AS begun, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY g"""


class _Path:
    """The cheapest way to a state: its cost, its letters and the hash of the rows it gives."""

    def __init__(self, cost: int = 0, audit: str = "", state: int = 0):
        self.cost, self.audit, self.state, self.hash, self.empty = cost, audit, state, hashlib.sha256(), True

    def then(self, letters: str, rows: Iterator[tuple[str, str]], cost: int) -> _Path:
        """This way with more letters, those of the given (role, text) rows in order and of rows put in."""
        new = _Path(cost, self.audit + letters, self.state)
        new.hash, new.empty = self.hash.copy(), self.empty
        for letter in letters:
            role, text = ("", "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter != "K":
                role = _FITTING[new.state][1]
            new.state = _NEXT[new.state, role[:1]]
            new.hash.update(f"{'' if new.empty else chr(10)}{role}:{text}".encode())
            new.empty = False
        return new


class _Open:
    """A conversation that is being read: its paths by state, and what is counted."""

    def __init__(self, conv: Any):
        self.conv, self.paths = conv, {0: _Path()}
        self.least = self.most = None
        self.begun, self.counts = 0, dict.fromkeys(_COUNTS, 0)

    def closed(self) -> tuple:
        ends = []
        for path in self.paths.values():
            letters, state = "", path.state
            while state not in _ENDS:
                letters, state = letters + "I", _NEXT[state, _FITTING[state][0]]
            ends.append((path.cost + _COSTS["I"] * len(letters), path.audit + letters, path, letters))
        cost, audit, path, letters = min(ends, key=lambda e: e[:2])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.begun
        return (self.conv, gaps, *self.counts.values(), cost, audit, path.then(letters, iter(()), cost).hash.hexdigest())


def _advance(con: Any, pieces: list[tuple[_Open, pa.Table]]) -> None:
    """All conversations of a chunk by their rows in it."""
    if not pieces:
        return
    turns = pa.concat_tables([t.append_column("g", pa.array([g] * len(t), pa.int64())).append_column("k", pa.array(range(1, len(t) + 1), pa.int64())) for g, (_, t) in enumerate(pieces)])
    ranked = [sorted(c.paths.items(), key=lambda p: p[1].audit) for c, _ in pieces]
    seeds = pa.Table.from_pylist([{"g": g, "state": s, "cost": p.cost, "rank": rank} for g, paths in enumerate(ranked) for rank, (s, p) in enumerate(paths)], pa.schema([(n, pa.int64()) for n in ("g", "state", "cost", "rank")]))
    con.register("turns", turns.drop_columns(["role", "text"]))
    con.register("seeds", seeds)
    for g, least, most, begun, *counts in con.sql(_TALLIES).fetchall():
        c = pieces[g][0]
        c.least, c.most = (least if c.least is None else c.least), (most if most is not None else c.most)
        c.begun += begun
        c.counts = {n: c.counts[n] + v for n, v in zip(_COUNTS, counts, strict=True)}
    for g, found in groupby(sorted(con.sql(_STEPS).fetchall()), key=lambda r: r[0]):
        c, table = pieces[g]
        rows = list(zip(table["role"].to_pylist(), table["text"].to_pylist(), strict=True))
        c.paths = {state: c.paths[entry].then(audit, iter(rows), cost) for _, state, cost, audit, entry in found}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
    con.execute("CREATE TABLE moves (state BIGINT, edits VARCHAR, edit VARCHAR, initial VARCHAR, next BIGINT, cost BIGINT)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
    pieces: list[tuple[_Open, pa.Table]] = []
    opened: list[_Open] = []
    kind, rows = pa.int64(), 0

    def advanced(still_open: _Open | None = None) -> Iterator[pa.RecordBatch]:
        """The chunk's end: all conversations but the one that may go on are done."""
        _advance(con, pieces)
        done = [c.closed() for c in opened if c is not still_open]
        opened[:], pieces[:] = [c for c in opened if c is still_open], []
        if done:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"])

    for batch in batches:
        ids, kind, at = batch.column(0).to_pylist(), batch.column(0).type, 0
        table = pa.Table.from_batches([batch.select(["turn", "role", "text", "fault", "initial", "illegal", "begins"])])
        while at < len(ids):
            until = at + 1
            while until < len(ids) and until - at < PIECE_ROWS and ids[until] == ids[at]:
                until += 1
            if not opened or opened[-1].conv != ids[at]:
                opened.append(_Open(ids[at]))
            current = opened[-1]
            if pieces and pieces[-1][0] is current or rows + until - at > CHUNK_ROWS:
                yield from advanced(current)
                rows = 0
            pieces.append((current, table.slice(at, until - at)))
            rows, at = rows + until - at, until
    yield from advanced()
    con.close()
    give_back()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, the numbers of rows by first fault, illegal pairs, cost, audit and the repaired rows' hash of every conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counted = ", ".join(f"{n} long" for n in ("gaps", *_COUNTS, "cost"))
    return faults(conversations).mapInArrow(_conversations, f"conv_id {kind}, {counted}, audit string, repaired_sha256 string")


def repair_all(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """repair(), and every conv_id of `ids` that has no rows left as an empty conversation."""
    found = repair(conversations).withColumnRenamed("conv_id", "found_id").withColumn("there", F.lit(True))
    every = ids.select(ids["conv_id"]).distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["found_id"]), "left")
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", *_COUNTS, "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired_rows(conversations: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role and text of the rows that the audits give, those put in among them (without a turn)."""
    audits = repairs.select(repairs["conv_id"].alias("of"), F.posexplode(F.filter(F.split("audit", ""), lambda c: c != "")).alias("step", "edit"))
    earlier = Window.partitionBy("of").orderBy("step")
    consumed = F.sum((F.col("edit") != "I").cast("long")).over(earlier)
    audits = audits.select("of", "step", "edit", F.when(F.col("edit") != "I", consumed).alias("k"))
    rows = faults(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "nth")
    rows = rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("n"))
    joined = audits.join(rows, audits["of"].eqNullSafe(rows["conv_id"]) & (audits["k"] == rows["n"]), "left").filter("edit <> 'D'")
    place = Window.partitionBy("of").orderBy("step")
    # After an optional s, users and assistants take turns: a row's role follows from its place.
    leads = F.first(F.when((F.col("edit") == "K") & F.startswith("role", F.lit("s")), 1).otherwise(0)).over(place)
    numbered = joined.select("*", (F.row_number().over(place) - 1).alias("place"), leads.alias("leads"))
    fitting = F.when((F.col("place") - F.col("leads")) % 2 == 0, "user").otherwise("assistant")
    return numbered.select(F.col("of").alias("conv_id"), "place", "edit", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(fitting).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
