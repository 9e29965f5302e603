"""Conversation repair: cheapest edits that make roles alternate, by the auction shortest-path algorithm.

A conversation is its rows by turn (nulls first, then role and text). A row's first fault counts:
blank, duplicate (role and text seen earlier), truncated (the last character that is no white
space is none of `.!?`). Edits keep a row (0), change its role to user or assistant (R, 1), delete
it (D, 2; required for blank and duplicate rows) or insert an empty message of either role
(I, 5); a truncated row that stays adds 5. The role initials that result are `(s?(ua)+)?`.

Nodes of the lattice are (rows read, state), the states nothing, after s, after u, after a; arcs
are edits. Every node has a price that never exceeds its true cost to the end, and on every arc
price(i) <= cost + price(j). The auction keeps a path from the start: its last node raises its
price to what its best arc asks and drops off (contraction), or, if that arc is tight, the path
goes on along it (extension), until it reaches the end; prices on it are then exact. Costs are
integers and no cycle is free, so it ends. The least of all cheapest audits is traced from the
start: letters in ASCII order, each tight arc proven by an auction from its far node, which
raises a price that was too low and so unties the arc.

Conversations are streams of sorted rows: a task holds one segment of at most `SEGMENT` rows and
the state that the rows before it left. A longer conversation is first dealt by row ranges, so
one with a third of all rows spreads over tasks: each segment finds the cost between its entry
and exit states (4 x 4), a stream of segments, last first, turns them into the prices at every
segment's end, and these are the end prices of the walk. Only the walk itself, which hashes the
repaired text from its first byte to its last, reads a conversation in one task, row by row.

Cases: a null role or text is one space, so such a text is blank and such a role has to change;
null turns come first and are one turn for order, none for gaps; null conv_ids are one
conversation; rows repeated in full are duplicates; equal turns are ordered by role and text; a
role is known by its first character, an empty role by none; other columns are not read; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import dealt, durable

SPACES = " \t\n\x0b\x0c\r"
SEGMENT = 256
RETYPE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of ending after the last row in each state: what must still be inserted.
FINISH = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_STATE = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}


def _due(state: int) -> int:
    """The state that a user or assistant message leads to: whichever is due."""
    return ASSISTANT if state == USER else USER


def _arcs(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """By state: (edit, cost, rows read, next state) of the edits of a row, in ASCII order of the edits."""
    out = []
    for state in range(4):
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, _due(state))]
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED * (fault == TRUNCATED)
            to = _STATE.get(initial)
            if to is not None and to == (SYSTEM if state == NOTHING and initial == "s" else _due(state)):
                arcs.append(("K", more, 1, to))
            arcs.append(("R", RETYPE + more, 1, _due(state)))
        out.append(tuple(arcs))
    return tuple(out)


_TABLE = {(i, f): _arcs(i, f) for i in ("u", "a", "s", "") for f in range(4)}


def arcs_of(role: str, fault: int):
    return _TABLE[role[:1] if role[:1] in _STATE else "", fault]


class Auction:
    """Prices of the lattice of some rows (their arcs by state) before states that cost `end`."""

    def __init__(self, rows: list, end: tuple[int, ...]):
        self.rows, low = rows, min(end)
        # Every row costs at least its cheapest edit, whatever comes before and after it.
        prices = [list(end)]
        for arcs in reversed(rows):
            low += min(arc[1] for by_state in arcs for arc in by_state if arc[2])
            prices.append([low] * 4)
        self.price = [p for four in reversed(prices) for p in four]
        self.exact = [False] * (4 * len(rows)) + [True] * 4
        # Nothing leads back from a later state to an earlier one: such nodes have no way to the end.
        lost = [s for s in (SYSTEM, USER, ASSISTANT) if all(end[t] == FAR for t in (SYSTEM, USER, ASSISTANT) if t >= min(s, USER))]
        for state in lost:
            self.price[state::4], self.exact[state::4] = [FAR] * (len(rows) + 1), [True] * (len(rows) + 1)

    def converge(self, origin: int) -> int:
        """The exact price of a node (4 * rows read + state), by extension and contraction of a path from it."""
        price, exact, rows = self.price, self.exact, self.rows
        path = [origin]
        while not exact[node := path[-1]]:
            i, state = divmod(node, 4)
            best, to = FAR, -1
            for _, cost, read, state_after in rows[i][state]:
                j = 4 * (i + read) + state_after
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if price[node] < best:
                price[node] = best
                if best == FAR:
                    exact[node] = True
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            exact[node] = True
        return price[origin]

    def trace(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(edit, row, state after) of the cheapest edits, the ASCII-least of them."""
        node = state
        self.converge(node)
        while (i := node // 4) < len(self.rows):
            for edit, cost, read, after in self.rows[i][node % 4]:
                j = 4 * (i + read) + after
                if cost + self.price[j] == self.price[node] and cost + self.converge(j) == self.price[node]:
                    yield edit, i, after
                    node = j
                    break


def crossing_costs(rows: list) -> list[int]:
    """The 16 costs from each entry state (slow) to each exit state (fast) of a segment."""
    by_exit = []
    for state in range(4):
        auction = Auction(rows, tuple(0 if s == state else FAR for s in range(4)))
        by_exit.append([min(FAR, auction.converge(entry)) for entry in range(4)])
    return [by_exit[x][entry] for entry in range(4) for x in range(4)]


# rows and their faults


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by the checksum of `conv_id:turn`: 1 in 20 each dropped, emptied, stripped of its ends, repeated, given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


ORDER = ["_none", "_conv", "_seg", "_kind", "_dated", "_turn", "role", "text"]


def with_faults(messages: DataFrame) -> DataFrame:
    """Rows in general form with `fault`; a row equal to the one before it is left to the stream, which sees both."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_conv"),
        F.col("turn").isNotNull().alias("_dated"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_turn"), blank("role").alias("role"), blank("text").alias("text"),
    )
    rows = rows.withColumns({"_h": F.xxhash64("role", "text"), "_g": F.xxhash64(F.lit(1), "text", "role")})
    key = ["_none", "_conv", "_h", "_g"]
    first = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_dated").alias("_first_dated"), F.min(F.when(F.col("_dated"), F.col("_turn"))).alias("_first_turn"))
    rows = rows.join(first.filter("_n > 1").drop("_n"), key, "left")
    later = F.coalesce(F.col("_dated") & (~F.col("_first_dated") | (F.col("_turn") > F.col("_first_turn"))), F.lit(False))
    inner = F.btrim("text", F.lit(SPACES))
    ends = F.right(inner, F.lit(1)).isin(".", "!", "?")
    fault = F.when(inner == "", BLANK).when(later, DUPLICATE).when(~ends, TRUNCATED).otherwise(0)
    return rows.select("_none", "_conv", "_dated", "_turn", "role", "text", fault.alias("fault"))


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        yield dict(zip(names, values, strict=True))


def _same(a: dict | None, b: dict) -> bool:
    return a is not None and all(a[c] == b[c] for c in ("_none", "_conv", "_dated", "_turn", "role", "text"))


def _fault(row: dict, before: dict | None) -> int:
    return DUPLICATE if row["fault"] != BLANK and _same(before, row) else row["fault"]


ROW = "_none boolean, _conv long, _dated boolean, _turn long, role string, text string, fault int"


def _flag_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of one task stand side by side and are all in that task."""
    before = None
    for batch in batches:
        faults = []
        for row in _rows_of(batch):
            faults.append(_fault(row, before))
            before = row
        at = batch.schema.get_field_index("fault")
        yield batch.set_column(at, "fault", pa.array(faults, pa.int32()))


def _segment_costs(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("_at")
    arcs = [arcs_of(r, f) for r, f in zip(rows.column("role").to_pylist(), rows.column("fault").to_pylist(), strict=True)]
    head = rows.slice(0, 1).select(["_none", "_conv", "_seg"])
    return head.append_column("costs", pa.array([crossing_costs(arcs)], pa.list_(pa.int64())))


def _segment_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments in descending order: the prices at each one's end."""
    conv, end = None, FINISH
    for batch in batches:
        ends = []
        for row in _rows_of(batch):
            if (row["_none"], row["_conv"]) != conv:
                conv, end = (row["_none"], row["_conv"]), FINISH
            ends.append(list(end))
            cost = row["costs"]
            end = tuple(min(FAR, *[cost[4 * a + b] + end[b] for b in range(4)]) for a in range(4))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.list_(pa.int64()))], names=["_none", "_conv", "_seg", "end"])


def ordered(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rows of every conversation in one task and in order, each long one's segments led by a row with their end prices."""
    rows = durable(with_faults(messages))
    whole = rows.groupBy("_none", "_conv").agg(F.count(F.lit(1)).alias("n"))
    long = durable(whole.filter(F.col("n") > segment).select("_none", "_conv"))
    plain = lambda df, seg: df.withColumns({"_seg": seg, "_kind": F.lit(1), "end": F.lit(None).cast("array<long>")})
    if long.isEmpty():
        every = plain(rows, F.lit(0).cast("long"))
    else:
        order = ["_none", "_conv", "_dated", "_turn", "role", "text"]
        ranged = rows.join(long, ["_none", "_conv"], "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = durable(ranged.select(*[x.split()[0] for x in ROW.split(", ")]).mapInArrow(_flag_repeats, ROW).withColumn("_at", F.monotonically_increasing_id()))
        ranged = ranged.withColumn("_seg", F.floor(F.col("_at") / segment).cast("long"))
        costs = ranged.select("_none", "_conv", "_seg", "_at", "role", "fault").groupBy("_none", "_conv", "_seg")
        costs = costs.applyInArrow(_segment_costs, "_none boolean, _conv long, _seg long, costs array<long>")
        ends = dealt(costs, ["_none", "_conv"], F.desc("_seg")).mapInArrow(_segment_ends, "_none boolean, _conv long, _seg long, end array<long>")
        heads = ends.withColumns({"_kind": F.lit(0), "_dated": F.lit(False), "_turn": F.lit(0).cast("long"), "role": F.lit(""), "text": F.lit(""), "fault": F.lit(0)})
        short = plain(rows.join(long, ["_none", "_conv"], "left_anti"), F.lit(0).cast("long"))
        every = short.unionByName(plain(ranged, F.col("_seg")).drop("_at")).unionByName(heads)
    return dealt(every, ORDER[:2], *ORDER[2:])


# the walk


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from _rows_of(batch)


class _Walk:
    """One conversation: what the rows so far come to."""

    def __init__(self):
        self.state, self.before = NOTHING, None
        self.faults, self.illegal, self.cost = [0] * 4, 0, 0
        self.low = self.high = None
        self.turns = 0

    def segment(self, rows: list[dict], end: tuple[int, ...]) -> Iterator[tuple[str, dict | None, str | None]]:
        """(edit, the row it reads, the role that results)."""
        for row in rows:
            row["fault"] = _fault(row, self.before)
            self.faults[row["fault"]] += 1
            if self.before is not None and self.before["role"][:1] + row["role"][:1] not in _LEGAL:
                self.illegal += 1
            if row["_dated"]:
                if self.high is None or row["_turn"] != self.high:
                    self.turns += 1
                self.low = row["_turn"] if self.low is None else self.low
                self.high = row["_turn"]
            self.before = row
        arcs = [arcs_of(row["role"], row["fault"]) for row in rows]
        for edit, i, after in Auction(arcs, end).trace(self.state):
            row = None if edit == "I" else rows[i]
            self.cost += next(a[1] for a in arcs[i][self.state] if a[0] == edit)
            role = None if edit == "D" else row["role"] if edit == "K" else _ROLE[after]
            self.state = after
            yield edit, row, role

    def rest(self) -> Iterator[tuple[str, None, str]]:
        """What is inserted after the last row."""
        self.cost += FINISH[self.state]
        while FINISH[self.state]:
            self.state = _due(self.state)
            yield "I", None, _ROLE[self.state]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, _Walk, Iterator]]:
    """(conversation, walk, its edits) of the sorted rows of a task; the edits are to be read before the next conversation."""
    for conv, rows in groupby(_stream(batches), key=lambda r: (r["_none"], r["_conv"])):
        walk = _Walk()

        def edits(rows=rows, walk=walk):
            for _, part in groupby(rows, key=lambda r: r["_seg"]):
                part = list(part)  # SEGMENT rows at most, and their head
                end = tuple(part[0]["end"]) if part[0]["_kind"] == 0 else FINISH
                yield from walk.segment(part[part[0]["_kind"] == 0 :], end)
            yield from walk.rest()

        yield conv, walk, edits()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    out = []
    for (none, conv), walk, edits in walks(batches):
        digest, audit, first = hashlib.sha256(), [], True
        for edit, row, role in edits:
            audit.append(edit)
            if role is not None:
                digest.update(("" if first else "\n").encode() + f"{role}:{row['text'] if row else ''}".encode())
                first = False
        out.append((none, conv, walk.gaps(), walk.faults[BLANK], walk.faults[DUPLICATE], walk.faults[TRUNCATED], walk.illegal, walk.cost, "".join(audit), digest.hexdigest()))
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)


SUMMARY = "_none boolean, _conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, place long, edit string, turn long, role string, text string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    put = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
    out = []
    for (none, conv), _, edits in walks(batches):
        for place, (edit, row, role) in enumerate(edits):
            turn = row["_turn"] if row and row["_dated"] else None
            out.append((None if none else conv, place, edit, turn, role if role is not None else row["role"], row["text"] if row else ""))
            if len(out) == 1000:
                yield put(out)
                out = []
    if out:
        yield put(out)


def repair(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): every edit of every conversation (conv_id, turn, role, text), in order of `place`.

    Rows with edit D are what was deleted; all others, in order, are the repaired conversation.
    """
    return ordered(messages, segment).mapInArrow(_edits, EDITS)


def summary(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation of `messages`: counts of faults, cost, audit and the digest of the repaired text."""
    found = ordered(messages, segment).mapInArrow(_summaries, SUMMARY)
    return found.select(F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), *[x.split()[0] for x in SUMMARY.split(", ")[2:]])


def damaged_and_repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The summary of every conversation after the test damage; one that lost all its rows is empty."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    found = summary(damage(rows), segment).withColumnRenamed("conv_id", "_id")
    zero = lambda c: F.lit(hashlib.sha256(b"").hexdigest()) if c == "repaired_sha256" else F.lit("") if c == "audit" else F.lit(0).cast("long")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return every.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.coalesce(c, zero(c)).alias(c) for c in found.columns if c != "_id"])


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tbl
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k
  FROM conversations
),
summed AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_concat([4294967295], list_transform(k, lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1]))) % 20 AS kind
  FROM keyed, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
r AS (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen
),
stats AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
),
step AS (
  SELECT conv_id, n AS i, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS ss,
         {'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'} AS su, {'c': 0, 'a': '', 't': ''} AS sa
  FROM stats
  UNION ALL
  SELECT conv_id, i, list_min([b0, {'c': fu.c + 5, 'a': 'I' || fu.a, 't': chr(10) || 'user:' || fu.t}]), list_min([bs, {'c': fu.c + 5, 'a': 'I' || fu.a, 't': chr(10) || 'user:' || fu.t}]), fu,
         list_min([ba, {'c': bu.c + 5, 'a': 'I' || bu.a, 't': chr(10) || 'user:' || bu.t}])
  FROM (
    SELECT *, list_min([bu, {'c': ba.c + 5, 'a': 'I' || ba.a, 't': chr(10) || 'assistant:' || ba.t}]) AS fu
    FROM (
      SELECT s.conv_id, s.i - 1 AS i,
        list_min([{'c': s0.c + 2, 'a': 'D' || s0.a, 't': s0.t}] || CASE WHEN NOT goes THEN [] ELSE [{'c': su.c + 1 + p, 'a': 'R' || su.a, 't': chr(10) || 'user:' || text || su.t}]
          || CASE WHEN role[1] = 'u' THEN [{'c': su.c + p, 'a': 'K' || su.a, 't': own || su.t}] WHEN role[1] = 's' THEN [{'c': ss.c + p, 'a': 'K' || ss.a, 't': own || ss.t}] ELSE [] END END) AS b0,
        list_min([{'c': ss.c + 2, 'a': 'D' || ss.a, 't': ss.t}] || CASE WHEN NOT goes THEN [] ELSE [{'c': su.c + 1 + p, 'a': 'R' || su.a, 't': chr(10) || 'user:' || text || su.t}]
          || CASE WHEN role[1] = 'u' THEN [{'c': su.c + p, 'a': 'K' || su.a, 't': own || su.t}] ELSE [] END END) AS bs,
        list_min([{'c': su.c + 2, 'a': 'D' || su.a, 't': su.t}] || CASE WHEN NOT goes THEN [] ELSE [{'c': sa.c + 1 + p, 'a': 'R' || sa.a, 't': chr(10) || 'assistant:' || text || sa.t}]
          || CASE WHEN role[1] = 'a' THEN [{'c': sa.c + p, 'a': 'K' || sa.a, 't': own || sa.t}] ELSE [] END END) AS bu,
        list_min([{'c': sa.c + 2, 'a': 'D' || sa.a, 't': sa.t}] || CASE WHEN NOT goes THEN [] ELSE [{'c': su.c + 1 + p, 'a': 'R' || su.a, 't': chr(10) || 'user:' || text || su.t}]
          || CASE WHEN role[1] = 'u' THEN [{'c': su.c + p, 'a': 'K' || su.a, 't': own || su.t}] ELSE [] END END) AS ba
      FROM step s JOIN (SELECT conv_id AS of, i, role, text, chr(10) || role || ':' || text AS own, fault NOT IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS p FROM r) q
        ON q.of IS NOT DISTINCT FROM s.conv_id AND q.i = s.i
    )
  )
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN step ON step.conv_id IS NOT DISTINCT FROM e.conv_id AND step.i = 0
"""
