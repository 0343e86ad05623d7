"""Repair of conversation structure by a recursive query in DuckDB, inside hash-partitioned batches.

A conversation's turns should give the role initials (s?(ua)+)?. Keeping a turn costs nothing, giving it another role
1, deleting it 2, inserting an empty one 5, and an unfinished turn that stays 5 more. Blank turns and repeats of an earlier turn
have to go. The recursion takes one turn of every conversation of a batch at a time and keeps, for each state of the
grammar, the least cost and the least audit with it: the initials of the edits (Delete, Insert, Keep, Rerole). Of two different audits of equal
cost none begins the other, so the least of a whole is made of the least of its parts.

Conversations are dealt by a hash of conv_id. One of more than LONG turns is cut into stretches of SEGMENT turns instead: equal
turns are counted before, earlier equal turns are found by an aggregate, each stretch is solved from every state to every state, and
the stretches' least costs are put together in order. Only the digest of a whole conversation has to be read in one go, turn by turn.

Defined results: null ids, roles and texts are one space; turns go by turn (null first), role, text; roles of other
initials, and the empty role, fit no place and are given another role or deleted; copies of a turn are adjacent; columns
besides conv_id, turn, role, text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

LONG, SEGMENT = 1000, 256
BATCH_ROWS, BATCH_BYTES = 8192, 64 << 20
# Costs of the edits, and of an unfinished turn that stays.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where a role of its own choice leads
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")


def _jumps() -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of up to two inserted turns; more than two only lead round."""
    out = []
    for state in NEXT:
        to = state
        for k in range(3):
            out.append((state, to, INSERT * k, "I" * k))
            to = NEXT[to]
    return out


def _moves() -> list[tuple[int, str, int, int, str, bool]]:
    """(from, initial, to, cost, letters, stays) of what can happen to a turn, insertions before it included."""
    out = []
    for state, at, cost, letters in _jumps():
        for initial in "suax":
            if (at, initial) in KEPT:
                out.append((state, initial, KEPT[at, initial], cost, letters + "K", True))
            out.append((state, initial, NEXT[at], cost + REROLE, letters + "R", True))
            out.append((state, initial, at, cost + DELETE, letters + "D", False))
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


#: turns(seg, i, turn, role, text, n, known): turn i (from 1) of a stretch, n equal ones, known: an equal one comes earlier elsewhere.
FAULTS = f"""
    CREATE TABLE faults AS
    SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS kind,
           NOT blank AND (known OR row_number() OVER (PARTITION BY seg, role, text ORDER BY i) > 1) AS repeated,
           lag(initial) OVER (PARTITION BY seg ORDER BY i) AS previous
    FROM (SELECT seg, i, turn, role, text, n, known, substring(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                 NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unfinished FROM turns)"""
WALK = f"""
    WITH RECURSIVE moves(state, kind, target, cost, letters, stays) AS (VALUES {_values(_moves())}),
    walk(seg, start, state, i, best) USING KEY (seg, start, state) AS (
        SELECT seg, s.start, s.start, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT seg FROM faults), starts s
        UNION
        SELECT w.seg, w.start, m.target, w.i + 1,
               min({{'cost': w.best.cost + m.cost + CASE WHEN m.stays AND f.unfinished THEN {UNFINISHED} ELSE 0 END + {DELETE} * (f.n - 1),
                    'audit': w.best.audit || m.letters || repeat('D', f.n - 1)}})
        FROM walk w JOIN faults f ON f.seg = w.seg AND f.i = w.i + 1
        JOIN moves m ON m.state = w.state AND m.kind = f.kind AND (NOT m.stays OR NOT (f.blank OR f.repeated))
        GROUP BY w.seg, w.start, m.target, w.i)
    SELECT seg, start, state, best.cost AS cost, best.audit AS audit
    FROM walk JOIN (SELECT seg, max(i) AS i FROM faults GROUP BY seg) USING (seg, i) ORDER BY seg, start, state"""
COUNTS = f"""
    SELECT seg, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns, sum(CASE WHEN blank THEN n ELSE 0 END)::BIGINT AS blank,
           sum(CASE WHEN blank THEN 0 WHEN repeated THEN n ELSE n - 1 END)::BIGINT AS duplicate,
           sum(CASE WHEN unfinished AND NOT blank AND NOT repeated THEN 1 ELSE 0 END)::BIGINT AS truncated,
           sum(n - 1 + CASE WHEN previous IS NULL OR previous || initial IN {LEGAL} THEN 0 ELSE 1 END)::BIGINT AS illegal,
           first(initial ORDER BY i) AS first_initial, last(initial ORDER BY i) AS last_initial
    FROM faults GROUP BY seg ORDER BY seg"""


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by the checksum of conv_id and turn: conv_id, turn, role, text, copies. A conversation with a
    dropped turn keeps one row of 0 copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    there = rows.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    gone = rows.where("fault = 0").select("conv_id").distinct()
    return there.union(gone.select("conv_id", F.lit(None).cast("long"), F.lit(""), F.lit(""), F.lit(0).cast("long")))


def plain(turns: DataFrame) -> DataFrame:
    """turns as they are, in the form that damaged() has."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role"), spaced("text"), F.lit(1).cast("long").alias("copies"))


def _whole(batches, column: str) -> Iterator:
    """Arrow tables of some thousand rows that hold all neighbouring rows of equal values of a column together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, rows, size = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            table = pa.Table.from_batches(held)
            last = pc.sum(pc.equal(table.column(column), table.column(column)[-1])).as_py()
            if last < rows:
                yield table.slice(0, rows - last)
                held = table.slice(rows - last).to_batches()
                rows, size = last, sum(h.nbytes for h in held)
    if held:
        yield pa.Table.from_batches(held)


def _numbered(keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For neighbouring equal keys: their number, the place of each within its own ones (from 1), where each number begins."""
    new = np.array([True, *(a != b for a, b in zip(keys, keys[1:]))])
    seg, first = np.cumsum(new) - 1, np.flatnonzero(new)
    return seg, np.arange(len(keys)) - first[seg] + 1, first


class Solver:
    """The recursive query over batches of turns."""

    def __init__(self, starts=(START,)):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1})
        self.db.execute(f"CREATE TABLE starts AS SELECT * FROM (VALUES {', '.join(f'({s})' for s in starts)}) AS v(start)")

    def solve(self, turns) -> tuple[list[dict], list[tuple]]:
        """turns: an Arrow table with the columns FAULTS names. Returns counts of each stretch and (seg, start, state, cost, audit)."""
        self.db.register("turns", turns)
        self.db.execute("DROP TABLE IF EXISTS faults")
        self.db.execute(FAULTS)
        self.db.unregister("turns")
        counts = self.db.execute(COUNTS)
        names = [c[0] for c in counts.description]
        return [dict(zip(names, r)) for r in counts.fetchall()], self.db.execute(WALK).fetchall()


def closed(found: dict[int, tuple[int, str]]) -> tuple[int, str, int, str]:
    """Least (cost, audit) over the states a conversation can end in, with the state before the last insertions and these."""
    return min((found[state][0] + cost, found[state][1] + letters, state, letters) for state, to, cost, letters in _jumps() if to in ENDS and state in found)


def applied(turns, audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn after the edits, deleted ones too. turns: (role, text, copies)."""
    at = 0
    for role, text, n in turns:
        while audit[at] == "I":
            state, at = NEXT[state], at + 1
            yield "I", ROLES[state], ""
        letter = audit[at]
        state = KEPT[state, role[:1]] if letter == "K" else NEXT[state] if letter == "R" else state
        yield letter, ROLES[state] if letter == "R" else role, text
        for _ in range(n - 1):
            yield "D", role, text
        at += n
    for _ in audit[at:]:
        state = NEXT[state]
        yield "I", ROLES[state], ""


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, edit string, role string, text string"
NAMES = [c.split()[0] for c in _REPORT.split(", ")]
_COUNTED = ("blank", "duplicate", "truncated", "illegal")


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _rows(schema: str, rows: list[tuple]):
    """An Arrow batch of rows."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _dealt_of(as_turns: bool):
    """Whole conversations of a task, in batches."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        solver = Solver()
        for table in _whole(batches, "key"):
            seg, place, first = _numbered(table.column("key").to_pylist())
            ids = table.column("conv_id").take(pa.array(first)).to_pylist()
            turns = table.append_column("seg", pa.array(seg)).append_column("i", pa.array(place)).append_column("known", pa.array(np.zeros(len(seg), bool)))
            alive = turns.filter(pc.greater(turns.column("n"), 0))  # the row of no copies is the last of a conversation
            counts, walked = solver.solve(alive.select(["seg", "i", "turn", "role", "text", "n", "known"]))
            ends: dict[int, dict] = {}
            for s, _, state, cost, audit in walked:
                ends.setdefault(s, {})[state] = (cost, audit)
            bounds = np.searchsorted(alive.column("seg").to_numpy(), np.arange(len(ids) + 1))
            of = {c["seg"]: c for c in counts}
            out = []
            for s, conv_id in enumerate(ids):
                c = of.get(s)
                if c is None:
                    if not as_turns:
                        out.append((conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
                    continue
                cost, audit, _, _ = closed(ends[s])
                own = alive.slice(bounds[s], bounds[s + 1] - bounds[s])
                lines = applied(zip(own.column("role").to_pylist(), own.column("text").to_pylist(), own.column("n").to_pylist()), audit, START)
                if as_turns:
                    out += [(conv_id, k, *line) for k, line in enumerate(lines)]
                else:
                    whole = "\n".join(f"{role}:{text}" for edit, role, text in lines if edit != "D").encode("utf-8", "surrogatepass")
                    out.append((conv_id, _gaps(c["low"], c["high"], c["turns"]), *(c[k] for k in _COUNTED), cost, audit, hashlib.sha256(whole).hexdigest()))
            for a in range(0, len(out), 4096):
                yield _rows(_TURNS if as_turns else _REPORT, out[a : a + 4096])

    return run


# ---- conversations of more than LONG turns ----

_CUT = "key string, conv_id long, turn long, role string, text string, n long, known boolean, seg long, i long"


def _cut(size: int):
    """Numbers the stretches of a task's sorted rows: they end with a conversation or after size rows."""

    def run(batches):
        import pyarrow as pa

        seg, i, before = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            segs, places = [], []
            for key in b.column("key").to_pylist():
                if before is not None and (key != before or i >= size):
                    seg, i = seg + 1, 0
                before, i = key, i + 1
                segs.append(seg)
                places.append(i)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(7)), pa.array(segs, pa.int64()), pa.array(places, pa.int64())], names=[c.split()[0] for c in _CUT.split(", ")])

    return run


_SOLVED = "key string, conv_id long, seg long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, start int, state int, cost long, audit string"


def _solved(batches):
    """Each stretch from every state to every state."""
    solver = Solver(NEXT)
    for table in _whole(batches, "seg"):
        counts, walked = solver.solve(table.select(["seg", "i", "turn", "role", "text", "n", "known"]))
        segs, keys, ids = (table.column(c).to_pylist() for c in ("seg", "key", "conv_id"))
        whose = dict(zip(segs, zip(keys, ids)))
        of = {c["seg"]: tuple(c.values())[1:] for c in counts}
        rows = [(*whose[s], s, *of[s], start, state, cost, audit) for s, start, state, cost, audit in walked]
        for a in range(0, len(rows), 4096):
            yield _rows(_SOLVED, rows[a : a + 4096])


_JOINED = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, seg long, start int, piece string, place long"


class _Joined:
    """A conversation's stretches, put together in order."""

    def __init__(self):
        self.counts, self.low, self.high, self.turns, self.last = [0] * 4, None, None, 0, None
        self.settled: list[str] = []  # what the audits of all states begin with
        self.ends: dict[int, tuple[int, str]] = {START: (0, "")}
        self.steps: list[tuple[int, dict]] = []  # stretch, state -> (state before, letters)

    def add(self, seg: int, stretch: tuple, ways: list[tuple[int, int, int, str]]) -> None:
        low, high, turns, *counted, first, last = stretch
        self.counts = [a + b for a, b in zip(self.counts, counted)]
        if self.last is not None and self.last + first not in LEGAL:
            self.counts[3] += 1
        if low is not None:
            self.turns += turns - (self.high == low)  # a turn that goes on over the cut
            self.low, self.high = (low if self.low is None else self.low), high
        self.last = last
        best: dict[int, tuple[int, str, int, str]] = {}
        for start, state, cost, audit in ways:
            if start in self.ends:
                so_far = (self.ends[start][0] + cost, self.ends[start][1] + audit, start, audit)
                best[state] = min(best.get(state, so_far), so_far)
        shared = commonprefix([b[1] for b in best.values()])
        self.settled.append(shared)
        self.ends = {state: (cost, audit[len(shared) :]) for state, (cost, audit, _, _) in best.items()}
        self.steps.append((seg, {state: (start, audit) for state, (_, _, start, audit) in best.items()}))

    def rows(self, key: str, conv_id: int | None) -> list[tuple]:
        """One row per stretch; the first carries what holds for the conversation."""
        cost, rest, state, letters = closed(self.ends)
        path = []
        for seg, ways in reversed(self.steps):
            start, piece = ways[state]
            path.append((seg, start, piece + letters))
            state, letters = start, ""
        path.reverse()
        places = np.cumsum([0, *(len(p[2]) for p in path)]).tolist()
        whole = (_gaps(self.low, self.high, self.turns), *self.counts, cost, "".join(self.settled) + rest)
        return [(key, conv_id, *(whole if k == 0 else (None,) * 7), *p, places[k]) for k, p in enumerate(path)]


def _joined(batches):
    """Rows come sorted by (key, seg)."""
    held, of, seg, stretch, ways = None, None, None, None, []

    def ended():
        held.add(seg, stretch, ways)
        rows = held.rows(*of)
        for a in range(0, len(rows), 4096):
            yield _rows(_JOINED, rows[a : a + 4096])

    for b in batches:
        for key, conv_id, s, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if of is not None and key != of[0]:
                yield from ended()
                held = None
            if held is None:
                held, of, seg, stretch, ways = _Joined(), (key, conv_id), s, tuple(rest[:9]), []
            elif s != seg:
                held.add(seg, stretch, ways)
                seg, stretch, ways = s, tuple(rest[:9]), []
            ways.append(tuple(rest[9:]))
    if held is not None:
        yield from ended()


_LINES = "key string, conv_id long, k long, edit string, role string, text string"


def _lines(batches):
    """Rows come sorted by (seg, i), each with the state its stretch starts from and the stretch's edits."""
    for table in _whole(batches, "seg"):
        data = table.to_pydict()
        _, _, first = _numbered(data["seg"])
        for a, z in zip(first, [*first[1:], len(data["seg"])]):
            lines = applied(zip(data["role"][a:z], data["text"][a:z], data["n"][a:z]), data["piece"][a], data["start"][a])
            out = [(data["key"][a], data["conv_id"][a], data["place"][a] + k, *line) for k, line in enumerate(lines)]
            for at in range(0, len(out), 4096):
                yield _rows(_LINES, out[at : at + 4096])


def _digest(batches):
    """Rows come sorted by (key, k): a digest is fed line by line."""
    of, digest, begun = None, None, False
    for b in batches:
        for key, edit, role, text in zip(*(b.column(c).to_pylist() for c in (0, 3, 4, 5))):
            if key != of:
                if of is not None:
                    yield _rows("key string, repaired_sha256 string", [(of, digest.hexdigest())])
                of, digest, begun = key, hashlib.sha256(), False
            if edit != "D":
                digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
    if of is not None:
        yield _rows("key string, repaired_sha256 string", [(of, digest.hexdigest())])


def _long_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations of many turns: the joined stretches and the repaired lines."""
    there = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    counted = saved(rows.where("n > 0").groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", digest), "turns-long")
    first = counted.groupBy("key", "digest").agg(F.min(there).alias("first"))
    known = counted.join(first, ["key", "digest"]).select("key", "conv_id", "turn", "role", "text", "n", (there > F.col("first")).alias("known"))
    order = ["key", "turn", "role", "text"]
    cut = saved(known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_cut(SEGMENT)), _CUT), "turns-cut")
    solved = saved(cut.repartition("seg").sortWithinPartitions("seg", "i").mapInArrow(tidy(_solved), _SOLVED), "turns-solved")
    joined = saved(solved.repartition("key").sortWithinPartitions("key", "seg", "start", "state").mapInArrow(tidy(_joined), _JOINED), "turns-joined")
    pieces = cut.join(joined.select("seg", "start", "piece", "place"), "seg").repartition("seg").sortWithinPartitions("seg", "i")
    return joined, pieces.mapInArrow(tidy(_lines), _LINES)


def _split(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations of up to LONG turns, and of the others if there are any."""
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "conv_id", "turn", "role", "text", F.col("copies").alias("n"))
    long = rows.groupBy("key").agg(F.sum("n").alias("turns")).where(F.col("turns") > LONG).select("key")
    if long.isEmpty():
        return rows, None
    long = saved(long, "turns-keys")
    return rows.join(long, "key", "left_anti"), rows.join(long, "key", "left_semi")


def _order(rows: DataFrame) -> DataFrame:
    """Dealt by conversation; within one, rows of no copies come last."""
    order = ["key", (F.col("n") == 0), "turn", "role", "text"]
    return rows.repartition("key").sortWithinPartitions(*order)


def report(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, copies), as of plain() or damaged(). One row per conv_id: gaps in its turn numbers, counts of
    faults and of adjacent roles out of order, the least cost of a repair, its audit and the digest of the repaired text."""
    short, long = _split(turns)
    out = _order(short).mapInArrow(tidy(_dealt_of(False)), _REPORT)
    if long is not None:
        joined, lines = _long_lines(long)
        digests = lines.repartition("key").sortWithinPartitions("key", "k").mapInArrow(tidy(_digest), "key string, repaired_sha256 string")
        out = out.union(joined.where("cost is not null").join(digests, "key").select(*NAMES))
    return out


def repair(turns: DataFrame) -> DataFrame:
    """turns as of plain() or damaged(). The turns after the repair, deleted ones too: conv_id, place (ascending within a conversation), edit
    (initial), role, text."""
    short, long = _split(turns)
    out = _order(short).mapInArrow(tidy(_dealt_of(True)), _TURNS)
    if long is not None:
        _, lines = _long_lines(long)
        out = out.union(lines.select("conv_id", F.col("k").alias("place"), "edit", "role", "text"))
    return out


def damaged_report(turns: DataFrame) -> DataFrame:
    return report(damaged(turns))


SQL = r"""
    WITH RECURSIVE spaced AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    sums AS (
        SELECT *, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(name, ''),
               lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS fault FROM spaced),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM sums, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substring(role, 1, 1) AS initial,
               text ~ '[\s\S]*[^\x20\x09-\x0D][\s\S]*' AS filled FROM damaged),
    judged AS (
        SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
               CASE WHEN NOT filled THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM ordered),
    grammar(base, initial, target) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
    free(base, target, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
    inserted AS (
        SELECT base, base AS target, 0 AS cost, '' AS letters, [] ::VARCHAR[] AS lines FROM free
        UNION ALL SELECT base, target, 5, 'I', [role || ':'] FROM free
        UNION ALL SELECT f.base, g.target, 10, 'II', [f.role || ':', g.role || ':'] FROM free f JOIN free g ON g.base = f.target),
    walk AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': [] ::VARCHAR[]} AS best FROM judged
        UNION ALL
        SELECT w.conv_id, w.i + 1, e.target, min({'cost': w.best.cost + n.cost + e.cost, 'audit': w.best.audit || n.letters || e.letter,
               'lines': w.best.lines || n.lines || e.lines})
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN inserted n ON n.base = w.state,
        LATERAL (SELECT n.target AS target, 2 AS cost, 'D' AS letter, [] ::VARCHAR[] AS lines
                 UNION ALL SELECT g.target, CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [j.role || ':' || j.text] FROM grammar g
                           WHERE g.base = n.target AND g.initial = j.initial AND j.fault IN ('fine', 'truncated')
                 UNION ALL SELECT f.target, CASE j.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [f.role || ':' || j.text] FROM free f
                           WHERE f.base = n.target AND j.fault IN ('fine', 'truncated')) e
        GROUP BY w.conv_id, w.i, e.target),
    repaired AS (
        SELECT w.conv_id, min({'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.letters, 'lines': w.best.lines || n.lines}) AS best
        FROM walk w JOIN (SELECT conv_id, max(i) AS i FROM judged GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i
        JOIN inserted n ON n.base = w.state AND n.target IN ('', 'a') GROUP BY w.conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
               count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
               count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
           sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""
