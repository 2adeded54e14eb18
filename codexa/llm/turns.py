"""Conversation structure repair by cost layers of grammar states.

A conversation's roles must read ``(s?(ua)+)?``: four states (nothing yet, after
system, after user, after assistant).  Read from its end, each turn has layers of
bitsets: layer c holds the states from which the rest can be repaired for c more
than the turn's least cost.  The layer of the start state gives the cost; from
the start, each turn then takes the first letter of D, I, K, R whose target's bit
is set in the layer that is left, which is the least audit of all cheapest ones.
Costs of a turn's states differ by less than ``LAYERS``, since at most two inserts
lead to the last two states, and these lose at most a deleted system turn to the
others; so a turn's layers are one small integer, and steps between them are
looked up.

No conversation is gathered.  Rows without texts are dealt by ranges of
(conversation, turn, digest).  What a range holds of a conversation that it shares
with others tells the driver sixteen costs (entry state to exit state), and later
its exit states: two pieces a range at most.  Edits and texts are then dealt by the
same order; a second exchange gets one row of each conversation, and texts
of those alone that ranges share or that exceed ``CHUNK``.

Defined results: conv_id, turn, role and text that are null stand as one space in
keys and texts, and a null conv_id is one conversation; rows of one turn are
ordered by md5 of role and text, so equal rows lie side by side; roles with other
initials than s, u and a can't be kept; a conversation without rows after damage
has zeros, an empty audit and the digest of an empty text; an empty table gives no
rows; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut

NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 2, 3, 2, 1
LAYERS = 12
STEPS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: From each state: the state after a turn with the role that it asks for, and the letters of inserting it and of giving it to a turn.
ASKED = {NONE: (USER, "u", "U"), SYSTEM: (USER, "u", "U"), USER: (ASSISTANT, "a", "A"), ASSISTANT: (USER, "u", "U")}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
#: Characters of repaired text in a row between the last two exchanges.
CHUNK = 1 << 20
#: Equal rows of one turn that may travel with their texts; with more, their texts are merged first.
ALIKE = 1000
COUNTS = ("cost", "blank", "duplicate", "truncated", "illegal")


def _best(*states: str) -> str:
    return f"list_min(list_filter([{', '.join(states)}], lambda z: z IS NOT NULL))"


def _edit(state: str, cost: str, letter: str, line: str = "", when: str = "TRUE") -> str:
    more = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'k': printf('%08d', CAST({state}.k[1:8] AS INTEGER) + {cost}) || {state}.k[9:] || '{letter}', 't': {more}}} END"


_KEPT, _LINE = "NOT gone", "role || ':' || text"
_TURN = {
    "s0": _edit("s0", "3", "D"),
    "s1": _best(_edit("s1", "3", "D"), _edit("s0", "late", "K", _LINE, f"{_KEPT} AND ini = 's'")),
    "s2": _best(_edit("s2", "3", "D"), *[_edit(s, c, k, line, f"{_KEPT} AND {w}") for s in ("s0", "s1", "s3") for c, k, line, w in (("late", "K", _LINE, "ini = 'u'"), ("2 + late", "R", "'user:' || text", "TRUE"))]),
    "s3": _best(_edit("s3", "3", "D"), _edit("s2", "late", "K", _LINE, f"{_KEPT} AND ini = 'a'"), _edit("s2", "2 + late", "R", "'assistant:' || text", _KEPT)),
}
#: Least cost and audit of each state, turn by turn; a state is its cost in eight digits and its audit.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
c AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
g AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda j: CAST(ascii(key[j]) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 20 AS harm FROM c, bits),
e AS (SELECT conv, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g),
o AS (SELECT *, role[1] AS ini, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || ':' || text), copy) AS i FROM e),
p AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open_end, lag(ini) OVER (PARTITION BY conv ORDER BY i) AS prior FROM o),
f AS (SELECT *, blank OR seen AS gone, CASE WHEN open_end THEN 1 ELSE 0 END AS late FROM p),
dp AS (SELECT DISTINCT conv, 0 AS i, {{'k': '00000000', 't': CAST([] AS VARCHAR[])}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS s1, {{'k': '00000002I', 't': ['user:']}} AS s2, {{'k': '00000004II', 't': ['user:', 'assistant:']}} AS s3 FROM c
  UNION ALL SELECT conv, i, s0, s1, s2, {_best("s3", _edit("s2", "2", "I", "'assistant:'"))} FROM (
    SELECT conv, i, s0, s1, {_best("s2", *[_edit(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")])} AS s2, s3 FROM (
      SELECT dp.conv, CAST(dp.i + 1 AS INTEGER) AS i, {", ".join(f"{v} AS {k}" for k, v in _TURN.items())} FROM dp JOIN f ON f.conv = dp.conv AND f.i = dp.i + 1))),
n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE open_end AND NOT gone) AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
b AS (SELECT dp.conv, {_best("s0", "s3")} AS best FROM dp LEFT JOIN n USING (conv) WHERE dp.i = coalesce(n.n, 0))
SELECT u.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.k[1:8] AS BIGINT) AS cost, best.k[9:] AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM c) u JOIN b USING (conv) LEFT JOIN n USING (conv)
"""


def damage(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: rows with faults planted by crc32; copies is 0 for a dropped row and 2 for a repeated one."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(spaced("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).alias("harm"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """One row a (conversation, turn, role, text), without texts: copies, and whether it is the first of its text.  A dropped row leaves its conversation's name."""
    end = F.rtrim("text", F.lit(BLANKS))
    there = F.col("copies") > 0
    last = F.substring(end, -1, 1)
    fault = F.when(end == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("")
    skinny = rows.select("conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, _digest()).otherwise("").alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies", F.lit(1).cast("long").alias("rows"), F.lit(0).alias("first"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = skinny.filter(F.col("copies") > 0).groupBy("conv", "digest").agg(F.min(order).alias("at"))
    first = first.select("conv", F.col("at.turn").alias("turn"), "digest", F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("rows"), F.lit(1).alias("first"))
    sums = [F.max("initial").alias("initial"), F.max("fault").alias("fault"), F.sum("copies").alias("copies"), F.sum("rows").alias("rows"), F.max("first").alias("first")]
    return skinny.unionByName(first).groupBy("conv", "turn", "digest").agg(*sums)


def _digest() -> Column:
    return F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    """Dealt by ranges, so that rows that agree up to their digest lie in one."""
    order = ["conv", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, *more)


class Layers:
    """A turn's layers as bits, STATES to a layer, and steps back over turns."""

    def __init__(self):
        self.known: dict[tuple[int, str], tuple[int, int]] = {}

    @staticmethod
    def pack(costs: dict[int, int]) -> tuple[int, int]:
        """Layers above the least cost, and that cost."""
        least = min(costs.values())
        return sum(1 << (STATES * (c - least) + q) for q, c in costs.items() if c - least < LAYERS), least

    @staticmethod
    def cost(layers: int, state: int) -> int:
        """The first layer that has the state, or -1."""
        for c in range(LAYERS):
            if layers >> (STATES * c + state) & 1:
                return c
        return -1

    @staticmethod
    def at(layers: int, c: int) -> int:
        return layers >> (STATES * c) & 15 if c >= 0 else 0

    def back(self, layers: int, kind: str) -> tuple[int, int]:
        """The layers before a turn, from those behind it, and by how much the least cost grows; kind: initial, then b, d, t or nothing."""
        if (layers, kind) not in self.known:
            gone, late, steps = kind[-1] in "bd", OPEN_END * (kind[-1] == "t"), STEPS.get(kind[0], {})
            costs: dict[int, int] = {}
            for c in range(LAYERS + DELETE + 2 * INSERT):
                now = self.at(layers, c - DELETE)
                if not gone:
                    now |= sum(1 << q for q, to in steps.items() if self.at(layers, c - KEEP - late) >> to & 1)
                    now |= sum(1 << q for q in range(STATES) if self.at(layers, c - REROLE - late) >> ASKED[q][0] & 1)
                now |= sum(1 << q for q in range(STATES) if costs.get(ASKED[q][0]) == c - INSERT)
                costs |= {q: c for q in range(STATES) if now >> q & 1 and q not in costs}
            self.known[layers, kind] = self.pack(costs)
        return self.known[layers, kind]

    def run(self, kinds: list[str], end: dict[int, int]) -> tuple[list[int], list[int]]:
        """Layers and least costs before each turn, and behind the last."""
        band, base = self.pack(end)
        bands, bases = [band], [base]
        for kind in reversed(kinds):
            band, more = self.back(band, kind)
            base += more
            bands.append(band)
            bases.append(base)
        return bands[::-1], bases[::-1]

    def costs(self, bands: list[int], bases: list[int]) -> dict[int, int]:
        return {q: bases[0] + c for q in range(STATES) if (c := self.cost(bands[0], q)) >= 0}

    def trace(self, kinds: list[str], bands: list[int], bases: list[int], state: int, close: bool) -> tuple[list[str], int]:
        """The least cheapest edits of each turn, from a state, and the state behind the last; close: with inserts behind the last."""
        edits = []
        left = bases[0] + self.cost(bands[0], state)
        for i, kind in enumerate(kinds):
            gone, late, said, now, then = kind[-1] in "bd", OPEN_END * (kind[-1] == "t"), "", left - bases[i], left - bases[i + 1]
            while True:
                to, insert, give = ASKED[state]
                if self.at(bands[i + 1], then - DELETE) >> state & 1:
                    said, then = said + "D", then - DELETE
                elif self.at(bands[i], now - INSERT) >> to & 1:
                    said, state, now, then = said + insert, to, now - INSERT, then - INSERT
                    continue
                elif not gone and (kept := STEPS.get(kind[0], {}).get(state)) is not None and self.at(bands[i + 1], then - KEEP - late) >> kept & 1:
                    said, state, then = said + "K", kept, then - KEEP - late
                else:
                    said, state, then = said + give, to, then - REROLE - late
                break
            left = then + bases[i + 1]
            edits.append(said)
        while close and left:
            state, insert, _ = ASKED[state]
            left -= INSERT
            if edits:
                edits[-1] += insert
        return edits, state


#: Cost of ending in a state: two inserts after a system turn, one after a user's.
END = {NONE: 0, ASSISTANT: 0, USER: INSERT, SYSTEM: 2 * INSERT}


def _pieces(batches) -> Iterator[tuple[str, list[dict]]]:
    """Of a range in order: each conversation and its rows there."""
    conv, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    yield conv, rows
                conv, rows = r["conv"], []
            rows.append(r)
    if conv is not None:
        yield conv, rows


def _turns(rows: list[dict]) -> list[str]:
    """The kind of each row, and of one more where it has copies; those behind the first are gone alike."""
    kinds = []
    for r in rows:
        if r["copies"]:
            gone = "b" if r["fault"] == "b" else "d"
            kinds.append((r["initial"] or "-") + (r["fault"] or "." if r["first"] or r["fault"] == "b" else "d"))
            kinds += [(r["initial"] or "-") + gone] * (r["copies"] - 1)
    return kinds


def _ends(batches):
    """Of the first and the last conversation of a range: costs from each state to each, and the outer initials."""
    part, layers, first, last = TaskContext.get().partitionId(), Layers(), None, None
    for conv, rows in _pieces(batches):
        last = (conv, rows)
        first = first or last
    out = []
    for conv, rows in [first, last][: 0 if first is None else 1 if first[0] == last[0] else 2]:
        kinds = _turns(rows)
        costs = [layers.costs(*layers.run(kinds, {to: 0})) for to in range(STATES)]
        out.append((part, conv, [costs[to].get(q, -1) for q in range(STATES) for to in range(STATES)], kinds[0][0] if kinds else None, kinds[-1][0] if kinds else None))
    cols = list(zip(*out, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string()), strict=True)], names=["part", "conv", "costs", "head", "tail"])


def _stitch(ends: list) -> dict[tuple[int, str], dict]:
    """For pieces of conversations that ranges share: what the rest costs from each state, and the initial before."""
    found: dict[tuple[int, str], dict] = {}
    by_conv: dict[str, list] = {}
    for r in sorted(ends, key=lambda r: r["part"]):
        by_conv.setdefault(r["conv"], []).append(r)
    for conv, pieces in by_conv.items():
        if len(pieces) == 1:
            continue
        rest, prior = END, None
        for r in reversed(pieces):
            found[r["part"], conv] = {"end": rest, "last": r is pieces[-1]}
            ways = {q: [r["costs"][q * STATES + to] + c for to, c in rest.items() if r["costs"][q * STATES + to] >= 0] for q in range(STATES)}
            rest = {q: min(w) for q, w in ways.items() if w}
        for r in pieces:
            found[r["part"], conv]["prior"] = prior
            prior = r["tail"] or prior
    return found


def _exits(shared: dict):
    """A function from a range to the exit of each shared piece, by entry."""

    def run(batches):
        part, layers, out = TaskContext.get().partitionId(), Layers(), []
        if any(p == part for p, _ in shared):
            for conv, rows in _pieces(batches):
                if own := shared.get((part, conv)):
                    kinds = _turns(rows)
                    bands, bases = layers.run(kinds, own["end"])
                    out.append((part, conv, [layers.trace(kinds, bands, bases, q, False)[1] if layers.cost(bands[0], q) >= 0 else -1 for q in range(STATES)]))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.list_(pa.int32())), strict=True)], names=["part", "conv", "exits"])

    return run


EDITS = "conv string, turn long, digest string, edits string, cost long, blank long, duplicate long, truncated long, illegal long"


def _edits(shared: dict):
    """A function from a range to the edits of its rows, and what they count."""

    def run(batches):
        part, layers = TaskContext.get().partitionId(), Layers()
        out: list[tuple] = []
        for conv, rows in _pieces(batches):
            own = shared.get((part, conv), {"end": END, "last": True, "prior": None, "entry": NONE})
            kinds = _turns(rows)
            bands, bases = layers.run(kinds, own["end"])
            said, _ = layers.trace(kinds, bands, bases, own["entry"], own["last"])
            at, prior = 0, own["prior"]
            for r in rows:
                n, mine = r["copies"], kinds[at : at + r["copies"]]
                bad = [k[-1] for k in mine]
                wrong = 0
                for k in mine:
                    wrong += prior is not None and prior + k[0] not in LEGAL
                    prior = k[0]
                edits = "".join(said[at : at + n])
                late = sum(k[-1] == "t" and "D" not in s for k, s in zip(mine, said[at : at + n], strict=True))
                cost = DELETE * edits.count("D") + INSERT * (edits.count("u") + edits.count("a")) + REROLE * (edits.count("U") + edits.count("A")) + OPEN_END * late
                out.append((conv, r["turn"] if n else None, r["digest"] if n else "", edits, cost, bad.count("b"), bad.count("d"), bad.count("t"), wrong))
                at += n
                if len(out) >= 5000:
                    yield _batch(out, EDITS)
                    out = []
        yield _batch(out, EDITS)

    return run


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def edits(dealt: DataFrame) -> DataFrame:
    """conv, turn, digest, edits and counts of each row of a cut table in order.

    Letters: K keep, D delete, u and a insert, U and A rerole.
    """
    ends = dealt.mapInArrow(_ends, "part int, conv string, costs array<long>, head string, tail string").collect()  # two rows a range at most
    shared = _stitch(ends)
    if shared:
        exits = {(r["part"], r["conv"]): r["exits"] for r in dealt.mapInArrow(_exits(shared), "part int, conv string, exits array<int>").collect()}
        state: dict[str, int] = {}
        for part, conv in sorted(shared):
            shared[part, conv]["entry"] = state.get(conv, NONE)
            state[conv] = exits[part, conv][state.get(conv, NONE)]
    return dealt.mapInArrow(_edits(shared), EDITS)


MERGED = "conv string, part int, idx int, low long, high long, turns long, first_turn long, last_turn long, cost long, blank long, duplicate long, truncated long, illegal long, audit string, lines string, sha string"
LETTERS = str.maketrans("uaUA", "IIRR")


class _Part:
    """Sums over rows of one conversation in order, and their repaired lines, each behind a newline."""

    def __init__(self):
        self.low = self.high = self.first = self.last = None
        self.turns, self.sums, self.audit, self.lines, self.size = 0, dict.fromkeys(COUNTS, 0), [], [], 0

    def row(self, conv: str, part: int, idx: int, whole: bool) -> tuple:
        lines = "".join(self.lines)
        sha = hashlib.sha256(lines[1:].encode("utf-8", "surrogatepass")).hexdigest() if whole else None
        return (conv, part, idx, self.low, self.high, self.turns, self.first, self.last, *self.sums.values(), "".join(self.audit), None if whole else lines, sha)

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.last = turn
            self.first = turn if self.first is None else self.first
            self.low = turn if self.low is None else min(turn, self.low)
            self.high = turn if self.high is None else max(turn, self.high)

    def line(self, role: str, text: str) -> None:
        self.lines.append(f"\n{role}:{text}")
        self.size += len(role) + len(text) + 2


ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def _repaired(batches):
    """Rows of edits and texts in order to a row a conversation, or more where it may go on in another range or is long."""
    part, out, conv, now, idx, edits, first = TaskContext.get().partitionId(), [], None, _Part(), 0, "", True
    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    out.append(now.row(conv, part, idx, whole=not first and not idx))
                    first = False
                conv, now, idx, edits = r["conv"], _Part(), 0, ""
            if r["kind"] == 0:
                edits = r["edits"]
                now.audit.append(edits.translate(LETTERS))
                for c in COUNTS:
                    now.sums[c] += r[c]
                if r["digest"]:
                    now.turn(r["turn"])
            else:
                # Of equal rows, the first one's text stands for all.
                for e in edits:
                    if e != "D":
                        now.line(ROLES.get(e, r["role"]), "" if e in "ua" else r["text"])
                edits = ""
            if now.size >= CHUNK:
                out.append(now.row(conv, part, idx, whole=False))
                idx, last, now = idx + 1, now.last, _Part()
                now.last = last
            if len(out) >= 500:
                yield _batch(out, MERGED)
                out = []
    if conv is not None:
        out.append(now.row(conv, part, idx, whole=False))
    yield _batch(out, MERGED)


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _merged(batches):
    """Parts in order to a row a conversation."""
    out, conv, now = [], None, {}

    def done():
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
        sums = now["sums"]
        out.append((conv, gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], sums["cost"], "".join(now["audit"]), now["sha"] or now["hash"].hexdigest()))

    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    done()
                conv, now = r["conv"], {"low": None, "high": None, "turns": 0, "last": None, "sums": dict.fromkeys(COUNTS, 0), "audit": [], "sha": r["sha"], "hash": hashlib.sha256(), "begun": False}
            for c in COUNTS:
                now["sums"][c] += r[c]
            now["audit"].append(r["audit"])
            now["turns"] += r["turns"] - (r["turns"] > 0 and r["first_turn"] == now["last"])
            now["last"] = now["last"] if r["last_turn"] is None else r["last_turn"]
            if r["low"] is not None:
                now["low"] = r["low"] if now["low"] is None else min(now["low"], r["low"])
                now["high"] = r["high"] if now["high"] is None else max(now["high"], r["high"])
            if r["lines"]:
                now["hash"].update(r["lines"][not now["begun"] :].encode("utf-8", "surrogatepass"))
                now["begun"] = True
            if len(out) >= 500:
                yield _batch(out, RESULT)
                out = []
    if conv is not None:
        done()
    yield _batch(out, RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """conv with its faults, cost, audit and digest, of a (conv, turn, role, text, copies) table."""
    dealt = cut(_in_order(_marked(rows)))
    alike = dealt.agg(F.max("rows")).first()[0] or 0
    texts = rows.filter(F.col("copies") > 0).select("conv", "turn", _digest().alias("digest"), "role", "text")
    if alike > ALIKE:
        texts = texts.groupBy("conv", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    both = edits(dealt).withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = _in_order(both, "kind").mapInArrow(_repaired, MERGED)
    return parts.repartition("conv").sortWithinPartitions("conv", "part", "idx").mapInArrow(_merged, RESULT)


def op13_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = dict(turns.dtypes)["conv_id"]
    out = repair(damage(turns))
    return out.select(F.when(F.col("conv") != " ", F.col("conv")).cast(kind).alias("conv_id"), *out.columns[1:])
