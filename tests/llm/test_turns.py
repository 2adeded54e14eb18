"""Conversation repair against an exhaustive search, its SQL, and over many ranges."""

import hashlib
import heapq
import random
import zlib

import harness
import pytest
from codexa.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
BLANK = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        conv, role, text = " " if conv is None else str(conv), " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if harm == 4 else role
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return sorted(out, key=lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))


def cheapest(rows):
    """Cost, audit and lines by the least path over (cost, audit), one edit at a time."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        for role in ("user", "assistant"):
            if to := NEXT.get((state, role[0])):
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, f"{role}:")))
        if i < len(rows):
            role, text, gone, late = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if not gone:
                if to := NEXT.get((state, role[:1])):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, to, (*lines, f"{role}:{text}")))
                for given in ("user", "assistant"):
                    if to := NEXT.get((state, given[0])):
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, to, (*lines, f"{given}:{text}")))


def expected(data):
    out = {}
    rows = harmed(data)
    for conv in {" " if r[0] is None else str(r[0]) for r in data}:
        own = [r for r in rows if r[0] == conv]
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = cheapest(marked)
        out[None if conv == " " else int(conv)] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(spark, tmp_path, data, parts=3):
    spark.createDataFrame(data, SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    rows = turns.op13_repair_turns(spark, str(tmp_path)).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert len(got) == len(rows)
    return got


def some(rng, convs=60, most=14):
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No!", "why", " ", "", "Long? \n", "x.y", None, "é.", "same.", f"t{t}."])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            turn = rng.choice([t, t, t, t, t + 3, None])
            out += [(None if c == 7 else c, turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_exhaustive_search(spark, tmp_path, seed):
    data = some(random.Random(seed))
    assert result(spark, tmp_path, data) == expected(data)


def test_agrees_with_sql(spark):
    con = harness.connect("/root/testdata/sf0.001")
    assert harness.differences(turns.op13_repair_turns(spark, "/root/testdata/sf0.001"), con, turns.ORACLE_SQL) == ""


def test_one_conversation_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK", 500)
    rng = random.Random(9)
    data = [(1, t // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", f"w{t}!", f"w{t}"])) for t in range(900)]
    data += [(2, None, "user", f"n{i % 150}.") for i in range(300)] + some(rng, 12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark, tmp_path, data, 5) == expected(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_equal_rows(spark, tmp_path):
    data = [(5, 1, "user", "again.")] * 3000 + [(5, 2, "assistant", "ok.")] + [(6, None, None, None)] * 5
    assert result(spark, tmp_path, data) == expected(data)


def test_empty_table_and_other_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA + ", conv string, digest int").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op13_repair_turns(spark, str(tmp_path)).collect() == []
    data = [(1, 0, "user", "Hi.", "a", 1), (1, 1, "assistant", "Ho.", "b", 2)]
    spark.createDataFrame(data, SCHEMA + ", conv string, digest int").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert {r[0]: tuple(r[1:]) for r in turns.op13_repair_turns(spark, str(tmp_path)).collect()} == expected([r[:4] for r in data])


def test_very_long_text(spark, tmp_path):
    data = [(1, 0, "user", "word " * 600_000 + "."), (1, 1, "assistant", "Ho."), (2, 0, "user", "Hi."), (3, 5, "assistant", "x" * 2_000_000)]
    assert result(spark, tmp_path, data) == expected(data)
