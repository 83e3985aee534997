import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from ledgerloom.llm import queries, turns
from ledgerloom.llm.common import forget

SPACES = " \t\n\x0b\x0c\r"


def after_damage(rows):
    """conv_id -> turns (turn, role, text) in order, plainly."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        mine += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {c: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0)) for c, v in out.items()}


def cheapest(turns_, faults):
    """(cost, audit, repaired) by all sequences that can be best, comparing whole strings."""

    def rest_all(i, state, run=0):
        found = []
        if i == len(turns_) and state in ("", "a"):
            found.append((0, "", ()))
        grow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[grow]
        if run < 3:
            found += [(c + 3, "I" + a, (f"{name}:", *r)) for c, a, r in memo(i, grow, run + 1)]
        if i < len(turns_):
            (_, role, text), fault = turns_[i], faults[i]
            found += [(c + 4, "D" + a, r) for c, a, r in memo(i + 1, state, 0)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                found += [(c + 3 + more, "R" + a, (f"{name}:{text}", *r)) for c, a, r in memo(i + 1, grow, 0)]
                if role[:1] == grow or (state == "" and role[:1] == "s"):
                    found += [(c + more, "K" + a, (f"{role}:{text}", *r)) for c, a, r in memo(i + 1, role[:1], 0)]
        return [min(found)] if found else []

    memo = cache(rest_all)
    return rest_all(0, "")[0]


def expected(rows):
    out = set()
    for conv, mine in after_damage(rows).items():
        seen, faults = set(), []
        for _, role, text in mine:
            core = text.strip(SPACES)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
        numbers = [t for t, _, _ in mine if t is not None]
        cost, audit, repaired = cheapest(tuple(mine), tuple(faults))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


def made(rng, conv, n):
    roles, texts = ["user", "assistant", "system", "tool", "User", ""], ["Yes.", "No!", "cut", "a. b", " \n", "", "Why? \t", "so.\x0b"]
    return [(conv, t, rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts) + ("" if rng.random() < 0.5 else f" {t}.")) for t in range(n) if rng.random() < 0.9]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op12_repair(spark, sf_dir).collect()} == expected(rows)


@pytest.mark.parametrize("most,most_bytes,bits", [(4096, 1 << 20, 12), (3, 1 << 20, 1), (4096, 5, 2), (0, 0, 0)])
def test_short_and_long_ways_agree_with_brute_force(spark, most, most_bytes, bits):
    """Small limits send conversations through blocks of one, two or four turns."""
    rng = random.Random(most + bits)
    rows = [r for conv in range(60) for r in made(rng, conv, rng.choice([1, 2, 3, 5, 9, 14]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = turns.digest(turns.repair(turns.damaged(df), most, most_bytes, bits))
    assert {tuple(r) for r in found.collect()} == expected(rows)
    forget(spark)


def test_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 0, "assistant", "Yes."), (2, 0, None, None), (None, None, None, None), (None, 3, "user", "x."), (None, 7, "user", "y."), (3, 2, "user", "")]
    rows += [(4, -(1 << 63), "user", "a."), (4, (1 << 63) - 1, "assistant", "b.")]
    extra = [(*r, 1, "k", [1]) for r in rows]
    df = spark.createDataFrame(extra, SCHEMA + ", position long, fault string, turns array<int>")
    found = {r.conv_id: tuple(r) for r in turns.op12_repair(df).collect()}
    want = {e[0]: e for e in expected(rows)}
    assert found.keys() == want.keys()
    assert {k: v for k, v in found.items() if k != 4} == {k: v for k, v in want.items() if k != 4}
    assert found[4][2:] == want[4][2:] and found[4][1] in (None, want[4][1])
    assert turns.op12_repair(df.limit(0)).count() == 0


def test_one_conversation_of_many_equal_rows(spark):
    """Equal rows lie in several partitions; all but the first are duplicates."""
    rows = [(5, 1, "user", "Same.")] * 3000 + [(5, 2, "assistant", "Well.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS copies")
    repaired = turns.repair(df)
    found = turns.digest(repaired).collect()
    assert len(found) == 1 and found[0].duplicate == 2999 and found[0].audit == "D" * 0 + "K" + "D" * 2999 + "K"
    assert repaired.turns().where("edit <> 'D'").count() == 2


def test_dropped_conversation_stays_as_a_row(spark):
    dropped = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    for others in ([], [(-1, 0, "user", "a."), (5000, 0, "user", "a.")]):
        df = spark.createDataFrame([(*dropped, "user", "Hello."), *others], SCHEMA)
        row = turns.op12_repair(df).where(f"conv_id = {dropped[0]}").collect()
        assert [tuple(r) for r in row] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (2, 0, "system", "Be kind."), (2, 1, "user", "cut"), (3, 0, "user", "A.")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = turns.repair(df).turns().where("edit <> 'D'").orderBy("conv_id", "place").collect()
    by = {c: "".join(r.role[:1] for r in g) for c, g in itertools.groupby(kept, key=lambda r: r.conv_id)}
    assert all(re.fullmatch("(s?(ua)+)?", v) for v in by.values()) and by[1] == "ua"


def test_codes_are_prefix_free_and_ordered():
    for a, b in itertools.permutations(turns.CODES, 2):
        assert not b.startswith(a)
    assert turns.CODES == ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    assert {tuple(r) for r in queries.op12_repair(spark, sf_dir).collect()} == set(con.sql(queries.ORACLES["op12_repair"]).fetchall())
