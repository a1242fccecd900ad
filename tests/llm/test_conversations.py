"""Conversation repair against a search over whole audits, and its SQL."""

import hashlib
import random
import zlib

import pytest

from voicelake.llm import conversations as C

MARKS = ".!?"
SPACE = "\t\n\x0b\x0c\r "


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in MARKS) if fault == 2 else text
        out.extend([(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1))
    return out


def plain_repair(rows):
    """Best (cost, audit) of every state of the pattern, row after row, with the text it gives."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    counts, seen, best = dict.fromkeys(C.COUNTS, 0), set(), {"": (0, "", ())}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, text) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in after[state]:
                        put(table, after[state][role[0]], (cost + 2, audit + "I", (*text, role + ":")))
        return table

    for _, turn, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in MARKS else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        new = {}
        for state, (cost, audit, said) in inserted(best).items():
            put(new, state, (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] and role[0] in after[state]:
                put(new, after[state][role[0]], (cost + extra, audit + "K", (*said, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if other[0] in after[state]:
                    put(new, after[state][other[0]], (cost + 2 + extra, audit + "R", (*said, f"{other}:{text}")))
        best = new
    ends = [v for state, v in inserted(best).items() if state in ("", "a")]
    cost, audit, said = min(ends)
    turns = {r[1] for r in rows if r[1] is not None}
    counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts["cost"] = cost
    return (*[counts[c] for c in C.COUNTS], audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def expected(rows):
    kept = plain_damage(rows)
    return {conv: plain_repair([r for r in kept if r[0] == conv]) for conv in {r[0] for r in rows}}


SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk int, place int, end string, is_live int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def result(df):
    return {r.conv_id: tuple(r[c] for c in (*C.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


@pytest.fixture(scope="module")
def conversations():
    rng, rows = random.Random(5), []
    for conv in range(160):
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 7, 20, 60])):
            turn += rng.choice([0, 1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "a", None])
            rows.append((conv, turn if rng.random() > 0.05 else None, role, rng.choice(["a.", "b", "c! ", " \t", None, "", "é?\n", "long text." * 50])))
    rows += [(None, t, "user", "same.") for t in range(30)] + [(1000, None, None, None)] * 3
    rows += [(2000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)]  # one long conversation
    rows += [(2001, t, "user", "again.") for t in range(200)] + [(2002, t, "tool", f"{t}.") for t in range(61)]
    return rows


@pytest.mark.parametrize("chunk_rows", [4, C.CHUNK_ROWS])
def test_repair_equals_the_plain_search(spark, conversations, chunk_rows):
    assert result(C.damaged_and_repaired(table(spark, conversations), chunk_rows)) == expected(conversations)


def test_only_dropped_rows_and_no_rows(spark):
    gone = [(i, 0, "user", "x.") for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    got = result(C.damaged_and_repaired(table(spark, gone)))
    assert got and set(got.values()) == {(0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}
    assert C.damaged_and_repaired(table(spark, gone).limit(0)).count() == 0


def test_vectors_of_any_end_meet():
    rng = random.Random(1)
    initials, truncated = [rng.choice("ua") for _ in range(40)], [rng.random() < 0.3 for _ in range(40)]
    shapes = {tuple(x - v[0] for x in v) for v in (C.costs_of(initials, truncated, end)[0] for end in ([0, 4, 2, 0], [0, 0, 0, 0], [0, 9, 2, 4]))}
    assert len(shapes) == 1


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from voicelake.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = QUERIES["op12_conversation_repair"](spark, folder)
    found = con.execute(ORACLES["op12_conversation_repair"])
    names = [d[0] for d in found.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())
    assert sorted(map(tuple, df.collect())) == want and want
