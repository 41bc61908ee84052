import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from heirflow.llm import repair
from heirflow.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
PATTERN = re.compile("(s?(ua)+)?")


def damage(rows):
    """Rows after damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        found = out.setdefault(conv, [])
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        found += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, lines) by trying all edits, remembered by place, state and rows inserted in a row."""

    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        edits = []
        if i < len(rows):
            _, role, text = rows[i]
            edits.append((2, "D", None, 1))
            if marks[i] not in ("blank", "duplicate"):
                extra = 5 * (marks[i] == "truncated")
                edits.append((extra, "K", (role, text), 1))
                edits += [(1 + extra, "R", (r, text), 1) for r in ("user", "assistant")]
        if inserted < 3:
            edits += [(5, "I", (r, ""), 0) for r in ("user", "assistant")]
        for cost, letter, line, taken in edits:
            to = state if line is None else step[state].get(line[0][:1])
            if to is not None:
                rest = best(i + taken, to, 0 if taken else inserted + 1)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], (() if line is None else (f"{line[0]}:{line[1]}",)) + rest[2]))
        return min(ways, default=None)

    return best(0, "", 0)


def expected(rows, damaged=damage):
    out = {}
    for conv, found in damaged(rows).items():
        marks = faults(found)
        turns = {r[0] for r in found if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        cost, audit, lines = cheapest(tuple(found), tuple(marks))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[marks.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "well", "so on ...  \n", "", " \t", "\xa0", "Ünd.", None, "a.b", "long " * 40 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "superuser"]
    out = []
    for conv in [*range(150), None]:
        turn = 0
        for k in range(r.randint(1, 9)):
            turn += r.choice([1, 1, 1, 1, 2, 0])
            plain = r.random() < 0.7
            role = ("user", "assistant")[k % 2] if plain else r.choice(roles)
            out.append((conv, None if r.random() < 0.05 else turn, role, f"{r.randint(0, 60)}." if plain else r.choice(texts)))
    out += [(700, k // 3, r.choice(roles[:5]), r.choice(texts[:6]) if r.random() < 0.5 else f"{k}.") for k in range(230)]
    out += [(701, None, "user", "again."), (701, 3, "user", "again.")] * 40
    out += [(702, k, ("user", "assistant")[k % 2], f"{k}?") for k in range(150)]
    return out


@pytest.mark.parametrize("block, parts", [(64, None), (3, None), (64, 40), (1, 23)])
def test_report_against_trying_all_edits(spark, rows, block, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        if parts:  # conversations cut by the borders of tasks
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = repair.repair_report(repair.damaged(df), block).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(found) == len({r[0] for r in rows})
    want = expected(rows)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_numbers_decide_as_enumeration():
    """Every sequence of edits with up to two rows inserted in each gap, on short conversations."""
    r = random.Random(2)
    for _ in range(120):
        rows = [(k, r.choice(["system", "user", "assistant", "tool"]), r.choice(["a.", "b.", "c", "", f"{k}."])) for k in range(r.randint(0, 3))]
        marks = faults(rows)
        codes = {"blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED, "": 0}
        items = [repair.Item(role, text, codes[m]) for (_, role, text), m in zip(rows, marks)]
        width = 3 * len(items) + 2
        number = repair.solve(items, repair.endings(width), width)[repair.START]
        best = None
        inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
        choices = [["D"] if m in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for m in marks]
        for gaps in product(inserts, repeat=len(rows) + 1):
            for edits in product(*choices):
                initials = gaps[0] + "".join(
                    ("" if e == "D" else row[1][0] if e == "K" else e[1]) + g for e, row, g in zip(edits, rows, gaps[1:])
                )
                if PATTERN.fullmatch(initials):
                    cost = 5 * len("".join(gaps)) + sum({"D": 2, "K": 0}.get(e, 1) + 5 * (m == "truncated" and e != "D") for e, m in zip(edits, marks))
                    audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                    best = min(best or (cost, audit), (cost, audit))
        assert (number >> repair.DIGIT * width, "".join(repair.LETTERS[x] for x in repair.decode(number, width))) == best


def test_repaired_lines_and_undamaged_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."), (2, 0, "tool", "x."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA)
    by_id = {r.conv_id: r for r in repair.repair_report(repair.given(df)).collect()}
    assert (by_id[1].cost, by_id[1].audit) == (2, "KDKK") and (by_id[2].cost, by_id[2].audit) == (2, "D") and by_id[3].blank == 1
    for block in (64, 1):
        lines = {}
        for r in sorted(repair.repaired(repair.given(df), block).collect(), key=lambda r: (r.part, r.number)):
            lines[r.conv_id] = lines.get(r.conv_id, []) + r.lines
        assert lines == {1: ["system:Be kind.", "user:Are you there?", "assistant:Yes."], 2: [], 3: []}


def test_empty_clashing_and_dropped(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(repair.damaged(none)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "All of it.")]
    extra = spark.createDataFrame([(*r, "k", 3, True, "h") for r in rows], SCHEMA + ", kind string, copies int, gone boolean, h string")
    path = str(tmp_path)
    extra.write.parquet(path + "/conversations.parquet")
    (row,) = op13_conversation_repair(spark, path).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
