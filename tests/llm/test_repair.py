import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import types as T

from merchlens.llm import repair

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("role", "text")]
)
GRAMMAR = re.compile(r"(s?(ua)+)?")


def codes_of(rng, n, who="suax", faults="....tbd"):
    return "".join(rng.choice(who) + rng.choice(faults) for _ in range(n))


def enumerate_repairs(codes, most):
    """Least (cost, audit) over all edit sequences with at most ``most`` insertions between two turns."""
    n = len(codes) // 2
    best = None
    inserts = [list(itertools.product("ua", repeat=k)) for k in range(most + 1)]
    gaps = [("I" * len(x), "".join(x), 3 * len(x)) for xs in inserts for x in xs]
    options = []
    for i in range(n):
        who, fault = codes[2 * i : 2 * i + 2]
        some = [("D", "", 4)]
        if fault not in "bd":
            add = 3 if fault == "t" else 0
            some += [("K", who, add), ("R", "u", 3 + add), ("R", "a", 3 + add)]
        options += [gaps, some]
    for chosen in itertools.product(*options, gaps):
        if GRAMMAR.fullmatch("".join(c[1] for c in chosen)):
            found = sum(c[2] for c in chosen), "".join(c[0] for c in chosen)
            best = found if best is None else min(best, found)
    return best


def walked(codes):
    """Least (cost, audit) by one label per state, row by row."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(labels):
        for _ in range(2):
            for state, (cost, audit) in list(labels.items()):
                new = cost + 3, audit + "I"
                labels[step[state]] = min(new, labels.get(step[state], new))
        return labels

    labels = with_inserts({"": (0, "")})
    for i in range(0, len(codes), 2):
        who, fault = codes[i : i + 2]
        after = {}
        for state, (cost, audit) in labels.items():
            ways = [(state, cost + 4, "D")]
            if fault not in "bd":
                cost += 3 if fault == "t" else 0
                ways.append((step[state], cost + 3, "R"))
                if who == step[state] or who == "s" and state == "":
                    ways.append((who, cost, "K"))
            for new, c, letter in ways:
                after[new] = min((c, audit + letter), after.get(new, (c, audit + letter)))
        labels = with_inserts(after)
    return min(labels[s] for s in ("", "a") if s in labels)


def test_search_is_optimal():
    for codes in ["", "u.", "x.", "s.", "s.u.a.", "a.u."] + ["".join(c) for c in itertools.product(("s.", "u.", "at", "xb"), repeat=2)]:
        assert repair.search(codes) == enumerate_repairs(codes, 2) == walked(codes), codes
    rng = random.Random(1)
    for _ in range(40):
        codes = codes_of(rng, 3)
        assert repair.search(codes) == enumerate_repairs(codes, 1), codes
    for _ in range(400):
        codes = codes_of(rng, rng.randint(0, 60), rng.choice(["suax", "ua", "u", "uuua", "su"]), rng.choice([".", "..t", "....tbd", "t"]))
        assert repair.search(codes) == walked(codes), codes


def test_bounds_never_exceed_the_truth_and_search_stays_fast():
    rng = random.Random(2)
    for _ in range(300):
        codes = codes_of(rng, rng.randint(1, 30), rng.choice(["suax", "ua"]), "..tbd")
        assert repair.suffix_bounds(codes)[0] <= walked(codes)[0]
    begun = time.time()
    for who, faults in (("suax", "....tbd"), ("u", "."), ("u", "t"), ("s", "."), ("ua", "t."), ("x", ".")):
        for _ in range(5):
            codes = codes_of(rng, repair.BLOCK, who, faults)
            assert repair.search(codes) == walked(codes)
    assert time.time() - begun < 20


def brute(rows):
    """{conv_id: expected row} for undamaged ``rows`` (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes = set(), ""
        for _, role, text in own:
            bare = text.rstrip(repair.SPACE)
            fault = "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "x") + fault
        cost, audit = walked(codes)
        staying, place, lines, left = len(audit) - audit.count("D"), 0, [], list(own)
        for edit in audit:
            _, role, text = left.pop(0) if edit != "I" else (0, "", "")
            if edit != "D":
                new = "user" if (place + staying) % 2 == 0 else "assistant"
                lines.append(f"{role if edit == 'K' else new}:{text}")
                place += 1
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        who = codes[::2]
        illegal = sum(who[i : i + 2] not in ("su", "ua", "au") for i in range(len(who) - 1))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(codes[1::2].count(f) for f in "bdt"), illegal, cost, audit, digest, lines)
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def sample(rng, convs=60, longest=12):
    texts = ["Fine.", "Is it?", "cut off", "", " \t\n", None, "😀!", "a.\x0b", "\x85.", "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "ux"]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(roles), text and f"{text[:1]}{rng.randint(0, 3)}{text}"))
    return rows


@pytest.mark.parametrize("block, fan", [(repair.BLOCK, repair.FAN), (3, 2), (1, 3)])
def test_report_and_turns_same_as_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair.solve, "__defaults__", (block, fan))
    rng = random.Random(block)
    rows = sample(rng) + [(1000, i, rng.choice(["user", "assistant"]), rng.choice(["So.", f"x{i}", "x"])) for i in range(400)]
    want = brute(rows)
    report, turns = repair.repair(spark.createDataFrame(rows, TURNS))
    assert {r.conv_id: tuple(r)[1:] for r in report.collect()} == {c: v[:7] for c, v in want.items()}
    lines = {c: [] for c in want}
    for r in sorted(turns.collect(), key=lambda r: r.place):
        if r.edit == "D":
            assert r.role is None and r.text is None
        else:
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: v[8] for c, v in want.items()}


def test_query_same_as_brute_force(spark, tmp_path):
    rows = sample(random.Random(9), 300)
    rows += [(5000, 1, "user", "Hi.")] * 30  # repeated rows
    gone = next(i for i in range(6000, 9000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "Hi."))
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: v[:8] for c, v in brute(damaged(rows)).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert got[gone] == empty


def test_empty_table_and_clashing_columns(spark):
    report, turns = repair.repair(spark.createDataFrame([], TURNS))
    assert report.count() == 0 and turns.count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "a " * 50_000 + ".", "x", 3)], "conv_id long, turn long, role string, text string, place string, code long")
    report, turns = repair.repair(clash)
    assert report.first().audit == "KI" and turns.count() == 2
