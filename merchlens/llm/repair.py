"""Conversation structure repair by depth-first branch and bound.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Turns may be kept, given the
role user or assistant, deleted, and empty turns of these roles inserted.  The search
walks the turns with an explicit stack of prefixes (turn, state, cost, audit).  A prefix
goes no further if

* its cost plus a lower bound of the turns after it exceeds the incumbent, or equals it
  with a later audit, or
* the dominance table of its node (turn, state) holds a prefix of less cost, or of equal
  cost and an earlier audit.  Two audits of equal cost at one node are never prefixes of
  one another, so the earlier one stays earlier whatever follows.

When the stack is empty the incumbent (cost, audit) is proved optimal.

Long conversations are searched in blocks of turns, from every state to every state; blocks
combine in rounds of neighbours, since (cost, audit) adds up over blocks.  So no task searches
more than a block, however long the conversation.  Texts are read again only to write the
result, streamed in order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.ordinals import numbered
from merchlens.llm.registry import query, read
from merchlens.session import cut_lineage

# Costs of the edits; a truncated turn that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Turns searched at once, and blocks combined at once.
BLOCK, FAN = 96, 32
SPACE = " \t\n\x0b\x0c\r"
# States by the initial of the last turn kept: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NONE, SYSTEM, USER, ASSISTANT)
ACCEPTED = (NONE, ASSISTANT)
# Where a user or assistant turn leads, and its initial.
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIAL = {USER: "u", ASSISTANT: "a"}
LEGAL = ("su", "ua", "au")


def suffix_bounds(codes: str) -> list[int]:
    """Least cost of the turns from each one on, whatever came before.

    ``codes`` has two characters a turn: the initial of its role (x: other) and its fault
    (b blank, d duplicate, t truncated, or a point).  Blank and duplicate turns cost a
    deletion, truncated ones their surcharge.  Two neighbours, deletions aside, whose
    initials may not follow each other cost one edit more: an insertion or another role, or a
    deletion less the surcharge it saves.  Pairs that share no turn add up.
    """
    n = len(codes) // 2
    forced, paired = [0] * (n + 1), [0] * (n + 1)
    later: list[int] = []  # turns after i that need not go, nearest last
    for i in range(n - 1, -1, -1):
        who, fault = codes[2 * i], codes[2 * i + 1]
        if fault in "bd":
            forced[i] = forced[i + 1] + DELETE
            paired[i] = paired[i + 1]
            continue
        surcharge = TRUNCATED if fault == "t" else 0
        forced[i] = forced[i + 1] + min(surcharge, DELETE)
        paired[i] = paired[i + 1]
        if later and who + codes[2 * later[-1]] not in LEGAL:
            saved = max(surcharge, TRUNCATED if codes[2 * later[-1] + 1] == "t" else 0)
            after = paired[later[-2]] if len(later) > 1 else 0
            paired[i] = max(paired[i], min(INSERT, REROLE, DELETE - saved) + after)
        later.append(i)
    return [a + b for a, b in zip(forced, paired)]


def search(codes: str, entry: int = NONE, exits: tuple[int, ...] = ACCEPTED) -> tuple[int, str] | None:
    """Least (cost, audit) that leads from ``entry`` over all turns to one of ``exits``; None if nothing does."""
    n = len(codes) // 2
    bound = suffix_bounds(codes)
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    best: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    table[0][entry] = (0, "")
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i][state] != (cost, audit):
            continue  # a better prefix came meanwhile
        if best is not None:
            least = cost + bound[i]
            if least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
                continue
        if i == n and state in exits and (best is None or (cost, audit) < best):
            best = cost, audit
        step = NEXT[state]
        grown = [(i, step, cost + INSERT, audit + "I")]
        if i < n:
            who, fault = codes[2 * i], codes[2 * i + 1]
            grown.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault not in "bd":
                kept = cost + (TRUNCATED if fault == "t" else 0)
                grown.append((i + 1, step, kept + REROLE, audit + "R"))
                if who == INITIAL[step]:
                    grown.append((i + 1, step, kept, audit + "K"))
                elif who == "s" and state == NONE:
                    grown.append((i + 1, SYSTEM, kept, audit + "K"))
        # The most promising prefix is pushed last and searched first.
        for j, s, c, a in sorted(grown, key=lambda g: (g[2] + bound[g[0]], g[3]), reverse=True):
            known = table[j].get(s)
            if known is None or (c, a) < known:
                table[j][s] = c, a
                stack.append((j, s, c, a))
    return best


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


WAY = "struct<entry:int,exit:int,cost:bigint,audit:string>"
SOLVED = f"block bigint, first string, last string, illegal bigint, ways array<{WAY}>"


def _way_type() -> pa.DataType:
    return pa.list_(
        pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    )


def _batch(ids: pa.Array, solved: list[tuple]) -> pa.RecordBatch:
    blocks, first, last, illegal, ways = ([r[i] for r in solved] for i in range(5))
    ways = [[dict(zip(("entry", "exit", "cost", "audit"), w)) for w in one] for one in ways]
    columns = [ids, pa.array(blocks, pa.int64()), pa.array(first, pa.string()), pa.array(last, pa.string())]
    columns += [pa.array(illegal, pa.int64()), pa.array(ways, _way_type())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "first", "last", "illegal", "ways"])


def _solver(block: int):
    def solve(batches):
        """(conv_id, block, codes) to the best way from each state to each state."""
        for batch in batches:
            solved = []
            for number, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                whole = number == 0 and len(codes) < 2 * block  # nothing follows such a block
                ways = []
                for entry in STATES if number else (NONE,):
                    for exits in (ACCEPTED,) if whole else ((s,) for s in STATES):
                        found = search(codes, entry, exits)
                        if found is not None:
                            ways.append((entry, exits[0], *found))
                initials = codes[::2]
                solved.append((number, initials[0], initials[-1], illegal_pairs(initials), ways))
            yield _batch(batch.column(0), solved)

    return solve


def _combined(blocks: list[dict]) -> tuple:
    """(first, last, illegal, ways) of neighbouring blocks in order."""
    illegal = sum(b["illegal"] for b in blocks)
    illegal += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
    ways = {(w["entry"], w["exit"]): (w["cost"], (w["audit"],)) for w in blocks[0]["ways"]}
    for b in blocks[1:]:
        grown: dict[tuple[int, int], tuple[int, tuple]] = {}
        for (entry, middle), (cost, audit) in ways.items():
            for w in b["ways"]:
                if w["entry"] == middle:
                    way = cost + w["cost"], (*audit, w["audit"])
                    key = entry, w["exit"]
                    old = grown.get(key)
                    if old is None or way[0] < old[0] or way[0] == old[0] and "".join(way[1]) < "".join(old[1]):
                        grown[key] = way
        ways = grown
    return blocks[0]["first"], blocks[-1]["last"], illegal, [(*k, c, "".join(a)) for k, (c, a) in ways.items()]


def _combine(batches):
    for batch in batches:
        numbers = batch.column(1).to_pylist()
        yield _batch(batch.column(0), [(n, *_combined(b)) for n, b in zip(numbers, batch.column(2).to_pylist())])


def solve(coded: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, illegal, cost, audit) of every conversation in ``coded`` (conv_id, place, code)."""
    kind = coded.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {SOLVED}"
    blocks = coded.groupBy("conv_id", F.floor(F.col("place") / block).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("place", "code")))["code"], "").alias("codes")
    )
    now = cut_lineage(blocks.mapInArrow(_solver(block), schema))
    while (now.agg(F.max("block")).first()[0] or 0) > 0:
        row = F.struct("block", "first", "last", "illegal", "ways")
        grouped = now.groupBy("conv_id", F.floor(F.col("block") / fan).alias("up")).agg(
            F.array_sort(F.collect_list(row)).alias("blocks")
        )
        now = cut_lineage(grouped.mapInArrow(_combine, schema))
    ends = F.filter("ways", lambda w: (w.entry == NONE) & w.exit.isin(*ACCEPTED))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w.cost.alias("cost"), w.audit.alias("audit"))))
    return now.select("conv_id", "illegal", best.alias("best")).select("conv_id", "illegal", "best.cost", "best.audit")


def _edits(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(edit, original role, new role, text) in order; deleted turns have no new role."""
    staying = len(audit) - audit.count("D")
    place = 0
    for edit in audit:
        old, text = next(turns) if edit != "I" else (None, "")
        if edit == "D":
            yield edit, old, None, None
            continue
        # A repaired conversation of odd length starts with its system turn.
        new = "user" if (place + staying) % 2 == 0 else "assistant"
        place += 1
        yield edit, old, old if edit == "K" else new, text


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, audit, its turns as (role, text)) from rows sorted by conversation and place."""
    pending = next(rows, None)
    while pending is not None:
        conv, _, _, _, audit = pending
        pending = None

        def own():
            nonlocal pending
            for row in rows:
                if row[1] < 0:  # the head of the next conversation
                    pending = row
                    return
                yield row[2], row[3]

        turns = own()
        yield conv, audit, turns
        for _ in turns:
            pass


def _streamed(turns: DataFrame, solved: DataFrame, fields: list[tuple[str, pa.DataType, str]], rows_of) -> DataFrame:
    """Every conversation's audit and turns, sorted, through ``rows_of(conversations)`` as (conv_id, *fields)."""
    none = F.lit(None).cast("string")
    head = solved.select(
        "conv_id", F.lit(-1).cast("bigint").alias("place"), none.alias("role"), none.alias("text"), "audit"
    )
    body = turns.select("conv_id", "place", "role", "text", none.alias("audit"))
    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        types: list[pa.DataType] = []

        def rows():
            for batch in batches:
                types[:] = [batch.column(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        made = rows_of(_conversations(rows()))
        while some := list(itertools.islice(made, 1000)):
            columns = [pa.array(c, t) for c, t in zip(zip(*some), [types[0], *(t for _, t, _ in fields)])]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *(n for n, _, _ in fields)])

    return ordered.mapInArrow(run, ", ".join([f"conv_id {kind}", *(f"{n} {sql}" for n, _, sql in fields)]))


def place_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, place, role, text, code) as a stored table: turns in order, with their first fault.

    Turns are ordered by turn (null first), then role and text.  Null roles and texts are
    one space.  A turn is blank if its text has nothing but white space, a duplicate if an
    earlier turn of the conversation has its role and text, truncated if its last
    character other than white space is none of ``.!?``.  Other columns are dropped.
    """
    slim = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = cut_lineage(numbered(slim, ["conv_id"], order, "place"))
    # A turn is met by its own place, so a text that fills a conversation is no hot key.
    first = placed.groupBy(F.col("conv_id").alias("c"), "role", F.md5("text").alias("m")).agg(F.min("place").alias("p"))
    first = first.select("c", "p")
    known = placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    ended = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(ended == "", "b")
        .when(F.col("p").isNull(), "d")
        .when(F.right(ended, F.lit(1)).isin(".", "!", "?"), ".")
        .otherwise("t")
    )
    who = F.left("role", F.lit(1))
    code = F.concat(F.when(who.isin("s", "u", "a"), who).otherwise("x"), fault)
    return cut_lineage(known.select("conv_id", "turn", "place", "role", "text", code.alias("code")))


def faults(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations in ``placed``."""
    of = {"blank": "b", "duplicate": "d", "truncated": "t"}
    fault = F.substring("code", 2, 1)
    by_turn = placed.groupBy("conv_id", "turn").agg(*[F.count_if(fault == c).alias(n) for n, c in of.items()])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = by_turn.groupBy(F.col("conv_id").alias("c")).agg(
        gaps.cast("bigint").alias("gaps"), *[F.sum(n).alias(n) for n in of]
    )
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return counts.join(solved, same).select("conv_id", "gaps", *of, "illegal", "cost", "audit")


def repaired_turns(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role_before, role, text): the edits of every conversation in order.

    ``edit`` is K, R, D or I; deleted turns have neither role nor text, inserted ones no
    role before.  A conversation is one sorted stream, held a row at a time.
    """

    def rows(conversations):
        for conv, audit, turns in conversations:
            for place, edit in enumerate(_edits(turns, audit)):
                yield (conv, place, *edit)

    names = ("edit", "role_before", "role", "text")
    fields = [("place", pa.int64(), "bigint"), *((n, pa.string(), "string") for n in names)]
    return _streamed(placed, solved, fields, rows)


def repaired_digests(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the newline-joined ``role:text`` lines of each repaired conversation.

    A digest is sequential: each conversation streams through one task, held a row at a time.
    """

    def rows(conversations):
        for conv, audit, turns in conversations:
            digest, between = hashlib.sha256(), ""
            for _, _, role, text in _edits(turns, audit):
                if role is not None:
                    digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                    between = "\n"
            yield conv, digest.hexdigest()

    return _streamed(placed, solved, [("repaired_sha256", pa.string(), "string")], rows)


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of all conversations; see `faults` and `repaired_turns`.

    Rows of a null conversation form one conversation.  Repeated rows are duplicates; ties
    between optimal repairs go to the ASCII-least audit.  A role whose initial is none of
    s, u, a (an empty or null one too) cannot be kept.  No rows give no rows.
    """
    placed = place_turns(turns, conv, turn, role, text)
    solved = cut_lineage(solve(placed.select("conv_id", "place", "code")))
    return faults(placed, solved), repaired_turns(placed, solved)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults that crc32 of ``conv_id:turn`` chooses, null parts as one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    the row, 4 makes it the user's; null roles and texts are one space.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    return conversations.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         CAST(list_reduce(list_prepend(4294967295, list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS BIGINT) AS crc
  FROM conversations),
kinds AS (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([0, 1]) AS copy) c WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM damaged),
flagged AS (
  SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS who,
         CASE WHEN ended = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
              WHEN right(ended, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault
  FROM placed),
paired AS (SELECT *, lag(who) OVER (PARTITION BY conv_id ORDER BY place) || who AS pair FROM flagged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM paired GROUP BY conv_id),
-- The least label of each state: cost in 8 digits, then the audit.  Inserted turns come before the next row.
walk(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '00000000', CAST(NULL AS VARCHAR), '00000003I', '00000006II' FROM counts
  UNION ALL
  SELECT conv_id, i, e, s, u,
         least(a, lpad(CAST(CAST(substr(u, 1, 8) AS INT) + 3 AS VARCHAR), 8, '0') || substr(u, 9) || 'I')
  FROM (
    SELECT conv_id, i, e, s, a,
           least(u, lpad(CAST(CAST(substr(least(e, s, a), 1, 8) AS INT) + 3 AS VARCHAR), 8, '0') || substr(least(e, s, a), 9) || 'I') AS u
    FROM (
      SELECT conv_id, i, e || 'D' AS e,
             least(s || 'D', CASE WHEN fault IN ('.', 't') AND who = 's' THEN keep_e END) AS s,
             least(u || 'D', CASE WHEN fault IN ('.', 't') THEN least(CASE WHEN who = 'u' THEN keep_esa END, change_esa) END) AS u,
             least(a || 'D', CASE WHEN fault IN ('.', 't') THEN least(CASE WHEN who = 'a' THEN keep_u END, change_u) END) AS a
      FROM (
        SELECT conv_id, i, who, fault,
               lpad(CAST(CAST(substr(e, 1, 8) AS INT) + 4 AS VARCHAR), 8, '0') || substr(e, 9) AS e,
               lpad(CAST(CAST(substr(s, 1, 8) AS INT) + 4 AS VARCHAR), 8, '0') || substr(s, 9) AS s,
               lpad(CAST(CAST(substr(u, 1, 8) AS INT) + 4 AS VARCHAR), 8, '0') || substr(u, 9) AS u,
               lpad(CAST(CAST(substr(a, 1, 8) AS INT) + 4 AS VARCHAR), 8, '0') || substr(a, 9) AS a,
               lpad(CAST(CAST(substr(e, 1, 8) AS INT) + t AS VARCHAR), 8, '0') || substr(e, 9) || 'K' AS keep_e,
               lpad(CAST(CAST(substr(least(e, s, a), 1, 8) AS INT) + t AS VARCHAR), 8, '0') || substr(least(e, s, a), 9) || 'K' AS keep_esa,
               lpad(CAST(CAST(substr(u, 1, 8) AS INT) + t AS VARCHAR), 8, '0') || substr(u, 9) || 'K' AS keep_u,
               lpad(CAST(CAST(substr(least(e, s, a), 1, 8) AS INT) + t + 3 AS VARCHAR), 8, '0') || substr(least(e, s, a), 9) || 'R' AS change_esa,
               lpad(CAST(CAST(substr(u, 1, 8) AS INT) + t + 3 AS VARCHAR), 8, '0') || substr(u, 9) || 'R' AS change_u
        FROM (
          SELECT w.conv_id, w.i + 1 AS i, e, s, u, a, who, fault, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t
          FROM walk w JOIN flagged f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = w.i + 1))))),
solved AS (
  SELECT c.conv_id, CAST(substr(least(w.e, w.a), 1, 8) AS BIGINT) AS cost, substr(least(w.e, w.a), 9) AS audit
  FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n),
edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS pos FROM solved WHERE audit <> ''),
steps AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS place, count(*) FILTER (edit <> 'D') OVER w AS kept,
         count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS staying
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
lines AS (
  SELECT s.conv_id, s.pos, CASE WHEN edit = 'K' THEN f.role WHEN (kept - 1 + staying) % 2 = 0 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END AS line
  FROM steps s LEFT JOIN flagged f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.place = f.place WHERE edit <> 'D'),
repaired AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS h FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.cost, 0) AS cost,
       coalesce(s.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation after its damage."""
    conversations = read(spark, sf_dir, "conversations")
    placed = place_turns(damaged(conversations))
    solved = cut_lineage(solve(placed.select("conv_id", "place", "code")))
    report, hashes = faults(placed, solved), repaired_digests(placed, solved)
    found = report.withColumnRenamed("conv_id", "c").join(
        hashes.withColumnRenamed("conv_id", "h"), F.col("c").eqNullSafe(F.col("h"))
    )
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
