"""Conversation structure repair: the cheapest edits that make roles alternate, found by A* on the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.hot_groups import with_group_totals
from trekframe.storage import materialize

#: What has been read of ``(s?(ua)+)?``: nothing, the system turn, a user turn, an assistant turn.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEPT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # by a turn whose role is chosen: user, unless an assistant's is due
ENDS = ("", "II", "I", "")  # what must still be inserted at the end
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


def cheapest_edits(initials: str, kinds: str, start: int = START, inside: bool = False) -> dict[int, tuple[int, str]]:
    """Least cost and, of that cost, the ASCII-least audit, by the state they end in.

    ``kinds`` has for each row ``B`` or ``D`` (must be deleted), ``T`` (costs 3 unless deleted) or ``G``. A* over nodes
    (rows read, state), keyed (cost so far + heuristic, audit so far). The heuristic is the suffix sum of 4 for rows that
    must go and of 3 for truncated rows, which cost that at least; no edge lowers the sum of both by more than it costs,
    so a node's first visit is its cheapest, and among equal ones that with the least audit: audits of a node hold equally many
    row letters and equal costs, so none is the beginning of another.

    Without ``inside``, all rows of a conversation are there: the first end that the grammar accepts is the only one
    given. With it, edits end with the last row (later insertions belong to the rows that follow) and all states that can be
    reached are given.
    """
    n = len(kinds)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if kinds[i] in "BD" else TRUNCATED if kinds[i] == "T" else 0)
    todo, seen, found = [(ahead[0], "", 0, start)], set(), {}
    while todo:
        f, audit, i, q = heapq.heappop(todo)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        cost = f - ahead[i]
        if i == n:
            if inside:
                found[q] = (cost, audit)
                continue
            if q in (START, AFTER_A):
                return {q: (cost, audit)}
        else:
            heapq.heappush(todo, (cost + DELETE + ahead[i + 1], audit + "D", i + 1, q))
            if kinds[i] not in "BD":
                more = cost + (TRUNCATED if kinds[i] == "T" else 0) + ahead[i + 1]
                if initials[i] in KEPT[q]:
                    heapq.heappush(todo, (more, audit + "K", i + 1, KEPT[q][initials[i]]))
                heapq.heappush(todo, (more + REROLE, audit + "R", i + 1, TURN[q]))
        heapq.heappush(todo, (f + INSERT, audit + "I", i, TURN[q]))
    return found


def repaired(audit: str, roles: list[str], texts: list[str], start: int = START) -> list[str]:
    """``role:text`` of the turns that the edits of an audit leave."""
    out, i, q = [], 0, start
    for letter in audit:
        if letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            q = KEPT[q][roles[i][:1]]
        elif letter in "RI":
            q = TURN[q]
            out.append(f"{'user' if q == AFTER_U else 'assistant'}:{texts[i] if letter == 'R' else ''}")
        i += letter != "I"
    return out


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class _Block:
    """Successive rows of one conversation, and what is counted over them."""

    def __init__(self):
        self.roles, self.texts, self.kinds, self.turns, self.size = [], [], [], [], 0

    def add(self, turn, role: str, text: str, kind: str) -> None:
        self.roles.append(role)
        self.texts.append("" if kind in "BD" else text)
        self.kinds.append(kind)
        self.turns.append(turn)
        self.size += len(self.texts[-1])

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "t_min": min(known, default=None), "t_max": max(known, default=None), "t_n": len(set(known)),
            "blank": self.kinds.count("B"), "duplicate": self.kinds.count("D"), "truncated": self.kinds.count("T"),
            "illegal": sum(illegal(a, b) for a, b in zip(initials, initials[1:])), "head": initials[0] if initials else None, "last": initials[-1] if initials else None,
        }

    def whole(self) -> dict:
        got = self.counts()
        ((cost, audit),) = cheapest_edits([r[:1] for r in self.roles], "".join(self.kinds)).values()
        text = "\n".join(repaired(audit, self.roles, self.texts))
        return got | {"gaps": _gaps(got["t_min"], got["t_max"], got["t_n"]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(_utf8(text)).hexdigest()}

    def part(self) -> dict:
        """For every two states: the cost of the edits from one to the other, and the audit's place among those from that start."""
        costs, ranks, kinds, initials = [], [], "".join(self.kinds), [r[:1] for r in self.roles]
        for start in range(4):
            ways = cheapest_edits(initials, kinds, start, inside=True)
            order = sorted(audit for _, audit in ways.values())
            costs += [ways[q][0] if q in ways else -1 for q in range(4)]
            ranks += [order.index(ways[q][1]) if q in ways else 0 for q in range(4)]
        return self.counts() | {"costs": costs, "ranks": ranks, "roles": self.roles, "texts": self.texts, "kinds": kinds}


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _gaps(low, high, distinct) -> int:
    return 0 if low is None else high - low + 1 - distinct


_COUNTS = "t_min long, t_max long, t_n long, blank long, duplicate long, truncated long, illegal long, head string, last string"
_WHOLE = "gaps long, cost long, audit string, repaired_sha256 string"
_PART = "costs array<long>, ranks array<int>, roles array<string>, texts array<string>, kinds string"
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: the rows after damage, ``n`` copies of each; a dropped row leaves 0 copies of
    an empty row, so that its conversation stays known. Equal rows are one, however many there are."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    rows = rows.select(
        "conv_id",
        F.when(fault != 0, F.col("turn")).alias("turn"),
        F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_kinds(rows: DataFrame) -> DataFrame:
    """``rows`` and the first fault of each: ``B`` blank, ``D`` duplicate, ``T`` truncated, else ``G``. ``rows`` is a written table."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marked = rows.select("*", F.when(F.col("n") > 0, digest).alias("said"), when.alias("at"))
    met = with_group_totals(marked, ["conv_id", "said"], {"first_at": F.min("at")}, least=2)
    core = F.rtrim(F.col("text"), F.lit(_SPACE))
    again = F.col("first_at").isNotNull() & F.col("said").isNotNull() & (F.col("first_at") < F.col("at"))
    kind = F.when(core == "", "B").when(again, "D").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "T").otherwise("G")
    return met.select(*rows.columns, kind.alias("kind"))


def repair_conversations(conversations: DataFrame, part_rows: int = 256, part_chars: int = 1 << 20) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation.

    Rows are damaged, told apart by their first fault, dealt out by range of (conversation, turn, role, text) and sorted in
    their tasks. A conversation that lies inside a task and has at most ``part_rows`` rows and ``part_chars`` characters
    is repaired there. Any other is cut into parts of that size, however many tasks they lie in: each gives the costs
    between all pairs of states and the order of the audits; a small pass over these numbers chooses the states at the cuts;
    each part is then repaired between its two states. So no task holds a long conversation; only the digest and the audit,
    one cell by contract, are put together in order, as a stream. (An audit has at most 2^31 letters, so a
    conversation has at most 2^31 / ``part_rows`` parts.)

    Null roles and texts are one space, and so are null ids and turns within the key of the damage. Rows without a turn
    come first; rows of one turn are in the order of their role and text. Rows without a conversation are one
    conversation. A turn whose role is none of s, u, a by its first letter can't be kept; an empty role has no
    initial, so it is illegal beside any other. Repeated rows are duplicates of the first. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = materialize(damaged(conversations), "damaged")
    kinds = materialize(with_kinds(rows), "kinds")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, pos long, is_whole boolean, {_COUNTS}, {_WHOLE}, {_PART}"
    out_schema = kinds.sparkSession.createDataFrame([], schema).schema
    names = out_schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, ready = TaskContext.get().partitionId(), 0, []
        conv, block, first, parted, any_row = None, _Block(), True, False, False
        arrow = _arrow_schema(out_schema)

        def row(is_whole: bool) -> dict:
            nonlocal seq
            seq += 1
            return {"conv_id": conv, "pos": (pid << 32) | seq, "is_whole": is_whole} | (block.whole() if is_whole else block.part())

        for batch in batches:
            for c, turn, role, text, n, kind in zip(*[col.to_pylist() for col in batch.columns]):
                if any_row and c != conv:
                    ready.append(row(not first and not parted))
                    block, first, parted = _Block(), False, False
                conv, any_row = c, True
                for copy in range(n):
                    if len(block.kinds) >= part_rows or block.size + len(text) > part_chars and block.kinds:
                        ready.append(row(False))
                        block, parted = _Block(), True
                    block.add(turn, role, text, kind if copy == 0 or kind == "B" else "D")
                    if len(ready) >= 64:
                        yield _batch(ready, names, arrow)
                        ready = []
        if any_row:
            ready.append(row(False))
        if ready:
            yield _batch(ready, names, arrow)

    dealt = kinds.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "kind")
    blocks = materialize(dealt.mapInArrow(cut, schema), "blocks")
    whole = blocks.where("is_whole").select(*RESULT)
    parts = blocks.where("not is_whole")

    routes = parts.select("conv_id", "pos", "t_min", "t_max", "t_n", "blank", "duplicate", "truncated", "illegal", "head", "last", "costs", "ranks")
    routes = routes.groupBy("conv_id").applyInPandas(_route, f"conv_id {id_type}, pos long, came int, went int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, tail string")
    told = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    met = parts.select("conv_id", "pos", "roles", "texts", "kinds").join(routes.select("pos", "came", "went", "tail", *told).hint("merge"), "pos")
    edited = met.mapInArrow(_edit_parts, f"conv_id {id_type}, pos long, audit string, said string, tail string, {', '.join(f'{c} long' for c in told)}")
    joined = edited.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "pos").select("conv_id", "audit", "said", "tail", *told)
    final = f"conv_id {id_type}, {', '.join(f'{c} long' for c in told)}, audit string, repaired_sha256 string"
    return whole.unionByName(joined.mapInArrow(_put_together(final, kinds.sparkSession), final).select(*RESULT))


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[dict], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], type=arrow.field(c).type) for c in names], names)


def _route(parts: pd.DataFrame) -> pd.DataFrame:
    """The states at the cuts of one conversation: numbers only, a few for every part."""
    parts = parts.sort_values("pos")
    best, order, back = [0, _FAR, _FAR, _FAR], [0, 0, 0, 0], []  # cost and place of the audit by state, from the beginning on
    for costs, ranks in zip(parts["costs"], parts["ranks"]):
        ways = []
        for q in range(4):
            ways.append(min(((best[p] + costs[4 * p + q], order[p], ranks[4 * p + q], p) for p in range(4) if best[p] < _FAR and costs[4 * p + q] >= 0), default=(_FAR, 0, 0, -1)))
        places = sorted({w[1:3] for w in ways if w[0] < _FAR})
        best, order = [w[0] for w in ways], [places.index(w[1:3]) if w[0] < _FAR else 0 for w in ways]
        back.append([w[3] for w in ways])
    cost, _, q = min((best[q] + INSERT * len(ENDS[q]), order[q], q) for q in range(4) if best[q] < _FAR)
    came, went, tail = [], [], ENDS[q]
    for step in reversed(back):
        went.append(q)
        q = step[q]
        came.append(q)
    low, high, distinct, wrong, last = None, None, 0, int(parts["illegal"].sum()), None
    for t0, t1, n, head, end in zip(parts["t_min"], parts["t_max"], parts["t_n"], parts["head"], parts["last"]):
        if n:
            distinct += int(n) - (high is not None and high == t0)
            low, high = int(t0) if low is None else low, int(t1)
        if head is not None:
            wrong += last is not None and illegal(last, head)
            last = end
    out = pd.DataFrame({"conv_id": parts["conv_id"], "pos": parts["pos"], "came": came[::-1], "went": went[::-1]})
    totals = {"gaps": _gaps(low, high, distinct), **{c: int(parts[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": wrong, "cost": cost, "tail": tail}
    return out.assign(**totals)


def _edit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            audit = cheapest_edits([x[:1] for x in r["roles"]], r["kinds"], r["came"], inside=True)[r["went"]][1]
            said = repaired(audit, r["roles"], r["texts"], r["came"])
            rows.append((audit, "\n".join(said) if said else None))
        names = ["conv_id", "pos", "audit", "said", "tail", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        own = {"audit": pa.array([a for a, _ in rows], pa.string()), "said": pa.array([s for _, s in rows], pa.string())}
        yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names)


def _put_together(schema: str, spark):
    made = spark.createDataFrame([], schema).schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, now, ready = _arrow_schema(made), None, []

        def close() -> dict:
            for turn in {"": [], "I": ["assistant:"], "II": ["user:", "assistant:"]}[now["tail"]]:
                put(turn)
            return now | {"audit": "".join(now["audits"]) + now["tail"], "repaired_sha256": now["sha"].hexdigest()}

        def put(said: str) -> None:
            now["sha"].update(_utf8(("\n" if now["any"] else "") + said))
            now["any"] = True

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        ready.append(close())
                    now = r | {"audits": [], "sha": hashlib.sha256(), "any": False}
                now["audits"].append(r["audit"])
                if r["said"] is not None:
                    put(r["said"])
            if len(ready) >= 64:
                yield _batch(ready, made.names, arrow)
                ready = []
        if now is not None:
            yield _batch([*ready, close()], made.names, arrow)

    return stream


def oracle_sql() -> str:
    """The same table in DuckDB: the damage, then the edits from each conversation's end to its beginning, for all four states."""
    ways = lambda q: ", ".join(
        [
            f"{{'c': s{q}.c + {DELETE}, 'a': 'D' || s{q}.a, 'r': s{q}.r}}",
            *[f"{{'c': CASE WHEN kind IN ('B', 'D') OR initial <> '{k}' THEN 1000000000 ELSE s{t}.c + late END, 'a': 'K' || s{t}.a, 'r': chr(10) || role || ':' || text || s{t}.r}}" for k, t in KEPT[q].items()],
            f"{{'c': CASE WHEN kind IN ('B', 'D') THEN 1000000000 ELSE s{TURN[q]}.c + late + {REROLE} END, 'a': 'R' || s{TURN[q]}.a, 'r': chr(10) || '{'user' if TURN[q] == AFTER_U else 'assistant'}:' || text || s{TURN[q]}.r}}",
        ]
    )
    ins = lambda t, who: f"{{'c': w{t}.c + {INSERT}, 'a': 'I' || w{t}.a, 'r': chr(10) || '{who}:' || w{t}.r}}"
    two = "{'c': w3.c + 6, 'a': 'II' || w3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || w3.r}"
    end = lambda c, a, r: f"{{'c': {c}, 'a': '{a}', 'r': {r}}}"
    return rf"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % 20 AS fault FROM k, t),
g AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
d AS (SELECT *, CASE WHEN core = '' THEN 'B' WHEN nth > 1 THEN 'D' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE 'G' END AS kind,
  prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au') AS bad FROM p),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'B') AS blank, count(*) FILTER (kind = 'D') AS duplicate,
  count(*) FILTER (kind = 'T') AS truncated, count(*) FILTER (bad) AS illegal FROM d GROUP BY conv_id),
e AS (SELECT conv_id, n + 1 AS i, {end(0, "", "''")} AS s0, {end(6, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")} AS s1, {end(3, "I", "chr(10) || 'assistant:'")} AS s2, {end(0, "", "''")} AS s3 FROM n
UNION ALL SELECT conv_id, i, list_min([w0, {ins(2, "user")}, {two}]), list_min([w1, {ins(2, "user")}, {two}]), list_min([w2, {ins(3, "assistant")}]), list_min([w3, {ins(2, "user")}])
  FROM (SELECT conv_id, i, {', '.join(f'list_min([{ways(q)}]) AS w{q}' for q in range(4))}
    FROM (SELECT e.conv_id, d.i, role, text, kind, initial, CASE WHEN kind = 'T' THEN {TRUNCATED} ELSE 0 END AS late, s0, s1, s2, s3 FROM e JOIN d ON d.conv_id IS NOT DISTINCT FROM e.conv_id AND d.i = e.i - 1)))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.s0.c, 0) AS BIGINT) AS cost, coalesce(e.s0.a, '') AS audit, sha256(coalesce(substr(e.s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = 1"""
