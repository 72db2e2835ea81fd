"""Conversation structure repair by divide and conquer.

A conversation's roles should read (system? (user assistant)+)? by their initials, so four states suffice: start, after
system, after user, after assistant. Edits: K keep (0), R rerole to user or assistant (2), D delete (3, the only edit of
blank and repeated turns), I insert an empty user or assistant turn (2); a truncated turn that stays costs 1 more. Given the
rows, an audit (the letters of the edits in order) determines the states, so the cheapest audit that is least in ASCII
determines the repaired conversation.

Reconstruction is linear in space: to repair rows [lo, hi) between an entry and an exit state, a forward vector of four
costs comes from the left, a backward one from the right, and they meet in the middle. Of the crossing states of least
total cost the one with the least left audit is taken, and both halves recurse. Inserts belong to the row after them, so no
left audit is a prefix of another one, and four ranks beside the four forward costs decide every comparison without any
audit being stored. numpy does all segments of a level, of all conversations of a batch, in one step per row.

The same code crosses blocks: rows are range-sorted by (conversation, turn, role, text digest) and cut into blocks
of at most 2**``BLOCK_BITS`` rows; a block has a 4 x 4 matrix of costs and ranks, like a row. The blocks of a long conversation are
analysed on as many tasks as they lie on, their matrices (32 numbers each) meet in one, and each block is then reconstructed
on its own. Only the texts' last pass (``repaired``), which writes a conversation in order, streams a conversation through one
task, in constant memory; a digest of the whole repaired text, like any sequential hash, needs that.

Defined results: null roles and texts count as one space. Rows of one turn number go by role, then by a digest of role and
text; equal rows are adjacent. A null conversation id is a conversation of its own. Extra columns are ignored. An empty table gives no
rows."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, map_arrow, quoted, slices, stored, table, with_fields

BLOCK_BITS = 16
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT, END = range(5)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that end the conversation from each state.
_TAIL = np.array([0, 2, 1, 0])
_FAR = 1 << 40
_RANK_BITS = 8
#: A row's code: class of its role's initial (s, u, a, other) times 3 plus 0 (sound), 1 (truncated), 2 (to delete).
CODES = 12
_ILLEGAL = np.ones((4, 4), bool)
_ILLEGAL[[0, 1, 2], [1, 2, 1]] = False


def _moves(code: int, state: int):
    """All ways to consume a row: (state after it, cost, letters)."""
    kind, fault = divmod(code, 3)
    for inserts in range(4):
        cost, letters = 2 * inserts, "I" * inserts
        yield state, cost + 3, letters + "D"
        if fault < 2:
            if kind == 0 and state == START:
                yield SYSTEM, cost + fault, letters + "K"
            elif kind in (1, 2) and _NEXT[state] == kind + 1:
                yield kind + 1, cost + fault, letters + "K"
            yield _NEXT[state], cost + 2 + fault, letters + "R"
        state = _NEXT[state]


def _tables():
    best = [[{} for _ in range(4)] for _ in range(CODES)]
    for code in range(CODES):
        for p in range(4):
            for q, cost, letters in _moves(code, p):
                best[code][p][q] = min(best[code][p].get(q, (_FAR, "")), (cost, letters))
    order = {x: i for i, x in enumerate(sorted({v[1] for row in best for b in row for v in b.values()}))}
    cost, rank = np.full((CODES, 4, 4), _FAR), np.zeros((CODES, 4, 4), np.int64)
    letters, price = np.full((CODES, 4, 5), "", object), np.zeros((CODES, 4, 5), np.int64)
    for code in range(CODES):
        for p in range(4):
            for q, (c, x) in best[code][p].items():
                cost[code, p, q], rank[code, p, q], letters[code, p, q], price[code, p, q] = c, order[x], x, c
            price[code, p, END], letters[code, p, END] = min((c + 2 * int(_TAIL[q]), x + "I" * int(_TAIL[q])) for q, (c, x) in best[code][p].items())
    return cost, rank, letters, price


ROW_COST, ROW_RANK, LETTERS, PRICE = _tables()
_EXIT = np.full((5, 4), _FAR)
_EXIT[np.arange(4), np.arange(4)] = 0
_EXIT[END] = 2 * _TAIL


def _forward(cost, rank, item, start, length, entry):
    """Least costs from ``entry`` over items [start, start + length) to each state, and the order of their least audits."""
    n = len(start)
    f, r = np.full((n, 4), _FAR), np.zeros((n, 4), np.int64)
    f[np.arange(n), entry] = 0
    order = np.argsort(-length, kind="stable")
    at, todo = start[order], length[order]
    for t in range(int(todo[0]) if n else 0):
        rows = order[:np.searchsorted(-todo, -t)]
        c = item[at[:len(rows)] + t]
        best = (((f[rows][:, :, None] + cost[c]) << (2 + _RANK_BITS)) | (r[rows][:, :, None] << _RANK_BITS) | rank[c]).min(1)
        f[rows] = np.minimum(best >> (2 + _RANK_BITS), _FAR)
        tie = best & ((4 << _RANK_BITS) - 1)
        r[rows] = (tie[:, :, None] > tie[:, None, :]).sum(2)
    return f, r


def _backward(cost, item, stop, length, leave):
    """Least costs from each state over items [stop - length, stop) to ``leave``."""
    b = _EXIT[leave]
    order = np.argsort(-length, kind="stable")
    at, todo = stop[order], length[order]
    for t in range(int(todo[0]) if len(stop) else 0):
        rows = order[:np.searchsorted(-todo, -t)]
        b[rows] = np.minimum((cost[item[at[:len(rows)] - 1 - t]] + b[rows][:, None, :]).min(2), _FAR)
    return b


def crossings(cost, rank, item, start, length, entry, leave):
    """Entry and exit state of every item of the segments [start, start + length), which an optimal and audit-least
    repair enters in state ``entry`` and leaves in state ``leave`` (END: with the closing inserts)."""
    enter_at, leave_at = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    while len(start):
        one = length == 1
        enter_at[start[one]], leave_at[start[one]] = entry[one], leave[one]
        start, length, entry, leave = (x[length > 1] for x in (start, length, entry, leave))
        half = length // 2
        f, r = _forward(cost, rank, item, start, half, entry)
        b = _backward(cost, item, start + length, length - half, leave)
        cross = (((f + b) << 2) | r).argmin(1)
        start, length, entry, leave = (np.concatenate(x) for x in ((start, start + half), (half, length - half), (entry, cross), (cross, leave)))
    return enter_at, leave_at


def matrix(cost, rank, item, start, length):
    """4 x 4 least costs and audit ranks of whole segments."""
    n = len(start)
    f, r = _forward(cost, rank, item, np.repeat(start, 4), np.repeat(length, 4), np.tile(np.arange(4), n))
    return f.reshape(n, 4, 4), r.reshape(n, 4, 4)


def _segments(strings: list[str]):
    length = np.array([len(s) for s in strings], np.int64)
    item = np.frombuffer("".join(strings).encode(), np.uint8).astype(np.int64) - ord("A")
    return item, np.cumsum(length) - length, length


def audit_codes(strings: list[str], entry=None, leave=None) -> tuple[list[str], list[int]]:
    """Audits and costs of conversations (or parts of them between given states) written as row codes from 'A'."""
    item, start, length = _segments(strings)
    entry = np.zeros(len(strings), np.int64) if entry is None else np.asarray(entry, np.int64)
    leave = np.full(len(strings), END) if leave is None else np.asarray(leave, np.int64)
    some = length > 0
    p, q = crossings(ROW_COST, ROW_RANK, item, start[some], length[some], entry[some], leave[some])
    letters, price = LETTERS[item, p, q], np.concatenate(([0], np.cumsum(PRICE[item, p, q])))
    stop = start + length
    return ["".join(letters[a:b]) for a, b in zip(start, stop, strict=True)], (price[stop] - price[start]).tolist()


# Spark


def _clean(c: str) -> Column:
    return F.coalesce(quoted(c).cast("string"), F.lit(" "))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    out = df.select(quoted(conv).alias("conv"), quoted(turn).alias("turn"), _clean(role).alias("role"), _clean(text).alias("text"))
    same = F.concat_ws(":", F.octet_length("role"), "role", "text")
    return out.withColumn("digest", F.unhex(F.sha2(same, 256)))


def _units(rows: DataFrame, bits: int) -> DataFrame:
    """Blocks of conversations: row codes in order, the key of the first row, counts of faults."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select("conv", "turn", "role", "digest", (body == "").alias("blank"), F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"))
    distinct = stored(light.groupBy("conv", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("blank").alias("blank"), F.min("ended").alias("ended")))
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    # texts that come back at another turn: their first turn, joined on a digest of its own so that hot ones can be split
    firsts = (distinct.groupBy("conv", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
              .select(F.col("conv").alias("conv2"), F.concat("digest", F.lit("").cast("binary")).alias("digest2"), "first"))
    seen = (distinct.join(firsts, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("digest") == F.col("digest2")), "left")
            .withColumn("again", F.coalesce(when != F.col("first"), F.lit(False))))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("again"), 2).when(~F.col("ended"), 1).otherwise(0)
    letter = lambda f: F.char(F.lit(ord("A")) + kind * 3 + f)
    coded = seen.select("conv", "turn", "role", "digest", F.concat(letter(fault), F.repeat(letter(F.lit(2)), (F.col("n") - 1).cast("int"))).alias("codes"),
                        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
                        F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"),
                        (fault == 1).cast("long").alias("truncated"))
    keys = ["conv", "turn", "role", "digest"]
    placed = stored(coded).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    units = placed.groupBy("conv", F.shiftright("at", bits).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "codes"))), lambda x: x["codes"]), "").alias("codes"),
        F.min(F.struct("at", "turn", "role", "digest")).alias("head"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"))
    one = Window.partitionBy("conv")
    by = one.orderBy("block")
    return stored(units.withColumns({
        "units": F.count(F.lit(1)).over(one), "before": F.coalesce(F.lag(F.right("codes", F.lit(1))).over(by), F.lit("")),
        "turns": F.col("turns") - (F.coalesce(F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1)) == F.col("low"), F.lit(False))).cast("int")}))


def _pieces(batches):
    """Batches of at most about a million rows' codes (or one block)."""
    return (part for batch in batches for part in slices(batch, 1 << 14, 1 << 20))


def _matrices(batches):
    for batch in _pieces(batches):
        cost, rank = matrix(ROW_COST, ROW_RANK, *_segments(batch.column("codes").to_pylist()))
        yield pa.RecordBatch.from_pydict({"conv": batch.column("conv"), "block": batch.column("block"),
                                          "cost": pa.array(cost.reshape(-1, 16).tolist(), pa.list_(pa.int64())), "rank": pa.array(rank.reshape(-1, 16).tolist(), pa.list_(pa.int64()))})


def _meet(batches):
    """States at the borders of the blocks of one conversation per row."""
    for batch in batches:
        states = []
        for parts in batch.column("parts").to_pylist():
            n = len(parts)
            cost, rank = (np.array([p[k] for p in parts], np.int64).reshape(n, 4, 4) for k in ("cost", "rank"))
            enter, leave = crossings(cost, rank, np.arange(n), np.array([0]), np.array([n]), np.array([START]), np.array([END]))
            states.append([{"block": p["block"], "enter": int(a), "leave": int(b)} for p, a, b in zip(parts, enter, leave, strict=True)])
        yield pa.RecordBatch.from_pydict({"conv": batch.column("conv"), "states": pa.array(states, pa.list_(pa.struct([("block", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])))})


def _audit(batches):
    """Audit, cost and illegal neighbours of each block."""
    for batch in _pieces(batches):
        codes, enter, leave, before = (batch.column(k).to_pylist() for k in ("codes", "enter", "leave", "before"))
        audits, costs = audit_codes(codes, enter, leave)
        illegal = []
        for b, c in zip(before, codes, strict=True):
            kinds = (np.frombuffer((b + c).encode(), np.uint8) - ord("A")) // 3
            illegal.append(int(_ILLEGAL[kinds[:-1], kinds[1:]].sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64())], names=[*batch.schema.names, "audit", "cost", "illegal"])


def audited(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BLOCK_BITS) -> DataFrame:
    """One row per block of a conversation: its audit, cost, faults and the key of its first row."""
    units = _units(_rows(df, conv, turn, role, text), bits)
    kind = units.schema["conv"].dataType.simpleString()
    many = units.where("units > 1")
    parts = (map_arrow(many.select("conv", "block", "codes"), _matrices, f"conv {kind}, block long, cost array<long>, rank array<long>")
             .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "cost", "rank"))).alias("parts")))
    states = (map_arrow(parts, _meet, f"conv {kind}, states array<struct<block:long,enter:int,leave:int>>")
              .select("conv", F.explode("states").alias("s")).select(F.col("conv").alias("conv2"), F.col("s.block").alias("block2"), "s.enter", "s.leave"))
    split = many.join(states, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("block") == F.col("block2"))).drop("conv2", "block2")
    whole = units.where("units = 1").withColumns({"enter": F.lit(START), "leave": F.lit(END)})
    todo = whole.unionByName(split)
    return stored(map_arrow(todo, _audit, with_fields(todo.schema, ("audit", "string"), ("cost", "long"), ("illegal", "long"))))


def report(blocks: DataFrame) -> DataFrame:
    """One row per conversation (column ``conv``) from ``audited``."""
    return blocks.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))


def _repair(batches):
    """Rows and block audits in order to repaired rows. Runs across batches; holds one audit and one batch."""
    now, letters, at, state, step = object(), "", 0, START, 0
    for batch in batches:
        conv, turn, role, text, audit = (batch.column(k).to_pylist() for k in ("conv", "turn", "role", "text", "audit"))
        out = []

        def insert():
            nonlocal at, state, step
            while at < len(letters) and letters[at] == "I":
                state = _NEXT[state]
                out.append((now, step, None, _ROLE[state], "", "I"))
                at, step = at + 1, step + 1

        for c, t, r, x, a in zip(conv, turn, role, text, audit, strict=True):
            if a is not None:
                insert()
                if c != now:
                    now, state, step = c, START, 0
                letters, at = a, 0
                continue
            insert()
            edit = letters[at]
            at += 1
            if edit != "D":
                state = SYSTEM if edit == "K" and r[0] == "s" else _NEXT[state]
                out.append((now, step, t, _ROLE[state] if edit == "R" else r, x, edit))
                step += 1
        yield _batch(out, batch)
    out = []
    while at < len(letters):
        state = _NEXT[state]
        out.append((now, step, None, _ROLE[state], "", "I"))
        at, step = at + 1, step + 1
    if out:
        yield _batch(out, batch)


def _batch(rows, like):
    kinds = {"conv": like.schema.field("conv").type, "step": pa.int64(), "turn": like.schema.field("turn").type, "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def repaired(df: DataFrame, blocks: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv, step (from 0), turn (null for inserts), role, text, edit (K, R or I). A
    conversation's rows come in order in one partition."""
    rows = _rows(df, conv, turn, role, text).withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = blocks.select("conv", F.col("head.turn").alias("turn"), F.col("head.role").alias("role"), F.lit(None).cast("string").alias("text"),
                          F.col("head.digest").alias("digest"), F.lit(0).alias("kind"), "audit")
    lined = rows.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind")
    kinds = [df.schema[c].dataType.simpleString() for c in (conv, turn)]
    return map_arrow(lined.select("conv", "turn", "role", "text", "audit"), _repair, f"conv {kinds[0]}, step long, turn {kinds[1]}, role string, text string, edit string")


def _hash(batches):
    now, sha, like = None, None, None
    for batch in batches:
        like = batch
        done = []
        for c, step, r, x in zip(*(batch.column(k).to_pylist() for k in ("conv", "step", "role", "text")), strict=True):
            if step == 0:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = c, hashlib.sha256()
            sha.update(f"{chr(10) if step else ''}{r}:{x}".encode())
        yield _hashes(done, batch)
    if sha is not None:
        yield _hashes([(now, sha.hexdigest())], like)


def _hashes(done, like):
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], like.schema.field("conv").type), pa.array([d[1] for d in done], pa.string())], names=["conv", "repaired_sha256"])


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, ``role:text`` joined by line feeds, over the output of ``repaired``."""
    return map_arrow(rows, _hash, f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20."""
    d = df.select("conv_id", "turn", _clean("role").alias("role"), _clean("text").alias("text"))
    d = d.withColumn("h", F.crc32(F.concat_ws(":", _clean("conv_id"), _clean("turn")).cast("binary")) % 20).where("h <> 0")
    copies = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.withColumn("copy", F.explode(copies)).select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def op12(spark, sf_dir):
    """Every conversation's faults, cheapest repair and digest of the repaired text, after planted damage."""
    df = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hurt = damage(df)
    blocks = audited(hurt)
    found = report(blocks)
    hashes = digests(repaired(hurt, blocks))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = df.select("conv_id").distinct()
    out = (ids.join(found.withColumnRenamed("conv", "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left")
           .join(hashes.withColumnRenamed("conv", "c2"), F.col("conv_id").eqNullSafe(F.col("c2")), "left"))
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: Every state with its best (cost, audit, text) row after row, all strings written out.
SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE h <> 0),
placed AS (
  SELECT *, rtrim(text, E' \t\n\x0B\x0C\r') AS body, row_number() OVER c AS i, lag(role) OVER c AS role_before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM hurt WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
rows AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, body = '' AS blank, body <> '' AND nth > 1 AS duplicate,
         body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         (i > 1 AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::INT AS illegal
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate,
         sum(truncated::INT) AS truncated, sum(illegal) AS illegal, max(i) AS n FROM rows GROUP BY conv_id),
inserts(p, k, q, lines) AS (
  VALUES ('', 0, '', ''), ('s', 0, 's', ''), ('u', 0, 'u', ''), ('a', 0, 'a', ''),
         ('', 1, 'u', E'\nuser:'), ('s', 1, 'u', E'\nuser:'), ('a', 1, 'u', E'\nuser:'), ('u', 1, 'a', E'\nassistant:'),
         ('', 2, 'a', E'\nuser:\nassistant:'), ('s', 2, 'a', E'\nuser:\nassistant:'), ('a', 2, 'a', E'\nuser:\nassistant:'), ('u', 2, 'u', E'\nassistant:\nuser:')),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {{'cost': 0::BIGINT, 'audit': '', 'text': ''}} AS b FROM rows
  UNION ALL
  SELECT r.conv_id, r.i,
         CASE e.e WHEN 'D' THEN n.q WHEN 'K' THEN r.initial ELSE CASE WHEN n.q = 'u' THEN 'a' ELSE 'u' END END,
         min({{'cost': s.b.cost + 2 * n.k + CASE e.e WHEN 'D' THEN 3 WHEN 'K' THEN r.truncated::INT ELSE 2 + r.truncated::INT END,
              'audit': s.b.audit || repeat('I', n.k) || e.e,
              'text': s.b.text || n.lines || CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || r.role || ':' || r.text
                      ELSE E'\n' || CASE WHEN n.q = 'u' THEN 'assistant' ELSE 'user' END || ':' || r.text END}})
  FROM best s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN inserts n ON n.p = s.state
  JOIN (VALUES ('D'), ('K'), ('R')) e(e) ON e.e = 'D' OR NOT (r.blank OR r.duplicate) AND (e.e = 'R'
    OR r.initial = CASE WHEN n.q = 'u' THEN 'a' ELSE 'u' END OR r.initial = 's' AND n.q = '')
  GROUP BY 1, 2, 3),
done AS (
  SELECT s.conv_id, min({{'cost': s.b.cost + 2 * n.k, 'audit': s.b.audit || repeat('I', n.k), 'text': s.b.text || n.lines}}) AS b
  FROM best s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN inserts n ON n.p = s.state AND n.q IN ('', 'a')
  GROUP BY s.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(d.b.cost, 0)::BIGINT AS cost,
       coalesce(d.b.audit, '') AS audit, sha256(coalesce(substr(d.b.text, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
