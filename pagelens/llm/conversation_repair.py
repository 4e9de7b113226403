"""Conversation structure repair: the cheapest edits that make turns alternate.

Rows are put in one order over all conversations (range partitions, so a very long
conversation spans several), and every row is one byte from there on: its role's
initial and its fault.  The bytes of a conversation, no more than the audit that it
gets, are solved by dynamic programming over four states from the end.  Cost vectors
are stored only every square root of the rows; walking forward, each stretch is
computed again from the stored vector after it, and the walk takes the least letter
among the edits that keep the cost.  Edits then join the rows in pieces of at most
PIECE rows, so texts of one conversation are dealt over many tasks; only its hash reads
them one after another, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import inf, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import cut

BLANK = " \t\n\x0b\x0c\r"
PIECE_BITS = 12
MOST = 2**63 - 1

# states of (s?(ua)+)?: start, after s, after u, after a; a role's initial: 0 other, 1 s, 2 u, 3 a
NEXT = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
WANTED = ("u", "u", "a", "u")  # the user's or assistant's row that a state takes
AFTER = (2, 2, 3, 2)
NO_FAULT, BLANK_ROW, DUPLICATE, TRUNCATED = range(4)  # in the upper bits of a row's byte


def _closed(base: list[float]) -> list[float]:
    """Costs when rows may be inserted first."""
    u, a = min(base[2], 2 + base[3]), min(base[3], 2 + base[2])
    return [min(base[0], 2 + u), min(base[1], 2 + u), u, a]


END = tuple(_closed([0, inf, inf, 0]))


def _back(code: int, v: list[float]) -> list[float]:
    """Costs before a row from the costs after it."""
    initial, fault = code & 3, code >> 2
    base = [3 + x for x in v]
    if fault not in (BLANK_ROW, DUPLICATE):
        more = fault == TRUNCATED
        for s in range(4):
            kept = NEXT[s][initial]
            base[s] = min(base[s], 2 + more + v[AFTER[s]], more + v[kept] if kept is not None else inf)
    return _closed(base)


def cheapest_edits(codes: bytes) -> tuple[int, list[str]]:
    """Cost and one string for each row, the edits up to and with it; rows inserted at the end follow in the last."""
    n, step = len(codes), isqrt(len(codes)) + 1
    stored = {n: list(END)}
    v = stored[n]
    for i in range(n - 1, -1, -1):
        v = _back(codes[i], v)
        if i % step == 0:
            stored[i] = v
    cost, state, out = int(v[0]) if n else 0, 0, []
    for first in range(0, n, step):
        last = min(n, first + step)
        costs = [stored[last]]
        for i in range(last - 1, first - 1, -1):
            costs.append(_back(codes[i], costs[-1]))
        for i in range(first, last):
            here, then, initial, fault, edits = costs[last - i], costs[last - i - 1], codes[i] & 3, codes[i] >> 2, ""
            more = fault == TRUNCATED
            while here[state] != 3 + then[state] and here[state] == 2 + here[AFTER[state]]:
                edits, state = edits + "I" + WANTED[state], AFTER[state]
            kept = None if fault in (BLANK_ROW, DUPLICATE) else NEXT[state][initial]
            if here[state] == 3 + then[state]:
                edits += "D"
            elif kept is not None and here[state] == more + then[kept]:
                edits, state = edits + "K", kept
            else:
                edits, state = edits + "R" + WANTED[state], AFTER[state]
            out.append(edits)
    while out and state in (1, 2):
        out[-1], state = out[-1] + "I" + WANTED[state], AFTER[state]
    return cost, out


_short = lru_cache(1 << 14)(cheapest_edits)  # most conversations are short and alike


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column("pieces")
        blocks, codes = pieces.flatten().field("block"), pieces.flatten().field("codes")
        ends, values = np.asarray(codes.offsets), np.asarray(codes.values).astype(np.uint8)
        rows, at = [], 0
        for conv, m in zip(batch.column("conv").to_pylist(), pieces.value_lengths().to_pylist(), strict=True):
            own = values[ends[at] : ends[at + m]]
            cost, edits = (_short if len(own) <= 64 else cheapest_edits)(own.tobytes())
            faults, pairs = np.bincount(own >> 2, minlength=4), (own[:-1] & 3) * 4 + (own[1:] & 3)
            bounds = ends[at : at + m + 1] - ends[at]
            parts = [{"block": blocks[at + i].as_py(), "edits": "".join(edits[bounds[i] : bounds[i + 1]])} for i in range(m)]
            legal = int(np.isin(pairs, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2)).sum())
            rows.append({"conv": conv, "blank": int(faults[1]), "duplicate": int(faults[2]), "truncated": int(faults[3]), "illegal": len(pairs) - legal, "cost": cost, "audit": "".join(edits).replace("u", "").replace("a", ""), "parts": parts})
            at += m
        yield pa.RecordBatch.from_pylist(rows, _AUDIT)


_AUDIT = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("parts", pa.list_(pa.struct([("block", pa.int64()), ("edits", pa.string())])))])
AUDIT = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<block:long,edits:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role user.
    Nulls count as one space; a null turn stays null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def placed(turns: DataFrame) -> DataFrame:
    """turns in one order over all conversations: conv (conv_id as text, null: empty), turn, role, text, digest, place.

    Rows of one turn are ordered by the SHA-256 of role and text; equal rows are dealt by
    their place in the input, so no run of rows is bound to one task.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    given = given.withColumns({"digest": digest, "dealt": F.monotonically_increasing_id()})
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "dealt"]
    return cut(given.repartitionByRange(*order).sortWithinPartitions(*order).drop("dealt")).withColumn("place", F.monotonically_increasing_id())


def _block():
    return F.shiftright("place", PIECE_BITS).alias("block")


def audits(rows: DataFrame) -> DataFrame:
    """placed rows -> for each conversation its counts, cost, audit, and the edits of each piece."""
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    first_letter = F.substring("role", 1, 1)
    initial = F.when(first_letter == "s", 1).when(first_letter == "u", 2).when(first_letter == "a", 3).otherwise(0)
    firsts = rows.groupBy("conv", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    facts = rows.select("conv", "place", initial.alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut_off"))
    fault = F.when(F.col("blank"), BLANK_ROW).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut_off"), TRUNCATED).otherwise(NO_FAULT)
    coded = facts.join(firsts, "place", "left").select("conv", "place", _block(), (F.col("initial") + 4 * fault).cast("tinyint").alias("code"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "code")))
    pieces = coded.groupBy("conv", "block").agg(F.transform(ordered, lambda x: x.getField("code")).alias("codes"))
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "codes"))).alias("pieces"))
    return cut(whole.mapInArrow(_audited, AUDIT))


TOKEN = r"((?:I[ua])*(?:K|D|R[ua])(?:(?:I[ua])*$)?)"


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """placed rows and their audits -> conv, place, nth, turn, role, text, edit (K, R or I): what stays or comes in."""
    edits = found.select("conv", F.inline("parts")).select("conv", "block", F.regexp_extract_all("edits", F.lit(TOKEN), F.lit(1)).alias("tokens"))
    own = rows.select("conv", "place", "turn", "role", "text", _block()).withColumn("nth", F.row_number().over(Window.partitionBy("conv", "block").orderBy("place")))
    with_token = own.join(edits, ["conv", "block"]).withColumn("token", F.element_at("tokens", F.col("nth"))).drop("tokens", "nth", "block")
    steps = with_token.select("*", F.posexplode(F.regexp_extract_all("token", F.lit("(I[ua]|K|R[ua])"), F.lit(1))).alias("nth", "step"))
    edit, letter = F.substring("step", 1, 1), F.substring("step", 2, 1)
    role = F.when(edit == "K", F.col("role")).when(letter == "u", "user").otherwise("assistant")
    inserted = edit == "I"
    return steps.select("conv", "place", "nth", F.when(~inserted, F.col("turn")).alias("turn"), role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"), edit.alias("edit"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which arrive in order; holds one digest and one batch."""
    own, digest = None, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if conv != own:
                if digest is not None:
                    out.append((own, digest.hexdigest()))
                own, digest = conv, sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], ["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])


def repair_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, place, nth, turn, role, text, edit: the repaired conversations.

    place and nth order the rows of a conversation; edit is K for a row as it was, R for one that got the role user or
    assistant, I for an inserted one without text.  A null conv_id is one conversation; null roles and texts are one
    space.  An empty role has no initial, so such a row is given a role or deleted.  Rows of one turn are
    ordered as in placed.  Other columns are not read; an empty table gives no rows.
    """
    rows = placed(turns)
    return repaired(rows, audits(rows)).select(_conv_id(), "place", "nth", "turn", "role", "text", "edit")


def _conv_id():
    return F.expr("cast(nullif(conv, '') as long)").alias("conv_id")


def repair_report(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """turns and the conversations to report (conv_id) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row for each different conv_id of conv_ids; one without turns has zeros, an empty audit and the hash of an empty
    text.  Gaps count the turns that are missing between the least and the largest, at most 2**63 - 1.  See
    repair_turns for nulls, ties and repeated rows.
    """
    rows = placed(turns)
    found = audits(rows)
    wide = lambda c: c.cast("decimal(38,0)")
    missing = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))
    gaps = rows.groupBy("conv").agg(F.when(missing > MOST, wide(F.lit(MOST))).otherwise(missing).cast("long").alias("gaps"))
    lines = repaired(rows, found).select("conv", "place", "nth", "role", "text")
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "place", "nth").select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    all_ids = conv_ids.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    out = all_ids.join(gaps, "conv", "left").join(found.drop("parts"), "conv", "left").join(hashes, "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(_conv_id(), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
with recursive crc as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i))),
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
kinds as (select given.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 as kind from given, crc),
turns as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from kinds where kind <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from turns),
seen as (select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as previous, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
 right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as ending from numbered),
r as (select *, case when ending = '' then 'blank' when again then 'duplicate' when ending not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
sizes as (select conv_id, count(*) as n from r group by conv_id),
best(conv_id, i, v) as (
 select conv_id, n + 1, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'IuIa'}, {'c': 2, 'a': 'Ia'}, {'c': 0, 'a': ''}] from sizes
 union all
 select conv_id, i, [list_sort([b[1], {'c': 2 + u.c, 'a': 'Iu' || u.a}])[1], list_sort([b[2], {'c': 2 + u.c, 'a': 'Iu' || u.a}])[1], u, a] from (
  select *, list_sort([b[3], {'c': 2 + b[4].c, 'a': 'Ia' || b[4].a}])[1] as u, list_sort([b[4], {'c': 2 + b[3].c, 'a': 'Iu' || b[3].a}])[1] as a from (
   select conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_sort([{'c': 3 + v[s].c, 'a': 'D' || v[s].a},
     {'c': keep_or + 2 + v[case s when 3 then 4 else 3 end].c, 'a': case s when 3 then 'Ra' else 'Ru' end || v[case s when 3 then 4 else 3 end].a},
     {'c': keep_or + case when s = 1 and initial = 's' then v[2].c when s <> 3 and initial = 'u' then v[3].c when s = 3 and initial = 'a' then v[4].c else 1000000 end,
      'a': 'K' || case when initial = 's' then v[2].a when initial = 'u' then v[3].a else v[4].a end}])[1]) as b
   from (select r.conv_id, r.i, r.initial, best.v, case r.fault when 'truncated' then 1 when '' then 0 else 1000000 end as keep_or from best join r on r.conv_id = best.conv_id and r.i = best.i - 1)))),
solved as (select conv_id, v[1].c as cost, v[1].a as edits, regexp_extract_all(v[1].a, '(?:I[ua])*(?:K|D|R[ua])') as tokens, regexp_extract(v[1].a, '(?:I[ua])*$') as rest from best where i = 1),
steps as (select r.conv_id, r.i, r.role, r.text, regexp_extract_all(tokens[r.i] || case when r.i = len(tokens) then rest else '' end, 'I[ua]|K|R[ua]') as own from r join solved on r.conv_id = solved.conv_id),
lines as (select *, unnest(own) as step, generate_subscripts(own, 1) as nth from steps),
hashes as (select conv_id, sha256(string_agg(case step[1] when 'K' then role || ':' || text else case step[2] when 'u' then 'user:' else 'assistant:' end || case step[1] when 'R' then text else '' end end, chr(10) order by i, nth)) as h from lines group by conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
 count(*) filter (i > 1 and previous || initial not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
coalesce(translate(edits, 'ua', ''), '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts on counts.conv_id = c.conv_id left join solved on solved.conv_id = c.conv_id left join hashes on hashes.conv_id = c.conv_id
"""
