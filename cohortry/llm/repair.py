"""Conversation structure repair: cheapest edits to a legal role sequence, over a DAWG of
role/fault signatures shared by all conversations.

Each row of a conversation (in turn order) is reduced to a one-letter signature: its role
class (`s`, `u`, `a`, or `o` for any other initial) in lower case, upper case when the row
is truncated, and `X` for rows that must go (blank or duplicate). The cheapest repair of
a suffix depends only on its signatures and the grammar state it starts in, so suffixes
are identified from the end: the key of the suffix from row i is its length and the sum
of a 64-bit hash of (signature, distance from the end) over its rows, a running sum per
conversation. Equal keys are one node of the automaton, whatever conversation they come
from; a large group of identical conversations is one path.

Cost-to-go and the best (ASCII-least among the cheapest) audit suffix are computed once
per node and grammar state, from the end outwards. Nodes are evaluated at every `ANCHOR`
levels and at the roots: a node is solved from the anchor below it by walking its at
most `ANCHOR` signatures, so one round of Spark work covers `ANCHOR` levels and a
conversation of L rows takes L / ANCHOR rounds.

Grammar: role initials `(s?(ua)+)?`, states 0 (start, accepting), S, U, A (accepting).
Edits: Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and
duplicate rows), Insert an empty user or assistant row anywhere (2); a truncated row that
is not deleted adds 1. Audit letters K, R, D, I.
"""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.session import checkpoint

#: Levels walked per round; a node is solved from the anchor at most so many levels below.
ANCHOR = 64
WHITE = "\\x20\\x09-\\x0D"
_MOVE = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPT = (0, 3)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(`conv_id:turn`) % 20, nulls rendered as one space:
    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes its
    role user. Null role and text become one space. Adds `ckey`, a non-null conversation key."""
    c = conversations
    key = F.concat(F.coalesce(c["conv_id"].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c["turn"].cast("string"), F.lit(" ")))
    h = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(c["role"], F.lit(" ")), F.coalesce(c["text"], F.lit(" "))
    rows = c.select(
        F.struct(c["conv_id"].isNull().alias("z"), F.coalesce(c["conv_id"], F.lit(0)).cast("long").alias("k")).alias("ckey"),
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), h.alias("h"),
        F.when(h == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    rows = rows.where(F.col("h") != 0).withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("h", "copy")


def signatures(rows: DataFrame) -> DataFrame:
    """Rows in order (turn, nulls first, then role and text), with pos, n (rows of the
    conversation), fault (`blank`, `duplicate`, `truncated` or null: the first that holds),
    init (role initial) and sig."""
    order = Window.partitionBy("ckey").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("ckey")))
    earlier = F.row_number().over(Window.partitionBy("ckey", "role", "text").orderBy("pos")) > 1
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    truncated = ~F.col("text").rlike(f"[.!?][{WHITE}]*\\z")
    fault = F.when(blank, "blank").when(earlier, "duplicate").when(truncated, "truncated")
    rows = rows.withColumn("fault", fault).withColumn("init", F.substring("role", 1, 1))
    cls = F.when(F.col("init").isin("s", "u", "a"), F.col("init")).otherwise(F.lit("o"))
    sig = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("X")).when(F.col("fault") == "truncated", F.upper(cls)).otherwise(cls)
    return rows.withColumn("sig", sig)


def _better(a, b):
    return b if a is None or (b is not None and b < a) else a


def _close(v: list) -> list:
    """Relax inserts at one position until nothing changes."""
    changed = True
    while changed:
        changed = False
        for g in range(4):
            for x in ("u", "a"):
                to = _MOVE.get((g, x))
                if to is not None and v[to] is not None:
                    cand = (v[to][0] + 2, "I" + v[to][1])
                    if _better(v[g], cand) is cand:
                        v[g], changed = cand, True
    return v


def terminal() -> list:
    return _close([(0, "") if g in _ACCEPT else None for g in range(4)])


def step(sig: str, nxt: list) -> list:
    """Cost-to-go and audit suffix at a row of signature `sig`, from those after it."""
    v = [None] * 4
    for g in range(4):
        best = None if nxt[g] is None else (nxt[g][0] + 3, "D" + nxt[g][1])
        if sig != "X":
            t = 1 if sig.isupper() else 0
            to = _MOVE.get((g, sig.lower()))
            if to is not None and nxt[to] is not None:
                best = _better(best, (nxt[to][0] + t, "K" + nxt[to][1]))
            for x in ("u", "a"):
                to = _MOVE.get((g, x))
                if to is not None and nxt[to] is not None:
                    best = _better(best, (nxt[to][0] + 2 + t, "R" + nxt[to][1]))
        v[g] = best
    return _close(v)


def walk(chunk: str, below: list) -> list:
    for s in reversed(chunk):
        below = step(s, below)
    return below


def _solve(batches):
    for b in batches:
        costs, audits = [], []
        for chunk, cs, au in zip(b["chunk"], b["costs"], b["audits"], strict=True):
            below = [None if c is None or pd.isna(c) else (int(c), a) for c, a in zip(cs, au, strict=True)]
            v = walk(chunk, below)
            costs.append([None if x is None else x[0] for x in v])
            audits.append([None if x is None else x[1] for x in v])
        yield pd.DataFrame({"level": b["level"], "h": b["h"], "costs": costs, "audits": audits})


_VALUES = "level long, h decimal(38,0), costs array<long>, audits array<string>"


def solve(rows: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """(ckey, cost, audit) of every conversation with rows, from `signatures` output."""
    spark = rows.sparkSession
    back = Window.partitionBy("ckey").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.col("n") - F.col("pos")
    keyed = rows.select("ckey", "pos", "n", "sig", level.alias("level"))
    keyed = keyed.withColumn("h", F.sum(F.xxhash64("sig", "level").cast("decimal(20,0)")).over(back).cast("decimal(38,0)"))
    keyed = checkpoint(keyed)
    text = keyed.groupBy("ckey").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "sig"))), lambda x: x["sig"])).alias("s"))
    base = F.floor((F.col("level") - 1) / anchor) * anchor
    nodes = keyed.where((F.col("level") % anchor == 0) | (F.col("pos") == 0)).select("ckey", "pos", "n", "level", "h", base.cast("long").alias("below"))
    nodes = nodes.join(text, "ckey").withColumn("chunk", F.expr("substring(s, pos + 1, level - below)"))
    at = keyed.select(F.col("ckey").alias("ack"), F.col("pos").alias("apos"), F.col("h").alias("ah"))
    nodes = nodes.join(at, (F.col("ckey") == F.col("ack")) & (F.col("apos") == F.col("n") - F.col("below")), "left")
    nodes = nodes.select("level", "h", "chunk", "below", F.coalesce("ah", F.lit(0).cast("decimal(38,0)")).alias("ah"))
    nodes = checkpoint(nodes.dropDuplicates(["level", "h"]))
    top = nodes.agg(F.max("level")).first()[0]
    end = terminal()
    anchors = spark.createDataFrame(
        [(0, decimal.Decimal(0), [None if x is None else x[0] for x in end], [None if x is None else x[1] for x in end])], _VALUES
    )
    solved = [anchors]
    for r in range(1, -(-(top or 0) // anchor) + 1):
        todo = nodes.where(F.col("below") == (r - 1) * anchor)
        todo = todo.join(anchors.select(F.col("level").alias("below"), F.col("h").alias("ah"), "costs", "audits"), ["below", "ah"])
        out = checkpoint(todo.select("level", "h", "chunk", "costs", "audits").mapInPandas(_solve, _VALUES))
        solved.append(out)
        anchors = out.where(F.col("level") == r * anchor)
    roots = keyed.where("pos = 0").select("ckey", "level", "h")
    values = solved[0]
    for s in solved[1:]:
        values = values.unionByName(s)
    got = roots.join(values.dropDuplicates(["level", "h"]), ["level", "h"])
    return got.select("ckey", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(ckey, repaired): the rows as the audit leaves them, `role:text` joined by newlines."""
    letters = audits.select("ckey", F.posexplode(F.split("audit", "")).alias("p", "e")).where(F.col("e") != "")
    w = Window.partitionBy("ckey").orderBy("p")
    upto = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    letters = letters.withColumn("pos", upto(F.col("e") != "I") - 1).withColumn("t", upto(F.col("e") != "D"))
    got = letters.join(rows.select("ckey", "pos", "role", "text", "init"), ["ckey", "pos"], "left")
    first_s = F.first(F.when((F.col("t") == 1) & (F.col("e") == "K") & (F.col("init") == "s"), True), ignorenulls=True).over(Window.partitionBy("ckey"))
    by_turn = F.when((F.col("t") + F.coalesce(first_s.cast("int"), F.lit(0))) % 2 == 1, "user").otherwise("assistant")
    role = F.when(F.col("e") == "K", F.col("role")).otherwise(by_turn)
    text = F.when(F.col("e") == "I", F.lit("")).otherwise(F.col("text"))
    lines = got.where(F.col("e") != "D").select("ckey", "p", F.concat(role, F.lit(":"), text).alias("line"))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]))
    return lines.groupBy("ckey").agg(joined.alias("repaired"))


def repair(conversations: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """One row per original conversation (conv_id null is one conversation of its own):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    gaps: max - min + 1 - distinct turns after damage, nulls ignored (none: 0). illegal:
    adjacent role initials not `su`, `ua` or `au`. Conversations without rows after damage,
    and an empty table's, give zeros, an empty audit and the hash of the empty string.
    Other columns of the input are ignored; very long texts are carried, not cut.
    """
    rows = checkpoint(signatures(damage(conversations)))
    w = Window.partitionBy("ckey").orderBy("pos")
    pair = F.concat(F.lag("init").over(w), F.col("init"))
    stats = rows.withColumn("bad", F.when(F.col("pos") > 0, (~pair.isin("su", "ua", "au")).cast("int")).otherwise(0)).groupBy("ckey").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.sum((F.col("fault") == f).cast("int")).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")],
        F.sum("bad").cast("long").alias("illegal"),
    )
    audits = solve(rows, anchor)
    texts = repaired(rows, audits)
    every = conversations.select(
        F.struct(F.col("conv_id").isNull().alias("z"), F.coalesce(F.col("conv_id"), F.lit(0)).cast("long").alias("k")).alias("ckey"),
        F.col("conv_id").cast("long").alias("conv_id"),
    ).distinct()
    out = every.join(stats, "ckey", "left").join(audits, "ckey", "left").join(texts, "ckey", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


def fault_of(text: Column) -> Column:
    """The fault a text alone can have: `blank`, `truncated` or null."""
    return F.when(~text.rlike(f"[^{WHITE}]"), "blank").when(~text.rlike(f"[.!?][{WHITE}]*\\z"), "truncated")
