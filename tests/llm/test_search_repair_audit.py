"""Exact top-k search, conversation repair and source divergence against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import topk

VECS = "vec_id bigint, embedding array<float>, label int, rows string, cell string"


def brute_topk(rows, k, scale=256.0):
    ok = []
    for n, (i, v) in enumerate(rows):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in c) >= 2.0**62:
            continue
        ok.append((n, i, c))
    out = set()
    for n, i, c in ok:
        if i is None or i % 50:
            continue
        cand = [(sum(a * b for a, b in zip(c, d)), j, m) for m, j, d in ok if m != n and len(d) == len(c)]
        cand.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0, t[2]))
        out |= {(i, r + 1, j, s) for r, (s, j, _) in enumerate(cand[:k])}
    return out


def odd_vectors(rng, n=400, d=8):
    rows = [(int(i), [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows[3] = (3, None)
    rows[4] = (4, [1.0, None] + [0.0] * (d - 2))
    rows[5] = (5, [float("nan")] * d)
    rows[6] = (6, [float("inf")] + [0.0] * (d - 1))
    rows[7] = (7, [0.0] * d)
    rows[8] = (None, rows[100][1])  # a null id, a copy of a query
    rows[9] = (9, [0.5, 0.5])  # another dimension
    rows[10] = (10, [])
    rows += [(150, rows[150][1])] * 3  # repeated rows of a query
    rows += [(1000 + j, rows[200][1]) for j in range(30)]  # a large group of copies
    rows += [(2000 + j, [0.25] * d) for j in range(8)]  # ties
    rows += [(2050, [0.25] * d)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECS)


def test_topk_equals_brute_force(spark):
    rows = odd_vectors(np.random.default_rng(5))
    got = frame(spark, rows)
    out = topk.top_k(got, F.col("vec_id") % 50 == 0, k=5, n_pivots=7)
    assert {tuple(r) for r in out.collect()} == brute_topk(rows, 5)


def test_topk_one_pivot_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = odd_vectors(np.random.default_rng(6), n=300)
    out = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5, n_pivots=1)
    assert {tuple(r) for r in out.collect()} == brute_topk(rows, 5)


def test_topk_empty_and_few(spark):
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [0.0, 0.5])]
    out = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert out == [(0, 1, 1, 256 * 256 + 2 * 256 * 256), (0, 2, 2, 2 * 256 * 128)]


# ---- conversation repair -------------------------------------------------------------

import hashlib  # noqa: E402
import itertools  # noqa: E402
import re  # noqa: E402
import zlib  # noqa: E402

from cohortry.llm import repair  # noqa: E402

CONVS = "conv_id bigint, turn bigint, role string, text string, ckey string, pos int"
LEGAL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out.setdefault(c, []).extend([(t, role, text)] * (2 if h == 3 else 1))
    return out


def exhaustive(kinds):
    """Cheapest (cost, audit) by trying every edit of every row and up to two inserts in
    every gap; kinds: (initial, fault) per row."""
    best = None
    per_row = []
    for init, fault in kinds:
        t = 1 if fault == "truncated" else 0
        if fault in ("blank", "duplicate"):
            per_row.append([("D", None, 3)])
        else:
            per_row.append([("D", None, 3), ("K", init, t), ("R", "u", 2 + t), ("R", "a", 2 + t)])
    gaps = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*per_row):
        for ins in itertools.product(gaps, repeat=len(kinds) + 1):
            roles, audit, cost = [], [], 0
            for k in range(len(kinds) + 1):
                roles += list(ins[k])
                audit += ["I"] * len(ins[k])
                cost += 2 * len(ins[k])
                if k < len(kinds):
                    e, r, c = choice[k]
                    audit.append(e)
                    cost += c
                    if r is not None:
                        roles.append(r)
            if LEGAL.fullmatch("".join(roles)):
                cand = (cost, "".join(audit))
                best = cand if best is None or cand < best else best
    return best


def brute_repair(rows):
    result = {}
    convs = damaged(rows)
    for c in {r[0] for r in rows}:
        got = sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for t, role, text in got:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                f = "blank"
            elif (role, text) in seen:
                f = "duplicate"
            elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
                f = "truncated"
            else:
                f = None
            seen.add((role, text))
            kinds.append((role[:1], f))
        turns = [t for t, _, _ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        inits = [k[0] for k in kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(inits, inits[1:]))
        cost, audit = exhaustive(kinds) if len(kinds) <= 4 else forward(kinds)
        lines, k, out_t, first_s = [], 0, 0, False
        for e in audit:
            if e == "D":
                k += 1
                continue
            out_t += 1
            if e == "K":
                role, text = got[k][1], got[k][2]
                first_s = first_s or (out_t == 1 and role[:1] == "s")
            else:
                role = "user" if (out_t + first_s) % 2 else "assistant"
                text = "" if e == "I" else got[k][2]
            if e != "I":
                k += 1
            lines.append(f"{role}:{text}")
        faults = [f for _, f in kinds]
        result[c] = (
            c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return set(result.values())


def forward(kinds):
    """Forward search over (row, state): every cheapest path's audit, the least kept."""
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    frontier = {0: (0, "")}

    def inserts(front):
        front = dict(front)
        for _ in range(4):
            for g, (c, a) in list(front.items()):
                for x in "ua":
                    to = move.get((g, x))
                    if to is not None and (to not in front or (c + 2, a + "I") < front[to]):
                        front[to] = (c + 2, a + "I")
        return front

    for init, fault in kinds:
        frontier = inserts(frontier)
        nxt = {}
        t = 1 if fault == "truncated" else 0
        for g, (c, a) in frontier.items():
            opts = [(g, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                if (g, init) in move:
                    opts.append((move[(g, init)], c + t, "K"))
                for x in "ua":
                    if (g, x) in move:
                        opts.append((move[(g, x)], c + 2 + t, "R"))
            for to, cc, e in opts:
                if to not in nxt or (cc, a + e) < nxt[to]:
                    nxt[to] = (cc, a + e)
        frontier = nxt
    frontier = inserts(frontier)
    return min(v for g, v in frontier.items() if g in (0, 3))


def conv_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], CONVS)


def test_exhaustive_agrees_with_forward():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(0, 5))
        kinds = [(str(rng.choice(list("suao"))), rng.choice([None, "blank", "duplicate", "truncated"])) for _ in range(n)]
        assert exhaustive(kinds) == forward(kinds)


def test_repair_equals_brute_force_on_table(spark):
    from conftest import SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in repair.repair(conv_frame(spark, rows)).collect()}
    assert got == brute_repair(rows)


def test_repair_odd_rows_and_long_conversations(spark):
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "Hi.", "Hi", "ok!", "What?  \n", "x ", "done." * 2000, "a.b"]
    roles = [None, "system", "user", "assistant", "tool", "", "superuser"]
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "Hi."), (7, None, "user", "Hi.")]
    rows += [(8, t, str(rng.choice(roles[1:])), str(rng.choice(texts[1:]))) for t in range(150)]  # many rounds at anchor 4
    rows += [(9 + c, t, roles[(c + t) % len(roles)], texts[(c * t) % len(texts)]) for c in range(30) for t in range(6)]
    rows += [(100 + c, t, ["system", "user", "assistant", "user"][t], "Same words.") for c in range(20) for t in range(4)]
    rows += [(200, 5, "user", "Gap."), (200, 9, "assistant", "Gap.")]
    got = {tuple(r) for r in repair.repair(conv_frame(spark, rows), anchor=4).collect()}
    assert got == brute_repair(rows)


def test_repair_empty(spark):
    assert repair.repair(conv_frame(spark, [])).count() == 0


# ---- source divergence ---------------------------------------------------------------

from cohortry.llm import divergence  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, p string, rank string"


def brute_divergence(rows, min_docs, top):
    docs = [("" if t is None else t, "" if la is None else la, "" if s is None else s) for t, la, s in rows]
    pat = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[w.translate(low) for w in pat.findall(t)] for t, _, _ in docs]
    out = set()
    for lang in {la for _, la, _ in docs}:
        idx = [k for k, d in enumerate(docs) if d[1] == lang]
        df = {}
        for k in idx:
            for w in set(toks[k]):
                df[w] = df.get(w, 0) + 1
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        V = len(kept)
        sources = sorted({docs[k][2] for k in idx})

        def ps(ks):
            c = {w: 0 for w in kept}
            for k in ks:
                for w in toks[k]:
                    if w in c:
                        c[w] += 1
            N = sum(c.values())
            return c, {w: 1 + (10**9 * (c[w] + 2)) // (N + 2 * V) for w in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        _, q = ps(idx)
        per = {s: ps([k for k in idx if docs[k][2] == s]) for s in sources}
        for s in sources:
            c, p = per[s]
            pairs = sorted(((sum(f(p[w], per[o][1][w]) for w in kept), o) for o in sources if o != s), key=lambda t: (-t[0], t[1].encode()))
            out |= {(lang, s, "pair", o, v, r + 1) for r, (v, o) in enumerate(pairs)}
            terms = sorted(((f(p[w], q[w]), w) for w in kept if c[w] > 0 and p[w] > q[w]), key=lambda t: (-t[0], t[1].encode()))
            out |= {(lang, s, "term", w, v, r + 1) for r, (v, w) in enumerate(terms[:top])}
    return out


def test_divergence_equals_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "GAMMA", "délta", "Ωmega", "x", "Zeta's", "b2b", "naïve", "ÉCOLE", "a-b"]
    rows = []
    for k in range(160):
        text = " ".join(str(rng.choice(words)) for _ in range(int(rng.integers(0, 12))))
        rows.append((text, str(rng.choice(["en", "fr"])), str(rng.choice(["s1", "s2", "s3"]))))
    rows += [("Alpha beta beta", "en", "hot")] * 40  # a large group of copies in one source
    rows += [(None, None, None), ("", "en", "empty-source"), ("12 34 !!", "en", None), ("Solo words here", "de", "only")]
    rows += [("Alpha " * 5000, "en", "s1")]  # a long text
    rows += [("rare", "xx", "a"), ("rare", "xx", "b")]  # a lang without kept terms
    frame = spark.createDataFrame([(k, t, la, s, 0, "c", "c", "c") for k, (t, la, s) in enumerate(rows)], DOCS)
    got = {tuple(r) for r in divergence.audit(frame, min_docs=3, top_terms=4).collect()}
    assert got == brute_divergence(rows, 3, 4)


def test_divergence_empty(spark):
    frame = spark.createDataFrame([], DOCS)
    assert divergence.audit(frame).count() == 0


PQ = (693748501, 829348807)  # (p - q)^2 / (p + q) is 180 / 1523097308 below a whole number
CN = [(731443, 1941897971), (10_000_000_000, 30_000_000_000)]


def test_divergence_values_are_floored_exactly(spark):
    """A quotient just below a whole number is not rounded up to it; counts beyond the
    range of the long product go on in decimals."""
    p, q = PQ
    row = spark.range(1).select(divergence._f(F.lit(p).cast("long"), F.lit(q).cast("long")).alias("f"), *[
        divergence._p(*[F.lit(x).cast("long") for x in (c, n, 1)]).alias(f"p{i}") for i, (c, n) in enumerate(CN)
    ]).first()
    assert row["f"] == (p - q) ** 2 // (p + q)
    assert [row["p0"], row["p1"]] == [1 + 10**9 * (c + 2) // (n + 2) for c, n in CN]


def test_divergence_terms_are_summed_across_flushes_and_copies(spark, monkeypatch):
    """Sums handed on early and copies in several sources give the same result."""
    rows = [(f"{w} " * 3, "l", f"s{i % 3}") for i, w in enumerate(["aa bb É1cc", "Aa,bb dd", "", "aa ÉE çb"] * 5)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    whole = {tuple(r) for r in divergence.audit(frame, 3, 4).collect()}
    monkeypatch.setattr(divergence, "HELD_TERMS", 2)
    parts = [b.to_pydict() for b in divergence._term_sums(iter([pa.RecordBatch.from_pylist(
        [{"text": "aa bb aa", "by": [{"gid": 1, "m": 1}, {"gid": 2, "m": 3}]}, {"text": "bb", "by": [{"gid": 1, "m": 2}]}]
    )]))]
    sums = {}
    for b in parts:
        for g, t, c, dm in zip(*b.values()):
            old = sums.get((g, t), (0, 0))
            sums[g, t] = (old[0] + c, old[1] + dm)
    assert len(parts) > 1 and sums == {(1, b"aa"): (2, 1), (1, b"bb"): (3, 3), (2, b"aa"): (6, 3), (2, b"bb"): (3, 3)}
    assert whole == brute_divergence(rows, 3, 4)
