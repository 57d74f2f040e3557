"""The text operators against brute force, round trips and held-out accuracy, and on odd rows."""

import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortry.llm import common, decontam, embdedup, langid, mixing, preference, quality, simhash, tokcount, tokenstore, toxicity
from conftest import SMALL
from oracle import compare, connect

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a b", "  a  b ", "\n\na", "a\n", "a \n b", "it's 'TIS don't,x, y.", "<|endoftext|> a <|startoftext|>b", "a\x1cb \x1c c",
    "a b   c", "x\r\ny", "\t\ta\tb", "ΣΑΣ ΟΔΟΣ,", "é Ñ\nß 12 3.4 İ", "日本 語\nテ", "a' s 's ll 'll", "\x00 \x01", "½ ² Ⅷ. ²!", "!!! ???", "12 34", "word " * 30_000,
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table_of(spark, texts, **more):
    """Documents with repeated rows, a null id and columns whose names clash."""
    rows = [(k, t, "en", "s0", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "no id here", None, None, None)], DOCS)
    for c in ("fp", "key", "score", "copies", "start", "component_id", "name", "tokens"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return table_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SMALL, "documents")


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_oracles(spark):
    con = connect(SMALL)
    for name in ("op1_preference_format",):
        ok, message = compare(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], con)
        assert ok, message


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


# 1 preference formatting


def test_preference_brute_force(spark):
    rng = np.random.default_rng(5)
    chosen, rejected, want = [], [], {}
    for pair in range(40):
        a = [(["user", "assistant", None][rng.integers(3)], ["x", "yy", "", None][rng.integers(4)]) for _ in range(rng.integers(0, 6))]
        b = a[: rng.integers(0, len(a) + 1)] + [("assistant", str(rng.integers(3))) for _ in range(rng.integers(0, 3))]
        chosen += [(pair, k, *t) for k, t in enumerate(a)]
        rejected += [(pair, k, *t) for k, t in enumerate(b)]
        k = len(list(itertools.takewhile(lambda t: t[0] == t[1], zip(a, b, strict=False))))
        write = lambda ts: "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in ts)
        if a or b:
            want[pair] = (k, write(a[:k]), write(a[k:]), write(b[k:]), [t or "" for r, t in a[k:] if r == "assistant"])
    schema = "pair_id bigint, turn int, role string, text string, chosen string"
    c, r = (spark.createDataFrame([(*x, "clash") for x in rows], schema) for rows in (chosen, rejected))
    got = preference.format_pairs(c, r).collect()
    assert {g["pair_id"] for g in got} == set(want)
    for g in got:
        k, prompt, a, b, learned = want[g["pair_id"]]
        assert (g["prompt_turns"], g["prompt"], g["chosen"]["text"], g["rejected"]["text"]) == (k, prompt, a, b)
        assert [a[s["start"] : s["end"]] for s in g["chosen"]["spans"]] == [t + "<|end|>\n" for t in learned]
    assert preference.format_pairs(c.limit(0), r.limit(0)).count() == 0
    one = preference.format_pairs(c.where("pair_id = 0").limit(0), r.where("pair_id = 1")).collect()
    assert all(x["prompt_turns"] == 0 and x["chosen"]["text"] == "" for x in one)


# 2 quality


def test_quality(spark, docs, odd, empty):
    labels = common.table(spark, SMALL, "labels")
    model = quality.fit(common.labelled_sample(docs, labels, "quality", common.fold(F.col("key"), 5) != 0, 20_000))
    held = docs.join(labels, "doc_id").where(common.fold(F.col("doc_id"), 5) == 0)
    rows = held.select("quality", quality.score(model, F.col("text")).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.3) == (r["quality"] == 1) for r in rows]) > 0.85
    got = [r[0] for r in odd.select(quality.score(model, F.col("text"))).collect()]
    assert len(got) == len(ODD) + 2 and all(0 <= s <= 1 for s in got) and got[0] == got[1]
    assert empty.select(quality.score(model, F.col("text"))).count() == 0
    constant = quality.fit(spark.createDataFrame([], "key bigint, text string, y int"))
    assert odd.select(quality.score(constant, F.col("text")).alias("s")).where("s <> 0.5").count() == 0


def test_isotonic_is_the_least_squares_order():
    x = np.arange(6.0)
    grid, level = quality.isotonic(x, np.array([0.0, 3, 1, 5, 4, 9]), np.full(6, 10.0))
    assert (np.diff(level) >= 0).all() and len(grid) == 4
    assert np.allclose(grid, [0, 1.5, 3.5, 5])


# 3 toxicity


def test_toxicity_finds_the_sentence(spark, odd, empty):
    rng = np.random.default_rng(1)
    plain = ["river", "stone", "cloud", "paper", "green", "table"]
    rows = []
    for k in range(400):
        s = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        y = int(k % 4 == 0)
        if y:
            s[rng.integers(5)] += " vilest person"
        rows.append((k, ". ".join(s) + ".", y))
    model = toxicity.fit(spark.createDataFrame(rows, "key bigint, text string, y int"))
    text = "A green river. You vilest person! The table."
    found = toxicity.judge(model, F.lit(text))
    r = spark.range(1).select(found.alias("j")).first()["j"]
    assert r["score"] > 0.7 and [text[s["start"] : s["end"]].strip() for s in r["offending"]] == ["You vilest person!"]
    assert 1 - np.prod([1 - p for _, _, p in model.sentence_scores(text)]) == pytest.approx(r["score"])
    got = odd.select(toxicity.judge(model, F.col("text"))["score"].alias("s")).collect()
    assert all(0 <= x["s"] <= 1 for x in got) and got[0]["s"] == 0
    assert empty.select(toxicity.judge(model, F.col("text"))).count() == 0
    assert toxicity.fit(spark.createDataFrame(rows[1:3], "key bigint, text string, y int")).weights == {}


def test_toxicity_held_out(spark, docs):
    out = entry.queries()["op3_toxicity_mil"](spark, "/root/testdata/sf0.01").where("held_out")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = out.join(labels, "doc_id").select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.93


# 4 language


def naive_phrases(data, texts):
    out = 0
    for s in range(0, len(texts), 256):
        part, at = texts[s : s + 256], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at : at + n + 1] in data:
                n += 1
            at += n
            out += 1
    return out


def test_language_brute_force(spark, odd, empty):
    rng = np.random.default_rng(2)
    a, b = (" ".join("".join(rng.choice(list(s), rng.integers(1, 7))) for _ in range(300)) for s in ("abcdef", "defghié"))
    model = langid.LanguageModel((("aa", langid.letters(a).tobytes()), ("bb", langid.letters(b).tobytes())))
    texts = ["abc fed", "ghi 12 é!", "zzz", "def", a[50:900], b[10:700] + a[:300]]
    _, counts = langid.phrases(model, texts)
    want = [[naive_phrases(d, langid.letters(t).tobytes()) for _, d in model.texts] for t in texts]
    assert counts.tolist() == want
    got = odd.select(langid.predict(model, F.col("text")).alias("p")).collect()
    letter = [any(map(str.isalpha, t or "")) for t in [*ODD, ODD[3], "no id here"]]
    assert [g["p"]["lang"] != "und" for g in got] == letter
    assert empty.select(langid.predict(model, F.col("text"))).count() == 0
    assert langid.fit(empty, F.lit(True)).texts == ()
    assert odd.select(langid.predict(langid.LanguageModel(()), F.col("text"))["lang"].alias("l")).where("l <> 'und'").count() == 0


def test_language_held_out(spark):
    out = entry.queries()["op4_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = out.join(common.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


# 5 decontamination


def test_decontamination_finds_replaced_tokens(spark, odd, empty):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 5))
    items = [[word() for _ in range(n)] for n in (30, 24, 18, 9, 6, 4)]
    bench = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(items)] + [(99, " ".join(items[0]), "x"), (7, None, "x"), (8, "", "x"), (None, "a b c d e f", "x")], "item_id bigint, text string, start string")
    texts, want = [], []
    for k, item in enumerate(items):
        for swap in ([], [len(item) // 2]):
            t = [word() if i in swap else w.upper() for i, w in enumerate(item)]
            texts.append(" ".join([word() for _ in range(40)] + t + [word() for _ in range(40)]))
            want.append([k] if len(item) >= 12 or (not swap and len(item) >= 5) else [])
    texts.append(" ".join(word() for _ in range(200)))
    want.append([])
    df = table_of(spark, texts).where("doc_id is not null")
    got = {}
    for r in decontam.contaminated(df, bench).collect():
        got.setdefault(r["doc_id"], []).append(r["item_id"])
        assert texts[r["doc_id"]].lower()[r["start"] : r["end"]].split()[0] == items[r["item_id"]][0]
        assert r["n_tokens"] == r["item_tokens"]
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: v for k, v in enumerate(want) if v}
    kept = {r["doc_id"] for r in decontam.clean(df, bench).collect()}
    assert kept == {k for k, v in enumerate(want) if not v}
    small = decontam.blocks(bench, block_tokens=20)
    assert len(small) > 1 and sum(len(b.ids) for b in small) == len(items)
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(df, bench.where("false")).count() == 0


# 6 token counts


def test_token_counts(spark, docs, odd, empty):
    got = tokcount.count_tokens(docs.unionByName(odd.select(docs.columns)), WORD).collect()
    library = tokcount.Counter(WORD).tokenizer
    texts = [r["text"] for r in docs.unionByName(odd.select(docs.columns)).collect()]
    assert [g["n_tokens"] for g in got] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [g["n_bytes"] for g in got] == [len((t or "").encode()) for t in texts]
    assert tokcount.count_tokens(empty, WORD).count() == 0
    whole = tokcount.Counter(WORD).whole
    assert len(whole) > 30_000 and all(len(library.model.tokenize(t)) == 1 for t in list(whole)[:2000])


# 7 mixing


def brute_copies(rows, wanted, seed_order):
    out = {}
    for name in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == name]
        total = sum(r[2] for r in mine)
        blocks = int(wanted[name] // total) if total else 0
        rest, before = wanted[name] - blocks * total, 0
        for r in sorted(mine, key=lambda r: seed_order[r[0]]):
            out[r[0]] = blocks + (1 if before < rest and r[2] > 0 else 0)
            before += r[2]
    return out


@pytest.mark.parametrize("target", [{"entropy": 0.5}, {"repetition": 2.0, "cover": True}])
def test_mixing_brute_force(spark, docs, target):
    cuts, plan = mixing.mix(docs, **target)
    got = {r["doc_id"]: r["copies"] for r in mixing.with_copies(docs, cuts).collect()}
    rows = [(r["doc_id"], r["source"], r["n"], r["u"]) for r in docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n"), mixing._position(F.col("doc_id"), F.col("text"), 7).alias("u")).collect()]
    assert all(r[2] == len(t.split()) for r, t in zip(rows, [x["text"] for x in docs.select("text").collect()], strict=True))
    p = {}
    for r in rows:
        p[r[1]] = p.get(r[1], 0) + r[2]
    total = sum(p.values())
    share = np.array([p[s] / total for s in sorted(p)])
    weights = lambda a: share**a / (share**a).sum()
    measure = (lambda q: -(q * np.log(q)).sum()) if "entropy" in target else (lambda q: -(q / share).max() / (q / share).min())
    goal = (measure(weights(1)) + measure(weights(0))) / 2 if "entropy" in target else -2.0
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        over = measure(weights(mid)) > goal if "entropy" in target else measure(weights(mid)) < goal
        low, high = (mid, high) if over else (low, mid)
    q = weights(high)
    budget = total if "entropy" in target else total * (share / q).max() * (1 + 1e-12)
    planned = {r["name"]: r["wanted"] for r in plan.collect()}
    assert all(planned[s] == pytest.approx(budget * w, rel=1e-8) for s, w in zip(sorted(p), q, strict=True))
    assert got == brute_copies(rows, planned, {r[0]: r[3] for r in rows})
    if "cover" in target:
        assert min(got.values()) >= 1 and mixing.realise(docs, cuts).count() == sum(got.values())


def test_mixing_odd(spark, odd, empty):
    cuts, _ = mixing.mix(odd, entropy=0.5)
    assert mixing.with_copies(odd.drop("copies"), cuts).count() == odd.count()
    assert mixing.realise(odd, cuts).columns == odd.columns
    cuts, _ = mixing.mix(empty, entropy=0.5)
    assert mixing.realise(empty, cuts).count() == 0
    with pytest.raises(ValueError):
        mixing.with_copies(odd, cuts)


# 8 SimHash


def test_simhash_brute_force(spark, docs, odd, empty):
    h = simhash.shingle_hashes("A b\tC d", 3)
    assert h == [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d")]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == h[0]
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0 and simhash.simhash("one Two") == xxhash.xxh64_intdigest("one two", 42)
    both = docs.unionByName(odd.where("doc_id is not null").select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = simhash.near_duplicates(both).collect()
    fps = np.array([r["fp"] for r in rows]).view(np.uint64)
    links = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1)).tolist()
    root = closure(len(rows), links)
    least = {}
    for r, k in zip(rows, root, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in rows] == [least[k] for k in root] and len(rows) == both.count()
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_simhash_hot_lists(spark, monkeypatch, bits):
    """Lists above the block size are compared in pairs of blocks without losing links."""
    monkeypatch.setattr(simhash, "_LIST", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    fps = [int(b) for b in base]
    for b in base:
        fps += [int(b ^ np.int64(sum(1 << int(k) for k in rng.integers(0, 40, rng.integers(1, 7))))) for _ in range(60)]
    fps = sorted(set(fps))
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), bits)
    roots = {r["node"]: r["root"] for r in common.components(edges).collect()}
    u = np.array(fps).view(np.uint64)
    want = closure(len(fps), np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= bits, 1)).tolist())
    assert [roots.get(f, f) for f in fps] == [fps[k] for k in want]


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(6)
    names = rng.permutation(300)
    edges = [(int(names[k]), int(names[k + 1])) for k in range(299) if k != 150] + [(5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = closure(300, edges)
    assert [got[k] for k in range(300)] == want


# 9 token files


def library_ids(texts):
    e = tokenstore.Encoder(BYTE)
    return [np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for t in texts]


def test_encoder_equals_library(docs):
    texts = ODD + [r["text"] for r in docs.select("text").collect()]
    e = tokenstore.Encoder(BYTE, memo=50)
    for _ in range(2):
        assert [x + b"\0\0\0\0" for at in range(0, len(texts), 40) for x in e.encode(pa.array(texts[at : at + 40]))] == library_ids(texts)


def test_token_files_round_trip(spark, tmp_path, docs, odd, empty):
    both = docs.unionByName(odd.where("doc_id is not null").select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    folder = f"file://{tmp_path}/tokens"
    index = tokenstore.write(both, folder, BYTE, frame_bytes=1 << 12)
    rows = both.select("doc_id", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    ids = library_ids([r["text"] for r in rows])
    got = sorted(tokenstore.digest(spark, folder, index).collect(), key=lambda r: r["start"])
    assert [g["doc_id"] for g in got] == [r["doc_id"] for r in rows]
    sizes = np.array([len(x) // 4 for x in ids])
    assert [g["start"] for g in got] == (np.cumsum(sizes) - sizes).tolist()
    assert [(g["n_tokens"], g["ids_crc32"]) for g in got] == [(len(x) // 4, zlib.crc32(x)) for x in ids]
    few = tokenstore.read(spark, folder, index.where("doc_id in (3, 10004)")).collect()
    assert {r["doc_id"]: np.array(r["ids"], "<u4").tobytes() for r in few} == {r["doc_id"]: x for r, x in zip(rows, ids, strict=True) if r["doc_id"] in (3, 10004)}
    # the files stand by themselves: any zstandard reader skips the table
    import zstandard

    path = next((tmp_path / "tokens").glob("*.zst"))
    raw = path.read_bytes()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and flags == 128 and n > 1
    with path.open("rb") as f:
        t = tokenstore.read_seek_table(f, len(raw))
        assert sum(len(tokenstore.read_frame(f, e)) for e in t) == t[:, 2].sum()
        assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) == t[:, 2].sum()
    hurt = tmp_path / "hurt.zst"
    hurt.write_bytes(raw[:-13] + bytes([raw[-13] ^ 1]) + raw[-12:])
    with hurt.open("rb") as f, pytest.raises(ValueError):
        tokenstore.read_frame(f, tokenstore.read_seek_table(f, len(raw))[-1])
    assert tokenstore.round_trip(empty, BYTE).count() == 0
    assert tokenstore.round_trip(odd, BYTE).count() == odd.count()


# 10 vectors


def brute_vectors(x, threshold):
    n = len(x)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    links = []
    for a, b in itertools.combinations(range(n), 2):
        if ok[a] and ok[b] and len(x[a]) == len(x[b]):
            p, q = np.array(x[a], float), np.array(x[b], float)
            if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= threshold:
                links.append((a, b))
    count = np.bincount(np.array(links, int).ravel(), minlength=n) if links else np.zeros(n, int)
    return count.tolist(), closure(n, links)


@pytest.mark.parametrize(("block", "kind"), [(1024, "float"), (24, "double")])
def test_vectors_brute_force(spark, monkeypatch, block, kind):
    monkeypatch.setattr(embdedup, "_LIST", block)
    rng = np.random.default_rng(7)
    x = [v for _ in range(12) for c in [rng.standard_normal(64)] for v in [c, c, 2 * c, *(c + rng.standard_normal(64) * s for s in rng.uniform(0, 0.35, 12))]]
    x += [rng.standard_normal(3) for _ in range(20)]
    x = [[float(np.float32(c)) for c in v] for v in x]
    x += [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63]
    df = spark.createDataFrame([(k, v, "clash") for k, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>, key string")
    count, root = brute_vectors(x, 0.95)
    for reach in (0.15, 1.0) if block == 1024 else (0.15,):
        got = sorted(embdedup.near_duplicates(df, reach=reach).collect())
        assert [g["n_links"] for g in got] == count
        assert [g["component_id"] for g in got] == root and all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got)
    loose = embdedup.near_duplicates(df, epsilon=4.0).agg(F.sum("n_links")).first()[0]
    assert loose >= 0.99 * sum(count)
    assert embdedup.near_duplicates(df.where("false")).count() == 0


def test_vectors_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    d, errors = 64, []
    r = embdedup.rotation(d)
    assert np.allclose(r @ r.T, np.eye(d))
    for _ in range(2000):
        o, q = (v / np.linalg.norm(v) for v in rng.standard_normal((2, d)))
        ro, rq = r @ o, r @ q
        u = np.sign(ro) / np.sqrt(d)
        f, e = u @ ro, u @ rq
        errors.append(e / f - o @ q)
        assert o @ q <= f * e + np.sqrt(1 - f * f) * np.sqrt(1 - e * e) + 1e-12
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(2000)


# pipeline


def test_pipeline_brute_force(spark, docs):
    import corpus_pipeline

    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs, common.fold(F.col("doc_id"), 4) != 2)
    kept = {r["doc_id"] for r in docs.where(langid.accepted(model, F.col("text"))).collect()}
    assert kept == {k for k, r in rows.items() if any(map(str.isalpha, r["text"] or ""))}
    ids = sorted(kept)
    fps = np.array([simhash.simhash(rows[k]["text"]) for k in ids], dtype=np.uint64)
    root = closure(len(ids), np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1)).tolist())
    ids = [k for n, k in enumerate(ids) if root[n] == n]
    words = lambda t: " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower()))
    bench = [words(r["text"]) for r in common.table(spark, SMALL, "benchmark").collect()]
    ids = [k for k in ids if not any(f" {b} " in f" {words(rows[k]['text'])} " for b in bench)]
    out = sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r["start"])
    assert sorted({r["doc_id"] for r in out}) == ids and [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    encoded = dict(zip(ids, library_ids([rows[k]["text"] for k in ids]), strict=True))
    at = 0
    for r in out:
        x = encoded[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x) // 4, zlib.crc32(x))
        at += len(x) // 4


def test_pipeline_odd(spark, odd, empty):
    import corpus_pipeline

    for start in (odd, empty):
        df = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SMALL)
            assert out.columns == df.columns, name
            df = out
        last = corpus_pipeline.STAGES[-1][1](spark, df, SMALL)
        assert last.count() == df.count()


def test_pipeline_near_duplicates_keeps_rows_not_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    text = lambda: " ".join(f"w{int(rng.integers(0, 10**6))}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (None, a), (None, text())]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("_row", F.lit("clash"))
    out = corpus_pipeline.near_duplicates(spark, df.drop("_row"), SMALL)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == sorted([(3, a), (5, b), (7, c), (7, d), (-1, rows[-1][1])])


def test_encoder_leading_white_space():
    spaces = ["\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "​", " ", " ", "　"]
    texts = [w + tail for w in spaces for tail in ("", "a", " a", "\na", "x y")]
    e = tokenstore.Encoder(BYTE)
    got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(pa.array(texts))]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_vectors_scale_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    c, d, e = rng.standard_normal(16), rng.standard_normal(16), rng.standard_normal(16)
    rows = [
        (1, (c * 1e200).tolist()), (2, (c * 1e-200).tolist()), (3, c.tolist()),  # one class of cosine 1 at any scale
        (4, d.tolist()), (4, e.tolist()),  # one id, two unrelated vectors
        (None, (d * 3).tolist()), (9, (d + 1e-3).tolist()),  # a null id links 4's d to 9
        (None, (e * 2).tolist()),  # a component of e: ids 4 (and null)
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(df).collect())
    assert got == sorted([(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (4, 1, 4), (-1, 2, 4), (9, 2, 4), (-1, 1, 4)])
