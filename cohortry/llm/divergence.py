"""Source divergence audit: how far each source's term distribution lies from the other
sources of its language, and which terms it over-represents.

Identical texts are collapsed per language first, with their multiplicity per source, and
each distinct text is tokenized once; document frequencies and term counts are then sums
weighted by those multiplicities. A text copied thousands of times costs one tokenization.

Terms: runs of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]` (ASCII letters and any non-ASCII
character), with only A-Z lower-cased. A language keeps the V terms that occur in at least
`min_docs` of its documents. For every (lang, source) group and for the language as a
whole, a kept term with count c (0 included) has p = 1 + floor(1e9 (c + 2) / (N + 2V)),
N the sum of the group's counts over kept terms. For p and q, f = floor((p-q)^2 / (p+q)).
All arithmetic is exact (whole divisions of longs, of decimals where a count needs them).

Pairs are evaluated sparsely: a term that is absent from a group has the group's constant
p0 = 1 + floor(2e9 / (N + 2V)), so a pair's sum over all V terms is its sum over the terms
present in either group plus (V - |present in either|) f(p0_A, p0_B). Terms present in
both meet inside the term's row, which lists its groups; terms present in one meet the
other group's p0, once per distinct count of the group.

Output (lang, source, part, item, value, rank):
- part `pair`: item is every other source of the lang; value the sum of f over all kept
  terms (0 when V = 0); every rank;
- part `term`: item is a kept term with count > 0 in the group whose p exceeds the
  language's p (q), value f(p, q); ranks 1 to `top_terms` only.
Ranks count from 1 per (lang, source, part) by value descending, then item ascending in
UTF-8 byte order (ties of value and item cannot happen: items differ).

Defined results: null text, lang and source read as ''; empty or letterless texts count as
documents without terms; a group without kept terms still has pair rows; a lang with one
source has no pair rows; an empty table gives no rows; very long texts are tokenized whole;
repeated rows are separate documents; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.llm.common import BROADCAST_KEYS
from cohortry.session import checkpoint

# bytes of a term as they are, A-Z lower-cased, every other ASCII byte a space: bytes of
# non-ASCII characters are 0x80 and above, so words of bytes are the terms
TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
#: (group, term) sums a task holds before it hands them on.
HELD_TERMS = 250_000


def _p(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(1e9 (c + 2) / (n + 2v)), exactly: in longs, in decimals where those end."""
    small = F.call_function("div", F.lit(1_000_000_000).cast("long") * (c + 2), n + 2 * v)
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (c.cast("decimal(20,0)") + 2)
    return F.lit(1).cast("long") + F.when(c < 9_000_000_000, small).otherwise(F.call_function("div", top, (n + 2 * v).cast("decimal(20,0)")))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exactly: p and q are at most 1e9 + 1, so longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _term_sums(batches):
    """(gid, term, c, dm) of texts with their sources: occurrences and documents, summed
    over the texts of a task until `HELD_TERMS` sums are held."""
    occurrences, documents, held = {}, {}, 0

    def flush():
        for gid, c in occurrences.items():
            dm = documents[gid]
            columns = [pa.array([gid] * len(c), pa.int64()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64()), pa.array([dm[t] for t in c], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["gid", "term", "c", "dm"])

    for batch in batches:
        for text, by in zip(batch.column("text").cast(pa.binary()), batch.column("by")):
            terms = text.as_py().translate(TERM_BYTES).split()
            once = set(terms)
            for b in by.as_py() if terms else []:
                gid, m = b["gid"], b["m"]
                c, dm = occurrences.setdefault(gid, Counter()), documents.setdefault(gid, Counter())
                held -= len(c)
                if m == 1:
                    c.update(terms)
                    dm.update(once)
                else:
                    for t, n in Counter(terms).items():
                        c[t] += n * m
                        dm[t] += m
                held += len(c)
                if held >= HELD_TERMS:
                    yield from flush()
                    occurrences, documents, held = {}, {}, 0
    yield from flush()


def audit(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    # identical texts per lang share a key of 128 bits and their length; the multiplicities
    # per source move without the text, and the text moves once per distinct key and map
    # partition, to be tokenized once
    d = d.withColumn("tid", F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.length("text").alias("n")))
    per_source = d.groupBy("lang", "tid", "source").agg(F.count("*").alias("m"))
    # each (lang, source) group is a small number in the shuffled rows, not two strings
    groups = per_source.select("lang", "source").distinct()
    langs = checkpoint(groups.select("lang").distinct().withColumn("lid", F.monotonically_increasing_id()))
    groups = checkpoint(groups.join(_small(langs), "lang").withColumn("gid", F.monotonically_increasing_id()))
    per_source = per_source.join(_small(groups), ["lang", "source"])
    by_text = per_source.groupBy("lang", "tid").agg(F.collect_list(F.struct("gid", "m")).alias("by"))  # sources of a text
    texts = d.groupBy("lang", "tid").agg(F.any_value("text").alias("text")).join(by_text, ["lang", "tid"])

    # each distinct text is tokenized once, its terms summed by (group, term) in the task,
    # then before and after the exchange; a lang's term is one row with its groups' counts
    sums = texts.select("by", "text").mapInArrow(_term_sums, "gid long, term binary, c long, dm long")
    every = sums.groupBy("gid", "term").agg(F.sum("c").alias("c"), F.sum("dm").alias("dm"))
    terms = every.join(_small(groups.select("gid", "lid")), "gid").groupBy("lid", "term").agg(
        F.sum("dm").alias("df"), F.sum("c").alias("lc"), F.sort_array(F.collect_list(F.struct("gid", "c"))).alias("by")
    )
    kept = checkpoint(terms.where(F.col("df") >= min_docs).select("lid", "term", "lc", "by"))
    entries = kept.select("term", "lc", F.inline("by"))

    # a lang without kept terms keeps its groups (V = 0): its pairs are worth 0
    by_count = checkpoint(entries.groupBy("gid", "c").agg(F.count("*").alias("n")))  # terms of a group with equal counts
    n_group = by_count.groupBy("gid").agg(F.sum(F.col("c") * F.col("n")).alias("N"))
    sizes = kept.groupBy("lid").agg(F.count("*").alias("V"), F.sum("lc").alias("LN"))
    g = groups.join(n_group, "gid", "left").join(sizes, "lid", "left").fillna(0, ["N", "V", "LN"])
    zero = F.when(F.col("V") > 0, _p(F.lit(0).cast("long"), F.col("N"), F.col("V"))).otherwise(F.lit(1).cast("long"))
    g = checkpoint(g.select("lid", "lang", "gid", "source", "N", "V", "LN", zero.alias("z")))

    def side(x: str, *more: str) -> DataFrame:
        """The groups with their columns named after one side of a pair."""
        return g.select(*more, *[F.col(c).alias(c + x) for c in ("gid", "N", "V", "z")])

    # pairs: terms present in both, in one only, and in neither; f is symmetric, so a pair
    # of groups is met once, the smaller gid first, and mirrored
    a = kept.select("by", F.posexplode("by").alias("at", "a")).select(F.slice("by", F.col("at") + 2, F.size("by")).alias("rest"), "a")
    both = a.select("a", F.explode("rest").alias("b")).select(
        F.col("a.gid").alias("gida"), F.col("a.c").alias("ca"), F.col("b.gid").alias("gidb"), F.col("b.c").alias("cb")
    )
    both = both.join(_small(side("a")), "gida").join(_small(side("b")), "gidb")
    both = both.select("gida", "gidb", "za", "zb", _p(F.col("ca"), F.col("Na"), F.col("Va")).alias("pa"), _p(F.col("cb"), F.col("Nb"), F.col("Vb")).alias("pb"))
    both = both.groupBy("gida", "gidb").agg(
        F.sum(_f(F.col("pa"), F.col("pb"))).alias("f_both"), F.count("*").alias("n_both"),
        F.sum(_f(F.col("pa"), F.col("zb"))).alias("fa_z"), F.sum(_f(F.col("za"), F.col("pb"))).alias("fz_b"),
    )
    # terms of A against B's constant: entries of equal count are worth the same
    one = by_count.withColumnRenamed("gid", "gida").join(_small(side("a", "lid")), "gida").join(_small(side("b", "lid")), "lid").where("gida <> gidb")
    one = one.select("gida", "gidb", "n", _f(_p(F.col("c"), F.col("Na"), F.col("Va")), F.col("zb")).alias("f"))
    one = checkpoint(one.groupBy("gida", "gidb").agg(F.sum(F.col("n") * F.col("f")).alias("f_one"), F.sum("n").alias("n_one")))
    other = one.select(F.col("gida").alias("gidb"), F.col("gidb").alias("gida"), F.col("f_one").alias("f_other"), F.col("n_one").alias("n_other"))
    grid = side("a", "lid").join(side("b", "lid"), "lid").where("gida < gidb")
    pair = ["gida", "gidb"]
    pairs = grid.join(one, pair, "left").join(other, pair, "left").join(both, pair, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    union = z("n_one") + z("n_other") - z("n_both")
    value = z("f_both") + (z("f_one") - z("fa_z")) + (z("f_other") - z("fz_b")) + (F.col("Va") - union) * _f(F.col("za"), F.col("zb"))
    ends = F.array(F.struct(F.col("gida").alias("gid"), F.col("gidb").alias("other")), F.struct(F.col("gidb").alias("gid"), F.col("gida").alias("other")))
    pair_rows = pairs.select(value.alias("value"), F.inline(ends)).join(g.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")

    p, q = _p(F.col("c"), F.col("N"), F.col("V")), _p(F.col("lc"), F.col("LN"), F.col("V"))
    term_rows = entries.join(_small(g.select("gid", "N", "V", "LN")), "gid").select("gid", "term", p.alias("p"), q.alias("q"))
    term_rows = term_rows.where(F.col("p") > F.col("q")).select("gid", F.col("term").cast("string").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("gid").orderBy(F.col("value").desc(), F.col("item").cast("binary"))
    ranked_terms = term_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    ranked_pairs = pair_rows.withColumn("rank", F.row_number().over(order))
    cols = ["gid", "part", "item", "value", "rank"]
    out = ranked_pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(ranked_terms.withColumn("part", F.lit("term")).select(*cols))
    return out.join(_small(g.select("gid", "lang", "source")), "gid").select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
