"""The source divergence audit against brute force, and the transducer against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoquery.llm.divergence import _shares, audit, build_shards
from annoquery.llm.transducer import Transducer

DOCS = "text string, lang string, source string, rank int, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs, top):
    cut = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), lang or "", source or "") for t, lang, source, *_ in rows]
    docs, counts, groups = Counter((lang, w) for terms, lang, _ in cut for w in set(terms)), Counter((lang, s, w) for terms, lang, s in cut for w in terms), defaultdict(set)
    for _, lang, source in cut:
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for (g, w), n in docs.items() if g == lang and n >= least_docs), key=str.encode)

        def shares(n):
            return {w: 1 + 10**9 * (n(w) + 5) // (sum(map(n, kept)) + 5 * len(kept)) for w in kept}

        p, q = {s: shares(lambda w: counts[lang, s, w]) for s in sources}, shares(lambda w: sum(counts[lang, s, w] for s in sources))
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            told = [(p[s][w] - q[w], w) for w in kept if counts[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", told, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("shard_terms, cells", [(1_000_000, 1 << 22), (7, 1)])
def test_audit_equals_brute_force(spark, shard_terms, cells):
    draw = random.Random(4)
    words = ["".join(draw.choices("abZé中-'1", k=draw.randint(1, 4))) for _ in range(60)]
    rows = [(" ".join(draw.choices(words, k=draw.choice([0, 3, 40]))), draw.choice(["en", "en", "e", "", None, "e\0n"]), draw.choice(["s", "s", "S", "", None, "ü"]), 1, "x") for _ in range(150)]
    rows += rows[:5] + [(None, "zz", "only", 1, "x"), ("", "zz", "other", 1, "x"), ("ab " * 30_000 + "a" * 50_000, "en", "long", 1, "x")]
    found = audit(spark.createDataFrame(rows, DOCS).repartition(5), least_docs=3, top=4, shard_terms=shard_terms, cells=cells)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, 4)


def test_audit_of_an_empty_table(spark):
    assert audit(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_source_and_ties(spark):
    rows = [("a b c", "en", "hot", 1, "x")] * 900 + [("a b d", "en", f"s{i}", 1, "x") for i in range(40)]
    assert sorted(map(tuple, audit(spark.createDataFrame(rows, DOCS)).collect())) == brute(rows, 30, 50)


def test_shards_keep_all_terms_in_order(spark):
    terms = spark.range(5000).select(F.element_at(F.array(*map(F.lit, ("de", "en"))), (F.col("id") % 2 + 1).cast("int")).alias("lang"), F.sha1(F.col("id").cast("string")).cast("binary").alias("term"))
    rows = build_shards(terms, 900).orderBy("shard").collect()
    machines = [Transducer.of(r.asDict()) for r in rows]
    found = [m.term(i) for m in machines for i in range(int(m.below[0]))]
    assert len(rows) > 4 and found == sorted(found) and len(found) == 5000 and max(int(m.below[0]) for m in machines) < 3000


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_transducer(n):
    draw = random.Random(n)
    terms = sorted({bytes(draw.choices(b"abcde\x80\xffz", k=draw.randint(1, 8))) for _ in range(n)})
    machine = Transducer.of(Transducer.build(terms).arrays())
    assert [machine.term(i) for i in range(len(terms))] == terms
    words = terms + [b"abq", b"z" * 40, b"a"]
    raw, sizes = b" ".join([*words, b""]), np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    places, ordinals = machine.ordinals(np.frombuffer(raw, np.uint8), starts, starts + sizes)
    assert dict(zip(places.tolist(), ordinals.tolist())) == {i: terms.index(w) for i, w in enumerate(words) if w in terms}
    shared = Transducer.build(sorted(a + b for a in (b"xa", b"xb", b"y") for b in (b"ing", b"ed", b"s")))
    assert len(shared.final) == 7  # ends are shared


def test_shares_are_exact_beyond_longs():
    counts, total = np.array([10**13, 3, 0]), np.array([2 * 10**15 + 7])
    assert _shares(counts, total, 1000, 5, 10**9).tolist() == [1 + 10**9 * (int(c) + 5) // (int(total[0]) + 5000) for c in counts]
