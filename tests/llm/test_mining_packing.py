"""Hard negatives and cost-balanced packing against brute force, and the byte-level encoder against its library."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annoquery.llm.byte_tokens import ByteTextEncoder
from annoquery.llm.cost_packing import balance, pack_balanced
from annoquery.llm.hard_negatives import emitted, mine, _packed

FILE = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, positives=5, negatives=5):
    known = []
    for key, vector, label in rows:
        if key is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            known.append((key, (label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, mine_, v in known:
        if a % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in known if i != a)
            for s, i in [(-s, i) for s, i, label in scored if label == mine_][:positives]:
                inside = [(-t, j) for t, j, label in scored if label != mine_ and 80 * s <= -100 * t <= 100 * s][:negatives]
                out += [(a, i, k, j, s, t) for k, (t, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims, n, per_round", [(3, 900, 100), (2, 600, 3), (8, 700, 4)])
def test_hard_negatives_equal_brute_force(spark, dims, n, per_round):
    draw = random.Random(dims)
    rows = [(i, [draw.choice([0.0, 0.01, 0.02, -0.01, 0.5]) for _ in range(dims)], draw.randrange(3)) for i in range(n)]
    rows[50], rows[200] = (50, None, 1), (200, None, 1)
    rows[301:305] = [(301, [math.nan] * dims, 1), (302, [None] * dims, 1), (303, [math.inf] * dims, 1), (304, [0.1] * dims, None)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("own")).repartition(5)
    assert sorted(map(tuple, mine(table, round_anchors=per_round).collect())) == brute_negatives(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert mine(spark.createDataFrame([], VECTORS)).count() == 0
    same = [(i, [1.0, 1.0], i % 2) for i in range(0, 400)]  # one vector: every score is tied
    assert sorted(map(tuple, mine(spark.createDataFrame(same, VECTORS)).collect())) == brute_negatives(same)
    huge = [(100, [3e12, 1.0], 1), (101, [2.0, 1.0], 1), (102, [2.0, 0.5], 2), (103, [-2.0, 1.0], 2)]  # beyond exact floating point
    assert sorted(map(tuple, mine(spark.createDataFrame(huge, VECTORS)).collect())) == brute_negatives(huge)
    repeated = [(100, [1.0], 1), (100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2), (102, [0.9], 2)]
    assert [tuple(r)[1:4] for r in mine(spark.createDataFrame(repeated, VECTORS)).orderBy("rank").collect()] == [(101, 1, 102), (101, 2, 102)]


def test_stream_needs_no_anchor_in_memory():
    def keys():  # a million rows of one anchor, read one by one
        yield _packed(0, 10**7, 1), 1
        for i in range(10**6):
            yield _packed(0, 10**7 - 1 - i, i), 0

    out = emitted(keys(), 5, 80)
    assert [next(out)[3] for _ in range(5)] == [0, 1, 2, 3, 4] and next(out, None) is None


def test_byte_encoder_equals_its_library():
    own, library, draw = ByteTextEncoder(FILE, most=500), Tokenizer.from_file(FILE), random.Random(1)
    parts = [" ", "  ", "\n", "\t", " ", " ", "a", "B", "é", "中", "'s", "'ll", "1", "23", "!", "...", "<|endoftext|>", "\x1c", "\x85", "​", "😀", " x", "\xa0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        assert [ids.tolist() for ids in own.encode(texts[at : at + 100])] == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]
    assert [len(ids) for ids in own.encode([None, "", " "])] == [0, 0, 1]


def packed(docs):
    """Check places and ids of every piece; pieces, sequences, tokens of padding, and the squared lengths of each full sequence."""
    library, rows = Tokenizer.from_file(FILE), pack_balanced(docs, FILE).collect()
    pieces, sequences, texts = defaultdict(list), defaultdict(list), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for key, text in texts.items():
        ids, at = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    padding, squares = 0, []
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
        squares += [sum(n * n for _, n in held)] if at == 1024 else []
    return len(rows), len(sequences), padding, squares


def test_packing_places_every_token_without_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    _, _, padding, squares = packed(docs)
    assert padding == 0 and np.std(squares) < 0.3 * np.mean(squares)


def test_packing_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b  c"), (4, "x " * 3000), (5, "word " * 700)]
    assert packed(spark.createDataFrame(rows, "doc_id long, text string"))[2] == 0
    assert packed(spark.createDataFrame([(i, "y " * 400) for i in range(50)], "doc_id long, text string"))[2] == 0
    assert pack_balanced(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string").withColumn("rank", F.lit(1))
    assert sorted((r["doc_id"] or 0, r["length"]) for r in pack_balanced(twice, FILE).collect()) == [(0, 2), (1, 2), (1, 2)]


def test_balance_goes_to_the_lowest_cost():
    groups, over = balance(Counter({512: 30, 300: 20, 100: 100, 10: 300}), 1024)
    assert sum(times * sum(k * n for n, k in held.items()) for _, times, held in groups) + sum(n * k for n, k in over.items()) == 512 * 30 + 6000 + 10000 + 3000
    assert all(room == 1024 - sum(n * k for n, k in held.items()) >= 0 for room, _, held in groups)
    greedy, blind = (balance(Counter({512: 300, 300: 200, 100: 1000, 10: 3000}), 1024, quadratic=q)[0] for q in (1 / 256, 0))
    spread = lambda groups: np.std(np.repeat([sum(k * n * n for n, k in held.items()) for _, _, held in groups], [t for _, t, _ in groups]))
    assert spread(greedy) < spread(blind)
