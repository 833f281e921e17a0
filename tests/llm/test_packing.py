import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from groundwork.llm.packing import best_fit, fractional, pack, plan, priced, rounded, traced

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(p := ids[a : a + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for x in inside.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x)])[:-1].tolist() and sum(n for _, n in x) <= capacity
    return len(inside), sum(r[3] for r in want)


def test_priced():
    w = np.full(11, -np.inf)
    w[3], w[4], w[7] = 3.1, 4.0, 6.9
    best, took = priced(w)
    assert traced(took, 10) == {3: 2, 4: 1} and abs(best[10] - 10.2) < 1e-9


def test_plan_covers_exactly():
    rng = random.Random(5)
    for capacity, most in ((10, 10), (64, 40), (512, 300)):
        counts = Counter(rng.randint(1, most) for _ in range(3000))
        packed = plan(dict(counts), capacity)
        got = Counter()
        for inside, times in packed:
            assert 0 < sum(s * a for s, a in inside.items()) <= capacity and times > 0
            for s, a in inside.items():
                got[s] += a * times
        assert got == counts
        least = -(-sum(s * n for s, n in counts.items()) // capacity)
        used, plain = sum(t for _, t in packed), sum(t for _, t in best_fit(dict(counts), capacity, []))
        assert used <= max(plain, least + 2), (used, plain, least)


def test_program():
    """The fractional solution covers no more than there is, its value meets the bound, and rounding takes a good part of the sequences from it."""
    rng = random.Random(8)
    counts = dict(Counter(min(512, int(rng.lognormvariate(4.2, 0.8)) + 1) for _ in range(20_000)))
    program = fractional(counts, 512)
    covered = Counter()
    for inside, v in program.x.items():
        assert v > 0 and sum(s * a for s, a in inside) == 512
        for s, a in inside:
            covered[s] += a * v
    for s, n in counts.items():
        assert abs(covered[s] + program.left.get(s, 0) - n) < 1e-6
    material = sum(s * n for s, n in counts.items()) / 512
    assert program.bound >= material - 1e-6
    used, left = rounded(program, counts)
    kept = Counter(left)
    for inside, times in used:
        for s, a in inside.items():
            kept[s] += a * times
    assert kept == Counter(counts)
    packed = plan(counts, 512)
    assert sum(t for _, t in used) > 0.3 * sum(t for _, t in packed) and program.bound <= sum(t for _, t in packed) + 1e-6 <= material + 3
    assert all((inside, times) in [(i, t) for i, t in packed] for inside, times in used[:5])


def test_bound_above_material():
    # Pieces of more than half a sequence: no two fit together, and the prices say so.
    assert fractional({6: 10, 4: 1}, 10).bound >= 6.4 and sum(t for _, t in plan({6: 10, 4: 1}, 10)) == 10


def test_hard_instances():
    # Best fit alone needs one sequence more than 2 for {6, 5, 5, 2, 2} at 10 with the wrong pairs.
    assert sum(t for _, t in plan({6: 1, 4: 2, 3: 2}, 10)) == 2
    assert all(inside == {10: 1} for inside, _ in plan({10: 7}, 10)) and sum(t for _, t in plan({10: 7}, 10)) == 7


def test_pack_edges(spark):
    texts = [(1, None), (2, ""), (3, "a b c " * 50), (3, "a b c " * 50), (None, "x y"), (4, "q " * 20), (5, "one two three"), (6, "z " * 19)]
    rows = pack(spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, length int"), capacity=20).collect()
    n, total = check(rows, texts, 20)
    assert n <= -(-total // 20) + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pack_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert n <= -(-total // 4096) + 1
