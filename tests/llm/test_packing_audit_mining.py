"""Packing, the filter audit and hard negatives, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import curve_packing, filter_audit, hard_negatives
from emberlog.llm.catalog import QUERIES
from tests.llm import brute
from tests.oracle import compare, open_duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, _ids string, _key int"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdéж年 😀'") for _ in range(rnd.randint(1, 9)))
    out = {i: " ".join(word() for _ in range(rnd.randint(1, 400))) for i in range(40)}
    out |= {40: None, 41: "", 42: " \t\n", 43: out[3], 44: "A B C", 45: out[3], 46: "x " * 30000, 47: "it's 12 $x <|endoftext|> \u0085 y​"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "de"][i % 3], None, 1, "p", 7, "i", i) for i, t in texts.items()]
    return spark.createDataFrame(rows + [rows[5], rows[3], (None, "no id", "en", "s", 1, "p", 7, "i", 1)], DOCS).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- op11

def test_curve_visits_neighbours():
    side, dims = 4, 2
    cells = np.array([(a, b) for a in range(1 << side) for b in range(1 << side)])
    keys = curve_packing.hilbert_key(cells, side)
    assert sorted(keys) == list(range(1 << side * dims))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    cube = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    assert (np.abs(np.diff(cube[np.argsort(curve_packing.hilbert_key(cube, 3))], axis=0)).sum(1) == 1).all()


def check_pieces(rows, want, limit):
    """``want``: Counter of (id, ids as tuple). Every id lies in one piece; no sequence is padded."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length >= 1
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.doc_tokens, tuple(ids)))
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit and (at == limit or at & (at - 1) == 0)
        sizes.append(at)
    copies = Counter(d for d, _ in want.elements())
    for d, pieces in by_doc.items():
        if copies[d] == 1:
            assert [p[0] for p in sorted(pieces)] == list(np.cumsum([0, *[len(p[2]) for p in sorted(pieces)]])[:-1])
            whole = tuple(x for p in sorted(pieces) for x in p[2])
            assert want[d, whole] == 1 and pieces[0][1] == len(whole)
    total = sum(len(x) for _, x in want.elements())
    assert sum(sizes) == total and set(by_doc) == set(copies)
    return sizes


def public_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(curve_packing.public_vocabulary()[0])
    t.encode_special_tokens = True
    return [(*e.ids, 1) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("limit,ranges", [(2048, None), (64, 3), (1, 2), (100, 1)])
def test_packing(docs, limit, ranges):
    rows = docs.collect()
    want = Counter(zip([r.doc_id for r in rows], public_ids([r.text for r in rows])))
    packed = curve_packing.pack(docs, *curve_packing.public_vocabulary(), end_id=1, limit=limit, ranges=ranges).collect()
    sizes = check_pieces(packed, want, limit)
    if limit == 2048 and ranges is None:
        assert max(sizes) == 2048


def test_packing_keeps_neighbours_together(spark):
    rnd = random.Random(1)
    kinds = [["alpha", "beta", "gamma"], ["uno", "dos", "tres"], ["rot", "blau", "grün"], ["sol", "mar", "ciel"]]
    rows = [(i, " ".join(rnd.choice(kinds[i % 4]) for _ in range(40))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    packed = curve_packing.pack(frame, *curve_packing.public_vocabulary(), end_id=1, limit=512, ranges=1).collect()
    mixes = defaultdict(Counter)
    for r in packed:
        mixes[r.sequence_id][r.doc_id % 4] += r.length
    pure = sum(max(c.values()) for c in mixes.values()) / sum(sum(c.values()) for c in mixes.values())
    assert pure > 0.8  # 0.25 to 0.35 in any order that doesn't look at the texts


def test_packing_by_query(spark):
    rows = QUERIES["op11_curve_packing"](spark, SF).collect()
    read = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = dict(zip([r.doc_id for r in read], public_ids([r.text for r in read])))
    for r in rows:
        raw = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_copies_are_spread_over_ranges(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one text that all rows share").alias("text"))
    packed = curve_packing.pack(frame, *curve_packing.public_vocabulary(), end_id=1, ranges=8)
    by_range = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 40)).count().collect()]
    assert len(by_range) == 8 and max(by_range) < 3 * 4000 / 8


def test_packing_nothing(nothing):
    packed = curve_packing.pack(nothing, *curve_packing.public_vocabulary(), end_id=1)
    assert packed.collect() == [] and packed.columns[:2] == ["doc_id", "start"]


# ---- op12

def brute_failures(text):
    t, w = text or "", brute.words_by_blanks(text)
    return {
        "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
        "D": any(c in "#$%&*|" for c in t)}


def test_audit(spark, docs):
    marks = spark.createDataFrame(
        [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 45, 2)] + [(4, 1, 1, "x"), (6, None, None, "x"), (None, 1, 1, "x")],
        "doc_id long, quality int, toxic int, part string")
    good = {r.doc_id for r in marks.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in marks.collect() if r.toxic == 1 and r.doc_id is not None}
    rows = docs.collect()
    smallest = defaultdict(lambda: math.inf)
    for r in rows:
        if r.doc_id is not None:
            smallest[r.text or ""] = min(smallest[r.text or ""], r.doc_id)
    judged = [(r, brute_failures(r.text) | {"E": (math.inf if r.doc_id is None else r.doc_id) > smallest[r.text or ""]}) for r in rows]
    want, shares = {}, Counter()
    for order in permutations("ABCDE"):
        for r, fails in judged:
            out = False
            for k, letter in enumerate(order, 1):
                c = want.setdefault((r.lang or "", "".join(order), k), Counter())
                if fails[letter]:
                    c["unique_fails"] += sum(fails.values()) == 1
                    c["redundant" if out else "removed"] += 1
                    if not out:
                        c["good_lost"] += r.doc_id in good
                        c["toxic_lost"] += r.doc_id in toxic
                        shares[r.lang or "", letter] += 1
                    out = True
                c["kept"] += not out
    got = filter_audit.audit(*reversed(filter_audit.mask_cells(docs, marks))).collect()
    assert len(got) == len(want) == 3 * 600
    for r in got:
        c = want[r.part, r.filter_order, r.step]
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == c[name], (r, name, c)
        assert r.shapley == shares[r.part, r.filter_order[r.step - 1]]


def test_audit_of_other_filters(spark, nothing):
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(cells, ["X", "Y"]).collect()}
    assert rows["XY", 1].removed == 5 and rows["XY", 2].removed == 0 and rows["XY", 2].redundant == 5
    assert rows["YX", 1].shapley == 5 == rows["YX", 2].shapley and rows["YX", 2].kept == 2
    with pytest.raises(ValueError):
        filter_audit.audit(cells, list("ABCDEFG"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    letters, none = filter_audit.mask_cells(nothing, labels)
    assert filter_audit.audit(none, letters).collect() == []


# ---- op13

def brute_negatives(rows, scale=256):
    sound = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    last = lambda i: math.inf if i is None else i
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in sound:
        if i is None or i % 100:
            continue
        scored = [(j, l, dot(v, w)) for j, l, w in sound]
        near = sorted(((-s, last(j), j) for j, l, s in scored if l == label and j != i))[:5]
        for s, _, j in near:
            s = -s
            far = sorted((-t, last(m), m) for m, l, t in scored if l != label and 80 * s <= 100 * t <= 100 * s)[:5]
            out += [(i, j, k + 1, m, s, -t) for k, (t, _, m) in enumerate(far)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("strength", [1.0, 3000.0])
def test_hard_negatives(spark, monkeypatch, strength):
    rnd = random.Random(8)
    rows = [(k * 10, rnd.choice([0, 0, 0, 1, 2]), [rnd.choice([-1.0, -0.5, 0.25, 0.3, 1.0]) * rnd.choice([1.0, strength]) for _ in range(70)]) for k in range(120)]
    rows += [(i + 1, lab, v) for i, lab, v in rows[:30]]  # the same vectors: ties
    rows += [rows[0], rows[0], rows[7], (300, 1, rows[3][2]), (None, 1, rows[0][2]), (None, 0, rows[0][2])]
    rows += [(500, 9, [1.0] * 70), (2001, None, [1.0] * 70), (2002, 1, None), (2003, 1, [float("nan")] * 70),
             (2004, 1, [float("inf")] + [0.0] * 69), (2005, 1, [None] + [0.0] * 69), (2100, 1, []), (2101, 1, [2.0, 1.0])]
    frame = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, _id string, _seq int").repartition(6)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 4000)  # several blocks of anchors
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 9)
    monkeypatch.setattr(hard_negatives, "TILE", (3, 4))
    got = hard_negatives.mine(frame, lambda i: i % 100 == 0).drop("anchor_no").collect()
    assert sorted(map(tuple, got), key=repr) == brute_negatives(rows)
    assert {r.anchor_id for r in got} >= {0, 300}


def test_scores_are_exact():
    rnd = np.random.default_rng(2)
    a, b = (rnd.integers(-(1 << 26), 1 << 26, (5, 200)) for _ in range(2))
    bound = max(int(sum(int(x) ** 2 for x in r)) for m in (a, b) for r in m)
    primes = hard_negatives.primes_for(bound)
    assert math.prod(primes) > 2 * bound and all(p < 1024 and all(p % q for q in range(2, p)) for p in primes)
    got = hard_negatives.scores([hard_negatives.residues(a, p) for p in primes], [hard_negatives.residues(b, p) for p in primes], primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(none, lambda i: i % 100 == 0).collect() == []
    alone = spark.createDataFrame([(100, 1, [1.0]), (101, 2, [1e30])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(alone, lambda i: i % 100 == 0).collect() == []


def test_mining_equals_sql_on_more_rows(spark):
    from emberlog.llm.catalog import ORACLES

    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op13_hard_negatives"](spark, sf), open_duckdb(sf), ORACLES["op13_hard_negatives"]) is None
