"""The operators on hard small tables, against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import (
    byte_bpe, chat_format, decontamination, license_scan, near_duplicates, page_templates, quality_rules, repeated_spans,
    ring_sharding, suffix_blocks, token_counts,
)
from emberlog.llm.catalog import ORACLES, QUERIES
from emberlog.llm.components import components
from tests.llm import brute
from tests.oracle import compare, open_duckdb

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string, hits string, unit string, x int"


def sentence(rnd, n):
    return " ".join(rnd.choice("the of and river stone light under Über naïve 年 tree walks 7 42").lower() if rnd.random() < 0.2 else
                    "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [sentence(rnd, 120) for _ in range(12)]
    out = {i: t for i, t in enumerate(base)}
    out[20] = base[0]
    out[21] = base[0].upper()
    for k in range(22, 30):  # near copies of growing distance
        w = base[1].split(" ")
        for j in range(k - 21):
            w[(13 * j + k) % len(w)] = f"edit{k}{j}"
        out[k] = " ".join(w)
    out[30] = base[2] + "\n" + base[3]
    out[31] = None
    out[32] = ""
    out[33] = " \t\n"
    out[34] = "one two"
    out[35] = "One two"
    out[36] = "a" * 3000 + " " + "ab" * 1500
    out[37] = "Getzbe des.\n" * 400
    out[38] = sentence(rnd, 20000)  # very long
    out[39] = out[38][40000:90000]
    out[40] = "ΑΣ ΒK ÉCOLE " + base[4]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Nulls in every column, repeated rows, and columns whose names the operators use inside."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "s0", "s0"][i % 3], None if t is None else len(t), 1, "s", "h", "u", i) for i, t in texts.items()]
    return spark.createDataFrame(rows + [rows[0], rows[3], rows[0]], DDL).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), open_duckdb(SF), ORACLES[name]) is None


def test_quality_counts_and_verdicts(docs, texts, nothing):
    judged = quality_rules.judge(docs, keep=["doc_id", "lang", "source"])
    for r in judged.collect():
        n, chars, symbols, lines, repeated = brute.quality_counts(texts[r.doc_id])
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r._q_base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r._q_base_failed and r._q_kept)
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {0, 3, 20} <= set(ids) and ids.count(0) == 3 and not {31, 32, 37} & set(ids)
    assert quality_rules.quality_filter(nothing).count() == 0


def test_quality_fence_follows_the_source(spark):
    clean, odd = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i}###" for i in range(80))
    rows = [(i, clean.replace("word1 ", f"z{i} "), "en", "a") for i in range(80)] + [(100, odd, "en", "a")]
    rows += [(200 + i, odd.replace("w1#", f"w1{i}#"), "en", "b") for i in range(80)]
    kept = {r.doc_id for r in quality_rules.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert 100 not in kept and set(range(80)) <= kept and set(range(200, 280)) <= kept


def test_sketches_merge_by_addition(spark):
    frame = spark.range(1000).select((F.col("id") % 7).cast("string").alias("g"), *[(F.col("id") * 37 % 991).alias(f"_q_m_{m}") for m in quality_rules.MEASURES])
    parts = quality_rules.sketch(frame.filter("id < 400"), ["g"]).unionAll(quality_rules.sketch(frame.filter("id >= 400"), ["g"]))
    got = {tuple(r) for r in quality_rules.merge(parts, ["g"]).collect()}
    assert got == {tuple(r) for r in quality_rules.sketch(frame, ["g"]).collect()}


def test_near_duplicates(docs, texts, nothing):
    want = brute.near_classes(texts)
    for r in near_duplicates.near_duplicate_classes(docs).collect():
        assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(brute.shingle_set(texts[r.doc_id])))
    kept = near_duplicates.near_deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d in texts if want[d] == d}
    assert near_duplicates.near_duplicate_classes(nothing).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    base = sentence(rnd, 100).split(" ")
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rnd.randrange(len(w))] = f"x{i}y{rnd.random()}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute.near_classes(texts)


def test_odd_sketch_estimates_distance():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 1 << 63, 900, np.uint64), rng.integers(0, 1 << 63, 200, np.uint64)
    a, b = np.concatenate((shared, own[:100])), np.concatenate((shared, own[100:]))
    both = near_duplicates.minhash(np.concatenate((a, b)), np.array([0, 1000, 2000]))
    differ = int((both[0] != both[1]).sum())
    bits = np.unpackbits(near_duplicates.odd_sketch(both), axis=1)
    ones = int((bits[0] ^ bits[1]).sum())
    estimate = -near_duplicates.BITS / 4 * np.log(1 - 2 * ones / near_duplicates.BITS)
    assert abs(estimate - differ) < 15 and ones <= near_duplicates.CUT


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 103: 100, 105: 100}


@pytest.mark.parametrize("unit", [2048, 2])
def test_repeated_spans(docs, texts, nothing, monkeypatch, unit):
    monkeypatch.setattr(repeated_spans, "UNIT", unit)
    want = {d: brute.removal_row(*x) for d, x in brute.repeats(texts).items()}
    for r in repeated_spans.removal_digests(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    if unit == 2048:
        cut = repeated_spans.remove_repeats(docs)
        assert cut.columns == docs.columns
        for r in cut.collect():
            raw, gone = brute.repeats(texts)[r.doc_id]
            text = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
            assert (r.text or "") == text and (r.text is None) == (texts[r.doc_id] is None)
        assert repeated_spans.removal_digests(nothing).count() == 0


def test_repeated_rows_in_separate_lots(spark):
    """Rows that repeat id and text are at one place, whatever lots they come in; later copies under other ids still go."""
    rnd = random.Random(8)
    texts = {i: sentence(rnd, 150) for i in range(6)}
    texts[7] = texts[2]
    texts[8] = sentence(rnd, 30) + " " + texts[4][100:700]
    rows = list(texts.items()) + [(i, texts[i]) for i in (0, 1, 2, 7, 8)]
    want = {d: brute.removal_row(*x) for d, x in brute.repeats(texts).items()}
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert frame.rdd.getNumPartitions() == len(rows)
    got = repeated_spans.removal_digests(frame).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert want[0][1] == 0 and want[7][1] == want[7][0] and want[8][1] >= 500
    left = sorted((r.doc_id, r.text) for r in repeated_spans.remove_repeats(frame).collect())
    assert [t for d, t in left if d in (0, 1, 2)] == [texts[d] for d in (0, 0, 1, 1, 2, 2)]


def test_run_digests_have_two_halves():
    raw = sentence(random.Random(9), 300).encode()
    *_, first, second = repeated_spans.runs([raw, raw, raw.replace(b"a", b"b")])
    assert len(set(zip(first, second))) == len(set(first)) == len(set(second)) < len(first)
    assert not set(first) & set(second)


def test_suffix_order(monkeypatch):
    monkeypatch.setattr(suffix_blocks, "BUCKET", 300)
    rng = np.random.default_rng(2)
    for letters in (2, 26):
        part = rng.integers(97, 97 + letters, 1500).astype(np.uint8)
        text = np.concatenate((part, part[100:900], part[50:1200], np.zeros(suffix_blocks.PAD, np.uint8)))
        starts = rng.permutation(len(text) - suffix_blocks.PAD - 100)
        raw, keys, heads = text.tobytes(), [], []
        for index, head in suffix_blocks.suffix_groups(text, starts):
            keys += [raw[starts[i] : starts[i] + 100] for i in index]
            heads += list(head)
        assert keys == sorted(keys) and len(keys) == len(starts)
        assert [bool(h) for h in heads] == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    assert {(a - b) % 32 for a in suffix_blocks.COVER for b in suffix_blocks.COVER} == set(range(32))


def test_decontamination(spark, docs, texts, nothing):
    items = [(1, " ".join(texts[2].split(" ")[5:30])), (2, "ONE Two!"), (3, None), (4, " ?"), (5, "βκ École"), (10, texts[4][:200]), (1, texts[5][:150])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: brute.contaminated_words(t, items) for d, t in texts.items()}
    windows = decontamination.benchmark_windows(bench)
    for most in (1_000_000, 3):
        got = decontamination.scan(docs, windows, most=most).withColumn("n", decontamination.covered_words()).collect()
        assert {r.doc_id: (r.n_words, r.n, r["items"]) for r in got} == want
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.select("doc_id").distinct().collect()) == sorted(d for d in texts if not want[d][1])
    left = decontamination.remove_spans(docs, bench)
    assert left.columns == docs.columns
    for r in left.collect():
        if not want[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
        else:
            assert len(brute.words_of_letters(r.text)) == want[r.doc_id][0] - want[r.doc_id][1]
    assert decontamination.scan(nothing, windows).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_bpe_equals_the_library(docs, texts, nothing):
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(docs, path, pattern)
    assert coded.columns == [*docs.columns, "tokens"]
    for r in coded.collect():
        assert r.tokens == library.encode_ordinary(texts[r.doc_id] or "")
    for r in byte_bpe.decode(coded.drop("text"), path, pattern).collect():
        assert r.text == (texts[r.doc_id] or "")
    for r in byte_bpe.digests(docs, path, pattern).collect():
        ids, raw = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert byte_bpe.digests(nothing, path, pattern).count() == 0
    own, rnd = byte_bpe.codec(path, pattern), random.Random(1)
    letters = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x10400, 0x1F600, 0x300, 0x4E2D, 0x661]]
    for _ in range(300):
        s = "".join(rnd.choice(letters if rnd.random() < 0.4 else "abc d\n  's") for _ in range(rnd.randint(0, 700)))
        assert [i for e in own.entries([s])[0] for i in e] == library.encode_ordinary(s)
    both = byte_bpe.encode(docs, path, pattern, read_back="text")
    assert set(both.columns) == {*docs.columns, "tokens"} and all(r.text == (texts[r.doc_id] or "") for r in both.collect())


def test_token_histogram(docs, texts, nothing):
    import tiktoken

    path, pattern = byte_bpe.public_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sizes = sorted(len(library.encode_ordinary(texts[r.doc_id] or "")) for r in docs.select("doc_id").collect())
    answers = token_counts.histogram(token_counts.with_lengths(docs, path, pattern))
    rows = {r.n_tokens: r for r in answers.collect()}
    assert set(rows) == set(sizes)
    for k, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.docs_up_to) == (sizes.count(k), sum(s >= k for s in sizes), sum(s <= k for s in sizes))
        assert (r.tokens_at_least, r.truncated_total) == (sum(s for s in sizes if s >= k), sum(min(s, k) for s in sizes))
    for r in token_counts.totals_at(answers, [1, 50, 10**9]).collect():
        assert (r.docs_at_least, r.truncated_total) == (sum(s >= r.limit for s in sizes), sum(min(s, r.limit) for s in sizes))
    assert token_counts.quantile(answers, 0.5) == sizes[-(-len(sizes) // 2) - 1]
    assert token_counts.histogram(token_counts.with_lengths(nothing, path, pattern)).count() == 0


def walk_rows(rows, shards, nodes):
    """One row after the other around the ring, for comparison."""
    at = sorted(ring_sharding.virtual_nodes(shards, nodes).items())
    room, out = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)], {}
    for key in sorted(rows, key=lambda k: (int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), k)):
        cell = int(hashlib.md5(str(key).encode()).hexdigest()[:4], 16)
        i = next((i for i, (c, _) in enumerate(at) if c >= cell), 0)
        while room[at[i % len(at)][1]] == 0:
            i += 1
        room[at[i % len(at)][1]] -= 1
        out[key] = at[i % len(at)][1]
    return out


def test_ring(spark, docs, nothing):
    placed = ring_sharding.assign(spark.range(3000), "id", 16).collect()
    assert {r.id: r.shard for r in placed} == walk_rows(range(3000), 16, 64)
    for s, slots in brute.groups_of((r.shard, r.slot) for r in placed).items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) in (187, 188)
    grown = {r.id: r.shard for r in ring_sharding.assign(spark.range(3000), "id", 17, slack=0.25).collect()}
    roomy = {r.id: r.shard for r in ring_sharding.assign(spark.range(3000), "id", 16, slack=0.25).collect()}
    assert sum(grown[k] != roomy[k] for k in grown) < 0.35 * len(grown)  # about 1/17 without a bound
    rows = ring_sharding.shard(docs, shards=3).collect()
    assert len(rows) == docs.count() and all(r.size >= 1 for r in rows)
    assert ring_sharding.shard(nothing).count() == 0


def test_chat_format(spark, nothing):
    rows = [
        (1, 1, "assistant", "hi \\ </s>[INST] \\\\[/INST]"), (1, 0, "user", "[INST] <<SYS>>\\"), (2, 0, "assistant", "first"), (3, 0, "tool", "<<TEXT>>"),
        (3, 1, None, None), (4, 0, "system", ""), (4, 1, "user", "é" * 5000), (4, 2, "assistant", "年"), (4, 2, "assistant", "年"), (None, None, "user", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("seq", F.lit(2))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    for c, mine in brute.groups_of((r[0], r[1:]) for r in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))).items():
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, 3, 4, None)] == [True, False, False, False, True]
    assert chat_format.read_back(chat_format.format_turns(nothing.selectExpr("doc_id conv_id", "n_chars turn", "lang role", "text"))).count() == 0


def page(article, host_links="<li><a href='/x'>Home</a></li>" * 3, tail="</body></html>"):
    return (f"<!DOCTYPE html><html><head><title>T {article[:5]}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul>{host_links}</ul></nav>"
            f"<!-- ad --><div class=\"ad\">Buy</div><article>{article}</article><footer>&copy; h</footer>{tail}")


def test_pages(spark):
    body = "<h1>Head &amp;amp; x</h1><p><b>One\n two<br>three<p>four<i>five</i> &lt;six</p><div class='comments'>no</div><aside>no</aside><form>no</form>"
    want = "Head &amp; x\n\nOne two three\n\nfourfive <six"
    rows = [(i, f"http://h.example/{i}", page(body)) for i in range(8)]
    rows += [(20, "http://h.example/odd", "<html><body><main><p>Only main"), (21, None, "<p>bare</p> text"), (22, "http://a/b", None), (23, "bad", ""),
             (24, "http://z.example/1", page("<p>" + "long " * 40000 + "</p>", tail="")), (25, "http://h.example/x", page("")), (0, "http://h.example/0", page(body))]
    # a host without article elements: the container that differs most between pages
    rows += [(40 + i, f"http://plain.example/{i}", f"<body><div>Menu all pages</div><div><section><p>Story number {i} of many</p><p>tail{i}</p></section></div>") for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("q")).withColumn("main", F.lit(1))
    got = {r.page_id: r for r in page_templates.extract(frame).collect()}
    assert all(got[i].text == want and got[i].main == "html/body/article" for i in range(8))
    assert got[20].text == "Only main" and got[21].text == "bare\n\ntext" and got[22].text == "" and got[23].text == "" and got[25].text == ""
    assert got[24].text == ("long " * 40000).strip()
    assert all(got[40 + i].text == f"Story number {i} of many\n\ntail{i}" for i in range(6))
    assert page_templates.extract(frame.limit(0)).count() == 0


def test_pages_without_template_text(spark):
    """Texts of the host's template go wherever they stand, also with neutral class names and inside the article; slots stay whole."""
    rnd = random.Random(4)
    words = lambda n: " ".join(sentence(rnd, n).split())
    rows, want = [], {}
    for i in range(6):
        story = [words(40) for _ in range(3)]
        lists = "".join(f"<ul><li>{words(4)}</li></ul>" for _ in range(i % 3))  # the notice moves among its siblings
        want[i] = "\n\n".join([*story[:2], *re.findall("<li>(.*?)</li>", lists), story[2]])
        rows.append((i, f"http://in.example/{i}", f"<html><body><div class='q1'>Menu Home About</div><article><p>{story[0]}</p><p>{story[1]}</p>{lists}"
                     f"<div>Sign up for our letter</div><p>{story[2]}</p></article><div class='q2'>All rights reserved</div></body></html>"))
    for i in range(10, 15):  # sibling divs, words of each page in both, a teaser named article, and a slot that class words would put off
        story = words(200)
        want[i] = story
        rows.append((i, f"http://div.example/{i}", f"<body><div>Menu Home About</div><div class='widget x'><p>{story}</p></div><div>Posted {i}</div><article>Look {i}</article></body>"))
    same = words(50)
    for i in (20, 21):  # an article under two addresses, all of it on both pages
        want[i] = same
        rows.append((i, f"http://two.example/{i}", f"<body><div class='ad'>Buy {i}</div><article><p>{same}</p></article></body>"))
    frame = spark.createDataFrame(rows + rows[:1] + rows[6:7], "page_id long, url string, html string").repartition(5)
    got = page_templates.extract(frame).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r.text == want[r.page_id], (r.page_id, r.main)


def test_license_scan(spark, docs, nothing):
    mit = license_scan.TEMPLATES[7][1]
    rows = [(1, "x " * 40 + mit.upper() + " y" * 30), (2, mit.replace("charge", "cost")), (3, " ".join(mit.split()[:12])), (4, "Released under the MIT License."), (5, None), (6, "")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.template_table(spark))
    got = {(r.doc_id, r.license): r for r in found.collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (4, "MIT")}  # the edited notice keeps 20 of 25 shingles
    assert got[1, "MIT"].share == 100 and got[4, "MIT"].first_word == 0
    assert license_scan.scan(nothing, license_scan.template_table(spark)).count() == 0


def test_pipeline(spark, tmp_path, docs, texts):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(texts[6].split(" ")[5:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tmp_path).collect()}
    kept = {r.doc_id for r in quality_rules.quality_filter(rows).collect()}
    left = {d: t for d, t in texts.items() if d in kept}
    classes = brute.near_classes(left)
    left = {d: t for d, t in left.items() if classes[d] == d}
    left = {d: bytes(b for b, g in zip(*x) if not g).decode("utf-8", "ignore") for d, x in brute.repeats(left).items()}
    left = {d: t for d, t in left.items() if not brute.contaminated_words(t, items)[1]}
    assert {d: r.text for d, r in got.items()} == left and 6 not in got and {0, 4} <= set(got)
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(r.tokens) for r in got.values())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows.limit(0), str(tmp_path)).columns == rows.columns
