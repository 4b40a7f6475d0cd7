"""A stream's templates: ids that stay, counts that add up, batches in any order."""

from itertools import permutations

import pytest

from emberlog.operators.templates import mine_templates
from emberlog.streaming import leaders as S

SCHEMA = "log_id long, source string, content string"
LINES = [
    *[(i, "s1", f"Receiving block blk_{i} of size {i * 7} from node {w}") for i, w in enumerate(("alpha", "beta", "gamma", "delta"))],
    *[(10 + i, "s1", f"Session opened for user {w}") for i, w in enumerate(("root", "guest", "root"))],
    *[(20 + i, "s2", "Session opened for user root") for i in range(3)],
    (30, "s1", "   "), (31, "s1", None), (32, "s2", "one"),
    *[(40 + i, "s1", f"error {w} in unit {w} stopped") for i, w in enumerate(("x", "y", "z"))],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("order", list(permutations(range(3)))[1::3])
def test_batches_in_any_order_add_up(spark, tmp_path, order):
    store, parts, ids = S.LeaderStore(spark, str(tmp_path / "s")), [LINES[k::3] for k in range(3)], {}
    for version, k in enumerate(order):
        got = {r.log_id: r.template_id for r in store.step(frame(spark, parts[k]), version).collect()}
        assert set(got) == {r[0] for r in parts[k]}
        leaders = {r.template_id: r.leader for r in store.leaders().collect()}
        assert ids.items() <= leaders.items()  # old ids are what they were
        ids = leaders
    templates = {r.template_id: r for r in store.templates().collect()}
    lines = {r.log_id: r.template_id for r in store.lines().collect()}
    assert {i for i, t in lines.items() if t == -1} == {30, 31}
    for t, r in templates.items():
        assert r.n == sum(x == t for x in lines.values())
    assert sum(r.n for r in templates.values()) == len(LINES) - 2
    # the same classes as mining all lines at once
    rows, _ = mine_templates(frame(spark, LINES))
    once = {r.log_id: r.template_id for r in rows.collect()}
    where = {r[0]: r[1] for r in LINES}
    same = lambda x, a, b: x[a] == x[b] and where[a] == where[b]
    assert all(same(once, a, b) == same(lines, a, b) for a in lines for b in lines if once[a] >= 0 and once[b] >= 0)
    assert "Session opened for user <*>" in {r.template for r in templates.values() if r.source == "s1"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    store = S.LeaderStore(spark, str(tmp_path / "s"))
    state = lambda: sorted(map(tuple, store.templates().collect()))
    store.step(frame(spark, LINES[:8]), 0)
    store.step(frame(spark, LINES[8:]), 1)
    before = state()
    store.step(frame(spark, LINES[8:]), 1)
    assert state() == before
    store.step(frame(spark, []), 2)
    assert state() == before


def test_stores_merge(spark, tmp_path):
    a, b = (S.LeaderStore(spark, str(tmp_path / x)) for x in "ab")
    a.step(frame(spark, LINES[:12]), 0)
    b.step(frame(spark, LINES[6:]), 0)
    own = {r.template_id: r.leader for r in a.leaders().collect()}
    ids = {r.other_id: r.template_id for r in S.absorb(a, b, 1).collect()}
    assert set(ids) == {r.template_id for r in b.leaders().collect()}
    assert own.items() <= {r.template_id: r.leader for r in a.leaders().collect()}.items()
    blank = 2
    assert sum(r.n for r in a.templates().collect()) == 12 + len(LINES) - 6 - blank - sum(1 for r in LINES[:12] if not (r[2] or "").strip())


def test_stream(spark, tmp_path):
    for part in (LINES[:7], LINES[7:12]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = S.stream_mined(stream(), str(tmp_path / "run"))
    before = {r.template_id: r.leader for r in store.leaders().collect()}
    frame(spark, LINES[12:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = S.stream_mined(stream(), str(tmp_path / "run"))
    assert store.lines().count() == len(LINES)
    assert before.items() <= {r.template_id: r.leader for r in store.leaders().collect()}.items()
