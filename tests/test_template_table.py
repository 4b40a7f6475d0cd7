"""Samples of templates are found by digest: the template text is shuffled for the counts only."""

from emberlog.operators import profile as P

ROWS = [(i, "a", "hot line", f"hot {i}") for i in range(300)] + [(900, "a", "rare", "r"), (901, "b", "rare", "q"), (902, None, "rare", "n"), (903, "b", None, "m")]


def table(spark):
    return P.template_table(spark.createDataFrame(ROWS, "log_id long, source string, template string, content string").repartition(16))


def test_counts_and_first_samples(spark):
    got = {(r["source"], r["template"]): (r["n"], r["samples"]) for r in table(spark).collect()}
    assert got == {("a", "hot line"): (300, ["hot 0", "hot 1", "hot 2"]), ("a", "rare"): (1, ["r"]), ("b", "rare"): (1, ["q"]),
                   (None, "rare"): (1, ["n"]), ("b", None): (1, ["m"])}


def test_texts_of_templates_are_not_shuffled_for_samples(spark):
    plan = table(spark)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    # one sort and shuffle of the rows, which go by their digest
    assert not [line for line in dealt if "template#" in line or "_part#" in line]
    assert plan.count("WindowGroupLimit") >= 2  # one of them before the shuffle
