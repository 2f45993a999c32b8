"""Equal scores are ties, whatever order their parts were summed in."""

from fractions import Fraction

from pyspark.sql import functions as F

from turnweave.operators import matching

GROUP = "rule_id string, dialogue_id string, a_turn int, a_seq int, window_ord int, decisive boolean, verdict string, score double, rule_type string, window string, hit_group double, review_group double"


def _noisy_pair():
    """(decided, support) of two windows, in parts of 128, whose scores are equal and of which the noise of floats puts the second first."""
    by_score = {}
    for d in range(64, 128):
        for s in range(128):
            by_score.setdefault(Fraction(8, 10) * d + Fraction(2, 10) * s, []).append((d, s))
    value = lambda p: 0.80 * (p[0] / 128) + 0.20 * (p[1] / 128)
    return next((a, b) for pairs in by_score.values() for a in pairs for b in pairs if value(a) < value(b))


def test_the_first_of_equal_windows_is_the_best_one(spark):
    rows = [("r", "d", turn, 0, 0, decisive, "hit", score / 128, "default", "w", 0.46, 0.22) for turn, pair in enumerate(_noisy_pair()) for decisive, score in zip((True, False), pair)]
    groups = spark.createDataFrame(rows, GROUP)
    assert [r.turn_index for r in matching.best_matches(matching.settle(groups, places=12)).collect()] == [0]
    assert [r.a_turn for r in matching.candidate_audit(matching.settle(groups, places=12), 1).collect()] == [0]


def test_settled_events_have_scores_without_noise(spark):
    from turnweave.plans import queries

    assert queries._settled(spark, "/root/testdata/sf0.01").where(F.col("score") != F.round("score", 12)).count() == 0


def test_settled_turns_have_scores_without_noise(spark):
    from turnweave.plans import queries_whole

    assert queries_whole._settled(spark, "/root/testdata/sf0.01").where(F.col("score") != F.round("score", 12)).count() == 0


def test_the_order_of_elements_decides_no_flat_score(spark):
    from itertools import permutations

    from turnweave.operators import requirements

    # 5.7 of 12.8 is 0.4453125: half of the sixth place, and each order of the rows is a span of its own.
    parts = [(3.0, True), (2.0, True), (0.1, True), (0.6, True), (7.0, False), (0.1, False)]
    rows = [("r", n, w, False, hit, 0) for n, order in enumerate(permutations(parts)) for w, hit in order]
    spans = spark.createDataFrame(rows, "rule_id string, span_id int, weight double, is_role boolean, is_hit boolean, n_pool_hits int").coalesce(1)
    found = requirements.flat_score(spans, 0.4453125, 0.22).select("score", F.round("score", 6).alias("shown"), "verdict").distinct().collect()
    assert [tuple(r) for r in found] == [(0.4453125, 0.445313, "hit")]
