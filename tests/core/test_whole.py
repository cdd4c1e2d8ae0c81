"""The reference's operators over whole tables: no curve stops early, no row or feature is left out."""

from tests.core.test_queries import SF
from trackloom.plans import QUERIES


def test_curves_do_not_stop_early(spark):
    for name in ("msd_pairs", "msd_by_well", "msd_by_zone", "msd_by_well_whole"):
        assert QUERIES[name](spark, SF).agg({"tau": "max"}).first()[0] > 10
    assert QUERIES["msd_models"](spark, SF).agg({"n": "max"}).first()[0] > 10


def test_metrics_of_every_window(spark):
    rows = QUERIES["forecast_metrics"](spark, SF)
    assert rows.where("mape >= 1000").count() > 0 and rows.count() == QUERIES["forecast_metrics_whole"](spark, SF).count()


def test_every_feature(spark):
    for name in ("fit_nonlinear_family", "impute", "impute_log"):
        assert QUERIES[name](spark, SF).select("feature").distinct().count() > 1


def test_every_frame(spark):
    assert QUERIES["nearest_within"](spark, SF).agg({"time_index": "max"}).first()[0] > 12
    assert QUERIES["offset_vote"](spark, SF).agg({"votes": "min"}).first()[0] <= 20


def test_greedy_match_of_every_frame(spark):
    """One global pass over all pairs of each frame, in order of distance and ids."""
    from trackloom.plans.views import frame

    tracks = [r for r in frame(spark, SF, "v_tracks").select("experiment", "time_index", "parent", "x_pos", "y_pos").collect() if r.x_pos is not None and r.y_pos is not None]
    frames = {}
    for r in tracks:
        frames.setdefault((r.experiment, r.time_index), []).append(r)
    want = set()
    for key, found in frames.items():
        pairs = sorted((((b.x_pos + 4 - a.x_pos) ** 2 + (b.y_pos - a.y_pos) ** 2) ** 0.5, a.parent, b.parent) for a in found for b in found)
        left, right = set(), set()
        for d, a, b in pairs:
            if d <= 60 and a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((*key, a, b))
    got = [(r.experiment, r.time_index, r.a, r.b) for r in QUERIES["greedy_match"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(r[1] for r in got) > 6
