"""What plans of the quality mart, reconcile checks and replays read, and that they still find the same."""

from pyspark.sql import functions as F

from sparkgrain import catalog
from sparkgrain.operators import audits as A
from sparkgrain.plans.guard import check
from sparkgrain.plans.spec import parse_texts

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_deduplicated_once_a_result(spark):
    """The counts read the evaluated rows once; nothing is sorted before its shuffle; the check needs no join."""
    plan = optimized(catalog.QUERIES["quality_mart_reconcile"](spark, SF))
    assert plan.count("Window [") == 2 and "WindowGroupLimit" not in plan
    assert "FullOuter" not in plan


def test_two_aggregates_are_reconciled(spark):
    """Null keys meet once, a missing side is null (a count, too), a tolerance is met at its bound."""
    side = "spec_version: 1\nentities:\n" + "".join(f"  {e}: {{grain: a row, key: [id], fields: {{id: {{type: int}}, k: {{type: string}}, v: {{type: 'decimal(10,2)'}}}}}}\n" for e in "ab")
    m = "mapping_version: 1\nsource: {0}\ntarget: {0}\nkey: {{id: {{from: $.id}}}}\nfields: {{k: {{from: $.k}}, v: {{from: $.v}}}}\n"
    p = check(parse_texts({"e": side, "ma": m.format("a"), "mb": m.format("b")}))
    frame = lambda *rows: spark.createDataFrame(rows, "id bigint, k string, v string").withColumn("v", F.col("v").cast("decimal(10,2)"))
    a = frame((1, "x", "1"), (2, "x", "2"), (3, None, "4"), (4, None, "1"), (5, "left", "1"), (6, "none", None))
    b = frame((1, "x", "2.5"), (2, None, "5.51"), (3, "right", "7"), (4, "none", None), (5, "x", None))
    found = lambda agg: A.reconcile(p, {"name": "c", "left": f"{agg}(a.v) by k", "right": f"{agg}(b.v) by k", "tolerance": "0.5"}, {"a": a, "b": b})
    text = lambda df: {r.k: tuple(None if x is None else f"{float(x):g}" for x in (r.left_value, r.right_value)) + (r.agrees,) for r in df.collect()}
    sums, counts = found("sum"), found("count")
    assert text(sums) == {"x": ("3", "2.5", True), None: ("5", "5.51", False), "left": ("1", None, False), "right": (None, "7", False), "none": (None, None, True)}
    assert text(counts) == {"x": ("2", "1", False), None: ("2", "1", False), "left": ("1", None, False), "right": (None, "1", False), "none": ("0", "0", True)}
    assert sums.count() == counts.count() == 5 and "Join" not in optimized(sums)


def test_a_replay_evaluates_events_and_payloads_once(spark):
    """What follows from the two pipelines reads their stored rows, neither the landed table nor the payloads."""
    for name in ("quality_mart_after_replay", "replay_rejects", "replay_merge"):
        df = catalog.QUERIES[name](spark, SF)
        assert not [f for f in df.inputFiles() if "/events.parquet" in f]
        assert "get_json_object" not in optimized(df) and "WindowGroupLimit" not in optimized(df)


def test_stored_rows_keep_what_rejects_need(spark, folder):
    """Payloads of diverted rows alone are written; rejects and kept rows are those of the lazy pipeline."""
    from sparkgrain.operators import rejects as J
    from sparkgrain.plans import retail
    from sparkgrain.plans.engine import stored
    from sparkgrain.sources.store import Store

    lazy = retail.frames(spark, SF).pipeline("event")
    held = stored(Store(spark, folder), "event__run", lazy)
    assert held.evaluated.where("_raw is not null and not _diverted").isEmpty() and held.diverted.where("_raw is null").isEmpty()
    for a, b in ((lazy.kept, held.kept), (J.reject_rows(lazy, "events"), J.reject_rows(held, "events"))):
        assert a.columns == b.columns and a.count() == b.count() > 0
        assert a.exceptAll(b).isEmpty()
