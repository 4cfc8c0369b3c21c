from pyspark.sql import functions as F

from causalgraph.operators import centrality as A
from causalgraph.operators import structure as L
from causalgraph.sources import documents as SRC

from .fixtures import build

TEXT = """{"feedbackLoops": [
 {"id": "l1", "name": "one", "type": "reinforcing", "edgeIds": ["e1", "e2"], "moduleIds": ["M"], "loopTimescale": "days",
  "tippingPoint": {"biomarker": "b", "threshold": ">2", "timescale": "years", "interpretation": "i", "interventionWindow": "early"}},
 {"id": "l2", "type": "balancing", "edgeIds": ["e2"]}, {"id": "l3", "type": "balancing"}]}"""


def read(spark, text):
    return SRC.from_loops(spark.createDataFrame([(text,)], "value string").select(F.from_json("value", SRC.LOOPS).alias("d")).select("d.*"))


def test_curated_loops(spark):
    loops = read(spark, TEXT)
    got = {r.id: r for r in loops.collect()}
    one, two = got["l1"], got["l2"]
    assert (one.edge_ids, one.tipping_biomarker, one.tipping_threshold, one.intervention_window, one.loop_timescale) == (["e1", "e2"], "b", ">2", "early", "days")
    assert (two.tipping_biomarker, two.intervention_window, two.module_ids, got["l3"].edge_ids) == (None, None, [], [])
    g = build(spark, "a:M b:M c:M", "a>b:L1 b>c:L1")
    assert sorted(r.id for r in L.loops_by_node(loops, g.edges, "a").collect()) == ["l1"]
    stats = {r.value: r.n for r in A.framework_stats(g, loops).collect() if r.kind == "loop"}
    assert stats == {"reinforcing": 1, "balancing": 2}


def test_no_loops(spark):
    assert read(spark, "{}").count() == 0 and read(spark, '{"feedbackLoops": []}').count() == 0
