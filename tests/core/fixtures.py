"""Small graphs as CausalGraph."""

from causalgraph.graph import CausalGraph

NODE = "id string, label string, category string, subtype string, module_id string, description string, roles array<string>, ord long"
EDGE = "id string, source string, target string, relation string, module_id string, causal_confidence string, pmid string, method_type string, ord long"

GRAPHS = {
    "diamond": ("a:M01 b:M01 c:M02 d:M02", "a>b:L2 a>c:L4 b>d:L3 c>d:L5"),
    "shortcut": ("a:M01 b:M01 c:M02 d:M02", "a>b:L2 b>c:L4 a>c:L6 c>d:L3"),
    "pathway": ("upstream1:M01 upstream2:M01 target:M02 downstream1:M02 downstream2:M03 sidenode:M03 isolated:M04", "upstream1>upstream2:L2 upstream2>target:L3 target>downstream1:L1 downstream1>downstream2:L4:decreases sidenode>target:L5 isolated>sidenode:L7"),
    "triangle": ("a:M b:M c:M", "a>b:L7 b>c:L7 c>a:L7"),
    "balancing": ("a:M b:M", "a>b:L7 b>a:L7:decreases"),
    "islands": ("a:M01 b:M01 c:M02 d:M02", "a>b:L7 c>d:L7"),
    "cross": ("a:M01 b:M02", "a>b:L3"),
    "bridge": ("a:M b:M c:M", "a>b:L7 b>c:L7"),
    "six": ("a:M01 b:M01 c:M02 d:M02 e:M03 f:M03", "a>b:L7 c>d:L7 e>f:L7 b>c:L7"),
}


def build(spark, nodes: str, edges: str, **options) -> CausalGraph:
    ns = [(n.split(":")[0], n.split(":")[0].upper(), "STOCK", "", n.split(":")[1], "", [], i) for i, n in enumerate(nodes.split())]
    es = []
    for i, e in enumerate(edges.split()):
        ends, level, *rel = e.split(":")
        s, t = ends.split(">")
        es.append((f"e{i + 1}", s, t, rel[0] if rel else "increases", "M", level, None, None, i))
    return CausalGraph(spark.createDataFrame(ns, NODE), spark.createDataFrame(es, EDGE), **options)


def graph(spark, name: str) -> CausalGraph:
    return build(spark, *GRAPHS[name])
