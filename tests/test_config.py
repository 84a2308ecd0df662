"""Configurations, the command line, batches and sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import __main__ as cli
from loomgraph import config as C
from loomgraph.graph import Graph
from loomgraph.operators import gnn
from loomgraph.operators.sampling import Hop
from loomgraph.sources import delimited, sinks


def test_round_trip_and_unknown_names():
    c = C.generated(["a.csv"], "out", dim=8)
    assert C.load(C.dump(c)) == c
    for bad in ('{"tusk": 1}', '{"settings": {"dims": 3}}', '{"source": 4}', '{"stages": [[{"kind": "gcn", "dim": 3}]]}'):
        with pytest.raises(ValueError):
            C.load(bad)


@pytest.mark.parametrize("bad", [
    {"task": "x"}, {"settings": {"decoder": "x"}}, {"settings": {"loss": "x"}}, {"settings": {"decoder": "complex", "dim": 7}}, {"settings": {"dim": 0}}, {"source": {"fractions": [0.9, 0.2]}},
    {"optimizers": [{"kind": "x"}]}, {"optimizers": [{}, {}]}, {"optimizers": [{"targets": ["0.0"]}, {"targets": ["0.0"]}]},
    {"stages": [[{"kind": "gcn", "input_dim": 4, "output_dim": 64}]]}, {"stages": [[{"kind": "embedding", "output_dim": 5}], [{"kind": "gcn", "input_dim": 4, "output_dim": 64}]]},
    {"stages": [[{"kind": "embedding", "output_dim": 5}]]}, {"stages": [[{"kind": "embedding", "output_dim": 64}, {"kind": "feature", "output_dim": 4}], [{"kind": "concat", "output_dim": 64}]]},
    {"stages": [[{"kind": "embedding"}]]}, {"stages": [[{"kind": "embedding", "output_dim": 64}]], "optimizers": [{"targets": ["nodes"]}]},
])
def test_what_does_not_hold_is_refused(bad):
    with pytest.raises(ValueError):
        C.load(json.dumps(bad))


def test_parameters_and_groups():
    c = C.load(json.dumps({
        "settings": {"dim": 8}, "stages": [[{"kind": "embedding", "output_dim": 6}, {"kind": "feature", "output_dim": 4}], [{"kind": "gat", "input_dim": 10, "output_dim": 4, "heads": 2, "average": False, "bias": True}]],
        "optimizers": [{"kind": "adam", "targets": ["1.0"]}, {"kind": "sgd"}],
    }))
    assert C.parameters(c, 5, 3) == {"nodes": (5, 8), "rels": (3, 8), "inverse": (3, 8), "1.0.weight": (2, 4, 10), "1.0.left": (2, 4), "1.0.right": (2, 4), "1.0.bias": (4,)}
    groups = C.optimizer_of(c.optimizers, ["0.0", "1.0"])
    assert groups["1.0"].kind == "adam" and groups["0.0"].kind == "sgd"


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "e.tsv").write_text("".join(f"a{s}\tr{s % 2}\ta{(s * 3 + d) % 15}\n" for s, d in rng.integers(0, 15, (200, 2))))
    path = str(tmp_path / "c.json")
    cli.main(["generate", path, "--paths", str(tmp_path / "e.tsv"), "--out", str(tmp_path / "out")])
    c = json.loads((tmp_path / "c.json").read_text())
    c["settings"] |= {"dim": 4, "batch_edges": 100, "negatives": 5}
    c["source"]["fractions"] = [0.8, 0.1, 0.1]
    (tmp_path / "c.json").write_text(json.dumps(c))
    for command in ("prepare", "stats", "train", "evaluate", "export"):
        cli.main([command, path])
    found = {r.metric: float(r.value) for r in spark.read.option("header", True).csv(str(tmp_path / "out/metrics")).collect()}
    assert set(found) == {"n", "MRR", "MR", "HITS@1", "HITS@10"} and 0 < found["MRR"] <= 1 and found["n"] > 0
    assert spark.read.parquet(str(tmp_path / "out/model/nodes")).count() == spark.read.parquet(str(tmp_path / "out/vectors")).count() == 15


def test_batches_with_neighbourhoods(spark):
    labelled = spark.createDataFrame([(i, f"a{i % 7}", "r", f"b{i % 5}") for i in range(30)], "edge_id bigint, src string, rel string, dst string")
    g = Graph.prepare(labelled, (1.0, 0.0, 0.0))
    seen = []
    for b in g.batches(12, negatives=3, hops=[Hop("uniform", 2)]):
        edges = [r.edge_id for r in b.edges.collect()]
        nodes = {r.node for r in b.nodes.filter("hop = 0").collect()}
        assert {x for r in b.edges.collect() for x in (r.src, r.dst)} | {r.node for r in b.negatives.collect()} == nodes
        assert b.negatives.count() == 6 and b.links.count() > 0
        seen.append(edges)
    assert [len(x) for x in seen] == [12, 12, 6] and sorted(sum(seen, [])) == list(range(30))


def test_headers_of_any_length_read_alike(spark, tmp_path):
    body = 'a,"x,y",b\n"c ""d""",r,e\n'
    for n in (0, 1, 3):
        (tmp_path / f"h{n}.csv").write_text("h,h,h\n" * n + body)
    read = lambda n: sorted(tuple(r) for r in delimited.read_delimited(spark, str(tmp_path / f"h{n}.csv"), {"src_column": 0, "edge_type_column": 1, "dst_column": 2}, ",", n).collect())
    assert read(0) == read(1) == read(3) and ("a", "x,y", "b") in read(3)


def test_attention_dropout(spark):
    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(6)]) for i in range(40)], "id bigint, vec array<double>")
    pairs = spark.createDataFrame([(i, int(j)) for i in range(40) for j in rng.choice(40, 10, False)], "center bigint, nbr bigint")
    heads = [(rng.standard_normal((3, 6)), rng.standard_normal(3), rng.standard_normal(3))]
    vec = lambda **how: np.array([r.vec for r in gnn.gat(nodes, pairs, heads, **how).orderBy("id").collect()])
    plain = vec()
    for how in ({"attention_dropout": 0.5}, {"input_dropout": 0.5}):
        assert (vec(**how, seed=1) == vec(**how, seed=1)).all() and not np.allclose(vec(**how, seed=1), plain)
    many = np.mean([vec(attention_dropout=0.5, seed=k) for k in range(6)], axis=0)
    assert np.abs(many - plain).mean() < np.abs(vec(attention_dropout=0.5, seed=1) - plain).mean()


def test_metrics_file(spark, tmp_path):
    ranks = spark.createDataFrame([(1,), (4,)], "rank bigint")
    sinks.write_metrics(ranks, {"MRR": F.avg(1 / F.col("rank"))}, str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()} == {("n", "2.0"), ("MRR", "0.625")}
