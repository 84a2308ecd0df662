"""Scores, ranks, metrics, losses, graph network layers and optimizer steps."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import digest_sql, draw, draw_sql, unit_sql
from loomgraph.operators import gnn, optim, sampling, scoring, train
from loomgraph.operators.order import hash_positions, with_chunks
from loomgraph.plans.views import FACTS, HUB_EDGES, LINES, VECTOR_EDGES, VECTORS, facts, hub_edges, lines, node_vectors, vector_edges
from loomgraph.session import table, written

DIM, OUT, CHUNKS, PER_CHUNK = 64, 8, 10, 16
LIMIT = 0.125


def _nodes(spark, d):
    return node_vectors(spark, d).select("id", "vec")


def _rels(spark, d, shift=0):
    """The vectors of the first nodes serve as those of relations."""
    return _nodes(spark, d).select((F.col("id") - shift).alias("rel"), "vec")


def _two_rels(spark, d):
    return facts(spark, d).select("rel").distinct().join(_rels(spark, d), "rel")


def _rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _exploded(df, key="id", vec="vec"):
    """(id, pos, val) of vectors."""
    return df.select(key, F.posexplode(vec).alias("pos", "val")).select(key, "pos", (F.round("val", 6) + 0.0).alias("val"))


def _score(decoder, spark, d):
    return _rounded(scoring.edge_scores(lines(spark, d), _nodes(spark, d), _rels(spark, d), decoder).select("edge_id", "score"), "score")


def score_inverse(spark, d):
    return _rounded(scoring.inverse_scores(lines(spark, d), _nodes(spark, d), _rels(spark, d, 2), "complex").select("edge_id", "score"), "score")


def score_relations(spark, d):
    return _rounded(scoring.relation_scores(facts(spark, d), _nodes(spark, d), _two_rels(spark, d), "distmult"), "score")


def relation_operators(spark, d):
    g = scoring.gathered(lines(spark, d), _nodes(spark, d), _rels(spark, d))
    c = V.complex_product(F.col("vs"), F.col("vr"))
    out = g.select("edge_id", V.total(V.hadamard(F.col("vs"), F.col("vr"))).alias("had"), V.total(V.translate(F.col("vs"), F.col("vr"))).alias("trans"), c[0].alias("re0"), c[DIM // 2].alias("im0"))
    return _rounded(out, "had", "trans", "re0", "im0")


def activations(spark, d):
    n = _nodes(spark, d)
    return _rounded(n.select("id", V.total(V.relu(F.col("vec"))).alias("relu"), V.total(V.sigmoid(F.col("vec"))).alias("sigmoid"), V.total(F.col("vec")).alias("none")), "relu", "sigmoid", "none")


def _chunked(spark, d):
    e = facts(spark, d)
    return with_chunks(hash_positions(e, 60, ["edge_id"]), CHUNKS, e.count())


def _negatives(spark, d):
    return sampling.uniform_negatives(spark, CHUNKS, PER_CHUNK, table(spark, d, "embeddings").count(), 61)


def _pos_neg(spark, d, decoder="distmult"):
    chunked = _chunked(spark, d)
    pos = scoring.edge_scores(chunked, _nodes(spark, d), _rels(spark, d), decoder).select("edge_id", "score")
    return pos, scoring.chunk_scores(chunked, _negatives(spark, d), _nodes(spark, d), _rels(spark, d), decoder)


def score_chunk_negatives(spark, d):
    return _rounded(_pos_neg(spark, d)[1].select("edge_id", "neg_id", "score"), "score")


def score_masked(spark, d):
    matches = sampling.local_matches(_chunked(spark, d), _negatives(spark, d), facts(spark, d))
    return _rounded(scoring.masked(_pos_neg(spark, d)[1].select("edge_id", "neg_id", "score"), matches), "score")


def _scored(spark, d, edges=None, rels=None, decoder="distmult"):
    return scoring.chunk_rows(_chunked(spark, d) if edges is None else edges, _negatives(spark, d), _nodes(spark, d), _rels(spark, d) if rels is None else rels, decoder, DIM)


def rank_chunks(spark, d):
    return scoring.chunk_ranks(_scored(spark, d))


def score_chunk_negatives_src(spark, d):
    """The negatives of a chunk in place of src, under inverse relations."""
    rows = _scored(spark, d, scoring.swapped(_chunked(spark, d)), _rels(spark, d, 2), "complex")
    return _rounded(rows.select("edge_id", F.posexplode("negs").alias("neg_id", "score")), "score")


def rank_unfiltered(spark, d):
    return scoring.all_node_ranks(facts(spark, d), _nodes(spark, d), _rels(spark, d), "distmult", DIM)


def rank_filtered(spark, d):
    e = facts(spark, d)
    return scoring.all_node_ranks(e, _nodes(spark, d), _rels(spark, d), "distmult", DIM, known=e)


def _metric(name, spark, d):
    return rank_filtered(spark, d).agg(F.round(scoring.metric(name), 6).alias("value"))


def evaluate_links(spark, d):
    r = scoring.all_node_ranks(facts(spark, d), _nodes(spark, d), _rels(spark, d), "complex", DIM, known=facts(spark, d))
    return r.agg(F.count(F.lit(1)).alias("n"), *[F.round(scoring.metric(m), 6).alias(m.lower().replace("@", "_")) for m in ("MRR", "MR", "HITS@1", "HITS@10")])


def evaluate_links_both(spark, d):
    """Two ranks an edge, src corrupted under inverse relations, filtered by all edges."""
    e = facts(spark, d)
    r = scoring.both_side_ranks(e, _nodes(spark, d), _rels(spark, d), _rels(spark, d, 2), "complex", DIM, known=e)
    return r.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *[F.round(scoring.metric(m), 6).alias(m.lower().replace("@", "_")) for m in ("MRR", "MR", "HITS@1", "HITS@10")])


def rank_filtered_hub(spark, d):
    """All edges of the edge list, whose hub holds a tenth of them, labels folded onto the nodes with vectors."""
    e = hub_edges(spark, d)
    return scoring.all_node_ranks(e, _nodes(spark, d), _rels(spark, d), "distmult", DIM, known=e)


def rank_lines(spark, d):
    """Ranks of all edges of vector_edges among 16 negatives a chunk, in one row an edge."""
    e = lines(spark, d)
    chunked = with_chunks(hash_positions(e, 62, ["edge_id"]), CHUNKS, e.count())
    return scoring.chunk_ranks(_scored(spark, d, chunked))


def _logits(spark, d):
    n = node_vectors(spark, d)
    centroids = n.groupBy("label").agg(V.sum_of_vectors("vec", DIM).alias("c"), F.count(F.lit(1)).alias("k"))
    all_c = centroids.agg(F.array_sort(F.collect_list(F.struct("label", V.scale(F.col("c"), F.lit(1.0) / F.col("k")).alias("c")))).alias("cs"))  # one entry a class
    return n.join(F.broadcast(all_c)).select("id", F.col("label").alias("y_true"), F.transform("cs", lambda c: F.round(V.dot(F.col("vec"), c["c"]) * 10, 9)).alias("logits"))


def predicted_classes(spark, d):
    return _logits(spark, d).select("id", "y_true", V.argmax(F.col("logits")).alias("y_pred"))


def accuracy(spark, d):
    return predicted_classes(spark, d).agg(F.round(scoring.accuracy(), 6).alias("accuracy"))


def loss_classes(spark, d):
    return _rounded(scoring.class_loss(_logits(spark, d)), "loss_sum", "loss_mean")


def _loss(kind, spark, d):
    return _rounded(scoring.link_loss(kind, _scored(spark, d)), "loss_sum", "loss_mean")


def norm_penalty(spark, d):
    return _rounded(scoring.norm_penalty(lines(spark, d), _nodes(spark, d), 2, 0.01, DIM), "penalty")


def _pairs(spark, d):
    return gnn.neighbour_pairs(vector_edges(spark, d))


def _segment(how, spark, d):
    return _exploded(gnn.segment(_pairs(spark, d), _nodes(spark, d), DIM, how).select(F.col("center").alias("id"), F.col("agg").alias("vec")))


def _w(seed, rows=OUT, cols=DIM):
    return gnn.hash_matrix(seed, rows, cols, LIMIT)


def sage_mean_layer(spark, d):
    return _exploded(gnn.sage_mean(_nodes(spark, d), _pairs(spark, d), _w("a"), _w("b")))


def sage_gcn_layer(spark, d):
    return _exploded(gnn.sage_gcn(_nodes(spark, d), _pairs(spark, d), _w("a")))


def gcn_layer(spark, d):
    return _exploded(gnn.gcn(_nodes(spark, d), _pairs(spark, d), _w("a"), _w("bias", OUT, 1)[:, 0]))


def rgcn_layer(spark, d):
    return _exploded(gnn.rgcn(_nodes(spark, d), vector_edges(spark, d), [_w("r0"), _w("r1"), _w("r2")], _w("a")))


def attention_softmax(spark, d):
    """Per node: the weight of itself, and the sum of squares of the weights of its neighbourhood."""
    n = _nodes(spark, d)
    links = gnn.with_self(n, _pairs(spark, d))
    v = links.join(n.select(F.col("id").alias("center"), F.col("vec").alias("a")), "center").join(n.select(F.col("id").alias("nbr"), F.col("vec").alias("b")), "nbr")
    alpha = gnn.attention_softmax(v.select("center", "nbr", (V.dot(F.col("a"), F.col("b")) * 4).alias("logit")))
    out = alpha.groupBy("center").agg(F.max(F.when(F.col("center") == F.col("nbr"), F.col("alpha"))).alias("own"), F.sum(F.col("alpha") * F.col("alpha")).alias("squares"))
    return _rounded(out, "own", "squares")


_HEADS = [("h0", "l0", "r0x"), ("h1", "l1", "r1x")]


def gat_layer(spark, d):
    heads = [(_w(w, 4), _w(a, 1, 4)[0] * 80, _w(b, 1, 4)[0] * 80) for w, a, b in _HEADS]
    return _exploded(gnn.gat(_nodes(spark, d), _pairs(spark, d), heads))


def encoder(spark, d):
    """Features cut to 32 columns, put beside the other 32, a linear layer, and two layers of mean aggregation with activation."""
    n = _nodes(spark, d)
    both = gnn.linear_layer(_w("lin"), gnn.slice_layer(n, 32, 32), gnn.slice_layer(n, 0, 32))
    layers = [lambda x, p: gnn.post(gnn.sage_gcn(x, p, _w("e1", OUT, OUT) * 10), np.full(OUT, 0.01), "relu"), lambda x, p: gnn.post(gnn.sage_gcn(x, p, _w("e2", 4, OUT) * 10), activation="sigmoid")]
    return _exploded(gnn.encode(both, layers, lambda k: _pairs(spark, d)))


def _grads(spark, d):
    return optim.distmult_mse_gradients(lines(spark, d), _nodes(spark, d), _rels(spark, d))


def summed_gradients(spark, d):
    return _exploded(optim.summed(_grads(spark, d), DIM).select("id", F.col("grad").alias("vec")))


def _with_grads(spark, d):
    return _nodes(spark, d).join(optim.summed(_grads(spark, d), DIM), "id")


def sgd_step(spark, d):
    return _exploded(_with_grads(spark, d).select("id", optim.sgd(F.col("vec"), F.col("grad"), 0.1).alias("vec")))


def adagrad_step(spark, d):
    nodes = _nodes(spark, d).withColumn("state", F.array_repeat(F.lit(0.5), DIM))
    return _exploded(optim.sparse_adagrad(nodes, _grads(spark, d), 0.1, DIM).select("id", "vec"))


def adagrad_decayed_step(spark, d):
    p, _ = optim.adagrad(F.col("vec"), F.col("grad"), F.array_repeat(F.lit(0.5), DIM), 0.1, 1e-10, 3, 0.1, 0.01)
    return _exploded(_with_grads(spark, d).select("id", p.alias("vec")))


def adam_step(spark, d):
    m, v = F.array_repeat(F.lit(0.01), DIM), F.array_repeat(F.lit(0.02), DIM)
    p = optim.adam(F.col("vec"), F.col("grad"), m, v, 0.1, 3, amsgrad=F.array_repeat(F.lit(0.03), DIM))[0]
    return _exploded(_with_grads(spark, d).select("id", p.alias("vec")))


def update_embeddings(spark, d):
    return _exploded(optim.add_updates(_nodes(spark, d), _grads(spark, d), DIM))


def put_embeddings(spark, d):
    n = _nodes(spark, d)
    new = facts(spark, d).filter("rel = 1").select(F.col("src").alias("id")).distinct().join(n, "id").select("id", V.scale(F.col("vec"), 2.0).alias("vec"))
    return _exploded(optim.put_rows(n, new))


def init_embeddings(spark, d):
    out = optim.initial_vectors(table(spark, d, "part").select(F.col("p_partkey").alias("id")), 4, optim.glorot_limit(2000, 4), 70)
    return _exploded(out)


def _gradient(decoder, loss, spark, d):
    """(kind, id, pos, val): one batch of all edges of lines, with STEP_NEGATIVES negatives in place of dst."""
    negatives = spark.range(STEP_NEGATIVES).select((draw(63, "id") % table(spark, d, "embeddings").count()).alias("node"))
    g = train.link_gradients(lines(spark, d), negatives, _nodes(spark, d), _rels(spark, d), decoder, loss, DIM)
    total = g.groupBy("kind", "id").agg(V.sum_of_vectors("grad", DIM).alias("grad"))
    return total.select("kind", "id", F.posexplode("grad").alias("pos", "val")).select("kind", "id", "pos", (F.round("val", 5) + 0.0).alias("val"))


def class_gradient(spark, d):
    return _exploded(train.class_gradients(_logits(spark, d), 0).select("id", F.col("grad").alias("vec")))


def adam_decayed_step(spark, d):
    m, v = F.array_repeat(F.lit(0.01), DIM), F.array_repeat(F.lit(0.02), DIM)
    p = optim.adam(F.col("vec"), F.col("grad"), m, v, 0.1, 2, weight_decay=0.01)[0]
    return _exploded(_with_grads(spark, d).select("id", p.alias("vec")))


def train_link_prediction(spark, d):
    """Two epochs over nine tenths of lines, then both ranks of the others; sums of floats differ in their last digits between runs, so there is no SQL for it."""
    e = written(lines(spark, d), "lines")
    n = e.count()
    held_out = draw(64, "edge_id") % 10 == 0
    rels = _two_rels(spark, d).unionByName(_rels(spark, d).filter("rel = 2"))
    zero = F.array_repeat(F.lit(0.0), DIM)
    both = [rels.select(F.lit(k).alias("kind"), F.col("rel").cast("bigint").alias("id"), "vec", zero.alias("state")) for k in ("rel", "inverse")]
    model = train.Model(_nodes(spark, d).withColumn("state", zero), both[0].unionByName(both[1]))
    settings = train.Settings(batch_edges=-(-n // 2), negatives=50)
    model, _ = train.train(e.filter(~held_out), model, settings, 2)
    r = scoring.both_side_ranks(e.filter(held_out), model.node_vectors, model.rel_vectors(), model.rel_vectors("inverse"), "distmult", DIM, e)
    return r.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(scoring.mrr(), 3).alias("mrr"), F.round(scoring.hits(10), 3).alias("hits_10"))


def train_classifier(spark, d):
    """Mean loss before each of three steps of a linear classifier on all labelled vectors."""
    v = node_vectors(spark, d).select("vec", F.col("label").alias("y_true"))
    n = v.agg(F.max("y_true")).first()[0] + 1
    _, _, losses = train.train_classes(v, np.zeros((n, DIM)), np.zeros(n), 1.0, 3)
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(losses)], "step int, loss double")


STEP_NEGATIVES = 4
STEPS = (("distmult", "softmax_ce"), ("distmult", "ranking"), ("distmult", "bce_logits"), ("distmult", "mse"), ("distmult", "softplus"), ("complex", "softmax_ce"), ("transe", "softmax_ce"))
LOSSES = ("softmax_ce", "cross_entropy", "ranking", "bce_sigmoid", "bce_logits", "mse", "softplus")
QUERIES = {
    **{f"score_{k}": partial(_score, k) for k in ("distmult", "complex", "transe", "cosine", "l2")},
    **{f.__name__: f for f in (score_inverse, score_relations, relation_operators, activations, score_chunk_negatives, score_masked, rank_chunks, rank_unfiltered, rank_filtered, evaluate_links, evaluate_links_both, rank_filtered_hub, rank_lines, score_chunk_negatives_src)},
    "mrr": partial(_metric, "MRR"), "mean_rank": partial(_metric, "MR"), "hits_at_k": partial(_metric, "HITS@10"),
    **{f.__name__: f for f in (predicted_classes, accuracy, loss_classes)},
    **{f"loss_{k}": partial(_loss, k) for k in LOSSES},
    "norm_penalty": norm_penalty,
    **{f"segment_{k}": partial(_segment, k) for k in ("sum", "mean", "max")},
    **{f.__name__: f for f in (
        sage_mean_layer, sage_gcn_layer, gcn_layer, rgcn_layer, attention_softmax, gat_layer, encoder, summed_gradients, sgd_step, adagrad_step, adagrad_decayed_step, adam_step, update_embeddings, put_embeddings, init_embeddings,
        train_link_prediction, train_classifier, class_gradient, adam_decayed_step,
    )},
    **{f"gradient_{a}_{b}": partial(_gradient, a, b) for a, b in STEPS},
}

_N = "(SELECT count(*) FROM embeddings)"
_zip = lambda a, b, e: f"list_transform(list_zip({a}, {b}), lambda x: {e})"
_had = lambda a, b: _zip(a, b, "x[1] * x[2]")
_add = lambda a, b: _zip(a, b, "x[1] + x[2]")
_dot = lambda a, b: f"list_sum({_had(a, b)})"
_dist = lambda a, b: "sqrt(greatest(list_sum(" + _zip(a, b, "(x[1] - x[2]) ** 2") + "), 1e-8))"
_re = lambda a: f"{a}[1:32]"
_im = lambda a: f"{a}[33:64]"


def _cplx(a: str, b: str) -> str:
    return f"list_concat({_zip(_had(_re(a), _re(b)), _had(_im(a), _im(b)), 'x[1] - x[2]')}, {_add(_had(_re(a), _im(b)), _had(_im(a), _re(b)))})"


_SCORES = {
    "distmult": lambda s, r, d: _dot(_had(s, r), d), "complex": lambda s, r, d: _dot(_cplx(s, r), d), "transe": lambda s, r, d: f"-{_dist(_add(s, r), d)}",
    "cosine": lambda s, r, d: f"{_dot(s, d)} / (sqrt({_dot(s, s)}) * sqrt({_dot(d, d)}))", "l2": lambda s, r, d: _dist(s, d),
}
_GATHERED = "fx AS (SELECT edge_id, src, rel, dst, s.vec AS vs, r.vec AS vr, t.vec AS vd FROM f JOIN v s ON s.id = src JOIN v t ON t.id = dst JOIN v r ON r.id = rel)"
_FX, _LX = f"{VECTORS}, {FACTS}, {_GATHERED}", f"{VECTORS}, {LINES}, {_GATHERED}"
_CH = f"fc AS (SELECT *, (row_number() OVER (ORDER BY {digest_sql(60, 'edge_id')}, edge_id) - 1) // ceil(count(*) OVER () / {CHUNKS})::BIGINT AS chunk_id FROM fx)"
_UN = f"un AS (SELECT k // {PER_CHUNK} AS chunk_id, k % {PER_CHUNK} AS neg_id FROM range({CHUNKS * PER_CHUNK}) r(k)), ng AS (SELECT chunk_id, neg_id, {draw_sql(61, 'chunk_id', 'neg_id')} % {_N} AS node FROM un)"
_PN = f"{_FX}, {_CH}, {_UN}, pos AS (SELECT edge_id, {_SCORES['distmult']('vs', 'vr', 'vd')} AS score FROM fc), neg AS (SELECT edge_id, neg_id, node, {_SCORES['distmult']('vs', 'vr', 'v.vec')} AS score FROM fc JOIN ng ON ng.chunk_id = fc.chunk_id JOIN v ON v.id = node)"


def _ranked(decoder: str) -> str:
    return f"""{_FX}, sc AS (SELECT edge_id, src, rel, v.id AS node, round({_SCORES[decoder]("vs", "vr", "v.vec")}, 9) AS n, round({_SCORES[decoder]("vs", "vr", "vd")}, 9) AS p FROM fx CROSS JOIN v),
un AS (SELECT edge_id, 1 + sum((n >= p)::INT)::BIGINT AS rank FROM sc GROUP BY edge_id),
fl AS (SELECT edge_id, 1 + sum((n >= p AND f2.edge IS NULL)::INT)::BIGINT AS rank FROM sc LEFT JOIN (SELECT src, rel, dst, 1 AS edge FROM f) f2 ON f2.src = sc.src AND f2.rel = sc.rel AND f2.dst = node GROUP BY edge_id)"""


def _both_sides() -> str:
    """Ranks as dst and, with ends swapped and inverse relations, as src."""
    parts = []
    for side, near, far, shift in (("dst", "src", "dst", 0), ("src", "dst", "src", 2)):
        parts.append(
            f"q{side} AS (SELECT edge_id, {near} AS near, rel, {_cplx('a.vec', 'r.vec')} AS q, b.vec AS vb FROM f JOIN v a ON a.id = {near} JOIN v b ON b.id = {far} JOIN v r ON r.id = rel + {shift}),"
            f" s{side} AS (SELECT edge_id, near, rel, v.id AS node, round(list_dot_product(q, v.vec), 9) AS n, round(list_dot_product(q, vb), 9) AS p FROM q{side} CROSS JOIN v),"
            f" r{side} AS (SELECT s.edge_id, '{side}' AS side, 1 + sum((n >= p AND k.src IS NULL)::INT)::BIGINT AS rank FROM s{side} s LEFT JOIN f k ON k.{near} = s.near AND k.rel = s.rel AND k.{far} = node GROUP BY s.edge_id)"
        )
    return f"{VECTORS}, {FACTS}, {', '.join(parts)}, bs AS (SELECT * FROM rdst UNION ALL SELECT * FROM rsrc)"


_LOGITS = f"""{VECTORS}, ce AS (SELECT label, pos, avg(vec[pos]) AS c FROM v, range(1, {DIM + 1}) r(pos) GROUP BY 1, 2), cl AS (SELECT label, list(c ORDER BY pos) AS c FROM ce GROUP BY label),
lg AS (SELECT v.id, v.label AS y_true, cl.label AS class, round({_dot("v.vec", "cl.c")} * 10, 9) AS logit FROM v CROSS JOIN cl),
pc AS (SELECT id, any_value(y_true) AS y_true, arg_max(class, (logit, -class)) AS y_pred FROM lg GROUP BY id)"""
_sp = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_ALL = "al AS (SELECT score AS s, 1.0::DOUBLE AS y FROM pos UNION ALL SELECT score, 0.0 FROM neg)"
_CE = "u AS (SELECT edge_id, score FROM pos UNION ALL SELECT edge_id, score FROM neg), lse AS (SELECT edge_id, max(score) AS m FROM u GROUP BY 1), ls AS (SELECT u.edge_id, any_value(m) + ln(sum(exp(score - m))) AS l FROM u JOIN lse ON lse.edge_id = u.edge_id GROUP BY 1), xs AS (SELECT l - score AS x FROM ls JOIN pos ON pos.edge_id = ls.edge_id)"
_LOSS = {
    "softmax_ce": _CE, "cross_entropy": _CE, "ranking": "xs AS (SELECT greatest(neg.score - pos.score + 0.1, 0) AS x FROM neg JOIN pos ON pos.edge_id = neg.edge_id)",
    "bce_sigmoid": f"{_ALL}, xs AS (SELECT {_sp('s')} - s * y AS x FROM al)", "bce_logits": f"{_ALL}, xs AS (SELECT {_sp('s')} - s * y AS x FROM al)",
    "mse": f"{_ALL}, xs AS (SELECT (s - y) ** 2 AS x FROM al)", "softplus": f"{_ALL}, xs AS (SELECT {_sp('(-(2 * y - 1) * s)')} AS x FROM al)",
}
_NB = f"{VECTORS}, {VECTOR_EDGES}, nb AS (SELECT src AS center, dst AS nbr FROM g UNION ALL SELECT dst, src FROM g)"
_POS = f"range(1, {DIM + 1}) r(pos)"
_SEG = f"sg AS (SELECT center, pos, sum(vec[pos]) AS s, count(*) AS n, max(vec[pos]) AS m FROM nb JOIN v ON v.id = nbr, {_POS} GROUP BY center, pos)"
_FULL = f"sn AS (SELECT v.id, r.pos, v.vec[r.pos] AS h, coalesce(sg.s, 0) AS s, coalesce(sg.n, 0) AS n FROM v CROSS JOIN {_POS} LEFT JOIN sg ON sg.center = v.id AND sg.pos = r.pos)"


def _weight(seed: str, i: str, j: str) -> str:
    return f"(({unit_sql(seed, i, j)}) * 2 - 1) * {LIMIT}"


def _mat(name: str, seed: str, rows: int = OUT, cols: int = DIM) -> str:
    return f"{name} AS (SELECT i, j, {_weight(seed, 'i', 'j')} AS w FROM range({rows}) a(i), range({cols}) b(j))"


def _matmul(source: str, value: str, mat: str, scale: str = "1") -> str:
    return f"SELECT id, i AS pos, sum(({value}) * w * {scale}) AS val FROM {source} JOIN {mat} ON j = pos - 1 GROUP BY id, i"


_OUT = "SELECT id, pos, round(val, 6) + 0.0 AS val FROM o"
_GR = f"{_LX}, gr AS (SELECT *, 2 * ({_SCORES['distmult']('vs', 'vr', 'vd')} - 1) AS c FROM fx), ge AS (SELECT src AS id, pos, c * vr[pos] * vd[pos] AS x FROM gr, {_POS} UNION ALL SELECT dst, pos, c * vs[pos] * vr[pos] FROM gr, {_POS}), gs AS (SELECT id, pos, sum(x) AS g FROM ge GROUP BY 1, 2)"
_GV = f"{_GR}, b AS (SELECT gs.id, gs.pos, v.vec[gs.pos] AS p, g FROM gs JOIN v ON v.id = gs.id)"


_CZ = {
    # per component: what the score gives to src, relation and target
    "distmult": ("vr[pos] * t[pos]", "vs[pos] * t[pos]", "vs[pos] * vr[pos]"),
    "complex": tuple(
        f"CASE WHEN pos <= 32 THEN {x}[pos] * {y}[pos] {s1} {x}[pos + 32] * {y}[pos + 32] ELSE {x2}[pos - 32] * {y2}[pos] {s2} {x2}[pos] * {y2}[pos - 32] END"
        for x, y, s1, x2, y2, s2 in (("vr", "t", "+", "vr", "t", "-"), ("vs", "t", "+", "vs", "t", "-"), ("vs", "vr", "-", "vs", "vr", "+"))
    ),
    "transe": ("-(vs[pos] + vr[pos] - t[pos]) / -score", "-(vs[pos] + vr[pos] - t[pos]) / -score", "(vs[pos] + vr[pos] - t[pos]) / -score"),
}
_sig = lambda x: f"(1 / (1 + exp(-({x}))))"
_SLOPE = {
    "softmax_ce": "exp(score - m) / z - y", "ranking": "CASE WHEN y = 1 THEN -(over) ELSE (score - p + 0.1 > 0)::INT END", "bce_logits": f"{_sig('score')} - y",
    "mse": "2 * (score - y)", "softplus": f"CASE WHEN y = 1 THEN -{_sig('-score')} ELSE {_sig('score')} END",
}


def _gradient_sql(decoder: str, loss: str) -> str:
    q, (ds, dr, dt) = _SCORES[decoder]("vs", "vr", "t"), _CZ[decoder]
    return (
        f"WITH {_LX}, ng AS (SELECT k, {draw_sql(63, 'k')} % {_N} AS node FROM range({STEP_NEGATIVES}) r(k)), tg AS (SELECT edge_id, src, rel, dst AS node, vs, vr, vd AS t, 1 AS y FROM fx UNION ALL SELECT edge_id, src, rel, node, vs, vr, v.vec, 0 FROM fx, ng JOIN v ON v.id = node),"
        f" sc AS (SELECT *, {q} AS score FROM tg), w1 AS (SELECT edge_id, max(score) AS m, max(CASE WHEN y = 1 THEN score END) AS p FROM sc GROUP BY 1),"
        " w2 AS (SELECT sc.edge_id, any_value(m) AS m, any_value(p) AS p, sum(exp(score - m)) AS z, sum((y = 0 AND score - p + 0.1 > 0)::INT) AS over FROM sc JOIN w1 ON w1.edge_id = sc.edge_id GROUP BY 1),"
        f" gx AS (SELECT src, rel, node, vs, vr, t, score, {_SLOPE[loss]} AS g FROM sc JOIN w2 ON w2.edge_id = sc.edge_id),"
        f" each AS (SELECT 'node' AS kind, src AS id, pos, g * ({ds}) AS x FROM gx, {_POS} UNION ALL SELECT 'rel', rel, pos, g * ({dr}) FROM gx, {_POS} UNION ALL SELECT 'node', node, pos, g * ({dt}) FROM gx, {_POS})"
        " SELECT kind, id, pos - 1 AS pos, round(sum(x), 5) + 0.0 AS val FROM each GROUP BY kind, id, pos"
    )


def _gat_sql() -> str:
    parts = []
    for k, (w, a, b) in enumerate(_HEADS):
        la = lambda s: ", ".join(f"({_weight(s, '0', str(j))}) * 80" for j in range(4))
        parts.append(
            f"{_mat(f'w{k}', w, 4)}, hx{k} AS (SELECT v.id, i, sum(v.vec[j + 1] * w) AS x FROM v CROSS JOIN w{k} GROUP BY 1, 2), hh{k} AS (SELECT id, list(x ORDER BY i) AS h FROM hx{k} GROUP BY id),"
            f" hs{k} AS (SELECT id, h, {_dot('h', f'[{la(a)}]')} AS l, {_dot('h', f'[{la(b)}]')} AS r FROM hh{k}),"
            f" lo{k} AS (SELECT center, nbr, c.l + n.r AS x, n.h FROM ns JOIN hs{k} c ON c.id = center JOIN hs{k} n ON n.id = nbr), ll{k} AS (SELECT center, h, CASE WHEN x > 0 THEN x ELSE 0.2 * x END AS x FROM lo{k}),"
            f" mx{k} AS (SELECT center, max(x) AS m FROM ll{k} GROUP BY 1), ex{k} AS (SELECT l.center, h, exp(x - m) AS e FROM ll{k} l JOIN mx{k} ON mx{k}.center = l.center),"
            f" at{k} AS (SELECT center AS id, q.pos, sum(e * h[q.pos + 1]) / sum(e) AS val FROM ex{k}, range(4) q(pos) GROUP BY 1, 2)"
        )
    return f"WITH {_NB}, ns AS (SELECT center, nbr FROM nb UNION ALL SELECT id, id FROM v), {', '.join(parts)} SELECT a.id, a.pos, round((a.val + b.val) / 2, 6) + 0.0 AS val FROM at0 a JOIN at1 b ON a.id = b.id AND a.pos = b.pos"


_ENC = (
    f"WITH {_NB}, {_mat('wl', 'lin')}, h0 AS (SELECT v.id, i AS pos, sum(vec[CASE WHEN j < 32 THEN j + 33 ELSE j - 31 END] * w) AS val FROM v CROSS JOIN wl GROUP BY 1, 2), {_mat('e1', 'e1', OUT, OUT)}, {_mat('e2', 'e2', 4, OUT)}"
    + "".join(
        f", s{k} AS (SELECT center, pos, sum(val) AS s, count(*) AS n FROM nb JOIN h{k - 1} ON id = nbr GROUP BY 1, 2), t{k} AS (SELECT h.id, h.pos, (h.val + coalesce(s, 0)) / (coalesce(n, 0) + 1) AS x FROM h{k - 1} h LEFT JOIN s{k} ON center = h.id AND s{k}.pos = h.pos),"
        f" u{k} AS (SELECT id, i AS pos, sum(x * w * 10) AS y FROM t{k} JOIN e{k} ON j = pos GROUP BY 1, 2), h{k} AS (SELECT id, pos, {act} AS val FROM u{k})"
        for k, act in ((1, "greatest(y + 0.01, 0)"), (2, "1 / (1 + exp(-y))"))
    )
    + " SELECT id, pos, round(val, 6) + 0.0 AS val FROM h2"
)

SQL = {
    **{f"score_{k}": f"WITH {_LX} SELECT edge_id, round({f('vs', 'vr', 'vd')}, 6) AS score FROM fx" for k, f in _SCORES.items()},
    "score_inverse": f"WITH {VECTORS}, {LINES} SELECT edge_id, round({_SCORES['complex']('t.vec', 'r.vec', 's.vec')}, 6) AS score FROM f JOIN v s ON s.id = src JOIN v t ON t.id = dst JOIN v r ON r.id = rel + 2",
    "score_relations": f"WITH {_FX}, rr AS (SELECT DISTINCT rel FROM f) SELECT edge_id, rr.rel, round({_SCORES['distmult']('vs', 'v.vec', 'vd')}, 6) AS score FROM fx CROSS JOIN rr JOIN v ON v.id = rr.rel",
    "relation_operators": f"WITH {_LX} SELECT edge_id, round(list_sum({_had('vs', 'vr')}), 6) AS had, round(list_sum({_add('vs', 'vr')}), 6) AS trans, round({_cplx('vs', 'vr')}[1], 6) AS re0, round({_cplx('vs', 'vr')}[33], 6) AS im0 FROM fx",
    "activations": f"WITH {VECTORS} SELECT id, round(list_sum(list_transform(vec, lambda x: greatest(x, 0))), 6) AS relu, round(list_sum(list_transform(vec, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoid, round(list_sum(vec), 6) AS none FROM v",
    "score_chunk_negatives": f"WITH {_PN} SELECT edge_id, neg_id, round(score, 6) AS score FROM neg",
    "score_masked": f"WITH {_PN} SELECT neg.edge_id, neg_id, CASE WHEN k.src IS NOT NULL THEN -1e9 ELSE round(score, 6) END AS score FROM neg JOIN f ON f.edge_id = neg.edge_id LEFT JOIN f k ON k.src = f.src AND k.rel = f.rel AND k.dst = node",
    "rank_chunks": f"WITH {_PN} SELECT pos.edge_id, 1 + sum((round(neg.score, 9) >= round(pos.score, 9))::INT)::BIGINT AS rank FROM pos JOIN neg ON neg.edge_id = pos.edge_id GROUP BY 1",
    "rank_unfiltered": f"WITH {_ranked('distmult')} SELECT * FROM un",
    "rank_filtered": f"WITH {_ranked('distmult')} SELECT * FROM fl",
    "evaluate_links": f"WITH {_ranked('complex')} SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mr, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 10)::INT), 6) AS hits_10 FROM fl",
    "evaluate_links_both": f"WITH {_both_sides()} SELECT side, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mr, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 10)::INT), 6) AS hits_10 FROM bs GROUP BY side",
    "rank_filtered_hub": f"""WITH {VECTORS}, {HUB_EDGES}, hx AS (SELECT edge_id, src, rel, dst, {_had('s.vec', 'r.vec')} AS q, t.vec AS vd FROM he JOIN v s ON s.id = src JOIN v r ON r.id = rel JOIN v t ON t.id = dst),
sc AS (SELECT edge_id, src, rel, v.id AS node, round(list_dot_product(q, v.vec), 9) AS n, round(list_dot_product(q, vd), 9) AS p FROM hx CROSS JOIN v)
SELECT edge_id, 1 + sum((n >= p AND k.src IS NULL)::INT)::BIGINT AS rank FROM sc LEFT JOIN he k ON k.src = sc.src AND k.rel = sc.rel AND k.dst = node GROUP BY edge_id""".replace("edge_id, 1 +", "sc.edge_id, 1 +").replace("GROUP BY edge_id", "GROUP BY sc.edge_id"),
    "rank_lines": f"""WITH {VECTORS}, {VECTOR_EDGES}, f AS (SELECT *, (src * 3 + rel) * 1000000 + dst AS edge_id FROM g), fx AS (SELECT edge_id, {_had('s.vec', 'r.vec')} AS q, t.vec AS vd FROM f JOIN v s ON s.id = src JOIN v t ON t.id = dst JOIN v r ON r.id = rel),
fc AS (SELECT *, (row_number() OVER (ORDER BY {digest_sql(62, 'edge_id')}, edge_id) - 1) // ceil(count(*) OVER () / {CHUNKS})::BIGINT AS chunk_id FROM fx), {_UN}
SELECT edge_id, 1 + sum((round(list_dot_product(q, v.vec), 9) >= round(list_dot_product(q, vd), 9))::INT)::BIGINT AS rank FROM fc JOIN ng ON ng.chunk_id = fc.chunk_id JOIN v ON v.id = node GROUP BY 1""",
    "score_chunk_negatives_src": f"WITH {_FX}, {_CH}, {_UN} SELECT edge_id, neg_id, round({_SCORES['complex']('vd', 'r.vec', 'n.vec')}, 6) AS score FROM fc JOIN v r ON r.id = rel + 2 JOIN ng ON ng.chunk_id = fc.chunk_id JOIN v n ON n.id = node",
    "mrr": f"WITH {_ranked('distmult')} SELECT round(avg(1.0 / rank), 6) AS value FROM fl",
    "mean_rank": f"WITH {_ranked('distmult')} SELECT round(avg(rank), 6) AS value FROM fl",
    "hits_at_k": f"WITH {_ranked('distmult')} SELECT round(avg((rank <= 10)::INT), 6) AS value FROM fl",
    "predicted_classes": f"WITH {_LOGITS} SELECT * FROM pc",
    "accuracy": f"WITH {_LOGITS} SELECT round(100 * avg((y_true = y_pred)::INT), 6) AS accuracy FROM pc",
    "loss_classes": f"WITH {_LOGITS}, m AS (SELECT id, max(logit) AS m FROM lg GROUP BY 1), x AS (SELECT lg.id, any_value(m) + ln(sum(exp(logit - m))) - sum(CASE WHEN class = y_true THEN logit ELSE 0 END) AS x FROM lg JOIN m ON m.id = lg.id GROUP BY 1)"
    " SELECT round(sum(x), 6) AS loss_sum, round(avg(x), 6) AS loss_mean FROM x",
    **{f"loss_{k}": f"WITH {_PN}, {_LOSS[k]} SELECT round(sum(x), 6) AS loss_sum, round(avg(x), 6) AS loss_mean FROM xs" for k in LOSSES},
    "norm_penalty": f"WITH {_LX}, n AS (SELECT pos, sqrt(sum(vs[pos] ** 2)) + sqrt(sum(vd[pos] ** 2)) AS x FROM fx, {_POS} GROUP BY pos) SELECT round(sum(x) * 0.01 / 2, 6) AS penalty FROM n",
    "segment_sum": f"WITH {_NB}, {_SEG} SELECT center AS id, pos - 1 AS pos, round(s, 6) + 0.0 AS val FROM sg",
    "segment_mean": f"WITH {_NB}, {_SEG} SELECT center AS id, pos - 1 AS pos, round(s / n, 6) + 0.0 AS val FROM sg",
    "segment_max": f"WITH {_NB}, {_SEG} SELECT center AS id, pos - 1 AS pos, round(m, 6) + 0.0 AS val FROM sg",
    "sage_mean_layer": f"WITH {_NB}, {_SEG}, {_FULL}, {_mat('wa', 'a')}, {_mat('wb', 'b')}, o1 AS ({_matmul('sn', 'h', 'wa')}), o2 AS ({_matmul('sn', 's / greatest(n, 1)', 'wb')}), o AS (SELECT o1.id, o1.pos, o1.val + o2.val AS val FROM o1 JOIN o2 ON o1.id = o2.id AND o1.pos = o2.pos) {_OUT}",
    "sage_gcn_layer": f"WITH {_NB}, {_SEG}, {_FULL}, {_mat('wa', 'a')}, o AS ({_matmul('sn', '(h + s) / (n + 1)', 'wa')}) {_OUT}",
    "gcn_layer": f"WITH {_NB}, dg AS (SELECT center, count(*) AS dg FROM nb GROUP BY 1),"
    f" s2 AS (SELECT nb.center, r.pos, sum(v.vec[r.pos] / sqrt(d2.dg + 1)) AS s FROM nb JOIN v ON v.id = nbr JOIN dg d2 ON d2.center = nbr CROSS JOIN {_POS} GROUP BY 1, 2),"
    f" sn AS (SELECT v.id, r.pos, (coalesce(s2.s, 0) + v.vec[r.pos] / sqrt(coalesce(dg.dg, 0) + 1)) / sqrt(coalesce(dg.dg, 0) + 1) AS x FROM v CROSS JOIN {_POS} LEFT JOIN s2 ON s2.center = v.id AND s2.pos = r.pos LEFT JOIN dg ON dg.center = v.id),"
    f" {_mat('wa', 'a')}, o1 AS ({_matmul('sn', 'x', 'wa')}), o AS (SELECT id, pos, val + {_weight('bias', 'pos', '0')} AS val FROM o1) {_OUT}",
    "rgcn_layer": f"WITH {VECTORS}, {VECTOR_EDGES}, {_mat('wa', 'a')}, wr AS ({' UNION ALL '.join(f'SELECT {r} AS rel, i, j, ' + _weight(f'r{r}', 'i', 'j') + f' AS w FROM range({OUT}) a(i), range({DIM}) b(j)' for r in range(3))}),"
    f" sr AS (SELECT src AS center, rel, pos, sum(vec[pos]) AS s, count(*) AS n FROM g JOIN v ON v.id = dst, {_POS} GROUP BY 1, 2, 3), nn AS (SELECT src AS center, count(*) AS n FROM g GROUP BY 1), m AS (SELECT center, i, sum(s * w) AS x FROM sr JOIN wr ON wr.rel = sr.rel AND j = pos - 1 GROUP BY 1, 2),"
    " own AS (SELECT v.id, i, sum(vec[j + 1] * w) AS x FROM v CROSS JOIN wa GROUP BY 1, 2), o AS (SELECT own.id, own.i AS pos, own.x + coalesce(m.x / nn.n, 0) AS val FROM own LEFT JOIN m ON m.center = own.id AND m.i = own.i LEFT JOIN nn ON nn.center = own.id)"
    f" {_OUT}",
    "attention_softmax": f"WITH {_NB}, ns AS (SELECT center, nbr FROM nb UNION ALL SELECT id, id FROM v), lo AS (SELECT center, nbr, {_dot('a.vec', 'b.vec')} * 4 AS x FROM ns JOIN v a ON a.id = center JOIN v b ON b.id = nbr), mx AS (SELECT center, max(x) AS m FROM lo GROUP BY 1),"
    " ex AS (SELECT lo.center, nbr, exp(x - m) AS e FROM lo JOIN mx ON mx.center = lo.center), sm AS (SELECT center, sum(e) AS s FROM ex GROUP BY 1) SELECT ex.center, round(max(CASE WHEN ex.center = nbr THEN e / s END), 6) AS own, round(sum((e / s) ** 2), 6) AS squares FROM ex JOIN sm ON sm.center = ex.center GROUP BY 1",
    "gat_layer": _gat_sql(),
    "encoder": _ENC,
    "summed_gradients": f"WITH {_GR} SELECT id, pos - 1 AS pos, round(g, 6) + 0.0 AS val FROM gs",
    "sgd_step": f"WITH {_GV} SELECT id, pos - 1 AS pos, round(p - 0.1 * g, 6) + 0.0 AS val FROM b",
    "adagrad_step": f"WITH {_GR} SELECT v.id, r.pos - 1 AS pos, round(CASE WHEN g IS NULL THEN vec[r.pos] ELSE vec[r.pos] - 0.1 * g / (sqrt(0.5 + g * g) + 1e-10) END, 6) + 0.0 AS val FROM v CROSS JOIN {_POS} LEFT JOIN gs ON gs.id = v.id AND gs.pos = r.pos",
    "adagrad_decayed_step": f"WITH {_GV}, w AS (SELECT *, g + 0.01 * p AS q FROM b) SELECT id, pos - 1 AS pos, round(p - 0.1 / 1.3 * q / (sqrt(0.5 + q * q) + 1e-10), 6) + 0.0 AS val FROM w",
    "adam_step": f"WITH {_GV}, w AS (SELECT *, 0.9 * 0.01 + 0.1 * g AS m, greatest(0.03, 0.999 * 0.02 + 0.001 * g * g) AS x FROM b) SELECT id, pos - 1 AS pos, round(p - 0.1 / (1 - 0.9 ** 3) * m / (sqrt(x) / sqrt(1 - 0.999 ** 3) + 1e-8), 6) + 0.0 AS val FROM w",
    **{f"gradient_{a}_{b}": _gradient_sql(a, b) for a, b in STEPS},
    "class_gradient": f"WITH {_LOGITS}, m AS (SELECT id, max(logit) AS m FROM lg GROUP BY 1), z AS (SELECT lg.id, any_value(m) AS m, sum(exp(logit - m)) AS z FROM lg JOIN m ON m.id = lg.id GROUP BY 1)"
    " SELECT lg.id, row_number() OVER (PARTITION BY lg.id ORDER BY class) - 1 AS pos, round(exp(logit - m) / z - (class = y_true)::INT, 6) + 0.0 AS val FROM lg JOIN z ON z.id = lg.id",
    "adam_decayed_step": f"WITH {_GV}, w AS (SELECT *, g + 0.01 * p AS q FROM b), x AS (SELECT *, 0.9 * 0.01 + 0.1 * q AS m, 0.999 * 0.02 + 0.001 * q * q AS x FROM w) SELECT id, pos - 1 AS pos, round(p - 0.1 / (1 - 0.9 ** 2) * m / (sqrt(x) / sqrt(1 - 0.999 ** 2) + 1e-8), 6) + 0.0 AS val FROM x",
    "update_embeddings": f"WITH {_GR} SELECT v.id, r.pos - 1 AS pos, round(vec[r.pos] + coalesce(g, 0), 6) + 0.0 AS val FROM v CROSS JOIN {_POS} LEFT JOIN gs ON gs.id = v.id AND gs.pos = r.pos",
    "put_embeddings": f"WITH {VECTORS}, {FACTS}, k AS (SELECT DISTINCT src FROM f WHERE rel = 1) SELECT id, pos - 1 AS pos, round(CASE WHEN id IN (SELECT src FROM k) THEN 2 * vec[pos] ELSE vec[pos] END, 6) + 0.0 AS val FROM v, {_POS}",
    "init_embeddings": f"SELECT p_partkey AS id, j AS pos, round(({unit_sql(70, 'p_partkey', 'j')} * 2 - 1) * sqrt(6 / 2004.0), 6) + 0.0 AS val FROM part, range(4) r(j)",
}
