"""Retrieval: kernel == relational plan == brute force."""

from conftest import plan_text
import numpy as np
from pyspark.sql import functions as F

from docmill.operators import retrieve as RT
from docmill.plans.corpus import benchmark_queries, chunk_table, table

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_lexical_kernel_equals_sql(spark):
    ch = chunk_table(spark, SF)
    q = benchmark_queries(spark, SF)
    cols = ["item_id", "doc_id", "chunk_index", "distance", "rank"]
    a = RT.lexical_topk(q, ch, k=5, q_keys=["item_id"], q_text="query")
    for method in ("sql", "index"):
        b = RT.lexical_topk(q, ch, k=5, q_keys=["item_id"], q_text="query", method=method)
        assert _rows(a, cols) == _rows(b, cols)
    assert a.count() == 5 * q.count()


def test_ties_leave_exactly_k_rows_per_task(spark):
    # 10,000 equal chunks in one partition, keys not in order, some NULL
    ch = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("id")).coalesce(1).select(
        F.when(F.col("id") != 4, F.col("id")).alias("doc_id"), F.lit(0).alias("chunk_index"),
        F.lit("same words here").alias("text"))
    q = spark.createDataFrame([(1, "same words"), (2, "here"), (3, "none")], "item_id long, text string")
    from docmill.functions.text import tokens
    body = ch.select("doc_id", "chunk_index", tokens("text").alias("tokens"))
    tbl = q.select("item_id", tokens("text").alias("_tokens")).toArrow()
    emitted = RT._lexical_block(tbl, body, "item_id long, doc_id long, chunk_index int, distance double", ["item_id"],
                                ["doc_id", "chunk_index"], [], 3)
    assert emitted.groupBy("item_id").count().collect() and emitted.count() == 6
    out = {m: RT.lexical_topk(q, ch, k=3, carry=["text"], method=m) for m in ("kernel", "sql", "index")}
    assert out["kernel"].columns == out["sql"].columns == out["index"].columns
    rows = {m: sorted(str(r) for r in df.collect()) for m, df in out.items()}
    assert rows["kernel"] == rows["sql"] == rows["index"]
    assert [r.doc_id for r in out["kernel"].where("item_id = 1").orderBy("rank").collect()] == [None, 0, 1]
    small = RT.lexical_topk(q, ch, k=3, carry=["text"], max_block_queries=1)  # beyond the bound: the index
    assert sorted(str(r) for r in small.collect()) == rows["kernel"]


def test_dense_ties_leave_exactly_k_rows(spark):
    corpus = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50, 0, -1)], "cid long, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 2.0])], "qid long, vec array<double>")
    assert [(r.cid, r.rank) for r in RT.dense_topk(q, corpus, k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    import numpy as np
    import pyarrow as pa

    from docmill.functions.vectors import topk_kernel
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([[1.0, 2.0]] * 50)], names=["cid", "vec"])
    out = list(topk_kernel(np.array([7]), RT.unit_rows(np.array([[1.0, 2.0]])), 2)(iter([batch, batch])))
    assert sum(b.num_rows for b in out) == 2


def test_lexical_blank_query_and_carry(spark):
    ch = spark.createDataFrame([(1, 0, "alpha beta", "s1"), (1, 1, "gamma", "s1"), (2, 0, "beta beta", "s2"),
                                (3, 0, "1234 !!", "s3")], "doc_id long, chunk_index int, text string, source string")
    q = spark.createDataFrame([(10, "beta"), (11, "   "), (12, "zeta")], "qid long, text string")
    out = RT.lexical_topk(q, ch, k=5, q_keys=["qid"], carry=["source", "text"]).collect()
    assert {r.qid for r in out} == {10}
    by = sorted((r.rank, r.doc_id, r.source, round(r.distance, 6)) for r in out)
    assert by == [(1, 2, "s2", 0.0), (2, 1, "s1", round(1 - 1 / np.sqrt(2), 6))]


def test_dense_topk_matches_numpy(spark):
    emb = table(spark, SF, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    qs = RT.label_centroids(emb)
    got = {(r.qid, r.rank): r.cid for r in RT.dense_topk(qs, corpus, k=5).collect()}
    pdf = emb.toPandas()
    m = np.stack(pdf.embedding.map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf.vec_id.to_numpy()
    for label in sorted(pdf.label.unique()):
        c = m[pdf.label.to_numpy() == label].mean(axis=0)
        d = 1 - (m @ c) / (np.linalg.norm(m, axis=1) * np.linalg.norm(c))
        order = np.lexsort((ids, np.round(d, 6)))[:5]
        assert [got[(int(label), r + 1)] for r in range(5)] == list(ids[order])


def test_dense_blocks_equal_single_block(spark):
    emb = table(spark, SF, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    qs = emb.where(F.col("label") < 3).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    cols = ["qid", "cid", "rank"]
    assert _rows(RT.dense_topk(qs, corpus, k=3), cols) == _rows(RT.dense_topk(qs, corpus, k=3, max_block_rows=40), cols)


def test_ivf_full_probe_is_exact(spark):
    emb = table(spark, SF, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    qs = RT.label_centroids(emb)
    exact = _rows(RT.dense_topk(qs, corpus, k=5), ["qid", "cid", "rank"])
    approx, cand = RT.ivf_topk(qs, corpus, k=5, nlist=6, nprobe=6)
    assert _rows(approx, ["qid", "cid", "rank"]) == exact
    assert {r.candidates for r in cand.collect()} == {corpus.count()}


def test_retrieval_plans(spark):
    ch = chunk_table(spark, SF)
    q = benchmark_queries(spark, SF)
    plan = plan_text(RT.lexical_topk(q, ch, k=5, q_keys=["item_id"], q_text="query"))
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    sql_plan = plan_text(RT.lexical_topk_sql(q, ch, k=5, q_keys=["item_id"], q_text="query"))
    assert "BroadcastHashJoin" in sql_plan and "WindowGroupLimit" in sql_plan and "MapInArrow" not in sql_plan


def test_encoder_contract_feeds_dense_topk(spark):
    from docmill.operators.encode import encode

    def toy(texts):  # character-class counts: deterministic, no model needed
        return np.array([[t.count(c) for c in "aeiou"] + [len(t) % 7 + 1] for t in texts], dtype=np.float32)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["banana", "kiwi", "apple pie", "", "queue"])],
                                 "id long, text string")
    vecs = encode(docs, ["id"], "text", toy, dim=6, batch_rows=2)
    rows = {r.id: r.embedding for r in vecs.collect()}
    assert rows[0] == [3.0, 0.0, 0.0, 0.0, 0.0, 7.0] and rows[3] == [0.0] * 5 + [1.0]
    corpus = vecs.select(F.col("id").alias("cid"), F.col("embedding").alias("vec"))
    q = vecs.where("id = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vec"))
    top = RT.dense_topk(q, corpus, k=1).collect()
    assert [(r.qid, r.cid) for r in top] == [(0, 0)]


def test_model_is_loaded_once_per_worker_and_sees_bounded_batches(spark):
    import tempfile
    import uuid

    from docmill.operators.encode import char_batches, encode, encode_with
    log = tempfile.mkdtemp(prefix="docmill-loads-")

    def load():
        import os
        me = f"{os.getpid()}-{uuid.uuid4().hex}"
        open(f"{log}/load-{me}", "w").close()

        def predict(texts):
            open(f"{log}/call-{uuid.uuid4().hex}-{len(texts)}-{sum(map(len, texts))}", "w").close()
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return predict

    texts = ["a" * (i % 50) + "b" for i in range(400)] + [None, "", "ab" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(16)
    got = encode_with(docs, ["id"], "text", load, dim=2, batch_rows=40, batch_chars=200)
    want = encode(docs, ["id"], "text", lambda ts: np.array([[len(t), t.count("a")] for t in ts]), dim=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got.collect()  # the same model again: workers that have it don't load it
    import os
    loads = [f.split("-")[1] for f in os.listdir(log) if f.startswith("load")]
    calls = [tuple(map(int, f.split("-")[2:])) for f in os.listdir(log) if f.startswith("call")]
    assert len(loads) == len(set(loads)) < len(calls)  # one load for each worker process
    assert all(n <= 40 and (chars <= 200 or n == 1) for n, chars in calls)
    assert list(char_batches([], 5)) == [] and list(char_batches(["abc", "defghi", "j", "k"], 3)) == [["abc"], ["defghi"], ["j", "k"]]


def test_ivf_recall_grows_with_nprobe(spark):
    emb = table(spark, SF, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    qs = emb.where(F.col("label") < 4).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    exact = {(r.qid, r.cid) for r in RT.dense_topk(qs, corpus, k=5).collect()}
    recalls, shares = [], []
    for nprobe in (1, 3, 8):
        approx, cand = RT.ivf_topk(qs, corpus, k=5, nlist=8, nprobe=nprobe)
        got = {(r.qid, r.cid) for r in approx.collect()}
        recalls.append(len(got & exact) / len(exact))
        shares.append(sum(r.candidates for r in cand.collect()))
    assert recalls[0] <= recalls[1] <= recalls[2] == 1.0
    assert shares[0] < shares[1] < shares[2]


def test_ivf_default_reaches_recall_and_carries(spark):
    emb = table(spark, "/root/testdata/sf0.01", "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.col("label").alias("source"))
    odd = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, [0.0] * 64, 1)], corpus.schema)
    qs = emb.where("vec_id < 60").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    index = RT.ivf_index(corpus.unionByName(odd), carry=["source"])
    assert index.nlist == int(corpus.count() ** 0.5) and index.cells.count() == corpus.count()
    approx, cand = RT.ivf_search(qs, index, k=5)
    exact = {(r.qid, r.cid) for r in RT.dense_topk(qs, corpus, k=5).collect()}
    rows = approx.collect()
    labels = {r.cid: r.source for r in corpus.select("cid", "source").collect()}
    assert all(r.source == labels[r.cid] for r in rows)
    assert len({(r.qid, r.cid) for r in rows} & exact) >= 0.9 * len(exact)


def test_lexical_kernel_blocks_are_exact():
    import pyarrow as pa

    from docmill.functions.vectors import lexical_kernel
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    toks = [list(rng.choice(words, size=rng.integers(0, 40))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(toks, pa.list_(pa.string()))],
                                       names=["cid", "tokens"])
    vocab = words[:45]
    weights = rng.integers(0, 3, size=(45, 7)).astype(float)
    q_norm = np.sqrt((weights ** 2).sum(axis=0))
    t_idx, q_idx = np.nonzero(weights)
    term_ptr = np.searchsorted(t_idx, np.arange(46))
    term_w = weights[t_idx, q_idx]

    def run(**kw):
        out = list(lexical_kernel(vocab, term_ptr, q_idx, term_w, q_norm, 4, ["cid"], **kw)(iter([batch])))
        t = pa.Table.from_batches(out)
        got = sorted(zip(t.column("_q").to_pylist(), [round(d, 6) for d in t.column("distance").to_pylist()],
                         t.column("cid").to_pylist()))
        top = {}
        for q, d, c in got:  # global top-4 per query, as the final window does
            top.setdefault(q, [])
            if len(top[q]) < 4:
                top[q].append((c, d))
        return top

    want = {}
    chunk_tf = np.array([[t.count(w) for w in vocab] for t in toks], dtype=float)
    c2 = np.array([sum(t.count(w) ** 2 for w in set(t)) for t in toks], dtype=float)
    dots = chunk_tf @ weights
    for q in range(7):
        cand = [(round(1 - dots[c, q] / (q_norm[q] * np.sqrt(c2[c])), 6), c) for c in range(300) if dots[c, q] > 0]
        want[q] = [(c, d) for d, c in sorted(cand)[:4]]
    assert run() == run(fanout_block=5) == want
    # several batches in one task: the running top-k must give the same answer
    split = [batch.slice(0, 90), batch.slice(90, 120), batch.slice(210, 90)]
    out = list(lexical_kernel(vocab, term_ptr, q_idx, term_w, q_norm, 4, ["cid"])(iter(split)))
    assert len(out) == 1
    t = pa.Table.from_batches(out)
    got = {}
    for q, d, c in sorted(zip(t.column("_q").to_pylist(), [round(d, 6) for d in t.column("distance").to_pylist()],
                              t.column("cid").to_pylist())):
        got.setdefault(q, [])
        if len(got[q]) < 4:
            got[q].append((c, d))
    assert got == want


def test_dense_skips_null_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0])],
                                   "cid long, vec array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.1]), (11, None)], "qid long, vec array<double>")
    got = sorted((r.qid, r.rank, r.cid) for r in RT.dense_topk(q, corpus, k=5).collect())
    assert got == [(10, 1, 1), (10, 2, 4)]


def _zipf(spark, n_chunks, n_queries, seed=5):
    rng = np.random.default_rng(seed)
    words = np.array([f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in "bcdfglmnprstvz"])
    p = 1 / np.arange(1, len(words) + 1)
    p /= p.sum()
    text = lambda n: " ".join(rng.choice(words, n, p=p))
    ch = [(i if i != 17 else None, i % 3, text(rng.integers(0, 60)), f"s{i % 7}") for i in range(n_chunks)]
    q = [(i % (n_queries - 3) if i != 5 else None, text(rng.integers(0, 8))) for i in range(n_queries)] + [(-1, "  "), (-2, "zzzz")]
    return (spark.createDataFrame(ch, "doc_id long, chunk_index int, text string, src string").repartition(4),
            spark.createDataFrame(q, "qid long, text string"))


def test_index_equals_sql_and_scores_few_pairs(spark):
    from docmill.operators import postings as P
    ch, q = _zipf(spark, 3000, 60)
    index = P.lexical_index(ch, carry=["src", "text"])
    cols = ["qid", "doc_id", "chunk_index", "src", "text", "distance", "rank"]
    for k in (1, 4):
        got, want = P.search(q, index, k, ["qid"]), RT.lexical_topk_sql(q, ch, k, ["qid"], carry=["src", "text"])
        assert got.columns == want.columns
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    _, asked = P.asked_bags(q, ["qid"], "text")
    weighted = P.weighted_terms(asked, index)
    wanted = P.wanted_terms(weighted, P.thresholds(weighted, asked, index, 4))
    pairs, every = P.candidate_pairs(wanted, index).count(), asked.count() * index.vectors.count()
    assert asked.count() < q.count() and pairs < 0.05 * every
    assert P.candidate_pairs(weighted.selectExpr("*", "0D as least", "0D as rest"), index).count() > 5 * pairs


def test_index_blocks_are_bounded_and_nothing_is_fetched(spark, monkeypatch):
    from docmill.operators import postings as P
    monkeypatch.setattr(P, "ZONE", 16)
    ch = spark.range(2000).selectExpr("id as doc_id", "0 as chunk_index", "'one line for all' as text").coalesce(1)
    index = P.lexical_index(ch)
    assert index.blocks.agg(F.max(F.size("postings"))).first()[0] == 16 and index.blocks.count() == 4 * 125
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    for name in ("toArrow", "collect", "toPandas", "first"):
        monkeypatch.setattr(Frame, name, lambda *a, **k: 1 / 0)
    top = P.search(spark.createDataFrame([(1, "line"), (2, "all of it")], "qid long, text string"), index, 3, ["qid"])
    plan = plan_text(top)
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan
    monkeypatch.undo()
    assert [(r.qid, r.doc_id, r["rank"]) for r in top.orderBy("qid", "rank").collect()] == [
        (q, d, d + 1) for q in (1, 2) for d in (0, 1, 2)]


def test_ivf_two_levels_fitted_on_a_sample(spark):
    emb = table(spark, "/root/testdata/sf0.01", "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    index = RT.ivf_index(corpus, nlist=30, sample=100, max_coarse=10)
    assert (len(index.coarse), len(index.fine)) == (10, 3) and index.cells.count() == corpus.count()
    assert index.cells.where("cell < 0 or cell >= 30").count() == 0
    qs = emb.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    exact = {(r.qid, r.cid) for r in RT.dense_topk(qs, corpus, k=5).collect()}
    approx, cand = RT.ivf_search(qs, index, k=5)
    assert len({(r.qid, r.cid) for r in approx.collect()} & exact) >= 0.9 * len(exact)
    assert sum(r.candidates for r in cand.collect()) < qs.count() * corpus.count()


def test_ivf_certified_is_exact(spark):
    emb = table(spark, "/root/testdata/sf0.01", "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    qs = emb.where("vec_id % 10 = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    odd = spark.createDataFrame([(-1, [0.0] * 64), (-2, None)], qs.schema)
    cols = ["qid", "cid", "rank"]
    exact = _rows(RT.dense_topk(qs, corpus, k=5), cols)
    index = RT.ivf_index(corpus, nlist=12)
    for nprobe in (1, 2, 12):
        assert _rows(RT.ivf_search(qs.unionByName(odd), index, k=5, nprobe=nprobe, certified=True)[0], cols) == exact
    many = RT.ivf_search(qs, index, k=200, nprobe=1, certified=True)[0]  # fewer than k in the first round
    assert _rows(many, cols) == _rows(RT.dense_topk(qs, corpus, k=200), cols)
    # well separated groups: most cells are ruled out
    rng = np.random.default_rng(1)
    groups = np.repeat(np.eye(8), 50, axis=0) + rng.normal(0, 0.02, (400, 8))
    far = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(groups)], "cid long, vec array<double>")
    one = far.where("cid % 50 = 7").withColumnRenamed("cid", "qid")
    got, cand = RT.ivf_search(one, RT.ivf_index(far, nlist=8), k=5, nprobe=1, certified=True)
    assert _rows(got, cols) == _rows(RT.dense_topk(one, far, k=5), cols)
    assert sum(r.candidates for r in cand.collect()) < 8 * 400 / 2


def test_ivf_without_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "cid long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    assert RT.ivf_topk(q, none)[0].count() == 0 == RT.ivf_topk(q, none, certified=True)[0].count()


def test_sums_of_a_chunk_are_made_in_its_zone(spark):
    from docmill.operators import postings as P
    ch, q = _zipf(spark, 300, 20)
    index = P.lexical_index(ch)
    blocks = index.blocks.select("zone", "term", F.inline(F.arrays_zip("postings", "tfs", "norms"))).collect()
    vectors = {r.cid: r for r in index.vectors.collect()}
    assert sorted((r[2], r.term, r[3], r[4]) for r in blocks) == sorted(
        (c, t, n, r.norm2) for c, r in vectors.items() for t, n in zip(r.terms, r.tfs))
    assert all(r.zone == r[2] // P.ZONE for r in blocks)
    _, asked = P.asked_bags(q, ["qid"], "text")
    weighted = P.weighted_terms(asked, index)
    wanted = P.written(P.wanted_terms(weighted, P.thresholds(weighted, asked, index, 4)), "wanted")
    plan = plan_text(P.read_postings(wanted, index))
    assert "hashpartitioning(zone" in plan and "hashpartitioning(qid" not in plan


def test_query_blocks_equal_sql_with_repeated_keys(spark):
    ch, q = _zipf(spark, 400, 40)
    ch = ch.unionByName(ch.where("doc_id < 9").withColumn("text", F.concat("text", F.lit(" bab"))))
    cols = ["qid", "doc_id", "chunk_index", "text", "distance", "rank"]
    want = RT.lexical_topk(q, ch, k=4, q_keys=["qid"], carry=["text"], method="kernel")
    for bound in ({"max_block_queries": 7}, {"max_block_terms": 20}):
        got = RT.lexical_topk(q, ch, k=4, q_keys=["qid"], carry=["text"], **bound)
        assert got.columns == want.columns
        named = [c for c in cols if c != "text"]
        assert sorted(map(str, got.select(named).collect())) == sorted(map(str, want.select(named).collect()))
    none = RT.lexical_topk(q.where("qid < 0"), ch, q_keys=["qid"], carry=["text"], max_block_queries=1)
    assert none.count() == 0


def test_ivf_ranks_cells_where_they_are_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i % 50 else 7, [float(x) for x in rng.normal(size=8)], f"s{i % 3}") for i in range(600)]
    corpus = spark.createDataFrame(rows, "cid long, vec array<double>, source string").repartition(5)
    qs = spark.createDataFrame([(i % 30, v) for i, (_, v, _) in enumerate(rows[:40])], "qid long, vec array<double>")
    index = RT.ivf_index(corpus, nlist=12, carry=["source"])
    cols = ["qid", "cid", "source", "distance", "rank"]
    full, cand = RT.ivf_search(qs, index, k=4, nprobe=12)
    assert {r.candidates for r in cand.collect()} == {600, 1200}  # ten queries come twice
    for kwargs in ({"max_values": 50}, {"certified": True, "nprobe": 2, "max_values": 90}):
        got, _ = RT.ivf_search(qs, index, k=4, **({"nprobe": 12} | kwargs))
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, full.select(cols).collect()))
    assert "Join" not in plan_text(full)


def test_coded_kernel_equals_brute_force(monkeypatch):
    """The block kernel's rows with few and many matrix terms, in single and double
    precision, small blocks of rows, ties, and a query that no row meets."""
    import math
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    from docmill.functions import vectors as V
    rng = random.Random(3)
    vocab = [f"w{i:02}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    queries = [Counter(rng.choices(vocab[:30], weights[:30], k=rng.randint(1, 8))) for _ in range(25)] + [Counter(["w39"])]
    for heavy in (1, 900):
        rows = [Counter(rng.choices(vocab[:35], weights[:35], k=rng.randint(1, 30)) + ["other"]) for _ in range(300)]
        rows += [Counter({t: n * heavy * 3 for t, n in c.items()}) for c in rows[:40]]
        want = []
        for q, asked in enumerate(queries):
            found = []
            for i, c in enumerate(rows):
                dot = sum(n * c[t] for t, n in asked.items())
                if dot:
                    norms = math.sqrt(sum(n * n for n in asked.values())) * math.sqrt(sum(n * n for n in c.values()))
                    found.append((round(1.0 - dot / norms, 6), i % 7, i))
            want += [(q, i, d) for d, _, i in sorted(found)[:4]]
        entries = sorted((vocab.index(t), q, n) for q, c in enumerate(queries) for t, n in c.items())
        term, held, tf = (np.array(x) for x in zip(*entries))
        ptr = np.searchsorted(term, np.arange(len(vocab) + 1))
        tokens = pa.array([[t for t, n in c.items() for _ in range(n)] for c in rows])
        batch = pa.RecordBatch.from_arrays([pa.array([i % 7 for i in range(len(rows))]), pa.array(range(len(rows))), tokens],
                                           names=["key", "cid", "tokens"])
        coded = list(V.coded_bags(vocab, ["key", "cid"])(iter([batch.slice(0, 200), batch.slice(200)])))
        assert sum(b.column("norm2").to_pylist()[0] for b in coded[:1]) == sum(n * n for n in rows[0].values())
        for dense, cells in ((0, 1 << 20), (3, 26 * 11), (128, 26 * 50)):
            monkeypatch.setattr(V, "DENSE_TERMS", dense)
            monkeypatch.setattr(V, "PRODUCT_CELLS", cells)
            out = list(V.coded_kernel(ptr, held, tf, np.arange(len(queries)), 4, ["key", "cid"], ["key", "cid"])(iter(coded)))
            got = [(r["qid"], r["cid"], round(r["distance"], 6)) for b in out for r in b.to_pylist()]
            assert sorted(got) == sorted((q, i, round(d, 6)) for q, i, d in want)


def test_blocks_read_the_tokens_of_chunks_once(spark, monkeypatch):
    """However many blocks of queries there are, chunks are cut into terms once."""
    cut = []
    tokens = RT.tokens
    monkeypatch.setattr(RT, "tokens", lambda c: cut.append(c) or tokens(c))
    q = spark.createDataFrame([(i, f"alpha beta{chr(97 + i)}") for i in range(20)], "qid long, text string")
    ch = spark.createDataFrame([(i, 0, f"alpha beta{chr(97 + i % 9)} gamma") for i in range(30)], "doc_id long, chunk_index int, text string")
    got = RT.lexical_topk(q, ch, k=2, q_keys=["qid"], method="blocks", max_block_queries=3)
    assert cut.count("_text") == 1
    want = RT.lexical_topk(q, ch, k=2, q_keys=["qid"], method="sql")
    def rows(df):
        return sorted((r["qid"], r["doc_id"], r["chunk_index"], round(r["distance"], 6), r["rank"]) for r in df.collect())
    assert rows(got) == rows(want)
