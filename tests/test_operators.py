import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.config import Config
from candor import checkpoints
from candor.operators import clustering, keywords, kmeans, order, scoring, truth
from candor.plans.discovery import clustered, discover
from candor.sources import corpus

ANSWERS = [
    (0, 0, "A stack is last in, first out."),
    (0, 1, "stack stack queue"),
    (0, 2, ""),
    (1, 0, None),
    (1, 1, "the and of"),
    (2, 0, "tree tree tree"),
    (2, 1, "tree graph"),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ANSWERS, "question_id int, owner_id int, raw_answer string")


@pytest.fixture(scope="module")
def model(spark):
    words = {"stack": [1.0, 0.0], "queue": [0.0, 1.0], "last": [0.8, 0.6], "first": [0.6, 0.8], "tree": [-1.0, 0.0], "graph": [0.0, -1.0]}
    return spark.createDataFrame(list(words.items()), "word string, vec array<float>")


def bag(df):
    return sorted((r.question_id, r.owner_id, r.content) for r in df.collect())


def test_keywords(spark, answers, model):
    words = bag(keywords.keywords(answers, corpus.stopwords(spark), model))
    assert words == sorted([(0, 0, "stack"), (0, 0, "last"), (0, 0, "first"), (0, 1, "stack"), (0, 1, "stack"), (0, 1, "queue")] + [(2, 0, "tree")] * 3 + [(2, 1, "tree"), (2, 1, "graph")])


def test_padding_keeps_words(answers):
    words = keywords.tokenized(answers)
    padded = keywords.padded(words)
    assert all(len(r.content) == r.width and r.width % 4 == 0 for r in padded.collect())
    assert bag(keywords.unpadded(padded)) == bag(words)


def test_dummies(answers):
    words = keywords.tokenized(answers)
    more = keywords.with_dummies(words)
    assert bag(keywords.without_dummies(more)) == bag(words)
    alpha = {r.question_id: r.a for r in keywords.vocabulary(words).groupBy("question_id").agg(keywords.gamma_alpha(F.count("*")).alias("a")).collect()}
    counts = more.where("owner_id = -1").groupBy("question_id", "content").count().collect()
    assert counts and all(r["count"] <= 2 * alpha[r.question_id] for r in counts)


@pytest.mark.parametrize(("u", "k"), [(0.0, -1), (0.26, -1), (0.27, 0), (0.73, 0), (0.75, 1), (0.999999, 5)])
def test_gamma(spark, u, k):
    drawn = spark.createDataFrame([(u,)], "u double").select(keywords.gamma(F.col("u"), F.lit(9))).first()[0]
    assert drawn - 9 == k


def test_alpha_is_nine_for_usual_vocabularies(spark):
    got = spark.range(34, 282).select(keywords.gamma_alpha(F.col("id")).alias("a")).distinct().collect()
    assert [r.a for r in got] == [9]


def test_shuffle_and_sort_are_permutations(answers):
    words = keywords.tokenized(answers)
    for df in (keywords.shuffled(words), keywords.ordered(words, "content", descending=True)):
        assert bag(df) == bag(words)
        places = df.where("question_id = 0").select("place").orderBy("place").collect()
        assert [r.place for r in places] == list(range(len(places)))


def test_nearest_takes_lowest_of_equal(spark):
    words = spark.createDataFrame([(0, "w", 1, [1.0, 0.0])], "question_id int, content string, n int, vec array<double>")
    centers = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (0, [0.0, 1.0])], "k int, mu array<double>")
    assert clustering.assigned(words, centers).first().cluster == 1


def test_fixed_centroids_are_compared_once_for_each_word(spark, answers):
    model = spark.createDataFrame([("stack", [1.0, 0.0]), ("tree", [0.0, 1.0]), ("queue", [0.6, 0.8]), ("graph", None)], "word string, vec array<float>")
    centers = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, mu array<double>")
    found = clustering.assigned(model, centers)
    assert {r.word: r.cluster for r in found.collect()} == {"stack": 3, "tree": 1, "queue": 1, "graph": None}
    assert found.limit(0).count() == 0
    made = clustered(keywords.tokenized(answers), model, Config(), centers)
    assert "vec" not in "".join(line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line or "Aggregate" in line)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.question_id, r.content, r.cluster) for r in made.collect() if r.content in ("stack", "tree")} >= {(0, "stack", 3), (2, "tree", 1)}


def test_mass_by_hand(spark):
    words = spark.createDataFrame([(0, 0, 2, [1.0, 0.0]), (0, 1, 3, [0.0, 1.0]), (1, 0, 1, [0.6, 0.8])], "question_id int, pos int, n int, vec array<double>")
    centers = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "question_id int, k int, mu array<double>")
    found = clustering.seeding_mass(words, centers)
    assert {(r.question_id, r.pos): round(r.mass, 9) for r in found.collect()} == {(0, 0): 0.0, (0, 1): 6.0, (1, 0): 0.4}


def test_kmeans_steps_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, 40)
    words = spark.createDataFrame([(0, f"w{k:02}", int(n), v.tolist()) for k, (n, v) in enumerate(zip(w, x, strict=True))], "question_id int, content string, n int, vec array<double>")
    start = spark.createDataFrame([(0, k, x[k].tolist()) for k in range(3)], "question_id int, k int, mu array<double>")
    found, _ = clustering.kmeans(words, start, max_iter=30)
    centers = x[:3].copy()
    for _ in range(30):
        c = np.argmax(x @ centers.T, 1)
        new = np.stack([(x[c == k] * w[c == k, None]).sum(0) for k in range(3)])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.abs(new - centers).sum() < 1e-12:
            break
        centers = new
    assert [r.cluster for r in found.orderBy("content").collect()] == np.argmax(x @ centers.T, 1).tolist()


def test_seeding_skips_weightless_words(spark):
    words = spark.createDataFrame([(0, p, n, v) for p, (n, v) in enumerate([(0, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [-1.0, 0.0])])], "question_id int, pos int, n int, vec array<double>")
    centers = clustering.initial_centers(words, 2).collect()
    assert {tuple(r.mu) for r in centers} <= {(0.0, 1.0), (-1.0, 0.0)} and len(centers) == 2


def test_grouped_kmeans_with_few_words(answers, model):
    words = keywords.with_vectors(keywords.distinct_words(keywords.keywords(answers, None, model)), model)
    found = clustering.kmeans_grouped(words, Config(clusters=30))
    assert found.count() == words.count() and all(0 <= r.cluster < 30 for r in found.collect())


def test_truth_model_by_hand(spark):
    cells = [(0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 1), (0, 1, 1, 1)]
    obs = spark.createDataFrame(cells, "question_id int, owner_id int, factor int, obs int")
    z = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "question_id int, factor int, indicator int")
    counts = truth.prior_counts(obs, z)
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 1, 0, 0, 1), (1, 0, 1, 0, 1)]
    like = {r.factor: r for r in truth.log_likelihood(obs, z, counts).collect()}
    # factor 0 is true now: less one in the numerator of indicator 1 only
    l0 = math.log(10) + math.log(10 / 101) + math.log(11 / 101)
    l1 = math.log(10) + 2 * math.log(50 / 101)
    assert like[0].l0 == pytest.approx(l0) and like[0].l1 == pytest.approx(l1)
    assert {r.factor: r.indicator for r in truth.most_likely(truth.log_likelihood(obs, z, counts)).collect()}[0] == 1


def test_observations_and_chain(spark, answers):
    words = spark.createDataFrame([(0, 0, 0, "a", 1), (0, 0, 1, "b", 1), (0, 1, 0, "a", 0)], "question_id int, owner_id int, pos int, content string, cluster int")
    obs = truth.observations(answers, words, 3)
    assert obs.count() == 3 * len(ANSWERS) and obs.agg(F.sum("obs")).first()[0] == 2
    counts = truth.prior_counts(obs, truth.initial_truth(obs))
    per_owner = {r.owner_id: r.n00 + r.n01 + r.n10 + r.n11 for r in counts.collect()}
    assert per_owner == {0: 9, 1: 9, 2: 3}
    chain = truth.gibbs(obs, Config(sweeps=5))
    assert sorted((r.question_id, r.factor) for r in chain.collect()) == [(q, f) for q in range(3) for f in range(3)]
    assert truth.synchronous(obs, 6, Config(), draw=True).count() == 9


@pytest.mark.parametrize("factors", [4, 130])
def test_packed_sweeps_equal_those_by_cell(spark, factors):
    rng = np.random.default_rng(5)
    cells = [(q, o, f, int(rng.random() < 0.4)) for q in range(5) for o in range(6) for f in range(factors) if (q + o) % 3]
    obs = spark.createDataFrame(cells, "question_id int, owner_id int, factor int, obs int")
    packed = checkpoints.cut(truth.repacked(obs, factors))
    assert sorted(tuple(r) for r in truth.unpacked(packed, factors).select("question_id", "owner_id", "factor", "obs").collect()) == sorted(cells)
    z = checkpoints.cut(truth.initial_truth(obs))
    coin = truth.repacked(z.select("question_id", F.lit(0).alias("owner_id"), "factor", F.col("indicator").alias("obs")), factors).select("question_id", F.col("obs").alias("z"))
    counts = truth.prior_counts(obs, z)
    first = checkpoints.cut(truth.packed_counts(packed, coin, factors))
    as_rows = lambda d: sorted(tuple(r) for r in d.select("owner_id", "n00", "n01", "n10", "n11").collect())
    assert as_rows(first) == as_rows(counts)
    expected = {(r.question_id, r.factor): r for r in truth.log_likelihood(obs, z, counts).collect()}
    likelihood = checkpoints.cut(truth.packed_likelihood(packed, coin, first, truth.Terms(factors)))
    got = likelihood.collect()
    assert len(got) * factors == len(expected)
    for r in got:
        for f in range(factors):
            assert r.l0[f] == pytest.approx(expected[r.question_id, f].l0) and r.l1[f] == pytest.approx(expected[r.question_id, f].l1)
    # the next truth by flips, and counts that follow it, as counted anew
    after = checkpoints.cut(truth.swept(likelihood, factors, True, "truth", 0))
    dense = {(r.question_id, r.factor): r.indicator for r in truth.drawn(truth.log_likelihood(obs, z, counts), "truth", 0).collect()}
    assert {(r.question_id, r.factor): r.indicator for r in truth.unpacked(after.select("question_id", "z"), factors, "z", "indicator").collect()} == dense
    assert as_rows(truth.changed_counts(first, packed, after, factors)) == as_rows(truth.packed_counts(packed, after, factors))


@pytest.mark.parametrize("sweeps", [9, 10])
def test_most_likely_truths_may_end_early(spark, sweeps):
    rng = np.random.default_rng(11)
    cells = [(q, o, f, int(rng.random() < 0.5)) for q in range(4) for o in range(5) for f in range(3)]
    obs = spark.createDataFrame(cells, "question_id int, owner_id int, factor int, obs int")
    config = Config(alpha=(2.0, 1.0, 1.0, 2.0))  # these alternate or stand still soon
    z = {(r.question_id, r.factor): r.indicator for r in truth.initial_truth(obs).collect()}
    a = np.array(config.alpha).reshape(2, 2)
    for _ in range(sweeps):
        n = np.zeros((5, 2, 2))
        for q, o, f, x in cells:
            n[o, z[q, f], x] += 1
        log = {k: np.zeros(2) for k in z}
        for q, o, f, x in cells:
            for i in (0, 1):
                log[q, f][i] += math.log((n[o, i, x] + a[i, x] - (z[q, f] == i)) / (a[i].sum() + n[o, i].sum()))
        z = {k: 0 if v[0] > v[1] else 1 for k, v in log.items()}
    got = {(r.question_id, r.factor): r.indicator for r in truth.synchronous(obs, sweeps, config).collect()}
    assert got == z


def vectors_of(spark, x, n, questions=1):
    rows = [(q, f"w{k:03}", int(m), v.tolist()) for q in range(questions) for k, (m, v) in enumerate(zip(n, x, strict=True))]
    return spark.createDataFrame(rows, "question_id int, content string, n int, vec array<float>")


def test_bounds_skip_and_give_the_same_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(6, 5)), 40, 0) + rng.normal(0, 0.35, size=(240, 5))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    w = rng.integers(0, 4, 240)
    words = vectors_of(spark, x, w)
    start = x[:6].copy()
    blocked = kmeans.blocks(words, 32)
    assert 5 <= blocked.count() <= 8
    checked: list[int] = []
    found = kmeans.lloyd(blocked, spark.createDataFrame([(0, start.tolist())], "question_id int, centers array<array<double>>"), 60, checked=checked)
    centers, steps = start, 0
    while True:
        label = np.argmax(x @ centers.T, 1)
        new = np.stack([(x[label == k] * w[label == k, None]).sum(0) for k in range(6)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-8)
        moved, centers, steps = np.linalg.norm(new - centers, axis=1).sum(), new, steps + 1
        if moved <= 1e-12:
            break
    assert len(checked) == steps and checked[0] == 240 and sum(checked[1:]) < 0.7 * 240 * (steps - 1)
    assert np.allclose(found.first().centers, centers)
    got = [r.cluster for r in kmeans.labelled(blocked, found).orderBy("content").collect()]
    assert got == np.argmax(x @ centers.T, 1).tolist()


def test_parallel_seeds_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words = vectors_of(spark, x, [k % 3 for k in range(90)], 2)
    few = spark.createDataFrame([(7, "only", 0, [1.0, 0.0, 0.0, 0.0])], words.schema)
    words = words.unionByName(few)
    found = [{r.question_id: [tuple(np.round(c, 6)) for c in r.centers] for r in kmeans.seeds(words, kmeans.blocks(words, size), 5).collect()} for size in (1000, 8)]
    assert found[0] == found[1]
    drawn = {tuple(np.round(v.astype(np.float32).astype(float), 6)): k for k, v in enumerate(x)}
    for q in (0, 1):
        assert len(set(found[0][q])) == 5 and all(drawn[c] % 3 for c in found[0][q])  # none of weight 0
    assert found[0][0] != found[0][1] and found[0][7] == [(1.0, 0.0, 0.0, 0.0)] * 5


def several_questions(spark, seed):
    """Questions of 60, 20, 3 and 1 words, one without weight, and centers to start from."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(q, f"w{k:02}", int(rng.integers(0 if q != 4 else 1, 4)), x[k].tolist()) for q, m in ((0, 60), (1, 20), (2, 3), (4, 1)) for k in range(m)]
    words = spark.createDataFrame(rows, "question_id long, content string, n int, vec array<float>")
    start = spark.createDataFrame([(q, k, x[7 * k].tolist()) for q in (0, 1, 2, 4) for k in range(3)], "question_id long, k int, mu array<double>")
    return words, start


def test_small_questions_are_seeded_within_their_row(spark):
    words, _ = several_questions(spark, 21)
    kept = words.withColumn("pos", F.col("content"))
    by = lambda c: {(r.question_id, r.k): tuple(np.round(r.mu, 6)) for r in c.collect()}
    with checkpoints.scope() as made:
        found = clustering.initial_centers(kept, 4)
        assert len(made) == 1  # the list of large questions: neither vectors nor distances are written
    assert by(found) == by(clustering.initial_centers(kept, 4, size=10)) == by(clustering.initial_centers(kept, 4, size=0))
    listed = lambda c: {r.question_id: [tuple(np.round(v, 6)) for v in r.centers] for r in c.collect()}
    with checkpoints.scope() as made:
        found = kmeans.seeded(words, 4)
        assert len(made) == 1
    assert listed(found) == listed(kmeans.seeded(words, 4, size=10)) == listed(kmeans.seeds(words, kmeans.blocks(words), 4))


def test_small_questions_move_within_their_row(spark):
    words, start = several_questions(spark, 22)
    words = words.where("n > 0")
    for step in (clustering.kmeans, clustering.movmf):
        with checkpoints.scope() as made:
            found = step(words, start, 3)
            assert len(made) == 1
        for size in (10, 0):
            other = step(words, start, 3, size=size)
            assert sorted((r.question_id, r.content, r.n, r.cluster) for r in found[0].collect()) == sorted((r.question_id, r.content, r.n, r.cluster) for r in other[0].collect())
            assert found[0].count() == words.count() and set(found[0].columns) == set(other[0].columns)
            state = [{(r.question_id, r.k): np.hstack([r.mu, *([r.alpha, r.kappa] if "alpha" in r else [])]) for r in c.collect()} for c in (found[1], other[1])]
            assert state[0].keys() == state[1].keys() and all(np.allclose(v, state[1][k], 1e-6) for k, v in state[0].items())


def test_blocks_stay_where_they_are(spark):
    words, start = several_questions(spark, 23)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocked = kmeans.blocks(words, 4)
        both = kmeans._beside(blocked, start.groupBy("question_id").agg(F.collect_list("mu").alias("centers")), kmeans.parts_of(blocked))
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Bucketed: true" in plan and both.count() == blocked.count()
    made = checkpoints.bucketed(words, ["question_id"])
    path = checkpoints.MADE[-1]
    checkpoints.clean(spark, [path])
    assert path not in checkpoints.BUCKETED and made.columns == words.columns
    checkpoints.MADE.remove(path)


def test_equal_vectors_are_one(spark):
    model = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "word string, vec array<float>")
    words = spark.createDataFrame([(0, "a", 2), (0, "b", 3), (0, "c", 1), (1, "b", 4), (1, "none", 1)], "question_id int, content string, n long")
    assert sorted(tuple(r) for r in kmeans.collapsed(words, kmeans.dictionary(model)).collect()) == [(0, "a", 5), (0, "c", 1), (1, "a", 4)]
    found = {(r.question_id, r.content): r.cluster for r in kmeans.clusters(words, model, 2).collect()}
    assert set(found) == {(0, "a"), (0, "b"), (0, "c"), (1, "b")} and found[0, "a"] == found[0, "b"] != found[0, "c"]


def test_clusters_of_one_block_and_of_several_are_the_same(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 6))
    x[100:] = x[:50]  # equal vectors
    model = spark.createDataFrame([(f"w{k:03}", v.tolist()) for k, v in enumerate(x)], "word string, vec array<float>")
    rows = [(q, f"w{k:03}", int(rng.integers(0, 4))) for q, m in ((0, 150), (1, 60), (2, 3), (3, 1)) for k in range(m)]
    rows += [(4, f"w{k:03}", 0) for k in range(40)]  # nothing has weight
    words = spark.createDataFrame(rows, "question_id int, content string, n int")
    found = [{(r.question_id, r.content): (r.n, r.cluster) for r in kmeans.clusters(words, model, 4, max_iter=40, size=size).collect()} for size in (1000, 50, 7)]
    assert found[0] == found[1] == found[2]
    assert {k: v[0] for k, v in found[0].items()} == {(q, c): n for q, c, n in rows}
    assert len({c for (q, _), (_, c) in found[0].items() if q == 0}) == 4


def test_small_questions_come_as_sorted_rows(spark):
    """Their vectors are not gathered into lists, and a question may lie in several batches."""
    rng = np.random.default_rng(12)
    rows = [(q, f"w{k:03}", int(rng.integers(0, 3)), rng.normal(size=4).tolist()) for q in (*range(9), None) for k in range(1 + 7 * (q or 0) % 23)]
    vectors = spark.createDataFrame(rows, "question_id int, content string, n int, vec array<float>")
    found, default = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (default, "1", "5"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append({(r.question_id, r.content): r.cluster for r in kmeans.whole(vectors, 3).collect()})
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    assert found[0] == found[1] == found[2] and set(found[0]) == {(q, c) for q, c, _, _ in rows if q is not None}
    assert "collect_list" not in kmeans.whole(vectors, 3)._jdf.queryExecution().toString()
    few, kmeans_few = found[0], kmeans.FEW
    x, n = rng.normal(size=(60, 4)), np.ones(60)
    try:  # with bounds and without
        kmeans.FEW = 0
        bound = kmeans.lloyd_moves(x, n, x[:5], 50, 1e-12)
    finally:
        kmeans.FEW = kmeans_few
    plain = kmeans.lloyd_moves(x, n, x[:5], 50, 1e-12)
    assert (bound[0] == plain[0]).all() and np.allclose(bound[1], plain[1]) and len(set(few.values())) == 3


@pytest.mark.parametrize("mode", ["plain", "padded"])
def test_answers_are_tokenized_once(spark, answers, model, mode):
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    texts = answers.withColumn("raw_answer", F.udf(count, "string").asNondeterministic()("raw_answer"))
    discover(texts, model, corpus.stopwords(spark), Config(clusters=2, top_k=2, sweeps=1, max_iter=2), mode).top.collect()
    assert read.value == answers.count()


def test_small_groups_are_placed_by_a_window(spark):
    rows = [(k % 3 or None, k % 5, k) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, v int, k int")
    by = lambda fits: {r.k: (r.place, r.n) for r in order.places(df, ["g"], [F.col("v").desc(), F.col("k")], total="n", fits=fits).collect()}
    assert by(0) == by(19) == by(20) and len(by(20)) == 60
    assert order.places(df.limit(0), ["g"], [F.col("k")], fits=5).count() == 0
    assert dict(order.places(df, ["g"], [F.col("k")], fits=20).dtypes) == dict(order.places(df, ["g"], [F.col("k")]).dtypes)


def test_places_of_a_hot_group_are_found_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if k % 3 else None if k % 2 else f"g{k % 7}", int(rng.integers(0, 500)), k) for k in range(6000)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = order._ranged(df, ["g"], [F.col("v").desc(), F.col("k")])
        share = [r["count"] for r in ranged.groupBy("__part").count().collect()]
        assert len(share) == 4 and max(share) < 0.5 * len(rows)
        placed = {r.k: (r.place, r.total) for r in order.places(df, ["g"], [F.col("v").desc(), F.col("k")], total="total").collect()}
        sums = {r.k: (r.running, r.total) for r in order.running_sums(df, ["g"], [F.col("k")], "v").collect()}
        picks = {r.g: r.k for r in order.drawn(df, ["g"], "k", "v", F.lit(0.6)).collect()}
        assert order.places(df.limit(0), ["g"], [F.col("k")]).count() == 0
        assert sorted(r.place for r in order.places(df, [], [F.col("k")]).collect()) == list(range(6000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [placed[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]
        run, total = 0, sum(r[1] for r in own)
        pick = None
        for r in sorted(own, key=lambda r: r[2]):
            run += r[1]
            assert sums[r[2]] == (run, total)
            pick = r[2] if pick is None and run / total > 0.6 else pick
        assert picks[g] == pick


def test_loops_delete_their_steps(spark):
    with checkpoints.scope() as made:
        loop = checkpoints.Loop(spark)
        for k in range(4):
            last = loop.cut(spark.range(k + 1))
            loop.turn()
        loop.close()
        assert last.count() == 4 and len(made) == 1
        checkpoints.clean(spark, made)
        assert made == []


def test_chain_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    cells = [(q, o, f, int(rng.random() < 0.4)) for q in range(4) for o in range(5) for f in range(3)]
    config = Config(sweeps=7)
    got = {(r.question_id, r.factor): r.indicator for r in truth.gibbs(spark.createDataFrame(cells, "question_id int, owner_id int, factor int, obs int"), config).collect()}
    draws = np.random.default_rng(list(config.seed.encode()))
    factors = sorted({(q, f) for q, _, f, _ in cells})
    z = dict(zip(factors, draws.integers(0, 2, len(factors)).tolist(), strict=True))
    alpha = {(0, 0): 90, (0, 1): 10, (1, 0): 50, (1, 1): 50}
    for _ in range(config.sweeps):
        for at in factors:
            log = []
            for i in (0, 1):
                p = math.log(10)
                for q, o, f, x in cells:
                    if (q, f) == at:
                        n = [sum(1 for q2, o2, f2, x2 in cells if o2 == o and z[q2, f2] == i and x2 == y) for y in (0, 1)]
                        p += math.log((n[x] + alpha[i, x] - (z[at] == i)) / (sum(n) + alpha[i, 0] + alpha[i, 1]))
                log.append(p)
            odds = [math.exp(v - max(log)) for v in log]
            z[at] = 0 if draws.random() < odds[0] / sum(odds) else 1
    assert got == z
    with pytest.raises(ValueError):
        truth.gibbs(spark.createDataFrame(cells, "question_id int, owner_id int, factor int, obs int"), most=10)


def test_weightless_words_move_nothing(spark):
    rows = [(0, "a", 1, [1.0, 0.0]), (0, "b", 0, [0.6, 0.8]), (0, "c", 2, [0.0, 1.0]), (1, "d", 0, [1.0, 0.0])]
    words = spark.createDataFrame(rows, "question_id int, content string, n int, vec array<double>")
    start = clustering.initial_centers(words.withColumn("pos", F.col("content")), 2)
    found, centers = clustering.kmeans(words, start, max_iter=5)
    assert {r.content for r in found.collect()} == {"a", "b", "c", "d"}
    assert {tuple(r.mu) for r in centers.where("question_id = 0").collect()} == {(1.0, 0.0), (0.0, 1.0)}
    assert clustering.movmf(words.where("n > 0"), start.where("question_id = 0"), 5)[0].count() == 2


def test_default_path(spark, answers, model):
    found = discover(answers, model, corpus.stopwords(spark), Config(clusters=3, top_k=2, sweeps=2, max_iter=3))
    padded = discover(answers, model, corpus.stopwords(spark), Config(clusters=3, top_k=2, sweeps=2, max_iter=3), "padded")
    assert sorted(map(tuple, found.top.collect())) == sorted(map(tuple, padded.top.collect())) and found.top.count() > 0


def test_scores(spark, answers):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 0)], "question_id int, owner_id int, n_true long")
    scores = scoring.normalised_scores(counts)
    assert {(r.question_id, r.owner_id): r.score for r in scores.collect()} == {(0, 0): 0.75, (0, 1): 0.25, (0, 2): 0, (1, 0): 0, (1, 1): 0}
    assert {r.owner_id: r.trust for r in scoring.owner_trust(scores).collect()}[0] == 0.75
    top = scoring.top_answers(scores, 5)
    assert [(r.owner_id, r.rank) for r in top.where("question_id = 1").orderBy("rank").collect()] == [(0, 1), (1, 2)]
    smaller = {tuple(r) for r in scoring.top_answers(scores, 1).collect()}
    assert smaller <= {tuple(r) for r in top.collect()}
    grades = spark.createDataFrame([(0, 0, 4.0), (1, 0, 2.0)], "question_id int, owner_id int, score double")
    exams = corpus.exams(spark, (2, 1))
    exam = scoring.exam_of(scores, exams)
    got = scoring.exam_scores(top.drop("score"), grades, exam, 5).collect()
    assert [(r.exam_id, r.average) for r in got] == [(1, 6 / (5 * 2))]
    assert scoring.overall_score(top.drop("score"), grades, 5).first()[0] == 3
    assert scoring.most_answers(answers).first()[0] == 3


def test_discovery_modes_agree(spark, answers, model):
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "k int, mu array<double>")
    config = Config(clusters=3, top_k=2)
    run = lambda mode: discover(answers, model, corpus.stopwords(spark), config, mode, centers, "map", 2)
    plain, padded = run("plain"), run("padded")
    assert bag(plain.words) == bag(padded.words)
    assert sorted(map(tuple, plain.answer_scores.collect())) == sorted(map(tuple, padded.answer_scores.collect()))
    sums = plain.answer_scores.groupBy("question_id").agg(F.sum("score").alias("s")).collect()
    assert all(r.s == pytest.approx(1) or r.s == 0 for r in sums)
    assert plain.top.groupBy("question_id").count().agg(F.max("count")).first()[0] <= 2


def test_empty_answers(spark, answers, model):
    none = answers.limit(0)
    found = discover(none, model, corpus.stopwords(spark), Config(clusters=2), inference="map", sweeps=1)
    assert found.top.count() == 0 and found.truth.count() == 0
