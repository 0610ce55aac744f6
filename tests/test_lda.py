from math import lgamma

import numpy as np
import pytest
from pyspark.ml.clustering import LDA

from topicloom.operators import model as md
from topicloom.operators.lda import em, heldout, mllib, online
from topicloom.operators.lda import kernel as kn
from topicloom.operators.lda import meeting
from topicloom.operators.lda import sampler as sp
from topicloom.operators.lda.declarative import gibbs_sweep
from topicloom.operators.lda.mllib import fit_ml, minibatch_fraction, model_from_ml, train_perplexity
from topicloom.operators.lda.state import initial_state, topic_totals, word_topic_counts
from topicloom.session import scratch_path
from topicloom.sources.checkpoints import read_latest

V, K = 60, 3


@pytest.fixture(scope="module")
def planted(spark):
    """Documents over three disjoint blocks of 20 terms, mostly one block each."""
    rng = np.random.default_rng(1)
    rows = []
    for d in range(240):
        block = rng.choice(K, size=50, p=rng.dirichlet([0.1] * K))
        terms, tfs = np.unique(block * 20 + rng.integers(0, 20, 50), return_counts=True)
        rows.append((d, terms.tolist(), tfs.tolist()))
    schema = "doc_id long, term_ids array<int>, tfs array<int>"
    return spark.createDataFrame(rows, schema).cache()


def counts_of(state, k=K):
    return sp.block_counts(word_topic_counts(state), 0, V, k)


def topics_of(state):
    return {r.doc_id: r.z for r in state.collect()}


def test_uniforms():
    key, pos = np.arange(-500, 500).repeat(100), np.tile(np.arange(100), 1000)
    u = kn.uniforms(42, 3, 1, key, pos)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.005
    assert len(np.unique(u)) == len(u)
    assert abs(np.corrcoef(u, kn.uniforms(42, 4, 1, key, pos))[0, 1]) < 0.02
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.02
    assert (u[:7] == kn.uniforms(42, 3, 1, key[:7], pos[:7])).all()


@pytest.mark.parametrize("cutoff", [0, 4, 100])
def test_block_counts_keep_hot_and_tail_rows(cutoff):
    rng = np.random.default_rng(0)
    full = rng.integers(0, 3, (20, 5)) * rng.integers(1, 9, (20, 5))
    term, topic = np.nonzero(full)
    shuffled = rng.permutation(len(term))
    mine = shuffled[(term[shuffled] >= 2) & (term[shuffled] < 17)]
    c = kn.BlockCounts.build(2, 17, 5, cutoff, term[mine], topic[mine], full[term, topic][mine], full.sum(0))
    asked = rng.integers(2, 17, 40)
    table, row = c.rows(asked)
    assert (table[row] == full[asked]).all()


def slow_gibbs(words, z, keys, totals, nwk, s):
    """The frozen-count sweep token by token, for one group of terms at a time."""
    out = [list(x) for x in z]
    for group in range(s.groups):
        frozen = [list(x) for x in out]
        for d, doc in enumerate(words):
            ndk = np.bincount(frozen[d], minlength=s.k)
            for p, w in enumerate(doc):
                if w * s.groups // s.vocab_size != group:
                    continue
                own = np.arange(s.k) == frozen[d][p]
                weight = (ndk - own + s.alpha) * (nwk[w] - own + s.beta)
                weight = weight / (totals - own + s.vocab_size * s.beta)
                c = np.cumsum(weight)
                u = s.uniform(s.seed, 5, 0, np.array([keys[d]]), np.array([p]))[0]
                out[d][p] = int(np.argmax(c >= u * c[-1]))
    return out


@pytest.mark.parametrize("groups", [1, 4])
@pytest.mark.parametrize("chunk", [10, 400_000])
def test_gibbs_kernel_equals_token_by_token(monkeypatch, groups, chunk):
    monkeypatch.setattr(kn, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(kn, "CHUNK_CELLS", 10 * chunk)
    rng = np.random.default_rng(2)
    words = [sorted(rng.integers(0, 9, n).tolist()) for n in (1, 0, 30, 5, 12)]
    z = [rng.integers(0, 4, len(w)).tolist() for w in words]
    nwk = rng.integers(30, 60, (9, 4))
    term, topic = np.indices(nwk.shape).reshape(2, -1)
    counts = kn.BlockCounts.build(0, 9, 4, 3, term, topic, nwk.ravel(), nwk.sum(0).astype(float))
    s = kn.Settings(4, 0.5, 0.01, 9, groups=groups)
    keys = np.array([11, -3, 7, 2**62, 5])
    offsets = np.cumsum([0] + [len(w) for w in words])
    flat = [np.array(sum(x, [])) for x in (words, z)]
    got = kn.sweep_documents("naive", s, 5, counts, *flat, offsets, keys)
    assert got.tolist() == sum(slow_gibbs(words, z, keys, nwk.sum(0), nwk, s), [])


def test_mh_converges_to_the_full_conditional():
    n, k = 40_000, 4
    nwk = np.array([[50, 10, 30, 1], [5, 80, 5, 60]])
    term, topic = np.indices(nwk.shape).reshape(2, -1)
    totals = np.array([300.0, 500.0, 200.0, 400.0])
    counts = kn.BlockCounts.build(0, 1, k, 10, term[:4], topic[:4], nwk[0], totals)
    s = kn.Settings(k, 0.5, 0.01, 100, mh_steps=12)
    words, z = np.tile([0, 1, 1, 1, 1], n), np.tile([2, 0, 0, 1, 3], n)
    got = kn.sweep_documents("mh", s, 0, counts, words, z, np.arange(n + 1) * 5, np.arange(n))
    drawn = np.bincount(got[::5], minlength=k) / n
    own = np.arange(k) == 2
    p = (np.array([2, 1, 1, 1]) - own + 0.5) * (nwk[0] - own + 0.01) / (totals - own + 1.0)
    assert np.abs(drawn - p / p.sum()).max() < 0.01
    assert (got.reshape(n, 5)[:, 1:] == [0, 0, 1, 3]).all()


def test_declarative_sweep_equals_kernel(spark, planted):
    def md5_uniforms(seed, sweep, step, key, pos):
        import hashlib

        texts = [f"{seed}:{sweep}:{k}:{p}" for k, p in zip(key, pos, strict=True)]
        return np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) / 2**32 for t in texts])

    state = initial_state(planted, K).cache()
    rows = {(r.doc_id, r.pos): r.topic for r in gibbs_sweep(state, K, V, 0.5, 0.01, 42, 0).collect()}
    docs = state.orderBy("doc_id").collect()
    s = kn.Settings(K, 0.5, 0.01, V, groups=1, uniform=md5_uniforms)
    flat = [np.concatenate([r[c] for r in docs]) for c in ("words", "z")]
    offsets = np.cumsum([0] + [len(r.words) for r in docs])
    got = kn.sweep_documents("naive", s, 0, counts_of(state), *flat, offsets, np.array([r.doc_id for r in docs]))
    assert got.tolist() == [rows[r.doc_id, p] for r in docs for p in range(len(r.words))]


@pytest.mark.parametrize("method", ["mh", "naive"])
@pytest.mark.parametrize("block_size", [None, 25])
def test_training(spark, planted, method, block_size):
    args = dict(method=method, k=K, alpha=0.1, block_size=block_size)
    fitted = sp.fit_sampler(planted, V, iterations=3, **args)
    assert sum(r.n for r in fitted.totals.collect()) == 240 * 50
    other = sp.fit_sampler(planted.repartition(5), V, iterations=3, partitions=3, **args)
    assert topics_of(fitted.state) == topics_of(other.state)
    seeded = sp.fit_sampler(planted, V, iterations=1, seed=7, **args)
    assert topics_of(seeded.state) != topics_of(sp.fit_sampler(planted, V, iterations=1, **args).state)


@pytest.mark.parametrize("method", ["mh", "naive"])
def test_planted_topics_are_found(spark, planted, method):
    fitted = sp.fit_sampler(planted, V, method, K, 20, alpha=0.1)
    n = np.zeros((V, K))
    for r in fitted.word_topic.collect():
        n[r.term_id, r.topic] = r.n
    blocks = n.reshape(K, 20, K).sum(axis=1)
    assert sorted(blocks.argmax(axis=1)) == list(range(K))
    assert blocks.max(axis=1).sum() > 0.9 * n.sum()


def test_checkpoints_resume_exactly(spark, planted):
    saved = scratch_path(spark, "saved")
    whole = sp.fit_sampler(planted, V, "mh", K, 5)
    sp.fit_sampler(planted, V, "mh", K, 3, checkpoint_save=saved, checkpoint_every=2)
    assert read_latest(spark, saved)[0] == 3
    resumed = sp.fit_sampler(planted, V, "mh", K, 5, checkpoint_read=saved, checkpoint_save=saved)
    assert topics_of(resumed.state) == topics_of(whole.state)
    assert read_latest(spark, saved)[0] == 5
    assert read_latest(spark, scratch_path(spark, "none")) == (0, None)


def test_perplexity_falls_and_both_fold_ins_agree(spark, planted):
    terms = spark.range(V).selectExpr("cast(id as int) as term_id")
    values = []
    for sweeps in (0, 20):
        fitted = sp.fit_sampler(planted, V, "naive", K, sweeps, alpha=0.1)
        probs = md.topic_word_probs(fitted.word_topic, fitted.totals, terms, K, V, 0.01).cache()
        sums = {r.topic: r.s for r in probs.groupBy("topic").agg({"prob": "sum"}).withColumnRenamed("sum(prob)", "s").collect()}
        assert len(sums) == K and all(abs(s - 1) < 1e-9 for s in sums.values())
        values.append(md.heldout_perplexity(planted, probs, K, V, 0.1, 20))
    assert values[1] < 0.7 * values[0]
    near = md.heldout_likelihood(planted, probs, K, V, 0.1, 3).first()
    far = md.heldout_likelihood(planted, probs, K, V, 0.1, 3, budget=0).first()
    assert near.tokens == far.tokens == 240 * 50
    assert near.log_likelihood == pytest.approx(far.log_likelihood, rel=1e-9)


def test_a_large_phi_meets_documents_once(spark, planted, monkeypatch):
    """No row of the corpus carries a phi: one cogroup, in as many parts as the limit asks for."""
    probs = spark.range(V).selectExpr("cast(id as int) term_id", "explode(array(0, 1, 2)) topic")
    probs = probs.selectExpr("term_id", "topic", f"1.0D / {V} as prob")
    docs = planted.selectExpr("doc_id AS doc_key", "term_ids", "tfs")
    few = heldout._parts_that_fit(docs, K)[0]
    monkeypatch.setattr(heldout, "PHI_PART_BYTES", 58 * K * 8)
    parts, uses = heldout._parts_that_fit(docs, K)
    assert parts > few and uses.groupBy("part").count().agg({"count": "max"}).first()[0] <= 58
    scored = md.heldout_likelihood(planted, probs, K, V, 0.1, 2, budget=0)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "explode" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert scored.first().tokens == 240 * 50
    assert scored.first().log_likelihood == pytest.approx(240 * 50 * np.log(1 / V))


def particles_by_hand(words, key, phi, alpha, particles, moves, seed):
    """Left to right, a document, a particle and a token at a time."""
    k, total = phi.shape[1], 0.0
    z = [[] for _ in range(particles)]

    def u(sweep, step, pos):
        return float(kn.uniforms(seed, sweep, step, np.array([key]), np.array([pos]))[0])

    def draw(weights, step, pos):
        c = np.cumsum(weights)
        return min(int((c < u(0, step, pos) * c[-1]).sum()), k - 1)

    for n, w in enumerate(words):
        seen = 0.0
        for r in range(particles):
            for move in range(moves if n else 0):
                at = min(int(u(1, move, n) * n), n - 1)
                rest = np.bincount([t for i, t in enumerate(z[r]) if i != at], minlength=k)
                z[r][at] = draw(phi[words[at]] * (rest + alpha), 2 + move, r + particles * n)
            weights = phi[w] * (np.bincount(z[r], minlength=k) + alpha)
            seen += weights.sum() / (n + k * alpha) / particles
            z[r].append(draw(weights, 1, r + particles * n))
        total += np.log(seen)
    return total


@pytest.mark.parametrize("moves", [0, 3])
def test_left_to_right_equals_token_by_token(monkeypatch, moves):
    monkeypatch.setattr(heldout, "CHUNK_CELLS", 2 * 4 * 3)  # two documents at a time
    rng = np.random.default_rng(moves)
    phi = rng.dirichlet([0.3] * 9, 3).T
    rows = [rng.integers(0, 9, n) for n in (0, 1, 7, 30, 12)]
    keys = np.array([5, -9, 2**62, 3, 11])
    got = heldout.left_to_right(rows, keys, phi, 0.4, 4, moves, 42)
    want = [particles_by_hand(r.tolist(), int(key), phi, 0.4, 4, moves, 42) for r, key in zip(rows, keys)]
    assert np.allclose(got, want)


def test_left_to_right_estimates_the_probability():
    """With enough moves the mean is the sum over all assignments; few are a little too high."""
    from itertools import product
    from math import lgamma

    phi = np.array([[0.7, 0.1], [0.2, 0.3], [0.1, 0.6]])
    words, alpha = [0, 2, 0, 1], 0.5
    exact = 0.0
    for z in product(range(2), repeat=4):
        n = np.bincount(z, minlength=2)
        prior = lgamma(1.0) - lgamma(5.0) + sum(lgamma(x + alpha) - lgamma(alpha) for x in n)
        exact += np.exp(prior) * np.prod([phi[w, t] for w, t in zip(words, z)])
    docs, off = [np.array(words)] * 20_000, []
    for moves in (0, 3, 30):
        found = heldout.left_to_right(docs, np.arange(20_000), phi, alpha, 5, moves, 1)
        off.append(abs(np.exp(found).mean() / exact - 1))
    assert off[0] > off[1] > off[2] and off[0] < 0.1 and off[2] < 0.01


def test_left_to_right_on_tables(spark, planted):
    """Broadcast and joined agree, and a token is harder to foresee than to fit."""
    terms = spark.range(V).selectExpr("cast(id as int) as term_id")
    fitted = sp.fit_sampler(planted, V, "naive", K, 10, alpha=0.1)
    probs = md.topic_word_probs(fitted.word_topic, fitted.totals, terms, K, V, 0.01).cache()
    near = md.left_to_right_likelihood(planted, probs, K, V, 0.1, 3).first()
    far = md.left_to_right_likelihood(planted.repartition(3), probs, K, V, 0.1, 3, budget=0).first()
    assert near.tokens == far.tokens == 240 * 50
    assert near.log_likelihood == pytest.approx(far.log_likelihood, rel=1e-9)
    assert near.log_likelihood < md.heldout_likelihood(planted, probs, K, V, 0.1).first().log_likelihood
    empty = md.left_to_right_likelihood(planted.where("false"), probs, K, V, 0.1).first()
    assert empty.tokens is None


def test_expectation_maximisation(spark, planted):
    """Parts change nothing, the likelihood rises, planted topics are found."""
    one = em.fit_em(planted, V, K, 1)
    many = em.fit_em(planted.repartition(7), V, K, 25, 1.1, 1.01)
    assert many.likelihood > one.likelihood and many.tokens == 240 * 50
    n = np.zeros((V, K))
    for r in many.word_topic.collect():
        n[r.term_id, r.topic] = r.n
    assert n.sum() == pytest.approx(240 * 50)
    blocks = n.reshape(K, 20, K).sum(axis=1)
    assert sorted(blocks.argmax(axis=1)) == list(range(K)) and blocks.max(axis=1).sum() > 0.9 * n.sum()
    shares = {r.doc_id: sum(r.shares) for r in many.docs.collect()}
    assert len(shares) == 240 and all(s == pytest.approx(50) for s in shares.values())
    with pytest.raises(ValueError):
        em.fit_em(planted, V, K, 1, alpha=1.0)


def test_an_em_step_equals_numpy(spark, planted, monkeypatch):
    monkeypatch.setattr(meeting, "PART_TOKENS", 700)
    monkeypatch.setattr(em, "CHUNK_CELLS", 40)
    docs, word_topic = em.start(planted, K)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    model = np.zeros((V, K))
    for r in word_topic.collect():
        model[r.term_id, r.topic] = r.n
    new, total = np.zeros((V, K)), 0.0
    for r in rows:
        share = np.array(r.shares)
        p = (model[r.term_ids] + 0.01) / (model.sum(0) + V * 0.01) * (share + 0.5) / (share.sum() + K * 0.5)
        total += np.array(r.tfs) @ np.log(p.sum(1))
        np.add.at(new, r.term_ids, p / p.sum(1, keepdims=True) * np.array(r.tfs)[:, None])
    got = em.fit_em(planted, V, K, 1)
    assert got.likelihood == pytest.approx(total)
    for r in got.word_topic.collect():
        assert r.n == pytest.approx(new[r.term_id, r.topic])


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.5, 40.0])
    h = 1e-5
    slopes = [(lgamma(v + h * v) - lgamma(v - h * v)) / (2 * h * v) for v in x]
    assert np.allclose(online.digamma(x), slopes, rtol=1e-6)
    assert online.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)


def test_online_variational_bayes(spark, planted, monkeypatch):
    """Perplexity falls, parts change nothing, planted topics are found; no limit on cells."""
    values = []
    for iterations in (1, 20):
        model = online.fit_online(planted, V, K, iterations, 0.1, 0.01, fraction=0.5, tau=1.0, kappa=0.6)
        probs = online.topic_probs(model).cache()
        assert np.allclose([r[1] for r in probs.groupBy("topic").sum("prob").collect()], 1)
        values.append(md.heldout_perplexity(planted, probs, K, V, 0.1, 20))
    assert values[1] < 0.7 * values[0]
    found = np.zeros((V, K))
    for r in probs.collect():
        found[r.term_id, r.topic] = r.prob
    assert sorted(found.reshape(K, 20, K).sum(axis=1).argmax(axis=1)) == list(range(K))
    one = {r.term_id: r.lambdas for r in online.fit_online(planted, V, K, 2, fraction=0.5).lambdas.collect()}
    monkeypatch.setattr(meeting, "PART_TOKENS", 300)
    many = {r.term_id: r.lambdas for r in online.fit_online(planted.repartition(5), V, K, 2, fraction=0.5).lambdas.collect()}
    assert len(one) == V and all(np.allclose(one[t], many[t]) for t in one)
    assert online.fit_online(planted.where("false"), V, K, 1, fraction=1.0).lambdas.count() == V


def test_spark_ml_trainers(spark, planted):
    assert minibatch_fraction(planted, 100).first().fraction == pytest.approx(0.02 + 1 / 240)
    assert minibatch_fraction(planted, 1).first().fraction == 1.0
    for method in ("sparkem", "sparkonline"):
        fitted = fit_ml(planted, V, method, K, 10)
        probs = model_from_ml(fitted)
        sums = [r[1] for r in probs.groupBy("topic").sum("prob").collect()]
        assert probs.count() == V * K and np.allclose(sums, 1)
        measured = train_perplexity(fitted)
        assert measured["train_tokens"] == 240 * 50 and measured["train_perplexity"] > 1
        assert md.heldout_perplexity(planted, probs, K, V, 0.5, 20) < V


def test_spark_em_in_small_tasks_without_going_back(planted, monkeypatch):
    """As Spark's own loop gives it, in tasks of a bounded number of pairs; edges are made once."""
    monkeypatch.setattr(mllib, "EM_TASK_PAIRS", 300)
    pairs = planted.selectExpr("sum(size(term_ids))").first()[0]
    lineages = []
    for iterations in (2, 12):
        fitted = fit_ml(planted.coalesce(1), V, "sparkem", K, iterations)
        edges = fitted.model._java_obj.getModel().graph().edges()
        assert edges.count() == pairs and edges.getNumPartitions() == -(-pairs // 300)
        lineages.append(edges.toDebugString().count("RDD["))
        own = LDA(
            k=K, maxIter=iterations, seed=42, docConcentration=[1.5], topicConcentration=1.01, optimizer="em"
        ).fit(mllib.em_tasks(fitted.features))
        assert np.allclose(fitted.model.topicsMatrix().toArray(), own.topicsMatrix().toArray())
        assert fitted.model.trainingLogLikelihood() == pytest.approx(own.trainingLogLikelihood())
        assert fitted.model.getK() == K and fitted.model.toLocal().describeTopics(2).count() == K
    assert lineages[0] == lineages[1]


@pytest.mark.parametrize("bad", [dict(method="x"), dict(k=0), dict(alpha=0), dict(mh_steps=0)])
def test_bad_arguments(planted, bad):
    with pytest.raises(ValueError):
        sp.fit_sampler(planted, V, **bad)


def test_power_law_cutoff():
    assert sp.power_law_cutoff(30) == 66_666


@pytest.mark.parametrize("method", ["mh", "naive"])
@pytest.mark.parametrize("block_size", [None, 25])
def test_counts_that_meet_documents_change_nothing(spark, planted, monkeypatch, method, block_size):
    """Broadcast or joined, in few or many parts, with dense rows or without: the same draws."""
    args = dict(method=method, k=K, iterations=2, block_size=block_size)
    whole = topics_of(sp.fit_sampler(planted, V, **args).state)
    assert topics_of(sp.fit_sampler(planted, V, **args, model_bytes=0).state) == whole
    monkeypatch.setattr(meeting, "PART_TOKENS", 500)
    monkeypatch.setattr(sp, "POWER_LAW_CELLS", 20 * K)
    assert topics_of(sp.fit_sampler(planted, V, **args, model_bytes=0).state) == whole


def test_a_joined_sweep_moves_no_model_with_the_corpus(spark, planted):
    """One read of the state; the rows of its parts come by a join on the term."""
    state = initial_state(planted, K).cache()
    table = word_topic_counts(state)
    uses = meeting.term_uses(state, "doc_key", "words", 5)
    assert uses.groupBy("term_id").count().agg({"count": "max"}).first()[0] <= 5
    s = kn.Settings(K, 0.5, 0.01, V)
    swept = sp.sample_block_met(state, uses, 5, table, sp.total_counts(table, K), 0, V, "mh", s, 0)
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert swept.columns == state.columns and "FlatMapCoGroupsInArrow" in plan
    assert swept.count() == 240


def test_alias_tables_give_the_weights_back():
    rng = np.random.default_rng(0)
    lengths = np.concatenate([[0, 1, 2, 500], rng.integers(0, 30, 200)])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    weights = rng.gamma(0.3, 1, starts[-1]) + 1e-9
    share, other, mass = kn.alias_tables(starts, weights)
    given = np.zeros(len(weights))
    np.add.at(given, np.arange(len(weights)), share)
    np.add.at(given, other, 1 - share)
    row = np.repeat(np.arange(len(lengths)), lengths)
    assert np.allclose(given * mass[row] / lengths[row], weights)
    assert (row[other] == row).all() and share.min() >= 0 and share.max() <= 1


def test_word_proposals_follow_their_density():
    """Chi-square of sparse draws against (count + beta) / (total + V beta)."""
    rng = np.random.default_rng(4)
    k, rows, n = 50, 4, 200_000
    full = rng.integers(1, 40, (rows, k)) * (rng.random((rows, k)) < 0.2)
    totals = full.sum(0) + rng.integers(50, 900, k).astype(float)
    term, topic = np.nonzero(full)
    s = kn.Settings(k, 0.5, 0.3, 100)
    counts = kn.BlockCounts.build(0, rows, k, 0, term, topic, full[term, topic], totals).prepare(s)
    for row in range(rows):
        drawn = np.bincount(counts.propose(np.full(n, row), rng.random(n)), minlength=k)
        q = (full[row] + 0.3) / (totals + 30)
        want = n * q / q.sum()
        assert ((drawn - want) ** 2 / want).sum() < 49 + 5 * np.sqrt(2 * 49)
    pairs = rng.integers(0, rows, 500), rng.integers(0, k, 500)
    assert (counts.at(*pairs) == full[pairs]).all()


def test_a_checkpoint_of_other_settings_is_refused(spark, planted, tmp_path):
    sp.fit_sampler(planted, V, "mh", K, 1, checkpoint_save=str(tmp_path / "c"))
    with pytest.raises(ValueError, match="seed"):
        sp.fit_sampler(planted, V, "mh", K, 2, seed=7, checkpoint_read=str(tmp_path / "c"))


def test_counts_of_state(spark, planted):
    counts = word_topic_counts(initial_state(planted, K))
    assert {r.topic for r in topic_totals(counts).collect()} == set(range(K))


def test_documents_side_by_side_fit_as_alone(monkeypatch):
    """Folding in and the online step, over blocks of any size, empty documents and one that settles early."""
    rng = np.random.default_rng(3)
    size = np.array([0, 4, 0, 30, 1, 17, 0])
    offsets = np.concatenate([[0], np.cumsum(size)])
    terms, tfs, phi = rng.integers(0, 40, 52), rng.integers(1, 6, 52).astype(float), rng.random((40, 3)) + 0.01
    full = [slice(a, b) for a, b in zip(offsets, offsets[1:]) if b > a]
    want = sum(heldout.fold_in(tfs[o], phi[terms[o]], 0.5, 9)[0] for o in full)
    for cells in (1, 60, 10**6):
        monkeypatch.setattr(heldout, "FOLD_CELLS", cells)
        assert heldout.fold_in_all(terms, tfs, offsets, lambda t: phi[t], 0.5, 9) == pytest.approx(want, rel=1e-12)
    assert heldout.fold_in_all(terms[:0], tfs[:0], np.array([0, 0]), lambda t: phi[t], 0.5, 9) == 0
    for rounds, enough in ((3, 0.0), (100, 1e-2)):
        share, norm = online.fit_documents(tfs, np.unique(offsets), phi[terms], 0.5, rounds, enough)
        for at, own in enumerate(full):
            one, its = online.fit_document(tfs[own], phi[terms[own]], 0.5, rounds, enough)
            assert np.allclose(share[at], one, rtol=1e-12) and np.allclose(norm[own], its, rtol=1e-12)


def test_em_starts_where_the_documents_are(spark, planted):
    """Shares and counts come from one pass over the vectors, without a join or a shuffle."""
    docs, _ = em.start(planted, K)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = docs.collect()
    assert len(rows) == planted.count()
    assert all(len(r.shares) == K and sum(r.shares) == sum(r.tfs) for r in rows)
