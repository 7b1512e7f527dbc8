"""The corpus operators: against SQL on the driver's tables, against brute force, and on odd inputs."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import catalogue
from lexigraph.llm.common import table
from tests.oracle import connect, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    same_rows(spark, sf_dir, con, catalogue.QUERIES[name], catalogue.SQL[name])


# Odd inputs: null columns, empty and long texts, repeated rows, ties, clashing names, empty tables.

LONG = "lorem ipsum dolor sit amet " * 3000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 1), (3, LONG, "en", "a", 1), (None, "the cat sat on the mat and looked at the moon again", "en", None, 5), (None, None, None, "b", None),
    (4, "one line\nshared line of words\n\n  ", "xx", "b", 1), (5, "\n\n", None, "c", 2), (6, "x" * 20_000, "en", "c", 2), (7, "shared line of words\nother words here", "en", "c", 3), (7, "a different text with the same id", "en", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


def operators(spark):
    from lexigraph.llm import contamination, language, lines, lm_score, mixing, near_dup, quality, toxicity

    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the moon again"), (2, None), (None, "one line"), (3, "dolor sit")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (4, None), (7, 0), (6, 0)], "doc_id long, toxic int")

    def lm(d):
        v = lm_score.fit_vocabulary(d)
        return lm_score.score_documents(d, v, lm_score.fit_network(d, v))

    return {
        "lines": (lambda d: lines.line_dedup(d, min_sites=2), ["n_lines", "n_removed"]),
        "contamination": (lambda d: contamination.decontaminate(d, items, slop=20), ["n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated", "near_items"]),
        "lm": (lm, ["lm_words", "lm_logprob", "lm_mean"]),
        "toxicity": (lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)), ["score", "predicted"]),
        "quality": (lambda d: quality.host_line_filter(d, max_docs=1), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "clean_text"]),
        "mixing": (mixing.mix_sources, ["size", "source_size", "target", "taken"]),
        "language": (lambda d: language.identify_language(d, language.fit_language_model(d)), ["lang_pred", "score"]),
        "near_dup": (near_dup.near_classes, None),
    }


NAMES = ["lines", "contamination", "lm", "toxicity", "quality", "mixing", "language", "near_dup"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    op, _ = operators(spark)[name]
    got = op(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name):
    assert operators(spark)[name][0](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n != "near_dup"])
def test_clashing_columns(spark, odd, name):
    op, new = operators(spark)[name]
    clash = odd.withColumns({c: F.lit("old") for c in [*new, "line", "at", "w", "pos", "term", "win", "n", "id", "root", "words"]})
    got = op(clash)
    assert len(got.columns) == len(set(got.columns)) and got.count() == len(ODD)
    assert all(r[new[0]] != "old" for r in got.collect())
    assert all(r["line"] == "old" for r in got.select("line").collect())


# Line dedup.


def test_lines(spark):
    from lexigraph.llm.lines import boilerplate_lines, line_dedup

    d = spark.createDataFrame([(i, f"own {i}\n  Common   LINE \nown {i}\n\n", "en", f"s{i % 4}", 0) for i in range(20)], DOCS)
    got = line_dedup(d, min_sites=4).orderBy("doc_id").collect()
    assert got[3]["text"] == "own 3\nown 3\n\n" and (got[3]["n_lines"], got[3]["n_removed"]) == (3, 1)
    assert line_dedup(d, min_sites=5).where("n_removed > 0").count() == 0
    assert line_dedup(d, min_sites=4, max_share=0.1).where("n_removed > 0").count() == 0
    many = spark.range(4000).select((F.col("id") % 7).alias("line"), (F.col("id") % 400).cast("string").alias("site"))
    assert boilerplate_lines(many, 400).count() == boilerplate_lines(many, 390).count() == 7 and boilerplate_lines(many, 401).count() == 0


# Decontamination.


def test_contamination_brute_force(spark, sf_dir):
    from lexigraph.llm import contamination as C

    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in C.decontaminate(d, b).collect()}
    cut = lambda t: re.findall(C.TOKEN, (t or "").translate(str.maketrans(C.UPPER, C.LOWER)))
    wins: dict = {}
    for r in b.collect():
        w = cut(r["text"])
        for i in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(r["item_id"]))
    for r in d.collect():
        w, hit, ids = cut(r["text"]), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= found
        assert got[r["doc_id"]] == (len(hit), sorted(ids))


def test_intersection_decides(spark):
    """Texts that hold a window's rarest words at their places, and its other words elsewhere, are no matches."""
    from lexigraph.llm import contamination as C

    window = [f"w{i}" for i in range(10)]
    items = spark.createDataFrame([(1, " ".join(window))], "item_id long, text string")
    rows = [(1, " ".join(window)), (2, " ".join(window[:9] + ["x"] + window[9:])), (3, " ".join([*window[:2], *window[:1:-1]])), (4, " ".join(window[:5] * 4))]
    rows += [(5 + i, " ".join(w for w in window[2:] for _ in range(3))) for i in range(5)]  # w0 and w1 are the rarest
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__doc", F.col("doc_id"))
    index = C.token_index(d)
    windows, held = C.benchmark_windows(items)
    ranked = C.ranked_terms(windows, index)
    anchors = C.anchor_postings(index, ranked)
    assert {r["term"] for r in ranked.where("rank < 2").collect()} == {"w0", "w1"} and ranked.count() == 10 and held.count() == 1
    assert {r["__doc"] for r in anchors.where("start = 0").collect()} == {1, 2, 3, 4}
    assert [(r["__doc"], r["start"]) for r in C.phrase_matches(index, ranked, anchors).collect()] == [(1, 0)]
    assert {r["__doc"] for r in C.proximity_matches(index, ranked, anchors, 20).collect()} == {1, 2, 3}
    assert {r["__doc"] for r in C.proximity_matches(index, ranked, anchors, 9).collect()} == {1, 3}


def test_proximity(spark):
    from lexigraph.llm import contamination as C

    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "zeta eta theta iota"), (4, "beta gamma delta"), (5, "omega")], "item_id long, text string")
    d = spark.createDataFrame([(1, "gamma x alpha y beta"), (2, "alpha beta gamma delta epsilon omega"), (3, "alpha " + "x " * 50 + "beta gamma")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.decontaminate(d, items, slop=5).collect()}
    assert got[1]["n_hit"] == 0 and got[1]["near_items"] == ["1"]
    assert got[2]["item_ids"] == got[2]["near_items"] == ["1", "2", "4", "5"] and got[2]["n_hit"] == got[2]["n_words"] == 6
    assert got[3]["near_items"] == []


# LM scoring.


def plain_log_prob(net, v, near, target):
    """The logarithm of the chance of an id between its neighbours, step by step in plain Python."""
    x = [float(f) for i in near for f in net.rows["e"][i]] + [1.0]
    h = [math.tanh(sum(a * float(w) for a, w in zip(x, column, strict=True))) for column in net.rows["h"].T] + [1.0]
    total = 0.0
    for first, nodes, turns in (v.near_root, v.low):
        for at in range(first[target], first[target + 1]):
            total -= math.log1p(math.exp(-turns[at] * sum(a * float(w) for a, w in zip(h, net.rows["o"][nodes[at]], strict=True))))
    return total


def test_lm_brute_force(spark, monkeypatch):
    """Scores of whole texts against plain Python, with words held by name and words known by their count only."""
    from lexigraph.llm import lm_score as L

    for name, value in {"KNOWN": 20, "KNOWN_RATE": 1, "CHUNK": 7, "CACHE": 50, "TOP": 8}.items():
        monkeypatch.setattr(L, name, value)
    rows = [(i, " ".join(f"w{k}a{'bcd'[k % 3]}" for k in range(120) if i % (k // 10 + 1) == 0)) for i in range(60)]
    rows += [(60, "w119ad w55ac w119ad"), (61, "w119ad w55ac w119ad"), (62, "New w3ab"), (62, "New w3ab"), (63, None), (64, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    v = L.fit_vocabulary(d)
    net = L.fit_network(d, v)
    count: dict = {}
    for _, text in rows:
        for w in L.words_in(text):
            count[w] = count.get(w, 0) + 1
    assert list(v.ids) == sorted(count, key=lambda w: (-count[w], w))[:20]
    mass: dict = {}
    for w, n in count.items():
        if w not in v.ids:
            mass[L.group_of(w)] = mass.get(L.group_of(w), 0) + n
    text_of = dict(rows)
    got = L.score_documents(d, v, net).collect()
    for r in got:
        words = L.words_in(text_of[r["doc_id"]])
        ids = [v.ids.get(w, len(v.ids) + L.group_of(w)) for w in words]
        around = [v.size, v.size, *ids, v.size, v.size]
        want = sum(plain_log_prob(net, v, [*around[i : i + 2], *around[i + 3 : i + 5]], k) for i, k in enumerate(ids))
        want += sum(math.log(count[w] / mass[L.group_of(w)]) for w in words if w not in v.ids)
        assert r["lm_words"] == len(words) and math.isclose(r["lm_logprob"], want, rel_tol=1e-4, abs_tol=1e-9)
    assert len(got) == len(rows)
    again = L.fit_network(d, v)
    assert all(np.array_equal(net.rows[k], again.rows[k]) for k in net.rows)


def test_lm_probabilities_add_up(spark, sf_dir):
    from lexigraph.llm import lm_score as L

    d = table(spark, sf_dir, "documents")
    v = L.fit_vocabulary(d)
    net = L.fit_network(d, v)
    near = np.tile(np.random.default_rng(0).integers(0, v.size + 1, (1, 2 * L.SIDES)), (v.size, 1))
    assert math.isclose(np.exp(net.log_probs(near, np.arange(v.size))).sum(), 1, rel_tol=1e-4)
    mean = lambda n: L.score_documents(d, v, n).agg(F.sum("lm_logprob") / F.sum("lm_words")).first()[0]
    plain = L.Network(v)
    plain.rows["o"][:, :-1] = 0
    # Without training the words' own frequencies, with it better than any model that doesn't see the neighbours.
    n = {r["word"]: r["n"] for r in L.word_counts(d).collect()}
    total = sum(n.values())
    own = sum(c / total * math.log(c / total) for c in n.values())
    assert math.isclose(mean(plain), own, rel_tol=5e-3) and mean(net) > own


def test_lm_twice_is_likelier(spark, sf_dir):
    """Texts of new words that the corpus holds twice are told from such that it holds once."""
    from lexigraph.llm import lm_score as L

    rng = np.random.default_rng(4)
    text = lambda: " ".join("".join(rng.choice(list("bdfgklmprst"), 7)) for _ in range(80))
    once, twice = [(10_000 + i, text()) for i in range(20)], [(20_000 + i, text()) for i in range(20)]
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([*once, *twice, *((i + 10_000, t) for i, t in twice)], "doc_id long, text string"))
    v = L.fit_vocabulary(d)
    got = {r["doc_id"]: r["lm_mean"] for r in L.score_documents(d, v, L.fit_network(d, v)).where("doc_id >= 10000").collect()}
    assert max(got[i] for i, _ in once) < min(got[i] for i, _ in twice)


def test_lm_gradients():
    from lexigraph.llm import lm_score as L

    rng = np.random.default_rng(1)
    v = L.Vocabulary({f"w{i}": i for i in range(300)}, np.zeros(L.LEAVES), *L.tree_ways([*range(300, 0, -1), *[1] * L.LEAVES]))
    net = L.Network(v)
    net.rows["o"] += rng.normal(0, 0.1, net.rows["o"].shape).astype(np.float32)
    near, target = rng.integers(0, v.size + 1, (60, 2 * L.SIDES)), rng.integers(0, v.size, 60)
    found = net.gradients(near, target)
    net.rows = {k: w.astype(np.float64) for k, w in net.rows.items()}
    for k, (rows, times, slopes) in found.items():
        assert len(np.unique(rows)) == len(rows) and (times > 0).all()
        for at in rng.choice(len(rows), 12):
            column, loss = int(rng.integers(slopes.shape[1])), []
            for side in (1e-4, -2e-4):
                net.rows[k][rows[at], column] += side
                loss.append(-net.log_probs(near, target).mean())
            net.rows[k][rows[at], column] += 1e-4
            assert math.isclose((loss[0] - loss[1]) / 2e-4, slopes[at, column], rel_tol=2e-3, abs_tol=2e-6)


def lm_sample(words):
    from lexigraph.llm import lm_score as L

    rng = np.random.default_rng(3)
    counts = [*(60_000 // k for k in range(1, 2001)), *[9] * L.LEAVES]
    net = L.Network(L.Vocabulary({f"w{i}": i for i in range(2000)}, np.zeros(L.LEAVES), *L.tree_ways(counts)))
    net.rows["o"] += rng.normal(0, 0.1, net.rows["o"].shape).astype(np.float32)
    return net, rng.integers(0, net.words.size + 1, (words, 2 * L.SIDES)), rng.choice(len(counts), words, p=np.array(counts) / sum(counts))


def test_lm_slopes_step_by_step():
    """All slopes, uses and probabilities against a walk of every word's way, decision by decision, and of every neighbour."""
    net, near, target = lm_sample(400)
    h = np.concatenate([np.tanh(np.concatenate([net.rows["e"][near].reshape(len(near), -1), np.ones((len(near), 1))], axis=1) @ net.rows["h"]), np.ones((len(near), 1))], axis=1)
    want = {k: np.zeros(net.rows[k].shape) for k in "eho"}
    uses = {k: np.zeros(len(net.rows[k]), dtype=int) for k in "eho"}
    for i, t in enumerate(target):
        back, log = np.zeros(h.shape[1]), 0.0
        for first, nodes, turns in (net.words.near_root, net.words.low):
            for at in range(first[t], first[t + 1]):
                z = turns[at] * (h[i] @ net.rows["o"][nodes[at]])
                slope, log = -turns[at] / (1 + math.exp(z)) / len(target), log - math.log1p(math.exp(-z))
                want["o"][nodes[at]] += slope * h[i]
                uses["o"][nodes[at]] += 1
                back += slope * net.rows["o"][nodes[at]]
        assert math.isclose(net.log_probs(near[i : i + 1], target[i : i + 1])[0], log, rel_tol=1e-5) and math.isclose(net.log_probs(near, target)[i], log, rel_tol=1e-5)
        back = back[:-1] * (1 - h[i, :-1] ** 2)
        want["h"] += np.outer([*net.rows["e"][near[i]].ravel(), 1], back)
        uses["h"] += 1
        for word, slope in zip(near[i], (net.rows["h"][:-1] @ back).reshape(near.shape[1], -1), strict=True):
            want["e"][word] += slope
            uses["e"][word] += 1
    for k, (rows, times, slopes) in net.gradients(near, target).items():
        assert sorted(rows) == np.flatnonzero(uses[k]).tolist() and (uses[k][rows] == times).all()
        assert np.allclose(slopes, want[k][rows], rtol=1e-4, atol=1e-7)


def test_lm_work_of_a_word():
    """A step's tables hold the decisions on the words' ways, not those near the root for every word."""
    import tracemalloc

    net, near, target = lm_sample(4096)
    tracemalloc.start()
    net.gradients(near, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(target) < 1600


def test_lm_texts_read_once(spark, monkeypatch):
    """Training and scoring go over stored ids; texts aren't asked again, and repeated, null and empty ones score as from the texts."""
    from lexigraph.llm import lm_score as L

    monkeypatch.setattr(L, "KNOWN", 20)
    monkeypatch.setattr(L, "KNOWN_RATE", 1)
    rows = [(i, " ".join(f"w{k}a{'bcd'[k % 3]}" for k in range(120) if i % (k // 10 + 1) == 0)) for i in range(30)]
    d = spark.createDataFrame([*rows, rows[1], (None, rows[2][1]), (62, None), (63, " ")], "doc_id long, text string")
    v = L.fit_vocabulary(d)
    ids = L.stored_ids(d, v, "text")
    net = L.fit_network(ids, v)
    assert "text" not in ids.columns and net.rows["e"].any()
    got, want = (sorted((str(r["doc_id"]), r["lm_words"], round(r["lm_logprob"], 6)) for r in L.score_documents(x, v, net).collect()) for x in (ids, d))
    assert got == want and len(got) == d.count()


# Toxicity.


def test_toxicity_held_out(spark):
    from lexigraph.llm import toxicity as X

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        text = list(rng.choice(words, 60))
        for _ in range(3 * toxic):
            text.insert(int(rng.integers(60)), "zorgh" + "".join(rng.choice(list("abcd"), 3)))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for known in (lab.where("doc_id % 3 > 1"), lab.where("doc_id % 3 > 1 and toxic = 1"), lab.where("doc_id % 3 > 0").unionByName(lab.where("doc_id = 8"))):  # labels of clean texts don't count
        model = X.fit_toxicity(d.where("doc_id % 3 > 0"), known)
        got = X.score_toxicity(d.where("doc_id % 3 = 0"), model).join(lab, "doc_id").collect()
        assert sum(r["predicted"] == r["toxic"] for r in got) > 0.97 * len(got)
    assert X.train_nnpu([], [], 0.1).weights.sum() == 0


def test_toxicity_query(spark, sf_dir):
    got = catalogue.QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in table(spark, sf_dir, "documents").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_toxicity_risk():
    """The risk against its definition, its slopes against differences, and the prior of samples with known shares."""
    from lexigraph.llm import toxicity as X

    rng = np.random.default_rng(2)
    zp, zu, loss = rng.normal(1, 1, 30), rng.normal(-1, 1, 50), lambda z: math.log(1 + math.exp(-z))
    for prior, shift in ((0.2, 0), (0.9, -3)):  # the second makes the estimate of the clean part negative
        u = zu + shift
        as_clean = sum(loss(-z) for z in u) / 50 - prior * sum(loss(-z) for z in zp) / 30
        assert np.allclose(X.risk(zp, u, prior), (prior * sum(map(loss, zp)) / 30, as_clean)) and (as_clean < 0) == (shift < 0)
        value = (lambda p, w, prior=prior: -X.risk(p, w, prior)[1]) if shift else (lambda p, w, prior=prior: sum(X.risk(p, w, prior)))
        for slopes, at in zip(X.risk_slopes(zp, u, prior), (0, 1), strict=True):
            for i in (0, 7, 29):
                step = [np.zeros(30), np.zeros(50)]
                step[at][i] = 1e-5
                assert math.isclose((value(zp + step[0], u + step[1]) - value(zp - step[0], u - step[1])) / 2e-5, slopes[i], rel_tol=1e-5, abs_tol=1e-9)
    for share in (0.05, 0.2, 0.5):
        mixed = np.where(rng.random(8000) < share, rng.normal(3, 1, 8000), rng.normal(0, 1, 8000))
        assert abs(X.best_bin(rng.normal(3, 1, 4000), mixed) - share) < 0.05


# Quality rules.


def test_quality_brute_force(spark, sf_dir):
    from lexigraph.llm import quality as Q

    d = table(spark, sf_dir, "documents").unionByName(spark.createDataFrame([(-1, "a b c d e f g h i\n" * 7 + "x a b c d e f g h", "en", "s", 1)], DOCS))
    for r in Q.host_line_filter(d).collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        wins: dict = {}
        for i in range(len(w) - 7):
            wins.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(hit))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_depleted_documents(spark):
    from lexigraph.llm.quality import host_line_filter

    same = "the very same words stand in every one of these documents of the one host and nothing else is in them at all now"
    d = spark.createDataFrame([(i, same + (f"\nbut this one has {i} " + " ".join(f"w{i}x{k}" for k in range(60)) if i % 2 else ""), "en", "h" if i < 30 else "g", 0) for i in range(33)], DOCS)
    got = {r["doc_id"]: r for r in host_line_filter(d).collect()}
    assert not got[2]["kept"] and got[2]["clean_text"] == "" and got[3]["kept"] and got[3]["clean_text"].startswith("but this") and got[32]["kept"]


# URL filters.


def test_url_intervals(spark):
    from lexigraph.llm.urls import judge_urls

    e = spark.createDataFrame([("l", "bad.example", "block", "2024-01-10"), ("l", "bad.example", "allow", "2024-02-10"), ("l", "bad.example/ok", "allow", "2024-01-01"), ("m", "example", "block", "2023-01-01"), ("l", None, "block", "2024-01-01"), ("l", "x.org", "block", None)], "list_name string, pattern string, action string, listed_at string").withColumn("listed_at", F.to_timestamp("listed_at"))
    u = [("http://bad.example/a", "2024-01-09"), ("http://bad.example/a", "2024-01-10"), ("http://u@WWW.bad.example:80/a", "2024-02-09"), ("http://bad.example/ok?x", "2024-01-20"), ("http://bad.example/a", "2024-02-10"), (None, "2024-01-20"), ("http://bad.example/a", None), ("no url", "2024-01-20"), ("http://bad.example/a", "2024-01-10")]
    c = spark.createDataFrame(u, "url string, at string").withColumn("fetched_at", F.to_timestamp("at")).withColumn("verdict", F.lit("old"))
    got = sorted((str(r["url"]), str(r["at"]), r["verdict"]) for r in judge_urls(c, e).collect())
    want = ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got == sorted((str(a), str(b), v) for (a, b), v in zip(u, want, strict=True))
    assert judge_urls(c, e.limit(0)).where("verdict = 'block'").count() == 0 and judge_urls(c.limit(0), e).count() == 0
    clash = judge_urls(c.withColumns({"list_name": F.lit("old"), "pattern": F.lit("old"), "salt": F.lit("x"), "entry": F.lit("y"), "list": F.lit("z")}), e)
    assert sorted(r["verdict"] for r in clash.collect()) == sorted(want) and clash.where("salt <> 'x' or entry <> 'y' or list <> 'z' or pattern = 'old'").count() == 0


def test_hosts(spark):
    from lexigraph.llm.urls import host_of, patterns_of

    urls = ["http://Bad.Example./x", "https://[::1]:80/y", "http://u:p@10.0.0.1:8080/", "ftp://a.b.c", "mailto:x@y", "http://" + "a." * 5000 + "org/" + "z" * 100_000, None]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [(r["h"], [p["pattern"] for p in r["p"]]) for r in d.orderBy("i").select(host_of(F.col("url")).alias("h"), patterns_of(F.col("url")).alias("p")).collect()]
    assert got[:5] == [("bad.example", ["bad.example/x", "bad.example"]), ("[::1]", ["[::1]/y", "[::1]"]), ("10.0.0.1", ["10.0.0.1"]), ("a.b.c", ["a.b.c", "b.c"]), ("", [])]
    assert len(got[5][0]) == 10_003 and got[5][1][-1] == "a.org" and got[6] == ("", [])


def test_url_hot_patterns(spark, monkeypatch):
    """Captures of a hot pattern are dealt over parts and judged as a plain loop judges them."""
    from lexigraph.llm import urls as U

    monkeypatch.setattr(U, "HOT_SHARE", 3)
    rng = np.random.default_rng(3)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    entries = sorted({(f"l{rng.integers(3)}", ["hot.org", "x.org", "www.x.org"][rng.integers(3)], ["allow", "block"][rng.integers(2)], day(int(rng.integers(200)))) for _ in range(60)})
    captures = [(f"http://{['hot', 'hot', 'hot', 'x', 'www.x', 'free'][rng.integers(6)]}.org/{i}", day(int(rng.integers(220)))) for i in range(400)]

    def judged(url, at):
        host = url.split("/")[2]
        for pattern in [host] + ([host.split(".", 1)[1]] if host.count(".") > 1 else []):
            last = {}
            for name, _, action, since in sorted((e for e in entries if e[1] == pattern and e[3] <= at), key=lambda e: (e[3], e[2])):
                last[name] = action
            if last:
                name = min(last, key=lambda x: (last[x] != "block", x))
                return last[name], name, pattern
        return "allow", None, None

    c = spark.createDataFrame(captures, "url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    e = spark.createDataFrame(entries, "list_name string, pattern string, action string, listed_at string").withColumn("listed_at", F.to_timestamp("listed_at"))
    got = {(r["url"], r["at"]): (r["verdict"], r["list_name"], r["pattern"]) for r in U.judge_urls(c, e).collect()}
    assert got == {x: judged(*x) for x in captures} and len({v for v in got.values()}) > 4


# Mixing.


def test_mixing_budgets(spark, sf_dir):
    from lexigraph.llm.mixing import mix_sources, repeated

    m = mix_sources(table(spark, sf_dir, "documents")).cache()
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert r["t"] == math.floor(r["target"] + 1e-9) or abs(r["t"] - r["target"]) < 1.01
        assert r["over"] <= 0
    assert math.isclose(m.groupBy("source").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0], m.agg(F.sum("size")).first()[0], rel_tol=1e-9)
    assert repeated(m).agg(F.sum("take")).first()[0] == m.agg(F.sum("taken")).first()[0]


@pytest.mark.parametrize("sizes", [[5, 100, 1000], [1000, 1, 1], [0, 10], [7], [3, 3, 3, 3, 3000]])
def test_targets_by_resharing(spark, sizes):
    from lexigraph.llm.mixing import source_targets

    w = [1 + i % 3 for i in range(len(sizes))]
    total, fixed = sum(sizes), {}
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * w[i] / sum(w[k] for k in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            break
        fixed |= {i: 3 * sizes[i] for i in over}
    want = fixed | share
    got = source_targets(spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long"))
    for r in got.collect():
        assert math.isclose(r["target"], want[int(r["source"][1:])], rel_tol=1e-9, abs_tol=1e-9)


# Language.


def test_forward_sums_all_segmentations():
    from lexigraph.llm.language import MARK, Segmenter

    pieces = [MARK, MARK + "a", "a", "b", "ab", "ba", MARK + "ab", "bab"]
    probs = np.random.default_rng(2).random((len(pieces) + 1, 2))
    cut = Segmenter(pieces)

    def brute(word):
        text, total = MARK + word, np.zeros(2)
        for k in range(len(text)):
            for bars in itertools.combinations(range(1, len(text)), k):
                parts = [text[i:j] for i, j in zip((0, *bars), (*bars, len(text)), strict=True)]
                if all(p in pieces or len(p) == 1 for p in parts):
                    total += np.prod([probs[pieces.index(p) if p in pieces else -1] for p in parts], axis=0)
        return total

    words = ["a", "ab", "abab", "bac", "babab"]
    assert np.allclose(np.exp(cut.forward(words, probs)), [brute(w) for w in words])
    uses = cut.expected(words, np.ones(len(words)), np.zeros(len(words), dtype=int), probs)
    assert uses[:, 1].sum() == 0 and uses[:, 0].sum() > len(words)


def test_long_words_are_summed_whole(monkeypatch):
    """The rescaled sums of long words equal the plain ones, and those in logarithms where the plain ones would vanish."""
    from lexigraph.llm import language as L

    pieces = [L.MARK, L.MARK + "a", "a", "b", "ab", "ba", L.MARK + "ab", "bab"]
    probs = np.random.default_rng(2).random((len(pieces) + 1, 2)) / 3
    cut, words = L.Segmenter(pieces), ["a", "abab", "bac", "babab", "abba" * 7]
    count, lang = np.arange(1.0, 6.0), np.array([0, 1, 1, 0, 1])
    plain, uses = cut.forward(words, probs), cut.expected(words, count, lang, probs)
    monkeypatch.setattr(L, "LONGEST", 2)
    assert np.allclose(cut.forward(words, probs), plain) and np.allclose(cut.expected(words, count, lang, probs), uses)

    word = "abcba" * 200
    assert L.words_in(word) == [word]
    logs = [np.zeros(2)]
    for e in range(1, len(word) + 2):
        text = (L.MARK + word)[:e]
        ends = [(n, pieces.index(text[-n:]) if text[-n:] in pieces else -1) for n in range(1, min(e, 3) + 1) if n == 1 or text[-n:] in pieces]
        logs.append(np.logaddexp.reduce([logs[e - n] + np.log(probs[i] / 1e6) for n, i in ends], axis=0))
    assert np.allclose(cut.forward([word], probs / 1e6)[0], logs[-1], rtol=1e-9) and logs[-1].max() < -2000
    uses = cut.expected([word], np.ones(1), np.zeros(1, dtype=int), probs / 1e6)[:, 0]
    assert math.isclose(uses @ [*map(len, pieces), 1], len(word) + 1, rel_tol=1e-9)  # each character is in one piece


def test_language_held_out(spark, sf_dir):
    q = catalogue.QUERIES["op8_language_id"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in q) >= 0.95 * len(q) and all(0 <= r["score"] <= 1 for r in q)


# Near-duplicates.


def test_prob_min_hash_estimates():
    from lexigraph.llm import near_dup as N

    rng = np.random.default_rng(5)
    h = rng.integers(1, 2**63, 3000).astype(np.uint64)
    w = rng.random(3000) * 3 + 0.2
    a, b = slice(0, 2000), slice(500, 2500)
    x, y = N.prob_min_hash([(h[a], w[a]), (h[b], w[b] * 2)])  # the similarity doesn't depend on scale
    va, vb = np.zeros(3000), np.zeros(3000)
    va[a], vb[b] = w[a], 2 * w[b]
    want = sum(1 / np.maximum(va / va[d], vb / vb[d]).sum() for d in range(500, 2000))
    assert abs((x == y).mean() - want) < 4 * math.sqrt(want * (1 - want) / N.REGISTERS)
    assert (N.prob_min_hash([(h[:1], w[:1])]) == h[0]).all()


@pytest.mark.parametrize("small", [False, True])
def test_near_classes_brute_force(spark, sf_dir, monkeypatch, small):
    from lexigraph.llm import near_dup as N

    if small:  # large buckets and classes by blocks
        monkeypatch.setattr(N, "BUCKET", 2)
        monkeypatch.setattr(N, "BLOCK", 2)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [f"w{i}" for i in range(100)]
    near = [(10_000 + k, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(0, 100, 9)]
    d = d.unionByName(spark.createDataFrame([(9_999, " ".join(base)), (9_998, None), (9_997, ""), (9_996, "A, b"), (9_995, "a b!"), *near], "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] for r in d.collect()}
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(N.WORDS.findall((t or "").lower())) for i, t in rows.items()}
    root, linked = {i: i for i in rows}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
            for x, y in ((i, j), (j, i)):
                linked.setdefault(x, set()).add(" ".join(N.WORDS.findall(rows[y].lower())))
    own = {i: " ".join(N.WORDS.findall((t or "").lower())) for i, t in rows.items()}
    got = N.near_classes(d).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in rows}
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: len(linked.get(i, set()) - {own[i]}) for i in rows}
    kept = {r["doc_id"] for r in N.drop_near_duplicates(d).collect()}
    assert kept == {find(i) for i in rows}


def test_near_texts_with_a_repeated_passage(spark):
    """Counts of shingles are no part of the similarity: one text of each pair repeats a passage, on sets they are at 0.8 or more."""
    from lexigraph.llm import near_dup as N

    rows = []
    for k in range(40):
        base, more = [f"w{k}x{i}" for i in range(104)], [f"m{k}x{i}" for i in range(20)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + more * 50))]
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for (_, x), (_, y) in zip(rows[::2], rows[1::2], strict=True):
        assert 5 * len(cut(x) & cut(y)) >= 4 * len(cut(x) | cut(y))
    got = {r["doc_id"]: r["class_id"] for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in got}


def test_near_repeated_rows(spark):
    from lexigraph.llm import near_dup as N

    base = [f"w{i}" for i in range(60)]
    one, edited, other = " ".join(base), " ".join([*base, "x"]), " ".join(base[::-1])
    rows = [(5, one), (5, one), (3, edited), (7, other), (7, other), (7, one), (8, None), (8, None), (None, one), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("row", "id", "class_id", "best", "root", "links", "__key")})
    got = sorted((r["doc_id"], r["class_id"]) for r in N.near_classes(d).where("doc_id is not null").collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (7, 7), (7, 7), (8, 8), (8, 8)]
    assert sorted(r["class_id"] or 0 for r in N.near_classes(d).where("doc_id is null").collect()) == [0, 3]
    kept = N.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == sorted([(3, edited), (7, other), (8, ""), (0, one), (0, "")])


@pytest.mark.parametrize("shape", ["copies", "stars", "apart"])
def test_verification_by_blocks(spark, monkeypatch, shape):
    """One candidate class of many blocks: all near one text; several groups and single texts; no links at all."""
    from lexigraph.llm import near_dup as N

    monkeypatch.setattr(N, "BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = [rng.integers(1, 2**32, 60) for _ in range({"copies": 1, "stars": 4, "apart": 70}[shape])]
    sets = []
    for i in range(70):
        s = centres[i % len(centres) if shape != "stars" or i % 7 else 0].copy()
        s[rng.integers(0, 60, 1 + i % 8)] = rng.integers(1, 2**32, 1)
        sets.append(np.unique(s.astype(np.uint32)))
    texts = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    classes = spark.range(70).select("id", F.lit(0).cast("long").alias("root"))
    root = list(range(70))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(70), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["id"]: r["root"] for r in N.connected_components(N.verified_links(texts, classes).select("a", "b")).collect()}
    assert [got.get(i, i) for i in range(70)] == [find(i) for i in range(70)]


def test_components_of_chains(spark):
    from lexigraph.llm.components import connected_components

    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 500), (7, 7), (900, 901), (901, 902), (902, 900)], "a long, b long"))
    got = {r["id"]: r["root"] for r in connected_components(chain).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500 and got[902] == 900


# Extraction.

PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a<b) x("</p>")</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="cookie-notice">We use cookies to make this the best of all sites that you have ever seen in your life.</div><article><h1>Title &amp; more</h1><p>First  <b>par</b>agraph of the text, which is long enough to be decided.<p>Short.
<aside>Ad in the text</aside><p>Last &lt;one&gt; of the paragraphs,<br>which is as long as the first one of them.</article><section id="comments"><p>I like this article and the way it is written, so thank you for it.</p></section><form>Name <input></form><footer>&copy; 2024</footer>"""


def test_extraction(spark):
    from lexigraph.llm.html import extract_text, main_text

    want = "Title & more\nFirst paragraph of the text, which is long enough to be decided.\nShort.\nLast <one> of the paragraphs, which is as long as the first one of them."
    assert main_text(PAGE) == want
    soup = "<div><a href=x>Menu</a> <a href=y>Other</a></div><p>This is the text of a page without an article, and it is long enough to have many of the words that are in all texts.</p><p>And more.</p><div class=footer>The end of it all</div>"
    assert main_text(soup) == "This is the text of a page without an article, and it is long enough to have many of the words that are in all texts.\nAnd more."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "&am"), (5, "u", "&am"), (6, "u", "<article>" + "<p>x y</p>" * 20_000)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(pages).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[4] == ("", 0) and got[6][1] == 4 * 20_000 - 1
    assert extract_text(pages).count() == 7 and extract_text(pages.limit(0)).count() == 0


def test_extraction_in_wrappers():
    from lexigraph.llm.html import main_text

    text = "This is the text of a page that stands in a wrapper, and it is long enough to have many of the words that are in all texts."
    for head, tail in (("<div class='layout no-sidebar'><article>", "</article></div>"), ("<div class=has-sidebar><main>", "</main></div>"), ("<div class='content-with-comments'><article>", "</article></div>"),
                       ("<article class='post share-enabled'>", "</article>"), ("<form id=aspnet><article>", "</article></form>"), ("<div class=widget><article>", "</article></div>"), ("<form>", f"<p>{text}</p></form>")):
        page = f"{head}<p>{text}</p><div class=comments><p>{text} It is a comment.</p></div>{tail}<footer>{text}</footer>"
        assert main_text(page) == (f"{text}\n{text}" if head == "<form>" else text), head
    assert main_text(f"<div class=cookie-notice><p>{text}</p></div>") == ""
    czech = "Vlak přijel pozdě večer, všichni cestující vystoupili, nádraží bylo prázdné, venku padal sníh, ulice mlčely, lampy svítily matně, psi štěkali daleko, hodiny odbily jedenáct, průvodčí zavřel dveře, město usnulo."
    assert main_text(f"<div><p>{czech}</p></div><p>{czech}</p>") == f"{czech}\n{czech}"


def test_extraction_within_an_article():
    """What an article is made of stays: its header, sentences with links, sections with ambiguous names, formulas."""
    from lexigraph.llm.html import main_text

    text = "This is the text of a page that has an article, and it is long enough to have many of the words that are in all texts."
    want = ["A title of some length", text, "See the full report of the committee.", "Earlier works on this are many.", "So E = m c 2 holds.", "The whole report", text]
    page = (
        f'<article class="post"><header class="entry-header"><h1>{want[0]}</h1></header><p>{text}</p><p>See <a href=r>the full report of the committee</a>.</p>'
        f'<div class="related-work"><p>{want[3]}</p></div><p>So <math><mi>E</mi> <mo>=</mo> <mi>m</mi> <msup><mi>c</mi> <mn>2</mn></msup></math> holds.</p><h2><a href=w>The whole report</a></h2>'
        '<div class="related-posts"><h3>More of it</h3><a href=x>Another article</a></div><ul class="share-buttons"><li><a href=y>Share this</a></ul>'
        f"<p>{text}</p></article>"
    )
    assert main_text(page) == "\n".join(want)
    linked = f"<div><p>{text}</p><a href=x><div>{text}</div><div>{text}</div></a><p>{text}</p></div>"
    assert main_text(linked) == f"{text}\n{text}"
    nonsense = " ".join(f"qx{i}zv" for i in range(60))
    assert main_text(f"<body><p>{text}</p><p>{text}</p><p>{nonsense}</p><p>{text}</p></body>") == "\n".join([text] * 3)


def test_extraction_without_an_article(spark, sf_dir):
    """The same pages with plain divisions instead of articles: the rules alone find four fifths of their invented words and nothing else."""
    from lexigraph.llm.html import main_text

    found = wrong = missed = 0
    for r in table(spark, sf_dir, "pages").collect():
        want, got = (main_text(h).split("\n") for h in (r["html"], r["html"].replace("<article>", "<div>").replace("</article>", "</div>")))
        size = lambda x: sum(map(len, x))
        both = [b for b in got if b in want]
        found, wrong, missed = found + size(both), wrong + size(got) - size(both), missed + size([b for b in want if b not in got])
    assert wrong <= 0.02 * found and missed <= 0.25 * found


def test_extraction_on_the_pages(spark, sf_dir):
    """The pages of the tables have one article each, of headings and paragraphs."""
    from html import unescape

    from lexigraph.llm.html import extract_text

    for r in extract_text(table(spark, sf_dir, "pages")).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*(>|\Z)", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body[1] if body else "")]
        assert r["text"] == "\n".join(x for x in blocks if x)


# The pipeline.


def test_pipeline_line_stage_brute_force(spark, sf_dir):
    """Every text with a line of its own is cleaned, however much of it is shared; texts of shared lines alone stay."""
    import corpus_pipeline as P

    shared = "one long passage that stands on the pages of many sites and says nothing of them " * 3
    planted = [(900_000 + i, f"{shared}\nown {i}\n\n", "en", f"site{i}", 1) for i in range(6)] + [(900_010 + i, f" {shared.upper()}\n", "en", f"site{i}", 1) for i in range(2)]
    docs = table(spark, sf_dir, "documents").unionByName(spark.createDataFrame([*planted, (900_020, None, None, None, None), (900_021, "\n", "en", "a", 1)], DOCS))
    rows = docs.collect()
    norm = lambda x: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x.lower()).strip(" ")
    sites: dict = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            sites.setdefault(norm(x), set()).add(r["source"])
    want = {}
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if not norm(x) or len(sites[norm(x)]) < 5]
        whole = not any(norm(x) for x in kept)
        want[r["doc_id"]] = r["text"] if whole or len(kept) == len(lines) else "\n".join(kept)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.line_stage(spark, docs, sf_dir).collect()}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}
    assert got[900_003][0] == "own 3\n\n" and got[900_011][0] == planted[7][1]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P
    from lexigraph.llm.contamination import decontaminate
    from lexigraph.llm.near_dup import near_classes

    docs = table(spark, sf_dir, "documents").unionByName(spark.createDataFrame([(777_777, "123 456", "en", "src0", 7), (777_778, None, None, None, None)], DOCS)).cache()
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        assert name == "mixing" or out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    gone = ids(seen["language_id"][0]) - ids(seen["language_id"][1])
    assert {777_777, 777_778} <= gone and len(gone) < 10
    assert ids(seen["line_dedup"][0]) == ids(seen["line_dedup"][1])
    before, after = seen["near_dedup"]
    assert ids(after) == {r["class_id"] for r in near_classes(before).collect()}
    before, after = seen["decontamination"]
    assert ids(after) == {r["doc_id"] for r in decontaminate(before, table(spark, sf_dir, "benchmark")).where("n_hit = 0").collect()}
    assert P.run(spark, sf_dir).count() > 0


def test_pipeline_odd_rows(spark, sf_dir, odd):
    """Null, empty, very long and repeated texts, null ids, clashing columns, and an empty table, through all stages."""
    import corpus_pipeline as P

    clash = odd.withColumns({c: F.lit("old") for c in ("line", "at", "w", "pos", "term", "win", "root", "row", "score", "lang_pred", "n_words", "size_", "salt", "model")})
    for docs in (clash, odd.limit(0)):
        left, some = docs, docs is clash
        for name, stage in P.STAGES:
            out = stage(spark, left, sf_dir)
            assert len(out.columns) == len(set(out.columns)) and (name == "mixing" or out.columns == docs.columns)
            assert name == "near_dedup" or not some or out.where("line <> 'old' or salt <> 'old'").count() == 0
            left = out.persist()
            assert (left.count() > 0) == some
