"""Substring dedup, whitening and the filter audit: brute force, odd inputs, several chunks and hot windows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import audit, substrings, whitening
from lexigraph.llm.common import salted_join, salted_semi, table
from tests.llm.test_corpus import ODD, DOCS, odd  # noqa: F401


def brute_windows(rows, n=substrings.LENGTH):
    """(id, words, removed, kept text) of each row, by the definition; null ids are one document after all others."""
    order = lambda d, at: (d is None, d or 0, at)
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, order(d, i)), order(d, i))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < order(d, i) for j in range(i, i + n)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def passages(seed):
    """Texts that share passages of 15 to 60 words, with copies, near copies, repeats within a text, and words of all lengths."""
    rng = np.random.default_rng(seed)
    words = ["é" * 300, " x", *(f"w{i}" for i in range(200))]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(n) for n in (15, 19, 20, 21, 45, 60)]
    rows = []
    for i in range(120):
        parts = [text(rng.integers(0, 40)), shared[rng.integers(len(shared))], text(rng.integers(0, 30)), shared[rng.integers(len(shared))]]
        rows.append((int(rng.integers(0, 100)) if i % 10 else None, "\t\n".join(parts) if i % 7 else parts[1]))
    rows += [rows[3], (rows[5][0], rows[6][1]), (1000, rows[8][1]), (1001, rows[8][1]), (1002, "same " * 70), (1003, "same " * 40), (1004, None), (1005, " \n ")]
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_windows_brute_force(spark, monkeypatch, small):
    """With tables sent to all tasks and with joins, and in chunks of a few texts."""
    if not small:
        monkeypatch.setattr(substrings, "is_small", lambda df: False)
    rows = passages(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substrings.substring_dedup(docs).collect()), key=str)
    assert got == brute_windows(rows)


def test_chunks_and_hashes(monkeypatch):
    """Words and windows are the same however texts are cut into chunks."""
    import pyarrow as pa

    texts = pa.array(["a bb  ccc", None, "", " é\x0bd ", "x" * 500 + " y", "a bb"])
    whole = next(substrings.text_chunks(texts))
    h, doc = substrings.hashed_words(*whole[2:])
    assert doc.tolist() == [0, 0, 0, 3, 3, 4, 4, 5, 5] and h[0] == h[7] and h[1] == h[8] and len(set(h.tolist())) == 7
    monkeypatch.setattr(substrings, "CHUNK", 5)
    parts = [substrings.hashed_words(*c[2:])[0] for c in substrings.text_chunks(texts.slice(0, 6))]
    assert len(parts) > 3 and np.array_equal(np.concatenate(parts), h)


def test_windows_odd_rows(spark, odd):  # noqa: F811
    clash = odd.withColumns({c: F.lit("old") for c in ("n_words", "row", "doc", "starts", "copy", "key")})
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substrings.substring_dedup(clash).collect()), key=str)
    assert got == brute_windows([(r[0], r[1]) for r in ODD])
    assert substrings.substring_dedup(odd.limit(0)).count() == 0 and substrings.longest_repeats(odd.limit(0)).count() == 0


def test_longest_repeats(spark):
    """Windows are doubled until none is repeated."""
    long = " ".join(f"w{i}" for i in range(170))
    cut_ = lambda n, tag: f"{tag}a {tag}b " + " ".join(f"w{i}" for i in range(3, 3 + n)) + f" {tag}c"
    rows = [(1, long), (2, cut_(19, "x")), (3, cut_(20, "y")), (4, cut_(79, "z")), (5, cut_(160, "u")), (6, long), (7, "lone " + " ".join(f"v{i}" for i in range(30))), (8, "r s t u " * 12)]
    got = {r["doc_id"]: r["longest"] for r in substrings.longest_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 160, 3: 20, 4: 40, 5: 160, 8: 40}


def check_whitening(rows, got):
    x = [None if v is None or not v or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    kept = [(k, np.array(v, dtype=object)) for (k, _), v in zip(rows, x, strict=True) if v]
    fit = np.array(sorted({tuple(v) for _, v in kept}), dtype=float)
    n, d = fit.shape
    v = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    sums = [sum(int(c) for c in col) for col in zip(*{tuple(v) for _, v in kept}, strict=True)]
    assert len(got) == len(kept) * min(d, 16) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k, vec in kept:
        for c in range(min(d, 16)):
            r = by[k, c + 1][0]
            assert r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(vec, sums, strict=True))
            assert math.isclose(r["explained"], values[c] / np.trace(v), rel_tol=1e-9)
            want = (vec.astype(float) - fit.mean(0)) @ axes[:, c] / math.sqrt(values[c])
            assert math.isclose(abs(r["whitened"]), abs(want), rel_tol=1e-6, abs_tol=1e-6)


def test_whitening_on_the_embeddings(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    check_whitening(rows, whitening.op12_whitening(spark, sf_dir).collect())


def test_whitening_odd_rows(spark):
    """Small eigenvalues, unusable rows, repeated ones, null keys; a single vector; none; lengths that differ."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.logspace(3, -1, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    bad = [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [math.nan] + [1.0] * 19), (904, [math.inf] * 20)]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows + rows[:5] + bad, schema)
    check_whitening([*rows, *rows[:5], *bad], whitening.whiten(df.withColumns({c: F.lit("old") for c in ("x", "n", "component", "deviation")})).collect())
    extra = whitening.whiten(spark.createDataFrame([*rows, (None, rows[0][1]), (7, [1.0, 2.0])], schema)).collect()
    assert sum(r["vec_id"] is None for r in extra) == 16 and len(extra) == 301 * 16
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, 0.0, 0.0, 0.0)} and len(one) == 4
    assert whitening.whiten(spark.createDataFrame(bad, schema)).count() == 0 == whitening.whiten(df.limit(0)).count()


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    d = np.logspace(0, -11, 12)
    scaled = np.diag(np.logspace(0, -6, 12)) @ (q @ np.diag(np.linspace(1, 2, 12)) @ q.T) @ np.diag(np.logspace(0, -6, 12))
    for v in (q @ np.diag(d) @ q.T, scaled, np.zeros((3, 3)), np.eye(4)):
        v = (v + v.T) / 2
        values, axes = whitening.jacobi(v)
        assert np.all(np.diff(values) <= 0) and np.allclose(axes.T @ axes, np.eye(len(v)), atol=1e-13)
        assert np.allclose(v @ axes, axes * values, atol=1e-14 * max(1, values[0] if len(values) else 1))


def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    failed = []
    for d, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and first[t] < d}
        failed.append((lang or "", d, {k for k, v in f.items() if v}))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [(d, f) for p, d, f in failed if p == part]
        for order in audit.ORDERS:
            left = own
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                fails = [x for x in own if letter in x[1]]
                out[part, order, step] = [len(left), len(here), len(fails) - len(here), sum(x[1] == {letter} for x in own), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
        for letter in audit.FILTERS:
            total = sum(out[part, o, o.index(letter) + 1][1] for o in audit.ORDERS)
            for o in audit.ORDERS:
                out[part, o, o.index(letter) + 1].append(total)
    return out


def test_audit_brute_force(spark, odd):  # noqa: F811
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice([f"w{i}" for i in range(400)], n)) + rng.choice(["", " #", " ABCDEFGH" * 30, " w1" * 90])
    docs = [(i, text(rng.integers(50, 300)), str(rng.choice(["en", "de", ""]))) for i in range(200)]
    docs += [(300 + i, docs[i % 7][1], None) for i in range(40)] + [(None, docs[0][1], "en"), (5, docs[5][1], "en")] + [(r[0], r[1], r[2]) for r in ODD]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 320, 2)] + [(4, None, 1), (None, 1, 1), (4, 1, None), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("old") for c in ("part", "bits", "key", "step", "kept")})
    got = audit.filter_audit(d.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == brute_audit(docs, labels) and len(got) == 600 * len({x[2] or "" for x in docs})
    assert audit.filter_audit(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_salted_copies_are_never_sent_whole(spark):
    """Their number isn't in the optimizer's estimate of the size: neither it nor what is measured while a query runs may broadcast them."""
    left, right = spark.range(100).selectExpr("id % 7 AS key", "id"), spark.range(3).selectExpr("id AS key", "id * 10 AS v")
    named, kept = salted_join(left, right, "key", F.col("id")), salted_semi(left, right, ["key"], F.col("id"))
    assert sorted(r["id"] for r in kept.collect()) == [i for i in range(100) if i % 7 < 3]
    assert {(r["id"], r["v"]) for r in named.collect()} == {(i, i % 7 * 10 if i % 7 < 3 else None) for i in range(100)}
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('text ', id % 20) AS text", "'en' AS lang")
    audited = audit.filter_audit(docs, spark.range(50).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    assert {r["good_lost"] for r in audited.where("filter_order = 'ABCDE' AND step = 1").collect()} == {50}
    for df in (named, kept, audited):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_digest_of_kept_words(spark, sf_dir):
    """The query's digest is that of the operator's text."""
    texts = {r["doc_id"]: r["text"] for r in substrings.substring_dedup(table(spark, sf_dir, "documents")).collect()}
    got = substrings.op11_substring_dedup(spark, sf_dir).collect()
    assert all(r["kept_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got) and len(got) == len(texts)


@pytest.mark.parametrize("part, kept", [
    ('<section class="discussion">{}</section>', False), ('<div class="user-comment">{}</div>', False), ("<p hidden>{}</p>", False), ('<div style="color:red; display: none">{}</div>', False),
    ('<div class="no-comments">{}</div>', True), ('<p title="hidden">{}</p>', True), ('<p data-hidden="1">{}</p>', True),
])
def test_comments_and_hidden_parts_of_an_article(part, kept):
    from lexigraph.llm.html import main_text

    text = "This is the text of the article and it is about the things that we have seen in the city. " * 4
    said = "I think that this is the best that I have read of it in a long time, and so are all the others of you."
    assert (said in main_text(f"<article><p>{text}</p>{part.format(said)}</article>")) == kept


def test_toxic_rows_are_drawn_by_what_can_be_drawn(spark, monkeypatch):
    """Labels of other documents and repeated ids don't change how many documents are drawn."""
    from lexigraph.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "train_nnpu", lambda toxic, other, prior: seen.append((len(toxic), len(other))))
    monkeypatch.setattr(toxicity, "estimate_prior", lambda toxic, other: 0.1)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    labels = spark.range(1900, 1950).selectExpr("id AS doc_id", "1 AS toxic").union(spark.range(10_000, 14_000).selectExpr("id AS doc_id", "1 AS toxic"))
    toxicity.fit_toxicity(docs.union(docs), labels, max_toxic=1000, max_rows=200)
    (toxic, other), = seen
    assert toxic == 50 and 140 < other < 260
