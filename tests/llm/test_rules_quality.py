"""Rule ledger and quality classifier."""
import zlib

import duckdb
import numpy as np

from postwise.llm import quality, rules
from postwise.llm.queries import ORACLES, QUERIES
from postwise.llm.stats import NAMES, measure

from .conftest import LONG, SF


def oracle_rows(name, views=("documents", "pages", "embeddings", "labels"), root=SF):
    con = duckdb.connect()
    for v in views:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{root}/{v}.parquet')")
    rel = con.sql(ORACLES[name])
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    assert spark_rows(QUERIES["op6_rules"](spark, SF)) == oracle_rows("op6_rules")


def test_odd_rows_match_sql(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    odd_docs.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(ORACLES["op6_rules"])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert spark_rows(QUERIES["op6_rules"](spark, str(tmp_path)))[1] == want
    assert rules.ledger(no_docs).count() == 0


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_measurements_by_brute_force():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "é!", "#*", "\n"], rng.integers(0, 60))) for _ in range(300)]
    texts += ["", " ", "x", "x y z", "x x x x", LONG]
    for t in texts:
        m = dict(zip(NAMES, measure(t.encode())))
        words = t.split()
        assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
        assert m["n_repeat_words"] == brute_repeats(words)
        if words:
            lines = [x for x in t.split("\n") if x.strip()]
            assert m["n_dup_lines"] == len(lines) - len(set(lines))
            assert m["n_symbols"] == sum(c in "#*$%&|<>" for c in t)


def test_policies_and_ablations(spark, docs):
    led = rules.ledger(docs).cache()
    rows = led.collect()
    for policy in rules.POLICIES.values():
        mask = policy.mask()
        kept = rules.apply_policy(led, policy).filter("kept").count()
        assert kept == sum(not r.fail_bits & mask for r in rows)
        got = {r.rule: (r.n_failing, r.n_only_this, r.n_rejected) for r in rules.ablations(led, policy).collect()}
        for k, rule in enumerate(rules.RULES):
            if rule.name in policy.rules:
                assert got[rule.name] == (sum(r.fail_bits >> k & 1 for r in rows),
                                          sum(r.fail_bits & mask == 1 << k for r in rows),
                                          sum(bool(r.fail_bits & mask) for r in rows))
    led.unpersist()


def test_filter_keeps_columns_and_clean_rows(odd_docs, docs, labels):
    assert rules.filter_documents(odd_docs).columns == odd_docs.columns
    kept = {r.doc_id for r in rules.filter_documents(docs).select("doc_id").collect()}
    good = [r.doc_id for r in labels.filter("quality = 1").join(docs, "doc_id").collect()]
    short = {r.doc_id for r in docs.collect() if len((r.text or "").split()) < 50}
    assert all(i in kept for i in good if i not in short)


def test_classifier_on_held_out_rows(spark, labels):
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    held = [i for i in truth if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.95


def test_held_out_labels_do_not_matter(spark, docs, labels):
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(labels.doc_id), 1 - labels.quality)
                                .otherwise(labels.quality))
    a = quality.score_documents(docs, labels).select("doc_id", "score").collect()
    b = quality.score_documents(docs, flipped).select("doc_id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_classifier_odd_rows(spark, odd_docs, no_docs, docs, labels):
    got = quality.score_documents(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_documents(odd_docs, labels.limit(0)).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (2, 1, 0), (2, 1, 0)],
                                "doc_id long, quality int, toxic int")
    assert len(quality.score_documents(odd_docs, odd).collect()) == odd_docs.count()
    assert quality.score_documents(no_docs, labels).count() == 0
    model, _ = quality.train(docs, labels)
    assert quality.filter_documents(odd_docs, model).columns == odd_docs.columns


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    means, covs = [rng.normal(size=d) for _ in range(2)], []
    for _ in range(2):
        a = rng.normal(size=(d, d))
        covs.append(a @ a.T + np.eye(d))
    chol = [np.linalg.cholesky(c) for c in covs]
    model = quality.Model(0.5, tuple(means), tuple(np.linalg.inv(c) for c in chol),
                          tuple(2 * np.log(np.diag(c)).sum() for c in chol), 0.3)
    x = rng.normal(size=(20, d))
    logp = [-0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1])
            for m, c in zip(means, covs)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(logp[1] - logp[0] + 0.3))), atol=1e-5)
