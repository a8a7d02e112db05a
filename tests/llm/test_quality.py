import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm import quality as q


def test_ngrams_equal_brute_force():
    texts = ["Ab  c!! c", None, "", "x x x", "é…é ,a", "z" * 3000, " ,"]
    bucket, owner = q.ngrams(q.tokens(texts), 18)
    sizes = {0: 4 + 3, 1: 0, 2: 0, 3: 3 + 2, 4: 3 + 2, 5: 1, 6: 1}
    assert {i: int((owner == i).sum()) for i in range(len(texts))} == sizes
    own = bucket[owner == 3]
    assert len(set(own[:3].tolist())) == 1 and len(set(own[3:].tolist())) == 1
    again = [q.ngrams(q.tokens([t]), 18)[0].tolist() for t in texts]
    assert [bucket[owner == i].tolist() for i in range(len(texts))] == again


def test_kth_largest_equals_sorting(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), i) for i, x in enumerate(rng.normal(size=500))] + [(0.5, i) for i in range(1000, 1200)] + [(0.5, None)]
    df = spark.createDataFrame(rows, "gumbel_key double, doc_id long")
    want = sorted(rows, key=lambda r: (-r[0], -1 if r[1] is None else r[1]))
    for k in (1, 2, 100, 250, 300, 500, 701):
        at = q.kth_largest(df, k, buckets=8)
        assert at == want[k - 1]
        assert df.where(q._kept(F.col("gumbel_key"), F.col("doc_id"), at)).count() == k


def test_junk_goes_and_good_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    out = q.resample(docs, labels).join(labels, "doc_id")
    share = lambda where: out.where(where).agg(F.avg(F.col("selected").cast("double"))).first()[0]
    assert share("quality = 1 AND toxic = 0") >= 0.97 and share("quality = 0") <= 0.1
    kept = q.keep_good(docs.withColumns({"log_weight": F.lit("x"), "__noise": F.lit(1)}), labels)
    assert kept.columns == [*docs.columns, "log_weight", "__noise"] and kept.where("__noise <> 1").isEmpty()
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in q.resample(docs, labels).where("selected").collect()}


@pytest.mark.parametrize("good", [True, False])
def test_odd_rows(spark, good):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "junk!! junk!!"), (4, "w " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (4, 1, 0), (3, 0, None), (None, 1, 0)] if good else [(2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = q.resample(docs, labels).collect()
    assert len(out) == 6 and all(r.gumbel_key is None or np.isfinite(r.gumbel_key) for r in out)
    assert good or all(r.selected for r in out)
    assert q.keep_good(docs, labels).count() == sum(bool(r.selected) for r in out)
    assert q.resample(docs.limit(0), labels).count() == 0 and q.keep_good(docs, labels.limit(0)).count() == 6


def test_weights_equal_brute_force(spark, sf_dir):
    """Ratios, weights, toxicity and threshold against plain Python over the same n-grams."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratios = q.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for r in labels.collect():
        seen.setdefault(r.doc_id, []).append((r.quality, r.toxic))
    good = {i for i, v in seen.items() if all(x == (1, 0) for x in v)}
    target = sorted(good - set(ratios.held_back)) if len(good) > len(ratios.held_back) else sorted(good)
    counts = {i: q.ngrams(q.tokens([t]), 18)[0].tolist() for i, t in texts.items()}
    raw, own = np.zeros((2, 1 << 18))
    for i, c in counts.items():
        np.add.at(raw, c, 1)
        if i in target:
            np.add.at(own, c, 1)
    table = np.log((own + 300) / (raw * own.sum() / raw.sum() + 300))
    table -= (table * own).sum() / own.sum()
    rows = {r.doc_id: r for r in q.resample(docs, labels).collect()}
    for i, c in counts.items():
        assert rows[i].n_grams == len(c) and rows[i].log_weight == pytest.approx(sum(table[b] for b in c) / max(1, len(c)) ** 0.75 / 0.2, abs=1e-6)
    tox = {i: float(sum(sorted((x for x in {b: ratios.toxic[b] for b in {*c, *q.stems(q.tokens([texts[i]]), 18)[0].tolist()}}.values() if x > q.FLOOR), reverse=True)[: q.STRONGEST])) for i, c in counts.items()}
    held = sorted(set(ratios.held_back) & set(counts))
    most = sorted(tox[i] for i in held)[int(np.ceil(0.994 * len(held))) - 1]
    least = np.quantile([rows[i].log_weight for i in held], 0.003)
    allowed = [i for i in counts if tox[i] <= most + 1e-9]
    k = sum(rows[i].log_weight >= least - 1e-9 for i in allowed)
    best = set(sorted(allowed, key=lambda i: (-rows[i].gumbel_key, i))[:k])
    assert {i for i, r in rows.items() if r.selected} == best


def test_noise_decides_near_the_cut_and_k_is_a_parameter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.resample(docs, labels, k=700).collect()
    assert sum(r.selected for r in rows) == 700
    plain = {r.doc_id for r in sorted(rows, key=lambda r: -r.log_weight)[:700]}
    assert 20 <= len(plain - {r.doc_id for r in rows if r.selected})
