import random

from spanmill.llm import quality as q


def test_toxic_documents_go_and_clean_ones_stay(spark):
    """Planted insults in documents otherwise like the good ones; recall and clean share separately, labelled or not."""
    rng, docs, labels = random.Random(4), [], []
    words, insults = [f"w{k}" for k in range(300)], ["moron", "idiot", "scum", "trash"]
    for i in range(1200):
        w = [rng.choice(words) for _ in range(rng.randint(20, 2000 if i % 50 == 0 else 200))]
        toxic = i % 8 == 0
        for k in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    out = q.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in out.collect() if r.selected}
    toxic = {i for i, _ in docs if i % 8 == 0}
    assert len(toxic & kept) <= 0.05 * len(toxic)
    assert len(kept - toxic) >= 0.97 * (len(docs) - len(toxic))
