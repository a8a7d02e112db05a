import hashlib

import public_tokenizers

import corpus_pipeline as p
from spanmill.llm.common import save
from spanmill.llm.pieces import vocabulary
from spanmill.llm.quality import resample

from test_decontaminate import brute as contaminated
from test_near_copies import brute as kept_of


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage over what its predecessor kept, held against plain Python; all but the last keep the columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    assert [name for name, _ in p.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "SentencePiece encoding"]
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = save(stage(spark, docs, sf_dir), "test")
        rows = {r.doc_id: r for r in out.collect()}
        if name != "SentencePiece encoding":
            assert out.columns == columns
        if name == "quality classifier":
            assert set(rows) == {r.doc_id for r in resample(docs, labels).where("selected").collect()} and 0.5 * len(before) < len(rows) < len(before)
        elif name == "SimHash near-dedup":
            assert set(rows) == kept_of(before)
        elif name == "substring dedup":
            words, least = {i: (t or "").split() for i, t in before.items()}, {}
            for i, w in sorted(words.items()):
                for k in range(len(w) - 49):
                    least.setdefault(hashlib.md5(" ".join(w[k : k + 50]).encode()).digest(), i)
            for i, w in words.items():
                gone = {k + j for k in range(len(w) - 49) if least[hashlib.md5(" ".join(w[k : k + 50]).encode()).digest()] < i for j in range(50)}
                assert rows[i].text == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else before[i])
        elif name == "benchmark decontamination":
            assert set(rows) == {i for i, t in before.items() if not contaminated(t, items, 10)[4]}
        else:
            own = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
            assert set(rows) == set(before) and all(own.decode(r.ids) == before[i] and r.round_trip for i, r in rows.items())
        docs = out
    final = p.run(spark, sf_dir)
    assert {r.doc_id: r.ids for r in final.select("doc_id", "ids").collect()} == {i: r.ids for i, r in rows.items()}
