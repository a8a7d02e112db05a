import numpy as np
from pyspark.sql import functions as F

from spanmill.llm import language_id as g


def test_bloom_has_no_false_negatives_and_known_rates():
    rng = np.random.default_rng(0)
    model = g.BitSlicedBloom([f"l{i:03}" for i in range(70)], "l000", bits=14)
    own = [rng.integers(0, 1 << 64, 500, np.uint64, endpoint=False) for _ in range(70)]
    for k, values in enumerate(own):
        model.add(k, values)
    model.seal()
    other = rng.integers(0, 1 << 64, 20_000, np.uint64, endpoint=False)
    for k in (0, 63, 64, 69):
        assert model.counts(own[k], np.zeros(500, int), 1)[1][0, k] == 500
        assert abs(model.counts(other, np.zeros(20_000, int), 1)[1][0, k] / 20_000 - model.rates[k]) < 0.003


def test_grams_equal_brute_force():
    texts = ["Ab1c", None, "", "é é", "  ", "İx"]
    values, owner, has = g.grams(texts)
    for i, t in enumerate(texts):
        view = "".join(c if c.isalpha() else " " for c in f" {(t or '').lower()} ")
        n = sum(view[k : k + n].strip() != "" and " " not in view[k + 1 : k + n - 1] for n in g.ORDERS for k in range(len(view) - n + 1))
        assert (owner == i).sum() == n
    assert has.tolist() == [True, False, False, True, False, True]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = g.fit(docs.where(~g.held_out()))
    out = g.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count() > 0
    assert out.where("score < 0 OR score > 1").count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 !?"), (3, "ქ"), (4, "the " * 20_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    rows = {r.doc_id: r for r in g.identify(odd, model).collect()}
    assert [rows[k].lang_pred for k in (None, 1, 2, 3, 4)] == ["und", "und", "und", model.default, "en"]
    assert rows[None].held_out is False and rows[3].score == 0
    assert g.fit(docs.limit(0)) is None and {r.lang_pred for r in g.identify(odd, None).collect()} == {"und"}
    assert g.identify(odd.limit(0), model).count() == 0


def test_decisions_equal_brute_force():
    """n-grams, membership, correction and choice in plain Python, with the same hash."""
    from spanmill.llm.wordhash import mix

    def hashes(text):
        code = [ord(c) if c.isalpha() else 32 for c in f" {(text or '').lower()} "]
        out = []
        for n in (2, 3, 4):
            for i in range(len(code) - n + 1):
                part = code[i : i + n]
                if any(c != 32 for c in part) and all(c != 32 for c in part[1:-1]):
                    value = n
                    for c in part:
                        value = (value * 0x110001 + c) % 2**64
                    out.append(int(mix(np.array([value], np.uint64))[0]))
        return out

    model = g.BitSlicedBloom(["aa", "bb", "cc"], "bb", bits=9)
    known = {"aa": "the cat and the hat", "bb": "der hund und die katze", "cc": "el perro y la casa"}
    for k, lang in enumerate(model.languages):
        model.add(k, np.array(hashes(known[lang]), np.uint64))
    model.seal()
    held = {lang: {((v + k * ((v >> 32) | 1)) % 2**64) % 512 for v in hashes(known[lang]) for k in range(3)} for lang in known}
    rates = {lang: (len(held[lang]) / 512) ** 3 for lang in known}
    texts = [None, "", "123 !", "the dog", "die katze der", "la casa", "xyzzy qqq", "the katze y", "É ñ"]
    names, scores = model.decide(texts)
    for text, name, score in zip(texts, names, scores):
        own = hashes(text)
        found = {lang: sum(all(((v + k * ((v >> 32) | 1)) % 2**64) % 512 in held[lang] for k in range(3)) for v in own) for lang in known}
        fixed = {lang: max(0.0, (found[lang] - len(own) * rates[lang]) / (1 - rates[lang])) for lang in known}
        mass = sum(fixed.values())
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0.0)
        elif not mass:
            assert (name, score) == ("bb", 0.0)
        else:
            assert name == max(known, key=lambda x: (fixed[x], -ord(x[0]))) and abs(score - fixed[name] / mass) < 1e-9
