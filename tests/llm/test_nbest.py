import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanmill.llm.nbest import Path, Segmenter, apply_edits, encode_nbest, log_probabilities, piece_scores, segmenter
from spanmill.llm.pieces import SPACE, vocabulary
from spanmill.llm.token_count import count_tokens, counter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  b ", "\n", "x\n\ny", "<s>hé</s>", "日本 語", "½²x", "\t\r\n{\r\n", "🙂🙂 a", "́e", "0123 45", "a" * 300, "the the the the"]


def scores_of(*texts):
    vocab, seen = vocabulary(MODEL), Counter()
    for text in texts:
        seen.update(vocab.processor.encode(text))
    return log_probabilities(vocab, seen)


def every(vocab, view, scores):
    """All segmentations of the model's view, by brute force."""
    if not view:
        return [(0.0, ())]
    out, unknown = [], min(scores[i] for i in vocab.ids.values()) - 10.0
    for j in range(1, min(len(view), vocab.longest) + 1):
        piece = view[:j]
        if piece in vocab.ids:
            out += [(scores[vocab.ids[piece]] + s, (vocab.ids[piece], *ids)) for s, ids in every(vocab, view[j:], scores)]
    if view[0] not in vocab.ids:
        own = tuple(vocab.bytes[b] for b in view[0].encode())
        out += [(unknown + s, own + ids) for s, ids in every(vocab, view[1:], scores)]
    return out


@pytest.mark.parametrize("text", ["the", "an on", "x\ny", "a b a b", "ab ab ab", "🙂 is", "no, no", "in  it", "to to to"])
def test_nbest_equals_brute_force(text):
    vocab = vocabulary(MODEL)
    scores = scores_of("the cat is on the mat in no time", "to an end") if len(text) % 2 else scores_of()
    own = segmenter(MODEL, scores.tobytes())
    want = sorted(every(vocab, SPACE + text.replace(" ", SPACE), scores), key=lambda x: (-x[0], x[1][::-1]))[:5]
    ids, score, more = own.segment(text, 5)
    got = [(score, tuple(ids.tolist()))] + [(m["score"], tuple(apply_edits(ids.tolist(), m["edits"]))) for m in more]
    assert got == want


def test_viterbi_agrees_with_search():
    own, rng = segmenter(MODEL, scores_of("an area of notes").tobytes()), random.Random(1)
    for _ in range(300):
        chunk = SPACE + "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 12)))
        best = own.lattice.nbest(chunk, 2)
        assert own.lattice.viterbi(chunk) == (best[0][0], best[1][0], list(best[0][1][::-1]))


def test_chunks_learnt_together_equal_chunks_alone():
    vocab, rng = vocabulary(MODEL), random.Random(2)
    chunks = {SPACE * rng.randint(0, 1) + "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 60))) for _ in range(3000)} | {"a" * 39, "a" * 40, "a" * 41, "🙂", "é🙂a", "日本", ",.;", "0"}
    for scores in (scores_of("an area of notes, on stones"), scores_of()):  # the latter ties often
        own = Segmenter(vocab, scores)
        own.learn(list(chunks))
        assert set(own.kinds) == chunks
        for chunk, k in own.kinds.items():
            best, second, ids = own.lattice.viterbi(chunk)
            got = own.flat[own.start[k] : own.start[k] + own.size[k]].tolist()
            assert (own.chunk[k], own.score[k], own.delta[k], got) == (chunk, best, best - second, ids)


def test_whole_documents_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in encode_nbest(df, MODEL).collect()}
    assert all(r.round_trip for r in rows.values()) and len(rows) == len(ODD)
    assert rows[0].ids == [] and rows[0].score == 0 and rows[0].alternatives == []
    assert encode_nbest(df.limit(0), MODEL).count() == 0


def test_counts_equal_the_library(spark, sf_dir):
    vocab = vocabulary(MODEL)
    assert len(counter(MODEL).proven) > 30_000
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for table in (df, docs):
        texts = {r[0]: r[1] for r in table.select("doc_id", "text").collect()}
        for r in count_tokens(table, MODEL).collect():
            text = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n := len(vocab.processor.encode(text)), n > 4096)
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_paths_compare_as_their_ids():
    rng, paths = random.Random(3), [Path()]
    for _ in range(300):
        rest = rng.choice(paths)
        paths.append(Path((rng.randint(0, 2),), rest))
    held = {p.ids(): p for p in paths}
    paths = list(held.values())  # one of each
    for a in rng.sample(paths, 60):
        for b in rng.sample(paths, 60):
            if a is not b and a.ids()[:1] != b.ids()[:1]:
                assert (a < b) == (a.ids() < b.ids())


def test_scores_are_the_corpus_unigrams_and_words_stay_whole(spark, sf_dir):
    vocab = vocabulary(MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    scores = piece_scores(docs, MODEL, held=500)
    assert np.array_equal(scores, scores_of(*(t for t in texts if t)))
    text = "the cat sat on the mat international"
    own = segmenter(MODEL, scores_of(text, "a cat", "the mat").tobytes())
    ids, _, _ = own.segment(text, 3)
    assert ids.tolist() == vocab.processor.encode(text)


def test_long_words_take_no_square_of_time():
    own = segmenter(MODEL, scores_of("a aa aaaa").tobytes())
    for word in ("a" * 100_000, "ab" * 50_000):
        began = time.time()
        ids, _, more = own.segment(word, 4)
        assert vocabulary(MODEL).decode(ids.tolist()) == word and len(more) == 3 and time.time() - began < 20
