"""op2's shortcuts: decoding is known by chunk, and words that are one chunk are counted without being cut."""

from collections import Counter

import numpy as np

from spanmill.llm import nbest
from spanmill.llm.nbest import Segmenter, encode_nbest, log_probabilities, piece_scores
from spanmill.llm.pieces import vocabulary
from spanmill.llm.queries import PIECES

TEXTS = ["the cat, the hat\nand two  spaces", "naïve Straße 東京 \U0001f600 x1 _y_", "a▁b", "", None, " lead", "plain words only plain", "tail ", "\0 end"]


def test_round_trips_known_by_chunk(spark, monkeypatch):
    vocab = vocabulary(PIECES)
    own, decoded, decode = Segmenter(vocab, np.array(log_probabilities(vocab, {}))), [], vocab.decode
    monkeypatch.setattr(vocab, "decode", lambda ids: decoded.append(ids) or decode(ids))
    texts = [t or "" for t in TEXTS]
    got = [(decode(ids.tolist()) == t, same) for t, (ids, _, _, same) in zip(texts, own.checked(texts, 3))]
    assert all(a == b for a, b in got) and not got[2][1] and sum(b for _, b in got) == len(TEXTS) - 1
    assert len(decoded) <= 3  # texts with U+2581 and empty ones
    own.bytes = own.bytes + 1  # as if no chunk's ids had the right size: then texts are decoded
    own.reset()
    assert [same for *_, same in own.checked(texts, 3)] == [b for _, b in got]


def test_scores_count_every_chunk(spark):
    vocab, want = vocabulary(PIECES), Counter()
    for text in TEXTS:
        for chunk in vocab.chunks(text or ""):
            want.update(vocab.encode_chunk(chunk))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    for held in (1, 5, 200_000):
        assert np.array_equal(piece_scores(docs, PIECES, held), log_probabilities(vocab, want))
    assert encode_nbest(docs, PIECES).where("round_trip").count() == len(TEXTS) - 1 and nbest.SPACE == "▁"
