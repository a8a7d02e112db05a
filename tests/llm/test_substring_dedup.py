import hashlib
import random
import re

import pytest

from spanmill.llm import substring_dedup as s


def brute(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {p + k for p in range(len(w) - window + 1) if least[tuple(w[p : p + window])] < i for k in range(window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "é", "日本", "x\xa0y", "c.", "D"]) + str(rng.randint(0, 400))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)] + [["la"] * 120]
    rows = [(0, None), (1, ""), (2, " \n "), (3, " ".join(["la"] * 60))]
    for i in range(4, 60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w += p[a : len(p) - rng.randint(0, 5)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(100, rows[30][1]), (101, rows[30][1]), (-5, rows[31][1])]


@pytest.mark.parametrize("window, phrase", [(50, 10), (12, 3)])
def test_equals_brute_force(spark, monkeypatch, window, phrase):
    monkeypatch.setattr(s, "BLOCK_BYTES", 4000)
    rows = corpus(window)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, owner string")
    want = brute(rows, window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in s.repeated_words(df, window, phrase).collect()}
    assert got == want and any(v[1] for v in want.values())
    kept = s.remove_repeats(df, window, phrase)
    assert kept.columns == df.columns
    for r in kept.collect():
        assert hashlib.sha256(" ".join((r.text or "").encode().decode().split()).encode()).hexdigest() == want[r.doc_id][2] or "\xa0" in r.text


def test_nulls_and_empty_tables(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, text), (None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in s.repeated_words(df).collect()), key=str) == [(1, 0), (1, 0), (2, 60), (None, 0), (None, 0)]
    assert s.repeated_words(df.limit(0)).count() == 0 and s.remove_repeats(df.limit(0)).count() == 0


def test_equal_rows_and_words_made_to_collide(spark, monkeypatch):
    """10,000 equal rows in many blocks; words whose polynomials modulo 2**64 are equal are different words; clashing columns."""
    monkeypatch.setattr(s, "BLOCK_BYTES", 20_000)
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(49))
    other = morse.translate(str.maketrans("ab", "ba"))
    copy = " ".join(f"c{i}" for i in range(70))
    rows = [(1, f"{morse} {tail}"), (2, f"{other} {tail}"), (3, copy)] + [(4, copy)] * 10_000 + [(5, f"x {copy} y")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, __block int, block int")
    seen = {}
    for r in s.repeated_words(df).collect():
        seen.setdefault((r.doc_id, r.n_removed), []).append(r)
    assert {k: len(v) for k, v in seen.items()} == {(1, 0): 1, (2, 0): 1, (3, 0): 1, (4, 70): 10_000, (5, 70): 1}
    kept = s.remove_repeats(df)
    assert kept.columns == df.columns and kept.where("__block = 1 AND block = 2").count() == len(rows)
    assert kept.where("doc_id = 5").first().text == "x y"
