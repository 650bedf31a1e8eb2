"""Runs of words against a plain search of every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from foresail.llm import periodic, queries
from tests.conftest import SF


def plain_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        k = 0
        while k < len(words) - q:
            e = k
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            length = e - k + q
            if e > k and length >= max(least, times * q):
                inside = words[k : k + length]
                if not any(inside[r:] == inside[:-r] for r in range(1, q)):
                    out.append((k, length, q))
            k = max(e, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("direct", [1, 12])
@pytest.mark.parametrize("times", [2, 3, 4])
def test_all_runs_of_random_words(monkeypatch, direct, times):
    monkeypatch.setattr(periodic, "DIRECT", direct)
    rnd = random.Random(direct * 10 + times)
    for _ in range(400):
        words = [rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randrange(40))] * rnd.choice([1, 1, 2, 5])
        if words and rnd.random() < 0.5:
            at, p = rnd.randrange(len(words)), rnd.randint(1, 8)
            words[at:at] = words[at : at + p] * rnd.randint(2, 9)
        assert periodic.runs_of_words(words, 6, times) == plain_runs(words, 6, times)


def test_hashes_that_agree_by_accident(monkeypatch):
    """With a useless hash every bisection is wrong, and the comparison of words still gives the true length."""
    monkeypatch.setattr(periodic, "DIRECT", 1)
    monkeypatch.setattr(periodic.Extensions, "_hash", lambda self, start, length: 0)
    words = ["x", "a", "b"] + ["a", "b"] * 20 + ["c"]
    assert periodic.runs_of_words(words) == plain_runs(words)


def test_long_texts_take_linear_time():
    words = [str(k) for k in range(3000)] * 5 + ["a"] * 30_000
    assert periodic.runs_of_words(words) == [(0, 15_000, 3000), (15_000, 30_000, 1)]


def test_operator_and_its_unusual_rows(spark):
    rows = [(1, "a a a a a a b", 7), (None, "x y x y x y x y", 7), (2, None, 7), (3, "", 7), (4, "\u00a0 \t\n", 7), (1, "a a a a a a b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r.doc_id, r.n_words): (r.runs, r.collapsed) for r in periodic.find_runs(df).collect()}
    assert got[(1, 7)] == ([(0, 6, 1)], "a b")
    assert got[(None, 8)] == ([(0, 8, 2)], "x y")
    assert got[(2, 0)] == ([], "") and got[(3, 0)] == ([], "")
    assert got[(4, 1)] == ([], "\u00a0")
    assert periodic.find_runs(df).count() == 6
    assert periodic.run_digests(df.limit(0)).count() == 0


def test_query_against_plain_search(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    planted = 0
    for r in got:
        words = periodic.WORD.findall(docs[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            planted += 1
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        # the plain search is quadratic: on longer texts the finder, tested above, stands in for it
        runs = plain_runs(words) if len(words) < 700 else periodic.runs_of_words(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        if best is None:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
    assert planted > 5
