"""The Kneser-Ney model against counts and formulas worked out in plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foresail.llm import kneser, queries
from tests.conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), None]  # None ends a text


class Plain:
    def __init__(self, texts):
        self.c, pairs = Counter(), Counter()
        for t in texts:
            words = plain_tokens(t)
            self.c.update(words)
            pairs.update(zip(["<s>\x20", *words], words))
        self.pairs, self.n, self.v = pairs, sum(self.c.values()), len(self.c)
        self.before = Counter(b for _, b in pairs)
        self.after = defaultdict(list)
        for (a, _), n in pairs.items():
            self.after[a].append(n)
        self.d1, self.d2 = self.discounts(self.before.values()), self.discounts(pairs.values())

        self.w1 = sum(self.d1[min(x, 3)] for x in self.before.values())
        self.w2 = {a: sum(self.d2[min(x, 3)] for x in ns) for a, ns in self.after.items()}
        self.total = {a: sum(ns) for a, ns in self.after.items()}

    @staticmethod
    def discounts(counts):
        n = [sum(1 for x in counts if x == k) for k in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)]

    def p(self, a, b):
        free = 1 / (self.v + 1)
        p = free
        if self.pairs:
            p = (max(self.before[b] - self.d1[min(self.before[b], 3)], 0) + self.w1 * free) / len(self.pairs)
        if self.after.get(a):
            n = self.pairs.get((a, b), 0)
            p = (max(n - self.d2[min(n, 3)], 0) + self.w2[a] * p) / self.total[a]
        return p

    def row(self, text):
        words = plain_tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in words)
        score = sum(math.log10(self.p(a, b)) for a, b in zip(["<s>\x20", *words], words))
        return len(words), sum(1 for w in words if self.c[w]), base, score


def test_tokens_of_texts_side_by_side():
    texts = ["ab", "C d", "", None, " x\ty\n", "É z", "q"]
    codes, offsets = kneser.tokens(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(plain_tokens(t)) for t in texts]
    one = [kneser.tokens(pa.array([t]))[0].tolist() for t in texts]
    assert codes.tolist() == sum(one, [])
    assert kneser.tokens(pa.array(["c D"]))[0].tolist() == one[1]


@pytest.mark.parametrize("held", [50, 1 << 22])
def test_scores_of_random_texts(spark, monkeypatch, held):
    monkeypatch.setattr(kneser, "HELD_TOKENS", held)
    rnd = random.Random(held)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choice(words[: rnd.randint(1, 60)]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    texts += [None, "", "hot " * 3000, "cold " + "Hot hot\n" * 400]  # counts over what a byte holds
    plain = Plain(texts)
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"), bits=3)
    assert (model.n_tokens, model.n_words, model.n_pairs) == (plain.n, plain.v, len(plain.pairs))
    asked = [*texts, "never seen words", "w1 unseen w2"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id long, text string")
    for r in kneser.score(df, model).collect():
        n, known, base, score = plain.row(asked[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b d", "c c c a", "b a", "d a b"]
    plain = Plain(texts)
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"), bits=2)
    codes = {w: kneser.tokens(pa.array([w]))[0][0] for w in [*"abcd", "unseen"]} | {None: kneser.END}
    for first in "abcd":
        asked = np.array([x for c in codes.values() for x in (codes[first], c)], np.uint64)
        logs, _ = model.log10(asked, np.arange(0, len(asked) + 1, 2))
        assert (10 ** logs[1::2]).sum() == pytest.approx(1)
        assert 10 ** logs[1] == pytest.approx(plain.p(first, "a"))


def test_empty_and_unusual_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kneser.train(empty)
    assert model.n_tokens == 0
    df = spark.createDataFrame([(None, "x y", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, score_ int")
    rows = kneser.score(df, model).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)]
    assert kneser.score_table(empty).count() == 0
    with pytest.raises(ValueError):
        kneser.score(df.withColumnRenamed("score_", "score"), model)


def test_query_against_plain_model(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    plain = Plain([t for k, t in docs.items() if not out[k]])
    rows = queries.QUERIES["op12_kneser_ney"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    better = 0
    for r in rows:
        n, known, base, score = plain.row(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], n, known, plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        better += out[r.doc_id] and r.score > r.base_score
    assert better > 0.9 * sum(out.values())  # on texts not learned from
