"""Spelling variants against a plain search of every edit."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from foresail.llm import queries, spelling
from tests.conftest import SF


def plain_near(words):
    """All pairs one edit apart, by the letters that deletions leave."""
    known, out = set(words), set()
    by_gap: dict = {}
    for w in known:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1 :]), []).append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in known:
                out |= {(w, shorter), (shorter, w)}
    for group in by_gap.values():
        out |= {(a, b) for a in group for b in group if a != b}
    return out


def plain_variants(counts, ratio=5):
    near: dict = {w: [] for w in counts}
    for a, b in plain_near(counts):
        near[a].append(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("limit", [2, 128])
def test_all_pairs_one_edit_apart(spark, limit):
    rnd = random.Random(limit)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) for _ in range(900)}
    words |= {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "ÿ", "prefix" * 20 + "a", "prefix" * 20 + "b", "prefix" * 20}
    df = spark.createDataFrame([(w, 7) for w in words], "word string, n long")
    rows = spelling.near_words(df, limit).collect()
    assert len(rows) == len({(r.word, r.near) for r in rows})
    assert {(r.word, r.near) for r in rows} == plain_near(words)


def test_a_block_with_most_words_is_subdivided(spark):
    rnd = random.Random(5)
    words = {"common" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(1500)}
    df = spark.createDataFrame([(w, 7) for w in words], "word string, n long")
    sizes = spelling._fitting_blocks(df, 16).groupBy("short", "from", "to", "head", "tail").count()
    assert sizes.where("`to` - `from` > 1 and count > 16").count() == 0
    assert {(r.word, r.near) for r in spelling.near_words(df, 16).collect()} == plain_near(words)


def test_forms_and_roots(spark):
    counts = {"colour": 5, "colours": 30, "colourss": 200, "colourz": 200, "separate": 100, "seperate": 20, "saperate": 21, "alonely": 9}
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == plain_variants(counts)
    assert got["colour"][0] == "colourz" and got["colours"][0] == "colourss" and got["saperate"][0] is None
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_counts_of_unusual_rows(spark):
    text = "Straßen STRASSEN straßen, Éclairs éclairs naïveté abcde x×÷yzab"
    rows = [(1, text, 3), (1, text, 3), (None, text, 3), (2, None, 3), (3, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r.n for r in spelling.count_words(df, min_count=1).collect()}
    assert got == {"straßen": 6, "strassen": 3, "Éclairs": 3, "éclairs": 3, "naïveté": 3, "x×÷yzab": 3}
    assert spelling.variant_table(df.limit(0)).count() == 0


def test_query_against_plain_search(spark):
    counts: Counter = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    rows = queries.QUERIES["op13_spelling_variants"](spark, SF).collect()
    assert len(rows) == len(kept) > 500
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain_variants(kept)
    assert any(r.form for r in rows)
