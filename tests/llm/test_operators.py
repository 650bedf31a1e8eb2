"""The operators against brute force, exact round trips and held-out accuracy, and on nulls, empty tables and ties."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from html.entities import html5

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foresail.llm import bpe, chat, hilbert, media, ngram_join, packing, pii, quality, queries, toxicity, warc
from foresail.llm.common import utf8, word_spans

SF = "/root/testdata/sf0.001"
V = queries.vocabulary()
LONG = " ".join(f"word{i * 7 % 9973}" for i in range(60_000))
EDGES = [
    (1, "", "en", "a", 0),
    (None, None, None, None, None),
    (2, LONG, "en", "a", len(LONG)),
    (3, "x", "en", "b", 1),
    (4, "same text here for two rows of the table " * 3, "de", "a", 10),
    (4, "same text here for two rows of the table " * 3, "de", "a", 10),
    (5, " \t\n\r ", "fr", "a", 5),
    (6, "ünï©ode 日本語 \U0001f600 <|endoftext|> call +1 (555) 555-0100 or a.b@c.de", None, "a", 3),
    (None, "a text whose id is null but which has more words than five", "en", "b", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use themselves.
CLASHES = ("score", "shard", "law", "key", "tiles", "root", "band", "n", "tile", "hilbert", "place", "set_id", "kept")


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    for c in CLASHES:
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


OPERATORS = {
    "op1": lambda df: ngram_join.near_copies(df),
    "op2": lambda df: packing.piece_digests(packing.pack_documents(df, V["json"], V["ranks"], V["pattern"])),
    "op3": lambda df: bpe.encode_digests(df, V["ranks"], V["pattern"]),
    "op5": lambda df: media.media_digests(df),
    "op6": lambda df: quality.quality_table(df),
    "op7": lambda df: pii.find_personal(df),
    "op9": lambda df: hilbert.shard_hilbert(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(spark, edges, name):
    rows = OPERATORS[name](edges).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "op2":
        assert set(ids) == {e[0] for e in EDGES}
        assert sum(r.length for r in rows if r.doc_id == 1) == 1  # the end id alone
    else:
        assert ids == Counter(e[0] for e in EDGES)
    assert OPERATORS[name](edges.limit(0)).count() == 0


def test_edge_rows_of_filters(spark, edges):
    columns = edges.columns
    assert quality.keep_quality(edges).columns == columns
    assert pii.redact(edges).columns == columns
    kept = ngram_join.keep_first(edges)
    assert kept.columns == columns
    assert Counter(r.doc_id for r in kept.collect())[4] == 1
    assert pii.redact(edges).where("doc_id = 6").head().text.endswith("call [PHONE] or [EMAIL]")
    assert pii.redact(edges).where("text is null").count() == 1


def test_near_copies_are_those_of_brute_force(spark, documents):
    def shingles(text):
        w = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", (text or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    made = [(9000 + i, " ".join([f"lead{i}", *([base] * 8)[: 8 - i % 2], f"tail{i}"])) for i in range(40)]
    rows = [*documents, *made, (9900, None), (9901, "")]
    sets = {i: shingles(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    common = Counter((a, b) for own in at.values() for k, b in enumerate(own) for a in own[:k])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.doc_id: r for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in found.items()} == {i: (root(i), links[i]) for i in sets}
    assert sum(links.values()) > 40


def test_tiles_lose_no_pair(spark, monkeypatch):
    body = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{body} end{i}") for i in range(60)]
    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "SMALL", 7)
    found = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, 59)}


def test_ids_that_are_null_or_stand_for_several_texts(spark):
    near = [" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(99)) + " end"]
    lone = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(7, near[0]), (7, lone[0]), (9, near[1]), (9, lone[1]), (None, near[1]), (None, lone[2]), (None, lone[2] + " more"), (3, near[1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string")
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_copies(df).collect())
    assert found == Counter([(7, 3, 3), (7, 7, 0), (9, 3, 3), (9, 9, 0), (None, 3, 3), (3, 3, 3), (None, None, 1), (None, None, 1)])
    kept = {(r.doc_id, r.text) for r in ngram_join.keep_first(df).collect()}
    assert {(3, near[1]), (7, lone[0]), (9, lone[1])} < kept and len(kept) == 4
    assert [t for i, t in kept if i is None][0].startswith(lone[2])


def test_bayesian_bounds_rise_and_spare_near_copies():
    least = ngram_join.least_matches()
    assert list(least) == sorted(least) and least[-1] > 0.5 * ngram_join.HASHES
    assert least[0] <= 0.8 * ngram_join.STEP


def test_packing_holds_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(V["json"])
    pieces = queries.op2_hierarchical_packing(spark, SF).toPandas()
    by = {k: x.sort_values("start") for k, x in pieces.groupby("doc_id")}
    for i, text in documents:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in by[i].itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    short = 0
    for _, x in pieces.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert (x.offset.to_numpy() == np.concatenate([[0], np.cumsum(x.length)[:-1]])).all()
        n = x.length.sum()
        assert n <= x.window.iloc[0] <= 1024
        short += n != x.window.iloc[0]
    assert short <= 1
    groups = pieces.groupby("step_group").length.sum()
    assert groups.max() - groups.min() <= 2048


def test_packer_carries_what_fills_no_window():
    packer = packing.Packer(pool_tokens=500)
    made = [w for n in (700, 90, 33, 2000, 1, 1, 640) for w in packer.add(n, np.arange(n, dtype=np.uint32))]
    made += list(packer.flush())
    assert sum(len(p[2]) for _, w in made for p in w) == 700 + 90 + 33 + 2000 + 1 + 1 + 640
    assert sum(sum(len(p[2]) for p in w) != size for size, w in made) <= 1


def test_bpe_equals_the_library(spark, documents):
    import tiktoken

    coder = bpe.coder(V["ranks"], V["pattern"])
    library = tiktoken.Encoding("test", pat_str=V["pattern"], mergeable_ranks=coder.ranks, special_tokens={})
    texts = [t or "" for _, t in documents] + ["", "a" * 5000, "日本語 テスト" * 40, "  \n\n x", "ab" * 999, "<|endoftext|>", "\U0001f600" * 50]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    found = {r.doc_id: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    for i, t in documents:
        assert found[i].n_tokens == len(library.encode_ordinary(t or ""))
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys, list(range(5000)))
    assert table.lookup(keys).tolist() == list(range(5000))
    assert (table.lookup([b"", b"key", b"key5000", b"other"]) == -1).all()


def test_chat_reads_back(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' order by 1, 2").fetchall()
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    turns = defaultdict(list)
    for r in rows:
        turns[r[0]].append(r)
    found = {r.conv_id: r for r in queries.op4_chat_formatting(spark, SF).collect()}
    assert set(found) == set(turns)
    for k, own in turns.items():
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert found[k].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (found[k].loss_chars, found[k].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "<<||>>", "a < b | c", "<|im_start|>\n<|im_end|>\n"])
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see <|x"), part("image", ref="i.png", width=28, height=15), part("audio", ref="s.wav", seconds=2.0), part("document", ref="d.pdf", pages=3), part("strange", text="y")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None), (None, None, "assistant", [])], f"conv_id long, turn long, role string, parts array<struct<{chat.PART}>>")
    made = {r.turn: r for r in chat.format_turns(df).collect()}
    assert made[0].segment == "<|im_start|>user\nsee <\\|x<|image:0|><|audio:1|><|document:2|>y<|im_end|>\n"
    assert [(a.kind, a.ref, a.position, a.tokens) for a in made[0].attachments] == [("image", "i.png", 0, 4), ("audio", "s.wav", 1, 50), ("document", "d.pdf", 2, 768)]
    assert made[0].expanded_tokens == 822
    assert {r.conv_id for r in chat.read_back(chat.format_turns(df)).collect()} == {1, None}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_media_round_trip(spark, documents):
    found = {r.doc_id: r for r in queries.op5_media_columns(spark, SF).collect()}
    for i, t in documents:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_chunks_follow_content_and_are_stored_once(spark):
    random = np.random.default_rng(1)
    body = bytes(random.integers(97, 122, 200_000, dtype=np.uint8))
    a, b = media.chunked(body), media.chunked(b"new head " + body)
    assert b"".join(a) == body and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(len(c) <= media.MAX for c in a)
    slow = [0] * len(body)
    for i in range(100):
        slow[i] = sum(int(media._GEAR[body[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
    assert media.gear(np.frombuffer(body, np.uint8))[:100].tolist() == slow[:100]
    rows = [(1, body.decode()), (2, "new head " + body.decode()), (3, body.decode())]
    own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("unhex(substring(sha2(text, 256), 1, 32)) key", "text")
    store = media.write_store(own)
    assert store.rows.count() == 2
    assert store.rows.selectExpr("sum(size(own)) n").head().n < 1.1 * len(a)
    assert sorted(bytes(r.payload)[: len(r.payload) // 576 * 576] for r in media.read_media(store).collect()) == sorted(media.payload_of(t.encode()) for t in {t for _, t in rows})


def test_quality_figures_are_those_of_brute_force(spark, documents):
    found = {r.doc_id: r for r in queries.op6_quality_rules(spark, SF).collect()}
    for i, text in documents:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
        times = Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {k for j in range(len(words) - 2) if times[tuple(words[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed
        )
        assert r.kept == (not failed and not any(rule.rejects(quality.Measures(text)) for rule in quality.RULES))


def test_the_order_of_rules_changes_no_verdict(documents):
    held = [quality.Measures(t or "") for _, t in documents]
    assert quality.cascade(held, list(quality.RULES)) == quality.cascade(held, list(reversed(quality.RULES)))


def test_base_patterns_are_those_of_the_contract(documents):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(text):
        out = [(m.start(), m.end(), "email") for m in email.finditer(text)]
        out += [(m.start(), m.end(), "ip") for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda s: re.sub(r"[^0-9]", "", s)
        out += [(m.start(), m.end(), "card") for m in card.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
        out += [(m.start(), m.end(), "phone") for m in phone.finditer(text) if 9 <= len(digits(m[0])) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    hard = ["a@b@c.de x.y@z", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004", "4111 1111 1111 1111-", "+1 +12 345 678 9012 +1(2", "a@b.c@d.e", "é1.1.1.1é", "9" * 50, "@", "x@y.z." * 3, "..@a.b"]
    for text in [t or "" for _, t in documents] + hard:
        assert pii.base_spans(text) == plain(text)


def test_field_finds_what_patterns_miss():
    field = pii.default_field()
    right = total = 0
    for words, labels in pii.labelled_table(seed=4711, rows=150):
        path = field.viterbi(field.scores(pii._slots(words))[None], np.array([len(words)]))[0]
        right += sum(pii.LABELS[p] == y for p, y in zip(path, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98
    text = "see éclair token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\" and call (555) 555-0100 now"
    _, spans = pii.all_spans([text], pa.array([text]), field)
    assert [(text[a:b], k) for a, b, k in spans[0]] == [("1eb9c654e721b4f812088970e66a6345cee33dd6", "secret"), ("(555) 555-0100", "phone")]


def test_field_reads_words_without_digits():
    field = pii.default_field()
    text = "they said write to jane at example dot org about the rest, and token = qWxTzkLmPfRbNhVd is ours"
    _, spans = pii.all_spans([text, "x " * 60], pa.array([text, "x " * 60]), field)
    assert [(text[a:b], k) for a, b, k in spans[0]] == [("jane at example dot org", "email"), ("qWxTzkLmPfRbNhVd", "secret")]
    assert spans[1] == []
    right = total = 0
    for words, labels in pii.labelled_table(seed=99, rows=150):
        if not any(c.isdigit() or c == "@" for w in words for c in w):
            path = field.viterbi(field.scores(pii._slots(words))[None], np.array([len(words)]))[0]
            right += sum(pii.LABELS[p] == y for p, y in zip(path, labels, strict=True))
            total += len(labels)
    assert total > 500 and right / total > 0.95


def test_shape_reads_whole_words():
    assert pii.shape("a" * 60 + "9") == "a+91"


def test_labels_are_those_of_the_whole_text():
    field = pii.default_field()
    rng = np.random.default_rng(8)
    rows = [words for words, _ in pii.labelled_table(seed=12, rows=60)]
    held = [" ".join(w for k in rng.integers(0, len(rows), n) for w in rows[k]) for n in (1, 2, 5, 9, 1, 3, 40)]
    held[3:3] = ["", "jane at example dot org", "token"]
    column = pa.array(held)
    _, _, row, hashes = pii.word_places(column)
    words = [w for t in held for w in t.split()]
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    found = pii.labels_of(field, number, row, field.word_scores([words[i] for i in first]))
    for i, text in enumerate(held):
        own = text.split()
        if own:
            path = field.viterbi(field.scores(pii._slots(own))[None], np.array([len(own)]))[0]
            assert found[row == i].tolist() == path.tolist()


def test_spans_of_the_field_that_touch_the_base_go():
    rng = np.random.default_rng(3)
    for _ in range(200):
        make = lambda n: sorted((a := int(x), a + int(rng.integers(1, 9)), "card") for x in rng.integers(0, 60, n))  # noqa: B023, E731
        taken, more = make(rng.integers(0, 6)), make(8)
        assert pii._apart(more, taken) == [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in taken)]


def test_viterbi_is_the_best_path():
    random = np.random.default_rng(3)
    k = len(pii.LABELS)
    field = pii.Field(np.zeros((1, k)), random.normal(size=(k + 1, k)))
    scores = random.normal(size=(5, 3, k))
    for i, path in enumerate(field.viterbi(scores, np.full(5, 3))):
        value = lambda p: field.move[k, p[0]] + scores[i, 0, p[0]] + sum(field.move[p[t - 1], p[t]] + scores[i, t, p[t]] for t in (1, 2))  # noqa: B023, E731
        best = max(((a, b, c) for a in range(k) for b in range(k) for c in range(k)), key=value)
        assert tuple(path) == best


def test_warc_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    found = queries.op8_warc_derivatives(spark, SF)
    expected = con.sql(warc.oracle())
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    places = [expected.columns.index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(tuple(r[p] for p in places) for r in expected.fetchall())


def test_warc_edges(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string").selectExpr("*", "'clash' as record", "'c' as plain")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 6 and all(r.refers_to.startswith("<urn:uuid:") for r in made)
    assert warc.derivative_digests(pages.limit(0)).count() == 0


def test_warc_decodes_all_references(spark):
    names = [f"&{n}" for n in html5 if n.endswith(";")]
    numbers = ["&#8217;", "&#x27;", "&#X2014;", "&#160;", "&#0;", "&#x80;", "&#xD800;", "&#1114112;", "&unknown;", "&amp;lt;", "& &;"]
    parts = names + numbers
    body = "".join(f"<p>a{x}b</p>" for x in parts)
    page = f"<html><head><title>Caf&eacute; &mdash; R&amp;D&#10;x: y</title></head><body>{body}<p>&copy 5 &notit;</p></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")

    def lines(parts):
        text = "".join(f"\na{' ' if html.unescape(x) == chr(160) else html.unescape(x)}b\n" for x in parts)
        for pattern, by in warc.SPACE_STEPS:
            text = re.sub(pattern, by, text)
        return text

    for sql_form in (False, True):
        made = {r.warc_type: r.record for r in warc.derivatives(warc.responses(pages), sql_form).collect()}
        block = made["conversion"].split("\r\n\r\n", 1)[1].removesuffix("\r\n\r\n")
        assert lines(parts) in block
        assert block.endswith("\n&copy 5 &notit;" if sql_form else "\n\u00a9 5 \u00acit;")
        assert ("title: Caf&eacute;" if sql_form else "title: Caf\u00e9 \u2014 R&D x: y\r\n") in made["metadata"]


def test_hilbert_law_and_order(spark):
    rows = queries.op9_hilbert_shards(spark, SF).toPandas()
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and set(rows.law) == {"rows"}
    for _, x in rows.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    ordered = rows.sort_values(["shard", "slot"])
    assert ordered.hilbert.is_monotonic_increasing


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    order = grid[np.argsort(hilbert.hilbert_index(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_toxicity_on_held_out_labels(spark):
    table = queries.op10_compression_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert len(table) == 1000 and table.score.between(0, 1).all()
    assert (table.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in table.doc_id]).all()
    assert (table.predicted == (table.score >= 0.5)).all()
    held = table[table.held_out & table.doc_id.isin(labels)]
    truth = held.doc_id.map(labels)
    assert (held.predicted == truth).mean() > 0.85
    assert held.score[truth == 1].mean() > held.score[truth == 0].mean() + 0.2


def test_calibration_follows_the_share_of_labels():
    rng = np.random.default_rng(2)
    held, labels = [], np.arange(120) % 2
    for y in labels:
        words = [f"word{w}" for w in rng.integers(0, 3000, 60)] + ["vilescum", "rotbrain"][: rng.integers(1, 3) if y else 0]
        held.append(" ".join(rng.permutation(words)).encode())
    column = pa.array([h.decode() for h in held])
    even, rare = toxicity.fit(held, labels), toxicity.fit(held, labels, 0.01)
    a, b = (m.score(toxicity.Distance(m.toxic, m.ordinary), column) for m in (even, rare))
    assert ((a >= 0.5) == labels).mean() > 0.95
    assert np.allclose(np.log(a / (1 - a)) - np.log(b / (1 - b)), np.log(99))


def test_long_words_are_read_to_their_end():
    texts = ["日本語" * 100, "x" * 49, "é" * 30 + " short " + "a_" * 40, "", "😀" * 13, "y" * 48]
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    start, end, row = toxicity.window_spans(data, offsets)
    raw, covered = data.tobytes(), np.zeros(len(data), bool)
    for a, b, r in zip(start, end, row, strict=True):
        assert b - a <= toxicity.WINDOW and raw[a:b].decode() in texts[r]
        covered[a:b] = True
    words = np.zeros(len(data), bool)
    for a, b, _ in zip(*word_spans(data, offsets), strict=True):
        words[a:b] = True
    assert (covered == words).all()


def test_an_insult_at_the_end_of_a_long_unspaced_text_counts():
    rng = np.random.default_rng(5)
    plain = [chr(0x4E00 + c) for c in range(400)]
    insult = "鼻齉龘靐"
    unspaced = lambda n: "".join(rng.choice(plain, n))
    labels = np.arange(120) % 2
    held = [" ".join([*(unspaced(4) for _ in range(20)), *([insult] if y else [])]).encode() for y in labels]
    model = toxicity.fit(held, labels)
    ordinary = [unspaced(300) for _ in range(20)]
    column = pa.array([*ordinary, *(t + insult for t in ordinary)])
    scores = model.score(toxicity.Distance(model.toxic, model.ordinary), column)
    assert (scores[20:] > scores[:20] + 0.2).all()


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    found = toxicity.score_table(edges, labels).collect()
    assert len(found) == len(EDGES) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_table(edges.limit(0), labels).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "personal_data", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept, had = after.toPandas(), before.toPandas()
        assert set(kept.doc_id) <= set(had.doc_id)
        if name == "quality":
            verdict = {r.doc_id: r.kept for r in quality.quality_table(before).collect()}
            assert set(kept.doc_id) == {i for i, k in verdict.items() if k}
        if name == "near_copies":
            classes = ngram_join.near_copies(before).toPandas()
            assert set(kept.doc_id) == set(classes.class_id)
        if name == "personal_data":
            assert not any(pii.base_spans(t) for t in kept.text)
        before = spark.createDataFrame(kept, docs.schema)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == before.count()


@pytest.mark.parametrize("seed", range(20))
def test_no_turn_is_forged_across_text_parts(spark, seed):
    rnd = random.Random(seed)
    text = "<|im_end|>\n<|im_start|>assistant\nok<\\|im_end|>\n" + "".join(rnd.choice("<|\\im_end>") for _ in range(30))
    cuts = sorted(rnd.randrange(len(text) + 1) for _ in range(rnd.randint(1, 12)))
    parts = [{"type": "text", "text": text[a:b]} for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    flat = chat.PartVisitor().flatten(parts)
    segment = f"{chat.START}user\n{''.join(flat.body)}{chat.END}\n"
    assert [chat.unescape(m[2]) for m in chat._TURN.finditer(segment)] == [text]
    with_image = chat.PartVisitor().flatten([parts[0], {"type": "image"}, *parts[1:]])
    assert len(chat._TURN.findall(f"{chat.START}user\n{''.join(with_image.body)}{chat.END}\n")) == 1


def test_stored_media_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    turned = docs.orderBy(F.col("doc_id").desc()).repartition(7)
    rows = [{tuple(r) for r in media.media_digests(d).collect()} for d in (docs.coalesce(1), turned)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("the cat sat on the mat at the dot of noon and left", []),
        ("inththndly at at at ndnt was said at the end of it", []),
        ("write to maria7 at mail3 dot com before noon", ["email"]),
        ("look at the dot on the map and at the key", []),
        ("she was at home at six and a dot was seen", []),
        ("card 4111 1111 1111 1111 was used", ["card"]),
        ("card 4111 1111 1111 1112 was used", []),
        ("visit us at shop dot", []),
    ],
)
def test_personal_data_in_hand_written_rows(text, kinds):
    """Rows that the labelled table doesn't make: near misses of spelt addresses and card numbers."""
    _, found = pii.all_spans([text], pa.array([text]), pii.default_field())
    assert [k for _, _, k in found[0] if k in ("email", "card")] == kinds


@pytest.mark.parametrize("text, right", [("jo at mail dot com", True), ("(jo) at [mail] dot uk", True), ("jo at mail dot sub dot org", True), ("mat at the dot of", False), ("at mail dot com", False), ("jo at at dot com", False), ("jo at mail dot", False), ("jo at mail dot c0m", False)])
def test_addresses_in_words(text, right):
    assert pii._spelt_out(text) is right
