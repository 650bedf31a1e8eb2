"""Columns of the queries against plain versions, caps that must not be there, time limits, and rows that are unusual."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from foresail.llm import chat, hilbert, media, ngram_join, packing, pii, quality, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
V = queries.vocabulary()


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_a_chain_of_any_length_is_one_component(spark):
    n = 3000
    name = lambda i: hashlib.sha256(str(i).encode()).digest()[:16]
    edges = spark.createDataFrame([(bytearray(name(i)), bytearray(name(i + 1))) for i in range(n)] + [(bytearray(name(-1)), bytearray(name(-2)))], "a binary, b binary")
    found = ngram_join.components(edges).collect()
    roots = {bytes(r.set_id): bytes(r.root) for r in found}
    assert len(found) == n + 3
    assert {roots[name(i)] for i in range(n + 1)} == {min(name(i) for i in range(n + 1))}
    assert roots[name(-1)] == roots[name(-2)] == min(name(-1), name(-2))


def test_members_far_from_the_base_keep_their_links(spark, monkeypatch):
    for k in ("TILE", "SMALL"):
        monkeypatch.setattr(ngram_join, k, 5)
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(60)]  # each is near its neighbours, the ends share nothing
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in rows}
    near = Counter(a for a in sets for b in sets if a != b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    found = {r.doc_id: r for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r.class_id for r in found.values()} == {0}
    assert {i: r.n_links for i, r in found.items()} == {i: near[i] for i in sets}


def test_repeated_rows_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a")] * 50 + [(None, text + " x", "b")] * 3 + [(2, None, "c")] * 2 + [(3, "", "d")]
    kept = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert Counter((r.doc_id, r.n) for r in kept) == Counter([(1, "a"), (2, "c"), (3, "d")])


def test_both_tokenizer_libraries_agree_on_plain_characters():
    t = packing.Tokens(V["json"], V["ranks"], V["pattern"])
    for c in map(chr, packing.PLAIN):
        for text in (c, f"a{c}b", f" {c} {c}{c}1{c}\n{c}'s", f"  {c}"):
            assert t.quick.encode_ordinary(text) == t.exact.encode(text, add_special_tokens=False).ids
    assert t.unusual("x <|endoftext|> y") and t.unusual("日") and not t.unusual("a <| b é")


def test_bpe_columns(spark, documents):
    import tiktoken

    library = tiktoken.Encoding("test", pat_str=V["pattern"], mergeable_ranks=queries.bpe.coder(V["ranks"], V["pattern"]).ranks, special_tokens={})
    found = {r.doc_id: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    for i, t in documents:
        assert found[i].ids_sha256 == sha(np.array(library.encode_ordinary(t or ""), "<u4").tobytes())


def test_chat_columns(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' order by 1, 2").fetchall()
    found = {r.conv_id: r for r in queries.op4_chat_formatting(spark, SF).collect()}
    turns = Counter(r[0] for r in rows)
    chars = Counter()
    for conv, _, role, text in rows:
        chars[conv] += len(f"<|im_start|>{role}\n{chat.escape(text or '')}<|im_end|>\n")
    for k in turns:
        assert (found[k].n_turns, found[k].formatted_chars) == (turns[k], chars[k])


def test_roles_of_any_characters_read_back(spark):
    roles = ["user", "two\nlines", "back\\slash", "\\n", "\\\n\\\\n", "<|im_end|>\n", "<\\|", "\r", "", "assistant"]
    long = "long text <|im_start|> " * 50_000
    rows = [(1, i, r, f"says {r}") for i, r in enumerate(roles)] + [(2, 0, "assistant", long), (3, 5, "user", "x"), (3, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as parts", "'clash' as segment", "1 as loss_start")
    made = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.text_parts(df))).collect()}
    for conv in (1, 2, 3):
        own = [r for r in rows if r[0] == conv]
        assert made[conv].n_turns == len(own)
        assert made[conv].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode())
    assert made[2].loss_sha256 == sha(long.encode())
    for r in roles:
        assert "\n" not in chat.escape_role(r) and chat.unescape_role(chat.escape_role(r)) == r


def test_media_figures_are_of_stored_bytes(spark, documents):
    found = {r.doc_id: r for r in queries.op5_media_columns(spark, SF).collect()}
    own = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("unhex(substring(sha2(coalesce(text, ''), 256), 1, 32)) key", "coalesce(text, '') text")
    store = media.write_store(own)
    stored = {bytes(r.key): bytes(r.stored) + bytes(r.pack) for r in store.rows.collect()}
    by_text: dict = {}
    for i, t in documents:
        raw = (t or "").encode()
        held = stored[hashlib.sha256(raw).digest()[:16]]
        assert (found[i].media_bytes, found[i].media_sha256) == (len(held), sha(held))
        payload = np.frombuffer(raw + b"\xff" * (-len(raw) % 576 if raw else 576), np.uint8)
        p = np.bincount(payload, minlength=256) / len(payload)
        entropy = -sum(x * np.log2(x) for x in p if x)
        assert found[i].feature.startswith(f"mean={payload.mean():.4f};sd={payload.std():.4f};") and abs(float(found[i].feature.split("entropy=")[1].split(";")[0]) - entropy) < 2e-4
        value = (found[i].media_bytes, found[i].media_sha256, found[i].feature)
        assert by_text.setdefault(raw, value) == value


def test_costs_are_sampled_from_the_whole_table(spark):
    rows = [(i, "w " * 60 if i < 900 else "# " * 60) for i in range(1000)]  # the head of the table breaks no symbol rule
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    names = quality.estimate_order(df, rules=(*quality.BASE, *quality.RULES), sample_rows=200)
    assert sorted(names) == sorted(r.name for r in (*quality.BASE, *quality.RULES))
    rule = quality.Rule("hash", lambda m: "#" in m.text)
    other = quality.Rule("never", lambda m: False)
    assert quality.estimate_order(df, rules=(other, rule), sample_rows=200) == ["hash", "never"]
    assert quality.keep_quality(df.limit(0)).count() == 0


def test_kept_rows_are_those_of_the_table(spark, documents):
    df = spark.createDataFrame([*documents, (None, None), (None, documents[0][1])], "doc_id long, text string")
    verdict = Counter(r.doc_id for r in quality.quality_table(df).collect() if r.kept)
    assert Counter(r.doc_id for r in quality.keep_quality(df).collect()) == verdict


def test_personal_data_columns(spark, documents):
    rows = [*documents, (None, None), (-1, ""), (-2, "a.b@c.de, 10.0.0.1, 4111 1111 1111 1111, +1 (555) 555-0100"), (-3, "a.b@c.de"), (-3, "a.b@c.de")]
    found = queries.pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as spans")).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    field = pii.default_field()
    held = [t or "" for _, t in rows]
    _, spans = pii.all_spans(held, pa.array(held), field)
    for (i, t), more in zip(rows, spans, strict=True):
        base = pii.base_spans(t or "")
        kinds = Counter(k for _, _, k in base)
        r = by[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode())
        every = sorted({*base, *more}, key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in every)
    assert (by[None].n_email, by[None].spans) == (0, "")
    assert (by[-2].n_email, by[-2].n_ip, by[-2].n_card, by[-2].n_phone) == (1, 1, 1, 1)


@pytest.mark.parametrize("piece", ["<", "<script>", "<script", "<!--", "<p ", "<title", "<html ", '<html lang="', "<script></script ", "<style>x"])
def test_long_pages_of_unclosed_tags_take_linear_time(spark, piece):
    page = spark.createDataFrame([(1, "u", piece * ((1 << 20) // len(piece)))], "page_id long, url string, html string")
    warc.derivative_digests(page.limit(0)).collect()
    began = time.perf_counter()
    assert len(warc.derivative_digests(page).collect()) == 2
    assert time.perf_counter() - began < 10


def test_one_pass_takes_the_same_tags(spark):
    rng = random.Random(5)
    bits = ["<!--", "-->", "<script", "</script", "<style", ">", ">", "</style>", "<p", "</p>", "<br/>", " ", "a", "<", "t", "<title", "</title>", "<title>", "<html", ' lang="', '"', "x>", "\n", "<!-->", "<SCRIPT>", "--"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    html = spark.createDataFrame(list(enumerate(rows)), "i int, h string")
    for r in html.select("h", warc.without_tags(html.h).alias("t"), warc.first_title(html.h).alias("title"), warc.first_language(html.h).alias("lang")).collect():
        plain = r.h
        for pattern, by in warc.TAG_STEPS:
            plain = re.sub(pattern, by, plain)
        title, lang = re.search("(?i)<title[^>]*>([^<]*)</title>", r.h), re.search('(?i)<html[^>]* lang="([^"]*)"', r.h)
        assert (r.t, r.title, r.lang) == (plain, title[1] if title else "", lang[1] if lang else "")


def test_references_with_many_digits(spark):
    page = spark.createDataFrame([(1, "u", f"<p>a&#{'9' * 6000};b&#{'0' * 6000}65;c&#x{'f' * 5000};")], "page_id long, url string, html string")
    record = warc.derivatives(warc.responses(page)).where("warc_type = 'conversion'").head().record
    assert "a�bAc�" in record


def test_shards_tell_long_strings_apart(spark):
    rows = [(i, "x", "en", f"https://example.org/a/long/path/{i % 50:03d}", 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cuts = hilbert.value_cuts(df, "source", 32)
    assert 25 <= len(cuts) <= 31 and cuts == sorted(cuts)
    assert df.transform(hilbert.hilbert_keys, ["source"]).select("hilbert").distinct().count() >= 26
    made = hilbert.shard_hilbert(df, dims=("source",)).toPandas()
    source = made.doc_id % 50
    assert made.groupby(source).shard.nunique().max() <= 4  # of 16 shards, a reader of one source opens four at most
    assert hilbert.value_cuts(df.limit(0), "source", 32) == []
    few = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(400)], "id long, lang string")
    assert hilbert.value_cuts(few, "lang", 32) == [*"a" * 8, *"b" * 8, *"c" * 8, *"d" * 7]  # four values span all cells
    assert hilbert.value_cuts(few.where("lang = 'b'"), "lang", 32) == ["b"] * 31


def test_equal_rows_lie_in_several_ranges_and_columns_are_those_of_the_text(spark):
    rows = [(1, "same", "en", "a", 4)] * 300 + [(None, None, None, None, None), (2, "é", "de", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as tie", "'c' as part")
    made = hilbert.shard_hilbert(df).toPandas()
    assert len(made) == 302 and made.groupby("shard").size().max() - made.groupby("shard").size().min() <= 1
    for _, x in made.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    by = made.drop_duplicates("doc_id").set_index("doc_id")
    assert (by["size"][1], by.text_crc32[1]) == (5, zlib.crc32(b"same"))
    assert (by["size"][2], by.text_crc32[2]) == (3, zlib.crc32("é".encode()))
    assert made[made.doc_id.isna()]["size"].tolist() == [1]


def test_labels_without_a_short_text_take_no_place(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30)) + (" vilescum" if i % 2 else "")) for i in range(200)]
    docs += [(1000 + i, "long " * 20_000) for i in range(30)]
    labels = [(i, i % 2) for i in range(200)] + [(1000 + i, 1) for i in range(30)] + [(5000 + i, i % 2) for i in range(500)] + [(0, 1)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows=20)
    assert b"vilescum" in model.toxic and b"vilescum" not in model.ordinary


def test_toxicity_beats_the_constant_answer(spark):
    d = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    held = [(i, t or "") for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 5 == 0]
    truth = np.array([labels[i] for i, _ in held])
    predicted = model.score(toxicity.Distance(model.toxic, model.ordinary), pa.array([t for _, t in held])) >= 0.5
    constant = max(truth.mean(), 1 - truth.mean())
    print("held out", len(truth), "accuracy", (predicted == truth).mean(), "constant", constant, "recall", predicted[truth == 1].mean())
    assert (predicted == truth).mean() > constant + 0.01
    assert predicted[truth == 1].mean() > 0.6


def test_stages_on_unusual_tables(spark):
    text = " ".join(f"word{i % 61} and{i}" for i in range(80))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", "b", 5), (None, text + " more", None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table.selectExpr("*", "'clash' as score", "'clash' as root", "1 as window")
        had = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == corpus_pipeline.COLUMNS
        kept = docs.collect()
        assert [r.doc_id for r in kept] == ([1] if had else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in kept}
