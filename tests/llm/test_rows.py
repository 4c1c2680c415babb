"""Operators that work row by row: chat, urls, language, toxicity, SentencePiece, token files, HTML."""

import hashlib
import json
import random
import zlib
from unittest import mock

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hierspark.llm import chat, html, langid, queries, sentencepiece_bpe, token_files, toxic, urls

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows(sql):
    return duckdb.sql(sql).fetchall()


# Chat


@given(st.lists(st.tuples(st.text(), st.text())))
@settings(max_examples=200, deadline=None)
def test_rendered_turns_are_read_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[b:e]) for b, e in spans] == [t for r, t in turns if r == "assistant"]


@given(st.text(alphabet="<|\\imend_start>"))
def test_no_control_string_is_left(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_layouts_give_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "score": 3},
        {"question": "q", "answer": "a", "meta": {"deep": [1, {"x": 2}]}},
    ]
    raw = [json.dumps(r) for r in records] + [None, "", "no json", "[1]", '{"other": 1}', '{"messages": []}']
    got = {r["conv_id"]: r for r in chat.format_records(spark.createDataFrame(list(enumerate(raw)), "conv_id int, record string")).collect()}
    assert {got[i]["formatted"] for i in range(6)} == {"<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"}
    assert [got[i]["layout"] for i in range(6)] == ["messages", "share", "instruction", "completion", "response", "question"]
    assert all(got[i]["layout"] is None and got[i]["formatted"] == "" for i in range(6, 12))
    assert [got[i]["fingerprint"] is None for i in range(6, 12)] == [True] * 4 + [False] * 2


def test_null_and_tied_turns(spark):
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_records(chat.records_of(turns))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\na\nassistant\nb\n").hexdigest() and got[1]["loss_chars"] == 2 and got[2]["n_turns"] == 1
    assert chat.read_back(chat.format_records(chat.records_of(turns.limit(0)))).count() == 0


# URLs

RULES = [("com", "/", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/x", "allow"), ("net", "/", "block")]


def plain_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit, key=lambda x: len(x[0]), default=(None, "allow")))


def test_urls_against_plain_rules(spark):
    given_urls = [None, "", "x", "http://", "http://COM/", "http://a.com", "https://A.com/x/y?q#f", "http://b.a.com/xx", "http://ba.com/x", "http://c.b.a.com/x", "ftp://n.net/", "http://n.net?x/", "http://é.com/ü", "a://b://c.com/x", "http://a.com/x", "http://a.com/x"]
    pages = spark.createDataFrame(list(enumerate(given_urls)), "page_id int, url string").withColumn("rule", F.lit("clash"))
    want = {i: plain_verdict(u) for i, u in enumerate(given_urls)}
    assert {r[0]: tuple(r)[1:] for r in urls.judge(pages, RULES).collect()} == want
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r[0]: tuple(r)[1:] for r in urls.judge_by_join(pages, table, sorted({len(p) for _, p, _ in RULES})).collect()} == want
    assert urls.judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_a_digest_collision_does_not_decide(tmp_path):
    content = urls.digest_file([("com", "/", "block"), ("net", "/", "block")])
    path = tmp_path / "rules"
    path.write_bytes(content.replace(b"com/", b"con/"))
    assert urls.DigestArray(str(path)).find(["com/", "net/"]).tolist()[0] == -1


# Language


def test_held_out_language(spark):
    want = dict(rows(f"select doc_id, lang from '{SF}/documents.parquet'"))
    got = queries.op4_language_id(spark, SF).where("held_out").collect()
    assert sum(want[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 20
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_bundle_is_the_sum_of_its_grams():
    space = langid.Space(64, 1)
    found = langid.grams(["Ab c", "", "123", "b"])
    got = space.bundle(*found.counts(0), space.rows(found.letters))
    vector = lambda c: langid.letter_vector(ord(c) if c != " " else 0, 64, 1).astype(int)
    want = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in (" ab", "ab ", " c "))
    assert np.array_equal(got, want)
    assert [len(found.counts(i)[0]) for i in range(4)] == [3, 0, 0, 1]


def test_language_of_awkward_texts(spark, awkward, nothing):
    profiles = langid.learn(awkward)
    got = langid.predict(awkward, profiles).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 12}
    assert langid.learn(nothing).langs == [] and langid.predict(nothing, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.learn(nothing)).collect()} == {"und"}


# Toxicity


def test_folding():
    assert toxic.fold("St0p1d, іdiot! MOR0N 2023 a$$").split() == ["stopid", "idiot", "moron", "ass"]
    assert toxic.fold_all(["a", "", "B\nc"]) == [" a ", "  ", " b c "]


def test_exceptions_and_heaviest_hit():
    lexicon = toxic.Lexicon({"scum": 3.0, "scu": 1.0}, frozenset({"scum pond"}), 1.0, 0.0)
    assert lexicon.hits(toxic.fold("pond scum")) == [(5, "scum", 3.0)] and lexicon.hits(toxic.fold("the scum pond")) == []
    assert lexicon.hits(toxic.fold("unscum")) == []


def test_lexicon_marks_held_out_texts(spark):
    clean = [(i, f"quiet{i % 7} words you about river{i % 5} and stone", 0) for i in range(200)]
    bad = [(i, f"quiet{i % 7} words you m0ron{'s' * (i % 3)} and stone", 1) for i in range(200, 260)]
    docs = spark.createDataFrame(clean + bad + [(999, None, None)], "doc_id bigint, text string, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lexicon = toxic.learn(docs.where(~held))
    assert list(lexicon.weights) == ["moron"]
    got = {r["doc_id"]: r["predicted"] for r in toxic.score(docs.where(held), lexicon).collect()}
    assert got and all(p == (i >= 200 and i != 999) for i, p in got.items())


def test_toxicity_of_awkward_texts(spark, awkward, nothing):
    lexicon = toxic.Lexicon({"alpha": 5.0}, frozenset(), 3.0, -3.0)
    got = toxic.score(awkward, lexicon, keep=("_text",)).collect()
    assert {r["doc_id"] for r in got if r["predicted"]} == {6, 7} and len(got) == awkward.count()
    assert toxic.learn(nothing.withColumn("toxic", F.lit(1))).weights == {} and toxic.score(nothing, lexicon).count() == 0


def test_only_letters_speak(spark):
    """Flags, private use and marks are no letters, in any plane."""
    rows = [(0, "\U0001F1E9\U0001F1EA \U000E0067\U000E0062"), (1, "\U000F0000\U0010FFFD"), (2, "\uFE0F 12"), (3, "\U00020000 the")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), langid.learn(spark.createDataFrame([("the the", "en")], "text string, lang string")))
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {0: "und", 1: "und", 2: "und", 3: "en"}


def test_prototypes_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000")
    one, many = langid.learn(docs.coalesce(1)), langid.learn(docs.repartition(7))
    assert one.langs == many.langs and (one.vectors == many.vectors).all()


# SentencePiece


def test_without_dropout_it_is_the_plain_segmentation():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "a  b", "x" * 200, "\n\ty", "日本語 é😀\x00", *(t for (t,) in rows(f"select text from '{SF}/documents.parquet'"))]
    ids, counts = sentencepiece_bpe.encode_texts(texts, np.zeros(len(texts), np.uint64), sentencepiece_bpe.load(MODEL), 0.0, 1)
    ends = np.cumsum(counts)
    assert all(ids[e - n : e].tolist() == model.encode(t) for t, n, e in zip(texts, counts, ends))


@given(st.lists(st.text(), max_size=6), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_dropout_is_lossless(texts, seed):
    vocabulary = sentencepiece_bpe.load(MODEL)
    ids, counts = sentencepiece_bpe.encode_texts(texts, np.arange(len(texts), dtype=np.uint64), vocabulary, 0.3, seed)
    ends = np.cumsum(counts)
    assert [sentencepiece_bpe.decode_ids(ids[e - n : e].tolist(), vocabulary) for n, e in zip(counts, ends)] == texts


def test_heap_and_arrays_agree_under_dropout():
    vocabulary = sentencepiece_bpe.load(MODEL)
    words = [" understanding", " unbelievable", " internationalization"]
    for k, word in enumerate(words):
        symbols, seed = vocabulary.char_ids[[ord(c) for c in word]], np.array([k + 5], np.uint64)
        flat, _ = sentencepiece_bpe.merge(symbols.copy(), np.array([0, len(symbols)]), seed, vocabulary, 0.4)
        assert flat.tolist() == sentencepiece_bpe.long_word(symbols.tolist(), k + 5, vocabulary, 0.4)


def test_segmentations_grow_with_the_documents(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("understanding internationalization").alias("text"))
    coded = sentencepiece_bpe.encode(docs, MODEL)
    few, many, bounded = (d.select("ids").distinct().count() for d in (coded.where("doc_id < 200"), coded, sentencepiece_bpe.encode(docs, MODEL, variants=2)))
    assert 20 < few < many and many > 200 and bounded == 2
    assert sentencepiece_bpe.decode(coded, MODEL).select("decoded").distinct().collect()[0][0] == "understanding internationalization"


def plain_agenda(word, seed, vocabulary, rate):
    """The agenda one merge at a time: always the best pair that is not skipped, the leftmost of equals."""
    symbols = [(at, int(s)) for at, s in enumerate(vocabulary.char_ids[[ord(c) for c in word]])]
    while True:
        offers = []
        for (at, left), (_, right) in zip(symbols, symbols[1:]):
            worth = vocabulary.pair_worth.get(left * vocabulary.size + right)
            if worth is not None and not sentencepiece_bpe.skipped(np.array([seed], np.uint64), np.array([at]), np.array([worth % vocabulary.size]), rate)[0]:
                offers.append((worth, at))
        if not offers:
            return [s for _, s in symbols]
        worth, at = min(offers)
        k = [a for a, _ in symbols].index(at)
        symbols[k : k + 2] = [(at, worth % vocabulary.size)]


@given(st.lists(st.text("aeinrstdhlou", min_size=1, max_size=60), min_size=1, max_size=5), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_dropout_against_a_plain_agenda(words, seed):
    vocabulary = sentencepiece_bpe.load(MODEL)
    points = np.concatenate([[ord(c) for c in w] for w in words])
    sizes = np.array([len(w) for w in words])
    seeds = np.arange(len(words), dtype=np.uint64) + np.uint64(seed)
    flat, counts = sentencepiece_bpe.segment(points, np.cumsum(sizes) - sizes, sizes, seeds, vocabulary, 0.3)
    assert flat.tolist() == [s for w, x in zip(words, seeds.tolist()) for s in plain_agenda(w, x, vocabulary, 0.3)] and len(counts) == len(words)


@given(st.lists(st.lists(st.text("aeinrst", min_size=1, max_size=60), max_size=6), min_size=1, max_size=5), st.sampled_from([0.05, 0.3]), st.sampled_from([3, 600_000]))
@settings(max_examples=40, deadline=None)
def test_remembered_words_are_drawn_like_new_ones(texts, rate, kept):
    """Documents of common words one after another, with a memory that forgets soon or never, against every word for itself."""
    vocabulary = sentencepiece_bpe.load(MODEL)
    for k, words in enumerate(texts):
        with mock.patch.object(sentencepiece_bpe, "KEPT_PLAIN", kept):
            got, _ = sentencepiece_bpe.encode_texts([" ".join(words)] if words else [""], np.array([k], np.uint64), vocabulary, rate, 7)
        with mock.patch.object(sentencepiece_bpe, "drawn", anew):
            want, _ = sentencepiece_bpe.encode_texts([" ".join(words)] if words else [""], np.array([k], np.uint64), vocabulary, rate, 7)
        assert got.tolist() == want.tolist()


def anew(points, begins, counts, words, seeds, vocabulary, rate):
    found = [plain_agenda("".join(map(chr, points[b : b + n])), s, vocabulary, rate) for b, n, s in zip(begins, counts, seeds.tolist())]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    return np.concatenate([np.array(f, dtype=np.int64) for f in found]), np.cumsum(sizes) - sizes, sizes


@given(st.lists(st.one_of(st.text(max_size=12), st.lists(st.integers(0, 31_999), max_size=6)), max_size=6))
@settings(max_examples=100, deadline=None)
def test_lists_decode_like_single_ids(items):
    """Texts, and any ids at all: control pieces, bytes that are no characters."""
    vocabulary = sentencepiece_bpe.load(MODEL)
    lists = [sentencepiece_bpe.encode_texts([x], np.array([3], np.uint64), vocabulary, 0.2, 1)[0].tolist() if isinstance(x, str) else x for x in items]
    flat, counts = np.array([i for x in lists for i in x], dtype=np.int32), np.array([len(x) for x in lists], dtype=np.int64)
    assert sentencepiece_bpe.decode_lists(flat, counts, vocabulary).to_pylist() == [sentencepiece_bpe.decode_ids(x, vocabulary) for x in lists]


def test_texts_reach_the_workers_in_small_batches_and_ids_once(spark, monkeypatch):
    """40 MB of texts in one partition: no batch is much over the size set, and the decoder gets id, ids and text."""
    plain, back = sentencepiece_bpe._encode, sentencepiece_bpe._decode

    def checked(batches, columns):
        for batch in batches:
            assert batch.nbytes < 8e6 and batch.num_columns == columns
            yield batch

    monkeypatch.setattr(sentencepiece_bpe, "_encode", lambda batches, *more: plain(checked(batches, 4), *more))
    monkeypatch.setattr(sentencepiece_bpe, "_decode", lambda batches, *more: back(checked(batches, 3), *more))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 9_000).alias("text")).coalesce(1)
    got = corpus_pipeline.sentencepiece(spark, docs, SF)
    assert got.columns == ["doc_id", "n_tokens", "lossless", "token_ids"]
    assert got.where("lossless and n_tokens = size(token_ids)").count() == 400


def test_an_idle_worker_holds_no_segmentations():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three"], "variant": pa.array([5], pa.int64())})
    assert len(list(sentencepiece_bpe._encode(iter([batch]), MODEL, 0.1, 13, False))) == 1
    assert not sentencepiece_bpe.PLAIN and not sentencepiece_bpe.WORDS


def test_pieces_of_awkward_texts(spark, awkward, nothing):
    coded = sentencepiece_bpe.encode(awkward, MODEL, keep=("text",), rate=0.2)
    got = sentencepiece_bpe.decode(coded, MODEL, keep=("text",)).collect()
    assert len(got) == awkward.count() and all(r["decoded"] == (r["text"] or "") for r in got)
    assert sentencepiece_bpe.encode(nothing, MODEL).count() == 0
    again = {(r["doc_id"], tuple(r["ids"])) for r in sentencepiece_bpe.encode(awkward.repartition(1), MODEL, rate=0.2).collect()}
    assert again == {(r["doc_id"], tuple(r["ids"])) for r in coded.collect()}
    other = {(r["doc_id"], tuple(r["ids"])) for r in sentencepiece_bpe.encode(awkward, MODEL, rate=0.2, seed=99).collect()}
    assert again != other


# Token files


def test_token_files_against_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(BPE)
    want, start = {}, 0
    for i, text in rows(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id"):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op8_token_files(spark, SF).collect()} == want


def test_token_files_of_awkward_texts(spark, awkward, nothing, tmp_path):
    tokenizer = Tokenizer.from_file(BPE)
    folder = f"file://{tmp_path}/a"
    token_files.write(awkward, folder, BPE, 2)
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in token_files.read(spark, folder).collect())
    want = sorted((r["doc_id"], np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in awkward.where("doc_id is not null").collect())
    assert got == want
    token_files.write(nothing, f"file://{tmp_path}/b", BPE, 2)
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0


def test_one_document_by_seek_and_wrong_dictionary(tmp_path):
    samples = [np.arange(i, i + 40, dtype="<u4").tobytes() for i in range(600)]
    dictionary = token_files.train_dictionary(samples, 2048)
    assert dictionary and token_files.train_dictionary([], 2048) == b""
    frame = token_files.compressor(dictionary, 3).compress(samples[7])
    assert token_files.decompressor(dictionary).decompress(frame) == samples[7]


# HTML


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b&nbsp; c<br>d", "a\n\nb c d"), ("<script>var t='</p>';</script><p>x</p>", "x"), ("<style>p{}", ""),
        ("<header>h</header><nav>n</nav><article><h1>T</h1><p>one <b>two<p>three</article><footer>f</footer>", "T\n\none two\n\nthree"),
        ("<article><p>x</p><div class='comments'><p>no</p></div><aside>no</aside><form>no</form></article>", "x"),
        ("<main><p>m</p></main><p>out</p>", "m"), ("<div class=\"cookie-notice\">no</div><div>yes<!-- no --></div>", "yes"), ("<p>a</p", "a"), ("<p>1 < 2</p>", "1 < 2"),
    ],
)
def test_text_of_a_page(page, text):
    assert html.main_text(page, frozenset()) == text


def test_template_words_go_without_an_article(spark):
    body = "<html><body><div>Site name</div><div>Story {0} goes {1}</div><div>All rights kept</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", body.format(i, i * 7)) for i in range(8)] + [(90, None, None), (91, "http://h.com/x", ""), (92, "http://solo.org/", "<p>alone</p>")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in html.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    assert len(got) == 11 and got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "alone"
    assert all(got[i]["n_chars"] == len(got[i]["text"]) for i in got)
    assert html.extract(pages.limit(0)).count() == 0


STORY = "<html><body><nav>menu</nav><article><h1>Title {0}</h1><p>Share this story</p><p>Body of {0}, told at length for {1}</p><p>Read more on our site</p></article><footer>f</footer></body></html>"


def page_table(spark, pages):
    return spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], "page_id bigint, url string, html string")


def test_template_blocks_inside_an_article_go(spark):
    """Repeated blocks are template; copies neither empty the article nor become template themselves."""
    told = [("a.com", STORY.format(i, i * 7)) for i in range(6)] + [("a.com", STORY.format(3, 21))] * 20
    near = [("b.org", "<article><h1>One title</h1>" + "".join(f"<p>Paragraph {k} of a story that many pages copy</p>" for k in range(6)) + f"<p>copy {i}</p></article>") for i in range(8)]
    alone = [("c.net", "<article><p>Only here</p><p>Share this story</p></article>")]
    got = [r["text"] for r in html.extract(page_table(spark, told + near + alone)).orderBy("page_id").collect()]
    number = [*range(6), *[3] * 20]
    assert got[:26] == [f"Title {i}\n\nBody of {i}, told at length for {i * 7}" for i in number]
    assert got[26:34] == ["\n\n".join(["One title", *(f"Paragraph {k} of a story that many pages copy" for k in range(6)), f"copy {i}"]) for i in range(8)]
    assert got[34] == "Only here\n\nShare this story"


def test_template_against_whole_vectors(spark):
    """Classes from the occurrence vectors themselves, with copies, ties, NULL pages and pages without a host."""
    rng = random.Random(8)
    parts = ["<div class='x'><p>w{}</p></div>", "<p>Fixed block</p>", "<section>one two {}</section>", "<ul><li>a</li><li>b</li></ul>", "<p>Now {}</p>", "<h2>same head</h2>"]
    pages = []
    for host in ("one.com", "two.com", "three.com", ""):
        for _ in range(9):
            page = "<body>" + "".join(p.format(rng.randrange(4)) for p in parts if rng.random() < 0.85) + "</body>"
            pages += [(host, page)] * rng.choice([1, 1, 3])
    pages += [("one.com", None), ("two.com", ""), ("four.com", "<p>x</p>")]
    df = page_table(spark, pages)
    vectors, distinct = {}, {}
    for host, page in dict.fromkeys(p for p in pages if p[1] is not None):
        for group in (host, html.POOL):
            n = distinct[group] = distinct.get(group, 0) + 1
            for token, count in html.tokens(page).items():
                vectors.setdefault((group, token), []).append((n, count))
    classes = {}
    for (group, token), vector in vectors.items():
        if group and distinct[group] >= html.MIN_PAGES and len(vector) >= html.SUPPORT * distinct[group]:
            classes.setdefault((group, tuple(vector)), set()).add(token)
    want = {}
    for (group, _), members in classes.items():
        if len(members) > 1:
            want.setdefault(group, set()).update(members)
    own = df.select(F.col("page_id").cast("string").alias("page"), urls.host_of(F.col("url")).alias("_host"), F.col("html").alias("_html"))
    got = {r["host"]: r["tokens"] for r in html.templates(own).collect()}
    assert {h: set(t) for h, t in got.items()} == want and {"one.com", "two.com", "three.com", html.POOL} >= set(want) != set()
    assert all(len(t) == len(set(t)) for t in got.values())


def test_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>line {i} &amp; more</p>" for i in range(20_000)) + "</article>"
    df = page_table(spark, [("a.com", long)] * 3 + [("a.com", STORY.format(1, 2))])
    got = [r["text"] for r in html.extract(df.unionByName(df)).orderBy("page_id").collect()]
    assert len(got) == 8 and got[:6] == ["\n\n".join(f"line {i} & more" for i in range(20_000))] * 6
    assert got[6] == got[7] and got[6].startswith("Title 1\n\nShare this story")


def test_pages_of_the_tables(spark):
    import re
    from html import unescape

    want = {}
    for i, page in rows(f"select page_id, html from '{SF}/pages.parquet'"):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        want[i] = "\n\n".join(p for p in parts if p)
    assert {r["page_id"]: r["text"] for r in queries.op6_html_text(spark, SF).collect()} == want
