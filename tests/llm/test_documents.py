"""Operators that map documents one by one, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import bpe, common, crf_langid, feistel, quality_llr, secrets, token_count

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "\n\n", "x", "no", "the and of\n" * 40, "word " * 3000, "é" * 50, "日本語 テキスト", "\x00\x01",
        "token = \"0123456789abcdef\" AKIAABCDEFGHIJKL " + "0a" * 20, "<|endoftext|> a<s>b", "password:short token=secret:abcdefghijkl"]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, repeated rows and null ids, with extra columns."""
    rows = [(i, t, "en" if i % 2 else None, "s", -1, "extra") for i, t in enumerate(EDGE)]
    rows += [rows[6], rows[7], (None, None, None, None, None, None), (None, "some words", "en", None, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, kept string")


def given(spark, table="documents"):
    return common.read(spark, SF, table)


def test_bpe_equals_the_library(spark, docs):
    import tokenizers
    lib = tokenizers.Tokenizer.from_file(common.tokenizer_path(bpe.MODEL))
    rng = random.Random(5)
    texts = [r["text"] for r in given(spark).collect()] + EDGE
    texts += ["".join(rng.choice("abAB'st  \né̀ΣİΑ日1²_-&<|>😀\x85") for _ in range(40)) for _ in range(300)]
    enc = bpe.Encoder(common.tokenizer_path(bpe.MODEL))
    for t, got in zip(texts, enc.batch([t or "" for t in texts])):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))
    assert bpe.encode_documents(docs, common.tokenizer_path(bpe.MODEL), ["doc_id"]).count() == docs.count()


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece
    path = common.tokenizer_path(token_count.MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    both = given(spark).select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
    counted = token_count.count_tokens(both.repartition(40), path, ["doc_id", "text"])
    for r in counted.collect():
        assert r["n_tokens"] == len(lib.encode(r["text"] or ""))
        assert r["n_bytes"] == len((r["text"] or "").encode())
    assert token_count.count_tokens(docs.limit(0), path, ["doc_id"]).count() == 0


def plain_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i:i + 8]), []).append(i)
    again = {i + o for at in spots.values() if len(at) > 1 for i in at for o in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
            len(words) < 20 or 100 * len(again) > 30 * len(words))


def test_quality_base_rules(spark, docs):
    both = given(spark).select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
    scored = quality_llr.score_documents(both, given(spark, "labels"), ["doc_id", "text"]).collect()
    assert len(scored) == both.count()
    for r in scored:
        assert tuple(r[c] for c in [*quality_llr.COLUMNS, "base_failed"]) == plain_quality(r["text"])
        assert not (r["base_failed"] and r["kept"])
    none = quality_llr.score_documents(both, given(spark, "labels").limit(0), ["doc_id"]).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


def test_quality_parts_junk_from_clean(spark):
    scored = quality_llr.score_documents(common.read(spark, "/root/testdata/sf0.01", "documents"),
                                         common.read(spark, "/root/testdata/sf0.01", "labels"), ["doc_id", "text"])
    rows = [r for r in scored.collect() if not r["base_failed"]]
    junk = [r for r in rows if r["n_symbols"] > 0.3 * r["n_words"]]
    clean = [r for r in rows if r["n_symbols"] == 0 and not r["text"].isupper()]
    assert len(junk) > 40 and sum(r["kept"] for r in junk) <= 0.05 * len(junk)
    assert len(clean) > 500 and all(r["kept"] for r in clean)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


@pytest.fixture(scope="module")
def weights(spark):
    return secrets.train(given(spark))


def test_base_spans(spark, docs, weights):
    many = "é token=abcdefgh1 " * 700
    both = (given(spark).select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
            .unionAll(spark.createDataFrame([(99, many)], "doc_id long, text string")))
    found = secrets.find_spans(both.withColumn("t", F.coalesce("text", F.lit(""))), weights, "t")
    for r in found.select("t", secrets.joined(secrets.ordered(secrets.KINDS[:3])).alias("s")).collect():
        assert r["s"] == plain_spans(r["t"])


def test_markov_models_part_random_from_ordinary(spark, weights):
    random_ = [hashlib.sha256(bytes([i])).hexdigest()[:24 + i % 16] for i in range(50)]
    ordinary = ["getUserAccountBalanceForCustomer", "MAX_CONNECTION_RETRY_COUNT_LIMIT", "some-long-kebab-case-identifier-name"]
    df = spark.createDataFrame([(s, i < 50) for i, s in enumerate(random_ + ordinary)], "s string, random boolean")
    for r in secrets.find_spans(df, weights, "s").collect():
        assert (len(r["markov"]) > 0) == r["random"]


def test_redaction(spark, docs, weights):
    clean = secrets.redact(docs, weights)
    assert clean.columns == docs.columns
    for before, after in zip(docs.collect(), clean.collect()):
        if before["text"] and "AKIA" in before["text"]:
            assert after["text"] == "[secret]\" [secret] [secret]"
        elif not plain_spans(before["text"] or ""):
            assert after["text"] == before["text"]


def test_language_held_out(spark, docs):
    rows, labels = crf_langid.training_rows(common.read(spark, "/root/testdata/sf0.01", "documents"))
    model = crf_langid.train(rows, labels)
    given_ = common.read(spark, "/root/testdata/sf0.01", "documents").where(crf_langid.held_out())
    found = crf_langid.predict(given_, model, labels, ["lang", "doc_id"]).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    edge = crf_langid.predict(docs, model, labels, ["doc_id", "text"]).collect()
    assert len(edge) == docs.count()
    for r in edge:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    post, _, words = crf_langid.label_words(["The thing and with for leaux eauenaux ouè étre"], model, labels)
    said = [labels[i] for i in post.argmax(axis=1)]
    assert said[0] == "en" and said[-1] == "fr"
    assert {r["lang_pred"] for r in crf_langid.predict(docs, crf_langid.train([], []), [], ["doc_id"]).collect()} == {"und"}


def plain_posteriors(emit, move):
    """By adding up every sequence of labels."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(sum(emit[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        out[range(n), path] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_crf_posteriors_equal_all_label_sequences():
    rng = np.random.default_rng(3)
    labels = ["a", "b", "c"]
    for n in (1, 2, 5, 7):
        emit, move = rng.normal(0, 2, (n, 3)), rng.normal(0, 2, (3, 3))
        wanted = plain_posteriors(emit, move)
        post, moves, _ = crf_langid.forward_backward(emit[None], move, np.ones((1, n), bool))
        assert np.allclose(post[0], wanted)
        assert np.allclose(moves.sum(), n - 1)
    model = rng.normal(0, 2, (crf_langid.DIM, 3)), rng.normal(0, 2, (3, 3))
    texts = ["one two three four five six seven", "", "un deux", "eins zwei drei vier", "x"]
    for length in (1, 2, 3, 64):
        post, doc, words = crf_langid.label_words(texts, model, labels, length)
        for i, ws in enumerate(words):
            if ws:
                assert np.allclose(post[doc == i], plain_posteriors(crf_langid.Words(ws).emissions(model[0]), model[1]))


def test_crf_long_texts_are_one_chain():
    rng = np.random.default_rng(4)
    labels, vocabulary = ["a", "b", "c", "d"], ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    for sticky in (0, 6):                    # chains that forget soon, and late
        model = rng.normal(0, 1, (crf_langid.DIM, 4)), rng.normal(0, 1, (4, 4)) + sticky * np.eye(4)
        texts = [" ".join(rng.choice(vocabulary, n)) for n in (5000, 64, 65, 128, 3, 700)]
        whole = crf_langid.label_words(texts, model, labels, 5000)[0]
        assert np.abs(crf_langid.label_words(texts, model, labels)[0] - whole).max() < 1e-8


def test_crf_letters_decide_und(spark):
    texts = ["\u00b2 \u00bd", "\u2167", "\u0660\u0661 _ 12", "\u0301", "\u00aa", "\u0928\u092e\u0938\u094d\u0924\u0947", "a", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = np.zeros((crf_langid.DIM, 2)), np.zeros((2, 2))
    got = {r["doc_id"]: r for r in crf_langid.predict(df, model, ["en", "fr"], ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(len(texts))] == ["und"] * 4 + ["en"] * 3 + ["und"] * 2   # ties: first label
    assert crf_langid.WORD.findall(texts[5]) == [texts[5]]          # vowel signs do not cut words
    assert crf_langid.predict(df.limit(0), model, ["en", "fr"], ["doc_id"]).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert crf_langid.training_rows(empty) == ([], [])


def test_crf_training_windows_are_bounded(spark):
    text = " ".join(f"w{'abcdefghij'[i % 10]}" for i in range(30_000))
    df = spark.createDataFrame([(i, text + "z" * i, "en") for i in range(1, 20)], "doc_id long, text string, lang string")
    rows, labels = crf_langid.training_rows(df)
    assert labels == ["en"] and rows
    assert all(len(t) == crf_langid.TRAIN_CHARS for t, _ in rows)
    assert any(not text.startswith(t) for t, _ in rows)             # anywhere in the text


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_feistel_is_a_permutation(n):
    p = feistel.permute(range(n), n, 11)
    assert sorted(p) == list(range(n))
    assert feistel.permute(p, n, 11, back=True).tolist() == list(range(n))
    for row in range(0, n, 5):
        shard, slot = feistel.locate(row, n, 8, 11)
        assert feistel.row_at(shard, slot, n, 8, 11) == row


def test_shards(spark, docs):
    both = given(spark).select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
    a, b = (feistel.shard_documents(x).collect() for x in (both, both.repartition(5)))
    assert sorted(a, key=str) == sorted(b, key=str)
    slots = {}
    for r in a:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == feistel.locate(r["row_no"], len(a), 8, 20240229)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(r["text_crc32"] for r in a) == sorted(zlib.crc32((r["text"] or "").encode()) for r in both.collect())
    assert feistel.shard_documents(both.limit(0)).count() == 0


def test_rule_lines_numbers_and_dates_are_no_secrets(spark, weights):
    strings = [c * 30 for c in "-_/+"] + [
        "20240101123456789012345", "2024-01-01/2024-12-31", "2024-01-01T10-20-30_to_2024-01-02T11-00-00", "-----+-----+-----+-----",
        "report_2024_summary_table_12", "/blog/2024/03/some-long-article-name", "_" * 1_000_000]
    secret = [hashlib.sha256(bytes([i])).hexdigest()[:40] for i in range(20)] + ["9f" * 500_000 + "a3"]
    df = spark.createDataFrame([(s, i >= len(strings)) for i, s in enumerate(strings + secret)], "s string, secret boolean")
    for r in secrets.find_spans(df, weights, "s").select("s", "secret", F.size("markov").alias("n")).collect():
        assert (r["n"] > 0) == r["secret"], r["s"][:60]


def test_sample_of_distinct_texts(spark):
    texts = ["same words here"] * 500 + [f"own{w} words" for w in "abcdefgh"]
    _, ordinary = secrets.labelled_samples(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert ordinary.where("s = 'same'").count() == 1 and ordinary.where("s like 'own_'").count() == 8


def test_every_language_is_learned(spark):
    """Also beyond 200 of them, and where one id is repeated very often."""
    langs = [f"l{i:03}" for i in range(205)]
    own = {x: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}qx{chr(97 + j)}" for j in range(6)) for i, x in enumerate(langs)}
    rows = [(i * 1000 + j, own[x], x) for i, x in enumerate(langs) for j in range(3 if x == "l204" else 4)]
    rows += [(7, f"{own['l000']} again {'z' * (j % 9)}", "l000") for j in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~crf_langid.held_out())
    found, labels = crf_langid.training_rows(df)
    assert labels == langs and {x for _, x in found} == set(langs) and len(found) == len(set(found))
    assert (found, labels) == crf_langid.training_rows(df.repartition(5))
    model = crf_langid.train(found, labels)
    said = crf_langid.label_words([own["l204"], own["l203"]], model, labels)[0].argmax(axis=1)
    assert [labels[i] for i in said] == ["l204"] * 6 + ["l203"] * 6
