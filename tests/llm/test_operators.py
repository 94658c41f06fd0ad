"""Each operator against brute force, an exact round trip, the library it stands for, or its SQL."""

import base64
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.llm import bytewords as bw
from footfall.llm import bwt_merge, chat, components, edit_embed, langid, minhash, mixing, quality, spiece, suffix_dedup, token_files, warc
from footfall.llm import queries as registered
from tests.llm.fixtures import clashing, documents, rows, words
from tests.oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- registered SQL ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(registered.QUERIES[name](spark, sf), connect(sf), registered.ORACLE_SQL[name])


# --- 1: WARC ----------------------------------------------------------------------------------------------------


def pages(spark):
    big = "<p>ü</p>" * 90_000
    data = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, None, None), (3, "http://a b/3", ""), (7, "u", big), (8, "u", big), (None, "u", "only"), (5, "http://a/5", "same"), (11, "x", "a\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame(data, "page_id bigint, url string, html string")


def test_warc_round_trip(spark):
    table = pages(spark)
    chunks = warc.read_chunks(warc.archive_pages(spark, table.withColumn("digest", F.lit(1))), chunk=1000).collect()
    got = defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["chunk_no"])):
        if r["record_type"] == "response" and r["page_id"] != 5:
            assert r["chunk_start"] == len(got[r["page_id"]]) and r["chunk_bytes"] == len(r["data"]) <= 1000
            got[r["page_id"]] += r["data"]
            assert r["sha1_so_far"] == base64.b32encode(hashlib.sha1(got[r["page_id"]]).digest()).decode()
    want = {r["page_id"]: (r["html"] or "").encode() for r in table.collect()}
    assert got == {k: want[k] for k in (2, 3, 7, None, 11)}
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in chunks if r["is_last"]}
    assert kinds[5] == ("revisit", 2, 4) and kinds[8] == ("revisit", 7, len(want[7])) and kinds[9] == ("revisit", 3, 0)
    assert len([r for r in chunks if r["is_last"]]) == table.count()


def test_warc_empty(spark):
    assert warc.read_chunks(warc.archive_pages(spark, pages(spark).limit(0))).count() == 0


# --- 2: token files ---------------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    files = token_files.token_files(spark, clashing(docs))
    got = sorted(token_files.read_documents(files).collect(), key=lambda r: r["start"])
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    found = Tokenizer.from_file(token_files.vocabulary()).encode_batch([r[1] or "" for r in ordered], add_special_tokens=False)
    start = 0
    assert len(got) == len(ordered)
    for row, have, want in zip(ordered, got, found, strict=True):
        ids = want.ids + [2]
        assert (have["doc_id"], have["start"], have["n_tokens"]) == (row[0], start, len(ids))
        assert have["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    for path in [r["path"] for r in files.collect()]:
        for ids, _ in token_files.open_sequences(path.removeprefix("file://") + ".arrow"):
            assert ids.shape[1] == token_files.SEQUENCE and not ids.flags.owndata


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcXYZ'stdm  \n\t.,!?-_#<|>é ßÄöñ²½ªİσΣς中文\x00\x1f\x85019", max_size=60))
def test_pieces_equal_the_tokenizer(text):
    encoder = token_files.encoder_of(token_files.vocabulary())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == want


def test_tokens_empty(spark):
    assert token_files.read_documents(token_files.token_files(spark, documents(spark).limit(0))).count() == 0


# --- 3: SentencePiece -------------------------------------------------------------------------------------------


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spiece.vocabulary())


def test_piece_ids_equal_the_library(spark):
    sp = library()
    got = spiece.encode_column(clashing(documents(spark))).collect()
    want = {(r[0], tuple(sp.encode(r[1] or ""))) for r in rows()}
    assert {(r["doc_id"], tuple(r["ids"])) for r in got} == want and len(got) == len(rows())
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)
    back = {(r["doc_id"], r["text"]) for r in spiece.decode_column(spiece.encode_column(documents(spark))).collect()}
    assert back == {(r[0], r[1] or "") for r in rows()}


def test_a_very_long_word_in_bounded_memory():
    import tracemalloc

    rnd = random.Random(1)
    word = "".join(rnd.choice("abcdeéingthe中文😀") for _ in range(1_000_000))
    encoder = spiece.TextEncoder(spiece.PieceModel(spiece.vocabulary()))
    tracemalloc.start()
    ids = encoder.encode([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.frombuffer(ids, "<i4").tolist() == library().encode(word)
    assert peak < 200e6 and not any(len(w) > spiece.KNOWN_LENGTH for w in encoder.known)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab\nthe  ing012é中.,!AZ▁<>s😀", max_size=60))
def test_any_text_equals_the_library(text):
    sp, encoder = library(), spiece.encoder_of(spiece.vocabulary(), "bpe")
    ids = np.frombuffer(encoder.encode([text])[0], "<i4").tolist()
    assert ids == sp.encode(text) and encoder.model.decode(ids) == sp.decode(ids)


def test_unigram_tables_find_the_best_sum():
    model = spiece.PieceModel(spiece.vocabulary(), "unigram")
    word = "▁nation"

    def best(at):
        if at == len(word):
            return 0.0
        ends = (e for e in range(at + 1, len(word) + 1) if word[at:e] in model.scores)
        return max(model.scores[word[at:e]] + best(e) for e in ends)

    ids = np.frombuffer(model.encode_words(["▁nat", word, "▁nations"])[word], "<i4").tolist()
    names = {i: p for p, i in model.ids.items()}
    assert sum(model.scores[names[i]] for i in ids) == best(0)


# --- 4: language ------------------------------------------------------------------------------------------------


def test_languages_are_learnt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.langid_query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    docs = clashing(documents(spark))
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert model.langs == ["de", "en"] and got[900] == ("und", 0.0)
    nothing = langid.fit(docs.filter("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_training_equals_a_plain_loop():
    rng = np.random.default_rng(7)
    model, classes = langid.Ftrl(3), 3
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= langid.L1:
            return 0.0
        sign = 1 if z[key] > 0 else -1
        return -(z[key] - sign * langid.L1) / ((langid.BETA + n[key] ** 0.5) / langid.ALPHA + langid.L2)

    for _ in range(150):
        index = np.sort(rng.choice(40, 8, replace=False))
        value, label = rng.random(8), int(rng.integers(classes))
        model.learn(index, value, label)
        scores = [sum(v * weight((i, c)) for i, v in zip(index.tolist(), value.tolist(), strict=True)) for c in range(classes)]
        total = sum(np.exp(x) for x in scores)
        fresh = {}
        for c in range(classes):
            for i, v in zip(index.tolist(), value.tolist(), strict=True):
                g = v * (np.exp(scores[c]) / total - (c == label))
                sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / langid.ALPHA
                fresh[i, c] = (z[i, c] + g - sigma * weight((i, c)), n[i, c] + g * g)
        for key, (zs, ns) in fresh.items():
            z[key], n[key] = zs, ns
    got = model.weights(slice(0, 40))
    want = np.array([[weight((i, c)) for c in range(classes)] for i in range(40)])
    assert np.allclose(got, want) and (want == 0).any() and (want != 0).any()


def test_prediction_equals_a_plain_sum(spark):
    model = langid.fit(documents(spark))
    for text in ("w1 w2 abc", "ÄÖ 12 eins", words(random.Random(2), 90)):
        index, count = langid.features(text)
        value = [(1 + np.log(c)) * model.idf[i] for i, c in zip(index.tolist(), count.tolist(), strict=True)]
        norm = sum(v * v for v in value) ** 0.5
        scores = [sum(v / norm * model.weights[i, c] for i, v in zip(index.tolist(), value, strict=True)) / model.temperature for c in range(len(model.langs))]
        p = [np.exp(x) / sum(np.exp(y) for y in scores) for x in scores]
        lang, score = model.predict(text)
        assert lang == model.langs[int(np.argmax(p))] and score == pytest.approx(max(p))


def test_equal_scores_go_to_the_first_language():
    model = langid.Model(["aa", "bb"], np.ones(langid.DIMENSIONS), np.zeros((langid.DIMENSIONS, 2)), 1.0)
    assert model.predict("tie") == ("aa", 0.5)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid.temperature(logits * 3, labels) - 3) < 0.3


# --- 5: suffix dedup --------------------------------------------------------------------------------------------


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        left = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length,group", [(100, 2048), (100, 3), (400, 2048)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, group):
    real = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda t, n: real(t, n, group))
    data = rows()
    got = suffix_dedup.removed(clashing(documents(spark)), length)
    want = sorted(((r[0], *b) for r, b in zip(data, brute_removed([r[1] for r in data], length), strict=True)), key=repr)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("repeat", [False, True])
def test_repeats_in_parts_of_a_long_text(spark, monkeypatch, repeat):
    """A text of several parts: windows at their borders start once, and repeats over borders are found."""
    real = suffix_dedup.anchors
    monkeypatch.setattr(suffix_dedup, "anchors", lambda t, n: real(t, n, 1000))
    text = "".join(map(chr, np.random.default_rng(5).integers(33, 127, 4500)))
    text += text[800:1300] * repeat
    got = suffix_dedup.removed(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 100)
    want = [(1, *brute_removed([text], 100)[0])]
    assert want[0][2] == 1000 * repeat
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_query_returns_what_is_left(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in suffix_dedup.suffix_query(spark, str(tmp_path)).collect():
        if "\ufffd" not in r["text"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
        assert len(r["text"].encode()) >= r["n_bytes"] - r["n_removed"]


def test_repeats_empty(spark):
    assert suffix_dedup.removed(documents(spark).limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=12), min_size=1, max_size=9), st.integers(1, 4), st.integers(1, 3))
def test_merged_transforms_find_shared_prefixes(strings, length, count):
    width = 12
    frames = [np.zeros(width, np.uint16) for _ in strings]
    for f, s in zip(frames, strings, strict=True):
        f[: len(s)] = np.frombuffer(s.encode(), np.uint8) + 1
    group = np.array([i % 2 for i in range(len(strings))], np.uint16)
    shards, own = [], []
    for s in range(min(count, len(strings))):
        at = np.arange(s, len(strings), min(count, len(strings)))
        shards.append(bwt_merge.Shard(group[at], np.ascontiguousarray(np.stack([frames[i] for i in at]).T), width))
        own.append(at)
    for at, hit in zip(own, bwt_merge.merge(shards, length), strict=True):
        for j, i in enumerate(at):
            for c in range(width):
                mine = strings[i][c : c + length]
                want = len(mine) == length and any(k != i and group[k] == group[i] and strings[k][c : c + length] == mine for k in range(len(strings)))
                assert hit[c, j] == want


# --- 6: near duplicates -----------------------------------------------------------------------------------------


def brute_groups(data, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in data:
        w = WORD.findall((text or "").translate(lower))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1))))
    parent = {r[0]: r[0] for r in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and data[i][0] is not None and data[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(data[i][0]), find(data[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((r[0], len(s), find(r[0]), find(r[0]) == r[0]) for r, s in zip(data, sets, strict=True)), key=repr)


@pytest.mark.parametrize("k,block", [(4, 512), (5, 512), (4, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 64 if block > 2 else 3)
    monkeypatch.setattr(minhash, "WIDE_BLOCKS", 8 if block > 2 else 2)
    got = minhash.near_groups(clashing(documents(spark)), k=k)
    assert collected(got, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows(), k)


def template_family(n, own, rnd, shared=90):
    """n texts that share their first words; a likeness of shared / (shared + 2 own)."""
    head = words(rnd, shared + 4, 10**9)
    return [f"{head} {words(rnd, own, 10**9)}" for _ in range(n)]


def counted_texts(monkeypatch):
    """How many texts each call of the verification takes, from now on."""
    taken, verify = [], minhash._verify

    def counting(members, k, percent):
        taken.append(members.count())
        return verify(members, k, percent)

    monkeypatch.setattr(minhash, "_verify", counting)
    return taken


def test_template_family_sends_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 8)
    rnd = random.Random(3)
    texts = template_family(300, 45, rnd)
    texts += [" ".join(["edit", *t.split(" ")[1:]]) for t in texts[:20]] + texts[40:45]
    data = [(i, t) for i, t in enumerate(texts)]
    taken = counted_texts(monkeypatch)
    got = minhash.near_groups(spark.createDataFrame(data, "doc_id bigint, text string"), k=4)
    assert collected(got, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(data, 4)
    assert taken[0] >= 300 and sum(taken) < 500


@pytest.mark.parametrize("edits,most", [(1, 400), (5, 10**6)])
def test_large_group_of_near_copies(spark, monkeypatch, edits, most):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 8)
    rnd = random.Random(4)
    base = words(rnd, 120).split(" ")
    texts = []
    for i in range(120):
        text = list(base if i % 3 else base[::-1])
        for _ in range(rnd.randint(1, edits)):
            text[rnd.randrange(len(text))] = words(rnd, 1)
        texts.append(" ".join(text))
    data = [(i, t) for i, t in enumerate(texts)]
    taken = counted_texts(monkeypatch)
    got = minhash.near_groups(spark.createDataFrame(data, "doc_id bigint, text string"), k=4)
    assert collected(got, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(data, 4)
    assert sum(taken) < most


def test_groups_empty(spark):
    assert minhash.near_groups(documents(spark).limit(0), k=4).count() == 0


def test_minhash_rows_of_one_id_are_linked_by_their_own_texts(spark):
    """Equal doc_ids with unlike texts: no link is lost, and the pipeline's stage drops rows, not ids."""
    rnd = random.Random(9)
    a, b = words(rnd, 90), words(rnd, 90)
    near = " ".join([*b.split(" ")[:-1], "other"])
    data = [(5, a), (5, b), (6, near), (6, words(rnd, 70)), (7, a), (None, b), (8, near), (8, near)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs, k=4).collect())
    assert got == Counter([(5, 5, True), (5, 5, True), (6, 5, False), (6, 6, True), (7, 5, False), (None, None, True), (8, 5, False), (8, 5, False)])
    left = minhash.minhash_stage(spark, clashing(docs).withColumn("_doc", F.lit(1)).withColumn("_tkey", F.lit(2)), None)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(5, a), (5, b), (6, data[3][1]), (0, b)])
    assert left.columns == clashing(docs).withColumn("_doc", F.lit(1)).withColumn("_tkey", F.lit(2)).columns



def test_signatures_estimate_likeness():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8):
        a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        same_ = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:same_], rng.integers(0, 1 << 63, 400 - same_).astype(np.uint64)])
        sig = minhash.super_minhash(np.repeat([0, 1], 400), np.concatenate([a, b]), 2)
        assert abs((sig[0] == sig[1]).mean() - share) < 0.15


def test_components_of_stars_and_chains(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 540)] + [(160, 539), (7, 7), (8, 9), (9, 8)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in [*range(100, 161), *range(500, 540)]}, 8: 8, 9: 8}


# --- 7: chat ----------------------------------------------------------------------------------------------------


def test_chat_reads_back_what_went_in(spark):
    data = [(1, 0, "user", "hi & <|im_end|>"), (1, 1, "user", ""), (1, 2, "assistant", "a<|im_sep|>b"), (1, 3, "assistant", None), (1, 3, "assistant", "&lt;|"), (1, 9, None, "r"), (2, None, "ro\nle<|", "&amp;"), (None, 1, "assistant", "é😀"), (1, 3, "assistant", None)]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(3))
    out = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.parse_formatted(out).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in data if r[0] == conv), key=order)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == want and got[conv]["mask_ok"]
        assert [t["loss"] for t in got[conv]["turns"]] == [role == "assistant" for role, _ in want]
    text = got[1]["formatted"]
    assert text.count(chat.START) == 3 and text.count(chat.SEP) == 4  # adjacent turns of one role are one block
    assert chat.digest(chat.format_conversations(turns.limit(0))).count() == 0


# --- 8: edit embedding ------------------------------------------------------------------------------------------


def test_edited_texts(spark):
    data = [r for r in rows() if r[0] is not None][:-2]
    docs = clashing(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = sorted(edit_embed.edited_fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    ordered = sorted(data, key=lambda r: r[0])
    seen = {}
    for i, (row, have) in enumerate(zip(ordered, got, strict=True)):
        text, after = row[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (have["n_chars"], have["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, have["fingerprint"]) == have["fingerprint"]
        assert seen.setdefault(edited, have["edited_fingerprint"]) == have["edited_fingerprint"]
        assert 0 <= have["near_edited"] <= 1 and 0 <= have["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 300 and r["doc_id"] < 39]  # the rest is followed by a near copy
    assert np.mean([r["near_edited"] for r in long]) > 0.4 + np.mean([r["near_next"] for r in long])


def test_edited_small_tables(spark):
    docs = documents(spark)
    assert edit_embed.edited_fingerprints(docs.limit(0)).count() == 0
    one = edit_embed.edited_fingerprints(docs.filter("doc_id = 1").limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert edit_embed.edited_fingerprints(docs).count() == len(rows())


def test_few_edits_keep_fingerprints_near():
    walker = edit_embed.Walker()
    take = lambda t: walker.fingerprint(edit_embed._points(t), walker.walk(edit_embed._points(t)))
    text = next(r[1] for r in rows() if r[1] and len(r[1]) > 5000)
    near = edit_embed.likeness(take(text), take(text[:2000] + "!" + text[2000:3000] + text[3001:]))
    assert edit_embed.likeness(take(text), take(text)) == 1 and near > 0.8 > edit_embed.likeness(take(text), take(text[::-1]))


def test_near_classes(spark):
    prints = edit_embed.fingerprints(documents(spark))
    got = {r["doc_id"]: r["component_id"] for r in edit_embed.near_classes(prints).collect()}
    by_text = defaultdict(list)
    for r in rows():
        if r[1] and r[0] is not None:
            by_text[r[1]].append(r[0])
    assert all(len({got[i] for i in ids}) == 1 for ids in by_text.values())


@pytest.mark.parametrize("block", [512, 3])
def test_near_classes_equal_brute_force(spark, monkeypatch, block):
    """Texts a few edits apart, and a bucket of texts that share an octave of samples but are not near its least member."""
    monkeypatch.setattr(edit_embed, "BLOCK", block)
    monkeypatch.setattr(edit_embed, "WIDE_BLOCKS", 2)
    rng = np.random.default_rng(3)
    data = {}
    for group in range(8):
        base = bytes(rng.integers(1, 256, 5 * edit_embed.SAMPLES, dtype=np.uint8))
        for _ in range(4):
            copy = bytearray(base)
            for p in rng.integers(0, len(base), 9):
                copy[p] = rng.integers(1, 256)
            data[len(data)] = bytes(copy)
    shared = bytes(rng.integers(1, 256, edit_embed.SAMPLES, dtype=np.uint8))
    for _ in range(30):
        # The upper octave but one is the same for all, the last is not, but for pairs.
        low, last = (bytes(rng.integers(1, 256, n * edit_embed.SAMPLES, dtype=np.uint8)) for n in (3, 1))
        for end in (last, bytes([last[0] % 255 + 1]) + last[1:]):
            data[len(data)] = low + shared + end
    data[len(data)] = data[3]
    prints = spark.createDataFrame([(i, x.hex()) for i, x in data.items()], "doc_id bigint, fingerprint string")

    def words(x):
        return edit_embed.band_words(np.frombuffer(x, np.uint8)[None, :], np.array([len(x) // edit_embed.SAMPLES]))[0]

    texts = sorted(set(data.values()))
    keys = [words(x) for x in texts]
    links = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            if ((keys[i] == keys[j]) & (keys[i] != 0)).any() and edit_embed.likeness(texts[i], texts[j]) >= edit_embed.NEAR:
                links[texts[i]].add(texts[j])
                links[texts[j]].add(texts[i])
    label = {}
    for i, x in sorted(data.items()):
        todo = [x]
        while todo:
            if (at := todo.pop()) not in label:
                label[at] = i
                todo += links[at]
    assert sum(map(len, links.values())) > 60
    got = edit_embed.near_classes(prints.withColumn("group", F.lit("clash")).withColumn("id", F.lit(1))).collect()
    assert len(got) == len(data) and {r["doc_id"]: r["component_id"] for r in got} == {i: label[x] for i, x in data.items()}


def test_fingerprints_equal_a_plain_walk():
    walker = edit_embed.Walker()
    rnd = random.Random(6)
    for n in (0, 1, 2, 31, 40, 64, 200, 700):
        text = "".join(rnd.choice("ab cdéß中😀\n") for _ in range(n))
        written_, at, step = [], 0, 0
        while at < len(text):
            point = np.uint64(ord(text[at]))
            kind = int(bw.mix(np.array([point]))[0]) & 255
            written_.append(ord(text[at]))
            at += int(bw.mix(np.array([kind * edit_embed.PERIOD + step % edit_embed.PERIOD], np.uint64) + np.uint64(0x8CB92BA72F3D8DD7))[0]) & 1
            step += 1
        want = []
        for octave in range(edit_embed.octaves(len(written_))):
            for place in edit_embed.sample_places(octave).tolist():
                value = 0
                if place < len(written_):
                    value = int(bw.mix(np.array([written_[place] + 0x632BE59BD9B4E019], np.uint64))[0]) % 255 + 1
                want.append(value)
        points = edit_embed._points(text)
        assert list(walker.fingerprint(points, walker.walk(points))) == want


def test_near_classes_find_nine_of_ten_near_pairs(spark):
    rnd = random.Random(8)
    texts = []
    for i in range(120):
        text = words(rnd, rnd.choice([4, 8, 15, 40, 120, 400]))
        texts.append(text)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(text))
            texts.append(text[:at] + rnd.choice(["", "x", "yz "]) + text[at + rnd.randint(0, 2) :])
    prints = {r["doc_id"]: r["fingerprint"] for r in edit_embed.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    table = spark.createDataFrame(list(prints.items()), "doc_id bigint, fingerprint string")
    got = {r["doc_id"]: r["component_id"] for r in edit_embed.near_classes(table).collect()}
    raw = {i: bytes.fromhex(x) for i, x in prints.items()}
    near = [(i, j) for i in raw for j in range(i) if edit_embed.likeness(raw[i], raw[j]) >= edit_embed.NEAR]
    found = sum(got[i] == got[j] for i, j in near)
    assert len(near) > 100 and found >= 0.9 * len(near)


def test_edited_query_gives_classes(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = edit_embed.fingerprint_query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    assert {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"} == set(got[0].asDict())
    of = {}
    for r in got:
        if r["fingerprint"] and r["doc_id"] is not None:
            assert of.setdefault(r["fingerprint"], r["component_id"]) == r["component_id"] <= r["doc_id"]


# --- 9: quality -------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), n < 50 or 100 * len(again) > 50 * n)


def brute_repeats(w):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def test_quality_counts_equal_brute_force(spark):
    got = quality.quality_rules(clashing(documents(spark)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, *names) == sorted(((r[0], *brute_quality(r[1])) for r in rows()), key=repr)
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]
    assert quality.quality_rules(documents(spark).limit(0)).count() == 0


def test_quality_verdict_needs_the_suffix_array(spark):
    word = lambda a, b: [f"w{i}" for i in range(a, b)]
    texts = {1: word(0, 140) + word(100, 140), 2: word(0, 400) + word(0, 101), 3: word(0, 400) + word(0, 100), 4: word(0, 200)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["base_failed"], r["covered_words"], r["longest_repeat"], r["kept"]) for r in quality.quality_rules(docs).collect()}
    assert got == {1: (False, 80, 40, False), 2: (False, 202, 101, False), 3: (False, 200, 100, False), 4: (False, 0, 0, True)}


def test_quality_verdict_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(80):
        text = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(45, 150))]
        for _ in range(rnd.randint(0, 3)):
            at, n = rnd.randrange(len(text)), rnd.randint(5, 40)
            to = rnd.randrange(len(text))
            text[to:to] = text[at : at + n]
        texts.append(text)
    docs = spark.createDataFrame([(i, rnd.choice([" ", "\n"]).join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    want = {}
    for i, w in enumerate(texts):
        best = brute_repeats(w)
        covered = {p + k for p, size in enumerate(best) if size >= quality.MIN_REPEAT for k in range(size)}
        good = len(covered) <= quality.MAX_COVERED * len(w) and max(best, default=0) <= quality.MAX_LONGEST
        want[i] = good and not brute_quality(" ".join(w))[-1]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert got == want and 20 < sum(want.values()) < 70


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=5))
def test_suffix_repeats_equal_brute_force(texts):
    row = np.concatenate([np.full(len(t), i) for i, t in enumerate(texts)]).astype(np.int64)
    symbol = np.array([hash((i, c)) for i, t in enumerate(texts) for c in t], np.int64).astype(np.uint64)
    want = [x for t in texts for x in brute_repeats(t)]
    assert quality.suffix_repeats(row, symbol).tolist() == want


@pytest.mark.parametrize("kind", ["repeats", "words"])
def test_quality_of_a_very_long_text_in_bounded_memory(kind):
    """16 MB of two words over and over, or of ordinary words, in less than 600 MB with the interpreter."""
    script = f"""
import random, resource, sys
import numpy as np
from footfall.llm import quality
rnd = random.Random(1)
text = "ab " * 5_600_000 if {kind == "repeats"} else " ".join("w%x" % rnd.randrange(50_000) for _ in range(2_600_000))
raw = np.frombuffer(text.encode(), np.uint8)
got = quality.measure(raw, np.array([0]), np.array([len(raw)]))
print(int(got["n_words"][0]), int(got["longest_repeat"][0]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    n, longest, megabytes = map(int, out.stdout.split())
    assert megabytes < 600 and (n, longest) in {(5_600_000, 5_599_999), (2_600_000, 2)}


# --- 10: mixing -------------------------------------------------------------------------------------------------


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
def test_targets_equal_repeated_sharing(spark, sizes):
    table = spark.createDataFrame([(chr(97 + i), s) for i, s in enumerate(sizes)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    weight, capped, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], set(), sum(sizes)
    while True:
        left, open_ = total - sum(3 * sizes[i] for i in capped), [i for i in range(len(sizes)) if i not in capped]
        level = left / sum(weight[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weight[i] > 3 * sizes[i] + 1e-9}
        if not over:
            break
        capped |= over
    for i, s in enumerate(sizes):
        assert got[chr(97 + i)] == pytest.approx(3 * s if i in capped else level * weight[i], abs=1e-6)


def test_taken_words_come_near_each_target(spark, sf):
    by = defaultdict(list)
    for r in mixing.mix_plan(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        by[r["source"]].append(r)
    for found in by.values():
        spread = sum(r["size"] ** 2 * (r["rate"] % 1) * (1 - r["rate"] % 1) for r in found) ** 0.5
        assert abs(sum(r["size"] * r["copies"] for r in found) - found[0]["target"]) <= 4 * spread + 1e-6


def test_copies_follow_the_plan(spark):
    docs = clashing(documents(spark))
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r["doc_id"]] += r["copies"]
        assert 0 <= r["copies"] <= 3
    copies = mixing.emit_copies(docs)
    assert copies.columns == docs.columns
    assert Counter(r["doc_id"] for r in copies.collect()) == +plan
    assert mixing.mix_plan(docs.limit(0)).count() == 0
