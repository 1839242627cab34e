"""The ten operators against plain versions, and on awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlark.llm import attention, gru, lm_score, suffix, warc, windows
from flowlark.llm.bagminhash import near_duplicates, signatures
from flowlark.llm.bpe import WORD_PATTERN, chunk_cuts, encode_decode, repaired_joins, word_edges, word_ends
from flowlark.llm.chat import preference_format, preference_pairs
from flowlark.llm.decontaminate import MASKS, clean_documents, contaminated
from flowlark.llm.fertility import RANKS, fertility, vocabulary_path
from flowlark.llm.lm_score import lm_scores
from flowlark.llm.substring import least_exactly, without_repeats
from flowlark.llm.text import mixed
from flowlark.llm.toxicity import Words, fitted, scored, toxicity
from flowlark.llm.warc import derived_records, responses_of_pages
from tests.llm import brute

DOCS = "doc_id long, text string"
BPE = vocabulary_path("word_bpe_49k.json")


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def repeating(seed=5):
    """Rows with shared passages, null and repeated ids, empty and long texts."""
    draw = random.Random(seed)
    base = [" ".join(draw.choice(["a", "b", "é", "the"]) for _ in range(90)) for _ in range(6)]
    some = [(draw.choice([None, *range(40)]), " ".join(draw.choice(base)[draw.randint(0, 30) :][: draw.randint(0, 150)] for _ in range(draw.randint(0, 4)))) for _ in range(90)]
    return [*some, some[3], (7, None), (8, ""), (9, " \n "), (10, "x " * 3000), (11, "x" * 50), (12, "x" * 49), (None, base[0]), (None, base[0])]


@pytest.fixture(scope="module")
def rows():
    return repeating()


AWKWARD = [(1, None), (1, None), (2, ""), (None, "one two"), (None, None), (3, " \t\n"), (4, "word " * 20000), (5, "日本語 Ώ \x00 <|endoftext|>")]


def test_bytes_against_brute_force(spark, rows):
    assert tuples(suffix.without_repeats(table(spark, rows))) == brute.without_bytes(rows)


def test_words_against_brute_force(spark, rows):
    assert tuples(without_repeats(table(spark, rows))) == brute.without_words(rows)


def test_joined_blocks_and_buckets_of_parts_remove_the_same(spark, rows, monkeypatch):
    """as they are for larger tables."""
    for name, value in (("ROOT_BYTES", 1), ("BUCKET_BYTES", 100)):
        monkeypatch.setattr(windows, name, value)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 300)
    assert windows.parts_for(100) == windows.MOST_PARTS
    assert tuples(suffix.without_repeats(table(spark, rows).repartition(3))) == brute.without_bytes(rows)
    assert tuples(without_repeats(table(spark, rows).repartition(3))) == brute.without_words(rows)


def test_rows_between_blocks_and_buckets_grow_as_the_table():
    """each block had a row for each bucket, so rows grew with the square of the table."""

    def pairs(size):
        parts = windows.parts_for(size)
        return size / (parts * windows.BLOCK_BYTES) * size / (parts * windows.BUCKET_BYTES)

    assert windows.parts_for(0) == windows.parts_for(windows.ROOT_BYTES) == 1
    for times in (2, 7, 12, 40, 64):
        assert pairs(times * windows.ROOT_BYTES) <= times * pairs(windows.ROOT_BYTES)


def test_rows_of_blocks_go_out_together_and_parts_are_solved_alone():
    draw = random.Random(8)
    passages = ["".join(draw.choice("abcdef ") for _ in range(200)) for _ in range(5)]
    texts = [draw.choice(passages)[draw.randint(0, 60) :] + str(i) for i in range(60)]
    block = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(at, at + 20), pa.int64()), "tag": pa.array([0] * 20, pa.int32()), "text": texts[at : at + 20]}) for at in (0, 20, 40)]
    cut = [suffix.super_strings(b.column(2)) for b in block]
    asked = [b.append_column("wanted", pa.array([c.start[c.doc == i].tolist() for i in range(20)], pa.list_(pa.int32()))) for b, c in zip(block, cut)]
    sent = list(windows.in_batches(windows.shipped(asked, suffix.super_strings, 2, 9, 4)))
    assert len(sent) == 1 and sent[0].num_rows == 4 and set(sent[0].column(2).to_pylist()) == {9}
    seen = []

    def least(strings, marks, docs):
        seen.append(len(strings))
        return suffix.least_by_refinement(strings, marks, docs)

    def answers(batch, solve):
        ordered = pa.Table.from_batches([batch]).sort_by([("bucket", "ascending"), ("kind", "ascending")]).combine_chunks().to_batches()
        return sorted(tuple(r.values()) for b in windows.met(iter(ordered), lambda k: windows.Bucket(k, solve)) for r in b.to_pylist())

    found = answers(sent[0], least)
    assert len(seen) > 2  # more than one part for each of the two buckets
    whole = next(windows.in_batches(windows.shipped(asked, suffix.super_strings, 1, 9)))
    assert found and found == answers(whole, suffix.least_by_refinement)


def test_window_hashes_that_agree_are_told_apart_by_sorting():
    assert least_exactly([b"b", b"a", b"b", b"c"], np.array([5, 4, 3, 9])).tolist() == [3, 4, 3, 9]


def test_kept_text_and_columns_are_passed_on(spark):
    text = " ".join(f"w{i}" for i in range(20))
    out = without_repeats(table(spark, [(1, text, "x"), (2, f"new {text}\nend", "y")], DOCS + ", tag string"), texts=True, keep=[]).collect()
    assert {r.doc_id: r.kept_text for r in out} == {1: text, 2: "new end"}


def test_near_duplicate_classes(spark):
    draw = random.Random(5)
    base = [" ".join(draw.choice(["a", "b", "é", "the", "of", f"x{draw.randrange(30)}"]) for _ in range(n)) for n in (4, 30, 200, 200, 60)]

    def near(text, k):
        own = text.split()
        for _ in range(k):
            own[draw.randrange(len(own))] = f"z{draw.randrange(99)}"
        return " ".join(own)

    rows = [(draw.choice([None, *range(300)]), near(draw.choice(base), draw.randint(0, 5))) for _ in range(120)]
    rows += [(7, None), (8, ""), (9, " \n "), (10, "x " * 3000), (11, "x " * 2700), (12, "x " * 2300), (13, "one"), (14, "one "), (15, "one two")]
    assert tuples(near_duplicates(table(spark, rows))) == sorted(brute.classes(rows), key=str)


def test_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(1)
    doc, shingle, weight = np.repeat([0, 1], 40), np.r_[np.arange(40), np.arange(10, 50)].astype(np.uint64), draw.integers(1, 20, 80)
    a, b = (collections.Counter(dict(zip(shingle[s].tolist(), weight[s].tolist()))) for s in (doc == 0, doc == 1))
    wanted = sum((a & b).values()) / sum((a | b).values())
    got = [np.mean(s[0] == s[1]) for s in (signatures(doc, mixed(shingle, k), weight, 2) for k in range(60))]
    assert abs(np.mean(got) - wanted) < 4 * np.std(got) / 60**0.5


def test_encoding_is_the_librarys(spark):
    from tokenizers import Tokenizer

    draw = random.Random(3)
    signs = [" ", "\n", "\t", "\x0b", "a", "b", "É", "é", "ß", "İ", "Σ", "<|endoftext|>", "<|", "́", " ", "　", "日", "1", "'s", "'RE", "!", "%%", "▁", "x" * 30]
    rows = [*AWKWARD, *((i + 10, "".join(draw.choice(signs) for _ in range(draw.randint(1, 200)))) for i in range(150)), (999, "ab" * 40000)]
    own = Tokenizer.from_file(BPE)
    wanted = []
    for doc, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc, len(ids), ids, own.decode(ids, skip_special_tokens=False)))
    out = encode_decode(table(spark, rows), BPE, ["ids", "decoded", "ids_sha256", "decoded_sha256"]).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in out), key=str) == sorted(wanted, key=str)
    assert all(r.ids_sha256 == brute.sha(" ".join(map(str, r.ids)).encode()) and r.decoded_sha256 == brute.sha(r.decoded.encode()) for r in out)
    assert sum(r.n_repaired for r in out) > 0


def test_word_ends_are_the_patterns():
    import regex

    draw = random.Random(8)
    signs = ["'", "'s", "'re", "'ll", "'ve", "'m", "'d", "'t", "l", "e", "v", "r", "s", "é", "ÿ", "1", "23", "!", "-", " ", "\n", "\t", "_", "a"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 14)))
        wanted = [len(text[: m.end()].encode()) - 1 for m in regex.finditer(WORD_PATTERN, text)]
        assert np.flatnonzero(word_ends(np.frombuffer(text.encode(), np.uint8))).tolist() == wanted, text


def test_chunks_of_equal_passages_are_equal():
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdefgh é") for _ in range(4000)).encode()
    chunks = []
    for lead in (b"", b"another opening of another length "):
        bytes_ = np.frombuffer(lead + passage, np.uint8)
        cuts = chunk_cuts(bytes_, np.array([0, len(bytes_)]), 64)
        chunks.append([bytes(x) for x in np.split(bytes_, cuts)[2:]])
    shared = set(chunks[0]) & set(chunks[1])
    assert len(chunks[0]) > 30 and len(shared) >= len(chunks[0]) - 2
    assert all(x.decode("utf-8") is not None for x in shared)


def test_ranges_at_joins_grow_until_the_chunks_agree():
    """A toy vocabulary, whose pairs reach over white space, so that the nearest words do not agree yet."""
    pairs = {b"a b", b"b c", b"c d"}

    def tokens(text):
        words, out, i = text.split(), [], 0
        while i < len(words):
            two = b" ".join(words[i : i + 2])
            out.append(two.replace(b" ", b"_") if two in pairs else words[i])
            i += 2 if two in pairs else 1
        return out

    def check(text, broken):
        bytes_ = np.frombuffer(text, np.uint8)

        def encode(starts, stops):
            made = [tokens(bytes_[i:j].tobytes()) for i, j in zip(starts, stops)]
            return [(len(t), b"".join(b" " + x for x in t), b"".join(b" " + x for x in t)) for t in made]

        begins = np.array([0, len(bytes_)])
        opens, closes, found = repaired_joins(np.array(broken), word_edges(bytes_, begins), begins, encode)
        whole, at = [], 0
        for i, j, (n, ids, _) in zip(opens, closes, found):
            assert ids.count(b" ") == n
            whole += [*tokens(text[at:i]), *ids.split()]
            at = j
        assert whole + tokens(text[at:]) == tokens(text)
        return closes - opens

    assert check(b"xx yyyy zz", [5]).tolist() == [5]
    assert check(b"q q a bbbb a b c d q q q", [7]).tolist() == [5]
    grown = check(b"q q q a b c d q q q", [6, 7])
    assert (grown > 4).all()
    assert check(b"xxxx", [1, 2]).tolist() == [4]


def test_fertility_measures(spark, rows):
    rows = [*rows, *AWKWARD, (50, "a b c\n\nA b c\na b c\n \n"), (51, "## |x| a b c d a b c\n" * 3)]
    out = fertility(table(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=str)
    assert got == sorted(((d, *brute.base_measures(t)) for d, t in rows), key=str)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_fertility_tokens_are_the_vocabularys(spark):
    import sentencepiece

    text = "The quick brown fox said: 日本 naïve!! Ωmega " * 3
    out = fertility(table(spark, [(1, text)])).first()
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    ids = [i for w in text.split() for i in model.encode(w)]
    share = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert out.n_tokens_0 == len(ids)
    assert math.isclose(out.byte_share_0, sum(map(model.is_byte, ids)) / len(ids))
    assert math.isclose(out.entropy_0, -(share * np.log2(share)).sum())


def test_fertility_bands_refuse_bad_and_keep_good(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [r for r in fertility(spark.read.parquet(f"{folder}/documents.parquet")).collect() if not r.base_failed]
    bad, good = ([not r.kept for r in out if labels.get(r.doc_id) == q] for q in (0, 1))
    assert len(bad) > 10 and len(good) > 100
    assert np.mean(bad) > 0.85 and np.mean(good) < 0.03


def test_fertility_bounds_of_other_scripts_fire(spark):
    few, none, fine = "\u65e5\u672c " * 400, "12 34 " * 400, " ".join(str(i * 7919) for i in range(400))
    docs = table(spark, [(1, few), (2, none), (3, fine)])
    out = {r.doc_id: r for r in fertility(docs, least_words=1, most_repeated=100).collect()}
    assert [out[i].script for i in (1, 2, 3)] == ["other", "none", "none"]
    assert [out[i].kept for i in (1, 2, 3)] == [False, False, True]


def test_masks_hit_every_window_they_promise():
    import itertools

    for n, wrong in [*((n, 1) for n in range(10, 20)), (20, 2)]:
        places = [{p + x for x in m} for m in MASKS for p in range(n - m[-1])]
        assert all(any(p.isdisjoint(e) for p in places) for e in itertools.combinations(range(n), wrong))


def test_decontamination(spark):
    item = [f"w{i}" for i in range(30)]
    changed = item.copy()
    changed[3] = changed[17] = "other"
    items = [(1, " ".join(item)), (2, "tiny set"), (3, None), (4, ""), (5, " ".join(f"q{i}" for i in range(12)))]
    docs = [
        (1, "before " + " ".join(item).upper() + "!! after"), (2, " ".join(changed)), (3, " ".join(item[:17])), (4, "a tiny, set b"), (5, "tiny other set"),
        (6, None), (7, ""), (8, "x " + " ".join(f"q{i}" for i in range(12) if i != 5).replace("q4", "q4 new")), (9, " ".join(w if i % 5 else "no" for i, w in enumerate(item))), (None, "tiny set"),
    ]
    found = tuples(contaminated(table(spark, docs), table(spark, items, "item_id long, text string")).select("doc_id", "item_id", "best_matched"))
    assert found == sorted([(1, 1, 20), (2, 1, 19), (4, 2, 2), (8, 5, 11), (None, 2, 2)], key=str)
    kept = clean_documents(table(spark, docs), table(spark, items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9]


def test_language_model_base_and_folds(spark):
    rows = [(i, t) for i, (_, t) in enumerate(repeating())] + [(None, "lone Words"), (None, "lone Words"), (None, "other"), (3, "again")]
    out = lm_scores(table(spark, rows), vocabulary_path(RANKS)).collect()
    own = [(d, [*brute.words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for d, t in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    count = collections.Counter(w for d, ws in own if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    wanted = sorted(((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in own), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == wanted
    assert all(r.score < 0 for r in out)


def test_every_training_text_reaches_the_language_model(spark, rows):
    from flowlark.llm import lm_score as lm

    path = vocabulary_path(RANKS)
    end = len(lm.vocabulary(path)[1])
    texts = [t or "" for _, t in rows]
    ids, begins = lm.subwords(pa.array(texts), path, end)
    classes = lm.Classes(np.bincount(ids, minlength=end + 1))
    shards = lm.dealt(table(spark, rows).repartition(3), path, end, classes, len(ids))
    got = collections.Counter()
    for r in shards.where("shard >= 0").collect():
        own, lengths = lm.unpacked(r.payload, np.int32, np.int32)
        got.update(tuple(x) for x in np.split(own, np.cumsum(lengths)[:-1]))
    assert got == collections.Counter(tuple(ids[a:b]) for a, b in zip(begins, begins[1:]))
    assert {r.shard for r in shards.collect()} == {-1, *range(lm.shards_of(len(ids))[0])}
    pairs = lm.pair_counts(shards, end)
    assert pairs.sum() == len(ids) and pairs[lm.CLASSES].sum() == len(texts)
    inside = np.exp(lm.inside_given(pairs, classes).astype(float))
    assert all(np.allclose(np.bincount(classes.of, x, lm.CLASSES), 1, atol=1e-4) for x in inside[:: lm.CLASSES // 4])
    assert lm.shards_of(1e10)[0] > 9 * lm.shards_of(1e9)[0] > 9 * lm.shards_of(1e6)[0]


def test_language_model_learns_what_follows(spark):
    draw, words = random.Random(4), ["red", "blue", "green", "stone", "river", "house", "cloud", "bread"]
    texts = []
    for _ in range(400):
        at = draw.randrange(8)
        texts.append(" ".join(words[(at + i) % 8] for i in range(draw.randint(40, 120))))
    out = [r for r in lm_scores(table(spark, list(enumerate(texts))), vocabulary_path(RANKS)).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)


def test_attention_gradients_and_single_scoring():
    draw = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in attention.fresh(20, np.log(np.full(6, 1 / 6))).items()}
    inputs, there, target, counts = draw.integers(0, 20, (3, 32)), np.ones((3, 32), bool), draw.integers(0, 6, (3, 32)), draw.random((3, 32)) < 0.7
    there[0, :8] = False
    _, g = attention.gradients(p, inputs, there, target, counts)
    for k in p:
        at = (int(inputs[1, 3]), 2) if k == "E" else tuple(int(draw.integers(0, s)) for s in p[k].shape)
        was, loss = p[k][at], []
        for step in (1e-5, -1e-5):
            p[k][at] = was + step
            loss.append(attention.gradients(p, inputs, there, target, counts)[0])
        p[k][at] = was
        assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 3e-5
    p = {k: x.astype(np.float32) for k, x in p.items()}
    slow = np.take_along_axis(attention.log_softmax(attention.forward(p, inputs, there)[0]), target[:, :, None], 2)[:, attention.CONTEXT :, 0]
    assert np.allclose(slow, attention.log_likelihoods(p, inputs, there, target[:, attention.CONTEXT :]), atol=1e-4)
    doc, places, scores = attention.windows_of(np.array([0, 1, 1, 30, 200]))
    assert sorted(zip(np.repeat(doc, scores.sum(axis=1)).tolist(), places[scores].tolist())) == [(d, i) for d, n in enumerate((1, 0, 29, 170)) for i in range(n)]


def test_recurrent_gradients():
    draw = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in gru.fresh().items()}
    vectors, words, there, label = draw.standard_normal((30, 16)), draw.integers(0, 30, (4, 10)), draw.random((4, 10)) < 0.8, np.array([0, 1, 1, 0.0])
    _, g, _ = gru.gradients(p, vectors, words, there, label)
    for k in g:
        at, loss = tuple(int(draw.integers(0, s)) for s in p[k].shape), []
        was = p[k][at]
        for step in (1e-3, -1e-3):
            p[k][at] = was + step
            loss.append(gru.gradients(p, vectors, words, there, label)[0])
        p[k][at] = was
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][at]) < 1e-4


def test_toxicity_learns_words_and_leaves_others(spark):
    draw = random.Random(2)

    def text(bad):
        own = [f"w{draw.randrange(300)}" for _ in range(draw.randint(5, 150))]
        return " ".join(own[:-1] + ["horrid"] * bad + own[-1:])

    texts = [text(i % 4 == 0) for i in range(500)]
    label = np.array([i % 4 == 0 for i in range(500)], np.float32)
    p = fitted(Words(pa.array(texts[:400])), label[:400])
    assert ((scored(p, Words(pa.array(texts[400:]))) >= 0.5) == (label[400:] == 1)).mean() > 0.95


def test_toxicity_rows(spark):
    out = toxicity(table(spark, AWKWARD), table(spark, [(1, 1, 1), (1, 1, None), (None, 1, 0), (9, 1, 7)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((d for d, _ in AWKWARD), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_preference_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, None, None, None), (None, 0, "user", "x"), (4, 0, "user", "hi"), (4, 1, "assistant", "yes")]
    out = preference_format(preference_pairs(table(spark, turns, "conv_id long, turn long, role string, text string"))).collect()
    got = {(r.kind, r.chosen_id, r.rejected_id): r for r in out}
    assert sorted(got) == [("opening", 1, 2), ("opening", 1, 4), ("reply", 1, 1), ("reply", 2, 2), ("reply", 3, 3), ("reply", 4, 4)]
    r = got["opening", 1, 2]
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.chosen_completion == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [r.chosen_completion[s.start : s.end] for s in r.chosen_spans] == ["yes<|im_end|>"] and r.n_prompt_turns == 1
    assert got["opening", 1, 4].identical and got["opening", 1, 4].chosen_completion == ""


def test_derived_records(spark):
    html = "<html><head><title>no</title></head><body><script>var t='</p>';</script><p>One &amp;lt; <b>two</b><br>three &copy;</p><!-- x -->\n\n</body>"
    out = derived_records(responses_of_pages(table(spark, [(1, "http://a/", html), (2, None, None), (None, None, "")], "page_id long, url string, html string"))).collect()
    one = {r.warc_type: r for r in out if r.source_id == 1}
    assert one["conversion"].block == "One &lt; two\nthree ©"
    assert one["metadata"].refers_to == one["conversion"].refers_to and one["conversion"].record_id in one["metadata"].block
    assert one["conversion"].block_digest == "sha256:" + brute.sha(one["conversion"].block.encode())
    assert f"source-payload-digest: sha256:{brute.sha(html.encode())}" in one["metadata"].block
    assert f"WARC-Refers-To: {one['conversion'].refers_to}\r\n" in one["conversion"].header and one["conversion"].header.endswith("\r\n\r\n")
    assert len(out) == 6 and all(r.content_length == len(r.block.encode()) for r in out)


ON_DOCUMENTS = {
    "bytes": lambda d: suffix.without_repeats(d),
    "words": lambda d: without_repeats(d),
    "near": lambda d: near_duplicates(d),
    "fertility": lambda d: fertility(d),
    "encoding": lambda d: encode_decode(d, BPE),
    "scores": lambda d: lm_scores(d, vocabulary_path(RANKS)),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_tables_and_clashing_columns(spark, name):
    assert ON_DOCUMENTS[name](table(spark, [])).collect() == []
    clashing = "doc_id long, text string, tag string, n long, d string, t string, starts string, node string, bucket string, kind string, key string, seed string, h string, words string"
    wide = [(d, t, *["x", 1], *["y"] * 10) for d, t in AWKWARD]
    out = ON_DOCUMENTS[name](table(spark, wide, clashing)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((d for d, _ in AWKWARD if d is not None or name != "near"), key=str)


def test_empty_other_tables(spark):
    items, labels = table(spark, [], "item_id long, text string"), table(spark, [], "doc_id long, toxic int")
    assert contaminated(table(spark, AWKWARD), items).collect() == []
    assert contaminated(table(spark, []), table(spark, [(1, "a b")], "item_id long, text string")).collect() == []
    assert toxicity(table(spark, []), labels).collect() == []
    assert preference_format(preference_pairs(table(spark, [], "conv_id long, turn long, role string, text string"))).collect() == []
    assert derived_records(responses_of_pages(table(spark, [], "page_id long, url string, html string"))).collect() == []


def test_strays_meet_in_blocks(spark, monkeypatch):
    """Many texts of one origin, mostly just below the limit: blocks of a few texts give the classes of the plain search."""
    import random

    from flowlark.llm import bagminhash as near
    from tests.llm import brute

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near, "AT_ONCE", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near.near_duplicates(docs, turns=1).collect())) == brute.classes(rows)


def test_named_characters_are_decoded_in_one_pass_as_one_by_one(spark):
    """op2: the text was searched once for each of 22 names, and every single space was replaced by itself."""
    pieces = [e for e, _ in warc.ENTITIES] + ["&", "amp;", "lt;", "&#39", ";", "é", " ", " ", "\n", "\t", "a  b", "&amp;amp;", "&&lt;lt;"]
    rng = np.random.default_rng(2)
    texts = ["", "&", "no", "&amp;lt;", *("".join(rng.choice(pieces, 12)) for _ in range(300))]

    def plain(text):
        for name, character in warc.ENTITIES:
            text = text.replace(name, character)
        return text

    def spaced(text):
        text = re.sub(r"[ \xa0]+", " ", plain(re.sub(r"[\n\t\x0b\f ]+", " ", text)))
        return text.strip(" ")

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", warc.decoded(F.col("t")).alias("d"), warc.plain_text(F.col("t")).alias("p"))
    got = {r["n"]: (r["d"], r["p"]) for r in rows.collect()}
    untagged = [n for n, t in enumerate(texts) if "<" not in t]
    assert [got[n][0] for n in range(len(texts))] == [plain(t) for t in texts]
    assert [got[n][1] for n in untagged] == [spaced(texts[n]) for n in untagged]
    assert not re.search(r"(?<!regexp_)replace\(", rows._jdf.queryExecution().optimizedPlan().toString())


def test_each_bucket_of_words_gets_its_own_words_and_counts():
    """all words of a block were gone through again for each bucket."""
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randint(0, 60)}" for _ in range(draw.randint(0, 40))) for _ in range(30)]
    block = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(30), pa.int64()), "tag": pa.array([0] * 30, pa.int32()), "text": texts})
    found, known = collections.Counter(), collections.Counter()
    for b, kind, number, payload in lm_score.shipped(block, 7, 4):
        if kind == 0:
            text, lengths, seen = windows.unpacked(payload, bytes, np.int32, np.int64)
            ends = np.cumsum(lengths).tolist()
            own = [text[a:e].decode() for a, e in zip([0, *ends[:-1]], ends)]
            known.update(dict(zip(own, seen.tolist())))
        else:
            local, doc, n = windows.unpacked(payload, np.int32, np.int32, np.int32)
            assert (np.diff(doc) >= 0).all() and number == 4
            found.update({(d, own[w]): c for w, d, c in zip(local.tolist(), doc.tolist(), n.tolist())})
    assert found == collections.Counter((d, w) for d, t in enumerate(texts) for w in [*t.split(), ""])
    train = set(np.flatnonzero(lm_score.fold(list(range(30))) != lm_score.HELD).tolist())
    assert +known == collections.Counter(w for d, t in enumerate(texts) for w in [*t.split(), ""] if d in train)


def test_words_of_a_block_are_searched_once_for_all_buckets(monkeypatch):
    """twice for each bucket, over all words and counts of the block."""
    calls, search = [], np.searchsorted
    monkeypatch.setattr(lm_score.np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    texts = [f"a{i} b{i % 7} c" for i in range(200)]
    block = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "tag": pa.array([0] * 200, pa.int32()), "text": texts})
    assert len({r[0] for r in lm_score.shipped(block, 50, 0)}) > 40 and len(calls) < 10
