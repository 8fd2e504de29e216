"""Operators on single texts: quality rules, BPE, secrets, PII, language."""

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import plain_pii, plain_secrets, quality_base, sha, spans
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourcast.llm import bpe, common, features, language, pii, quality_rules, secret_scan

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text("abc dehrnt'1\né<|endoftext|>", max_size=400))
def test_bpe_is_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_long_words_leave_the_array(codec, library):
    for text in ("a" * 5000, "thethere" * 300, "é" * 700, "<|endoftext|>" * 3 + "z" * 200):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_memory_empties(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 5)
    texts = ["the cat sat on the mat", None, "", "a cat and a dog and a hen"]
    got = [ids.tolist() for ids in bpe.Codec(bpe.vocabulary(PATH)).encode_many(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_tasks_do_not_parse_the_vocabulary(spark, monkeypatch):
    source = bpe.vocabulary(PATH)
    want = bpe.Codec(source).encode("some words, some more words")
    made = [bpe.encoder(source), bpe.digest(source), bpe.decoder(source)]
    monkeypatch.setattr(bpe.json, "loads", lambda text: pytest.fail("a task parsed the file"))
    ids, digests, text = (f.func for f in made)
    texts = pd.Series(["some words, some more words", None, ""])
    for _ in range(2):  # a task that follows starts with an empty memory and gives the same
        got = next(iter(list(ids(iter([texts])))))
        assert [x.tolist() for x in got] == [want, [], []]
        assert list(digests(iter([texts])))[0]["n_tokens"].tolist() == [len(want), 0, 0]
        assert list(text(iter([pd.Series([want, None])])))[0].tolist() == ["some words, some more words", None]


def test_tasks_give_memory_back_before_and_after(monkeypatch):
    log = []
    monkeypatch.setattr(common, "give_back", lambda: log.append("back"))
    for x in common.lean(iter([1, 2])):
        log.append(x)
    assert log == ["back", 1, 2, "back"]


def test_secret_evidence_is_worked_out_once(spark, small, monkeypatch):
    """The function is not held twice, above and below the filter: that took a second worker a task."""
    plans, stored = [], secret_scan.stored
    monkeypatch.setattr(secret_scan, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stored(df, label))[1])
    secret_scan.learn(small)
    assert len(plans) == 1 and plans[0].count("ArrowEvalPython") == 1


def test_bpe_gives_memory_back_after_every_batch(monkeypatch):
    log = []
    monkeypatch.setattr(common, "give_back", lambda: log.append("back"))
    source = bpe.vocabulary(PATH)
    for made in (bpe.encoder(source), bpe.digest(source)):
        log.clear()
        for out in made.func(iter([pd.Series(["some words"]), pd.Series(["more", None])])):
            log.append(len(out))
        assert log[:5] == ["back", 1, "back", 2, "back"]


def test_bpe_memory_is_bounded_and_keeps_words_met_again(library, monkeypatch):
    """Rare words by the thousand, one frequent word: both halves stay in the bound, the frequent word is worked out once."""
    monkeypatch.setattr(bpe, "MEMORY", 60_000)
    monkeypatch.setattr(bpe, "TOGETHER", 400)
    codec, learned, most = bpe.Codec(bpe.vocabulary(PATH)), [], 0
    learn = codec.learn
    monkeypatch.setattr(codec, "learn", lambda words: (learned.extend(words), learn(words)))
    texts = [" ".join(f"frequent w{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}" for j in range(26)) for i in range(120)]
    for text, ids in zip(texts, codec.encode_many(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        most = max(most, sum(bpe.ENTRY + len(w) + len(x) for half in (codec.seen, codec.before) for w, x in half.items()))
    assert len(learned) > 2000 and learned.count(" frequent") == 1
    assert most < 60_000 + 2 * 60 * (bpe.ENTRY + 40)  # the halves, and the words of one round in each


def test_bpe_digest(tricky, empty, small, library):
    for docs in (tricky, small):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        got = [tuple(r) for r in bpe.digest_documents(docs, PATH).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.digest_documents(empty, PATH).count() == 0


def test_bpe_round_trip(tricky):
    back = bpe.decode_documents(bpe.encode_documents(tricky.select("text"), PATH), PATH)
    assert all((r["text"] or "") == r["decoded"] for r in back.select("text", "decoded").collect())


def test_quality_counts_and_empty_labels(tricky, empty, labels):
    rules = quality_rules.learn(tricky, labels.limit(0))
    assert rules == []
    for r in quality_rules.judged(tricky, rules).join(tricky.select("doc_id", "text").distinct(), "doc_id").collect():
        want = quality_base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judged(empty, rules).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("a b c".split()), max_size=60))
def test_repeated_words(words):
    text = " ".join(words)
    assert features.base(text) == quality_base(text)


def test_decision_list_learns_thresholds():
    rng = np.random.default_rng(1)
    x = {"u": rng.random(3000), "v": rng.random(3000)}
    bad = (x["u"] > 0.8) & (x["v"] <= 0.5)
    rules = quality_rules.decision_list(x, bad, rng.random(3000) < 0.33)
    got = np.zeros(3000, bool)
    for r in rules:
        got |= r.holds(x)
    assert rules and (got == bad).mean() > 0.99


def test_rules_are_one_ordered_expression(spark):
    c = quality_rules.Condition
    rules = [quality_rules.Rule((c("u", ">", 1.0),), True), quality_rules.Rule((c("u", ">", 0.0), c("v", "<=", 2.0)), False)]
    df = spark.createDataFrame([(2.0, 0.0), (0.5, 1.0), (0.5, 3.0), (-1.0, 0.0)], "u double, v double")
    assert [r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == [True, False, True, True]


def test_quality_rules_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality_rules.judged(docs, quality_rules.learn(docs, learn)).join(test, "doc_id").where("not base_failed").toPandas()
    # some twenty bad documents to learn from: those it rejects are bad, and many of the others are found
    assert (got.kept == (got.quality == 1)).mean() > 0.9
    assert got.kept[got.quality == 1].mean() > 0.97


def test_secrets_plain_spans(tricky, empty, small):
    model = secret_scan.Model([], [[0.0] * secret_scan.CLASSES] * secret_scan.CLASSES)
    for docs in (tricky, small):
        texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        want = sorted(((i, sha(spans(plain_secrets(t), secret_scan.KINDS)), *(sum(k == n for _, k, _ in plain_secrets(t)) for n in range(3))) for i, t in texts), key=repr)
        got = sorted({(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secret_scan.digest_documents(docs, model).collect()}, key=repr)
        assert sorted(set(want), key=repr) == got
    assert secret_scan.digest_documents(empty, secret_scan.learn(empty)).count() == 0


def test_grammar_prefers_its_format():
    rng = np.random.default_rng(2)
    make = lambda letters, n: "".join(rng.choice(list(letters), n)).encode().translate(secret_scan.TABLE)
    g = secret_scan.Grammar([make("0123456789abcdef", 40) for _ in range(200)])
    assert g.bits(make("0123456789abcdef", 40)) > g.bits(make("ghijkmnopqr", 40)) + 100


def test_secrets_format_spans(spark):
    rng = np.random.default_rng(3)
    secret = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    prose = "plain words of ordinary prose stand here without any credential at all and version2beta1release3 "
    rows = [(i, prose + (f"token = {secret()} " if i < 60 else "")) for i in range(200)]
    bare = secret()[:30]  # under the plain pattern's length
    rows.append((200, prose + bare + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.learn(docs)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_documents(docs, model).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[200]] == [("format", len(prose), len(prose) + 30)]
    assert all(not got[i] for i in range(60, 200))
    masked = {r["doc_id"]: r["t"] for r in docs.select("doc_id", secret_scan.redactor(model)(F.col("text")).alias("t")).collect()}
    assert masked[200] == prose + "[SECRET] end" and masked[0] == prose + "[SECRET] " and masked[100] == rows[100][1]


def test_secrets_ordinary_text_is_that_of_all_texts(spark, monkeypatch):
    """Class pairs come from every text, with credentials or without, wherever it stands in a batch."""
    rng = np.random.default_rng(4)
    number = lambda: "".join(rng.choice(list("0123456789"), 16))
    texts = ["prose", *(f"prose token = {number()} end" for _ in range(60)), *(f"order {number()}" for _ in range(300)), None, "", "naïve 🙂"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs = np.full((secret_scan.CLASSES, secret_scan.CLASSES), 0.5)
    for t in texts:
        t, at, ordinary = t or "", 0, " "
        for s, e in sorted((s, e) for s, _, e in plain_secrets(t)):
            ordinary, at = ordinary + t[at:s] + " ", max(at, e)
        c = (ordinary + t[at:] + " ").encode().translate(secret_scan.TABLE)
        for a, b in zip(c, c[1:]):
            pairs[a, b] += 1
    want = np.log2(pairs / pairs.sum(1, keepdims=True))
    for stretch, parts in ((1 << 20, 1), (5, 1), (1 << 20, 7)):
        monkeypatch.setattr(secret_scan, "STRETCH", stretch, raising=False)
        model = secret_scan.learn(docs.coalesce(1) if parts == 1 else docs.repartition(parts))
        assert np.allclose(model.plain, want)
    # numbers are ordinary here: most texts without credentials hold one
    assert all(k != 3 for t in texts for _, k, _ in model.spans(t or ""))


def test_secrets_all_candidates_are_scored():
    """Short runs, runs of one kind of character, and what a plain span leaves of a run."""
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYzz"
    text = f"AKIAABCDEFGHIJKL/{key} pre.{'0123456789abcdef' * 2}.{key}/x abcdefgh 12345678 short12"
    got = [(text[s:e], s, e) for s, e, _ in secret_scan.candidates(text, secret_scan.plain_spans(text))]
    assert [t for t, _, _ in got] == ["/" + key, "." + key + "/x", "abcdefgh", "12345678"]
    g = secret_scan.Grammar([b"\x01" * 100] * 50)  # folded whole: they stop after 100 characters, nowhere before
    assert sum(stop > np.log2(secret_scan.FLOOR) for _, stop in g.table) == 1


def test_pii_plain_spans(tricky, empty, small):
    for docs in (tricky, small):
        texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        want = {(i, sha(spans(plain_pii(t), pii.KINDS)), *(sum(k == n for _, k, _ in plain_pii(t)) for n in range(4))) for i, t in texts}
        got = {(r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.digest_documents(docs).collect()}
        assert got == want
    assert pii.digest_documents(empty).count() == 0


def test_pii_terms_that_reveal(spark):
    common = "the report was sent and the answer came back to the office late in the day"
    rows = [(i, f"{common} number {i}") for i in range(60)]
    rows += [(60 + i, f"{common} by zarathustra at z@x.org and others") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest_documents(docs).collect()}
    text = rows[60][1]
    at, mail = text.index("zarathustra"), text.index("z@x.org")
    assert f"term:{at}:{at + 11}" in got[60] and f"email:{mail}:{mail + 7}" in got[60]
    assert not any("term:0:3" in s for s in got.values())  # "the" is everywhere
    assert all(got[i] == "" for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "zarathustra" not in clean[60] and "z@x.org" not in clean[60] and "[EMAIL]" in clean[60] and clean[0] == rows[0][1]


def test_pii_terms_far_from_the_entity_and_without_it(spark):
    common = "the report was sent and the answer came back to the office late in the day "
    rows = [(i, f"{common} number {i}") for i in range(60)]
    rows += [(60 + i, "Zarathustra wrote: " + common * 40 + "ZARATHUSTRA mail z@x.org") for i in range(30)]
    rows.append((90, common * 30 + "x🙂zarathustra, again zarathustra"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest_documents(docs).collect()}
    for i in (60, 89, 90):  # every occurrence, in pieces beyond the first, and where the entity is not
        places = [m.start() for m in regex.finditer("zarathustra", rows[i][1].lower())]
        assert [s for s in got[i].split(",") if s.endswith(tuple(f":{p}:{p + 11}" for p in places))] == [f"term:{p}:{p + 11}" for p in places]
    assert all(got[i] == "" for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert not any("zarathustra" in t.lower() for t in clean.values())
    text = "ab 🙂 naïve" + "y" * 2500 + " x1y22zzz " + "word " * 900
    at = pii.occurrences(spark.createDataFrame([(1, text)], "row_no long, _text string")).collect()
    assert sorted((r["start"], r["end"], r["term"]) for r in at) == [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{3,}", text)]


def test_pii_entities_count_in_documents_without_terms(spark):
    rows = [(i, f"no. {i}") for i in range(56)] + [(56 + i, "zarathustra +1 (234) 555-0199") for i in range(3)] + [(59, "zarathustra")]
    rows += [(60 + i, "+1 (234) 555-0199") for i in range(40)]
    got = pii.digest_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # 3 of 4 is above (3 / 100) ** 0.1, but the entity is in 43 documents
    assert not any("term" in r["spans"] for r in got) and sum(r["n_phone"] for r in got) == 43


def test_pii_plan_is_native(small):
    plan = pii.digest_documents(small)._jdf.queryExecution().toString()
    assert not regex.search("Python|Arrow|Pandas", plan)


def test_language(spark, tricky, empty, small):
    def und(t):
        return not t or not any(c.isalpha() for c in t)

    got = language.predict_documents(tricky).join(tricky.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all((r["lang_pred"] == "und") == und(r["text"]) and 0 <= r["score"] <= 1 for r in got)
    assert language.predict_documents(empty).count() == 0
    got = language.predict_documents(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)


def test_code_length_is_the_context_trees(spark):
    """The looked-up costs against a walk over the counts, seen and unseen contexts alike."""
    from collections import Counter
    from math import log2

    taught = "the cat sat on the mat, the hat"
    docs = spark.createDataFrame([(taught, "en")], "text string, lang string")
    model = language.learn(docs, F.lit(True))
    data = b"  " + taught.encode()
    order = [Counter(data[i - k : i + 1] for i in range(2, len(data))) for k in range(3)]

    def bits(text):
        total, b = 0.0, b"  " + text.encode()
        for i in range(2, len(b)):
            p = 1.0
            for k in (2, 1, 0):
                context = b[i - k : i]
                here = {s: n for s, n in order[k].items() if s[:-1] == context}
                t, d = sum(here.values()), len(here)
                if b[i - k : i + 1] in here:
                    p *= here[b[i - k : i + 1]] / (t + d)
                    break
                p *= d / (t + d) if t else 1.0
            else:
                p /= 256 - len(order[0])
            total -= log2(p)
        return total

    scorer = language.Scorer(model)
    for text in ("the cat", "zebra", "mat hat cat", "é!", "t"):
        assert abs(scorer.bits(text.encode())[0] - bits(text)) < 1e-3 * (1 + bits(text))


def test_language_keeps_all_languages_and_triples(spark, monkeypatch):
    """More than 16 languages, more than 100,000 triples in one, and languages in parts as in one table."""
    rng = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * i + j, f"l{i:02}", " ".join("".join(rng.choice(list(letters[i : i + 5]), 6)) for _ in range(30))) for i in range(20) for j in range(12 - i % 5)]
    rows += [(5000 + j, "noise", "".join(map(chr, rng.integers(0x80, 0x7FF, 100_000)))) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.learn(docs, F.lit(True))
    assert len(model.languages) == 21
    noise = {bytes(t) for _, lang, text in rows if lang == "noise" for d in [b"  " + text.encode()] for t in zip(d, d[1:], d[2:])}
    got = {bytes([k >> 16, (k >> 8) & 255, k & 255]) for k in model.keys.tolist()}
    assert len(noise) > 100_000 and noise <= got
    whole = language.predict_documents(docs).collect()
    right = {i: lang for i, lang, _ in rows}
    assert all(r["lang_pred"] == right[r["doc_id"]] for r in whole)
    monkeypatch.setattr(language, "TABLE", 50_000)
    assert len(language.together(language.counted(docs, F.lit(True)))) > 2
    odd = docs.unionByName(spark.createDataFrame([(None, None, None), (7001, None, "123"), (7001, None, "123")], docs.schema))
    parted = language.predict_documents(odd).collect()
    key = lambda r: (r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9))
    assert sorted(map(key, whole)) == sorted(key(r) for r in parted if r["doc_id"] in right)
    assert sorted((r["lang_pred"], r["score"]) for r in parted if r["doc_id"] not in right) == [("und", 0.0)] * 3


def test_hash_is_of_utf8():
    assert sha("é") == hashlib.sha256(b"\xc3\xa9").hexdigest()


def test_pii_of_many_numbers_is_linear(spark):
    """50,000 separate numbers in one text, some of them entities, in seconds and at the right places."""
    import time

    text = " ".join(f"{i % 97} x" if i % 500 else f"10.0.{i // 500}.7 x" for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.digest_documents(docs).first()
    assert time.time() - began < 10
    want = plain_pii(text)
    assert got["n_ip"] == 100 and got["base_sha256"] == sha(spans(want, pii.KINDS))


def test_labelled_rows_are_bounded(spark):
    """One labelled id on most rows: no more than ``sample`` rows come to the driver, equal ones once."""
    from hourcast.llm import quality_rules
    from hourcast.llm.features import RATES, measured, with_rates

    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(900)] + [(1, "same text")] * 50 + [(i, "other words") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    rows = quality_rules.labelled(docs, labels, 20)
    rows = with_rates(rows.select("doc_id", "bad", measured(F.col("text")).alias("x")).select("doc_id", "bad", "x.*"))
    kept = quality_rules.bounded(rows, 20).collect()
    assert len(kept) <= 20 and len({(r["doc_id"], *(r[c] for c in RATES)) for r in kept}) == len(kept)
    assert quality_rules.learn(docs, labels, sample=20) is not None


def test_column_names_with_a_dot(small, spark):
    from hourcast.llm import mixing, site_quality

    docs = small.limit(30).withColumn("a.b", F.lit("x")).withColumn("row", F.lit(1))
    for out in (mixing.copies_of(docs), pii.sanitised(docs), site_quality.scored(docs, None, carry=docs.columns).select("row.*")):
        assert set(docs.columns) <= set(out.columns) and out.where("`a.b` <> 'x'").count() == 0
