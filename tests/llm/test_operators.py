"""Corpus operators against plain loops, on small awkward tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import (
    components,
    decontaminate,
    langid,
    licences,
    pieces,
    pii,
    queries,
    repeats,
    sharding,
    simhash,
    topk,
    warc,
    words,
)

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# a name of every helper column, to clash with
CLASH = ", _row bigint, node bigint, hash string, units string, bucket string, text2 string"
rng = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(60)]
PROSE = [" ".join(rng.choice(VOCABULARY) for _ in range(60)) for _ in range(8)]
AWKWARD = [
    None, "", "   ", "!!!", "one", "One", "two words", "é\u0000ü 日本 😀", "a" * 5000, "x " * 3000,
    PROSE[0], PROSE[0], PROSE[0] + " tail", PROSE[1].upper(), PROSE[1], "line one is here\n" * 3,
]


def frame(spark, texts, clash=True):
    rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(3, "!!!", None, None, None), (None, "no key at all here", None, None, None)]
    df = spark.createDataFrame(rows, DOC)
    if clash:
        for c, kind in (x.split() for x in CLASH.lstrip(", ").split(", ")):
            df = df.withColumn(c, F.lit(1).cast(kind))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i: i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, docs, empty):
    edited = [PROSE[2].replace(w, "zz", 1) for w in VOCABULARY[:30]]
    df = docs.unionByName(frame(spark, edited).withColumn("doc_id", F.col("doc_id") + 100))
    got = [r.asDict() for r in simhash.near_duplicates(df, shingle=3).collect()]
    rows = [(r.doc_id, fingerprint(r.text, 3)) for r in df.collect()]
    assert sorted(str((g["doc_id"], g["fingerprint"] % 2**64)) for g in got) == sorted(map(str, rows))
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 3:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {f: new if r == old else r for f, r in root.items()}
    least = collections.defaultdict(list)
    for i, f in rows:
        least[root[f]] += [i] if i is not None else []
    for g in got:
        assert g["component_id"] == min(least[root[g["fingerprint"] % 2**64]], default=None)
    assert simhash.near_duplicates(empty).collect() == []


def test_tries_in_chunks(spark, monkeypatch):
    """Cells that are cut into chunks lose no link."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) & 2**64 - 1 for b in base for _ in range(30)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v, 0, v) for v in signed], "node bigint, table int, fingerprint bigint")
    links = simhash.near_links(prints, 3)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    group = {v: {v} for v in signed}
    for a in signed:
        for b in signed:
            if bin((a ^ b) % 2**64).count("1") <= 3 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    for v in signed:
        assert {x for x in signed if got.get(x, x) == got.get(v, v)} == group[v]


def test_similar_documents(spark, docs, empty):
    text = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in range(12))
    near = text.replace("b3 ", "changed ")
    far = " ".join(f"{b}{a}" for a in "abcdefghijklmnopqrst" for b in range(12))
    df = spark.createDataFrame([(5, text), (2, near), (9, text), (7, far), (8, None), (1, "")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 2, 7]
    assert simhash.similar_documents(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() <= 1


@pytest.mark.parametrize("chunk_bytes", [simhash.CHUNK_BYTES, 40_000])
def test_similar_documents_against_all_pairs(spark, monkeypatch, chunk_bytes):
    """Groups around the bound, whole and cut into chunks, and boilerplate that hides other words."""
    monkeypatch.setattr(simhash, "CHUNK_BYTES", chunk_bytes)
    own = random.Random(11)
    texts = ["same line again and again\n" * 400 + " ".join(f"t{k}x{j}" for j in range(60)) for k in range(4)]
    for _ in range(12):
        base = [own.choice(VOCABULARY) + own.choice("abcdef") for _ in range(300)]
        for changes in (0, 0, 1, 2, 4, 6, 7, 8, 9, 10, 12, 16, 30):
            words = list(base)
            for at in own.sample(range(300), changes):
                words[at] = f"new{own.randrange(10**6)}"
            texts.append(" ".join(words))
    found = simhash.similar_documents(
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = {k: {k} for k in range(len(texts))}
    close = 0
    for i in group:
        for j in range(i):
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            close += 0.7 < similarity < 0.9
            if similarity >= 0.8 and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[i]:
                    group[k] = group[i]
    component = {r.doc_id: r.component for r in found}
    assert close > 100 and len(found) == len(texts)
    for i in group:
        assert {j for j in group if component[i] == component[j]} == group[i]
    assert {r.doc_id for r in found if r.is_first} == {min(g) for g in group.values()}


def test_similar_documents_miss_no_pair(spark):
    """Texts of 8 to 100 words with appended and replaced runs, against all pairs."""
    r = random.Random(9)
    texts = []
    for size in (8, 12, 20, 35, 50, 70, 100):
        for _ in range(12):
            own = [f"v{int(r.paretovariate(0.7)) % 5000}" for _ in range(size)]
            extra = [f"u{r.randrange(10**6)}" for _ in range(max(1, size // 6))]
            at = r.randrange(size)
            texts += [own, own + extra, own[:at] + extra[:max(1, size // 40)] + own[at + 1:]]
    sets = [{tuple(t[k: k + 5]) for k in range(max(len(t) - 4, 1))} for t in texts]
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    df = spark.createDataFrame([(k, " ".join(t), None, None, None) for k, t in enumerate(texts)], DOC)
    got = {}
    for row in simhash.similar_documents(df).collect():
        got.setdefault(row.component, set()).add(row.doc_id)
    want = {}
    for k, g in enumerate(group):
        want.setdefault(g, set()).add(k)
    assert len(want) < len(texts) - 60 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_stages_judge_rows_by_themselves(spark):
    """Null and shared keys: only the bad rows go, and one of several equal rows stays."""
    good = [r[1] for r in language_rows()]
    passage = " ".join(f"aeiou{k % 7}lmn" for k in range(30))
    spoilt = [(None, "12 34 !!", "aa", "s", 8), (3, "56 78 !!", "aa", "s", 8)]
    nulls = [(None, good[k], "aa", "s", 1) for k in (0, 2, 4)]
    df = spark.createDataFrame([*language_rows()[1:], *nulls, *spoilt], DOC).withColumn("_row", F.lit("x"))
    kept = langid.keep_known(df)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == df.columns and sorted(texts) == sorted([*good[1:], good[0], good[2], good[4]])
    leak = [(None, passage, "aa", "s", 1), (5, passage, "aa", "s", 1)]
    df = spark.createDataFrame([*nulls, (5, good[6], "aa", "s", 1), *leak], DOC).withColumn("_row", F.lit("x"))
    kept = decontaminate.keep_clean(df, spark.createDataFrame([(1, passage)], queries.BENCHMARK))
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == sorted(good[k] for k in (0, 2, 4, 6))
    rows = [(7, good[0], "aa", "s", 1)] * 3 + [(None, good[1], "bb", "s", 1)] * 2 + [
        (None, good[2], "aa", "s", 1), (8, good[2], "aa", "s", 1), (9, good[3], "aa", "s", 1)]
    df = spark.createDataFrame(rows, DOC).withColumn("_row", F.lit("x"))
    kept = simhash.keep_one(df)
    want = [(7, good[0]), (None, good[1]), (8, good[2]), (9, good[3])]
    assert kept.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = components.connected_components(edges).collect()
    assert {r.root for r in got if r.node <= 40} == {0} and {r.root for r in got if r.node >= 100} == {100}
    assert components.connected_components(edges.limit(0)).count() == 0


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_of_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words, "PIECE", 64)
    texts = [t for t in AWKWARD]
    found = words.words_of(*words.text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        lo, hi = found.first[k], found.first[k + 1]
        assert found.text(lo, hi).split(" ") == (tokens(t) or [""])
    same = collections.defaultdict(set)
    for k in range(len(found.start)):
        same[found.text(k, k + 1)].add(int(found.hash[k]))
    assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)


def test_contamination_against_loops(spark, docs, empty):
    items = [(1, PROSE[0]), (2, "one"), (3, "two words"), (4, None), (5, "?!"), (None, PROSE[1]), (6, PROSE[0]), (6, PROSE[0]),
             (7, " ".join(PROSE[1].split()[5:30]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    report, matches = decontaminate.contamination(docs, bench)
    want = []
    wins = collections.defaultdict(set)
    for i, t in items:
        w = tokens(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k: k + n])].add(i)
    for r in docs.collect():
        w, hit, ids = tokens(r.text), set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k: k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= of
        ids = sorted(str(i) for i in ids if i is not None)
        want.append(str((r.doc_id, len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w))))
    got = [str((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in report.collect()]
    assert sorted(got) == sorted(want)
    assert decontaminate.contamination(empty, bench)[0].count() == 0
    assert decontaminate.contamination(docs, bench.limit(0))[0].where("n_hit > 0").count() == 0
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.where(F.col("text") == PROSE[0]).count() == 0


def base_by_rule(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_follow_the_patterns():
    for _ in range(5000):
        t = "".join(rng.choice("ab.@@12 +-(9é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == base_by_rule(t), t
    assert pii.base_spans("a@b.c@d.e 4111 1111 1111 1111") == base_by_rule("a@b.c@d.e 4111 1111 1111 1111")
    assert pii.base_spans("0001.02.003.255") and not pii.base_spans("1.2.3.256")
    assert len(pii.base_spans("x" * 200_000 + "@y.z")) == 1


def test_personal_spans(spark, docs, empty):
    secret = 'token = "0123456789abcdef0123456789abcdef01234567"'
    texts = [f"{PROSE[k % 8]} {secret} mail bob{k}@mail.example.com or +1 (017) 555-{k:04d}" for k in range(30)]
    df = frame(spark, [*texts, None, "", "4111111111111111", "version 1.2.3.4"], clash=True)
    got = {r.doc_id: r for r in pii.personal_spans(df).collect() if r.doc_id is not None}
    assert {s["name"] for s in got[0].spans} >= {"email", "phone", "secret"} and len(got[0].base) == 2
    assert got[30].spans == [] and got[31].spans == [] and got[32].base[0]["name"] == "card"
    masked = pii.mask_personal(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    text = masked.where("doc_id = 0").first()
    assert "[EMAIL]" in text.text and "[PHONE]" in text.text and "[SECRET]" in text.text and text.n_chars == len(text.text)
    assert masked.where("doc_id = 30").first().text is None
    assert pii.personal_spans(empty).count() == 0 and pii.mask_personal(empty).count() == 0
    assert pii.mask_personal(docs).count() == docs.count()


@pytest.mark.parametrize("size", [16, 256, 257, 400, 5000])
def test_secrets_are_taken_whole(spark, size):
    token = "".join(random.Random(size).choice("0123456789abcdefXYZ_+/-") for _ in range(size))
    text = f"login with api_key={token} today"
    assert (19, 4, 19 + size) in {c[:3] for c in pii.candidates(text)}
    held = token[:8] + "x4111111111111111x" + token[8:]
    found = pii.candidates(f"login with api_key={held} today")
    assert {(19, 4, 19 + len(held)), (28, 2, 44)} <= {c[:3] for c in found}
    got = pii.mask_personal(spark.createDataFrame([(1, text, "en", "s", len(text))], DOC)).first()
    assert size < 400 or got.text == "login with api_key=[SECRET] today"


def test_reliabilities_find_the_bad_labeler():
    """Two labelers tell the truth in nine of ten cases, one is wrong as often as right."""
    r = np.random.default_rng(1)
    truth = r.integers(0, 2, 4000)
    codes = np.zeros((4000, len(pii.WIDTHS)), np.int64)
    for k, accuracy in enumerate((0.9, 0.9, 0.5)):
        right = r.random(4000) < accuracy
        codes[:, 1 + k] = np.where(right, truth, 1 - truth) + 1
    post, table = pii.reliabilities(codes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.85
    assert table[0, 1, pii.YES] > 0.8 and abs(table[2, 1, pii.YES] - 0.5) < 0.1


LANGUAGES = {"aa": "aeioulmn", "bb": "zxkqwtpr"}


def language_rows():
    r = random.Random(2)
    rows = []
    for k in range(400):
        lang = ("aa", "bb")[k % 2]
        t = " ".join("".join(r.choice(LANGUAGES[lang]) for _ in range(r.randrange(2, 8))) for _ in range(40))
        rows.append((k, t, lang, "s", len(t)))
    return rows


def test_language_models(spark, docs, empty):
    df = spark.createDataFrame([*language_rows(), (1000, None, "aa", "s", 0), (1001, "12 !?", "aa", "s", 5),
                                (1002, "жщыюяэ " * 30, None, "s", 210)], DOC)
    fold = langid.in_fold(F.col("doc_id"))
    got = {r.doc_id: r for r in langid.identify(df, ~fold).collect()}
    truth = {r[0]: r[2] for r in language_rows()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(got[k].lang_pred == truth[k] for k in held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].rejected and got[1002].lang_pred != "und" and not any(got[k].rejected for k in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.where("doc_id >= 1000").count() == 0
    assert langid.identify(empty, F.lit(True)).count() == 0
    assert langid.identify(docs, F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs, F.lit(True)).count() == docs.count()


def test_probabilities_sum_to_one(spark):
    """The interpolated model is a distribution over the letters after any context."""
    df = spark.createDataFrame(language_rows()[:20], DOC)
    model = langid.train(df)
    letters = sorted(set("".join(r[1] for r in language_rows()[:20]))) 
    code = lambda s: sum(ord(c) << 16 * (len(s) - 1 - k) for k, c in enumerate(s))
    for context in ("aei", "zzz", "xae"):
        logs = model.log_probabilities(np.array([code(context + c) for c in letters], np.uint64))
        total = np.exp(logs.astype(np.float64)).sum(axis=0)
        assert ((total > 0.5) & (total <= 1.001)).all()


def unigram_model():
    """A unigram model file with byte fallback, built by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for p, t in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=p, score=0, type=t)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for p, s in (("▁", -2.1), ("▁the", -3.3), ("▁a", -3.7), ("he", -4.1), ("t", -5.3), ("h", -5.5), ("e", -5.9), ("a", -6.1),
                 ("ab", -6.7), ("b", -7.3), ("▁▁", -7.9), (".", -4.4)):
        m.pieces.add(piece=p, score=s, type=1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, True, len(m.pieces)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    return m.SerializeToString()


def test_pieces_equal_the_original(spark, docs, empty):
    models_ = [unigram_model()]
    try:
        models_.append(pieces.read_model(spark, queries.PIECE_MODEL))
    except OSError:
        pass
    for model in models_:
        original = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = [t for t in AWKWARD if t is not None] + [
            "".join(rng.choice("ab  the in é😀\n.,▁") for _ in range(rng.randrange(30))) for _ in range(300)]
        encoder, decoder = pieces.Encoder(model, 2), pieces.Decoder(model)
        ids, parity = encoder.encode(texts)
        assert all(parity) and [i.tolist() for i in ids] == original.encode(texts)
        whole = encoder.model.tokenizer()
        assert [whole.encode(t, add_special_tokens=False).ids for t in texts] == original.encode(texts)
        assert [decoder.decode(i) for i in ids] == [original.decode(i.tolist()) for i in ids]
        done = pieces.encode(docs, model, restored=True)
        assert done.count() == docs.count() and done.where("not restored or not parity").count() == 0
        back = pieces.decode(done, model)
        assert back.where("decoded <> coalesce(text, '')").count() == 0
        assert pieces.encode(empty, model).count() == 0


def test_licences(spark, docs, empty):
    mit = licences.KNOWN[0][1]
    df = frame(spark, ["# Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("\n", "\r\n\r\n"),
                       mit + " and more", "text\nReleased under the MIT Licence!\nLicensed under the Apache License, Version 2.0", None, ""])
    got = {r.doc_id: r for r in licences.scan(df, licences.known_digests(spark)).collect()}
    assert got[0].license_id == "MIT" and got[1].license_id is None
    assert got[2].notices == "Apache-2.0,MIT" and got[2].n_notice_lines == 2 and got[4].license_id is None
    assert licences.scan(docs, licences.known_digests(spark)).count() == docs.count()
    assert licences.scan(empty, licences.known_digests(spark)).count() == 0


def test_licence_lines_agree_with_sql(spark):
    """Every known text on one line, and one from a further table without any licence word."""
    duckdb = pytest.importorskip("duckdb")
    texts = [f"some text\n{' '.join(t.split())}\nmore text" for _, t in licences.KNOWN]
    df = frame(spark, texts, clash=False)
    scanned = licences.scan(df, licences.known_digests(spark))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    cur = con.execute(licences.scan_sql())
    want = {r[0]: r for r in cur.fetchall() if r[0] != 3}
    got = {r.doc_id: tuple(r) for r in scanned.collect() if r.doc_id not in (None, 3)}
    assert got == want and all(got[k][3] == name for k, (name, _) in enumerate(licences.KNOWN) if k != 3)
    further = licences.known_digests(spark, [("own", "Do as you like with this.")])
    assert licences.scan(frame(spark, ["a\nDo as you like with this\nb"]), further).where("notices = 'own'").count() == 1


def test_repeats_against_loops(spark, docs, empty):
    passage = "This passage of quite many words stands in several texts and should stay only once. And so does this second sentence of the passage here."
    texts = [passage, f"Something of its own stands here first. {passage} And an end of its own that is long enough.",
             "short\nshort\n" + passage.upper(), *[t for t in AWKWARD]]
    df = frame(spark, texts)
    df = df.where("doc_id is null or doc_id <> 3 or text is not null")
    got = repeats.remove_repeats(df).collect()
    source, seen = {d.doc_id: d.text for d in df.collect()}, set()
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        text, drop = source[r.doc_id], []
        for unit, kind, start, end in sorted(repeats.units_of(text or "", 3, 8), key=lambda u: u[2]):
            if (unit, kind) in seen:
                drop.append((start, end, kind))
            seen.add((unit, kind))
        assert [tuple(s) for s in r.removed] == sorted(drop), r.doc_id
        assert r.kept_text == (None if text is None else repeats.without(text, sorted(drop)))
    assert any(passage == r.kept_text for r in got)
    second = next(r for r in got if r.doc_id == 1)
    assert "should stay only once" not in second.kept_text and "Something of its own" in second.kept_text
    assert repeats.remove_repeats(empty).count() == 0


def test_top_products_against_all(spark):
    r = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in r.normal(size=8) * (0.1 + k % 7)], 0) for k in range(300)]
    vectors += [(400 + k, vectors[50][1], 0) for k in range(40)] + [
        (500, None, 0), (501, [1.0, None] * 4, 0), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0), (504, [1.0, 2.0], 0),
        (550, [0.0] * 8, 0), (600, [2.0, 1.0], 0), (None, [0.5] * 8, 0), (100, vectors[100][1], 0)]
    df = spark.createDataFrame(vectors, queries.EMBEDDINGS).withColumn("_row", F.lit("x")).withColumn("norm", F.lit(1))
    got = [tuple(x) for x in topk.top_products(df, F.col("vec_id") % 50 == 0).collect()]
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int), n) for n, (i, v, _) in enumerate(vectors)
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v, n in whole:
        if i is not None and i % 50 == 0:
            scores = sorted((-int(u @ v), j if j is not None else 2**63) for j, u, m in whole if m != n and len(u) == len(v))[:5]
            want += [(i, k + 1, j if j < 2**63 else None, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert topk.top_products(df.limit(0), F.lit(True)).count() == 0


def hilbert(x, y, z, bits):
    """Place on the curve by walking it: each step changes one axis by one."""
    axes, m = [x, y, z], 1 << bits - 1
    q = m
    while q > 1:
        for i in range(3):
            if axes[i] & q:
                axes[0] ^= q - 1
            else:
                t = (axes[0] ^ axes[i]) & q - 1
                axes[0] ^= t
                axes[i] ^= t
        q >>= 1
    for i in (1, 2):
        axes[i] ^= axes[i - 1]
    t, q = 0, m
    while q > 1:
        t ^= q - 1 if axes[2] & q else 0
        q >>= 1
    axes = [a ^ t for a in axes]
    return int("".join(str(a >> b & 1) for b in range(bits - 1, -1, -1) for a in axes), 2)


def test_hilbert_curve_and_shards(spark, docs, empty):
    cells = spark.range(4096).selectExpr("int(id div 256) x", "int(id div 16 % 16) y", "int(id % 16) z")
    got = {r.at: (r.x, r.y, r.z) for r in sharding.with_curve_index(cells, "x", "y", "z", "at").collect()}
    assert sorted(got) == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(got[k], got[k + 1])) == 1 for k in range(4095))
    assert all(hilbert(*p, 4) == k for k, p in got.items())
    placed = sharding.hilbert_shards(docs, 5).collect()
    counts = collections.Counter(r.shard for r in placed)
    assert len(placed) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))
        ranges = [r.curve for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
        assert ranges == sorted(ranges)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (3, None)}
    for r in placed:
        if r.doc_id in texts:
            data = (texts[r.doc_id] or "").encode()
            assert r["size"] == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
    assert sharding.hilbert_shards(empty, 5).count() == 0


def test_write_shards(spark, tmp_path):
    df = frame(spark, AWKWARD, clash=False).where("doc_id is not null").dropDuplicates(["doc_id"])
    path = str(tmp_path / "shards")
    sharding.write_shards(df, sharding.hilbert_shards(df, 4), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4


def test_archives(spark, tmp_path):
    big, html = "x" * 2000, "<p>é</p>"
    rows = [(1, "http://a b\n/", big), (9, None, big), (9, "u", big), (4, "u", html), (5, "u", html), (6, "u", None),
            (None, "u", big), (7, "u", "y" * 1000), (8, "u", "y" * 1000)]
    df = spark.createDataFrame(rows, queries.PAGES).withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit(0))
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, records=2)
    got = sorted(warc.read_archives(spark, path).collect(), key=str)
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    assert kinds == collections.Counter([
        (1, "revisit", 9, 2000, sha(big)), (9, "response", None, 2000, sha(big)), (9, "revisit", 9, 2000, sha(big)),
        (None, "revisit", 9, 2000, sha(big)), (4, "response", None, 9, sha(html)), (5, "response", None, 9, sha(html)),
        (6, "response", None, 0, sha("")), (8, "response", None, 1000, sha("y" * 1000)), (7, "revisit", 8, 1000, sha("y" * 1000))])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_broken_archives():
    good = warc._gzip(warc.record(1, "u", b"abc", False, None))
    assert [warc.parse(m)["page"] for m in warc.inflate(memoryview(good + warc.EMPTY_MEMBER + good))] == ["<urn:page:1>"] * 2
    assert zlib.decompress(good, 31).startswith(b"WARC/1.1\r\n")
    with pytest.raises(warc.BrokenRecord):
        list(warc.inflate(memoryview(good[:-3])))
    with pytest.raises(warc.BrokenRecord):
        warc.parse(warc.record(1, "u", b"abc", False, None).replace(b"abc", b"abd"))
    with pytest.raises(warc.BrokenRecord):
        warc.parse(warc.record(1, "u", b"abc", False, None)[:-1])
