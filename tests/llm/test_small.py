"""The corpus operators on hand-made rows against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinarium.llm import bpe, decontamination, jaccard, language, licenses, linerules, quality, secrets, sharding, suffixes
from opinarium.llm.columns import held_out
from opinarium.llm.tables import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, row long, n long, key string"


def frame(spark, texts, langs=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), 7, 8, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words, vocabulary=4000):
    pick = random.Random(seed)
    return [f"w{pick.randrange(vocabulary)}" for _ in range(words)]


EDGE = [(901, None), (902, ""), (903, "   \n "), (904, "one"), (905, "One"), (906, "é ñ"), (907, "long " * 30000), (None, "no id at all here"), (None, None)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 9), (20, 21), (21, 22), (22, 20)], "a long, b long")
    assert {tuple(r) for r in components(edges, "c").collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (20, 20), (21, 20), (22, 20)}
    assert components(edges.limit(0), "c").count() == 0


def test_input_columns_of_any_name(spark):
    """Columns named like those that operators once used inside are kept."""
    rows = spark.createDataFrame([(1, "a text of some words", "kept", 5, "six", 7)], "doc_id long, text string, _text string, _id long, _clean string, texts long")
    model = language.fit(spark.createDataFrame([(i, "a b c", "en") for i in range(9)], "doc_id long, text string, lang string"))
    outs = [language.identify(rows, model), secrets.find_secrets(rows, redact="clean"), linerules.apply_rules(rows), bpe.encode_documents(rows, PATH), quality.score(rows, None)]
    for out in outs:
        row = out.collect()[0]
        assert (row["_text"], row["_id"], row["_clean"], row["texts"]) == ("kept", 5, "six", 7)


def test_secret_scan_survives_hostile_texts(spark):
    import base64
    import time

    nested = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    head = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    body = "A" * 30
    npm = f"npm_{body}{secrets.base62_crc(body.encode()).decode()}"
    texts = [f"eyJ{nested} {nested}.x.y", f"ü {head}.abc.def", f"é {npm} npm_{'B' * 36}", "ß token=12345678 " * 16_000]
    begun = time.time()
    out = [r.spans for r in secrets.find_secrets(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert time.time() - begun < 20
    assert out[0] == "" and out[1] == f"jwt:2:{2 + len(head) + 8}" and out[2] == f"npm:2:{2 + len(npm)}"
    assert out[3].split(",")[15_999] == f"assign:{17 * 15_999 + 2}:{17 * 15_999 + 16}"


# --- decontamination ---------------------------------------------------------------


def brute_hits(text, items, length=10):
    words = ITEM_WORDS.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for item, body in items:
        own = ITEM_WORDS.findall((body or "").translate(FOLD))
        size = min(length, len(own))
        for at in range(len(own) - size + 1) if own else ():
            window = own[at : at + size]
            for start in range(len(words) - size + 1):
                if words[start : start + size] == window:
                    hit.update(range(start, start + size))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    base = prose(1, 40, 200)
    items = [(1, " ".join(base)), (2, "Two words"), (3, "solo"), (4, None), (5, ""), (6, " ".join(["the"] * 14)), (10, " ".join(base[5:25]))]
    texts = [(i, " ".join(prose(100 + i, 60, 200))) for i in range(12)]
    texts += [(20, "x " + " ".join(base[3:15]).upper() + " y"), (21, " ".join(base[:9])), (22, "the " * 11), (23, "a two-words b SOLO solo"), (24, " ".join(base[:30]) + " Ñ " + " ".join(base[20:]))]
    texts += [*EDGE, (20, "x " + " ".join(base[3:15]).upper() + " y")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, size int")
    got = decontamination.report(frame(spark, texts), bench).drop("items").collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *brute_hits(t, items)) for i, t in texts], key=key)
    assert decontamination.report(frame(spark, texts), bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.report(frame(spark, []), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = frame(spark, [(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma beta alpha z z z z"), (4, "alpha z z z z beta z z gamma")])
    terms = decontamination.test_terms(bench)
    index = decontamination.build_index(docs, terms)
    ids = decontamination.documents(index).select("row", "doc_id")
    near = lambda slop: {r.doc_id for r in decontamination.proximity_hits(index, terms, slop).join(ids, "row").collect()}
    assert near(1) == {1, 2} and near(4) == {1, 2, 3}


def test_report_lists_near_items(spark):
    passage = prose(1, 12)
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, "Two words"), (3, "solo")], "item_id long, text string")
    inserted, far = [*passage[:6], "x", *passage[6:]], [*passage[:6], *"xxxxx", *passage[6:]]
    texts = [(1, " ".join(passage)), (2, " ".join(inserted)), (3, " ".join(far)), (4, "two x words"), (5, "a solo"), (6, None), (None, " ".join(inserted))]
    got = {r.doc_id: (r.contaminated, r.n_near_items, r.near_items) for r in decontamination.report(frame(spark, texts), bench, slop=decontamination.SLOP).collect()}
    one = (False, 1, ["1"])
    assert got == {1: (True, 1, ["1"]), 2: one, 3: (False, 0, []), 4: (False, 1, ["2"]), 5: (True, 1, ["3"]), 6: (False, 0, []), None: one}


# --- similarity join ---------------------------------------------------------------


def brute_components(texts, rule):
    sets = {}
    for i, t in texts:
        words = BLANK_WORDS.findall((t or "").translate(FOLD))
        k = rule.shingle
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= rule.percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(2, 80), jaccard.Rule(5, 80)])
def test_jaccard_join(spark, rule):
    texts, pick = [(900 + i, t) for i, (_, t) in enumerate(EDGE)], random.Random(4)
    for family in range(6):
        words = prose(family, 30 + 40 * family)
        for copy in range(14):
            edited = list(words)
            for _ in range(pick.randrange(0, 5)):
                edited[pick.randrange(len(edited))] = f"e{pick.randrange(10**6)}"
            texts.append((family * 100 + copy, " ".join(edited)))
    got = {tuple(r) for r in jaccard.linked_components(frame(spark, texts), rule).collect()}
    assert got == brute_components(texts, rule)


def test_jaccard_repeated_rows(spark):
    text = " ".join(prose(3, 50))
    docs = frame(spark, [(5, text), (5, text), (2, text.upper()), (None, text), (7, None), (8, "")])
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.linked_components(docs).collect())
    assert got == [("2", 2), ("5", 2), ("5", 2), ("7", 7), ("8", 8), ("None", 2)]
    kept = sorted(str(r.doc_id) for r in jaccard.keep_representatives(docs).collect())
    assert kept == ["2", "7", "8"]
    assert jaccard.linked_components(docs.limit(0)).count() == 0


def test_representatives_by_row(spark):
    """Null ids come last, one id can have several texts, and repeated rows count once."""
    words = prose(8, 60)
    near = " ".join(words + ["more"])
    other = " ".join(prose(9, 60))
    rows = [(None, " ".join(words)), (None, near), (4, near), (4, " ".join(words)), (4, near), (None, other), (None, other + " "), (None, None), (None, None), (5, ""), (5, "\t")]
    docs = spark.createDataFrame([(*row, 1, 2, "x", 3) for row in rows], "doc_id long, text string, _id long, kept_id long, _text string, n long")
    out = jaccard.keep_representatives(docs)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert [t for i, t in left if i == 4 and t] in ([near], [" ".join(words)])
    assert [t.strip() for i, t in left if i is None and t] == [other]
    assert len(left) == 6


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80)])
def test_sketch_bounds_difference(rule):
    pick = np.random.default_rng(1)
    lows, errors, _, spare = bands = rule.bands(2000)
    for size in (2, 7, 40, 300, 1500):
        band = int(np.searchsorted(lows, size, side="right")) - 1
        for _ in range(50):
            one = np.unique(pick.integers(0, 2**63, size, dtype=np.uint64))
            gone = min(errors[band] // 2, size - 1)
            two = np.unique(np.concatenate((one[gone:], pick.integers(0, 2**63, errors[band] - gone, dtype=np.uint64))))
            for c in (spare[band], 0):
                (ones, need), (twos, other) = [jaccard.block_codes(x, band, errors[band], c) for x in (one, two)]
                assert len(set(ones) & set(twos)) >= max(need, other) >= 1
            if len(two) < rule.largest_partner(size) and errors[band]:
                assert set(jaccard.sketch_keys(one, rule, bands)[0]) & set(jaccard.sketch_keys(two, rule, bands)[0])


def test_bare_blocks_are_left_out_only_within_the_spare():
    shingles = np.array([1, 2], dtype=np.uint64)  # both in the first block
    assert len(jaccard.block_codes(shingles, 3, 3, 2)[0]) == 6
    assert len(jaccard.block_codes(shingles, 3, 3, 5)[0]) == 9
    codes, need = jaccard.block_codes(shingles, 3, 0, 4)
    assert len(codes) == need == 1
    spread = np.arange(1, 64, dtype=np.uint64) << np.uint64(58)
    codes, need = jaccard.block_codes(spread, 3, 4, 2)
    assert len(codes) == 7 and need == 3


# --- classifiers -------------------------------------------------------------------


def test_language(spark):
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "éèêñü"}
    texts, langs = [], {}
    for i in range(90):
        name = sorted(alphabets)[i % 3]
        pick = random.Random(i)
        texts.append((i, " ".join("".join(pick.choice(alphabets[name]) for _ in range(5)) for _ in range(20))))
        langs[i] = name
    texts += [(200, None), (201, ""), (202, "12 34 !?"), (203, "éèê")]
    langs |= {200: "aa", 202: None, 203: None}
    docs = frame(spark, texts, langs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()}
    assert all(got[i][0] == langs[i] and 0.9 < got[i][1] <= 1 for i in range(90))
    assert [got[i] for i in (200, 201, 202)] == [("und", 0.0)] * 3 and got[203][0] == "cc"
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert {r.doc_id for r in docs.filter(held_out(F.col("doc_id"))).collect()} == {i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0}


def test_quality(spark):
    good = [(i, " ".join(prose(i, 60)).capitalize() + ".") for i in range(60)]
    bad = [(100 + i, "### ".join(prose(i, 60)) + "$$$") for i in range(30)]
    docs = frame(spark, [*good, *bad, *EDGE])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5000, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect() if r.doc_id is not None}
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p in got.values())
    assert all(got[i][1] == 1 for i, _ in good) and all(got[i][1] == 0 for i, _ in bad)
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert {(r.score, r.predicted) for r in quality.score(docs, None).collect()} == {(0.5, 1)}


def test_quality_learns_from_every_label(spark):
    """Weights of all pairs and the cut of all scores, not those of drawn ones."""
    pick = np.random.default_rng(5)
    texts = [(i, "".join(pick.choice(list("ab. #"), 12))) for i in range(700)]
    labelled = [(i, int(i % 5 > 0)) for i, _ in texts if zlib.crc32(str(i).encode()) % 5]
    docs, labels = frame(spark, texts), spark.createDataFrame(labelled, "doc_id long, quality int")
    model = quality.fit(docs, labels, group=10_000)
    rows = quality.features(pa.array([dict(texts)[i] for i, _ in labelled]))
    good = np.array([q for _, q in labelled]) == 1
    assert model.center == pytest.approx(rows.mean(axis=0))
    scaled = (rows - model.center) / model.spread
    rare, other = scaled[~good], scaled[good]
    # Of one group per part: each of the rarer class meets every other document once.
    pairs = [(i, j) for i in range(len(other)) for j in range(len(rare))]
    want = quality.ranking_weights(other[[i for i, _ in pairs]], rare[[j for _, j in pairs]])
    assert model.weights == pytest.approx(want, abs=1e-6)
    scores = scaled @ model.weights
    assert model.cut == pytest.approx(quality.quantile_cut(scores, np.ones(len(scores)), (~good).mean()), abs=1e-9)
    assert quality.fit(docs, labels, group=8).weights == pytest.approx(want, abs=0.3)


def test_cut_of_a_table(spark):
    values = np.concatenate((np.random.default_rng(2).normal(size=400), np.full(50, 0.25), [1e9]))
    table = spark.createDataFrame([(float(v),) for v in values], "score double")
    for below in (1, 5, 200, 260, 449, 450):
        assert quality.cut_at(table, below) == pytest.approx(np.sort(values)[below - 1 : below + 1].mean(), rel=1e-12)


def test_ranking_weights_gradient():
    pick = np.random.default_rng(0)
    better, worse = pick.normal(size=(500, 4)) + 0.3, pick.normal(size=(500, 4))
    weights = quality.ranking_weights(better, worse)
    apart = better - worse
    slope = quality.RIDGE * weights - (apart / (1 + np.exp(apart @ weights))[:, None]).mean(axis=0)
    assert np.abs(slope).max() < 1e-8
    assert quality.quantile_cut(np.array([1.0, 2.0, 3.0, 4.0]), np.ones(4), 0.25) == 1.5


# --- secrets -----------------------------------------------------------------------


def brute_secrets(text):
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]")
    assign = re.compile(rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_spans():
    pieces = ["token", "TOKEN = ", "api_key:", "apikey=", "password", "passwd", '"', "'", " ", ":", "=", "abcdef0123", "é", "AKIA", "ABCD1234", "0a1b2c3d4e5f", "\n", "secret", "ſecret=", "K", "x"]
    pick, keywords = random.Random(3), secrets.automaton()
    for _ in range(4000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randrange(25)))
        assert [s for s in secrets.scan(text, keywords) if s[0] in secrets.BASE_KINDS] == brute_secrets(text)


def test_checksums_and_redaction(spark):
    body = "a1B2" * 7 + "zz"
    token = "ghp_" + body + secrets.base62_crc(body.encode()).decode()
    wrong = token[:-1] + ("a" if token[-1] != "a" else "b")
    text = f"é {token} and {wrong} token={'f' * 40}"
    docs = frame(spark, [(1, text), (2, None), (3, "clean"), (3, "clean")])
    got = {r.doc_id: r for r in secrets.find_secrets(docs, redact="clean").collect()}
    assert got[1].spans.split(",")[0] == f"github:2:{2 + len(token)}" and got[1].clean == f"é [SECRET] and {wrong} [SECRET]"
    assert (got[1].n_assign, got[1].n_hex, got[1].spans.count("github")) == (1, 1, 1)
    assert got[2].spans == "" and got[2].clean is None and got[3].clean == "clean"
    assert secrets.find_secrets(docs.limit(0)).count() == 0


# --- sharding ----------------------------------------------------------------------


def test_sharding(spark):
    texts = [(i, f"text {i % 7}") for i in range(400)] + [(5, "again")] * 300 + EDGE
    got = sharding.assign(frame(spark, texts).repartition(5), [1.0] * 6, [1.0] * 7).collect()
    assert len(got) == len(texts)
    assert all(r.grown_shard in (r.shard, 6) for r in got) and any(r.grown_shard == 6 for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    for shard in range(6):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    by_id = dict(texts[:400])
    assert all(r.size == len(by_id[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(by_id[r.doc_id].encode()) for r in got if r.doc_id in by_id and r.doc_id != 5)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (901, 902)} == {(8, 0)}


def test_weighted_shards(spark):
    ids = spark.range(6000)
    share = {r.s: r.n for r in ids.groupBy(sharding.shard_of(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert set(share) == {0, 1} and 2.6 < share[1] / share[0] < 3.4


# --- line rules --------------------------------------------------------------------


def brute_counts(text):
    words = BLANK_WORDS.findall(text)
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if BLANK_WORDS.search(line):
            doubles += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), doubles, len(inside), failed


def test_line_rules(spark):
    texts = [(i, "\n".join(" ".join(prose(i + j % 3, 12, 30)) + "." for j in range(i % 6))) for i in range(20)]
    texts += [(50, " ".join(prose(9, 80)) + "."), (51, "a b c d e " * 8), (52, "Home | About | Contact | Help\n" * 9 + "one two three four five six seven eight nine ten."), (53, "é# ñ* $x " * 4)]
    texts += [e for e in EDGE if e[0] != 907]
    got = {r.doc_id: r for r in linerules.apply_rules(frame(spark, texts), clean="left").collect() if r.doc_id is not None}
    for i, text in texts:
        if i is not None:
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(text or "")
    assert got[50].kept and not got[51].kept and not got[52].kept and got[901].left is None
    assert got[52].left.strip() == "one two three four five six seven eight nine ten."


# --- byte pairs --------------------------------------------------------------------


def test_byte_pairs_equal_the_library(spark):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    pick = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x2028, 0x3000, 0x85, 0xA0, 0x1C, 0x200B, 0x4E2D, 0x1F600, 0x301, 0x661, 0xBD]] + ["the", " the", "'re", "<|endoftext|>", "  ", "\n\n", "aaaa"]
    texts = ["".join(pick.choice(pool) for _ in range(pick.randrange(40))) for _ in range(1500)] + ["a" * 3001, "ab" * 900, " " * 50 + "x", "", "<|endoftext|>"]
    coded = encoder.encode(texts)
    for text, ids, expected in zip(texts, coded, library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == expected.ids
        assert encoder.vocabulary.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)
    docs = frame(spark, [(1, "hello world"), (2, None), (3, ""), (3, "")])
    out = bpe.encode_documents(docs, PATH, ids="ids")
    rows = {r.doc_id: r for r in bpe.decode_documents(out, PATH, "ids").collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows[1].ids == library.encode("hello world").ids and rows[1].decoded == "hello world"
    assert (rows[2].n_tokens, rows[2].ids_sha256, rows[2].decoded_sha256) == (0, nothing, nothing)


# --- licenses, repeated passages ---------------------------------------------------


def test_licenses(spark):
    filler = " ".join(prose(2, 90))
    texts = [(1, f"{filler}\nReleased under the MIT License. {filler}"), (2, f"{filler} licensed under the {filler}"), (3, licenses.TEMPLATES["bsd-3-clause"].upper())]
    texts += [(4, f"{filler} " + licenses.TEMPLATES["gpl-notice"].replace("redistribute", "x")), *EDGE]
    known = licenses.templates(spark)
    got = {(r.doc_id, r.license, r.found == r.shingles) for r in licenses.report(frame(spark, texts), known).collect()}
    assert got == {(1, "mit", True), (3, "bsd-3-clause", True), (4, "gpl-notice", False)}
    assert licenses.report(frame(spark, []), known).count() == 0


def test_license_variants(spark):
    filler = " ".join(prose(2, 60))
    gpl = licenses.TEMPLATES["gpl-3.0"]
    whole = {name: text for name, text, _ in licenses.license_texts.entries() if len(text) > 600}
    cases = [
        ("Licensed under the MIT License", {"mit"}),
        ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
        ("Licensed under CC BY-NC 4.0", {"cc-by-nc-4.0"}),
        (gpl, {"gpl-3.0"}),
        (gpl.replace("version 3", "version 2"), {"gpl-2.0"}),
        (gpl.replace("General", "Lesser General"), {"lgpl-3.0"}),
        (gpl.replace("General", "Affero General"), {"agpl-3.0"}),
        ("Licensed under the Apache License, Version 1.1", set()),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", {"cc-by-nd-4.0"}),
        (licenses.license_texts._MIT + f" {filler} Released under the Apache License, Version 2.0.", {"mit", "apache-2.0"}),
    ]
    cases += [(text, {name}) for name, text in whole.items()]
    got = {}
    for r in licenses.report(frame(spark, [(i, f"{filler} {t} {filler}") for i, (t, _) in enumerate(cases)]), licenses.templates(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert [(t[:60], got.get(i, set())) for i, (t, _) in enumerate(cases)] == [(t[:60], e) for t, e in cases]
    assert len(whole) >= 11


def test_repeated_passages(spark):
    common, other = prose(1, 70), prose(2, 55)
    texts = [(i, " ".join(prose(10 + i, 30 + 5 * i) + common + prose(40 + i, 40))) for i in range(6)]
    texts += [(20, " ".join(prose(60, 100))), (21, " ".join(other + prose(61, 40) + other)), (22, " ".join(prose(62, 9) + common[:49])), *EDGE[:7]]
    words = {i: BLANK_WORDS.findall(t or "") for i, t in texts}
    seen: dict = {}
    for i, own in words.items():
        for at in range(len(own) - 49):
            seen.setdefault(tuple(own[at : at + 50]), []).append((i, at))
    expected: dict = {}
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                expected.setdefault(i, set()).update(range(at, at + 50))
    got: dict = {}
    for r in suffixes.repeated_passages(frame(spark, texts)).collect():
        got.setdefault(r.id, set()).update(range(r.start, r.stop))
    assert got == expected
    assert suffixes.report(frame(spark, [])).count() == 0


def brute_repeats(texts, least=50):
    words = {i: BLANK_WORDS.findall(t or "") for i, t in texts}
    seen: dict = {}
    for i, own in words.items():
        for at in range(len(own) - least + 1):
            seen.setdefault(tuple(own[at : at + least]), []).append((i, at))
    out: dict = {}
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                out.setdefault(i, set()).update(range(at, at + least))
    return out


def test_repeated_passages_of_recombined_blocks(spark):
    """Frequent blocks in many combinations: better neighbours to one side hide the partners."""
    pick, blocks = random.Random(8), [prose(700 + b, 9) for b in range(6)]
    texts = [(i, " ".join(w for _ in range(24) for w in blocks[pick.randrange(6)])) for i in range(150)]
    got: dict = {}
    for r in suffixes.repeated_passages(frame(spark, texts)).collect():
        got.setdefault(r.id, set()).update(range(r.start, r.stop))
    assert got == brute_repeats(texts)
