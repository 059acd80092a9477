import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinarium.functions import labels, text
from opinarium.operators import features

SAMPLES = [
    None, "", "   ", "Ótimo!!! <b>Produto</b> nota 10", "veja https://a.b/c?d=1 e www.x.com agora",
    "nbsp aqui ali\x1cfim", "café decomposto ã", "ẹ́ ž Å 가",
    "<nao fecha", "a < b > c", "!!!", "àü Lingüiça ÀÜ", "<br/>linha\nnova\ttab", "İstanbul ÇA", "emoji 😀 ok", "“aspas” – e…",
]


def spark_values(spark, expression, samples=SAMPLES):
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    return [r[1] for r in df.select("i", expression(F.col("t"))).orderBy("i").collect()]


def by_hand(value, light=False):
    if not isinstance(value, str) or not value.strip():
        return ""
    value = value if light else value.lower()
    for pattern in (r"<[^>]+>", r"https?://\S+|www\.\S+"):
        value = re.sub(pattern, " ", value)
    value = unicodedata.normalize("NFC", value)
    if not light:
        value = re.sub(rf"[^{text.NORMAL_LETTERS}0-9\s]", " ", value)
    return " ".join(value.split())


def test_normalisers_follow_the_rules_in_order(spark):
    assert spark_values(spark, text.normalize_text) == [by_hand(s) for s in SAMPLES]
    assert spark_values(spark, text.normalize_light) == [by_hand(s, True) for s in SAMPLES]


def test_quick_composition_check_covers_all_changing_characters():
    outside = re.compile("[^\u0000-˿‐-‧\U0001f300-\U0001faff]")
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        char = chr(cp)
        if not unicodedata.is_normalized("NFC", char) or unicodedata.combining(char):
            assert outside.match(char), hex(cp)


def test_report_words_vanish_whole(spark):
    got = spark_values(spark, text.report_words, ["àgua boa_vista café CAFÉ não ele xis a1b casa-grande", "café sol"])
    assert got == [["café", "café", "xis", "casa", "grande"], ["cafe", "sol"]]


def test_ngrams(spark):
    assert spark_values(spark, lambda c: text.ngrams(text.analyzer_tokens(c), 1, 2), ["Um dia a mais", "só", ""]) == [
        ["um", "dia", "mais", "um dia", "dia mais"], ["só"], []
    ]
    assert spark_values(spark, lambda c: text.ngrams(text.analyzer_tokens(c), 3, 3), ["um dois tres quatro"]) == [["um dois tres", "dois tres quatro"]]


def test_term_frequencies(spark):
    got = spark_values(spark, lambda c: text.term_frequencies(text.analyzer_tokens(c)), ["bb aa bb cc bb", ""])
    assert [[tuple(x) for x in row] for row in got] == [[("aa", 1), ("bb", 3), ("cc", 1)], []]


def test_tfidf_by_hand(spark):
    docs = ["aa aa bb", "aa cc", "bb cc cc dd"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, t string")
    terms = features.document_terms(df, "doc", "t", "unigrams")
    vocabulary = features.fit_vocabulary(terms)
    assert {r.term for r in vocabulary.collect()} == {"aa", "bb", "cc"}
    got = {(r.doc, r.term): r.weight for r in features.tfidf(terms, vocabulary, "doc").collect()}
    idf = math.log(4 / 3) + 1
    expected = {}
    for i, doc in enumerate(docs):
        raw = {t: (1 + math.log(n)) * idf for t, n in Counter(doc.split()).items() if t != "dd"}
        length = math.sqrt(sum(v * v for v in raw.values()))
        expected |= {(i, t): v / length for t, v in raw.items()}
    assert got == pytest.approx(expected)


def test_vocabulary_cap_breaks_ties_by_term(spark):
    df = spark.createDataFrame([(1, "bb aa cc"), (2, "cc bb aa")], "doc int, t string")
    kept = features.fit_vocabulary(features.document_terms(df, "doc", "t", "unigrams"), max_features=2)
    assert [r.term for r in features.index_vocabulary(kept).orderBy("term_id").collect()] == ["aa", "bb"]


def test_vocabulary_cap_at_every_size(spark):
    docs = ["aa aa aa bb bb cc dd", "aa bb bb cc dd ee", "dd cc ee ff", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, t string").repartition(3)
    terms = features.document_terms(df, "doc", "t", "unigrams")
    tf = Counter(" ".join(docs).split())
    df_of = Counter(t for d in docs for t in set(d.split()))
    ranked = sorted((t for t in tf if df_of[t] >= 2), key=lambda t: (-tf[t], t))
    for cap in (0, 1, 2, 3, 4, 5, 9, None):
        got = features.fit_vocabulary(terms, max_features=cap).collect()
        assert sorted(r.term for r in got) == sorted(ranked if cap is None else ranked[:cap])
        assert {(r.term, r.df, r.tf) for r in got} <= {(t, df_of[t], tf[t]) for t in tf}
        assert all(r.idf == pytest.approx(math.log(5 / (1 + r.df)) + 1) for r in got)
    assert features.fit_vocabulary(terms.filter("false")).count() == 0


def test_weights_in_the_row_equal_those_by_join(spark):
    docs = ["aa aa bb", "aa cc", None, "bb cc cc dd", "zz", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, t string")
    terms = features.document_terms(df, "doc", "t", "both")
    vocabulary = features.fit_vocabulary(terms)
    pairs = lambda out: {(r.doc, r.term): pytest.approx(r.weight) for r in out.collect()}
    assert pairs(features.tfidf(terms, vocabulary, "doc")) == pairs(features._tfidf_by_join(terms, vocabulary, "doc"))
    assert features.tfidf(terms, vocabulary.filter("false"), "doc").count() == 0


def test_lemmas_without_moving_tokens(spark):
    docs = spark.createDataFrame([(1, "Os carros são bons 2 carros"), (2, "os Os"), (3, None), (3, "bons"), (4, "x" * 50_000 + " bons" * 3)], "doc int, t string")
    table = spark.createDataFrame([("carros", "carro"), ("são", "Ser"), ("bons", "zz"), ("bons", "bom"), (None, "x")], "form string, lemma string")
    found = features.lemmatize(docs, "doc", "t", table, ["os", "ser"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc, r.lemmas) for r in found.collect())
    assert got == [(1, "carro bom carro"), (2, ""), (3, ""), (3, "bom"), (4, "x" * 50_000 + " bom" * 3)]
    one = docs.filter("doc <> 3")
    joined = features._lemmatize_by_join(one, "doc", "t", features.one_per_key(table, "form", "lemma", "lemmas"), ["os", "ser"])
    assert sorted(joined.collect()) == [r for r in got if r[0] != 3]
    assert features.lemmatize(docs, "doc", "t", table.filter("false"), []).count() == 5


def test_sparse_rows_keep_documents_without_terms(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb bb"), (3, "zz")], "doc int, t string")
    terms = features.document_terms(df, "doc", "t", "unigrams")
    vocabulary = features.index_vocabulary(features.fit_vocabulary(terms))
    got = {r.doc: r.features for r in features.sparse_rows(terms, vocabulary, "doc").collect()}
    assert got[3].indices == [] and got[3].size == 2
    assert got[1].indices == [0, 1] and got[1]["values"] == pytest.approx([math.sqrt(0.5)] * 2)


ODD_TEXTS = ["aa bb aa  bb-aa", "ab a abc ab_c ab abc", "Żółw Żółw 𝒜𝒷𝒸 ١٢٣ éa e\u0301a", "", None, "x", "zz " * 700 + "aa"]


@pytest.mark.parametrize("piece", [1 << 18, 3])
@pytest.mark.parametrize("mode", ["unigrams", "bigrams", "both"])
def test_terms_counted_in_batches_equal_the_expression(spark, monkeypatch, mode, piece):
    monkeypatch.setattr("opinarium.functions.dictionary.PIECE", piece)
    df = spark.createDataFrame([(i % 5 or None, t) for i, t in enumerate(ODD_TEXTS)], "doc int, t string")
    grams = text.ngrams(text.analyzer_tokens(F.coalesce("t", F.lit(""))), *text.NGRAM_MODES[mode])
    want = df.select("doc", text.term_frequencies(grams).alias("terms"))
    assert features.document_terms(df, "doc", "t", mode).collect() == want.collect()


def test_sparse_rows_without_moving_all_terms(spark, monkeypatch):
    """Rows of one key, null ones too, are one vector as in the join."""
    df = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(ODD_TEXTS * 2)], "doc int, t string").repartition(3)
    terms = features.document_terms(df, "doc", "t", "both")
    vocabulary = features.index_vocabulary(features.fit_vocabulary(terms, max_features=4))
    found = features.sparse_rows(terms, vocabulary, "doc")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(features, "load_if_small", lambda *_: None)
    rows = lambda out: {r.doc: (r.features.size, r.features.indices, [round(v, 12) for v in r.features["values"]]) for r in out.collect()}
    assert rows(found) == rows(features.sparse_rows(terms, vocabulary, "doc"))
    assert features.sparse_rows(terms, vocabulary, "doc").count() == found.count() == 3


def test_lemmas_keep_order_and_drop_stop_words(spark):
    docs = spark.createDataFrame([(1, "Os carros são bons 2 carros"), (2, "os Os"), (3, None)], "doc int, t string")
    table = spark.createDataFrame([("carros", "carro"), ("são", "Ser"), ("bons", "bom")], "form string, lemma string")
    got = {r.doc: r.lemmas for r in features.lemmatize(docs, "doc", "t", table, ["os", "ser"]).collect()}
    assert got == {1: "carro bom carro", 2: "", 3: ""}


def test_numbers_are_coerced(spark):
    df = spark.createDataFrame([(v,) for v in ("5", " 4.5 ", "abc", None, "1d", "nan", "1e2")], "v string")
    assert [r[0] for r in df.select(labels.number(df, "v")).collect()] == [5.0, 4.5, None, None, None, None, 100.0]


def test_answers(spark):
    raw = ['{"sentiment": "positive"}', '{"sentiment": "neutral"}', "{broken", None, '{"other": 1}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(labels.parse_answer(F.col("r"))).collect()]
    assert [(g.sentiment, g.polarity) for g in got] == [("positive", 1)] + [(None, None)] * 4
    assert got[0].error is None and got[1].error == "malformed_response: neutral" and got[2].error


def test_neutral_filter_keeps_missing_ratings(spark):
    df = spark.createDataFrame([(3,), (None,), (5,)], "r int")
    assert sorted(r[0] or 0 for r in df.filter(labels.not_neutral(F.col("r"))).collect()) == [0, 5]


def test_long_lists_are_looked_up_in_pieces():
    import pyarrow as pa

    from opinarium.functions.dictionary import pieces

    lists = [["a"] * n for n in (3, 0, 9, 2, 2, 0, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], ["key", "words"])
    cut = list(pieces(batch, 4))
    assert [part.column(0).to_pylist() for part in cut] == [[0, 1], [2], [3, 4, 5], [6, 7]]
    assert pa.Table.from_batches(cut).column(1).to_pylist() == lists
    assert list(pieces(batch.slice(0, 0))) == []
