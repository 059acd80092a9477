"""Fingerprints, token alignment and spelling variants against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from opinarium.llm import alignment, bpe, simhash, spelling
from tests.llm.test_small import BLANK_WORDS, EDGE, FOLD, SCHEMA, frame, prose

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- fingerprints ----------------------------------------------------------------


def brute_fingerprint(text):
    words = BLANK_WORDS.findall((text or "").translate(FOLD))
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Component numbers of distinct values linked at four or fewer differing bits."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def check_simhash(spark, rows):
    found = simhash.linked_components(frame(spark, rows)).collect()
    prints = [brute_fingerprint(text) for _, text in rows]
    roots = brute_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = collections.Counter((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints))
    assert collections.Counter(map(tuple, found)) == want


def test_simhash(spark):
    rows = list(EDGE) + EDGE[:3]
    for i in range(40):
        base = prose(i, 300 + 7 * i)
        rows.append((i, " ".join(base)))
        for copy in range(3):
            base = base[:]
            base[random.Random(copy).randrange(len(base))] = "Changed"
            rows.append((1000 + 10 * i + copy, "  ".join(base).upper() if copy else " ".join(base)))
    check_simhash(spark, rows)


def test_simhash_empty(spark):
    assert simhash.linked_components(frame(spark, [])).columns == ["doc_id", "fingerprint", "component_id"]
    check_simhash(spark, [])


def test_linked_words_share_a_key():
    """Every pattern of at most four errors, on random words."""
    golay, pick = simhash.Golay(), np.random.default_rng(5)
    one = pick.integers(0, 1 << 63, 30000, dtype=np.uint64) << np.uint64(1)
    other = one.copy()
    for errors in range(4):
        other[errors * 7000 :] ^= np.uint64(1) << pick.integers(0, 64, len(one) - errors * 7000).astype(np.uint64)
    first, second = ({(r, k) for r, k in zip(*map(np.ndarray.tolist, simhash.keys(words, golay)))} for words in (one, other))
    assert {r for r, _ in first & second} == set(range(len(one)))
    words = pick.integers(0, 1 << 23, 5000)
    nearest = golay.index(words)
    assert len(np.unique(golay.index(np.arange(1 << 23)), return_counts=True)[1]) == 1 << 12
    assert all((golay.index(words ^ (1 << b)) == nearest).mean() > 0.1 for b in range(23))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_crowded_fingerprints(spark, monkeypatch, crowd):
    """Clouds of fingerprints larger than what is compared in pairs; links are exact either way."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    pick = random.Random(9)
    values = set()
    for _ in range(3):
        center = pick.getrandbits(64)
        for _ in range(120):
            value = center
            for _ in range(pick.randrange(6)):
                value ^= 1 << pick.randrange(64)
            values.add(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    low = (1 << 64) - 1
    assert all(((a & low) ^ (b & low)).bit_count() <= 4 for a, b in edges)
    groups = {v: v for v in values}

    def find(v):
        while groups[v] != v:
            v = groups[v]
        return v

    for a, b in edges:
        a, b = find(a & low), find(b & low)
        groups[max(a, b)] = min(a, b)
    want = brute_components(values)
    assert {v: find(v) for v in values} == want


def test_keys_and_points_are_not_broadcast(spark, monkeypatch):
    """What Python makes of few fingerprints is far larger than Spark takes it to be."""
    kept, plans = simhash.materialize, []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return df

    monkeypatch.setattr(simhash, "materialize", lambda df, name: kept(planned(df), name))
    found = kept(spark.createDataFrame([(1 << a | 1 << b,) for a in range(20) for b in range(a)], "fp long"), "clouds")
    planned(simhash.links(found))
    assert len(plans) == 4 and any("MapInArrow" in line for line in plans[-1])
    for lines in plans:
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                inside = itertools.takewhile(lambda below: below.find("- ") > line.find("- "), lines[at + 1 :])
                assert not any("MapInArrow" in below for below in inside)


def test_fingerprints_keep_columns(spark):
    rows = spark.createDataFrame([("x", 1, "y")], "fingerprint string, texts int, text string")
    out = simhash.fingerprints(rows).collect()[0].asDict()
    assert out["texts"] == 1 and out["fingerprint"] == np.uint64(brute_fingerprint("y")).astype(np.int64)
    copied = simhash.fingerprints(rows, text="fingerprint").collect()[0].asDict()
    assert copied["texts"] == 1 and copied["fingerprint"] == np.uint64(brute_fingerprint("x")).astype(np.int64)


# --- token alignment -----------------------------------------------------------------


def brute_alignment(rows):
    first, second = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    first.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    texts, counts = [], collections.Counter()
    for i, text in rows:
        found = None
        if text:
            raw = f" {text}".encode()
            a = first.encode(f" {text}", add_special_tokens=False)
            b = second.encode(text)
            pieces = [bytes(letters[c] for c in t) for t in a.tokens], [
                bytes([int(p[3:5], 16)]) if second.is_byte(n) else p.replace("▁", " ").encode() for n, p in zip(b, map(second.id_to_piece, b))
            ]
            if all(b"".join(p) == raw for p in pieces):
                spans = [list(zip([0, *itertools.accumulate(map(len, p))], itertools.accumulate(map(len, p)))) for p in pieces]
                cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                groups, start = [], 0
                for cut in cuts:
                    own = [[n for n, (s, _) in zip(ids, span) if start <= s < cut] for ids, span in zip((a.ids, b), spans)]
                    groups.append("|".join(",".join(map(str, ids)) for ids in own))
                    start = cut
                links = [(x, y) for x, (s, e) in zip(a.ids, spans[0]) for y, (t, u) in zip(b, spans[1]) if max(s, t) < min(e, u)]
                found = (len(a.ids), len(b), groups, links)
                counts.update(set(links))
        texts.append((i, found))
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for i, found in texts:
        if found is None:
            yield (i, 0, 0, 0, 0, 0, 0, "", "")
        else:
            n_a, n_b, groups, links = found
            best = sum(counts[pair] == most[pair[0]] for pair in links)
            written = ";".join(groups)
            yield (i, n_a, n_b, len(groups), len(links), best, sum(counts[pair] for pair in links), hashlib.sha256(written.encode()).hexdigest(), written)


ALIGNED = [
    (1, "Hello world, naïve café ünïcödé"),
    (2, "  two  spaces\n\nand\ttabs "),
    (3, "日本語 text and 😀 emoji"),
    (4, "<|endoftext|> </s> <0x41> ▁ is not a space"),
    (5, "Hello world, naïve café ünïcödé"),
    (6, "x" * 700 + " " + "1234567890" * 30),
    (7, " "),
    (8, "\u0000 control \u007f"),
    (None, "a null id"),
]


def test_alignment(spark):
    rows = ALIGNED + [e for e in EDGE if e[0] != 907] + [(30 + i, " ".join(prose(i, 60))) for i in range(20)]
    rows.append((907, "long wörds " * 4000))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    out = alignment.align(frame(spark, rows), PATH_A, PATH_B, groups="groups").select(names).collect()
    short = [row for row in rows if row[0] != 907]
    assert len(out) == len(rows)
    long = [row for row in out if row["doc_id"] == 907]
    assert long[0]["n_a"] == len(Tokenizer.from_file(PATH_A).encode(" " + rows[-1][1]).ids) and long[0]["n_groups"] > 8000
    again = alignment.align(frame(spark, short), PATH_A, PATH_B, groups="groups").select(names).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(brute_alignment(short))


def test_alignment_over_chunks(spark, monkeypatch):
    """Counts are of the corpus whatever the chunks are."""
    whole = alignment.align(frame(spark, ALIGNED), PATH_A, PATH_B).collect()
    one = alignment.align(frame(spark, ALIGNED).repartition(5), PATH_A, PATH_B).collect()
    assert collections.Counter(whole) == collections.Counter(one)
    assert alignment.align(frame(spark, []), PATH_A, PATH_B).count() == 0
    assert alignment.align(frame(spark, [(1, None), (2, "")]), PATH_A, PATH_B).collect()[0]["groups_sha256"] == ""


def test_coalesce():
    found = alignment.coalesce(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert found.order.tolist() == [0, 3, 4, 1, 2, 5] and found.opens.tolist() == [True, False, False, True, False, False]
    assert list(zip(found.link_a.tolist(), found.link_b.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    empty = alignment.coalesce(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not len(empty.order) and not len(empty.link_a)


# --- spelling variants ----------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, noise=True):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(FOLD)
            drawn = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and drawn % 31 == 0:
                run = run[: drawn % len(run)] + run[drawn % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    nears = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in nears.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        yield (w, form.get(w), root, words[w], len(nears[w]), words[form[w]] if w in form else None)


def variant_rows():
    pick, rows = random.Random(3), list(EDGE)
    letters = "abcdeéñ"
    stems = ["".join(pick.choice(letters) for _ in range(pick.randrange(7, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "Été" * 3, "÷×÷×÷×÷×"]
    for i in range(600):
        stem = stems[min(int(pick.expovariate(0.2)), len(stems) - 1)]
        at = pick.randrange(len(stem))
        kind = pick.randrange(12)
        word = {0: stem[:at] + stem[at + 1 :], 1: stem[:at] + pick.choice(letters) + stem[at:], 2: stem[:at] + pick.choice(letters) + stem[at + 1 :]}.get(kind, stem)
        rows.append((i % 300, f"{word} {stem.upper()}-{word}2{stem}"))
    return rows


def test_variants(spark):
    rows = variant_rows()
    for noise in (True, False):
        out = spelling.variants(frame(spark, rows), noise=noise).collect()
        want = collections.Counter(brute_variants(rows, noise))
        assert len(want) > 20 and any(form for _, form, *_ in want)
        assert collections.Counter(map(tuple, out)) == want


def test_variant_ties_chains_and_long_words(spark):
    rows = [(1, " ".join(["abcdefg"] * 2 + ["abcdefh"] * 20 + ["abcdefi"] * 20 + ["abcdeehi"] * 3))]
    rows += [(2, " ".join(["chainaaa"] * 2 + ["chainaab"] * 20 + ["chainabb"] * 200 + ["chainbbb"] * 2000))]
    rows += [(3, " ".join(["z" * 30000] * 2 + ["z" * 15000 + "y" + "z" * 15000] * 25))]
    found = {r["word"]: r for r in spelling.variants(frame(spark, rows)).collect()}
    assert found["abcdefg"]["form"] == "abcdefh" and found["abcdefh"]["form"] is None
    assert found["chainaaa"]["form"] == "chainaab" and found["chainaaa"]["root"] == "chainbbb"
    assert found["z" * 30000]["form_n"] == 25
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
