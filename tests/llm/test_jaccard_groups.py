"""Block groups of the similarity join on texts that share passages."""

import random

from opinarium.llm import jaccard
from tests.llm.test_small import brute_components, prose


def crowded_texts():
    """Near copies among unlinked texts that all quote some of the same passages."""
    pick, rows = random.Random(11), []
    passages = [" ".join(prose(7000 + i, 25)) for i in range(6)]
    for i in range(60):
        parts = [*pick.sample(passages, 3), " ".join(prose(8000 + i, 110))]
        pick.shuffle(parts)
        words = " ".join(parts).split()
        rows.append((i, " ".join(words)))
        if i % 6 == 0:
            for at in pick.sample(range(len(words)), 2):
                words[at] = f"changed{i}"
            rows.append((100 + i, " ".join(words)))
    return rows


def test_texts_that_share_passages_alone_leave_the_similarity_join(spark, tmp_path):
    rule, rows = jaccard.Rule(5, 80), crowded_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, classes, edges = jaccard.links(docs, rule, "doc_id", "text")
    linked = {i for i, _, root in brute_components(rows, rule) if i != root}
    assert linked == {100 + i for i in range(0, 60, 6)}
    assert {r.doc_id for r in jaccard.keep_representatives(docs, rule).collect()} == {i for i, _ in rows} - linked
    nonempty = found.filter("n > 0")
    nodes = jaccard._block_groups(docs, rule, "text", nonempty, classes).select("node").distinct().count()
    assert nodes <= 3 * len(linked)


def test_linked_classes_keep_enough_keys_without_their_crowded_ones(spark):
    pick, rows, needs = random.Random(5), [], {}
    crowd = {key: pick.randrange(2, 6) for key in range(60)}
    for pair in range(40):
        common = pick.sample(range(60), pick.randrange(4, 20))
        for side in (0, 1):
            need = pick.randrange(1, len(common) + 1)
            needs[2 * pair + side] = need
            others = pick.sample([k for k in range(60) if k not in common], pick.randrange(0, 20))
            rows += [(key, 2 * pair + side, crowd[key], 0, need) for key in [*common, *others]]
    entries = spark.createDataFrame(rows, "key long, node long, crowd int, band long, need int")
    left, least = {}, {}
    for r in jaccard._without_crowded(entries).collect():
        left.setdefault(r.node, set()).add(r.key)
        least[r.node] = r.need
    assert all(least[node] == need - need // 2 for node, need in needs.items())
    assert all(len(left[2 * p] & left[2 * p + 1]) >= max(least[2 * p], least[2 * p + 1]) for p in range(40))


def test_representatives_exchange_no_texts_of_single_rows(spark):
    rows = crowded_texts() + [(3, "one more text under id three"), (None, "a text without an id"), (None, "a text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.keep_representatives(docs, jaccard.Rule(5, 80))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def near_copies(seed, number=120):
    """One template, and pairs of texts that share up to five changes to it and no others."""
    pick, base = random.Random(seed), prose(500 + seed, 150)
    rows = [(0, " ".join(base))]
    for i in range(number):
        words, places = list(base), pick.sample(range(150), pick.randint(4, 7))
        for at in places[2:]:
            words[at] = f"new{i}at{at}"
        # Shorter than the template, which therefore leads.
        words[places[0]] = ""
        rows.append((2 * i + 1, " ".join(words)))
        words[places[1]] = f"own{i}"
        rows.append((2 * i + 2, " ".join(words)))
    return rows


def test_near_copies_of_one_text_are_not_compared_pair_by_pair(spark, monkeypatch):
    rule, seen, distance = jaccard.Rule(5, 80), [], jaccard._distance

    def counted(pairs, sets):
        seen.append(pairs.count())
        return distance(pairs, sets)

    monkeypatch.setattr(jaccard, "_distance", counted)
    rows = near_copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in jaccard.linked_components(docs, rule).collect()}
    assert got == brute_components(rows, rule)
    assert len({root for _, _, root in got}) > 10
    assert sum(seen) <= 10 * len(rows), seen


def test_classes_of_one_pivot_meet_in_what_they_share_beside_it(spark):
    rule, pick = jaccard.Rule(5, 80), random.Random(3)
    pivot = set(range(90))
    sets = {0: pivot}
    for i in range(1, 120):
        gone = set(pick.sample(range(40), pick.randint(1, 14)))
        sets[i] = pivot - gone | {100 + x for x in pick.sample(range(40), pick.randint(0, 14))}
    apart = lambda x, y: len(sets[x] ^ sets[y])
    linked = lambda x, y: 180 * apart(x, y) <= 20 * (len(sets[x]) + len(sets[y]))
    rows = [(0, i, len(s), apart(0, i), i, sorted(s ^ pivot), linked(0, i)) for i, s in sets.items() if s != pivot]
    table = spark.createDataFrame(rows, "pivot long, node long, n long, d long, root long, diff array<long>, near boolean")
    ones, twos = table.filter("near").drop("near"), table.filter("not near").drop("near")
    links = set()
    for left, right in ((ones, twos), (twos, twos)):
        found = {tuple(sorted((r.a, r.b))) for r in jaccard._overlapping(left, right, rule).collect()}
        x, y = ([r.node for r in side.collect()] for side in (left, right))
        every = {tuple(sorted((a, b))) for a in x for b in y if a != b}
        wanted = {pair for pair in every if linked(*pair)}
        assert wanted <= found <= every
        links |= wanted
    assert links
