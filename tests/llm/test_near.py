import random

import numpy as np
import pytest
from brute import bag, near, words

from tallyloom.llm import near_copies as nc
from tallyloom.llm import setjoin as sj
from tallyloom.llm import split_overlap as so

SCHEMA = "grp string, id long, text string"


def noisy(rng, n, vocabulary):
    """Texts that are edits of each other, to every degree."""
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 40))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            text = base[:]
            for _ in range(rng.randint(0, max(1, len(text) // 2))):
                k = rng.randrange(len(text))
                text[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                text = text or ["x"]
            if rng.random() < 0.5:
                rng.shuffle(text)
            out.append(" ".join(text))
    return out[:n]


def expected(data, share=0.7):
    bags = [(g, i, bag(t)) for g, i, t in data if t]
    return sorted((g, i, j) for k, (g, i, a) in enumerate(bags) for h, j, b in bags[k + 1 :] if g == h and near(a, b, share))


def found(spark, data, **options):
    got = nc.near_copies(spark.createDataFrame(data, SCHEMA), id_col="id", text_col="text", group_col="grp", **options).all_pairs()
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("size", [6, 40, 400])
@pytest.mark.parametrize("deep", [False, True])
def test_all_pairs_are_found(spark, monkeypatch, size, deep):
    """Also where all words are common, groups large, and keys split."""
    if deep:
        monkeypatch.setattr(nc, "SMALL_GROUP", 3)
        monkeypatch.setattr(nc, "SPLIT_GROUP", 20)
        monkeypatch.setattr(nc, "LONG_TAIL", 9)
        monkeypatch.setattr(nc, "COMBINATION", 0.01)
    rng = random.Random(size)
    data = [(rng.choice("ab"), k, t) for k, t in enumerate(noisy(rng, 160, [f"w{x}" for x in range(size)]))]
    assert found(spark, data) == expected(data)


@pytest.mark.parametrize("size", [6, 40, 400])
@pytest.mark.parametrize("deepest", [1, 2, 3])
def test_split_until_it_fits(spark, monkeypatch, size, deepest):
    """Rare words in large groups, keys that are split again and again, and
    blocks of what shares even the longest key: no pair is lost."""
    for name, value in {"COMMON": 0.4, "SMALL_GROUP": 3, "SPLIT_GROUP": 12, "BLOCK_ROWS": 5, "BUCKETS": 64, "DEEPEST_KEY": deepest}.items():
        monkeypatch.setattr(nc, name, value)
    rng = random.Random(size + deepest)
    data = [(rng.choice("ab"), k, t) for k, t in enumerate(noisy(rng, 160, [f"w{x}" for x in range(size)]))]
    assert found(spark, data) == expected(data)


@pytest.mark.parametrize("share, least", [(0.5, 1), (0.34, 2)])
def test_few_words_in_common(spark, monkeypatch, share, least):
    """Texts that need fewer words in common than a split key has."""
    for name, value in {"SMALL_GROUP": 3, "SPLIT_GROUP": 6, "BLOCK_ROWS": 5, "DEEPEST_KEY": 3}.items():
        monkeypatch.setattr(nc, name, value)
    rng = random.Random(8)
    data = [("a", k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))) for k in range(90)]
    bags = [(i, bag(t)) for _, i, t in data]
    want = sorted(("a", i, j) for k, (i, a) in enumerate(bags) for j, b in bags[k + 1 :] if near(a, b, share, least))
    assert found(spark, data, threshold=share, min_words=least) == want


def test_no_key_has_more_rows_than_a_task_may_hold(monkeypatch):
    import pyarrow as pa

    for name, value in {"SPLIT_GROUP": 40, "BLOCK_ROWS": 20, "DEEPEST_KEY": 3}.items():
        monkeypatch.setattr(nc, name, value)
    rng = np.random.default_rng(2)
    sets = [np.sort(np.append(rng.choice(np.arange(3, 60), 12, replace=False), [0, 1, 2])) for _ in range(300)]
    lists = lambda x, kind: pa.array(x, pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), lists([[]] * 300, pa.int64()), lists(sets, pa.int32())], ["uid", "rare", "common"])
    heavy = nc.Heavy(np.bincount(np.concatenate(sets)), np.empty(0, np.int64))
    while heavy.deepest() and len(heavy.longer) + 2 <= nc.DEEPEST_KEY:
        key, n = (np.concatenate([x.column(c).to_numpy() for x in nc._key_counter(700, heavy, len(heavy.longer) + 2)(iter([batch]))]) for c in (0, 1))
        heavy = nc.Heavy(heavy.common, heavy.rare, (*heavy.longer, (key[n > nc.SPLIT_GROUP], n[n > nc.SPLIT_GROUP])))
    assert len(heavy.longer) == 2
    keys = np.concatenate([x.column("key").to_numpy() for x in nc._prefixes(700, heavy)(iter([batch]))])
    assert np.unique(keys, return_counts=True)[1].max() <= 2 * nc.SPLIT_GROUP


def test_members_and_links(spark):
    rng = random.Random(4)
    data = [("a", k, t) for k, t in enumerate(noisy(rng, 80, [f"w{x}" for x in range(60)]))]
    data += [("a", 100 + k, data[0][2].upper()) for k in range(3)]
    got = nc.near_copies(spark.createDataFrame(data, SCHEMA), id_col="id", text_col="text", group_col="grp").links()
    pairs = expected(data)
    want = {i: sum(i in (a, b) for _, a, b in pairs) for _, i, t in data if bag(t).total() >= 12}
    assert {r.id: r.links for r in got.collect()} == want


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_thresholds(spark, monkeypatch, share):
    monkeypatch.setattr(nc, "SMALL_GROUP", 3)
    rng = random.Random(3)
    data = [("a", k, t) for k, t in enumerate(noisy(rng, 100, [f"w{x}" for x in range(60)]))]
    assert found(spark, data, threshold=share) == expected(data, share)


@pytest.mark.parametrize("cost", [1e9, 1.0, 0.0])
def test_further_words_lose_nothing(monkeypatch, cost):
    """Whatever length of prefix the cost leads to, a group gives all its
    near-same pairs."""
    monkeypatch.setattr(nc, "COMBINATION", cost)
    rng = np.random.default_rng(1)
    sets = [np.unique(np.append(rng.choice(np.arange(1, 30), rng.integers(13, 21), replace=False), 0)) for _ in range(60)]
    sets.sort(key=len)
    n = np.asarray([len(s) for s in sets])
    room = n - sj.need(n, 700)  # the first word is the key
    tails = [s[1 : r + nc.DEEPEST] for s, r in zip(sets, room, strict=True)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in tails])])
    bits = sj.sketches(np.repeat(np.arange(60), n), np.concatenate(sets).astype(np.uint64), 60).view(np.uint64)
    i, j = nc._by_further_words(n, room, 1, bits, ends, np.concatenate(tails), 700)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {
        (a, b) for a in range(60) for b in range(a + 1, 60) if len(np.intersect1d(sets[a], sets[b])) * 1000 >= 700 * max(n[a], n[b])
    }
    assert want
    assert want <= got


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(12))
    data = [("a", 1, None), ("a", 2, ""), ("a", 3, " \n"), ("a", 4, "short text"), ("a", 5, text), ("a", 6, text.upper()), ("a", 7, " ".join(reversed(text.split()))), ("b", 5, text)]
    assert found(spark, data) == [("a", 5, 6), ("a", 5, 7), ("a", 6, 7)]
    # a row delivered twice counts once; no rows at all give none
    assert found(spark, [*data, ("a", 6, text.upper())]) == [("a", 5, 6), ("a", 5, 7), ("a", 6, 7)]
    assert nc.near_copies(spark.createDataFrame([], SCHEMA), id_col="id", text_col="text").all_pairs().count() == 0


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(1)
    long = [f"v{rng.randrange(3000)}" for _ in range(20_000)]
    edited = long[:]
    for k in range(0, 20_000, 9):
        edited[k] = "edited"
    data = [("a", 1, " ".join(long), 1, 2), ("a", 2, " ".join(edited), 1, 2), ("a", 3, " ".join(long[:9000]), 1, 2)]
    df = spark.createDataFrame(data, "grp string, id long, text string, uid long, one int")
    got = nc.near_copies(df, id_col="id", text_col="text", group_col="grp")
    assert [tuple(r)[1:] for r in got.all_pairs().collect()] == [(1, 2)]


def test_hot_class(spark):
    """A third of all rows is one text: one class, all its pairs."""
    rng = random.Random(5)
    hot = " ".join(f"h{k}" for k in range(20))
    data = [("a", k, hot if k % 3 == 0 else " ".join(f"x{rng.randrange(10**6)}" for _ in range(15))) for k in range(300)]
    near_ = nc.near_copies(spark.createDataFrame(data, SCHEMA), id_col="id", text_col="text", group_col="grp")
    assert near_.members.where("class_id = 0").count() == 100
    assert near_.pairs.count() == 0
    assert near_.all_pairs().count() == 100 * 99 // 2


def test_ranges_and_windows():
    got = [(int(k), int(x)) for a, b in sj.ranges(np.array([3, 5, 0]), np.array([5, 5, 4]), most=2) for k, x in zip(a, b, strict=True)]
    assert got == [(0, 3), (0, 4), (2, 0), (2, 1), (2, 2), (2, 3)]
    group, n = np.array([0, 0, 0, 1]), np.array([12, 16, 40, 12])
    pairs = [(int(i), int(j)) for a, b in sj.pairs_within(group, n, 700) for i, j in zip(a, b, strict=True)]
    assert pairs == [(0, 1)]


def overlaps(spark, held, other):
    side = lambda data: spark.createDataFrame(data, "id long, field string, text string")
    got = so.split_overlap(side(held), side(other)).rows()
    return sorted((r.held_id, r.other_id, r.field) for r in got.collect())


@pytest.mark.parametrize("spread", [so.SPREAD, 3])
def test_overlaps_equal_brute_force(spark, sf, monkeypatch, spread):
    """On the whole small tables every overlap is found, also where digests
    are spread over several keys."""
    monkeypatch.setattr(so, "SPREAD", spread)
    import pandas as pd

    root = sf.replace("sf0.001", "sf0.01")
    test, train = (pd.read_parquet(f"{root}/{t}.parquet") for t in ("test", "train"))
    held = [(int(i), "body", t) for i, t in zip(test.src_pos, test.body, strict=True) if t]
    other = [(int(i), f, t) for f in ("body", "positive_example_1") for i, t in zip(train.src_pos, train[f], strict=True) if t]
    bags = {t: bag(t) for _, _, t in held + other}
    texts = {t for _, _, t in other}
    hits = {a: [b for b in texts if near(bags[a], bags[b])] for a in {t for _, _, t in held}}
    by_text = {}
    for i, f, t in other:
        by_text.setdefault(t, []).append((i, f))
    want = sorted((h, i, f) for h, _, t in held for b in hits[t] for i, f in by_text[b])
    assert want
    assert overlaps(spark, held, other) == want


def test_overlap_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    held = [(1, "body", text), (2, "body", None), (3, "body", "few words"), (4, "body", text)]
    other = [(1, "body", text + " more"), (1, "pool", text), (2, "pool", None), (3, "pool", ""), (1, "pool", text)]
    assert overlaps(spark, held, other) == [(1, 1, "body"), (1, 1, "pool"), (4, 1, "body"), (4, 1, "pool")]
    assert overlaps(spark, held, []) == overlaps(spark, [], other) == []


def test_orders_of_one_bag_have_their_own_chunks(spark):
    """Each order of the words gets its own fraction; none is lost."""
    rng = random.Random(2)
    text = [f"w{k}" for k in range(60)]
    swapped = [*text[40:], *text[:40]]
    mixed = rng.sample(text, 60)  # shares no chunk
    spell = lambda x: " ".join(x)
    side = lambda data: spark.createDataFrame(data, "id long, field string, text string")
    # whatever order comes first
    for orders in ((text, swapped, mixed), (mixed, swapped, text), (swapped, mixed, text)):
        other = [(k, "pool", spell(x)) for k, x in enumerate(orders)]
        held = [(7, "body", spell(text)), (8, "body", spell(swapped))]
        got = {(r.held_id, r.other_id): r.shared_chunks for r in so.split_overlap(side(held), side(other)).rows().collect()}
        assert len(got) == 6
        for h, own in ((7, text), (8, swapped)):
            assert [o for o in range(3) if got[h, o] == 1] == [orders.index(own)]
            assert 0.5 < min(got[h, orders.index(text)], got[h, orders.index(swapped)])
            assert got[h, orders.index(mixed)] < so.LEAST_SHARED


def test_chunks_cover_every_word_once():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 3000).astype(np.uint64)
    ends = np.array([0, 0, 1, 900, 900, 3000])
    owner, digest, length = so.chunks(ends, hashes)
    assert np.bincount(owner, length, 5).tolist() == [0, 1, 899, 0, 2100]
    assert length.max() <= so.LONGEST
    same = np.concatenate([hashes[:50], hashes[:50]])
    o, d, _ = so.chunks(np.array([0, 50, 100]), same)
    assert d[o == 0].tolist() == d[o == 1].tolist()
    assert so.chunks(np.array([0, 100]), np.zeros(100, np.uint64))[2].max() <= so.LONGEST


def test_words_are_runs_of_letters_and_digits():
    from tallyloom.llm.textform import words as ours

    for text in ["It's snake_case", "Ｆｕｌｌ ﬁne", "tea​cup х2 уоur σπίτι добрый", "é vs é 1½", "ПРИВЕТ cоde", "", None]:
        assert ours(text) == words(text)
