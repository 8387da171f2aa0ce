import random

import numpy as np
import pandas as pd
import pytest
from brute import words

from tallyloom.llm import leaked_passages as K

OPTIONS = {"id_col": "id", "text_col": "text", "item_col": "id", "item_text_col": "text"}


def brute(docs, items, least):
    out = set()
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for d, x in docs:
            v = words(x)
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return sorted(out)


def leaks(spark, docs, items, least):
    frame = lambda data: spark.createDataFrame(data, "id long, text string")
    return K.leaked_passages(frame(docs), frame(items), min_words=least, **OPTIONS)


@pytest.mark.parametrize("least", [3, 4, 7, 12])
@pytest.mark.parametrize("block", [50, 10**6])
def test_equals_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(K, "BLOCK_CHARS", block * 4)
    monkeypatch.setattr(K, "SHARD_WORDS", 200)
    rng = random.Random(least)
    text = lambda n: [f"w{rng.randrange(9)}" for _ in range(n)]
    items = [(k, text(rng.randrange(30))) for k in range(12)]
    docs = []
    for k in range(60):
        body = text(rng.randrange(40))
        part = rng.choice(items)[1]
        a = rng.randrange(len(part) + 1)
        docs.append((k, body[:5] + part[a : a + rng.randrange(20)] + body[5:]))
    docs, items = [(k, " ".join(x)) for k, x in docs], [(k, " ".join(x)) for k, x in items]
    got = leaks(spark, docs, items, least)
    assert sorted({(r.doc_id, r.item_id) for r in got.collect()}) == brute(docs, items, least)


def test_longest_passage_and_places(spark):
    item = " ".join(f"i{k}" for k in range(40))
    doc = "before that " + " ".join(f"I{k}" for k in range(5, 30)) + ". after"
    got = leaks(spark, [(1, doc), (2, None), (3, ""), (1, doc)], [(7, item), (8, None), (7, item)], 12).collect()
    assert [tuple(r) for r in got] == [(1, 7, 2, 5, 25)]
    assert leaks(spark, [], [(7, item)], 12).count() == leaks(spark, [(1, doc)], [], 12).count() == 0


def test_no_passage_runs_over_two_documents(spark):
    w = [f"x{k}" for k in range(20)]
    docs = [(1, " ".join(w[:10])), (2, " ".join(w[10:]))]
    assert leaks(spark, docs, [(1, " ".join(w))], 12).count() == 0


@pytest.mark.parametrize("least", [3, 5, 12])
def test_more_words_than_three_to_a_number(spark, monkeypatch, least):
    monkeypatch.setattr(K, "_pack", lambda different: 2)
    rng = random.Random(least)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    docs, items = [(k, text(60)) for k in range(20)], [(k, text(30)) for k in range(10)]
    got = leaks(spark, docs, items, least).select("doc_id", "item_id").distinct()
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, least)


def test_blocks_are_cut_by_size(spark, monkeypatch):
    """No block holds more than the bound and the item that reaches it."""
    monkeypatch.setattr(K, "BLOCK_CHARS", 300)
    seen, search = [], K._search
    monkeypatch.setattr(K, "_search", lambda block, least: seen.append(block) or search(block, least))
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12 + 40 * (k == 3)))) for k in range(12)]
    assert sorted((r.doc_id, r.item_id) for r in leaks(spark, items, items, 12).collect()) == brute(items, items, 12)
    assert sorted(i for block in seen for i, _ in block) == list(range(12))
    assert len(seen) > 2
    assert all(sum(len(t) for _, t in block) - len(max(block, key=lambda x: x[0])[1]) < 300 for block in seen if block)


def test_suffix_array():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 4, 500)
    got = K.suffix_array(ids, 12, 6)
    keys = [tuple(ids[p : p + 12]) for p in got]
    assert keys == sorted(keys)
    runs = [next((k for k, x in enumerate(ids[p:]) if x == 0), len(ids) - p) for p in range(len(ids))]
    assert sorted(got) == [p for p in range(len(ids)) if runs[p] >= 6]


def test_whole_tables(spark, sf):
    root = sf.replace("sf0.001", "sf0.01")
    from tallyloom.llm.queries import QUERIES

    docs, items = pd.read_parquet(f"{root}/documents.parquet"), pd.read_parquet(f"{root}/eval_items.parquet")
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)), 12)
    assert want
    assert sorted(tuple(r) for r in QUERIES["p6_found"](spark, root).collect()) == want
    kept = QUERIES["p6_clean_corpus"](spark, root)
    assert kept.count() == len(docs) - len({d for d, _ in want})
    assert QUERIES["p6_by_item"](spark, root).count() == len(items)
