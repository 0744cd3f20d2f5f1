"""Near duplicates by five-word similarity against plain Python."""

import random

import corpus_pipeline


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def kept_plain(texts):
    sets = {i: shingles(t or "") for i, t in texts.items()}
    first = {i: i for i in texts}

    def top(i):
        return i if first[i] == i else top(first[i])

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or (sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))):
                x, y = sorted((top(a), top(b)))
                first[y] = x
    return {i for i in texts if top(i) == i}


def test_near_copies(spark):
    r = random.Random(5)
    texts, wants = {}, []
    footer = words(r, 60)
    for n in (100, 200, 500):
        for k in range(12):
            base = words(r, n)
            copy = list(base)
            for _ in range(1 if k < 8 else n // 40 + k):
                copy[r.randrange(n)] = "changed" + str(r.random())
            one = len(texts)
            texts[one] = " ".join(base + footer * (k % 2))
            texts[one + 1] = " ".join(copy + footer * (k % 2)).upper()
            if k < 8:
                wants.append(one + 1)
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "too few words", len(texts) + 3: "Too  few words", len(texts) + 4: "other few"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near(spark, docs, "")
    assert out.columns == docs.columns
    got = [x.doc_id for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == kept_plain(texts)
    assert not set(wants) & set(got)
    assert corpus_pipeline.near(spark, docs.limit(0), "").count() == 0


def test_traversal_keeps_every_connection():
    """Links of a traversal connect exactly what all pairs do; pivots discard, and only what cannot link."""
    import numpy as np

    from tilesieve.llm import similar

    r = random.Random(8)
    sets = []
    for _ in range(12):
        base = [r.randrange(1 << 40) for _ in range(60)]
        for k in range(10):
            gone = set(r.sample(range(60), r.randrange(8)))
            sets.append(np.unique(np.array([x for i, x in enumerate(base) if i not in gone] + [r.randrange(1 << 40) for _ in range(r.randrange(6))], np.int64)))
    r.shuffle(sets)

    def parts(pairs):
        top = list(range(len(sets)))
        for a, b in pairs:
            x, y = top[a], top[b]
            top = [x if t == y else t for t in top]
        return {frozenset(i for i, t in enumerate(top) if t == v) for v in set(top)}

    plain = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))]
    tally = {}
    found = similar.set_links(sets, 4, 5, tally)
    assert parts(found) == parts(plain) and len(found) < len(sets)
    assert tally["discarded"] > 0 and tally["verified"] > 0
    prints = np.stack([similar.wide_print(s) for s in sets])
    near = similar.cell_links(prints, np.array([len(s) for s in sets]), 4, 5)
    wider = parts(near)
    assert all(any(p <= q for q in wider) for p in parts(plain)) and len(wider) >= 12


def test_groups_larger_than_a_block(spark, monkeypatch):
    """A group of copies that fills many blocks is one class; no link is lost between blocks."""
    from tilesieve.llm import similar

    monkeypatch.setattr(similar, "CELL", 8)
    monkeypatch.setattr(similar, "BLOCK", 500)
    r = random.Random(4)
    base, texts = words(r, 120), {}
    for k in range(60):
        copy = list(base)
        copy[r.randrange(120)] = f"other{k}"
        texts[k] = " ".join(copy)
    texts |= {100 + k: " ".join(words(r, 100) + base[:30]) for k in range(30)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {x.doc_id for x in corpus_pipeline.near(spark, docs, "").collect()}
    assert got == kept_plain(texts) == {0} | set(range(100, 130))
