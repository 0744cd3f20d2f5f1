"""Text operators against plain versions, on small tables with odd rows."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilesieve.llm import bpe, exact_dedup, license_scan, line_dedup, packing, quality_fm, quality_rules, simhash, url_filter, warc

tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "\n", "a", "a b", "Ünïcödé  wörds\n\nand\ttabs \x0b\x0c\r\n end", "x" * 5000, "word " * 3000, "日本語 テキスト。\n", "A\u00a0B\u2003C", "<|endoftext|> <|endoftext|>"]


def documents(spark, texts, **extra):
    """Rows with ids in order, one null text, one null id, one row twice and clashing names."""
    rows = [(i, t, "en", f"src{i % 2}", len(t or ""), "x", i) for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None, None, None), (None, "no id here", "en", "s", 10, "x", 1), rows[-1]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id bigint")


def empty(spark):
    return documents(spark, ["a"]).limit(0)


def prose(seed, n, words=40):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(200)]
    return [" ".join(r.choice(v) for _ in range(r.randint(1, words))).capitalize() + "." for _ in range(n)]


def lower(t):
    return (t or "").encode().lower()


# --- packing --------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizers.path("byte_bpe_50k.json")


def test_encoder_is_the_library(vocabulary):
    own = packing.Encoder(vocabulary)
    for t in ODD + prose(1, 200) + ["a  b", " lead", "trail ", "x\n y", "tab\t z", "'s 't it's", "\n\n  \n x", "a\x85 b", "0 1  2", "don't we'll THEY'RE"]:
        assert own.encode(t) == own.whole(t), t


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("block", [4096, 40])
def test_packing(spark, vocabulary, block):
    docs = documents(spark, ODD + prose(2, 150, 300))
    rows = packing.pack(docs, vocabulary, capacity=256, with_ids=True, block=block).collect()
    own = packing.Encoder(vocabulary)
    want = []
    for r in docs.collect():
        ids = np.frombuffer(own.whole(r.text or ""), "<u4").tolist() + [2]
        want += [(r.doc_id, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 256))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in map(tuple, rows)), key=key) != [] and sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    least = -(-sum(r.length for r in rows) // 256)
    assert len(by) <= least * 1.03 + 3
    assert packing.pack(empty(spark), vocabulary).count() == 0
    made = packing.sequences(spark.createDataFrame(rows)).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in rows)


def test_genetics_keep_every_piece():
    r = np.random.default_rng(1)
    lengths = -np.sort(-r.integers(1, 400, 600))
    island = packing.Evolution(lengths, 1000, r)
    first = island.fresh(0.0)
    out = island.run([first, *(island.fresh(0.1) for _ in range(4))], 40)
    for g in out:
        fill = np.bincount(g, lengths)
        assert len(g) == 600 and fill.max() <= 1000
    assert island.fitness(out[0]) >= island.fitness(first)


def test_genetics_beat_best_fit_on_hard_lengths():
    """Two or three pieces a sequence: best fit, longest first, leaves room that the search and the genetics fill."""
    r = np.random.default_rng(3)
    lengths = -np.sort(-r.integers(250, 520, 2048))
    island = packing.Evolution(lengths, 1024, np.random.default_rng(1))
    plain = island.fresh(0.0)
    start = [plain, island.fresh(0.02), island.fresh(0.04), island.filled()]
    best = max(island.fitness(g)[0] for g in start)
    out = island.run(start, packing.GENERATIONS)
    assert all(np.bincount(g, lengths).max() <= 1024 and len(g) == 2048 for g in (*start, *out))
    assert island.fitness(out[0])[0] > island.fitness(plain)[0] and island.fitness(out[0])[0] >= best


def test_added_tokens_are_the_library_s(vocabulary):
    from tokenizers import Tokenizer

    own, fresh = packing.Encoder(vocabulary), Tokenizer.from_file(vocabulary)
    for t in ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n <|pad|>", "\u00a0<|endoftext|>\u2003y", "<|endoftext", "<|ENDOFTEXT|>"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t


# --- line dedup -----------------------------------------------------------------


def test_one_very_long_line(spark):
    """A line of a hundred thousand characters and a copy with one edit; the edit bound as a parameter."""
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh ") for _ in range(100_000))
    docs = spark.createDataFrame([(1, line), (2, line[:70_000] + "X" + line[70_001:]), (3, "a" * 20_000), (4, "a" * 19_999), (5, line + "YZ"), (6, "ab"), (7, "abc")], "doc_id bigint, text string")
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup(docs).select("row.doc_id", "n_dropped").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 1}
    assert {x.n_dropped for x in line_dedup.dedup(docs, edits=0).collect()} == {0}
    with pytest.raises(ValueError):
        line_dedup.dedup(docs, edits=2)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def lines_plain(docs, least=0):
    seen, out = [], {}
    for key, text in docs:
        stay = []
        for line in (text or "").split("\n"):
            if re.search(r"[^ \t\n\x0b\f\r]", line):
                gone = any(line == s or min(len(line), len(s)) >= least and one_edit(line, s) for s in seen)
                seen.append(line)
                if gone:
                    continue
            stay.append(line)
        out[key] = "\n".join(stay)
    return out


@pytest.mark.parametrize("least", [0, 16])
def test_line_dedup(spark, least):
    r = random.Random(7)
    base = ["".join(r.choice("abcdé z") for _ in range(r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 63, 64, 65, 128, 129, 300]))) for _ in range(40)]

    def edited(s):
        p, c = r.randrange(len(s) + 1), r.choice("abcdé z")
        return r.choice([s, s[:p] + c + s[p:], s[:p] + s[p + 1 :], s[:p] + c + s[p + 1 :]])

    texts = ["\n".join(edited(r.choice(base)) if r.random() < 0.5 else r.choice(base) for _ in range(r.randrange(7))) for _ in range(90)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "same\nsame", None)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id bigint, text string, lines string")
    got = line_dedup.dedup(docs, min_chars=least).select("row.doc_id", "row.lines", "n_lines", "n_dropped", "text").collect()
    want = lines_plain([x[:2] for x in rows], least)
    assert len(got) == len(rows) + 1
    for x in got:
        assert x.text == want[x.doc_id], x.doc_id
    assert line_dedup.dedup(docs.limit(0)).count() == 0


# --- url filter -----------------------------------------------------------------

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/", "allow"), ("net/", "block"), ("org", "block")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://example.com/EN/", "http://com", "http://xcom/", "x://y.net/es/a://b", "ftp://net/es", "http://a.net?q=/es/", "http://É.com/", "http://x.org", "http://porg/"]


def judged_plain(url, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].encode().lower().decode(), m[2]
    best = None
    for rule, verdict in RULES:
        h, s, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(s + p):
            best = max(best or (0, "", ""), (len(rule), verdict, rule))
    return host, path, best and best[2], best[1] if best else default


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "h")], "page_id bigint, url string, host string")
    got = url_filter.judge_urls(pages, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        if r.page_id is not None:
            assert tuple(r)[1:] == judged_plain(URLS[r.page_id])
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_colliding_digests_are_confirmed(tmp_path):
    same = lambda strings: np.full(len(strings), 7, np.uint64)
    path = tmp_path / "rules.bin"
    path.write_bytes(url_filter.build_index(RULES, same))
    index = url_filter.Index(str(path), same)
    assert index.judge([("a.example.com", "/en/")]) == (["example.com/en/"], [1])
    assert index.judge([("a.nothing", "/")]) == ([None], [None])


# --- exact dedup ----------------------------------------------------------------


def test_exact_dedup(spark):
    texts = ODD + ["Same Text"] * 90 + ["same text"] * 40 + ["SAME É", "same É", "same é"] + prose(3, 60) + prose(3, 20)
    docs = documents(spark, texts)
    rows = [(r.doc_id, lower(r.text)) for r in docs.collect()]
    got = exact_dedup.mark(docs, counters=4).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        group = [i for i, t in rows if t == text]
        known = [i for i in group if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(group))
        assert r.text_sha256 == hashlib.sha256(text).hexdigest()
    assert sorted(hashlib.sha256(t).hexdigest() for t in {t for _, t in rows}) == sorted(r.text_sha256 for r in got if r.kept)
    stay = exact_dedup.dedup(docs, counters=4)
    assert stay.columns == docs.columns and sorted(lower(r.text) for r in stay.collect()) == sorted({t for _, t in rows})
    assert exact_dedup.mark(empty(spark)).count() == 0 and exact_dedup.dedup(empty(spark)).count() == 0


def test_misra_gries_bound():
    r = random.Random(1)
    items = [r.choice("abcdefgh") if r.random() < 0.7 else str(r.randrange(500)) for _ in range(4000)]
    mg = exact_dedup.MisraGries(20)
    for x in items:
        mg.add(x)
    for x in set(items):
        n = items.count(x)
        assert n - len(items) / 21 <= mg.counts.get(x, 0) <= n


# --- quality rules --------------------------------------------------------------


def counts_plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [t for t in ODD if len(t) < 6000] + prose(4, 30) + ["a b c a b c d\na b\na b\n \n \n", "x x x x x x"]
    docs = documents(spark, texts)
    for r in quality_rules.judge(docs).collect():
        text = (texts[r.doc_id] if r.doc_id < len(texts) else "") if r.doc_id is not None else "no id here"
        want = counts_plain(text)
        assert tuple(r)[1:6] == want, text[:50]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality_rules.judge(empty(spark)).count() == 0


GOOD = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) + "." for i in range(8))


@pytest.mark.parametrize(
    "line,rule",
    [("a*** b%%% c&&& d### e$$$", "punctuation"), ("WE!! SAY!! THIS!! LOUD!!", "punctuation"), ("one | two | three | four", "navigation"), ("Home Login Contact", "navigation"), ("All Rights Reserved by us.", "boilerplate"), (" ".join(["word"] * 40), "punctuation"), ("A plain line & no more.", None), ("Licensed under the MIT license.", None)],
)
def test_line_rules(line, rule):
    assert quality_rules.line_fails(line.encode(), line.encode().split()) == rule


def test_clean(spark):
    junk = "one | two | three | four"
    docs = spark.createDataFrame([(1, GOOD, 5, "a"), (2, GOOD + "\n" + junk, 7, "b"), (3, "\n".join([junk] * 30), 9, "c"), (4, None, None, None)], "doc_id bigint, text string, n_chars bigint, kept string")
    got = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert got.keys() == {1, 2} and got[1].text == GOOD and got[1].n_chars == 5 and got[2].text == GOOD and got[2].n_chars == len(GOOD) and got[2].kept == "b"


# --- license scans --------------------------------------------------------------


def test_templates():
    def labels(text):
        return license_scan.scan_text(text)[5]

    assert labels("Released under the MIT license.") == "mit,mit-notice"
    assert labels("released under the terms of the mit license") == "mit,mit-notice"
    assert labels("released under the terms of mit license") == "mit"
    assert labels('Licensed under the Apache License, Version 2.0 (the "License"); you may not use') == "apache,apache-2.0-notice"
    assert labels("Licensed under the Apache License, Version 1.1") == "apache"
    body = license_scan.TEMPLATES["mit-text"]
    full = re.sub(r"<<(begin|end)Optional>>", "", body)
    for who in ("the authors or copyright holders", "ACME Inc", ""):
        assert labels(re.sub(r"<<var[^>]*>>", who, full)) == "mit-text"
    assert labels(re.sub(r"<<var[^>]*>>", "who", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", body, flags=re.S))) == "mit-text"
    assert labels(re.sub(r"<<var[^>]*>>", "who", full).replace("sublicense", "sublet")) == ""


def test_scan_counts(spark):
    texts = ODD + ["MIT License mit license! the general public license", "mit\u00a0license", "apache-license v2, Apache (License)"] + prose(5, 20)
    docs = documents(spark, texts)
    for r in license_scan.scan(docs).collect():
        text = ((texts[r.doc_id] if r.doc_id < len(texts) else "") if r.doc_id is not None else "no id here").encode().lower().decode()
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan(empty(spark)).count() == 0


# --- warc -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>é</p>" * 20, "<p>é</p>" * 20, "short", "short", "", None, "x" * 100, "x" * 99, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9] + ["hot page " * 30] * 80
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://a/{i} b\nX: y", h, "z") for i, h in enumerate(html)], "page_id bigint, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got.keys() == set(range(len(html)))
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(k for k, o in enumerate(html) if (o or "") == (h or "")) if len(data) >= 100 else i
        assert tuple(got[i])[1:] == (len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(compressed):
    out, starts = b"", []
    for i in range(6):
        payload = f"<html>{i}</html>".encode() * 30
        data = warc.record(i, f"http://a/{i}", payload, hashlib.sha256(payload).hexdigest(), None) + warc.END
        starts.append(len(out))
        out += gzip.compress(data, mtime=0) + warc.EMPTY_MEMBER if compressed else data
    return out, starts


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("damage", ["byte", "cut", "junk", "end"])
def test_salvage(compressed, damage):
    data, starts = archive(compressed)
    if damage == "byte":
        at = starts[2] + (starts[3] - starts[2]) // 2
        data = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        lost = {2}
    elif damage == "cut":
        data, lost = data[: starts[2] + 40] + data[starts[3] :], {2}
    elif damage == "junk":
        data, lost = data[: starts[3]] + b"\x00garbage\n" * 5 + data[starts[3] :], set()
    else:
        data, lost = data[: starts[5] + 60], {5}
    found = list(warc.salvage(data))
    records = [f["page_id"] for _, _, f in found if isinstance(f, dict)]
    gaps = [(a, b, f) for a, b, f in found if isinstance(f, str)]
    assert records == [i for i in range(6) if i not in lost] and gaps
    assert all(a < b and why for a, b, why in gaps)


# --- byte-level BPE -------------------------------------------------------------


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (50, 20), (7, 5)])
def test_bpe_round_trip(spark, chunk, overlap):
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in ODD if len(t) < 6000] + prose(6, 25, 60) + ["it's we'll   many   blanks\n\n\n 12345678901234567890 !!!???..." * 4, "z" * 400 + " " * 300 + "'re"]
    docs = documents(spark, texts)
    got = bpe.round_trip(docs, path, tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    assert len(got) == docs.count()
    for r in got:
        text = (texts[r.doc_id] if r.doc_id < len(texts) else "") if r.doc_id is not None else "no id here"
        ids = plain.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), text[:60]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    if chunk == 50:
        ids = bpe.encode(docs, path, tokenizers.PATTERN, chunk=chunk, overlap=overlap)
        back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, path, tokenizers.PATTERN).collect()}
        assert all(back[i] == t for i, t in enumerate(texts))
        assert bpe.round_trip(empty(spark), path, tokenizers.PATTERN).count() == 0


# --- simhash --------------------------------------------------------------------


def fingerprint_plain(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text).decode())
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_plain(prints):
    left, out = set(prints), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            x = todo.pop()
            seen.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        for x in seen:
            out[x] = min(seen)
    return out


def test_simhash(spark):
    base = prose(8, 40, 300)
    r = random.Random(2)
    near = []
    for t in base[:25]:
        w = t.split()
        for _ in range(3):
            w[r.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    texts = ODD + base + near + base[:10]
    docs = documents(spark, texts)
    got = simhash.near_duplicates(docs).collect()
    rows = [(x.doc_id, fingerprint_plain(x.text)) for x in docs.collect()]
    cls = classes_plain([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[cls[f]] = min(i, first.get(cls[f], i))
    want = sorted(((i, f"{f:016x}", first.get(cls[f])) for i, f in rows), key=str)
    assert sorted((tuple(x) for x in got), key=str) == want
    stay = simhash.dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(set(cls.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("cell", [4, 8192])
def test_links_keep_all_classes(spark, cell):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:8]:
        for _ in range(60):
            p ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                p ^= 1 << r.randrange(64)
            prints.add(p)
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    found = [(a % 2**64, b % 2**64) for a, b in map(tuple, simhash.links(nodes, cell=cell).collect())]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    cls = classes_plain(prints)
    groups = {}
    for p in prints:
        groups.setdefault(root(p), set()).add(cls[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(cls.values()))


def test_pivots_discard_and_verify():
    """Every pair of a cell is discarded by pivots or verified; both happen."""
    r = random.Random(9)
    low = r.getrandbits(32)
    members = {low | r.getrandbits(32) << 32 for _ in range(300)}
    members |= {m ^ (1 << 40) for m in list(members)[:20]}
    tally = {}
    found = simhash.cell_links(np.array(sorted(members), np.uint64), 2, tally)
    assert len(found) == sum(1 for m in members if (m ^ (1 << 40)) in members) // 2
    assert tally["discarded"] > tally["verified"] > 0
    pair = {}
    assert simhash.cell_links(np.array([7, 6], np.uint64), 2, pair) and pair == {"discarded": 0, "verified": 1}


@pytest.mark.parametrize("cell", [4, 40])
def test_large_cells_are_dealt_by_pivots(spark, cell, monkeypatch):
    """One quarter pair shared by all: the cell is dealt on by pivot windows, and links survive."""
    r = random.Random(6)
    low = r.getrandbits(32)
    prints = {low | r.getrandbits(32) << 32 for _ in range(120)}
    prints |= {p ^ (1 << 35) ^ (1 << 60) for p in list(prints)[:30]}
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    found = {frozenset((a % 2**64, b % 2**64)) for a, b in map(tuple, simhash.links(nodes, cell=cell).collect())}
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert found <= want and {x for p in found for x in p} == {x for p in want for x in p}


# --- quality classifier ---------------------------------------------------------


def test_linear_time_score():
    r = np.random.default_rng(0)
    model = quality_fm.Model(0.3, r.normal(size=quality_fm.BUCKETS).astype(np.float32), r.normal(size=(quality_fm.BUCKETS, quality_fm.FACTORS)).astype(np.float32) * 0.1)
    index, value = quality_fm.features("some words and some more | words!! 12")
    z = model.bias + float(model.linear[index] @ value)
    for a in range(len(index)):
        for b in range(a + 1, len(index)):
            z += float(model.factors[index[a]] @ model.factors[index[b]]) * value[a] * value[b]
    assert abs(model.score(index, value) - 1 / (1 + np.exp(-z))) < 1e-4


def test_classifier(spark):
    good = prose(9, 150, 60)
    bad = [" ".join(w + "***" for w in t.split()) for t in prose(10, 150, 60)]
    docs = documents(spark, good + bad + ["", "one"])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(1, None, 0), (2, 1, 0), (9999, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_fm.fit(docs, labels)
    rows = quality_fm.score(docs, model).collect()
    assert len(rows) == docs.count()
    held = [x for x in rows if x.held_out and x.doc_id < 300]
    assert len(held) > 30 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows if x.doc_id is not None)
    assert sum(x.predicted == (x.doc_id < 150) for x in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    assert quality_fm.keep_good(docs, model).columns == docs.columns
    none = quality_fm.fit(docs, labels.limit(0))
    assert {x.score for x in quality_fm.score(docs, none).collect()} == {0.5}
    assert quality_fm.score(empty(spark), model).count() == 0
