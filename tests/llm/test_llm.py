"""Each operator against brute force, exact round trips and its edge cases."""

import collections
import hashlib
import json
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bytesnp, chat, licenses, neardup, packing, passages, positional, pretokens, quality, transducer, urls, wavelet, wordgrams
from quillspark.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, tokenizer_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PIECES = ["a", "b", "S", "s", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "23", "²", "é", "É", "İ", "Σ", "e\u0301", "\u00a0", "!", "?!", "<|endoftext|>", "中", "🙂", "ß", "Ⱥ", "th", "ing", "LL", "ª", "\r\n", "\x00", "\x1c", "\x85"]
texts = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a nameless text"), (4, "x" * 50_000), (5, "word " * 20_000)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(name, same):
    same(name)


# -- tokens -------------------------------------------------------------------
@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    return {f: (Tokenizer.from_file(tokenizer_path(f)), pretokens.Encoder(tokenizer_path(f)), transducer.Transducer(tokenizer_path(f))) for f in FILES}


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, max_size=8))
def test_encoder_and_transducer(tools, batch):
    for library, enc, machine in tools.values():
        raw, offsets = bytesnp.text_buffer(pa.array(batch, pa.string()))
        ids, counts = enc.encode(raw, offsets)
        want = [library.encode(t, add_special_tokens=False).ids for t in batch]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        assert machine.counts(raw, offsets).tolist() == counts.tolist()


def test_transducer_long_words(tools):
    rnd = random.Random(2)
    batch = ["".join(rnd.choices("etaoinshr", k=n)) for n in (1, 50, 500, 3000)] + ["!?" * 700, ""]
    for library, _, machine in tools.values():
        raw, offsets = bytesnp.text_buffer(pa.array(batch))
        assert machine.counts(raw, offsets).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in batch]


def test_tables_are_emptied(tools):
    _, enc, machine = tools[FILES[1]]
    small, tiny = pretokens.Encoder(tokenizer_path(FILES[1])), transducer.Transducer(tokenizer_path(FILES[1]))
    small.SLOTS = 1 << 8
    small._clear()
    tiny.SLOTS, tiny.MAX_FILLED = 1 << 10, 600
    tiny._clear()
    rnd = random.Random(4)
    for _ in range(4):
        raw, offsets = bytesnp.text_buffer(pa.array([" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(300))]))
        assert small.encode(raw, offsets)[0].tolist() == enc.encode(raw, offsets)[0].tolist()
        assert tiny.counts(raw, offsets).tolist() == machine.counts(raw, offsets).tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=700))
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    m = wavelet.from_bytes(wavelet.to_bytes(wavelet.WaveletMatrix.of(a), np.array([1]), np.array([0]), np.array([len(a)])))[0]
    assert m.decode().tolist() == ids and m.access(np.arange(len(a))).tolist() == ids
    for t in {*ids[:3], 5}:
        assert m.occurrences(t).tolist() == np.flatnonzero(a == t).tolist() and m.rank(t, len(ids) // 2) == ids[: len(ids) // 2].count(t)


def test_wavelet_files(spark, tools, tmp_path):
    rows = EDGE + [(10, "a<|endoftext|>b")]
    got = wavelet.token_files(frame(spark, rows).withColumn("start", F.lit("clash")), tokenizer_path(FILES[0]), shard_tokens=50, folder=f"file://{tmp_path}/w").collect()
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tools[FILES[0]][0].encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert wavelet.token_files(frame(spark, []), tokenizer_path(FILES[0])).count() == 0


def test_token_counts(spark, tools):
    got = transducer.token_counts(frame(spark, EDGE), tokenizer_path(FILES[1]), limit=100).collect()
    library = tools[FILES[1]][0]
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for d, t in EDGE]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert transducer.token_counts(frame(spark, []), tokenizer_path(FILES[1])).count() == 0


# -- packing ------------------------------------------------------------------
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 20))
def test_best_fit(lengths, limit):
    bins, used = packing.BestFit(64, limit), collections.Counter()
    for n in lengths:
        s, offset = bins.place(n)
        assert offset == used[s] and bins.open <= limit
        used[s] += n
    assert all(v <= 64 for v in used.values()) and len(used) <= max(1, 2 * -(-sum(lengths) // 64) + limit)


def test_packing(spark, tools):
    rows = EDGE + [(i, "some words here " * (i % 40)) for i in range(100, 400)]
    got = packing.pack(frame(spark, rows), tokenizer_path(FILES[1]), capacity=256).toPandas()
    library, want = tools[FILES[1]][0], collections.Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[(d, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    key = [(None if d != d else int(d), *r) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert collections.Counter(key) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.2 * got.length.sum() / 256 + 8
    assert packing.pack(frame(spark, []), tokenizer_path(FILES[1])).count() == 0


# -- licences -----------------------------------------------------------------
def test_licenses(spark):
    rows = EDGE + [(20, "Text.\nLicensed under the Apache License, version 2.0\nmore"), (21, "\n".join(licenses.TEMPLATES[4][1].split(", "))), (22, "All the words of the license are here")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[20].licenses == "Apache-2.0" and got[20].best_dice == 1.0 and got[21].best_license == "MIT" and got[22].licenses == "" and got[5].best_dice is None
    assert licenses.scan(frame(spark, [])).count() == 0


# -- positional index ---------------------------------------------------------
def contaminated(docs, items, width=10):
    word, windows = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    sizes, out = {len(k) for k in windows}, []
    for d, t in docs:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


@pytest.mark.parametrize("query_bytes", [1 << 20, 8])
def test_contamination(spark, query_bytes):
    docs = EDGE + [(11, "a b c d e f g h i j k"), (12, "x A,b c-d e f g h i J zz é"), (13, "one short one and é ü"), (14, "b c d e f g h i j k"), (15, "short " * 50)]
    items = [(1, "a b c d e f g h i j"), (2, "b c d e f g h i j k l"), (3, "Short one"), (30, "é"), (4, None), (5, ""), (6, "short short"), (6, "short short")]
    got = positional.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), query_bytes=query_bytes)
    assert collections.Counter(tuple(r)[:6] for r in got.collect()) == contaminated(docs, items)
    assert positional.contamination(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    assert not positional.contamination(frame(spark, docs), frame(spark, [], "item_id long, text string")).where("contaminated").count()


def test_shards_one_after_the_other(spark, monkeypatch):
    """Building and searching an index hold the arrays of one shard at a time."""

    class Table:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    monkeypatch.setattr(positional, "written", lambda table, name: table)
    monkeypatch.setattr(positional, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("etaoin", k=rnd.randint(2, 9))) for _ in range(20_000)]
    docs = [" ".join(rnd.choices(vocabulary, k=2000)) for _ in range(400)]
    batch = pa.record_batch([pa.array(range(len(docs))), pa.array(docs)], ["id", "text"])
    size = 1 << 20
    block = positional.QueryBlock([(str(i), t[:3000]) for i, t in enumerate(docs[::20])], 10)
    peaks, held = [], iter([batch])
    for table in (positional.build_index(Table(), shard_bytes=size), positional._search(Table(), block)):
        tracemalloc.start()
        out = []
        for row in table.run(held):
            out.append(row)
        peaks.append(tracemalloc.get_traced_memory()[1] / size)
        tracemalloc.stop()
        held = iter(out)
    assert sum(bool(x) for r in out for x in r.column(5).to_pylist()) == 20
    assert peaks[0] < 16 and peaks[1] < 11.3  # times a shard's bytes


def test_proximity(spark):
    shard = positional.Shard(positional.build_index(frame(spark, [(1, "a x b y y a b"), (2, "b a")]).coalesce(1)).first().asDict())
    names = [b"a", b"b"]
    h = bytesnp.span_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    ids = shard.term_ids(names, h).tolist()
    assert shard.near(ids, 1) == [(0, 0, 2), (0, 5, 6), (1, 0, 1)] and shard.near(ids, 0) == [(0, 5, 6), (1, 0, 1)]
    phrase, start = shard.phrases(np.array([ids]))
    assert start.tolist() == [5]


@pytest.mark.parametrize("query_bytes", [1 << 20, 8])
def test_proximity_over_shards(spark, query_bytes):
    rnd = random.Random(12)
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 40)))) for i in range(60)] + [(None, "b a"), (100, None)]
    items = [(i, " ".join(rnd.choices("abcdefghz", k=rnd.randint(0, 4)))) for i in range(30)] + [(40, "a b"), (41, "a b"), (42, "a a")]
    want = {}
    for d, t in docs:
        w = (t or "").split()
        for i, q in items:
            need = collections.Counter(q.split())
            holds = lambda a, b, w=w, need=need: not need - collections.Counter(w[a:b])
            spans = [(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + need.total() + 2) + 1) if need and holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
            if spans:
                want[d, str(i)] = spans
    rows = positional.proximity(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string"), slop=2, query_bytes=query_bytes).collect()
    assert {(r.doc_id, r.item): [(x.a, x.b) for x in r.spans] for r in rows} == want and len(rows) == len(want) > 100


# -- urls ---------------------------------------------------------------------
def test_url_rules(spark):
    cases = [("http://a.example.net/en/x?y", "example.net/en/", "allow"), ("http://a.net/", "net/", "block"), ("https://Example.COM/de/1", "example.com/de/", "block"), ("http://b.org/fr/", "org/fr/", "allow"), ("http://c.net", None, None), (None, None, None), ("no scheme", None, None), ("http://xnet/", None, None)]
    rows = [(i, u, None) for i, (u, _, _) in enumerate(cases)]
    got = {r.page_id: r for r in urls.judge(frame(spark, rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, (_, rule, verdict) in enumerate(cases):
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict)
    assert got[5].host == got[5].path == got[6].host == "" and got[2].host == "example.com" and got[0].path == "/en/x"
    assert urls.judge(frame(spark, [], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_url_bayes(spark):
    """The whole query against counts kept in plain dictionaries."""
    rnd = random.Random(3)
    vocab = ["cheap", "pills", "win", "big", "news", "daily", "garden", "tea"]
    rows = []
    for i in range(120):
        bad = i % 2
        words = rnd.choices(vocab[:4] if bad else vocab[4:], k=2)
        zone = rnd.choice([".example.com/de/" if bad else ".org/fr/", ".xyz/p/"])
        rows.append((i, f"http://{''.join(words)}{zone}{i}", "<p>" + " ".join(rnd.choices(vocab, k=8)) + "</p>"))
    got = {r.page_id: r for r in urls.judge(frame(spark, rows, "page_id long, url string, html string"), URL_RULES).collect()}
    counts = collections.Counter(w for _, _, h in rows for w in re.split("[^a-z0-9]+", re.sub("<[^>]*>", " ", h)) if 0 < len(w) <= 20)
    total = sum(counts.values())

    def split(name):
        return urls.best_split(name, {(a, b): counts[name[a:b]] for a in range(len(name)) for b in range(a + 1, len(name) + 1) if counts[name[a:b]]}, total)

    def words_of(r):
        names = [x for x in re.split("[^a-z0-9]+", r.host) + re.split("[^a-z0-9]+", r.path.lower()) if x]
        return [w for x in names for w in split("0" if x.isdigit() else x)]

    seen = {"block": collections.Counter(), "allow": collections.Counter()}
    pages = collections.Counter(r.verdict for r in got.values() if r.rule)
    for r in got.values():
        if r.rule:
            seen[r.verdict].update(words_of(r))
    v = len(seen["block"] | seen["allow"])
    for r in got.values():
        if not r.rule:
            s = np.log(pages["block"] / pages["allow"])
            for w in words_of(r):
                if w in seen["block"] or w in seen["allow"]:
                    s += np.log((seen["block"][w] + 1) / (seen["block"].total() + v)) - np.log((seen["allow"][w] + 1) / (seen["allow"].total() + v))
            assert r.score == pytest.approx(s, abs=1e-6) and r.verdict == ("block" if s > 0 else "allow")
    held_out = [r for r in got.values() if not r.rule]
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in held_out) / len(held_out) > 0.95


# -- chat ---------------------------------------------------------------------
@given(st.text(alphabet='\\#</turn> :\nab"', max_size=40), st.text(alphabet="\\#:<a ", max_size=8))
def test_turns_read_back(body, role):
    formatted, a, b = chat.turn(role, body)
    assert chat.unescape(formatted[a:b]) == body
    assert [(r, t) for r, t, _, _ in chat.parse(formatted * 2)] == [(role, body)] * 2


@pytest.mark.parametrize("units", [1 << 20, 60])
def test_prefix_trees(spark, units):
    rnd = random.Random(5)
    rows = []
    for c in range(60):
        for k in range(rnd.randint(1, 5)):
            rows.append((c, k, "assistant" if k % 2 else "user", rnd.choice(["hi", "### x", "</turn>", "a\\", None])))
    rows += [(100, 0, None, None), (None, 1, "user", "nameless"), (101, 0, "user", "tie"), (101, 0, "user", "tie")]
    trees = chat.prefix_trees(frame(spark, rows, "conv_id long, turn long, role string, text string"), tree_units=units)
    got = {r.conv_id: r for r in chat.read_conversations(trees).collect()}
    by = collections.defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.turn(a, t)[0]) for _, a, t in turns)
    # positions and attention: a node sees its ancestors and nothing else
    whole = collections.defaultdict(list)
    for r in trees.orderBy("tree", "seq").collect():
        whole[r.tree].append(r.asDict(recursive=True))
    for rows_ in whole.values():
        nodes = {r["node"]: r for r in rows_ if not r["ends"]}
        mask = chat.attention(rows_)
        for r in nodes.values():
            up, seen, size = r["parent"], set(), 0
            while up >= 0:
                seen |= set(range(nodes[up]["start"], nodes[up]["start"] + nodes[up]["length"]))
                size += nodes[up]["length"]
                up = nodes[up]["parent"]
            assert r["position"] == size and set(np.flatnonzero(mask[r["start"]])) == seen | {r["start"]}
    if units > 1000:
        assert sum(len([r for r in t if not r["ends"]]) for t in whole.values()) < len(rows)
    assert chat.read_conversations(chat.prefix_trees(frame(spark, [], "conv_id long, turn long, role string, text string"))).count() == 0


def test_trees_of_tokens(spark):
    rows = frame(spark, [(1, 0, "user", "hi there"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi there")], "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # ranges of two tasks would each write the shared turn
    try:
        t = chat.prefix_trees(rows, tokenizer=tokenizer_path(FILES[0])).where("not ends").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(len(r.ids) == r.length for r in t) and len(t) == 2


# -- near duplicates ----------------------------------------------------------
def grouped(docs, width, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("pairs, block", [(256, 512), (4, 7)])
def test_near_duplicates(spark, monkeypatch, pairs, block):
    rnd = random.Random(3)
    words, docs = [f"w{i}" for i in range(3000)], []
    for _ in range(3):
        base = rnd.choices(words, k=120)
        for _ in range(40):
            w = base[:]
            for _ in range(rnd.randint(0, 12)):
                w[rnd.randrange(120)] = rnd.choice(words)
            docs.append(" ".join(w))
    docs += [" ".join(rnd.choices(words[:200], k=rnd.randint(0, 60))) for _ in range(60)] + [" ".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(40)] + docs[:5]
    rows = list(enumerate(docs)) + [(900, None), (901, "")]
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert got == grouped(rows, 2, 80)


def test_near_duplicate_edges(spark):
    got = neardup.near_duplicates(frame(spark, EDGE).withColumn("n_shingles", F.lit("clash")), 5, 80).collect()
    assert len(got) == len(EDGE) and sum(r.doc_id == 3 for r in got) == 2
    assert all(r.kept for r in got) and all(r.component_id is None for r in got if r.doc_id is None)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


# -- quality ------------------------------------------------------------------
def test_quality_counts(spark):
    rnd = random.Random(6)
    rows = [(i, "\n".join(" ".join(rnd.choices(["a", "b", "#c", "d\u00e9", "e|", "f"], k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 12))) + rnd.choice(["", "\n", "\n\n"])) for i in range(80)] + EDGE
    got = quality.quality(frame(spark, rows).withColumn("lang", F.lit("en"))).collect()
    want = collections.Counter()
    for d, t in rows:
        t = t or ""
        w, seen, dup = re.findall(r"[^\x20\x09-\x0d]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        c, cover = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_kneser_ney(spark):
    """Perplexities and bands against a model in dictionaries."""
    rnd = random.Random(8)
    rows = [(i, " ".join("".join(rnd.choices("abcde", k=rnd.randint(1, 5))) for _ in range(60)), "en") for i in range(40)]
    rows += [(100, " ".join("".join(rnd.choices("QXZ#", k=9)) for _ in range(60)), "en"), (101, " ".join(rnd.choices(["xyz", "zyx", "yy"], k=60)), None)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows, "doc_id long, text string, lang string"), width=3.0, least=0.05, repeat_percent=100).collect()}
    codes = lambda t: [0, 0, *(int(quality.FOLD[b]) for b in t.encode())]
    for lang in ("en", ""):
        mine = [(d, codes(t)) for d, t, x in rows if (x or "") == lang]
        c3 = collections.Counter(g for _, s in mine for g in zip(s, s[1:], s[2:], strict=False))
        c2 = collections.Counter(g[1:] for g in c3)
        c1 = collections.Counter(g[1] for g in c2)

        def level(counts):
            n = collections.Counter(counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else 0.5 for k in (1, 2, 3)]

        d1, d2, d3 = level(c1), level(c2), level(c3)
        total1 = sum(c1.values())
        left1 = sum(d1[min(v, 3)] for v in c1.values()) / total1
        p1 = {k: (v - d1[min(v, 3)]) / total1 + left1 / 128 for k, v in c1.items()}

        def interpolated(counts, d, lower):
            total, left = collections.Counter(), collections.Counter()
            for g, v in counts.items():
                total[g[:-1]] += v
                left[g[:-1]] += d[min(v, 3)]
            return {g: (v - d[min(v, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * lower(g) for g, v in counts.items()}

        p2 = interpolated(c2, d2, lambda g: p1[g[1]])
        p3 = interpolated(c3, d3, lambda g: p2[g[1:]])
        assert sum(p for g, p in p3.items() if g[:2] == (0, 0)) <= 1 + 1e-9
        for d, s in mine:
            want = -np.mean([np.log(p3[g]) for g in zip(s, s[1:], s[2:], strict=False)])
            assert got[d].log_perplexity == pytest.approx(want, abs=1e-5)
    assert not got[100].kept and all(got[i].kept == (got[i].low <= got[i].log_perplexity <= got[i].high) for i in got)
    assert quality.quality(frame(spark, [], "doc_id long, text string, lang string")).count() == 0


def test_production_band(spark):
    """Spoilt texts well inside the old floor of 1.0 go at the query's own parameters; copies of one text do not close the band."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda: rnd.choices(vocabulary, k=120)
    spoilt = lambda: " ".join("".join(rnd.sample(w, len(w))) if rnd.random() < 0.5 else w for w in prose())
    rows = [(i, " ".join(prose()), "en") for i in range(300)] + [(1000 + i, spoilt(), "en") for i in range(12)]
    rows += [(2000 + i, rows[0][1] if i < 60 else " ".join(prose()), "xx") for i in range(100)] + [(3000, rows[0][1], "only")]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows, "doc_id long, text string, lang string"), repeat_percent=100).collect()}
    middle = np.median([got[i].log_perplexity for i in range(300)])
    assert all(abs(got[1000 + i].log_perplexity - middle) < 1 and not got[1000 + i].kept for i in range(12))
    assert sum(got[i].kept for i in range(300)) >= 294 and sum(got[2000 + i].kept for i in range(100)) >= 96 and got[3000].kept


def test_unseen_grams():
    m = quality.Model(np.array([1 << 14 | 2 << 7 | 3, 1 << 14 | 2 << 7 | 4, 2 << 14 | 3 << 7 | 1]), np.array([3, 1, 2]))
    for x, y in ((1, 2), (5, 2), (9, 9)):
        p = np.exp(m.log_probability(np.arange(128) + (x << 14 | y << 7)))
        assert p.sum() == pytest.approx(1, abs=1e-4) and (p > 0).all()


def test_word_model(spark, monkeypatch):
    """Perplexities over words against a model in dictionaries, whatever is pruned and however often tasks send."""
    monkeypatch.setattr(wordgrams, "HELD", 500)
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choices(["the", "cat", "sat", "on", "a", "mat", "\u00e9t\u00e9"], [9, 5, 4, 3, 3, 2, 1], k=40) + [f"once{i}"]), "en") for i in range(60)] + [(99, "", "en")]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows, "doc_id long, text string, lang string"), min_words=0, repeat_percent=100, unit="word").collect()}
    often = collections.Counter(w for _, t, _ in rows for w in t.split())
    kept = {w for w, n in often.items() if n >= 3}
    texts = {d: ["", "", *(w if w in kept else None for w in t.split())] for d, t, _ in rows}
    c3 = collections.Counter(g for s in texts.values() for g in zip(s, s[1:], s[2:], strict=False))
    raw2 = collections.Counter()
    for g, n in c3.items():
        raw2[g[1:]] += n
    c2 = collections.Counter(g[1:] for g in c3)
    c1, total1 = collections.Counter(g[1] for g in c2), collections.Counter()
    for g, n in c2.items():
        total1[g[0]] += n

    def discounts(counts):
        n = collections.Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else 0.5 for k in (1, 2, 3)]

    d1, d2, d3 = map(discounts, (c1, c2, c3))
    own1 = {w: (n - d1[min(n, 3)]) / sum(c1.values()) for w, n in c1.items()}
    p1 = lambda w: own1.get(w, 0) + (1 - sum(own1.values())) / (len(kept) + 1)
    own2 = {g: (n - d2[min(n, 3)]) / total1[g[0]] for g, n in c2.items() if raw2[g] >= 3}
    p2 = lambda y, z: own2.get((y, z), 0) + (1 - sum(v for g, v in own2.items() if g[0] == y)) * p1(z)
    three, total2 = {g: n for g, n in c3.items() if n >= 3}, collections.Counter()
    for g, n in three.items():
        total2[g[:2]] += n
    total2 = {c: max(n, raw2[c] if raw2[c] >= 3 else 0) for c, n in total2.items()}
    own3 = {g: (n - d3[min(n, 3)]) / total2[g[:2]] for g, n in three.items()}
    left = collections.Counter()
    for g, v in own3.items():
        left[g[:2]] += v
    for d, s in texts.items():
        if d == 99:
            assert got[d].log_perplexity is None
            continue
        want = -np.mean([np.log(own3.get(g, 0) + (1 - left[g[:2]]) * p2(*g[1:])) - (g[2] is None) * np.log(len(often) - len(kept)) for g in zip(s, s[1:], s[2:], strict=False)])
        assert got[d].log_perplexity == pytest.approx(want, abs=1e-4)


def test_word_order_counts(spark):
    """The query's model tells texts in order from the same words in disorder, letters in other scripts from each other, and grows with the corpus."""
    rnd = random.Random(13)
    follows = {w: rnd.sample(range(200), 4) for w in range(200)}

    def prose():
        out = [rnd.randrange(200)]
        while len(out) < 120:
            out.append(rnd.choice(follows[out[-1]]))
        return [f"\u0434{w}\u0436" for w in out]

    rows = [(i, " ".join(prose()), "ru") for i in range(300)]
    rows += [(1000 + i, " ".join(rnd.sample(x := prose(), len(x))), "ru") for i in range(12)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows, "doc_id long, text string, lang string"), repeat_percent=100, unit="word").collect()}
    assert not any(got[1000 + i].kept for i in range(12)) and sum(got[i].kept for i in range(300)) >= 291


def test_scoring_holds_little():
    """Measuring long batches takes memory for a part of them at a time, and gives what each text gives by itself."""
    rnd = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 5000, 400)) for _ in range(1500)]
    raw, offsets = bytesnp.text_buffer(pa.array(texts))
    langs = np.array(["en"] * len(texts), object)
    own = np.unique(wordgrams.word_hashes(raw, offsets)[0])
    none = (np.zeros(0, np.int64),) * 3
    model = {"en": wordgrams.Model(own, none, none, none, np.zeros(32, np.int64), len(own))}
    assert len(raw) > 2 << 20
    tracemalloc.start()
    try:
        got = quality.measured(raw, offsets, langs, model)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20
    one = quality.measured(*bytesnp.text_buffer(pa.array(texts[77:78])), langs[:1], model)
    assert all(got[k][77] == pytest.approx(one[k][0]) for k in one)


def test_executors_give_heap_back():
    """After slim() an executor's JVM is smaller than a wide phase left it."""
    code = """
import time
import psutil
from pyspark.sql import SparkSession
from quillspark import session
spark = SparkSession.builder.master("local-cluster[1,2,2048]").config("spark.executor.memory", "2g").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
rss = lambda: sum(p.memory_info().rss for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()))
spark.range(0, 4_000_000, 1, 4).selectExpr("repeat(cast(id as string), 20) as v").groupBy("v").count().selectExpr("max(v)").collect()
wide = rss()
session.slim(spark)
for _ in range(40):  # the collector gives back in the background
    time.sleep(0.5 * (rss() > wide * 0.7))
print("RSS", wide >> 20, rss() >> 20)
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": bytesnp.__file__.rpartition("/quillspark/")[0], "SPARK_LOCAL_IP": "127.0.0.1"})
    wide, slim = map(int, ran.stdout.rpartition("RSS")[2].split())
    assert wide > 400 and slim < 0.75 * wide


def test_word_model_of_many_languages(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGES", 2)
    rows = [(i, f"words of a text {i}" if i < 9 else "", f"l{i % 5}" if i < 9 else "only-empty") for i in range(12)]
    assert quality.passing(frame(spark, rows, "doc_id long, text string, lang string"), min_words=0, unit="word").count() == 12
    assert quality.quality(frame(spark, [], "doc_id long, text string, lang string"), unit="word").count() == 0


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGES", 2)
    rows = [(i, f"words of a text {i}" if i < 9 else "", f"l{i % 5}" if i < 9 else "only-empty") for i in range(12)]
    got = quality.quality(frame(spark, rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(12))
    assert quality.passing(frame(spark, rows, "doc_id long, text string, lang string"), min_words=0).count() == 12


# -- passages -----------------------------------------------------------------
@given(st.lists(st.integers(0, 9), max_size=70), st.integers(1, 9), st.sets(st.integers(0, 69), max_size=6))
def test_window_minima(values, t, cuts):
    """The same places as those of the tree, by sliding minima and without a step for each of them."""
    x, barrier = np.array(values, np.uint64) + np.uint64(1), np.isin(np.arange(len(values)), list(cuts))
    assert passages.window_minima(x, t, barrier).tolist() == passages.compact_windows(x, t, barrier)[1].tolist()


def test_windows_build_no_tree(spark, monkeypatch):
    """Windows and their surroundings need the minima's places only."""
    monkeypatch.setattr(passages, "compact_windows", None)
    line = " ".join(f"w{i}" for i in range(60))
    got = passages.repeated_passages(frame(spark, [(1, f"a {line} b"), (2, f"c {line} d")])).collect()
    assert sorted((r.doc_id, r.n_repeated, r.n_later, r.first_doc_id) for r in got) == [(1, 60, 0, 1), (2, 60, 60, 1)]


@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 9), st.sets(st.integers(0, 59), max_size=6))
def test_compact_windows(values, t, cuts):
    x = np.array(values, np.uint64) + np.uint64(1)
    barrier = np.zeros(len(x), bool)
    barrier[[c for c in cuts if c < len(x)]] = True
    want = set()
    for i in np.flatnonzero(~barrier).tolist():
        a = b = i
        while a > 0 and not barrier[a - 1] and x[a - 1] > x[i]:
            a -= 1
        while b < len(x) - 1 and not barrier[b + 1] and x[b + 1] >= x[i]:
            b += 1
        if b - a + 1 >= t:
            want.add((a, i, b))
    assert set(zip(*(v.tolist() for v in passages.compact_windows(x, t, barrier)), strict=True)) == want


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: rnd.choices(words, k=n)
    docs = {i: make(rnd.randint(0, 300)) for i in range(40)}

    def put(d, p):
        k = rnd.randint(0, len(docs[d]))
        docs[d][k:k] = p

    one, two, three = make(51), make(60), make(80)
    for d in (3, 9, 17, 30):
        put(d, one)
    for d in (4, 9, 31):
        put(d, two)
    changed = three[:]
    changed[40] = "zz"
    for d, p in ((5, three), (6, changed), (7, [*three[:40], "extra", *three[40:]])):
        put(d, p)
    line = make(30)
    for d in range(10, 16):
        put(d, line)
    docs[100] = docs[0][:]
    docs[101] = []
    return docs, one


def test_passages(spark, planted):
    docs, one = planted
    df = frame(spark, [(i, " ".join(w)) for i, w in docs.items()] + [(200, None), (None, " ".join(one))])
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    seen = collections.defaultdict(set)
    for i, w in docs.items():
        for s in range(len(w) - 49):
            seen[tuple(w[s : s + 50])].add((i, s))
    need = collections.defaultdict(set)
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, s in places:
                need[i] |= set(range(s, s + 50))
    for i, places in need.items():
        assert places <= {k for x in got[i].spans for k in range(x.a, x.b)}, i
    assert set(got) == set(need) | {5, 6, 7} and got[17].first_doc_id == 3 and got[3].n_later == 0
    left = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    holders = [i for i, w in docs.items() if " ".join(one) in " ".join(w)]  # document 9 holds it in two parts
    assert len(holders) > 2 and [i for i in holders if " ".join(one) in left[i]] == [3] and 100 not in left and 101 in left and 200 in left and None in left
    assert left[20] == " ".join(docs[20])


def test_frequent_line_inside_a_passage(spark, monkeypatch):
    """Passages of exactly 50 words round a frequent line of 40; the smallest documents hold the line alone."""
    monkeypatch.setattr(passages, "BLOCK", 16)
    word = iter(range(10**6))
    make = lambda n: [f"v{next(word)}" for _ in range(n)]
    line = make(40)
    docs = {i: [*make(30), *line, *make(30)] for i in range(20)}
    for i in range(30):
        left = i % 11
        own = [*make(left), *line, *make(10 - left)]
        docs[100 + i], docs[200 + i] = ([*make(20), *own, *make(20)] for _ in range(2))
    got = {r.doc_id: r for r in passages.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()}
    for i in [*range(100, 130), *range(200, 230)]:
        assert i in got and set(range(20, 70)) <= {k for x in got[i].spans for k in range(x.a, x.b)}, i
    assert not set(got) & set(range(20)) and all(got[i].n_later == 0 for i in (100, 105, 110))


def _near_copies_round_a_line() -> dict[int, list[str]]:
    """Texts round a line of 44 words: pairs that share a passage but for a changed, an added or no word, and texts that share the line alone."""
    word = iter(range(10**6))
    make = lambda n: [f"x{next(word)}" for _ in range(n)]
    line = make(44)
    docs = {i: [*make(40), *line, *make(40)] for i in range(30)}
    for i in range(30):
        left = i % 17 + 4
        own = [*make(left), *line, *make(31 - left)]
        for k, kind in enumerate(("as it is", "changed", "added")[: 2 + i % 2]):
            text = own[:]
            if kind != "as it is":
                text[2 : 3 if kind == "changed" else 2] = make(1)
            docs[100 * (k + 1) + i] = [*make(20), *text, *make(20)]
    for i in range(400, 420):  # surroundings of several texts
        docs[i] = [*make(10 + i % 2), *docs[100][:80], *make(7)]
    for i in range(40):  # of what the passage holds beside the line one shingle agrees
        own = make(5)
        docs[500 + i], docs[600 + i] = ([*make(20), *own, x, *line, *make(20)] for x in make(2))
    return docs


def test_passages_do_not_depend_on_block(spark, monkeypatch):
    """Groups of more than BLOCK windows give what they give when they are compared as a whole."""
    rows = frame(spark, [(i, " ".join(w)) for i, w in _near_copies_round_a_line().items()])
    found = []
    for block in (16384, 40, 8):
        monkeypatch.setattr(passages, "BLOCK", block)
        found.append(sorted(passages.repeated_passages(rows).collect()))
    assert found[0] == found[1] == found[2]
    got = {r.doc_id: r for r in found[0]}
    assert not set(got) & set(range(30)) and set(got) == {i for i in _near_copies_round_a_line() if i >= 100}
    assert all(r.n_repeated >= 50 for r in found[0]) and all(got[k + i].n_later == 0 and got[k + 100 + i].n_later for k, n in ((100, 30), (500, 40)) for i in range(n))


def test_smallest_partner_at_any_block(spark, monkeypatch):
    """The counts, the spans and the smallest document are those of all partners, however a group is cut: texts round a line, each with changed words of its own."""
    rnd = random.Random(21)
    line, around = [f"l{i}" for i in range(46)], [[f"a{k}x{i}" for i in range(16)] for k in range(3)]
    docs = {}
    for i in range(60):
        left, right = (list(around[rnd.randrange(3)]) for _ in range(2))
        for side in (left, right):
            side[rnd.randrange(16)] = f"own{i}" if rnd.random() < 0.7 else side[0]
        docs[i] = " ".join([f"b{i}", *left, *line, *right, f"e{i}"])
    rows = frame(spark, list(docs.items()))
    found = []
    for block in (16384, 24, 6):
        monkeypatch.setattr(passages, "BLOCK", block)
        found.append(sorted((r.doc_id, r.n_repeated, r.n_later, r.first_doc_id, r.spans, r.later_spans) for r in passages.repeated_passages(rows).collect()))
    assert len(found[0]) > 40 and found[0] == found[1] == found[2]


def test_smallest_partner_of_all():
    """Each row's smallest other document and what agrees with smaller ones, against all pairs laid over each other."""
    rnd = np.random.default_rng(6)
    kinds = rnd.integers(1, 1 << 60, (4, 91)).astype(np.uint64)
    x = kinds[rnd.integers(0, 4, 120)]
    x[:, 20:60] = kinds[0, 20:60]
    for row in x:
        for at in rnd.integers(0, 87, 2):
            row[at : at + 5] = rnd.integers(1, 1 << 60, 5)
    ids = np.arange(120)
    found = passages.compare(np.zeros(120, np.int64), ids, ids, x, 46, 41)
    late = 0
    for i in range(120):
        agree = [(passages._slide(x[i : i + 1] == x[j : j + 1], 46) >= 41).any() for j in range(120)]
        other = min((j for j in range(120) if j != i and agree[j]), default=passages._NONE)
        late += other < i
        assert found.other[i] == other and (found.later_hi[i] >= 0) == (other < i)
    assert late > 20


def test_partners_in_turn(monkeypatch):
    """Rows that agree with very many are compared with the first ones only; the first two rows of the group agree with each other alone."""
    x = np.tile(np.arange(1, 92, dtype=np.uint64), (60, 1))
    x[:2] += np.uint64(1000)
    x[:, 45] = 1
    for place in (22, 68):  # no window is equal in two rows
        x[:, place] = np.arange(5000 + 100 * place, 5060 + 100 * place)
    pairs, lay = [], passages._on_diagonal
    monkeypatch.setattr(passages, "_on_diagonal", lambda found, rows, *rest: pairs.append(len(rows)) or lay(found, rows, *rest))
    ids = np.arange(60)
    found = passages.compare(np.zeros(60, np.int64), ids, ids, x, 46, 41)
    assert found.other.tolist() == [1, 0, 3, *[2] * 57]
    assert (found.lo == 0).all() and (found.hi == 90).all() and (found.later_hi[3:] == 90).all()
    assert sum(pairs) < 600


def test_rows_that_agree_in_place_need_no_marks(monkeypatch):
    """What agrees on the diagonal is neither looked up in the marks nor, where it tells no window anything, added; two rows whose words are moved are."""
    x = np.tile(np.arange(1, 92, dtype=np.uint64), (60, 1))
    for place in (22, 68):  # no window is equal in two rows
        x[:, place] = np.arange(5000 + 100 * place, 5060 + 100 * place)
    marked, added, holds, add = [], [], passages.Marks.holds, passages.Found.add
    monkeypatch.setattr(passages.Marks, "holds", lambda self, rows, numbers: marked.append(len(rows)) or holds(self, rows, numbers))
    monkeypatch.setattr(passages.Found, "add", lambda self, rows, *rest: added.append(len(set(rows.tolist()))) or add(self, rows, *rest))
    ids = np.arange(60)
    found = passages.compare(np.zeros(60, np.int64), ids, ids, x, 46, 41)
    assert found.other.tolist() == [1, *[0] * 59] and sum(marked) == 0 and sum(added) <= 120
    x[50:, 1:] = x[50:, :-1].copy()
    found = passages.compare(np.zeros(60, np.int64), ids, ids, x, 46, 41)
    assert found.other.tolist() == [1, *[0] * 59] and sum(marked) > 0


def test_minima_among_places():
    rnd = np.random.default_rng(8)
    for high, t in ((40, 5), (1 << 62, 46), (3, 46)):
        x, barrier = rnd.integers(1, high, 4000).astype(np.uint64), rnd.random(4000) < 0.01
        every = passages.window_minima(x, t, barrier)
        assert passages.minima_among(x, t, barrier, np.arange(4000)).tolist() == every.tolist()
        some = np.sort(rnd.choice(4000, 700, replace=False))
        assert passages.minima_among(x, t, barrier, some).tolist() == np.intersect1d(every, some).tolist()
        assert passages.minima_among(x[: t - 1], t, barrier[: t - 1], np.arange(t - 1)).tolist() == []


def test_order_of_hashes_that_differ_at_their_end():
    x = np.array([8, 9, 8, 1 << 60, 0, 9, (1 << 60) + 1, 0], np.uint64)
    assert passages._in_order(x).tolist() == np.argsort(x, kind="stable").tolist()
    x = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)[np.arange(3000) % 500]
    assert passages._in_order(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_two_rows_need_no_codes(monkeypatch):
    """Groups of two rows that agree in place, or share too little, are told without numbers for their shingles; those whose words are moved are not."""
    numbered, codes = [], passages._codes
    monkeypatch.setattr(passages, "_codes", lambda keyed, *rest: numbered.append(len(keyed)) or codes(keyed, *rest))
    x = np.arange(1, 8 * 91 + 1, dtype=np.uint64).reshape(8, 91)
    x[1] = x[0]
    x[1, [20, 45, 70]] += np.uint64(5000)
    x[5, 1:] = x[4, :-1]
    group, ids = np.repeat([1, 2, 3, 4], 2), np.arange(8)
    found = passages.compare(group, ids, ids, x, 46, 41)
    assert found.other.tolist() == [1, 0, *[passages._NONE] * 2, 5, 4, *[passages._NONE] * 2] and sum(numbered) == 2
    assert (found.lo[:2] == 0).all() and (found.hi[:2] == 90).all() and found.later_hi[:2].tolist() == [-1, 90]


def test_marks_never_miss():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 3000, (40, 91)).astype(np.int32)
    x[::2, :50] = x[1::2, 20:70]
    x[::5, 60:] = x[::5, :31]  # numbers that stand twice
    marks = passages.Marks(x)
    r, q = (k.ravel() for k in np.meshgrid(np.arange(40), np.arange(40)))
    has = np.array([np.isin(x[j], x[i]) & (x[j] > 0) for i, j in zip(r, q, strict=True)])
    back = np.array([np.isin(x[i], x[j]) & (x[i] > 0) for i, j in zip(r, q, strict=True)])
    assert not (has & ~marks.holds(r, x[q])).any()
    assert marks.may_share(r, q, 30)[np.minimum(has.sum(1), back.sum(1)) >= 30].all()
    assert all(marks.last[i, j] == (x[i, j] not in x[i, j + 1 :]) for i in range(40) for j in range(91))


def test_classes_against_rows():
    """Rows folded by their surroundings give what all rows give, each by itself."""
    rnd = np.random.default_rng(4)
    base = rnd.integers(1, 1 << 60, (6, 91)).astype(np.uint64)
    base[1] = base[0]
    base[1, 60] += np.uint64(1)
    base[2] = base[0]
    base[2, [20, 70]] += np.uint64(1)
    of, ids = np.r_[np.arange(6), rnd.integers(0, 6, 14)], np.arange(20)
    every = passages.compare(np.zeros(20, np.int64), ids, ids, base[of], 46, 41)
    head = np.unique(of, return_index=True)[1]
    most = ids[head].copy()
    np.maximum.at(most, of, ids)
    folded = passages.compare(np.zeros(6, np.int64), ids[head], most, base, 46, 41)
    for k, row in enumerate(head.tolist()):
        if most[k] == row:
            assert (every.covered[row] == folded.covered[k]).all() and every.lo[row] == folded.lo[k] and every.hi[row] == folded.hi[k]
        else:
            assert every.covered[row].all() and every.lo[row] == 0 and every.hi[row] == 90
        assert every.later_lo[row] == folded.later_lo[k] and every.later_hi[row] == folded.later_hi[k]


def test_joined_spans():
    got = passages._joined(np.array([0, 0, 0, 2, 0]), np.array([5, 0, 9, 1, 20]), np.array([9, 3, 12, 4, 21]), 3).to_pylist()
    assert [[(x["a"], x["b"]) for x in spans] for spans in got] == [[(0, 3), (5, 12), (20, 21)], [], [(1, 4)]]
    assert passages._joined(*(np.zeros(0, np.int64) for _ in range(3)), 2).to_pylist() == [[], []]


def test_agreeing_as_sets():
    """A dropped shingle group in a passage whose shingles also stand earlier in the other text."""
    rnd = np.random.default_rng(3)
    p, early = rnd.integers(1, 1 << 60, 46), rnd.integers(1, 1 << 60, 20)
    a = p.copy()
    b = np.r_[p[:30], early, p[:15], rnd.integers(1, 1 << 60, 4), p[15:]]  # inserted words; the first 30 also stand before
    around = b[60 - 45 : 60 + 46]  # of the shingle that a holds at 10
    got = passages.set_spans(a, around, 46, 41)
    assert got and got[0][:2] == (0, 45) and got[0][2] == 50 - 15
    assert 0.2**passages.HASHES < 0.002


def test_two_passages_on_one_diagonal(spark):
    """What stands between two repeated passages is not repeated, though it is as long in both texts."""
    word = iter(range(10**6))
    make = lambda n: [f"u{next(word)}" for _ in range(n)]
    docs = {}
    for i in range(12):
        head, tail = make(60), make(60)
        docs[2 * i], docs[2 * i + 1] = ([*head, *make(100), *tail] for _ in range(2))
    df = frame(spark, [(i, " ".join(w)) for i, w in docs.items()])
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(got) == set(docs) and all({(x.a, x.b) for x in r.spans} == {(0, 60), (160, 220)} for r in got.values())
    left = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert all(left[i].split() == (docs[i] if i % 2 == 0 else docs[i][60:160]) for i in docs)


def test_passage_edges(spark):
    assert passages.repeated_passages(frame(spark, [])).count() == 0
    assert passages.repeated_passages(frame(spark, EDGE)).count() == 0
    rows = frame(spark, [*EDGE, (6, "word " * 20_000)]).withColumn("spans", F.lit("clash"))
    assert {r.doc_id for r in passages.repeated_passages(rows).collect()} == {5, 6}
    assert passages.without_repeats(rows).count() == len(EDGE)


# -- pipeline -----------------------------------------------------------------
def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns and kept.schema == before.schema, name
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        if name == "near dedup":
            groups = grouped([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {d for d, _ in rows} == {d for d, (_, c) in groups.items() if d == c}
        if name == "decontamination":
            clean = contaminated([(r.doc_id, r.text) for r in before.collect()], bench)
            assert {d for d, _ in rows} == {k[0] for k in clean if not k[5]}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.count() and corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_stages_with_nulls(spark, sf_dir):
    import corpus_pipeline

    rows = [(d, t, None, None, None) for d, t in EDGE]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).collect()
        stage(spark, docs.where("false"), sf_dir).collect()
        stage(spark, docs.withColumn("__extra", F.lit(json.dumps({}))), sf_dir).collect()


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


# -- hashes -------------------------------------------------------------------
def thue_morse(n=1024):
    """Two words of a and b that meet under every polynomial hash modulo 2^64."""
    x = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_hash_of_patterns(spark, tools):
    x, y = thue_morse()
    for library, enc, machine in tools.values():
        raw, offsets = bytesnp.text_buffer(pa.array([x, y]))
        want = [library.encode(t, add_special_tokens=False).ids for t in (x, y)]
        ids, counts = enc.encode(raw, offsets)
        assert ids.tolist() == want[0] + want[1] and counts.tolist() == [len(w) for w in want] == machine.counts(raw, offsets).tolist()
    many = [" ".join(f"{w}{k}" for k in range(60)) for w in (x, y)]
    docs = frame(spark, list(enumerate(many)))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=2).collect()} == {0: 0, 1: 1}
    assert passages.repeated_passages(docs).count() == 0
    lines = quality.quality(frame(spark, [(1, f"{x}\n{y}", "en")], "doc_id long, text string, lang string")).first()
    assert lines.n_dup_lines == 0
    hit = positional.contamination(frame(spark, [(1, x), (2, y)]), frame(spark, [(7, x)], "item_id long, text string")).collect()
    assert {r.doc_id: r.contaminated for r in hit} == {1: True, 2: False}


def test_memory_is_given_back():
    """After a task of many arrays in the C library's heap, its worker's memory is about what it was before."""
    import multiprocessing

    with multiprocessing.get_context("spawn").Pool(1) as pool:
        plain, given = pool.apply(_held, (False,)), pool.apply(_held, (True,))
    assert plain > 150 and given < 50


def _held(tidy: bool) -> float:
    """MB of this process after a task less those before it."""
    size = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    pins = []

    def run(batches):
        np.ones(30 << 20, np.uint8)  # from then on the C library takes arrays of this size from its heap
        arrays = [np.ones(1 << 20, np.uint8) for _ in range(300)]
        pins.append(np.ones(1 << 20, np.uint8))  # the heap cannot shrink from its end
        del arrays
        yield from batches

    bytesnp.give_back()
    before = size()
    assert list((bytesnp.tidy(run) if tidy else run)(iter(()))) == []
    return size() - before


def test_tidy_tasks_drop_what_others_keep():
    """An encoder and its tables stay for the next task of their own function, not through tasks of others."""
    from pyspark import cloudpickle

    path = tokenizer_path(FILES[0])
    enc = pretokens.encoder(path)
    assert pretokens.encoder(path) is enc

    def run(batches):
        from quillspark.llm import bytesnp

        yield list(bytesnp.kept)

    sent = cloudpickle.loads(cloudpickle.dumps(bytesnp.tidy(run)))  # as workers get it
    assert list(bytesnp.kept) == [path] and list(sent(iter(()))) == [[]] and pretokens.encoder(path) is not enc


def test_short_spans_never_meet():
    spans = [bytes([a, b]) for a in range(60) for b in range(60)] + [bytes([a]) for a in range(60)]
    raw = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    assert len(set(bytesnp.span_hashes(raw, ends - [len(s) for s in spans], ends).tolist())) == len(spans)


def test_all_templates(spark):
    text = "permission is granted to anyone who reads this notice in full and keeps it beside the work it was written for today"
    two = (("A", text), ("B", text + " again"))
    found = licenses.scan(frame(spark, [(1, text)]), templates=two).first()
    assert found.licenses == "A,B" and found.best_license == "A" and found.best_dice == 1.0


def test_quality_with_clashing_columns(spark):
    rows = frame(spark, [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(80)), "en") for i in range(6)], "doc_id long, text string, lang string")
    clash = rows.withColumns({"_lang": F.lit("x"), "_kept": F.lit(False), "_low": F.lit(1), "_n_words": F.lit(0)})
    got = quality.passing(clash)
    assert got.columns == clash.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in quality.passing(rows).collect()}


def test_near_dedup_leaves_no_sketches(spark, monkeypatch):
    made, gone = [], []
    keep, drop = neardup.written, neardup.discard
    monkeypatch.setattr(neardup, "written", lambda df, name="table", **o: made.append(keep(df, name, **o)) or made[-1])
    monkeypatch.setattr(neardup, "discard", lambda t: (gone.append(t._written_path), drop(t)))
    texts = [" ".join(f"w{(i // 3) * 50 + j}" for j in range(40 + i % 3)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}  # read after the tables went
    assert found == {i: i // 3 * 3 for i in range(60)}
    left = {t._written_path.rsplit("/", 1)[1].split("-")[0] for t in made if t._written_path not in gone}
    assert not left & {"sketches", "heads", "lists", "placed"} and "members" in left
