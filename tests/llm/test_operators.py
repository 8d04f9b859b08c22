"""The operators against plain versions, with the defined odd cases."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.llm import bpe, common, html, jaccard, langid, lines, packing, quality, suffix, vectors, wavelet

DOCS = "doc_id long, text string, ids string, uid string"     # the last two clash with inner names
BASE = " ".join(f"w{i}" for i in range(120))
CHANGED = BASE.replace("w50 ", "changed ")
HALF = " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"v{i}" for i in range(60))
TEXTS = [None, "", " \n\t ", BASE, BASE, CHANGED, HALF, "a b", "A  B", "x", "É " * 200, "z" * 5000, BASE + " tail",
         "one line of more than twenty four\nshort\none line of more than twenty foul\n" + BASE,
         "line that is here only once, surely\n\none line of more than twenty four"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "i", "u") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs():
    return list(enumerate(TEXTS))


def ranks():
    return bpe.read_ranks(common.file_bytes(P.path("byte_bpe_50k.tiktoken")))


def test_tree_bpe_equals_library():
    tiktoken = pytest.importorskip("tiktoken")
    r = ranks()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=r, special_tokens={})
    tree, rnd = bpe.TreeBPE(r), random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("aabcdeth éß1漢") for _ in range(rnd.randrange(1, 200))).replace(" ", "")
        want = [t for m in [word.encode()] if m for t in enc._core_bpe.encode_single_piece(m)] if word else []
        assert tree.encode(word.encode()) == want
        assert tree.decode(np.array(want)) == word.encode()


def test_bpe_long_pieces_equal_library():
    """Long runs of one byte, of short periods and of letters; the heap merges alike at every length."""
    tiktoken = pytest.importorskip("tiktoken")
    r, rnd = ranks(), random.Random(4)
    single = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=r, special_tokens={})._core_bpe.encode_single_piece
    tree = bpe.TreeBPE(r)
    for size in (97, 4096, 20_001):
        for unit in ("=", "-=", "abc", "漢字仮", None):
            text = (unit * size)[:size] if unit else "".join(rnd.choice("etaoinshrdlu") for _ in range(size))
            assert tree.encode(text.encode()) == single(text.encode())
    for _ in range(200):
        word = "".join(rnd.choice("aabcdeth") for _ in range(rnd.randrange(3, 400))).encode()
        if word not in r:
            assert [r[t] for t in tree._merge_long(word)] == single(word)
    assert tree.encode(b"=" * 1_000_000) == single(b"=" * 1_000_000)


def test_bpe_whole_texts_equal_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rnd = random.Random(6)
    odd = " \n\t\r\x0b\x1c\x85\xa0\u3000\u200b'sAbÉ1!-ß²漢="
    texts = TEXTS + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    texts += ["=" * 30_000, "ruler " + "-" * 9_000 + "\n" + "=" * 9_001, "<|endoftext|>", "a" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert np.frombuffer(row["ids"], "<u4").tolist() == enc.encode_ordinary(texts[row["id"]] or "")


def test_bpe_round_trip(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert {r["id"]: bytes(r["bytes"]) for r in got} == {i: (t or "").encode() for i, t in pairs()}
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert bpe.encode(empty(spark), path, P.PATTERN).count() == 0


def test_piece_ids_equal_library():
    import pyarrow as pa
    tokenizers = pytest.importorskip("tokenizers")
    rnd = random.Random(5)
    odd = " \n\t\r\x0b\x1c\x1f\x85\xa0 ́​\x00\x01'sAbÉ1!-ß²漢"
    texts = TEXTS + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 30))) for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = tokenizers.Tokenizer.from_file(P.path(name))
        tok.encode_special_tokens = True
        ids, n = common.PieceIds(common.library_encoder(common.file_bytes(P.path(name))), 500).batch(pa.array(texts))
        cuts = np.split(ids, np.cumsum(n)[:-1])
        want = tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert all(list(c) == w.ids for c, w in zip(cuts, want))


def test_piece_ids_of_words_in_several_forms(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    rnd = random.Random(7)
    parts = " aA.,'é́!Éßsİ"
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))).strip() for _ in range(3000)]
    forms = ["Word word word, word. (Word)\nword\nWord!? WORD... wörd, Wörd Wörd\nwörd."]
    for name, keys in (("word_bpe_49k.json", {"word", "(word", "wörd", "Wörd", ",", ".", "!?", ")", "..."}),
                       ("byte_bpe_50k.json", None)):
        tok = tokenizers.Tokenizer.from_file(P.path(name))
        tok.encode_special_tokens = True
        encode, asked = common.library_encoder(common.file_bytes(P.path(name))), []
        seen = lambda keys: asked.extend(keys) or encode(keys)
        seen.__dict__.update(vars(encode))
        for some in (forms, texts):
            ids, n = common.PieceIds(seen).batch(pa.array(some))
            cuts = np.split(ids, np.cumsum(n)[:-1])
            assert [c.tolist() for c in cuts] == [w.ids for w in tok.encode_batch(some, add_special_tokens=False)]
            if some is forms and keys:      # each word is encoded once
                assert sorted(asked) == sorted(keys)


def test_regions_are_filtered_by_their_linked_members(spark):
    run = jaccard._Join(None, 85, 100)
    run.comp = common.stored(spark.createDataFrame([(1, 1), (2, 1)], "node long, component_id long"), "comp")
    rows = [(7, 1, 2), (7, 2, 2), (8, 2, 2), (8, 3, 2), (9, 4, 2), (9, 5, 2)]

    def labels(some):
        got = run.labelled(common.stored(spark.createDataFrame(some, "s long, uid long, c long"), "members"))
        return got, sorted((r["s"], r["uid"], r["label"]) for r in got.collect())

    assert labels(rows)[1] == [(8, 2, 1), (8, 3, 3), (9, 4, 4), (9, 5, 5)]
    got, out = labels(rows[2:])     # no region is settled: none of the members meets a list of regions
    assert out == [(8, 2, 1), (8, 3, 3), (9, 4, 4), (9, 5, 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan


def test_jaccard(spark, docs):
    got = jaccard.jaccard_classes(docs, 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(pairs())
    assert jaccard.jaccard_classes(empty(spark), 4, 85, 100).count() == 0


def test_jaccard_large_mixed_regions(spark, monkeypatch):
    """A common passage and a group of near copies, with regions divided again."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rnd = random.Random(9)
    words = [f"k{i}" for i in range(400)]
    passage = " ".join(rnd.choices(words, k=25))
    rows = []
    for i in range(40):
        rows.append((i, passage + " " + " ".join(rnd.choices(words, k=rnd.randrange(5, 60)))))
    base = rnd.choices(words, k=80)
    for i in range(40, 70):
        w = list(base)
        w[rnd.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, 4, 85, 100).collect()}
    assert got == brute.jaccard(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one(df, 4, 85, 100).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_components_write_files_by_rows(spark, monkeypatch):
    files = []

    def counted(df, name, rows=None):
        out = stored(df, name, rows) if rows is not None else stored(df, name)
        files.append(len(out.inputFiles()))
        return out

    stored = common.stored
    monkeypatch.setattr(common, "stored", counted)
    edges = ([(i, i + 1) for i in range(60)] + [(5000, 1000 + i) for i in range(300)] + [(7, 7), (None, 3), (4, None)]
             + [(300 - i, 299 - i) for i in range(40)] + [(1, 0), (1, 0)])
    df = spark.createDataFrame(edges, "a long, b long")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["node"]: r["component_id"] for r in common.components(df, rows=len(edges)).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want = {i: 0 for i in range(61)} | {i: 1000 for i in (5000, *range(1000, 1300))} | {i: 260 for i in range(260, 301)}
    assert got == want
    assert max(files) == 1
    assert common.components(df.where("a is null"), rows=1).count() == 0
    assert {tuple(r) for r in common.components(df.where("a = 1")).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_workers_drop_tokenizers(monkeypatch):
    monkeypatch.setattr(common, "_ENCODERS", {"x": None})

    def held(batches):
        yield len(common._ENCODERS)

    assert list(common.freeing(held, encodes=True)([])) == [1]
    assert list(common.freeing(held)([])) == [0]


def test_batches_of_texts_are_bounded(spark):
    common.prepare(spark)
    df = spark.range(9000, numPartitions=1).select(F.expr("repeat('x', 8000)").alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) <= 17 << 20


def test_batches_and_slices_of_texts_are_small(spark):
    common.prepare(spark)
    df = spark.range(4000, numPartitions=1).select("id", F.expr("repeat('x', 8000)").alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) <= 9 << 20
    batch = pa.record_batch([pa.array(range(2048)), pa.array(["y" * 4000] * 2048)], ["id", "t"])
    each = list(common.slices(batch, 1, size=packing.SLICE))
    assert sum(s.num_rows for s in each) == 2048
    assert max(s.num_rows for s in each) * 4000 <= (3 << 20) + 4000


def test_suffix_array_of_wanted_suffixes():
    rnd = random.Random(3)
    for _ in range(50):
        t = np.array([x for _ in range(rnd.randrange(1, 9))
                      for x in [rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))] + [0]], np.int32)
        wanted = np.array([rnd.random() < 0.3 for _ in t])
        got = suffix.suffix_array(t, 200, wanted)
        assert got.tolist() == [i for i in sorted(range(len(t)), key=lambda i: t[i:].tolist()) if wanted[i]]


def test_repeats_of_segments():
    rnd = random.Random(4)
    for _ in range(100):
        n = rnd.choice([3, 7, 8, 16])
        segments = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(n + rnd.randrange(9)))
                    for _ in range(rnd.randrange(1, 8))]
        size = np.array([len(s) for s in segments])
        got = suffix.repeats(np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size, size, n)
        seen, want = set(), set()
        for i, s in enumerate(segments):
            for j in range(len(s) - n + 1):
                if s[j:j + n] in seen:
                    want.add((i, j))
                seen.add(s[j:j + n])
        assert {(i, j) for i, a, b in zip(*(x.tolist() for x in got)) for j in range(a, b)} == want


def test_anchors_of_texts_taken_together(monkeypatch):
    """Equal strings have equal anchors, wherever texts are put together or cut."""
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"abcd") for _ in range(900))
    texts = [base[rnd.randrange(300):rnd.randrange(301, 900)] for _ in range(40)] + [b"", b"x" * 500]
    found = []
    for text, block in ((1 << 20, 1 << 17), (256, 64)):
        monkeypatch.setattr(suffix, "TEXT", text)
        monkeypatch.setattr(suffix, "BLOCK", block)
        of, h, s, a, n = suffix.anchors(texts, 40, 16)
        at = {(i, b + k): hh for i, hh, b, m in zip(of.tolist(), h.tolist(), a.tolist(), n.tolist()) for k in range(m)}
        assert set(at) == {(i, k) for i, x in enumerate(texts) for k in range(len(x) - 39)}
        by: dict[bytes, set] = {}
        for (i, k), hh in at.items():
            by.setdefault(texts[i][k:k + 40], set()).add(hh)
        assert all(len(x) == 1 for x in by.values())
        found.append(by)
    assert found[0] == found[1]


def test_suffix_array_order():
    rnd = random.Random(1)
    for _ in range(50):
        # segments of symbols, each ended by a 0
        t = np.array([x for _ in range(rnd.randrange(1, 9))
                      for x in [rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))] + [0]], np.int32)
        got = suffix.suffix_array(t, 200)
        assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_repeated_bytes(spark, docs):
    got = suffix.dedup_substrings(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
            for r in got} == brute.repeated_bytes(pairs())
    assert suffix.dedup_substrings(empty(spark)).count() == 0
    kept = suffix.dedup_texts(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").first()["text"] is None


def test_repeated_bytes_of_files_read_together(spark):
    rnd = random.Random(7)
    base = [" ".join(str(rnd.randrange(10 ** 6)) for _ in range(60)) for _ in range(9)]
    rows = [(i, rnd.choice(base)[:rnd.randrange(150, 400)] + f" own {rnd.random()} " + rnd.choice(base)[60:])
            for i in range(60)]
    few = {"spark.sql.files.minPartitionNum": "2", "spark.sql.files.openCostInBytes": "0"}    # as on local[2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    for k, v in few.items():
        spark.conf.set(k, v)
    try:
        texts = common.stored(suffix.numbered(df), "texts")
        assert texts.rdd.getNumPartitions() <= 4
        got = suffix.dedup_substrings(df).collect()
    finally:
        for k in few:
            spark.conf.unset(k)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
            for r in got} == brute.repeated_bytes(rows)


def test_line_dedup(spark, docs):
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.dedup_lines(pairs(), lines.MIN_CHARS)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_short_lines(spark):
    """Exact copies of short lines go whatever their length, one edit does not count there, blank lines stay."""
    rows = [(1, "Read more\n\n}\nbody of one"), (2, "Read more\n \n\nRead mores\n}"), (3, "\u3000\nx\nx\n\t\n\u3000"),
            (None, "x"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {None: "x", 1: rows[0][1], 2: " \n\nRead mores", 3: "\u3000\n\t", 4: None, 5: ""}


def test_line_dedup_random_edits(spark):
    rnd, rows = random.Random(2), []
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(24, 70))) for _ in range(12)]
    for i in range(150):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 3)):
            k = rnd.randrange(len(t))
            t[k:k + rnd.randrange(0, 2)] = rnd.choice(["", "x", "é"])
        rows.append((i, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == brute.dedup_lines(rows, lines.MIN_CHARS)


def test_quality_order_does_not_change_verdicts(spark, docs):
    got = {r["doc_id"]: r["kept"] for r in quality.cascade(docs, features=quality.BASE).collect()}
    for i, t in pairs():
        f = quality.Features(t)
        assert got[i] == (not any(r.rejects(f) for r in quality.RULES))
    assert quality.cascade(empty(spark), features=quality.BASE).count() == 0
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == {i for i, k in got.items() if k}


def test_wavelet_shard():
    rnd = np.random.default_rng(0)
    ids = rnd.integers(0, 300, 1000)
    s = wavelet.Shard(wavelet.build(ids, [None, 5], [400, 600], 9))
    assert (s.tokens() == ids).all() and s.doc_ids == [None, 5]
    for i in (0, 17, 999):
        assert s.access(i) == ids[i]
    for token in (int(ids[3]), 299, 511):
        at = np.flatnonzero(ids == token)
        assert s.count(token) == len(at) and [s.locate(token, k) for k in range(len(at))] == at.tolist()


def test_shards_of_any_width():
    rnd = np.random.default_rng(1)
    for bits in (1, 16, 17):
        ids = rnd.integers(0, 1 << bits, 777)
        assert (wavelet.Shard(wavelet.build(ids, [1], [777], bits)).tokens() == ids).all()


def test_piece_keys_are_distinct_words(monkeypatch):
    texts = [f"a{i} b{i % 7}\n\u00e9{i}" for i in range(50)]
    enc = common.PieceIds(lambda keys: (np.arange(len(keys), dtype="<u4"), np.ones(len(keys), np.int64)))
    seen = []
    monkeypatch.setattr(enc, "_slots", lambda keys, f=enc._slots: seen.extend(keys) or f(keys))
    assert enc.batch(pa.array([*texts, None]))[1].tolist() == [3] * 50 + [0]
    assert all(type(k) is str for k in seen) and len(seen) == 50 + 7 + 50


def test_token_shards(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, start = {r["doc_id"]: r for r in wavelet.round_trip(docs, P.path("byte_bpe_50k.json")).collect()}, 0
    for i, t in pairs():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert wavelet.round_trip(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_packing(spark, docs):
    got = packing.best_fit_packing(docs, P.path("word_bpe_49k.json"), 64).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict().keys() == set(range(len(TEXTS)))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 64 and (g.offset == g.length.cumsum() - g.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2
    assert packing.best_fit_packing(empty(spark), P.path("word_bpe_49k.json"), 64).count() == 0


def test_packing_of_repeated_ids_and_open_bins(spark):
    path, text = P.path("word_bpe_49k.json"), " ".join(["the"] * 19)
    for one in (True, False):
        df = spark.createDataFrame([(None if one else i, text) for i in range(320)], "doc_id long, text string")
        cut = common.stored(packing.pieces(df.repartition(3), path, 64), "pieces")
        got = packing.pack(cut, 64, island=32).toPandas()
        assert len(got) == 320 and got.length.nunique() == 1
        # no island holds all rows of one id, and islands do not keep an open bin each
        assert got.groupby(got.sequence_id // 65536).length.count().max() <= 64
        assert got.sequence_id.nunique() == -(-320 // (64 // got.length[0]))
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.length.sum() <= 64 and (g.offset == g.length.cumsum() - g.length).all()


def test_language(spark):
    rows = [(i, ("the and of " if i % 2 else "der die und ") * (i % 7 + 1), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34", None)], "doc_id long, text string, lang string")
    got = {r["id"]: r for r in langid.predict(df, langid.train(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert langid.train(df.where("false")) is None
    assert langid.predict(df, None).where("lang_pred <> 'und'").count() == 0


def page(host, body):
    return f"http://{host}/x", f"<html><body><nav><a href='/'>Home</a></nav>{body}<footer>foot</footer></body></html>"


def test_main_text(spark):
    pages = [page("a.org", f"<div class='top'>Welcome to us</div><div id='b'><p>Story {i} &amp; more</p><p>x\n y</p></div>"
                  "<div class='sidebar'>more</div>") for i in range(8)]
    pages += [page("b.org", "<article><h1>T</h1><p><b>one<br><p>two</p><script>var a='</p>'</script>"
                            "<div class='ad'>buy</div></article>"), (None, None), ("odd", ""), page("b.org", "")]
    rows = [(i, u, h, "z") for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["id"]: r["text"] for r in html.extract(df).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i} & more\nx y" for i in range(8)]
    assert [got[i] for i in range(8, 12)] == ["T\none\ntwo", "", "", ""]
    assert html.extract(df.where("false")).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html.extract(df).orderBy("id").collect()]


def test_main_text_of_mixed_blocks(spark):
    # no article element; paragraphs hold most of the text that varies
    long = "long paragraph words " * 9
    body = ("<div class='slogan'>All of us</div><div><h1>Title {0}</h1><p>{1}{0}</p><p>more {0}</p><h2>Part {0}</h2>"
            "<ul><li>item {0}</li></ul><table><tr><th>Head {0}</th><td>cell {0}</td></tr></table>{2}</div>")
    got = texts_of(spark, [page("m.org", body.format(i, long, f"<blockquote>said {i}</blockquote>" if i == 5 else ""))
                           for i in range(9)])
    for i, text in enumerate(got):
        want = [f"Title {i}", f"{long}{i}", f"more {i}", f"Part {i}", f"item {i}", f"Head {i}", f"cell {i}"]
        assert text.split("\n") == want + ([f"said {i}"] if i == 5 else [])
    # what stands beside the container, and on some pages only
    lead = "<h1>T{0}</h1>{2}<div><p>{1}{0}</p></div>"
    got = texts_of(spark, [page("l.org", lead.format(i, long, f"<div class='x'>lead {i}</div>" if i % 3 == 2 else ""))
                           for i in range(9)])
    for i, text in enumerate(got):
        assert text.split("\n") == [f"T{i}"] + ([f"lead {i}"] if i % 3 == 2 else []) + [f"{long}{i}"]


def test_main_text_keeps_text_in_template_places(spark):
    body = "<div class='top'>{1}</div><div id='b'><h2>Shared</h2><p>Story {0} and what came of it</p></div>"
    # one page of twelve has other text where the template stands
    got = texts_of(spark, [page("t.org", body.format(i, "Corrected" if i == 11 else "Welcome")) for i in range(12)])
    assert got == [("Corrected\n" if i == 11 else "") + f"Shared\nStory {i} and what came of it" for i in range(12)]
    # near copies of one article, other articles, and subheadings that all of them share
    for tag in ("article", "div"):
        near = "<{3}><h2>Shared</h2><p>{0}</p></{3}><div class='x'>{2}</div>"
        same = "the same long body of one article, copied again and again"
        pages = [page("n.org", near.format(same if i < 27 else f"another article, number {i}, as long as that, or more",
                                           0, f"note {i}", tag)) for i in range(30)]
        for i, text in enumerate(texts_of(spark, pages)):
            p = same if i < 27 else f"another article, number {i}, as long as that, or more"
            assert text.split("\n") == ["Shared", p] + ([f"note {i}"] if tag == "div" else [])
    # part of a sentence that all pages share
    got = texts_of(spark, [page("s.org", f"<div class='c'><p>By <a href='#'>Author {i}</a></p></div>"
                                f"<div class='d'>text {i}</div><div class='e'>All rights</div>") for i in range(9)])
    assert got == [f"By Author {i}\ntext {i}" for i in range(9)]


def test_main_text_of_several_articles(spark):
    parts = ("<main><article class='teaser'><div><div><h2>Elsewhere</h2></div></div></article><h1>Title</h1>"
             "<article><h2>One</h2><p>first part, the longest of them all</p></article>"
             "<article><p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here</p></article>"
             "<article class='comment'><p>me too</p></article>"
             "<article><h3><a href='/o'>Other page</a></h3><p>teaser</p></article></main>")
    assert texts_of(spark, [page("p.org", parts), page("q.org", "<article>one</article>")]) == [
        "Title\nOne\nfirst part, the longest of them all\nsum x+1 here", "one"]


def test_vectors(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(40, 8))
    rows = []
    for i in range(300):
        v = base[rnd.integers(40)] + rnd.normal(size=8) * 0.15
        rows.append((i, [float(np.float32(x)) for x in v], int(rnd.integers(2))))
    rows += [(300, rows[0][1], rows[0][2]), (301, None, 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1),
             (304, rows[0][1], None), (305, [None] * 8, 0), (306, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, 0.93).collect()}
    want = brute.cosine_links(rows, 0.93)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_of_repeated_ids_and_many_lists(spark):
    close = [[1.0, 0.01 * i, 0.0] for i in range(3)]
    rows = [(7, v, 1) for v in close] + [(None, [0.0, 0.01 * i, 1.0], 1) for i in range(2)] + [(9, [-1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in vectors.near_vectors(df).collect())
    assert got == [(0, 1, 0)] * 2 + [(7, 2, 7)] * 3 + [(9, 0, 9)]
    # more lists than probes
    rnd = np.random.default_rng(6)
    x = (rnd.normal(size=(500, 16))[rnd.integers(500, size=4000)] + rnd.normal(size=(4000, 16)) * 0.15).astype(np.float32)
    assert len(x) // vectors.PER_LIST > vectors.PROBES
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                               "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, 0.93).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(want.tolist())) and sum(got.values()) >= 0.9 * want.sum()


def test_pipeline_keeps_columns(spark, docs):
    import corpus_pipeline
    rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.stored(stage(spark, d, ""), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert d.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, d, "").count() >= d.count()


def test_main_text_structure_over_words():
    p = "<p>long words of the main text here</p><p>and more of them</p>"
    want = "T\nlong words of the main text here\nand more of them"

    def read(h):
        return html.read_text(html.parse(h), {})

    for page_ in (f"<body class='has-sidebar'><h1>T</h1>{p}</body>",
                  f"<div class='with-sidebar layout'><h1>T</h1>{p}</div>",
                  f"<form action=x><h1>T</h1>{p}<input name=a><button>Go</button></form>",
                  f"<form><article><h1>T</h1>{p}</article></form>",
                  f"<div class='menu'><article><h1>T</h1>{p}</article></div>",
                  f"<div class=post><header><h1>T</h1></header>{p}</div>",
                  f"<header><h1>Site</h1></header><div><h1>T</h1>{p}</div>",
                  f"<div id=sidebar><p>x</p></div><h1>T</h1>{p}<div class='comments-area'><p>{'me too ' * 90}</p></div>",
                  f"<div class=sidebar><article>{'a teaser ' * 40}</article></div><article><h1>T</h1>{p}</article>",
                  f"<article><h1>T</h1>{p}<form><input>Name</form><div id='comments'>hi</div><p class=ad>buy</p></article>"):
        assert read(page_) == want, page_
    # class and id words of the article's own parts
    assert read("<article><h2 id='related-work'>a</h2><section id='menu-prices'><p>b</p></section><p class='share-price'>"
                "c</p><p class='social history'>d</p><div id='comment-policy'>e</div></article>") == "a\nb\nc\nd\ne"
    # references are decoded within their own text node
    assert read("<p>a &<b>lt;</b> b &amp; c &lt; d</p>") == "a &lt; b & c < d"
    assert read("<div class='ad'><p>buy</p></div>") == read("<nav>a</nav><footer>b</footer>") == ""


def test_main_text_of_hosts_with_an_odd_first_page(spark):
    body = "<div class='slogan'>All of us</div><div class='post'><h1>T{0}</h1><p>story {0}</p></div><div class='legal'>(c)</div>"
    odd = ("http://o.org/login", "<html><body><div class='login'><p>Please sign in</p></div></body></html>")
    got = texts_of(spark, [odd] + [page("o.org", body.format(i)) for i in range(10)])
    assert got == ["Please sign in"] + [f"T{i}\nstory {i}" for i in range(10)]
    # two layouts of one host, each with its own template
    got = texts_of(spark, [page("w.org", (body if i % 2 else "<div class='x'>Lab</div><section><h1>N{0}</h1></section>")
                                .format(i)) for i in range(16)])
    assert got == [f"T{i}\nstory {i}" if i % 2 else f"N{i}" for i in range(16)]
