"""WARC archives, token-id files, the SentencePiece lattice, the Jaccard join and top-k search on small tables with awkward rows."""

import base64
import gzip
import hashlib
import math
import os
import pathlib
import re
import subprocess
import sys
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import graph, jaccard, lattice, tokenbin, topk, warc
from lodestone.llm.common import pieces, work_path
from lodestone.llm.eliasfano import EliasFano

DOCS = "doc_id long, text string, source string, sig string, n string"

# WARC


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "x" * 30_000, "<p>one</p>", "é\r\n\r\nWARC/1.1\r\n", "<p>two</p>"]
    rows = [(i, None if i == 3 else f"http://x/{i} \n", h, "w") for i, h in enumerate(html)] + [(5, "http://x/5", "<p>one</p>", "w"), (None, "u", "<p>two</p>", "w"), (9, "u", "lone", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    path = work_path(spark, "test-warc")
    manifest = warc.write_warc(pages, path, shard_bytes=8_000, roll_bytes=200).orderBy("file").collect()
    assert len({m.shard for m in manifest}) > 1 and len(manifest) > len({m.shard for m in manifest})
    got = Counter(tuple(r)[:5] for r in warc.read_warc(spark, path).collect())
    raw = [(h or "").encode() for _, _, h, _ in rows]
    largest = {}
    for (i, *_), b in zip(rows, raw):
        largest[b] = max(largest.get(b, -1), -1 if i is None else i)
    want, used = Counter(), set()
    for (i, *_), b in zip(rows, raw):
        first = largest[b] == (-1 if i is None else i) and b not in used
        used |= {b} if first else set()
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else largest[b])] += 1
    assert got == want
    again = warc.write_warc(pages.repartition(5), work_path(spark, "test-warc"), shard_bytes=8_000, roll_bytes=200).orderBy("file").collect()
    assert again == manifest  # the same bytes
    local = pathlib.Path(re.sub("^file:/*", "/", path))
    data = gzip.decompress((local / manifest[0].file).read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and not list((local / "_temporary").iterdir())
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = Counter(r.record_type for r in warc.round_trip(pages, min_revisit_bytes=10).collect())
    assert small["revisit"] == sum(1 for _ in rows) - len(set(raw)) - 1


# token ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=1500), st.integers(0, 3))
def test_elias_fano(steps, zeros):
    values = np.cumsum([0] * zeros + steps) if zeros or steps else np.zeros(0, np.int64)
    ef = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert ef.all().tolist() == values.tolist() and len(ef) == len(values)
    for i in {*range(0, len(values), 97), len(values) - 1} if len(values) else ():
        assert ef[i] == values[i]


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 100_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < len(values) * (2 + np.log2(values[-1] / len(values)) + 0.5)


TOKENS = public_tokenizers.path("word_bpe_49k.json")
CODERS = [tokenbin.Encoder(TOKENS), tokenbin.Encoder(public_tokenizers.path("byte_bpe_50k.json"))]


def test_only_some_tokenizers_cut_at_space():
    assert [c.by_word for c in CODERS] == [True, False]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["It's.", "<|endoftext|>", "<|EndOfText|>x", "café,", "A.", "́", "İİ", "ΣΣ.", "they'll,"])), max_size=6), st.sampled_from([" ", "\n", "\t\x0b ", " "]))
def test_words_in_a_row_give_the_text_s_ids(parts, gap):
    text = gap.join(parts).encode("utf-8", "replace").decode()
    for coder in CODERS:
        assert [bytes(x) for x in coder.encode_all(pa.chunked_array([[text, None], ["", text]]))] == [coder.encode(text), b"", b"", coder.encode(text)]


def test_memory_of_words_is_bounded():
    from tokenizers import Tokenizer

    coder = tokenbin.Encoder(TOKENS, memory=1500)
    texts = [" ".join(f"Word{(i * j) % 97}." for j in range(60)) for i in range(9)]
    plain = Tokenizer.from_file(TOKENS)
    for t in texts * 2:
        assert np.frombuffer(coder.encode_all(pa.array([t]))[0], coder.kind).tolist() == plain.encode(t, add_special_tokens=False).ids
        assert coder.stems.size < 1500 + 60 * 20
    # What is remembered again and again stays right.
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode_all(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENS)
    rows = [(7, "Hello, world", "s", "g", "n"), (3, None, "s", "g", "n"), (5, "", "s", "g", "n"), (None, "no id", "s", "g", "n"), (-2, "minus", "s", "g", "n"), (7, "Hello, world", "s", "g", "n"), (7, "Another seven", "s", "g", "n"), (8, "long " * 50_000, "s", "g", "n"), (1 << 40, "<|endoftext|> x", "s", "g", "n")]
    docs = spark.createDataFrame(rows, DOCS)
    path = work_path(spark, "test-ids")
    manifest = tokenbin.write_ids(docs, path, TOKENS, shard_bytes=60).orderBy("file").collect()
    assert len(manifest) > 2
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want, at = Counter(), 0
    for i, t, *_ in order:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in tokenbin.read_ids(spark, path).collect()) == want
    whole = tokenbin.write_ids(docs, work_path(spark, "test-ids"), public_tokenizers.path("byte_bpe_50k.json"), end_id=50256).agg(F.sum("ids")).first()[0]
    assert whole == sum(len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    last = tokenbin.IdFile(path, manifest[-1].file)
    assert last.ids(last.docs - 1).tolist() == [*plain.encode("no id", add_special_tokens=False).ids, 1]
    assert [m.sha256 for m in tokenbin.write_ids(docs.repartition(6), work_path(spark, "test-ids"), TOKENS, shard_bytes=60).orderBy("file").collect()] == [m.sha256 for m in manifest]
    assert tokenbin.round_trip(docs.limit(0), TOKENS).count() == 0


# SentencePiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def unigram_model():
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(pathlib.Path(MODEL).read_bytes())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:  # the lower a merge's rank, the likelier
            p.score = -np.log(2 + min(-p.score, 40_000.0)) - 1 / len(p.piece)
    return m, SentencePieceProcessor(model_proto=m.SerializeToString())


def test_lattice_agrees_with_the_library(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    texts = ["a plain text of words", "", None, " ", "  two  spaces ", "line\nbreaks\n\n\tand tabs", "éè Ａ \U0001f642\U0001f642", "<s>x</s> <unk>", "aaaaaaaaaaaaaaaa" * 20, "x" * 30_000, "日本語 中文", "of words of words of words", "of words of words of words"]
    rows = [(i, t, "s", "g", "n") for i, t in enumerate(texts)] + [(None, "no id", "s", "g", "n")]
    docs = spark.createDataFrame(rows, DOCS)
    m, unigram = unigram_model()
    file = tmp_path / "unigram.model"
    file.write_bytes(m.SerializeToString())
    for model_file, library in ((MODEL, SentencePieceProcessor(model_file=MODEL)), (str(file), unigram)):
        model = lattice.load_pieces(model_file)
        want = Counter((i, tuple(library.encode(t or ""))) for i, t, *_ in rows)
        got = lattice.encode(docs, model)
        assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want, model.kind
        back = {r.doc_id: r.text for r in lattice.decode(got, model).collect()}
        assert back == {i: library.decode(library.encode(t or "")) for i, t, *_ in rows}
        assert all(r.decodes_back for r in lattice.digest(docs, model).collect())
        words = spark.createDataFrame([(w,) for w in ["▁words", "▁unéè\U0001f642", "▁▁▁", "\n", "z", "▁internationalization"]], "word string")
        in_batches = lattice.Lattice(model)
        for r in lattice.encode_words(words, model).collect():
            assert r.ids == np.frombuffer(in_batches.ids(pa.array([r.word.replace("▁", " ")]))[0].as_py(), "<u4").tolist(), r.word
    assert lattice.encode(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_batches_of_words_agree_with_the_library(tmp_path, kind):
    from sentencepiece import SentencePieceProcessor

    m, unigram = unigram_model()
    file = tmp_path / "unigram.model"
    file.write_bytes(m.SerializeToString())
    library = SentencePieceProcessor(model_file=MODEL) if kind == "bpe" else unigram
    table = lattice.Lattice(lattice.load_pieces(MODEL if kind == "bpe" else str(file)))
    coder, small = lattice.Coder(table), lattice.Coder(table, memory=200)
    letters = st.one_of(st.text(alphabet="aeinrst ", max_size=40), st.text(alphabet=" \n\t▁é日🙂Ａin", max_size=20), st.text(max_size=10))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(letters, st.sampled_from(["ing" * 120, " " * 300])), min_size=1, max_size=5))
    def check(texts):
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        for c in (coder, small):
            ids, starts = c.encode(pa.array(texts))
            got, want = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])], [library.encode(t) for t in texts]
            if kind == "bpe":
                assert got == want
            else:  # paths of equal scores are not told apart
                assert [sum(map(library.get_score, x)) for x in got] == pytest.approx([sum(map(library.get_score, x)) for x in want], rel=1e-5)
            assert all(c.decodes_back(ids, starts, pa.array(texts)))
            assert [x.decode() for x in c.decode(ids, starts)] == [t.replace("▁", " ") for t in texts]

    check()
    # Long words, which are taken one by one, agree with short ones, which are taken side by side.
    words = ["internationalization" * 3, "é🙂" * 20, "  ", "ingin" * 30]
    together = table.ids(pa.array(words))
    assert [table._long(w) for w in words] == together.to_pylist()


# Jaccard join


def brute_classes(rows, size=4, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = [r[0] for r in rows]
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return [(r[0], len(s), c) for r, s, c in zip(rows, sets, comp)]


@pytest.mark.parametrize(("pivots", "hot"), [(1, 100_000), (2, 5), (4, 100_000)])
def test_classes_match_brute_force(spark, pivots, hot):
    rng = np.random.default_rng(11)
    base = [f"w{int(x)}" for x in rng.integers(0, 10_000, 60)]
    rows = []
    for i in range(160):  # near copies on both sides of the threshold
        words = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[int(k)] = f"v{int(rng.integers(0, 10_000))}"
        rows.append((i * 3, " ".join(words[: int(rng.integers(52, 61))]), "s", "g", "n"))
    rows += [(1000 + i, " ".join(base[:20] + [f"u{int(x)}" for x in rng.integers(0, 10_000, 30)]), "s", "g", "n") for i in range(40)]
    rows += [(2000, None, "s", "g", "n"), (2001, " \n", "s", "g", "n"), (2002, "One two", "s", "g", "n"), (2003, "one TWO", "s", "g", "n"), (2004, "one", "s", "g", "n"), (2005, "É two", "s", "g", "n"), (2006, "é two", "s", "g", "n"), (2007, "long " * 40_000, "s", "g", "n"), (2007, "long " * 40_000, "s", "g", "n")]
    rows += [(3000 + i, " ".join(base), "s", "g", "n") for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(tuple(r) for r in jaccard.near_duplicates(docs, pivots=pivots, hot_rows=hot).collect())
    assert got == Counter(brute_classes(rows))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each_class(spark):
    words = " ".join(f"w{i}" for i in range(50))
    assert jaccard.deduplicated(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(4, words, "a", "g", "n"), (2, words + " x", "b", "g", "n"), (9, words, "c", "g", "n"), (9, words, "c", "g", "n"), (5, "lone " + words[::-1], "d", "g", "n"), (5, "lone " + words[::-1], "d", "g", "n"), (None, words, "e", "g", "n"), (7, None, "f", "g", "n"), (8, "", "f", "g", "n")]
    docs = spark.createDataFrame(rows, DOCS)
    got = jaccard.deduplicated(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or -1 for r in got.collect()) == [-1, 2, 5, 7, 8]
    # Names that the operator uses itself are the caller's.
    own = docs.select("doc_id", "text", *[F.lit(77).alias(c) for c in ("_id", "may", "stays", "nth", "row", "_may", "node", "sig", "component_id")])
    got = jaccard.deduplicated(own)
    assert got.columns == own.columns and sorted(r.doc_id or -1 for r in got.collect()) == [-1, 2, 5, 7, 8]
    assert all(set(r[2:]) == {77} for r in got.collect())


def test_pipeline_links_copies_of_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words), "a", "g", "n"), (2, " ".join(words + [f"t{i}" for i in range(22)]), "a", "g", "n"), (3, " ".join(words[:60] + [f"u{i}" for i in range(40)]), "a", "g", "n")]
    got = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]  # 96 of 118 shingles of five words; 56 of 136


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(50, 95))
def test_filters_lose_no_link(a, b, percent):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    if len(x) and len(y):
        link = 100 * len(a & b) >= percent * len(a | b)
        assert jaccard.similar(x, y, percent) == link
        lines = [np.frombuffer(jaccard.outline(jaccard._spread(z)), np.uint8) for z in (x, y)]
        assert jaccard.gaps(*lines) <= len(a ^ b)
        if link:
            common = min(a & b)
            assert jaccard.may_link(len(a), sorted(a).index(common), len(b), sorted(b).index(common), percent)
            assert common in sorted(a)[: jaccard._prefix_length(len(a), percent)]


def test_outlines_of_long_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    x = np.unique(base[:4000])
    lengths, gaps = set(), []
    for y in (np.unique(base[400:]), np.unique(base[:5000]), np.unique(base[2000:]), np.unique(rng.integers(0, 1 << 63, 4100).astype(np.uint64))):
        lines = [np.frombuffer(jaccard.outline(s), np.uint8)[None, :] for s in (x, y)]
        short = min(z.shape[1] for z in lines)
        lengths.add(lines[1].shape[1])
        gaps.append(int(jaccard.gaps(*[jaccard.folded(z, short) for z in lines])[0]))
        assert gaps[-1] <= len(np.setxor1d(x, y))
    assert len(lengths) == 2 and gaps[3] > 4 * 0.111 * 2000  # unrelated sets are told apart, whatever their length
    assert all(abs(math.floor(math.log(n) / math.log(100.001 / 80)) - math.floor(math.log(-(-80 * n // 100)) / math.log(100.001 / 80))) <= 1 for n in range(2, 5000))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(60)] + [(None, 3)]
    comp = {x: x for ab in links if None not in ab for x in ab}
    for _ in range(len(comp)):
        for a, b in links:
            if a is not None:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in comp.items()}


# top-k


def brute_top(rows, every, k):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)))
    longest = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, longest - len(v)))) for i, v in good]
    out = Counter()
    for n, (q, v) in enumerate(good):
        if q is not None and q % every == 0:
            scores = sorted(((-int(w @ v), i is None, i or 0, i) for m, (i, w) in enumerate(good) if m != n))[:k]
            out.update((q, r, i, -s) for r, (s, _, _, i) in enumerate(scores, 1))
    return out


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(60)]
    rows += [(61, rows[10][1]), (62, rows[10][1]), (10, rows[10][1]), (10, rows[11][1]), (None, rows[20][1]), (63, None), (64, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (65, [float("nan")] * 6), (70, [float("inf")] * 6), (80, [0.0] * 6), (90, []), (100, [3.0, -1.0]), (101, [2.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label string, score int").select("vec_id", topk.quantized().alias("v"))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, pivots=8, candidates=blocks[0], queries=blocks[1])
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, 10, 5)
    few = topk.top_k(df.filter("vec_id IN (20, 21, 22)"), F.col("vec_id") % 10 == 0, candidates=blocks[0])
    empty = topk.top_k(df.filter("vec_id = 90"), F.col("vec_id") % 10 == 0).union(topk.top_k(df.filter("vec_id IN (90)").union(df.filter("vec_id = 90")), F.col("vec_id") % 10 == 0))
    assert [tuple(r) for r in empty.collect()] == [(90, 1, 90, 0)] * 2
    assert few.count() == 2 and topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_leave_candidates_out():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 200
    c = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 16)) * 5).astype(np.int64)
    m2 = int((c * c).sum(1).max())
    pivots = topk._extended(c[::50], m2)
    q = c[7:8]
    qd = topk._distances(np.hstack([q.astype(float), [[0.0]]]), pivots)
    found, evaluated = topk.block_top(q, qd, c, topk._distances(topk._extended(c, m2), pivots), np.arange(2000), [np.array([7])], m2, 5, np.array([-(10**9)]), step=64)
    want = sorted((-int(s), i) for i, s in enumerate(c @ q[0]) if i != 7)[:5]
    assert [(-s, j) for j, s in found[0]] == want and evaluated < 1000


# work tables


def test_work_tables_can_be_cleared(spark):
    from lodestone.llm.common import clear_work, saved

    kept = saved(spark.range(5).toDF("x"), "test-clear")
    file = pathlib.Path(re.sub("^file:/*", "/", kept.inputFiles()[0]))
    assert kept.count() == 5 and file.exists()
    clear_work(spark)
    assert not file.exists()


# the pipeline


def test_pipeline_decodes_what_it_encodes(spark):
    docs = spark.createDataFrame([(1, "Some  text, é\n\U0001f642", "s", "g", "n"), (2, None, "s", "g", "n"), (3, "", "s", "g", "n")], DOCS)
    stage = corpus_pipeline.STAGES[3][1]
    pieces = lattice.load_pieces(MODEL)
    assert {(r.doc_id, r.decodes_back) for r in stage(spark, docs, "").collect()} == {(r.doc_id, r.decodes_back) for r in lattice.digest(docs, pieces).collect()} == {(1, True), (2, True), (3, True)}
    coder = lattice.Coder(lattice.Lattice(pieces))
    ids, starts = coder.encode(pa.array(["a\u2581b", "c"]))
    assert coder.decodes_back(ids, starts, pa.array(["a b", "d"])) == [True, False]


def test_stages_return_the_columns_of_documents(spark):
    words = lambda seed: " ".join(f"w{int(x)}" for x in np.random.default_rng(seed).integers(0, 500, 80))
    rows = [(i, words(i // 2), "en", f"s{i % 3}", 400) for i in range(40)] + [(100, "too short", "en", "s0", 9), (101, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = work_path(spark, "test-pipeline")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 3:
            assert out.columns == docs.columns
            ids = sorted(r.doc_id for r in out.collect())
            assert ids == list(range(40)) if k == 0 else set(ids) <= set(range(0, 40, 2))
            assert k != 1 or ids == list(range(0, 40, 2))
            docs = out
    from sentencepiece import SentencePieceProcessor

    library, texts = SentencePieceProcessor(model_file=MODEL), {r[0]: r[1] for r in rows}
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in out.collect())
    assert corpus_pipeline.run(spark, path).count() == len(ids)


def test_pipeline_runs_on_awkward_tables(spark):
    words = lambda seed: " ".join(f"w{int(x)}" for x in np.random.default_rng(seed).integers(0, 500, 80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, row int, may int, times int"
    rows = [(i, words(i // 2), "en", None if i % 3 else "s", 400, 7, 7, 7, 7) for i in range(30)] + [(None, words(99), "en", "s", 9, 7, 7, 7, 7), (40, None, None, None, None, 7, 7, 7, 7), (41, "", "en", "blank", 0, 7, 7, 7, 7), (42, "long " * 30_000, "en", "s", 0, 7, 7, 7, 7)]
    for name, table in (("some", rows), ("none", [])):
        path = work_path(spark, f"test-awkward-{name}")
        spark.createDataFrame(table, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and all(set(r[5:]) == {7} for r in out.collect())
        folder = pathlib.Path(re.sub("^file:/*", "/", work_path(spark, "x"))).parent
        before = set(folder.iterdir())
        got = corpus_pipeline.run(spark, path).collect()
        assert sorted(p.name.split("-")[1] for p in set(folder.iterdir()) - before) == sorted(n.split(" ")[0].split("-")[0] for n, _ in corpus_pipeline.STAGES)
        assert all(r.decodes_back for r in got) and {r.doc_id for r in got} <= {*range(0, 30, 2), None} and bool(got) == bool(table)


# memory of workers

_WORKER = """
import re, sys
import numpy as np, pyarrow as pa, public_tokenizers
from lodestone.llm import jaccard, lattice

class Docs:
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        self.run = run

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

docs, rng = Docs(), np.random.default_rng(3)
if sys.argv[1] == "lattice":
    lattice.encode(docs, lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model")), read_back=True)
else:
    jaccard.prefixes(docs, np.zeros(jaccard.COUNTS, np.int64), 5, 80, 100_000)
texts = [" ".join(f"{w:x}ab" for w in rng.integers(0, 200_000, 500)) for _ in range(8000)]
batches = [pa.record_batch({"doc_id": pa.array(range(4000)), "text": pa.array(texts[k : k + 4000])}) for k in (0, 4000)]
before = held()
rows = sum(b.num_rows for batch in batches for b in docs.run(iter([batch])))
print(rows, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux's own figures")
@pytest.mark.parametrize("step", ["lattice", "jaccard"])
def test_a_worker_gives_its_memory_back_after_a_task(step):
    rows, left = subprocess.run([sys.executable, "-c", _WORKER, step], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2]).stdout.split()[-2:]
    assert int(rows) == 8000 and int(left) < 30


def test_pieces_keep_every_row_in_order():
    texts = [None, "", "x" * 10, "é" * 7, "y" * 300, None, "z"]
    batches = [pa.record_batch({"k": pa.array(range(7)), "text": pa.array(texts, kind)}) for kind in (pa.string(), pa.large_string())]
    for batch in [*batches, batches[0].slice(2, 4), batches[0].slice(0, 0)]:
        tables = list(pieces([batch], 20))
        assert [r for t in tables for r in t.to_pylist()] == batch.to_pylist()
        assert all(sum(len((x or "").encode()) for x in t["text"].to_pylist()[1:]) <= 20 for t in tables)
