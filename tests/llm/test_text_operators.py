"""Chat formatting, quality rules, URL filters, mixing and licence scans on small tables with awkward rows."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, licences, mixing, quality, urlfilter

DOCS = "doc_id long, text string, source string, lang string, n_words string"


# chat


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\\\[ROLE]", "[INST", "]<s", "<<SYS>><</SYS>>[/TURN]", "", "a\r\n\u2028\x85b", "\U0001f642[/INST]\\"]
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "yes", "x"), (2, None, None, "no turn", "x"), (None, 0, "user", "alone", "x"), (None, 0, "user", "alone", "x"), (3, 0, "[ROLE]odd\\", "t", "x"), (4, 0, "user", "u" * 200_000, "x")]
    rows += [(9, i, ["user", "assistant", "tool"][i % 3], t, "x") for i, t in enumerate(hostile)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = Counter(tuple(r) for r in chat.chat_digest(chat.format_chats(df)).drop("formatted_chars").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(conv, turns, valid):
        said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        return conv, len(turns), sha(said), len(loss), sha(loss), valid

    nine = [(["user", "assistant", "tool"][i % 3], t) for i, t in enumerate(hostile)]
    assert got == Counter(
        [want(1, [("user", None), ("assistant", "yes")], True), want(2, [(None, "no turn")], False), want(None, [("user", "alone")], True), want(None, [("user", "alone")], True), want(3, [("[ROLE]odd\\", "t")], False), want(4, [("user", "u" * 200_000)], True), want(9, nine, False)]
    )
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_machine(spark):
    t = chat.DEFAULT
    assert not any(c[1:].count("[") + c[1:].count("<") > 1 or "\\" in c for c in t.controls())
    orders = [("user", "assistant"), ("system", "user", "assistant", "user"), ("assistant",), ("user", "user"), ("system",), ("user", "system")]
    df = spark.createDataFrame([(i, k, r, "x") for i, o in enumerate(orders) for k, r in enumerate(o)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.error_turn) for r in chat.format_chats(df).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, None), 5: (False, 1)}


# quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#|\u00e9\u2028 \n\t\x0b", max_size=80))
def test_base_counts(text):
    chars, symbols, lines = quality.base_counts(text.encode())
    codes, starts, hashes = quality.coded(pa.array([None, text, "a b"]))
    assert starts.tolist() == [0, 0, len(codes) - 2, len(codes)] and len(set(hashes.tolist())) == len(hashes)
    mine = codes[: starts[2]]
    assert (len(mine), chars, symbols, lines, quality.repeated_words(mine, len(hashes))) == brute_base(text)
    assert quality.repeated_words(mine, 1 << 21) == brute_base(text)[4]


def test_quality_judges_all(spark):
    good = " ".join(f"w{i % 37} x{i % 11}" for i in range(60))
    junk = " ".join(f"#{i}$ %{i * 7}" for i in range(60))
    rows = [(1, good, "s", "a", "z"), (2, good + " more", "s", "a", "z"), (3, junk, None, "a", "z"), (4, None, "s", "a", "z"), (5, "", "s", "a", "z"), (6, "a b " * 100, "s", "a", "z"), (None, good, "s", "a", "z"), (2, good + " more", "s", "a", "z"), (8, "long " * 60_000, "s", "a", "z")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 0), (77, 1, 0), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_base(t)) for i, t, *_ in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[2] and not kept[4] and not kept[5] and not kept[6] and not kept[8]
    stay = quality.judge(docs, labels, keep_rows=True)
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert all(r.score == 0 for r in quality.judge(docs, labels.limit(0)).collect())
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_scores_match_brute_force(spark):
    import math

    rng = np.random.default_rng(5)
    text = lambda words: " ".join(words[int(i)] for i in rng.integers(0, len(words), 150))
    clean, junk = [f"w{i}" for i in range(300)], [f"#{i}%" for i in range(40)]
    rows = [(i, text(junk if i % 5 == 4 else clean), "s", "a", "z") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2) if i % 5 != 4], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(0, 60, 2) if i % 5 != 4}
    h = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    grams = {}
    for i, t, *_ in rows:
        hs = [h(w) for w in t.split()]
        grams[i] = [x % 65536 for x in hs] + [(31 * x + y + 7) % 65536 for x, y in zip(hs, hs[1:])]
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in trusted for b in grams[i])
    prior, got = quality.PRIOR * 65536, {r.doc_id: r.score / quality.SCALE for r in quality.judge(docs, labels).collect()}
    for i, g in grams.items():
        own, t_all, total = Counter(g), sum(target.values()) - (len(g) if i in trusted else 0), 0.0
        n = sum(raw.values()) - len(g)
        for b in g:
            r, t = raw[b] - own[b], target[b] - (own[b] if i in trusted else 0)
            total += math.log((t * n + prior * r) / (r * (t_all + prior))) if r else 0
        assert got[i] == pytest.approx(total / len(g), abs=1e-4)
    assert min(s for i, s in got.items() if i % 5 != 4) > max(s for i, s in got.items() if i % 5 == 4)


# urls

hosts = st.sampled_from(["net", "example.net", "a.EXAMPLE.com", "org", "x.org", "notexample.net", "example.net.evil", "", "ads.x.io"])
paths = st.text(alphabet="/adensfr?#.*", max_size=14)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http://", "", "x://"]), hosts, paths), max_size=8))
def test_automaton_agrees_with_regexes(parts):
    urls = ["".join(p) for p in parts]
    globs = [r.glob for r in urlfilter.RULES] + list(urlfilter.BLOCK_GLOBS) + ["a?c*", "**", "*", "?" * 70 + "**"]
    machine = urlfilter.ShiftAnd(globs)
    assert machine.words > 1
    texts = [f".{h}{p}" for h, p in map(urlfilter.split_url, urls)]
    got = machine.match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for g, glob in enumerate(globs):
            assert got[i, g] == bool(re.fullmatch(urlfilter._regex(glob), t)), (t, glob)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "http://net", "https://www.example.net/en/1?a", "https://example.net/de/", "ftp://x.example.com/de/#f", "http://example.com/DE/", "s://org/fr/", "http://nett/", "http://x.y/ads/1", "h://u@net:80/", "http://" + "a" * 50_000 + ".net/"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df).collect()}
    assert [got[i] for i in range(len(urls))] == [(None, "allow")] * 3 + [("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("net/", "block")]
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


# mixing


def brute_mix(rows, weights=(1, 2, 3), epochs=3, seed="mix-1"):
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, *_ in rows]
    per = Counter()
    for r, n in zip(rows, size):
        per[r[2]] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > epochs * per[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(epochs * per[s])
            left -= target[s]
        free -= full
    return size, per, target


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(rng.integers(1, 4)) for _ in range(int(rng.integers(1, 60)))), f"s{int(min(rng.integers(9), rng.integers(9)))}", "l", "x") for i in range(900)]
    rows += [(1000, None, None, "l", "x"), (1001, "a b c", None, "l", "x"), (1002, "", "s1", "l", "x"), (None, "a b", "s1", "l", "x"), (5, rows[5][1], rows[5][2], "l", "x"), (1004, "", "empty", "l", "x"), (1005, " \n", "blank", "l", "x")]
    size, per, target = brute_mix(rows)
    taken = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 61 for s in per), (taken, target)
    # One document larger than its source's target: it is not reached, and what it leaves goes to the others by weight.
    rows.append((1003, "w " * 30_000, "s0", "l", "x"))
    docs = spark.createDataFrame(rows, DOCS)
    size, per, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((r[0], n, per[r[2]]) for r, n in zip(rows, size))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert sum(size) - 30_000 <= sum(taken.values()) <= sum(size)
    assert all(taken[s] >= target[s] - 61 for s in per if s != "s0"), (taken, target)
    assert taken["empty"] == taken["blank"] == 0
    only_blank = docs.filter("source IN ('empty', 'blank')")
    assert [(r.taken, r.target) for r in mixing.mix(only_blank).collect()] == [(0, 0.0)] * 2 and mixing.mixed_documents(only_blank).count() == 0
    again = Counter(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == Counter(tuple(r) for r in got)
    whole = mixing.mixed_documents(docs)
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert whole.columns == docs.columns and Counter(r.doc_id for r in whole.collect()) == +copies
    # Names that the operator uses itself are the caller's.
    own = docs.select("doc_id", "text", "source", *[F.lit(77).alias(c) for c in ("_times", "_last", "_copy", "_most", "_least", "_source", "row", "mine", "of", "most", "times", "col", "size", "place")])
    mixed = mixing.mixed_documents(own)
    assert mixed.columns == own.columns and all(set(r[3:]) == {77} for r in mixed.collect()) and mixed.count() == sum(copies.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "l", "x")], DOCS)
    chats = spark.sql("SELECT 1L conv_id, 0L turn, 'user' role, 'x' text")
    for df in (mixing.mix(docs), mixing.mixed_documents(docs.select("doc_id", "text", "source")), chat.chat_digest(chat.format_chats(chats))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().optimizedPlan().toString())


# licences


def test_licence_model_on_held_out_rows():
    rng = np.random.default_rng(1)
    corpus = [[f"w{int(x)}".encode() for x in rng.integers(0, 900, int(rng.integers(3, 60)))] for _ in range(600)]
    model = licences.fit_rows(*licences.training_rows(corpus[:400]))
    rows, labels, classes = licences.training_rows(corpus[400:], per_template=12, seed=99)
    top = model.probabilities(rows).argmax(1)
    assert (top == labels).mean() > 0.95
    assert (top[labels == 0] == 0).mean() > 0.98
    # Calibration: in ranges of the best probability, its mean is near the share of right answers.
    best = model.probabilities(rows).max(1)
    error = 0.0
    for k in range(10):
        some = (best > k / 10) & (best <= (k + 1) / 10)
        if some.any():
            error += some.mean() * abs(best[some].mean() - (top[some] == labels[some]).mean())
    assert error < 0.08, error


#: Opening words of notices as they stand in files; none of them is a template as a whole.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


def test_wrapped_notices_are_found_and_prose_is_not(spark):
    filler = [" ".join(f"v{(i * j) % 97}" for j in range(1, 12)) for i in range(1, 30)]
    texts, want = [], []
    for family, notice in NOTICES.items():
        for width in (40, 72, 1000):
            texts.append("\n".join(filler[:9]) + "\n\n * " + "\n * ".join(textwrap.wrap(notice, width)) + "\n\n" + "\n".join(filler[9:]))
            want.append(family)
    prose = ["the software is free and the terms of use are public", "permission was granted to copy the source of the river", "no event will be held in the public domain of the hall", "the author has waived the fee, and all copies are distributed without warranty"]
    docs = spark.createDataFrame([(i, t, "s", "a", "x") for i, t in enumerate(texts + prose)], DOCS)
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert all(got[len(texts) + k] is None for k in range(len(prose)))


def naive_scan(text, model):
    """A document by itself: every unit's probabilities by plain sums, resemblance by plain sets."""
    lines = [(k, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[.,;:()\"'\[\]!?]", b"", line.lower()))) for k, line in enumerate((text or "").encode().split(b"\n"))]
    block, numbered = 0, []
    for _, words in lines:
        if words:
            numbered.append((block, words))
        else:
            block += 1
    paragraphs = [w for _, w in numbered]
    units = [(p, k, k) for k, p in enumerate(paragraphs)]
    units += [(p[a : a + licences.WINDOW], k, k) for k, p in enumerate(paragraphs) if len(p) > licences.WINDOW for a in range(0, len(p) - licences.WINDOW // 2, licences.WINDOW // 2)]
    flat, of = [w for p in paragraphs for w in p], [k for k, p in enumerate(paragraphs) for _ in p]
    units += [(flat[a : b + 1], of[a], of[b]) for a, b in licences.spans(paragraphs, np.array([b for b, _ in numbered]))]
    found, looks = {}, set()
    for words, a, b in units:
        codes = [zlib.crc32(w) for w in words]
        z = sum(model.weights[c % licences.FEATURES].astype(float) for c in codes) + sum(model.weights[(31 * x + y + 7) % licences.FEATURES].astype(float) for x, y in zip(codes, codes[1:]))
        z = (z / np.sqrt(2 * len(codes) - 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = model.classes[int(p.argmax())]
        if family != licences.NONE:
            pairs = set(zip(words, words[1:]))
            share = max(len(pairs & set(zip(t, t[1:]))) / len(set(zip(t, t[1:]))) for t in (licences.paragraphs(x.encode())[0] for x in licences.TEMPLATES[family]))
            for k in range(a, b + 1):
                if p.max() >= licences.SURE and share >= licences.CONFIRM:
                    found.setdefault(k, set()).add(family)
                else:
                    looks.add(k)
    return len(paragraphs), len(found), len(looks - set(found)), ",".join(sorted({f for x in found.values() for f in x})) or None


def test_scan_matches_a_naive_one(spark):
    rng = np.random.default_rng(8)
    pool = [f"v{i}" for i in range(60)] + "license software the of public free under terms copy rights".split()
    model = licences.fit_rows(*licences.training_rows([[w.encode() for w in rng.choice(pool, int(rng.integers(3, 40)))] for _ in range(300)]))
    notices = [t for ts in licences.TEMPLATES.values() for t in ts] + list(NOTICES.values())
    rows = [(0, None, "s", "a", "x"), (1, "", "s", "a", "x"), (2, " \n\t\n", "s", "a", "x")]
    for i in range(3, 60):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            words = list(rng.choice(pool, int(rng.integers(1, 90))))
            if rng.random() < 0.5:
                k = int(rng.integers(len(words)))
                words[k:k] = textwrap.fill(str(rng.choice(notices)), int(rng.integers(20, 200))).split(" ")
            parts.append(" ".join(words))
        rows.append((i, str(rng.choice(["\n", "\n\n"])).join(parts), "s", "a", "x"))
    got = {r.doc_id: (r.n_paragraphs, r.n_licence, r.n_unknown, r.licences) for r in licences.scan(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got == {i: naive_scan(t, model) for i, t, *_ in rows}


def test_licence_scan(spark):
    filler = "\n".join(" ".join(f"v{(i * j) % 97}" for j in range(1, 12)) for i in range(1, 12))
    rows = [(1, filler + "\nReleased under the MIT License.\n" + filler, "s", "a", "x"), (2, filler, "s", "a", "x"), (3, None, "s", "a", "x"), (4, "\n\n", "s", "a", "x"), (5, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved.", "s", "a", "x"), (5, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved.", "s", "a", "x"), (None, "This work is licensed under the GNU General Public License, version 3.", "s", "a", "x"), (7, "word " * 60_000, "s", "a", "x"), (8, "the public general was released by all of the rights", "s", "a", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.n_paragraphs, r.licences) for r in licences.scan(docs).collect())
    assert got == Counter([(1, 23, "mit"), (2, 11, None), (3, 0, None), (4, 0, None), (5, 2, "cc-by-nc,proprietary"), (5, 2, "cc-by-nc,proprietary"), (None, 1, "gpl"), (7, 1, None), (8, 1, None)])
    assert licences.scan(docs.limit(0)).count() == 0


def test_licences_are_found_in_wrapped_and_long_texts(spark):
    filler = [" ".join(f"v{(i * j) % 97}" for j in range(1, 12)) for i in range(1, 30)]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation."
    inside = " ".join(filler) + " {} " + " ".join(filler[::-1])
    lines = gpl.split("\n")
    texts = ["\n".join(filler) + "\n\n" + gpl, "\n".join(f"# {x}" for x in lines), inside.format("Released under the MIT License."), inside.format(gpl.replace("\n", " ")), lines[0] + "\n\n" + lines[1], inside.format("x"), gpl + "\n\n" + inside.format("Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(i, t, "s", "a", "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_paragraphs, r.n_licence, r.licences) for r in licences.scan(docs).collect()}
    assert got == {0: (32, 2, "gpl"), 1: (3, 2, "gpl"), 2: (1, 1, "mit"), 3: (1, 1, "gpl"), 4: (2, 0, None), 5: (1, 0, None), 6: (4, 3, "cc-by,gpl")}


def test_spans_match_brute_force():
    rng = np.random.default_rng(5)
    pool = [w for t in licences.TEMPLATES["gpl"] + licences.TEMPLATES["mit"] for w in licences.paragraphs(t.encode())[0]]
    for _ in range(40):
        lines = []
        for _ in range(6):
            a = int(rng.integers(len(pool)))
            lines.append(pool[a : a + int(rng.integers(1, 25))] if rng.random() < 0.7 else [b"x"] * int(rng.integers(1, 60)))
        block = np.sort(rng.integers(0, 3, 6))
        words, of = [w for p in lines for w in p], np.repeat(block, [len(p) for p in lines])
        want = any(licences.resemblance(words[i : i + licences.WINDOW][: int((of[i : i + licences.WINDOW] == of[i]).sum())], f) >= licences.CONFIRM for i in range(len(words)) for f in licences.TEMPLATES)
        got = licences.spans(lines, block)
        assert bool(got) == want
        assert all(of[a] == of[b] and max(licences.resemblance(words[a : b + 1], f) for f in licences.TEMPLATES) >= licences.CONFIRM for a, b in got)


def test_features_do_not_cross_paragraphs():
    one, two = [b"a", b"b", b"c"], [b"d"]
    at, starts = licences.features([one, two])
    assert starts.tolist() == [0, 5] and len(at) == 6
    assert sorted(at[:5]) == sorted(licences.features([one])[0]) and at[5:].tolist() == licences.features([two])[0].tolist()
