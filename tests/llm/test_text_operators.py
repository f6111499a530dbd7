"""Secrets, licences, personal data, language model, mixing, quality: against plain Python, and on awkward input."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from plotsage.llm import licenses, lm, mixing, pii, quality, queries, secrets

BLANK = r"[\x20\x09-\x0D]+"


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


# --- secrets ---------------------------------------------------------------------------------------------------------


def base_secrets(text):
    # a-z matched letter by letter: no folding beyond ASCII
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(x[2] for x in sorted(out))


def test_secret_base_equals_plain_search(spark, corpus):
    draw = random.Random(3)
    bits = ["token", "=", '"', " ", ":", "abcdef0123456789", "AKIA", "ABCDEFGH12", "secret", "K", "ſ", "PassWord", "Api_key", "é😀", "x" * 5]
    rows = [(i, "".join(draw.choice(bits) for _ in range(60))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    got = secrets.digest(secrets.find(df)).collect()
    same([(r.doc_id, r.base_sha256) for r in got], [(d, hashlib.sha256(base_secrets(t).encode()).hexdigest()) for d, t in pairs(df)])
    for r in got:
        assert {s for s in r.spans.split(",") if not s.startswith("random")} - {""} == {s for s in r.spans.split(",") if s[:3] in ("ass", "acc", "hex")}


def test_random_words_are_found_and_ordinary_ones_left(spark):
    draw = random.Random(4)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = ["".join(draw.choice(symbols) for _ in range(40)) for _ in range(60)]
    rows = [(i, f"é😀 some words {k} more") for i, k in enumerate(key)]
    rows += [(1000 + i, f"release-2024-candidate_{i}_final internationalization{i} https://example.org/some/long/path/{i}/index") for i in range(300)]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i in range(60) if got[i].more]
    assert len(found) >= 57
    assert all(rows[i][1][s.start : s.end] == key[i] for i in found for s in got[i].more)
    assert not any(got[d].more for d in got if d >= 1000)


def test_words_of_one_class_and_sequences(spark):
    """Random words of letters alone are found; ordered and woven sequences are not, however even their symbols."""
    draw = random.Random(14)
    letters = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64)) for _ in range(40)]
    rows = [(i, f"the words before {w} and the words after it") for i, w in enumerate(letters)]
    woven = ["a1b2c3d4e5f6g7h8i9j0k1", "aB1cD2eF3gH4iJ5kL6mN7", "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcdefghijkl"]
    rows += [(100 + i, f"see {w} here") for i, w in enumerate(woven)]
    rows += [(200 + i, "an ordinary report about the quality of water in the northern districts and the income of farms " * 3 + "northerndistrictsandtheincomeoffarmsaboutthequalityofwaterinthem") for i in range(40)]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i].more) for i in range(40)) >= 38
    assert not any(got[d].more for d in got if d >= 100)


def combined(words, name):
    return secrets.sidak(secrets.battery(secrets.measured(words, name)).T)


def test_battery_on_random_and_regular_symbols():
    draw = random.Random(5)
    p = combined(["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(2000)], "hex")
    assert (p < 0.05).mean() < 0.09  # near its level
    low = lambda w, name: combined([w], name)[0]
    assert low("0123456789abcdef" * 4, "hex") < 1e-3 and low("aaaa1111" * 5, "hex") < 1e-6
    assert low("abcdefghijklmnopqrstuvwxyz", "lower") < 1e-3
    p = secrets.sidak(np.array([[1e-8], [1.0], [0.5]]))
    assert 1e-8 < p[0] < 4e-8  # no dull test makes up for a telling one


def test_battery_equals_plain_tests():
    draw = random.Random(15)
    for name in ("hex", "base62"):
        k, n = len(secrets.ALPHABETS[name]), 24
        words = ["".join(draw.choice(secrets.ALPHABETS[name]) for _ in range(n)) for _ in range(20)]
        x = np.array([[secrets.ALPHABETS[name].index(c) for c in w] for w in words])
        for got, row in zip(secrets.battery(secrets.statistics(x, k)), x.tolist(), strict=True):
            two = lambda z: math.erfc(abs(z) / math.sqrt(2))
            chi = sum((row.count(v) - n / k) ** 2 / (n / k) for v in range(k))
            up = [v >= k / 2 for v in row]
            u, d = sum(up), n - sum(up)
            mean = 1 + 2 * u * d / n
            runs = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
            serial = [two(sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(row, row[j:], strict=False)) / ((k * k - 1) / 12 * math.sqrt(n - j))) for j in (1, 2, 3, 4)]
            want = [two((chi - k + 1) / math.sqrt(2 * (k - 1) * (n - 1) / n)), two((runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))), 1 - (1 - min(serial)) ** 4]
            assert np.allclose(got, want)


ORDINARY = {"lower": [("water", 5), ("report", 3), ("northern", 2)], "capital": [("Income", 2), ("District", 1)], "upper": [("FARM", 2), ("QUALITY", 1)], "digit": [("2020", 1), ("15", 3)]}


def test_score_is_the_ratio_of_two_normal_laws():
    found = secrets.law(ORDINARY, "base36:24")
    z = secrets.measured(secrets.random_words("base36", 24, 30) + secrets.null_words(ORDINARY, "base36", 24, 30), "base36")

    def log_density(row, words):
        sample = np.clip(secrets.measured(words, "base36"), -8, 8)
        mean = [sum(c) / len(c) for c in sample.T]
        spread = np.array([[sum((a - m) * (b - o) for a, b in zip(c, d, strict=True)) / (len(c) - 1) + 0.1 * (m is o) for d, o in zip(sample.T, mean, strict=True)] for c, m in zip(sample.T, mean, strict=True)])
        off = np.clip(row, -8, 8) - mean
        return -0.5 * (off @ np.linalg.solve(spread, off) + math.log(np.linalg.det(spread)))

    even, usual = secrets.random_words("base36", 24), secrets.null_words(ORDINARY, "base36", 24)
    assert np.allclose(found.score(z), [log_density(row, even) - log_density(row, usual) for row in z])
    assert list(found.null) == sorted(found.null) and len(found.null) == secrets.NULL_WORDS
    assert all(secrets.encoding(w) == "base36" and len(w) == 24 for w in even)


def test_limits_follow_benjamini_and_hochberg():
    """The threshold of a stratum is the least score at which expected false discoveries are a hundredth of those found."""
    null = secrets.law(ORDINARY, "base36:40").null
    draw = np.random.default_rng(3)
    for planted in (0, 1, 30):
        score = np.concatenate([draw.choice(null, 500), draw.normal(15, 4, size=planted)])
        bins = np.floor(np.clip(score, -secrets.BIN, 40) / secrets.BIN).astype(int)
        least = secrets.least_passing(dict(zip(*np.unique(bins, return_counts=True), strict=True)), null, 0.01)
        edge = np.quantile(null, 0.95)
        excess = max((null[null > edge] - edge).mean(), 0.5)
        chance = lambda v: max((null >= v).mean(), 0.05 * math.exp(-(v - edge) / excess) if v > edge and (null >= v).mean() < 0.05 else 0)
        passing = [b * secrets.BIN for b in np.unique(bins) if b >= 0 and chance(b * secrets.BIN) * len(score) <= 0.01 * (bins >= b).sum()]
        assert least == min(passing, default=None)
    assert least is not None


def test_recall_of_planted_words_and_false_discoveries(spark, sf_dir):
    """Among documents that few ordinary words make up: nine in ten random words are found where they are long, three in four where they are not."""
    draw = random.Random(21)
    kinds = {("base62", 20): 60, ("base62", 32): 60, ("base64", 44): 60, ("base32", 26): 60, ("HEX", 32): 60}
    rows, kind_of = [], {}
    for kind, n in kinds.items():
        for _ in range(n):
            word = "".join(draw.choice(secrets.ALPHABETS[kind[0]]) for _ in range(kind[1]))
            kind_of[len(rows)] = kind
            rows.append((len(rows), f"the report says {word} about it"))
    parts = ["water", "quality", "northern", "district", "income", "farm", "Report", "Annual", "System", "FARM", "DATA", "2020", "15", "7", "of", "the"]
    for _ in range(600):
        joint = draw.choice(["", "-", "_", "/", ""])
        rows.append((len(rows), f"about the {joint.join(draw.choice(parts) for _ in range(draw.randrange(4, 9)))} of water and 15 farms of the North District in 2020, DATA and income"))
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(given)
    got = {r.doc_id: r.more for r in secrets.find(docs).collect()}
    found = collections.Counter(kind_of[d] for d, more in got.items() if more and d in kind_of)
    for kind, n in kinds.items():
        assert found[kind] >= (0.75 if kind in (("base62", 20), ("base32", 26)) else 0.9) * n, (kind, found)
    # these identifiers are put together of few words, unlike the null: up to three in a hundred reports are false, and one with odds of 100
    false = lambda got: sum(bool(more) for d, more in got.items() if d not in kind_of)
    assert false(got) <= 0.03 * sum(map(bool, got.values()))
    sure = {r.doc_id: r.more for r in secrets.find(docs, odds=100).collect()}
    assert false(sure) <= 0.01 * sum(map(bool, sure.values()))
    assert all(set(sure[d]) <= set(got[d]) for d in sure)


def test_null_is_made_of_all_short_words(spark):
    """Every different short word is counted, in all texts, and drawn by its share of all occurrences."""
    draw = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["".join(draw.choice(letters) for _ in range(draw.randrange(5, 9))) for _ in range(6000)]
    texts = [" ".join([*rare[i : i + 60], *["water"] * 60, "Farm", "DATA", f"{i}", "a1", "x", "w" * 16]) for i in range(0, 6000, 60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "é😀 rare1"])], "doc_id long, text string")
    counted = secrets.short_words(docs)
    want = collections.Counter(w for t in [*texts, "rare1"] for w in t.split() if 2 <= len(w) <= 15)
    assert {r.word: r.n for r in counted.collect()} == want
    drawn = secrets.drawn_words(counted, ["lower:24", "base62:20"]).collect()
    low = [r.word for r in drawn if r.stratum == "lower:24" and r.stream == "lower"]
    assert len(low) == 2 * secrets.NULL_WORDS and set(low) <= set(rare) | {"water"}
    assert abs(low.count("water") / len(low) - 0.5) < 0.04
    assert len({w for w in low if w != "water"}) > 1500  # of some 2,050 draws among 6,000 words
    kinds = {c: {r.word for r in drawn if r.stratum == "base62:20" and r.stream == c} for c in ("capital", "digit")}
    assert kinds["capital"] == {"Farm"} and kinds["digit"] == {str(i) for i in range(0, 6000, 60) if i > 9}
    assert {"Farm", "DATA", "a1", "water"} < {r.word for r in drawn if r.stream == "any"}


def test_copies_of_a_word_count_once(spark):
    """A table with every row three times has the same spans: copies lend a word no weight."""
    draw = random.Random(22)
    rows = [(i, f"the income of farms {''.join(draw.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(30))} and waterqualityofthe{i % 7}districts") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {(r.doc_id, str(r.more)) for r in secrets.find(docs).collect()}
    thrice = secrets.find(docs.unionByName(docs).unionByName(docs)).collect()
    assert len(thrice) == 180 and {(r.doc_id, str(r.more)) for r in thrice} == once and any("random" in m for _, m in once)


def test_many_secrets_in_one_text(spark):
    text = "token=abcdef0123456789 and a-long-word-with-marks " * 20_000
    got = secrets.find(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert {r.doc_id: len(r.base) for r in got} == {1: 40_000, 2: 0, 3: 0}


# --- personal data ----------------------------------------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text) if ok(k, m.group()))


def test_pii_base_equals_plain_search(spark, corpus):
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice("a1234567890..@-_ %+() é\n") for _ in range(draw.randrange(300)))) for i in range(800)]
    rows += [(9000, "a@b.c_d@e.f x@y.z.@q.w"), (9001, "1 " * 9000), (9002, "😀 4111 1111 1111 1111 é a@b.co"), (9003, "000.00255.1.256 001.2.3.255"), (9004, "+1 (234) 555-1234")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    got = pii.digest(pii.find(df)).collect()
    same([(r.doc_id, r.base_sha256) for r in got], [(d, hashlib.sha256(base_pii(t).encode()).hexdigest()) for d, t in pairs(df)])
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got}
    assert counts[9002] == (1, 0, 1, 0) and counts[9004][3] == 1


def test_pii_contexts_discover_unseen_identifiers(spark):
    """Mails behind 'write to' make that a pattern; an identifier of another shape behind it is found, one elsewhere is not."""
    rows = [(i, f"please write to user{i}@mail.example.com today, order 77{i}881 is fine") for i in range(20)]
    rows += [(100, "please write to account-5512-77 today"), (101, "the number of account-5512-78 is known")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.value) for s in got[100]] == [("context", "account-5512-77")]
    assert got[101] == [] and all([s.kind for s in got[i]] == ["email"] for i in range(20))


def test_pii_contexts_may_have_as_many_unseen_values_as_seeds(spark):
    """Unseen values are no evidence against a context; values that also stand behind a context without seeds are."""
    rows = [(i, f"please write to user{i}@mail.example.com today") for i in range(10)] + [(100 + i, f"please write to account-55{i:02}-77 today") for i in range(10)]
    rows += [(200 + i, f"the sum of user{i}@other.example.com is") for i in range(10)] + [(300 + i, f"the sum of 10,{i}00 is") for i in range(10)]
    rows += [(400 + i, f"a price near 10,{i}00 is") for i in range(10)] + [(500, "the sum of 77-1234 is")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find(df).collect()}
    assert all(got[100 + i] == [("context", f"account-55{i:02}-77")] for i in range(10))
    assert not any(got[i] for i in range(300, 501) if i in got)
    assert pii.redact(df).filter("doc_id = 103").first().text == "please write to <context> today"


def plain_patterns(pairs, rounds=pii.ROUNDS, support=pii.SUPPORT, confidence=pii.CONFIDENCE):
    """The graph's scoring with dictionaries."""
    seeds, of_context, of_value = {v for _, v, s in pairs if s}, collections.defaultdict(set), collections.defaultdict(set)
    for c, v, _ in pairs:
        of_context[c].add(v)
        of_value[v].add(c)
    few = {c: len(vs) >= support and len(vs & seeds) <= (1 - confidence) * len(vs) for c, vs in of_context.items()}
    belief, doubted = dict.fromkeys(of_context, 0.0), dict(few)
    for _ in range(rounds):
        after_belief, after_doubt = {}, {}
        for c, vs in of_context.items():
            mass = against = 0.0
            for v in vs:
                others = of_value[v] - {c}
                score = 1.0 if v in seeds else 1 - math.prod(max(1 - belief[o], 1e-9) for o in others)
                mass += score
                against += (1 - score) if any(doubted[o] for o in others) else 0.0
            told = mass / (mass + against) if mass + against else 0.0
            after_belief[c] = told if mass >= support and told >= confidence else 0.0
            after_doubt[c] = few_mass(len(vs), mass, support, confidence) and not after_belief[c]
        belief, doubted = after_belief, after_doubt
    return {c for c, b in belief.items() if b > 0}


def few_mass(n, mass, support, confidence):
    return n >= support and mass <= (1 - confidence) * n


def test_pattern_graph_equals_plain_scoring(spark):
    draw = random.Random(16)
    for _ in range(3):
        pairs_ = [(f"c{draw.randrange(25)}", f"v{draw.randrange(120)}", draw.random() < draw.choice((0.05, 0.6))) for _ in range(700)]
        got = {r.context for r in pii.believed_patterns(spark.createDataFrame(pairs_, "context string, value string, seed boolean")).collect()}
        assert got == plain_patterns(pairs_)


def test_candidates_that_meet_base_spans_are_dropped(spark):
    draw = random.Random(17)
    rows = [(i, " ".join(draw.choice(["a@b.co,12345x", "(1.2.3.4)", "id-99881", "77-1234-5", "+49 170 1234567", "x1y2z3w4", "word"]) for _ in range(60))) for i in range(30)]
    spans = pii.located(spark.createDataFrame(rows, "row long, text string").select("row", pii.all_matches(F.col("text")).alias("matches")))
    every = collections.defaultdict(list)
    for r in spans.collect():
        every[r.row].append(r)
        assert rows[r.row][1][r.start : r.end] == r.value
    want = sorted((d, s.start, s.end) for d, found in every.items() for s in found if s.kind == "context" and not any(b.start < s.end and b.end > s.start for b in found if b.kind != "context"))
    assert want and want == sorted((r.row, r.start, r.end) for r in pii.without_met(spans).filter("kind = 'context'").collect())


def test_very_many_mails_in_one_text(spark):
    text = "".join(f"write to user{i}@mail.example.com or call id-{i}9988 now. " for i in range(20_000))
    row = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.n_email == 20_000


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é a@b.co now 1.2.3.4", 9, "k"), (2, None, 0, "k"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, row string")
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    assert rows[1].text == "mail é <email> now <ip>" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "clean" and pii.redact(df).columns == df.columns


def test_redaction_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(7, "to a@b.co", [5], "x")], "row long, text string, spans array<int>, _row string")
    assert [tuple(r) for r in pii.redact(df).collect()] == [(7, "to <email>", [5], "x")]


# --- licences ------------------------------------------------------------------------------------------------------------


def test_license_rules_need_order_and_longer_rules_win(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    names = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [(1, bsd + source + binary), (2, bsd + "Other words. " + source.replace(" the above", "\nthe above") + binary + names), (3, binary + source + bsd), (4, "prose\nReleased under the MIT License.\nmore"), (5, None), (6, "A licensed under the MIT license maker.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "", 4: "MIT", 5: "", 6: ""}


# Public wording, as the licences' own pages give it.
NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 A Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
""",
    "ISC": """ISC License

Copyright (c) 2020, A Holder <holder@example.com>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
""",
    "BSD-2-Clause": """Copyright (c) 2020, A Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "Apache-2.0": """   Copyright 2020 A Holder

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "GPL-3.0-or-later": """    A program
    Copyright (C) 2020  A Holder

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "GPL-2.0-or-later": """    Copyright (C) 2020  A Holder

    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"] + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def test_standard_notices_are_found_plain_and_in_comments(spark):
    forms = [("", "", ""), ("/*\n", " * ", " */\nint main;\n"), ("#!/bin/sh\n", "# ", "run\n")]
    rows = [(f"{name} {i}", first + "".join((mark + line).rstrip() + "\n" for line in text.splitlines()) + last) for name, text in NOTICES.items() for i, (first, mark, last) in enumerate(forms)]
    rows += [("proprietary", "Copyright 2020\nAll rights reserved.\n"), (" unlike", NOTICES["ISC"].replace("hereby granted", "hereby refused"))]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: k.split(" ")[0] for k, _ in rows}


MORE = {
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.\n",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without more.\n",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)\n",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n",
    "GPL-2.0-or-later": "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;\n",
    "CC-BY-SA-3.0": "some prose\nThis work is licensed under a Creative Commons text.\nLicensed under CC BY-SA 3.0.\n",
    "BSD-4-Clause": NOTICES["BSD-2-Clause"] + "\n3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software.\n\n4. Neither the name of the University nor the names of its contributors may\n   be used to endorse or promote products derived from this software without\n   specific prior written permission.\n",
}


def test_more_notices(spark):
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(list(MORE.items()), "doc_id string, text string")).collect()}
    assert got == {k: k for k in MORE}


REFERENCES = {
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "dual-licensed under MIT or Apache-2.0": "Apache-2.0,MIT",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "// SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)": "GPL-2.0-or-later,MIT",
    "The code is licensed under the MIT License.": "MIT",
    "Some words. The whole project is also distributed\nunder the GNU GPL version 3; see COPYING.": "GPL-3.0",
    "We release this code under the MIT License, see LICENSE.": "MIT",
    "License: MIT": "MIT",
    "License: BSD-3-Clause AND Zlib\n": "BSD-3-Clause,Zlib",
    "Mozilla Public License Version 2.0\n====\n": "MPL-2.0",
    "We like the MIT License and others.": "",
    "This is licensed under a license or MIT license": "",
    "Nobody is licensed under the MIT license of others": "",
}


def test_references_in_everyday_words(spark):
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(k, k) for k in REFERENCES], "doc_id string, text string")).collect()}
    assert got == REFERENCES


# What the licence files that systems and packages bring along are.
FILES = {
    "/usr/share/common-licenses": {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0-or-later", "GPL-3": "GPL-3.0-or-later", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1-or-later", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"},
    os.path.join(os.path.dirname(pyspark.__file__), "licenses"): {"LICENSE-AnchorJS.txt": "MIT", "LICENSE-CC0.txt": "CC0-1.0", "LICENSE-bootstrap.txt": "MIT", "LICENSE-cloudpickle.txt": "BSD-2-Clause", "LICENSE-d3.min.js.txt": "ISC", "LICENSE-dagre-d3.txt": "MIT", "LICENSE-datatables.txt": "MIT", "LICENSE-graphlib-dot.txt": "MIT", "LICENSE-join.txt": "BSD-2-Clause", "LICENSE-jquery.txt": "MIT", "LICENSE-json-formatter.txt": "Apache-2.0", "LICENSE-modernizr.txt": "MIT", "LICENSE-mustache.txt": "MIT", "LICENSE-py4j.txt": "BSD-2-Clause", "LICENSE-respond.txt": "MIT", "LICENSE-sbt-launch-lib.txt": "BSD-3-Clause", "LICENSE-xz.txt": "0BSD"},
}


def test_unmodified_license_files(spark):
    found = {os.path.join(folder, name): want for folder, names in FILES.items() for name, want in names.items() if os.path.isfile(os.path.join(folder, name))}
    if not found:
        pytest.skip("no licence files on this machine")
    rows = [(path, Path(path).read_text(errors="replace")) for path in found]
    assert {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()} == found


def test_rules_name_known_identifiers_and_order_counts():
    known = set(licenses.SENTENCES.values())
    assert len(licenses.SENTENCES) > 150 and all(i in known for _, sequence in licenses.RULES for i in sequence)
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES)
    assert all(s == " ".join(re.findall("[a-z0-9]+", s)) for s in licenses.SENTENCES)


def test_very_many_notices_in_one_text(spark):
    """A notices file of a thousand licences takes linear time; the rule that no identifier completes is tried once."""
    import time

    text = (NOTICES["BSD-2-Clause"] + "\n") * 1000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(df).first().licenses == "BSD-2-Clause"
    began = time.perf_counter()
    assert licenses.scan(df).first().licenses == "BSD-2-Clause"
    assert time.perf_counter() - began < 4


def test_license_scan_equals_sql(spark, corpus):
    import duckdb

    docs = corpus.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(licenses.scan_sql()).fetchall()
    same([tuple(r) for r in licenses.scan(corpus).select("doc_id", "sentences", "licenses", "n_licenses").collect()], [(None if d != d else d, *rest) for d, *rest in want])


# --- language model ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_plain_counts(spark, corpus, order):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(d, ["<s>", *[w for w in re.split(BLANK, t.translate(lower)) if w], "</s>"]) for d, t in pairs(corpus)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = [collections.Counter() for _ in range(order + 1)]
    for d, words in rows:
        if not held(d):
            for n in range(1, order + 1):
                counts[n].update(tuple(words[i - n + 1 : i + 1]) for i in range(n - 1, len(words)))
    n_all = sum(c for g, c in counts[1].items() if g != ("<s>",))
    types = sum(g != ("<s>",) for g in counts[1])
    want = []
    for d, words in rows:
        base = total = known = 0
        for i in range(1, len(words)):
            c = counts[1][(words[i],)]
            known += c > 0
            p = (c + 1) / (n_all + types + 1)
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                p = (counts[n][tuple(words[i - n + 1 : i + 1])] + lm.MASS * p) / (counts[n - 1][tuple(words[i - n + 1 : i])] + lm.MASS)
            total += math.log10(p)
        want.append((d, held(d), len(words) - 1, known, n_all, round(base, 6), round(total, 6)))
    got = lm.score(corpus, order).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got], want)


def test_model_beats_single_words_on_held_out_text(spark):
    draw = random.Random(8)
    after = {i: [draw.randrange(50) for _ in range(3)] for i in range(50)}
    rows = []
    for d in range(300):
        w = [draw.randrange(50)]
        for _ in range(60):
            w.append(draw.choice(after[w[-1]]))
        rows.append((d, " ".join(f"w{x}" for x in w)))
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)  # log10 of smaller size is better


def test_packing_is_a_round_trip():
    for kind in (np.uint32, np.uint64):
        values = np.random.default_rng(1).integers(0, 1 << 31, 1000).astype(kind)
        assert (lm.unpack(lm.pack(values), kind) == values).all()
        assert len(lm.unpack(lm.pack(values[:0]), kind)) == 0
    hashes = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_sorted(lm.pack_sorted(hashes)) == hashes).all()


def test_automaton_walks_its_arcs_by_hand():
    """Words a, b and END after BEGIN; training holds "a b" twice and "b" once."""
    vocabulary = np.array([lm.BEGIN, lm.END, 7, 9], np.uint64)
    texts = [[0, 2, 3, 1], [0, 2, 2, 1]]  # "a b", "a a"
    tokens, begins = np.concatenate(texts), np.array([0, 4, 8])
    text = np.repeat([0, 1], 4)
    seen = {(0,): 3, (1,): 3, (2,): 2, (3,): 3, (0, 2): 2, (2, 3): 2, (3, 1): 3}
    counts = []
    for n in (1, 2):
        hashes, ends = lm.gram_keys(vocabulary[tokens], text, n)
        _, _, one = lm.ranked(hashes)
        counts.append(np.array([seen.get(tuple(tokens[ends[i] - n + 1 : ends[i] + 1].tolist()), 0) for i in one], np.uint32))
    model = lm.Automaton(tokens, text, vocabulary, counts, 1.0, 8, 3)
    word = {2: 3 / 12, 3: 4 / 12, 1: 4 / 12}
    arc = lambda c, of, w: (c + word[w]) / (of + 1)
    want = [math.log10(arc(2, 3, 2)) + math.log10(arc(2, 2, 3)) + math.log10(arc(3, 3, 1)), math.log10(arc(2, 3, 2)) + math.log10(1 / 3 * word[2]) + math.log10(1 / 3 * word[1])]
    assert np.allclose(model.read(tokens, begins, 2), want)


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in lm.score(docs).collect()} == {"a": 3, None: 1}


# --- quality: plain scores ---------------------------------------------------------------------------------------------------


def test_scores_equal_a_plain_factorisation_machine(spark, corpus):
    """All pairs of features, one by one."""
    draw = np.random.default_rng(2)
    model = quality.Machine()
    model.bias, model.w, model.v = 0.3, draw.normal(0, 0.3, len(model.w)), draw.normal(0, 0.3, model.v.shape)
    texts = ["one two two three", "", None, "Ünï 42! x\ny. z", "word " * 40]
    got = [r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    import pyarrow as pa

    for text, score in zip(texts, got, strict=True):
        (_, _, stats, owner, bucket, value), = quality.features(pa.array([text], pa.string()), quality.byte_table(lower=False))
        _, index, x = model.inputs(stats, owner, bucket, value)
        margin = model.bias + sum(model.w[i] * v for i, v in zip(index, x, strict=True))
        for a in range(len(index)):
            for b in range(a + 1, len(index)):
                margin += float(model.v[index[a]] @ model.v[index[b]]) * x[a] * x[b]
        assert score == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)


def test_training_is_bounded_where_ids_repeat_and_columns_may_have_any_name(spark):
    docs = spark.range(600).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("x").alias("_score"), F.lit(1).alias("score"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_rows=50)
    assert quality.accepted(docs, model, 0.0).columns == docs.columns and quality.accepted(docs, model, 0.0).count() == 600


# --- mixing -------------------------------------------------------------------------------------------------------------------


def filled(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """Targets by plain water filling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    df = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(df).collect()
    assert len(rows) == 100 and sum(r.taken for r in rows) == 300 and max(r.taken for r in rows) <= 4


def test_mixing(spark, corpus):
    rows = mixing.mix(corpus).collect()
    sized = [(r.doc_id, r.source, len([w for w in re.split(BLANK, r.text or "") if w])) for r in corpus.select("doc_id", "source", "text").collect()]
    same([(r.doc_id, r.source, r.size) for r in rows], sized)
    sizes = collections.Counter()
    for _, s, n in sized:
        sizes[s] += n
    target = filled(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.size * r.copies
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    same([(r.doc_id, r.source, r.taken) for r in mixing.mix(corpus.repartition(7)).collect()], [(r.doc_id, r.source, r.taken) for r in rows])


def test_tree_of_many_levels_keeps_the_sum(spark):
    draw = random.Random(9)
    df = spark.createDataFrame([(i, "w " * draw.randrange(1, 30), "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, source string")
    for leaf in (3, 16, 4096):
        rows = mixing.mix(df, leaf_rows=leaf).collect()
        for s in "ab":
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 30


def test_rounding_keeps_expectations():
    p, size = np.array([0.3, 0.6, 0.9, 0.2, 0.5]), np.array([9.0, 7.0, 4.0, 3.0, 2.0])
    sums = np.zeros(5)
    for seed in range(4000):
        draw = np.random.default_rng(seed)
        q, held = mixing.pivot(mixing.pivot_large(p, size, draw), size, draw)
        if held >= 0:
            q[held] = draw.random() < q[held]
        sums += q
    assert np.abs(sums / 4000 - p).max() < 0.03


# --- quality -------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf_dir):
    got = queries.op8_quality_classifier(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.8


def test_quality_awkward(spark, corpus, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None), (5, 7)], "doc_id long, quality int")
    model = quality.train(corpus, labels)
    got = quality.score(corpus, model).collect()
    same([r.doc_id for r in got], [r.doc_id for r in corpus.collect()])
    empty = {r.score for r in got if r.doc_id in (100, 101, 102)}
    assert len(empty) <= 2 and not [r for r in got if r.doc_id is None and r.held_out]
    assert quality.accepted(corpus, model).columns == corpus.columns
    assert quality.score(nothing, quality.train(nothing, labels)).count() == 0
    assert quality.score(corpus, quality.train(corpus, labels.limit(0))).count() == corpus.count()


def test_pairwise_sum_by_squares():
    model = quality.Machine()
    model.w = np.random.default_rng(1).normal(size=model.w.shape)
    model.v = np.random.default_rng(2).normal(size=model.v.shape)
    owner, index, value = np.zeros(5, int), np.array([1, 5, 9, 700, 4000]), np.array([0.1, 0.5, 0.2, 0.9, 0.4])
    want = model.bias + sum(model.w[i] * x for i, x in zip(index, value, strict=True))
    want += sum(model.v[index[a]] @ model.v[index[b]] * value[a] * value[b] for a in range(5) for b in range(a))
    assert model.margins(1, owner, index, value)[0][0] == pytest.approx(want)


# --- empty tables -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("run", [lambda d: secrets.digest(secrets.find(d)), lambda d: pii.digest(pii.find(d)), pii.redact, licenses.scan, lm.score, mixing.mix], ids=["secrets", "pii", "redact", "licenses", "lm", "mixing"])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0
