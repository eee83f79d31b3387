"""The ten operators against brute force, round trips and messy rows."""

from __future__ import annotations

import collections
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import bpe, licenses, line_dedup, media, mixing, near_dedup, packing, quality_model, quality_rules, sharding, shingles, tokens

from brute import WORD, brute_components, brute_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept boolean"


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, shared ids, columns with clashing names."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta.", "épsilon", "#zeta", "eta|", "THETA!!", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", str(rng.randrange(50))]) for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en", "a", 5, 1, 1, True),
        (1, base, "en", "a", 5, 1, 1, True),
        (2, base + " tail", None, "b", None, 1, 1, None),
        (3, None, "en", None, 0, None, None, None),
        (4, "", "en", "a", 0, 1, 1, True),
        (5, " \n\t ", "en", "c", 3, 1, 1, True),
        (None, prose(30), "de", "c", 9, 1, 1, True),
        (6, prose(20_000), "fr", "b", 1, 1, 1, True),
        (7, "x" * 50_000, "fr", "b", 1, 1, 1, True),
        (8, "Released under the MIT License.\n" + prose(60) + ".", "en", "c", 1, 1, 1, False),
        (8, prose(4), "en", "c", 1, 1, 1, False),
        (9, "same line of words.\n" * 30, "en", "a", 1, 1, 1, False),
        *[(100 + i, f"A shared line of boilerplate here.\n{prose(40)}.", "en", "abcde"[i % 5], 1, 1, 1, True) for i in range(20)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [r.text or "" for r in df.select("text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path(tokens.VOCABULARY))


# 1


def test_media_round_trip_and_carving():
    rng = random.Random(2)
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.padded(bytes(rng.randrange(256) for _ in range(n)))
        for kind in media.STORES:
            stored = media.store(payload, kind)
            found = [x for x in media.carve(b"BM junk RIFF" + stored + b"P5 tail") if x.kind == kind]
            assert found[0].samples == payload and found[0].begin == 12 and found[0].end == 12 + len(stored)
            assert not [x for x in media.carve(stored[:-1]) if x.begin == 0]  # a cut file fails its length checks
    png = bytearray(media.store(media.padded(b"hello"), "image/png"))
    png[-20] ^= 1
    assert media.carve(bytes(png)) == []


def test_media_query_columns(messy, nothing):
    keyed = media.stored_texts(messy)
    found = media.sniff(keyed.select("doc_id", "declared", "media")).collect()
    assert len(found) == messy.count() and all(r.media_type for r in found)
    assert any(r.corrected for r in found)
    assert sorted(bytes(r.samples) for r in found) == sorted(media.padded(t.encode()) for t in texts(messy))
    assert media.digests(media.sniff(media.stored_texts(nothing)).withColumn("n_bytes", F.lit(0)).select("doc_id", "n_bytes", "media", "media_type", "corrected", "offset", "length", "width", "height", "samples", "embedded")).count() == 0


def test_media_digests_equal_brute_force(spark, messy):
    import hashlib

    held = media.stored_texts(messy.withColumn("text", F.coalesce("text", F.lit(""))))
    found = media.sniff(held.selectExpr("struct(doc_id, n_bytes) AS doc_id", "declared", "media")).selectExpr("doc_id.doc_id", "doc_id.n_bytes", "media", "media_type", "corrected", "`offset`", "length", "width", "height", "samples", "embedded")
    got = sorted(tuple(r)[1:7] for r in media.digests(found).collect())
    want = []
    for t in texts(messy):
        payload = media.padded(t.encode())
        stored = media.store(payload, media.STORES[zlib.crc32(payload) % 5])
        want.append((len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert got == sorted(want)


def test_media_query_takes_whole_table(spark, sf_dir):
    rows = media.op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_sha256", "feature").collect()
    want = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_bytes for r in rows} == want and len(rows) == len(want)
    assert all(re.fullmatch(r"[0-9a-f]{64}", r.payload_sha256) and "mean=" in r.feature for r in rows)


def chunk(name, body):
    return len(body).to_bytes(4, "big") + name + body + zlib.crc32(body, zlib.crc32(name)).to_bytes(4, "big")


def test_media_headers_that_promise_too_much():
    head = lambda w, h: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
    for size in (0xFFFFFFFF, 100_000, 3):
        assert media.carve(head(size, size) + chunk(b"IDAT", zlib.compress(b"\0" * 50)) + chunk(b"IEND", b"")) == []
    bomb = media.carve(head(40_000, 20_000) + chunk(b"IDAT", zlib.compress(b"\0" * 40_001 * 20_000, 9)) + chunk(b"IEND", b""))
    assert len(bomb) == 1 and bomb[0].samples is None  # confirmed in pieces, beyond MAX_SAMPLES


def test_media_many_finds_hold_offsets_only():
    import tracemalloc

    data = b"P5 1000 100 255 " * 16384
    tracemalloc.start()
    found = media.carve(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 9000 and peak < 16 << 20


def test_media_made_elsewhere():
    pixels = bytes(range(12))
    for head in (40, 108, 124):
        fields = struct.pack("<IiiHHIIiiII", head, 4, 3, 1, 8, 0, 0, 0, 0, 256, 0).ljust(head, b"\0")
        body = fields + bytes(1024) + pixels + b"profile"
        found = media.carve(b"BM" + struct.pack("<III", 14 + len(body), 0, 14 + head + 1024) + body)
        assert [(x.kind, x.shape, x.samples) for x in found] == [("image/bmp", (4, 3), pixels[8:] + pixels[4:8] + pixels[:4])]
    for text in (b"P5\n# made by hand\n4 3\n# top\n100\n", b"P5 4\t3 255 "):
        assert [(x.shape, x.samples) for x in media.carve(text + pixels)] == [((4, 3), pixels)]
    assert [(x.shape, x.end, x.samples) for x in media.carve(b"P5 2 3 65535\n" + pixels)] == [((2, 3), 25, None)]


# 2


def test_tokens_equal_library(library):
    rng = random.Random(3)
    pieces = ["a", "b", "s", "'", " ", "\n", "\t", "re", "ll", "1", "²", "é", "中", "　", "!", "🙂", "\x1c", "\x85", "0", "<|endoftext|>", "'t", "\U0001c89a", "Ᲊ"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["", "aaaa" * 3000, "<|endof", "text|>"]
    data = [t.encode() for t in made]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    flat, counts = bpe.encoder(bpe.vocabulary_path(tokens.VOCABULARY)).encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    at = 0
    for t, n in zip(made, counts, strict=True):
        assert flat[at : at + n].tolist() == library.encode(t, add_special_tokens=False).ids
        at += n


def test_token_counts(messy, nothing, library):
    got = tokens.count_tokens(messy).collect()
    want = [(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts(messy)]
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokens.count_tokens(nothing).count() == 0


# 3


def rules(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_quality_rules(spark, messy, nothing):
    extra = ["a b c a b c a b c", "a a a a", "x y z w x y z", "a b c d", "\n\n", "l\nl\n l\nl"]
    df = messy.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(None, t, None) for t in extra], "doc_id long, text string, kept boolean"))
    got = quality_rules.clean_lines(df).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(rules(t) for t in texts(df))
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.clean_lines(nothing).count() == 0
    shouting = " ".join(["WORD!!"] * 3 + [f"W{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(60)])
    clean = ". ".join(f"Some{i} words go along{i} here" for i in range(30)) + "."
    verdict = {r.doc_id: r.kept for r in quality_rules.clean_lines(spark.createDataFrame([(1, shouting), (2, clean), (3, clean + "\n| a | b | c | d |")], "doc_id long, text string")).collect()}
    assert verdict == {1: False, 2: True, 3: True}


def test_quality_rules_on_many_lines(spark):
    """A line of three words goes where it came before, however many lines there are; shorter ones stay."""
    rng = random.Random(6)
    lines = [f"A line with number {i} in it." for i in range(3000)]
    lines += [rng.choice(lines) for _ in range(500)] + ["Short.", "Short."] * 20
    rng.shuffle(lines)
    seen, want = set(), []
    for x in lines:
        if x == "Short." or x not in seen:
            want.append(x)
        seen.add(x)
    got = quality_rules.clean_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert got.cleaned == "\n".join(want) and got.n_failed_lines == len(lines) - len(want) and got.n_dup_lines == len(lines) - len(set(lines))


# 4


def brute_family(line):
    classes, weights, bias = licenses.model()
    seen = {g for n in (1, 2, 3) for g in licenses.runs(licenses.tokens(line), n)}
    z = np.array(bias)
    for g in seen & set(weights):
        z = z + np.array(weights[g])
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    c = int(p.argmax())
    if classes[c] == licenses.UNKNOWN or round(float(p[c]), 4) < licenses.MIN_PROBABILITY:
        return None
    own = licenses.pairs(licenses.tokens(line))
    return classes[c] if max(len(own & licenses.pairs(licenses.tokens(t))) / len(licenses.pairs(licenses.tokens(t))) for t in licenses.templates(classes[c])) >= licenses.MIN_TEMPLATE else None


def test_licenses(spark, messy, nothing):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.OTHERS) + ["no words of that kind", "All rights reserved!", "mit license", "license " * 30]
    df = spark.createDataFrame([(i, f"first line\n {t} \nlast") for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan(df).collect()}
    assert got == {i: brute_family(t) or "" for i, t in enumerate(lines)}
    right = [got[i] == f for i, f in enumerate(f for f, ts in licenses.TEMPLATES.items() for _ in ts)]
    assert np.mean(right) >= 0.9
    assert not any(got[i] for i in range(len(right), len(right) + len(licenses.OTHERS)))
    done = licenses.scan(messy)
    assert done.count() == messy.count() and done.filter("license = 'MIT'").count() == 1  # another row shares the id
    assert licenses.scan(nothing).count() == 0


WRAPPED = {
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use it:',
    "GPL": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
}


def test_licenses_wrapped_and_other_holders(spark):
    rows, want = [], {}
    for family, notice in WRAPPED.items():
        for width in (40, 70, 72, 76, 80):
            for start, mark in (("", ""), (" * ", " *"), ("# ", "#"), ("// ", "//"), ("REM ", "REM")):
                wrapped = "\n".join(start + x for x in textwrap.wrap(notice, width))
                for text in (wrapped, f"{start}A program that counts.\n{mark}\n{wrapped}\n{mark}\n{start}More words.", f"Words\nof prose.\n{wrapped}\nand more\nof them."):
                    want[len(rows)] = family
                    rows.append((len(rows), text))
    for line in ("Copyright (c) 2015 Foo Bar Inc. All rights reserved.", "Copyright 1999-2004, 2007 by J. Doe and others.\n# All rights reserved.", "\u00a9 Copyright 2021 The Example Company, all rights reserved"):
        want[len(rows)] = "Proprietary"
        rows.append((len(rows), line))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.families for i, r in got.items()} == want
    assert {i: r.license for i, r in got.items()} == want
    assert all(r.n_licenses == 1 <= r.n_candidates for r in got.values())


def test_license_model_on_notices_left_out():
    figures = licenses.held_out()
    assert figures["right_families"] >= 0.8 and figures["wrong_families"] <= 0.03 and figures["false_alarms"] <= 0.01


def test_licenses_of_the_documents(spark, sf_dir):
    """Every line that is a notice by itself is found, and no document without words of one has a licence."""
    notices = {t.strip(): f for f in licenses.TEMPLATES for t in licenses.templates(f)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: {notices[x.strip()] for x in (r.text or "").split("\n") if x.strip() in notices} for r in docs.collect()}
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in licenses.scan(docs).collect()}
    assert got == want and any(want.values())


def test_licenses_of_null_ids_and_long_texts(spark):
    prose = "\n".join(f"Row {i} of a long and plain report." for i in range(3000))
    rows = [(None, "Released under the MIT License."), (None, "plain words"), (None, None), (1, ""), (2, prose + "\nLicensed under\nthe Apache License,\nVersion 2.0.\n" + prose), (2, "plain words"), (2, "plain words")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.families, r.n_licenses) for r in got) == [(0, "", 0), (0, "", 0), (0, "MIT", 1), (1, "", 0), (2, "", 0), (2, "", 0), (2, "Apache-2.0", 1)]


def test_licenses_in_neighbouring_lines(spark):
    """Lines count as before: each confirmed one, whatever stands beside it."""
    single = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if brute_family(t) == f and t != "All rights reserved."]
    rows = [(i * 1000 + j, f"{a}\n{b}") for i, (_, a) in enumerate(single) for j, (_, b) in enumerate(single)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r.n_licenses == 2
        assert r.families == ",".join(sorted({single[r.doc_id // 1000][0], single[r.doc_id % 1000][0]}))


# 5


def test_packing(messy, nothing, library):
    want = collections.Counter(tuple(library.encode(t, add_special_tokens=False).ids + [1]) for t in texts(messy))
    for options in ({}, {"block_tokens": 4000}):
        got = packing.pack(messy.coalesce(1), **options).collect()
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at == 2048 or at & (at - 1) == 0
        # Each document's pieces, in order, are its ids.
        by = collections.defaultdict(list)
        for r in got:
            by[r.doc_id, r.doc_tokens].append(r)
        assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
        for (doc, n), pieces in by.items():
            pieces.sort(key=lambda r: r.start)
            if sum(p.length for p in pieces) == n:
                assert tuple(x for p in pieces for x in p.ids) in want
    assert packing.pack(nothing).count() == 0


def test_packing_fills_every_tier_and_balances_groups(spark):
    rng = random.Random(5)
    rows = [(i, "a b c d e f g h " * rng.choice([2, 9, 9, 15, 20, 20, 40, 60, 60, 100, 120, 200])) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()
    size, group, held, longer = {}, {}, collections.defaultdict(list), 0
    for r in got:
        assert size.setdefault(r.sequence_id, r.tier) == r.tier and group.setdefault(r.sequence_id, r.step_group) == r.step_group
        held[r.sequence_id].append(r)
    for i, pieces in held.items():
        assert sum(p.length for p in pieces) == size[i]
        longer += size[i] < 2048 and any(p.doc_tokens - p.start > size[i] for p in pieces)
    assert longer <= 11 * 16  # the tails of tasks alone
    assert all(n >= 16 for n in (sum(s == t for s in size.values()) for t in packing.TIERS))
    tokens = collections.Counter()
    for i, n in size.items():
        tokens[group[i]] += n
    assert sorted(tokens) == list(range(len(tokens))) and len(tokens) == -(-sum(tokens.values()) // (16 * 2048))
    assert max(tokens.values()) - min(tokens.values()) <= 2 * 2048


# 6


@pytest.mark.parametrize("fine_rows", [5, 1000])
def test_sharding(messy, nothing, fine_rows):
    got = sharding.shard(messy, 4, part_rows=fine_rows).collect()
    sizes = [len((t or "").encode()) + 8 for t in texts(messy)]
    assert sorted(r.size for r in got) == sorted(sizes)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    for rows in per.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sharding.shard(nothing, 4).count() == 0


def test_sharding_balances_a_hot_text(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)] + [(7, "one row again")] * 600
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = [r.b for r in got]
    assert len(b) == 6 and max(b) - min(b) <= 0.01 * sum(b) / 6 + 64


def test_sharding_query_columns(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sharding.op6_sharding(spark, sf_dir).collect()
    assert len(got) == len(docs)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append((r.slot, docs[r.doc_id]))
    assert sorted(load) == list(range(24)) and max(load.values()) - min(load.values()) <= 2 * max(map(len, docs.values())) + 16
    assert all(sorted(i for i, _ in v) == list(range(len(v))) for v in slots.values())
    order = [t for k in sorted(slots) for _, t in sorted(slots[k], key=lambda x: x[0])]
    runs = sum(a != b for a, b in zip(order, order[1:])) + 1
    assert runs == len(set(order))  # equal texts are neighbours


# 7


def test_line_dedup(messy, nothing):
    got = line_dedup.dedup_lines(messy).collect()
    assert len(got) == messy.count()
    spread = collections.defaultdict(set)
    first = {}
    rows = messy.collect()
    for r in rows:
        for x in (r.text or "").split("\n"):
            x = x.strip(" \t\n\x0b\f\r")
            if x and r.source is not None:
                spread[x].add(r.source)
            if x and r.doc_id is not None:
                first[x] = min(first.get(x, r.doc_id), r.doc_id)
    want = collections.Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        gone = [i for i, x in enumerate(lines) if (b := x.strip(" \t\n\x0b\f\r")) and len(spread[b]) >= 3 and b in first and first[b] != r.doc_id]
        want[r.doc_id, tuple(gone)] += 1
    assert collections.Counter((r.doc_id, tuple(r.removed)) for r in got) == want
    assert sum(len(r.removed) for r in got) == 19
    assert line_dedup.dedup_lines(nothing).count() == 0


# 8


def test_mixing(messy, nothing):
    got = mixing.plan_mix(messy, block_words=500, shards=5).collect()
    assert len(got) == messy.count()
    sizes = collections.Counter()
    for r in messy.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert r.taken == r.size * len(r.shards) <= 3 * r.size
        taken[r.source] += r.taken
    longest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.plan_mix(messy, block_words=500, shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(messy, block_words=500, shards=5)
    assert mixed.count() == sum(len(r.shards) for r in got)
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixing_counts_out_equal_rows(spark):
    rows = [(None, f"w{i} " + "x " * 99, "b") for i in range(900)] + [(i, "y " * 100, "a") for i in range(200)] + [(5, "same " * 100, "c")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    df = spark.createDataFrame(df.collect(), df.schema)
    for part_words in (5000, 4_000_000):
        plan = mixing.plan_mix(df, block_words=3000).groupBy("source").agg(F.first("target").alias("want"), F.sum("taken").alias("got")).collect()
        assert len(plan) == 3 and all(abs(r.want - r.got) <= 50 for r in plan)
        assert mixing.mix(df, block_words=3000, part_words=part_words).count() * 100 == sum(r.got for r in plan)


def test_quota_tree_is_exact():
    q = np.array([100, 7, 0, 31])
    dealt = mixing.split_quotas(q, 5, 3)
    assert (dealt.sum(axis=1) == q).all() and dealt.sum(axis=0).max() - dealt.sum(axis=0).min() <= 1
    assert (dealt == mixing.split_quotas(q, 5, 3)).all()
    mean = np.mean([mixing.split_quotas(q, 5, s)[0] for s in range(200)], axis=0)
    assert abs(mean - 20).max() < 1.5


# 9


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    table = np.zeros((quality_model.WIDTH, 1 + quality_model.RANK))
    keys = np.array([3, 8, 11])
    table[keys] = rng.normal(size=(3, 1 + quality_model.RANK))
    v = np.array([0.5, 2.0, -1.0])
    z = quality_model.raw_scores((0.3, table), np.zeros(3, int), keys, v, 1)[0]
    brute = 0.3 + (table[keys, 0] * v).sum() + sum(table[keys[i], 1:] @ table[keys[j], 1:] * v[i] * v[j] for i in range(3) for j in range(i))
    assert abs(z - brute) < 1e-9


def test_quality_model(spark, sf_dir, messy, nothing):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels)
    rows = quality_model.score(docs, model).join(labels, "doc_id").select("predicted", "quality", quality_model.held_out(F.col("doc_id")).alias("h")).collect()
    assert np.mean([r.predicted == r.quality for r in rows if r.h]) > 0.9
    plain = lambda rows: (rows[0], rows[1].tobytes())
    assert plain(quality_model.train(docs.unionAll(docs).unionAll(docs), labels.unionAll(labels))) == plain(model)
    worse = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert plain(quality_model.train(docs, worse)) == plain(model)  # held-out labels are not read
    held = quality_model.op9_quality_classifier(spark, sf_dir).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    taken = quality_model.score(messy.withColumns({"score": F.lit(7.0), "_text": F.lit("x"), "c0": F.lit(3)}), model, keep=("score", "_text", "c0"))
    assert taken.columns == ["doc_id", "_text", "c0", "score", "predicted"] and taken.filter("_text <> 'x' OR c0 <> 3 OR score > 1").isEmpty()
    got = quality_model.score(messy, model, keep=("source", "size")).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    a, b = (quality_model.score(messy.withColumns({"doc_id": F.lit(x).cast("long"), "source": F.lit("z"), "lang": F.lit("z")}), model).select("score").collect() for x in (1, 2))
    assert sorted(a) == sorted(b)
    assert quality_model.score(nothing, model).count() == 0
    assert quality_model.train(nothing, labels)[0] == 0.0


# 10


def test_near_dedup(spark, messy, nothing):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(150)]
    for i in range(120):  # a family around one text, and chains of growing change
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(200, 260):
        w = rows[-1][1].split() if i % 10 else [rng.choice(vocabulary) for _ in range(80)]
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(rng.choice(vocabulary) for _ in range(3))) for i in range(10)] + [(400, None), (401, ""), (402, "W1 w2"), (403, "w1 W2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (2, 12):
        near_dedup.SMALL, kept = small, near_dedup.SMALL
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
        near_dedup.SMALL = kept
        assert got == brute_components(rows)
    done = near_dedup.near_duplicates(messy).collect()
    assert len(done) == messy.count()
    assert {(r.doc_id, r.kept) for r in done if r.doc_id in (1, 2, 3, 4, None)} == {(1, True), (2, False), (3, True), (4, True), (None, True)}
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """One bucket of thousands of near copies: rows grow with the members, links equal brute force."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(800):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    asked, real = [], near_dedup.confirm_blocks
    monkeypatch.setattr(near_dedup, "BLOCK", 32)

    def counted(members, *args, **options):
        asked.extend((r.m, r.a * -(-r.m // 32) + r.m * -(-r.a // 32)) for r in members.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if(F.col("label") != F.col("main")).alias("a")).collect())
        return real(members, *args, **options)

    monkeypatch.setattr(near_dedup, "confirm_blocks", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert max(m for m, _ in asked) > 6 * 32 and sum(n for _, n in asked) <= 2 * sum(m for m, _ in asked)


CLASHES = ("_id", "_size", "_source", "_part", "_w", "_t", "_l", "_h", "_k", "_kept", "_text", "_place", "_u", "line", "id", "n", "bands", "k0", "c0", "shards", "size", "target", "taken", "source_size", "shard", "slot", "score", "predicted", "removed", "n_lines", "kept", "label", "bucket", "cleaned")


def test_clashing_names(spark, messy):
    """Columns of any name come through unchanged, but for those that an operator's own results replace."""
    df = messy.drop("size", "shard", "kept").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    results = {
        "op3": (quality_rules.clean_lines(df), ("cleaned", "n_lines", "kept")),
        "op6": (sharding.shard(df, 4), ("size", "shard", "slot")),
        "op7": (line_dedup.dedup_lines(df), ("n_lines", "removed")),
        "op8": (mixing.plan_mix(df), ("size", "source_size", "target", "taken", "shards")),
        "op8 mix": (mixing.mix(df), ("shard",)),
    }
    for name, (got, replaced) in results.items():
        assert len(set(got.columns)) == len(got.columns), name
        kept = [c for c in CLASHES if c not in replaced]
        assert set(kept) <= set(got.columns), name
        assert got.filter(" OR ".join(f"`{c}` <> 'own {c}' OR `{c}` IS NULL" for c in kept)).isEmpty(), name
    for got in (tokens.count_tokens(df), licenses.scan(df), packing.pack(df), near_dedup.near_duplicates(df), media.stored_texts(df)):
        assert got.count() >= df.count() and "bucket" not in got.columns


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    s = shingles.Sketcher(120)
    assert len(s.sketch(np.array([5], np.uint64))) == 120
    assert (s.sketch(np.array([5], np.uint64)) != np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    b = np.concatenate((a[:700], rng.integers(0, 1 << 62, 200, dtype=np.uint64)))
    same = np.mean([(shingles.Sketcher(120, k).sketch(a) == shingles.Sketcher(120, k).sketch(b)).mean() for k in range(20)])
    assert abs(same - 700 / 1100) < 0.04
