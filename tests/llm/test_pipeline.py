from __future__ import annotations

import collections
import random
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import bpe, quality_model, rows, tokens

from brute import WORD, brute_components, brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, _id string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The documents with hot groups, repeated rows, null ids and sources, and columns named like the operators' own."""
    rng = random.Random(3)
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    text = next(r[1] for r in rows if r[1] and len(r[1].split()) > 100)
    rows += [(10_000 + i, text, "en", "hot", len(text)) for i in range(60)] + [rows[3]] * 4 + [(None, f"Some {i} words of a text without id.", "en", "hot", 9) for i in range(20)]
    rows += [(20_000 + i, " ".join(rng.choice(text.split()) if rng.random() < 0.02 else w for w in text.split()), "de", None, None) for i in range(20)]
    rows += [(30_000, None, None, None, None), (30_001, "", "en", "hot", 0)]
    return spark.createDataFrame([(*r, 1, 2, 7.0, "own") for r in rows], SCHEMA)


def plain(df):
    return collections.Counter(map(tuple, df.collect()))


def test_quality_stage_equals_brute_force(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = plain(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir))
    bias, table = quality_model.train(docs, labels)
    model = bias, table.astype(np.float32)
    want = collections.Counter()
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        d, k, v = quality_model.features(data, np.array([0, len(data)]), np.array([np.nan if r.n_chars is None else float(r.n_chars)]))
        if quality_model.raw_scores(model, d, k, v, 1)[0] >= 0:
            want[tuple(r)] += 1
    assert got == want
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    lost = {r[0] for r in plain(docs) - got} & good
    assert len(lost) <= 0.02 * len(good) and sum(got.values()) < docs.count()


def test_near_stage_equals_brute_force(spark, sf_dir, docs):
    rows = docs.collect()
    smallest = {k: c for k, (_, c) in brute_components([(r.doc_id, r.text) for r in rows if r.doc_id is not None]).items()}
    want = collections.Counter(tuple(r) for r in rows if r.doc_id is None)
    want.update({tuple(r) for r in rows if r.doc_id is not None and smallest[r.doc_id] == r.doc_id})  # a set: repeated rows once
    got = plain(corpus_pipeline.STAGES[2][1](spark, docs, sf_dir))
    assert got == want
    twice = spark.createDataFrame([(i, t, "en", None, 5 + k) for k in range(2) for i, t in ((1, "a b c d e f"), (2, ""), (3, "one text"), (3, "another text"))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.STAGES[2][1](spark, twice, sf_dir).collect()) == [(1, "a b c d e f", 5), (2, "", 5), (3, "another text", 5), (3, "one text", 5)]


def test_mixing_stage_equals_brute_force(spark, sf_dir, docs):
    size, given = collections.Counter(), plain(docs)
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(dict(size))
    got = plain(corpus_pipeline.STAGES[3][1](spark, docs, sf_dir))
    taken, longest = collections.Counter(), collections.Counter()
    for r, n in got.items():
        assert n <= 3 * given[r]
        taken[r[3]] += n * len(WORD.findall(r[1] or ""))
    for r in given:
        longest[r[3]] = max(longest[r[3]], len(WORD.findall(r[1] or "")))
    for s in size:
        whole = int(want[s] // size[s]) if size[s] else 0
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
        assert all(got[r] in (whole * n, *range(whole * n, (whole + 1) * n + 1)) for r, n in given.items() if r[3] == s and whole < 3)


def test_packing_stage_equals_brute_force(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(tokens.VOCABULARY))
    want = collections.Counter(x for r in docs.collect() for x in library.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert collections.Counter(x for p in pieces for x in p.ids) == want
    spots = collections.defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        spots[p.sequence_id].append((p.offset, p.length))
    for s in spots.values():
        ends = [o + n for o, n in sorted(s)]
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    first = next(r for r in docs.collect() if r.doc_id and r.doc_id < 10_000 and r.text)
    mine = sorted((p.start, tuple(p.ids)) for p in pieces if p.doc_id == first.doc_id)
    assert [x for _, ids in mine for x in ids] == library.encode(first.text, add_special_tokens=False).ids + [1]


def test_stages_keep_all_columns(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        assert got.filter("size <> 1 OR shard <> 2 OR score <> 7 OR _id <> 'own'").isEmpty(), name


def test_run_equals_stages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = rows.checkpoint(stage(spark, df, sf_dir))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.agg(F.sum("length")).first() == df.agg(F.sum("length")).first()
    assert got.select("doc_id").distinct().exceptAll(df.select("doc_id").distinct()).isEmpty() and set(key) <= set(got.columns)


def test_line_stage_equals_brute_force(spark, sf_dir):
    """Three sites for a line, two for one of over 50 words, where null is a site; hot lines and lines of one site stay."""
    long = lambda name, n=51: " ".join(f"{name}{i}" for i in range(n))
    hot, void, fifty, own = long("hot"), long("void", 60), long("fifty", 50), long("own", 80)
    spots = [(hot, "a"), (hot, "b"), (void, "a"), (void, None), (fifty, "a"), (fifty, "b"), (own, "c"), ("short line", "a"), ("short line", None), ("short line", "b"), ("wide line", "a"), ("wide line", "b"), ("wide line", "c")]
    rows = [(10 * i + j, f" {line}\t\nown words {i} {j}" if j else line, "en", source, 7) for i, (line, source) in enumerate(spots) for j in range(8)]
    sites, first = collections.defaultdict(set), {}
    for i, text, _, source, _ in rows:
        for line in map(str.strip, text.split("\n")):
            first[line] = min(first.get(line, i), i)
            if source is not None or len(line.split()) > 50:
                sites[line].add(source)
    want = {}
    for i, text, lang, source, n in rows:
        kept = [x for x in text.split("\n") if first[x.strip()] == i or len(sites[x.strip()]) < (2 if len(x.split()) > 50 else 3)]
        if kept:
            want[i] = ("\n".join(kept), lang, source, n if len(kept) == len(text.split("\n")) else len("\n".join(kept)))
    got = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sum(hot in r.text for r in got) == sum(void in r.text for r in got) == 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, None), (1, "Some words. " * 40, "en", "a", 480), (2, "x" * 9000, "en", None, 1)]])
def test_stages_take_odd_rows(spark, sf_dir, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality classifier":
            model = quality_model.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert quality_model.score(docs, model, keep=("text", "lang", "source", "n_chars")).count() == len(rows)
        assert stage(spark, docs, sf_dir).count() >= 0


def test_quality_stage_sends_a_text_once_in_small_slices(spark, sf_dir, docs, monkeypatch):
    """An executor's memory holds its workers, too: neither two copies of a batch's texts nor arrays of 100 times 1 MB."""
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent, plain_map = [], rows.arrow_map
    monkeypatch.setattr(rows, "arrow_map", lambda df, fn, schema: sent.append((df, fn)) or plain_map(df, fn, schema))
    got = quality_model.score(docs, model, keep=("text",))
    df, fn = sent[0]
    assert [t for _, t in df.dtypes].count("string") == 1 and got.columns == ["doc_id", "text", "score", "predicted"]
    text = " ".join(f"word{i}" for i in range(1200))
    values = {"bigint": list(range(400)), "string": [text] * 400, "double": [float(len(text))] * 400}
    batch = pa.RecordBatch.from_pydict({name: values[kind] for name, kind in df.dtypes})
    list(fn(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    scored = sum(b.num_rows for b in fn(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored == 400 and peak < 40e6


def test_plans_start_no_second_set_of_workers(spark, sf_dir, docs, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a list of rows is read by Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).count() and corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count()


def test_workers_give_memory_back_after_a_task():
    """200 MB in pieces that malloc keeps, below one that stays."""
    code = """
import re
from chronoloom.llm import rows

def own():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1e3

def task(batches):
    held, stays = [bytearray(b"x" * 100_000) for _ in range(2000)], bytearray(b"x" * 100_000)
    del held
    yield stays

class Frame:
    mapInArrow = staticmethod(lambda fn, schema: fn)

run, before = rows.arrow_map(Frame, task, ""), own()
kept = list(run(iter([])))
print(own() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 50
