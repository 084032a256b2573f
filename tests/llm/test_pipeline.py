"""The pipeline against the brute-force versions of its stages, one after the other."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest

from nearfield.llm import bpe, quality, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # rules: the verdicts' counts are held against brute force in test_operators
    kept = {r["doc_id"] for r in quality.apply(spark.read.parquet(f"{SF}/documents.parquet")).where("_rejected_by is null").collect()}
    docs = {i: t for i, t in docs.items() if i in kept}

    first, new = {}, {}
    windows = lambda l: [k for k in range(len(l) - 2) if any(x.strip() for x in l[k : k + 3])]
    for i in sorted(docs):
        lines = docs[i].split("\n")
        for k in windows(lines):
            first.setdefault(tuple(lines[k : k + 3]), (i, k))
    for i, t in docs.items():
        lines = t.split("\n")
        gone = {k + d for k in windows(lines) if first[tuple(lines[k : k + 3])] != (i, k) for d in range(3)}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or re.search(r"[^\x20\x09-\x0D]", left):
            new[i] = left
    docs = new

    prints = {i: simhash.fingerprint(t.encode()) for i, t in docs.items()}
    ids, head = sorted(prints), {}
    for i in ids:
        if i not in head:
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in head:
                    head[a] = i
                    todo += [b for b in ids if b not in head and (prints[a] ^ prints[b]).bit_count() <= 2]
    docs = {i: t for i, t in docs.items() if head[i] == i}

    fold = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    leaks = {" ".join(w[k : k + 10]) for w in map(fold, bench) if w for k in range(max(1, len(w) - 9))}
    docs = {i: t for i, t in docs.items() if not any(f" {x} " in f" {' '.join(fold(t))} " for x in leaks)}

    tokenizer = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(docs) and len(docs) > 100
    for i, t in docs.items():
        assert got[i]["n_tokens"] == len(tokenizer.encode(t))
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage(spark, docs, SF).columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0
