"""Every corpus operator against a brute-force version, and its edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import bpe, chunks, common, decontaminate, html_text, line_dedup, pii, quality, queries, simhash, substring_dedup, suffix_dedup, token_files, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)] + ["Größe", "été", "!!", "x"]


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in rng.choices(WORDS, k=k))
    passage, short = text(70), text(20)
    line = "\n".join(["same line one", "same line two", "same line three", "four"])
    out = []
    for i in range(n):
        t = text(rng.randint(0, 160))
        if i % 5 == 0:
            t = text(30) + passage + t
        if i % 7 == 0:
            t += "\n" + line
        if i % 9 == 0 and out:
            t = out[rng.randrange(len(out))]
        out.append(t)
    out += ["", None, "   ", "one", "ab " * 700, "THE SAME. " * 90, "short", short, "\x00\x1c odd\xa0　white", out[0]]
    return [(100 - i, t, "en", "src0", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_substring_dedup(docs, texts):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got, removed = by_id(substring_dedup.dedup(docs)), 0
    for i, t in texts.items():
        w = words(t)
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                hit[k : k + 50] = True
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), hit.sum())
        assert got[i]["kept"] == " ".join(x for x, h in zip(w, hit) if not h)
        removed += hit.sum()
    assert removed > 100


@pytest.mark.parametrize("hot", [windows.HOT, 1])
def test_suffix_dedup(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(windows, "HOT", hot)
    raw = {i: t.encode() for i, t in texts.items()}
    times = Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    got, removed = by_id(suffix_dedup.dedup(docs)), 0
    for i, b in raw.items():
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                hit[k : k + 400] = True
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), hit.sum(), runs)
        assert bytes(got[i]["kept"]) == np.frombuffer(b, np.uint8)[~hit].tobytes()
        removed += hit.sum()
    assert removed > 1000


def test_substring_dedup_splits_hot_minimisers(docs, monkeypatch):
    want = by_id(substring_dedup.dedup(docs))
    for hot, sampled in ((1, True), (3, True), (1, False)):
        monkeypatch.setattr(windows, "HOT", hot)
        if not sampled:
            monkeypatch.setattr(windows, "HOT_BYTES", 1)
        assert by_id(substring_dedup.dedup(docs)) == want


def near_copies(n=40, size=150):
    """Copies of one text, each with a few words of its own: their minimisers are hot."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(size)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(size)] = f"own{i}"
        out.append((i, " ".join(own)))
    return out


def test_hot_minimisers_of_near_copies(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(windows, "HOT", 4)
    recut, real = [], windows._recut
    monkeypatch.setattr(windows, "_recut", lambda scheme, level: recut.append(level) or real(scheme, level))
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = by_id(substring_dedup.dedup(docs))
    for i, t in rows:
        w, hit = t.split(), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                hit.update(range(k, k + 50))
        assert got[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in hit)
    times = Counter(t[k : k + 400] for _, t in ((i, t.encode()) for i, t in rows) for k in range(len(t) - 399))
    got = by_id(suffix_dedup.dedup(docs))
    for i, t in rows:
        raw, hit = t.encode(), set()
        for k in range(len(raw) - 399):
            if times[raw[k : k + 400]] > 1:
                hit.update(range(k, k + 400))
        assert bytes(got[i]["kept"]) == bytes(b for k, b in enumerate(raw) if k not in hit)
    assert recut and max(recut) > 1


def test_dedup_of_repeated_ids_and_segments(spark, monkeypatch):
    """Rows of one id with different texts keep apart; texts over a segment are whole."""
    rng = random.Random(9)
    passage, other = (" ".join(rng.choices(WORDS, k=70)) for _ in range(2))
    rows = [(1, passage), (2, f"{passage} tail"), (2, other), (2, other), (3, " ".join(rng.choices(WORDS, k=300)) + " " + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, 70, 0), (2, 70, 0), (2, 70, 0), (2, 71, 70), (3, 370, 70)]
    for segment in (windows.SEGMENT, 16):
        monkeypatch.setattr(windows, "SEGMENT", segment)
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect()) == want
        gone = sorted((r["doc_id"], r["n_removed"] > 0) for r in suffix_dedup.dedup(docs).collect())
        assert gone == [(1, True), (2, True), (2, True), (2, True), (3, True)] if len(passage) >= 400 and len(other) >= 400 else gone


def test_suffix_array_sorts():
    rng = random.Random(2)
    for _ in range(200):
        text = np.array([rng.randint(65, 64 + rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))] + [255], np.uint8)
        raw = text.tobytes()
        assert suffix_dedup.suffix_array(text, 64).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_bpe_is_the_library(spark, docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(queries.bpe_digest(docs))
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert tuple(got[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(t))
    own, rng = bpe.load(path, public_tokenizers.PATTERN), random.Random(3)
    assert by_id(bpe.recode(docs, own)) == by_id(bpe.decode(bpe.encode(docs, own), own))
    for _ in range(3000):
        x = "".join(rng.choice("ab cde\n\t é日本　\xa0\x85 '1٣,.!\x1c\x00😀I'll  ") for _ in range(rng.randint(0, 40)))
        assert own.encode(x).tolist() == library.encode_ordinary(x)
        assert own.decode(own.encode(x).tolist()) == x.encode()


def test_pieces_keep_all_pre_tokens():
    import regex

    split, rng = regex.compile(chunks.SPACED).findall, random.Random(3)
    assert chunks.SPACED == public_tokenizers.PATTERN
    signs = "ab c\n\t é日 　\xa0\x85 '1,\x1c     à…'sd×÷²Ȁʰ́''rell.😀"
    for _ in range(5000):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 4))]
        raw = "".join(texts).encode()
        sizes = np.array([len(t.encode()) for t in texts])
        begin = chunks.cuts(np.frombuffer(raw, np.uint8), (np.cumsum(sizes) - sizes)[sizes > 0]) if raw else []
        pieces = [raw[a:b].decode() for a, b in zip(begin, [*begin[1:], len(raw)])]
        assert [x for p in pieces for x in split(p)] == [x for t in texts for x in split(t)]


def test_encoders_split_long_texts(monkeypatch):
    """Long texts go in slabs, batches in groups, and other patterns without pieces: the ids are the same."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own, rng = bpe.load(path, public_tokenizers.PATTERN), random.Random(5)
    texts = ["".join(rng.choice(["word", " other", "  ", "\n", "été ", "x1."]) for _ in range(rng.randint(0, 400))) for _ in range(20)] + ["a" * 3000, " " * 3000, ""]
    want = [x.tolist() for x in own.encoder.encode_all(texts)]
    monkeypatch.setattr(chunks, "SLAB", 50)
    monkeypatch.setattr(chunks, "BYTES", 300)
    assert [x.tolist() for x in own.encoder.encode_all(texts)] == want
    own.encoder.by_pieces = False
    assert [x.tolist() for x in own.encoder.encode_all(texts)] == want
    monkeypatch.setattr(bpe, "_STEP", 7)
    lists = bpe._ids([np.array(x, "<u4") for x in want])
    assert [y.as_py() for part in own.decode_all(lists) for y in part] == [t.encode() for t in texts]
    with pytest.raises(Exception):
        list(own.decode_all(bpe._ids([np.array([10**6], "<u4")])))


def test_wide_ids(spark, tmp_path):
    """A vocabulary of over 65536 tokens takes 32 bits in the ranks and in the files."""
    import json

    letters = token_files._byte_letters()
    tokens = [bytes([b]) for b in range(256)] + [b"%05x" % i for i in range(70_000)]
    own = bpe.Tokenizer(tokens, public_tokenizers.PATTERN)
    assert own.decode(own.encode("11110 1ffff").tolist()) == b"11110 1ffff" and max(own.encode("11111")) < 256 + 70_000
    vocab = {letters[b]: b for b in range(256)} | {f"t{i}": i for i in range(256, 70_000)} | {"qz": 70_000}
    said = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": ["q z"]},
    }
    path = str(tmp_path / "wide.json")
    with open(path, "w") as f:
        json.dump(said, f)
    written = token_files.write(spark.createDataFrame([(1, "qz q")], "doc_id long, text string"), path, public_tokenizers.PATTERN)
    file = token_files.Shard(written.root, written.shards[0][0])
    assert file.sequence(0).dtype == np.uint32 and file.sequence(0)[:4].tolist() == [70_000, 32, ord("q"), 0]
    assert token_files.read(spark, written).first()["n_tokens"] == 4


def test_perfect_hash():
    keys = [bytes([a, b]) for a in range(40) for b in range(40)]
    table = bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(len(keys))) and table.get(b"none") == -1
    assert sorted(table.slots) == list(range(len(keys)))


def test_decontaminate(spark, docs, texts):
    item_texts = [" ".join(texts[100].split()[3:20]).upper(), "ONE", None, "", "never seen words here at all", " ".join(texts[95].split()[:40])]
    bench = spark.createDataFrame(list(enumerate(item_texts)), "item_id long, text string")
    fold = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
    found = {}
    for item, t in enumerate(item_texts):
        w = fold(t or "")
        for k in range(max(1, len(w) - 9) if w else 0):
            found.setdefault(tuple(w[k : k + 10]), set()).add(item)
    for limit in (decontaminate.BLOCK_BYTES, 60):
        old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, limit
        try:
            got = by_id(decontaminate.scan(docs, bench))
        finally:
            decontaminate.BLOCK_BYTES = old
        total = 0
        for i, t in texts.items():
            w, hit, items = fold(t), set(), set()
            for n in {len(k) for k in found}:
                for k in range(len(w) - n + 1):
                    if own := found.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        items |= own
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(items))
            total += len(hit)
            if limit > 60 and hit:
                raw = t.encode()
                assert b" ".join(raw[s["from"] : s["to"]] for s in got[i]["spans"]).lower().count(w[min(hit)])
        assert total > 20


def test_decontaminate_is_the_same_for_any_number_of_blocks(spark, monkeypatch):
    word = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(word[i : i + 12])) for i in range(0, 24, 4)] + [(90 + i, f"other item {i}") for i in range(70)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = "a  " + ", ".join(word) + " b other  ITEM 3 c"
    rows = [(1, text), (1, text), (1, "else"), (1, "else"), (2, text), (None, text), (None, text), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = []
    for limit in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        scanned.append(sorted(decontaminate.scan(docs, bench).collect(), key=str))
    assert scanned[0] == scanned[1] and len(scanned[0]) == len(rows)
    assert max(len(r["spans"]) for r in scanned[0]) == 2
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 16)
    assert len(list(decontaminate._blocks(bench, "item_id", "text"))) > 64
    assert decontaminate.scan(docs, bench).columns == ["doc_id", "n_words", "n_hit", "items", "spans"]


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p><article>';</script></head><body><nav><ul><li>menu</ul></nav>"
        "<!-- <article>no</article> --><div class=\"ad\">buy<p>now</div><article><header><h1>Head &amp; line</h1></header><p>one\n <b>two<br>three &eacute;&#33;<p>four"
        "<div class='comments'><p>reader</p></div><form>f<input></form><ul><li>five<li> <i>si</i>x </ul></article><footer>foot</footer>"
    )
    plain = "<body><div>shared menu of this very site with many words</div><p>{0} unique number text of {0} its own</p>"
    rows = [(1, "http://a/1", page), (2, "http://b/1", plain.format("one")), (3, "http://b/2", plain.format("two")), (4, None, None), (5, "http://c/", ""), (6, "x", "<p>lone < & text")]
    got = by_id(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[1]["text"] == "Head & line\none two three é!\nfour\nfive\nsix"
    assert got[2]["text"] == "one unique number text of one its own" and got[3]["text"].split()[0] == "two"
    assert [got[i]["text"] for i in (4, 5)] == ["", ""] and got[6]["text"] == "lone < & text"
    assert html_text.unique_runs([["a b c d e f g h i"], ["x a b c d e f g h y"]]) == [["i"], ["x y"]]


def test_html_repeats_across_cells(spark, monkeypatch):
    notice = "this notice of eight words stands on two pages"
    own = lambda i: " ".join(f"p{i}w{k}" for k in range(12))
    rows = [(i, f"http://h/{i}", f"<div>{own(i)}</div><p>{notice if i % 20 == 3 else f'only p{i}'}</p>") for i in range(40)] + [(None, "http://h/x", f"<p>{own(5)}")]
    rows += [(7, "http://h/7", rows[7][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = []
    for cell in (html_text.CELL, 4, 1):
        monkeypatch.setattr(html_text, "CELL", cell)
        results.append(sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str))
    assert results[0] == results[1] == results[2]
    got = {(i, u): t for i, u, t in results[0]}
    for i in range(40):
        assert got[i, f"http://h/{i}"] == {3: own(3), 23: own(23), 5: "only p5"}.get(i, f"{own(i)}\nonly p{i}")
    assert got[None, "http://h/x"] == "" and len(results[0]) == 42


def test_html_route_is_by_parsed_elements(spark):
    rows = [
        (1, "http://a/", "<!-- <article> --><p>whole page one</p>"), (2, "http://b/", "<script>'<main>'</script><p>whole page two</p>"),
        (3, "http://c/", "<!-- <main> --><p>menu</p><ARTICLE\n>three</article>"), (4, "http://d/", "<img alt='<article>'><p>four"),
    ]
    got = by_id(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["whole page one", "whole page two", "three", "four"]


def test_html_class_names():
    main = lambda html: html_text.blocks(html, True)
    assert main('<html class="widget"><body class="has-sidebar sidebar"><article><p>a</p></article></body>') == ["a"]
    assert main('<div id="page" class="sidebar-right"><div class="notice"><main><p>a</p></main></div></div>') == ["a"]
    assert main('<article><div class="entry-header"><h1>title</h1></div><div class="header"><h2>sub</h2></div><p>a</p></article>') == ["title", "sub", "a"]
    assert main('<article><p>a</p><div class="x ad">buy</div><div id="comments"><article>reader</article></div></article>') == ["a"]
    assert main('<main><article>a</article><ol class="comments"><li><article>reader</article></ol></main>') == ["a"]
    assert main('<aside class="ad"><article>no</article></aside><article>a</article>') == ["a"]
    assert html_text.blocks('<body class="ad"><p>a</p><div class="sidebar">b</div><div class="sidebar-left">c</div>', False) == ["a", "c"]


def test_token_files(spark, docs, texts):
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    written = token_files.write(docs, path, public_tokenizers.PATTERN)
    got, start, every = by_id(token_files.read(spark, written)), 0, []
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    back = []
    for shard, before, n in written.shards:
        assert before == len(back)
        file = token_files.Shard(written.root, shard)
        n_seq = -(-n // file.length)
        for s in reversed(range(n_seq)):
            assert len(file.sequence(s)) == file.length and not file.sequence(s).flags.owndata
        whole = np.concatenate([file.sequence(s)[file.mask(s)] for s in range(n_seq)])
        back += whole.tolist()
    assert back == every
    assert token_files.write(docs.limit(0), path, public_tokenizers.PATTERN).shards == []


def test_token_files_know_added_tokens(spark):
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "abc <|endoftext|> def"), (2, "plain text"), (3, "<|endoftext|>"), (4, "x<|endoftext|><|endoftext|>\n é日本"), (5, "<|endoftext| >")]
    got, start = by_id(token_files.read(spark, token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN))), 0
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (50256 in ids) == (i in (1, 3, 4))
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_line_dedup(docs, texts):
    first, got = {}, {r["doc_id"]: r for r in line_dedup.apply(docs).collect()}
    spans = lambda l: [k for k in range(len(l) - 2) if any(x.strip() for x in l[k : k + 3])]
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for k in spans(lines):
            first.setdefault(tuple(lines[k : k + 3]), (i, k))
    removed = 0
    for i, t in texts.items():
        lines = t.split("\n")
        gone = {k + d for k in spans(lines) if first[tuple(lines[k : k + 3])] != (i, k) for d in range(3)}
        assert got[i]["_n_removed"] == len(gone) and got[i]["_kept"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        removed += len(gone)
    assert removed > 5


def test_simhash(docs, texts):
    prints = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    got = by_id(simhash.near_duplicates(docs))
    assert all(got[i]["fp"] % 2**64 == p for i, p in prints.items())
    assert {i: r["component_id"] for i, r in got.items()} == reachable(prints)


def reachable(prints):
    out = {}
    for i in sorted(prints):
        if i not in out:
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in out:
                    out[a] = i
                    todo += [b for b in prints if b not in out and (prints[a] ^ prints[b]).bit_count() <= 2]
    return out


def test_links_of_close_fingerprints(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({s ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for s in seeds for _ in range(15)})
    signed = [simhash._signed(p) for p in prints]
    got = sorted((r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2)
    assert got == want and len(got) > 100


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_quality(docs, texts):
    got = by_id(queries_of_quality(docs))
    for i, t in texts.items():
        w = words(t)
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        q = got[i]["_q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
        )
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            assert got[i]["_rejected_by"] is not None


def queries_of_quality(docs):
    return quality.apply(docs)


def test_rule_order_changes_no_verdict(docs):
    rules = quality.default_rules()
    verdicts = []
    for order in (rules, rules[::-1]):
        found = quality.with_features(docs).select("doc_id", quality.cascade([*quality.BASE, *order], F.col("_q")).isNull().alias("ok"))
        verdicts.append({r["doc_id"]: r["ok"] for r in found.collect()})
    for counts in (True, False):
        verdicts.append({r["doc_id"]: r["_rejected_by"] is None for r in quality.apply(docs, counts=counts).collect()})
    assert verdicts[0] == verdicts[1] == verdicts[2] == verdicts[3] and 0 < sum(verdicts[0].values()) < len(verdicts[0])
    never = [quality.Rule("none", lambda q: F.lit(False)), quality.Rule("all", lambda q: q["n_words"] >= 0)]
    assert [r.name for r in quality.order_rules(docs, never)] == ["all", "none"]


def test_pseudonyms():
    p = pii.Pseudonymizer(b"0123456789abcdef")
    text = (
        "card 4111 1111 1111 1111, bad 4111111111111112, ssn 123-45-6789 not 000-12-3456, +1 (564) 555-4526, 192.168.2.1 not 300.1.1.1, "
        "2024-02-29 not 2023-02-29, 31.12.1999, a.b7@mail.example.com, GB82 WEST 1234 5698 7654 32, token 3dc91a32781def2fd668aa2fd071eacee1a19444"
    )
    new, kinds = p.replace(text)
    assert Counter(kinds) == Counter(["card", "ssn", "phone", "ip", "date", "date", "email", "iban", "secret"])
    for kept in ("4111111111111112", "000-12-3456", "300.1.1.1", "2023-02-29", "@mail.example.com", "+1 ("):
        assert kept in new
    for gone in ("4111 1111 1111 1111", "123-45-6789", "564) 555", "192.168.2.1", "2024-02-29", "31.12.1999", "a.b7@", "WEST", "3dc91a3278"):
        assert gone not in new
    again, kinds2 = p.replace(new)
    assert kinds2 == kinds and p.replace(new, back=True)[0] == text
    assert p.replace("4111 1111 1111 1111")[0] == new[5:24]
    small = pii.Permutation(b"0123456789abcdef")
    assert sorted(small.move("k", 37, x) for x in range(37)) == list(range(37))
    assert pii.Pseudonymizer(b"another key, longer").replace(text)[0] != new


@pytest.mark.parametrize(
    "text, value, kind",
    [
        ("4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "card"),
        ("4111111111111111 4.", "4111111111111111", "card"),
        ("no 12 4111 1111 1111 1111.", "4111 1111 1111 1111", "card"),
        ("BE68 5390 0754 7034 PAID", "BE68 5390 0754 7034", "iban"),
        ("BE68539007547034 IN", "BE68539007547034", "iban"),
        ("on 12/25/2024,", "12/25/2024", "date"),
    ],
)
def test_pseudonyms_beside_other_characters(text, value, kind):
    p = pii.Pseudonymizer(b"0123456789abcdef")
    new, kinds = p.replace(text)
    alone = p.replace(value)[0]
    assert kinds == [kind] and alone != value and new == text.replace(value, alone) and p.replace(alone, back=True)[0] == value


def test_dates_with_the_day_in_the_middle_stay_so():
    p = pii.Pseudonymizer(b"0123456789abcdef")
    for day in range(13, 32):
        new, kinds = p.replace(f"12/{day}/2024")
        assert kinds == ["date"] and int(new[3:5]) > 12 and p.replace(new, back=True)[0] == f"12/{day}/2024"
    assert p.replace("13/13/2024 4111 1111 1111 1112 12/25") == ("13/13/2024 4111 1111 1111 1112 12/25", [])


def planted_value(rng):
    """A value of some kind, made without the operator's code, its kind, and what makes it the same as another."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(["card", "ip", "date", "ssn", "phone", "email", "secret", "key", "iban"])
    if kind == "card":
        body = "4" + digits(14)
        total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
        full = body + str(-total % 10)
        return kind, rng.choice([full, " ".join(full[i : i + 4] for i in range(0, 16, 4))]), full
    if kind == "ip":
        value = ".".join(str(rng.randrange(256)) for _ in range(4))
    elif kind == "date":
        value = f"{rng.randint(1950, 2040)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    elif kind == "ssn":
        value = f"{rng.randint(100, 600)}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    elif kind == "phone":
        own = f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}"
        return kind, rng.choice(["", "+1 "]) + own, own
    elif kind == "email":
        own = f"{rng.choice(['ann', 'bo'])}.{rng.choice(['lee', 'ray'])}{digits(1)}@mail.example.com"
        return kind, rng.choice([own, own.title().replace("Mail.Example.Com", "mail.example.com")]), own
    elif kind == "secret":
        value = "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(38))
    elif kind == "key":
        value = "AKIA" + "".join(rng.choice("0123456789ABCDEFGH") for _ in range(16))
    else:
        bban = digits(18)
        value = f"DE{98 - int(bban + '131400') % 97:02d}{bban}"
    return kind, value, value


def test_pseudonyms_against_planted_values(spark):
    """Every planted value goes, nothing else changes, and equal values (and only they) stay equal across documents."""
    rng = random.Random(11)
    pool = [planted_value(rng) for _ in range(120)]
    rows, want = [], []
    for i in range(150):
        parts, kinds = [], []
        for _ in range(rng.randint(0, 6)):
            kind, value, same = rng.choice(pool)
            parts += [" ".join(rng.choices(["plain", "Words", "x,", "été", "12"], k=rng.randint(1, 5))) + " and: ", (kind, value, same)]
            kinds.append(kind)
        rows.append((i, "".join(p if isinstance(p, str) else p[1] + "; " for p in parts)))
        want.append((parts, kinds))
    got = by_id(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"0123456789abcdef"))
    links: dict = {}
    for i, (parts, kinds) in enumerate(want):
        assert got[i]["kinds"] == kinds
        rest = got[i]["text"]
        for p in parts:
            if isinstance(p, str):
                assert rest.startswith(p)
                rest = rest[len(p) :]
            else:
                new, rest = rest[: len(p[1])] if p[0] != "ip" else rest[: rest.index("; ")], rest[rest.index("; ") + 2 :]
                key = re.sub("[^0-9a-z@.]", "", new.lower())[-10 if p[0] == "phone" else 0 :]
                links.setdefault((p[0], p[2]), set()).add(key)
                assert new != p[1]
        assert rest == ""
    assert all(len(v) == 1 for v in links.values()) and len({(k[0], *v) for k, v in links.items()}) == len(links) > 80


def test_pseudonymize_frame(spark):
    rows = [(1, "ip 10.0.0.1"), (2, None), (3, ""), (None, "10.0.0.1 and 10.0.0.1"), (1, "ip 10.0.0.1")]
    got = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"0123456789abcdef").collect()
    out = {(r["doc_id"], r["text"]) for r in got}
    ip = next(t for i, t in out if i == 1)[3:]
    assert out == {(1, f"ip {ip}"), (2, None), (3, ""), (None, f"{ip} and {ip}")} and len(got) == 5


def test_later_rules_see_no_rejected_row(docs, monkeypatch):
    """Lazy features: what only later rules need is null where an earlier one has rejected."""
    monkeypatch.setattr(quality, "order_rules", lambda df, rules, *_: sorted(rules, key=lambda r: r.name == "repeats"))
    got = quality.apply(docs, counts=False).select("_rejected_by", F.col("_q.n_repeat_words").alias("n")).collect()
    assert all((r["n"] is None) == (r["_rejected_by"] not in (None, "repeats")) for r in got) and any(r["n"] is None for r in got)


def test_results_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(2**63 - 1, "a\nb\nc", 1, 2), (None, "a\nb\nc", 1, 2)], "doc_id long, text string, _kept int, _Q int")
    found = line_dedup.apply(docs).collect()
    assert sorted(r["_kept"] for r in found) == ["", "a\nb\nc"] and all(r["_Q"] == 2 for r in found)
    assert next(r["_kept"] for r in found if r["doc_id"]) == "a\nb\nc"
    docs = docs.withColumn("_rejected_by", F.lit(1)).withColumn("row", F.lit(5)).withColumn("words", F.lit(6))
    for counts in (True, False):
        rows = quality.apply(docs, counts=counts).collect()
        assert all(r["_rejected_by"] == "few_words" or r["_rejected_by"] for r in rows) and all((r["_kept"], r["row"], r["words"]) == (1, 5, 6) for r in rows)
        assert all(r["_q"]["n_words"] in (3, None) for r in rows)


OPERATORS = {
    "substring": substring_dedup.dedup,
    "suffix": suffix_dedup.dedup,
    "lines": line_dedup.apply,
    "quality": quality.apply,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "pii": lambda d: pii.pseudonymize(d, b"0123456789abcdef"),
    "bpe": queries.bpe_digest,
    "quality_lazy": lambda d: quality.apply(d, counts=False),
    "scan": lambda d: decontaminate.scan(d, d.sparkSession.createDataFrame([(1, "a b"), (None, "w1 w2"), (1, "a b")], "item_id long, text string")),
    "tokens": lambda d: token_files.read(d.sparkSession, token_files.write(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)),
    "clean": lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, "a b")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name):
    """No rows; null ids and texts; repeated rows; columns whose names operators use inside."""
    extra = "doc_id long, text string, mini long, n long, b string, fp long, words string, starts long, h1 string, _id long, _th long, lines string, _kept int, _n_removed int, _q int, _rejected_by int, row int, body int, kinds int, th int, ids int, page_id int, url int"
    none = (None,) * (extra.count(",") - 1)
    long = " ".join(WORDS[:90])
    rows = [(1, long, *none), (1, long, *none), (2, long, *none), (None, long, *none), (3, None, *none), (None, None, *none), (4, "", *none), (5, "\n\n\n", *none)]
    run = OPERATORS[name]
    assert run(spark.createDataFrame([], extra)).count() == 0
    got = run(spark.createDataFrame(rows, extra))
    if name == "keep_one":
        assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 0, 1, 1, 3]
    else:
        assert got.count() == len(rows)
    if name == "substring":
        assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got.collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 90), (3, 0), (4, 0), (5, 0)]


def test_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file:")


def test_scratch_tables_start_no_process_for_checksum_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda s, name: f"file://{tmp_path}/{name}")
    assert common.materialize(spark.range(0, 100, 1, 3), "own").count() == 100
    assert len(list((tmp_path / "own").glob("*.parquet"))) == 3 and not list((tmp_path / "own").rglob("*.crc"))
    spark.range(3).write.parquet(f"file://{tmp_path}/other")  # a caller's tables are written as before
    assert list((tmp_path / "other").glob(".*.crc"))


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_windows_tables_start_no_process_in_executors(spark, monkeypatch, operator):
    def refuse(*_):
        raise AssertionError("Spark's writer has a folder for each attempt, and Hadoop starts chmod for it")

    monkeypatch.setattr(common, "materialize", refuse)
    monkeypatch.setattr(common, "GROUP_BYTES", 1)
    monkeypatch.setattr(windows, "HOT", 1)
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(1, text), (2, text[::-1]), (3, "other " + text), (4, None), (None, text)]
    got = operator.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in got) == [(0, False), (1, operator is suffix_dedup), (2, False), (3, True), (4, False)]


def test_written_tables_have_one_file_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda s, name: f"file://{tmp_path}/{name}")
    many = spark.range(0, 3000, 1, 4).selectExpr("id", "cast(id as int) n", "cast(cast(id as string) as binary) b", "id % 3 = 0 as third")
    got = common.written(many.where("id < 1000 or id >= 2000"), "own")
    assert got.schema.simpleString() == many.schema.simpleString() and sorted(got.collect()) == sorted(many.where("id < 1000 or id >= 2000").collect())
    assert sorted(f.name for f in (tmp_path / "own").iterdir()) == [f"part-0000{k}.parquet" for k in (0, 1, 2, 3)]
    assert common.written(many.where("id < 0"), "none").count() == 0 and not list((tmp_path / "none").iterdir())

    def broken(batches):
        yield next(batches)
        raise ValueError("halfway")

    with pytest.raises(Exception, match="halfway"):
        common.written(many, "broken", broken, "id long, n int, b binary, third boolean")
    assert not list((tmp_path / "broken").iterdir())

    monkeypatch.setattr(common.os, "listdir", lambda folder: ["part-00000.parquet"])
    with pytest.raises(FileNotFoundError, match="part-00001"):
        common.written(many, "not_shared")
