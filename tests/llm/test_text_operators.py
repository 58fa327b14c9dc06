import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bpe, quality, simhash
from tests import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string"


def some_texts():
    r = random.Random(1)
    words = ["the", "Of", "and", "in", "été", "mañana", "x#y", "日本", "a", "be", "token"]
    texts = [None, "", " ", "\n\n", "one", "one two", "a\x0bb\x0cc d", "\n".join(["same line here"] * 9), "é" * 4000, "ab " * 900]
    texts += [" ".join(r.choice(words) for _ in range(r.randrange(1, 140))) for _ in range(150)]
    return texts


def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", 0, "clash", "clash") for i, t in enumerate(some_texts() + some_texts()[:40])] + [(None, "x y z", None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {t: i for i, t in enumerate(tokens) if t}
    return bpe.Encoder(tokens, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_a_worker_tells_patterns_and_vocabularies_apart(spark, tmp_path):
    one = spark.createDataFrame([(1, "the same worker", "en", "s", 0, "", "")], DOCS).coalesce(1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    count = lambda p, pattern: bpe.encode_documents(one, p, pattern).first()["n_tokens"]
    few = tmp_path / "few"
    lines = open(path, "rb").read().splitlines(keepends=True)
    few.write_bytes(b"".join(lines[:256]))
    whole = count(path, public_tokenizers.PATTERN)
    assert whole < 15 and count(path, r"[\s\S]") == 15 and count(path, public_tokenizers.PATTERN) == whole
    assert count(str(few), public_tokenizers.PATTERN) == 15
    few.write_bytes(b"".join(lines))
    assert count(str(few), public_tokenizers.PATTERN) == whole


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abé 'll\n", max_size=80)))
def test_ids_equal_the_library(reference, text):
    mine, library = reference
    packed = mine.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert mine.decode(packed) == text.encode()


def test_encoding_documents(spark, reference):
    found = bpe.encode_documents(docs(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs(spark).collect()}
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        ids = reference[1].encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(prints)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in known}


@pytest.mark.parametrize("dense", [48, 2])
def test_components_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    texts = {r["doc_id"]: r["text"] for r in docs(spark).collect()}
    prints = {d: plain_fingerprint(t, 3) for d, t in texts.items()}
    roots = plain_components(set(prints.values()))
    low = defaultdict(lambda: None)
    for d, f in prints.items():
        if d is not None:
            low[roots[f]] = d if low[roots[f]] is None else min(d, low[roots[f]])
    found = simhash.near_duplicates(docs(spark)).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found} == {d: (f, low[roots[f]]) for d, f in prints.items()}


@pytest.mark.parametrize("dense", [48, 1])
def test_links_lose_no_close_fingerprint(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base) | {0, 1, 3, (1 << 64) - 1, 1 << 63}
    for b in base:
        x = b
        for _ in range(20):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = [(e["a"] & (1 << 64) - 1, e["b"] & (1 << 64) - 1) for e in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    parts = {(e["node"] & (1 << 64) - 1): (e["root"] & (1 << 64) - 1) for e in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    want, mine = defaultdict(set), defaultdict(set)
    for f, root in plain_components(prints).items():
        want[root].add(f)
        mine[parts.get(f, f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}


def plain_measures(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é \x1c", max_size=120))
def test_measures_by_definition(text):
    assert quality.measures(text.encode()) == plain_measures(text)


def test_binomial_bound_is_exact():
    from math import comb

    for n, k, p in [(50, 0, 0.1), (50, 3, 0.1), (400, 2, 0.02), (10, 1, 0.5)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_keep_the_guarantee():
    n = 2000
    dropped = {rule: [min(n, i * 2) for i in range(len(quality.CUTS))] for rule in quality.RULES}
    held = quality.certified_cutoffs([("en", n, dropped), ("few", 10, {r: [0] * len(quality.CUTS) for r in quality.RULES})], 0.02, 0.05)
    assert all(cuts == [] for cuts in held["few"].values())
    for rule, cuts in held["en"].items():
        assert cuts == quality.CUTS[: len(cuts)] and cuts
        assert quality.binomial_tail(dropped[rule][len(cuts) - 1], n, 0.02) <= 0.05 / 8
        assert quality.binomial_tail(dropped[rule][len(cuts)], n, 0.02) > 0.05 / 8


def test_a_small_stratum_certifies_a_looser_alpha():
    none = {rule: [0] * len(quality.CUTS) for rule in quality.RULES}
    one = {rule: [0] * 20 + [1] * 20 for rule in quality.RULES}
    held = quality.certified_cutoffs([("small", 300, none), ("one", 300, one), ("tiny", 60, none)], 0.01, 0.05)
    level = 0.05 / 12
    assert all(cuts == quality.CUTS for cuts in held["small"].values()) and all(cuts == quality.CUTS[:20] for cuts in held["one"].values()) and all(cuts == [] for cuts in held["tiny"].values())
    loose = quality.alpha_of(300, 0.01, level)
    assert 0.01 < loose < 0.02 and quality.binomial_tail(0, 300, loose) == pytest.approx(level) and quality.alpha_of(5000, 0.01, level) == 0.01 and quality.alpha_of(60, 0.01, level) == 0.05


def test_cutoffs_act_in_every_language_of_the_test_table(spark):
    sf = f"{oracle.ROOT}/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge_documents(docs, labels)
    counts = {"good": "quality = 1", "lost": "quality = 1 AND NOT kept", "bad": "quality = 0", "caught": "quality = 0 AND NOT kept"}
    sums = judged.join(labels, "doc_id").filter("NOT base_failed").groupBy("lang").agg(*(F.expr(f"count_if({c})").alias(n) for n, c in counts.items())).collect()
    assert {r["lang"] for r in sums} == {"en", "de", "fr", "es"}
    for r in sums:
        assert r["caught"] >= 0.95 * r["bad"] and r["lost"] <= 0.01 * r["good"], r


def test_best_cutoff_spares_good_documents():
    assert quality.best_cutoff([2.0, 1.0, 0.5, 0.1], [0, 4, 4, 4], [0, 0, 0, 3]) == 0.5
    assert quality.best_cutoff([2.0, 1.0], [0, 0], [0, 0]) is None
    assert quality.best_cutoff([], [], []) is None


def test_rules_drop_junk_and_keep_clean_documents(spark):
    r = random.Random(4)
    clean = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80))
    rows = [(i, clean(), "en", "s", 0, "c", "c") for i in range(500)] + [(1000 + i, clean().replace(" ", "### "), "en", "s", 0, "c", "c") for i in range(50)]
    rows += [(5000, None, "en", "s", 0, "c", "c"), (5001, clean(), None, "s", 0, "c", "c")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(1000 + i, 0, 0) for i in range(50)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    judged = {x["doc_id"]: x["kept"] for x in quality.judge_documents(df, labels, alpha=0.05).collect()}
    assert all(judged[i] for i in range(500)) and not any(judged[1000 + i] for i in range(50)) and not judged[5000] and judged[5001]
    kept = quality.filter_documents(df, labels, alpha=0.05)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {d for d, k in judged.items() if k}
    bare = quality.judge_documents(df, labels.filter("false"))
    assert bare.filter("kept").count() == 551
    assert quality.judge_documents(df.filter("false"), labels).collect() == []


def test_list_hits_tell_agreeing_bytes():
    from itertools import combinations

    for agree, hits in ((8, {14}), (7, {7}), (6, {3}), (5, {1}), (4, {0, 1})):
        assert {sum(set(b) <= set(c) for b in simhash.BLOCKS) for c in combinations(range(8), agree)} == hits
