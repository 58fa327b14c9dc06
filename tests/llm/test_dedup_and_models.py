import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import entries, logbilinear, nearcopies, secrets, suffixes
from tests import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 0.5) for i, t in rows], DOCS)


def some_rows(seed=1, n=60):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "z", "0", "日本"]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(r.randrange(0, 60)))
        if i % 3 == 0:
            cut = r.randrange(0, 200)
            text += " " + passage[cut : cut + r.randrange(40, 180)] + " " + text[:30]
        rows.append((i, text))
    rows += [(100 + i, rows[i][1]) for i in range(15)] + [(7, "same id " * 20), (7, "same id " * 20), (None, passage), (None, passage), (3, None), (300, ""), (301, "x" * 49), (302, "x" * 49)]
    rows += [(400, "a" * 4000), (401, "b" + "a" * 3000), (402, passage * 3)]
    r.shuffle(rows)
    return rows


def removed_by_definition(rows):
    first = {}
    number = lambda d: suffixes.LAST if d is None else d
    for d, t in sorted(rows, key=lambda r: number(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], number(d))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 50, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < number(d):
                gone[i : i + 50] = True
        gone = gone[: len(b)]
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowded, block", [(512, 4 << 20), (512, 1500), (2, 1500)])
def test_repeated_strings_go(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    rows = some_rows()
    found = suffixes.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in found) == removed_by_definition(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_no_documents_nothing_removed(spark):
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []


def test_loser_tree_merges_and_knows_shared_lengths():
    r = random.Random(4)
    for _ in range(60):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randrange(0, 9))}) for _ in range(r.randrange(1, 9))]
        coded = [(suffixes.shared_lengths(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 6)).tolist() if x else [], x) for x in runs]
        sources, lengths = suffixes.merge(coded)
        at = Counter()
        merged = []
        for s in sources:
            merged.append(runs[s][at[s]])
            at[s] += 1
        assert merged == sorted(x for run in runs for x in run)
        for i in range(1, len(merged)):
            a, b = merged[i - 1], merged[i]
            assert lengths[i] == next((k for k in range(6) if a[k] != b[k]), 6)


def test_front_coded_runs_come_back():
    own = suffixes.Block([1, 2], [300, 300], __import__("zstandard").compress((b"the same words " * 20) * 2))
    found = suffixes.Suffixes(own, None, 4, 3)
    kept = []
    for part, data in found.runs():
        shared, strings, before, lengths, docs = suffixes.decoded(data)
        assert strings == sorted(strings) and len(docs) == len(strings) == len(before) == len(lengths)
        kept += [part] * len(strings)
    assert len(kept) == len(found.kept)


def test_token_counts_and_base_scores(spark):
    rows = [(i, t) for i, t in some_rows(5, 90)] + [(5000 + i, "The THE the\x0bcat \x1c") for i in range(30)]
    found = logbilinear.score_documents(frame(spark, rows)).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for d, t in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        want[d].append((held(d), len(tokens), sum(x in counts for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(logbilinear, "SHARD_TOKENS", 700)
    rows = some_rows(3, 90) + [(7000, "long " * 30_000)]
    found = []
    for parts in (1, 5):
        scored = logbilinear.score_documents(frame(spark, rows).repartition(parts)).collect()
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6), r["score"]) for r in scored))
    assert [a[:3] for a in found[0]] == [b[:3] for b in found[1]]
    assert all(abs(a[3] - b[3]) <= 1e-5 * abs(a[3]) for a, b in zip(*found, strict=True))


def test_rare_tokens_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(logbilinear, "HEAD", 4)
    test_token_counts_and_base_scores(spark)


def test_no_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = logbilinear.score_documents(frame(spark, [(held, "a b")])).collect()[0]
    assert (one["n_known"], one["train_tokens"], one["base_score"]) == (0, 0, 0.0)
    assert logbilinear.score_documents(frame(spark, [])).collect() == []


def test_model_is_normalised_and_learns():
    r = np.random.RandomState(1)
    frequency = r.rand(logbilinear.SYMBOLS) * 100
    model = logbilinear.Model(frequency)
    target = r.randint(0, 8, 60_000).astype(np.int32)
    context = np.stack([np.roll(target, 1), np.roll(target, 2), np.roll(target, 3)], axis=1).astype(np.int32)
    target = ((context[:, 0] + 1) % 8).astype(np.int32)
    before = model.log10_probability(context, target).mean()
    for _ in range(6):
        for i in range(0, len(target), 1000):
            model.step(context[i : i + 1000], target[i : i + 1000], r)
    assert model.log10_probability(context, target).mean() > before + 0.5
    every = np.arange(logbilinear.SYMBOLS, dtype=np.int32)
    total = (10 ** model.log10_probability(np.repeat(context[:1], len(every), axis=0), every)).sum()
    assert abs(total - 1) < 1e-4


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{oracle.ROOT}/sf0.1/documents.parquet")
    found = logbilinear.score_documents(docs).filter("held_out").toPandas()
    assert found["score"].sum() > found["base_score"].sum() * 0.98


def test_forest_tells_secrets_from_false_positives(spark):
    forest = secrets.train(spark)
    held_out = spark.createDataFrame(secrets.labelled_findings(1500, seed=99), "b string, c string, a string, is_secret int")
    from pyspark.sql import functions as F

    judged = secrets.features_of(held_out).select("is_secret", (F.expr(forest) >= 0.5).alias("said")).collect()
    right = sum(bool(r["is_secret"]) == r["said"] for r in judged)
    assert right >= 0.97 * len(judged)


def test_secrets_are_found_and_masked(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'a b token = "{key}" c'), (2, None), (3, ""), (4, "thehousesofthingsandotherwords in the text"), (5, f'x\x01y token = "{key}" token = "{key}"'), (1, f'a b token = "{key}" c'), (6, f"commit {key} by me")]
    df = frame(spark, rows)
    found = secrets.scan(df).collect()
    assert Counter((r["doc_id"], r["ordinal"]) for r in found if r["is_secret"]) == {(1, 0): 2, (5, 0): 1, (5, 1): 1}
    out = secrets.redacted(df, length_column="n_chars")
    assert out.columns == df.columns
    texts = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    assert texts[1, 'a b token = "[SECRET]" c', 24] == 2 and texts[5, 'x y token = "[SECRET]" token = "[SECRET]"', 41] == 1
    assert texts[2, None, 0] == 1 and texts[6, rows[6][1], 0] == 1
    assert secrets.scan(df.filter("false")).collect() == [] and secrets.redacted(df.filter("false")).collect() == []


def test_scan_runs_no_python(spark):
    plan = secrets.redacted(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("dense", [12, 2])
def test_near_copies_leave_one_of_each_group(spark, monkeypatch, dense):
    monkeypatch.setattr(nearcopies, "DENSE", dense)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, at = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 12, 60, 400]))]
        for k in range(r.choice([1, 2, 30])):
            copy = list(base)
            if k and len(copy) > 50:
                copy[r.randrange(len(copy))] = word()
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(500, None), (501, ""), (None, rows[0][1]), (0, rows[0][1]), (502, "One two"), (503, "one  two")]
    out = nearcopies.one_of_each(frame(spark, rows))
    assert out.columns == DOCS.replace(",", "").split()[::2]
    known = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in nearcopies.similar_pairs([t or "" for _, t in known], 5, 0.8).itertuples(index=False):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(known[i][0] for i in range(len(known)) if find(i) == i)
    assert nearcopies.one_of_each(frame(spark, [])).collect() == []


def test_a_copy_of_two_levels_does_not_displace_the_original(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**9)}" for _ in range(823)]
    rows = [(0, " ".join(base))]
    for i in range(1, 121):
        copy = list(base)
        at = r.randrange(0, 700)
        copy[at : at + 74] = [f"w{r.randrange(10**9)}" for _ in range(74 + (3 if i % 3 == 0 else -3))]
        rows.append((i, " ".join(copy)))
    assert {len(nearcopies.levels(len(nearcopies.shingle_set(t.encode(), 5)))) for _, t in rows} == {1, 2}
    assert len(nearcopies.similar_pairs([t for _, t in rows], 5, 0.8).query("i == 0")) == 120
    named = {hashlib.md5(t.encode()).digest(): i for i, t in rows}
    texts = nearcopies.indexed(spark.createDataFrame([(bytearray(k), rows[i][1]) for k, i in named.items()], "tid binary, text string"), 5)
    pairs = [{named[bytes(x["a"])], named[bytes(x["b"])]} for x in nearcopies.candidates(texts, 0.8).collect()]
    assert sum(0 in pair for pair in pairs) == 120


def test_form_letters_that_share_a_passage_keep_their_own_copies(spark):
    r = random.Random(6)
    fresh = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    passage = fresh(205)
    rows = []
    for i in range(300):
        own = fresh(28)
        rows += [(2 * i, " ".join([*passage, *own])), (2 * i + 1, " ".join([*passage, *own[:4], *fresh(24)]))]
    found = nearcopies.similar_pairs([t for _, t in rows], 5, 0.8)
    assert sorted(found.itertuples(index=False, name=None)) == [(2 * i, 2 * i + 1) for i in range(300)]
    assert sorted(x["doc_id"] for x in nearcopies.one_of_each(frame(spark, rows)).collect()) == list(range(0, 600, 2))


@pytest.mark.parametrize("block", [1 << 13, nearcopies.BLOCK])
def test_a_dense_cluster_at_the_threshold_keeps_its_components(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    r = random.Random(9)
    base = [f"w{r.randrange(10**9)}" for _ in range(100)]
    rows = []
    for i in range(400):
        copy = list(base)
        for at in r.sample(range(100), r.choice([1, 2])):
            copy[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = nearcopies.similar_pairs([t for _, t in rows], 5, 0.8)
    for i, j in pairs.itertuples(index=False):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert len(pairs) > 10_000
    assert sorted(x["doc_id"] for x in nearcopies.one_of_each(frame(spark, rows)).collect()) == [i for i in range(len(rows)) if find(i) == i]


@pytest.mark.parametrize("few", [0, 40, 1 << 20])
@pytest.mark.parametrize("changes", [3, 6, 12])
def test_prefixes_lose_no_similar_pair(monkeypatch, few, changes):
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "TILE", 16)
    r = random.Random(changes)
    base = [f"w{r.randrange(500)}" for _ in range(100)]
    texts = ["", "one two", "one two"]
    for _ in range(80):
        copy = base[: r.choice([5, 60, 90, 100])]
        for at in r.choices(range(len(copy)), k=r.randrange(changes)):
            copy[at] = f"v{r.randrange(3000)}"
        texts.append(" ".join(copy))
    sets = [nearcopies.shingle_set(t.encode(), 5) for t in texts]
    may = np.triu(nearcopies.sharing_prefixes(sets, 0.8), 1)
    assert sorted(nearcopies.similar(sets, may, 0.8)) == sorted(nearcopies.similar_pairs(texts, 5, 0.8).itertuples(index=False, name=None))


def test_shared_shingles_are_counted(monkeypatch):
    monkeypatch.setattr(nearcopies, "COUNTED", 7)
    r = random.Random(7)
    a, b = ([np.array(sorted(r.sample(range(60), r.randrange(1, 40))), np.uint64) for _ in range(k)] for k in (5, 6))
    assert nearcopies.shared_shingles(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_near_copies_of_the_test_table_are_all_found(spark):
    docs = spark.read.parquet(f"{oracle.ROOT}/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in nearcopies.similar_pairs([t for _, t in rows], 5, 0.8).itertuples(index=False):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in nearcopies.one_of_each(docs).collect()) == [rows[i][0] for i in range(len(rows)) if find(i) == i]


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_operator_query_equals_its_sql(spark, name):
    found = oracle.spark_rows(entries.queries()[name](spark, f"{oracle.ROOT}/sf0.001"))
    assert found == oracle.duck_rows(entries.oracle_sql()[name], "sf0.001")


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]
    sf = f"{oracle.ROOT}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] <= seen[4]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == seen[4]
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
