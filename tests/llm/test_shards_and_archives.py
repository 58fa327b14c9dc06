import gzip
import io
import itertools
import random
from collections import Counter, defaultdict

import pytest

from quillon.llm import entries, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string"


def rows():
    texts = [None, "", "a", "é" * 50, "copy " * 40, "long " * 3000]
    out = [(i, texts[i % 6], "en", "src0", 0, 9, "x") for i in range(120)]
    return out + [(7, "twice", "en", None, 0, 9, "x")] * 300 + [(None, "no id", None, None, None, None, None)] * 5


def cheapest_by_trial(supply, capacity):
    """Least units moved, over all integer flows of a tiny case."""
    best = 10**9
    spans = [range(s + 1) for s in supply for _ in capacity]
    for flat in itertools.product(*spans):
        flow = [flat[i * len(capacity) : (i + 1) * len(capacity)] for i in range(len(supply))]
        if [sum(f) for f in flow] == list(supply) and all(sum(c) <= cap for c, cap in zip(zip(*flow), capacity)):
            best = min(best, sum(x for i, f in enumerate(flow) for j, x in enumerate(f) if i != j))
    return best


def test_flow_moves_the_fewest_bytes():
    for supply, capacity in [((3, 1), (2, 2)), ((4,), (1, 2, 1)), ((2, 2, 1), (3, 2)), ((0, 3), (1, 1, 1))]:
        flow = sharding.transfers(supply, capacity)
        assert [sum(f) for f in flow] == list(supply)
        assert all(sum(c) <= cap for c, cap in zip(zip(*flow), capacity))
        assert sum(x for i, f in enumerate(flow) for j, x in enumerate(f) if i != j) == cheapest_by_trial(supply, capacity)


def test_flow_reroutes_when_costs_demand_it():
    assert sharding.min_cost_flow([1, 1], [1, 1], [[0, 1], [0, 5]]) == [[0, 1], [1, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2], [[0]])


def test_large_flow_is_optimal():
    r = random.Random(3)
    old = [r.randrange(10**9) for _ in range(40)]
    new = sharding.even_capacities(sum(old), 64)
    flow = sharding.transfers(old, new)
    kept = sum(min(o, n) for o, n in zip(old, new))
    assert sum(x for i, f in enumerate(flow) for j, x in enumerate(f) if i != j) == sum(old) - kept


def test_every_row_gets_a_place_and_sizes_are_even(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    found = sharding.placed(docs, 16).collect()
    assert len(found) == docs.count()
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 15001  # either end of a piece is off by under a row
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows())
    moved = sum(r["size"] for r in found if r["shard"] != r["old_shard"])
    old = Counter()
    for r in found:
        old[r["old_shard"]] += r["size"]
    assert abs(moved - sum(max(0, v - sum(sizes.values()) / 16) for v in old.values())) <= 12 * 15001


def test_empty_tables_have_no_places(spark):
    assert sharding.placed(spark.createDataFrame([], DOCS), 16).collect() == []


def test_only_shards_that_give_or_take_are_rewritten(spark, tmp_path):
    table = [(i, f"t{i}" + "x" * 20, i % 2, "k") for i in range(200)] + [(1000 + i, "y" * 22, 2, "k") for i in range(40)]
    spark.createDataFrame(table, "doc_id long, text string, shard int, slot string").write.partitionBy("shard").parquet(f"{tmp_path}/old")
    made = sharding.rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", 3)
    back = [r for s, d in made for r in spark.read.parquet(d).collect()]
    assert sorted((r["doc_id"], r["text"], r["slot"]) for r in back) == sorted((a, b, d) for a, b, _, d in table)
    same = sharding.rewrite(spark, f"{tmp_path}/new", f"{tmp_path}/again", 3)
    assert all("/new/" in d for _, d in same)


def test_the_query_writes_its_shards_and_reads_them_back(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(rows(), DOCS)
    monkeypatch.setattr(entries, "documents", lambda *_: docs)
    monkeypatch.setattr(sharding, "fresh_path", lambda _, name: f"file://{tmp_path}/{name}", raising=False)
    found = entries.op1_sharding(spark, "").collect()
    kept = spark.read.parquet(f"file://{tmp_path}/new-shards").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((r[0], r[1]) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in found) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, r["shard"], r["slot"]) for r in kept)
    names = ["doc_id", "size", "text_crc32", "shard", "slot", "old_shard"]
    assert Counter(tuple(r[c] for c in names) for r in found) == Counter(sharding.placed(docs, 16).select(*names).collect())
    assert sharding.resharded(docs.limit(0), 16).collect() == []


PAGES = "page_id long, url string, html string, digest string"


def pages():
    big = "<p>" + "b" * 1500
    return [(1, "http://a", big, "z"), (2, "http://b\r\nX: y", big, "z"), (3, None, big, "z"), (4, "u", "small", "z"), (5, "u", "small", "z"), (6, "u", None, "z"), (7, "ü", "é" * 700, "z"), (None, "u", "é" * 700, "z"), (9, "u", "", "z"), (3, None, big, "z")]


def test_archives_give_back_every_page(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES)
    found = warc.archive(df, f"file://{tmp_path}/w").collect()
    import hashlib

    winners = {}
    for p, _, h, _ in pages():
        h = (h or "").encode()
        if len(h) >= 1000 and p is not None:
            winners[h] = max(p, winners.get(h, p))
    want = Counter()
    for p, _, h, _ in pages():
        h = (h or "").encode()
        to = winners.get(h) if winners.get(h) != p else None
        want[p, len(h), hashlib.sha1(h).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want


def test_files_roll_and_are_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50, "") for i in range(300)], PAGES)
    for name in ("one", "two"):
        warc.write(warc.with_record_types(df), f"file://{tmp_path}/{name}", roll_bytes=2000)
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in ("one", "two"))
    assert one == two and len(one) > 10
    assert not list((tmp_path / "one").glob(".*.tmp"))
    manifest = spark.read.parquet(f"file://{tmp_path}/one/manifest").collect()
    assert {m["file"]: m["bytes"] for m in manifest} == {k: len(v) for k, v in one.items()}
    ids = [int(h["warc-record-id"].strip("<>").split(":")[-1]) for k in sorted(one) for h, _ in warc.records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(one[k]))))]
    assert ids == sorted(ids) == list(range(300))


@pytest.mark.parametrize("partitions", [1, 7])
def test_archives_do_not_depend_on_partitions(spark, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(warc, "PART_BYTES", 20_000)
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice([i, i, 5, None]), f"u{i % 7}", f"page {i % 90} " * r.choice([1, 50, 300]), "") for i in range(900)] + [(1, "u", "z" * 400_000, "")], PAGES)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    warc.write(warc.with_record_types(df), f"file://{tmp_path}/one", roll_bytes=9000)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        warc.write(warc.with_record_types(df.repartition(partitions)), f"file://{tmp_path}/two", roll_bytes=9000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in ("one", "two"))
    assert one == two and len({name.split("-")[1] for name in one}) > 5
    names = [h["warc-record-id"] for x in one.values() for h, _ in warc.records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(x))))]
    assert len(names) == len(set(names)) == df.count()


def test_parts_by_bounds_equal_a_plain_count(spark):
    bounds = sorted((r, d) for r, d in [(-5, 1), (0, 7), (0, 9), (3, 3), (8, 0), (8, 1), (90, 2)])
    rows = [(p, d) for p in range(-8, 12) for d in (0, 1, 3, 8, 9)] + [(91, 0), (90, 2)]
    from pyspark.sql import functions as F

    found = spark.createDataFrame(rows, "p long, d long").select("p", "d", F.struct("p", "d").alias("key")).select("p", "d", warc.part_of(bounds).alias("part")).collect()
    assert all(r["part"] == sum(b <= (r["p"], r["d"]) for b in bounds) for r in found)


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x", "")], PAGES)
    folder = f"file://{tmp_path}/w"
    warc.write(warc.with_record_types(df), folder)
    (tmp_path / "w" / "part-000099-000000.warc.gz").write_bytes(b"rubbish")
    assert warc.read(spark, folder).count() == 1


def test_damage_is_noticed():
    import hashlib

    r = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z").replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    with pytest.raises(ValueError):
        [warc.parsed(*x) for x in warc.records(io.BytesIO(r))]


def test_no_pages_no_records(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w").collect() == []
