"""Suffix-array deduplication: bytes of repeated 50-byte strings are removed from all documents but the first.

A distributed merge sort of suffixes that is aware of common prefixes, over those suffixes that matter. Every
50-byte string has an anchor: the 24 bytes within it whose hash is smallest. Equal strings have equal
anchors, so two documents can share a string only where they share an anchor.

1. ``packed``: texts are packed into compressed blocks of about ``BLOCK_BYTES``, a row each.
2. ``exchanged``: each block sends the hashes of its anchors (once each) and of its texts to buckets, which
   answer with the anchors that other blocks hold too, and with the smallest doc_id of equal texts.
3. ``runs``: a block sorts the suffixes at its shared anchors (50 bytes on, with 26 bytes before), keeps equal ones
   once with their smallest doc_id, and sends them to parts as front-coded sorted runs: each suffix is the
   length it shares with the one before it and the rest.
4. ``merged_part``: a loser tree merges the runs of a part. It compares shared lengths first and bytes only from
   there on. The lengths shared by neighbours in the result say which suffixes agree in a 50-byte string, for all 27
   places it can have around the anchor; the part answers which of them start in a smaller document.
5. ``removed``: each block marks the bytes covered, and digests what is left.

Equal texts are handled in step 2: copies never send suffixes. An anchor that many blocks share (``CROWDED``) is not
sent whole: its strings are, each to the part of its own hash, so no part gets all that stands around a common
passage. Blocks send equal things once, so a group's size adds at most a row per block.

Edge cases: a null text is empty; texts under 50 bytes keep all; a null doc_id counts as larger than any, and two of
them don't remove from each other, nor do rows that share a doc_id; strings within one document don't count; very
long texts are a block of their own; rows that repeat give a row each; columns other than doc_id and text are not
used; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, session, text_bytes

LENGTH, GRAM = 50, 24
PLACES = LENGTH - GRAM + 1
BEFORE = PLACES - 1
BLOCK_BYTES = 4 << 20
#: Anchors in a bucket; anchors in all for each part, of which a part gets those that are shared.
BUCKET, PART = 1 << 20, 1 << 18
#: Blocks that share an anchor before its strings are sent one by one.
CROWDED = 512
CHUNK = 1 << 15
#: Stands for a null doc_id.
LAST = np.iinfo(np.int64).max
TOP = np.uint64(np.iinfo(np.uint64).max)
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
PACKED = "block long, ids array<long>, lens array<int>, z binary"
COPY = np.dtype([("sha", "S16"), ("doc", "<i8")])
SENT = "bucket long, kind int, block long, data binary"
RUN = "part long, block long, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def packed(docs: DataFrame) -> DataFrame:
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal block, size
            block += 1
            out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([pack.compress(b"".join(texts))], pa.binary())], ["block", "ids", "lens", "z"])
            ids.clear()
            texts.clear()
            size = 0
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield full()
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield full()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


class Block:
    """A block's bytes and documents: ``start`` and ``room`` (bytes to the document's end) by position."""

    def __init__(self, ids: Sequence[int | None], lens: Sequence[int], z: bytes):
        self.raw = zstandard.ZstdDecompressor().decompress(z, max_output_size=max(1, sum(lens))) if sum(lens) else b""
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.lens = np.array(lens, np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.shas = [hashlib.sha256(self.raw[a:b]).digest()[:16] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        self.smallest: dict[bytes, int] = {}
        for sha, doc in zip(self.shas, self.ids.tolist(), strict=True):
            self.smallest[sha] = min(doc, self.smallest.get(sha, LAST))

    def copies(self) -> np.ndarray:
        """Whether an equal text has a smaller doc_id, or (so that one row sends suffixes) an earlier row the same."""
        seen: set[bytes] = set()
        out = np.zeros(len(self.ids), bool)
        for i, (sha, doc) in enumerate(zip(self.shas, self.ids.tolist(), strict=True)):
            out[i] = doc > self.smallest[sha] or sha in seen
            if not out[i]:
                seen.add(sha)
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all anchors, in order."""
        n = len(self.raw)
        if n < LENGTH:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        padded = bytearray(n + 128)
        padded[BEFORE : BEFORE + n] = self.raw
        words = np.ndarray((n + 120,), "<u8", buffer=padded, strides=(1,))
        room = np.zeros(n + 128, np.int64)
        room[BEFORE : BEFORE + n] = np.repeat(self.ends, self.lens) - np.arange(n)
        a, b, c, d = MULTIPLIERS
        places, hashes = [], []
        for at in range(0, n, CHUNK):
            upto = min(n, at + CHUNK)
            # padded positions at .. upto + 2 * BEFORE stand for at - BEFORE .. upto + BEFORE
            wide = upto - at + 2 * BEFORE
            h = words[at : at + wide] * a + words[at + 8 : at + 8 + wide] * b + words[at + 16 : at + 16 + wide] * c
            h ^= h >> np.uint64(32)
            h *= d
            h ^= h >> np.uint64(29)
            own = room[at : at + wide]
            h[own < GRAM] = TOP
            low = _sliding(h, np.minimum)
            low[own[: len(low)] < LENGTH] = 0
            high = _sliding(low, np.maximum)
            here = h[BEFORE : BEFORE + upto - at]
            chosen = np.flatnonzero((high[: upto - at] == here) & (here != TOP))
            places.append(chosen + at)
            hashes.append(here[chosen])
        return np.concatenate(places), np.concatenate(hashes)


def _sliding(x: np.ndarray, op: np.ufunc) -> np.ndarray:
    """op over every PLACES (27) neighbours, by doubling."""
    width = 1
    while 2 * width <= PLACES:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = PLACES - width
    return op(x[: len(x) - rest], x[rest:])


def keys_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What stands for an anchor in the exchange: the bucket's bits and 32 more.

    Anchors have small hashes, so these are mixed again; else most would fall into the first bucket.
    """
    mixed = hashes * MULTIPLIERS[3]
    mixed ^= mixed >> np.uint64(32)
    return (mixed * MULTIPLIERS[0]) >> np.uint64(32 - bits)


def sent_keys(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and end of each bucket's keys in sorted distinct keys."""
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(buckets[a]), a, b


def exchanged(blocks: DataFrame, bits: int) -> DataFrame:
    """block, answers: what the buckets (2**bits of them) answer each block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block = batch.column(0)[row].as_py()
                own = Block(*(batch.column(i)[row].as_py() for i in (1, 2, 3)))
                at, hashes = own.anchors()
                copy = own.copies()
                keys = np.unique(keys_of(hashes[~copy[np.searchsorted(own.ends, at, "right")]], bits))
                out = [(bucket, 0, keys[a:b].astype("<u4").tobytes()) for bucket, a, b in sent_keys(keys)]
                texts: dict[int, list] = {}
                for sha, doc in own.smallest.items():
                    texts.setdefault(int.from_bytes(sha[:4], "big") % (1 << bits), []).append((sha, doc))
                out += [(bucket, 1, np.array(pairs, COPY).tobytes()) for bucket, pairs in texts.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "kind", "block", "data"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, bytes]] = []
        bucket = int(rows["bucket"].iloc[0])
        anchors = rows[rows["kind"] == 0]
        if len(anchors):
            parts = [np.frombuffer(x, "<u4") for x in anchors["data"]]
            keys, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(keys, kind="stable")
            first = np.concatenate([[True], np.diff(keys[order]) != 0])
            group = np.cumsum(first) - 1
            count = np.empty(len(keys), np.int64)
            count[order] = np.bincount(group)[group]
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            for kind, chosen in ((0, (count > 1) & (count < CROWDED)), (2, count >= CROWDED)):
                for block, own in zip(anchors["block"], np.split(chosen, cuts), strict=True):
                    if own.any():
                        out.append((block, kind, np.packbits(own).tobytes()))
        texts = rows[rows["kind"] == 1]
        smallest: dict[bytes, int] = {}
        held = [np.frombuffer(x, COPY).tolist() for x in texts["data"]]
        for pairs in held:
            for sha, doc in pairs:
                smallest[sha] = min(doc, smallest.get(sha, LAST))
        for block, pairs in zip(texts["block"], held, strict=True):
            less = [(sha, smallest[sha]) for sha, doc in pairs if smallest[sha] < doc]
            if less:
                out.append((block, 1, np.array(less, COPY).tobytes()))
        return pd.DataFrame({"block": pd.Series([x[0] for x in out], dtype="int64"), "kind": pd.Series([x[1] for x in out], dtype="int32"), "bucket": pd.Series([bucket] * len(out), dtype="int64"), "data": [x[2] for x in out]})

    sent = blocks.mapInArrow(send, SENT)
    answers = sent.groupBy("bucket").applyInPandas(answer, "block long, kind int, bucket long, data binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("answers"))


class Suffixes:
    """The suffixes of a block at its shared anchors, equal ones once, by part in sorted order."""

    def __init__(self, own: Block, answers: list[dict] | None, bits: int, parts: int):
        at, hashes = own.anchors()
        keys = keys_of(hashes, bits)
        doc = np.searchsorted(own.ends, at, "right")
        # the answers are bits for the keys as they were sent
        sent = np.unique(keys[~own.copies()[doc]])
        places = {bucket: (a, b) for bucket, a, b in sent_keys(sent)}
        held = {0: np.zeros(len(sent), bool), 2: np.zeros(len(sent), bool)}
        for answer in answers or []:
            if answer["kind"] == 1:
                for sha, low in np.frombuffer(answer["data"], COPY).tolist():
                    sha = sha.ljust(16, b"\0")
                    own.smallest[sha] = min(low, own.smallest.get(sha, LAST))
            else:
                a, b = places[answer["bucket"]]
                held[answer["kind"]][a:b] = np.unpackbits(np.frombuffer(answer["data"], np.uint8), count=b - a)
        self.own = own
        copy = own.copies()
        at, hashes, keys, doc = (x[~copy[doc]] for x in (at, hashes, keys, doc))
        place = np.searchsorted(sent, keys)
        shared, crowded = held[0][place], held[2][place]
        order = np.lexsort((doc, keys))
        k, d = keys[order], doc[order]
        near = np.zeros(len(k), bool)
        if len(k) > 1:
            same = (k[1:] == k[:-1]) & (d[1:] != d[:-1])
            groups = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1
            near = np.isin(groups, groups[1:][same])
        local = np.zeros(len(k), bool)
        local[order] = near
        plain = (shared | local) & ~crowded
        windows = at[crowded][:, None] - np.arange(PLACES)
        owner = np.broadcast_to(doc[crowded][:, None], windows.shape)
        whole = (windows >= own.starts[owner]) & (windows + LENGTH <= own.ends[owner])
        single, index = np.unique(windows[whole], return_index=True)
        single_doc = owner[whole][index]
        self.at = np.concatenate([at[plain], single])
        self.doc = np.concatenate([doc[plain], single_doc])
        self.before = np.concatenate([np.minimum(BEFORE, at[plain] - own.starts[doc[plain]]), np.zeros(len(single), np.int64)])
        self.after = np.minimum(LENGTH, own.ends[self.doc] - self.at) if len(self.at) else np.empty(0, np.int64)
        raw = np.zeros(len(own.raw) + BEFORE + LENGTH, np.uint8)
        raw[BEFORE : BEFORE + len(own.raw)] = np.frombuffer(own.raw, np.uint8)
        text = raw[self.at[:, None] + np.arange(BEFORE + LENGTH)]
        text[:, :BEFORE][np.arange(BEFORE) < (BEFORE - self.before)[:, None]] = 0
        text[:, BEFORE:][np.arange(LENGTH) >= self.after[:, None]] = 0
        if len(single):
            windowed = text[len(at[plain]) :, BEFORE:].astype(np.uint64)
            mixed = np.zeros(len(single), np.uint64)
            for j in range(LENGTH):
                mixed = (mixed + windowed[:, j] + np.uint64(1)) * MULTIPLIERS[0]
                mixed ^= mixed >> np.uint64(31)
            part_hash = np.concatenate([hashes[plain], mixed])
        else:
            part_hash = hashes[plain]
        self.part = ((part_hash & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
        # sorted by part, suffix, text before it, lengths, then doc_id, so that the first of equal ones has the smallest
        self.lengths = self.before * 64 + self.after
        record = np.empty(len(self.at), [("part", ">u4"), ("suffix", f"V{LENGTH}"), ("before", f"V{BEFORE}"), ("lengths", ">u2")])
        record["part"], record["lengths"] = self.part, self.lengths
        rows = record.view(np.uint8).reshape(len(self.at), -1) if len(self.at) else np.empty((0, 4 + LENGTH + BEFORE + 2), np.uint8)
        rows[:, 4 : 4 + LENGTH], rows[:, 4 + LENGTH : -2] = text[:, BEFORE:], text[:, :BEFORE]
        wide = -(-rows.shape[1] // 8) * 8
        bytes8 = np.zeros((len(rows), wide), np.uint8)
        bytes8[:, : rows.shape[1]] = rows
        numbers = bytes8.view(">u8").astype(np.uint64)
        self.order = np.lexsort((own.ids[self.doc], *(numbers[:, j] for j in range(numbers.shape[1] - 1, -1, -1)))) if len(rows) else np.empty(0, np.int64)
        rows = rows[self.order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        self.group = np.empty(len(rows), np.int64)
        self.group[self.order] = np.cumsum(new) - 1
        self.kept = rows[new]
        self.kept_doc = own.ids[self.doc[self.order]][new]
        self.kept_part = self.part[self.order][new]

    def runs(self) -> list[tuple[int, bytes]]:
        """Part and front-coded run of each part: numbers of suffixes, shared lengths, rests, what stands before, lengths, doc_ids."""
        out = []
        pack = zstandard.ZstdCompressor(level=3)
        cuts = np.flatnonzero(np.diff(self.kept_part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.kept)], strict=True):
            if a < b:
                rows = self.kept[a:b]
                suffix, before = rows[:, 4 : 4 + LENGTH], rows[:, 4 + LENGTH : -2]
                lcp = shared_lengths(suffix)
                rests = suffix[np.arange(LENGTH) >= lcp[:, None]]
                out.append((int(self.kept_part[a]), pack.compress(b"".join([np.array([b - a], "<u4").tobytes(), lcp.astype(np.uint8).tobytes(), rests.tobytes(), before.tobytes(), rows[:, -2:].tobytes(), self.kept_doc[a:b].astype("<i8").tobytes()]))))
        return out


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def decoded(data: bytes) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A run's shared lengths, whole suffixes, bytes before, lengths and doc_ids."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    lcp = np.frombuffer(data, np.uint8, n, 4)
    at = 4 + n
    suffixes, last = [], b""
    shared = lcp.tolist()
    for k in shared:
        last = last[:k] + data[at : at + LENGTH - k]
        at += LENGTH - k
        suffixes.append(last)
    before = np.frombuffer(data, np.uint8, n * BEFORE, at).reshape(n, BEFORE)
    lengths = np.frombuffer(data, ">u2", n, at + n * BEFORE).astype(np.int64)
    return shared, suffixes, before, lengths, np.frombuffer(data, "<i8", n, at + n * (BEFORE + 2))


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted runs (shared lengths, strings of equal length).

    Returns the run that each string of the result comes from (a run's own strings stay in order) and the
    length it shares with the string before it. A contestant's known length is what it shares with the
    last winner; the longer known length wins, and only equal ones are compared, from that byte on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    known = [0 if i < len(runs) and runs[i][1] else -1 for i in range(k)]
    current = [runs[i][1][0] if known[i] == 0 else b"" for i in range(k)]
    at = [0] * k
    losers = [0] * k

    def loses(a: int, b: int) -> bool:
        """Whether a loses to b; the loser's known length becomes what it shares with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return ka < kb
        if ka < 0:
            return a > b
        x, y = current[a][ka:], current[b][ka:]
        if x == y:
            known[max(a, b)] = ka + len(x)
            return a > b
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        shared = ka + len(x) - (differ.bit_length() + 7) // 8
        lost = x > y
        known[a if lost else b] = shared
        return lost

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if loses(a, b):
            a, b = b, a
        losers[node] = b
        return a

    winner = play(1) if k > 1 else 0
    sources, lengths = [], []
    while known[winner] >= 0:
        sources.append(winner)
        lengths.append(known[winner])
        shared, strings = runs[winner]
        at[winner] += 1
        if at[winner] < len(strings):
            known[winner], current[winner] = shared[at[winner]], strings[at[winner]]
        else:
            known[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            if known[other] > known[winner] or (known[other] == known[winner] and loses(winner, other)):
                losers[node], winner = winner, other
            node >>= 1
    return sources, lengths


def smaller_places(lcp: np.ndarray, before: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For suffixes in sorted order: bit a is set if the 50-byte string that starts a bytes before the suffix also is in a smaller document."""
    n = len(docs)
    reverse = np.zeros((n, 32), np.uint8)
    reverse[:, :BEFORE] = before[:, ::-1]
    numbers = reverse.view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(numbers[:, j] for j in range(3, -1, -1)))
    left_lcp = shared_lengths(reverse[order])
    masks = np.zeros(n, np.uint32)
    n_before, n_after = lengths >> 6, lengths & 63
    group = np.cumsum(lcp < GRAM)
    alone = np.bincount(group)[group] == 1
    for a in range(PLACES):
        valid = np.flatnonzero((n_before >= a) & (n_after >= LENGTH - a) & ~alone)
        if not len(valid):
            continue
        right = np.cumsum(lcp < LENGTH - a)
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(left_lcp < a) if a else 0
        key = right[valid] * (n + 1) + left[valid]
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
        low = np.minimum.reduceat(docs[valid][by], starts)
        lowest = np.repeat(low, np.diff(np.append(starts, len(by))))
        hit = valid[by[lowest < docs[valid][by]]]
        masks[hit] |= np.uint32(1 << a)
    return masks


def merged_part(rows: pd.DataFrame) -> pd.DataFrame:
    """block, part, masks of each run of a part, in the run's order."""
    rows = rows.sort_values("block")
    runs = [decoded(x) for x in rows["data"]]
    sources, lcp = merge([(r[0], r[1]) for r in runs])
    sizes = np.array([len(r[1]) for r in runs])
    source = np.array(sources)
    # a run's strings stay in order, so sorting the result's sources stably gives their places
    places = np.argsort(source, kind="stable")
    before, lengths, docs = (np.concatenate([r[i] for r in runs]) for i in (2, 3, 4))
    row_of = np.empty(len(source), np.int64)
    row_of[places] = np.arange(len(source))
    found = smaller_places(np.array(lcp), before[row_of], lengths[row_of], docs[row_of])
    masks = np.empty(len(source), np.uint32)
    masks[row_of] = found
    cuts = np.cumsum(sizes)[:-1]
    return pd.DataFrame({"block": rows["block"].to_numpy(), "part": rows["part"].to_numpy(), "masks": [m.astype("<u4").tobytes() for m in np.split(masks, cuts)]})


def _suffixes(batch: pa.RecordBatch, row: int, bits: int, parts: int) -> Suffixes:
    ids, lens, z, answers = (batch.column(i)[row].as_py() for i in (1, 2, 3, 4))
    return Suffixes(Block(ids, lens, z), answers, bits, parts)


def remove_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if with_text)."""
    blocks = materialise(packed(docs), "blocks")
    total = blocks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    anchors = total * 2 // (PLACES + 1)
    bits = min(24, max(4, (anchors // BUCKET).bit_length()))
    parts = max(16, anchors // PART)
    answered = materialise(exchanged(blocks, bits), "answers")
    joined = blocks.join(answered, "block", "left").select("block", "ids", "lens", "z", "answers")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                out = _suffixes(batch, row, bits, parts).runs()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([batch.column(0)[row].as_py()] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["part", "block", "data"])

    merged = joined.mapInArrow(send, RUN).groupBy("part").applyInPandas(merged_part, "block long, part long, masks binary")
    marks = materialise(merged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "masks"))).alias("marks")), "marks")
    last = joined.join(marks, "block", "left").select("block", "ids", "lens", "z", "answers", "marks")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                yield finished(_suffixes(batch, row, bits, parts), batch.column(5)[row].as_py() or [], with_text)

    return last.mapInArrow(finish, RESULT + (", kept binary" if with_text else ""))


def finished(found: Suffixes, marks: list[dict], with_text: bool) -> pa.RecordBatch:
    """A block's rows of the result."""
    own = found.own
    masks = np.frombuffer(b"".join(m["masks"] for m in marks), "<u4")  # parts ascend, as do the kept suffixes'
    cover = np.zeros(len(own.raw) + 1, np.int64)
    if len(found.at):
        mask = masks[found.group]
        later = own.ids[found.doc] > found.kept_doc[found.group]
        for a in range(PLACES):
            hit = (later | (mask >> np.uint32(a) & np.uint32(1)).astype(bool)) & (found.before >= a) & (found.after >= LENGTH - a)
            starts = found.at[hit] - a
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + LENGTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    raw = np.frombuffer(own.raw, np.uint8)
    done: dict[tuple[bytes, int], tuple[int, int, str, bytes]] = {}
    rows: list[tuple] = []
    for i, (a, b) in enumerate(zip(own.starts.tolist(), own.ends.tolist(), strict=True)):
        doc, sha = int(own.ids[i]), own.shas[i]
        key = (sha, doc)
        if key not in done:
            lost = gone[a:b]
            if doc > own.smallest[sha] and b - a >= LENGTH:
                lost = np.ones(b - a, bool)
            spans = int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(b > a and lost[0])
            kept = raw[a:b][~lost].tobytes() if spans else own.raw[a:b]
            done[key] = (int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else b"")
        rows.append((None if doc == LAST else doc, b - a, *done[key]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(6 if with_text else 5)]
    return pa.RecordBatch.from_arrays(columns, names[: len(columns)])
