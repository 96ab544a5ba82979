"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash
of the ``mmer``-word groups in it. Neighbouring windows mostly share their minimiser: they
travel together as one packed string of words to the minimiser's bucket, at most ``RUN``
windows each; a task's packed strings for one bucket are compressed together. Equal windows
have equal minimisers, so they meet in one bucket; there, sorting brings equal windows
together (hashes first, then the words' bytes decide) and gives the smallest doc_id in which
each window starts. Words covered by a window that also starts in a
document with a smaller doc_id are removed.

Equal packed strings are combined where they are made, so a passage in a third of all
documents sends its words once a task, not once a document. Windows are judged on the input. Null
and short texts have no window. A null doc_id counts as larger than any other. Rows that
repeat a doc_id are judged each by its own text and never against each other; rows that agree
in doc_id and text are one document, whose places count once however often it stands in the
table. Repeats inside one document stay. Extra columns are ignored.

A string that stands more than ``FEW`` times in what a task sends at once goes to its bucket with
its smallest doc_id alone, under the name of that sending. The places of all such strings of a
sending go round the judge together, by document: they meet the judge's answers, the smallest
doc_id of each window of each string, by that name. So what a bucket holds doesn't grow with the
documents that share a passage, and the strings of one document, which follow each other, give
one range of words to remove where they touch, not one each.

A document is named by its doc_id, and where ids repeat or are null also by the 64-bit hash of
its text.

A task holds one bucket's distinct packed strings at a time, so the number of buckets grows
with the text (``BUCKET_BYTES``), and that of tasks too (``TASK_BYTES``). A group of words that is
frequent in the language would be the minimiser of ever more windows, all in one bucket. Such
minimisers are looked for in a sample of the documents; windows that have one go by a second
minimiser, of longer groups (``LONG_MMER``), together with the first. Equal windows still meet: which
minimisers are split is settled before any window is sent, and changes where windows meet, not
whether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, stored

WINDOW, MMER, LONG_MMER = 13, 3, 8
#: Documents in which frequent minimisers are looked for: this many, or this share if it is more;
#: and the windows, as a multiple of what a bucket should get, from which a minimiser is split.
SAMPLE_DOCS, SAMPLE_SHARE, HOT_SHARE = 4_000, 0.001, 4.0
#: Least windows of a sample that make a minimiser frequent.
HOT_WINDOWS = 50
#: Windows in one packed string at most.
RUN = 64
#: Words of a document that are looked at together; the next piece overlaps it by a window.
SEGMENT = 200_000
#: Text bytes a bucket aims at (packed, about three times that), and buckets a task at least.
BUCKET_BYTES, BUCKETS_A_TASK = 3_000_000, 6
#: Text bytes that a task of the second half gets at most, on average.
TASK_BYTES = 128_000_000
#: Packed bytes a task gathers before it compresses and sends them, by bucket.
FLUSH_BYTES = 24_000_000
#: Zstandard level of what is sent: 7 % smaller than at 3 for some 20 CPU seconds more a GB of text.
LEVEL = 6
#: Occurrences of a string, in what a task sends at once, up to which they travel with it.
FEW = 64
#: Occurrences that are judged at once.
GATHER = 40_000
_LAST = 2**63 - 1
#: The position that marks an occurrence as a name for many.
_MANY = 2**32 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OCC = np.dtype([("doc", "<i8"), ("sum", "<i8"), ("at", "<u4")])
_NONE = np.zeros(0, np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64, by doubling."""
    out = np.ones(n + 1, np.uint64)
    k = 1
    with np.errstate(over="ignore"):
        while k <= n:
            m = min(k, n + 1 - k)
            out[k : k + m] = out[:m] * (out[k - 1] * base)
            k += m
    return out


class _Powers:
    """base ** n for arrays of n below 2 ** 32, from two tables."""

    def __init__(self, base: int):
        self.low = _powers(np.uint64(base), (1 << 16) - 1)
        self.high = _powers(np.uint64(pow(base, 1 << 16, 1 << 64)), (1 << 16) - 1)

    def __call__(self, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.low[n & 0xFFFF] * self.high[n >> 16]

    def block(self, k: int, n: int) -> np.ndarray:
        """The powers from k * 2 ** 16 on, n of them."""
        with np.errstate(over="ignore"):
            return self.low[:n] * self.high[k]


class _Bytes:
    """Hashes of byte ranges in constant time each, from running sums (8 bytes a byte)."""

    up, down = _Powers(int(_BASE)), _Powers(pow(int(_BASE), -1, 1 << 64))

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k, at in enumerate(range(0, n, 1 << 16)):
                part = self.data[at : at + (1 << 16)].astype(np.uint64) + np.uint64(1)
                np.cumsum(part * self.up.block(k, len(part)), out=self.sums[at + 1 : at + 1 + len(part)])
                self.sums[at + 1 : at + 1 + len(part)] += self.sums[at]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[b] - self.sums[a]) * self.down(a)
            return _mix(h + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; rows end at line feeds."""
    stops = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], stops + 1]), np.concatenate([stops, [len(data)]])
    row = np.concatenate([[0], np.cumsum(data[stops] == 10)])
    return starts, ends, row


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


def _minimisers(word: np.ndarray, window: int, mmer: int) -> np.ndarray:
    """The minimiser of the window that starts at each word."""
    with np.errstate(over="ignore"):
        group = np.zeros(max(0, len(word) - mmer + 1), np.uint64)
        for k in range(mmer):
            group = group * np.uint64(0xFF51AFD7ED558CCD) + word[k : len(word) - mmer + 1 + k]
    return _sliding_min(_mix(group), window - mmer + 1)


def _pack(rows: list[tuple[int, int, int, list[bytes]]], window: int, mmer: int, found: dict[bytes, list], hot: np.ndarray = _NONE) -> int:
    """Add the packed strings of some documents (doc, sum, first word, words), each with its
    minimiser and its occurrences. Returns the bytes added. ``hot``: minimisers to split, sorted."""
    flat = b"\n".join(b" ".join(r[3]) for r in rows)
    text = _Bytes(flat)
    starts, ends, row = _words(text.data)
    word = text.hash(starts, ends)
    least = _minimisers(word, window, mmer)
    real = np.flatnonzero(row[: len(least)] == row[window - 1 :])  # windows inside one document
    if len(hot):
        split = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least)
        if len(split):
            second = _minimisers(word, window, min(LONG_MMER, window))
            with np.errstate(over="ignore"):
                least[split] = _mix(least[split] * np.uint64(3) + second[split])
    least, owner = least[real], row[real]
    fresh = np.ones(len(real), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    run = np.arange(len(real)) - np.repeat(first, np.diff([*first, len(real)]))
    first = np.flatnonzero(run % RUN == 0)
    last = np.append(first[1:], len(real)) - 1
    word0 = np.searchsorted(row, np.arange(len(rows)))
    occ = np.empty(len(first), _OCC)
    docs, sums, ats = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    occ["doc"], occ["sum"], occ["at"] = docs[owner[first]], sums[owner[first]], real[first] - word0[owner[first]] + ats[owner[first]]
    raw, size, added = occ.tobytes(), _OCC.itemsize, 0
    for i, (a, b, m) in enumerate(zip(starts[real[first]].tolist(), ends[real[last] + window - 1].tolist(), least[first].tolist(), strict=True)):
        if (e := found.get(packed := flat[a:b])) is None:
            found[packed] = [m, raw[size * i : size * i + size]]
            added += b - a + 64
        else:
            e[1] += raw[size * i : size * i + size]
            added += size
    return added


def _planes(a: np.ndarray) -> bytes:
    """The bytes of a column of numbers, all first ones, then all second ones: they compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    """The column of n numbers whose ``_planes`` begin at ``at``."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def _columns(occ: np.ndarray) -> bytes:
    """Occurrences by column, doc_ids as differences."""
    return b"".join([_planes(np.diff(occ["doc"], prepend=0)), _planes(occ["sum"]), _planes(occ["at"])])


def _occurrences(raw: bytes, m: int, at: int) -> np.ndarray:
    """The m occurrences whose ``_columns`` begin at ``at``."""
    occ = np.empty(m, _OCC)
    occ["doc"] = np.cumsum(_numbers(raw, np.int64, m, at))
    occ["sum"] = _numbers(raw, np.int64, m, at + 8 * m)
    occ["at"] = _numbers(raw, np.uint32, m, at + 16 * m)
    return occ


def _blob(items: list[tuple[bytes, list]]) -> bytes:
    """Packed strings and their occurrences, by column, compressed."""
    occ = np.frombuffer(b"".join(e[1] for _, e in items), _OCC)
    counts = np.array([len(e[1]) // _OCC.itemsize for _, e in items], np.uint32)
    body = b"\n".join(p for p, _ in items)
    head = np.array([len(items), len(occ)], np.uint32)
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([head.tobytes(), _planes(counts), _columns(occ), body]))


def _open(blob: bytes) -> Iterator[tuple[bytes, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    at = 8
    counts = _numbers(raw, np.uint32, n, at)
    ends = (np.cumsum(counts) * _OCC.itemsize).tolist()
    data = _occurrences(raw, m, at + 4 * n).tobytes()
    for packed, a, b in zip(raw[at + 4 * n + 20 * m :].split(b"\n"), [0, *ends[:-1]], ends, strict=True):
        yield packed, data[a:b]


def _signed(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _aside(found: dict[bytes, list]) -> tuple[int, bytes] | None:
    """Take the places of frequent strings out: their name, and all of them by document, each with its
    string's number in a list of the strings' hashes. What names them is a hash of all that, so that
    a task that runs again gives the same name."""
    often: dict[int, list] = {}
    for packed, e in found.items():
        if len(e[1]) > FEW * _OCC.itemsize:
            often.setdefault(_signed(packed), e)  # of two that share a hash, one keeps its places
    if not often:
        return None
    occ = np.frombuffer(b"".join(e[1] for e in often.values()), _OCC)
    of = np.repeat(np.arange(len(often), dtype=np.uint32), [len(e[1]) // _OCC.itemsize for e in often.values()])
    order = np.lexsort((occ["at"], occ["sum"], occ["doc"]))
    head = np.array([len(often), len(occ)], np.uint32)
    raw = b"".join([head.tobytes(), _planes(np.array([*often], np.int64)), _planes(of[order]), _columns(occ[order])])
    ref = _signed(raw)
    for e in often.values():
        e[1] = np.array([(np.frombuffer(e[1], _OCC)["doc"].min(), ref, _MANY)], _OCC).tobytes()
    return ref, zstandard.ZstdCompressor().compress(raw)


def _open_aside(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings' hashes, the number of the string of each place, and the places."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    at = 8 + 8 * n
    return _numbers(raw, np.int64, n, 8), _numbers(raw, np.uint32, m, at), _occurrences(raw, m, at + 4 * m)


def _send(found: dict[bytes, list], buckets: int) -> pa.RecordBatch:
    aside = _aside(found)
    items = list(found.items())
    bucket = (np.array([e[0] for _, e in items], np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    stops = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = np.split(order, stops)
    sent = [(int(bucket[g[0]]), _blob([items[i] for i in g.tolist()]), None) for g in groups]
    if aside:
        ref, places = aside
        sent.append((ref % buckets, places, ref))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*sent, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["bucket", "blob", "ref"])


def _frequent(docs: DataFrame, buckets: int, n: int, window: int, mmer: int) -> np.ndarray:
    """Minimisers that more windows of a sample have than a bucket should get, sorted: at most
    ``buckets / HOT_SHARE`` of them, and few in practice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = [(t or "").encode("utf-8").split() for t in part.column("text").to_pylist()]
                flat = b"\n".join(b" ".join(w) for w in words)
                text = _Bytes(flat)
                starts, ends, row = _words(text.data)
                least = _minimisers(text.hash(starts, ends), window, mmer)
                keys, counts = np.unique(least[row[: len(least)] == row[window - 1 :]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(counts, pa.int64())], names=["m", "n"])

    sample = docs.select("text").sample(min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, n))), seed=1)
    counts = sample.mapInArrow(run, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(HOT_WINDOWS, HOT_SHARE * total / buckets)
    return np.sort(np.array([r["m"] for r in counts.where(F.col("n") >= least).select("m").toLocalIterator()], np.int64).view(np.uint64))


def super_kmers(docs: DataFrame, buckets: int, window: int = WINDOW, mmer: int = MMER, hot: np.ndarray = _NONE) -> DataFrame:
    """bucket, blob: the distinct packed strings of a task's documents (doc, sum, text), with the
    documents and word positions where they begin; and, under a ref with a blob of their own, the
    places of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        seen: set[tuple[int, int]] = set()  # documents that may stand here again
        held = 0
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, s, t in zip(*(part.column(c).to_pylist() for c in ("doc", "sum", "text")), strict=True):
                    if s:
                        if (i, s) in seen:
                            continue
                        seen.add((i, s))
                        held += 200
                    ws = (t or "").encode("utf-8").split()
                    for at in range(0, len(ws) - window + 1, SEGMENT):
                        rows.append((i, s, at, ws[at : at + SEGMENT + window - 1]))
                if rows:
                    held += _pack(rows, window, mmer, found, hot)
                if held >= FLUSH_BYTES:
                    if found:
                        yield _send(found, buckets)
                    found, seen, held = {}, set(), 0
        if found:
            yield _send(found, buckets)

    return docs.select("doc", "sum", "text").mapInArrow(run, "bucket bigint, blob binary, ref bigint")


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the byte ranges at a and b, of ``size`` bytes each, are equal."""
    out = np.ones(len(a), bool)
    step = max(1, 4_000_000 // max(1, int(size.max(initial=1))))
    for k in range(0, len(a), step):
        n = size[k : k + step]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        diff = data[np.repeat(a[k : k + step], n) + inner] != data[np.repeat(b[k : k + step], n) + inner]
        out[k : k + step] = ~np.logical_or.reduceat(diff, begin)
    return out


def _once(occ: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once: a document that stands in several rows has sent its places as often."""
    owner = np.repeat(np.arange(len(counts)), counts)
    maybe = np.flatnonzero((counts > 1)[owner] & (occ["sum"] != 0))
    if not len(maybe):
        return occ, counts
    order = maybe[np.lexsort((occ["at"][maybe], occ["sum"][maybe], occ["doc"][maybe], owner[maybe]))]
    again = np.flatnonzero((owner[order[1:]] == owner[order[:-1]]) & (occ[order[1:]] == occ[order[:-1]])) + 1
    stay = np.ones(len(occ), bool)
    stay[order[again]] = False
    return occ[stay], np.bincount(owner[stay], minlength=len(counts))


def _spans(occ: np.ndarray, wins: np.ndarray, least: np.ndarray, window: int) -> list[np.ndarray]:
    """doc, sum, start and stop of the runs of words to remove. ``wins``: windows of each occurrence;
    ``least``: the smallest doc_id of each of those windows, one after the other."""
    begin = np.cumsum(wins) - wins
    who = np.repeat(np.arange(len(occ)), wins)
    inner = np.arange(len(who)) - begin[who]
    cut = least < occ["doc"][who]
    edge = np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))
    s = np.flatnonzero(cut & ((inner == 0) | (edge[:-1] == 1)))
    e = np.flatnonzero(cut & ((inner == wins[who] - 1) | (edge[1:] == -1)))
    at = occ["at"].astype(np.int64)
    return [occ["doc"][who[s]], occ["sum"][who[s]].astype(np.int64), at[who[s]] + inner[s], at[who[e]] + inner[e] + window]


def _joined(doc: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Ranges in the order of documents and starts; of one document, those that touch become one."""
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] > stop[:-1])
    head = np.flatnonzero(fresh)
    return [doc[head], own[head], start[head], np.maximum.reduceat(stop, head) if len(head) else stop]


_SPANS = ("doc", "sum", "start", "stop")
_JUDGED = pa.schema([*((c, pa.int64()) for c in (*_SPANS, "ref", "sha")), ("answer", pa.list_(pa.int64())), ("places", pa.binary())])


def _row_batch(**cols: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in _JUDGED], schema=_JUDGED)


def _judge(packed: dict[bytes, list[bytes]], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of words to remove, from all packed strings of some minimisers; and the smallest doc_id
    of each window of frequent strings."""
    flat = b"\n".join(packed)
    whole = [b"".join(x) for x in packed.values()]
    occ = np.frombuffer(b"".join(whole), _OCC)
    counts = np.fromiter(map(len, whole), np.int64, len(packed)) // _OCC.itemsize
    occ, counts = _once(occ, counts)
    base = np.cumsum(counts) - counts
    lowest = np.minimum.reduceat(occ["doc"], base)
    text = _Bytes(flat)
    starts, ends, row = _words(text.data)
    win = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    a, b, owner = starts[win], ends[win + window - 1], row[win]
    h = text.hash(a, b)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.append(head, len(h)))
    least = np.minimum.reduceat(lowest[owner[order]], head)[group]
    many = np.flatnonzero(size[group] > 1)
    if len(many):
        x, y = order[many], order[head[group[many]]]
        n = b[x] - a[x]
        equal = n == b[y] - a[y]
        equal[equal] = _same(text.data, a[x][equal], a[y][equal], n[equal])
        for g in np.unique(group[many[~equal]]).tolist():  # hashes meet by chance: the bytes decide
            members = order[head[g] : head[g] + size[g]]
            keys = [flat[p:q] for p, q in zip(a[members].tolist(), b[members].tolist(), strict=True)]
            best: dict[bytes, int] = {}
            for k, o in zip(keys, lowest[owner[members]].tolist(), strict=True):
                best[k] = min(o, best.get(k, _LAST))
            least[head[g] : head[g] + size[g]] = [best[k] for k in keys]
    smallest = np.empty(len(h), np.int64)
    smallest[order] = least
    # Each occurrence of a packed string against the smallest doc_id of each of its windows.
    wins = np.bincount(owner, minlength=len(packed))
    first = np.cumsum(wins) - wins
    touched = (counts > 1) | np.logical_or.reduceat(smallest < lowest[owner], first)
    of = np.repeat(np.arange(len(packed)), counts)
    many = occ["at"] == _MANY
    names = np.flatnonzero(many)
    if len(names):
        strings = list(packed)
        answers = [smallest[first[r] : first[r] + wins[r]] for r in of[names].tolist()]
        yield _row_batch(ref=pa.array(occ["sum"][names], pa.int64()), sha=pa.array([_signed(strings[r]) for r in of[names].tolist()], pa.int64()), answer=pa.array(answers, pa.list_(pa.int64())))
    real = np.flatnonzero(touched[of] & ~many)
    for k in range(0, len(real), max(1, GATHER)):
        o = real[k : k + GATHER]
        n = wins[of[o]]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        cols = _spans(occ[o], n, smallest[np.repeat(first[of[o]], n) + inner], window)
        if len(cols[0]):
            yield _row_batch(**{c: pa.array(x, pa.int64()) for c, x in zip(_SPANS, cols, strict=True)})


def _named(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text, doc (null: the largest bigint) and sum: zero, or the 64-bit hash of the text if
    the doc_id is null or may repeat."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    unique = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)), "sum": F.when(F.col("doc_id").isNull(), hashed).otherwise(0) if unique else hashed})


def repeated_spans(named: DataFrame, window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """doc, sum, start, stop: word ranges to remove, of documents named as by ``_named``; ranges may
    overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}
        at = None
        for batch in batches:
            aside = batch.filter(batch.column("ref").is_valid())
            if aside.num_rows:
                yield _row_batch(ref=aside.column("ref"), places=aside.column("blob"))
            batch = batch.filter(batch.column("ref").is_null())
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if bucket != at:
                    if held:
                        yield from _judge(held, window)
                    held, at = {}, bucket
                for packed, occ in _open(blob.as_py()):
                    held.setdefault(packed, []).append(occ)
        if held:
            yield from _judge(held, window)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, answers in zip(batch.column("places"), batch.column("answers"), strict=True):
                shas, of, occ = _open_aside(raw.as_py())
                sha, answer = answers.values.field("sha").to_numpy(), answers.values.field("answer")
                order = np.argsort(sha)
                at = order[np.minimum(np.searchsorted(sha, shas, sorter=order), len(sha) - 1)]
                if (sha[at] != shas).any():
                    raise ValueError("a frequent string has no answer")
                wins = answer.value_lengths().to_numpy().astype(np.int64)
                first, least = (np.cumsum(wins) - wins)[at], answer.flatten().to_numpy()
                wins = wins[at]
                step = max(1, GATHER // 8)
                for k in range(0, len(occ), step):
                    part, n = of[k : k + step], wins[of[k : k + step]]
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    cols = _joined(*_spans(occ[k : k + step], n, least[np.repeat(first[part], n) + inner], window))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=[*_SPANS])

    total = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    tasks = max(shuffle_partitions(named.sparkSession), total["b"] // TASK_BYTES)
    buckets = max(BUCKETS_A_TASK * tasks, total["b"] // BUCKET_BYTES)
    packed = super_kmers(named, buckets, window, mmer, _frequent(named, buckets, total["n"], window, mmer))
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    spans = "doc bigint, sum bigint, start bigint, stop bigint"
    judged = stored(dealt.mapInArrow(run, f"{spans}, ref bigint, sha bigint, answer array<bigint>, places binary"), "judged")
    found, places = judged.where("doc is not null").select(*_SPANS), judged.where("places is not null").select("ref", "places")
    if places.isEmpty():
        return found
    # As many answers to a name as a sending has frequent strings: FLUSH_BYTES bounds them, and the places.
    answers = judged.where("answer is not null").groupBy("ref").agg(F.collect_list(F.struct("sha", "answer")).alias("answers"))
    return found.unionByName(places.join(answers.hint("merge"), "ref").select("places", "answers").mapInArrow(answered, spans))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row."""
    named = _named(docs, text)
    spans = repeated_spans(named, window, mmer).groupBy("doc", "sum").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = named.join(spans, ["doc", "sum"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, gone, kept = [], [], []
                for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    ws = (t or "").encode("utf-8").split()
                    stay = np.ones(len(ws), bool)
                    for s in spans or ():
                        stay[s["start"] : s["stop"]] = False
                    n.append(len(ws))
                    gone.append(len(ws) - int(stay.sum()))
                    kept.append(b" ".join(ws if not gone[-1] else [ws[i] for i in np.flatnonzero(stay).tolist()]).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
