"""Join of documents whose sets of word n-grams overlap by a Jaccard share: prefix trees of globally ordered sets.

1. Sets. A pass over the texts gives each document its set's size, key (a hash of the set) and parity map (see below), and
   counts n-grams in a table of SLOTS counters, a size that does not depend on the input. Equal sets are one class. The
   counts order all n-grams, rare ones first; where they share a counter, by their hashes: one order for all sets.
2. Lists. Of two linked sets A and B, each holds one of the other's first |A| - ceil(t |A|) + 1 n-grams in that order among
   its own first ones. A second pass sends these, and the classes that share one meet in its list.
3. Blocks. A class stays in a list only beside a class it may link with, by their sizes and by their parity maps: bit i
   tells whether an odd number of a set's n-grams fall on i, so that two maps differ in no more bits than the sets differ
   in n-grams. Classes that may link, directly or through others, are a block. Nothing is lost by this: any two that link
   share a list, and pass.
4. Trees. The sets of a block form a prefix tree along the global order, read from its frequent end, so that paths begin
   with what many share. All sets walk it at once: what they share with a path is counted once for all paths that begin
   with it, and a set leaves a subtree as soon as what remains below can't reach the overlap it needs. Only links between
   what is not joined yet are kept: at most one fewer than there are sets.
5. Blocks beyond CHUNK classes or CHUNK_MEMBERS n-grams are walked in chunks that share some members. Where that leaves
   such a block in more than one piece, all classes outside its largest piece are walked once more together with each
   chunk, so that no link is lost; that is quadratic in what the first walk left alone, and only in that.

An n-gram that more than HOT classes of a list share joins them all, unfiltered, by a star; one whose counter says that it
is in many millions of sets is dealt over several tasks, whose stars meet in their least members.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import blocks_for, discard, materialise
from winnow.llm.components import connected

#: What one walk takes at most: classes and n-grams; classes that all chunks of a block share.
CHUNK, CHUNK_MEMBERS, SHARED = 1024, 500_000, 8
POSTINGS = 1_000_000  # that a walk looks up at once
HASHES, MEMBERS, MAPS = 200_000, 1_000_000, 8 << 20  # sent hashes, walked n-grams and bytes of parity maps in a task
HOT = 20_000  # classes that are compared within a list
SPLIT = 8 * 22  # counters from here (2 ** 22 sets) have their n-grams dealt over several tasks
SMALL = 32  # classes of a list whose pairs are compared at once with those of other lists
PAIRS = 2_000_000  # that are compared at once
_WORDS_KEPT = 200_000
SLOTS, PARTS, FAN_IN = 1 << 22, 64, 256  # counters of n-grams, the parts they are summed in, and arrays summed at once
_SLOT = np.uint64(64 - 22)  # the first bits of a hash name its counter
_WIDEST = 16  # the longest parity map has 2 ** 16 bits
_MARKS = 1 << 24  # bits of the map that is broadcast: 2 ** 18 rows at most, whatever the input
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def ngram_set(text: bytes | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; A-Z count as a-z; a text of fewer words is one n-gram."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _M1 + h[i : len(words) - k + 1 + i]
    return np.unique(mix(out))


def set_key(members: np.ndarray) -> np.int64:
    return (mix(members).sum(dtype=np.uint64, keepdims=True) * _M1 + np.uint64(len(members))).astype(np.int64)[0]


def parity(members: np.ndarray) -> bytes:
    """A set's parity map: 64 bits or more, a power of two, about as many as it has members."""
    width = 1 << min(_WIDEST, max(6, (len(members) - 1).bit_length()))
    counts = np.bincount((mix(members) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def first_members(members: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of a set, the rarest n-grams of which it shares one with every set that it links with; fewer link only if equal."""
    size = len(members)
    if size * (den - num) < num:
        return np.empty(0, np.uint64)
    order = np.argsort(counts[members >> _SLOT], kind="stable")  # members are sorted: ties go by hash
    return members[order[: size + num * size // -den + 1]]


def _counted(documents: DataFrame, n: int) -> DataFrame:
    """A row for each document (at: what names the row); and those of each task's counters, by part, that have a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, task = WordHashes(), np.zeros(SLOTS, np.uint32), TaskContext.get().partitionId()
        names, none = ["doc_id", "at", "n", "key", "map", "part", "task", "counts"], [pa.int32(), pa.int32(), pa.binary()]
        for b in (whole.slice(start, 2000) for whole in batches for start in range(0, len(whole), 2000)):
            sets = [ngram_set(t, n, known) for t in b.column("text").cast(pa.binary()).to_pylist()]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> _SLOT).astype(np.int64), minlength=SLOTS).astype(np.uint32)
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("at"), *own, *[pa.nulls(len(sets), t) for t in none]], names=names)
        if counts.any():
            packed = [zlib.compress(c.astype(np.uint64).tobytes(), 1) for c in np.split(counts, PARTS)]
            own = [pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 4, pa.nulls(PARTS, pa.binary()), *own], names=names)

    return documents.mapInArrow(run, "doc_id long, at long, n long, key long, map binary, part int, task int, counts binary")


def _summed(counted: DataFrame) -> np.ndarray:
    """All counts, as eighths of powers of two: SLOTS bytes. No task gathers more than FAN_IN arrays at once."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // PARTS, np.uint64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint64)
        return pa.table([pa.array([x.as_py()], pa.int32()) for x in key] + [pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "task", "counts"])

    rows = counted.where("part is not null").select("part", "task", "counts")
    tasks = rows.agg(F.count_distinct("task")).first()[0]
    while tasks > 1:
        tasks = blocks_for(tasks, FAN_IN)
        rows = materialise(rows.groupBy("part", F.pmod(F.xxhash64("task"), F.lit(tasks)).cast("int").alias("_group")).applyInArrow(add, "part int, task int, counts binary"), "counts")
    total = np.zeros((PARTS, SLOTS // PARTS), np.uint64)
    for r in rows.collect():
        total[r.part] += np.frombuffer(zlib.decompress(r.counts), np.uint64)
    return (8 * np.log2(1 + total.ravel())).astype(np.uint8)


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _lists(documents: DataFrame, n: int, num: int, den: int, counts: Broadcast, buckets: int, hot: int, split: int) -> DataFrame:
    """kind, id, classes: what shares a first member, by keys.

    kind 0: a list of classes (id: a hash of them); 1: the same, too long to compare, and id its least class; 2: of an
    n-gram that is dealt over several tasks (id), the least class of one.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = WordHashes(), counts.value
        for whole in batches:
            for start in range(0, len(whole), 2000):
                made: dict[int, np.ndarray] = {}
                for text in whole.column("text").slice(start, 2000).cast(pa.binary()).to_pylist():
                    members = ngram_set(text, n, known)
                    if (key := int(set_key(members))) not in made:
                        made[key] = first_members(members, order, num, den)
                if not sum(map(len, made.values())):
                    continue
                hashes = np.concatenate(list(made.values()))
                keys = np.repeat(np.array(list(made), np.int64), [len(x) for x in made.values()])
                level = order[hashes >> _SLOT].astype(np.int64)
                hashes = mix(hashes ^ _M1)
                parts = np.where(level >= split, 2 << np.maximum(0, (level - split) // 8), 1).astype(np.uint64)
                part = mix(keys.view(np.uint64)) % parts
                bucket = ((hashes + part * _M3) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                first = _starts(bucket[by])
                ends = np.append(first[1:], len(by)).tolist()
                rows = [(bucket[by[x]], hashes[by[x:y]].tobytes(), keys[by[x:y]].tobytes(), (parts[by[x:y]] > 1).tobytes()) for x, y in zip(first.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "x", "y", "dealt"])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        hashes, keys, dealt = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("x", np.uint64), ("y", np.int64), ("dealt", np.bool_)))
        order = np.lexsort((keys, hashes))
        hashes, keys, dealt = hashes[order], keys[order], dealt[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])])
        hashes, keys, dealt = hashes[new], keys[new], dealt[new]
        first = _starts(hashes)
        many = np.diff(np.append(first, len(hashes)))
        known: set[int] = set()
        rows: list[tuple[int, int, np.ndarray]] = []
        for at in first[dealt[first]].tolist():
            rows.append((2, int(hashes[at].astype(np.int64)), keys[at : at + 1]))
        for at, m in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            classes = keys[at : at + m]
            name = int(set_key(classes.view(np.uint64)))
            if name not in known:
                known.add(name)
                if m <= hot and not dealt[at]:
                    rows.append((0, name, classes))
                else:
                    rows += [(1, int(classes[0]), classes[x : x + hot]) for x in range(1, m, hot)]
        kinds, names, classes = zip(*rows, strict=True) if rows else ((), (), ())
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in classes])])
        joined = np.concatenate(classes) if classes else np.empty(0, np.int64)
        held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(joined, pa.int64()))
        return pa.table([pa.array(kinds, pa.int32()), pa.array(names, pa.int64()), held], names=["kind", "id", "classes"])

    sent = documents.select("text").mapInArrow(send, "bucket int, x binary, y binary, dealt binary")
    return sent.groupBy("bucket").applyInArrow(meet, "kind int, id long, classes array<long>")


class Maps:
    """Parity maps of classes, folded to any width. Folding a map to half its width adds up its halves."""

    def __init__(self, maps: list[bytes]) -> None:
        self.level = np.array([len(m).bit_length() - 1 for m in maps], np.int64)  # of bytes
        self.at: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        rows, held = np.empty((0, 1), np.uint64), np.empty(0, np.int64)
        for level in range(int(self.level.max(initial=3)), 2, -1):
            own = np.flatnonzero(self.level == level)
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:] if len(held) else np.empty((0, 1 << (level - 3)), np.uint64)
            made = np.frombuffer(b"".join([maps[i] for i in own.tolist()]), np.uint64).reshape(len(own), 1 << (level - 3))
            rows, held = np.concatenate([rows, made]), np.concatenate([held, own])
            self.rows[level] = rows
            self.at[level] = np.full(len(maps), -1)
            self.at[level][held] = np.arange(len(held))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, at least in how many bits the maps differ: never more than the sets differ in n-grams."""
        out = np.empty(len(a), np.int64)
        level = np.minimum(self.level[a], self.level[b])
        for v in np.unique(level).tolist():
            some = np.flatnonzero(level == v)
            at, rows = self.at[v], self.rows[v]
            step = max(1, (32 << 20) >> v)
            for x in range(0, len(some), step):
                i = some[x : x + step]
                out[i] = np.bitwise_count(rows[at[a[i]]] ^ rows[at[b[i]]]).sum(axis=1, dtype=np.int64)
        return out


def may_link(lists: list[np.ndarray], sizes: np.ndarray, maps: Maps, num: int, den: int) -> np.ndarray:
    """Pairs (a, b) of a forest that joins what may link, directly or through others, in each of the lists."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least, most = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        out = least * den >= most * num
        out[out] = maps.differ(a[out], b[out]) * (num + den) <= (least + most)[out] * (den - num)
        return out

    root = list(range(len(sizes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges: list[tuple[int, int]] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(x), find(y)
            if i != j:
                root[j] = i
                edges.append((x, y))

    by_size: dict[int, list[np.ndarray]] = {}
    for x in lists:
        if len(x) <= SMALL:
            by_size.setdefault(len(x), []).append(x)
    for m, same in by_size.items():
        i, j = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(same), step):
            rows = np.sort(np.stack(same[at : at + step]), axis=1)
            pairs = np.unique(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], 1), axis=0)
            pairs = pairs[near(pairs[:, 0], pairs[:, 1])]
            join(pairs[:, 0], pairs[:, 1])
    for x in (x for x in lists if len(x) > SMALL):
        x = x[np.argsort(sizes[x], kind="stable")]
        open_ = np.ones(len(x), bool)
        own = sizes[x]
        for start in range(len(x)):
            todo = [start] if open_[start] else []
            open_[start] = False
            while todo:
                at = todo.pop()
                lo = np.searchsorted(own, -(-own[at] * num // den))
                hi = np.searchsorted(own, own[at] * den // num, "right")
                other = lo + np.flatnonzero(open_[lo:hi])
                if len(other):
                    other = other[near(np.full(len(other), x[at]), x[other])]
                    open_[other] = False
                    join(np.full(len(other), x[at]), x[other])
                    todo += other.tolist()
    return np.array(edges, np.int64).reshape(-1, 2)


def _candidates(lists: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between keys: forests that join, in each list, what may link; and the stars of the longest lists."""
    listed = lists.where("kind = 0").dropDuplicates(["id"]).select("id", F.explode("classes").alias("_key"))
    held = lists.where("kind = 0").agg(F.coalesce(F.sum(F.size("classes")), F.lit(0))).first()[0]
    mean = classes.agg(F.coalesce(F.avg(F.octet_length("map") + 32), F.lit(0.0))).first()[0]
    bucket = F.pmod(F.xxhash64("id"), F.lit(blocks_for(int(held * mean), MAPS))).cast("int")
    rows = listed.join(classes.select("key", "n", "map"), F.col("_key") == F.col("key")).select(bucket.alias("bucket"), "id", "key", "n", "map")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, keys = t.column("id").to_numpy(), t.column("key").to_numpy()
        own, first, at = np.unique(keys, return_index=True, return_inverse=True)
        sizes = t.column("n").to_numpy()[first].astype(np.int64)
        maps = Maps(t.column("map").take(pa.array(first)).to_pylist())
        order = np.argsort(ids, kind="stable")
        found = may_link(np.split(at[order], _starts(ids[order])[1:]), sizes, maps, num, den)
        return pa.table([pa.array(own[found[:, 0]], pa.int64()), pa.array(own[found[:, 1]], pa.int64())], names=["a", "b"])

    edges = rows.groupBy("bucket").applyInArrow(run, "a long, b long")
    stars = lists.where("kind = 1").select(F.col("id").alias("a"), F.explode("classes").alias("b"))
    least = F.min(F.col("classes")[0]).over(Window.partitionBy("id"))  # a row for each task that an n-gram is dealt to
    dealt = lists.where("kind = 2").select(least.alias("a"), F.col("classes")[0].alias("b"))
    return edges.unionByName(stars).unionByName(dealt)


def trie_links(sets: list[np.ndarray], num: int, den: int, piece: np.ndarray | None = None, order: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets which links join, walking a prefix tree of the sets.

    piece: numbers of what is known to be joined already; sets of one number need no link. order: the counters of the
    global order, frequent ones first here; without it n-grams go by their hashes.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    piece = np.arange(n) if piece is None else np.unique(piece, return_inverse=True)[1]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # n-grams of one set alone overlap nothing and stay out of the tree: they are numbered last
    level = np.zeros(len(values), np.int64) if order is None else -(order[values >> _SLOT].astype(np.int64))
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, level, counts == 1))] = np.arange(len(values))
    shared = int((counts > 1).sum())
    owner = np.repeat(np.arange(n), sizes)
    member = rank[inverse]
    keep = member < shared
    owner, member = owner[keep], member[keep]
    order = np.lexsort((owner, member))
    posted = owner[order]  # the sets that hold each n-gram, one after the other
    starts = np.searchsorted(member[order], np.arange(shared + 1))
    order = np.lexsort((member, owner))
    cuts = np.searchsorted(owner[order], np.arange(n + 1))
    by_owner = member[order]  # once: each path is a view of it
    paths = [by_owner[cuts[i] : cuts[i + 1]] for i in range(n)]
    by_path = sorted(range(n), key=lambda i: paths[i].astype(">u4").tobytes())
    paths = [paths[i] for i in by_path]
    place = np.array(by_path)
    lengths = np.array([len(p) for p in paths], np.int64)
    own_sizes = sizes[place]
    common = np.zeros(n + 1, np.int64)  # with the path before
    for i in range(1, n):
        m = min(lengths[i - 1], lengths[i])
        differ = np.flatnonzero(paths[i - 1][:m] != paths[i][:m])
        common[i] = differ[0] if len(differ) else m
    common[0] = common[n] = -1
    links: list[tuple[int, int]] = []

    at_once = max(1, POSTINGS // n)

    def gained(tokens: np.ndarray) -> np.ndarray:
        if not len(tokens):
            return 0
        total = np.zeros(n, np.int64)
        for some in np.split(tokens, range(at_once, len(tokens), at_once)):
            many = starts[some + 1] - starts[some]
            at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            total += np.bincount(posted[at], minlength=n)
        return total

    stack = [(0, n, 0, np.zeros(n, np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        least, most = own_sizes[lo:hi].min(), own_sizes[lo:hi].max()
        need = -(-num * (sizes + least) // (num + den))
        walking = (overlap + (lengths[lo:hi].max() - depth) >= need) & (sizes * den >= least * num) & (most * den >= sizes * num)
        below = piece[place[lo:hi]]
        if not walking.any() or ((below == below[0]).all() and (piece[walking] == below[0]).all()):
            continue
        end = int(lengths[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
        overlap = overlap + gained(paths[lo][depth:end])
        while lo < hi and lengths[lo] == end:  # paths that end here come first
            i = place[lo]
            near = walking & (overlap * (num + den) >= num * (sizes + sizes[i])) & (piece != piece[i])
            for p in np.unique(piece[near]):
                links.append((int(i), int(np.flatnonzero(near & (piece == p))[0])))
                piece[piece == p] = piece[i]
            lo += 1
        if lo < hi:
            forks = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
            stack += [(x, y, end, overlap) for x, y in zip(forks[:-1], forks[1:], strict=True)]
    return links


def _walk(documents: DataFrame, tasks: DataFrame, n: int, num: int, den: int, counts: Broadcast) -> DataFrame:
    """tasks (at, key, block, chunk, piece, bucket): the links (a, b) found in each (block, chunk)."""
    # most documents have no neighbour: a bit map of hashes, of a fixed size, keeps their texts from moving
    place = F.pmod(F.col("at"), F.lit(_MARKS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marks = tasks.select(F.floor(place / 64).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = documents.join(F.broadcast(marks), F.floor(place / 64) == F.col("_word")).where(F.getbit("_bits", (place % 64).cast("int")) == 1)
    # rows that are named alike have one text: one of them is enough, and copies without doc_id don't meet in one task
    texts = marked.groupBy(F.col("at").alias("_at")).agg(F.first("text").alias("text"))
    rows = tasks.hint("merge").join(texts, F.col("at") == F.col("_at")).select("bucket", "block", "chunk", "key", "piece", "text")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        known = WordHashes()
        members: dict[int, np.ndarray] = {}
        groups: dict[tuple[int, int], dict[int, int]] = {}
        for b in t.to_batches():
            cols = [b.column(c).to_pylist() for c in ("block", "chunk", "key", "piece")]
            for block, chunk, k, piece, text in zip(*cols, b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if k not in members:
                    made = ngram_set(text, n, known)
                    if int(set_key(made)) != k:  # another text of an equal hash
                        continue
                    members[k] = made
                groups.setdefault((block, chunk), {})[k] = piece
        a, b = [], []
        for group in groups.values():
            keys = sorted(group)
            for i, j in trie_links([members[k] for k in keys], num, den, np.array([group[k] for k in keys]), counts.value):
                a.append(keys[i])
                b.append(keys[j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def _dealt(tasks: DataFrame, members: int) -> DataFrame:
    return tasks.withColumn("bucket", F.pmod(F.xxhash64("block", "chunk"), F.lit(blocks_for(members, MEMBERS))).cast("int"))


def _chunks(classes: Column, members: Column, chunk: int) -> Column:
    return F.greatest(F.ceil(classes / chunk), F.ceil(members / F.lit(CHUNK_MEMBERS))).cast("int")


def _again(blocks: DataFrame, links: DataFrame, chunk: int) -> DataFrame:
    """Tasks for blocks of several chunks that links leave in pieces: all outside the largest piece meet every chunk."""
    pieces = connected(links)
    large = blocks.where("chunks > 1").join(pieces, F.col("key") == F.col("node"), "left")
    large = materialise(large.select("at", "key", "block", "n", "classes", F.coalesce("root", "key").alias("piece")), "large")
    by_size = large.groupBy("block", "piece").agg(F.count("*").alias("many"), F.sum("n").alias("own"), F.first("classes").alias("classes"))
    most = F.max(F.struct("many", "piece"))
    main = by_size.groupBy("block").agg(most["piece"].alias("main"), F.first("classes").alias("_all"), F.sum("own").alias("_own"), (F.first("classes") - most["many"]).alias("rest"))
    main = main.where("rest > 0").select(F.col("block").alias("_block"), "main", "_all", "_own", "rest")
    split = large.join(main, F.col("block") == F.col("_block"))
    half = max(1, chunk // 2)
    n_all = _chunks(F.col("_all"), F.col("_own"), half)
    n_rest = F.greatest(F.ceil(F.col("rest") / half), F.ceil(n_all * F.col("rest") / F.col("_all"))).cast("int")
    outside = split.where("piece <> main")
    rest_at, all_at = F.pmod(F.xxhash64("key", F.lit(1)), n_rest).cast("int"), F.pmod(F.xxhash64("key", F.lit(2)), n_all).cast("int")
    left = outside.withColumn("_a", rest_at).withColumn("_b", F.explode(F.sequence(F.lit(0), n_all - 1)))
    right = split.withColumn("_b", all_at).withColumn("_a", F.explode(F.sequence(F.lit(0), n_rest - 1)))
    again = left.unionByName(right).select("at", "key", "block", "n", (F.col("_a") * n_all + F.col("_b")).alias("chunk"), "piece")
    return materialise(again, "again")


def jaccard_components(documents: DataFrame, n: int = 5, num: int = 8, den: int = 10, chunk: int = CHUNK, hot: int = HOT, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; two documents link when den * |A & B| >= num * |A | B|.

    component_id is the smallest doc_id reachable by links, the document itself included. A null or empty text has no
    n-gram, links with nothing and is its own component; a text of fewer than n words is one n-gram. Equal sets are always
    linked. Rows without doc_id take part; their component is null only where no other document is in it. Rows that share a
    doc_id are documents of their own, and repeated rows come back each. An empty table gives an empty result; extra
    columns are ignored. Sets are compared by 64-bit hashes of their n-grams, and told apart by 64-bit keys.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents = documents.withColumn("at", F.xxhash64("doc_id", "text"))
    counted = materialise(_counted(documents, n), "sets")
    sizes = counted.where("part is null").select("doc_id", "at", "n", "key", "map")
    counts = documents.sparkSession.sparkContext.broadcast(_summed(counted))
    least = [F.min(c).alias(c) for c in ("doc_id", "at", "n", "map")]
    classes = materialise(sizes.where("n > 0").groupBy("key").agg(*least), "classes")
    sent = classes.agg(F.coalesce(F.sum(F.col("n") * (den - num) / den + 1), F.lit(0))).first()[0]
    lists = materialise(_lists(documents, n, num, den, counts, blocks_for(sent, HASHES), hot, split), "lists")
    near = connected(_candidates(lists, classes, num, den))
    discard(lists)
    blocked = materialise(near.join(classes, F.col("node") == F.col("key")).select("at", "n", "key", F.col("root").alias("block")), "blocks")
    shared = [F.min(F.struct(F.xxhash64("key", F.lit(i)), F.col("key")))["key"].alias(f"s{i}") for i in range(SHARED)]
    # dealt anew, so that a large block can be split where the two are joined
    found = blocked.groupBy(F.col("block").alias("_block")).agg(F.count("*").alias("classes"), F.sum("n").alias("_own"), F.array(*shared).alias("shared"))
    found = found.withColumn("chunks", _chunks(F.col("classes"), F.col("_own"), chunk)).drop("_own").repartition(F.xxhash64("_block"))
    rows = materialise(blocked.join(found, F.col("block") == F.col("_block")).drop("_block"), "chunked")
    discard(blocked)
    own = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    every = F.when((F.col("chunks") > 1) & F.array_contains("shared", F.col("key")), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    tasks = rows.select("at", "key", "block", "n", F.explode(every).alias("chunk"), F.col("key").alias("piece"))
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.count_if(F.col("chunks") > 1).alias("large")).first()
    links = materialise(_walk(documents, _dealt(tasks, size.members), n, num, den, counts), "links")
    if size.large:
        again = _again(rows, links, chunk)
        if members := again.agg(F.sum("n")).first()[0]:
            links = links.unionByName(materialise(_walk(documents, _dealt(again, members), n, num, den, counts), "links"))
    pieces = connected(links)
    named = classes.join(pieces, F.col("key") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), "component_id")
    return (
        sizes.join(named, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
