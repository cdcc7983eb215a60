"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

A prefix tree of the labelled credentials of a kind is generalised by merging states whose outgoing shares agree within
Hoeffding bounds: those of one depth first, then those of different depths, so that the automaton tells at which place what
may stand and where a credential ends. Each candidate (a run of key characters, less the patterns' matches, and its pieces)
is then scored by how much likelier the kind's automaton makes it, for each character, than that of ordinary runs does. That one has a state for each last character,
and its shares and the thresholds come from all candidates by occurrence.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialise

KINDS = ("assign", "access", "hex", "format")  # in the order that ties in start take
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8))
_CHARS = [chr(c) for c in np.flatnonzero(_RUN).tolist()]
_NUMBER = np.where(_RUN, np.cumsum(_RUN), 0)  # of a key character by its byte, from 1; 0 for any other
_SIGNS = "+/_.=-"
_NO_END = 0.02  # samples that count as ending in a state where none does
_LEAST = 16  # characters of a candidate, unless shorter credentials are known
_ACCESS_LEAST = 20  # characters of the shortest run that can hold one of _ACCESS or _HEX
_LENGTHS = (8, 12, 16, 24, 40)  # short texts' scores vary more, so that each class of lengths has its own threshold
_KNOWN = 50_000  # texts whose advantages are kept
_A_UNIT, _BINS = 50, 1000  # bins of the advantages' histogram: so many a unit, and each side of 0


@dataclass(frozen=True)
class Settings:
    """per_kind bounds the credentials of a kind that are learned from: those of smallest hash. Ordinary runs all count."""

    per_kind: int = 300
    longest: int = 200
    alpha: float = 0.05


@dataclass
class Automaton:
    """next: where a state goes by each character, other: where by any else; cost: log shares; end: those of ending there."""

    next: list[dict[str, int]] = field(default_factory=list)
    cost: list[dict[str, float]] = field(default_factory=list)
    other: list[int] = field(default_factory=list)
    end: list[float] = field(default_factory=list)
    unseen: float = log(1e-4)

    def score(self, text: str) -> float:
        """Log likelihood, that of ending after the last character included, for each character and the end."""
        total, state = 0.0, 0
        for c in text:
            total += self.cost[state].get(c, self.unseen)
            state = self.next[state].get(c, self.other[state])
        return (total + self.end[state]) / (len(text) + 1)


def infer(samples: list[str], alpha: float, support: int = 20) -> Automaton:
    """Merge the states of the samples' prefix tree that are statistically compatible.

    First those of one depth, from the root down: few samples pass through each, so that only together they tell what may
    stand at a place, and where samples end. Then, breadth first, those of different depths that `support` samples pass.
    Each state's shares are smoothed by the characters' overall shares, with the weight of a sample for each character.
    """
    next_: list[dict[str, int]] = [{}]
    seen, ends, through = [0], [0], [{}]
    for s in sorted(samples):
        state = 0
        for c in s:
            seen[state] += 1
            through[state][c] = through[state].get(c, 0) + 1
            if c not in next_[state]:
                next_[state][c] = len(next_)
                next_.append({})
                seen.append(0)
                ends.append(0)
                through.append({})
            state = next_[state][c]
        seen[state] += 1
        ends[state] += 1
    room = sqrt(0.5 * log(2 / alpha))
    merged = list(range(len(next_)))

    def find(x: int) -> int:
        while merged[x] != x:
            merged[x] = merged[merged[x]]
            x = merged[x]
        return x

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > room * (1 / sqrt(n) + 1 / sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo, known = [(a, b)], set()
        while todo:
            a, b = map(find, todo.pop())
            if a == b or (a, b) in known:
                continue
            known.add((a, b))
            if differ(ends[a], seen[a], ends[b], seen[b]):
                return False
            for c in through[a].keys() | through[b].keys():
                if differ(through[a].get(c, 0), seen[a], through[b].get(c, 0), seen[b]):
                    return False
                if c in next_[a] and c in next_[b]:
                    todo.append((next_[a][c], next_[b][c]))
        return True

    def merge(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(find, todo.pop())
            if a == b:
                continue
            merged[b] = a
            seen[a] += seen[b]
            ends[a] += ends[b]
            for c, n in through[b].items():
                through[a][c] = through[a].get(c, 0) + n
                if c in next_[a]:
                    todo.append((next_[a][c], next_[b][c]))
                else:
                    next_[a][c] = next_[b][c]

    def below(states: list[int]) -> list[int]:
        return list(dict.fromkeys(find(next_[s][c]) for s in states for c in sorted(next_[s])))

    level = [0]
    while level := below(level):
        groups: list[int] = []
        for state in level:
            if like := next((g for g in groups if compatible(g, state)), None):
                merge(like, state)
            else:
                groups.append(state)
        level = groups
    kept, waiting = [0], below([0])
    while waiting:
        state = find(waiting.pop(0))
        if state in kept:
            continue
        like = next((k for k in kept if min(seen[k], seen[state]) >= support and compatible(k, state)), None)
        if like is not None:
            merge(like, state)
            kept = list(dict.fromkeys(map(find, kept)))
            waiting += below(kept)
        else:
            kept.append(state)
            waiting += below([state])
    reached = [0]
    for s in reached:
        reached += [t for t in below([s]) if t not in reached]
    number = {s: i for i, s in enumerate(reached)}
    overall = Counter(c for s in samples for c in s)
    every = sum(overall.values())
    out = Automaton()
    for s in reached:
        out.next.append({c: number[find(t)] for c, t in next_[s].items()})
        out.cost.append({c: log((through[s].get(c, 0) + len(overall) * n / every) / (seen[s] + len(overall))) for c, n in overall.items()})
        likeliest = max(sorted(through[s]), key=lambda c: through[s][c], default=None)
        out.other.append(out.next[-1][likeliest] if likeliest is not None else 0)
        out.end.append(max(out.unseen, log((ends[s] + _NO_END) / (seen[s] + 1))))
    return out


def ordinary_automaton(counts: dict[tuple[str, str], int]) -> Automaton:
    """The automaton whose states are the last character ("" at the start), from how often each character, or the end (""),
    follows it.

    Each state also counts a thousandth of all characters, in their overall shares, and takes two, or four in a million of
    all, off each of its own numbers: what few candidates alone hold, such as credentials that no pattern names, doesn't
    make its own characters likely. No cost exceeds an unseen character's.
    """
    states = ["", *sorted({c for _, c in counts if c})]
    number = {c: i for i, c in enumerate(states)}
    overall: Counter = Counter()
    own: dict[str, dict[str, int]] = {s: {} for s in states}
    for (before, c), n in counts.items():
        if c:
            overall[c] += n
            own[before][c] = n
    out = Automaton([{c: number[c] for c in states[1:]} for _ in states], [{} for _ in states], [0] * len(states))
    every = sum(overall.values())
    for s in states:
        left = {c: max(0.0, n - max(2, every / 250_000)) for c, n in own[s].items()}
        room = every / 1000 + sum(own[s].values()) - sum(left.values())
        ends = counts.get((s, ""), 0)
        whole = sum(left.values()) + room + ends + 1
        out.cost[number[s]] = {c: max(out.unseen, log((left.get(c, 0) + room * n / every) / whole)) for c, n in overall.items()}
        out.end.append(max(out.unseen, log((ends + 1) / whole)))
    return out


def follows(texts: list[str]) -> np.ndarray:
    """How often each key character (number 1 and up), or the end (0), follows each other one, or the start (0), in the texts."""
    codes = _NUMBER[np.frombuffer("\n".join(["", *texts, ""]).encode(), np.uint8)]
    n = len(_CHARS) + 1
    counts = np.bincount(codes[:-1] * n + codes[1:], minlength=n * n).reshape(n, n)
    counts[0, 0] = 0
    return counts


def _named(counts: Iterator[tuple[int, int, int]]) -> dict[tuple[str, str], int]:
    names = ["", *_CHARS]
    return {(names[a], names[b]): n for a, b, n in counts if n}


def _length(text: str) -> int:
    return bisect_right(_LENGTHS, len(text))


def _bin(advantage: float) -> int:
    return max(-_BINS, min(_BINS, floor(advantage * _A_UNIT)))


@dataclass
class Model:
    """Automata of the kinds, the one of ordinary runs, and for each class of lengths the advantage for each character
    from which a run is a secret."""

    kinds: list[Automaton]
    ordinary: Automaton
    least: list[float]
    shortest: int  # characters of a candidate
    known: dict[str, float] = field(default_factory=dict)

    def advantage(self, text: str) -> float:
        if (out := self.known.get(text)) is None:
            out = max((a.score(text) for a in self.kinds), default=-1e9) - self.ordinary.score(text)
            if len(self.known) >= _KNOWN:
                self.known.clear()
            self.known[text] = out
        return out

    def matches(self, text: str) -> bool:
        return bool(self.kinds) and self.advantage(text) >= self.least[_length(text)]


def threshold(usual: dict[int, int], good: list[float]) -> float:
    """The advantage from which a run is a secret. `usual` has how many candidates, by occurrence, are in each bin.

    Above what all but one in a thousand candidates reach and, if there is room, half-way to what nine in ten credentials
    do. Where there is none, but fewer than one in twenty candidates get half of what nine in ten credentials do, those
    are taken for credentials that no pattern names.
    """
    total, above, top = sum(usual.values()), 0, 0.0
    for b in sorted(usual, reverse=True):
        if (above + usual[b]) * 1000 > total:
            top = (b + 1) / _A_UNIT
            break
        above += usual[b]
    low = sorted(good)[len(good) // 10] if good else 0.0
    if low > top:
        return max(0.0, (top + low) / 2)
    like = sum(n for b, n in usual.items() if b >= _bin(low / 2))
    return low / 2 if low > 0 and like * 20 < total else max(0.0, top + 0.5)


def halves(credentials: dict[str, list[str]]) -> list[tuple[list[str], list[str]]]:
    """What teaches each automaton, and what sets the threshold; one credential does both. Kinds of fewer than 20
    credentials are taken together, as few characters of one say little about its others."""
    rare = list(dict.fromkeys(x for v in credentials.values() if len(v) < 20 for x in v))
    return [(v[::2], v[1::2] or v) for v in [*(v for v in credentials.values() if len(v) >= 20), rare] if v]


def shortest(credentials: dict[str, list[str]]) -> int:
    """The length of the shortest credential that is learned from, or _LEAST if all are longer."""
    return min((len(x) for pair in halves(credentials) for part in pair for x in part if len(x) < _LEAST), default=_LEAST)


def with_thresholds(model: Model, credentials: dict[str, list[str]], usual: dict[tuple[int, int], int]) -> Model:
    """`usual` has the candidates' number by class of lengths and bin. A class too small to tell counts with all others."""
    together: Counter = Counter()
    for (_, b), n in usual.items():
        together[b] += n
    good = [(_length(x), model.advantage(x)) for _, b in halves(credentials) for x in b]
    for i in range(len(_LENGTHS) + 1):
        own = [g for n, g in good if n == i]
        bins = {b: n for (c, b), n in usual.items() if c == i}
        model.least[i] = threshold(bins if sum(bins.values()) >= 1000 else together, own if len(own) >= 10 else [g for _, g in good])
    return model


def untold(credentials: dict[str, list[str]], counts: dict[tuple[str, str], int], alpha: float) -> Model:
    """The automata, without thresholds yet."""
    return Model([infer(a, alpha) for a, _ in halves(credentials)], ordinary_automaton(counts), [0.0] * (len(_LENGTHS) + 1), shortest(credentials))


def learn(credentials: dict[str, list[str]], ordinary: list[str], alpha: float = 0.05) -> Model:
    """Half of each list of credentials teaches the automata, the other half sets the thresholds; all ordinary runs count
    for both, each as often as it occurs."""
    counts = follows(ordinary)
    model = untold(credentials, _named((a, b, int(counts[a, b])) for a, b in np.argwhere(counts).tolist()), alpha)
    return with_thresholds(model, credentials, Counter((_length(x), _bin(model.advantage(x))) for x in ordinary))


def _runs(text: str, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of key characters that have `least` at least, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _RUN[b], [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if len(raw) != len(text) and len(starts):
        before = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        starts, ends = before[starts], before[ends]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def base_spans(text: str, least: int = _ACCESS_LEAST) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    """(start, kind's number, end, credential) of the patterns' matches, by start; and all runs of `least` characters."""
    found, runs = [], _runs(text, min(least, _ACCESS_LEAST))
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for start, end in runs:
        if end - start < _ACCESS_LEAST:
            continue
        run = text[start:end]
        for number, pattern in ((1, _ACCESS), (2, _HEX)):
            found += [(start + m.start(), number, start + m.end(), m[0]) for m in pattern.finditer(run)]
    return sorted(found), runs


def candidates(text: str, base: list[tuple[int, int, int, str]], runs: list[tuple[int, int]], least: int) -> list[tuple[int, int, str]]:
    """What the patterns' matches leave of the runs, without signs at its ends, where it has `least` characters."""
    out, spans, at = [], sorted((s, e) for s, _, e, _ in base), 0
    for start, end in runs:
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        i, free = at, start
        while free < end:
            while i < len(spans) and spans[i][1] <= free:
                i += 1
            stop = min(end, max(free, spans[i][0])) if i < len(spans) else end
            part = text[free:stop]
            first = free + len(part) - len(part.lstrip(_SIGNS))
            if len(part := part.strip(_SIGNS)) >= least:
                out.append((first, first + len(part), part))
            free = spans[i][1] if stop < end else end
    return out


def pieces(text: str, least: int) -> list[list[tuple[int, int]]]:
    """(start, end) of what lies between "=" signs, then also dots, then also slashes; levels that cut nothing are left
    out. Ends have no signs, and each piece has `least` characters."""
    out, cut = [], ""
    for sign in "=./":
        if sign in text:
            cut += sign
            level = []
            for m in re.finditer(f"[^{re.escape(cut)}]+", text):
                part = m[0].strip(_SIGNS)
                first = m.start() + len(m[0]) - len(m[0].lstrip(_SIGNS))
                if len(part) >= least:
                    level.append((first, first + len(part)))
            out.append(level)
    return out


def scored(run: str, least: int) -> list[str]:
    """A candidate and all of its pieces."""
    return [run, *sorted({run[s:e] for level in pieces(run, least) for s, e in level} - {run})]


def found(run: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of what the model takes for secrets: the whole candidate, or the largest of its pieces."""
    if not model.kinds:
        return []
    if model.matches(run):
        return [(0, len(run))]
    out: list[tuple[int, int]] = []
    for level in pieces(run, model.shortest):
        out += [(s, e) for s, e in level if not any(a < e and s < b for a, b in out) and model.matches(run[s:e])]
    return sorted(out)


def _scanned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[str, list[tuple[int, int, int, str]], list[tuple[int, int, str]]]]:
    """text, the patterns' matches and the candidates of each row."""
    for b in batches:
        for at in range(0, len(b), 1000):
            for text in b.column("text").slice(at, 1000).to_pylist():
                base, runs = base_spans(text or "", least)
                yield text, base, candidates(text or "", base, runs, least)


def labelled(documents: DataFrame) -> DataFrame:
    """kind, value: the credentials that the patterns find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(k, v) for _, base, _ in _scanned([b], _ACCESS_LEAST) for _, k, _, v in base}
            kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], names=["kind", "value"])

    return documents.select("text").mapInArrow(run, "kind int, value string")


def _tallied(documents: DataFrame, least: int, tally: Callable[[list[str]], dict[tuple[int, int], int]]) -> Iterator[tuple[int, int, int]]:
    """Sums over the candidates of all documents, each as often as it occurs; few keys, added up where the data are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in batches:
            sums.update(tally([v for _, _, runs in _scanned([b], least) for _, _, v in runs]))
        rows = [(i, j, n) for (i, j), n in sums.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["i", "j", "n"])

    sums = documents.select("text").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    return ((r.i, r.j, r.n) for r in sums.collect())


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from a bounded sample of the patterns' own credentials, which their kind labels, and from all candidates."""
    base = materialise(labelled(documents).where(F.length("value").between(1, settings.longest)).distinct(), "credentials")

    def sample(values: DataFrame) -> list[str]:
        return [r.value for r in values.orderBy(F.xxhash64("value"), "value").limit(settings.per_kind).collect()]

    credentials = {KINDS[k]: sample(base.where(F.col("kind") == k).select("value")) for k in range(3)}

    def counts(texts: list[str]) -> dict[tuple[int, int], int]:
        found = follows(texts)
        return {(a, b): int(found[a, b]) for a, b in np.argwhere(found).tolist()}

    least = shortest(credentials)
    model = untold(credentials, _named(_tallied(documents, least, counts)), settings.alpha)

    def bins(texts: list[str]) -> dict[tuple[int, int], int]:
        out: Counter = Counter()
        for run, n in Counter(texts).items():
            for x in scored(run, least):
                out[_length(x), _bin(model.advantage(x))] += n
        return out

    return with_thresholds(model, credentials, {(i, j): n for i, j, n in _tallied(documents, least, bins)})


def secrets(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; `format` is what the
    automata add. A null or empty text has none. Repeated rows come back each, null ids stay, an empty table gives an
    empty result, extra columns are ignored. Kinds of fewer than 20 credentials share an automaton; without any credentials there is none.
    """
    model = fit(documents, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, base, runs in _scanned([b], model.shortest):
                own = [(s, k, e) for s, k, e, _ in base]
                more = [(s + i, 3, s + j) for s, _, v in runs for i, j in found(v, model)]
                text = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)) for spans in (own, own + more)]
                counts = [sum(k == i for _, k, _ in own) for i in range(3)]
                rows.append((*counts, hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(documents: DataFrame, settings: Settings = Settings(), mark: str = "[SECRET]") -> DataFrame:
    """documents with every span replaced by `mark` in `text`; other columns, null texts and row count stay."""
    model = fit(documents, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, base, runs in _scanned([b], model.shortest):
                spans = sorted([(s, e) for s, _, e, _ in base] + [(s + i, s + j) for s, _, v in runs for i, j in found(v, model)])
                parts, at = [], 0
                for s, e in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append(text if not spans else "".join(parts) + text[at:])
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)
