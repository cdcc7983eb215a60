"""The operators against brute force, and on nulls, empty tables, repeated rows and extra columns."""

import collections
import fractions
import hashlib
import itertools
import json
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import chat, jaccard, mixing, nearest, packing, quality, secrets, sharding, topk, warc
from winnow.llm.queries import op5_chat, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int"


def docs(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(rng):
    return [None, "", " \t\n", "one", "One two", "a\x00b é 😀 ", "x" * 20000, words(rng, 5000), words(rng, 50), words(rng, 50)]


# --- quality


def test_quality_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(1)
    texts = [words(rng, 40) + ("!! " * 20 if i % 3 == 0 else "") for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs(spark, texts), labels).collect()
    assert len(rows) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality(docs(spark, texts), turned).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    assert quality.quality(docs(spark, ["a", None]), labels.limit(0)).where("score = 0.5").count() == 2
    assert quality.quality(docs(spark, ["a"]).limit(0), labels).count() == 0


def test_scores_are_those_of_the_model_that_was_trained(spark):
    # a plain model: look up each bucket's vector, average, softmax; folded weights must give its probabilities
    rng = random.Random(11)
    settings = quality.Settings(bits=10, dim=4, epochs=3)
    texts = [words(rng, rng.randint(1, 30)).encode() + b" zz" * (i % 2) for i in range(40)]
    rows = [(*quality.featurise(t, 10), i % 2) for i, t in enumerate(texts)]
    weights, bias = quality.fit(rows, settings)
    draw = np.random.default_rng(settings.seed)
    vectors, out, b = draw.uniform(-0.5, 0.5, (1024, 4)) / 4, np.zeros((4, 2)), np.zeros(2)
    step = 0
    for _ in range(3):
        for i in draw.permutation(40):
            rate = settings.rate * (1 - step / 120)
            step += 1
            buckets, shares, label = rows[i]
            hidden = sum(s * vectors[k] for k, s in zip(buckets, shares, strict=True))
            p = np.exp(hidden @ out + b) / np.exp(hidden @ out + b).sum()
            error = p - np.eye(2)[label]
            back = out @ error
            for k, s in zip(buckets, shares, strict=True):
                vectors[k] -= rate * min(1, 20 * s) * back
            out, b = out - rate * np.outer(hidden, error), b - rate * error
    for t in [*texts, b"", b"new words here"]:
        found = quality.buckets_of(t, 10)
        hidden = vectors[found].mean(axis=0) if len(found) else np.zeros(4)
        logits = hidden @ out + b
        assert quality._scores([t], weights, bias)[0] == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])), abs=1e-6)


def test_quality_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(12)
    long = words(rng, 300_000)
    frame = docs(spark, ["a b", "a b", long, None])
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(frame.unionByName(frame), labels).orderBy("doc_id").collect()
    assert len(rows) == 8 and all(rows[i].score == rows[i + 1].score for i in (0, 2, 4, 6)) and rows[0].score == rows[2].score


# --- packing


def test_one_id_of_many_rows_teaches_once(spark):
    texts = [f"good plain words {i}" for i in range(40)]
    frame = spark.createDataFrame([(i % 4 if i < 30 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sample = quality._sample(frame, labels, quality.Settings())
    held = lambda i: crc32(str(i).encode()) % 3 == 1
    assert len(sample) == len([i for i in [*range(4), *range(30, 40)] if not held(i)])


def test_sum_of_squares_against_brute_force():
    rng = random.Random(13)
    for _ in range(40):
        capacity = rng.choice([8, 20, 50])
        sizes = [rng.randint(1, capacity) for _ in range(60)]
        found, place = packing.sum_of_squares(np.array(sizes), capacity)
        gaps: list[int] = []
        for s, b, at in zip(sizes, found, place, strict=True):
            def total(i, s=s):  # sum of squared counts of open bins per gap, if the item goes to bin i (or a new one)
                after = [g - s if j == i else g for j, g in enumerate(gaps)] + ([capacity - s] if i == len(gaps) else [])
                return sum(n * n for g, n in collections.Counter(after).items() if 0 < g < capacity)

            options = [(total(i), i == len(gaps), g, i) for i, g in enumerate([*gaps, capacity]) if g >= s]
            best = min(x[:3] for x in options)
            own = gaps[b] if b < len(gaps) else capacity
            assert (total(int(b)), b == len(gaps), own) == best and at == capacity - own
            if b == len(gaps):
                gaps.append(capacity)
            gaps[b] -= s



def test_tokens_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    plain, ids = Tokenizer.from_file(tokenizer_path()), packing._Ids(tokenizer_path())
    letters = "ab'sStTREéÉß²½٣ \t\u0085\x1c_-!?12<|>İΣς́中😀​.,ª"
    for text in ["it's I'LL <|endoftext|>x", *("".join(rng.choice(letters) for _ in range(30)) for _ in range(2000))]:
        got = np.frombuffer(b"".join(map(ids.__getitem__, packing._split(text))), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = odd_texts(rng) + [words(rng, rng.randint(1, 400)) for _ in range(60)]
    rows = packing.packed(docs(spark, texts), tokenizer_path(), 256).toPandas()
    t = Tokenizer.from_file(tokenizer_path())
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 256)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [crc32(np.array(ids[s : s + 256], "<u4").tobytes()) for s in range(0, len(ids), 256)]
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 256
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 256) * 1.03 + 1
    whole = packing.sequences(docs(spark, texts), tokenizer_path(), 256).collect()
    assert sum(len(r.ids) for r in whole) == rows.length.sum()
    assert packing.packed(docs(spark, ["a"]).limit(0), tokenizer_path()).count() == 0


# --- Jaccard join


def components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize(("n", "num", "den", "chunk", "hot", "split"), [(3, 90, 100, 512, 1000, 200), (5, 8, 10, 4, 1000, 200), (2, 7, 10, 3, 4, 200), (3, 8, 10, 512, 1000, 8)])
def test_jaccard_against_brute_force(spark, n, num, den, chunk, hot, split):
    rng = random.Random(n)
    texts = odd_texts(rng)
    for size in (4, 9, 11, 12, 30, 60, 200):
        base = words(rng, size).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(99)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy))
    root, sizes = components(texts, n, num, den)
    rows = jaccard.jaccard_components(docs(spark, texts), n, num, den, chunk, hot, split).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (sizes[i], root[i]) for i in range(len(texts))}


def test_jaccard_odd_tables(spark):
    assert jaccard.jaccard_components(docs(spark, ["a"]).limit(0)).count() == 0
    frame = docs(spark, ["a b c d e f", "a b c d e f", None]).unionByName(docs(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id is None, r.component_id) for r in jaccard.jaccard_components(frame.unionByName(frame)).collect()) == sorted([(False, 0), (False, 0), (False, 2), (True, 0)] * 2)


# --- secrets


def base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(4)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = odd_texts(rng) + ["token=short1 Token: 'abcde' API_KEY = \"x\" passwd:abcdef/é AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "é " + "a" * 24]
    for _ in range(60):
        texts.append(f"é {words(rng, 9)} password={draw(hexa, 18)} {words(rng, 5)} AKIA{draw(upper, 16)} token = \"{draw(hexa, 40)}\"")
    texts.append(f"plain KKIA{draw(upper, 16)} word " + "verylongordinaryword" * 2)
    rows = {r.doc_id: r for r in secrets.secrets(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = base(text or "")
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("format")) == said
    clean = {r.doc_id: r.text for r in secrets.redacted(docs(spark, texts)).collect()}
    assert clean[0] is None and all(not base(t or "") or "[SECRET]" in clean[i] for i, t in enumerate(texts))
    assert secrets.secrets(docs(spark, ["a"]).limit(0)).count() == 0


def test_automaton_tells_formats_apart():
    rng = random.Random(5)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(200)]
    usual = ["".join(rng.choice(["tion", "ing", "the", "er", "and"]) for _ in range(6)) for _ in range(200)]
    model = secrets.learn({"access": keys[:150]}, usual[:150])
    assert all(model.matches(k) for k in keys[150:]) and not any(model.matches(x) for x in usual[150:])


def keys_and_words(rng, keys):
    """Texts of 40 ordinary long runs, each often; 60 labelled keys; and unlabelled ones of the same format."""
    draw = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    usual = ["".join(rng.choice(["tion", "ing", "the", "er", "and"]) for _ in range(9)) for _ in range(40)]
    return [" ".join(rng.choice(usual) for _ in range(50)) for _ in range(100)] + [f"token={draw()}" for _ in range(60)] + [f"so {x} it is" for x in (draw() for _ in range(keys))]


def test_secrets_learn_from_all_candidates_by_occurrence(spark):
    # of the distinct candidates a third are unlabelled keys, of all 5,020 one in 251
    texts = keys_and_words(random.Random(14), 20)
    rows = {r.doc_id: r.spans for r in secrets.secrets(docs(spark, texts)).collect()}
    assert sum(rows[i] == "format:3:27" for i in range(160, 180)) >= 18
    assert not any(rows[i] for i in range(100))


def test_secrets_score_what_patterns_leave_and_pieces(spark):
    rng = random.Random(24)
    draw = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    key, short = draw(24), draw(10)
    odd = [f"AKIA{draw(16)}/{key}", f"{'0123456789abcdef' * 2}.{key}", f"aws_access_name={key}", f"host.com/ordinary/path/{key}", f"it is {short} here"]
    texts = keys_and_words(rng, 0) + [f"token={draw(10)}" for _ in range(60)] + odd
    rows = {r.doc_id: r.spans for r in secrets.secrets(docs(spark, texts)).collect()}
    for i, text in enumerate(odd, len(texts) - len(odd)):
        at = text.find(key) if key in text else text.find(short)
        assert f"format:{at}:{at + len(key if key in text else short)}" in rows[i].split(","), text
    clean = {r.doc_id: r.text for r in secrets.redacted(docs(spark, texts)).collect()}
    assert not any(key in x or short in x for x in clean.values())
    assert not any(rows[i] for i in range(100))


def test_secrets_learn_from_few_credentials(spark):
    rng = random.Random(34)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = keys_and_words(rng, 0)[:100] + [f"token={draw(40)}" for _ in range(11)] + [f"so {draw(20)} it is" for _ in range(5)]
    rows = {r.doc_id: r.spans for r in secrets.secrets(docs(spark, texts)).collect()}
    assert all(rows[i] == "format:3:23" for i in range(111, 116)) and not any(rows[i] for i in range(100))


def test_automata_know_places_and_ends():
    rng = random.Random(64)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    forty = secrets.infer([draw(hexa, 40) for _ in range(100)], 0.05)
    mean = lambda n: sum(forty.score(draw(hexa, n)) for _ in range(200)) / 200
    assert len(forty.next) == 41 and mean(40) > mean(30) + 0.1 and mean(40) > mean(50) + 0.1
    keys = secrets.infer([f"sk_{rng.choice(['live', 'test'])}_{draw(upper, 12)}" for _ in range(100)], 0.05)
    assert keys.score(f"sk_live_{draw(upper, 12)}") > max(keys.score(f"ks_live_{draw(upper, 12)}"), keys.score(draw(upper, 20))) + 0.3
    # where samples end is a matter of chance alone: depths tell nothing
    assert len(secrets.infer([draw("ab", 1 + int(rng.expovariate(0.1))) for _ in range(300)], 0.05).next) < 20
    assert len(secrets.infer([], 0.05).next) == 1


def test_secrets_planted_in_a_table(spark):
    # of six keys without a name and of lengths that no label has, five at least are found, and nothing else
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    planted = [*(f"so {draw(n)} it is" for n in (18, 20, 22, 23)), f"refresh_code={draw(22)} then", f"https://x.org/a/{draw(23)}?b"]
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    rows = [r.doc_id >= 10**9 for r in secrets.secrets(frame.unionByName(more)).where("spans like '%format%'").collect()]
    assert all(rows) and len(rows) >= 5


def test_secrets_of_repeated_rows_and_null_ids(spark):
    rows = [(i, f"token={'abcdef12' * 3}") for i in (None, None, 3, 3)] + [(None, None)]
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_hex) for r in got) == [(0, 0, 0), (0, 1, 1), (0, 1, 1), (3, 1, 1), (3, 1, 1)]


# --- chat


def test_chat_round_trip(spark):
    strange = ["<|im_end|>", "<\\|x", "<\\\\|", "a<|b|>", "\\n", "", None, "|im_start|>", "é😀\n<", "<<|"]
    rows = [(c, t, r, x, 1) for c in (1, None, 3) for t, (r, x) in enumerate((rng_role, x) for rng_role, x in zip(["user", "assistant", "a\nb\\n<|"] * 4, strange, strict=False))]
    frame = spark.createDataFrame(rows + [(7, None, None, None, 1)], "conv_id long, turn long, role string, text string, score int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.as_chain(frame))).collect()}
    assert len(got) == 4
    for c in (1, None, 3):
        own = [(r or "", x or "") for cc, _, r, x, _ in rows if cc == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss_text == "".join(x for r, x in own if r == "assistant")
        assert got[c].text.count("<|im_start|>") == len(own)
    assert [(t.role, t.text) for t in got[7].turns] == [("", "")]
    assert chat.formatted(chat.as_chain(frame.limit(0))).count() == 0


def test_chat_ranks_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 2, "user", "x", 0.0), (2, 1, 9, "user", "alone", None)]
    tree = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    best = {r.conv_id: r for r in chat.read_back(chat.formatted(tree)).collect()}
    assert [t.text for t in best[1].turns] == ["q", "good", "more"] and best[1].loss_text == "good" and len(best) == 2
    assert chat.formatted(tree, None).count() == 3


def test_chat_query(spark):
    r = op5_chat(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


# --- mixing


def test_mixing(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(900)] + [None, "", "one"]
    sources = [rng.choice(["b", "a", "é", None] + ["c"] * 4) for _ in texts]
    frame = docs(spark, texts, sources)
    rows = mixing.mix(frame.unionByName(frame.where("doc_id < 3"))).collect()
    assert len(rows) == len(texts) + 3
    sizes = collections.Counter()
    for i in [*range(len(texts)), 0, 1, 2]:
        sizes[sources[i]] += len((texts[i] or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while over := {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 2 * sizes[s]}:
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 120 for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame.unionByName(frame.where("doc_id < 3")).repartition(7)).collect()))
    assert mixing.mixed(frame).agg(F.sum("size")).first()[0] == pytest.approx(1.5 * sum(len((t or "").split()) for t in texts), rel=0.01)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mixing_against_a_queue(spark):
    # a plain fair queue: all documents' finish times, sorted, taken up to the budget
    rng = random.Random(15)
    texts = [words(rng, rng.randint(1, 20)) for _ in range(200)]
    sources = [rng.choice(["a", "b", "c"]) for _ in texts]
    frame = docs(spark, texts, sources).drop("size")
    rows = mixing.mix(frame).collect()
    order = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id", "source", F.size(F.split("text", " ")).cast("long")).alias("h")).collect()}
    target, size = {r.source: r.target for r in rows}, {r.source: r.source_size for r in rows}
    queue = []
    for s in "abc":
        at = 0
        for i in sorted((i for i in range(200) if sources[i] == s), key=lambda i: order[i]):
            at += len(texts[i].split())
            queue += [((at + p * size[s]) / target[s], order[i], i) for p in (0, 1)]
    left, taken = 1.5 * sum(size.values()), collections.Counter()
    for _, _, i in sorted(queue):
        n = len(texts[i].split())
        left -= n
        if left < 0:
            break
        taken[i] += n
    assert {r.doc_id: r.taken for r in rows} == {i: taken[i] for i in range(200)}


# --- vector searches


def vectors(spark, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).round(2).tolist(), 1) for i in range(400)]
    rows[5], rows[7], rows[9], rows[11], rows[13] = (5, None, 1), (7, [float("nan")] * 8, 1), (9, [0.0] * 8, 1), (11, [None] * 8, 1), (13, [], 1)
    rows[21] = (21, rows[20][1], 1)
    rows[23] = (23, [1e9] * 8, 1)
    rows[25] = (25, [0.5] * 3, 1)
    return spark.createDataFrame(rows + [(None, [1.0] * 8, 1), rows[20]], "vec_id long, embedding array<float>, rank int"), rows


def test_top_k_against_brute_force(spark):
    frame, rows = vectors(spark)
    got = collections.defaultdict(list)
    for r in topk.top_k(frame, every=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    codes = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in codes if i % 10 == 0):
        want = sorted(((-sum(a * b for a, b in zip(codes[q], c, strict=True)), i) for i, c in codes.items() if i != q and len(c) == len(codes[q])))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert topk.top_k(frame.limit(0)).count() == 0


def test_neighbours_against_brute_force(spark):
    frame, rows = vectors(spark)
    got = collections.defaultdict(list)
    for r in nearest.neighbours(frame, every=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in (i for i in exact if i % 10 == 0):
        want = sorted((float(np.sqrt(((exact[q] - v) ** 2).sum())), i) for i, v in exact.items() if i != q and len(v) == len(exact[q]))[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want] and [s for _, s in got[q]] == pytest.approx([s for s, _ in want])
    assert nearest.neighbours(frame.limit(0)).count() == 0


def test_searches_over_the_range_of_doubles(spark):
    rng = np.random.default_rng(9)
    scales = [1e-310, 1e-200, 1.0, 1e9, 1e17, 1e200, 1.7e308]
    rows = [(i, (rng.uniform(-1, 1, 4) * scales[i % 7]).tolist()) for i in range(140)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(frame, every=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    codes = {i: [int(math.floor(fractions.Fraction(x) * 256)) for x in v] for i, v in rows}
    held = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    for q in range(0, 140, 10):
        assert got[q] == sorted((-held(sum(a * b for a, b in zip(codes[q], c, strict=True))), i) for i, c in codes.items() if i != q)[:5]
    got = collections.defaultdict(list)
    for r in nearest.neighbours(frame, every=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 140, 10):
        want = sorted((math.dist(rows[q][1], v), i) for i, v in rows if i != q)[:10]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want], rel=1e-12, abs=0) and len(got[q]) == 10


# --- sharding


def test_sharding(spark):
    rng = random.Random(8)
    texts = [None, "", "é😀"] + [words(rng, rng.randint(1, 50)) for _ in range(400)] + ["same text"] * 40
    rows = sharding.sharded(docs(spark, texts), 8).toPandas()
    assert len(rows) == len(texts) and (rows.law == "bytes").all() and rows.grown_shard.isna().all()
    by_text = collections.defaultdict(set)
    for r in rows.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == crc32(raw)
        by_text[raw].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    total = rows.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 2
    assert sharding.sharded(docs(spark, ["a"]).limit(0), 8).count() == 0


def test_differencing_against_brute_force():
    rng = random.Random(16)
    for _ in range(30):
        k, sizes = rng.choice([2, 3, 5]), [rng.randint(1, 99) for _ in range(rng.randint(1, 14))]
        parts = np.zeros((len(sizes), k), np.int64)
        parts[:, -1] = sizes
        bins = sharding.difference(parts)[:, -1]
        # the plain rule on lists of (sum, members), smallest first
        lists = [[(0, ())] * (k - 1) + [(s, (i,))] for i, s in enumerate(sizes)]
        while len(lists) > 1:
            lists.sort(key=lambda x: x[0][0] - x[-1][0])
            a, b = lists[:2]
            lists = [sorted(((x + y, m + o) for (x, m), (y, o) in zip(a, b[::-1], strict=True)), key=lambda x: x[0]), *lists[2:]]
        got = sorted(sum(s for s, b in zip(sizes, bins, strict=True) if b == j) for j in range(k))
        assert got[-1] - got[0] <= max(sizes) and got[-1] - got[0] <= lists[0][-1][0] - lists[0][0][0] + max(sizes) // 2
        assert k > 2 or len(set(sizes)) < len(sizes) or got == sorted(x for x, _ in lists[0])


def test_sharding_of_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "a")] * 30 + [(5, "b")] * 30 + [(None, None), (6, "c")], "doc_id long, text string")
    rows = sharding.sharded(frame, 3).toPandas()
    assert len(rows) == 62 and all(sorted(s.slot) == list(range(len(s))) for _, s in rows.groupby("shard"))
    assert rows[rows["size"] == 9].groupby("text_crc32").shard.nunique().max() == 1


def test_differencing_in_levels(spark):
    frame = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("group"), (F.col("id") * 37 % 101 + 1).alias("size"))
    found = sharding.balanced(frame, 4, per_block=20).join(frame, "group").groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 500 and max(r.s for r in found) - min(r.s for r in found) <= 20


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1", "x" * 50000, "<p>a</p>", "y"]
    rows = [(i, None if i == 4 else f"http://h/{i} é", h, "x") for i, h in enumerate(html)] + [(None, "u", "y", "x"), (5, "http://h/5 é", "x" * 50000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, shard string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(frame, folder, shard_bytes=20000, file_bytes=400).collect()
    assert len(manifest) > 2 and sum(m.records for m in manifest) == len(rows)
    first = {m.path: m.sha256 for m in manifest}
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = (html[r.page_id] if r.page_id is not None else "y") or ""
        want = max((i for i, h in enumerate(html) if (h or "") == payload), default=None)
        assert r.payload_bytes == len(payload.encode()) and r.payload_digest == warc.base32_sha1(hashlib.sha1(payload.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == want else ("revisit", want))
        assert (None if r.payload is None else bytes(r.payload)) == (payload.encode() if r.record_type == "response" else None)
    again = warc.write(frame.repartition(5), f"file://{tmp_path}/v", shard_bytes=20000, file_bytes=400).collect()
    assert {m.path: m.sha256 for m in again} == first
    assert warc.write(frame.limit(0), f"file://{tmp_path}/e").count() == 0 and warc.read(spark, f"file://{tmp_path}/e").count() == 0
    json.dumps(sorted(first))


def test_warc_shards_hold_alike(spark, tmp_path):
    # an outlier among the ids, an id that repeats, and rows without id: none of them makes one shard of it all
    html = lambda i: f"{i} " * 50
    rows = [(i, f"u{i}", html(i)) for i in range(400)] + [(2**62, "far", html(1))]
    rows += [(1000, f"u{i}", html(i)) for i in range(200)] + [(None, f"u{i}", html(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = [warc.write(frame.repartition(n), f"file://{tmp_path}/{n}", shard_bytes=10_000, file_bytes=1 << 20).collect() for n in (1, 6)]
    assert sorted(map(str, made[0])) == sorted(map(str, made[1]))
    assert len(made[0]) >= 10 and max(m.records for m in made[0]) <= 120 and sum(m.records for m in made[0]) == len(rows)
    got = warc.read(spark, f"file://{tmp_path}/6").collect()
    count = lambda k: sum(r.page_id == k for r in got)
    assert (count(1000), count(None), count(2**62)) == (200, 200, 1)
    lead = {}
    for i, _, h in rows:
        lead[h] = max(lead.get(h, -1), -1 if i is None else i)
    assert sorted((str(r.page_id), r.refers_to or 0) for r in got) == sorted((str(i), 0 if i == lead[h] else lead[h]) for i, _, h in rows)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, frame, sf)
    assert kept.columns == frame.columns and 0 < kept.count() <= frame.count()
    one = corpus_pipeline.drop_near_copies(spark, frame, sf).toPandas()
    texts = frame.orderBy("doc_id").toPandas()
    root, _ = components(texts.text.tolist(), 5, 8, 10)
    assert sorted(one.doc_id) == sorted({int(texts.doc_id[r]) for r in root})
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def test_pipeline_decides_for_each_row(spark):
    import corpus_pipeline

    rng = random.Random(44)
    texts = [words(rng, 30) for _ in range(30)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i % 3 == 0 else i // 6, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows + [(None, texts[0], "en", "a", 0), (99, texts[3], "en", "b", 0)], columns)
    one = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert one.columns == frame.columns and sorted(r.text for r in one.collect()) == sorted(texts)
    assert one.where("doc_id = 99").count() == 1
    frame = frame.limit(30)
    taken = mixing.mix(frame).agg(F.sum("taken")).first()[0]
    mixed = [r.text for r in corpus_pipeline.mix_sources(spark, frame, "").collect()]
    assert sum(len(t.split()) for t in mixed) <= 1.5 * 900 and abs(sum(len(t.split()) for t in mixed) - taken) <= 60
    assert max(collections.Counter(mixed).values()) <= 2


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    columns = "doc_id long, text string, lang string, source string, n_chars long, _id string, _n int, _times int, _row long, key long, size int"
    rest = ("en", "a", 0, "x", 1, 1, 1, 1, 1)
    long = words(random.Random(54), 6000)
    rows = [(1, None), (1, ""), (None, long), (None, long), (2, long), (2, "x token=abcdef1234567890 y"), (2, "x token=abcdef1234567890 y"), (None, None)]
    frame = spark.createDataFrame([(i, t, *rest) for i, t in rows] + [(7, "one two", None, None, None, None, None, None, None, None, None)], columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        empty = stage(spark, frame.limit(0), sf)
        assert empty.count() == 0 and empty.columns == out.columns, name
        assert name == "packing" or out.columns == frame.columns, name
    one = corpus_pipeline.drop_near_copies(spark, frame, sf).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in one) == sorted([(0, ""), (1, ""), (1, ""), (2, long[:5]), (2, "x tok"), (7, "one t")])
    masked = corpus_pipeline.mask_secrets(spark, frame, sf).collect()
    assert len(masked) == len(rows) + 1 and sum("[SECRET]" in (r.text or "") for r in masked) == 2
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked)
    mixed = corpus_pipeline.mix_sources(spark, frame, sf).collect()
    assert sum(len((r.text or "").split()) for r in mixed) <= 1.5 * sum(len((t or "").split()) for _, t in rows) + 3
    assert max(collections.Counter((r.doc_id, r.text) for r in mixed).values()) <= 4
    packed = corpus_pipeline.pack_sequences(spark, frame, sf).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all() and len(packed[packed.start == 0]) == len(rows) + 1


def test_pipeline_keeps_the_first_of_each_group(spark):
    import corpus_pipeline

    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [r.text for r in frame.orderBy("doc_id").collect()]
    root, _ = components(texts, 5, 8, 10)
    kept = corpus_pipeline.drop_near_copies(spark, frame, "").orderBy("doc_id").collect()
    assert [r.text for r in kept] == [t for i, t in enumerate(texts) if root[i] == i]
