"""Each operator on documents against brute force, over nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evimine.llm import bpe, langid, licenses, lm, mixing, ngram_join, quality, substrings
from evimine.llm._spark import id_fold

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), data) if lower else data)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def encoding():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys_and_round_trips(docs, texts, encoding):
    got = bag(bpe.digest(docs, PATH, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = Counter()
    for i, t, *_ in texts:
        ids = encoding.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == expected


def test_bpe_merges_long_pieces_like_short_ones(encoding):
    v = bpe._vocabulary(open(PATH, "rb").read(), PATTERN)
    for piece in (b"a" * 300, b"abcde" * 60, "é中".encode() * 50, b"x"):
        expected = encoding.encode_single_piece(piece) if hasattr(encoding, "encode_single_piece") else None
        assert expected is None or bpe.merge_long(piece, v) == expected
        short = piece[:200]
        assert np.frombuffer(bpe.merge_rows([short], 256, v)[0], "<u4").tolist() == bpe.merge_long(short, v)


def test_bpe_keeps_other_columns_and_replaces_clashing_ones(spark):
    df = spark.createDataFrame([(1, "ab cd", "x", 5)], "doc_id long, text string, ids string, n_tokens int")
    row = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).first()
    assert bytes(row["decoded"]) == b"ab cd" and row["n_tokens"] == len(row["ids"]) // 4


def brute_classes(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(t, lower=True)
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        least[find(a)].append(i)
    out = Counter()
    for a, (i, *_) in enumerate(rows):
        ids = [x for x in least[find(a)] if x is not None]
        out[i, len(sets[a]), min(ids) if ids and sets[a] else i] += 1
    return out


def test_ngram_join(docs, texts):
    assert bag(ngram_join.classes(docs), "doc_id", "n_shingles", "component_id") == brute_classes(texts)


@pytest.mark.parametrize(("block", "visit"), [(1 << 17, 1 << 20), (200, 300)])
def test_ngram_join_pairs_long_lists_across_components(spark, monkeypatch, block, visit):
    """Chains of near copies, so that lists are long and hold several components; their blocks and visits may be many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "VISIT", visit)
    rng = np.random.default_rng(4)
    current, rows = [f"w{i}" for i in range(100)], []
    for step in range(60):
        rows.append((step, " ".join(current)))
        current = list(current)
        current[int(rng.integers(0, 100))] = f"new{step}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert bag(ngram_join.classes(df), "doc_id", "n_shingles", "component_id") == brute_classes(rows)


def test_one_of_each_keeps_the_smallest(docs):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()]
    assert 0 in kept and 1 not in kept and 200 in kept and kept.count(None) == 2


def brute_dedup(rows, width=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if i is not None and first[tuple(w[j : j + width])] < i:
                gone |= set(range(j, j + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substring_dedup(docs, texts):
    got = bag(substrings.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_dedup(texts)


def test_substring_dedup_leaves_untouched_texts_as_they_are(docs):
    rows = substrings.dedup(docs, spaced=True).collect()
    assert all(r["kept"] == r["text"] for r in rows if not r["n_removed"])
    assert any(r["n_removed"] for r in rows)


def brute_scores(texts, out):
    """log10 probability of each text: absolute discounting of bigrams seen often enough, over add-half words."""
    sequences = [(i, out(i), [*words(t, lower=True), "end"]) for i, t, *_ in texts]
    counts, pairs = Counter(), Counter()
    for _, held, w in sequences:
        if not held:
            counts.update(w)
            pairs.update(zip(["start", *w], w, strict=False))
    n, kinds = sum(counts.values()), len(counts)
    history = Counter({w: c for w, c in counts.items() if w != "end"}) + Counter(start=counts["end"])
    kept = {p: c for p, c in pairs.items() if c >= lm.LEAST}
    mass = Counter()
    for (a, _), c in kept.items():
        mass[a] += c - lm.DISCOUNT

    def each(a, b):
        word = (counts[b] + 0.5) / (n + 0.5 * (kinds + 1))
        if not history[a]:
            return word
        return (max(kept.get((a, b), 0) - lm.DISCOUNT, 0) + (history[a] - mass[a]) * word) / history[a]

    return Counter((i, round(sum(math.log10(each(a, b)) for a, b in zip(["start", *w], w, strict=False)), 4)) for i, _, w in sequences)


def test_lm(docs, texts):
    held = id_fold("doc_id", 5) == 1
    rows = lm.score(docs, held).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t, *_ in texts:
        if not out(i):
            counts.update([*words(t, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t, *_ in texts:
        w = [*words(t, lower=True), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        expected[i, out(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 5)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    assert got == expected
    assert Counter((r["doc_id"], round(r["score"], 4)) for r in rows) == brute_scores(texts, out)


@pytest.mark.parametrize("head", [1 << 19, 8])
def test_lm_probabilities_sum_to_one(spark, monkeypatch, head):
    """After every state, over all words, the end and one unknown word; with words that are no state, too."""
    monkeypatch.setattr(lm, "HEAD", head)
    texts = ["a b a b c", "a b d", "b c a b", "c c c a", "e f g h i j k l m n o p", "a b a b", "a b c"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model, vocabulary = lm.fit(train, 2)
    vocab = {n: c for r in vocabulary.collect() for n, c in zip(np.frombuffer(r["names"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True)}
    n = len(model.names)
    known = set(model.names.tolist())
    tail = sum(10 ** model.unigram(float(c)) for w, c in vocab.items() if w not in known) + 10 ** model.unigram(0.0)
    for state in range(n + 1):
        total = 0.0
        for word in range(n + 1):
            key = state << 21 | word
            at = np.searchsorted(model.arcs, key)
            arc = at < len(model.arcs) and model.arcs[at] == key
            total += 10 ** (model.weight[at] if arc else model.failure[state] + model.root[word])
        assert total + 10 ** model.failure[state] * tail == pytest.approx(1)


def test_lm_learns_held_out_text(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog sat on the rug") for i in range(40)], "doc_id long, text string")
    rows = lm.score(docs, id_fold("doc_id", 5) == 1).collect()
    assert all(r["score"] > r["base_score"] for r in rows) and any(r["held_out"] for r in rows)


def test_mixing_meets_targets(spark):
    rows = [(i, "x" if i % 3 == 0 else "y" if i % 50 else "z", 1 + i % 7) for i in range(3000)] + [(9000, None, 5), (9001, None, 0), (9002, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    total = sum(r["size"] or 0 for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r["source"]][0] += (r["size"] or 0) * r["repeats"]
        by[r["source"]][1:] = [r["target"], r["source_size"]]
        assert 0 <= r["repeats"] <= 3
    assert sum(t for _, t, _ in by.values()) == pytest.approx(total)
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 7
    weights = dict(zip(["x", "y", "z", None], [1, 2, 3, 1], strict=True))
    free = {s: t / weights[s] for s, (_, t, size) in by.items() if t < 3 * size - 1e-9}
    assert max(free.values()) == pytest.approx(min(free.values()))


def test_language_id_is_right_on_held_out_rows(spark):
    import random

    r = random.Random(3)
    alphabet = {"aa": "abcdef ", "bb": "ghijkl ", "cc": "éèàçùa "}
    rows = [(i, "".join(r.choice(alphabet[x]) for _ in range(r.randint(20, 300))) + "a", x) for i, x in enumerate(list(alphabet) * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "aa"), (903, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = id_fold("doc_id", 4)
    got = {r["doc_id"]: r for r in langid.predict(df, langid.learn(df, fold != 2)).collect()}
    held = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) / len(held) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[903]["lang_pred"] in alphabet


def test_language_id_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], *(rng.normal(0, 0.3, s) for s in ((2, 256, 9), (2, 3, 9), (6, 2), (2,))))
    data, real, owner = langid.segments([b"hello world", b"xyz"], 8)
    label = np.array([0, 1])[owner]

    def loss(n):
        p = langid.label_positions(n, data, real)
        return -(np.log(p[:, np.arange(len(label)), label]) * real).sum() / real.sum()

    grads = langid._gradients(net, data, real, label)
    used = sorted(set(b"hello worldxyz"))
    for part, weight in enumerate(net[1:]):
        for at in np.ndindex(weight.shape):
            if part == 0 and at[1] not in used:
                assert grads[part][at] == 0
                continue
            moved = []
            for step in (1e-5, -1e-5):
                weights = [w.copy() for w in net[1:]]
                weights[part][at] += step
                moved.append(loss(langid.Network(net.languages, *weights)))
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(grads[part][at], rel=1e-4, abs=1e-8)


def test_language_id_squash_has_its_slope():
    x = np.linspace(-4, 4, 801)
    x = x[np.abs(np.abs(x) - 3) > 1e-3]
    assert (langid._squash(x + 1e-6) - langid._squash(x - 1e-6)) / 2e-6 == pytest.approx(langid._slope(x), abs=1e-6)


def test_quality_ledger(docs, texts):
    got = bag(quality.verdicts(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = Counter()
    for i, t, *_ in texts:
        w = [x.decode() for x in words(t)]
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected[i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == expected


def test_quality_ablation_is_bitwise(docs):
    entries = quality.ledger(docs, keep_text=False)
    whole = quality.mask(quality.POLICIES["v2"])
    bits = [r["failures"] for r in entries.collect()]
    for r in quality.ablation(entries).collect():
        bit = quality.mask((r["rule"],))
        assert r["failing"] == sum(bool(b & bit) for b in bits)
        assert r["failing_only"] == sum((b & whole) == bit for b in bits)
        assert r["kept_without"] == sum(not (b & whole & ~bit) for b in bits)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "words before\nReleased under the MIT License.\nafter"), (2, mit.upper()), (3, "nothing here " * 50), (4, None), (5, ""), (6, "Released under the MIT License")]
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT-notice"), (2, "MIT"), (6, "MIT-notice")} and all(v == 1 for v in got.values())


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: bpe.digest(d, PATH, PATTERN),
        ngram_join.classes,
        substrings.digest,
        lambda d: lm.score(d, id_fold("doc_id", 5) == 1),
        licenses.scan,
        lambda d: mixing.mix(d.withColumn("size", mixing.n_words(F.col("text")))),
        lambda d: langid.predict(d, langid.learn(d, id_fold("doc_id", 4) != 2)),
        quality.verdicts,
    ],
)
def test_an_empty_table_gives_no_rows(empty_docs, apply):
    assert apply(empty_docs).count() == 0


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: bpe.encode(d, PATH, PATTERN),
        lambda d: substrings.dedup(d),
        lambda d: quality.ledger(d),
        lambda d: langid.predict(d, langid.learn(d, id_fold("doc_id", 4) != 2)),
        lambda d: mixing.mix(d),
    ],
)
def test_clashing_columns_are_replaced_and_others_kept(docs, apply):
    names = ("ids", "n_tokens", "n_words", "n_removed", "kept", "failures", "lang_pred", "score", "source_size", "target", "repeats", "set", "places", "size")
    more = docs.withColumns({n: F.lit(7).cast("long") for n in names})
    out = apply(more)
    assert len(set(out.columns)) == len(out.columns) and set(more.columns) <= set(out.columns) and out.count() == docs.count()


def test_bpe_merges_a_piece_of_over_a_megabyte_in_bounded_memory(monkeypatch):
    import random
    import tracemalloc

    monkeypatch.setattr(bpe, "LOOK_UP", 1 << 18)
    v = bpe._vocabulary(open(PATH, "rb").read(), PATTERN)
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    piece = "".join(r.choice(words) for _ in range(220_000)).encode()
    assert len(piece) > 1_000_000 and v.pairs
    tracemalloc.start()
    bpe.merged_array(piece[:50_000], v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * 50_000
    ids = bpe.merged_array(piece, v)
    assert b"".join(map(v.bytes.__getitem__, ids)) == piece and len(ids) < len(piece) // 2
    assert all(a << 32 | b not in v.pairs for a, b in zip(ids, ids[1:], strict=False))  # nothing is left to merge
