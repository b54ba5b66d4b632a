"""Vectors, conversations, the pipeline, and what the subpackage may be used by."""

import hashlib
import itertools
import os
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimine.llm import ann, chat, components

ROOT = Path(__file__).resolve().parents[2]


def by_fifty(vec_id):
    return vec_id % 50 == 0


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:160] = x[100]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({"id": F.lit(7), "v": F.lit("x"), "score": F.lit(0)}).repartition(4)
    got = defaultdict(list)
    for r in ann.search(df, by_fifty).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    z = x.astype(np.float64)
    norm = np.sqrt((z * z).sum(1))
    hits = 0
    for q in range(0, 3000, 50):
        s = (z * z[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        top = np.lexsort((np.arange(3000), -s))[:5]
        hits += len(set(top.tolist()) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(score == s[v] for v, score in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
    assert hits / 300 >= 0.9


@pytest.mark.parametrize("shape", ["random", "clustered", "dense"])
def test_ann_recall_on_other_shapes(spark, shape):
    """At least 0.9 of the nearest are found, and clustered vectors meet few others in their files."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    if shape == "clustered":
        x = rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] * 3 + x * 0.7
    if shape == "dense":
        x[1000:2400] = x[5] + 0.02 * x[1000:2400]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for r in ann.search(df, by_fifty).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    hits = 0
    for q in range(0, 4000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits / 400 >= 0.9
    near = ann.prefixes(x, unit[:512], ann.PREFIX)
    met = np.mean([np.isin(near[:, : ann.POSTS], near[q]).any(1).mean() for q in range(0, 4000, 50)])
    print(f"{shape}: recall {hits / 400:.3f}, a query meets {met:.3f} of all vectors")
    assert shape != "clustered" or met < 0.35


def test_ann_blocks_of_hot_files(spark, monkeypatch):
    """Blocks of a few vectors and queries give what large ones give."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "vec_id long, embedding array<double>")
    whole = ann.search(df, lambda c: c % 5 == 0, share=0.0).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    assert ann.search(df, lambda c: c % 5 == 0, share=0.0).orderBy("query_id", "rank").collect() == whole


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, by_fifty).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.search(df.limit(0), by_fifty).count() == 0
    assert ann.search(df.where("vec_id = 1"), by_fifty).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_reads_back(spark):
    odd = "a\\b </s>[INST] <|turn|>user\nx<|end|>\n \\< \\\\/ <s> [/INST] <<SYS>> \\[INST]"
    rows = [
        (1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "user", "é🙂"), (1, 4, "assistant", "end\n"),
        (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (3, 1, "user", "after"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"),
        (5, None, None, None), (5, 0, "user role\n", "x"), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2)})
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    made = chat.examples(df).collect()
    assert all(m["formatted"].count(chat.START) == m["n_turns"] for m in made)
    assert sum(m["trainable"] for m in made) == sum(role == "assistant" for _, _, role, _ in rows)
    assert chat.digest(df.limit(0)).count() == 0


def test_escape_round_trip(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=20, deadline=None)
    @given(st.lists(st.text(alphabet="\\<>|/s[]INTurn\nend", max_size=40), min_size=1, max_size=20))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
            assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)

    check()


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for a in parent if find(a) != a}


def brute_kept(text):
    """The rules, one by one."""
    from test_documents import words

    w = [x.decode() for x in words(text)]
    windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    letters = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)
    return (
        len(w) >= 50
        and 100 * len(covered) <= 50 * len(w)
        and 100 * sum((text or "").count(c) for c in "#*$%&|<>") <= 25 * len(w)
        and 100 * (len(lines) - len(set(lines))) <= 60 * len(lines)
        and 2 * len(w) <= sum(map(len, w)) <= 20 * len(w)
        and 100 * letters >= 50 * len(w)
    )


def brute_mix(rows, seed=17, epochs=3):
    """rows: id, source, size. How often each is taken: water-filling by rounds, then whole repetitions and the first of a seeded order."""
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(epochs * size[s]) for s in over}
        left -= sum(epochs * size[s] for s in over)
        free -= over
    order = lambda i: int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    taken = {}
    for s in names:
        whole = int(target[s] // size[s]) if size[s] else 1
        extra = target[s] - whole * size[s]
        docs = sorted((((order(i) >> 20) & 4095, order(i), str(i), n, i) for i, t, n in rows if t == s))
        so_far, ended, slices = 0, False, Counter()
        for x, *_, n, _ in docs:
            slices[x] += n
        before = {x: sum(n for y, n in slices.items() if y < x) for x in slices}
        cut = max(x for x in slices if before[x] <= extra)
        for x, _, _, n, i in docs:
            ended = ended or x > cut or (x == cut and so_far + n / 2 > extra)
            taken[i] = whole + (extra > 0 and not ended)
            so_far += n
    return taken


def test_pipeline_against_brute_force(spark, tmp_path):
    import base64

    import corpus_pipeline
    import public_tokenizers
    import tiktoken
    from hard_rows import hard_rows, prose
    from test_documents import brute_classes, words

    seen, docs = set(), []
    for r in [*hard_rows(), *((500 + i, prose(700 + i, 60 + i), "en", f"s{i % 3}", 5) for i in range(30))]:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            docs.append(r)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    stay = [d for d in docs if brute_kept(d[1])]
    first = {i for i, _, c in brute_classes(stay) if i == c}
    stay = [d for d in stay if d[0] in first]
    starts, texts = {}, {}
    for d in stay:
        w = words(d[1])
        for j in range(len(w) - 12):
            starts[tuple(w[j : j + 13])] = min(starts.get(tuple(w[j : j + 13]), d[0]), d[0])
    for d in stay:
        data = d[1].encode()
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        w = [data[a:b] for a, b in spans]
        gone = {k for j in range(len(w) - 12) if starts[tuple(w[j : j + 13])] < d[0] for k in range(j, j + 13)}
        runs = [list(g) for kept, g in itertools.groupby(range(len(w)), lambda k: k not in gone) if kept]
        texts[d[0]] = d[1] if not gone else b"\n".join(data[spans[g[0]][0] : spans[g[-1]][1]] for g in runs).decode()
    taken = brute_mix([(d[0], d[3], len(words(texts[d[0]]))) for d in stay])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, n in taken.items():
        ids = encoding.encode_ordinary(texts[i])
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += n
    assert got == +expected and len(got) > 10 and any(len(words(texts[d[0]])) < len(words(d[1])) for d in stay)


def test_pipeline_takes_hard_and_no_rows(spark, tmp_path):
    """Null ids, repeated ids and rows, null sources, and an empty table."""
    import corpus_pipeline
    from hard_rows import SCHEMA, hard_rows

    spark.createDataFrame(hard_rows(), SCHEMA).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    some = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert some.columns == ["doc_id", "n_tokens", "ids_sha256"] and some.count() > 0 and some.where("n_tokens < 1").isEmpty()
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_the_rest_passes_without_the_folders(tmp_path):
    """A copy without both folders still loads its queries and runs one."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", "__pycache__", "*.json", "*.md"))
    (copy / "corpus_pipeline.py").unlink()
    assert not (copy / "evimine/llm").exists() and not (copy / "tests/llm").exists()
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) > 60 and set(e.oracle_sql()) < set(e.queries()) and not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in e.queries())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("evimine/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


@pytest.mark.parametrize("gone", ["evimine.llm", "corpus_pipeline"])
def test_the_rest_works_without(gone):
    code = f"""
import sys, importlib.util as u
real = u.find_spec
u.find_spec = lambda n, *a: None if n.startswith({gone!r}) else real(n, *a)
import __spark_entry__ as e
assert "rule_replay" in e.queries() and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
