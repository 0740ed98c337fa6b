"""Spelling variants, document fingerprints and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctriage.llm import fingerprints, periodic, spelling

DOCUMENTS = "doc_id bigint, text string, word string, runs int, n int, id string"


def documents(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCUMENTS)


# ---- spelling variants --------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def brute_groups(uses):
    n = {w: c for w, c in uses.items() if c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def brute_words(rows):
    uses = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            uses[run] += len(run) >= 6
    return +uses


def groups_of(words):
    return sorted(tuple(r) for r in spelling.variant_groups(words).collect())


def test_variant_groups_brute(spark):
    rng = random.Random(5)
    uses = Counter()
    for alphabet, many in (("ab", 40), ("aeioué", 120), ("abcdefghij×", 60)):
        for _ in range(many):
            word = "".join(rng.choices(alphabet, k=rng.randint(6, 9)))
            for _ in range(3):
                uses[word] += rng.choice([1, 4, 5, 6, 30, 900])
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1:] + "q" * (len(word) < 7),
                                   word[:at] + rng.choice(alphabet) + word[at:],
                                   word[:at] + rng.choice(alphabet) + word[at + 1:]])
    words = spark.createDataFrame(list(uses.items()), "word string, times int").select(
        F.explode(F.array_repeat("word", F.col("times"))).alias("word"), F.lit(1).alias("n"))
    want = brute_groups(uses)
    assert groups_of(words) == want
    assert sum(r[4] for r in want) > 300 and len({r[2] for r in want}) < len(want)


def test_near_pairs_once(spark):
    words = ["".join(w) for w in np.array(np.meshgrid(*["ab"] * 6)).T.reshape(-1, 6)]
    table = spark.createDataFrame([(w, 5) for w in words + [w + "a" for w in words]],
                                  "word string, n bigint")
    pairs = [tuple(sorted((r["word"], r["other"]))) for r in spelling.near_pairs(table).collect()]
    every = words + [w + "a" for w in words]
    want = {tuple(sorted((a, b))) for a in every for b in every if one_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_variant_chain(spark):
    """Forms of forms lead to the last one."""
    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi"]
    words = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(chain)],
                                  "word string, times int")
    out = {r["word"]: r for r in spelling.variant_groups(words.select(
        F.explode(F.array_repeat("word", F.col("times"))).alias("word"))).collect()}
    assert {r["root"] for r in out.values()} == {"abcdefghi"}
    assert out["abcdefghi"]["form"] is None and out["abcdef"]["form_n"] == 25


def test_misspelt_words_odd(spark):
    rows = [(i, f"Recieve received RECEIVED ÉtésÉté ×÷ÿÀàè abc{i}defghi")
            for i in range(400)]
    rows += [(None, "received " * 3), (None, None), (7, ""), (7, "12 34"), (8, "received " * 20),
             (8, "received " * 20), (9, "z" * 100_000 + " " + "y" * 70_000)]
    rows += [(10 + i, "z" * 100_000) for i in range(5)]
    docs = documents(spark, rows)
    got = Counter(r["word"] for r in spelling.misspelt_words(docs).collect())
    assert got == brute_words(rows)
    assert groups_of(spelling.misspelt_words(docs)) == brute_groups(brute_words(rows))
    assert groups_of(spelling.misspelt_words(docs.limit(0))) == []


# ---- document fingerprints ----------------------------------------------------------------

def brute_sketch(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if c.isascii() else c for c in text or ""))
    n = max(1, len(words) - 4) if words else 0
    hashes = {hashlib.md5(" ".join(words[i:i + 5]).encode()).hexdigest()[:16] for i in range(n)}
    kept = {h for h in hashes if int(h, 16) < 2 ** 64 // 8}
    return kept or set(sorted(hashes)[:1])


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    texts = [t or "" for _, t in rows]
    out = []
    for (i, _), text, after in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        a, b, c = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        out.append((i, len(text), edited, "".join(sorted(a)), "".join(sorted(b)),
                    len(a & b) / len(a | b) if a | b else 1.0, len(a & c) / len(a | c) if a | c else 1.0,
                    len(a & b) / len(a) if a else 1.0, len(a & c) / len(a) if a else 1.0))
    return sorted(out)


@pytest.mark.parametrize("rows_a_bucket", [7, 20_000])
def test_edited_fingerprints_brute(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", rows_a_bucket)
    rng = random.Random(3)
    words = ["Été", "bébé", "\U0001f600", " x", "The", "the", "a", "of", "word", "Zz"]
    rows = [(i * 3 - 50, None if i % 17 == 0 else rng.choice(["", " ", "\t "]) + "\n".join(
        rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 30, 400])))) for i in range(150)]
    rows += [(1000 + i, "the same text of a group of copies that is rather long") for i in range(80)]
    rows.append((5000, " ".join(f"w{i}" for i in range(50_000))))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in fingerprints.edited_fingerprints(
        documents(spark, rows).repartition(5)).collect())
    assert got == brute_edits(rows)


def test_edited_fingerprints_odd(spark):
    one = documents(spark, [(4, "one two three four five six seven")])
    row = fingerprints.edited_fingerprints(one).first()
    assert row["edited"] == "one two three four fiv" + "one two thr"
    assert row["n_chars"] == 33 and row["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(one.limit(0)).count() == 0
    twice = documents(spark, [(1, "a b c")] * 3 + [(None, "d e f")] * 2 + [(2, None)])
    out = fingerprints.edited_fingerprints(twice).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 3, None: 2, 2: 1}
    assert [r["fingerprint"] for r in out if r["doc_id"] == 2] == [""]


def test_fingerprint_columns(spark):
    """The column forms agree with the sets, and parts merge into the whole."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    a, b = words[:2000], words[1200:1260]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, "short text"), (4, None), (5, " ".join(words))]
    table = fingerprints.fingerprints(documents(spark, rows))
    prints = {r["doc_id"]: r["fingerprint"] for r in table.collect()}
    assert all(prints[i] == "".join(sorted(brute_sketch(t))) for i, t in rows)
    left, right = table.toDF("i", "a"), table.toDF("j", "b")
    for r in left.crossJoin(right).select("i", "j", fingerprints.fingerprint_likeness("a", "b").alias("s"),
                                          fingerprints.fingerprint_containment("a", "b").alias("c")).collect():
        x, y = (fingerprints.sketch(dict(rows)[k]) for k in (r["i"], r["j"]))
        assert (r["s"], r["c"]) == (fingerprints.likeness(x, y), fingerprints.containment(x, y))
    contained = fingerprints.containment(fingerprints.sketch(rows[1][1]), fingerprints.sketch(rows[0][1]))
    assert contained == 1.0
    parts = [[rng.choice(words) for _ in range(n)] for n in (1, 3, 9, 300)]
    whole = set().union(*(fingerprints.sketch(" ".join(p), scale=1) for p in parts))
    joint = table.sparkSession.createDataFrame([(i, " ".join(p)) for i, p in enumerate(parts)],
                                               "doc_id long, text string")
    got = fingerprints.fingerprints(joint).agg(fingerprints.merged_fingerprint("fingerprint")).first()[0]
    assert got == "".join(sorted(h.hex() for h in whole if h < fingerprints.limit(8)))
    small = [fingerprints.sketch(f"x{i}") for i in range(20)]
    total = small[0]
    for s in small[1:]:
        total = fingerprints.merged(total, s)
    assert total == fingerprints.merged(frozenset().union(*small), frozenset())


def test_containment_estimate():
    """Near the truth for a part of a long text."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(20_000)]
    part = words[:600] + [f"v{i}" for i in range(600)]
    a, b = fingerprints.sketch(" ".join(part)), fingerprints.sketch(" ".join(words))
    assert abs(fingerprints.containment(a, b) - 596 / 1196) < 0.12


# ---- periodic runs ------------------------------------------------------------------------

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if size >= max(6, 4 * q) and not any(
                    all(words[x] == words[x + d] for x in range(start, start + size - d))
                    for d in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_find_runs_brute():
    rng = random.Random(0)
    for _ in range(1500):
        n, k, words = rng.randint(0, 60), rng.choice([1, 2, 3, 5]), []
        while len(words) < n:
            piece = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            words += piece * rng.choice([1, 1, 3, 4, 5, 7])
        words = [b"%d" % w for w in words]
        assert periodic.find_runs(periodic.word_numbers(words)) == brute_runs(words)


def test_find_runs_long():
    tile = [b"%d" % (i * i % 101) for i in range(37)]
    words = tile * 6000 + [b"x"] * 50_000 + tile[:5] * 30_000
    runs = periodic.find_runs(periodic.word_numbers(words))
    assert runs == [(0, 222_000, 37), (222_000, 50_000, 1), (272_000, 150_000, 5)]
    kept = periodic.collapsed(words, runs).split()
    assert kept == tile + [b"x"] + tile[:5]


def brute_digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_query(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 12)) for w in
                         [rng.choice("abé ") for _ in range(rng.randint(1, 4))] * rng.randint(1, 9)))
            for i in range(300)]
    rows += [(None, "a " * 9), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, "b\x0bb\nb\tb b\rb"),
             (6, "b\x0bb\nb\tb b\rb"), (2 ** 62, "x y " * 5)]
    docs = periodic.with_planted_runs(documents(spark, rows))
    got = periodic.run_digests(periodic.periodic_runs(docs)).collect()
    key = repr
    assert sorted((tuple(r) for r in got), key=key) == sorted((brute_digests(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and n for i, n in rows)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=2)
