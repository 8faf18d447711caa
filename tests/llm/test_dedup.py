"""Near duplicates and repeated bytes against brute force."""

import hashlib
import itertools
import random
import re

import pytest

from folioscope.llm import near_dups, suffix_dedup

WORDS = [f"w{k}" for k in range(40)]


def _set(text, words):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())


def _components(texts, words, percent):
    sets = [_set(t, words) for t in texts]
    comp = list(range(len(texts)))
    for x, y in itertools.combinations(range(len(texts)), 2):
        both = len(sets[x] & sets[y])
        if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((comp[x], comp[y]))
            comp = [a if c == b else c for c in comp]
    return sets, comp


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(documents, seed):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(120)] for _ in range(4)]
    texts = [_edited(rng, rng.choice(base), rng.randrange(8)) for _ in range(120)]
    texts += [texts[0].upper(), texts[1], texts[1], None, "", "  \n", "a", "A", "a b", "a b c", " a\tb\vc ", "x " * 500, "x " * 700]
    sets, comp = _components(texts, 3, 85)
    rows = near_dups.near_duplicates(documents(texts).repartition(5), words=3, percent=85).orderBy("doc_id").collect()
    assert [r.n_shingles for r in rows] == [len(s) for s in sets]
    assert [r.component_id for r in rows] == comp
    assert [r.kept for r in rows] == [k == c for k, c in enumerate(comp)]


def test_near_duplicates_without_rows(documents, spark):
    assert near_dups.near_duplicates(documents(["a b"]).where("false")).count() == 0
    wide = documents(["a b c d e f", "a b c d e f"]).selectExpr("*", "'x' AS rep", "1 AS comp", "2 AS sig")
    assert [r.kept for r in near_dups.near_duplicates(wide).orderBy("doc_id").collect()] == [True, False]


def test_near_duplicates_by_similarity(documents):
    """Every pair from 0.80 on is linked, none below."""
    rng = random.Random(9)
    texts = []
    for k in range(60):
        base = [f"d{k}w{i}" for i in range(150)]
        texts += [" ".join(base), _edited(rng, base, k // 10 + 1)]
    sets, comp = _components(texts, 5, 80)
    shares = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.8 <= s < 0.9 for s in shares) > 10 and sum(s < 0.8 for s in shares) > 10
    rows = near_dups.near_duplicates(documents(texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == comp


def test_a_bucket_without_a_common_component(documents, monkeypatch):
    """Documents that share bands but no link go through the blocks."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(200)]
    texts = [" ".join(common + [f"t{k // 2}w{i}" for i in range(70 + k // 2 % 3)] + [f"k{k}"]) for k in range(80)]
    rng.shuffle(texts)
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    _, comp = _components(texts, 3, 85)
    rows = near_dups.near_duplicates(documents(texts), words=3, percent=85).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == comp and 1 < len(set(comp)) < 80


def test_words_that_a_linear_hash_confuses(documents):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = near_dups.near_duplicates(documents([f"{word} x", f"{other} x", f"{word} x"])).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 1, 0]


def test_near_duplicates_that_share_an_id(spark):
    same, lone = "a b c d e f g h i j " * 3, "k l m n o p q r s t " * 3
    rows = [(1, same, "p"), (5, same, "q"), (5, lone, "r"), (None, lone + " u", "s"), (None, "only here v w x y z", "t"), (None, "only here v w x y z", "u"), (7, None, "v"), (None, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = near_dups.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.row for r in kept.collect()) == ["p", "r", "t", "u", "v", "w"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "x long, y long")
    found = {r.node: r.comp for r in near_dups.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def _marked(docs):
    seen: dict[bytes, int] = {}
    for i, b in docs:
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], i), i)
    out = {}
    for i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        out[i] = gone
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_bytes(documents, seed, monkeypatch):
    if seed == 4:  # as over a large input: more buckets than groups, and small flushes
        for name, value in {"partitions": lambda df, mb: 40, "GROUPS": 5, "PARTS": 3, "RESPLIT": 2000, "FLUSH": 3000, "SORT_AT_ONCE": 500}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcé d") for _ in range(500))
    texts = [passage, passage, None, "", "x" * 49, "x" * 50, "x" * 400, "x" * 500, "é" * 60, "é" * 61]
    for _ in range(60):
        text = "".join(rng.choice("abcé d") for _ in range(rng.randrange(200)))
        for _ in range(rng.randrange(3)):
            a, at = rng.randrange(440), rng.randrange(len(text) + 1)
            text = text[:at] + passage[a : a + rng.randrange(30, 120)] + text[at:]
        texts.append(text)
    docs = [(k, (t or "").encode()) for k, t in enumerate(texts)]
    want = _marked(docs)
    rows = suffix_dedup.repeated_bytes(documents(texts).repartition(4)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = docs[r.doc_id][1]
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in want[r.doc_id]))]
        assert (r.n_bytes, list(zip(r.begins, r.ends, strict=True))) == (len(data), spans), r.doc_id
        kept = bytes(c for c, g in zip(data, want[r.doc_id], strict=True) if not g)
        assert hashlib.sha256(r.kept).digest() == hashlib.sha256(kept).digest()
    wide = documents(texts).selectExpr("*", "1 AS rest", "'m' AS marks", "2 AS copied")
    rows = suffix_dedup.without_repeats(wide)
    assert rows.columns == wide.columns
    cut = {r.doc_id: r for r in rows.collect()}
    assert cut[0].text == passage and cut[1].text == "" and cut[2].text == "" and cut[5].source == "s2" and cut[5].marks == "m"
    again = suffix_dedup.without_repeats(wide.where("doc_id < 3").unionAll(wide.where("doc_id < 3"))).collect()
    assert sorted(len(r.text) for r in again) == [0, 0, 0, 0, 500, 500]


def test_rows_that_share_an_id_lose_nothing_to_each_other(spark):
    rng = random.Random(2)
    first, lone, tail = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3))
    rows = [(1, first), (5, first), (5, lone), (5, tail + first[:80]), (5, lone), (6, lone[:100] + "x"), (None, first), (None, tail)]
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted([(1, first), (5, ""), (5, lone), (5, tail), (5, lone), (6, "x"), (None, first), (None, tail)], key=str)


def test_contexts_with_equal_hashes_are_compared_by_bytes(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup._vec, "mix", lambda h: h * 0)
    ctx = np.array([[97] * 80, [98] * 80, [97] * 80], np.uint8)
    h, d, pos, zero = np.zeros(3, np.uint64), np.array([1, 2, 3]), np.array([40, 40, 40]), np.zeros(3, np.int64)
    _, (docs, _, _) = suffix_dedup._merge(h, d, pos, zero, zero, ctx)
    assert docs.tolist() == [3]


def test_repeated_bytes_of_long_and_of_no_documents(documents):
    rows = suffix_dedup.repeated_bytes(documents(["ab " * 400_000, "x" + "ab " * 400_000])).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.begins, r.ends) for r in rows] == [(1_200_000, [], []), (1_200_001, [1], [1_200_001])]
    assert suffix_dedup.repeated_bytes(documents(["a"]).where("false")).count() == 0


def test_repeated_bytes_of_negative_ids(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(12)]
    ids = [-(2**63), *(rng.randrange(-(2**62), 2**62) for _ in range(45)), -1, 0]
    docs = [(i, "".join(rng.choice("ijklmno ") for _ in range(90)) + rng.choice(passages) + str(i)) for i in ids]
    want = _marked([(i, t.encode()) for i, t in sorted(docs)])
    rows = suffix_dedup.repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: sum(b - a for a, b in zip(r.begins, r.ends, strict=True)) for r in rows} == {i: sum(w) for i, w in want.items()}


def test_deep_shallow_orders_and_groups():
    import numpy as np

    rng = random.Random(5)
    rows = np.array([[rng.choice(b"ab") if rng.random() < 0.1 else 97 for _ in range(80)] for _ in range(300)], np.uint8)
    at = np.array([rng.randrange(30) for _ in range(300)])
    order, number = suffix_dedup.deep_shallow(rows, np.arange(300), at, np.zeros(300, np.int64))
    strings = [rows[k, at[k] : at[k] + 50].tobytes() for k in order]
    assert strings == sorted(strings)
    assert [a == b for a, b in itertools.pairwise(strings)] == [a == b for a, b in itertools.pairwise(number.tolist())]


def test_null_ids(spark, documents):
    rows = [(None, "a b c d " * 30), (1, "a b c d " * 30), (2, "x y z " * 30), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(None, 1, False), (1, 1, True), (2, 2, True), (None, None, False)], key=str)
    cut = [(r.doc_id, r.n_bytes, len(r.begins)) for r in suffix_dedup.repeated_bytes(df).collect()]
    assert sorted(cut, key=str) == sorted([(None, 240, 0), (1, 240, 0), (2, 180, 0), (None, 0, 0)], key=str)
