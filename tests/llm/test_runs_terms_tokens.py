"""Periodic runs, source divergence and byte-level BPE against brute force and the tokenizer library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textquarry.llm import bpe, divergence, periodic

SPACE = r"[^\x20\x09-\x0D]+"


# --- periodic runs


def run_truth(words):
    """All runs by the definition: maximal stretches of each period whose smallest period it is."""
    runs = []
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - p:
            e = i
            while e < len(words) - p and words[e] == words[e + p]:
                e += 1
            length = e - i + p
            if e > i and length >= max(24, 3 * p) and not any(all(words[x] == words[x + q] for x in range(i, e + p - q)) for q in range(1, p)):
                runs.append((i, length, p))
            i = max(e, i) + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed_truth(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


def run_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "A a " * 12, " ".join("abc" * 9), "x " + "a b " * 20 + "c d e f " * 7 + "y", "é é " * 30, "one " * 24 + "two " * 24]
    for _ in range(60):
        texts.append(" ".join(rng.choice("ab") for _ in range(rng.randint(20, 90))))
    for _ in range(30):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        words = (base * 9)[: rng.randint(24, 150)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "z"
        texts.append("  ".join([*"qrs"[: rng.randint(0, 3)], *words, *"tuv"[: rng.randint(0, 3)]]))
    square = [rng.choice("ab") for _ in range(50)]
    texts.append(" ".join([*square, *square, *square[:49]]))  # just under three periods
    texts.append(" ".join([*square, *square, *square]))
    return [*texts, texts[8]]


def test_periodic_runs_against_brute_force(spark):
    texts = run_texts()
    got = periodic.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        words = re.findall(SPACE, texts[r["doc_id"]] or "")
        runs = run_truth(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
        assert r["collapsed"] == collapsed_truth(words, runs)


@pytest.mark.parametrize("block", [16, 100])
def test_periodic_runs_in_small_blocks(monkeypatch, block):
    monkeypatch.setattr(periodic, "PROBED", block)
    rng = np.random.RandomState(1)
    words = np.concatenate([np.tile(rng.randint(0, 9, p), 200 // p) for p in (7, 50, 3)] + [rng.randint(0, 2, 80)]).astype(np.int32)
    _, p, at = (np.concatenate(x) for x in zip(*periodic.probed(words, np.array([0, len(words)])), strict=True))
    assert periodic.found_runs(words, p, at) == run_truth(words.tolist())


def test_long_texts_of_runs():
    """Time in proportion: one word, many short runs, a long period."""
    rng = np.random.RandomState(2)
    for words in (np.zeros(200_000, np.int32), np.repeat(np.arange(8_000), 25).astype(np.int32), np.tile(rng.randint(0, 1 << 30, 60_000), 4).astype(np.int32)):
        parts = list(periodic.probed(words, np.array([0, len(words)])))
        _, p, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        runs = periodic.found_runs(words, p, at)
        assert len(runs) == (8_000 if words[-1] == 7_999 else 1)
        assert sum(n for _, n, _ in runs) == len(words)


def test_repetition_goes_and_other_columns_stay(spark):
    rows = [(1, "go " * 30, 5, "x"), (1, "go " * 30, 5, "x"), (None, "all  different words", None, None), (2, None, 1, "y"), (3, "", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, rest string")
    out = periodic.without_repetition(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "go", 5, "x"), (1, "go", 5, "x"), *rows[2:]], key=repr)
    assert periodic.without_repetition(docs.limit(0)).collect() == []


def planted_truth(doc_id, text):
    words = re.findall(SPACE, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op11_against_its_contract(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "w"]) if i % 50 == 0 else "\n".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 120)))) for i in range(400)]
    rows += [(400 + i, t) for i, t in enumerate(run_texts())] + [(None, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and any(r["n_runs"] > 1 for r in got.values())
    for doc_id, text in rows:
        words, r = planted_truth(doc_id, text), got[doc_id]
        runs = run_truth(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed_truth(words, runs).encode()).hexdigest()


# --- divergence


def divergence_truth(rows, min_documents, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_documents]
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        price = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        of, q = {s: price(count[lang, s]) for s in sources}, price(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted(((q[t] - of[s][t], t.encode()) for t in kept if count[lang, s][t] > 0 and of[s][t] > q[t]))[:top]
            out += [(lang, s, part, item.decode(), -v, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(7)
    vocabulary = ["été", "The", "the", "zz", "a1b", "naïve", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), rng.choice([None, "", "123 !?"]) if i % 9 == 0 else " ".join(rng.choice(vocabulary[: rng.randint(1, 26)]) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    return rows + [rows[1]] * 3 + [("xx", "s1", "rare words only"), ("xx", "s2", None), ("yy", "alone", "one")]


def test_divergence_against_brute_force(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, source string, text string, n int, term string").repartition(3)
    for least, top in ((2, 3), (10, 50), (1000, 50)):
        assert sorted(map(tuple, divergence.divergence(docs, least, top).collect())) == divergence_truth(rows, least, top)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_divergence_in_small_batches(spark, monkeypatch):
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(1)
    batches = docs.fillna("").toArrow().to_batches(max_chunksize=7)
    monkeypatch.setattr(divergence, "BATCHED", 200)
    tallies = Counter()
    for out in divergence._counted(iter(batches)):
        for r in out.to_pylist():
            tallies[r["lang"], r["source"], r["term"]] += r["n"]
    truth = Counter()
    for lang, source, text in rows:
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            truth[lang or "", source or "", w] += 1
    assert {k: v for k, v in tallies.items() if k[2] is not None} == truth
    assert {k[:2] for k in tallies if k[2] is None} == {(lang or "", source or "") for lang, source, _ in rows}


def test_prices_are_exact(spark):
    cases = [(c, n, v) for c in (0, 1, 7, 10**12, 9 * 10**17) for n in (10**18, 3 * 10**17 + 1) for v in (1, 77, 10**6)] + [(0, 0, 0)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.price(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == (1 + 1_000_000_000 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) if r["v"] else None) for r in df.collect())


# --- byte-level BPE

RANKS = bpe.ranks_of(open(public_tokenizers.path(bpe.VOCABULARY), "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
UNKNOWN = bpe.unknown_characters()
PARTS = ["'", "s", "re", "ll", "'ve", " ", "  ", "\n", "\t", "\r\n", "a", "e", "é", "ñ", "1", "22", "!", "?", "…", "\U0001f600", "　", " ", "lower", " the", "中文", "अ", "é", *UNKNOWN[:3], *UNKNOWN[-2:]]


def token_texts():
    rng = random.Random(11)
    texts = [None, "", " ", "<|endoftext|>", "a" * 5_000, "ab" * 3_000, " " * 3_000 + "x", "'" * 2_000, "́" * 500, "x" + "\n" * 999, "The the THE  the\tthe"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)))
    texts.append(" ".join(rng.choice(PARTS) for _ in range(40_000)))
    return [*texts, texts[-2]]


def test_encoding_as_the_library_does(spark):
    texts = token_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, ids string").repartition(3)
    got = bpe.decoded(bpe.encoded(docs)).select("*", bpe.unpacked_ids().alias("list")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["list"] == LIBRARY.encode_ordinary(text) and r["n_tokens"] == len(r["list"])
        assert bytes(r["decoded"]).decode() == text
    assert bpe.encoded(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("chars", "size"), [(1, 1), (2, 3), (3, 2), (7, 5), (64, 16)])
def test_trees_of_small_leaves(chars, size):
    codec = bpe.Codec(RANKS, unknown=UNKNOWN, leaf_chars=chars, leaf_bytes=size)
    for text in token_texts()[1:150]:
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_merges_by_heap_and_by_list():
    rng = random.Random(13)
    codec = bpe.Codec(RANKS)
    for _ in range(200):
        raw = bytes(rng.choice(b"abc \xc3\xa9the") for _ in range(rng.randint(1, 90)))
        assert codec.merge_long(raw) == codec.merge_short(raw)


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    codec = bpe.Codec(RANKS)
    text = " ".join(f"word{i}x" for i in range(200))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert len(codec.kept) <= 5 and len(codec.pairs) <= 5


def test_other_vocabularies_and_unknown_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(open(path, "rb").read()), special_tokens={})
    row = bpe.encoded(spark.createDataFrame([(1, "Hello, wörld")], "doc_id int, text string"), path).select(bpe.unpacked_ids().alias("ids")).first()
    assert row["ids"] == other.encode_ordinary("Hello, wörld")
    bad = spark.createDataFrame([(1, 1, bytearray(b"\xff\xff\xff\xff")), (2, 1, bytearray(b"\x01")), (3, 0, None), (4, 0, bytearray())], "doc_id int, n_tokens long, ids binary")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decoded(bad).collect()} == {1: None, 2: None, 3: None, 4: bytearray()}
