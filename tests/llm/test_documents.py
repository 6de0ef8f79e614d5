"""Line dedup, decontamination, near copies, mixing, quality and scoring on small documents with nulls, empty and long texts, repeats and clashing columns."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from textquarry.llm import decontamination, jaccard, line_dedup, mixing, quality, suffix_tree, textops

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
#: Extra columns that have the names of columns used inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, row_hash string, rest string, keep string, score string, spans string, items string, stats string"


def docs_of(spark, texts, ids=None, sources=None):
    rows = []
    for i, text in enumerate(texts):
        doc_id = ids[i] if ids else i
        rows.append((doc_id, text, "en", sources[i] if sources else f"src{i % 3}", None if text is None else len(text), *["x"] * 8))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def text_of(seed, n=40, vocabulary=500):
    random = np.random.RandomState(seed)
    return " ".join(f"w{random.randint(vocabulary)}" for _ in range(n))


EDGES = [None, "", " \t ", "\n\n", "one", "two words", "Ünïcödé ÉÈ façade naïve coöperate", "x" * 70000]


# --- line dedup


def line_truth(docs):
    key = lambda line: line.strip(BLANKS).translate(LOW)
    held = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(math.inf if doc_id is None else doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        me = math.inf if doc_id is None else doc_id
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 2 and min(held[key(x)]) != me)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_texts():
    common = ["A common line of text", "  a COMMON line of text\t", "Überall dieselbe Zeile", "short"]
    out = [*EDGES]
    random = np.random.RandomState(3)
    for i in range(120):
        lines = [common[random.randint(4)] if random.rand() < 0.4 else text_of(1000 * i + j, 4) for j in range(random.randint(1, 12))]
        out.append("\n".join(lines))
    return [*out, out[20], out[20], "\n" * 20 + "A common line of text\n" * 30]


def test_line_dedup_against_brute_force(spark):
    texts = line_texts()
    ids = [None if i in (9, 30) else i for i in range(len(texts))]
    got = line_dedup.keep_bitmaps_joined(docs_of(spark, texts, ids).select("doc_id", "text")).collect()
    got = sorted(((r["doc_id"], (k := line_dedup.kept_lines(r["text"], r["keep"]))[1], k[2], k[0]) for r in got), key=repr)
    assert got == line_truth(list(zip(ids, texts, strict=True)))


def test_line_dedup_hot_line_is_cut_between_partitions(spark):
    """One key fills most partitions; only the first document keeps it."""
    texts = ["the very same line of text\n" + text_of(i, 6) for i in range(400)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs_of(spark, texts)).collect()}
    assert out[0] == texts[0]
    assert all(out[i] == text_of(i, 6) for i in range(1, 400))


def test_line_dedup_keeps_columns_and_repeated_rows(spark):
    texts = ["first shared line\nown line number one", "first shared line\nown line number two"]
    docs = docs_of(spark, [*texts, *texts], ids=[1, 2, 1, 2])
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r["text"] for r in out.collect()) == sorted([texts[0], texts[0], "own line number two", "own line number two"])


def test_empty_documents(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.deduplicated(docs).collect() == []
    assert jaccard.without_near_copies(docs).collect() == []
    assert decontamination.decontaminated(docs, benchmark).collect() == []
    assert mixing.weighted_fair_mix(docs).collect() == []
    assert quality.accepted(docs, labels).collect() == []
    tree, tokens = suffix_tree.learn(docs)
    assert suffix_tree.score(docs.select("doc_id", "text", suffix_tree.held_out().alias("held_out")), tree, tokens).collect() == []


# --- near copies


def sets_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_truth(docs):
    sets = [sets_of(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * union:
                count[i] += 1
                count[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(top(i), []).append(d)
    return sorted((d, min(least[top(i)]), count[i]) for i, (d, _) in enumerate(docs))


def near_texts():
    out = [*EDGES, "one", "a b c d", "A  b c\td"]
    random = np.random.RandomState(8)
    for group in range(6):
        base = text_of(group, 120).split()
        for _ in range(12):
            words = list(base)
            for _ in range(random.randint(0, 6)):
                words[random.randint(len(words))] = f"new{random.randint(10**6)}"
            out.append(" ".join(words))
        out += [" ".join(base)] * 3
    return [*out, *(text_of(100 + i, 60) for i in range(30))]


def test_native_keys_of_contexts(spark):
    """The key that SQL makes of a context and a token is the one that texts have, at wrapping products too."""
    rng = np.random.default_rng(5)
    context, token = rng.integers(0, 2**64, (2, 500), dtype=np.uint64)
    context[:3], token[:3] = (0, 2**63, 2**64 - 1), (2**64 - 1, 2**63, 0)
    rows = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(zip(context.view(np.int64).tolist(), token.view(np.int64).tolist(), strict=True))], "i long, context long, token long")
    for level in (1, 3):
        keys = [r["key"] for r in suffix_tree._keyed(rows, level).orderBy("i").collect()]
        assert keys == suffix_tree.extended(context, token, level).view(np.int64).tolist()


def test_near_copies_against_brute_force(spark):
    texts = near_texts()
    got = jaccard.jaccard_classes(docs_of(spark, texts)).select("d", "class_d", "n_links").collect()
    assert sorted(tuple(r) for r in got) == near_truth(list(enumerate(texts)))


def test_near_copies_in_small_blocks(spark, monkeypatch):
    """A group over several blocks loses no link."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 7)
    texts = near_texts()
    got = jaccard.jaccard_classes(docs_of(spark, texts)).select("d", "class_d", "n_links").collect()
    assert sorted(tuple(r) for r in got) == near_truth(list(enumerate(texts)))


def test_one_document_of_each_class_stays(spark):
    texts = near_texts()
    docs = docs_of(spark, [*texts, texts[15]], ids=[*range(len(texts)), 15])
    out = jaccard.without_near_copies(docs)
    assert out.columns == docs.columns
    truth = {c for d, c, _ in near_truth(list(enumerate(texts)))}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(truth)


def test_null_ids_come_back_as_null(spark):
    out = jaccard.jaccard_classes(docs_of(spark, ["a b c d e f", "a b c d e f", None], ids=[None, 4, None])).collect()
    assert sorted((r["class_d"], r["n_links"]) for r in out if r["n_links"]) == [(4, 1), (4, 1)]


def test_pruning_bound():
    """At the fewest matches the posterior is at the tolerance, one match fewer it is below."""
    for n, m in zip(range(16, 113, 16), jaccard.least_matches(0.8, 1e-6), strict=True):
        grid = np.linspace(0, 1, 200001)[1:-1]
        posterior = lambda k: (grid**k * (1 - grid) ** (n - k))[grid >= 0.8].sum() / (grid**k * (1 - grid) ** (n - k)).sum()  # noqa: E731, B023
        assert posterior(m) >= 0.99e-6
        assert m == 0 or posterior(m - 1) < 1.01e-6


def test_links_verify_exactly():
    """Candidates of any similarity: only those at 4/5 or more pass."""
    full = textops.mix(np.arange(1, 101, dtype=np.uint64))
    sets = [np.sort(full[:90]), np.sort(full[10:100]), np.sort(full[1:91])]
    bounds = np.cumsum([0, *map(len, sets)])
    block = jaccard._Block(np.arange(3), np.ones(3, int), jaccard.minhashes(np.concatenate(sets), bounds), sets)
    found = {(a, b) for i, j in jaccard.links(block, block, True, Fraction(4, 5)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(0, 1), (0, 2), (1, 2)}  # 80/100, 89/91, 81/99
    found = {(a, b) for i, j in jaccard.links(block, block, True, Fraction(9, 10)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(0, 2)}


# --- decontamination


def hits_truth(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    names |= windows[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out)


def contaminated_case():
    items = [(i, text_of(5000 + i, 30, 60)) for i in range(20)] + [(50, "Short Item here"), (51, "lone"), (52, None), (53, "--- ..."), (None, text_of(1, 20, 60)), (7, text_of(9999, 25, 60))]
    docs = [*EDGES]
    random = np.random.RandomState(4)
    for i in range(80):
        words = text_of(i, 60, 60).split()
        if i % 3 == 0:
            part = items[random.randint(20)][1].split()[random.randint(0, 10) :][: random.randint(8, 25)]
            words[10:10] = part
        if i % 7 == 0:
            words += ["SHORT", "item,", "Here!"]
        docs.append("  ".join(words))
    return items, [*docs, "lone lone alone lone", text_of(1, 20, 60)]


@pytest.mark.parametrize("block_words", [100_000, 100])
def test_decontamination_against_brute_force(spark, block_words):
    items, docs = contaminated_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs_of(spark, docs), benchmark, ["doc_id"], block_words=block_words)
    got = found.select("doc_id", "n_words", decontamination.hit_words().alias("n"), "items").collect()
    assert sorted((r[0], r[1], r[2], list(r[3])) for r in got) == hits_truth(list(enumerate(docs)), items)


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 20)
    items, docs = contaminated_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs_of(spark, docs), benchmark, ["doc_id"]).select("doc_id", "n_words", decontamination.hit_words().alias("n"), "items").collect()
    assert sorted((r[0], r[1], r[2], list(r[3])) for r in got) == hits_truth(list(enumerate(docs)), items)


def test_decontaminated_keeps_clean_documents_whole(spark):
    items, texts = contaminated_case()
    docs = docs_of(spark, texts)
    out = decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == docs.columns
    clean = {d for d, n, hit, _ in hits_truth(list(enumerate(texts)), items) if not (hit and 20 * hit >= n)}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {d: texts[d] for d in clean}


def test_hit_spans_are_cut_out(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = docs_of(spark, [f"Before é, {item.upper()}! after", None])
    out = decontamination.without_hit_spans(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(0, "Before é, ! after"), (1, None)]


# --- mixing


def mix_truth(sizes):
    """Targets by the rule as it is worded: share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in names}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return {s: float(t) for s, t in target.items()}
        capped |= above


def test_mixing(spark):
    texts = [*EDGES[:7], *(text_of(i, 5 + i % 30) for i in range(300))]
    sources = [None if i % 50 == 0 else "tiny" if i % 41 == 0 else "é" if i % 7 == 0 else "hot" for i in range(len(texts))]
    ids = [None if i == 20 else i // 2 * 2 if i > 250 else i for i in range(len(texts))]
    docs = docs_of(spark, texts, ids, sources)
    rows = mixing.weighted_fair_mix(docs).collect()
    assert len(rows) == len(texts)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += size(t)
    targets = mix_truth(sizes)
    assert sorted(r["size"] for r in rows) == sorted(map(size, texts))
    by_source_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in rows:
        source = by_source_size[r["source_size"]]
        assert r["target"] == pytest.approx(targets[source])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 70 for s in targets)
    again = mixing.weighted_fair_mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)


# --- quality


def quality_case(spark):
    random = np.random.RandomState(2)
    texts, labels = [], []
    for i in range(600):
        good = random.rand() < 0.7
        texts.append(". ".join(text_of(100 * i + j, 12).capitalize() for j in range(6)) + "." if good else " ".join(["spam!!!"] * random.randint(5, 60)))
        labels.append((i, int(good), 0))
    texts += EDGES
    return docs_of(spark, texts), spark.createDataFrame([*labels, (None, 1, 0), (10**6, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark):
    docs, labels = quality_case(spark)
    out = quality.classified(docs, labels, ["doc_id"]).withColumn("held_out", quality.held_out())
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    held = [d for d in rows if d in truth and zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d]["held_out"] for d in held)
    assert sum((rows[d]["score"] >= 0.5) == bool(truth[d]) for d in held) >= 0.97 * len(held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in rows.items() if r["predicted"]}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = quality_case(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (quality.fit(docs, x) for x in (labels, flipped))
    assert (a.rules, a.weights, a.intercept) == (b.rules, b.weights, b.intercept)


def test_column_expression_agrees_with_the_rules(spark):
    docs, labels = quality_case(spark)
    model = quality.fit(docs, labels)
    assert model.rules
    rows = quality.with_statistics(docs, ["doc_id"]).withColumn("score", model.score()).collect()
    x = np.array([[r["stats"][s] for s in quality.STATISTICS] for r in rows])
    expected = 1 / (1 + np.exp(-(model.intercept + quality.fires(x, model.rules) @ np.array(model.weights))))
    assert np.allclose(expected, [r["score"] for r in rows])


def test_no_labels_give_one_score(spark):
    docs, labels = quality_case(spark)
    assert {r["score"] for r in quality.classified(docs, labels.limit(0), ["doc_id"]).collect()} == {0.5}


# --- language model


def test_scoring_base_and_gain(spark):
    random = np.random.RandomState(6)
    follows = {w: f"f{random.randint(40)}" for w in range(40)}
    texts = [*EDGES]
    for _ in range(300):
        words = []
        for _ in range(20):
            w = random.randint(40)
            words += [f"W{w}", follows[w] if random.rand() < 0.9 else f"f{random.randint(40)}"]
        texts.append(" ".join(words) + f" rare{random.randint(2000)}")
    docs = docs_of(spark, texts, [None if i == 12 else i for i in range(len(texts))]).select("doc_id", "text", suffix_tree.held_out().alias("held_out"))
    tree, tokens = suffix_tree.learn(docs.where("not held_out"))
    rows = suffix_tree.score(docs, tree, tokens).collect()
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if w] + [None]
    by_id = {None if i == 12 else i: t for i, t in enumerate(texts)}
    counts = Counter(w for d, t in by_id.items() if not (d is not None and zlib.crc32(str(d).encode()) % 5 == 1) for w in split(t))
    total = sum(counts.values())
    assert (tree.total, tree.distinct) == (total, len(counts))
    held = [0.0, 0.0]
    for r in rows:
        said = split(by_id[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in said)
        assert (r["n_tokens"], r["n_known"]) == (len(said), sum(counts[w] > 0 for w in said))
        assert r["base_score"] == pytest.approx(base)
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > 0.8 * held[0]  # log10 probabilities: the tree's is higher by far


def test_unigrams_sum_to_one(spark):
    texts = [" ".join(np.random.RandomState(i).choice(["a", "b", "c", "d"], 30, p=[0.4, 0.3, 0.2, 0.1])) + " a b a b" for i in range(60)]
    tree, _ = suffix_tree.learn(docs_of(spark, texts))
    assert tree.unigram(tree.counts).sum() + 0.5 / tree.z == pytest.approx(1)  # the rest is for all that was never seen


def test_scores_keep_rare_continuations(spark):
    """What is broadcast is a share of the corpus; what is counted is not: the rest is joined to the same scores."""
    random = np.random.RandomState(8)
    follows = {w: f"f{random.randint(60)}" for w in range(60)}
    texts = [*EDGES, *[" ".join(f"W{w} {follows[w]} g{w}" for w in random.randint(0, 60, 15)) for _ in range(120)]]
    docs = docs_of(spark, texts).select("doc_id", "text", suffix_tree.held_out().alias("held_out"))
    scores = []
    for cache in (10**9, 40, 0):
        tree, tokens = suffix_tree.learn(docs.where("not held_out"), cache)
        scores.append({r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in suffix_tree.score(docs, tree, tokens).collect()})
    assert sum(r[3] for r in scores[0].values()) > 0.7 * sum(r[2] for r in scores[0].values())
    for other in scores[1:]:
        assert set(other) == set(scores[0])
        for d, r in other.items():
            assert r == pytest.approx(scores[0][d])


@pytest.mark.parametrize("cache", [10**9, 0])
def test_contexts_of_more_than_two_words(spark, cache):
    """What follows "a b" depends on the words before it."""
    random = np.random.RandomState(9)
    texts = [" ".join(f"z{k} x{k} a b y{k}" for k in random.randint(0, 9, 8)) for _ in range(60)]
    tree, tokens = suffix_tree.learn(docs_of(spark, texts), cache)
    asked = docs_of(spark, ["q x1 a b y1", "q x1 a b y2"]).selectExpr("doc_id", "text", "true AS held_out")
    score = {r["doc_id"]: r["score"] for r in suffix_tree.score(asked, tree, tokens).collect()}
    assert score[0] > score[1] + 0.9


def brute_force_scores(training, texts, depth=suffix_tree.DEPTH):
    """The suffix tree with no pruning, no hashes and no tables: all contexts of up to `depth` tokens, each held against its parent."""
    cut = lambda t: ["<s>", *re.findall("[^ \t\n\x0b\x0c\r]+", (t or "").translate(LOW)), "</s>"]
    seqs = [cut(t) for t in training]
    ones = Counter(w for s in seqs for w in s[1:])
    total = sum(ones.values())
    z = total + 0.5 * (len(ones) + 1)
    kept: dict = {}
    grams = Counter(tuple(s[i : i + k]) for s in seqs for k in range(1, depth + 2) for i in range(len(s) - k + 1))
    after: dict = {}
    for g, n in grams.items():
        if len(g) > 1 and n >= suffix_tree.MIN_COUNT:
            after.setdefault(g[:-1], {})[g[-1]] = n

    def p(context, w):
        if not context:
            return (ones[w] + 0.5) / z
        below = p(context[1:], w)
        if context not in kept:
            return below
        n, known, m = after[context].get(w, 0), sum(after[context].values()), grams[context]
        return (n + (m - known + 1) * below) / (m + 1)

    for context in sorted(after, key=len):
        known, m = sum(after[context].values()), grams[context]
        back = m - known + 1
        gain = (m - known) * math.log(back / (m + 1))
        for w, n in after[context].items():
            below = p(context[1:], w)
            gain += n * math.log((n + back * below) / (m + 1) / below)
        if gain > 0.5 * math.log(total) * len(after[context]):
            kept[context] = True
    out = []
    for s in map(cut, texts):
        out.append(sum(math.log10(p(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s))))
    return out, kept


@pytest.mark.parametrize("cache", [10**9, 60, 0])
def test_suffix_tree_against_brute_force(spark, cache):
    random = np.random.RandomState(12)
    phrases = [[f"w{x}" for x in random.randint(60, size=random.randint(3, 9))] for _ in range(25)]
    texts = [" ".join(w for _ in range(random.randint(1, 12)) for w in phrases[random.randint(25)]) for _ in range(60)]
    texts += [texts[0], texts[1], texts[1], "a b c d e f " * 30, "x b c d g " * 25, "y b c d h " * 25, None, "", "W1 w1\nW2"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", suffix_tree.held_out())
    held = {r["doc_id"] for r in docs.where("held_out").collect()}
    truth, kept = brute_force_scores([t for i, t in rows if i not in held], texts)
    assert len(kept) > 30 and max(map(len, kept)) == suffix_tree.DEPTH and min(map(len, kept)) == 1
    tree, tokens = suffix_tree.learn(docs.where("not held_out"), cache)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, tree, tokens).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in enumerate(truth)}


def test_one_word_is_counted_in_several_parts():
    """What follows a word of all texts is dealt out to several parts, in batches of some MB, and its totals add up."""
    texts = [" ".join(f"the w{i * 50 + j}" for j in range(50)) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    sent = list(suffix_tree._counting(1, 64)(iter([batch])))
    merged = list(suffix_tree._merging(1, 64)(iter(sent)))
    the = suffix_tree.sequence(pa.array(["the"]))[0][1]
    totals, parts = 0, set()
    for b in sent:
        for part, k, blob in zip(b.column("part").to_pylist(), b.column("k").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if the in np.frombuffer(blob, np.uint64, k):
                parts.add(part)
    for b in merged:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if kind == suffix_tree._TOTAL:
                context, n = np.frombuffer(blob, np.uint64).reshape(2, -1)
                totals += int(n[context == the].sum())
    assert len(parts) == 8 and totals == 400 * 50


def test_bits_grow_with_their_members(spark):
    """Two probes in a table sized by its members let few others through, and all members."""
    keys = textops.mix(np.arange(50_000, dtype=np.uint64))
    bits = suffix_tree.Bits(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), 30, 2)
    assert bits(keys).all()
    assert bits(textops.mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))).mean() < 0.06


# --- hashes


def structured_pair(n: int) -> tuple[str, str]:
    """Two different texts of letters a and b that collide under polynomials mod 2^64, whatever their multiplier."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 1 << 19])
def test_structured_texts_stay_apart(n):
    raw, offsets = textops.utf8(__import__("pyarrow").array(structured_pair(n)))
    starts, ends, _ = textops.words(raw, offsets, textops.SPACE)
    for seed in (0, 1):
        both = textops.hashes(raw, starts, ends, seed)
        assert both[0] != both[1]
        assert [textops.hashes(raw, starts[i : i + 1], ends[i : i + 1], seed, 100)[0] for i in (0, 1)] == both.tolist()


def test_structured_lines_and_texts_are_kept(spark):
    texts = [t for n in (2048, 4096) for t in structured_pair(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()} == dict(enumerate(texts))
    assert {(r["d"], r["class_d"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()} == {(i, i, 0) for i in range(4)}
