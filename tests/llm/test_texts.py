import hashlib
import math
import re
from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vecengine.llm import decontamination, fingerprints, language, lm_scores, near_duplicates

DIR = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def test_word_hashes_are_those_of_the_words(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    hashes, sizes = fingerprints.word_hashes(texts)
    assert sizes == [len(words(t)) for t in texts]
    assert hashes.tolist() == [fingerprints.word_hashes([w])[0][0] for t in texts for w in words(t)]


def test_fingerprints_estimate(odd_rows):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 64, (2, 3000), dtype=np.uint64)
    x, y = np.concatenate([a, b[:1000]]), np.concatenate([a, b[1000:]])
    fx, fy = fingerprints.bottom_k(x), fingerprints.bottom_k(y)
    assert abs(fingerprints.resemblance(fx, fy) - 0.5) < 0.15
    assert abs(fingerprints.distinct_count(fx) / 4000 - 1) < 0.3
    assert abs(fingerprints.containment(fx, fy) - 0.75) < 0.25
    assert (fingerprints.merge(fx, fy) == fingerprints.bottom_k(np.concatenate([x, y]))).all()
    assert (fingerprints.from_text(fingerprints.as_text(fx)) == fx).all()
    assert (fingerprints.bottom_k(np.repeat(x, 50)) == fx).all()


def test_likeness_is_that_of_the_shingles():
    """Exact for texts of up to 128 shingles together, else near, against sets of the words themselves."""
    rng = np.random.default_rng(14)

    def shingles(t):
        w = words(t)
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    for n, slack in ((3, 1e-12), (6, 1e-12), (40, 1e-12), (64, 1e-12), (3000, 0.15)):
        for _ in range(20):
            a = [f"W{x}" for x in rng.integers(0, 4 * n, n)]
            b = list(a)
            for at in rng.integers(0, n, rng.integers(0, max(2, n // 20) + 1)):
                b[at] = "other"
            texts = [" ".join(a), ", ".join(b).lower()]
            x, y = map(shingles, texts)
            fa, fb = fingerprints.fingerprints(texts)
            assert abs(fingerprints.resemblance(fa, fb) - len(x & y) / len(x | y)) <= slack
            assert abs(fingerprints.distinct_count(fa) / len(x) - 1) <= 2 * slack
            assert abs(fingerprints.containment(fa, fb) - len(x & y) / len(x)) <= 2 * slack


def test_fingerprints_of_edits(spark, odd, odd_rows, nothing):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = Counter()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut] if cut else t
        prints = fingerprints.fingerprints([t, edited, after])
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *map(fingerprints.as_text, prints[:2]), fingerprints.resemblance(*prints[:2]), fingerprints.resemblance(prints[0], prints[2])] += 1
    assert Counter(tuple(r)[:7] for r in fingerprints.compare_with_edits(odd).collect()) == want
    assert fingerprints.compare_with_edits(nothing).count() == 0
    one = odd.where("doc_id = 11")
    assert [(r.near_next, r.near_edited) for r in fingerprints.compare_with_edits(one).collect()] == [(1.0, 1.0)]


def test_language(spark, odd, nothing):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    prototypes = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    got = language.identify(docs, prototypes).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    found = {r.doc_id: r for r in language.identify(odd, prototypes).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (5, 6, 7, 9, 10)) and found[1].lang_pred != "und"
    kept = language.with_language(odd, prototypes)
    assert kept.columns == odd.columns and kept.where("lang IS NULL").count() == 0
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - {5, 6, 7, 9, 10}
    unlabelled = language.with_language(odd.withColumn("lang", F.lit(None).cast("string")), {})  # nothing to learn from: texts with letters stay
    assert {r.doc_id for r in unlabelled.collect()} == {r.doc_id for r in kept.collect()} and unlabelled.where("lang IS NOT NULL").count() == 0
    assert language.learn(nothing) == {} and language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(nothing, prototypes).count() == 0


def test_prediction_by_brute_force_and_ties():
    """Bundles of bound and rotated letter vectors, a trigram at a time; of equal cosines the first name wins."""
    vectors, classes = language.letter_vectors().astype(float), language.letter_classes()

    def profile(t):
        cut = re.sub(r"[^a-zäöüß]+", " ", t.lower())
        codes = [classes[ord(c)] if c != " " else 0 for c in f" {cut.strip()} "]
        return sum(np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    known = {"de": "die straße führt über den fluss", "en": "the road leads over the river", "fr": "la route passe sur le fleuve"}
    prototypes = {k: profile(t) / np.linalg.norm(profile(t)) for k, t in known.items()}
    names, matrix = language.as_matrix(prototypes)
    texts = ["Über die Straße!", "over the road, 42 leads", "sur la route", "x", "the the the the", "fluss river fleuve"]
    langs, scores = language.predict(texts, names, matrix)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        p = profile(t)
        cosines = {k: float(v @ p / np.linalg.norm(p)) for k, v in prototypes.items()}
        assert lang == max(cosines, key=cosines.get) and abs(score - max(0.0, cosines[lang])) < 1e-5
    tied = language.as_matrix({"b": prototypes["en"], "c": prototypes["en"]})
    assert language.predict(["the road"], *tied)[0] == ["b"] and language.predict(["", "42 !", "the"], [], matrix[:0])[0] == ["und"] * 3


def test_learning_is_an_integer_sum(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    a, b = language.learn(docs.repartition(1)), language.learn(docs.repartition(5))
    assert all((a[k] == b[k]).all() for k in a)
    by = defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for r in docs.collect():
        for key in language.trigrams(r.text).tolist():
            by[r.lang] += language.bound_vectors(np.array([key]))[0]
    assert all(np.allclose(a[k], by[k] / np.linalg.norm(by[k])) for k in a)


def contained(docs, items, t):
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            n = min(5, len(v))
            s = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            hit = len(s & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}) if n else 0
            if s and hit >= t * len(s) - 1e-9:
                out.append((d, i, len(s), hit, hit / len(s)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_containment(spark, odd, odd_rows, nothing, block_bytes):
    long = odd_rows[16][1].split(" ")
    items = [(1, " ".join(long[3000:3040])), (2, " ".join([*long[100:140], "not", "there"])), (3, "one"), (4, "a b c"), (5, None), (6, ""), (7, "no such words in any text at all"), (None, odd_rows[0][1].upper()), (8, "?!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontamination.find_items(odd, table, block_bytes=block_bytes).collect()), key=str)
    assert got == contained(odd_rows, items, 0.8) and any(r[0] == 13 for r in got)
    clean = decontamination.without_items(odd, table, block_bytes=block_bytes)
    assert clean.columns == odd.columns and clean.count() == len(odd_rows) - sum(any(contained([r], items, 0.8)) for r in odd_rows)
    assert decontamination.find_items(nothing, table).count() == 0 and decontamination.find_items(odd, table.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance_is_the_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 3, rng.integers(0, 15)).tolist() for _ in range(2))
        d = distance(a, b)
        for limit in range(16):
            assert near_duplicates.banded_distance(a, b, limit) == (d if d <= limit else None)


def test_order_min_hash_sees_order_and_repeats():
    a = fingerprints.mixed(np.arange(1, 200, dtype=np.uint64))
    keys = near_duplicates.order_min_hash(a)[0]
    assert (keys == near_duplicates.order_min_hash(a)[0]).all()
    assert (keys == near_duplicates.order_min_hash(a[::-1])[0]).sum() == 0
    assert (keys == near_duplicates.order_min_hash(np.append(a[:-5], a[:5]))[0]).mean() > 0.5
    assert len(set(near_duplicates.labelled(np.repeat(a[:3], 4)).tolist())) == 12


def brute_classes(rows, t=0.8):
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cut = [words(a) for _, a in rows]
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if (a or "") == (b or "") or (cut[i] and cut[j] and min(len(cut[i]), len(cut[j])) >= 0.79 * max(len(cut[i]), len(cut[j])) and near_duplicates.similar(cut[i], cut[j], t)):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicate_classes(spark, odd, odd_rows, nothing):
    assert Counter((r.doc_id, r.class_id) for r in near_duplicates.near_duplicate_classes(odd).collect()) == brute_classes(odd_rows)
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns
    with_id = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert with_id == sorted([4, *{c for _, c in brute_classes(odd_rows) if c is not None}])  # two unlike texts have the id 4
    assert kept.where("doc_id IS NULL").count() == 2  # two unlike texts without an id
    assert near_duplicates.near_duplicate_classes(nothing).count() == 0 and near_duplicates.one_of_each(nothing).count() == 0


def test_near_duplicates_of_real_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.class_id) for r in near_duplicates.near_duplicate_classes(docs).collect()) == brute_classes(rows)


def test_hot_buckets_and_chains(spark, monkeypatch):
    """A shared passage in many unlike texts links none of them; a chain of edits is one class."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, rows = text(60), []
    for i in range(90):
        rows.append((i, f"{text(60)} {passage} {text(60)}"))
    chain = text(100).split(" ")
    for i in range(100, 110):
        rows.append((i, " ".join(chain)))
        for k in rng.integers(0, 100, 3):
            chain[k] = f"new{i}{k}"
    monkeypatch.setattr(near_duplicates, "HOT", 4)
    monkeypatch.setattr(near_duplicates, "BLOCK", 5)
    monkeypatch.setattr(near_duplicates, "CROWDED", 6)
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(90)) and {got[i] for i in range(100, 110)} == {100}


def classes_of(spark, rows):
    return {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_near_pairs_in_a_crowded_bucket(spark, monkeypatch):
    """Pairs that share only a passage of 90 unlike texts, and with it most of their words, are found among those, in many blocks."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage, rows = list(rng.choice(vocabulary, 60)), []
    for i in range(0, 180, 2):
        own = list(rng.choice(vocabulary, 30))
        rows.append((i, " ".join(passage + own)))
        if i < 16:
            rows.append((i + 1, " ".join(passage + [w if k % 2 else f"x{i}_{k}" for k, w in enumerate(own)])))  # 75 of 90 words, J = 0.48
    monkeypatch.setattr(near_duplicates, "CROWDED", 16)
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    assert classes_of(spark, rows) == {i: i - i % 2 for i, _ in rows}


def test_links_of_texts_that_are_no_heads(spark):
    """A text is linked although in each of its buckets a text of its own component, unlike the other, comes before it."""
    rng = np.random.default_rng(6)
    base = list(rng.choice([f"w{i}" for i in range(5000)], 100))
    edit = lambda at, n, name: " ".join(f"{name}{k}" if at <= k < at + n else w for k, w in enumerate(base))

    def marked(text, low):
        """text with signs that change its digest only: to one of the least, or to one of the largest."""
        return next(t for k in range(100_000) if (hashlib.sha256((t := text + "." * k).encode()).hexdigest()[:2] == "00") == low and (low or hashlib.sha256(t.encode()).hexdigest()[0] == "f"))

    rows = [(1, marked(edit(0, 18, "b"), False)), (2, marked(" ".join(base), False))]
    rows += [(3 + i, marked(edit(18 + 10 * i, 10, f"s{i}_"), True)) for i in range(8)]
    assert set(classes_of(spark, rows).values()) == {1}


def test_short_texts_and_spread_edits(spark):
    """Any word of a short text may be replaced, left out or added; long texts may be edited evenly up to the threshold."""
    rng = np.random.default_rng(8)
    vocabulary, rows, want, number = [f"w{i}" for i in range(5000)], [], {}, iter(range(10_000))

    def add(*texts):
        ids = [next(number) for _ in texts]
        rows.extend((i, " ".join(t)) for i, t in zip(ids, texts, strict=True))
        want.update(dict.fromkeys(ids, ids[0]))

    for n in range(5, 20):
        for at in range(n):
            t = list(rng.choice(vocabulary, n))
            edits = [[*t[:at], "new", *t[at + 1 :]], [*t[:at], "more", *t[at:]]]
            add(t, *(edits if n > 5 else edits[:1]), *([t[:at] + t[at + 1 :]] if n > 5 else []))
    for n in (10, 15, 20, 30, 40, 45, 50, 60, 100, 300, 1000):
        for step in (5, 7, 10):
            t = list(rng.choice(vocabulary, n))
            add(t, [f"x{n}_{step}_{k}" if k % step == 2 else w for k, w in enumerate(t)])
    assert classes_of(spark, rows) == want


def test_pairs_that_share_a_long_passage(spark, monkeypatch):
    """100 pairs, similar above the threshold, share one passage of 130 of their 200 words: rare words bring each pair together."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(20_000)]
    passage, rows = list(rng.choice(vocabulary, 130)), []
    for i in range(0, 200, 2):
        own = list(rng.choice(vocabulary, 70))
        rows.append((i, " ".join(own[:35] + passage + own[35:])))
        own = [f"x{i}_{k}" if k % 2 else w for k, w in enumerate(own)]
        rows.append((i + 1, " ".join(own[:35] + passage + own[35:])))
    monkeypatch.setattr(near_duplicates, "CROWDED", 40)
    assert classes_of(spark, rows) == {i: i - i % 2 for i, _ in rows}


def test_texts_with_a_passage_alone_go_before_rare_words(spark):
    """Of texts that share a passage those stay that are similar to one of another label, whatever the edits, and others go."""
    rng = np.random.default_rng(14)
    vocabulary, rows, pairs = [f"w{i}" for i in range(50_000)], [], set()
    passage = list(rng.choice(vocabulary, 40))
    add = lambda t, label: rows.append((len(rows).to_bytes(16, "big"), len(t), label.to_bytes(16, "big"), zstandard.compress(" ".join(t).encode())))
    for i in range(40):
        add(passage + list(rng.choice(vocabulary, 60)), i)
    for i, at in enumerate([range(2, 100, 5), range(0, 100, 5), range(0, 20), range(80, 100)]):
        t = list(rng.choice(vocabulary, 100))
        for edited in ([f"x{i}_{k}" if k in at else w for k, w in enumerate(t)], [w for k, w in enumerate(t) if k not in at], [x for k, w in enumerate(t) for x in ([w, f"y{i}_{k}"] if k in at else [w])]):
            pairs |= {len(rows), len(rows) + 1}
            assert near_duplicates.similar(t, edited)
            add(t, 100 + len(rows))
            add(edited, 100 + len(rows))
    for _ in range(5):  # copies under one label only
        add(["a", *rows[0][1] * ["b"]], 99)
    df = spark.createDataFrame(rows, "h binary, n_words int, label binary, z binary").repartition(3)
    assert {int.from_bytes(r.h, "big") for r in near_duplicates.without_lone(df, 0.8).collect()} == pairs
    assert near_duplicates.without_lone(df.limit(0), 0.8).count() == 0


def test_the_closest_pair_of_two_components(spark):
    """Of two components that meet in several groups the closest pair alone is a candidate of the first round; texts that are components of their own don't meet in the last."""
    rng = np.random.default_rng(15)
    base, rows = [int(x) for x in rng.integers(0, 1 << 62, 100)], []
    for i in range(24):
        words = np.array(base[: 100 - i % 8] + [int(x) for x in rng.integers(0, 1 << 62, i % 8)], np.uint64)
        label = i // 8 if i < 16 else i
        rows += [(key, 0, 0, 0, i.to_bytes(16, "big"), label.to_bytes(16, "big"), 100, near_duplicates.bag_of(words), i < 16) for key in (1, 2, 3)]
    df = spark.createDataFrame(rows, "key long, lo int, hi int, side int, h binary, label binary, n_words int, bag binary, many boolean").repartition(3)
    pairs = lambda *x: {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in near_duplicates.meetings(*x).collect()}
    labels = [i // 8 if i < 16 else i for i in range(24)]
    every = {(i, j) for j in range(24) for i in range(j) if labels[i] != labels[j]}
    assert pairs(df.drop("many"), 0.8) == every
    first = pairs(df.drop("many"), 0.8, True)
    assert (0, 8) in first and Counter((labels[i], labels[j]) for i, j in first) == Counter({(labels[i], labels[j]) for i, j in every})
    assert pairs(df, 0.8) == {(i, j) for i, j in every if i < 16}


@pytest.mark.parametrize("later", [3, 200])
def test_texts_that_share_rare_words_meet_over_one(spark, monkeypatch, later):
    """Two texts meet in one group of those that they share, or in a few where the list of others is cut, and each two in one at least."""
    monkeypatch.setattr(near_duplicates, "LATER", later)
    rng = np.random.default_rng(16)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = list(rng.choice(vocabulary, 150))
    texts = [" ".join(w if rng.random() < 0.9 else str(rng.choice(vocabulary)) for w in passage) for _ in range(24)]
    crowd = spark.createDataFrame([(i.to_bytes(16, "big"), 150, i.to_bytes(16, "big"), zstandard.compress(t.encode())) for i, t in enumerate(texts)], "h binary, n_words int, label binary, z binary")
    rare = near_duplicates.rarest_words(crowd, 0.8).localCheckpoint()
    profiles = near_duplicates.profiles_of(rare.select("h", F.lit(b"").alias("bag")), rare)
    rows = [r.asDict() for r in near_duplicates.with_others(near_duplicates.words_apart(rare), profiles).collect()]
    groups, shared, met = {}, Counter(), Counter()
    for r in rows:
        groups.setdefault(r["key"], []).append((int.from_bytes(r["h"], "big"), set(np.frombuffer(r["others"], np.int32).tolist())))
    for group in groups.values():
        two = [((a, b), x.isdisjoint(y)) for a, x in group for b, y in group if a < b]
        shared.update(p for p, _ in two)
        met.update(p for p, apart in two if apart)
    assert set(met) == set(shared) and sum(met.values()) < 0.7 * sum(shared.values())
    assert later < 150 or set(met.values()) == {1}
    # Of the rows of one group those alone meet that don't meet elsewhere.
    key = max(groups, key=lambda k: sum(not x.isdisjoint(y) for a, x in groups[k] for b, y in groups[k] if a < b))
    bag = bytes(near_duplicates.BAG)
    df = spark.createDataFrame([(key, 0, 0, 0, r["h"], r["label"], 150, bag, r["others"]) for r in rows if r["key"] == key], "key long, lo int, hi int, side int, h binary, label binary, n_words int, bag binary, others binary")
    got = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in near_duplicates.meetings(df, 0.8).collect()}
    own = sorted(groups[key], key=itemgetter(0))
    assert got == {(a, b) for a, x in own for b, y in own if a < b and x.isdisjoint(y)} and len(got) < len(own) * (len(own) - 1) / 2


def test_bags_tell_unlike_texts_apart(spark):
    """Texts whose words agree modulo 128 alone aren't candidates, and edited ones are."""
    words = np.random.default_rng(17).integers(0, 1 << 40, 200).astype(np.uint64) * np.uint64(512)
    texts = [words, words + np.uint64(128), np.concatenate((words[:170], words[:30] + np.uint64(256)))]
    rows = [(1, 0, 0, 0, i.to_bytes(16, "big"), i.to_bytes(16, "big"), 200, near_duplicates.bag_of(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "key long, lo int, hi int, side int, h binary, label binary, n_words int, bag binary")
    assert [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in near_duplicates.meetings(df, 0.8).collect()] == [(0, 2)]


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.19])
def test_recall_of_the_sketch(share):
    """Edits spread evenly over 200 words, of three kinds: at least 0.97 of the pairs above the threshold share a tuple."""
    rng, hits, pairs = np.random.default_rng(int(100 * share)), 0, 300
    for _ in range(pairs):
        a = fingerprints.mixed(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        at = np.arange(1, 200, 1 / share).astype(int)
        kind = rng.integers(0, 3)
        b = a.copy()
        b[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        b = b if kind == 0 else np.delete(a, at) if kind == 1 else np.insert(a, at, b[at])
        assert near_duplicates.similar(a.tolist(), b.tolist())
        hits += bool(np.intersect1d(near_duplicates.keys_of(a), near_duplicates.keys_of(b)).size)
    assert hits >= 0.97 * pairs


def lm_brute(rows, train=None):
    """Scores by the counts of train; by those of all rows but the own where it is None."""
    one, two = Counter(), Counter()
    for _, t in rows if train is None else train:
        w = words(t)
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    everything, all_one, all_two, out = sum(one.values()), one, two, []
    for d, t in rows:
        w = words(t)
        one, two, n = all_one, all_two, everything
        if train is None:
            one, two, n = all_one - Counter(w), all_two - Counter(zip(w, w[1:], strict=False)), max(everything - len(w), 1)
        alone = lambda w, one=one, n=n: math.log((one[w] or 1) / n)
        s = sum(math.log(two[p] / one[p[0]]) if two[p] else math.log(0.4) + alone(p[1]) for p in zip(w, w[1:], strict=False))
        out.append((d, len(w), s + alone(w[0]) if w else 0.0))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[2], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])


@pytest.mark.parametrize("block_words", [2_000_000, 50])
def test_scores_of_a_corpus(spark, odd, odd_rows, nothing, monkeypatch, block_words):
    monkeypatch.setattr(lm_scores, "BLOCK_WORDS", block_words)
    got = lm_scores.score_corpus(odd).collect()
    close([(r.doc_id, r.n_words, r.log_score) for r in got], lm_brute(odd_rows))
    held = Counter(b for _, t in odd_rows for b in {*zip(words(t), words(t)[1:], strict=False)})
    back = Counter((d, sum(held[b] == 1 for b in zip(words(t), words(t)[1:], strict=False))) for d, t in odd_rows)
    assert Counter((r.doc_id, r.n_backed_off) for r in got) == back and any(n for _, n in back)
    assert lm_scores.score_corpus(nothing).count() == 0
    assert lm_scores.score_corpus(odd.where("text IS NULL")).collect()[0].log_score == 0.0


def test_scores_back_off(spark, odd, odd_rows, nothing):
    train = [r for r in odd_rows if r[0] in (1, 4, 12)]
    close(lm_scores.score_against(odd, odd.where("doc_id IN (1, 4, 12)")).collect(), lm_brute(odd_rows, train))
    assert lm_scores.score_against(nothing, odd).count() == 0
