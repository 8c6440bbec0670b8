from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rangeweave.llm import context_mixing as cm
from rangeweave.llm import mixing, syncmers

from .helpers import by_id, documents, noise, saved, words

# ---------------------------------------------------------------- mixing


def test_raked_weights_meet_the_margins():
    cells = {("a", "en", "x"): 60.0, ("a", "fr", "y"): 10.0, ("b", "en", "y"): 20.0, ("b", "fr", "x"): 10.0, (None, "en", "x"): 5.0}
    targets = [{"a": 0.5, "b": 0.4, None: 0.1}, {"en": 0.7, "fr": 0.3}, {"x": 0.6, "y": 0.4}]
    weights = mixing.rake(cells, targets)
    for i, t in enumerate(targets):
        for level, share in t.items():
            assert abs(sum(weights[k] * m for k, m in cells.items() if k[i] == level) / sum(cells.values()) - share) < 1e-6


def test_tables_rake_like_the_driver(spark):
    cells = {("a", "en", "x"): 60.0, ("a", "fr", "y"): 10.0, ("b", "en", "y"): 20.0, (None, "fr", "x"): 10.0}
    targets = [{"a": 0.5, "b": 0.3, None: 0.2}, {"en": 0.6, "fr": 0.4}, {"x": 0.55, "y": 0.45}]
    df = spark.createDataFrame([(*k, m) for k, m in cells.items()], "source string, lang string, topic string, mass double")
    frames = [spark.createDataFrame(list(t.items()), f"{m} string, share double") for m, t in zip(mixing.MARGINS, targets)]
    got = {tuple(r[:3]): r.weight for r in mixing.rake_table(df, frames, rounds=4).collect()}
    mixing_rounds, mixing.ROUNDS = mixing.ROUNDS, 4
    try:
        want = mixing.rake(cells, targets)
    finally:
        mixing.ROUNDS = mixing_rounds
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mixing_query(spark, tmp_path):
    texts = noise(12, 400)
    got = mixing.op6_mixing(spark, saved(documents(spark, texts), tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(words(texts[r.doc_id])) and 0 <= r.probability <= 1
    mass = collections.Counter()
    for r in got:
        mass[r.source] += r.n_tokens
    want = mixing.tempered(mass)
    total = sum(r.n_tokens for r in got)
    for s, share in want.items():
        assert abs(sum(r.weight * r.n_tokens for r in got if r.source == s) / total - share) < 1e-6
    expected = sum(r.probability for r in got)
    assert abs(sum(r.kept for r in got) - expected) < 4 * math.sqrt(len(got)) and max(r.probability for r in got) == 1
    docs = documents(spark, texts)
    again = {r.doc_id: r.mix_kept for r in mixing.weighed(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.kept for r in got}
    assert mixing.weighed(docs.limit(0)).count() == 0


def hot(spark):
    """A source with half of the tokens, eight rarer ones, and cells of few texts or of none with words."""
    rows = [(i, "same long line of words " * 4 + str(i), ["en", "fr"][i % 3 == 0], "hot" if i < 400 else f"s{i % 8}") for i in range(800)]
    rows += [(900, "rare text | | | |", "xx", "rare"), (901, "", "yy", "empty"), (902, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("cells", [mixing.CELLS, 1])
def test_only_a_hot_source_is_thinned(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    got = mixing.weighed(hot(spark)).collect()
    assert len(got) == 803
    assert all(r.mix_kept and r.mix_probability == 1 for r in got if r.source != "hot")
    mass = collections.Counter()
    for r in got:
        mass[r.source == "hot"] += r.mix_probability * r.mix_tokens
    assert abs(mass[True] / sum(mass.values()) - mixing.MOST) < 1e-6
    assert 80 < sum(r.mix_kept for r in got if r.source == "hot") < 190


def uneven(spark):
    """English has most tokens of all, and of source s0 most of all; no source is over the bound."""
    rows = [(i, "words of one line " * (3 + i % 5), "en" if i % 10 < 6 + 2 * (i % 8 < 2) else ["de", "fr", "es"][i % 3], f"s{i % 8}") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


def test_query_rakes_languages_against_sources(spark, tmp_path):
    docs = uneven(spark)
    got = mixing.op6_mixing(spark, saved(docs, tmp_path)).collect()
    mass, weight = collections.Counter(), collections.Counter()
    for r in got:
        for level in (r.source, r.lang):
            mass[level] += r.n_tokens
            weight[level] += r.weight * r.n_tokens
    total = sum(r.n_tokens for r in got)
    assert len(got) == 600 and mass["en"] / total > 0.6 and max(v for k, v in mass.items() if k[0] == "s") / total < mixing.MOST
    assert abs(weight["en"] / total - 0.5) < 1e-6
    assert all(abs(weight[f"s{i}"] - mass[f"s{i}"]) / total < 1e-6 for i in range(8))
    # a source with much English has more weight than one with little, in every language: the fit works on both margins
    of = {(r.source, r.lang): r.weight for r in got}
    assert of["s0", "en"] > 1.02 * of["s2", "en"] and len({round(w, 6) for (_, lang), w in of.items() if lang == "en"}) > 2
    expected = sum(r.probability for r in got)
    assert abs(sum(r.kept for r in got) - expected) < 4 * math.sqrt(len(got)) and sum(r.kept for r in got) < 0.9 * len(got)


def test_tables_of_cells_rake_like_the_driver(spark, monkeypatch):
    docs = uneven(spark)
    one = by_id(mixing.weighed(docs, bounded=("source", "lang")))
    monkeypatch.setattr(mixing, "CELLS", 1)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    many = by_id(mixing.weighed(docs, bounded=("source", "lang")))
    assert all(abs(many[i].mix_weight - r.mix_weight) < 1e-2 for i, r in one.items())


def test_shares_stay_under_the_bound():
    for mass in ({"a": 90.0, "b": 5.0, "c": 5.0, **{f"x{i}": 2.0 for i in range(9)}}, {"a": 400.0, "b": 300.0, "c": 200.0, **{i: 1.0 for i in range(40)}}):
        got = mixing.tempered(mass)
        assert abs(sum(got.values()) - 1) < 1e-9 and max(got.values()) <= mixing.MOST + 1e-9
        assert len({round(got[k] / v, 12) for k, v in mass.items() if got[k] < mixing.MOST - 1e-9}) == 1
    even = {i: 1.0 for i in range(20)}
    assert all(abs(v - 0.05) < 1e-12 for v in mixing.tempered(even).values()) and mixing.tempered({"a": 3.0}) == {"a": 1.0}


# ---------------------------------------------------------------- language model


def lowered(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]


def test_base_scores_equal_brute_force(spark, tmp_path):
    texts = noise(14, 200)
    got = by_id(cm.op5_context_mixing(spark, saved(documents(spark, texts), tmp_path)))
    tokens = {i: [*lowered(t), None] for i, t in enumerate(texts)}
    count = collections.Counter(x for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(count[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


def test_passes_over_split_tables_give_the_same_sums(spark):
    docs = documents(spark, noise(15, 60))
    one, many = (by_id(cm.scores(docs, n)) for n in (1 << 20, 150))
    for i, r in one.items():
        assert (many[i].n_known, many[i].n_tokens) == (r.n_known, r.n_tokens)
        assert math.isclose(many[i].base_score, r.base_score, rel_tol=1e-9) and math.isclose(many[i].score, r.score, rel_tol=1e-9)


def test_the_two_values_of_a_bit_have_all_probability():
    r = np.random.default_rng(0)
    mixer = cm.Mixer()
    mixer.by_part, mixer.by_gate = (r.uniform(0.01, 0.99, t.shape).astype(np.float32) for t in (mixer.by_part, mixer.by_gate))
    x, part, evidence = r.normal(size=(50, len(cm.CONTEXTS))).astype(np.float32), r.integers(1, 256, 50), r.integers(0, 20, 50)
    one, zero = (mixer.predict(3, part, s * x, np.full(50, s, np.float32), evidence) for s in (1, -1))
    assert np.allclose(one + zero, 1, atol=1e-5)


def slow_bits(rows, steps=cm.STEPS):
    """(cost of a (word, kind), mixer) from definitions: contexts are tuples in dictionaries, and decisions go one by one."""
    seen = collections.defaultdict(lambda: [0.0, 0.0])

    def decisions(word, kind):
        data = word + b" "
        for i, byte in enumerate(data):
            for k in range(8):
                part, bit = (byte | 256) >> (8 - k), byte >> (7 - k) & 1
                names = [(j, data[max(0, i - order) if order else 0 : i], kind if kinded else None, part) for j, (order, kinded) in enumerate(cm.CONTEXTS)]
                yield k, part, bit, names

    for word, kind, n in rows:
        for _, _, bit, names in decisions(word, kind):
            for name in names:
                seen[name][bit] += n

    def inputs(bit, names, own):
        came = [max(seen[x][bit] - own, 0) for x in names]
        other = [seen[x][1 - bit] for x in names]
        evidence = came[-2] + other[-2]
        return np.array([math.log(c + 0.02) - math.log(o + 0.02) for c, o in zip(came, other)]), sum(evidence > x for x in cm.SEEN)

    weights, c = np.full((cm.GATES, len(cm.CONTEXTS)), 0.25), len(cm.CONTEXTS)
    mixed = lambda x, gate: min(max(float(weights[gate] @ x), -7.99), 7.99)
    squash = lambda x: 1 / (1 + math.exp(-x))
    for _ in range(steps):
        slope, curve = np.zeros((cm.GATES, c)), np.zeros((cm.GATES, c, c))
        for word, kind, n in rows:
            for k, _, bit, names in decisions(word, kind) if n else ():
                x, level = inputs(bit, names, 1)
                gate = k * (len(cm.SEEN) + 1) + level
                p = squash(mixed(x, gate))
                slope[gate] += n * (1 - p) * x
                curve[gate] += n * max(p * (1 - p), 1e-4) * np.outer(x, x)
        for g in range(cm.GATES):
            weights[g] += np.clip(np.linalg.solve(curve[g] + cm.PRIOR * np.eye(c), slope[g]), -1, 1)
    ones, every = collections.Counter(), collections.Counter()
    for word, kind, n in rows:
        for k, part, bit, names in decisions(word, kind) if n else ():
            x, level = inputs(bit, names, 1)
            gate = k * (len(cm.SEEN) + 1) + level
            knot = round((mixed(x, gate) * (1 if bit else -1) + 8) * 2)
            for cell in (("part", part, knot), ("gate", gate, knot)):
                ones[cell] += n * bit
                every[cell] += n
    table = lambda cell: (ones[cell] + cm.REFINE * squash(float(cm.KNOTS[cell[2]]))) / (every[cell] + cm.REFINE)

    def cost(word, kind):
        total = 0.0
        for k, part, bit, names in decisions(word, kind):
            x, level = inputs(bit, names, 0)
            gate = k * (len(cm.SEEN) + 1) + level
            m = mixed(x, gate)
            place = (m * (1 if bit else -1) + 8) * 2
            low, high = int(place), place - int(place)
            one = sum(table((t, row, low)) * (1 - high) + table((t, row, low + 1)) * high for t, row in (("part", part), ("gate", gate))) / 4
            total -= math.log2(min(max(0.5 * squash(m) + (one if bit else 0.5 - one), 1e-6), 1 - 1e-6))
        return total

    return cost


def costs(spark, rows):
    words_in = spark.createDataFrame([(bytearray(w), k, n, n) for w, k, n in rows], "word binary, kind byte, n long, c long")
    blocks = words_in.filter("n > 0").repartition(2).mapInArrow(cm._tabled, "block long, seen binary").groupBy("block").applyInArrow(cm._added, "block long, seen binary")
    seen = cm._folder(cm.written(blocks, "word-contexts"))
    got = words_in.mapInArrow(cm._costed(seen, cm.learned(words_in, seen)), "hash long, c long, bits float").collect()
    return {r.hash: r.bits for r in got}


def test_bits_equal_a_model_made_of_dictionaries(spark):
    rows = [(b"the", 0, 40), (b"then", 0, 9), (b"the", 1, 3), (b"that", 1, 1), (b"\n", 0, 20), (b"\n", 1, 4), ("né".encode(), 0, 2), (b"unseen", 1, 0), (b"thea", 0, 0)]
    slow, got = slow_bits(rows), costs(spark, rows)
    for word, kind, _ in rows:
        h = int(cm.pair_hashes(cm._hashes(cm.pa.array([word], cm.pa.binary())), np.array([kind])).view(np.int64)[0])
        assert abs(got[h] - slow(word, kind)) < 0.02 * max(1, slow(word, kind)), word


def test_all_words_have_at_most_all_probability(spark):
    """Over every word of up to two of four letters, learned from or not; others take the rest."""
    letters = b"abcd"
    every = [bytes([a]) for a in letters] + [bytes([a, b]) for a in letters for b in letters]
    rows = [(w, 0, (7 * i) % 5) for i, w in enumerate(every)]
    total = sum(2.0 ** -b for b in costs(spark, rows).values())
    assert 0.5 < total <= 1 + 1e-6


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = documents(spark, noise(16, 80))
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 4, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(by_id(cm.scores(docs.repartition(parts + 1))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    for other in found[1:]:
        assert all(math.isclose(other[i].score, r.score, rel_tol=1e-5) for i, r in found[0].items())


def test_learning_beats_the_base_on_held_out_texts(spark):
    got = cm.op5_context_mixing(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("held out, a token:", got[0] / got[2], "base:", got[1] / got[2])
    assert got[0] > got[1]


def test_scores_without_training_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = cm.scores(docs).collect()
    assert len(got) == 2 and all(r.train_tokens == 0 and r.n_known == 0 and not r.held_out for r in got)
    assert cm.scores(docs.limit(0)).count() == 0


def test_rare_forms_shape_the_kinds(spark):
    """Every training text counts: 6 texts of 6,000, which a sample of 2,000 may miss, are in the centres' sums."""
    rows = [(i, f"plain words of the usual form {i}") for i in range(6000)] + [(10_000 + i, "\u6f22\u5b57" * 400) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = docs.withColumn("learn", F.lit(True))
    centres = cm.find_kinds(learned)
    rare, plain = (cm.profiles(cm.Flat(cm.pa.array([t]), cm.LOWER)) for t in ("\u6f22\u5b57" * 400, rows[0][1]))
    assert (rare @ centres.T).max() > 0.99 and (rare @ centres.T).argmax() != (plain @ centres.T).argmax()
    sums = [cm.np.frombuffer(r.n, cm.np.int64).sum() for r in learned.select("text").mapInArrow(cm._nearest(centres, 1), "sums binary, n binary, far binary").collect()]
    assert sum(sums) == len(rows)
    assert ((cm.find_kinds(learned.repartition(7)) * centres).sum(1) > 0.999).all()  # rounding may move texts between two centres


# ---------------------------------------------------------------- fingerprints


def signed(b):
    v = xxhash.xxh64(b, seed=42).intdigest()
    return v - (1 << 64) if v >> 63 else v


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64((v & (1 << 64) - 1).to_bytes(8, "little"), seed=seed).intdigest()
    return seed & 0xFFFFFFFF


def sketch(text, k=syncmers.K, s=syncmers.S):
    """Steps from anchor to anchor with the bytes between them."""
    b, found = text.encode(), []
    if 0 < len(b) < k:
        found.append((0, signed(b) & 0xFFFFFFFF))
    h = [signed(b[i : i + s]) for i in range(len(b) - s + 1)]
    for i in range(len(b) - k + 1):
        v = h[i : i + k - s + 1]
        inner = min(v[1:-1])
        if min(v[0], v[-1]) < inner:
            found.append((i, signed(b[i : i + k]) & 0xFFFFFFFF))
    out = {spark_hash(found[0][1])} if found else set()
    out |= {spark_hash(x, y, j - i) for (i, x), (j, y) in zip(found, found[1:])}
    return sorted(out)[: syncmers.SKETCH]


def alike(a, b):
    u = sorted({*a, *b})[: syncmers.SKETCH]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


def spelt(a):
    return "".join(f"{x:08x}" for x in a)


@pytest.mark.parametrize("n", [40, 1])
def test_fingerprints_equal_brute_force(spark, tmp_path, n):
    texts = (noise(21, n) + ["z" * 20000 + "".join(map(str, range(3000)))])[-70:] if n > 1 else ["only one text here"]
    ids = [3 * i - 50 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = by_id(syncmers.op8_syncmers(spark, saved(docs, tmp_path)))
    order = sorted(zip(ids, [t or "" for t in texts]), reverse=True)
    for j, (i, t) in enumerate(order):
        after = order[(j + 1) % len(order)][1]
        m = len(t) // 2
        edited = t[: len(t) - m] + after[:m]
        a, e, x, r = sketch(t), sketch(edited), sketch(after), got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), spelt(a), spelt(e))
        assert math.isclose(r.near_edited, alike(a, e)) and math.isclose(r.near_next, alike(a, x))


def test_fingerprints_of_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same words here, long enough"), (1, "same words here, long enough"), (None, "x"), (None, None), (2, "")], "doc_id long, text string")
    rows = syncmers.fingerprints(docs).collect()
    assert len(rows) == 5 and len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert syncmers.fingerprints(docs.limit(0)).count() == 0


def test_positional_matches_find_the_shift(spark):
    passage = " ".join(f"token{i}" for i in range(60))
    left = spark.createDataFrame([(1, "intro " + passage)], "doc_id long, text string")
    right = spark.createDataFrame([(2, "another, longer beginning: " + passage), (3, "nothing in common at all")], "doc_id long, text string")
    best = syncmers.positional_matches(left, right).orderBy(F.desc("matches")).first()
    assert (best.right_id, best["shift"]) == (2, len("another, longer beginning: ") - len("intro "))


def test_likeness_goes_by_positions(spark):
    """The same passages in another order keep their anchors but not the steps between passages."""
    passages = [f"passage {c} of some words that belong to it alone {c * 3}" for c in "abcdefgh"]
    gaps = "".join(x + "#" * (7 * i) for i, x in enumerate(passages))
    docs = spark.createDataFrame([(3, " ".join(passages)), (2, "moved on: " + " ".join(passages)), (1, gaps)], "doc_id long, text string")
    got = by_id(syncmers.fingerprints(docs))
    assert got[3].near_next > 0.85 and got[2].near_next < got[3].near_next


def test_rows_without_an_id_are_dealt_too(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    many = syncmers.in_sequence(rows.withColumn("tie", F.xxhash64("text"))).filter("side = 0").groupBy("bucket").count().collect()
    assert sum(r[1] for r in many) == 4000 and len(many) >= 7
    got = syncmers.fingerprints(rows).collect()
    assert len(got) == 4000 and all(0 <= r.near_next <= 1 for r in got)


def test_native_plan(spark):
    plan = syncmers.op8_syncmers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
