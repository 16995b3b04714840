"""Each operator against a plain form of it, on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import ann, boosting, common, bpe, components, fingerprint, labelled, langid, minhash, mix, neardup, pagetext, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"
ODD = [None, "", "  \n\t ", "one", "one two", "ÀÉ ñ ß 中文 😀😀", "a" * 5000, "word " * 3000, "don't <|endoftext|> I'LL\x1cx", "ΑΣ ΟΔΟΣ İstanbul"]
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, schema=DOCS):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "c"][i % 4], None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- tokens ----

def test_tokens_are_those_of_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x300, 0x3000), 0x1F600 + rng.randrange(60)])) for _ in range(30)) for _ in range(400)]
    pairs = [f"{chr(a)}{chr(b)}" for a in range(128) for b in range(128)] + [f"abc{chr(a)} d" for a in range(300)]
    odd += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(97, 123), rng.randrange(0x250)])) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    for text in [t or "" for t in ODD] + odd + pairs + list(lib.get_vocab())[::7]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_encoding_and_decoding_tables(spark):
    d = docs(spark, ODD)
    path = bpe.default_path()
    out = bpe.encode(d, path, keep=["doc_id", "component"], digests=True)
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(out, path).collect()}
    for r in out.collect():
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert hashlib.sha256(back[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"]
    assert out.count() == len(ODD) and bpe.encode(d.where("false"), path).count() == 0


# ---- near-duplicates ----

def brute_sets(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, width, percent=80):
    sets = [brute_sets(t, width) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return sets, label


def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    texts = list(ODD)
    for size in (6, 12, 60, 200):
        for _ in range(4):
            base = words(rng, size).split()
            for _ in range(8):
                w = list(base)
                for i in rng.sample(range(size), rng.choice([0, 1, max(1, size // 20), size // 10])):
                    w[i] = rng.choice(WORDS)
                texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
    monkeypatch.setattr(neardup, "BLOCK", 500)  # so that buckets are cut into blocks
    monkeypatch.setattr(neardup, "ROWS", 5)
    monkeypatch.setattr(common, "HOT", 3)  # and keys are hot
    for width in (2, 5):
        sets, label = brute_components(texts, width)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, texts), width=width).collect()}
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert [got[i]["component_id"] for i in range(len(texts))] == label
        assert all(got[i]["kept"] == (label[i] == i) for i in got)


def test_pairs_whose_bytes_agree_in_an_earlier_band_are_compared(spark):
    rng = random.Random(580)  # the pair's first band by bytes is 4, by whole hashes 6
    base = rng.sample(WORDS, 40)
    spare = [w for w in WORDS if w not in base]
    rng.shuffle(spare)
    texts = []
    for k in (1, 2, 3, 4):  # least rows of the pair's buckets, linked with neither
        r = random.Random(580_000 + k)
        texts.append(" ".join(r.sample(base[:36], 34) + r.sample(spare[4:], 8)))
    texts += [" ".join(base), " ".join(base[:36] + spare[:4])]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts), width=1).collect()}
    assert [got[i] for i in range(6)] == brute_components(texts, 1)[1] == [0, 1, 2, 3, 4, 4]


def test_no_link_near_the_threshold_is_lost(spark, monkeypatch):
    """Thousands of pairs whose similarity is about 0.8, in buckets that hold several components."""
    monkeypatch.setattr(neardup, "ROWS", 6)
    rng = random.Random(12)
    texts, want = [], []
    for group in range(250):
        pool = [f"g{group}x{i}" for i in range(60)]
        base = pool[:45]
        own = []
        for _ in range(8):
            w = set(base)
            for x in rng.sample(base, rng.choice([3, 4, 5, 6, 7])):
                w.discard(x)
            w |= set(rng.sample(pool[45:], rng.choice([0, 1, 3])))
            own.append(" ".join(sorted(w)))
        first = len(texts)
        want += [first + x for x in brute_components(own, 1)[1]]
        texts += own
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts), width=1).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 300


def test_cells_hold_every_pair_across_components_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS", 4)
    rng = random.Random(3)
    rows = [(b, 0, f"n{i:03}".encode(), 10, f"c{min(i // 20, 3) if i < 60 else i:03}".encode()) for b in (1, 2) for i in range(70)]
    rng.shuffle(rows)
    cells = neardup._cells(spark.createDataFrame(rows, "bucket long, band int, node binary, n_shingles long, component binary")).collect()
    met, held = Counter(), {}
    for c in cells:
        held.setdefault((c["bucket"], str(c["i"]), str(c["j"])), []).append((bytes(c["node"]), bytes(c["component"]), c["second"]))
    for (_, i, j), members in held.items():
        for x in members:
            for y in members:
                if x[0] < y[0] and x[1] != y[1] and (i == j or x[2] != y[2]):
                    met[x[0], y[0]] += 1
    component = {r[2]: r[4] for r in rows}
    assert met == {(x, y): 2 for x in component for y in component if x < y and component[x] != component[y]}
    assert max(map(len, held.values())) < 40


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 5), (2, 1), (3, 2), (None, 4), (9, 4)) for i in range(n)], "k long, i long")
    keys = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (3, 2, "c")], "k long, n long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_hot(rows, keys, "k", "n", 16, how).collect())) == sorted(map(str, rows.join(keys, "k", how).collect()))


def test_running_sums_and_slices(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("x")).repartition(9)
    got = {r["x"]: (r["s"], r["_alls"]) for r in common.running_sums(rows, [F.col("x")], {"s": F.col("x") * 2}, "_all").collect()}
    assert got == {x: (x * (x - 1), 249_500) for x in range(500)}
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (3, 0, 9, 1, 1, 50, 2)])], names=["t"])
    assert [p.num_rows for p in common.slices(batch, 0, 5)] == [2, 1, 2, 1, 1] and [p.num_rows for p in common.slices(batch.slice(2, 4), 0, 11)] == [3, 1]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d e f", "x"])
    twice = twice.union(twice).union(spark.createDataFrame([(None, "a b c d e f", None, None, None, None)], DOCS))
    got = sorted(neardup.near_duplicates(twice).collect(), key=str)
    other = spark.createDataFrame([("a", "1 2 3 4 5 6"), ("a", "u v w x y z"), ("b", "1 2 3 4 5 6"), ("B", "U V w x y z")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(other).collect()) == [("B", "B", True), ("a", "B", False), ("a", "a", True), ("b", "a", False)]
    assert len(got) == 5 and [r["component_id"] for r in got if r["doc_id"] is None] == [None] and not any(r["kept"] for r in got if r["doc_id"] is None)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    err = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        cut = int(rng.integers(50, 350))
        a, b = np.unique(pool[:cut]), np.unique(pool[cut // 3 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        err.append(np.mean(minhash.signature(a, 128) == minhash.signature(b, 128)) - true)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.05
    assert minhash.signature(np.array([7], np.uint64), 16).max() < 2**36  # each register is offered something


def test_components_of_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40) if i % 13] + [(100 + rng.randrange(50), 100) for _ in range(80)]
    label = {}
    for a, b in links:
        for x in (a, b):
            label.setdefault(x, x)
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and set(label) - set(got) <= {a for a, b in links if a == b}


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_links_that_one_task_can_hold_take_no_rounds(spark, monkeypatch, most):
    """Rounds are for links that span tasks; either way every node has the least one that it reaches."""
    rng = random.Random(8)
    links = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300) if i % 37] + [(f"h{rng.randrange(60):02}", "h00") for _ in range(120)] + [(None, "h01"), ("x", None), ("y", "y")]
    label = {x: x for p in links for x in p if None not in p and p[0] != p[1]}
    for _ in range(60):
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    rounds = []
    stars = components._stars
    monkeypatch.setattr(components, "_stars", lambda *a: rounds.append(1) or stars(*a))
    monkeypatch.setattr(components, "LINKS", most)
    rng.shuffle(links)
    for kind in ("string", "binary"):
        rows = spark.createDataFrame(links, "a string, b string").selectExpr(f"CAST(a AS {kind}) AS a", f"CAST(b AS {kind}) AS b")
        got = [tuple(bytes(x).decode() if kind == "binary" else x for x in r) for r in components.components(rows).select("node", "component").collect()]
        assert len(got) == len(dict(got)) and dict(got) == label
    assert bool(rounds) == (most == 40)


# ---- mixing ----

def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares given out again and again until none is above most times its source's size."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    n = dict(sizes)
    out, open_, left = {}, set(n), float(sum(n.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > most * n[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * n[s])
            left -= out[s]
        open_ -= over
    return out


def test_targets_fill_up_and_share_out(spark):
    rng = random.Random(2)
    for sizes in ([("a", 10), ("b", 100), ("c", 1000), (None, 0), ("d", 5)], [], [("a", 0), (None, 0)], [(f"h{i}.é", rng.choice([0, 1, 7, 10**rng.randrange(9)])) for i in range(300)] + [("", 4), (None, 9)]):
        got = {r["_s"]: r["target"] for r in mix.targets(spark.createDataFrame(sizes, "_s string, _n long")).collect()}
        want = plain_targets(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_mix_comes_near_its_targets(spark, monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, rng.choice([0, 3, 20, 20, 300])) for _ in range(600)] + ODD
    d = docs(spark, texts).union(docs(spark, texts[:5]))
    none = spark.createDataFrame([(None, "a b", "en", "a", None, "x"), (None, None, None, None, None, None)], DOCS)
    assert mix.plan(d.union(none)).where("doc_id IS NULL").count() == 2
    whole = {(r["doc_id"], r["size"]): r for r in mix.plan(d).collect()}
    assert mix.mixed(d.withColumn("_copies", F.lit(1))).columns == [*d.columns, "_copies"]
    taken, target = Counter(), {}
    source = {i: [None, "a", "b", "c"][i % 4] for i in range(len(texts))}
    for r in mix.plan(d).collect():
        assert 0 <= r["copies"] <= 3 and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        taken[source[r["doc_id"]]] += r["size"] * r["copies"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 3 * 3000 and abs(taken[s] - t) <= 0.1 * t + 3001 for s, t in target.items())
    assert mix.mixed(d).count() == mix.plan(d).agg(F.sum("copies")).first()[0] and mix.mixed(d).columns == d.columns
    monkeypatch.setattr(mix, "BUCKET", 20)  # crowded sizes are salted; the same places come out
    salted = {(r["doc_id"], r["size"]): r for r in mix.plan(d).collect()}
    assert salted == whole
    assert mix.plan(docs(spark, [])).count() == 0


# ---- classifiers ----

def toxic_rows(rng, n):
    bad = ["vexor", "gruml", "zotid"]
    out = []
    for _ in range(n):
        w, y = [rng.choice(WORDS) for _ in range(60)], int(rng.random() < 0.2)
        if y:
            for i in rng.sample(range(60), 4):
                w[i] = rng.choice(bad) + rng.choice(["", "a", "ik", "ou"])
        out.append((" ".join(w), y))
    return out


def test_toxicity_finds_new_forms_of_learned_words():
    rng = random.Random(6)
    m = toxicity.fit(toxic_rows(rng, 1200))
    test = toxic_rows(rng, 300)
    s = m.score(toxicity.Words(m.lexicon), [t for t, _ in test])
    assert np.mean((s >= 0.5) == np.array([y for _, y in test])) > 0.97
    assert 0 <= m.score(toxicity.Words(m.lexicon), [None, "", "x" * 9000]).min() and toxicity.plain("1D10T!!") == "idiot"
    assert len(toxicity.fit([]).score(toxicity.Words({}), ["a"])) == 1


def plain_toxicity_features(words, text):
    """The features, word by word."""
    text = text or ""
    tokens = text.split()
    flags = [words._flags(w) for w in tokens]
    at = lambda bit: [i for i, f in enumerate(flags) if f & bit]
    strong, weak, you = at(toxicity.STRONG), at(toxicity.WEAK), at(toxicity.YOU)
    gaps = [min(abs(s - y) for y in you) for s in strong] if you else []
    n, size = max(1, len(tokens)), max(1, len(text))
    rate = lambda ok: sum(map(ok, text)) / size
    signs = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return [
        len(strong) / n, len(strong), len(weak) / n, len(weak), len(you) / n, sum(g <= toxicity.NEAR for g in gaps) / n, 1 / (1 + (min(gaps) if gaps else n)),
        len(at(toxicity.OBFUSCATED)) / n, len(at(toxicity.CAPITALS)) / n, len(at(toxicity.SINGLE)) / n,
        rate(lambda c: "A" <= c <= "Z"), rate(lambda c: c in "!?"), rate(lambda c: c in signs), rate(lambda c: "0" <= c <= "9"), math.log1p(len(tokens)),
    ]


def test_toxicity_table_is_the_plain_forms_scores(spark):
    rng = random.Random(16)
    m = toxicity.fit(toxic_rows(rng, 800))
    words_ = toxicity.Words(m.lexicon)
    texts = [t for t, _ in toxic_rows(rng, 60)] + ODD + ["YOU are a vexor!! gruml1k vexxxor a b c", "vexor " * 400 + "you"]
    d = docs(spark, texts).withColumn("score", F.lit("clash"))
    plain = [plain_toxicity_features(words_, t) for t in texts]
    for t, p in zip(texts, plain):
        assert np.allclose(words_.features(t), p)
    want = np.clip(m.isotonic(m.trees(np.array(plain))), 0, 1)
    got = {r["doc_id"]: r["s"] for r in toxicity.score(d, m, keep=["doc_id", "score"], out="s").collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want) and toxicity.score(d.where("false"), m, out="s").count() == 0
    none = labelled.sample(d, spark.createDataFrame([], "doc_id long, toxic int"), "toxic", 5, 0)
    assert none == [] and toxicity.score(d, toxicity.fit(none), out="s").count() == len(texts)


def test_isotonic_and_trees():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    f = boosting.fit_isotonic(x, np.array([0, 0, 1, 0, 1, 1.0]))
    assert (np.diff(f(np.linspace(-1, 6, 50))) >= 0).all()
    rng = np.random.default_rng(0)
    z = rng.normal(size=(2000, 3))
    y = ((z[:, 0] > 0) ^ (z[:, 1] > 0)).astype(float)
    assert np.mean((boosting.fit_trees(z, y)(z) > 0) == y) > 0.95


def test_factorisation_machine_and_its_identity():
    rng = random.Random(8)
    rows = [(words(rng, 80), 1) if i % 4 else ((rng.choice(WORDS) + " ") * 80, 0) for i in range(600)]
    m = quality.fit(rows[:450])
    assert np.mean((m.score([t for t, _ in rows[450:]]) >= 0.7) == np.array([y for _, y in rows[450:]])) > 0.97
    # the linear-time form is the sum over pairs
    ids, stats = quality.inputs(rows[1][0])
    z = m.dense([stats])
    x = np.concatenate([np.full(len(ids), 1 / np.sqrt(len(ids))), z[0]])
    k = np.concatenate([ids, quality.BUCKETS + np.arange(z.shape[1])])
    pairs = sum(x[i] * x[j] * m.vector[k[i]] @ m.vector[k[j]] for i in range(len(k)) for j in range(i))
    assert math.isclose(m.odds([ids], z)[0], m.bias + m.weight[k] @ x + pairs, rel_tol=1e-6)
    assert len(m.score([None, "", "x" * 50_000])) == 3


def test_samples_leave_held_out_rows_alone(spark):
    rng = random.Random(1)
    d = docs(spark, [words(rng, 5) for _ in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (3, 0), (None, 1), (5000, 1)], "doc_id long, quality int")
    held = {r[0] for r in d.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).select("text").collect()}
    got = labelled.sample(d, labels, "quality", 4, 2, sample=60)
    few = labelled.sample(d, labels, "quality", 4, 2, characters=200)
    assert few and sum(len(t) for t, _ in few) <= 200 and labelled.sample(d.where("false"), labels, "quality", 4, 2) == []
    long = docs(spark, ["x " * 30_000] * 8)
    assert len(labelled.sample(long.union(long), labels, "quality", 4, 2)) >= 4
    assert got and len(got) <= 60 and not held & {t for t, _ in got} and got == labelled.sample(d.repartition(7), labels, "quality", 4, 2, sample=60)
    assert quality.score(d, quality.fit([]), keep=d.columns, out="q", least=0.0).columns == [*d.columns, "q"]


def test_language(spark):
    rng = random.Random(9)
    part = {"en": "the and ing ou th".split(), "fr": "le eau oi que ez".split()}
    text = lambda x: " ".join("".join(rng.choice(part[x]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(x), x, "s", None, None) for i in range(120) for x in [["en", "fr"][i % 2]]] + [(200, None, None, None, None, None), (201, "123 !?", "fr", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in langid.predict(d, langid.learn(d)).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x, *_ in rows[:120]) and got[200]["lang_pred"] == got[201]["lang_pred"] == "und"
    none = d.where("false")
    assert langid.predict(d, langid.learn(none)).where("lang_pred = 'und'").count() == len(rows) and langid.predict(none, langid.learn(d)).count() == 0


def test_filters_know_all_that_they_learned():
    f = langid.fit({"a": ["abc abd"] * 3, "b": ["xyz"] * 3})
    assert f.masks(["ab", "xy", "qq"])[:2] == [1, 2] and f.masks(["qq"])[0] in (0, 1, 2, 3)


def test_languages_beyond_one_mask_and_texts_without_letters(spark):
    rng = random.Random(4)
    names = [f"l{k:02}" for k in range(70)]
    part = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for x in names}
    text = lambda x: " ".join(rng.choice(part[x]) + rng.choice(part[x]) for _ in range(25))
    rows = [(70 * i + k, text(x), x, None, None, None) for i in range(8) for k, x in enumerate(names)]
    rows += [(9000, "½ ² Ⅷ", "l00", None, None, None), (9001, "क्षमा", None, None, None, None), (9002, "x " * 60_000, "long", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    f = langid.learn(d)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(d, f).collect()}
    assert len(f.languages) >= 70 and f.slots.shape[1] == 2 and got[9000] == ("und", 0) and got[9001][0] != "und"
    assert np.mean([got[i][0] == x for i, _, x, *_ in rows[:560]]) > 0.98


def test_last_slots_are_those_of_a_whole_ranking(spark):
    rng = random.Random(21)
    slot = lambda: rng.randrange(-(2**63), 2**63)
    rows = [("many", slot()) for _ in range(3_000)] + [("few", slot()) for _ in range(4)] + [("same", 2**62)] * 900 + [("two", s) for s in (2**63 - 1, -(2**63)) for _ in range(100)] + [("edge", 2**63 - 1)]
    slots = spark.createDataFrame(rows, "lang string, slot long")
    sizes = slots.groupBy("lang").agg(F.count("*").alias("size")).union(spark.createDataFrame([("untold", 500)], "lang string, size long"))
    for sample in (1, 10, 700):
        of = {x: sorted(s for y, s in rows if y == x) for x, _ in rows}
        assert dict(langid._last_slots(slots, sizes, sample).collect()) == {x: s[: sample][-1] for x, s in of.items()}


def test_bloom_shares_are_those_of_exact_sets(spark):
    rng = random.Random(14)
    part = {"en": "the and ing ou th".split(), "fr": "le eau oi que ez".split(), "es": "ción ado os la es".split()}
    text = lambda x, n: " ".join("".join(rng.choice(part[x]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(x, rng.choice([3, 30])), x, None, None, None) for i in range(240) for x in [sorted(part)[i % 3]]]
    d = spark.createDataFrame(rows, DOCS)
    held = {r[0] for r in d.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).select("doc_id").collect()}
    exact = {}
    for x in part:
        texts = [t for i, t, lang, *_ in rows if lang == x and i not in held]
        counts = Counter(g for t in texts for g in langid.text_grams(t))
        exact[x] = {g for g, n in counts.items() if n >= max(2, 0.02 * len(texts))}
    one = langid.Scorer(langid.learn(d))
    for _, t, *_ in rows + [(0, "zzq the eauoi", None)]:
        grams = [g for w in re.findall(r"[^\W\d_]+", t.lower()) for g in langid._grams(w)]
        plain = np.array([sum(g in exact[x] for g in grams) / len(grams) for x in one.f.languages])
        assert np.abs(one.shares(t) - plain).max() < 0.02 and one(t)[0] == one.f.languages[int(np.argmax(one.shares(t)))]


# ---- fingerprints ----

def test_fingerprints_collide_as_often_as_weights_agree():
    rng = random.Random(3)
    err = []
    for _ in range(40):
        a = words(rng, 150).split()
        a += a[:40]
        b = list(a)
        for i in rng.sample(range(len(b)), rng.choice([2, 6, 12])):
            b[i] = rng.choice(WORDS)
        x, y = (dict(zip(*map(list, fingerprint.terms(" ".join(t))))) for t in (a, b))
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        f = fingerprint.fingerprints([" ".join(a), " ".join(b)], 256)
        err.append(fingerprint.likeness(f[0], f[1]) - true)
    assert abs(np.mean(err)) < 0.015 and np.std(err) < 0.05


def test_edited_texts_take_from_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE", 7)
    rng = random.Random(2)
    texts = [words(rng, rng.choice([0, 1, 10, 40])) + "é" for _ in range(50)] + ODD
    d = docs(spark, texts).repartition(5)
    got = {r["doc_id"]: r for r in fingerprint.with_next(d).collect()}
    clean = [t or "" for t in texts]
    for i, t in enumerate(clean):
        after = clean[(i + 1) % len(clean)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        assert got[i]["near_edited"] == fingerprint.likeness(*fingerprint.fingerprints([t, edited])) and (got[i]["near_edited"] == 1) >= (t == edited)
    odd = spark.createDataFrame([(None, "b a"), (None, None), (3, "c"), (3, "c"), (5, "d d d d")], "doc_id long, text string")
    got = fingerprint.with_next(odd).collect()  # null ids stand first, repeated ones next to each other
    assert len(got) == 5 and sorted(str(r["doc_id"]) for r in got) == ["3", "3", "5", "None", "None"] and [r["near_next"] for r in got if r["doc_id"] == 3].count(1.0) >= 1
    assert fingerprint.with_next(docs(spark, [])).count() == 0 and fingerprint.with_next(docs(spark, ["only one here"])).first()["near_next"] == 1


# ---- archives and pages ----

PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\n", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (3, "u", None, "c"), (9, "u", "", "c"), (4, "u", "é" * 5000, "c"), (5, "u", "WARC/1.1\r\n\r\n", None), (5, "u", "WARC/1.1\r\n\r\n", None), (None, "u", "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, PAGES)
    index = warc.write(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read(index, f"file://{tmp_path}/w").collect()}
    assert index.count() == len(rows) and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[3]["refers_to"] == 9 and got[None]["record_type"] == "response"
    assert bytes(got[4]["payload"]).decode() == "é" * 5000 and got[4]["payload_bytes"] == 10_000 and got[3]["payload_bytes"] == 0
    assert got[9]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and bytes(got[5]["payload"]) == b"WARC/1.1\r\n\r\n"
    assert warc.read(index.where("page_id = 4"), f"file://{tmp_path}/w").count() == 1
    assert warc.write(pages.where("false"), f"file://{tmp_path}/e").count() == 0


def test_ranges_join_where_they_are_near():
    assert [(a, b, k) for a, b, k in warc._ranges([(0, 10), (10, 5), (100_000, 10), (100_020, 5)])] == [(0, 15, [0, 1]), (100_000, 100_025, [2, 3])]


def test_page_text():
    page = "<head><title>t</title></head><body><header><h1>Site</h1></header><div class='main-menu'>m</div><main><header><h1>T &amp; U</h1></header><div>a<div>b <i>c</i>d</div>e</div><ul><li>x<li>y&nbsp; z</ul><div id='comments'><p>bad</p></div><span class=ad>no</span> tail<script>var t='</p>'</script></main><form>f</form><p>after"
    assert pagetext.parse(page)[0] == ["T & U", "a", "b cd", "e", "x", "y z", "tail"]
    assert pagetext.parse(None)[0] == [] and pagetext.parse("plain < text")[0] == ["plain < text"] and pagetext.parse("<p>a<p>b<!-- c")[0] == ["a", "b"]
    assert pagetext.parse("<article><p>1</article><aside>x</aside><article><p>2</article>")[0] == ["1", "2"]


def test_templates_go_and_articles_stay(spark):
    rows = [(i, "http://h.example/x", f"<body><div class=x1><p>Our site: all rights</p></div><div><p>own text {i}</p></div></body>", None) for i in range(20)]
    rows += [(100 + i, "http://c.example/", "<body><article><p>the same copy</p></article></body>", None) for i in range(20)] + [(900, None, None, None), (901, "nohost", "<p>a</p>", None)]
    got = {r["page_id"]: r for r in pagetext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i]["text"] == f"own text {i}" for i in range(20)) and all(got[100 + i]["text"] == "the same copy" for i in range(20))
    assert got[900]["text"] == "" and got[900]["n_chars"] == 0 and got[901]["text"] == "a"


def test_odd_tables_of_pages(spark):
    long = "<body><article>" + "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(60_000)) + "</article></body>"
    clash = "page_id long, url string, html string, host string, hashes int, text string"
    pages = spark.createDataFrame([(1, "http://h/", long, "x", 1, "t"), (1, "http://h/", "<p>again</p>", None, None, None), (None, None, None, None, None, None)], clash)
    got = sorted((r["page_id"] or 0, r["n_chars"], r["url"]) for r in pagetext.extract(pages).collect())
    assert got == [(0, 0, None), (1, 5, "http://h/"), (1, sum(len(f"paragraph {i} of a very long page") + 1 for i in range(60_000)) - 1, "http://h/")]
    assert pagetext.extract(pages.where("false")).count() == 0


def test_recurring_parts_go_without_telling_names(spark):
    """Menus and footers in plain divs, which no tag, role or class tells; the plain form counts blocks of a host by page."""
    page = lambda i: f"<body><div><p>Start</p><p>Offers</p></div><div><div><p>story {i} begins</p><p>story {i} ends</p></div></div><div><p>Imprint</p></div></body>"
    rows = [(i, f"http://s{i % 2}.example/{i}", page(i), None) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in pagetext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    blocks = {i: pagetext.parse(h)[0] for i, _, h, _ in rows}
    for i in range(40):
        same = [blocks[j] for j in range(40) if j % 2 == i % 2]
        assert got[i] == "\n".join(b for b in blocks[i] if sum(b in x for x in same) < 10) == f"story {i} begins\nstory {i} ends"


# ---- nearest neighbours ----

def test_search_finds_what_brute_force_finds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:500] = x[7] + rng.normal(scale=0.01, size=(300, 24))  # a dense cluster
    x[600:700] = x[9]  # equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [None] * 24, 0), (2080, [1.0], 0)]
    monkeypatch.setattr(ann, "LEAST_ROWS", 400)
    monkeypatch.setattr(ann, "LEAST_QUERIES", 30)
    monkeypatch.setattr(ann, "RERANK", 60)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(v, F.col("vec_id") % 20 == 0, 10, sample=500).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    d, found = x.astype(float), []
    assert set(got) == set(range(0, 1500, 20))
    for q, near in got.items():
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:10]
        found.append(len({i for i, _ in near.values()} & set(best)) / 10)
        assert all(abs(s[i] - sc) < 1e-12 for i, sc in near.values()) and sorted(near) == list(range(1, 11)) and q not in {i for i, _ in near.values()}
    assert np.mean(found) >= 0.9
    assert ann.search(v.where("vec_id >= 2000 and vec_id < 2080"), F.lit(True)).count() == 0
    assert ann.search(v.where("vec_id < 3"), F.lit(True)).count() == 6


@pytest.mark.parametrize("magnitude", [1.0, 1e120])
def test_search_keeps_double_precision_and_lengths_apart(spark, magnitude):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)) * magnitude
    y = rng.normal(size=(40, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(v, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20)) | {1000, 1020}
    for z, first in ((x, 0), (y, 1000)):
        for q in range(0, len(z), 20):
            s = (z * z[q]).sum(axis=1)
            s[q] = -np.inf
            best = np.lexsort((np.arange(len(s)), -s))[:20]
            assert [(k, i - first, sc) for k, i, sc in sorted(got[first + q])] == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert ann.search(v.where("vec_id < 250"), F.col("vec_id") == 0, 249).count() == 249


def test_blocks_grow_with_the_table():
    assert [ann.blocks(n, 4096) for n in (0, 1, 4096, 4097, 1_000_000, 10**9)] == [1, 1, 1, 2, 64, -(-(10**9) // 65_536)]


def test_anisotropic_codes_lower_the_weighted_loss():
    x = np.random.default_rng(0).normal(size=(800, 64)).astype(np.float32)
    book = ann.fit(x)
    x = (x * book.scale).astype(np.float32)

    def loss(codes):
        r = book.split(x) - book.words[np.arange(book.words.shape[0]), codes]
        along = (r * book.split(x)).sum(axis=(1, 2)) ** 2 / (x**2).sum(axis=1)
        return float(((r**2).sum(axis=(1, 2)) + (book.weight - 1) * along).sum())

    assert book.weight > 2 and loss(book.codes(x, 2)) < loss(book.codes(x, 0))


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://w.example/", "<body><div class=page><article><p>the same copy</p></article></div></body>", None) for i in range(20)]
    rows += [(100 + i, "http://p.example/", "<body><div><p>the same plain copy</p></div></body>", None) for i in range(20)]
    # a wrapper with many different texts elsewhere on the page
    rows += [(200 + i, "http://v.example/", f"<body><div class=page><article><p>the same copy</p></article></div><article><p>text {i}</p></article></body>", None) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in pagetext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == "the same copy" and got[100 + i] == "the same plain copy" and got[200 + i] == f"the same copy\ntext {i}" for i in range(20))


def test_templates_inside_articles_go(spark):
    box = "<div><h3>Join us</h3><p>every week</p></div>"
    page = lambda i, x: f"<body><article><h2>Summary</h2><p>own text of page {i}, which is long enough</p>{x}<ul><li>yes</li><li>{i}</li></ul></article></body>"
    rows = [(i, "http://b.example/", page(i, box), None) for i in range(20)] + [(100 + i, "http://c.example/", page(0, box), None) for i in range(20)]
    # edited copies: most of their text recurs
    rows += [(200 + i, "http://e.example/", f"<body><article><p>the first long paragraph</p><p>the second long paragraph</p><p>edit {i}</p></article></body>", None) for i in range(20)]
    got = {r["page_id"]: r["text"].split("\n") for r in pagetext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(20):
        assert got[i] == ["Summary", f"own text of page {i}, which is long enough", "yes", str(i)]
        assert got[100 + i] == ["Summary", "own text of page 0, which is long enough", "Join us", "every week", "yes", "0"]
        assert got[200 + i] == ["the first long paragraph", "the second long paragraph", f"edit {i}"]
