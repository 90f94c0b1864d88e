"""Results against brute-force versions on small tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, line_dedup, lm_scoring, near_dedup, packing, pii, quality_gam, quality_rules, queries, spotsigs, suffix_dedup
from tessera.llm.common import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(tokenizer_path())
    out.no_truncation()
    out.no_padding()
    return out


def test_bpe_equals_the_library(spark, sf, texts, library):
    for r in queries.op4_bpe(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library_on_random_text(library):
    random.seed(5)
    letters = "aB1 '\n\té ÉßẞÑñ.,!?<|>́  ﬁİΣς日本🙂\x1c\x85\x00\x7f-_'s'T'll'RE"
    made = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "x<|y"]
    for kind in (bpe.PairIndexBPE, bpe.LibraryWords):
        for text, raw in zip(made, bpe.Words(kind, tokenizer_path()).texts(made), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert raw == struct.pack(f"<{len(ids)}I", *ids), text


def test_packing_is_gapless_and_tight(spark, sf, texts, library):
    got = queries.op1_best_fit_packing(spark, sf).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(e.ids) + 1 for e in library.encode_batch(list(texts.values()), add_special_tokens=False))
    assert sum(r["length"] for r in got) == total and len(bins) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("seed", range(30))
def test_packing_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
    bins = defaultdict(list)
    placed = Counter()
    for length, first, items, start, each, offset in packing.plan(dict(counts), capacity):
        for i in range(items):
            bins[start + i // each].append((offset + i % each * length, length))
            placed[length, first + i] += 1
    assert set(placed.values()) <= {1} and Counter(n for n, _ in placed) == counts
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2


def test_classifier_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality_gam(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert rows and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality_gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    x = np.random.default_rng(1).random((50, len(quality_gam.FEATURES)))
    assert (quality_gam.fit(docs, labels).scores(x) == quality_gam.fit(docs, flipped).scores(x)).all()


def test_line_dedup_equals_sql(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE).fetchall()}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in queries.op3_line_dedup(spark, sf).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_spotsigs(spark, sf, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in queries.op5_spotsigs(spark, sf).collect()}
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_spotsigs_pruning():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        true = len(set(a) & set(b)) / len(set(a) | set(b)) if len(a) + len(b) else 1.0
        pruned = spotsigs.pruned_jaccard(a, b, 0.5)
        assert pruned == true or pruned == 0.0 and true < 0.5
        if true >= 0.5 and len(a) and len(b):
            assert abs(spotsigs.length_partition(len(a)) - spotsigs.length_partition(len(b))) <= 1


@pytest.mark.parametrize("largest", [512, 4])
def test_spotsigs_classes(spark, texts, largest, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spotsigs, "LARGEST", largest)
    docs = dict(texts)
    for k, t in enumerate(near_copies(40, 120, 3)):
        docs[10**6 + k] = t.replace("w1", "the w1")
    ids = sorted(docs)
    sets = dict(zip(ids, spotsigs.signature_sets(pa.array([docs[i] for i in ids])), strict=True))
    parent = {i: i for i in ids if len(sets[i])}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) and len(sets[b]) and spotsigs.pruned_jaccard(sets[a], sets[b], 0.75) >= 0.75:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = spotsigs.near_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) if i in parent else i for i in docs}


def covered(docs):
    seen, out = set(), []
    for raw in docs:
        mask = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                mask[s : s + 100] = True
            seen.add(raw[s : s + 100])
        out.append(mask)
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(spark, sf, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in queries.op6_suffix_dedup(spark, sf).collect()}
    for i, mask in zip(ids, covered([texts[i].encode() for i in ids]), strict=True):
        raw = np.frombuffer(texts[i].encode(), np.uint8)
        spans = int((mask & ~np.append(False, mask[:-1])).sum()) if len(mask) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(raw), int(mask.sum()), spans, hashlib.sha256(raw[~mask].tobytes()).hexdigest())


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(150):
        x = np.array([rng.choice(b"ab\0c") for _ in range(rng.randint(1, 300))], np.uint8)
        if rng.random() < 0.3:
            x[:] = 97
        order = suffix_dedup.suffix_array(x).tolist()
        keys = [x.tobytes()[i : i + 104].ljust(104, b"\0") for i in order]
        assert sorted(order) == list(range(len(x))) and keys == sorted(keys)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(t):
    out = []
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and luhn(digits)) or k == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base(spark, sf, texts):
    odd = {10**6: "ip 1.2.3.4.5.6 and 300.1.1.1 a@b.com_x@d.e x@y +1 (523) 555-1055, 4111 1111 1111 1111 é 4111-1111-1111-1112 12@a.b@c.d 1.2.3 " + "7" * 30, 10**6 + 1: "1.2.3.4 " * 300, 10**6 + 2: "a@" + "b." * 5000 + "c"}
    docs = spark.createDataFrame([*texts.items(), *odd.items()], "doc_id long, text string")
    for r in pii.find_pii(docs).select("doc_id", pii.spelled(F.col("base_spans")).alias("b"), pii.spelled(F.col("spans")).alias("s")).collect():
        want = base_spans({**texts, **odd}[r["doc_id"]])
        assert r["b"] == want and set(filter(None, want.split(","))) <= set(r["s"].split(","))


def test_redaction_leaves_no_base_span(spark, sf):
    left = pii.redact(spark.read.parquet(f"{sf}/documents.parquet")).select("text").collect()
    assert all(base_spans(r["text"]) == "" for r in left)


def test_redaction_covers_the_union_of_overlapping_spans(spark):
    cases = {
        "+1 202 555 0143.john@x.com": "<phone>",
        "card 4111 1111 1111 1111@mail.com, end": "card <card>, end",
        "a@b.com +1 202 555 0143.john@x.com 1.2.3.4": "<email> <phone> <ip>",
        "nothing": "nothing",
        "": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, odds={}).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_em_tells_good_labelers_apart():
    after = pii.reliabilities({(0, (1, 1, 0)): 900, (0, (1, -1, 0)): 20, (0, (0, 1, 1)): 30, (0, (0, -1, -1)): 200, (0, (-1, -1, 0)): 300})
    assert after[0, (1, 1, 0)] > 0.9 and after[0, (-1, -1, 0)] < 0.1 and after[0, (0, -1, -1)] < 0.5


def rejects(t, w, lines):
    """The rules, written again in Python."""
    import unicodedata

    n, solid = len(t), sum(map(len, w))
    kinds = [unicodedata.category(c) for c in t]
    return (
        sum(c in "#*$%&|<>" for c in t) > 0.04 * n
        or t.count("!") > 0.04 * n
        or kinds.count("Lu") > 0.3 * n
        or sum(k[0] == "L" for k in kinds) < 0.6 * solid
        or not 2.5 * len(w) <= solid <= 12 * len(w)
        or len(set(lines)) < 0.5 * len(lines)
    )


def test_quality_rules(spark, sf, texts):
    for r in queries.op8_quality_rules(spark, sf).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        twice = Counter(windows)
        at = {i + d for i, x in enumerate(windows) if twice[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), failed)
        assert r["kept"] == (not failed and not rejects(t, w, lines))


def test_rule_order_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = [{r["doc_id"] for r in docs.filter(~quality_rules.rejected(list(rules))).collect()} for rules in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert both[0] == both[1]


def test_rules_on_counts_reject_the_same_texts(spark, sf):
    docs = quality_rules.base_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    counted = [r for r in quality_rules.RULES if r.counted]
    differ = [F.count_if(F.expr(r.reject) != F.expr(r.counted)).alias(r.name) for r in counted]
    assert len(counted) == 3 and set(docs.agg(*differ).first()) == {0}


def test_rule_order_is_by_rejections_of_what_is_left(spark, monkeypatch):
    rules = tuple(quality_rules.Rule(n, f"text LIKE '%{n}%'") for n in ("a", "b", "c"))
    docs = spark.createDataFrame([(t,) for t in ["ab"] * 5 + ["a"] * 4 + ["c"] * 3 + ["b"] * 2 + ["x"] * 6], "text string")
    monkeypatch.setattr(quality_rules, "_seconds", lambda sample, reject: 1.0 if "LIKE" in reject else 0.0)
    assert [(r.name, round(share, 3)) for r, _, share in quality_rules.order_rules(docs, rules)] == [("a", 0.45), ("c", 0.273), ("b", 0.25)]


def test_language_models(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mark = F.col("doc_id") % 2 == 0
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, mark).collect()}
    import pyarrow as pa

    tokens = {i: lm_scoring.token_grams(pa.array([t]))[:2] for i, t in texts.items()}
    v = len({w for x, _ in tokens.values() for w in x.tolist()})
    for i in list(texts)[:25]:
        for name, of in (("target_loss", [j for j in texts if j % 2 == 0 and j != i]), ("background_loss", [j for j in texts if j != i])):
            one, two = Counter(), Counter()
            for j in of:
                one.update(tokens[j][0].tolist())
                two.update(tokens[j][1].tolist()[1:])
            total, n, loss = sum(one.values()), len(tokens[i][0]), 0.0
            for k, (w, p) in enumerate(zip(*(x.tolist() for x in tokens[i]), strict=True)):
                alone = (one[w] + 1) / (total + v)
                u = tokens[i][0][k - 1]
                loss -= np.log(alone if k == 0 else (min(two[p], one[u]) + lm_scoring.PRIOR * alone) / (one[u] + lm_scoring.PRIOR))
            assert n == got[i]["n_tokens"] and (n == 0 or abs(loss / n - got[i][name]) < 1e-4)


def test_language_models_count_exact_ngrams(spark, monkeypatch):
    """More words and pairs than any fixed table of classes holds apart, against counts of the spelled-out grams."""
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1 << 17)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1 << 15)
    rng = np.random.default_rng(9)
    words = {i: [f"w{x}" for x in rng.zipf(1.3, 3000) % 200_000] + [f"only{i}x{k}" for k in range(3000)] for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string").repartition(5)
    mark = F.col("doc_id") % 2 == 0
    v = len({x for w in words.values() for x in w})
    pairs = {x for w in words.values() for x in zip(w, w[1:], strict=False)}
    assert v > 1 << 16 and lm_scoring.count(docs, mark).words == v and lm_scoring.gram_counts(docs, mark).count() == v + len(pairs)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, mark).collect()}
    for i in (0, 1, 20, 39):
        for name, of in (("target_loss", [j for j in words if j % 2 == 0 and j != i]), ("background_loss", [j for j in words if j != i])):
            one = Counter(x for j in of for x in words[j])
            two = Counter(x for j in of for x in zip(words[j], words[j][1:], strict=False))
            total, loss = sum(one.values()), 0.0
            for k, w in enumerate(words[i]):
                alone = (one[w] + 1) / (total + v)
                u = words[i][k - 1]
                loss -= np.log(alone if k == 0 else (two[u, w] + lm_scoring.PRIOR * alone) / (one[u] + lm_scoring.PRIOR))
            assert abs(loss / len(words[i]) - got[i][name]) < 1e-9


def exact_components(texts):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(upper))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 4 * small >= 3 * large and 100 * (n := len(sets[a] & sets[b])) >= 75 * (small + large - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


def near_copies(n, words, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, words // 20)):
            t[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup(spark, texts, small, monkeypatch):
    if small:  # every way through the tree: branching, dense nodes, blocks of clusters, members outside the main component
        for name, value in (("LEAF", 6), ("CLUSTER", 5), ("HUBS", 1), ("LEVELS", 3)):
            monkeypatch.setattr(near_dedup, name, value)
    docs = dict(texts)
    for k, t in enumerate(near_copies(60, 120, 3) + near_copies(20, 40, 4) + ["same words here now"] * 3):
        docs[10**6 + k] = t
    sets, want = exact_components(docs)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


@pytest.mark.parametrize("n", range(7))
def test_short_texts_alone(n):
    import pyarrow as pa

    sets, at = near_dedup.shingle_sets(pa.array([" ".join("abcdefg"[:n])]))
    assert at.tolist() == [0, max(1, n - 4) if n else 0] and len(sets) == at[-1]


def test_two_words_alone_in_a_partition(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "Hello  World"), (3, "a b c")], "doc_id long, text string").repartition(3, "doc_id")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_words_on_which_polynomial_hashes_collide():
    import pyarrow as pa

    a, b = "a", "b"
    for _ in range(10):  # the Thue-Morse word and its complement
        a, b = a + b, b + a
    for table in (near_dedup.LOWER, spotsigs.WORDS):
        assert len(np.unique(near_dedup.hashed_words(pa.array([f"{a} {b}"]), table)[0])) == 2
    assert len(np.unique(near_dedup.shingle_sets(pa.array([f"x y {a} z u", f"x y {b} z u"]))[0])) == 2


def test_near_dedup_recall(spark):
    """Four thousand planted pairs, most of them just above the threshold."""
    rng = random.Random(8)
    rows, pairs = [], []
    while len(pairs) < 4000:
        k = 2 * len(pairs)
        words = [f"v{rng.randrange(10**9)}" for _ in range(100)]
        other = list(words)
        for at in rng.sample(range(5, 95), rng.randint(1, 4)):
            other[at] = f"n{rng.randrange(10**9)}"
        one, two = ({tuple(w[i : i + 5]) for i in range(96)} for w in (words, other))
        if 100 * len(one & two) >= 75 * len(one | two):
            pairs.append((k, k + 1))
            rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert sum(got[b] == a for a, b in pairs) / len(pairs) > 0.995


def test_contents_on_which_polynomial_hashes_collide():
    a, b = b"a", b"b"
    for _ in range(11):  # equal modulo 2^64 for every base
        a, b = a + b, b + a
    x, y = (np.frombuffer(raw, np.uint8) for raw in (a, b))
    table, up = suffix_dedup._constants()["table"], suffix_dedup._powers(len(x))[0][:-1]
    assert (table[x] * up).sum(dtype=np.uint64) == (table[y] * up).sum(dtype=np.uint64)
    whole = np.array([0]), np.array([len(x)])
    assert near_dedup.range_hashes(x.astype(np.uint64), *whole)[0] != near_dedup.range_hashes(y.astype(np.uint64), *whole)[0]


def test_range_hashes_do_not_depend_on_the_place():
    value = np.random.default_rng(3).integers(1, 256, 5000).astype(np.uint64)
    twice = np.concatenate([value, value[::-1], value])
    starts, stops = np.array([0, 10, 10_000, 10_010]), np.array([40, 900, 10_040, 10_900])
    h = near_dedup.range_hashes(twice, starts, stops).tolist()
    assert h[:2] == h[2:] and h[0] != h[1] and h[0] == near_dedup.range_hashes(value[:40], np.array([0]), np.array([40]))[0]


def test_suffix_dedup_with_several_texts_of_an_id(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1)), (5, text(2)), (5, text(3)), (6, text(2)), (7, text(3)), (None, text(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["kept"].decode()) for r in suffix_dedup.suffix_dedup(docs).collect()))
    first = [(6, text(2)), (7, "")], [(6, ""), (7, text(3))]
    assert got[:3] == [(0, text(1)), (1, text(1)), (2, "")] and {x[1] for x in got[3:5]} == {text(2), text(3)} and got[5:] in first


def test_near_dedup_with_several_texts_of_an_id(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    long = " ".join(f"token{i} of a text beyond one chunk" for i in range(60_000))
    rows = [(7, text(1)), (7, text(2)), (8, text(1) + " z"), (9, text(2) + " z"), (None, text(3)), (3, text(3) + " y"), (None, text(4)), (None, text(4)), (7, text(1)), (20, long), (21, long + " end"), (22, long + " x" * 3), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    want = [(7, 7, True)] * 3 + [(8, 7, False), (9, 7, False), (None, 3, False), (3, 3, True)] + [(None, None, True)] * 2 + [(20, 20, True), (21, 20, False), (22, 20, False), (5, 5, True), (5, 5, True)]
    assert got == sorted(want, key=str)


def test_near_dedup_of_named_documents(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([("b", text), ("a", text + " z"), ("c", "other")], "doc_id string, text string")
    assert {tuple(r) for r in near_dedup.near_duplicates(docs).collect()} == {("b", 36, "a", False), ("a", 37, "a", True), ("c", 1, "c", True)}


def test_near_classes_of_odd_rows(spark):
    text = lambda k: " ".join(f"the word{k}x{i} of a thing{k}x{i}" for i in range(60))
    rows = [(7, text(1)), (7, text(2)), (8, text(1) + " the end"), (9, text(2) + " the end"), (None, text(3)), (3, text(3) + " the end"), (None, text(4)), (5, None), (6, ""), (None, "")]
    docs = spark.createDataFrame([(*r, "r", 1, 2) for r in rows], "doc_id long, text string, raw string, n int, low int").repartition(4)
    got = sorted(((r["doc_id"], r["component_id"]) for r in spotsigs.near_classes(docs).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (8, 7), (9, 7), (None, 3), (3, 3), (None, None), (5, 5), (6, 6), (None, None)], key=str)
    assert spotsigs.near_classes(docs.filter("n > 5")).count() == 0


def test_near_classes_of_long_copies_meet_once(spark):
    """Near copies of a long text share thousands of rare signatures; the sets travel for a few of them only."""
    base = [f"the word{i} of a thing{i}" for i in range(3000)]
    docs = [(i, " ".join(base[: 3000 - 20 * i])) for i in range(6)] + [(10 + i, " ".join(f"the other{i}x{k} of a matter{i}x{k}" for k in range(50))) for i in range(3)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in spotsigs.near_classes(table).collect()} == dict.fromkeys(range(6), 0) | {10 + i: 10 + i for i in range(3)}
    sets = spotsigs.signature_sets(pa.array([t for _, t in docs]))
    classes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "id long, raw binary")
    met = spotsigs.meetings(classes, 0.75).collect()
    assert len({(r["part"], r["sig"]) for r in met}) < 30 and {r["id"] for r in met} == set(range(6))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_next_documents_in_blocks_of_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(block)
    docs = [(rng.randrange(10**6) if i % 2 else i, f"the text {i} of some words " * 3) for i in range(200)]
    docs = list({i: (i, t) for i, t in docs}.values())
    got = spotsigs.edited_likeness(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    order = sorted(docs)
    follows = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    for r in got:
        t = dict(docs)[r["doc_id"]]
        edited = t[: len(t) - len(t) // 2] + follows[r["doc_id"]][: len(t) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len(got) == len(docs)


def test_packing_pieces_starts_and_checksums(spark, sf, texts, library):
    """Every column of a piece from the library's ids."""
    got = defaultdict(dict)
    for r in queries.op1_best_fit_packing(spark, sf).collect():
        got[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert got[i] == {k: (2048 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cut)}
