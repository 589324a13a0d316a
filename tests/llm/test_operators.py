"""Every operator on a small table with all the awkward rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, license_scan, line_dedup, mixing, pii, ppm, quality_cnn, quality_rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, at string, fp long, id string, size long, held_out string, h string, `__x` int"
LOREM = "the quick brown fox jumps over the lazy dog and then it rests for a while under an old tree near the river bank"
PASSAGE = "\n".join(f"line {i} of a passage that many texts share with seven more words here" for i in range(6))


def texts():
    base = [
        (0, LOREM, "en", "b"), (1, LOREM.replace("lazy", "sleepy"), "en", "b"), (2, LOREM, "en", None), (2, LOREM, "en", None), (3, None, None, "a"), (4, "", "en", "a"),
        (None, "only a few words", None, "b"), (5, "x", "de", ""), (6, " \n\t ", "fr", "a"), (7, "123 $$$ !!!", "en", "b"), (8, "intro\n" + PASSAGE + "\nend", "en", "a"),
        (9, PASSAGE + "\nother end", "en", "b"), (10, "start\n" + PASSAGE, None, "a"), (11, ("der die das und nicht ein Haus am See " * 9).strip(), "de", "c"),
        (12, "Mail a.b@c.org or call +44 20 7946 0958, card 4111 1111 1111 1111, host 10.0.0.1 é😀", "en", "c"), (13, "word " * 3000, "en", "c"),
        (14, "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License", "en", "c"), (15, "le chat et la souris dans une maison que les gens " * 6, "fr", "c"),
        (16, PASSAGE.split("\n")[0], "en", "a"), (17, "a\n" * 40 + "b", "en", "a"),
    ]
    return base + [(100 + i, f"{LOREM} number {i} {'alpha beta gamma' if i % 2 else 'delta epsilon'}", "en" if i % 3 else "de", "abc"[i % 3]) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 1, "y", 2, "z", "w", 3) for r in texts()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def brute_fingerprint(t):
    w = words(lower(t))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(codes):
    """code to the smallest code reachable by links of 2 bits or fewer."""
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = sorted(codes)
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts())
    codes = {}
    for i, t, *_ in texts():
        codes.setdefault(brute_fingerprint(t), []).append(i)
    root = brute_components(codes)
    least = defaultdict(list)
    for c, ids in codes.items():
        least[root[c]] += [i for i in ids if i is not None]
    want = sorted((repr(i), brute_fingerprint(t), min(least[root[brute_fingerprint(t)]], default=None)) for i, t, *_ in texts())
    assert sorted((repr(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted({repr(w[2]) for w in want})


@pytest.mark.parametrize("bucket", [64, 3, 1])
def test_links_against_all_pairs(spark, bucket):
    """Clusters around centres, so that buckets overflow and the extended keys are used."""
    rng = np.random.default_rng(5)
    codes = set()
    for c in rng.integers(0, 1 << 63, 6):
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            codes.add(x)
        codes |= {int(c) ^ (1 << b) for b in range(40)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), bucket)
    found = links.collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in found)
    comps = {r.node: r.root for r in simhash.components(links).collect()}
    root = brute_components(codes)
    groups = defaultdict(set)
    for c in codes:
        groups[root[c]].add(c)
    ours = defaultdict(set)
    for c in signed:
        ours[comps.get(c, c)].add(c % (1 << 64))
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def test_mixing(spark, docs, none):
    got = mixing.mix(docs)
    assert set(docs.columns) <= set(got.columns) and mixing.mix(none).count() == 0
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == len(texts())
    size = defaultdict(int)
    for _, t, _, s in texts():
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(order), 1.5 * sum(size.values())
    while True:  # shares again until none is above its limit
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)  # alike rows round down
    again = mixing.mix(docs.repartition(7))
    assert sorted((repr(r["doc_id"]), r["taken"]) for r in rows) == sorted((repr(r.doc_id), r.taken) for r in again.collect())


def test_targets_sum(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 50), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and sum(got.values()) == pytest.approx(1.5 * 1060)
    zero = spark.createDataFrame([("a", 0)], "source string, source_size long")
    assert mixing.targets(zero).first().target == 0


def brute_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        twice = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and twice % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii(spark, docs, none):
    hard = [
        "a.b@c.d_e@f.g x@y", "1.2.3.4.5.6.7.8 1.1.1.999 001.002.3.4", "+1 (234) 567-8901", "é😀 a@b.co 4111-1111-1111-1111", "1 " * 20000 + "x", "7" * 30000, "a" * 30000 + "@",
        "a@" + "b." * 9000 + "c", "x@b.c " * 600, "1.1.1.1." * 2000, "+1" + "2 " * 9000, "4111 1111 1111 1112", "12-34-56 7 8", "@@a@b.c@d.e"]
    rows = [(i, t) for i, t in enumerate(hard)] + [(100 + i, r[1]) for i, r in enumerate(texts())]
    got = spark.createDataFrame(rows, "i int, t string").select("i", "t", pii.listed(pii.spans(F.col("t"), pii.BASE)).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: brute_spans(t) if i != 6 else "" for i, t in rows}
    assert docs.select(pii.spans(F.col("text"))).count() == len(texts()) and none.select(pii.spans(F.col("text"))).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    t = spark.createDataFrame([("my iban GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33, ssn 123-45-6789; code 123-45-6789 " + "." * 60 + " 123-45-6789 x",)], "t string")
    found = pii.spans(F.col("t"))
    r = t.select(pii.listed(found).alias("s"), pii.redacted(F.col("t"), found).alias("r")).first()
    assert r.s.startswith("iban:8:35,ssn:") and r.s.count("iban") == 1 and r.s.count("ssn") == 1
    assert r.r.startswith("my iban [iban] and GB82") and "[ssn]" in r.r and r.r.endswith("123-45-6789 x")


def brute_scan(t):
    low = lower(t)
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(token, low)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for k in [p.split()] for i in range(len(w)) if w[i : i + len(k)] == k]
    found, blocks = {}, []
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        need, length = set(license_scan._words(text)), license_scan.block_length(text)
        for i in range(len(w)):
            held = set(w[i : i + length]) & need
            if w[i] in need and len(held) >= math.ceil(license_scan.THRESHOLD * len(need) - 1e-9):
                found[label] = max(found.get(label, 0), len(held) / len(need))
                blocks.append((k, label, i, len(held) / len(need)))
    return len(w), sorted(places), blocks, sorted(found.items())


def wrapped(text, width, mark=""):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_license_scan(spark, docs, none):
    notices = [wrapped(text, 8, mark) for _, text in license_scan.TEMPLATES for mark in ("", "# ")]
    cut = " ".join(license_scan.TEMPLATES[3][1].split()[:60])
    spread = " and so on and on ".join(license_scan.TEMPLATES[8][1].split())
    more = [
        "cc by cc by CC-BY", "x\n" + license_scan.TEMPLATES[2][1].upper() + " more", license_scan.TEMPLATES[12][1].replace("terms", "rules"), "all rights reserved " * 5000, cut, spread,
        "licensed under the " * 2000, "L\u0130CENSED under the M\u0130T License", "general public \u212aing general public license \u00c9", *notices]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = [(repr(r.doc_id), (r.n_words, [tuple(p) for p in r.places], [tuple(b) for b in r.blocks], [tuple(x) for x in r.found])) for r in license_scan.scan(every).collect()]
    want = [(repr(i), brute_scan(t)) for i, t in [(r[0], r[1]) for r in texts()] + [(1000 + i, t) for i, t in enumerate(more)]]
    assert sorted(got) == sorted(want)
    labels = {i: {x[0] for x in found} for i, (*_, found) in got}
    for k, notice in enumerate(notices):
        assert license_scan.TEMPLATES[k // 2][0] in labels[repr(1000 + len(more) - len(notices) + k)]
    assert not labels["1005"]  # the words of a notice, far apart
    assert license_scan.scan(none).count() == 0


def brute_contained(t, item):
    w, x = words(lower(t)), words(lower(item))
    if not x:
        return None
    k = min(5, len(x))
    need = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return (len(own & need), len(need)) if len(own & need) >= 0.8 * len(need) - 1e-9 else None


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_decontamination(spark, docs, none, block):
    items = [(0, " ".join(LOREM.split()[2:14])), (1, "only a few"), (2, ""), (3, None), (4, "X"), (5, LOREM.upper()), (5, LOREM), (6, LOREM + " and five other words at end"), (7, PASSAGE.split("\n")[3])]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    got = sorted((repr(r.doc_id), r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contained(docs, bench, block_shingles=block).collect())
    want = sorted((repr(i), k, *hit) for i, t, *_ in texts() for k, x in items if (hit := brute_contained(t, x)))
    assert got == want and len(want) > 20
    clean = decontaminate.clean(docs, bench, block_shingles=block)
    assert clean.columns == docs.columns and clean.count() == len(texts()) - sum(any(brute_contained(t, x) for _, x in items) for _, t, *_ in texts())
    assert decontaminate.contained(none, bench).count() == 0 and decontaminate.contained(docs, bench.where("false")).count() == 0


def brute_line_dedup(rows, least):
    """{(id, text): deleted line numbers} by all runs of enough words."""
    keys = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda k: (k[0], k[1]))
    seen, out = {}, defaultdict(set)
    runs = defaultdict(list)
    for at, k in enumerate(keys):
        lines = k[2].split("\n")
        n = [len(words(x)) for x in lines]
        for i in range(len(lines)):
            total = 0
            for e in range(i, len(lines)):
                total += n[e]
                if total >= least:
                    runs["\n".join(lines[i : e + 1])].append((at, i, e))
    for places in runs.values():
        for at, i, e in sorted(places)[1:]:
            out[at] |= set(range(i, e + 1))
    del seen
    return {(k[1] if k[0] else None, k[2]): out[at] for at, k in enumerate(keys)}


@pytest.mark.parametrize("least", [12, 50])
def test_line_dedup(spark, docs, none, least):
    got = line_dedup.dedup_lines(docs, min_words=least)
    assert set(docs.columns) <= set(got.columns)
    want = brute_line_dedup([(r[0], r[1]) for r in texts()], least)
    left = sorted((repr(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect() if r.text is not None)
    right = sorted((repr(i), "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i, t]), len(t.split("\n")), len(want[i, t])) for i, t, *_ in texts() if t is not None)
    assert left == right and any(want.values())
    assert got.where("text is null").select("n_lines", "n_removed").collect() == [(0, 0)]
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_random(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), "\n".join(" ".join(["w%d" % rng.integers(0, 3)] * int(rng.integers(0, 4))) for _ in range(rng.integers(1, 30)))) for i in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=9)
    want = brute_line_dedup(rows, 9)
    for r in got.collect():
        gone = {n for run in r.removed_runs for n in range(run.i, run.e + 1)}
        assert gone == want[r.doc_id, dict(rows)[r.doc_id]]


def test_quality_rules(spark, docs, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(texts())
    plain = {repr((i, t)): (i, t) for i, t, *_ in texts()}
    assert plain
    want = []
    for i, t, *_ in texts():
        w = words(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((repr(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge(none).count() == 0


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert quality_rules.distance(p, q) == pytest.approx(1) and quality_rules.distance(p, 5 * p) == pytest.approx(0)


def test_quality_rules_know_every_language(spark):
    """Each language has a reference of its own; a text of no language is compared with none."""
    english, russian = "the cat and the dog that we saw at one time in a house of this kind ", "\u043a\u043e\u0442 \u0438 \u0441\u043e\u0431\u0430\u043a\u0430 \u0432 \u0434\u043e\u043c\u0435 "
    long = lambda s, i: " ".join(f"{w}{chr(97 + (i + k) % 23)}{chr(97 + k // 23)}" for k, w in enumerate(s.split() * 16))
    rows = [(i, long(english, i), "en") for i in range(100)] + [(1000 + i, long(russian, i), "ru") for i in range(30)] + [(2000, long(russian, 3), None), (2001, "$$ ## %% " * 60, "ru")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i].base_failed for i in [*range(100), *range(1000, 1030), 2000])
    assert all(got[1000 + i].kept and got[1000 + i].char_distance is not None for i in range(30)) and got[2000].kept and got[2000].char_distance is None
    assert got[2001].char_distance > quality_rules.MAX_CHAR_DISTANCE


def test_quality_rules_tell_junk(spark, sf):
    rows = quality_rules.judge(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")).join(spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet"), "doc_id")
    by = {(r.quality, r.base_failed, r.kept): r["count"] for r in rows.groupBy("quality", "base_failed", "kept").count().collect()}
    assert by[1, False, True] >= 0.98 * (by[1, False, True] + by.get((1, False, False), 0))
    assert by.get((0, False, False), 0) >= 0.5 * (by.get((0, False, False), 0) + by.get((0, False, True), 0))


def test_language_id(spark, sf, docs, none):
    rows = language_id.identify(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert all(crc(r.doc_id) % 3 == 1 for r in rows)
    got = language_id.identify(docs).collect()
    assert len(got) == len(texts())
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert language_id.identify(none).count() == 0 and {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 20])
def test_codewords(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 1:
        assert all(abs(c.sum()) < n for c in code.T) and len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1]
    if 3 <= n <= 7:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == 2 ** (n - 2)


def test_quality_cnn(spark, sf, docs, none):
    at = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = quality_cnn.classify(spark.read.parquet(f"{at}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.9 and np.mean([r.predicted for r in rows if r.quality]) > 0.95
    empty = labels.where("false")
    assert {r.score for r in quality_cnn.classify(docs, empty).collect()} == {0.5} and quality_cnn.classify(none, labels).count() == 0
    lab = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(None, 1, 1), (1, 0, 1), (100, None, 1)], "doc_id long, quality int, text int")
    got = quality_cnn.classify(docs, lab).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)


def test_cnn_gradient_and_segments():
    net, y = quality_cnn.ByteNet(), np.array([1.0, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raws = [quality_cnn.padded(t) for t in ("abc" * 200, "#*# " * 90, "x")]

    def loss():
        m, x = net.pooled(raws)
        z = m @ net.p["mean"] + x @ net.p["max"] + net.p["out"]
        return np.mean(np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y))

    g = net.gradient(raws, y)
    for name, at in (("mean", 1), ("max", 2), ("bias", 3), ("out", 0), ("w0", (5, 2)), ("w1", (7, 4)), ("embed", (97, 3))):
        old, d = net.p[name][at], 1e-3
        net.p[name][at] = old + d
        up = loss()
        net.p[name][at] = old - d
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2 / d, rel=0.05, abs=2e-4), name
    long = "some words and #signs\n" * 40000
    one = quality_cnn.ByteNet()
    whole = one.halves(np.concatenate((quality_cnn.padded(long), np.zeros(256, np.uint8))))
    assert len(whole) > quality_cnn._SEGMENT and np.isfinite(one.scores([long, "", None])).all()
    assert one.scores([long, "a"])[0] == pytest.approx(one.scores([long])[0])


def brute_ppm(train, text):
    tables = [defaultdict(Counter) for _ in range(4)]
    code = lambda t: b"\xff\xff\xff" + lower(t).encode() + b"\xff"
    for t in train:
        b = code(t)
        for p in range(3, len(b)):
            for k in range(4):
                tables[k][b[p - k : p]][b[p]] += 1
    b, total = code(text), 0.0
    for p in range(3, len(b)):
        share, out = 1.0, set()
        for k in (3, 2, 1, 0):
            found = tables[k].get(b[p - k : p])
            if found is None:
                continue
            n, q = sum(v for s, v in found.items() if s not in out), sum(s not in out for s in found)
            if b[p] in found:
                share *= found[b[p]] / (n + q)
                break
            share *= q / (n + q) if n + q else 1
            out |= set(found)
        else:
            share /= 256 - len(out)
        total += math.log10(share)
    return total


@pytest.mark.parametrize(("hot", "grams"), [(5, 1 << 19), (1 << 17, 7)])
def test_ppm(docs, none, hot, grams):
    got = ppm.score(docs, hot_grams=grams, hot_words=hot).collect()
    train = [t for i, t, *_ in texts() if crc(i) % 7 != 2]
    count = Counter(w for t in train for w in [*words(lower(t)), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, *_ in texts():
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((repr(i), crc(i) % 7 == 2, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6), round(brute_ppm(train, t), 6)))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert ppm.score(none).count() == 0


def test_ppm_without_training(spark):
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    r = ppm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and r.score == pytest.approx(-3 * math.log10(256))


def test_ppm_is_a_distribution(spark):
    """Over all 256 next bytes the probabilities sum to 1, in contexts known to any depth."""
    docs = spark.createDataFrame([("abracadabra abra",), ("cabbage\u00e9",)], "text string")
    trie = ppm.Trie(ppm.counts(docs))
    for context in (b"abr", b"xbr", b"xyr", b"xyz"):
        keys = [(int.from_bytes(context + bytes([s]), "big"),) for s in range(256)]
        got = trie.probabilities(spark.createDataFrame(keys, "key bigint")).collect()
        assert len(got) == 256 and sum(10**r.logp for r in got) == pytest.approx(1)


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    t = ppm.Lookup(keys, np.arange(len(keys), dtype=float))
    v, f = t.find(np.concatenate((keys, keys + np.uint64(1 << 62))))
    assert f[: len(keys)].all() and (v[: len(keys)] == np.arange(len(keys))).all() and not f[len(keys) :].any()


def test_sha_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
