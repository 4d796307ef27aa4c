import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from clickstrata.llm import line_dedup, quality, repeats, simhash, spot_signatures

from .helpers import PASSAGE, SCHEMA, corpus, frame, sorted_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for held in places.values() if len(held) > 1 for i in held for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(spark):
    out = quality.quality(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted_rows(out) == sorted(((r[0], *_base(r[1])) for r in corpus()), key=repr)
    assert quality.quality(frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_quality_rejects_outliers_only(spark, monkeypatch, broadcast):
    import random

    monkeypatch.setattr(quality, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(quality, "SALTS", 3)

    rng = random.Random(3)
    clean = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randint(0, 99)) for _ in range(60)), "en", f"s{i % 2}", 1) for i in range(400)]
    junk = [(1000 + i, " ".join("&&&word###" + str(rng.randint(0, 999)) for _ in range(60)), "en", "s0", 1) for i in range(60)]
    rare = [(2000, clean[0][1], "xx", "only", 1), (2001, junk[0][1], "xx", "only", 1)]
    out = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(clean + junk + rare, SCHEMA)).collect()}
    assert all(out[r[0]] for r in clean) and not any(out[r[0]] for r in junk)
    assert out[2000] and not out[2001]  # a small group is judged by all rows


def test_long_texts_come_in_smaller_blocks(spark, monkeypatch):
    """Few enough texts for one task, but with more shingles than a task may hold."""
    rng = random.Random(4)
    texts = []
    for _ in range(3):  # groups of near copies in one candidate component
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for i in range(40):
            held = list(words)
            held[rng.randrange(300)] = f"x{i}"
            texts.append(" ".join(held))
    frame_ = spark.createDataFrame([(0, i * 7919 % 127, t) for i, t in enumerate(texts)], "root long, node long, text string")
    monkeypatch.setattr(simhash, "HELD", 4000)
    most, real = [], simhash.compared

    def compared(dealt, least):
        held = dealt.groupBy("root", "i", "j").agg({"shingles": "count"}).collect()
        most.extend(r["count(shingles)"] for r in held)
        return real(dealt, least)

    monkeypatch.setattr(simhash, "compared", compared)
    parent = {i * 7919 % 127: i * 7919 % 127 for i in range(len(texts))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.verified_links(frame_, 5, 0.8).collect():
        parent[root(r.a)] = root(r.b)
    assert [len({root((40 * g + i) * 7919 % 127) for i in range(40)}) for g in range(3)] == [1, 1, 1] and len({root(x) for x in parent}) == 3
    assert len(most) > 9 and max(most) < 80, most  # 120 texts in one task before


def test_least_determinant_equals_that_of_all_subsets(spark):
    from itertools import combinations

    rng, n, groups = np.random.default_rng(7), 13, 12
    p = len(quality.VECTOR)
    floors = np.diag([quality.FLOORS[x] ** 2 for x in quality.VECTOR])
    scale = quality.COVERAGE / quality.chi_square(quality.chi_square_quantile(quality.COVERAGE, p), p + 2)
    rows, expected = [], {}
    for g in range(groups):
        held = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) * 0.3
        held[: g % 5] += rng.normal(size=(g % 5, p)) * 2 + 3  # outliers
        rows += [("en", f"g{g}", *map(float, x)) for x in held]
        size = int(np.ceil(quality.COVERAGE * n))
        expected[f"g{g}"] = min(np.linalg.slogdet(np.cov(held[list(c)].T, bias=True) * scale + floors)[1] for c in combinations(range(n), size))
    sample = spark.createDataFrame(rows, ["g_lang", "g_source", *quality.VECTOR])
    found = {r.g_source: r.log_det for r in quality.least_determinant(sample, groups).collect()}
    assert set(found) == set(expected)
    off = [found[g] - expected[g] for g in expected]
    # in groups of two rows a dimension a search by steps may end in another minimum now and then
    assert min(off) > -1e-6 and max(off) < 1.5 and sum(x < 1e-6 for x in off) >= 0.75 * groups, off


def test_small_groups_have_more_starts_and_none_of_nearly_all_rows(spark):
    rng, p = np.random.default_rng(5), len(quality.VECTOR)
    held = {f"g{n}": rng.normal(size=(n, p)) for n in (13, 59, 60, 400)}
    sample = spark.createDataFrame([("en", g, *map(float, x)) for g, rows in held.items() for x in rows], ["g_lang", "g_source", *quality.VECTOR])
    found = quality.starts(sample, len(held)).collect()
    counts = Counter(r.g_source for r in found)
    assert counts["g60"] == counts["g400"] == quality.RANDOM_STARTS + 4 and min(counts["g13"], counts["g59"]) > 4 * quality.RANDOM_STARTS, counts
    # means of half the rows differ from the mean of all; those of 12 of 13 rows hardly do
    middle = held["g13"].mean(0)
    off = [np.linalg.norm([r[f"m_{x}"] for x in quality.VECTOR] - middle) for r in found if r.g_source == "g13" and r.start.startswith("random")]
    assert np.median(off) > 0.4, off


def test_settled_groups_take_no_more_steps(spark, monkeypatch):
    rng, n, groups = np.random.default_rng(11), 40, 10
    p = len(quality.VECTOR)
    rows = [("en", f"g{g}", *map(float, x)) for g in range(groups) for x in rng.normal(size=(n, p)) @ rng.normal(size=(p, p))]
    rows += [("en", "even", *[0.0] * p)] * n  # settles at once
    sample = spark.createDataFrame(rows, ["g_lang", "g_source", *quality.VECTOR])
    steps, real = [], quality.concentrated

    def concentrated(sample, estimate, n_groups, keys):
        out = real(sample, estimate, n_groups, keys)
        if keys == quality.GROUP:
            held = {r.g_source: r.log_det for r in estimate.collect()}
            steps.append({r.g_source: held[r.g_source] - r.log_det for r in out.collect()})
        return out

    monkeypatch.setattr(quality, "concentrated", concentrated)
    found = {r.g_source for r in quality.least_determinant(sample, groups + 1).collect()}
    assert len(found) == groups + 1 == len(steps[0]) and len(steps) > 1
    for one, after in zip(steps, steps[1:], strict=False):
        assert set(after) == {g for g, fall in one.items() if fall > quality.TOLERANCE}
    assert all(fall <= quality.TOLERANCE for fall in steps[-1].values())


def test_words_end_at_the_six_blanks_only(spark):
    texts = ["abc \x85", "abc\u2028", "\u2029", "a\u00a0b c\x1c", " \n", "\x0b\x0ca\r"]
    out = quality.quality(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted_rows(out) == [(i, *_base(t)) for i, t in enumerate(texts)]


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 1) - 3.841) < 1e-3 and abs(quality.chi_square_quantile(0.99, 5) - 15.086) < 1e-3


def _removed(texts, window, units):
    seqs = [list(t.encode()) if units == "bytes" else [m.group() for m in WORD.finditer(t)] for t in texts]
    count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    return [{i + k for i in range(len(s) - window + 1) if count[tuple(s[i : i + window])] > 1 for k in range(window)} for s in seqs]


@pytest.mark.parametrize("group", [16_384, 2])
def test_repeated_bytes(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = [(r[0], (r[1] or "")[:1200], *r[2:]) for r in corpus()]
    texts = [r[1] for r in rows]
    expected = []
    for r, gone in zip(rows, _removed(texts, 40, "bytes"), strict=True):
        raw = r[1].encode()
        kept = bytes(x for i, x in enumerate(raw) if i not in gone)
        runs = sum(1 for i in gone if i - 1 not in gone)
        expected.append((r[0], len(raw), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    out = repeats.without_repeats(frame(spark, rows), repeats.Windows("bytes", 40), digest_only=True)
    assert sorted_rows(out.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256")) == sorted(expected, key=repr)


def _passages(seed=11):
    """Texts with repeated passages around the threshold of 400 bytes, within and across texts, overlapping and cut by edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n).encode()[:size].decode("utf-8", "ignore") for n, size in ((200, 399), (200, 400), (200, 401), (300, 700), (20, 30))]
    texts = [None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 900]
    for _ in range(40):
        parts = [prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append("".join(parts))
    texts += [shared[3][50:650] + prose(20) + shared[3], texts[9], texts[10], shared[1] + "q" + shared[1]]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group", [2, 8192])
def test_repeated_bytes_at_the_production_window(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = _passages()
    expected = []
    for r, gone in zip(rows, _removed([r[1] or "" for r in rows], 400, "bytes"), strict=True):
        raw = (r[1] or "").encode()
        kept = bytes(x for i, x in enumerate(raw) if i not in gone)
        expected.append((r[0], len(raw), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(kept).hexdigest()))
    out = repeats.without_repeats(frame(spark, rows), digest_only=True)
    assert sorted_rows(out.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256")) == sorted(expected, key=repr)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_radix_passes_give_the_groups_of_equal_suffixes():
    rng = random.Random(2)
    raw = "".join(rng.choice("ab") for _ in range(900)).encode() + b"a" * 60
    for window in (3, 8, 13, 40):
        windows = repeats.Windows("bytes", window)
        starts = np.arange(len(raw) - window + 1)
        places, group = repeats.equal_suffixes(repeats.digits_of(raw, windows), starts, np.zeros(len(starts), np.int64), windows)
        held = Counter(raw[i : i + window] for i in starts)
        assert sorted(places.tolist()) == [i for i in starts.tolist() if held[raw[i : i + window]] > 1]
        kinds = [raw[i : i + window] for i in places.tolist()]
        assert kinds == sorted(kinds) and len(set(zip(group.tolist(), kinds, strict=True))) == len(set(kinds)) == len(set(group.tolist()))


def test_repeated_words(spark):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 4000]
    texts = [r[1] or "" for r in rows]
    gone = _removed(texts, 50, "words")
    out = repeats.without_repeats(frame(spark, rows), repeats.Windows("words", 50), columns=("lang", "source"))
    kept = sorted(((r.doc_id, r.lang, r.source, WORD.findall(r.kept.decode())) for r in out.collect()), key=repr)
    expected = sorted(((r[0], r[2], r[3], [m.group() for i, m in enumerate(WORD.finditer(t)) if i not in g]) for r, t, g in zip(rows, texts, gone, strict=True)), key=repr)
    assert kept == expected
    assert not any(PASSAGE in r.kept.decode() for r in out.collect())
    assert repeats.without_repeats(frame(spark, []), repeats.Windows("words", 50)).count() == 0


def test_digests_and_minima():
    rng = np.random.default_rng(1)
    codes = repeats.BYTE_CODES[rng.integers(0, 3, 500)]
    for size in (1, 2, 3, 7, 64, 133):
        (held,) = repeats.digests(codes, size)
        same = {}
        for i, x in enumerate(held.tolist()):
            assert same.setdefault(codes[i : i + size].tobytes(), x) == x
        assert len(set(held.tolist())) == len(same)
        assert (repeats.sliding_min(codes, size) == np.lib.stride_tricks.sliding_window_view(codes, size).min(axis=1)).all()


def _components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = sorted(nodes)
    for i, a in enumerate(held):
        for b in held[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_anchors_count_every_stretch(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    windows = repeats.Windows("words", 50)
    same = " ".join(f"same{k}" for k in range(40))
    text = " ".join(f"{same} " + " ".join(f"r{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(60))
    texts = spark.createDataFrame([(1, 2, text, 1)], "did bigint, hash bigint, text string, copies int")
    counts = {r.anchor: r.n for r in repeats.anchors(texts, windows).collect()}
    again = F.array(*[F.struct(F.lit(k).alias("anchor"), F.lit(1).alias("parts")) for k, n in counts.items() if n > 1])
    made = Counter(r.anchor for r in repeats.stretches(texts.withColumn("again", again), windows).where("anchor is not null").collect())
    assert max(made.values()) > 2 and all(n <= counts[k] for k, n in made.items())


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 3)
    rows = corpus(n=120)
    prints = {}
    for r in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        held = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [simhash.xxh64_intdigest(x.encode(), 42) for x in held]
        prints[id(r)] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    classes = _components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r in rows:
        key = classes[prints[id(r)]]
        if r[0] is not None:
            least[key] = min(least.get(key, r[0]), r[0])
    expected = [(r[0], f"{prints[id(r)]:016x}", least.get(classes[prints[id(r)]])) for r in rows]
    out = simhash.near_duplicates(frame(spark, rows)).selectExpr("doc_id", "lower(hex(fingerprint)) AS f", "component_id")
    assert sorted_rows(out) == sorted(expected, key=repr)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_bk_tree_and_forest():
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)] + base
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.within(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]
    for radius in (1, 2, 4):
        links = simhash.forest(values, len(values), radius)
        assert all((values[a] ^ values[b]).bit_count() <= radius for a, b in links)


@pytest.mark.parametrize("pivots", [1, 16])
def test_one_of_each_near_duplicate_group_stays(spark, monkeypatch, pivots):
    monkeypatch.setattr(simhash, "COMPARED", 3)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    import random

    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
        for k in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(150)] = f"x{rng.randint(0, 5000)}"
            rows.append((n, " ".join(words), "en", "s", 1))
            n += 1
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), rows[0], (n + 2, rows[0][1], "de", "t", 1)]
    sets = {r[0]: set(simhash.shingles(r[1] or "", 5)) for r in rows}
    text = {r[0]: r[1] or "" for r in rows}
    groups = _components(list(sets), lambda a, b: text[a] == text[b] or bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9)
    out = simhash.first_of_each_group(frame(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))
    assert out.columns == frame(spark, rows).columns
    assert simhash.first_of_each_group(frame(spark, [])).count() == 0


def _near(rows):
    sets = {r[0]: set(simhash.shingles(r[1], 5)) for r in rows}
    return sorted(set(_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9).values()))


def test_near_duplicates_that_differ_in_repeats(spark):
    rows = []
    for n in range(40):
        words = [f"w{n}x{k}" for k in range(304)]
        line = " ".join(words[:12])
        rows += [(2 * n, " ".join(words + words[:4]) + f" {line}" * 2, "en", "s", 1), (2 * n + 1, " ".join(words + words[:4]) + f" {line}" * 16, "en", "s", 1)]
    assert _near(rows) == [2 * n for n in range(40)]
    assert sorted(r.doc_id for r in simhash.first_of_each_group(frame(spark, rows)).collect()) == _near(rows)


def test_near_duplicates_that_share_no_band(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "COUNTED", 500, raising=False)
    rng = random.Random(3)
    common = [" ".join(f"c{k}x{j}" for j in range(30)) for k in range(6)]
    rows = []
    for n in range(30):
        base = [f"b{n}x{rng.randint(0, 400)}" for _ in range(rng.randint(2, 120))] + rng.choice(common).split()
        for k in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"y{rng.randint(0, 400)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    alone = simhash.Links(shingle=5, bits=384, radius=0, blocks=24, equal=24)
    assert sorted(r.doc_id for r in simhash.first_of_each_group(frame(spark, rows), alone).collect()) == _near(rows)


@pytest.mark.parametrize("least", [1, 8])
def test_lines_keep_the_first(spark, least):
    rows = [*corpus(), (900, "a\u00a0b c\nA b\x0bc\n a B  C \n...\n...", "en", "s1", 1)]
    seen, expected = {}, []
    ranked = sorted({(r[0] if r[0] is not None else -(1 << 63), _xx(spark, r[1] or ""), r[1] or "") for r in rows})
    gone = {}
    for did, h, text in ranked:
        for k, line in enumerate(text.split("\n")):
            words = [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", line.lower()) if w]
            if len(words) >= least:
                gone[did, h, k] = " ".join(words) in seen
                seen.setdefault(" ".join(words), (did, h, k))
    for r in rows:
        did, h, text = r[0] if r[0] is not None else -(1 << 63), _xx(spark, r[1] or ""), r[1] or ""
        lines = text.split("\n")
        drop = [k for k in range(len(lines)) if gone.get((did, h, k))]
        expected.append((r[0], len(lines), len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    out = line_dedup.without_copies(frame(spark, rows), least_words=least)
    assert sorted_rows(out.select("doc_id", "n_units", "n_removed", "kept")) == sorted(expected, key=repr)
    for r in out.collect():
        source = next(x[1] for x in rows if x[0] == r.doc_id and len((x[1] or "").split("\n")) == r.n_units) if r.n_removed else ""
        for s in r.spans:
            assert "\n" not in source[s.start : s.start + s.length] and len(source[s.start : s.start + s.length].split()) >= least
    assert line_dedup.without_copies(frame(spark, [])).count() == 0
    assert line_dedup.without_copies(frame(spark, rows), unit="paragraph").count() == len(rows)


_hashes = {}


def _xx(spark, text):
    if text not in _hashes:
        from xxhash import xxh64_intdigest

        x = xxh64_intdigest(text.encode(), 42)
        _hashes[text] = x - (1 << 64) if x >> 63 else x
    return _hashes[text]


def _signatures(text):
    words, anchors = re.findall(r"[^\W_]+", text.lower()), set(spot_signatures.ANCHORS)
    content = [(words[i - 1], w) for i, w in enumerate(words) if i and w not in anchors]
    found = {(a, w, content[i + 1][1]) for i, (a, w) in enumerate(content[:-1]) if a in anchors}
    return found or ({tuple(words)} if words else set())


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spot_signatures(spark):
    rows = [r for r in corpus() if r[1] is None or "́" not in r[1]]
    order = sorted({(r[0] if r[0] is not None else -(1 << 63), _xx(spark, r[1] or ""), r[1] or "") for r in rows}, reverse=True)
    after = {k: order[(i + 1) % len(order)][2] for i, k in enumerate(order)}
    expected = []
    for r in rows:
        text = r[1] or ""
        other = after[r[0] if r[0] is not None else -(1 << 63), _xx(spark, text), text]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own = _signatures(text)
        expected.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(_jaccard(own, _signatures(edited)), 9), round(_jaccard(own, _signatures(other)), 9)))
    out = spot_signatures.edited_likeness(frame(spark, rows))
    assert sorted_rows(out.selectExpr("doc_id", "n_chars", "edited_sha256", "round(near_edited, 9)", "round(near_next, 9)")) == sorted(expected, key=repr)
    prints = {}
    for r in out.collect():
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {len(r.fingerprint) for r in out.collect()} == {64}
    assert spot_signatures.edited_likeness(frame(spark, [])).count() == 0
    one = spot_signatures.edited_likeness(frame(spark, rows[10:11])).first()
    assert one.near_next == 1.0


def test_spot_signature_links(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(dict.fromkeys(r[1] for r in corpus(n=40) if r[1] and "́" not in r[1]))]
    base = "the alpha beta of gamma delta and epsilon zeta to eta theta the iota kappa of lambda mu and nu xi to pi rho"
    rows += [(1000, base, "en", "s", 1), (1001, base.replace("pi", "sigma"), "en", "s", 1), (1002, base, "en", "s", 1), (1003, base.replace("beta", "tau").replace("mu", "phi"), "en", "s", 1)]
    members, links = spot_signatures.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.6)
    sets = {r[0]: frozenset(_signatures(r[1])) for r in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    expected = {(a, b) for sa, a in first.items() for sb, b in first.items() if a < b and sa and sb and _jaccard(sa, sb) >= 0.6}
    assert {(r.a, r.b) for r in links.collect()} == expected and expected
    assert {r.doc_id: r.representative for r in members.collect()} == {i: first[s] for i, s in sets.items()}


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    from clickstrata.llm.common import scratch, shared_dir, table_path, written

    folder = Path(shared_dir(spark).removeprefix("file:")) / f"clickstrata-{spark.sparkContext.applicationId}"
    kept = table_path(spark, "kept")
    with scratch(spark):
        written(spark.range(3), "scratch-inner").write.parquet(kept)
        assert list(folder.glob("scratch-inner-*"))
    assert not list(folder.glob("scratch-inner-*")) and spark.read.parquet(kept).count() == 3


def test_components_of_long_chains(spark):
    from clickstrata.llm.common import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (7, 7), (300, 301), (301, 302), (302, 300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 300, 301: 300, 302: 300}


def test_neighbours_over_ranges(spark):
    from pyspark.sql import functions as F

    from clickstrata.llm.common import neighbours

    keys = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    out = {r.k: r.n for r in neighbours(keys, [F.desc("k")], True, "n", "k").collect()}
    assert out == {k: (k - 1) % 101 for k in range(101)}
    assert {r.k: r.n for r in neighbours(keys, [F.asc("k")], False, "n", "k").collect()} == {k: k + 1 if k < 100 else None for k in range(101)}
