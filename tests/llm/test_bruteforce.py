"""Every operator against a plain version of what it must give."""

import collections
import hashlib
import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest_llm import SCHEMA

from factline.llm import lattice as lat
from factline.llm import words as w
from factline.llm.exact_dedup import CountingQuotientFilter, exact_dedup
from factline.llm.jaccard_join import Terms, jaccard_components
from factline.llm.line_dedup import line_dedup
from factline.llm.mixing import edf_blocks, pfair_mix, pfair_schedule
from factline.llm.mixing_lm import lm_scores
from factline.llm.quality import LineField, quality_lines
from factline.llm.sharding import stratified_shards
from factline.llm.substring_dedup import difference_cover, plan, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_rules(docs, table_of, corpus):
    got = rows_by_id(quality_lines(table_of(docs)))
    for i, text, *_ in corpus:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = collections.Counter(grams)
        hit = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert want in [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got[i]]
        assert all(len(r["line_labels"]) == text.count("\n") + 1 for r in got[i] if len(got[i]) == 1)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        field = LineField(steps=rng.normal(size=(2, 2)))
        scores = rng.normal(size=rng.integers(1, 9))
        value = lambda y: sum(s * k for s, k in zip(scores, y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert value(field.decode(scores).tolist()) == pytest.approx(value(best))


def plain_runs(texts, least):
    """Of each line of texts, in order, whether it lies in a run of that weight that also stands at an earlier place."""
    names, ids, size, where = {}, [], [], []
    for t, text in enumerate(texts):
        for line in text.split("\n"):
            ids.append(names.setdefault(line, len(names)))
            size.append(len(line) + 1)
            where.append(t)
        ids.append(-1 - t)  # no run goes beyond a text
        size.append(0)
        where.append(None)
    ids, upto = np.array(ids), np.cumsum([0, *size])
    alike, gone = np.zeros(len(ids) + 1, int), [False] * len(ids)
    for i in range(len(ids) - 1, -1, -1):
        alike[:-1] = np.where(ids == ids[i], alike[1:] + 1, 0)
        longest = alike[:i].max(initial=0)  # the place at i + 1 is alike to itself, but only earlier ones count
        if where[i] is not None and longest and upto[i + longest] - upto[i] >= least:
            gone[i : i + longest] = [True] * longest
    out = [[] for _ in texts]
    for t, g in zip(where, gone):
        if t is not None:
            out[t].append(g)
    return out


@pytest.mark.parametrize("least", [60, 200])
def test_line_dedup(docs, table_of, corpus, least):
    got = {(r["doc_id"], r["text"]): r for r in line_dedup(table_of(docs), min_chars=least).collect()}
    order = sorted({(i if i is not None else 1 << 62, t) for i, t, *_ in corpus if t is not None})
    for (i, t), gone in zip(order, plain_runs([t for _, t in order], least)):
        r = got[(i if i < 1 << 62 else None, t)]
        if i != 91:  # the repeated row's copies meet each other
            assert (r["_n_removed"], r["_kept"]) == (sum(gone), "\n".join(x for x, g in zip(t.split("\n"), gone) if not g))
    assert got[(80, None)]["_kept"] is None


def test_lm_counts_and_gain(docs, table_of, corpus):
    got = rows_by_id(lm_scores(table_of(docs)))
    tokens = {k: WORD.findall(lower(t)) + [None] for k, (_, t, *_) in enumerate(corpus)}
    held = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for k, (i, *_) in enumerate(corpus)}
    c = collections.Counter(x for k, ts in tokens.items() if not held[k] for x in ts)
    n, v = sum(c.values()), len(c)
    score = base = 0.0
    for k, (i, *_) in enumerate(corpus):
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[k])
        r = min(got[i], key=lambda r: abs(r["base_score"] - want))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens[k]), sum(c[x] > 0 for x in tokens[k]), n)
        assert r["base_score"] == pytest.approx(want)
        assert r["score"] < 0
        score, base = score + held[k] * r["score"], base + held[k] * r["base_score"]
    assert score > base


def test_exact_dedup(docs, table_of, corpus):
    got = exact_dedup(table_of(docs)).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    want = collections.Counter()
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            want[(m[3], keep[3], len(members), hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    a, b = (rng.choice(rng.integers(0, 1 << 63, 300).astype(np.uint64), 2000) for _ in range(2))
    for bits in (4, 9):
        both = CountingQuotientFilter.of(a, bits).merge(CountingQuotientFilter.of(b, bits))
        n = collections.Counter(np.r_[a, b].tolist())
        assert dict(zip(both.prints().tolist(), both.counts.tolist())) == n
        assert all(both.count(x) == k for x, k in list(n.items())[:50]) and both.count(5) == 0


def test_runs_are_cut_to_their_ends(spark, table_of):
    lines = [c * n for c, n in zip("abcde", (89, 89, 89, 39, 39))]
    rows = [(1, "\n".join(["first", *lines, "x"]), None, None, 0), (2, "\n".join(["other", *lines, "y"]), None, None, 0), (3, "\n".join([lines[4], "z", lines[1]]), None, None, 0), (4, "\n".join(["z", lines[3], lines[4]]), None, None, 0)]
    got = {r["doc_id"]: (r["_kept"], r["_n_runs"]) for r in line_dedup(table_of(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other\ny", 1), 3: (lines[4] + "\nz", 1), 4: ("z", 1)}


def test_shards(docs, table_of, corpus):
    got = stratified_shards(table_of(docs), shards=8).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(corpus) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    for source, n in collections.Counter(r["source"] for r in got).items():
        assert all(abs(sum(r["source"] == source for r in got if r["shard"] == s) - n / 8) <= 2 for s in range(8))
    by = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == by


def plain_edf(weights, blocks):
    """Slot -> (source, block): at each slot every source is looked at anew."""
    shares = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    done, out, t = [0] * len(weights), {}, 0
    while done != blocks:
        open_ = [k for k, n in enumerate(blocks) if done[k] < n]
        ready = [k for k in open_ if math.floor(done[k] / shares[k]) <= t]
        if ready:
            k = min(ready, key=lambda k: (math.ceil((done[k] + 1) / shares[k]), k))
            out[t] = (k, done[k])
            done[k] += 1
        t += 1
    return out


def test_pfair(spark, docs, table_of, corpus):
    for weights, blocks in (([5.0, 3.0, 2.0], [50, 30, 20]), ([1.0, 1.0, 98.0], [4, 1, 150]), ([7.0], [9]), ([3.0] * 11, [3] * 11), ([0.1, 0.7, 0.3], [40, 20, 60])):
        which, slots = edf_blocks(weights, blocks)
        want = plain_edf(weights, blocks)
        assert list(zip(slots.tolist(), which.tolist())) == [(t, k) for t, (k, _) in want.items()]
        for k, w in enumerate(weights):
            share = Fraction(w) / sum(map(Fraction, weights))
            at = [t for t, (s, _) in want.items() if s == k]
            assert all(math.floor(j / share) <= t < math.ceil((j + 1) / share) for j, t in enumerate(at))  # each block in its window, also after others have run out
    t = table_of(docs)
    got = pfair_schedule(t, block_rows=2).collect()
    assert sorted(r["mix_order"] for r in got) == list(range(len(corpus)))
    assert collections.Counter(r["id"] for r in got) == collections.Counter(i for i, *_ in corpus)
    counts = collections.Counter(s for _, _, _, s, _ in corpus)
    names = sorted(counts, key=lambda s: (s is None, str(s)))
    want = plain_edf([counts[s] ** 0.7 for s in names], [-(-counts[s] // 2) for s in names])
    assert {r["slot"]: (names.index(r["source"]), r["block"]) for r in got} == want
    assert [r["slot"] for r in sorted(got, key=lambda r: r["mix_order"])] == sorted(r["slot"] for r in got)
    mixed = pfair_mix(t).collect()
    assert collections.Counter(map(tuple, mixed)) == collections.Counter(map(tuple, corpus))
    with pytest.raises(ValueError):
        pfair_schedule(t, weights={"big": 1.0})


def brute_components(corpus, terms):
    sets = {}
    for k, (_, t, *_) in enumerate(corpus):
        words = WORD.findall(lower(t))
        sets[k] = {tuple(words[j : j + terms.n]) for j in range(len(words) - terms.n + 1)} if len(words) >= terms.n else {tuple(words)} if words else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= terms.percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k in sets:
        i = corpus[k][0]
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((corpus[k][0], len(sets[k]), least.get(find(k)) if sets[k] else corpus[k][0]) for k in sets)


@pytest.mark.parametrize("percent", [85, 60])
def test_jaccard(docs, table_of, corpus, percent):
    terms = Terms(4, percent)
    got = jaccard_components(table_of(docs), terms).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(corpus, terms)


def test_jaccard_chains_without_a_common_hub(spark, table_of):
    rows = []
    for g in range(4):
        words = [f"g{g}w{k}" for k in range(60)]
        for v in range(8):
            words = [*words[:2], f"g{g}v{v}", *words[3:]] if v % 2 else [*words[:-1], f"g{g}e{v}"]
            rows.append((100 * g + 7 - v, " ".join(words[v // 3 :]), None, None, 0))
    got = jaccard_components(table_of(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(rows, Terms())


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup(docs, table_of, corpus, window):
    got = rows_by_id(substring_dedup(table_of(docs), window=window))
    big = 1 << 62
    texts = [(big if i is None else i, WORD.findall(t or "")) for i, t, *_ in corpus]
    first = {}
    for i, words in sorted(texts, key=lambda x: x[0]):
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    for i, words in texts:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(words, gone) if not g)
        want = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
        assert want in [(r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got[None if i == big else i]]


@pytest.mark.parametrize("window", [2, 3, 5, 10, 20, 50, 100])
def test_difference_cover(window):
    period, cover, length = plan(window)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and length >= 1 and period - 1 + length <= window
    assert {(a - b) % 40 for a in difference_cover(40) for b in difference_cover(40)} == set(range(40))


def test_lattice_samples_follow_the_distribution():
    pieces = lat.Pieces.load()
    text = "the \U0001f600 é".encode()
    names = {pieces.data[pieces.offsets[i] : pieces.offsets[i + 1]].tobytes(): int(i) for i in np.flatnonzero(pieces.usable)}

    def every(rest):
        if not rest:
            yield (), 0.0
            return
        char = rest.decode()[0].encode()
        options = [(rest[:k], [names[rest[:k]]], pieces.logp[names[rest[:k]]]) for k in range(1, len(rest) + 1) if rest[:k] in names]
        if char not in names:
            options.append((char, [pieces.byte0 + b for b in char], len(char) * pieces.logp[pieces.byte0]))
        for part, ids, lp in options:
            for more, q in every(rest[len(part) :]):
                yield (*ids, *more), lp + q

    law = dict(every(b" " + text))
    z = np.logaddexp.reduce(list(law.values()))
    n = 4000
    keys = w._mixed(np.arange(n, dtype=np.uint64))
    drawn = lat.sample_slice(pieces, [text] * n, keys, 3)
    first = collections.Counter(tuple(s[0].ids.tolist()) for s, _ in drawn)
    expected = {k: n * math.exp(v - z) for k, v in law.items()}
    cells = [k for k, v in expected.items() if v > 5]
    assert sum((first[k] - expected[k]) ** 2 / expected[k] for k in cells) < 3 * len(cells) + 15
    weights = []
    for samples, bound in drawn:
        assert len({s.ids.tobytes() for s in samples}) == 3 and all(s.text_ok for s in samples)
        assert all(s.logp == pytest.approx(law[tuple(s.ids.tolist())] - z) for s in samples)
        assert all(lat.decode(pieces, s.ids) == text for s in samples)
        weights.append(sum(math.exp(s.logp) / -math.expm1(-math.exp(s.logp - bound)) for s in samples))
    assert np.mean(weights) == pytest.approx(1, abs=0.02)


def test_lattice_round_trips(docs, table_of, corpus):
    got = lat.sample_segmentations(table_of(docs), k=2)
    rows = got.collect()
    assert all(r["roundtrip"] for r in rows) and {r["doc_id"] for r in rows} == {i for i, *_ in corpus}
    again = lat.sample_segmentations(table_of(docs.repartition(5), "other"), k=2).collect()
    key = lambda r: (str(r["doc_id"]), r["sample"], r["ids_sha256"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    decoded = lat.decode_ids(got.filter("doc_id = 87")).collect()
    assert {r["decoded"] for r in decoded} == {t for i, t, *_ in corpus if i == 87}
