"""Periodic runs against a plain version of their definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import CLASHING, SCHEMA
from pyspark.sql import functions as F

from factline.llm.periodic_runs import Rule, folded, live_lags, periodic_runs, run_digest, scan
from factline.llm.words import boundaries, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_words=12, min_exp=2):
    """Straight from the definition: for every period, the stretches that keep it, if no smaller period does."""
    n, out = len(words), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                s, size = i, j + q - i
                part = words[s : s + size]
                smaller = any(part[: size - p] == part[p:] for p in range(1, q))
                if size >= max(min_words, min_exp * q) and not smaller:
                    out.append((s, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(3)
    out = ["", None, " \t ", "a", "a " * 11, "a " * 12, "a b " * 6, "a b c d e f " * 2, "a b c d e f g " * 2 + "a b", "x y " * 40 + "z " + "x y " * 40]
    for k in range(60):
        few = rng.choice([1, 2, 3, 30])
        words = [f"w{rng.randrange(few)}" for _ in range(rng.randrange(90))]
        if k % 3 == 0 and words:
            a = rng.randrange(len(words))
            words = words[:a] + words[a : a + 1 + rng.randrange(12)] * rng.randrange(2, 6) + words[a:]
        out.append(" ".join(words))
    block = " ".join(f"v{rng.randrange(500)}" for _ in range(400))
    out += [f"{block} {block} tail", f"head {block} {block}", f"{block} mid {block}", "A a " * 30, "long-word-of-more-than-eight-bytes other " * 20, f"{block}\n" * 5]
    return out


@pytest.mark.parametrize("cells", [1 << 25, 20_000])
def test_runs(spark, table_of, cells):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in periodic_runs(table_of(spark.createDataFrame(rows, SCHEMA)), cells=cells).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        want = plain_runs(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, t
        assert got[i]["collapsed"] == plain_collapsed(words, want) and got[i]["n_words"] == len(words)


def test_other_rules(spark, table_of):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts())]
    for least, exp in ((4, 2), (9, 3), (1, 4)):
        for r in periodic_runs(table_of(spark.createDataFrame(rows, SCHEMA), f"t{least}"), Rule(least, exp)).collect():
            assert [tuple(x) for x in r["runs"]] == plain_runs(WORD.findall(rows[r["doc_id"]][1] or ""), least, exp)


def test_left_out_lags_hold_no_runs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        words = [b"w%d" % x for x in rng.integers(0, rng.integers(2, 6), rng.integers(13, 80))]
        data = np.frombuffer(b" ".join(words), np.uint8)
        live = live_lags(word_hashes(data, *boundaries(data, np.array([0, len(data)]))[:2]), Rule())
        ids = np.array([int(x[1:]) for x in words])
        assert {int(q) for q in scan(ids, 1, len(ids) // 2, Rule())[:, 2]} <= {q for a, b in live for q in range(a, b + 1)}


def test_digest_and_folding(spark, docs, table_of, corpus):
    extra = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in f"{CLASHING}, runs string, ranges int, kept int, start int, period int, found int, lo int".split(", "))]
    got = sorted((tuple(r) for r in run_digest(periodic_runs(folded(table_of(docs.select("*", *extra))), cells=20_000)).collect()), key=str)
    want = []
    for i, t, *_ in corpus:
        words = WORD.findall(t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words) if n < 1000 or len(set(words)) < 500 else []
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_collapsed(words, runs)))))
    same = [x for x in want if x[0] != 90]
    assert [x for x in got if x[0] != 90] == sorted(same, key=str) and sum(x[1] > 0 for x in got) > 5


def test_a_very_long_text_and_nothing(spark, table_of):
    rng = random.Random(1)
    words = [f"x{rng.randrange(10**6)}" for _ in range(150_000)]
    words = words[:50_000] + words[49_000:50_000] * 3 + words[50_000:]
    got = periodic_runs(table_of(spark.createDataFrame([(1, " ".join(words), None, None, None)], SCHEMA))).collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(49_000, 4_000, 1_000)]
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = run_digest(periodic_runs(folded(spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)))).collect()
    assert [tuple(r)[:6] for r in nulls] == [(None, 0, None, None, None, None)] * 2
