"""What a shorter job would leave out."""

import collections

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SCHEMA

from factline.llm import mixing, mixing_lm
from factline.llm.exact_dedup import exact_dedup
from factline.llm.jaccard_join import jaccard_components, keep_one_of_class
from factline.llm.lattice import sample_segmentations
from factline.llm.quality import FEATURES, LineField
from factline.llm.url_filter import judge_urls


def test_pipeline_links_from_four_fifths_on(spark, table_of):
    words = [f"w{k}" for k in range(300)]
    texts = [words, words[:-52], [*words[:-26], *(f"x{k}" for k in range(26))], [f"v{k}" for k in range(300)]]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    got = corpus_pipeline.near_copies(spark, table_of(spark.createDataFrame(rows, SCHEMA)), "")
    assert {r["doc_id"] for r in got.collect()} == {0, 3}


def strays(got, weights):
    """How far any source is from its true weight over the prefixes in which none has run out."""
    rows = sorted(got, key=lambda r: r["mix_order"])
    left, done, worst, total = collections.Counter(r["source"] for r in rows), collections.Counter(), 0.0, sum(weights.values())
    for t, r in enumerate(rows, 1):
        done[r["source"]] += 1
        worst = max(worst, *(abs(done[s] - w / total * t) for s, w in weights.items()))
        left[r["source"]] -= 1
        if not left[r["source"]]:
            return worst


@pytest.mark.parametrize("sizes,temper", [({"a": 1800, "b": 100, "c": 100}, 1.0), ({"hot": 4750} | {f"s{k}": 500 for k in range(19)}, 0.7)])
def test_mixture_follows_the_true_weights(spark, table_of, sizes, temper):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.pfair_schedule(table_of(spark.createDataFrame(rows, SCHEMA)), block_rows=1, temper=temper).collect()
    assert strays(got, {s: n**temper for s, n in sizes.items()}) < 1 and sorted(r["mix_order"] for r in got) == list(range(len(rows)))


def test_sources_of_weight_nought_come_last(spark, table_of):
    rows = [(i, "t", "en", "abc"[i % 3], 1) for i in range(30)]
    got = mixing.pfair_schedule(table_of(spark.createDataFrame(rows, SCHEMA)), weights={"a": 1.0, "b": 0, "c": 3.0}, block_rows=2).collect()
    assert {r["source"] for r in got if r["mix_order"] >= 20} == {"b"} and len(got) == 30


@pytest.mark.parametrize("small", [1 << 16, 10])
def test_mixture_of_many_sources(spark, table_of, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL", small, raising=False)
    rows = [(i, "t", "en", f"s{i % 599}" if i % 3 else None, 1) for i in range(3000)]
    got = mixing.pfair_schedule(table_of(spark.createDataFrame(rows, SCHEMA)), block_rows=2).collect()
    assert sorted(r["mix_order"] for r in got) == list(range(3000)) and {(r["id"], r["source"]) for r in got} == {(i, s) for i, _, _, s, _ in rows}


def test_fresh_hosts_are_judged_by_their_prior(spark):
    urls = [(i, f"http://h{i % 5}.{'bad' if i % 2 else 'good'}.com/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2 == 1) for i, _ in urls], "id bigint, bad boolean")
    fresh = [(1000, "http://new.bad.com/"), (1001, "http://new.good.com/"), (1002, "http://other.com/"), (1003, "http://x.org/"), (None, "http://n.bad.com/")]
    pages = spark.createDataFrame(urls + fresh, "page_id bigint, url string")
    got = {r["host"]: (r["verdict"], r["bad_mean"]) for r in judge_urls(pages, labels, rules=()).collect()}
    assert [got[h][0] for h in ("new.bad.com", "n.bad.com", "new.good.com", "other.com", "x.org")] == ["block", "block", "allow", "allow", "allow"]
    assert got["h1.bad.com"][0] == "block" and got["new.bad.com"][1] > 0.9 and got["x.org"][1] == pytest.approx(0.5)


def test_urls_agree_with_their_sql_on_fresh_hosts(spark, tmp_path):
    import duckdb

    from factline.llm.queries import ORACLES, op7_url_filter

    urls = [(i, f"http://h{i % 5}.{'bad' if i % 2 else 'good'}.{'co.uk' if i % 3 else 'com'}/{i}") for i in range(400)]
    urls += [(900 + i, f"http://10.0.0.{i % 2}:80{i}/x") for i in range(20)]
    fresh = ["http://new.bad.com/", "http://User@new.bad.co.uk:8080/a?b", "http://new.good.com/", "http://other.com", "http://x.org/", "http://x.org/fr/", "http://a.net/", "http://10.0.0.1:9/", "http://10.0.0.7/", "http://:80/", "http://[::1]:80/", None, "nothing"]
    pages = spark.createDataFrame(urls + [(2000 + k, u) for k, u in enumerate(fresh)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in urls], "doc_id bigint, quality int, toxic int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(r) for r in op7_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    with duckdb.connect() as db:
        for name in ("pages", "labels"):
            db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(got) == sorted(db.execute(ORACLES["op7_url_filter"]).fetchall())
    by = {i: v for i, *_, v in got}
    assert [by[2000 + k] for k in (0, 1, 2, 6, 7)] == ["block", "block", "allow", "block", "block"]


def test_gates_learn_from_every_occurrence():
    rng = np.random.default_rng(2)
    x, bit, n = rng.normal(size=(mixing_lm.INPUTS, 3)), np.array([1.0, 0.0, 1.0]), np.array([1000, 3, 40])
    sets = sure = np.zeros(3, np.int64)
    one, each = mixing_lm.Mixer(), mixing_lm.Mixer()
    one.learn(x, sets, sure, bit, n.astype(float))
    k = np.repeat(np.arange(3), n)
    each.learn(x[:, k], sets[k], sure[k], bit[k], np.ones(len(k)))
    assert one.weights == pytest.approx(each.weights) and one.pull == pytest.approx(each.pull)


def test_counts_go_on_above_single_precision():
    words = [b"word", *(b"word%d" % k for k in range(100))]
    train = np.array([1 << 24] + [1] * 100, float)
    counts = mixing_lm.Words(sum(map(len, words)) + len(words))
    for _, _, s in mixing_lm._chunks(pa.array(words, pa.binary()), np.zeros(len(words), np.int64)):
        counts.add(s, train[s.of])
    bits = 8 * np.array([len(w) + 1 for w in words])  # each with the byte that closes it
    assert counts.total.sum() == (bits * train).sum()


def test_the_pipeline_ends_in_the_order_of_the_mixture(spark, table_of):
    rows = [(i, f"text {i}", "en", "aaab"[i % 4], 6) for i in range(400)]
    docs = table_of(spark.createDataFrame(rows, SCHEMA))
    want = [r["id"] for r in mixing.pfair_schedule(docs).orderBy("mix_order").collect()]
    mixed = table_of(corpus_pipeline.mixture(spark, docs, "").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), "other")
    assert len(mixed.inputFiles()) > 1
    by = lambda t: [r["doc_id"] for r in corpus_pipeline.encode(spark, t, "").filter("sample = 1").orderBy("position").collect()]
    assert by(mixed) == list(range(400))
    assert by(table_of(corpus_pipeline.mixture(spark, docs, ""), "mixed")) == want


def test_shards_and_mixture_agree_with_their_sql(spark, tmp_path):
    import duckdb

    from factline.llm.queries import ORACLES, QUERIES

    rows = [(i, None if i % 11 == 0 else "é text " * (i % 5) + str(i % 3), "en", None if i % 13 == 0 else "abbbcd"[i % 6] * (1 + i % 2), 0) for i in range(700)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        for name in ("op6_sharding", "op8_pfair_mixing"):
            got = QUERIES[name](spark, str(tmp_path))
            want = db.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_ids_of_any_kind(spark, table_of, docs):
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    whole, text = table_of(docs, "whole"), table_of(named, "text")
    sizes = lambda t: collections.Counter((r["doc_id"] and int(r["doc_id"]), r["group_size"], r["text_sha256"]) for r in exact_dedup(t).collect())
    assert sizes(whole) == sizes(text)
    members = lambda t: collections.Counter(collections.Counter(r["component_id"] for r in jaccard_components(t).collect() if r["doc_id"] is not None).values())
    assert members(whole) == members(text)
    assert keep_one_of_class(text).count() == keep_one_of_class(whole).count()
    assert all(r["roundtrip"] for r in sample_segmentations(text).collect())


def test_rows_alike_in_id_and_text_leave_the_same_one(spark, table_of):
    rows = [(1, "a b c d e f", lang, "s", n) for n, lang in enumerate(["en", "de", None, "fr"])]
    one, other = (table_of(spark.createDataFrame(r, SCHEMA), n) for r, n in ((rows, "one"), (rows[::-1], "other")))
    assert keep_one_of_class(one).collect() == keep_one_of_class(other).collect() and keep_one_of_class(one).count() == 1


def test_few_labels_move_the_field_from_its_prior():
    x = np.zeros((6, len(FEATURES)))
    x[:, 0] = x[:, FEATURES.index("long")] = 1
    prior = LineField()
    away = [np.abs(LineField.fit([(x, 1)] * n + [(x * 0 + (np.arange(len(FEATURES)) == 0), 0)] * n).weights - prior.weights).max() for n in (0, 1, 4, 5, 300)]
    assert away[0] == 0 < away[1] < away[2] < away[3] < away[4] and away[3] < 1.3 * away[2]
    many = LineField.fit([(x, 1)] * 300 + [(x * 0 + (np.arange(len(FEATURES)) == 0), 0)] * 300)
    assert (many.decode(x @ many.weights) == 1).all() and (prior.decode(x @ prior.weights) == 0).all()
    assert (LineField.fit([(x, 1)] * 3).weights[0] > prior.weights[0])  # one label alone is no special case


def test_a_held_out_text_changes_no_other_score(spark, table_of, corpus):
    import zlib

    rows = [r for r in corpus if r[0] is not None]
    held = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 2)
    long = " ".join(f"w{k}q{k * k}" for k in range(60000))  # would ask for larger tables and more words a beginning
    changed = [(i, long if i == held else t, *more) for i, t, *more in rows]
    one, other = ({(r["doc_id"], r["n_tokens"]): (r["base_score"], r["score"]) for r in mixing_lm.lm_scores(table_of(spark.createDataFrame(x, SCHEMA), n)).collect() if r["doc_id"] != held} for x, n in ((rows, "one"), (changed, "other")))
    assert one.keys() == other.keys()
    for k, v in one.items():
        assert other[k] == pytest.approx(v, rel=1e-9)


def test_lm_uses_every_pair_of_words_and_whole_tokens(spark, table_of):
    """Any pair of neighbouring words predicts its next token, and a seen token does not cost its spelling."""
    rng = np.random.default_rng(3)
    passages = [" ".join(f"w{rng.integers(300)}" for _ in range(60)) for _ in range(6)]
    rows = [(k, f"{passages[k % 6]} w{rng.integers(300)}") for k in range(60)]
    data, offsets = np.frombuffer(" ".join(f"u{k}" for k in range(50)).encode(), np.uint8), np.array([0])
    assert len(mixing_lm._pairs(data, np.r_[offsets, len(data)])[0]) == 49
    got = mixing_lm.lm_scores(table_of(spark.createDataFrame(rows, "doc_id long, text string"), "pairs")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(np.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("often", [1, 1024])
def test_lm_contexts_are_packed_and_score_as_counted_by_hand(spark, table_of, monkeypatch, often):
    """What contexts add, counted in a plain way; a common context is not sent about as a row an occurrence, and blocks are small."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(40)] + ["of"] * 8
    rows = [(k, " ".join(rng.choice(words, 60)) if k % 9 else " ".join(f"w{j}" for j in range(30))) for k in range(120)] + [(200, None), (201, "one"), (202, "two words")]
    monkeypatch.setattr(mixing_lm, "OFTEN", often)
    monkeypatch.setattr(mixing_lm, "_CHUNK_PAIRS", 500)
    raw = table_of(spark.createDataFrame(rows, "t1 long, text string").selectExpr("t1", "0 t2", "crc32(cast(cast(t1 as string) as binary)) % 7 = 2 held_out", "coalesce(cast(text as binary), x'') raw"))
    held = {r["t1"]: r["held_out"] for r in raw.select("t1", "held_out").collect()}
    hash_of = lambda x: int(mixing_lm.w.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x)]))[0])
    keys = np.sort(np.array([hash_of(x) for x in (*words[:20], "of")], np.uint64))
    lp = -np.arange(1.0, len(keys) + 1)
    keys, first = np.unique(keys, return_index=True)
    hot = spark.sparkContext.broadcast((keys, lp[first], lp[first], lp[first]))
    counted = raw.mapInArrow(mixing_lm._emit_words, mixing_lm._VOCABULARY)
    found = counted.filter("word is null").groupBy("h").sum("total").withColumnRenamed("sum(total)", "total")
    assert found.count() > 0
    pairs = sum(max(len((t or "").split()) - 1, 0) for _, t in rows)
    got = mixing_lm._repeats(raw, found, pairs, hot).collect()
    # the same by hand
    seen = [(i, (x[k], x[k + 1]), hash_of([*x, "\n"][k + 2])) for i, t in rows for x in [(t or "").split()] for k in range(len(x) - 1)]
    nexts = collections.defaultdict(collections.Counter)
    for i, pair, token in seen:
        nexts[pair][token] += not held[i]
    told, cells = [], collections.Counter()
    signed = lambda h: h - (h >> 63 << 64)
    for i, pair, token in seen:
        guess = max(nexts[pair], key=lambda h: (nexts[pair][h], signed(h)))
        own, hit = not held[i], token == guess
        n, k = sum(nexts[pair].values()) - own, nexts[pair][guess] - (own and hit)
        if n > 0:
            cell = ((n + 1).bit_length() - 1, (n - k + 1).bit_length() - 1)
            told.append((i, cell, hit, token))
            cells[cell, hit] += own
    scores, spelled, by = collections.Counter(), collections.Counter(), dict(zip(keys.tolist(), lp[first].tolist()))
    for i, (s, x), hit, token in told:
        right = max(2.0**s - 2.0**x, 0)
        prior = (right + mixing_lm.PRIOR) / (right + 2.0**x - 1 + 2 * mixing_lm.PRIOR)
        p = (cells[(s, x), True] + 2 * prior) / (cells[(s, x), True] + cells[(s, x), False] + 2)
        scores[i] += np.log10(p if hit else 1 - p) - (by.get(token, 0) if hit else 0)
        if hit and token not in by:
            spelled[i, signed(token)] -= 1
    assert {r["t1"] for r in got} == {i for i, _ in rows} and sum(r["h"] is None for r in got) == len(rows)
    for i, _ in rows:
        assert sum(r["score"] for r in got if r["t1"] == i) == pytest.approx(scores[i])
    have = collections.Counter()
    for r in got:
        if r["h"] is not None:
            have[r["t1"], r["h"]] += r["spelled"]
    assert have == spelled and len(spelled) > 50


def test_lm_packs_a_pair_of_words_in_few_bytes(spark, table_of):
    rng = np.random.default_rng(9)
    rows = [(k, 0, False, " ".join(f"w{x}" for x in rng.integers(0, 3000, 500)).encode()) for k in range(400)]
    raw = table_of(spark.createDataFrame(rows, "t1 long, t2 int, held_out boolean, raw binary").coalesce(1))
    sc = spark.sparkContext
    keys = np.sort(mixing_lm.w.word_hashes(*_words_of([f"w{x}" for x in range(3000)])))
    none = sc.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    blocks = raw.mapInArrow(mixing_lm._blocks(sc.broadcast((keys,)), none, 16), mixing_lm._ddl(mixing_lm._BLOCK))
    size = sum(len(r[c] or b"") for r in blocks.collect() for c in ("texts", "tokens", "rare", "contexts", "sizes"))
    assert size < 12 * 400 * 499  # a row of its own takes 29


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_lm_blocks_of_one_occurrence_are_told(spark, n):
    """Parts of a block may hold a single number, and are written to like longer ones."""
    for kind in (np.int16, np.int32, np.uint64):
        given = np.arange(5, 5 + n).astype(kind)
        got = mixing_lm._unpacked(mixing_lm._packed(given), kind)
        assert got.dtype == kind and got.tolist() == given.tolist() and got.flags.writeable
    pack = mixing_lm._packed
    one = {"part": 0, "texts": pack(np.array([0], np.int32)), "tokens": pack(np.array([0], np.int32)), "rare": pack(np.array([7], np.uint64)), "contexts": pack(np.array([9], np.uint64)), "sizes": pack(np.array([1], np.int32))}
    hot = spark.sparkContext.broadcast((np.zeros(0, np.uint64),))  # no hot word: each token stands in the block's own list
    told = mixing_lm._tell(hot)(pa.table(mixing_lm._rows(mixing_lm._BLOCK, [one | {"chunk": k} for k in range(n % 7)]))).to_pylist()
    assert [r["chunk"] for r in told] == ([] if n % 7 < 2 else list(range(n % 7)))  # a context that stands once tells nothing


def _words_of(words):
    size = np.array([len(x) for x in words])
    ends = np.cumsum(size)
    return np.frombuffer("".join(words).encode(), np.uint8), ends - size, ends
