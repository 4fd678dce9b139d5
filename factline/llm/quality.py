"""Quality rules, and line labelling with a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import words as w

SYMBOLS = b"#*$%&|<>"
FEATURES = ("one", "short", "long", "symbols", "upper", "digits", "marks", "shouted", "ends well", "starts well", "echo", "no letters", "word length")
CONTENT, BOILERPLATE = 0, 1
TRAIN_DOCS = 1000  # bound of the labelled sample that the field is fitted on; its texts are taken whole
SEGMENT = 64  # lines after which a training chain is cut in two


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS = {
    "symbol": _table(SYMBOLS),
    "upper": _table(bytes(range(65, 91))),
    "letter": _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])),
    "digit": _table(b"0123456789"),
    "mark": _table(b"#*$%&|<>~^=_{}[]\\/@+"),
    "shout": _table(b"!"),
    "start": ~_table(bytes(range(0x80, 0xC0))),
    "space": _table(bytes([0x20, *range(0x09, 0x0E)])),
    "end": _table(b".!?:;\"')"),
}


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every \\n-split line, and each text's first line (n + 1); every text has a line."""
    breaks = np.flatnonzero(data == 10)
    firsts = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    of = np.searchsorted(offsets[1:], breaks, "right")  # texts may be empty
    ends = np.empty(firsts[-1], np.int64)
    at = np.arange(len(breaks)) + of
    ends[at] = breaks
    ends[firsts[1:] - 1] = offsets[1:]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[firsts[:-1]] = offsets[:-1]
    return starts, ends, firsts


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES, in 0 to 1, for every line; and its number of words."""

    def count(name: str) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_IS[name][data], out=sums[1:])
        return (sums[ends] - sums[starts]).astype(float)

    a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    n = (b - a).astype(float)
    echo = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        echo[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    echoes = np.where(b > a, echo[b] - echo[np.minimum(a + 1, b)], 0)
    size = np.maximum(ends - starts, 1).astype(float)
    letters = count("letter")
    safe = np.maximum(letters, 1)
    last, first = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    some = ends > starts
    last[some] = _IS["end"][data[ends[some] - 1]]
    first[some] = _IS["upper"][data[starts[some]]] | (data[starts[some]] >= 0x80)
    rows = [
        np.ones(len(starts)), n < 4, n >= 12, np.minimum(1, 8 * count("symbol") / size), np.minimum(1, count("upper") / safe), np.minimum(1, 4 * count("digit") / size),
        np.minimum(1, 8 * count("mark") / size), np.minimum(1, 12 * count("shout") / size), last, first, echoes / np.maximum(n, 1), letters == 0, np.minimum(1, letters / np.maximum(n, 1) / 12),
    ]
    return np.stack([np.asarray(r, float) for r in rows], 1), b - a


class LineField:
    """A two-label chain: label scores linear in the features, and a score for each step."""

    #: What the field is before it has seen a label, and what its fit is held to: marks and shouting speak for boilerplate, and labels last.
    PRIOR = {"one": -1.5, "symbols": 3.0, "marks": 2.0, "shouted": 3.0, "upper": 2.0, "echo": 3.0, "no letters": 2.0}

    PRIOR_STEPS = ((0.5, -0.5), (-0.5, 0.5))

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.array([self.PRIOR.get(f, 0.0) for f in FEATURES]) if weights is None else weights
        self.steps = np.array(self.PRIOR_STEPS) if steps is None else steps

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Most probable labels of one text's lines. scores: boilerplate over content, by line."""
        (cc, cb), (bc, bb) = self.steps.tolist()
        c, b, back = 0.0, 0.0, []
        for k, s in enumerate(scores.tolist()):
            if k:
                from_c, from_b = c + cb > b + bb, c + cc >= b + bc
                back.append((from_b, from_c))
                c, b = (c + cc if from_b else b + bc), (c + cb if from_c else b + bb)
            b += s
        label = BOILERPLATE if b > c else CONTENT
        out = [label]
        for from_b, from_c in reversed(back):
            stay_c = from_b if label == CONTENT else from_c
            label = CONTENT if stay_c else BOILERPLATE
            out.append(label)
        return np.array(out[::-1])

    @classmethod
    def fit(cls, texts: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.15, ridge: float = 1.0, step_ridge: float = 50.0) -> LineField:
        """Ascend the posterior: conditional likelihood, and a normal prior around the unfitted field.

        texts: features of all of a text's lines, and their common label. ridge and step_ridge,
        the prior's precisions, weigh as much as so many texts: one rule for any number of
        labels, which without texts, or far from them, gives the unfitted field.

        Chains are cut into segments of SEGMENT lines: every line and all steps but one in
        SEGMENT count, and a round takes SEGMENT vector steps whatever the longest text. Both
        labels weigh alike, and so do all texts of a label. As one text's lines share a label,
        no step between labels is ever seen; step_ridge holds the scores of steps back.
        """
        if not texts:
            return cls()
        labels = np.array([y for _, y in texts])
        alike = 0.5 / np.bincount(labels, minlength=2)[labels] * len(texts) / np.array([len(f) for f, _ in texts])
        parts = [(f[lo : lo + SEGMENT], y, v) for (f, y), v in zip(texts, alike.tolist(), strict=True) for lo in range(0, len(f), SEGMENT)]
        parts.sort(key=lambda p: -len(p[0]))
        lengths = np.array([len(p[0]) for p in parts])
        y, weigh = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
        live = [int((lengths > t).sum()) for t in range(lengths[0])]
        to = np.cumsum([0, *live])  # lines lie by place in their segment, then by segment
        x = np.concatenate([np.stack([p[0][t] for p in parts[:k]]) for t, k in enumerate(live)])
        prior = cls()
        centre, m, v = np.r_[prior.weights, prior.steps.ravel()], 0.0, 0.0
        theta, keep = centre.copy(), np.r_[np.full(len(FEATURES), ridge), np.full(4, step_ridge)] / len(texts)
        for r in range(1, rounds + 1):
            steps, s = theta[-4:].reshape(2, 2), x @ theta[:-4]
            fwd, bwd = np.zeros((len(x), 2)), np.zeros((len(x), 2))
            fwd[: live[0], 1] = s[: live[0]]
            for t in range(1, len(live)):
                k, a, b = live[t], to[t - 1], to[t]
                fwd[b : b + k] = np.logaddexp(fwd[a : a + k, :1] + steps[0], fwd[a : a + k, 1:] + steps[1])
                fwd[b : b + k, 1] += s[b : b + k]
            for t in range(len(live) - 2, -1, -1):
                k, a, b = live[t + 1], to[t], to[t + 1]
                onward = bwd[b : b + k].copy()
                onward[:, 1] += s[b : b + k]
                bwd[a : a + k] = np.logaddexp(steps[:, 0] + onward[:, :1], steps[:, 1] + onward[:, 1:])
            z = np.logaddexp(*fwd[to[lengths - 1] + np.arange(len(parts))].T)
            of = np.concatenate([np.arange(k) for k in live])
            p = np.exp(np.minimum(fwd[:, 1] + bwd[:, 1] - z[of], 0))
            grad = ((y[of] - p) * weigh[of]) @ x
            here = np.concatenate([np.arange(to[t], to[t] + live[t + 1]) for t in range(len(live) - 1)]).astype(np.int64) if len(live) > 1 else np.zeros(0, np.int64)
            after = np.arange(live[0], len(x))
            pair = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    e = fwd[here, a] + steps[a, b] + (s[after] if b else 0) + bwd[after, b] - z[of[after]]
                    seen = ((lengths - 1) * ((y == a) & (y == b)) * weigh).sum()
                    pair[a, b] = seen - (np.exp(np.minimum(e, 0)) * weigh[of[after]]).sum()
            g = np.r_[grad, pair.ravel()] / len(texts) - keep * (theta - centre)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (1 - (r - 1) / rounds) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return cls(theta[:-4], theta[-4:].reshape(2, 2))


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's features, a row of single-precision numbers a line."""
    for batch in batches:
        rows = []
        for _, _, data, offsets in w.slices(batch):
            starts, ends, _ = w.boundaries(data, offsets)
            a, b, firsts = lines_of(data, offsets)
            found = line_features(data, a, b, starts, w.word_hashes(data, starts, ends))[0].astype(np.float32)
            rows += [found[lo:hi].tobytes() for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(rows, pa.binary())], ["label", "features"])


def fit_field(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fit on at most TRAIN_DOCS labelled texts, half of either label, those with the least hash of the id.

    labels: (id, quality 0/1); an id labelled both ways is bad. All lines of a text of quality 0
    count as boilerplate. Texts are whole; the driver gets 52 bytes a line of them. Of several
    rows with one id the least text counts; null and empty texts are left out. Without
    labelled texts the field is its prior, with a few it is near it (LineField.fit).
    """
    if labels is None:
        return LineField()
    few = labels.toDF("_lid", "_q").filter("_lid is not null and _q in (0, 1)").groupBy("_lid").agg(F.min("_q").alias("_q"))
    few = few.withColumn("_h", F.md5(F.col("_lid").cast("string")))
    good, bad = (few.filter(F.col("_q") == q).orderBy("_h", "_lid").limit(TRAIN_DOCS // 2) for q in (1, 0))
    few = good.union(bad)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("raw")).filter("raw <> ''").join(F.broadcast(few.select("_lid", "_q")), F.col("_id") == F.col("_lid"))
    rows = rows.groupBy("_id").agg(F.min("raw").alias("raw"), (1 - F.min("_q")).cast("int").alias("label")).orderBy("_id")
    found = rows.select("label", F.col("raw").cast("binary").alias("raw")).mapInArrow(_line_features, "label int, features binary").collect()
    return LineField.fit([(np.frombuffer(r["features"], np.float32).reshape(-1, len(FEATURES)).astype(float), r["label"]) for r in found])


def _judge(field: LineField, min_words: int, most_repeats: int, least_content: float):
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in w.slices(batch):
                starts, ends, firsts = w.boundaries(data, offsets)
                hashes = w.word_hashes(data, starts, ends)
                grams = w.ngram_hashes(hashes, 3)
                a, b, line_firsts = lines_of(data, offsets)
                features, line_words = line_features(data, a, b, starts, hashes)
                scores = features @ field.weights

                def total(mask: np.ndarray, data=data, offsets=offsets) -> np.ndarray:
                    sums = np.zeros(len(data) + 1, np.int64)
                    np.cumsum(mask[data], out=sums[1:])
                    return np.diff(sums[offsets])

                n_words = np.diff(firsts)
                repeats, dups, shares, marks = [], [], [], []
                for k in range(hi - lo):
                    f, n = int(firsts[k]), int(n_words[k])
                    covered = 0
                    if n > 3:
                        own = grams[f : f + n - 2]
                        order = np.argsort(own, kind="stable")
                        same = own[order[1:]] == own[order[:-1]]
                        if same.any():
                            hit = np.zeros(n, bool)
                            at = order[np.r_[same, False] | np.r_[False, same]]
                            for d in range(3):
                                hit[at + d] = True
                            covered = int(hit.sum())
                    repeats.append(covered)
                    at = slice(int(line_firsts[k]), int(line_firsts[k + 1]))
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    worded = [t for t, c in zip(text.split(b"\n"), line_words[at].tolist(), strict=True) if c]
                    dups.append(len(worded) - len(set(worded)))
                    label = field.decode(scores[at])
                    content = int(line_words[at][label == CONTENT].sum())
                    shares.append(content / n if n else 0.0)
                    marks.append("".join("CB"[x] for x in label))
                failed = (n_words < min_words) | (100 * np.array(repeats) > most_repeats * n_words)
                share = np.array(shares)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].slice(lo, hi - lo), pa.array(n_words), pa.array(total(_IS["start"] & ~_IS["space"])), pa.array(total(_IS["symbol"])), pa.array(dups, pa.int64()),
                        pa.array(repeats, pa.int64()), pa.array(failed), pa.array(~failed & (share >= least_content)), pa.array(share), pa.array(marks, pa.string()),
                    ], names,
                )

    return w.tidy(run)


def quality_lines(docs: DataFrame, labels: DataFrame | None = None, min_words: int = 50, most_repeats: int = 50, least_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base rules, then Viterbi labels of every line; the share of words in content lines decides.

    The field (LineField) is fitted on a bounded labelled sample, see fit_field; everything
    else covers every row and whole texts. Returns id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, content_share and line_labels (C or B, one
    letter a line).

    A row fails the base rules with fewer than min_words words, or if more than most_repeats
    percent of its words lie in 3-word windows found twice in it. It is kept if it passes and
    at least least_content of its words lie in content lines. Nulls: a null text has no words
    and fails; a null id is carried. Repeated rows are judged alike. Empty tables give no rows;
    extra columns are not read.
    """
    field = fit_field(docs, labels, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    out = raw.mapInArrow(_judge(field, min_words, most_repeats, least_content), f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, line_labels string")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_lines keeps, with all their columns, in one pass.

    Nulls, empty texts, repeated rows and empty tables: as there; columns of any name are carried.
    """
    field = fit_field(docs, labels, id_col, text_col)
    judge = _judge(field, 50, 50, 0.5)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch[text_col].cast(pa.binary()).fill_null(b"")
            named = pa.RecordBatch.from_arrays([batch[id_col], text], ["id", "raw"])
            kept = [r["kept"] for r in judge(iter([named]))]
            yield batch.filter(pa.concat_arrays(kept)) if kept else batch

    return docs.mapInArrow(run, schema)
