"""Quality and toxicity by co-training over two views.

The content view of a document is the set of its words' traits (a word and its beginnings, hashed into ``BUCKETS``
columns); the metadata view is what can be said without reading words: language, source, length, and the page's shape
(shares of characters and lines). Each view has a logistic classifier. Both start from the labelled rows. In each round
both score all documents of the corpus, those that one is sure of and that have no label become pseudo-labels, and the
other one learns from them, too: with their terms, languages and sources, which the labelled rows may never have shown.
Then each view's score is calibrated on labelled rows kept apart, and a logistic combination of the calibrated views
scores every document.

Each text is read once: its traits and shape go to a table in the shared folder, a few bytes for each distinct word,
which the rounds and the last scoring read. The classifiers are fitted on the driver on bounded samples, chosen by a
hash: ``labelled`` labelled rows, ``marks`` pseudo-labels for each label, view, side and round, and ``most_traits``
traits in all. Everything else covers all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept, settle, small_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, DIGIT, SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
LETTER = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = [b"!", b"$*%&#", b"|", b".,;:", b"<>{}[]", b"\n"]
SHAPES = 16
BUCKETS = 1 << 18
CARRY = 65535
LABELS = ("low", "toxic")
VIEWS = ("content", "meta")


def shape_of(raw: bytes) -> list[float]:
    """Shares of characters, words and lines; each between 0 and about 3."""
    n = len(raw)
    if not n:
        return [0.0] * SHAPES
    part = lambda chars: (n - len(raw.translate(None, chars))) / n
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    long_lines = [x for x in lines if len(x) > 20]
    return [part(UPPER), part(DIGIT), part(SPACE), part(LETTER), *(min(3.0, 10 * part(m)) for m in MARKS), np.log1p(n) / 10, min(3.0, (n - k) / k / 10), len(set(words)) / k, len(set(long_lines)) / max(1, len(long_lines)), min(3.0, k / len(lines) / 50), min(3.0, max(map(len, words), default=0) / 50)]


def traits(word: bytes) -> tuple[int, ...]:
    """Columns of a word and of its beginnings, which inflected forms share."""
    import xxhash

    return tuple({xxhash.xxh3_64_intdigest(f) % BUCKETS for f in (word, *(b"^" + word[:k] for k in (4, 6) if len(word) > k))})


def columns_of(raw: bytes, known: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Sorted columns of a text's traits; those of words are remembered in a bounded table."""
    words = set(WORD.findall(raw.lower()))
    if len(known) > 200_000:
        known.clear()
    own = [known.get(w) or known.setdefault(w, traits(w)) if len(w) < 100 else traits(w) for w in words]
    got = set().union(*own)
    out = np.fromiter(got, np.int32, len(got))
    out.sort()
    return out


def packed(columns: np.ndarray) -> bytes:
    """Sorted columns as 16-bit gaps; CARRY adds itself and goes on."""
    gaps = np.diff(columns, prepend=0)
    times = gaps // CARRY + 1
    out = np.full(int(times.sum()), CARRY, np.uint16)
    out[np.cumsum(times) - 1] = gaps % CARRY
    return out.tobytes()


def unpacked(blobs: list[bytes]) -> Rows:
    """The rows that ``packed`` made."""
    gaps = np.frombuffer(b"".join(blobs), np.uint16)
    sizes = np.array([len(b) // 2 for b in blobs], np.int64)
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)])
    value = sums[1:] - np.repeat(sums[ends - sizes], sizes)
    real = gaps != CARRY
    count = np.concatenate([[0], np.cumsum(real)])
    return Rows(value[real], np.concatenate([[0], count[ends]]), None, BUCKETS)


def telling(rows: Rows, labels: list[np.ndarray], least: int, most: int) -> np.ndarray:
    """For each label the ``most`` columns that tell most about it (chi-squared), of those that ``least`` rows have."""
    n = len(rows)
    owner = np.repeat(np.arange(n), np.diff(rows.start))
    total = np.bincount(rows.index, minlength=BUCKETS).astype(float)
    out = np.zeros(BUCKETS, bool)
    for y in labels:
        up = np.bincount(rows.index, weights=y[owner], minlength=BUCKETS)
        p = y.sum() / max(1, n)
        score = np.where(total >= least, (up - total * p) ** 2 / np.maximum(total * p * (1 - p) * (1 - total / max(1, n)), 1e-9), -1.0)
        best = np.argsort(-score, kind="stable")[:most]
        out[best[score[best] >= 0]] = True
    return out


@dataclass
class Logistic:
    """Weights of a view; fitted by Adam on the whole sample."""

    weights: np.ndarray
    bias: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        return rows.times(self.weights) + self.bias


@dataclass
class Rows:
    """Sparse rows with values 0 or 1, or dense rows."""

    index: np.ndarray | None
    start: np.ndarray | None
    dense: np.ndarray | None
    width: int

    def only(self, wanted: np.ndarray) -> Rows:
        """Without the columns that aren't wanted."""
        keep = wanted[self.index]
        return Rows(self.index[keep], np.concatenate([[0], np.cumsum(keep)])[self.start], None, self.width)

    def __len__(self) -> int:
        return len(self.dense) if self.dense is not None else len(self.start) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ w
        sums = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense.T @ r
        return np.bincount(self.index, weights=np.repeat(r, np.diff(self.start)), minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 150) -> Logistic:
    w, b = np.zeros(rows.width), 0.0
    m, v = np.zeros(rows.width + 1), np.zeros(rows.width + 1)
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        r = (sigmoid(rows.times(w) + b) - y) * weight / total
        g = np.append(rows.back(r) + ridge * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - 0.9 * t / steps)
        w, b = w - move[:-1], b - move[-1]
    return Logistic(w, b)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift, with his softened targets."""
    up, down = y.sum(), (1 - y).sum()
    soft = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    got = fit(Rows(None, None, np.clip(z, -20, 20)[:, None], 1), soft, np.ones(len(y)), 1e-3, 200)
    return float(max(got.weights[0], 0.0)), float(got.bias)


def _take(rows: Rows, at: np.ndarray) -> Rows:
    if rows.dense is not None:
        return Rows(None, None, rows.dense[at], rows.width)
    sizes = rows.start[at + 1] - rows.start[at]
    start = np.concatenate([[0], np.cumsum(sizes)])
    return Rows(rows.index[np.repeat(rows.start[at] - start[:-1], sizes) + np.arange(start[-1])], start, None, rows.width)


def _joined(a: Rows, b: Rows) -> Rows:
    if a.dense is not None:
        return Rows(None, None, np.concatenate([a.dense, b.dense]), a.width)
    return Rows(np.concatenate([a.index, b.index]), np.concatenate([a.start, a.start[-1] + b.start[1:]]), None, a.width)


@dataclass
class Meta:
    """How metadata become columns: shapes are centred, languages and sources are told apart as far as the rows that
    the view learns from show them."""

    mean: np.ndarray
    scale: np.ndarray
    categories: dict[tuple[str, str], int]

    @classmethod
    def of(cls, shapes: np.ndarray, langs: list, sources: list, most: int = 2000) -> Meta:
        seen: dict[tuple[str, str], int] = {}
        for pair in zip(langs, sources, strict=True):
            for kind, value in zip(("lang", "source"), pair, strict=True):
                if value is not None:
                    seen[(kind, value)] = seen.get((kind, value), 0) + 1
        often = sorted(seen, key=lambda k: (-seen[k], k))[:most]
        return cls(shapes.mean(0) if len(shapes) else np.zeros(SHAPES), np.maximum(shapes.std(0), 1e-3) if len(shapes) else np.ones(SHAPES), {k: n for n, k in enumerate(often)})

    def rows(self, shapes: np.ndarray, langs: list, sources: list) -> Rows:
        x = np.clip((shapes - self.mean) / self.scale, -6, 6)
        marks = np.zeros((len(x), len(self.categories)))
        for k, pair in enumerate(zip(langs, sources, strict=True)):
            for kind, value in zip(("lang", "source"), pair, strict=True):
                if (at := self.categories.get((kind, value))) is not None:
                    marks[k, at] = 1
        dense = np.concatenate([x, x * x / 6, marks], axis=1)
        return Rows(None, None, dense, dense.shape[1])


@dataclass
class Model:
    """For each label and view a classifier, the scale and shift that calibrate it, and for each label how the two
    calibrated views are combined (two weights, shift)."""

    meta: Meta
    views: dict[tuple[str, str], Logistic]
    calibration: dict[tuple[str, str], tuple[float, float]]
    mixture: dict[str, tuple[float, float, float]]

    def chances(self, content: Rows, meta: Rows, label: str) -> tuple[np.ndarray, np.ndarray]:
        """What each view says by itself."""
        return tuple(sigmoid(self.views[label, v].raw(x)) for v, x in zip(VIEWS, (content, meta), strict=True))

    def score(self, content: Rows, meta: Rows, label: str) -> np.ndarray:
        a, b = (np.clip(s * self.views[label, v].raw(x) + h, -12, 12) for v, x in zip(VIEWS, (content, meta), strict=True) for s, h in [self.calibration[label, v]])
        first, second, shift = self.mixture[label]
        return sigmoid(first * a + second * b + shift)


@dataclass
class Sample:
    """Rows that classifiers learn from."""

    content: Rows
    shapes: np.ndarray
    langs: list
    sources: list
    labels: dict[str, np.ndarray]

    @classmethod
    def of(cls, rows: list, labels: dict[str, np.ndarray]) -> Sample:
        """From rows (words, shape, lang, source)."""
        return cls(unpacked([r[0] for r in rows]), np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), SHAPES).astype(float), [r[2] for r in rows], [r[3] for r in rows], labels)


def learn(sample: Sample, free: Sample, told: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]], least: int, most: int) -> Model:
    """Classifiers from the labelled ``sample`` and, at half weight, from those rows of ``free`` that the other view
    has marked. A fifth of the labelled rows only calibrates."""
    n = len(sample.langs)
    content, meta_of = sample.content, Meta.of(np.concatenate([sample.shapes, free.shapes]), sample.langs + free.langs, sample.sources + free.sources)
    own, others = meta_of.rows(sample.shapes, sample.langs, sample.sources), meta_of.rows(free.shapes, free.langs, free.sources)
    model = Model(meta_of, {}, {}, {})
    for label in LABELS:
        y = sample.labels[label]
        if len(set(y.tolist())) < 2:  # nothing to tell apart
            p = (y.sum() + 0.5) / (n + 1) if n else 0.0
            model.mixture[label] = (0.0, 0.0, float(np.log(max(p, 1e-6) / (1 - min(p, 1 - 1e-6)))))
            for v, width in zip(VIEWS, (BUCKETS, own.width), strict=True):
                model.views[label, v], model.calibration[label, v] = Logistic(np.zeros(width)), (0.0, 0.0)
            continue
        apart = np.arange(n) % 5 == 4
        if not (0 < y[apart].sum() < apart.sum() and 0 < y[~apart].sum() < (~apart).sum()):
            apart = np.zeros(n, bool)
        train, held = np.flatnonzero(~apart), np.flatnonzero(apart) if apart.any() else np.arange(n)
        raws = []
        for v, rows, more, ridge in ((VIEWS[0], content, free.content, 3e-4), (VIEWS[1], own, others, 1e-3)):
            at, marked = told.get((label, v), (np.zeros(0, int), np.zeros(0)))
            learnt, ys = _joined(_take(rows, train), _take(more, at)), np.concatenate([y[train], marked])
            if v == "content":
                learnt = learnt.only(telling(learnt, [ys], least, most))
            weight = np.concatenate([np.ones(len(train)), np.full(len(at), 0.5)])
            model.views[label, v] = fit(learnt, ys, weight, ridge)
            raws.append(model.views[label, v].raw(_take(rows, held)))
        for v, z in zip(VIEWS, raws, strict=True):
            model.calibration[label, v] = _calibrated(z, y[held])
        both = np.stack([np.clip(s * z + h, -12, 12) for z, v in zip(raws, VIEWS, strict=True) for s, h in [model.calibration[label, v]]], axis=1)
        mix = fit(Rows(None, None, both, 2), y[held], np.ones(len(held)), 1e-3, 200)
        weights = np.maximum(mix.weights, 0)
        model.mixture[label] = (float(weights[0]), float(weights[1]), float(mix.bias))
    return model


def traits_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, mark, lang, source, words, shape) for each row: all that the views see; ``mark`` hashes the text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        known = kept(("traits",), dict)
        for batch in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            words = pa.array([packed(columns_of(r, known)) for r in raws], pa.binary())
            shapes = pa.array([np.array(shape_of(r), np.float32).tobytes() for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], words, shapes], ["id", "mark", "lang", "source", "words", "shape"])

    return rows.mapInArrow(run, f"id {id_type}, mark long, lang string, source string, words binary, shape binary")


def _views_of(model: Model, batch: pa.RecordBatch) -> tuple[Rows, Rows]:
    shapes = np.frombuffer(b"".join(batch.column("shape").to_pylist()), np.float32).reshape(batch.num_rows, SHAPES)
    return unpacked(batch.column("words").to_pylist()), model.meta.rows(shapes.astype(float), batch.column("lang").to_pylist(), batch.column("source").to_pylist())


def sure_rows(features: DataFrame, model: Model, turn: int, sure: float, marks: int) -> DataFrame:
    """(label, view, side, rank, id, mark): of all rows, those that a view is sure of; each task gives ``marks`` for each
    label, view and side at most, by a hash."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    rows = features.select("id", "mark", "lang", "source", "words", "shape", F.xxhash64("id", "mark", F.lit(turn)).alias("rank"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        best: dict[tuple, list[tuple]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            if not batch.num_rows:
                continue
            content, meta = _views_of(shared.value, batch)
            rank, ids, names = batch.column("rank").to_numpy(), batch.column("id").to_pylist(), batch.column("mark").to_pylist()
            for label in LABELS:
                for view, p in zip(VIEWS, shared.value.chances(content, meta, label), strict=True):
                    for side, which in ((1, p >= sure), (0, p <= 1 - sure)):
                        own = best.setdefault((label, view, side), [])
                        own.extend((int(rank[k]), ids[k], names[k]) for k in np.flatnonzero(which))
                        if len(own) > 4 * marks:
                            own.sort(key=lambda x: x[0])
                            del own[marks:]
        out = [(*group, *x) for group, own in best.items() for x in sorted(own, key=lambda x: x[0])[:marks]]
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), kind, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["label", "view", "side", "rank", "id", "mark"])

    return rows.mapInArrow(run, f"label string, view string, side int, rank long, id {id_type}, mark long")


def _told(features: DataFrame, known: DataFrame, model: Model, turn: int, sure: float, marks: int) -> tuple[list, dict]:
    """Pseudo-labels: the rows, and for each label and view which rows the *other* view marks, and as what."""
    found = settle(sure_rows(features, model, turn, sure, marks), "sure")
    open_ = settle(found.join(known.select("id"), "id", "left_anti").where("id is not null"), "sure")
    names: dict[tuple, int] = {}
    told: dict[tuple[str, str], tuple[list, list]] = {}
    for label in LABELS:
        for view, other in zip(VIEWS, VIEWS[::-1], strict=True):
            for side in (1, 0):
                for r in open_.where((F.col("label") == label) & (F.col("view") == view) & (F.col("side") == side)).orderBy("rank", "id").limit(marks).collect():
                    at, as_what = told.setdefault((label, other), ([], []))
                    at.append(names.setdefault((r.id, r.mark), len(names)))
                    as_what.append(float(side))
    forget(found, open_)
    spark = features.sparkSession
    wanted = spark.createDataFrame([(k, m, n) for (k, m), n in names.items()], f"id {features.schema['id'].dataType.simpleString()}, mark long, place int")
    got: list = [None] * len(names)
    for r in features.join(F.broadcast(wanted), ["id", "mark"]).select("place", "words", "shape", "lang", "source").toLocalIterator():
        got[r.place] = (bytes(r.words), bytes(r.shape), r.lang, r.source)
    return got, {k: (np.array(a, int), np.array(b)) for k, (a, b) in told.items()}


def fit_on(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = 6000, marks: int = 300, rounds: int = 2, sure: float = 0.95, least: int = 4, most: int = 1500, most_traits: int = 16_000_000) -> Model:
    """A model from the ``features`` of all documents and from ``labels`` (id, quality, toxic). Labels with nulls don't
    count; of several labels of one id the worst holds. Which rows are taken depends on ids and texts alone."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), (1 - F.col("quality")).alias("low"), F.col("toxic").alias("toxic")).dropna()
    known = settle(known.groupBy("id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic")), "labels")
    some = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    taken, size = [], 0
    for r in features.join(F.broadcast(some), "id").orderBy(F.xxhash64("id"), "id", "mark").select("words", "shape", "lang", "source", "low", "toxic").limit(labelled).toLocalIterator():
        size += len(r.words) // 2
        if size > most_traits:
            break
        taken.append((bytes(r.words), bytes(r.shape), r.lang, r.source, float(r.low), float(r.toxic)))
    sample = Sample.of(taken, {label: np.array([r[4 + k] for r in taken]) for k, label in enumerate(LABELS)})
    model = learn(sample, Sample.of([], {}), {}, least, most)
    for turn in range(rounds if taken else 0):
        rows, told = _told(features, known, model, turn, sure, marks)
        if not told:
            break
        model = learn(sample, Sample.of(rows, {}), told, least, most)
    forget(known)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", reject_low: float = 0.5, reject_toxic: float = 0.3, **fitting) -> DataFrame:
    """A row for each document row: its id, p_low, p_toxic (rounded to six places) and rejected. ``fitting``: see
    ``fit_on``. Null texts count as empty; an empty table gives no rows, and without usable labels nothing is rejected."""
    spark = docs.sparkSession
    features = settle(traits_of(docs, id_col), "traits")
    shared = spark.sparkContext.broadcast(fit_on(features, labels, id_col, **fitting))
    id_type = features.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                content, meta = _views_of(shared.value, batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.round(shared.value.score(content, meta, k), 6)) for k in LABELS)], ["id", "p_low", "p_toxic"])

    scored = settle(features.mapInArrow(run, f"id {id_type}, p_low double, p_toxic double"), "scores")
    forget(features)
    return scored.select(F.col("id").alias(id_col), "p_low", "p_toxic", ((F.col("p_low") >= reject_low) | (F.col("p_toxic") >= reject_toxic)).alias("rejected"))
