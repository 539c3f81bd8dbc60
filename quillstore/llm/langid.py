"""Language identification of mixed-language text.

Each word gets a score per language (naive Bayes over hashed character n-grams
of the word), script ranges rule languages out, and the best path through all
words of a text, where each switch of language costs a penalty, labels spans.
All of it runs on whole Arrow batches: words of many texts advance together.
"""

from __future__ import annotations

import pickle
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_batches, filter_rows

#: First code points of script ranges, and the script that starts there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Indic"), (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})


@dataclass(frozen=True)
class Options:
    """buckets: hashed n-grams; top: longest n-gram; smoothing: added to counts; switch_cost: log units for a change
    of language; min_script_share: below this share of its words a language does not use a script;
    max_rows: bound of the labelled sample a model is fitted on, the rows with the least hash."""

    buckets: int = 1 << 15
    top: int = 4
    smoothing: float = 0.5
    switch_cost: float = 12.0
    min_script_share: float = 0.001
    max_rows: int = 20_000


@dataclass
class Model:
    languages: list
    weights: np.ndarray  # buckets x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def letters() -> np.ndarray:
    """Marks the code points that are letters, built once per worker."""
    cache = K.process_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points of all texts, starts, ends, text) of the maximal runs of letters."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    inside = letters()[points]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([len(t) + 1 for t in low])
    return points, starts, ends, np.searchsorted(bounds, starts, side="right")


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, options: Options):
    """Bucket of each n-gram, word by word: n-grams of 1 to top code points inside a word, its bounds included."""
    padded = np.where(letters()[points], points, 0).astype(K.U)  # a bound is 0
    out, order = [], []
    word_at = np.zeros(len(points) + 1, np.int64)
    word_at[starts] = 1
    word_at = np.cumsum(word_at) - 1
    h = np.zeros(len(padded), K.U)
    for n in range(1, options.top + 1):
        h = h[: len(padded) - n + 1] * K.U(0x9E3779B97F4A7C15) + padded[n - 1 :] + K.U(1)
        at = np.arange(len(h))
        mid = at + (n - 1) // 2  # this one and all but the outer two must be letters; it decides the word
        ok = padded[mid] > 0
        for j in range(n):
            if 0 < j < n - 1:
                ok &= padded[j : len(padded) - n + 1 + j] > 0
        if n == 1:
            ok = padded > 0
        out.append((K.splitmix(h[ok] ^ K.U(n)) & K.U(options.buckets - 1)).astype(np.int64))
        order.append(word_at[mid[ok]])
    return np.concatenate(out), np.concatenate(order)


def word_scripts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of the first letter of each word, as an index into SCRIPT_NAMES."""
    of = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
    return of[np.searchsorted([c for c, _ in SCRIPTS], points[starts], side="right") - 1]


#: Words of a segment in best_paths.
SEGMENT = 64


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, cost: float) -> np.ndarray:
    """Viterbi labels of all words.  scores: words x languages; first, count: of each text.

    Texts are cut into segments that advance side by side: first each segment's best score from any state before it to
    any state at its end, then the states at all cuts from segment to segment, then the paths inside.  A long text thus
    takes as many steps as it has segments, not words.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    parts = -(-count // SEGMENT)
    total = int(parts.sum())
    if not total:
        return labels
    text = np.repeat(np.arange(len(count)), parts)
    at = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)  # number of a segment in its text
    start = first[text] + at * SEGMENT
    size = np.minimum(SEGMENT, count[text] - at * SEGMENT)
    order = np.argsort(-size, kind="stable")  # the segments with more than t words come first
    start, size = start[order], size[order]
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(SEGMENT + 1)]
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)

    def step(state):
        """(scores before the next word, whether each state is kept, the best state)."""
        best = state.argmax(-1)
        jump = np.take_along_axis(state, best[..., None], -1) - cost
        stay = state >= jump
        return np.where(stay, state, jump), stay, best

    through = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -cost), (total, k, k)).copy()
    for t in range(SEGMENT):
        m = active[t]
        if not m:
            break
        before = through[:m] if t == 0 else step(through[:m])[0]
        through[:m] = before + scores[start[:m] + t][:, None, :]
    # From cut to cut; texts with more segments first.
    by = np.argsort(-parts, kind="stable")
    head = np.cumsum(parts) - parts
    alive = [int(np.searchsorted(-parts[by], -j, side="left")) for j in range(int(parts.max()) + 1)]
    enter = np.zeros((total, k))
    state = np.zeros((len(count), k))
    for j in range(int(parts.max())):
        own = by[: alive[j]]
        seg = place[head[own] + j]
        enter[seg] = state[own]
        state[own] = (state[own][:, :, None] + through[seg]).max(1)
    # Inside, with back pointers.
    back = np.zeros((n, k), np.int8 if k <= 128 else np.int32)
    inner = enter.copy()
    states = np.arange(k)
    for t in range(SEGMENT):
        m = active[t]
        if not m:
            break
        moved, stay, best = step(inner[:m])
        word = start[:m] + t
        back[word] = np.where(stay, states, best[:, None])
        inner[:m] = moved + scores[word]
    origin = np.broadcast_to(states, (total, k)).copy()  # state before a segment, by the state at its end
    for t in range(SEGMENT - 1, -1, -1):
        m = active[t]
        origin[:m] = np.take_along_axis(back[start[:m] + t].astype(np.int64), origin[:m], 1)
    end = np.zeros(total, np.int64)
    current = inner[place[np.maximum(head + parts - 1, 0) % total]].argmax(1)
    for j in range(int(parts.max()) - 1, -1, -1):
        own = by[: alive[j]]
        seg = place[head[own] + j]
        end[seg] = current[own]
        current[own] = origin[seg, current[own]]
    for t in range(SEGMENT - 1, -1, -1):
        m = active[t]
        word = start[:m] + t
        labels[word] = end[:m]
        end[:m] = back[word, end[:m]]
    return labels


def label_words(texts: list[str], model: Model, options: Options):
    """(starts, ends, text, language of each word) of some texts."""
    points, starts, ends, row = word_spans(texts)
    if not len(starts) or not model.languages:
        return starts, ends, row, np.zeros(len(starts), np.int64)
    bucket, word = grams(points, starts, ends, options)
    scores = np.stack([np.bincount(word, model.weights[bucket, k], len(starts)) for k in range(len(model.languages))], 1)
    allowed = model.allowed[word_scripts(points, starts)]
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), scores, scores - 1e3)
    count = np.bincount(row, minlength=len(texts))
    return starts, ends, row, best_paths(scores, np.cumsum(count) - count, count, options.switch_cost)


def _groups(column: pa.Array, size: int = 1 << 19):
    """Lists of texts of bounded length, with the index of their first row; null is empty."""
    K.trim_memory()
    at, texts, n = 0, [], 0
    for i, t in enumerate(x.as_py() for x in column):
        texts.append(t or "")
        n += len(texts[-1])
        if n >= size:
            yield at, texts
            at, texts, n = i + 1, [], 0
    if texts:
        yield at, texts
    K.trim_memory()


def fit(labelled: DataFrame, options: Options | None = None) -> Model:
    """A model from rows (doc_id, text, lang) with a language and a text: the ``max_rows`` rows with the least hash of
    doc_id, in whole.  Counts are summed by executors; the driver gets the hashed counts only."""
    options = options or Options()
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    pick = F.xxhash64(F.col("doc_id"))
    edge = rows.select(pick.alias("h")).orderBy("h").limit(options.max_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return Model([], np.zeros((options.buckets, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                for _, texts in _groups(batch.column(0).filter(pa.array(langs == lang))):
                    points, starts, ends, _ = word_spans(texts)
                    if len(starts):
                        got = np.bincount(grams(points, starts, ends, options)[0], minlength=options.buckets)
                        got = np.concatenate([got, np.bincount(word_scripts(points, starts), minlength=len(SCRIPT_NAMES))])
                        total[lang] = total.get(lang, 0) + got
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))], names=["lang", "bucket", "n"])

    sample = rows.where(pick <= edge).select("text", "lang")
    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(counts["lang"].unique().to_pylist())
    n = np.zeros((options.buckets + len(SCRIPT_NAMES), len(languages)))
    number = {lang: i for i, lang in enumerate(languages)}
    n[counts["bucket"].to_numpy(), np.array([number[x] for x in counts["lang"].to_pylist()], np.int64)] = counts["n"].to_numpy()
    gram, script = n[: options.buckets], n[options.buckets :]
    weights = np.log(gram + options.smoothing) - np.log(gram.sum(0) + options.smoothing * options.buckets)
    allowed = script >= options.min_script_share * np.maximum(script.sum(0), 1)
    return Model(languages, weights.astype(np.float64), allowed & (script > 0))


def predict(texts: list[str], model: Model, options: Options) -> tuple[list[str], np.ndarray]:
    """Language with most letters on the best path, and its share of the letters; ``und`` and 0 without letters."""
    starts, ends, row, label = label_words(texts, model, options)
    size = max(len(model.languages), 1)
    share = np.bincount(row * size + label, ends - starts, len(texts) * size).reshape(-1, size)
    total = share.sum(1)
    best = share.argmax(1)
    score = np.where(total > 0, share[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
    known = (total > 0) & bool(model.languages)
    return [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _shared(docs: DataFrame, model: Model, options: Options):
    bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.languages, model.weights, model.allowed, options)))


def _open(shared):
    languages, weights, allowed, options = pickle.loads(shared.value)
    return Model(languages, weights, allowed), options


def identify(docs: DataFrame, model: Model, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).  Only the text is looked at.

    A null or empty text, or one without letters, is ``und`` with score 0, and so is each if the model knows no
    language; ties go to the first language by name; repeated rows are predicted each; an empty table gives no rows; a
    long text is one row, cut into segments that advance side by side."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = _shared(docs, model, options or Options())

    def run(batches):
        model, options = _open(shared)
        for batch in batches:
            for at, texts in _groups(batch.column(1)):
                lang, score = predict(texts, model, options)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.dtypes[0][1]}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labelled spans of each text: doc_id, span (from 0), lang, n_words, n_letters.  Texts without letters have none."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = _shared(docs, model, options or Options())

    def run(batches):
        model, options = _open(shared)
        for batch in batches:
            for at, texts in _groups(batch.column(1)):
                starts, ends, row, label = label_words(texts, model, options)
                if not len(row) or not model.languages:
                    continue
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (label[1:] != label[:-1]))))
                of = row[new]
                number = np.arange(len(new)) - np.searchsorted(of, of, side="left")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at + of)),
                        pa.array(number),
                        pa.array([model.languages[k] for k in label[new]], pa.string()),
                        pa.array(np.diff(np.append(new, len(row)))),
                        pa.array(np.add.reduceat(ends - starts, new)),
                    ],
                    names=["doc_id", "span", "lang", "n_words", "n_letters"],
                )

    return slim.mapInArrow(run, f"doc_id {slim.dtypes[0][1]}, span long, lang string, n_words long, n_letters long")


def keep_identified(docs: DataFrame, model: Model, options: Options | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language can be told: null and empty texts and texts without
    letters go; repeated rows stay or go together; columns may have any names; an empty table stays empty."""
    shared = _shared(docs, model, options or Options())

    def verdicts(column):
        model, options = _open(shared)
        return [x != "und" for _, texts in _groups(column) for x in predict(texts, model, options)[0]]

    return filter_rows(docs, text_col, verdicts)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that a model may learn from: a stated language, and crc32 of the id as text not divisible by 5."""
    return docs.where(~held_out()).select("doc_id", "text", "lang")
