"""Language identification by a byte convolutional network, trained here in numpy.

Texts are cut into windows of 256 bytes that cover all of them. Bytes fall into classes (letters without case, digits, UTF-8 lead and
continuation bytes); filters of widths two, three and four run over the classes, the largest response of each filter goes
through a rectifier and a softmax layer, and a document's probabilities are the mean over its windows.

Training uses at most ``per_language`` labelled documents a language (taken by a hash of the id, of the
``languages`` most frequent labels; a rarer label is never predicted) and three windows of each, so its cost does not grow with the corpus; prediction
covers every window of every text.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if no row has a label to learn from; ``und`` may also be a label
that is learned and predicted like any other;
very long texts are read in all their windows, some thousand at a time; of equally likely languages the first by name is predicted;
repeated rows are predicted alike, and rows that share an id and a label are one to learn from; an empty table gives an empty
result; extra input columns, whatever their names, are not read, and the stage hands them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.runtime import columns, pieces, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 250
MAX_LANGUAGES = 200
WINDOWS_EACH = 3
PARTS = 16
EPOCHS = 10
UNKNOWN = "und"
_CHUNK = 512  # windows evaluated at a time
_LETTER = re.compile(rb"[A-Za-z]")


def _byte_classes() -> np.ndarray:
    table = np.empty(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            lead = (b == 0xC2) + 2 * (b == 0xC3) + 3 * (0xC4 <= b < 0xE0) + 4 * (0xE0 <= b < 0xF0) + 5 * (b >= 0xF0)
            table[b] = 29 + lead if b >= 0xC0 else 35 + (b & 31)  # case folds in the low bits of Latin letters
        elif c.isalpha():
            table[b] = 1 + ord(c.lower()) - ord("a")
        else:
            table[b] = 27 if c.isspace() else 28 if c.isdigit() else 29
    return table


CLASS_OF = _byte_classes()
CLASSES = 67  # 0 is padding


@dataclass
class ByteNetwork:
    """Filters ``(width, class, filter)`` by width, their biases, and the softmax layer."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables by pairs of classes (and one class for an odd end) whose sums are the responses."""
        out = []
        for w in self.filters:
            parts = [(w[k][:, None] + w[k + 1][None]).reshape(-1, w.shape[2]) for k in range(0, len(w) - 1, 2)]
            out.append(parts + ([w[-1]] if len(w) % 2 else []))
        return out

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """Class codes ``(position, window)`` to probabilities ``(window, language)``."""
        tables = tables or self.tables()
        codes = windows.astype(np.int32)
        pairs = codes[:-1] * CLASSES + codes[1:]
        best = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = len(codes) - w + 1
            response = parts[0].take(pairs[:n], axis=0)
            for j, table in enumerate(parts[1:], 1):
                at = 2 * j
                response += table.take((pairs if len(table) > CLASSES else codes)[at : at + n], axis=0)
            best.append(response.max(axis=0))
        hidden = np.maximum(np.concatenate(best, axis=1) + self.bias, 0)
        return _softmax(hidden @ self.dense + self.dense_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_windows(data: bytes, window: int = WINDOW) -> np.ndarray:
    """Windows ``(n, window)`` of class codes that cover the text; the last one ends with it."""
    codes = CLASS_OF[np.frombuffer(data, dtype=np.uint8)]
    if len(codes) <= window:
        return np.pad(codes, (0, window - len(codes)))[None]
    whole = len(codes) // window * window
    rows = codes[:whole].reshape(-1, window)
    return rows if whole == len(codes) else np.concatenate((rows, codes[None, -window:]))


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNetwork | None:
    """Fit the network by Adam on windows of the texts; some windows are shortened, so that short texts are known too."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        rows = text_windows(text)
        picked = rows[np.unique(np.linspace(0, len(rows) - 1, WINDOWS_EACH).astype(int))]
        windows.append(picked)
        target += [languages.index(label)] * len(picked)
    x, y = np.concatenate(windows), np.array(target)
    short = rng.random(len(x)) < 0.35
    keep = rng.integers(8, WINDOW, len(x))
    x = np.where(short[:, None] & (np.arange(WINDOW) >= keep[:, None]), 0, x).astype(np.intp)

    net = ByteNetwork(
        languages,
        [rng.normal(0, 0.1, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters, net.bias, net.dense, net.dense_bias]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    lane = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            codes = x[rows]
            best, places = [], []
            for w in net.filters:
                n = WINDOW - len(w) + 1
                response = sum(w[k][codes[:, k : k + n]] for k in range(len(w)))
                place = response.argmax(axis=1)
                places.append(place)
                best.append(np.take_along_axis(response, place[:, None], axis=1)[:, 0])
            raw = np.concatenate(best, axis=1) + net.bias
            hidden = np.maximum(raw, 0)
            error = _softmax(hidden @ net.dense + net.dense_bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = (error @ net.dense.T) * (raw > 0)
            gradients = []
            for j, (w, place) in enumerate(zip(net.filters, places, strict=True)):
                g = np.zeros_like(w)
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(w)):
                    seen = np.take_along_axis(codes, place + k, axis=1)
                    np.add.at(g[k], (seen, np.broadcast_to(lane, seen.shape)), part)
                g[:, 0] = 0
                gradients.append(g)
            gradients += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for i, (w, g) in enumerate(zip(weights, gradients, strict=True)):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w -= 0.01 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    for w in net.filters:
        w[:, 0] = 0
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that training never sees: a third, by the CRC-32 of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train_on(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    languages: int = MAX_LANGUAGES,
) -> ByteNetwork | None:
    """Train on labelled documents outside the held-out third. Ids are chosen without reading texts.

    Rows that share the id and the label are one document here, so at most ``per_language`` of each of ``languages`` labels are collected.
    """
    key = F.xxhash64(F.col(doc_id).cast("string"))
    rows = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # The first ids by hash, of each part of a language and then of all its parts, so that no task sees all ids of a language.
    part = F.pmod("key", F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy("lang", part).orderBy("key", "doc_id"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    keyed = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), key.alias("key"))
    common = keyed.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    ids = keyed.distinct().withColumn("turn", first).where(F.col("turn") <= per_language)
    ids = ids.withColumn("turn", turn).where(F.col("turn") <= per_language).join(F.broadcast(common), "lang")
    ids = ids.select("doc_id", "lang")
    chosen = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), utf8(text).alias("text"))
    chosen = chosen.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most languages * per_language ids
    # Three windows of a document are all that training uses; only they travel.
    size = F.length("text")
    windows = [F.substring("text", 1, WINDOW)]
    for share in (0.5, 1.0):
        start = F.greatest(F.lit(1), F.floor((size - WINDOW) * share).cast("int") + 1)
        windows.append(F.when(size > WINDOW, F.col("text").substr(start, F.lit(WINDOW))))
    each = chosen.select("doc_id", "lang", F.array(*windows).alias("windows")).groupBy("doc_id", "lang").agg(F.min("windows").alias("windows"))
    found = each.select("doc_id", "lang", F.explode("windows").alias("text")).where(F.col("text").isNotNull()).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["text"])))
    return train([bytes(r["text"]) for r in found], [r["lang"] for r in found])


def has_letters(data: bytes | None) -> bool:
    if not data:
        return False
    return bool(_LETTER.search(data)) or (not data.isascii() and any(map(str.isalpha, data.decode("utf-8", "replace"))))


def predict(texts: list[bytes | None], net: ByteNetwork | None, tables=None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    tables = tables or net.tables()
    sums, numbers = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def evaluate() -> None:
        windows = np.concatenate(waiting)
        owner = np.repeat(owners, [len(w) for w in waiting])
        for at in range(0, len(windows), _CHUNK):
            p = net.probabilities(np.ascontiguousarray(windows[at : at + _CHUNK].T), tables)
            for j in range(p.shape[1]):
                sums[:, j] += np.bincount(owner[at : at + _CHUNK], p[:, j], len(texts))
        numbers[:] += np.bincount(owner, minlength=len(texts))
        waiting.clear()
        owners.clear()

    count = 0
    for i, text in enumerate(texts):
        if has_letters(text):
            waiting.append(text_windows(text))
            owners.append(i)
            count += len(waiting[-1])
            if count >= 8 * _CHUNK:
                evaluate()
                count = 0
    if waiting:
        evaluate()
    mean = sums / np.maximum(numbers, 1)[:, None]
    best = mean.argmax(axis=1)
    names = [net.languages[b] if n else UNKNOWN for b, n in zip(best, numbers, strict=True)]
    return names, [float(min(mean[i, b], 1.0)) for i, b in enumerate(best)]


def identify_languages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    languages: int = MAX_LANGUAGES,
) -> DataFrame:
    """Every row of ``docs``: ``doc_id, held_out, lang_pred, score``."""
    net = train_on(docs, doc_id, text, lang, per_language, languages)
    kind = docs.schema[doc_id].dataType.simpleString()

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in pieces(batches, 250):
            names, scores = predict(columns(batch, "text")[0], net, tables)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), utf8(text).alias("text"))
    return rows.mapInArrow(identified, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known_languages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    languages: int = MAX_LANGUAGES,
    wanted: tuple[str, ...] | None = None,
    least_score: float = 0.0,
) -> DataFrame:
    """The rows of ``docs`` with a language, all columns. A row without a label gets the one that is predicted; a given label stays, whatever it is.

    Rejected are texts that are null or have no letters, and, where asked for, those whose prediction is not among the ``wanted`` languages or has
    a score below ``least_score``. Texts are scored where the prediction is used: all of them if it decides, else those without a label. Where no row has a label to learn
    from, nothing is predicted: the letters alone decide, labels stay null, and ``wanted`` rejects all rows. The prediction rides along with its row, so no
    text is shuffled.
    """
    net = train_on(docs, doc_id, text, lang, per_language, languages)
    names, decides = docs.columns, wanted is not None or least_score > 0
    place = names.index(lang)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in pieces(batches, 250):
            texts = [x.encode() if x is not None else None for x in columns(batch, text)[0]]
            labels = batch.column(place).to_pylist()
            keep = [has_letters(x) for x in texts]
            asked = [i for i, good in enumerate(keep) if good and (decides or labels[i] is None)] if net or wanted is not None else []
            for i, name, score in zip(asked, *predict([texts[i] for i in asked], net, tables), strict=True):
                keep[i] = net is not None and (wanted is None or name in wanted) and score >= least_score
                labels[i] = name if labels[i] is None else labels[i]
            batch = batch.set_column(place, batch.schema.field(place), pa.array(labels, batch.schema.field(place).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(kept, docs.schema)
