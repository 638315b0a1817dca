"""Quality by compression: a text is good if a dictionary of good text compresses it better than one of bad text.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is compressed in stretches of
``STRETCH`` bytes with each of them; the difference of the compressed sizes per byte of text is the feature, and a
logistic curve fitted on other labelled rows turns it into a probability. A short text says little, so every text counts
as if ``PRIOR_BYTES`` bytes of average good text stood beside it.

Fitting takes a bounded sample: at most ``SAMPLE_DOCS`` documents per label. Two thirds build the dictionaries, of each document a
stretch of ``SAMPLE_CHARS`` characters from a place that its hash names. One third fits the curve, with whole texts, which are measured in
tasks. Scoring reads whole texts.

Defined cases: null or empty text has the feature of average good text; null ids and labels are not learned from; a document with several labels
has the largest; if either label is missing, the score is the share of good labels (0.5 without any); equal texts get equal scores; an
empty table gives an empty result; extra columns are carried on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import learnable, with_columns_of_text
from shelfwise.session import materialized

SAMPLE_DOCS = 3000
SAMPLE_CHARS = 8000
DICTIONARY_BYTES = 64_000
LEAST_FOR_TRAINING = 64
STRETCH = 2000
LEVEL = 3
PRIOR_BYTES = 150
THRESHOLD = 0.7


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0
    middle: float = 0.0
    scale: float = 1.0
    usual: float = 0.0

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def saved(self, text: str | None) -> tuple[int, int]:
        """Bytes that the good dictionary saves against the bad one, and bytes of text."""
        import zstandard

        if self._compressors is None:
            plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._compressors = [
                zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (self.good, self.bad)
            ]
        if not text or not self.good or not self.bad:
            return 0, 0
        data = text.encode()
        good, bad = (sum(len(c.compress(data[i : i + STRETCH])) for i in range(0, len(data), STRETCH)) for c in self._compressors)
        return bad - good, len(data)

    def feature(self, text: str | None) -> float:
        saved, size = self.saved(text)
        return (saved + self.usual * PRIOR_BYTES) / (size + PRIOR_BYTES)

    def score(self, text: str | None) -> float:
        x = (self.feature(text) - self.middle) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30))))

    @property
    def fitted(self) -> bool:
        return bool(self.good and self.bad and self.slope)

    def accepts(self, texts: list[str | None]) -> list[bool]:
        return [self.score(t) >= THRESHOLD for t in texts]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; too few texts for training give their raw content."""
    import zstandard

    data = [t.encode() for t in texts]
    if len(data) >= LEAST_FOR_TRAINING:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, data)) // 10)), data).as_bytes()
        except zstandard.ZstdError:
            pass  # texts too much alike to train on
    return b"\n".join(data)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float]:
    """slope, shift, middle and scale of the curve, by Newton steps with a small ridge."""
    middle, scale = float(np.median(x)), float(x.std()) or 1.0
    z = np.stack([(x - middle) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (weight * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), middle, scale


def learn(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on bounded samples of the documents that ``labels`` (doc_id, quality) marks 0 or 1 and that may be learned from."""
    marked = labels.where(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = materialized(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), "quality-labels")
    share = dict(marked.groupBy("quality").count().collect())
    # The lowest hash of each bucket: a random choice of at most SAMPLE_DOCS documents per label, known before texts are read.
    h = F.xxhash64("doc_id")
    lowest = marked.groupBy("quality", F.pmod(h, F.lit(SAMPLE_DOCS)).alias("bucket")).agg(F.min(F.struct(h, "doc_id")).alias("m"))
    chosen = F.broadcast(lowest.select("quality", F.col("m.doc_id").alias("doc_id")))
    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(chosen, "doc_id").select("quality", "text", F.hash("text").alias("h"))
    rows = materialized(rows, "quality-sample")
    # Copies of a text count once, and share a side, so nothing that built a dictionary is fitted on.
    side = F.pmod("h", F.lit(3)) == 0
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    stretch = F.substring("text", (F.pmod(F.xxhash64("text"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    build = sorted((r["h"], r["text"], r["quality"]) for r in rows.where(~side).select("quality", "h", stretch).distinct().collect())
    model = QualityModel(*(dictionary([t for _, t, label in build if label == q]) for q in (1, 0)))
    fit = measured(rows.where(side), model) if model.good and model.bad else []
    y = np.array([float(r["quality"]) for r in fit])
    if 0 < y.sum() < len(y):
        # The samples hold as many texts of either label as there are, up to a bound; weights restore the shares.
        weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
        saved, size = (np.array([float(r[c]) for r in fit]) for c in ("saved", "size"))
        # A text counts as one stretch at most, so that a few very long ones do not decide.
        counted = np.minimum(size, STRETCH) * y
        model.usual = float((saved / size * counted).sum() / counted.sum())
        x = (saved + model.usual * PRIOR_BYTES) / (size + PRIOR_BYTES)
        model.slope, model.shift, model.middle, model.scale = logistic(x, y, weight / weight.mean())
    elif share:
        good = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
        model.shift = float(np.log(good / (1 - good)))
    return model


def measured(rows: DataFrame, model: QualityModel) -> list:
    """quality, h, saved and size of every different text of ``rows`` (quality, text, h), by whole texts, in a fixed order."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    added = "saved long, size long"
    found = with_columns_of_text(rows, added, lambda texts: list(zip(*map(sent.value.saved, texts), strict=True)) or [[], []], keep_text=False)
    return sorted(found.distinct().collect(), key=lambda r: (r["h"], r["quality"], r["saved"], r["size"]))


def score_quality(docs: DataFrame, model: QualityModel, keep_text: bool = True) -> DataFrame:
    """``docs`` with score and predicted. A score sees the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[list]:
        scores = [sent.value.score(t) for t in texts]
        return [scores, [int(s >= THRESHOLD) for s in scores]]

    return with_columns_of_text(docs, "score double, predicted int", run, keep_text)
