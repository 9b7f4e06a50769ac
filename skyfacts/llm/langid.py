"""Language identification by a string kernel.

Two texts are as alike as their sets of byte n-grams overlap: the blended
spectrum kernel counts the n-grams of lengths 1 to 3 that both contain, divided
by the geometric mean of their own counts. Nyström landmarks, a few whole texts
of every language, stand for the training texts: K(x, landmarks) times the
inverse root of K(landmarks, landmarks) is a text's feature vector. One ridge
regression per language is fitted on those features. A batch is scored by two
matrix products: presence of the landmarks' n-grams times the landmarks, and
that times the fitted coefficients.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfacts.llm.shared import draw, fold, small_batches

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Training texts per language, and those of them that are landmarks. The sample is bounded; scoring reads everything.
SAMPLE, LANDMARKS = 200, 24
#: Bytes of a language's sample, and texts up to which length are drawn before longer ones.
SAMPLE_BYTES, SHORT_BYTES = 4_000_000, 40_000
RIDGE = 1e-3
#: Texts per matrix product.
ROWS = 128
#: Softness of the score: margins of one-versus-rest outputs are differences of about one.
SHARPNESS = 6.0
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
SPELLED = bytes(
    b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Bytes of text taken at a time, for bounded memory on long texts.
CHUNK = 1 << 20

_scratch: dict[str, np.ndarray] = {}


def has_letter(text: str) -> bool:
    found = LETTER.search(text)  # a letter, or now and then a number that is not a digit
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text[found.end() :])))


def distinct(codes: np.ndarray) -> np.ndarray:
    """Distinct codes below 2**24, without sorting: of equal codes the last one written is kept."""
    if "seen" not in _scratch:
        _scratch["seen"] = np.empty(1 << 24, np.int32)
    seen, order = _scratch["seen"], np.arange(len(codes), dtype=np.int32)
    seen[codes] = order
    return codes[seen[codes] == order]


def grams(text: str) -> list[np.ndarray]:
    """The distinct n-grams of a whole text, as numbers, for each order; words are set off by single spaces."""
    line = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(SPELLED).split()) + b" "
    data = np.frombuffer(line, np.uint8).astype(np.int32)
    out: list[list[np.ndarray]] = [[] for _ in ORDERS]
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + max(ORDERS) - 1]
        for i, n in enumerate(ORDERS):
            size = min(CHUNK, len(part) - n + 1)
            if size > 0:
                codes = part[:size]
                for k in range(1, n):
                    codes = codes << 8 | part[k : k + size]
                out[i].append(distinct(codes))
    return [distinct(np.concatenate(o)) if len(o) > 1 else o[0] if o else np.zeros(0, np.int32) for o in out]


@dataclass
class Spectrum:
    """The n-grams of the landmarks, sorted per order; a text becomes a row of zeros and ones."""

    known: list[np.ndarray]

    @property
    def width(self) -> int:
        return sum(map(len, self.known))

    def columns(self, text: str) -> tuple[np.ndarray, int]:
        """Columns of the known n-grams in a text, and the number of all its distinct n-grams."""
        base, out, total = 0, [], 0
        for own, known in zip(grams(text), self.known, strict=True):
            total += len(own)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out.append(base + at[known[at] == own])
            base += len(known)
        return np.concatenate(out), total

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        presence = np.zeros((len(texts), self.width), np.float32)
        totals = np.ones(len(texts), np.float32)
        for i, text in enumerate(texts):
            columns, total = self.columns(text)
            presence[i, columns] = 1
            totals[i] = max(total, 1)
        return presence, totals


@dataclass
class Model:
    """Fitted languages; `outputs` gives the one-versus-rest values of texts."""

    spectrum: Spectrum
    landmarks: np.ndarray  # (n-grams, landmarks), each column divided by the root of its n-grams
    coefficients: np.ndarray  # (landmarks, languages): inverse root of the landmark kernel times the ridge solution
    languages: list[str]

    def kernel(self, texts: list[str]) -> np.ndarray:
        presence, totals = self.spectrum.rows(texts)
        return (presence @ self.landmarks) / np.sqrt(totals)[:, None]

    def outputs(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.coefficients

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score from 0 to 1 of each text; UNKNOWN with score 0 for a text without letters."""
        own = [i for i, t in enumerate(texts) if t and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(own) if self.languages else 0, ROWS):
            rows = own[at : at + ROWS]
            out = SHARPNESS * self.outputs([texts[i] for i in rows]).astype(np.float64)
            out = np.exp(out - out.max(axis=1, keepdims=True))
            best = out.argmax(axis=1)
            scores[rows] = out[np.arange(len(rows)), best] / out.sum(axis=1)
            for i, b in zip(rows, best.tolist(), strict=True):
                names[i] = self.languages[b]
        return names, scores


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on (text, language) pairs; the first texts of each language are its landmarks."""
    names = sorted(set(languages))
    if not names:
        return Model(Spectrum([np.zeros(1, np.int32)] * len(ORDERS)), np.zeros((0, 0)), np.zeros((0, 0)), [])
    chosen: list[int] = []
    for name in names:
        chosen += [i for i, l in enumerate(languages) if l == name][:landmarks]
    held = [grams(texts[i]) for i in chosen]
    spectrum = Spectrum([np.unique(np.concatenate([h[n] for h in held])) for n in range(len(ORDERS))])
    presence, totals = spectrum.rows([texts[i] for i in chosen])
    model = Model(spectrum, (presence / np.sqrt(totals)[:, None]).T.copy(), np.eye(len(chosen), dtype=np.float32), names)
    inner = model.kernel([texts[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.concatenate([model.kernel(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]).astype(np.float64) @ root
    targets = np.array([[1.0 if l == n else -1.0 for n in names] for l in languages])
    weight = 1 / np.array([languages.count(l) for l in languages])[:, None]  # each language counts the same
    gram = features.T @ (weight * features)
    solved = np.linalg.solve(gram + ridge * len(names) * np.eye(len(gram)), features.T @ (weight * targets))
    model.coefficients = (root @ solved).astype(np.float32)
    return model


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, short_bytes: int = SHORT_BYTES,
) -> Model:
    """Fit on a bounded sample of the labelled rows with letters: per language `sample` rows and `sample_bytes` at most.

    Rows of up to `short_bytes` are drawn by the hash of id and text; a language
    that has too few of them gets longer ones, from the shortest up, so that
    every language with a text is learned. The keys are drawn first, so that
    texts are read for those only.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    labelled = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        F.xxhash64(F.col(id_col), text).alias("key"), F.col(lang_col).alias("language"), text.alias("text"), F.octet_length(text).alias("size")
    )
    marks = draw(labelled.select("key", "language", "size"), "language", sample, sample_bytes, short_bytes)
    if not marks:
        return fit([], [])
    wanted = spark.createDataFrame(marks, "key long, language string")  # `sample` per language
    rows = labelled.join(F.broadcast(wanted), ["key", "language"], "left_semi").dropDuplicates(["key", "language"]).collect()
    nth = {mark: i for i, mark in enumerate(marks)}
    rows.sort(key=lambda r: nth[r["key"], r["language"]])
    return fit([r["text"] for r in rows], [r["language"] for r in rows])


def language(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column struct(lang, score) for a text column, by a model that each task gets once."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        names, scores = held.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<lang: string, score: double>")(text)


def predict_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score) per row; fold `held` of the ids is not learned from.

    A null text, or one without letters, is UNKNOWN with score 0. So is every
    text if no row has a language. Repeated rows and null ids are kept. An
    empty table gives an empty result. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    outside = fold(F.col("id"), folds) == held
    model = train(own.where(~outside), id_col="id", text_col="text", lang_col="lang")
    found = own.select(F.col("id").alias(id_col), outside.alias("held_out"), language(own, model, F.col("text")).alias("found"))
    return found.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
