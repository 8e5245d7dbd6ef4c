"""Language identification with a blended-spectrum presence kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from introngrid.llm.words import slices
from introngrid.storage import materialize

UNKNOWN = "und"
#: Character n-grams of all these lengths count, by presence; they share so many hashed places.
SPECTRUM, PLACES = (1, 2, 3), 1 << 14
#: Labelled rows that the classifier is fitted on, at most, and landmarks of the Nyström map.
SAMPLE, LANDMARKS = 2000, 256
RIDGE = 1e-3
BATCH = 256


def _places(text: str, spectrum=SPECTRUM) -> np.ndarray:
    """Places of a whole text's n-grams, with repeats."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    shift, out = np.uint32(32 - PLACES.bit_length() + 1), []
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, max(spectrum) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] * np.uint32(0x9E3779B1)) + codes[n - 1 :] + np.uint32(n)
        if n in spectrum:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> shift)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(texts: list[str]) -> np.ndarray:
    """Rows of presence features scaled to length 1: their products are the kernel's values."""
    x = np.zeros((len(texts), PLACES), np.float32)
    for i, text in enumerate(texts):
        x[i, _places(text)] = 1
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Classifier:
    """One-versus-rest kernel ridge regression in the space that the landmarks span."""

    def __init__(self, packed: list[bytes], labels: list[str], seed: int = 11):
        self.languages = sorted(set(labels))
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        rng = np.random.default_rng(seed)
        z = self._rows([packed[i] for i in np.sort(rng.permutation(len(packed))[:LANDMARKS])])
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        gram, right, n = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], y.shape[1])), len(packed)
        weight = 1.0 / np.array([labels.count(x) for x in labels], dtype=float)
        for k in range(0, n, BATCH):
            phi = (self._rows(packed[k : k + BATCH]) @ z.T).astype(np.float64) @ root
            heavy = phi * (weight[k : k + BATCH, None] * n / len(self.languages))
            gram += heavy.T @ phi
            right += heavy.T @ y[k : k + BATCH]
        dual = root @ np.linalg.solve(gram + RIDGE * n * np.eye(len(gram)), right)
        # Scores are X @ Z.T @ dual for presence rows X and landmarks Z; the last two factors are multiplied once.
        self.table = (z.T @ dual).astype(np.float32)

    @staticmethod
    def _rows(packed: list[bytes]) -> np.ndarray:
        x = np.stack([np.unpackbits(np.frombuffer(p, np.uint8)) for p in packed]).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        scores = presence(texts) @ self.table
        best = scores.argmax(1)
        top = np.sort(scores, axis=1)
        # Targets are 1 and -1, so a sure case leads the runner-up by 2; a text unlike all landmarks leads by 0.
        lead = top[:, -1] - (top[:, -2] if scores.shape[1] > 1 else -top[:, -1])
        return [self.languages[i] for i in best], np.clip(lead / 2, 0, 1).astype(float)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """A classifier from rows (doc_id, text, lang), by at most `sample` of them and alike many of each language; None without any.

    Every language is learned, by one row at least; only of more languages than `sample`
    the commonest are (ties by name). Rows are ranked by a hash inside their language and equal
    rows count once. Their whole texts become presence bits on the workers, and only
    these, two kilobytes a row, come to the driver.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample), "languages")
    languages = counts.count()
    if not languages:
        return None
    each = max(1, sample // languages)
    # A hash thins each language to some more rows than it needs (too few only if its rows repeat); those are ranked.
    small = F.broadcast(counts.select("lang", (F.lit(2.0 * each + 40) / F.col("n")).alias("share")))
    place = F.xxhash64("doc_id", F.lit("langid"))
    thinned = labelled.join(small, "lang").where((F.pmod(place, F.lit(1 << 40)) < F.col("share") * (1 << 40)) | (F.col("share") >= 1))

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            yield pd.DataFrame({"lang": part["lang"], "doc_id": part["doc_id"], "place": part["place"], "bits": [np.packbits(presence([t])[0] > 0).tobytes() for t in part["text"]]})

    coded = thinned.select("lang", F.col("doc_id").cast("string").alias("doc_id"), place.alias("place"), "text").mapInPandas(bits, "lang string, doc_id string, place long, bits binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "bits"))
    rows = coded.distinct().withColumn("k", rank).where(F.col("k") <= each).select("lang", "doc_id", "bits").collect()
    rows = sorted((r["lang"], r["doc_id"] or "", bytes(r["bits"])) for r in rows)
    return Classifier([r[2] for r in rows], [r[0] for r in rows]) if rows else None


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: Classifier | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the columns {prefix}lang_pred and {prefix}score.

    The prediction uses the whole text and nothing else. It is UNKNOWN with score 0 for
    null texts, texts without a letter, and where there is no model.
    """
    fields = StructType([*docs.schema.fields, StructField(f"{prefix}lang_pred", StringType()), StructField(f"{prefix}score", DoubleType())])
    target = to_arrow_schema(fields)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):  # the other columns pass through as they are
                part = batch.slice(at, BATCH)
                texts = part.column(place).to_pylist()
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                some = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if model else []
                if some:
                    found, s = model.predict([texts[i] for i in some])
                    score[some] = s
                    for i, f in zip(some, found, strict=True):
                        pred[i] = f
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], schema=target)

    return docs.mapInArrow(run, fields)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    It learns from rows that are not held out (CRC-32 of the doc_id as text is not 0
    modulo 5; a null doc_id is not held out) and have a text and a label. Rows are kept
    with repeats; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(base.where(~held_out(F.col("doc_id"))), sample)
    return identify(base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
